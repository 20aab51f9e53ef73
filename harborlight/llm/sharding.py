"""Sharding by histogram sort: shards of near equal bytes, in key order, after one exchange.

A row's key is 40 bits of its text's hash above 24 bits of its id's, so equal texts stand together. A bounded sample of
keys gives each splitter between shards a first range; each round counts, over all partitions, the exact bytes below
PROBES probes in every open range and narrows it (or widens it, where the sample was wrong), until each splitter meets
its tolerance or its range holds no second row. Probes lie between texts as long as a range holds more than one, and a
splitter that falls into a group of equal texts moves to the nearer edge of the group, unless the group is larger than WHOLE of
a shard: so groups up to that size stand in one shard, at the price of shards that differ by half of it at most, and larger
groups are cut where sizes ask for it. Shards consist of pieces of about PIECE bytes,
which are split in the same way; slots are the piece's start plus the rank in the piece, so no task sorts a whole shard.

Defined cases: a null text has 16 bytes and a null checksum; a null id is a value like any other; rows with equal text
and id stay together; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from harborlight.llm.common import carried, unpacked, written

LAW = "bytes"
OVERHEAD = 16
LOW = 24
PROBES = 15
#: The share of a shard up to which a group of equal texts is never cut.
WHOLE = 0.1
#: Keys sampled to begin with, for a splitter and at most in all; bytes of a piece and pieces at most, for the driver's counts.
SAMPLE, SAMPLED, PIECE, PIECES = 32, 500_000, 1 << 28, 100_000
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def key_of(text: Column, doc_id: Column) -> Column:
    upper = F.xxhash64(text).bitwiseAND(F.lit(-(1 << LOW)).cast("long"))
    return upper.bitwiseOR(F.xxhash64(doc_id).bitwiseAND(F.lit((1 << LOW) - 1).cast("long")))


def below(keys: DataFrame, probes: Sequence[int]) -> list[tuple[int, int]]:
    """(bytes, rows) of the keys below each probe; each task adds up its own rows first."""
    edges = np.array(probes, dtype=np.int64)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, n = np.zeros(len(edges) + 1, dtype=np.int64), np.zeros(len(edges) + 1, dtype=np.int64)
        for batch in batches:
            at = np.searchsorted(edges, batch.column(0).to_numpy(zero_copy_only=False), side="right")
            np.add.at(size, at, batch.column(1).to_numpy(zero_copy_only=False))
            n += np.bincount(at, minlength=len(n))
        keep = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(keep), pa.array(size[keep]), pa.array(n[keep])], ["at", "bytes", "n"])

    rows = keys.select("key", "size").mapInArrow(counted, "at long, bytes long, n long").groupBy("at").agg(F.sum("bytes"), F.sum("n"))
    size, n = [0] * (len(probes) + 1), [0] * (len(probes) + 1)
    for at, b, c in rows.collect():  # a row a probe at most
        size[at], n[at] = b, c
    return list(zip(np.cumsum(size).tolist(), np.cumsum(n).tolist()))


def ranges(keys: DataFrame, goal: list[float], total: int, rows: int) -> tuple[list[int], list[int]]:
    """A first range for each splitter, by a sample of at most SAMPLED keys; only the number of rounds depends on it."""
    want = min(SAMPLED, SAMPLE * (len(goal) + 1))
    sample = keys if rows <= want else keys.where(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(rows)) < want)
    once = sample.groupBy("key").agg(F.sum("size").alias("size"))  # a key that many rows have is one row here
    taken = sorted(once.limit(2 * SAMPLED).collect())
    if not taken:
        return [LEAST] * len(goal), [MOST] * len(goal)
    key, size = np.array([k for k, _ in taken], dtype=np.int64), np.cumsum([s for _, s in taken], dtype=np.float64)
    slack = 3 * np.sqrt(len(key)) / 2  # three deviations of a sampled rank
    at = np.searchsorted(size, np.array(goal) * size[-1] / max(1, total))
    bound = lambda i, other: key[np.clip(i, 0, len(key) - 1).astype(int)] if (0 <= i < len(key)) else other
    low, high = [int(bound(i - slack, LEAST)) for i in at], [int(bound(i + slack, MOST)) for i in at]
    return [k >> LOW << LOW for k in low], [min(MOST, (k >> LOW) + 1 << LOW) for k in high]  # between texts


def splitters(keys: DataFrame, shards: int, pieces: int, tolerance: float, total: int, rows: int) -> list[int]:
    """shards * pieces - 1 keys, in order; every pieces-th one parts two shards."""
    count = shards * pieces
    goal = [total * i / count for i in range(1, count)]
    allowed = [total / shards * tolerance * (1 if i % pieces == 0 else 20 / pieces) for i in range(1, count)]
    low, high = ranges(keys, goal, total, rows)
    n_low, n_high, best = [0] * len(goal), [rows] * len(goal), [(float("inf"), LEAST)] * len(goal)
    checked = [False] * len(goal)  # whether the range is known to hold its splitter
    still = list(range(len(goal)))
    while still:
        asked: dict[int, list[int]] = {}
        for i in still:
            span, step = high[i] - low[i], 1 << LOW
            inside = {low[i] + span * j // (PROBES + 1) for j in range(1, PROBES + 1)}
            between = {p >> LOW << LOW for p in inside} if span > step * PROBES else set(range((low[i] >> LOW) + 1 << LOW, high[i], step))
            if between:
                inside = between
            elif i % pieces == pieces - 1 and best[i][0] <= total / shards * WHOLE / 2:  # one group is left, whose edges were asked
                inside = set()
            asked[i] = sorted(p for p in inside if low[i] < p < high[i]) + [low[i], high[i]] * (not checked[i])
        probes = sorted({p for x in asked.values() for p in x})
        under = dict(zip(probes, below(keys, probes))) if probes else {}
        for i in still:
            if not checked[i]:  # the sample's range may lie beside the splitter
                low[i], n_low[i] = (low[i], under[low[i]][1]) if under[low[i]][0] <= goal[i] else (LEAST, 0)
                high[i], n_high[i] = (high[i], under[high[i]][1]) if under[high[i]][0] > goal[i] else (MOST, rows)
                checked[i] = True
            for p in asked[i]:
                size, n = under[p]
                best[i] = min(best[i], (abs(size - goal[i]), p))
                if size <= goal[i] and p >= low[i]:
                    low[i], n_low[i] = p, n
                elif size > goal[i] and p <= high[i]:
                    high[i], n_high[i] = p, n
        still = [i for i in still if best[i][0] > allowed[i] and asked[i] and n_high[i] - n_low[i] > 1]
    found = [p for _, p in best]
    return np.maximum.accumulate(np.array(found, dtype=np.int64)).tolist() if found else []


def sharded(
    docs: DataFrame, shards: int = 40, columns: Sequence[str] | None = None, pieces: int | None = None, tolerance: float = 0.005
) -> DataFrame:
    """Every row with size, text_crc32, law, shard (from 0) and slot (gapless in the shard). pieces: of a shard; None: by bytes."""
    columns = list(columns or docs.columns)
    keys = written(docs.select(key_of(docs["text"], docs["doc_id"]).alias("key"), size_of(docs["text"]).alias("size")))
    total, rows = below(keys, [MOST])[-1]
    pieces = pieces or max(1, min(PIECES // shards, -(-total // (shards * PIECE))))
    edges = splitters(keys, shards, pieces, tolerance, total, rows)
    before = [0, *(n for _, n in below(keys, edges))][: shards * pieces] if edges else [0] * shards * pieces
    # below() has a count for each probe and the total; the start of piece i is the count below splitter i - 1
    first = [before[i // pieces * pieces] for i in range(shards * pieces)]
    starts = docs.sparkSession.createDataFrame(
        [(i, before[i] - first[i]) for i in range(shards * pieces)], "_piece int, _start long"
    )

    @F.pandas_udf(IntegerType())
    def piece(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(edges, dtype=np.int64), key.to_numpy(), side="right").astype("int32"))

    rows = docs.select(
        carried(docs, columns),
        key_of(docs["text"], docs["doc_id"]).alias("_key"),
        size_of(docs["text"]).alias("_size"),
        F.crc32(docs["text"]).alias("_crc"),
        docs["doc_id"].alias("_id"),
    ).withColumn("_piece", piece("_key"))
    rank = F.row_number().over(Window.partitionBy("_piece").orderBy("_key", "_id", "_size"))
    placed = rows.withColumn("_rank", rank).join(F.broadcast(starts), "_piece")  # shards * pieces rows
    return unpacked(
        placed,
        columns,
        size=F.col("_size"),
        text_crc32=F.col("_crc").cast("long"),
        law=F.lit(LAW),
        shard=F.floor(F.col("_piece") / pieces).cast("int"),
        slot=(F.col("_start") + F.col("_rank") - 1).cast("long"),
    )
