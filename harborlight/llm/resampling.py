"""Importance resampling of documents towards a target's distribution of hashed word runs.

Arrow's UTF-8 buffers are read as they lie: a table classifies every byte (letters, digits and all bytes of non-ASCII letters
are parts of words), words begin and end where the class or the text changes, and a table-driven CRC-32 takes the k-th
byte of all words at once, in order of their lengths; a run of several words goes on from the state of the run before. Words
of more than LONG bytes are rare and take zlib's CRC, which has the same values.

Runs are counted by bucket over all documents and over the whole target, each task sending one row a bucket at most. A
bucket's gain is 1000 times the logarithm of its smoothed share in the target over that in the documents, a text's weight the
mean gain of its runs, all floored; the score adds noise of Gumbel's distribution from a digest of the id, so the highest
scores are a draw without replacement by weight. The least score that can be drawn is read from counts by score (as many
as scores can have values); the rows at or above it are dealt by range of (score, id), so ranks need no task with all rows.

Defined cases: a null, empty or wordless text has no runs and weight 0; a null id's noise is that of an empty id, and it comes
behind other ids on a tie; rows that tie by score and id are ranked by runs, then by weight, then in any order; repeated rows
count each; an empty table gives an empty result; without a target all shares of it are the smoothing's; columns of any
name are carried in a struct, and ours replace those of the same name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborlight.llm.common import carried, unpacked, written

BUCKETS, RUNS, SEED, LEAST_WORDS, PERCENT = 10_000, 2, 7, 20, 25
#: Bytes of texts and words that are worked on at once; words of more bytes than LONG are hashed one by one.
BYTES, BLOCK, LONG = 1 << 22, 1 << 18, 48
#: Fixed value: the reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320


def byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By byte: its small form, whether it is part of a word, its CRC."""
    small = np.arange(256, dtype=np.uint8)
    small[ord("A") : ord("Z") + 1] += 32
    inside = np.zeros(256, dtype=bool)
    inside[ord("0") : ord("9") + 1] = inside[ord("a") : ord("z") + 1] = inside[ord("A") : ord("Z") + 1] = inside[128:] = True
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(POLYNOMIAL), crc >> 1)
    return small, inside, crc


SMALL, INSIDE, CRC = byte_tables()


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null takes none."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    if column.null_count:  # a null's place may hold bytes
        there = np.diff(offsets) * column.is_valid().to_numpy(zero_copy_only=False)
        if there.sum() != offsets[-1] - offsets[0]:
            return bytes_of(column.fill_null(""))
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the words between offsets[0] and offsets[-1], whose bytes are `data`."""
    inside = INSIDE[data]
    opens = np.zeros(len(data) + 1, dtype=bool)
    opens[offsets - offsets[0]] = True  # a text begins or ends here
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | opens[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | opens[1:-1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets[1:] - offsets[0], start, side="right")


def advanced(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC states after the bytes from start to end, all taken a byte at a time together."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    s, at, sizes = state[order], start[order], size[order]
    long = int(np.searchsorted(-sizes, -LONG, side="left"))  # these have more bytes
    for i in range(long):
        s[i] = zlib.crc32(data[at[i] : at[i] + sizes[i]], int(s[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    active = len(s) - np.searchsorted(sizes[::-1], np.arange(int(sizes[long]) if long < len(s) else 0), side="right")
    for k, n in enumerate(active):  # those with more than k bytes
        part = s[long:n]
        s[long:n] = CRC[(part ^ data[at[long:n] + k]) & 0xFF] ^ (part >> np.uint32(8))
    out = np.empty_like(s)
    out[order] = s
    return out


def runs_of(column: pa.Array, runs: int = RUNS, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(text, bucket, whether they are single words) of all runs of up to so many words, block by block."""
    data, offsets = bytes_of(column)
    cut = 0
    while cut < len(column):
        until = max(cut + 1, int(np.searchsorted(offsets, offsets[cut] + BYTES, side="right")) - 1)
        part = SMALL[data[offsets[cut] : offsets[until]]]
        start, end, text = spans(part, offsets[cut : until + 1])
        for i in range(0, len(start), BLOCK):
            n = min(i + BLOCK, len(start))
            state = np.full(n - i, 0xFFFFFFFF, dtype=np.uint32)
            for k in range(runs):
                here = np.arange(i, min(n, len(start) - k))
                here = here[text[here] == text[here + k]]
                state = state[here - i] if k == 0 else state[np.isin(before, here, assume_unique=True)]
                if k:
                    state = CRC[(state ^ 0x20) & 0xFF] ^ (state >> np.uint32(8))
                state = advanced(state, part, start[here + k], end[here + k])
                yield text[here] + cut, ((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64), k == 0
                before = here
        cut = until


def counted(texts: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """Runs by bucket over all texts; a row a bucket at most comes to the driver."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, bucket, _ in runs_of(batch.column(0), runs, buckets):
                total += np.bincount(bucket, minlength=buckets)
        keep = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keep), pa.array(total[keep])], ["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in texts.select("text").mapInArrow(of, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of the shares' ratio, by bucket, floored."""
    b, s_all, t_all = len(docs), int(docs.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + b)) / float((s + 1) * (t_all + b)))) for s, t in zip(docs.tolist(), target.tolist())], dtype=np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def scored(docs: DataFrame, target: DataFrame, columns: Sequence[str] | None = None, runs: int = RUNS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(_row, _id, _n, _words, _weight, _score): a row a document; _row holds the columns to carry."""
    gain = gains(counted(docs, runs, buckets), counted(target, runs, buckets))
    kind = docs.select(carried(docs, columns))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, n, words = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for text, bucket, single in runs_of(batch.column(1), runs, buckets):
                total += np.bincount(text, gain[bucket], batch.num_rows).astype(np.int64)
                each = np.bincount(text, minlength=batch.num_rows)
                n += each
                words += each * single
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in (n, words, weight))], ["_row", "_n", "_words", "_weight"])

    rows = docs.select(F.struct(carried(docs, columns), docs["doc_id"].alias("_id")).alias("_row"), "text")
    shape = f"_row struct<_row: {kind.schema[0].dataType.simpleString()}, _id: {docs.schema['doc_id'].dataType.simpleString()}>, _n long, _words long, _weight long"
    found = rows.mapInArrow(of, shape).select("_row._row", "_row._id", "_n", "_words", "_weight")
    return found.withColumn("_score", F.col("_weight") + noise(F.col("_id"), seed))


def ranked(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored() rows with _rank: from 1 by score and id for the share that is drawn, else null."""
    rows = written(rows)
    fits = F.col("_words") >= least_words
    levels = rows.where(fits).groupBy("_score").agg(F.count(F.lit(1)).alias("n"))
    draw = F.floor(F.lit(percent) * F.sum("n").over(Window.partitionBy()) / 100)
    over = F.sum("n").over(Window.orderBy(F.desc("_score")).rowsBetween(Window.unboundedPreceding, -1))
    levels = levels.select("_score", draw.alias("draw"), F.coalesce(over, F.lit(0)).alias("over"))  # as many rows as scores have values
    last = levels.where("over < draw").agg(F.min("_score").alias("least"), F.max("draw").alias("draw")).first()
    able = fits & (F.col("_score") >= F.lit(last.least)) if last.least is not None else F.lit(False)
    rest = rows.where(~F.coalesce(able, F.lit(False))).withColumn("_rank", F.lit(None).cast("long"))
    if last.least is None:
        return rest
    order = [F.desc("_score"), F.asc_nulls_last("_id"), "_n", "_weight", "_tie"]
    dealt = rows.where(able).withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt)
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    rank = F.col("_before") + F.col("_place")
    drawn = dealt.withColumn("_place", place).join(F.broadcast(sizes.select("_part", before)), "_part")
    return rest.unionByName(drawn.withColumn("_rank", F.when(rank <= last.draw, rank).cast("long")).select(*rest.columns))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The documents that are drawn, with n_features, weight, score and rank."""
    return numbered(docs, target, None, percent, least_words, seed).where("rank is not null")


def numbered(
    docs: DataFrame, target: DataFrame, columns: Sequence[str] | None = None, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """Every document with n_features, weight, score and rank (null if it isn't drawn). target has a column text."""
    columns = list(columns or docs.columns)
    rows = ranked(scored(docs, target, columns, seed=seed), percent, least_words)
    return unpacked(rows, columns, n_features=F.col("_n"), weight=F.col("_weight"), score=F.col("_score"), rank=F.col("_rank"))
