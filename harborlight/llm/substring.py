"""Repeated lines, paragraphs and pasted passages: units of words are hashed, and of each the first occurrence stays.

Words are runs of letters and digits in lower case, so punctuation and capitals play no part. Units are

* every line and every paragraph (lines between blank ones) of LINE_WORDS words or more (`lines`; 0 leaves them out), and
* stretches cut by content, for passages that are pasted into lines: of every WINDOW neighbouring boundaries between words
  the one with the least hash of the words beside it is a cut, and a unit goes from each cut to the first one that is
  UNIT_WORDS or more behind. Equal stretches have equal units whatever stands around them: of 51 equal words at least
  UNIT_WORDS are always found, as the first common cut lies within WINDOW words and its unit ends within WINDOW more.

Digests are counted over the corpus; units whose digest comes twice go on, and of each digest the occurrence first by
(document id, place) is kept. The later ones of a document, joined where they overlap or touch, are the passages to remove.
Each is then compared word by word with its first occurrence, up to WINDOW words ahead of it and twice as many behind,
which is as far as a common stretch can reach beyond its units; offsets are those of the original text.

Defined cases: null and wordless texts and those under LINE_WORDS words have no units, nor have lines and paragraphs of
fewer words, unless they lie in a longer repeat; ids order with null last, and rows without an id are documents of their
own, in the order of their texts' digests and then as they were read; rows with one id and different texts are different
documents, ordered by the text's digest; repeated rows with one id are the same occurrence and both kept; a repeat in the
document that has the first occurrence is removed too, unless it overlaps that or `within` is unset; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborlight.llm.common import scratch, written

#: Boundaries of which one is a cut, and words at least of such a unit and of a line or paragraph. A stretch of
#: UNIT_WORDS + 2 * WINDOW words is always found.
WINDOW, UNIT_WORDS, LINE_WORDS = 13, 25, 5
#: Characters whose words are hashed at once.
BLOCK = 1 << 20
#: Odd factors of the hashes.
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
B_INVERSE = np.uint64(pow(int(B), -1, 1 << 64))
SPACE, LINE, BLANK = re.compile(r"\s"), re.compile(r"\n"), re.compile(r"\n\s*\n")


@cache
def alphanumeric() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(0x110000)])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * A
    return h ^ (h >> np.uint64(29))


def words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of a text."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose small form is longer stays as it is
        low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
    hashes, starts, ends = [], [], []
    at = 0
    while at < len(low):
        until = len(low)
        if until - at > BLOCK and (m := SPACE.search(low, at + BLOCK)):
            until = m.start()
        codes = np.frombuffer(low[at:until].encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.concatenate([[False], alphanumeric()[codes], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[::2], edges[1::2]
        if len(start):
            place = np.arange(len(codes)) - np.repeat(np.concatenate([[0], start]), np.diff(np.concatenate([[0], start, [len(codes)]])))
            each = mixed(codes.astype(np.uint64) * B + place.astype(np.uint64) * C) * inside[1:-1]
            hashes.append(mixed(np.add.reduceat(each, start)))
            starts.append(start + at)
            ends.append(end + at)
        at = until
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def parts(start: np.ndarray, text: str, breaks: re.Pattern) -> tuple[np.ndarray, np.ndarray]:
    """(first word, word behind the last) of the stretches between breaks that have words."""
    at = np.searchsorted(np.array([m.start() for m in breaks.finditer(text)], dtype=np.int64), start)
    first = np.flatnonzero(np.concatenate([[True], np.diff(at) > 0]))
    return first, np.append(first[1:], len(start))


def units(text: str | None, lines: int = LINE_WORDS) -> tuple[np.ndarray, ...]:
    """(digest, first word, word behind the last) of each unit."""
    text = text or ""
    h, start, _ = words(text)
    n = len(h)
    found = []
    if lines and n >= lines:
        for breaks in (LINE, BLANK):
            first, behind = parts(start, text, breaks)
            found.append(np.stack([first, behind])[:, behind - first >= lines])
    if n >= UNIT_WORDS:
        between = mixed(h[:-1] * A + h[1:] * C)
        least = np.lib.stride_tricks.sliding_window_view(between, WINDOW).argmin(1)
        cuts = np.unique(np.concatenate([[0], least + np.arange(len(least)) + 1, [n]]))
        to = np.searchsorted(cuts, cuts + UNIT_WORDS)
        found.append(np.stack([cuts[to < len(cuts)], cuts[to[to < len(cuts)]]]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    first, behind = np.unique(np.concatenate(found, axis=1), axis=1)
    with np.errstate(over="ignore"):
        powers = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, B))])
        sums = np.concatenate([[np.uint64(0)], np.add.accumulate(h * powers[:-1])])
        inverse = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, B_INVERSE))])
        digest = mixed((sums[behind] - sums[first]) * inverse[first])
    return digest.view(np.int64), first, behind


#: What tells documents apart: the id, a digest of the text, and a number for rows without id, which are counted one by one.
DOC = ["doc_id", "key", "n"]


def key_of(docs: DataFrame) -> Column:
    return F.shiftrightunsigned(F.xxhash64(docs["text"]), 32)


def unit_rows(docs: DataFrame, lines: int = LINE_WORDS) -> DataFrame:
    """(doc_id, key, n, digest, w0, w1): a row a unit."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [*DOC, "digest", "w0", "w1"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TaskContext.get().partitionId() << 33

        def batch_of(batch: pa.RecordBatch, at: list, numbers: list, found: list) -> pa.RecordBatch:
            sizes = [len(f[0]) for f in found]
            columns = [pa.array(np.concatenate([f[k] for f in found]), t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))]
            places = pa.array(np.repeat(at, sizes))
            return pa.RecordBatch.from_arrays([batch.column(0).take(places), batch.column(1).take(places), pa.array(np.repeat(np.array(numbers, np.int64), sizes)), *columns], names)

        for batch in batches:
            at, numbers, found, size = [], [], [], 0
            for i, (doc_id, text) in enumerate(zip(batch.column(0), batch.column(2))):
                count += 1
                at.append(i)
                numbers.append(0 if doc_id.is_valid else count)
                found.append(units(text.as_py(), lines))
                size += len(found[-1][0])
                if size > 100_000:
                    yield batch_of(batch, at, numbers, found)
                    at, numbers, found, size = [], [], [], 0
            if found:
                yield batch_of(batch, at, numbers, found)

    return docs.select("doc_id", key_of(docs), "text").mapInArrow(of, f"doc_id {kind}, key long, n long, digest long, w0 int, w1 int")


def in_runs(rows: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, key, n, w0, w1, ...) joined where they overlap or touch."""
    order = Window.partitionBy(*DOC).orderBy("w0")
    reached = F.max("w1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.col("w0") <= F.col("reached"), 0).otherwise(1)
    runs = rows.withColumn("reached", reached).withColumn("run", F.sum(begins).over(order)).groupBy(*DOC, "run")
    return runs.agg(F.min("w0").alias("w0"), F.max("w1").alias("w1"), *more)


def around(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, key, place, back, hashes, edges): the words ahead of each place (back) or from it on, nearest first.

    edges: where the word at the place starts (the one before it ends, if not back), and then the outer end of each word.
    places: (doc_id, key, place, back), no row twice; a text has at most two for each word.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    asked = places.groupBy(F.col("doc_id").alias("id"), F.col("key").alias("k")).agg(F.collect_list(F.struct("place", "back")).alias("places"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (text, asks) in enumerate(zip(batch.column(2), batch.column(3))):
                h, start, end = words(text.as_py())
                h, rows = h.view(np.int64), []
                for ask in asks.as_py():
                    at, back = ask["place"], ask["back"]
                    near = np.arange(at - 1, max(-1, at - 1 - WINDOW), -1) if back else np.arange(at, min(len(h), at + 2 * WINDOW))
                    rows.append((at, back, h[near].tolist(), [int(start[at] if back else end[at - 1]), *(start if back else end)[near].tolist()]))
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32())))]
                same = pa.array([i] * len(rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(same), batch.column(1).take(same), *columns], ["doc_id", "key", "place", "back", "hashes", "edges"])

    texts = docs.select("doc_id", key_of(docs).alias("key"), "text")
    near = texts.join(asked, texts["doc_id"].eqNullSafe(F.col("id")) & (texts["key"] == F.col("k"))).select("doc_id", "key", "text", "places")
    near = near.mapInArrow(of, f"doc_id {kind}, key long, place int, back boolean, hashes array<long>, edges array<int>")
    return near.dropDuplicates(["doc_id", "key", "place", "back"])  # of repeated rows one is enough


def extended(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """runs with w0 and w1 moved outwards over words that equal those beside the first occurrence, and with start and end."""
    runs = written(runs.withColumn("run_id", F.monotonically_increasing_id()))
    sides = [("", "w0", True, True), ("a_", "a_w0", True, False), ("", "w1", False, True), ("z_", "z_w1", False, False)]
    asks = [
        runs.select("run_id", F.col(f"{whose}doc_id").alias("doc_id"), F.col(f"{whose}key").alias("key"), F.col(w).alias("place"), F.lit(back).alias("back"), F.lit(own).alias("own"))
        for whose, w, back, own in sides
    ]
    asks = written(asks[0].unionByName(asks[1]).unionByName(asks[2]).unionByName(asks[3]))
    near = around(docs, asks.select("doc_id", "key", "place", "back").distinct()).alias("near")
    same = F.col("asks.doc_id").eqNullSafe(F.col("near.doc_id"))
    for c in ("key", "place", "back"):
        same &= F.col(f"asks.{c}") == F.col(f"near.{c}")
    side = lambda own, back, c: F.max(F.when((F.col("own") == own) & (F.col("asks.back") == back), F.col(c)))
    met = asks.alias("asks").join(near, same).groupBy("run_id").agg(
        *(side(own, back, c).alias(f"{c}_{'own' if own else 'first'}_{'back' if back else 'on'}") for own in (True, False) for back in (True, False) for c in ("hashes", "edges"))
    )

    def equal(where: str) -> Column:
        same = F.zip_with(f"hashes_own_{where}", f"hashes_first_{where}", lambda x, y: F.coalesce(x == y, F.lit(False)))
        at = F.array_position(same, False)
        return F.coalesce(F.when(at > 0, at - 1).otherwise(F.size(same)), F.lit(0)).cast("int")

    def alike(whose: str) -> Column:
        return F.col("doc_id").eqNullSafe(F.col(f"{whose}_doc_id")) & (F.col("key") == F.col(f"{whose}_key")) & (F.col("n") == F.col(f"{whose}_n"))

    # in the first occurrence's own document neither may grow into the other
    kept_to = F.greatest(F.when(alike("a"), F.col("a_w1")), F.when(alike("z"), F.col("z_w1")))
    free = lambda w: F.when(F.col("kept_to").isNull(), F.lit(1 << 30)).otherwise(F.greatest(F.lit(0), w - F.col("kept_to")))
    rows = runs.join(met, "run_id").withColumn("kept_to", kept_to)
    rows = rows.withColumn("more", F.least(equal("back"), free(F.col("w0"))))
    rows = rows.withColumn("on", F.least(equal("on"), free(F.col("w0") - F.col("more"))))
    return rows.select(
        *DOC, (F.col("w0") - F.col("more")).alias("w0"), (F.col("w1") + F.col("on")).alias("w1"),
        F.get("edges_own_back", F.col("more")).alias("start"), F.get("edges_own_on", F.col("on")).alias("end"), "first_doc_id",
    )


def repeats(docs: DataFrame, least: int = LINE_WORDS, within: bool = True, lines: int = LINE_WORDS) -> DataFrame:
    """(doc_id, start, end, n_words, first_doc_id): the passages to remove; first_doc_id has the kept occurrence of its first unit.

    n_words counts the passage's words; passages of fewer than `least` are left.
    """
    with scratch(docs.sparkSession):  # all units are large, and not needed once those that come twice are written
        rows = written(unit_rows(docs, lines))
        twice = written(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("digest"))
        hits = written(rows.join(twice, "digest", "left_semi"), outside=True)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), *DOC, "w0")
    first = written(hits.groupBy("digest").agg(F.min(rank).alias("kept")))  # a table, so that Spark can split the join of a common unit
    later = hits.join(first, "digest")
    same = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("key") == F.col("kept.key")) & (F.col("n") == F.col("kept.n"))
    behind = F.col("w0") >= F.col("kept.w0") + F.col("w1") - F.col("w0")
    later = later.where(~same | (behind & F.lit(within)))
    once = later.groupBy(*DOC, "w0", "w1").agg(F.min("kept").alias("kept"))
    unit = F.struct("kept", "w0", "w1")
    runs = in_runs(once, F.min_by(unit, F.struct("w0", "w1")).alias("a"), F.max_by(unit, F.struct("w1", "w0")).alias("z"))
    of = lambda side: [F.col(f"{side}.kept.{c}").alias(f"{side}_{c}") for c in DOC]
    until = lambda side: (F.col(f"{side}.kept.w0") + F.col(f"{side}.w1") - F.col(f"{side}.w0")).alias(f"{side}_w1")
    runs = runs.select(*DOC, "w0", "w1", *of("a"), F.col("a.kept.w0").alias("a_w0"), until("a"), *of("z"), until("z"), F.col("a.kept.doc_id").alias("first_doc_id"))
    whole = in_runs(extended(docs, runs), F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("first_doc_id", "w0").alias("first_doc_id"))
    out = whole.select("doc_id", "start", "end", (F.col("w1") - F.col("w0")).alias("n_words"), "first_doc_id")
    return out.where(F.col("n_words") >= least)
