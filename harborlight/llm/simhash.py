"""SimHash near-duplicates, found by fuzzy hashing with the binary Golay code.

Texts get 64-bit fingerprints of their three-word shingles; fingerprints link at three or fewer differing bits. Of
four 16-bit blocks one is free of errors then, and of the two 23-bit segments of the other 48 bits one has at most one
error. The Golay code parts all 23-bit words into balls of radius three around its 4096 words, so a segment is decoded
to the index of its own code word and, where it lies on the rim of its ball, to the five words at distance four: two
segments that differ in one bit share the own index of either one. A fingerprint is stored under block, segment and
own index (8 keys) and asked for under every index (8 to 48 keys); the join of the two is verified by counting bits.

Equal fingerprints are one node. In each bucket first only the least fingerprint is compared. Buckets of one component
need no more and are dropped. In the others those of the bucket's commonest component meet only the rest, and the rest
meets all, so a dense group costs stars and not its pairs, and no link between groups is lost. What the second join finds
links whole components, which are then joined as nodes.

Defined cases: a null, empty or blank text has fingerprint zero and links like any other; a component without any id
has a null component_id, and of its rows one is kept; repeated rows share a fingerprint, and of them one is kept; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborlight.llm.common import written
from harborlight.llm.components import components

SHINGLE, SEED, BITS = 3, 42, 3
#: Shingles that are counted at once.
BLOCK = 1 << 15
#: Fixed value: the generator polynomial of the Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + SHINGLE - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
        h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, fp): a row a document, with a digest of its text and fp as a signed long."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["doc_id", "digest", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64(docs["text"]).alias("_digest"), "text")
    return rows.mapInArrow(of, f"doc_id {kind}, digest long, fp long")


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits; by syndrome, the six patterns of up to four errors (-1: none)."""
    rest = [1]
    for _ in range(22):
        x = rest[-1] << 1
        rest.append(x ^ GENERATOR if x >> 11 else x)

    def syndromes(bits: list[int]) -> np.ndarray:
        out = np.zeros(1, dtype=np.int64)
        for r in bits:
            out = np.concatenate([out, out ^ r])
        return out

    low, high = syndromes(rest[:12]), syndromes(rest[12:])
    errors = np.full((2048, 6), -1, dtype=np.int64)
    filled = [0] * 2048
    for weight in range(5):
        for places in combinations(range(23), weight):
            s, e = 0, 0
            for p in places:
                s, e = s ^ rest[p], e | 1 << p
            errors[s, filled[s]] = e
            filled[s] += 1
    return low, high, errors


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, index of the fingerprint, whether it is the own key) of every key."""
    low, high, errors = golay()
    fps = fps.view(np.uint64)
    keys, at, own = [], [], []
    index = np.arange(len(fps))
    for block in range(4):
        exact = (fps >> np.uint64(16 * block)) & np.uint64(0xFFFF)
        rest = ((fps >> np.uint64(16 * block + 16)) << np.uint64(16 * block)) if block < 3 else np.zeros_like(fps)
        rest |= fps & np.uint64((1 << 16 * block) - 1)
        for part in range(2):
            segment = ((rest >> np.uint64(23 * part)) & np.uint64(0x7FFFFF)).astype(np.int64)
            pattern = errors[low[segment & 0xFFF] ^ high[segment >> 12]]
            word = (segment[:, None] ^ pattern) >> 11
            table = np.int64((2 * block + part) << 28) | (exact.astype(np.int64) << 12)
            there = pattern >= 0
            keys.append((table[:, None] | word)[there])
            at.append(np.broadcast_to(index[:, None], there.shape)[there])
            own.append(np.broadcast_to(np.arange(6) == 0, there.shape)[there])
    return np.concatenate(keys), np.concatenate(at), np.concatenate(own)


def keyed(fps: DataFrame) -> DataFrame:
    """(key, fp, own) of a table of distinct fingerprints."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            if len(values):
                key, at, own = keys_of(np.ascontiguousarray(values))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(values[at]), pa.array(own)], ["key", "fp", "own"])

    return fps.select("fp").mapInArrow(of, "key long, fp long, own boolean")


def near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= BITS


def links(fps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of distinct fingerprints: (parts, edges), the components (node, root) of stars and the links (a, b) between roots."""
    keys = written(keyed(fps))
    own = keys.where("own").select("key", F.col("fp").alias("a"))
    asked = keys.select("key", F.col("fp").alias("b"))
    first = own.groupBy("key").agg(F.min("a").alias("a"))
    stars = asked.join(first, (asked["key"] == first["key"]) & (F.col("a") != F.col("b")) & near(F.col("a"), F.col("b")))
    parts = written(components(stars.select("a", "b")))
    roots = keys.join(parts.select(F.col("node").alias("fp"), "root"), "fp", "left").select("key", "fp", "own", F.coalesce("root", "fp").alias("root"))
    counted = roots.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    open_ = counted.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    mixed = written(roots.join(open_.select("key", "most"), "key"))  # the buckets of several components
    mine = mixed.where("own").select(F.col("key").alias("k"), F.col("fp").alias("a"), F.col("root").alias("a_root"), (F.col("root") == F.col("most")).alias("a_most"))
    asking = mixed.select("key", F.col("fp").alias("b"), F.col("root").alias("b_root"), (F.col("root") == F.col("most")).alias("b_most"))
    linked = (F.col("k") == F.col("key")) & (F.col("a_root") != F.col("b_root")) & near(F.col("a"), F.col("b"))
    rest = mine.where("not a_most").join(asking, linked).unionByName(mine.where("a_most").join(asking.where("not b_most"), linked))
    return parts, written(rest.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct())


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, fp, group, component_id): a row a document; group is the least fingerprint reachable."""
    rows = written(fingerprints(docs))
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts, edges = links(nodes)
    whole = components(edges).select(F.col("node").alias("root"), F.col("root").alias("group"))
    of_node = nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")).join(whole, "root", "left")
    of_node = written(of_node.select("fp", "least", F.coalesce("group", "root").alias("group")))
    named = of_node.join(of_node.groupBy("group").agg(F.min("least").alias("component_id")), "group")
    return rows.join(written(named.select("fp", "group", "component_id")), "fp").select("doc_id", "digest", "fp", "group", "component_id")


def labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): a row a document."""
    return grouped(docs).select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the smallest id (of the ids that come twice, the least fingerprint)."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "digest")).alias("first")
    return chosen(docs, grouped(docs).groupBy("group").agg(least))


def chosen(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs with the rows named by the groups' `first` (doc_id, digest of the text), one row each.

    Whole rows are shuffled once, by id and text digest, at every size; of repeated rows each task sends one.
    """
    keep = written(groups.select(F.struct(F.col("first.doc_id").alias("doc_id")).alias("_id"), F.col("first.digest").alias("_digest")))
    plain = [docs[c] for c, kind in docs.dtypes if not any(k in kind for k in ("map<", "variant"))]  # what can be hashed
    rows = docs.select(
        F.struct(*(docs[c] for c in docs.columns)).alias("_row"), F.struct(docs["doc_id"].alias("doc_id")).alias("_id"),
        F.xxhash64(docs["text"]).alias("_digest"), F.xxhash64(*plain).alias("_tie"),
    )
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_digest").orderBy("_tie"))).where("_n = 1")
    return once.join(keep, ["_id", "_digest"], "left_semi").select("_row.*")
