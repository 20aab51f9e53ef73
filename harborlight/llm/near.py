"""Near-duplicate texts by exact Jaccard similarity of word shingles; candidates from fuzzy hashing and from MinHash bands.

SimHash fingerprints within three bits, which operator 5 finds by Golay-code keys, hold only the closest copies: at a similarity
of 0.8 some ten of 64 bits differ. So candidates are also all texts that share one of BANDS keys, each of ROWS minima of
the shingles' permuted hashes: a pair of similarity s shares one with 1 - (1 - s^ROWS)^BANDS, which is 0.99 at 0.8.
Every candidate pair is verified on the whole sets of shingles, so no dissimilar pair links.

Texts with the same set are one node. In each bucket of nodes first all are compared with the one that meets most others over
all its buckets, mostly the original of a family; buckets whose nodes are in one component then are done. In the others the
nodes of different components are compared: as pairs, each with the commonest component's nodes or a larger node, where a
bucket is small, and else in tasks that hold two pieces of the bucket and give a forest of the links they find, so a large
family makes no table of its pairs. Sets are made of the texts in buckets only.

Defined cases: words are split at ASCII white space, A-Z in lower case; a text of fewer words than a shingle is one shingle,
and null, empty and blank texts have none and are equal to each other; a component without any id keeps one row; of repeated
rows one is kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlight.llm import simhash
from harborlight.llm.common import written
from harborlight.llm.components import components

SHINGLE, SIMILARITY, BANDS, ROWS, SEED = 5, 0.8, 16, 6, 42
#: Shingles whose hashes are permuted at once, and texts whose results are held at once.
BLOCK, TEXTS = 1 << 11, 512
#: Nodes up to which a bucket's pairs are joined, and nodes of a piece of a larger one.
FEW, PIECE = 24, 512
#: Odd factors of the hashes.
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * A
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's different shingles, in order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], dtype=np.uint64)
    n = max(1, len(h) - size + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(size, len(h))):
        total = mixed(total * B + h[k : k + n])
    return np.unique(total)


def sketch(h: np.ndarray, bands: int, rows: int) -> tuple[str, int, list[int]]:
    """(digest of the set, fingerprint, band keys) of a set of shingles."""
    name = xxhash.xxh3_128_hexdigest(h.tobytes(), SEED)
    if not len(h):
        return name, 0, []
    factors = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) * B) | np.uint64(1)
    least, ones = np.full(bands * rows, np.iinfo(np.uint64).max), np.zeros(64, np.int64)
    for at in range(0, len(h), BLOCK):
        part = h[at : at + BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        least = np.minimum(least, mixed(part[None, :] * factors[:, None]).min(1))
    key = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        key = mixed(key * B + least[k::rows])
    fp = np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0]
    return name, int(fp), key.view(np.int64).tolist()


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def sketches(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, digest, node, fp, keys): a row a document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            found = [sketch(shingles(t.as_py(), shingle), bands, rows) for t in batch.column(2)]
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.int64(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "digest", "node", "fp", "keys"])

    given = docs.select("doc_id", F.xxhash64(docs["text"]).alias("digest"), "text")
    return given.mapInArrow(of, f"doc_id {kind}, digest long, node string, fp long, keys array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes): the sets of the wanted nodes. wanted: (digest, node), one text a node."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            sets = [shingles(t.as_py(), shingle).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

    texts = docs.select(F.xxhash64(docs["text"]).alias("digest"), "text")
    return texts.join(wanted, "digest").select("node", "text").mapInArrow(of, "node string, hashes array<long>").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    size = F.size("x.hashes") + F.size("y.hashes")
    # sets too different in size can't be similar; both are whole
    able = F.least(F.size("x.hashes"), F.size("y.hashes")) >= F.lit(similarity) * F.greatest(F.size("x.hashes"), F.size("y.hashes"))
    met = pairs.join(sets.alias("x"), F.col("a") == F.col("x.node")).join(sets.alias("y"), (F.col("b") == F.col("y.node")) & able)
    common = F.size(F.array_intersect("x.hashes", "y.hashes"))
    return met.where(common >= F.lit(similarity) * (size - common)).select("a", "b")


def compared(rows: pa.Table, similarity: float) -> pa.Table:
    """(a, b): links between different components of some nodes (node, root, small: shortened hashes), a forest of them.

    A set's members are marked in a table of all members, so one sum gives its common members with all others.
    """
    names, group = rows.column("node").to_pylist(), np.unique(rows.column("root").to_pylist(), return_inverse=True)[1]
    sets = rows.column("small").combine_chunks()
    sizes = np.diff(sets.offsets.to_numpy())
    _, member = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(member.max(initial=-1) + 1, dtype=np.int32)
    found: tuple[list, list] = ([], [])
    for u in range(len(names)):
        if (group[u:] == group[u]).all():
            continue
        mine = member[at[u] : at[u + 1]]
        mark[mine] = 1
        common = np.add.reduceat(mark[member[at[u] :]], at[u:-1] - at[u])
        mark[mine] = 0
        near = u + np.flatnonzero((common >= similarity * (sizes[u] + sizes[u:] - common) - 1e-9) & (group[u:] != group[u]))
        for v in near:
            if group[u] != group[v]:
                found[0].append(names[u])
                found[1].append(names[v])
                group[group == group[v]] = group[u]
    return pa.table({"a": pa.array(found[0], pa.string()), "b": pa.array(found[1], pa.string())})


def inside(buckets: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between components in large buckets (key, node, root, n), found where a bucket's pieces lie together.

    Hashes are shortened to 32 bits here, so the links still have to be verified.
    """
    pieces = F.ceil(F.col("n") / PIECE).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit(1)), pieces).cast("int")
    small = F.transform("hashes", lambda h: h.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    rows = buckets.join(sets, "node").select("key", "node", "root", small.alias("small"), mine.alias("i"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("j"))
    dealt = rows.select("key", "node", "root", "small", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q")).groupBy("key", "p", "q")
    return dealt.applyInArrow(lambda t: compared(t, similarity), "a string, b string")


def grouped(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, digest, node, group): a row a document; group is the least node reachable by verified links."""
    made = written(sketches(docs, shingle, bands, rows))
    nodes = written(made.groupBy("node").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.min("digest").alias("digest")))
    parts, edges = simhash.links(nodes.select("fp").distinct())
    whole = components(edges).select(F.col("node").alias("root"), F.col("root").alias("family"))
    family = parts.join(whole, "root", "left").select(F.col("node").alias("fp"), F.coalesce("family", "root").alias("family"))
    of_family = nodes.where(F.size("keys") > 0).join(family, "fp", "left").select("node", F.xxhash64(F.lit("family"), F.coalesce("family", "fp")).alias("key"))
    keys = nodes.select("node", F.explode("keys").alias("key")).unionByName(of_family)
    shared = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    held = written(keys.join(shared, "key"))
    # the node that meets most others in all its buckets is the middle of a family, so that one star joins it
    middle = written(held.groupBy("node").agg(F.sum("n").alias("met")))
    first = held.join(middle, "node").groupBy("key").agg(F.max_by("node", F.struct("met", "node")).alias("first"))
    buckets = written(held.select("key", "node").join(written(first), "key"))
    wanted = buckets.select("node").distinct().join(nodes.select("node", "digest"), "node")
    sets = written(sets_of(docs, written(wanted), shingle))
    stars = buckets.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    near = written(verified(stars, sets, similarity))
    roots = written(components(near))
    rooted = buckets.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    counted = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    open_ = counted.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("most"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("roots")).where("roots > 1").drop("roots")
    left = rooted.join(open_, "key").select("key", "node", "root", "n", (F.col("root") == F.col("most")).alias("common"))
    left = written(left)
    few = left.where(F.col("n") <= FEW)
    other = (F.col("u.key") == F.col("v.key")) & (F.col("u.root") != F.col("v.root")) & (F.col("v.common") | (F.col("u.node") < F.col("v.node")))
    more = few.where("not common").alias("u").join(few.alias("v"), other).select(F.col("u.node").alias("a"), F.col("v.node").alias("b"))
    more = more.unionByName(written(inside(left.where(F.col("n") > FEW), sets, similarity)))
    asked = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(asked, ["a", "b"], "left_anti")
    root_of: Column = F.coalesce("root", "node")
    again = verified(more, sets, similarity)
    again = again.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    tops = components(written(again.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))))
    tops = tops.select(F.col("node").alias("root"), F.col("root").alias("top"))
    named = nodes.select("node").join(roots, "node", "left").select("node", root_of.alias("root")).join(tops, "root", "left")
    named = written(named.select("node", F.coalesce("top", "root").alias("group")))
    return made.select("doc_id", "digest", "node").join(named, "node").select("doc_id", "digest", "node", "group")


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs with one row of each group: that of the smallest id (of the ids that come twice, the least digest)."""
    found = grouped(docs, similarity, shingle, bands, rows)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    return simhash.chosen(docs, found.groupBy("group").agg(first))
