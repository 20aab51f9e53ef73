"""Near-duplicate embeddings: a subspace pigeonhole join on cosine.

Vectors are brought to unit length, so cosine >= c means a squared distance of at most 2 - 2c, and turned by a fixed
random rotation, which spreads the distance evenly. Of BLOCKS subspaces one holds at most its share of it. Each block is
range-joined under that budget: coordinates are cut at their means, as many of them as bring a cell to about CELL vectors;
a vector is stored in its own cell and asks in those that its budget reaches (of two cells only one asks the other).
Cells are dealt in chunks of bounded size. A chunk holds the vectors themselves: its pairs within the block's budget are
found by matrix product in float, with a margin, and verified at once, in double precision. A link counts in the block
where it takes the least share of the budget, so once. A chunk gives the number of links of each vector and a forest of
its links, so no table of all pairs comes about, however dense a group is.

Equal vectors are one node with a count; nodes are rows of a written table and told apart by the whole vector, not a hash.
Vectors of each length are joined among themselves, in the same jobs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; very large and very
small components count in full, as vectors are scaled by powers of two first; rows without
an id are counted as links and have no part in component_id; repeated rows are vectors of their own; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlight.llm.common import written
from harborlight.llm.components import components

COSINE, BLOCKS, SEED = 0.95, 4, 5
#: Vectors that cells are cut down to, and vectors of one cell that meet in a task, stored and asking.
CELL, CHUNK = 16_384, 16_384
#: Added to a budget, for float arithmetic; shares of a budget below TIE count as none.
MARGIN, TIE = 1e-5, 1e-9
#: Pairs that are verified at once, and tasks that compare.
PAIRS, TASKS = 1 << 16, 2_000


@cache
def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def bounds(d: int) -> np.ndarray:
    return np.linspace(0, d, min(BLOCKS, d) + 1).astype(int)


def turned(x: np.ndarray) -> np.ndarray:
    """Vectors of one length as unit vectors, rotated."""
    x = scaled(x)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation(x.shape[1])


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times powers of two, which changes no digit, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def given(vectors: DataFrame) -> Column:
    """The vectors in their own kind if that is float, else as doubles."""
    return F.col("embedding").cast("array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>")


def usable(e: Column) -> Column:
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return F.coalesce(good & (F.size(e) > 0), F.lit(False))


def nodes_of(vectors: DataFrame) -> DataFrame:
    """(node, embedding, d, n, least): the different vectors that can link, their length, how often they come, the least id.

    node is a number that a row gets when the table is written.
    """
    rows = vectors.select("vec_id", given(vectors).alias("embedding")).where(usable(F.col("embedding")))
    once = rows.groupBy("embedding").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    return written(once.select(F.monotonically_increasing_id().alias("node"), "embedding", F.size("embedding").alias("d"), "n", "least"))


def by_length(batch: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) of the rows of each length."""
    column = batch.column(at)
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(ends)
    for d in np.unique(sizes):
        places = np.flatnonzero(sizes == d)
        yield places, values[(ends[places][:, None] + np.arange(d)).ravel()].reshape(len(places), d).astype(np.float64)


def cuts_of(nodes: DataFrame) -> dict[int, list[list[tuple[int, float]]]]:
    """By length, of each block the coordinates to cut, most varied first, with their means: none for fewer than CELL vectors.

    There are at most one length for CELL vectors here, so what comes to the driver is small.
    """
    many = [(r.d, r.n) for r in nodes.groupBy("d").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL).collect()]
    if not many:
        return {}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in by_length(batch, 0):
                y = turned(x)
                total[y.shape[1]] = total.get(y.shape[1], 0) + np.stack([y.sum(0), (y * y).sum(0)])
        for d, s in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d), pa.array(range(d)), pa.array(s[0]), pa.array(s[1])], ["d", "i", "x", "xx"])

    rows = nodes.where(F.col("d").isin([d for d, _ in many])).select("embedding").mapInArrow(sums, "d long, i long, x double, xx double")
    found = rows.groupBy("d", "i").agg(F.sum("x").alias("x"), F.sum("xx").alias("xx")).collect()
    out = {}
    for d, n in many:
        of = {r.i: (r.x / n, r.xx / n - (r.x / n) ** 2) for r in found if r.d == d}
        need = int(np.ceil(np.log2(n / CELL)))
        ends = bounds(d)
        order = [sorted(range(a, b), key=lambda i: (-of[i][1], i))[:need] for a, b in zip(ends, ends[1:])]
        out[d] = [[(i, of[i][0]) for i in block] for block in order]
    return out


def celled(nodes: DataFrame, cuts: dict, cosine: float, asking: bool) -> DataFrame:
    """(node, n, embedding, d, block, cell, home): of each block its cell, or those that it reaches and that aren't below its own."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, x in by_length(batch, 2):
                d = x.shape[1]
                y, ends = turned(x), bounds(d)
                for block in range(len(ends) - 1):
                    own, gaps = np.zeros(len(y), np.int64), []
                    for bit, (i, mean) in enumerate(cuts[d][block] if d in cuts else ()):
                        own |= (y[:, i] >= mean).astype(np.int64) << bit
                        gaps.append((y[:, i] - mean) ** 2)
                    at, cell, used = np.arange(len(y)), own, np.zeros(len(y))
                    for bit, gap in enumerate(gaps if asking else ()):
                        over = used + gap[at]
                        near = over <= (2 - 2 * cosine) * (ends[block + 1] - ends[block]) / d + MARGIN
                        at, cell, used = np.concatenate([at, at[near]]), np.concatenate([cell, cell[near] ^ (1 << bit)]), np.concatenate([used, over[near]])
                    keep = cell >= own[at]
                    at, cell = at[keep], cell[keep]
                    rows = batch.take(pa.array(places[at]))
                    more = [pa.array(np.full(len(at), v, np.int32)) for v in (d, block)] + [pa.array(cell), pa.array(cell == own[at])]
                    yield pa.RecordBatch.from_arrays([*rows.columns, *more], ["node", "n", "embedding", "d", "block", "cell", "home"])

    kind = nodes.schema["embedding"].dataType.simpleString()
    return nodes.select("node", "n", "embedding").mapInArrow(of, f"node long, n long, embedding {kind}, d int, block int, cell long, home boolean")


class Forest:
    """Joins nodes 0, 1, ... by links and keeps those links that joined two trees."""

    def __init__(self, n: int):
        self.tree, self.members, self.edges = np.arange(n), {}, []

    def join(self, node: int, others: np.ndarray) -> None:
        while len(others := others[self.tree[others] != self.tree[node]]):
            a, b = self.tree[node], self.tree[others[0]]
            self.edges.append((node, others[0]))
            mine, more = self.members.pop(a, [a]), self.members.pop(b, [b])
            if len(mine) < len(more):
                a, mine, more = b, more, mine
            self.tree[more] = a
            self.members[a] = mine + more


def compared(rows: pa.Table, cosine: float) -> pa.Table:
    """(a, b, n): links of the chunk's forest, and with b null the number of vectors that a links with here."""
    d, block = rows.column("d")[0].as_py(), rows.column("block")[0].as_py()
    flat = rows.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    x = scaled(flat.reshape(rows.num_rows, d).astype(np.float64))
    node, n, home, stored = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n", "home", "stored"))
    node, n, home, stored = node.astype(np.int64), n.astype(np.float64), home.astype(bool), stored.astype(bool)
    names, place = np.unique(node, return_inverse=True)
    y, ends = turned(x), bounds(d)
    part = y[:, ends[block] : ends[block + 1]].astype(np.float32)
    shares = np.diff(ends) * (2 - 2 * cosine) / d
    s, q = np.flatnonzero(stored), np.flatnonzero(~stored)
    far_s, norm = (part[s] ** 2).sum(1), np.sqrt(np.einsum("ij,ij->i", x, x))
    counts, forest = np.zeros(len(names)), Forest(len(names))
    step = max(1, PAIRS * 16 // max(1, len(s)))
    for i in range(0, len(q), step):
        mine = q[i : i + step]
        far = (part[mine] ** 2).sum(1)[:, None] + far_s[None, :] - 2 * (part[mine] @ part[s].T)
        at, to = np.nonzero(far <= np.float32(shares[block] + MARGIN))
        at, to = mine[at], s[to]
        keep = (node[at] < node[to]) | ((node[at] > node[to]) & ~home[at])  # within a cell both ask for each other
        at, to = at[keep], to[keep]
        for k in range(0, len(at), PAIRS):
            a, b = at[k : k + PAIRS], to[k : k + PAIRS]
            true = np.einsum("ij,ij->i", x[a], x[b]) / (norm[a] * norm[b]) >= cosine
            a, b = a[true], b[true]
            over = np.add.reduceat((y[a] - y[b]) ** 2, ends[:-1], axis=1) / shares if len(a) else np.zeros((0, len(shares)))
            here = np.where(over < TIE, 0, over).argmin(1) == block if len(a) else np.zeros(0, bool)
            a, b = a[here], b[here]
            counts += np.bincount(place[a], n[b], len(names)) + np.bincount(place[b], n[a], len(names))
            for group in np.split(np.arange(len(a)), np.flatnonzero(np.diff(a)) + 1):
                if len(group):
                    forest.join(place[a[group[0]]], place[b[group]])
    linked = np.flatnonzero(counts)
    edges = np.array(forest.edges, dtype=np.int64).reshape(-1, 2)
    a = np.concatenate([names[linked], names[edges[:, 0]]])
    b = pa.array(np.concatenate([np.zeros(len(linked), np.int64), names[edges[:, 1]]]), mask=np.arange(len(a)) < len(linked))
    return pa.table({"a": a, "b": b, "n": np.concatenate([counts[linked], np.zeros(len(edges))]).astype(np.int64)})


def links(nodes: DataFrame, cosine: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """(edges, counts): links (a, b) that join what links join, and (node, others), the vectors that a node links with."""
    cuts = cuts_of(nodes)
    stored, asking = celled(nodes, cuts, cosine, False), celled(nodes, cuts, cosine, True)
    cell = ["d", "block", "cell"]
    sizes = stored.groupBy(*cell).agg(F.count(F.lit(1)).alias("stored")).join(asking.groupBy(*cell).agg(F.count(F.lit(1)).alias("asked")), cell)
    pieces = lambda c: F.ceil(F.col(c) / CHUNK).cast("int")
    chunks = written(sizes.select(*cell, pieces("stored").alias("s"), pieces("asked").alias("q")))
    tasks = chunks.agg(F.sum(F.col("s") * F.col("q")).alias("n")).first().n or 1
    deal = lambda n: F.pmod(F.xxhash64("node", F.lit(1)), F.col(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    what = ["node", "n", "embedding", *cell]
    left = stored.join(chunks, cell).select(*what, F.lit(True).alias("home"), F.lit(True).alias("stored"), deal("s").alias("s"), others("q").alias("q"))
    right = asking.join(chunks, cell).select(*what, "home", F.lit(False).alias("stored"), others("s").alias("s"), deal("q").alias("q"))
    # a number of partitions, so that Spark doesn't join them by size: little data is much work here
    dealt = left.unionByName(right).repartition(min(tasks, TASKS), *cell, "s", "q").groupBy(*cell, "s", "q")
    found = written(dealt.applyInArrow(lambda rows: compared(rows, cosine), "a long, b long, n long"))
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    return found.where("b is not null").select("a", "b"), counts


def labelled(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row a vector."""
    nodes = nodes_of(vectors)
    edges, counts = links(nodes, cosine)
    parts = written(components(edges))
    roots = parts.join(nodes.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("component_id"))
    named = parts.join(roots, "root").join(counts, "node", "left").select("node", "component_id", "others")
    found = nodes.join(named, "node", "left").select(
        "embedding", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")
    )
    e = given(vectors)
    rows = vectors.select("vec_id", F.when(usable(e), e).alias("embedding"))  # null joins with nothing
    alone = F.coalesce("component_id", "vec_id")
    return rows.join(found, "embedding", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), alone.alias("component_id"), F.col("vec_id").eqNullSafe(alone).alias("kept")
    )
