"""Hard negatives by one-dimensional distance keys: rows stored by (pivot, distance), scanned in annuli around each anchor.

Vectors become integers, floor(256 x), and scores are their inner products. With M the largest length, a row gets one more
component, sqrt(M^2 - |x|^2), and an anchor a zero there; then high scores are small distances: d^2 = |q|^2 + M^2 - 2 score.
Pivots come from a bounded sample, and only the amount of work depends on them. Each row is stored by (its nearest pivot,
its distance to it), in that order; stretches of the key are cells, whose number has a fixed bound, so their exact ends and
counts are a small directory. By the triangle inequality a cell's key interval bounds the scores of its rows from both sides.

An anchor asks cells from the highest bound downwards: first those with FIRST rows, then GROWTH times as many, and so on,
skipping the ones above the scores that it wants (the inner side of the annulus), until its k-th find beats the bound of
every cell not yet asked, or none is left. Cells are dealt in pieces of rows and chunks of anchors of bounded size, so
neither a cell with a third of all rows nor one that all anchors ask is one task. Positives are searched first, then for all
positives of an anchor together the negatives between `low` and `high` hundredths of their scores.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part; vectors meet those of
their own length only, empty ones score zero; components are clipped to a long, and scores that exceed it, which are
calculated exactly, too; ties go to the smaller id, null ids last, repeated rows are rows of their own (so a positive may
come twice, and a repeated anchor repeats its results); a null id is no anchor; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborlight.llm.common import written

POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Rows of a cell as intended, cells at most, rows that pivots and rings come from, rounds of Lloyd's for pivots.
CELL, CELLS, SAMPLE, LLOYD, SEED = 1_024, 65_536, 8_192, 5, 7
#: Rows of a piece and anchors of a chunk, which meet in one task; scores that are held at once.
PIECE, CHUNK, SCORES = 8_192, 2_048, 1 << 21
#: Rows that an anchor asks for at first, and how much more in each round.
FIRST, GROWTH = 2_048, 8
#: Of float arithmetic on bounds, in parts of |q|^2 + M^2.
MARGIN = 1e-6
EXACT = float(1 << 53)


class Keys(NamedTuple):
    """Of one length of vectors: M^2, pivots in the larger space, and the ends of each pivot's rings."""

    most: float
    pivots: np.ndarray
    rings: list[np.ndarray]


class Cells(NamedTuple):
    """The directory of one length: of each cell pivot, least and greatest distance, rows."""

    cell: np.ndarray
    pivot: np.ndarray
    near: np.ndarray
    far: np.ndarray
    rows: np.ndarray


def usable(e: Column) -> Column:
    return F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integers(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, label, x, d): the rows that take part, each with a number of its own."""
    e = F.col("embedding").cast("array<double>")
    good = vectors.where(F.col("label").isNotNull() & usable(e))
    x = F.transform(e, lambda v: F.floor(v * 256.0).cast("long"))
    return written(good.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("label").cast("long").alias("label"), x.alias("x"), F.size("embedding").alias("d")))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), d)


def by_length(batch: pa.RecordBatch, x: int, d: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    sizes = batch.column(d).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes):
        part = batch.take(pa.array(np.flatnonzero(sizes == n)))
        yield int(n), part, matrix(part.column(x), int(n)).astype(np.float64)


def distances(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1) + extra**2
    return np.sqrt(np.maximum(0, square[:, None] + (pivots**2).sum(1)[None, :] - 2 * (x @ pivots[:, :-1].T + extra[:, None] * pivots[None, :, -1])))


def keys_of(rows: DataFrame) -> dict[int, Keys]:
    """Pivots and rings of each length that more than PIECE rows have, from a sample of at most SAMPLE rows (by digest) of each."""
    norm = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    many = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("most")).where(F.col("n") > PIECE).collect()  # at most n / PIECE
    out = {}
    for d, n, most in many:
        mine = rows.where(F.col("d") == d)
        sample = mine.where(F.pmod(F.xxhash64("row", F.lit(SEED)), F.lit(n)) < SAMPLE).select("x").limit(2 * SAMPLE).toArrow()
        x = matrix(sample.column(0), d).astype(np.float64)
        if not len(x):
            continue
        x = np.column_stack([x, np.sqrt(np.maximum(0, most - (x * x).sum(1)))])
        cells = min(CELLS, -(-n // CELL))
        count = max(1, min(256, round(cells**0.5), len(x)))
        pivots = x[np.random.default_rng(SEED).choice(len(x), count, replace=False)]
        for _ in range(LLOYD):
            nearest = distances(x[:, :-1], x[:, -1], pivots).argmin(1)
            pivots = np.stack([x[nearest == i].mean(0) if (nearest == i).any() else pivots[i] for i in range(count)])
        far = distances(x[:, :-1], x[:, -1], pivots)
        nearest, far = far.argmin(1), far.min(1)
        share = np.linspace(0, 1, max(1, min(256, -(-cells // count))) + 1)[1:-1]
        out[d] = Keys(float(most), pivots, [np.unique(np.quantile(far[nearest == i], share)) if (nearest == i).any() else np.zeros(0) for i in range(count)])
    return out


def stored(rows: DataFrame, keys: dict[int, Keys]) -> DataFrame:
    """rows with pivot, dist and cell, in the order of (d, pivot, dist)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part, x in by_length(batch, 3, 4):
                pivot, dist, cell = np.zeros(len(x), np.int32), np.zeros(len(x)), np.zeros(len(x), np.int32)
                if d in keys:
                    most, pivots, rings = keys[d]
                    far = distances(x, np.sqrt(np.maximum(0, most - (x * x).sum(1))), pivots)
                    pivot, dist = far.argmin(1).astype(np.int32), far.min(1)
                    for i in np.unique(pivot):
                        cell[pivot == i] = i * 256 + np.searchsorted(rings[i], dist[pivot == i], side="right")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pivot), pa.array(dist), pa.array(cell)], ["row", "vec_id", "label", "x", "d", "pivot", "dist", "cell"])

    id_kind = rows.schema["vec_id"].dataType.simpleString()
    found = rows.mapInArrow(of, f"row long, vec_id {id_kind}, label long, x array<bigint>, d int, pivot int, dist double, cell int")
    order = ["d", "pivot", "dist", "row"]
    return written(found.repartitionByRange(*order).sortWithinPartitions(*order))


def directory(store: DataFrame, keys: dict[int, Keys]) -> dict[int, Cells]:
    """At most 256 * 256 cells for each length that has keys."""
    if not keys:
        return {}
    ends = store.where(F.col("d").isin(list(keys))).groupBy("d", "cell").agg(F.first("pivot"), F.min("dist"), F.max("dist"), F.count(F.lit(1))).collect()
    return {d: Cells(*(np.array(c) for c in zip(*(r[1:] for r in sorted(ends) if r[0] == d)))) for d in {r[0] for r in ends}}


def bounds(q: np.ndarray, keys: Keys, cells: Cells) -> tuple[np.ndarray, np.ndarray]:
    """(greatest, least) score of each anchor with the rows of each cell, with a margin."""
    to = distances(q, np.zeros(len(q)), keys.pivots)[:, cells.pivot]
    square = (q * q).sum(1)[:, None] + keys.most
    slack = 1 + MARGIN * square
    near = np.maximum(0, np.maximum(cells.near - to, to - cells.far))
    high = np.minimum((square - near**2) / 2, np.sqrt((q * q).sum(1) * keys.most)[:, None])
    return high + slack, (square - (to + cells.far) ** 2) / 2 - slack


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The scores s with low * score <= 100 * s <= high * score."""
    return -((-low * score) // 100), high * score // 100


def asking(anchors: DataFrame, keys: dict[int, Keys], cells: dict[int, Cells], step: int, low: int, high: int) -> DataFrame:
    """(row, label, x, d, wanted, held, ask, bound): the cells that each anchor asks in this round, and the bound of those that it hasn't asked yet (null: none is left).

    wanted: the positives' scores whose negatives are searched, or empty to search for positives. held: for each of them (or
    the positives) the score of the k-th find so far, null without one.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part, q in by_length(batch, 2, 3):
                wanted = part.column(4).to_pylist()
                asked, bound = [[0]] * len(q) if step == 0 else [[]] * len(q), [None] * len(q)
                if d in cells:
                    top, bottom = bounds(q, keys[d], cells[d])
                    upto = [0 if r < 0 else FIRST * GROWTH**r for r in (step - 1, step)]
                    for i, scores in enumerate(wanted):
                        spans = [window(s, low, high) for s in scores]
                        least, most = min((a for a, _ in spans), default=-np.inf), max((b for _, b in spans), default=np.inf)
                        order = np.argsort(-top[i], kind="stable")
                        order = order[(top[i][order] >= least) & (bottom[i][order] <= most)]
                        before = np.concatenate([[0], np.cumsum(cells[d].rows[order])])[:-1]  # rows of the cells in front
                        new = order[(before >= upto[0]) & (before < upto[1])]
                        rest = order[before >= upto[1]]
                        asked[i] = cells[d].cell[new].tolist()
                        bound[i] = float(top[i][rest[0]]) if len(rest) else None
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(asked, pa.list_(pa.int32())), pa.array(bound, pa.float64())], ["row", "label", "x", "d", "wanted", "held", "ask", "bound"])

    return anchors.select("row", "label", "x", "d", "wanted", "held").mapInArrow(of, "row long, label long, x array<bigint>, d int, wanted array<bigint>, held array<bigint>, ask array<int>, bound double")


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: in doubles where no sum can exceed 2^53, else in Python's integers, clipped to a long."""
    norm = lambda v: np.sqrt((v.astype(np.float64) ** 2).sum(1).max(initial=0))
    if norm(q) * norm(x) < EXACT:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    exact = np.dot(q.astype(object), x.astype(object).T)
    return np.array([[min(max(int(v), -(1 << 63)), (1 << 63) - 1) for v in line] for line in exact], dtype=np.int64).reshape(len(q), len(x))


def best(group: pa.Table, positives: int, negatives: int, low: int, high: int) -> pa.Table:
    """(row, wanted, vec_id, score): of a piece of a cell, each anchor's first positives, or its first negatives for each wanted score, unless behind what is held."""
    d = group.column("d")[0].as_py()
    asks = np.flatnonzero(group.column("asks").to_numpy(zero_copy_only=False))
    there = group.filter(pa.compute.invert(group.column("asks")))
    there = there.take(pa.compute.sort_indices(there, sort_keys=[("vec_id", "ascending"), ("row", "ascending")], null_placement="at_end"))
    rows, anchors = there.column("row").to_numpy(zero_copy_only=False), group.take(pa.array(asks))
    x, label = matrix(there.column("x"), d), there.column("label").to_numpy(zero_copy_only=False)
    q, q_label = matrix(anchors.column("x"), d), anchors.column("label").to_numpy(zero_copy_only=False)
    q_row, wanted, held = anchors.column("row").to_numpy(zero_copy_only=False), anchors.column("wanted").to_pylist(), anchors.column("held").to_pylist()
    out: tuple[list, list, list, list] = ([], [], [], [])

    def first(i: int, score: np.ndarray, fit: np.ndarray, k: int, want: int | None, least: int | None) -> None:
        at = np.flatnonzero(fit if least is None else fit & (score >= least))
        if len(at) > k:
            at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
        at = at[np.argsort(-score[at], kind="stable")][:k]
        for values, more in zip(out, ([int(q_row[i])] * len(at), [want] * len(at), at.tolist(), score[at].tolist())):
            values += more

    size = max(1, SCORES // max(1, len(x)))
    for at in range(0, len(q) if len(x) else 0, size):
        part = products(q[at : at + size], x)
        for i, score in enumerate(part, at):
            same = label == q_label[i]
            if wanted[i]:
                for want, kth in zip(wanted[i], held[i] or [None] * len(wanted[i])):
                    least, most = window(want, low, high)
                    first(i, score, ~same & (score >= least) & (score <= most), negatives, want, kth)
            else:
                first(i, score, same & (rows != q_row[i]), positives, None, held[i][0] if held[i] else None)
    ids = there.column("vec_id").take(pa.array(out[2], pa.int64()))
    return pa.table({"row": pa.array(out[0], pa.int64()), "wanted": pa.array(out[1], pa.int64()), "vec_id": ids, "score": pa.array(out[3], pa.int64())})


def met(asks: DataFrame, store: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """best() of all pieces of the cells that are asked."""
    cell = ["d", "cell"]
    asks = asks.select("row", "label", "x", "d", "wanted", "held", F.explode("ask").alias("cell"))
    sizes = store.groupBy(*cell).agg(F.count(F.lit(1)).alias("rows")).join(asks.groupBy(*cell).agg(F.count(F.lit(1)).alias("asked")), cell)
    parts = written(sizes.select(*cell, F.ceil(F.col("rows") / PIECE).cast("int").alias("p"), F.ceil(F.col("asked") / CHUNK).cast("int").alias("c")))
    tasks = parts.agg(F.sum(F.col("p") * F.col("c")).alias("n")).first().n or 1
    deal = lambda n: F.pmod(F.xxhash64("row", F.lit(1)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    none = lambda c, df: F.lit(None).cast(df.schema[c].dataType).alias(c)
    left = store.join(parts, cell).select("row", "vec_id", "label", "x", none("wanted", asks), none("held", asks), F.lit(False).alias("asks"), *cell, deal("p").alias("p"), each("c").alias("c"))
    right = asks.join(parts, cell).select("row", none("vec_id", store), "label", "x", "wanted", "held", F.lit(True).alias("asks"), *cell, each("p").alias("p"), deal("c").alias("c"))
    dealt = left.unionByName(right).repartition(min(tasks, 2_000), *cell, "p", "c").groupBy(*cell, "p", "c")
    id_kind = store.schema["vec_id"].dataType.simpleString()
    return dealt.applyInArrow(lambda group: best(group, positives, negatives, low, high), f"row long, wanted long, vec_id {id_kind}, score long")


def certain(last: Column, wanted: Column, bound: Column, low: int) -> Column:
    """Whether no cell that wasn't asked can change the finds. last: wanted score -> score of the last find, where all were found."""
    full = lambda w: F.coalesce(F.element_at(last, w) > bound, F.lit(False))
    below = lambda w: F.lit(100.0) * bound < F.lit(float(low)) * w
    return F.when(F.size(wanted) == 0, full(F.lit(0).cast("long"))).otherwise(F.forall(wanted, lambda w: full(w) | below(w)))


def searched(anchors: DataFrame, store: DataFrame, keys: dict[int, Keys], cells: dict[int, Cells], k: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """(row, wanted, vec_id, score, rank): the first k finds of each anchor and wanted score, in rounds."""
    open_, found = anchors.withColumn("held", F.array().cast("array<bigint>")), None
    step = 0
    while True:
        asks = written(asking(open_, keys, cells, step, low, high))
        more = met(asks, store, positives, negatives, low, high)
        both = more if found is None else found.drop("rank").unionByName(more)
        order = Window.partitionBy("row", "wanted").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        found = written(both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        entry = F.struct(F.coalesce("wanted", F.lit(0).cast("long")).alias("wanted"), "score")
        last = found.where(F.col("rank") == k).groupBy("row").agg(F.map_from_entries(F.collect_list(entry)).alias("last"))
        rest = asks.where("bound is not null").join(last, "row", "left").where(~certain(F.col("last"), F.col("wanted"), F.col("bound"), low))
        each = F.when(F.size("wanted") > 0, F.col("wanted")).otherwise(F.array(F.lit(0).cast("long")))
        open_ = written(rest.select("row", "label", "x", "d", "wanted", F.transform(each, lambda w: F.element_at("last", w)).alias("held")))
        if open_.isEmpty():
            return found
        step += 1


def mined(
    vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    vectors: vec_id, embedding, label; anchor: which rows are anchors, from vec_id. An anchor's positives are its first rows
    of the same label; for each, rank counts the first rows of other labels with scores from low to high hundredths of its own.
    """
    rows = integers(vectors)
    keys = keys_of(rows)
    store = stored(rows, keys)
    cells = directory(store, keys)
    anchors = written(rows.where(anchor & F.col("vec_id").isNotNull()).withColumn("wanted", F.array().cast("array<bigint>")))
    near = searched(anchors, store, keys, cells, positives, positives, negatives, low, high)
    scores = near.groupBy("row").agg(F.sort_array(F.collect_set("score")).alias("wanted"))  # at most `positives` of them
    asking_ = written(anchors.drop("wanted").join(scores, "row"))
    hard = searched(asking_, store, keys, cells, negatives, positives, negatives, low, high)
    pairs = near.select("row", F.col("vec_id").alias("positive_id"), F.col("score").alias("wanted"))
    named = anchors.select("row", F.col("vec_id").alias("anchor_id"))
    return pairs.join(hard, ["row", "wanted"]).join(named, "row").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("wanted").alias("positive_score"), F.col("score").alias("negative_score")
    )
