"""Quality scores: random-indexing word vectors, pooled by document, and a small calibrated network.

Each word has a sparse ternary index vector, drawn from its hash. The vector of one of the VOCABULARY commonest words
of the sample is its index vector plus, scaled, the sum of those of the words within two places around it, over all
texts of the sample; other words keep their index vectors. A document is the mean of its words' vectors with three
shape figures (length, share of different words, share of capital letters in all its characters). A network with one hidden layer is trained in
numpy on the sampled rows and a temperature fitted on the part of them that training doesn't see.

Learned from is a bounded sample, SAMPLE labelled rows with the least digests of their ids; scoring reads whole texts.

Defined cases: null and empty texts have the zero vector and are scored like any other; a label that is null or whose
document is missing is ignored, and so is one without an id; without labels of both kinds every score is 0.5; repeated
rows are scored each.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborlight.llm.common import written

#: Rows learned from, words with learned vectors, dimensions, index vectors, and nonzero entries of one.
SAMPLE, VOCABULARY, DIMENSIONS, BUCKETS, NONZERO = 12_000, 8_192, 160, 1 << 14, 8
AROUND, NEAR_WEIGHT = 2, 0.5
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 48, 30, 256, 0.003, 1e-4, 11
THRESHOLD = 0.3
#: Words a row of sums, and partitions of the sample.
CHUNK, PARTS = 256, 16
TOKEN = regex.compile(r"\p{L}+|\p{N}|[^\p{L}\p{N}\s]+")
CAPITAL = regex.compile(r"\p{Uppercase}")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def index_vectors() -> np.ndarray:
    random = np.random.default_rng(SEED)
    out = np.zeros((BUCKETS, DIMENSIONS), dtype=np.float32)
    for row in out:
        row[random.choice(DIMENSIONS, NONZERO, replace=False)] = random.choice((-1.0, 1.0), NONZERO) / np.sqrt(NONZERO)
    return out


def bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


class Pooler:
    """Turns texts to document vectors; made once in a task."""

    def __init__(self, words: list[str], near: np.ndarray | None):
        self.index = index_vectors()
        own = self.index[[bucket(w) for w in words]] if words else np.zeros((0, DIMENSIONS), np.float32)
        if near is not None and len(words):
            own = own + NEAR_WEIGHT * near / np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-6)
        self.matrix = np.vstack([self.index, own.astype(np.float32)])
        self.place = {w: BUCKETS + i for i, w in enumerate(words)}

    def vector(self, text: str | None) -> np.ndarray:
        found = tokens(text)
        out = np.zeros(DIMENSIONS + 3, dtype=np.float32)
        if found:
            counts = Counter(found)
            at = np.fromiter((self.place.get(w) or bucket(w) for w in counts), dtype=np.int64, count=len(counts))
            n = np.fromiter(counts.values(), dtype=np.float32, count=len(counts))
            for i in range(0, len(at), 4096):
                out[:DIMENSIONS] += n[i : i + 4096] @ self.matrix[at[i : i + 4096]]
            out[:DIMENSIONS] /= len(found)
            out[DIMENSIONS:] = np.log1p(len(found)), len(counts) / len(found), len(CAPITAL.findall(text)) / len(text)
        return out


def near_sums(texts: DataFrame, words: list[str]) -> np.ndarray:
    """For each word the sum of the index vectors around it; each task sends CHUNK words a row, which are added up in groups."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # whole numbers: their sums are exact in any order; what uses them brings them to unit length
        index, place = np.rint(index_vectors() * np.sqrt(NONZERO)), {w: i for i, w in enumerate(words)}
        sums = np.zeros((len(words), DIMENSIONS), dtype=np.float32)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = tokens(text)
                for start in range(0, len(found), 8192):
                    ahead = min(AROUND, start)  # parts overlap by what is around their words
                    part = found[start - ahead : start + 8192 + AROUND]
                    vectors = index[[bucket(w) for w in part]]
                    total = np.vstack([np.zeros((1, DIMENSIONS), np.float32), np.cumsum(vectors, axis=0)])
                    i = np.arange(len(part))
                    around = total[np.minimum(i + AROUND + 1, len(part))] - total[np.maximum(i - AROUND, 0)] - vectors
                    at = np.array([place.get(w, -1) for w in part])
                    at[:ahead] = at[ahead + 8192 :] = -1
                    order = np.argsort(at[at >= 0], kind="stable")
                    which, first = np.unique(at[at >= 0][order], return_index=True)
                    if len(which):
                        sums[which] += np.add.reduceat(around[at >= 0][order], first, axis=0)
        parts = range(0, len(words), CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([sums[i : i + CHUNK].tobytes() for i in parts], pa.binary())], ["at", "sums"])

    def added(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in rows:
            for x in batch.column("sums").to_pylist():
                total = np.frombuffer(x, np.float32).astype(np.float64) if total is None else total + np.frombuffer(x, np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["at", "sums"])

    rows = texts.select("text").mapInArrow(counted, "at long, sums binary").groupBy("at").applyInArrow(added, "at long, sums binary").collect()
    out = np.zeros((len(words), DIMENSIONS), dtype=np.float32)
    for at, sums in rows:  # VOCABULARY / CHUNK rows
        out[at : at + CHUNK] = np.frombuffer(sums, np.float32).reshape(-1, DIMENSIONS)
    return out


class Network:
    """Standardised input, one hidden layer of tanh, a logit; Adam on the mean log loss; then a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        random = np.random.default_rng(SEED)
        order = random.permutation(len(y))
        cut = max(1, len(y) // 6)
        check, train = order[:cut], order[cut:]
        self.mean, self.scale = x[train].mean(0), x[train].std(0) + 1e-3
        d = x.shape[1]
        self.p = [random.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), random.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        m, v, step = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0
        z = self.standard(x)
        for _ in range(EPOCHS):
            for part in np.array_split(random.permutation(train), max(1, len(train) // BATCH)):
                h = np.tanh(z[part] @ self.p[0] + self.p[1])
                g = (1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3], -30, 30))) - y[part]) / len(part)
                back = np.outer(g, self.p[2]) * (1 - h * h)
                step += 1
                for i, grad in enumerate((z[part].T @ back + DECAY * self.p[0], back.sum(0), h.T @ g + DECAY * self.p[2], g.sum(keepdims=True))):
                    m[i] = 0.9 * m[i] + 0.1 * grad
                    v[i] = 0.999 * v[i] + 0.001 * grad * grad
                    self.p[i] -= RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        logit = self.logit(z[check])
        loss = lambda t: np.mean(np.logaddexp(0, logit / t) - y[check] * logit / t)
        self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logit(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(self.standard(x)) / self.temperature, -30, 30)))


class Model:
    def __init__(self, words: list[str], near: np.ndarray | None, network: Network | None):
        self.words, self.near, self.network = words, near, network


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, label): at most SAMPLE labelled documents, those with the least digests of their ids.

    Ids are chosen first and broadcast, SAMPLE rows at most; no other texts are moved. An id with several labels has
    their mean, and of an id with several texts the one with the least digest counts.
    """
    of_id = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.avg("label").alias("label"))
    there = of_id.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("_digest", F.xxhash64(F.col("doc_id").cast("string")))
    there = written(there)
    n = there.count()
    if n > 2 * SAMPLE:  # digests are even, so about 2 * SAMPLE lie below this bound, and the last task gets no more
        bound = -(1 << 63) + (2 * SAMPLE << 64) // n
        if (below := there.where(F.col("_digest") < bound)).count() >= SAMPLE:
            there = below
    ids = written(there.orderBy("_digest", "doc_id").limit(SAMPLE).select("doc_id", "label"))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def fitted(labelled: DataFrame) -> Model:
    """From rows (doc_id, text, label), of which sampled() gives few enough."""
    spark = labelled.sparkSession
    few = labelled.where("label is not null").select("doc_id", "text", F.col("label").cast("double").alias("label"))
    sample = written(few.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(SAMPLE).repartition(PARTS))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter(w for t in batch.column(0).to_pylist() for w in tokens(t))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    counted = sample.select("text").mapInArrow(words_of, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = [r.word for r in counted.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()]
    near = near_sums(sample, words) if words else None
    rows = vectors(sample, ["label"], Model(words, near, None)).select("label", "vector").collect()
    y = np.array([r.label for r in rows])
    network = None
    if 0 < y.sum() < len(y):
        x = np.frombuffer(b"".join(r.vector for r in rows), np.float32).reshape(len(rows), -1).astype(np.float64)
        order = np.lexsort((*x.T[:4], y))  # whatever the order of the rows
        network = Network(x[order], y[order])
    return Model(words, near, network)


def vectors(docs: DataFrame, columns: list[str], model: Model) -> DataFrame:
    held, cache = docs.sparkSession.sparkContext.broadcast(model), {}  # VOCABULARY x DIMENSIONS floats

    @F.pandas_udf("binary")
    def pooled(texts: pd.Series) -> pd.Series:
        pooler = cache.get("pooler") or cache.setdefault("pooler", Pooler(held.value.words, held.value.near))
        return pd.Series([pooler.vector(t).tobytes() for t in texts], dtype=object)

    return docs.select(*columns, pooled("text").alias("vector"))


def scored(docs: DataFrame, columns: list[str], model: Model) -> DataFrame:
    """columns of docs with score and predicted."""
    held, cache = docs.sparkSession.sparkContext.broadcast(model), {}

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = held.value
        if m.network is None:
            return pd.Series(0.5, index=texts.index)
        pooler = cache.get("pooler") or cache.setdefault("pooler", Pooler(m.words, m.near))
        return pd.Series(m.network.probability(np.array([pooler.vector(t) for t in texts], dtype=np.float64)), index=texts.index)

    rows = docs.select(F.struct(*(docs[c] for c in columns)).alias("_row"), score(docs["text"]).alias("_score"))
    keep = [F.col("_row")[c].alias(c) for c in columns if c.lower() not in ("score", "predicted")]
    return rows.select(*keep, F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
