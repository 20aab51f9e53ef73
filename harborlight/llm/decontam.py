"""Benchmark decontamination by spaced-seed hashing (DataFrame functions only).

Texts become tokens (lower case, runs of letters and digits) and tokens 64-bit hashes. Fixed masks choose five tokens
and ignore those between. Of 9 to 23 tokens of which at least 0.8 are equal, wherever the others stand, one mask at least
finds its five equal, and of more tokens such a part is left, so no substitutions lose an overlap. Every position of every
text is hashed under every mask (pairs first, then threes, then the mask's runs: arrays are zipped, shifted) and joined
with the hashes of all positions of the benchmark. Around a hit the text and the item are laid side by side, token
against token. They overlap if at least 0.8 of all tokens side by side are equal, or of a stretch of them that an equal
token begins and another ends, and if those are `least` tokens or as many as a shorter item has.

Items of PHRASE to SHORTEST - 1 tokens have seeds of all their tokens, so they match where all stand in a row; for shorter
ones, which stand in many a text by chance, the whole text must be the item. Masks for such lengths are used only if there
are such items.

The seeds of the benchmark are broadcast when a count shows them to be at most SEEDS, some thousands of items; then only the
tokens beside an item leave the stage that reads a text. Otherwise positions and seeds are shuffled and hits are joined
back to the texts. Either way the diagonals of a text and an item are made distinct before they are compared.

Defined cases: null and empty texts and items match nothing; rows without id report a null doc_id; repeated rows report
once; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlight.llm.common import with_small, written

#: The masks (0 is an ignored token), equal tokens in so many, and tokens of an overlap and of an item.
MASKS = ("110111", "11010011", "11111")
SAME, OF = 4, 5
LEAST, SHORTEST = 12, 9
#: Shorter items from this length on are phrases; below it only a whole text can match.
PHRASE = 5
#: Items of this number at most are broadcast for the comparison, each as its hashes; and seeds, of four numbers each.
ITEMS, SEEDS = 50_000, 2_000_000


def token_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shifted(a: Column, b: Column, by: int, *salt: Column) -> Column:
    """The hash of each element with b's so far behind it; near the end of the element alone."""
    return F.zip_with(a, F.slice(b, F.lit(by + 1), F.size(b)), lambda x, y: F.xxhash64(*salt, x, y))


def salted(masks: tuple[str, ...], lengths: list[int]) -> list[tuple[int, str]]:
    """Masks with numbers that tell them apart: those given, and a full one for each length of a phrase."""
    return [*enumerate(masks), *((-m, "1" * m) for m in lengths)]


def positions(df: DataFrame, keep: list[str], masks: list[tuple[int, str]]) -> DataFrame:
    """keep, seed and at (its first token) of every position of the texts' hashes _h under every mask."""
    three = df.select("*", shifted(F.col("_h"), F.col("_h"), 1).alias("_g2")).select("*", shifted(F.col("_g2"), F.col("_h"), 2).alias("_g3"))
    runs = {"1": F.col("_h"), "11": F.col("_g2"), "111": F.col("_g3")}

    def under(n: int, mask: str) -> Column:
        first, *more = re.finditer("1{1,3}", mask)
        seeds = runs[first.group()]
        for run in more:
            seeds = shifted(seeds, runs[run.group()], run.start(), F.lit(n))
        return F.when(F.size("_h") >= len(mask), seeds)

    # outer: for the inner form Spark would infer a filter on the array and push all of it below the hashes
    none = F.array().cast("array<bigint>")
    listed = three.select(*keep, F.size("_h").alias("_count"), F.concat(*(F.coalesce(under(n, m), none) for n, m in masks)).alias("_seeds"))
    return listed.select(*keep, "_count", F.posexplode_outer("_seeds").alias("_pos", "_seed")).withColumn("_at", F.pmod("_pos", "_count"))


def hits(texts: DataFrame, marks: DataFrame, masks: list[tuple[int, str]], broadcast: bool) -> DataFrame:
    """Rows of texts (keys, _id, _h) with _item, _m (its length) and _d (where the item would start in the text)."""
    keys = ["_k1", "_k2"]
    start = (F.col("_at") - F.col("_j")).alias("_d")
    if broadcast:
        found = positions(texts, [*keys, "_id", "_h"], masks).join(F.broadcast(marks), "_seed")
        return found.select(*keys, "_id", "_h", "_item", "_m", start)
    found = positions(texts, keys, masks).join(marks, "_seed").select(*keys, "_item", "_m", start).distinct()
    return found.join(texts.dropDuplicates(keys), keys)


def longest(at: Column) -> Column:
    """(length, from, same) of the longest stretch that an equal token begins and another ends, SAME in OF equal at least.

    at has the places of the equal tokens. A stretch from the a-th to the b-th is good if begin(a) <= end(b); along the
    least begin so far and the greatest end from here on, two pointers pass each place once.
    """
    begin = F.transform(at, lambda p, a: a * OF - p * SAME)
    end = F.transform(at, lambda p, b: (b + 1) * OF - (p + 1) * SAME)
    held = F.struct(
        at.alias("at"),
        F.transform(begin, lambda _, a: F.array_min(F.slice(begin, F.lit(1), a + 1))).alias("low"),
        F.transform(end, lambda _, b: F.array_max(F.slice(end, b + 1, F.size(end)))).alias("high"),
        *(F.lit(0).alias(n) for n in ("a", "b", "length", "from", "same")),
    )

    def step(s: Column, _: Column) -> Column:
        good = F.coalesce(F.get(s["low"], s["a"]) <= F.get(s["high"], s["b"]), F.lit(False))
        length = F.get(s["at"], s["b"]) - F.get(s["at"], s["a"]) + 1
        better = good & (length > s["length"])
        pick = lambda x, n: F.when(better, x).otherwise(s[n]).alias(n)
        return F.struct(
            s["at"].alias("at"), s["low"].alias("low"), s["high"].alias("high"),
            (s["a"] + (~good).cast("int")).alias("a"), (s["b"] + good.cast("int")).alias("b"),
            pick(length, "length"), pick(F.get(s["at"], s["a"]), "from"), pick(s["b"] - s["a"] + 1, "same"),
        )

    best = lambda s: F.struct(s["length"].alias("length"), s["from"].alias("from"), s["same"].alias("same"))
    return F.aggregate(F.array_repeat(F.lit(0), 2 * F.size(at)), held, step, best)


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, least: int = LEAST, broadcast_rows: int = SEEDS) -> DataFrame:
    """(_k1, _k2, doc_id, item_id, n_tokens, n_equal, first_token, last_token): verified stretches of texts with items."""
    items = benchmark.select(F.col("item_id").alias("_item_id"), F.xxhash64("item_id", "text").alias("_item"), token_hashes(F.col("text")).alias("_b"))
    items = written(items.where(F.size("_b") > 0).dropDuplicates(["_item"]))
    sized = items.withColumn("_h", F.col("_b")).withColumn("_m", F.size("_b"))
    lengths = sorted(r[0] for r in sized.where(F.col("_m") < SHORTEST).select("_m").distinct().collect())  # few, by their bound
    phrases = [m for m in lengths if m >= PHRASE]
    at = ["_seed", "_item", "_m", F.col("_at").alias("_j")]
    marks = positions(sized.where(F.col("_m") >= SHORTEST), ["_item", "_m"], salted(masks, [])).where("_seed is not null").select(*at)
    for m in phrases:
        marks = marks.unionByName(positions(sized.where(F.col("_m") == m), ["_item", "_m"], salted((), [m])).select(*at))
    marks = written(marks)
    texts = docs.select(
        F.xxhash64("doc_id").alias("_k1"), F.xxhash64("text").alias("_k2"), F.col("doc_id").alias("_id"), token_hashes(docs["text"]).alias("_h")
    )
    found = hits(texts, marks, salted(masks, phrases), marks.count() <= broadcast_rows)
    if lengths and lengths[0] < PHRASE:
        short = sized.where(F.col("_m") < PHRASE).select("_item", "_m", F.xxhash64("_h").alias("_seed"))
        alone = texts.where(F.size("_h").between(1, PHRASE - 1)).withColumn("_seed", F.xxhash64("_h")).join(short, "_seed")
        found = found.unionByName(alone.where(F.size("_h") == F.col("_m")).select("_k1", "_k2", "_id", "_h", "_item", "_m", F.lit(0).alias("_d")))
    ahead = F.greatest(F.col("_d"), F.lit(0))
    length = F.least(F.col("_m") + F.least(F.col("_d"), F.lit(0)), F.size("_h") - ahead)
    found = found.select("_k1", "_k2", "_id", "_item", "_m", "_d", F.slice("_h", ahead + 1, length).alias("_side"))
    beside = with_small(found.dropDuplicates(["_k1", "_k2", "_item", "_d"]), items, ["_item"], "inner", ITEMS)
    equal = F.zip_with("_side", F.slice("_b", F.greatest(-F.col("_d"), F.lit(0)) + 1, F.size("_side")), lambda a, b: a == b)
    beside = beside.withColumn("_equal", F.array_compact(F.transform(equal, lambda e, i: F.when(e, i))))
    side, same = F.size("_side"), F.size("_equal")
    whole = F.struct(side.alias("length"), F.lit(0).alias("from"), same.alias("same"))
    scored = beside.withColumn("_best", F.when(same * OF >= side * SAME, whole).otherwise(longest(F.col("_equal"))))
    tokens = F.col("_best")["length"]
    begin = ahead + F.col("_best")["from"]
    return (
        scored.where(tokens >= F.least(F.lit(least), "_m"))
        .select("_k1", "_k2", F.col("_id").alias("doc_id"), F.col("_item_id").alias("item_id"), tokens.alias("n_tokens"),
                F.col("_best")["same"].alias("n_equal"), begin.alias("first_token"), (begin + tokens - 1).alias("last_token"))
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """A row for each document and item that overlap: doc_id, item_id, n_tokens, n_equal, first_token, last_token (of the longest)."""
    best = F.max(F.struct("n_tokens", "n_equal", (-F.col("first_token")).alias("first"), "last_token"))
    grouped = overlaps(docs, benchmark, **options).groupBy("doc_id", "item_id").agg(best.alias("b"))
    return grouped.select("doc_id", "item_id", "b.n_tokens", "b.n_equal", (-F.col("b.first")).alias("first_token"), "b.last_token")


def cleaned(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows that overlap with any item."""
    flagged = written(overlaps(docs, benchmark, **options).select("_k1", "_k2").distinct())
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64("doc_id").alias("_k1"), F.xxhash64("text").alias("_k2"))
    return with_small(rows, flagged, ["_k1", "_k2"], "left_anti").select("_row.*")
