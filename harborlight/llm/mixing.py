"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Sources in code-point order, null last, weigh 5, 2, 1, repeating; they share the corpus's words, no source above
`most` times its own (the excess goes to the others by weight). Within a source every document is expected
`target / source size` times. Expected copies are prefix-summed in the order of size, then of a digest of the id, one
offset per source (a digest of seed and source) is added, and a document is taken once for each whole number that its
interval crosses. As the expectation is one rate for a source, the prefix sum is rate times rank, and ranks are built
from counts of (source, size, salt): no task sees more of a source than one of 256 salts of one size.

Defined cases: a null or empty text has size 0; a null source is a source of its own; a null id ranks by its text;
repeated rows each count; a source without words has target 0; an empty table gives an empty result. The table of
sources passes one task: a row a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborlight.llm.common import WORD, carried, unpacked

WEIGHTS = (5, 2, 1)
#: Hex digits of the salt.
SALT_DIGITS = 2


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(text: Column) -> Column:
    """A number in [0, 1) from a text's digest."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: Sequence[int], most: float) -> DataFrame:
    """(_src, _source_size) with _target: shares by weight, filled up to the caps in the order of cap a weight."""
    by_name, by_ratio = Window.orderBy("_src"), Window.orderBy("_ratio", "_src")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_n") % len(weights) + 1).cast("int"))
    ranked = (
        sizes.withColumn("_n", F.row_number().over(by_name) - 1)
        .withColumn("_w", weight.cast("long"))
        .withColumn("_cap", F.lit(float(most)) * F.col("_source_size"))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
    )
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("_source_size").over(Window.partitionBy()) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest)
    first = F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_src", "_level"))).over(Window.partitionBy())
    return (
        ranked.withColumn("_level", level)
        .withColumn("_level", first["_level"])
        .select("_src", "_source_size", F.least(F.col("_cap"), F.col("_level") * F.col("_w")).alias("_target"))
    )


def plan(
    docs: DataFrame, columns: Sequence[str] | None = None, weights: Sequence[int] = WEIGHTS, most: float = 3.0, seed: str = "mix-1"
) -> DataFrame:
    """Every row with size, source_size, target (its source's) and copies (how often the mix takes it)."""
    columns = list(columns or docs.columns)
    tie = F.md5(F.concat(F.coalesce(docs["doc_id"].cast("string"), docs["text"], F.lit("")), F.lit("|" + seed)))
    rows = docs.select(
        carried(docs, columns),
        words(docs["text"]).alias("_size"),
        F.coalesce(F.concat(F.lit("s"), docs["source"]), F.lit("t")).alias("_src"),
        tie.alias("_tie"),
        docs["doc_id"].alias("_id"),
    ).withColumn("_salt", F.substring("_tie", 1, SALT_DIGITS))
    salted = rows.groupBy("_src", "_size", "_salt").agg(F.count(F.lit(1)).alias("_c"))
    sized = salted.groupBy("_src", "_size").agg(F.sum("_c").alias("_c"))
    source = targets(sized.groupBy("_src").agg(F.sum(F.col("_size") * F.col("_c")).alias("_source_size")), weights, most)
    upto = Window.partitionBy("_src").orderBy("_size").rowsBetween(Window.unboundedPreceding, -1)
    starts = sized.select("_src", "_size", F.coalesce(F.sum("_c").over(upto), F.lit(0)).alias("_before")).join(source, "_src")
    within = Window.partitionBy("_src", "_size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.select("_src", "_size", "_salt", F.coalesce(F.sum("_c").over(within), F.lit(0)).alias("_in")).join(
        starts, ["_src", "_size"]
    )
    rank = F.row_number().over(Window.partitionBy("_src", "_size", "_salt").orderBy("_tie", "_id"))
    rate = F.coalesce(F.try_divide(F.col("_target"), F.col("_source_size").cast("double")), F.lit(0.0))
    offset = unit(F.concat(F.col("_src"), F.lit("|" + seed)))
    ranked = rows.join(starts, ["_src", "_size", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_in") + rank)
    crossed = F.floor(rate * F.col("_rank") + offset) - F.floor(rate * (F.col("_rank") - 1) + offset)
    return unpacked(
        ranked,
        columns,
        size=F.col("_size"),
        source_size=F.col("_source_size").cast("long"),
        target=F.col("_target"),
        copies=crossed.cast("long"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row as often as it is taken, with the columns of docs."""
    wrapped = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "text", "source")
    taken = plan(wrapped, ["_doc"], **options).where("copies > 0")
    return taken.select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_doc.*")
