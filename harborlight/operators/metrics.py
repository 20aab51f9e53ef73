"""Scores of probabilistic predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlight.functions.prob import bin_of, brier, log_loss, skill


def long_form(predictions: DataFrame, models: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(…keep, y, model, p): a row a prediction."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("p")) for m in models)))
    return predictions.select(*keep, "y", pairs.alias("x")).select(*keep, "y", "x.model", "x.p").where("p is not null")


def segments(predictions: DataFrame, tests: dict[str, object]) -> DataFrame:
    """A row for each segment that a row is in."""
    names = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in tests.items())), lambda x: x.isNotNull())
    return predictions.withColumn("segment", F.explode(names))


def summarised(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    y = F.col("y")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y.cast("double")).alias("base_rate"), brier(F.col("p"), y).alias("brier"), log_loss(F.col("p"), y).alias("log_loss")
    )


def reliability(rows: DataFrame, by: Sequence[str], bins: int = 10) -> DataFrame:
    rows = rows.withColumn("bin", bin_of(F.col("p"), bins))
    return rows.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("p_mean"), F.avg(F.col("y").cast("double")).alias("y_mean"))


def calibration(table: DataFrame, by: Sequence[str], least: int = 1000) -> DataFrame:
    """Of a reliability table: the largest gap of bins with `least` rows, and the expected calibration error."""
    gap = F.abs(F.col("y_mean") - F.col("p_mean"))
    return table.groupBy(*by).agg(F.max(F.when(F.col("n") >= least, gap)).alias("gap"), (F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"))


def best_of(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """The model with the least Brier score, and the skill of the others against it."""
    best = scores.groupBy(*by).agg(F.min(F.struct("brier", "model")).alias("b")).select(*by, F.col("b.model").alias("best"), F.col("b.brier").alias("best_brier"))
    return scores.join(best, list(by)).select(*by, "model", "best", skill(F.col("brier"), F.col("best_brier")).alias("skill"))
