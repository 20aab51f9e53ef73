"""Trees, calibration and the block bootstrap."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.functions.prob import along, bin_of, clip, logit, sigmoid
from harborlight.functions.timeparts import is_peak_slot
from harborlight.plans import learning as L
from harborlight.plans import views_sql as V
from harborlight.plans.trips import flow_of, plausible
from harborlight.sources import tables as T
from harborlight.sources.shared import saved, shared_folder

#: A missing lag: trees don't route nulls, so an indicator goes with the stand-in.
MISSING = -1.0
#: Rows that a bin of scores is reduced to before isotonic fitting, which is exact for scores of so many digits.
DIGITS = 4


def numeric(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Doubles without nulls, and an indicator for each column that may be null."""
    return rows.withColumns({f"f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in columns} | {f"m_{c}": F.col(c).isNull().cast("double") for c in columns})


def boosted(train: DataFrame, columns: list[str], check: str, rounds: int = 20, depth: int = 4, seed: int = 7):
    """Gradient-boosted trees with a validation column for early stopping."""
    inputs = [f"{p}_{c}" for c in columns for p in ("f", "m")]
    trees = GBTClassifier(labelCol="label", featuresCol="x", maxIter=rounds, maxDepth=depth, seed=seed, validationIndicatorCol=check)
    return Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="x"), trees]).fit(train)


def isotonic(rows: DataFrame, p: str = "p", y: str = "y") -> tuple[list[float], list[float]]:
    """Knots of the monotone fit; equal scores are one weighted row first."""
    few = rows.groupBy(F.round(p, DIGITS).alias("feature")).agg(F.avg(F.col(y).cast("double")).alias("label"), F.count(F.lit(1)).cast("double").alias("w"))
    model = IsotonicRegression(featuresCol="feature", labelCol="label", weightCol="w").fit(few)
    return [float(x) for x in model.boundaries], [float(y) for y in model.predictions]


def platt(rows: DataFrame, p: str = "p", y: str = "y") -> tuple[float, float]:
    """(a, b) of sigmoid(a logit(p) + b), without regularisation; the identity if the rows have one label only, as then nothing is to be learnt."""
    seen = rows.agg(F.countDistinct(y)).first()[0]
    if seen < 2:
        return 1.0, 0.0
    x = VectorAssembler(inputCols=["z"], outputCol="features").transform(rows.select(logit(F.col(p)).alias("z"), F.col(y).cast("double").alias("label")))
    model = LogisticRegression(regParam=0.0, standardization=False, maxIter=100).fit(x)
    return float(model.coefficients[0]), float(model.intercept)


def calibrated(rows: DataFrame, a: float, b: float, where, p: str = "p") -> DataFrame:
    """p through Platt's map on a subgroup only."""
    return rows.withColumn(p, F.when(where, sigmoid(a * logit(F.col(p)) + b)).otherwise(F.col(p)))


def rolling(rows: DataFrame, step: int = 7, window: int = 28, gap: int = 1, least: int = 1000) -> DataFrame:
    """Each week's scores through an isotonic map of the window that ends a day before it; the plain score if that has fewer rows.

    The window's rows are reduced to counts by score before a week is fitted, so a group is bounded by the scores' digits.
    """
    rows = rows.withColumn("week", F.floor((F.col("d") - 1) / step))
    past = rows.groupBy("d", F.round("p", DIGITS).alias("x")).agg(F.sum(F.col("y").cast("double")).alias("hits"), F.count(F.lit(1)).alias("n"))
    return mapped(rows, weekly_maps(past, rows.select("week").distinct(), step, window, gap), least)


def weekly_maps(counts: DataFrame, weeks: DataFrame, step: int, window: int, gap: int) -> DataFrame:
    """(week, xs, ys, total): each week's monotone fit on the counts (d, x, hits, n) of the days of its window."""
    first = F.col("w.week") * step + 1
    inside = F.col("r.d").between(first - gap - window + 1, first - gap)
    met = counts.alias("r").join(F.broadcast(weeks.alias("w")), inside).groupBy("w.week", "x").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))  # a row a week
    return met.groupBy("week").applyInPandas(lambda key, part: pooled(key[0], part), "week long, xs array<double>, ys array<double>, total double")


def mapped(rows: DataFrame, maps: DataFrame, least: int) -> DataFrame:
    joined = rows.join(F.broadcast(maps), "week", "left")  # a row a week
    enough = F.coalesce(F.col("total"), F.lit(0.0)) >= least
    return joined.withColumn("p_roll", F.when(enough, along(F.col("p"), F.col("xs"), F.col("ys"))).otherwise(F.col("p"))).drop("xs", "ys", "total")


def pooled(week: int, part: pd.DataFrame) -> pd.DataFrame:
    """The knots of a week's monotone fit: neighbours that fall are pooled."""
    means: list[list[float]] = []  # mean, weight, least and largest score
    for x, hits, n in part.sort_values("x")[["x", "hits", "n"]].itertuples(index=False):
        means.append([hits / n, float(n), x, x])
        while len(means) > 1 and means[-2][0] >= means[-1][0]:
            b, a = means.pop(), means.pop()
            w = a[1] + b[1]
            means.append([(a[0] * a[1] + b[0] * b[1]) / w, w, a[2], b[3]])
    xs = [v for m in means for v in ((m[2], m[3]) if m[3] > m[2] else (m[2],))]
    ys = [m[0] for m in means for _ in range(2 if m[3] > m[2] else 1)]
    return pd.DataFrame({"week": [week], "xs": [xs], "ys": [ys], "total": [float(part.n.sum())]})


def bootstrap(blocks: DataFrame, model: str, reference: str, draws: int = 500, seed: int = 3) -> tuple[float, float, float]:
    """Skill with its 95 % interval from block sums (a row a day; blocks without a bound are for bootstrap_skill)."""
    sums = blocks.select("n", model, reference).orderBy("n", model).toPandas()
    weights = np.random.default_rng(seed).multinomial(len(sums), np.full(len(sums), 1 / len(sums)), size=draws)
    skills = 1 - (weights @ sums[model].to_numpy()) / (weights @ sums[reference].to_numpy())
    low, high = np.nanpercentile(skills, [2.5, 97.5])
    return float(1 - sums[model].sum() / sums[reference].sum()), float(low), float(high)


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.baselines(L.examples(T.readings(spark, sf_dir))).withColumn("p", clip(F.col("p_hist"), 0.001, 0.999))


def isotonic_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = saved(_predictions(spark, sf_dir))
    xs, ys = isotonic(rows.where(F.col("d").between(*L.FIT)))
    fit = spark.createDataFrame([(xs, ys)], "xs array<double>, ys array<double>")
    report = rows.where(F.col("d").between(*L.REPORT)).crossJoin(F.broadcast(fit))  # one row
    return report.select("sid", "t", "y", F.round("p", 6).alias("p"), F.round(along(F.col("p"), F.col("xs"), F.col("ys")), 6).alias("p_iso"))


def _saturated_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with a mark on peak slots of working days at stations that are often full."""
    ex = saved(L.examples(T.readings(spark, sf_dir)))
    full = L.saturated(ex).select("sid", F.lit(True).alias("often"))
    rows = L.baselines(ex).withColumn("p", clip(F.col("p_hist"), 0.001, 0.999)).join(full, "sid", "left")
    return saved(rows.withColumn("sub", F.coalesce("often", F.lit(False)) & ~F.col("weekend") & is_peak_slot(F.col("target_slot"))))


def platt_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platt's map, fitted on the subgroup and applied to it only."""
    rows = _saturated_peak(spark, sf_dir)
    a, b = platt(rows.where(F.col("d").between(*L.FIT)).where("sub"))
    return calibrated(rows.where(F.col("d").between(*L.REPORT)), a, b, F.col("sub")).select("sid", "t", "y", "p")


def rolling_recalibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window has 50 rows at least here, as the test readings are sparse."""
    rows = rolling(saved(_predictions(spark, sf_dir)), least=50)
    return rows.select("sid", "t", "d", "week", "y", F.round("p", 6).alias("p"), F.round("p_roll", 6).alias("p_roll"))


FITTED = ("p_persist_cal", "p_hist")


def baseline_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted baselines with the models' calibration step: each through a monotone fit of the fitting days, on those of the report."""
    rows = saved(L.baselines(L.examples(T.readings(spark, sf_dir))))
    scores = F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("week"), F.lit(m).alias("model"), F.col(m).alias("p")) for i, m in enumerate(FITTED))))
    long = rows.select("sid", "t", "d", "y", scores.alias("s")).select("sid", "t", "d", "y", "s.*").where("p is not null")
    counts = long.where(F.col("d").between(*L.FIT)).groupBy("week", F.round("p", DIGITS).alias("x")).agg(F.sum(F.col("y").cast("double")).alias("hits"), F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("week").applyInPandas(lambda key, part: pooled(key[0], part), "week long, xs array<double>, ys array<double>, total double")  # counts by digits
    found = mapped(long.where(F.col("d").between(*L.REPORT)), maps, 1)
    return found.select("sid", "t", "y", F.concat("model", F.lit("_iso")).alias("model"), F.round("p_roll", 6).alias("p"))


def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, low, high = bootstrap(L.block_sums(spark, sf_dir), "p_hist", "p_persist")
    return spark.createDataFrame([("p_hist", "p_persist", value, low, high)], "model string, reference string, skill double, low double, high double")


def draws_of(blocks: DataFrame, keys: list[str], draws: int, seed: int) -> DataFrame:
    """blocks with a row for each draw that takes it, and how often: Poisson counts of mean one from digests of key, draw and seed.

    Draws are independent by block, so a block's rows never meet on the driver, and reruns agree.
    """
    drawn = blocks.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    digest = F.md5(F.concat_ws("|", *keys, "draw", F.lit(str(seed))))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2**32
    count = sum((F.when(u >= limit, 1).otherwise(0) for limit in POISSON), F.lit(0))
    return drawn.withColumn("w", count).where("w > 0")


#: Shares of Poisson counts of mean one below 1, 2, ... 9.
POISSON = [round(sum(math.exp(-1) / math.factorial(k) for k in range(n)), 9) for n in range(1, 10)]
DRAWS, BIN_ROWS = 200, 50


def _block_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.baselines(saved(L.examples(T.readings(spark, sf_dir)))).where(F.col("d").between(*L.REPORT))


def bootstrap_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95 % interval of the history's skill against persistence, over blocks of stations and days."""
    err = lambda c: F.round(F.sum(F.pow(F.col(c) - F.col("y").cast("double"), 2)), 9).alias(c)
    blocks = _block_errors(spark, sf_dir).groupBy("sid", "d").agg(err("p_hist"), err("p_persist"))
    sums = draws_of(blocks, ["sid", "d"], DRAWS, 3).groupBy("draw").agg(F.sum(F.col("w") * F.col("p_hist")).alias("a"), F.sum(F.col("w") * F.col("p_persist")).alias("b"))
    skill = 1 - F.col("a") / F.nullif(F.col("b"), F.lit(0.0))
    return sums.agg(F.count(F.lit(1)).alias("draws"), *(F.round(F.percentile(skill, F.lit(q)), 6).alias(n) for n, q in (("low", 0.025), ("high", 0.975))))


def bootstrap_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95 % interval of the largest calibration gap of bins with enough rows in a draw, over blocks of stations and days."""
    cells = _block_errors(spark, sf_dir).where("p_hist is not null").groupBy("sid", "d", bin_of(F.col("p_hist")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("p_hist"), 9).alias("p"), F.sum(F.col("y").cast("int")).alias("y"))
    times = lambda c: F.sum(F.col("w") * F.col(c)).alias(c)
    bins = draws_of(cells, ["sid", "d"], DRAWS, 3).groupBy("draw", "bin").agg(times("n"), times("p"), times("y"))
    gaps = bins.groupBy("draw").agg(F.coalesce(F.max(F.when(F.col("n") >= BIN_ROWS, F.abs(F.col("y") - F.col("p")) / F.col("n"))), F.lit(0.0)).alias("gap"))
    return gaps.agg(F.count(F.lit(1)).alias("draws"), *(F.round(F.percentile("gap", F.lit(q)), 6).alias(n) for n, q in (("low", 0.025), ("high", 0.975))))


COLUMNS = [
    "docks_now", "bikes_now", "docks_disabled", "occupancy_now", "slot", "target_slot", "minute_of_day", "weekday", *(f"{c}{x}" for x in L.LAGS for c in ("docks_lag", "docks_delta", "full_lag")), "nb_n", "nb_full_frac",
    "nb_occupancy_mean", "nb_docks_sum", "temperature_now", "precip_now", "precip_next_hour", "flow_arrivals_target", "flow_departures_target", "flow_net_target", "flow_net_window",
    "st_full_rate", "st_peak_full_rate", "station",
]


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features as doubles, in a fixed order, so that samples and splits agree between runs."""
    r = saved(T.readings(spark, sf_dir))
    rows = L.features(r, T.last_of_day(r), flow_of(plausible(spark, sf_dir)), T.weather(spark, sf_dir), L.examples(r))
    rows = numeric(rows, COLUMNS).withColumn("label", F.col("y").cast("double")).withColumn("check", F.col("d") > L.TRAIN[1] - 4)
    return saved(rows.repartitionByRange("sid", "t").sortWithinPartitions("sid", "t"))


def _of(model, rows: DataFrame, name: str) -> DataFrame:
    return model.transform(rows).withColumn(name, F.element_at(vector_to_array("probability"), 2)).drop("rawPrediction", "probability", "prediction", "x")


def _stored(spark: SparkSession, rows: DataFrame) -> str:
    """The folder of a fitted model: trees and the isotonic knots."""
    model = boosted(rows.where(F.col("d").between(*L.TRAIN)), COLUMNS, "check")
    folder = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    model.write().save(f"{folder}/trees")
    xs, ys = isotonic(_of(model, rows.where(F.col("d").between(*L.FIT)), "p"))
    spark.createDataFrame([(xs, ys)], "xs array<double>, ys array<double>").coalesce(1).write.json(f"{folder}/knots")
    return folder


def gbt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees and their isotonic map, stored, loaded and applied to the days of the report."""
    rows = _matrix(spark, sf_dir)
    folder = _stored(spark, rows)
    fit = spark.read.schema("xs array<double>, ys array<double>").json(f"{folder}/knots")
    scored = _of(PipelineModel.load(f"{folder}/trees"), rows.where(F.col("d").between(*L.REPORT)), "p_raw").crossJoin(F.broadcast(fit))  # one row
    return scored.select("sid", "t", "y", "p_raw", along(F.col("p_raw"), F.col("xs"), F.col("ys")).alias("p"))


def gbt_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features with the largest shares of the gain; a feature and the indicator of its absence count together."""
    model = PipelineModel.load(f"{_stored(spark, _matrix(spark, sf_dir))}/trees")
    shares = model.stages[-1].featureImportances.toArray()
    pairs = spark.createDataFrame([(name[2:], float(v)) for name, v in zip(model.stages[0].getInputCols(), shares)], "feature string, share double")
    return pairs.groupBy("feature").agg(F.sum("share").alias("share")).orderBy(F.desc("share"), "feature").limit(15)


def stacked_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short model that takes the first one's score as a feature, fitted on the days after the first one's."""
    rows = _matrix(spark, sf_dir)
    base = boosted(rows.where(F.col("d").between(*L.TRAIN)), COLUMNS, "check")
    scored = numeric(saved(_of(base, rows.where(F.col("d") >= L.FIT[0]), "p_base")), ["p_base"]).withColumn("check", F.col("d") == L.FIT[1])
    short = boosted(scored.where(F.col("d").between(*L.FIT)), ["p_base", "docks_now", "bikes_now", "target_slot", "weekday"], "check", 10, 3)
    return _of(short, scored.where(F.col("d").between(*L.REPORT)), "p").select("sid", "t", "y", "p_base", "p")


QUERIES = [isotonic_map, platt_map, rolling_recalibration, baseline_iso, bootstrap_interval, bootstrap_skill, bootstrap_gap, gbt_scores, gbt_importances, stacked_scores]
_COUNT = " + ".join(f"CAST(u >= {limit!r} AS INT)" for limit in POISSON)
_ERRORS = V.with_views(V.SNAP, V.examples(), V.predictions()) + ", err AS (SELECT *, CAST(y AS INT) AS hit FROM pred WHERE d BETWEEN 23 AND 30)"
_DRAWN = f"""drawn AS (SELECT *, {_COUNT} AS w FROM (SELECT *, CAST('0x' || substr(md5(sid || '|' || d || '|' || draw || '|3'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM (SELECT *, unnest(range({DRAWS})) AS draw FROM cells)))"""
_SCORES = V.with_views(V.SNAP, V.examples(), V.predictions()) + ", sc AS (SELECT sid, t, d, y, CAST(y AS INT) AS hit, least(greatest(p_hist, 0.001), 0.999) AS p, (d - 1) // 7 AS week FROM pred)"
#: The monotone fit of counted scores cnt (g, x, hits, n) by its closed form: at each score the largest, over stretches that begin no
#: later, of the least mean, over those that end no sooner.
_MONOTONE = """, pts AS (SELECT *, row_number() OVER w AS i, sum(n) OVER w AS cn, sum(hits) OVER w AS ch FROM cnt WINDOW w AS (PARTITION BY g ORDER BY x)),
        lows AS (SELECT j.g, k.i, min((k.ch - j.ch + j.hits) / CAST(k.cn - j.cn + j.n AS DOUBLE)) OVER (PARTITION BY j.g, j.i ORDER BY k.i DESC) AS v FROM pts j JOIN pts k ON k.g = j.g AND k.i >= j.i),
        knots AS (SELECT p.g, p.x, l.y, lead(p.x) OVER w AS x1, lead(l.y) OVER w AS y1, first_value(l.y) OVER w AS y0 FROM pts p JOIN (SELECT g, i, max(v) AS y FROM lows GROUP BY 1, 2) l ON l.g = p.g AND l.i = p.i WINDOW w AS (PARTITION BY p.g ORDER BY p.x)),
        lowest AS (SELECT g, any_value(y0) AS y0, count(*) AS knots FROM knots GROUP BY 1)"""
_ALONG = "CASE WHEN k.x IS NULL THEN e.y0 ELSE k.y + coalesce((k.y1 - k.y) * (s.p - k.x) / nullif(k.x1 - k.x, 0), 0) END"
WEEKLY_SQL = _SCORES + """, days AS (SELECT d, round(p, 4) AS x, sum(hit) AS hits, count(*) AS n FROM sc GROUP BY 1, 2), weeks AS (SELECT DISTINCT week FROM sc),
        cnt AS (SELECT week AS g, x, sum(hits) AS hits, sum(n) AS n FROM days JOIN weeks ON d BETWEEN week * 7 - 27 AND week * 7 GROUP BY 1, 2), enough AS (SELECT g FROM cnt GROUP BY 1 HAVING sum(n) >= 50)""" + _MONOTONE + f"""
        SELECT s.sid, s.t, s.d, s.week, s.y, round(s.p, 6) AS p, round(CASE WHEN s.week IN (SELECT g FROM enough) THEN {_ALONG} ELSE s.p END, 6) AS p_roll FROM sc s ASOF LEFT JOIN knots k ON k.g = s.week AND s.p >= k.x LEFT JOIN lowest e ON e.g = s.week"""
SQL: dict[str, str] = {
    "isotonic_map": _SCORES + ", cnt AS (SELECT 0 AS g, round(p, 4) AS x, sum(hit) AS hits, count(*) AS n FROM sc WHERE d BETWEEN 19 AND 22 GROUP BY 2), rep AS (SELECT *, 0 AS g FROM sc WHERE d BETWEEN 23 AND 30)" + _MONOTONE + f"""
        SELECT s.sid, s.t, s.y, round(s.p, 6) AS p, round({_ALONG}, 6) AS p_iso FROM rep s ASOF LEFT JOIN knots k ON k.g = s.g AND s.p >= k.x LEFT JOIN lowest e ON e.g = s.g""",
    "rolling_recalibration": WEEKLY_SQL,
    "baseline_iso": V.with_views(V.SNAP, V.examples(), V.predictions()) + """, sc AS (SELECT sid, t, d, y, CAST(y AS INT) AS hit, 'p_persist_cal' AS g, p_persist_cal AS p FROM pred UNION ALL SELECT sid, t, d, y, CAST(y AS INT), 'p_hist', p_hist FROM pred),
        cnt AS (SELECT g, round(p, 4) AS x, sum(hit) AS hits, count(*) AS n FROM sc WHERE d BETWEEN 19 AND 22 AND p IS NOT NULL GROUP BY 1, 2), rep AS (SELECT * FROM sc WHERE d BETWEEN 23 AND 30 AND p IS NOT NULL)""" + _MONOTONE + f"""
        SELECT s.sid, s.t, s.y, s.g || '_iso' AS model, round(CASE WHEN e.g IS NULL THEN s.p ELSE {_ALONG} END, 6) AS p FROM rep s ASOF LEFT JOIN knots k ON k.g = s.g AND s.p >= k.x LEFT JOIN lowest e ON e.g = s.g""",
    "bootstrap_skill": _ERRORS + f""", cells AS (SELECT sid, d, round(sum(pow(p_hist - hit, 2)), 9) AS a, round(sum(pow(p_persist - hit, 2)), 9) AS b FROM err GROUP BY 1, 2), {_DRAWN},
        s AS (SELECT draw, 1 - sum(w * a) / nullif(sum(w * b), 0) AS skill FROM drawn WHERE w > 0 GROUP BY 1)
        SELECT count(*) AS draws, round(quantile_cont(skill, 0.025), 6) AS low, round(quantile_cont(skill, 0.975), 6) AS high FROM s""",
    "bootstrap_gap": _ERRORS + f""", cells AS (SELECT sid, d, least(greatest(floor(p_hist * 10), 0), 9) AS bin, count(*) AS n, round(sum(p_hist), 9) AS p, sum(hit) AS y FROM err WHERE p_hist IS NOT NULL GROUP BY 1, 2, 3), {_DRAWN},
        b AS (SELECT draw, bin, sum(w * n) AS n, sum(w * p) AS p, sum(w * y) AS y FROM drawn WHERE w > 0 GROUP BY 1, 2), g AS (SELECT draw, coalesce(max(abs(y - p) / n) FILTER (n >= {BIN_ROWS}), 0) AS gap FROM b GROUP BY 1)
        SELECT count(*) AS draws, round(quantile_cont(gap, 0.025), 6) AS low, round(quantile_cont(gap, 0.975), 6) AS high FROM g""",
}
