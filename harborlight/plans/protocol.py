"""The protocol around the models: splits by local day, fitted persistence, the report as one table, frozen artifacts, ranked places."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harborlight.config import EARTH_M, PERIODS
from harborlight.functions import geo as G
from harborlight.functions import text as X
from harborlight.functions import timeparts as P
from harborlight.operators import metrics
from harborlight.plans import learning as L
from harborlight.plans import search
from harborlight.plans import views_sql as V
from harborlight.plans.live import fresh_folder
from harborlight.sources import tables as T
from harborlight.sources.shared import saved

R6 = L.R6
#: Of the usable days in order, where fitting and reporting begin.
SHARES = (0.6, 0.8)
#: Days that are only trained on, and the horizons of the report, in minutes.
DEV, REPORTED = (3, 11), (720, 1440, 2160)
REFIT = ("p_persist_cal", "p_hist")
#: Metres of the first ring around an asked point, how much farther each next one reaches, and what no flat distance exceeds.
FIRST_M, RING, ALL_M = 150.0, 4.0, 60_000_000.0
MODELS = (*L.MODELS, *(f"{m}_tvf" for m in REFIT))


def period_of(day: Column) -> Column:
    """The period of a local day; null for days that no period has, which are left out everywhere."""
    return F.coalesce(*(F.when(day.between(F.to_date(F.lit(first)), F.to_date(F.lit(last))), name) for name, first, last in PERIODS))


def ordered_split(days: DataFrame, day: str, dev: Sequence[int], shares: tuple[float, float] = SHARES) -> DataFrame:
    """Distinct days with their part: train, fit or report in order, days of dev always train.

    With three usable days or more the report has one (of just three, fitting has none); with fewer all are trained on. The window runs over days, which are few.
    """
    rows = days.withColumn("_dev", F.col(day).isin(*dev))
    usable = Window.partitionBy("_dev")
    n, i = F.count(F.lit(1)).over(usable), F.row_number().over(usable.orderBy(day)) - 1
    a, b = (F.greatest(F.lit(1), F.bround(n * share).cast("int")) for share in shares)
    b = F.least(F.greatest(b, a + 1), n - 1)
    part = F.when(F.col("_dev") | (n < 3) | (i < a), "train").when(i < b, "fit").otherwise("report")
    return rows.withColumn("part", part).drop("_dev")


def calibrated_persistence(rows: DataFrame, train: Column, least: int = 20) -> DataFrame:
    """rows with p_persist_cal: the rate of y by station and present state on the rows to train on, by state alone where those are few."""
    fit = rows.where(train).groupingSets([[F.col("sid"), F.col("full_now")], [F.col("full_now")]], "sid", "full_now").agg(
        F.grouping("sid").alias("_all"), F.avg(F.col("y").cast("double")).alias("_p"), F.count(F.lit(1)).alias("_n"))
    own = fit.where(f"_all = 0 and _n >= {least}").select("sid", "full_now", "_p")
    by_state = fit.where("_all = 1").select("full_now", F.col("_p").alias("_g"))
    met = rows.join(own, ["sid", "full_now"], "left").join(F.broadcast(by_state), "full_now", "left")  # two rows
    return met.select(*rows.columns, F.coalesce("_p", "_g").alias("p_persist_cal"))


def reported(readings: DataFrame, horizon: int) -> DataFrame:
    """(horizon, segment, model, y, p) of the report's days: the baselines, and those refitted with the fitting days too."""
    ex = saved(L.examples(readings, horizon, L.TOLERANCE))
    again = L.baselines(ex, (L.TRAIN[0], L.FIT[1])).withColumnsRenamed({m: f"{m}_tvf" for m in REFIT}).drop("p_persist")
    often = L.saturated(ex).select("sid", F.lit(True).alias("often"))
    rows = L.baselines(again).where(F.col("d").between(*L.REPORT)).join(often, "sid", "left")
    peak, often = ~F.col("weekend") & P.is_peak_slot(F.col("target_slot")), F.coalesce("often", F.lit(False))
    rows = metrics.segments(rows, {"all": F.lit(True), "peak": peak, "saturated": often, "saturated_peak": often & peak})
    return metrics.long_form(rows.withColumn("horizon", F.lit(horizon)), MODELS, ["horizon", "segment"])


def report_table(rows: DataFrame, by: Sequence[str], least: int) -> DataFrame:
    """A row a model of each group: scores, skill against the best one, and calibration."""
    keys = [*by, "model"]
    scores = saved(metrics.summarised(rows, keys).withColumn("brier", R6("brier")))  # groups times models
    held = metrics.calibration(metrics.reliability(rows, keys), keys, least)
    return scores.join(metrics.best_of(scores, by), keys).join(held, keys)


def store_text(rows: DataFrame, order: Sequence[str], path: str) -> None:
    """A small table as one text file whose bytes depend on its rows only."""
    rows.repartition(1).sortWithinPartitions(*order).select(F.to_json(F.struct(*rows.columns))).write.text(path)


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(name, digest) of the artifacts in a folder, each a folder with one file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("name"), F.sha2("content", 256).alias("digest"))


def compared(fresh: DataFrame, frozen: DataFrame) -> DataFrame:
    """(name, same): artifacts that only one side has aren't the same."""
    both = fresh.withColumnRenamed("digest", "a").join(frozen.withColumnRenamed("digest", "b"), "name", "full")
    return both.select("name", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same"))


def met_within(todo: DataFrame, there: DataFrame, metres: float) -> DataFrame:
    """todo (unit, lat0, lon0 and what else) with the rows of there (unit, lat, lon and what else) of its unit within the flat distance, as metres.

    An equi join on the unit and on grid cells; past ALL_M on the unit alone. Rows without a place count as within.
    """
    far = F.round(G.flat_m(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"))).cast("long")
    if metres >= ALL_M:
        return todo.join(there, "unit").withColumn("metres", far)
    step = metres / (EARTH_M * 3.141592653589793 / 180)
    edge = (F.abs("_row") + 2) * step  # no middle of two points is farther from the equator
    width = F.when(edge < 89, F.lit(step) / F.cos(F.radians(edge))).otherwise(1000.0)
    around = lambda c: F.explode(F.array(*(F.floor(c) + i for i in (-1, 0, 1))))
    asked = todo.withColumn("_row", around(F.col("lat0") / step)).withColumn("_cell", around(F.col("lon0") / width))
    cells = there.withColumn("_row", F.floor(F.col("lat") / step)).withColumn("_cell", F.floor(F.col("lon") / width))
    met = asked.join(cells, ["unit", "_row", "_cell"]).drop("_row", "_cell").withColumn("metres", far).where(F.col("metres") <= metres)
    return met.unionByName(todo.join(there.where("lat is null or lon is null"), "unit").withColumn("metres", far))


def suggested(names: DataFrame, asked: DataFrame, limit: int = 5) -> DataFrame:
    """(ask, place, place_id, name): places with a name's word for a token at least, and for every other one such a word or a word of their kind.

    names: place_id, name, kind_words, kind_rank, context, lat, lon; asked: ask, query, lat0, lon0. A kind that was typed goes first,
    then the same start, kinds by rank, the nearer (whole metres), shorter names; one of each name and context.

    Names are compared with queries once each. What goes before the distance is a query's and a place's alone, so only the first
    classes that hold `limit` names are kept; of those, places are sought around each asked point in rings, and a ring that
    surely has the nearest ones ends its search. No asked point meets all places of its query but where those are too few.
    """
    asked = asked.withColumn("spot", F.to_json(F.struct("query", "lat0", "lon0")))
    queries = asked.select("query").distinct().withColumn("_tokens", X.words_of(F.col("query")))
    met = search.word_hits(names.select("name").distinct(), queries.select("query", F.explode("_tokens").alias("_token")), "name", "name")
    found = met.groupBy("name", "query").agg(F.collect_set("_token").alias("_set"))  # the query's tokens at most
    rows = found.join(names.select("name", "kind_words").distinct(), "name").join(queries, "query").withColumn("_in", F.filter("_tokens", lambda t: F.array_contains("_set", t)))
    rows = rows.where(F.forall("_tokens", lambda t: F.array_contains("_in", t) | F.array_contains("kind_words", t)))
    folded = X.plain(F.col("name"))
    fits = rows.select(
        "query", F.col("name").alias("_name"), F.col("kind_words").alias("_words"), folded.alias("folded"), (F.size("_in") == F.size("_tokens")).cast("int").alias("name_only"),
        (~F.startswith(folded, F.array_join("_in", " "))).cast("int").alias("other_start"),
    )
    kind, group = ["name_only", "other_start", "kind_rank"], ["query", "folded", "context"]
    there = names.hint("merge").join(fits, (F.col("name") == F.col("_name")) & F.col("kind_words").eqNullSafe(F.col("_words")))
    first = F.min(F.struct(F.length("name").alias("letters"), "name", "place_id")).alias("first")
    there = saved(there.withColumn("kind", F.struct(*kind)).groupBy(*group, "kind", "lat", "lon").agg(first))
    best = there.groupBy(*group).agg(F.min("kind").alias("kind"))
    classes = Window.partitionBy("query").orderBy("kind").rowsBetween(Window.unboundedPreceding, -1)  # few a query
    room = F.lit(limit) - F.coalesce(F.sum("groups").over(classes), F.lit(0))
    kept = best.groupBy("query", "kind").agg(F.count(F.lit(1)).alias("groups")).withColumn("room", room).where("room > 0")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, "kind"]]
    there = there.alias("a").join(best.join(kept, ["query", "kind"]).alias("b"), reduce(Column.__and__, same)).select("a.*", "b.groups", "b.room")
    alone = F.col("groups") <= F.col("room")  # all of the class are wanted: each is sought by itself
    there = there.withColumn("unit", F.to_json(F.struct("query", "kind", F.when(alone, F.struct("folded", "context")).alias("group"))))
    there = saved(there.withColumn("want", F.when(alone, F.lit(1)).otherwise(F.col("room"))))
    units = there.select("query", "unit", "want").distinct()
    there = there.drop("query", "want", "groups", "room")
    todo, ends, reach = saved(asked.select("spot", "query", "lat0", "lon0").distinct().join(units, "query").drop("query")), [], FIRST_M
    while not ends or not todo.isEmpty():
        near = saved(met_within(todo, there, reach))
        asked_at = F.col("lat0").isNotNull() & F.col("lon0").isNotNull()  # others meet all places in the last ring
        sure = F.lit(reach >= ALL_M) | asked_at & (F.col("metres").isNull() | (F.col("metres") + 1 <= reach))
        done = near.where(sure).groupBy("spot", "unit", "want").agg(F.countDistinct(F.struct("folded", "context")).alias("_n")).where("_n >= want").select("spot", "unit")
        ends.append(near.join(done, ["spot", "unit"], "left_semi"))
        todo, reach = saved(todo.join(done, ["spot", "unit"], "left_anti")), reach * RING
    order = F.struct("kind.*", "metres", "first.*")
    one = reduce(DataFrame.unionByName, ends).groupBy("spot", "folded", "context").agg(F.min(order).alias("o")).select("spot", "o.*")
    place = F.row_number().over(Window.partitionBy("spot").orderBy(*kind, "metres", "letters", "name", "place_id"))
    return one.withColumn("place", place.cast("long")).where(F.col("place") <= limit).join(asked.select("ask", "spot"), "spot").drop("spot")


def period_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of this century by the period of their local day, six hours behind UTC."""
    utc = F.add_months("o_orderdate", 348).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"))
    day = F.to_date(utc - F.expr("INTERVAL 6 HOURS"))
    rows = T.table(spark, sf_dir, "orders").select(day.alias("day")).withColumn("period", period_of(F.col("day"))).where("period is not null")
    return rows.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.date_format("day", "yyyy-MM")).alias("months"), F.min("day").alias("first"), F.max("day").alias("last"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_split(T.readings(spark, sf_dir).select("d").distinct(), "d", DEV)


def dev_day_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir)


def short_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated persistence on the days of the report, by the split with days that only train."""
    rows = saved(L.examples(T.readings(spark, sf_dir)).join(F.broadcast(_parts(spark, sf_dir)), "d"))  # a row a day
    return calibrated_persistence(rows, F.col("part") == "train").where("part = 'report'").select("sid", "t", "y", R6("p_persist_cal").alias("p_persist_cal"))


def model_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All baselines at all horizons by segment, as one table."""
    readings = T.readings(spark, sf_dir)
    rows = saved(reduce(DataFrame.unionByName, [reported(readings, h) for h in REPORTED]))
    out = report_table(rows, ["horizon", "segment"], 100)
    return out.select("horizon", "segment", "model", "n", "best", "brier", *(R6(c).alias(c) for c in ("base_rate", "log_loss", "skill", "gap", "ece")))


def frozen_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates fitted twice on the same days have the bytes that were stored, those fitted on more days have not."""
    ex = saved(L.examples(T.readings(spark, sf_dir)))

    def fitted(days: tuple[int, int]) -> DataFrame:
        folder = fresh_folder(spark, "artifacts")
        for name, key in (("states", "full_now"), ("stations", "sid")):
            store_text(ex.where(F.col("d").between(*days)).groupBy(key).agg(R6(F.avg(F.col("y").cast("int"))).alias("p"), F.count(F.lit(1)).alias("n")), [key], f"{folder}/{name}")
        return digests(spark, folder)

    frozen = fitted(L.TRAIN)
    checks = [compared(fitted(days), frozen).withColumn("days", F.lit(days[1])) for days in (L.TRAIN, (L.TRAIN[0], L.FIT[1]))]
    return checks[0].unionByName(checks[1])


def kinds_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions for every hundredth part: the beginning of its name with its kind, or with the beginning of its next word."""
    part = T.table(spark, sf_dir, "part")
    names = part.select(
        F.col("p_partkey").alias("place_id"), F.concat_ws(" ", "p_name", "p_brand").alias("name"), F.split(X.plain(F.col("p_type")), " ").alias("kind_words"), (F.col("p_size") % 3).alias("kind_rank"),
        (F.col("p_partkey") % 5).alias("context"), (F.lit(19.3) + (F.col("p_partkey") % 89) * 0.0021).cast("double").alias("lat"), (F.lit(-99.2) + (F.col("p_partkey") % 97) * 0.0017).cast("double").alias("lon"),
    )
    w = F.split(X.plain(F.col("name")), " ")
    second = F.when(F.col("place_id") % 200 == 0, F.element_at("kind_words", 1)).otherwise(F.substring(F.element_at(w, 2), 1, 2))
    query = F.concat_ws(" ", F.substring(F.element_at(w, 1), 1, 3), second)
    asked = names.where("place_id % 100 = 0").select(F.col("place_id").alias("ask"), query.alias("query"), F.col("lat").alias("lat0"), F.col("lon").alias("lon0"))
    return suggested(names, asked).select("ask", "place", "place_id", "name", F.col("name_only").cast("long").alias("name_only"), "metres")


QUERIES = [period_split, dev_day_split, short_persistence, model_report, frozen_artifacts, kinds_typed]
W = V.with_views
_CASES = " ".join(f"WHEN day BETWEEN DATE '{first}' AND DATE '{last}' THEN '{name}'" for name, first, last in PERIODS)
_SPLIT = f"""dd AS (SELECT d, d IN {DEV} AS dev FROM (SELECT DISTINCT d FROM snap)),
di AS (SELECT *, count(*) OVER (PARTITION BY dev) AS n, row_number() OVER (PARTITION BY dev ORDER BY d) - 1 AS i FROM dd),
da AS (SELECT *, greatest(1, CAST(round_even(n * {SHARES[0]}::DOUBLE, 0) AS INT)) AS a, greatest(1, CAST(round_even(n * {SHARES[1]}::DOUBLE, 0) AS INT)) AS b FROM di),
parts AS (SELECT d, CASE WHEN dev OR n < 3 OR i < a THEN 'train' WHEN i < least(greatest(b, a + 1), n - 1) THEN 'fit' ELSE 'report' END AS part FROM da)"""
_AGAIN = re.sub(r"\b(tr|pred)\b", r"\1_again", V.predictions(L.TRAIN[0], L.FIT[1]))


def _long_sql(h: int) -> str:
    """The report's long form at a horizon."""
    flags = f"""sat AS (SELECT sid FROM tr GROUP BY sid HAVING avg(CAST(y AS INT)) >= 0.1),
flagged AS (SELECT p.*, {", ".join(f"q.{m} AS {m}_tvf" for m in REFIT)}, p.sid IN (SELECT sid FROM sat) AS often, NOT p.weekend AND p.target_slot BETWEEN 34 AND 41 AS peak
  FROM pred p JOIN pred_again q USING (sid, t) WHERE p.d BETWEEN {L.REPORT[0]} AND {L.REPORT[1]}),
seg AS (SELECT 'all' AS segment, * FROM flagged UNION ALL SELECT 'peak', * FROM flagged WHERE peak UNION ALL SELECT 'saturated', * FROM flagged WHERE often UNION ALL SELECT 'saturated_peak', * FROM flagged WHERE often AND peak)"""
    models = " UNION ALL ".join(f"SELECT {h} AS horizon, segment, '{m}' AS model, CAST(y AS INT) AS y, {m} AS p FROM seg WHERE {m} IS NOT NULL" for m in MODELS)
    return f"({W(V.SNAP, V.examples(h, L.TOLERANCE), V.predictions(), _AGAIN, flags)} {models})"


SQL = {
    "period_split": f"""WITH o AS (SELECT CAST(o_orderdate + INTERVAL 29 YEAR + to_hours(CAST(o_orderkey % 24 AS INT)) - INTERVAL 6 HOUR AS DATE) AS day FROM orders), p AS (SELECT day, CASE {_CASES} END AS period FROM o)
        SELECT period, count(*) AS n, count(DISTINCT strftime(day, '%Y-%m')) AS months, min(day) AS first, max(day) AS last FROM p WHERE period IS NOT NULL GROUP BY 1""",
    "dev_day_split": W(V.SNAP, _SPLIT) + " SELECT * FROM parts",
    "short_persistence": W(V.SNAP, V.examples(), _SPLIT) + """, e AS (SELECT * FROM ex JOIN parts USING (d)), own AS (SELECT sid, full_now, avg(CAST(y AS INT)) AS p FROM e WHERE part = 'train' GROUP BY 1, 2 HAVING count(*) >= 20),
        g AS (SELECT full_now, avg(CAST(y AS INT)) AS g FROM e WHERE part = 'train' GROUP BY 1)
        SELECT sid, t, y, round(coalesce(p, g), 6) AS p_persist_cal FROM e LEFT JOIN own USING (sid, full_now) LEFT JOIN g USING (full_now) WHERE part = 'report'""",
    "model_report": "WITH long AS (" + " UNION ALL ".join(f"SELECT * FROM {_long_sql(h)}" for h in REPORTED) + """),
        s AS (SELECT horizon, segment, model, count(*) AS n, avg(y) AS base_rate, round(avg(pow(p - y, 2)), 6) AS brier,
          -avg(CASE WHEN y = 1 THEN ln(least(greatest(p, 1e-6), 1 - 1e-6)) ELSE ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)) END) AS log_loss FROM long GROUP BY 1, 2, 3),
        b AS (SELECT horizon, segment, model AS best, brier AS least FROM (SELECT *, row_number() OVER (PARTITION BY horizon, segment ORDER BY brier, model) AS k FROM s) WHERE k = 1),
        r AS (SELECT horizon, segment, model, least(greatest(floor(p * 10), 0), 9) AS bin, count(*) AS n, abs(avg(y) - avg(p)) AS gap FROM long GROUP BY 1, 2, 3, 4),
        c AS (SELECT horizon, segment, model, max(gap) FILTER (n >= 100) AS gap, sum(gap * n) / sum(n) AS ece FROM r GROUP BY 1, 2, 3)
        SELECT horizon, segment, model, n, best, brier, round(base_rate, 6) AS base_rate, round(log_loss, 6) AS log_loss, round(CASE WHEN least > 0 THEN 1 - brier / least END, 6) AS skill, round(gap, 6) AS gap, round(ece, 6) AS ece
        FROM s JOIN b USING (horizon, segment) JOIN c USING (horizon, segment, model)""",
    "frozen_artifacts": W(V.SNAP, V.examples()) + "".join(
        f", {name}{last} AS (SELECT {key}, round(avg(CAST(y AS INT)), 6) AS p, count(*) AS n FROM ex WHERE d BETWEEN 1 AND {last} GROUP BY 1)" for name, key in (("states", "full_now"), ("stations", "sid")) for last in (18, 22)
    ) + " " + " UNION ALL ".join(
        f"SELECT '{name}' AS name, {last} AS days, NOT EXISTS (FROM {name}{last} EXCEPT FROM {name}18) AND NOT EXISTS (FROM {name}18 EXCEPT FROM {name}{last}) AS same" for name in ("states", "stations") for last in (18, 22)
    ),
    "kinds_typed": f"""WITH places AS (SELECT p_partkey AS place_id, p_name || ' ' || p_brand AS name, {search.FOLD.format(c="p_name || ' ' || p_brand")} AS folded, string_split({search.FOLD.format(c="p_type")}, ' ') AS kind_words, p_size % 3 AS kind_rank, p_partkey % 5 AS context,
          CAST(19.3 + (p_partkey % 89) * 0.0021::DOUBLE AS DOUBLE) AS lat, CAST(-99.2 + (p_partkey % 97) * 0.0017::DOUBLE AS DOUBLE) AS lon FROM part),
        w AS (SELECT *, string_split(folded, ' ') AS words FROM places),
        asked AS (SELECT place_id AS ask, lat AS lat0, lon AS lon0,
          [substr(words[1], 1, 3), CASE WHEN place_id % 200 = 0 THEN kind_words[1] ELSE substr(words[2], 1, 2) END] AS tokens FROM w WHERE place_id % 100 = 0),
        hit AS (SELECT *, list_filter(tokens, lambda t: len(list_filter(words, lambda x: starts_with(x, t))) > 0) AS found FROM asked, w),
        o AS (SELECT ask, place_id, name, folded, context, kind_rank, CAST(len(found) = len(tokens) AS BIGINT) AS name_only, CAST(NOT starts_with(folded, array_to_string(found, ' ')) AS INT) AS other_start, length(name) AS letters,
          CAST(round(6371000.0 * sqrt(pow(radians(lat - lat0), 2) + pow(radians(lon - lon0) * cos(radians((lat0 + lat) / 2)), 2))) AS BIGINT) AS metres
          FROM hit WHERE len(found) > 0 AND len(list_filter(tokens, lambda t: NOT list_contains(found, t) AND NOT list_contains(kind_words, t))) = 0),
        one AS (SELECT *, row_number() OVER (PARTITION BY ask, folded, context ORDER BY name_only, other_start, kind_rank, metres, letters, name, place_id) AS k FROM o),
        r AS (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY name_only, other_start, kind_rank, metres, letters, name, place_id) AS place FROM one WHERE k = 1)
        SELECT ask, place, place_id, name, name_only, metres FROM r WHERE place <= 5""",
}
