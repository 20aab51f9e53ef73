"""Boosted trees as a table of nodes: chosen by a validation curve, stored as text with a digest, walked in an expression,
tested on later periods, and used on the captures of the moment, in batches and on a stream.

The node table has a row a node: tree, node, feature, threshold or the categories that go left, children, leaf, weight. A
model is a few hundred rows, so it is one broadcast row with an array a tree; scoring has no Python and no MLlib in it.
"""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harborlight.functions.prob import along, brier, clip, log_loss, logit, sigmoid, skill
from harborlight.functions.timeparts import is_peak_slot
from harborlight.operators import stations as S
from harborlight.plans import learning as L
from harborlight.plans import planner
from harborlight.plans.live import all_horizons
from harborlight.plans.models import COLUMNS, isotonic, numeric, platt
from harborlight.plans.trips import flow_of, plausible, ride_times
from harborlight.sources import tables as T
from harborlight.sources.shared import saved, shared_folder

ROUNDS, DEPTH, PATIENCE = 20, 4, 5
#: Stations that are categories of their own; more of them are so many groups of like rates at most.
CATEGORIES = 2_000
#: Days that the curve is read from, of the training days; days of the final tests, after those of the report.
CHECK, PERIODS = 4, {"report": (23, 26), "test": (27, 28), "test_late": (29, 30)}
#: The station is a category; everything else is a number with a mark of its absence.
NUMBERS = [c for c in COLUMNS if c != "station"]
INPUTS = [f"{p}_{c}" for c in [*NUMBERS, "holiday"] for p in ("f", "m")] + ["station_index"]
#: The planner's horizons, and the ones that they stand for on the sparse readings.
SCALED = {15: 720, 30: 1_080, 45: 1_440}
NODES = "tree int, node int, feature int, threshold double, categories array<double>, left int, right int, leaf double, weight double"
MODEL = "digest string, rounds int, xs array<double>, ys array<double>, a double, b double"


def indexed(rows: DataFrame) -> DataFrame:
    """Means are rounded: their last digits depend on the order of a sum, and one value in two spellings moves the trees' splits."""
    means = {c: F.round(c, 9) for c in ("nb_occupancy_mean", "temperature_now")}
    return numeric(rows.withColumns({"holiday": F.col("holiday").cast("int")} | means), [*NUMBERS, "holiday"]).withColumn("name", F.col("sid").cast("string"))


def categories(train: DataFrame, most: int = CATEGORIES) -> DataFrame:
    """(name, category) of the stations: each its own up to `most`, more are cut into groups of equal size by their rate of the label.

    Trees order categories by that rate, so neighbours in the order share a bin; bins, nodes and the work of a split stay bounded.
    Rates are drawn to that of all rows by one row's weight; stations of one rate (four digits) are one group.
    """
    rates = saved(train.groupBy("name").agg(F.sum("label").alias("hits"), F.count(F.lit(1)).alias("n")))
    if rates.count() <= most:
        return rates.select("name", F.col("name").alias("category"))
    mean = rates.agg(F.sum("hits") / F.sum("n")).first()[0]
    rates = rates.withColumn("rate", F.round((F.col("hits") + mean) / (F.col("n") + 1), 4))
    before = F.coalesce(F.sum("stations").over(Window.orderBy("rate").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = rates.groupBy("rate").agg(F.count(F.lit(1)).alias("stations"))  # 10,001 rates at most
    cuts = cuts.select("rate", F.floor(before * most / F.sum("stations").over(Window.partitionBy())).cast("string").alias("category"))
    return rates.join(cuts, "rate").select("name", F.lpad("category", 6, "0").alias("category"))


def fitted(train: DataFrame, folder: str, rounds: int = ROUNDS, depth: int = DEPTH, seed: int = 7):
    """Trees on all features, with the station as a category of as many bins as it needs; stored by MLlib in the folder."""
    names = StringIndexer(inputCol="name", outputCol="station_index", handleInvalid="keep", stringOrderType="alphabetAsc").fit(train)
    bins = max(32, len(names.labels) + 2)
    trees = GBTClassifier(labelCol="label", featuresCol="x", maxIter=rounds, maxDepth=depth, maxBins=bins, seed=seed)
    model = Pipeline(stages=[names, VectorAssembler(inputCols=INPUTS, outputCol="x"), trees]).fit(train)
    model.write().overwrite().save(folder)
    return model


def nodes_of(spark: SparkSession, folder: str) -> DataFrame:
    """The node table of a pipeline that MLlib stored: its last stage's trees."""
    stage = f"{folder}/stages/2_*"
    weights = spark.read.parquet(f"{stage}/treesMetadata").toDF("tree", "metadata", "weight").drop("metadata")
    n = F.col("nodeData")
    number, inner = n["split"]["numCategories"] < 0, n["leftChild"] >= 0
    rows = spark.read.parquet(f"{stage}/data").toDF("tree", "nodeData").select(
        "tree", n["id"].alias("node"), F.when(inner, n["split"]["featureIndex"]).alias("feature"),
        F.when(inner & number, F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        F.when(inner & ~number, F.array_sort(n["split"]["leftCategoriesOrThreshold"])).alias("categories"),
        F.when(inner, n["leftChild"]).alias("left"), F.when(inner, n["rightChild"]).alias("right"), F.when(~inner, n["prediction"]).alias("leaf"),
    )
    return rows.join(F.broadcast(weights), "tree").select(*(F.col(c.split()[0]) for c in NODES.split(", ")))  # a row a tree


def lines_of(nodes: DataFrame) -> DataFrame:
    return nodes.select("tree", "node", F.to_json(F.struct(*nodes.columns)).alias("value"))


def digest_of(nodes: DataFrame) -> str:
    """sha-256 of the nodes' lines in order; a model's nodes are few."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("tree", "node", "value"))), lambda x: x["value"])
    return lines_of(nodes).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("d")).first().d


def bits_of(numbers: Column) -> Column:
    """An array of longs with a bit for each of the numbers; null stays null."""
    word = lambda w: F.aggregate(F.filter(numbers, lambda c: F.floor(c / 64) == w), F.lit(0).cast("long"), lambda s, c: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (c % 64).cast("int"))))
    return F.transform(F.sequence(F.lit(0), F.floor(F.array_max(numbers) / 64).cast("int")), word)


def trees_of(nodes: DataFrame) -> DataFrame:
    """One row: trees, an array of (weight, nodes by number); the categories that go left are bits."""
    nodes = nodes.withColumn("bits", bits_of(F.col("categories")))
    one = nodes.groupBy("tree", "weight").agg(F.array_sort(F.collect_list(F.struct("node", "feature", "threshold", "bits", "left", "right", "leaf"))).alias("nodes"))
    return one.agg(F.array_sort(F.collect_list(F.struct("tree", "weight", "nodes"))).alias("trees"))


def leaves(trees: Column, x: Column, depth: int = DEPTH) -> Column:
    """The weighted leaf that x reaches in each tree."""

    def step(nodes: Column, at: Column) -> Column:
        n = F.get(nodes, at)
        value = F.get(x, n["feature"])
        among = F.getbit(F.get(n["bits"], F.floor(value / 64).cast("int")), (value % 64).cast("int")) == 1  # null behind the last bit: not left
        left = F.when(n["bits"].isNotNull(), among).otherwise(value <= n["threshold"])
        return F.when(n["feature"].isNull(), at).when(left, n["left"]).otherwise(n["right"])

    def leaf(tree: Column) -> Column:
        at = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), lambda at, _: step(tree["nodes"], at))
        return tree["weight"] * F.get(tree["nodes"], at)["leaf"]

    return F.transform(trees, leaf)


def vectors(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with x, the features in the trees' order; labels: (name, station_index), a station that isn't in it is the category behind all."""
    last = labels.agg(F.max("station_index")).first()[0]
    rest = F.lit(0.0 if last is None else last + 1)
    named = rows.drop("station_index").join(labels, "name", "left").withColumn("station_index", F.coalesce("station_index", rest))
    return named.withColumn("x", F.array(*(F.col(c).cast("double") for c in INPUTS)))


def scored(rows: DataFrame, trees: DataFrame) -> DataFrame:
    """rows with p_raw: MLlib's probability, from the margin of all trees."""
    with_trees = rows.crossJoin(F.broadcast(trees))  # one row
    margin = F.aggregate(leaves(F.col("trees"), F.col("x")), F.lit(0.0), lambda s, v: s + v)
    return with_trees.withColumn("p_raw", sigmoid(2 * margin)).drop("trees")


def curve(rows: DataFrame, trees: DataFrame) -> DataFrame:
    """(round, n, loss): the log loss after each round; every row is walked once."""
    with_trees = rows.crossJoin(F.broadcast(trees)).select("y", leaves(F.col("trees"), F.col("x")).alias("v"))  # one row
    sums = F.transform(F.sequence(F.lit(1), F.size("v")), lambda k: F.aggregate(F.slice("v", 1, k), F.lit(0.0), lambda s, v: s + v))
    each = with_trees.select("y", F.posexplode(sums).alias("at", "margin"))
    return each.groupBy((F.col("at") + 1).alias("round")).agg(F.count(F.lit(1)).alias("n"), log_loss(sigmoid(2 * F.col("margin")), F.col("y")).alias("loss"))


def chosen_round(losses: list[tuple[int, float]], patience: int = PATIENCE) -> int:
    """The best round before the first one that is `patience` rounds behind the best so far."""
    best, least = 1, float("inf")
    for k, loss in sorted(losses):
        if loss < least:
            best, least = k, loss
        elif k - best >= patience:
            break
    return best


def subgroup(rows: DataFrame, often: DataFrame) -> DataFrame:
    """rows with sub: peak slots of working days at the stations that are often full."""
    marked = rows.join(often.select("sid", F.lit(True).alias("_often")), "sid", "left")
    return marked.withColumn("sub", F.coalesce("_often", F.lit(False)) & ~F.col("weekend") & is_peak_slot(F.col("target_slot"))).drop("_often")


def calibrated(rows: DataFrame, model: DataFrame) -> DataFrame:
    """rows with p_trees, through the isotonic knots, and p, on the subgroup through Platt's map as well."""
    with_model = rows.crossJoin(F.broadcast(model))  # one row
    p = along(F.col("p_raw"), F.col("xs"), F.col("ys"))
    q = F.when(F.col("sub"), sigmoid(F.col("a") * logit(F.col("p_trees")) + F.col("b"))).otherwise(F.col("p_trees"))
    return with_model.withColumn("p_trees", p).withColumn("p", q).drop(*(c.split()[0] for c in MODEL.split(", ")))


def shared_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """What all horizons' features and models read, each computed once."""
    r = saved(T.readings(spark, sf_dir))
    return {
        "readings": r, "places": saved(S.places(r)), "profile": saved(S.profile(r.where(F.col("d").between(*L.TRAIN)))),
        "flow": saved(flow_of(plausible(spark, sf_dir))), "weather": saved(T.weather(spark, sf_dir)),
    }


FLOWS = ["flow_arrivals_target", "flow_departures_target", "flow_net_target", "flow_net_window"]


def several(readings: DataFrame, shared: dict[str, DataFrame], ex: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """Features of examples with a y{h} for each horizon, in a fixed order; at_horizon takes one horizon out.

    Lags, neighbours and weather are the same for all horizons and found once; flows are found once for each different
    pair of slots and kind of day, not for each row.
    """
    rows = L.around(readings, T.last_of_day(readings), shared["weather"], ex, shared["places"]).join(shared["profile"], "sid", "left")
    to = {h: F.struct(*(c.alias(n) for n, c in L.arrival(h).items())) for h in horizons}
    rows = saved(rows.withColumns({"station_id": L.station_code()} | {f"to{h}": c for h, c in to.items()}))
    keys = ["station_id", "slot", *(f"to{h}" for h in horizons)]
    found = rows.select(keys).distinct()
    for h in horizons:
        found = L.flows(found.select("*", f"to{h}.*"), shared["flow"]).withColumn(f"flow{h}", F.struct(FLOWS)).drop("target_slot", "weekend", *FLOWS)
    rows = rows.join(saved(found), keys).drop("station_id").withColumns(L.state())
    return saved(in_order(rows))


def in_order(rows: DataFrame) -> DataFrame:
    """A fixed order, by days first, so that reads of some days skip the pages of others."""
    return rows.repartition("sid").sortWithinPartitions("d", "sid", "t")


def at_horizon(rows: DataFrame, horizon: int) -> DataFrame:
    """Features and label of the examples of one of several() horizons."""
    plain = [c for c, kind in rows.dtypes if not kind.startswith("struct")]
    one = rows.where(F.col(f"y{horizon}").isNotNull()).select(*plain, *(f"{c}{horizon}.*" for c in ("y", "to", "flow")))
    return indexed(one.withColumns(L.calendar(horizon))).withColumn("label", F.col("y").cast("double"))


def matrix(spark: SparkSession, sf_dir: str, horizon: int = L.HORIZON, shared: dict[str, DataFrame] | None = None) -> DataFrame:
    """Features and label of all examples, in a fixed order, so that fits agree between runs."""
    shared = shared_tables(spark, sf_dir) if shared is None else shared
    r = shared["readings"]
    return saved(at_horizon(several(r, shared, L.examples_of(r, (horizon,)), (horizon,)), horizon))


def freeze(spark: SparkSession, sf_dir: str, rows: DataFrame, rounds: int = ROUNDS, shared: dict[str, DataFrame] | None = None) -> str:
    """Fits, chooses the round, calibrates and stores all that scoring needs; returns the folder.

    nodes: the kept trees as lines of JSON in order; labels: stations and the number of their category; model: digest, knots and Platt's map;
    often: the stations of the subgroup; places, profile, flow, weather: the fixed side of the features; curve.
    """
    folder = f"{shared_folder(spark)}/frozen-{uuid.uuid4().hex}"
    train = rows.where(F.col("d").between(*L.TRAIN))
    check = F.col("d") > L.TRAIN[1] - CHECK
    learn = train.where(~check)
    groups = saved(categories(learn))
    if not groups.where("name <> category").isEmpty():
        taken = learn.select("sid", "t", "d", "name", "label", *(c for c in INPUTS if c in learn.columns))
        learn = saved(in_order(taken.join(groups, "name").drop("name").withColumnRenamed("category", "name")))
    model = fitted(learn, f"{folder}/mllib", rounds)
    index = spark.createDataFrame([(n, float(i)) for i, n in enumerate(model.stages[0].labels)], "category string, station_index double")
    labels = saved(groups.join(F.broadcast(index), "category").select("name", "station_index"))  # as many as there are categories
    labels.write.json(f"{folder}/labels")
    every = saved(nodes_of(spark, f"{folder}/mllib"))
    losses = saved(curve(vectors(train.where(check), labels), trees_of(every)))
    losses.coalesce(1).write.json(f"{folder}/curve")
    best = chosen_round([(r["round"], r.loss) for r in losses.collect()]) if not losses.isEmpty() else rounds  # a row a round
    nodes = every.where(F.col("tree") < best)
    lines_of(nodes).coalesce(1).sort("tree", "node").select("value").write.text(f"{folder}/nodes")
    often = saved(L.saturated(train.select("sid", "target_slot", "weekend", "y", "d")).select("sid"))
    often.write.parquet(f"{folder}/often")
    fit = saved(subgroup(scored(vectors(rows.where(F.col("d").between(*L.FIT)), labels), trees_of(nodes)), often).select("sub", "y", "p_raw"))
    xs, ys = isotonic(fit, "p_raw")
    knots = spark.createDataFrame([("", 0, xs, ys, 1.0, 0.0)], MODEL)
    a, b = platt(calibrated(fit, knots).where("sub"), "p_trees")
    spark.createDataFrame([(digest_of(nodes), best, xs, ys, a, b)], MODEL).coalesce(1).write.json(f"{folder}/model")
    shared = shared_tables(spark, sf_dir) if shared is None else shared
    for name in ("places", "profile", "flow", "weather"):
        shared[name].write.parquet(f"{folder}/{name}")
    return folder


def load_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.text(f"{folder}/nodes").select(F.from_json("value", NODES).alias("n")).select("n.*")


def predicted(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """rows (features with numbers and marks) with p_raw, p_trees, p and sub, by what the folder holds; a changed node table is an error."""
    nodes, model = load_nodes(spark, folder), spark.read.schema(MODEL).json(f"{folder}/model")
    if digest_of(nodes) != model.first().digest:
        raise ValueError(f"{folder}: the nodes aren't those that were stored")
    labels = spark.read.schema("name string, station_index double").json(f"{folder}/labels")
    marked = subgroup(scored(vectors(rows, labels), trees_of(nodes)), spark.read.parquet(f"{folder}/often"))
    return calibrated(marked, model)


def live(spark: SparkSession, folder: str, lookback: DataFrame, ex: DataFrame, horizon: int = L.HORIZON) -> DataFrame:
    """(sid, t, p_trees, p, sub) of the examples, from readings that reach back as far as the longest lag; all else is the folder's."""
    held = lambda name: spark.read.parquet(f"{folder}/{name}")
    rows = L.features(lookback, T.last_of_day(lookback), held("flow"), held("weather"), ex, horizon, places=held("places"), profile=held("profile"))
    return predicted(spark, folder, indexed(rows)).select("sid", "t", "p_raw", "p_trees", "p", "sub")


#: How far live features look back.
LOOKBACK = max(L.LAGS) + L.TOLERANCE


def latest(readings: DataFrame, minutes: int = LOOKBACK) -> tuple[DataFrame, DataFrame]:
    """(readings of the days that the lags of each station's last one can reach, the last ones in service)."""
    last = readings.groupBy("sid").agg(F.max("t").alias("until"))
    first_day = F.date_trunc("day", F.col("until") - F.make_dt_interval(mins=F.lit(minutes))).cast("timestamp_ntz")
    rows = readings.join(last, "sid").where(F.col("t") >= first_day)
    return rows.drop("until"), rows.where("t = until and ok").drop("until")


# queries


def _frozen(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    shared = shared_tables(spark, sf_dir)
    rows = matrix(spark, sf_dir, shared=shared)
    return freeze(spark, sf_dir, rows, shared=shared), rows


def gbt_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validation curve of the rounds, and which one was kept."""
    folder, _ = _frozen(spark, sf_dir)
    kept = spark.read.schema(MODEL).json(f"{folder}/model").select("rounds")
    return spark.read.schema("round int, n long, loss double").json(f"{folder}/curve").crossJoin(F.broadcast(kept)).select("round", "n", "loss", (F.col("round") == F.col("rounds")).alias("kept"))  # one row


def frozen_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored node table, with the names of the features."""
    folder, _ = _frozen(spark, sf_dir)
    names = F.array(*map(F.lit, INPUTS))
    nodes = load_nodes(spark, folder)
    return nodes.select("tree", "node", F.get(names, F.col("feature")).alias("name"), "threshold", F.size("categories").alias("n_left"), "left", "right", "leaf", "weight")


def final_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the frozen trees and the baselines on the report's days and on two later periods, over all and on the subgroup."""
    folder, rows = _frozen(spark, sf_dir)
    base = saved(L.baselines(L.examples(T.readings(spark, sf_dir)))).select("sid", "t", "p_persist", "p_persist_cal", "p_hist")
    found = saved(predicted(spark, folder, rows.where(F.col("d") >= L.REPORT[0])).join(base, ["sid", "t"]))
    period = F.coalesce(*(F.when(F.col("d").between(*days), F.lit(name)) for name, days in PERIODS.items()))
    models = ["p_persist", "p_persist_cal", "p_hist", "p_trees", "p"]
    long = found.select(period.alias("period"), "sub", "y", "p_hist", F.explode(F.array(*(F.struct(F.lit(m).alias("model"), clip(F.col(m)).alias("score")) for m in models))).alias("m"))
    long = long.select("period", F.explode(F.when(F.col("sub"), F.array(F.lit("all"), F.lit("sub"))).otherwise(F.array(F.lit("all")))).alias("segment"), "y", "p_hist", "m.*").where("period is not null")
    score, reference = brier(F.col("score"), F.col("y")), brier(F.col("p_hist"), F.col("y"))
    return long.groupBy("period", "segment", "model").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("y").cast("int")).alias("rate"), score.alias("brier"), log_loss(F.col("score"), F.col("y")).alias("log_loss"), skill(score, reference).alias("skill")
    )


def live_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each station's last reading in service with the stored model's probabilities, from the readings that its lags can reach."""
    folder, _ = _frozen(spark, sf_dir)
    lookback, now = latest(T.readings(spark, sf_dir))
    return live(spark, folder, saved(lookback), L.examples_now(now)).select("sid", "t", "p_trees", "p", "sub")


def scored_board(spark: SparkSession, sf_dir: str, rounds: int = 6) -> DataFrame:
    """The planner's board: each station's latest state with the stored models' probability of being full after each horizon.

    A model a horizon; a horizon that a station has no forecast for is null. The planner's horizons stand for the scaled ones.
    """
    shared, horizons = shared_tables(spark, sf_dir), tuple(SCALED.values())
    readings = shared["readings"]
    rows = several(readings, shared, L.examples_of(readings, horizons), horizons)
    lookback, now = latest(readings)
    now = L.known(now).withColumns({f"y{m}": F.struct(F.lit(None).cast("boolean").alias("y")) for m in horizons})
    live_rows = several(saved(lookback), shared, now, horizons)
    frames = []
    for h, minutes in SCALED.items():
        folder = freeze(spark, sf_dir, at_horizon(rows, minutes), rounds, shared)
        frames.append(predicted(spark, folder, at_horizon(live_rows, minutes)).select("sid", "t", F.col("p").alias(f"p_full_{h}")))
    forecasts = all_horizons([saved(f) for f in frames], ["sid", "t"]).drop("t").withColumnRenamed("sid", "station_id")
    state = planner.board(spark, sf_dir).drop(*(f"p_full_{h}" for h in SCALED))
    return saved(state.join(forecasts, "station_id", "left"))


def plan_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips ranked by expected time with the stored models' probabilities."""
    board = scored_board(spark, sf_dir)
    rows = planner.ranked(planner.candidates(planner.requests(spark, sf_dir), board), board, ride_times(spark, sf_dir))
    return rows.select("request_id", "station_id", "rank", "recommendable", "ride_min", "p_full", "expected_min")


QUERIES = [gbt_curve, frozen_nodes, final_test, live_scores, plan_live]
SQL: dict[str, str] = {}
