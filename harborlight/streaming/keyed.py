"""Streams with keyed state: lags and labels as their times pass, request limits, and live scores by the stored model.

Rows wait in a key's state until the watermark has passed them, and are then taken in the order of their times, so rows that
come late (by less than LATE) give what they would have given in time. A timer at the next time that something is due wakes
keys without new rows, and another one empties the state of keys that have gone quiet. What a key keeps is bounded by time.
Stations share a key by blocks of neighbouring ids, as a call for each station costs far more than its few rows.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from harborlight.plans import learning as L
from harborlight.plans import models, scoring
from harborlight.plans import views_sql as V
from harborlight.sources import tables as T
from harborlight.sources.shared import shared_folder
from harborlight.streaming.jobs import LATE, drained, files_a_batch, files_for, in_turn

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MINUTE = 60_000
#: Minutes that a lag looks back, requests that a client may make in so many minutes, ids that are remembered of each.
LAG, CALLS, CALL_WINDOW, SEEN = 1_440, 4, 2_880, 5
#: Stations whose ids differ in so many low bits only share a key of the state.
BLOCK_BITS = 6


class InOrder(StatefulProcessor):
    """Takes each key's rows in the order of their times. Times are milliseconds since the epoch."""

    waits = "id bigint, ms bigint, flag boolean, other boolean, what bigint"

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waits)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [r for part in rows for r in part[["id", "ms", "flag", "other", "what"]].itertuples(index=False, name=None)]
        yield from self.run(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.run(key, [], timerValues.getCurrentWatermarkInMs())

    def run(self, key, new: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        if out := self.step(new, now):
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["sid", "id", "kind", "value"])

    def step(self, new: list[tuple], now: int) -> list[tuple]:
        """What one station gives for new rows and a watermark."""
        waiting = [tuple(r) for r in self.waiting.get()] + [(int(i), int(ms), bool(f), bool(o), int(w)) for i, ms, f, o, w in new]
        due = sorted((r for r in waiting if r[1] <= now), key=lambda r: (r[1], r[0]))
        rest = [r for r in waiting if r[1] > now]
        self.waiting.put(rest) if rest else self.waiting.clear()
        out, wake = self.taken(due, now)
        wake = min([wake, *(r[1] for r in rest)], key=lambda x: x if x is not None else float("inf"))
        if wake is not None and wake > now:
            self.handle.registerTimer(wake)
        return out

    def taken(self, due: list[tuple], now: int) -> tuple[list[tuple], int | None]:
        """(rows to give out, when to wake up at the latest) from rows in order."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class LagsAndLabels(InOrder):
    """flag: full, other: in service. Gives each reading's state before it, if recent, and each reading in service its later state.

    The label is the state at the first reading at or after t + horizon - tolerance; a late or bad one gives none.
    """

    def __init__(self, lag: int = LAG, horizon: int = L.HORIZON, tolerance: int = L.TOLERANCE):
        self.lag, self.low, self.high = lag * MINUTE, (horizon - tolerance) * MINUTE, (horizon + tolerance) * MINUTE

    def init(self, handle) -> None:
        super().init(handle)
        self.recent = handle.getListState("recent", "id bigint, ms bigint, flag boolean, other boolean, labelled boolean")

    def taken(self, due: list[tuple], now: int) -> tuple[list[tuple], int | None]:
        recent, out = [list(r) for r in self.recent.get()], []
        for i, ms, full, ok, _ in due:
            last = recent[-1] if recent else None
            out.append((i, "lag", last[2] if last and ms - last[1] <= self.lag else None))
            recent.append([i, ms, full, ok, not ok])
        times = [r[1] for r in recent]
        for r in recent:
            if not r[4]:
                at = bisect_left(times, r[1] + self.low)
                first = recent[at] if at < len(recent) else None
                if first or now >= r[1] + self.high:  # all readings up to now are here
                    r[4] = True
                    if first and first[1] <= r[1] + self.high and first[3]:
                        out.append((r[0], "label", first[2]))
        # a reading stays while it can be a lag, or its label is open and needs those behind it
        open_ = [r[1] for r in recent if not r[4]]
        least = min([now - self.lag, *open_])
        kept = [r for k, r in enumerate(recent) if r[1] >= least]
        self.recent.put([tuple(r) for r in kept]) if kept else self.recent.clear()
        return out, (min(open_) + self.high if open_ else kept[-1][1] + self.lag + 1 if kept else None)


class Limit(InOrder):
    """what: the id of what is asked for. Gives each request whether it is allowed, and of the allowed ones whether the id is new.

    Allowed are at most `calls` in any window that ends with a request, both ends included; refused ones don't count. Of each
    client the last `seen` new ids are remembered. A client without recent calls is forgotten, ids too.
    """

    def __init__(self, calls: int = CALLS, minutes: int = CALL_WINDOW, seen: int = SEEN):
        self.calls, self.window, self.limit = calls, minutes * MINUTE, seen

    def init(self, handle) -> None:
        super().init(handle)
        self.held = handle.getListState("held", "ms bigint, what bigint, call boolean")

    def taken(self, due: list[tuple], now: int) -> tuple[list[tuple], int | None]:
        held = [tuple(r) for r in self.held.get()]
        calls, seen, out = [r[0] for r in held if r[2]], [r[1] for r in held if not r[2]], []
        for i, ms, _, _, what in due:
            calls = [c for c in calls if c >= ms - self.window]
            if not calls:
                seen = []
            allowed = len(calls) < self.calls
            out.append((i, "allowed", allowed))
            if allowed:
                calls.append(ms)
                out.append((i, "first", what not in seen))
                if what not in seen:
                    seen = [*seen, what][-self.limit :]
        if calls and calls[-1] < now - self.window:
            calls, seen = [], []
        kept = [(c, 0, True) for c in calls] + [(0, w, False) for w in seen]
        self.held.put(kept) if kept else self.held.clear()
        return out, (calls[-1] + self.window + 1 if calls else None)


class Slot:
    """A list state of the rules within a block: the rows of the station that is at hand.

    All stations' rows are one text in the block's state, as each row of a state costs far more on its way than its bytes.
    """

    schema = "rows string"

    def __init__(self, state):
        self.state, self.rows, self.sid = state, {}, None

    def load(self) -> None:
        self.rows = {}
        for (text,) in self.state.get():
            for sid, *row in json.loads(text):
                self.rows.setdefault(sid, []).append(tuple(row))

    def store(self) -> None:
        rows = [(sid, *row) for sid, part in self.rows.items() for row in part]
        self.state.put([(json.dumps(rows),)]) if rows else self.state.clear()

    def get(self) -> Iterator[tuple]:
        return iter(self.rows.get(self.sid, ()))

    def put(self, rows: list[tuple]) -> None:
        self.rows[self.sid] = rows

    def clear(self) -> None:
        self.rows.pop(self.sid, None)


class Blocks(StatefulProcessor):
    """Runs the rules for each station of a block; the block's state is read and written once a call, and has one timer."""

    def __init__(self, rules: InOrder):
        self.rules = rules

    def init(self, handle) -> None:
        self.handle, self.slots, self.wakes = handle, [], []
        self.rules.init(self)

    def getListState(self, name: str, schema: str) -> Slot:
        self.slots.append(Slot(self.handle.getListState(name, Slot.schema)))
        return self.slots[-1]

    def registerTimer(self, ms: int) -> None:
        self.wakes.append(ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, list[tuple]] = {}
        for part in rows:
            for sid, *row in part[["sid", "id", "ms", "flag", "other", "what"]].itertuples(index=False, name=None):
                new.setdefault(sid, []).append(tuple(row))
        yield from self.run(new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.run({}, timerValues.getCurrentWatermarkInMs())

    def run(self, new: dict[int, list[tuple]], now: int) -> Iterator[pd.DataFrame]:
        for slot in self.slots:
            slot.load()
        self.wakes, out = [], []
        for sid in {*new, *(sid for slot in self.slots for sid in slot.rows)}:
            for slot in self.slots:
                slot.sid = sid
            out += [(sid, *r) for r in self.rules.step(new.get(sid, []), now)]
        for slot in self.slots:
            slot.store()
        if self.wakes:
            self.handle.registerTimer(min(self.wakes))
        if out:
            yield pd.DataFrame(out, columns=["sid", "id", "kind", "value"])

    def close(self) -> None:
        pass


def ordered(stream: DataFrame, processor: InOrder) -> DataFrame:
    """(sid, id, kind, value) of a stream of (sid, t, id, flag, other, what); rows without a station give nothing."""
    rows = stream.where("sid is not null").withWatermark("t", LATE).withColumns({"ms": F.unix_millis("t"), "block": F.shiftright("sid", BLOCK_BITS)})
    return rows.groupBy("block").transformWithStateInPandas(Blocks(processor), "sid bigint, id bigint, kind string, value boolean", "Append", "EventTime")


def run(stream: DataFrame) -> DataFrame:
    """drained() with the state in RocksDB, whose size the executors' memory doesn't bound."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return drained(stream)
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def late_parts(spark: SparkSession, sf_dir: str, days: int = 6) -> str:
    """A folder of so many days of events at a time, as a feed would add them: some of the last hours of a part come with the
    next one, and two parts with one far later event of no station end the feed, so that all times pass.
    """
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    part = F.floor((F.day("ts") - 1) / days)
    late = (F.day("ts") % days == 0) & (F.hour("ts") >= 22) & (F.col("event_id") % 3 == 0)
    count = -(-31 // days)
    parts = [rows.where(F.when(late, part + 1).otherwise(part) == n) for n in range(count)]
    end = rows.limit(1).select(*(F.lit(-1).cast(rows.schema[c].dataType).alias(c) if c in ("event_id", "user_id") else F.col(c) for c in rows.columns))
    for more in (100, 200):  # the second one lets the watermark of the first pass
        parts.append(end.withColumn("ts", (F.lit("2024-02-01").cast("timestamp_ntz") + F.make_dt_interval(days=F.lit(more)))))
    return in_turn(spark, parts, files_for(rows, count))


def feed(spark: SparkSession, folder: str) -> DataFrame:
    """The folder's events as (sid, t, id, flag: full, other: in service, what), a part a micro-batch."""
    k = F.get_json_object("props", "$.k").cast("int")
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", files_a_batch(folder)).parquet(folder)
    return stream.select(F.col("user_id").alias("sid"), F.col("ts").cast("timestamp").alias("t"), F.col("event_id").alias("id"), (k % 10 == 0).alias("flag"), (F.col("event_type") != "error").alias("other"), (k % 12).cast("long").alias("what"))


def stream_state_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags and labels from keyed state, over several files with late rows."""
    rows = run(ordered(feed(spark, late_parts(spark, sf_dir)), LagsAndLabels()))
    return rows.where("sid >= 0").select("sid", F.col("id").alias("event_id"), "kind", "value")


def stream_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests of clients: which are allowed, and of those which ask for something new."""
    rows = run(ordered(feed(spark, late_parts(spark, sf_dir)), Limit())).where("sid >= 0")
    wide = rows.groupBy("sid", "id").agg(F.max(F.when(F.col("kind") == "allowed", F.col("value"))).alias("allowed"), F.max(F.when(F.col("kind") == "first", F.col("value"))).alias("first"))
    return wide.select("sid", F.col("id").alias("event_id"), "allowed", "first")


def scored_captures(stream: DataFrame, model: str, score: Callable[[DataFrame, DataFrame], DataFrame], minutes: int = scoring.LOOKBACK) -> DataFrame:
    """Every reading in service of a stream of events, scored once by the model in a folder.

    A micro-batch's readings are stored by batch and day, and with those of the days that the lags of its readings can reach
    (other days aren't read) they give the features. A batch that is run again replaces its own rows.
    """
    spark = stream.sparkSession
    out = f"{shared_folder(spark)}/captures-{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        rows = T.as_readings(batch).withColumn("day", F.to_date("t"))
        rows.repartition("day").write.partitionBy("day").mode("overwrite").parquet(f"{out}/readings/batch={n}")
        held = batch.sparkSession.read.schema(rows.schema.add("batch", "long")).parquet(f"{out}/readings").where(F.col("batch") <= n)
        new = held.where(F.col("batch") == n)
        least = new.agg(F.min("t")).first()[0]
        if least is None:
            return
        reach = F.to_date(F.lit(least) - F.make_dt_interval(mins=F.lit(minutes)))
        lookback = held.where(F.col("day") >= reach).drop("batch", "day")
        score(lookback, L.examples_now(new.drop("batch", "day"))).write.mode("overwrite").parquet(f"{out}/scores/batch={n}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/scores").drop("batch")


def stream_live_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prediction a capture by the stored trees, over several parts of whole days."""
    from harborlight.streaming.jobs import in_parts

    model, _ = scoring._frozen(spark, sf_dir)
    folder = in_parts(spark, sf_dir)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", files_a_batch(folder)).parquet(folder)
    rows = scored_captures(stream, model, lambda lookback, ex: scoring.live(spark, model, lookback, ex))
    return rows.select("sid", "t", "p_trees", "p", "sub")


def refitted(stream: DataFrame, step: int = 7, window: int = 28, gap: int = 1, least: int = 1_000) -> DataFrame:
    """A stream of scores with their outcomes (sid, t, d, p, y), each score through its week's isotonic map: p_roll.

    A micro-batch adds the counts of its scores by day and digits, then fits the maps of its weeks from the counts of the days that
    end `gap` before them, stores them by week, and scores with them. Batches must come in the order of weeks, each whole;
    a batch that is run again replaces its own rows. Only counts are kept, a bounded number a day.
    """
    spark = stream.sparkSession
    out = f"{shared_folder(spark)}/refit-{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        rows = models.saved(batch.withColumn("week", F.floor((F.col("d") - 1) / step)))
        counts = rows.groupBy("d", F.round("p", models.DIGITS).alias("x")).agg(F.sum(F.col("y").cast("double")).alias("hits"), F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{out}/counts/batch={n}")
        held = spark.read.schema("d long, x double, hits double, n long, batch long").parquet(f"{out}/counts").where(F.col("batch") <= n).drop("batch")
        maps = models.weekly_maps(held, rows.select("week").distinct(), step, window, gap)
        maps.write.mode("overwrite").parquet(f"{out}/maps/batch={n}")
        stored = spark.read.parquet(f"{out}/maps/batch={n}")
        models.mapped(rows, stored, least).write.mode("overwrite").parquet(f"{out}/rows/batch={n}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("batch")


def stream_recalibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly recalibration as its weeks close, a part of the feed a week."""
    rows = models.saved(models._predictions(spark, sf_dir).select("sid", "t", F.col("d").cast("long").alias("d"), "y", "p"))
    weeks = -(-31 // 7)
    folder = in_turn(spark, (rows.where(F.floor((F.col("d") - 1) / 7) == week) for week in range(weeks)), files_for(rows, weeks))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_a_batch(folder)).parquet(folder)
    return refitted(stream, least=50).select("sid", "t", "d", "week", "y", F.round("p", 6).alias("p"), F.round("p_roll", 6).alias("p_roll"))


QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [stream_state_lags, stream_limits, stream_live_scores, stream_recalibration]
_EVENTS = "e AS (SELECT event_id, user_id AS sid, ts, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"
SQL = {
    "stream_recalibration": models.WEEKLY_SQL,
    "stream_state_lags": V.with_views(V.SNAP, V.examples()) + f""", {_EVENTS}, b AS (SELECT *, lag(ts) OVER w AS b_ts, lag(k) OVER w AS b_k FROM e WINDOW w AS (PARTITION BY sid ORDER BY ts, event_id))
        SELECT sid, event_id, 'lag' AS kind, CASE WHEN ts - b_ts <= INTERVAL {LAG} MINUTE THEN b_k % 10 = 0 END AS value FROM b
        UNION ALL SELECT ex.sid, e.event_id, 'label', ex.y FROM ex JOIN e ON e.sid = ex.sid AND e.ts = ex.t""",
    "stream_limits": f"""WITH RECURSIVE {_EVENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY ts, event_id) AS n FROM e),
        s AS (SELECT DISTINCT sid, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BOOLEAN) AS allowed, CAST(NULL AS BOOLEAN) AS first, CAST([] AS TIMESTAMP[]) AS calls, CAST([] AS INT[]) AS seen FROM e
          UNION ALL SELECT sid, n, event_id, allowed, CASE WHEN allowed THEN fresh END, CASE WHEN allowed THEN list_append(recent, ts) ELSE recent END,
            CASE WHEN allowed AND fresh THEN list_append(known, what)[-{SEEN}:] ELSE known END
          FROM (SELECT *, len(recent) < {CALLS} AS allowed, NOT list_contains(known, what) AS fresh FROM (SELECT *, CASE WHEN len(recent) = 0 THEN CAST([] AS INT[]) ELSE seen END AS known
            FROM (SELECT o.sid, o.n, o.event_id, o.ts, o.k % 12 AS what, s.seen, list_filter(s.calls, lambda c: c >= o.ts - INTERVAL {CALL_WINDOW} MINUTE) AS recent FROM s JOIN o ON o.sid = s.sid AND o.n = s.n + 1))))
        SELECT sid, event_id, allowed, first FROM s WHERE n > 0""",
}
