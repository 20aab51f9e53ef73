"""The shared views, as DuckDB SQL, for the comparison of results."""

SNAP = """
snap AS (
  SELECT user_id AS sid, ts AS t, day(ts) AS d, event_type <> 'error' AS ok, k % 10 AS docks, 19 - k % 20 AS bikes, k % 3 AS docks_disabled,
         20 AS capacity, k % 10 = 0 AS is_full, CAST(19.40 + (user_id % 40) * 0.001 AS DOUBLE) AS lat,
         CAST(-99.17 + (user_id // 40) * 0.001 AS DOUBLE) AS lon, k * 200 AS age_s, k
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
)"""
GRID = """
snap_grid AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, date_trunc('day', t) AS g, row_number() OVER (PARTITION BY sid, date_trunc('day', t) ORDER BY t DESC) AS rn FROM snap) WHERE rn = 1
)"""
TRIPS = """
trips AS (
  SELECT lpad(CAST(l_suppkey % 100 AS VARCHAR), 3, '0') AS origin_code, lpad(CAST(l_partkey % 100 AS VARCHAR), 3, '0') AS destination_code,
         l_shipdate + to_minutes(CAST(15 * (l_orderkey % 96) AS BIGINT)) AS departed_at,
         l_shipdate + to_minutes(CAST(15 * (l_orderkey % 96) + l_quantity AS BIGINT)) AS arrived_at, l_quantity AS duration_min
  FROM lineitem
)"""
WEATHER = """
weather AS (SELECT date_trunc('hour', ts) AS hour, avg(value) AS temp, count(*) AS precip FROM events GROUP BY 1)"""
STATIONS = """
stations AS (SELECT *, row_number() OVER (ORDER BY sid) - 1 AS station FROM (SELECT sid, avg(lat) AS lat, avg(lon) AS lon FROM snap GROUP BY sid))"""
NEIGHBOURS = """
nb AS (
  SELECT * FROM (
    SELECT x.sid AS a, y.sid AS b, 2 * 6371000.0 * asin(sqrt(pow(sin(radians(y.lat - x.lat) / 2), 2)
           + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2))) AS metres
    FROM stations x JOIN stations y ON x.sid <> y.sid) WHERE metres <= 300
)"""
NBF = """
nbf AS (
  SELECT a AS sid, g, count(*) AS nb_n, avg(CAST(ok AND is_full AS INT)) AS nb_full_frac,
         avg(1 - docks / nullif(capacity, 0)::DOUBLE) AS nb_occupancy_mean, CAST(sum(docks) AS BIGINT) AS nb_docks_sum
  FROM nb JOIN snap_grid ON b = sid GROUP BY a, g
)"""
PROFILE = """
profile AS (
  SELECT sid, avg(CAST(is_full AS INT)) AS st_full_rate,
         avg(CAST(is_full AS INT)) FILTER (WHERE isodow(t) < 6 AND hour(t) * 60 + minute(t) BETWEEN 510 AND 630) AS st_peak_full_rate
  FROM snap WHERE ok {where} GROUP BY sid
)"""
FLOW = """
moves AS (
  SELECT destination_code AS station_id, CAST(arrived_at AS DATE) AS day, (hour(arrived_at) * 60 + minute(arrived_at)) // 15 AS slot, 1 AS arr, 0 AS dep
  FROM trips WHERE duration_min BETWEEN 5 AND 45
  UNION ALL
  SELECT origin_code, CAST(departed_at AS DATE), (hour(departed_at) * 60 + minute(departed_at)) // 15, 0, 1 FROM trips WHERE duration_min BETWEEN 5 AND 45
), days AS (
  SELECT isodow(day) >= 6 AS weekend, count(DISTINCT day) AS n_days FROM moves GROUP BY 1
), flow AS (
  SELECT station_id, slot, weekend, sum(arr) / any_value(n_days) AS arrivals_mean, sum(dep) / any_value(n_days) AS departures_mean,
         (sum(arr) - sum(dep)) / any_value(n_days) AS net_flow_mean
  FROM (SELECT *, isodow(day) >= 6 AS weekend FROM moves) JOIN days USING (weekend) GROUP BY station_id, slot, weekend
)"""
FLOW_CUM = """
flow_cum AS (
  SELECT station_id, weekend, slot,
         coalesce(sum(net) OVER (PARTITION BY station_id, weekend ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum_before,
         sum(net) OVER (PARTITION BY station_id, weekend) AS day_total
  FROM (SELECT k.station_id, k.weekend, s.slot, coalesce(f.net_flow_mean, 0) AS net
        FROM (SELECT DISTINCT station_id, weekend FROM flow) k CROSS JOIN (SELECT range AS slot FROM range(96)) s
        LEFT JOIN flow f ON f.station_id = k.station_id AND f.weekend = k.weekend AND f.slot = s.slot)
)"""
EXAMPLES = """
ex AS (
  SELECT now.sid, now.t, now.d, (hour(now.t) * 60 + minute(now.t)) // 15 AS slot,
         (hour(now.t + INTERVAL {h} MINUTE) * 60 + minute(now.t + INTERVAL {h} MINUTE)) // 15 AS target_slot,
         isodow(now.t + INTERVAL {h} MINUTE) >= 6 AS weekend, now.is_full AS full_now, now.docks AS docks_now, now.capacity, fut.is_full AS y
  FROM (SELECT * FROM snap WHERE ok) now ASOF JOIN snap fut ON now.sid = fut.sid AND now.t + INTERVAL {low} MINUTE <= fut.t
  WHERE fut.t <= now.t + INTERVAL {high} MINUTE AND fut.ok
)"""
PRED = """
tr AS (SELECT * FROM ex WHERE d BETWEEN {first} AND {last}),
pred AS (
  SELECT e.*, CAST(e.full_now AS DOUBLE) AS p_persist,
         coalesce(CASE WHEN sn.n >= 20 THEN sn.p END, gn.p) AS p_persist_cal,
         coalesce(CASE WHEN c.n >= 10 THEN c.p END, s.p, (SELECT avg(CAST(y AS INT)) FROM tr)) AS p_hist
  FROM ex e
  LEFT JOIN (SELECT sid, full_now, avg(CAST(y AS INT)) AS p, count(*) AS n FROM tr GROUP BY ALL) sn ON sn.sid = e.sid AND sn.full_now = e.full_now
  LEFT JOIN (SELECT full_now, avg(CAST(y AS INT)) AS p FROM tr GROUP BY ALL) gn ON gn.full_now = e.full_now
  LEFT JOIN (SELECT sid, avg(CAST(y AS INT)) AS p FROM tr GROUP BY ALL) s ON s.sid = e.sid
  LEFT JOIN (SELECT sid, target_slot, weekend, avg(CAST(y AS INT)) AS p, count(*) AS n FROM tr GROUP BY ALL) c
         ON c.sid = e.sid AND c.target_slot = e.target_slot AND c.weekend = e.weekend
)"""


def examples(h: int = 720, tolerance: int = 360) -> str:
    return EXAMPLES.format(h=h, low=h - tolerance, high=h + tolerance)


def predictions(first: int = 1, last: int = 18) -> str:
    return PRED.format(first=first, last=last)


def with_views(*views: str) -> str:
    return "WITH " + ",".join(views)
