"""Place and address search, house numbers and the geometry behind them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harborlight.functions import geo as G
from harborlight.functions import text as X
from harborlight.plans import views_sql as V
from harborlight.sources import tables as T


#: Letters of a word or token that the join goes by; longer ones are compared.
PREFIX = 6


def word_hits(names: DataFrame, tokens: DataFrame, key: str, text: str) -> DataFrame:
    """(key, and what tokens has): a row for each word of a name that begins with a token; tokens are joined with the beginnings of words."""
    words = names.select(key, F.explode(X.words_of(F.col(text))).alias("_word"))
    lengths = F.sequence(F.lit(1), F.least(F.length("_word"), F.lit(PREFIX)))
    heads = words.withColumn("_head", F.explode(F.transform(lengths, lambda n: F.substring(F.col("_word"), F.lit(1), n))))
    return heads.join(tokens.withColumn("_head", F.substring("_token", 1, PREFIX)), "_head").where(F.startswith("_word", "_token")).drop("_head", "_word")


def matches(names: DataFrame, queries: DataFrame, text: str = "name", query: str = "query") -> DataFrame:
    """Names with a word for every token of the query; equal texts are compared once, and the names themselves are never broadcast."""
    asked = queries.select(query).distinct().withColumn("_tokens", X.words_of(F.col(query)))
    tokens = asked.select(query, F.size("_tokens").alias("_n"), F.explode("_tokens").alias("_token"))
    met = word_hits(names.select(text).distinct(), tokens, text, text)
    whole = met.groupBy(text, query, "_n").agg(F.countDistinct("_token").alias("_found")).where("_found = _n").select(text, query)
    return names.hint("merge").join(whole, text).join(queries, query)


def kinds_once(places: DataFrame) -> DataFrame:
    """Of the places of one name and kind that with the least id, which goes before the others in any ranking."""
    return places.groupBy("name", "kind_rank").agg(F.min("place_id").alias("place_id"))


def ranked_places(found: DataFrame, limit: int = 5) -> DataFrame:
    """Same start before others, kinds by rank, shorter names; one of each name; the first ones of each query."""
    starts = F.startswith(X.plain(F.col("name")), X.plain(F.col("query")))
    order = [F.desc("starts"), F.asc("kind_rank"), F.length("name"), F.asc("name"), F.asc("place_id")]
    one = Window.partitionBy("query", "name").orderBy(*order)
    rows = found.withColumn("starts", starts).withColumn("_n", F.row_number().over(one)).where("_n = 1")
    place = F.row_number().over(Window.partitionBy("query").orderBy(*order)).cast("long")
    return rows.withColumn("place", place).where(F.col("place") <= limit).drop("_n")


def merged(first: DataFrame, second: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """Two ranked lists as one, the first one's entries before equal ones of the second."""
    both = first.withColumn("source", F.lit(0)).unionByName(second.withColumn("source", F.lit(1)))
    one = Window.partitionBy(*by, key).orderBy("source", "place")
    kept = both.withColumn("_n", F.row_number().over(one)).where("_n = 1")
    return kept.withColumn("merged", F.row_number().over(Window.partitionBy(*by).orderBy("source", "place")).cast("long")).drop("_n")


def spaced(points: Column, metres: float) -> Column:
    """Of an array of struct<lat, lon> those at least so far from the last kept one; the first always."""
    def keep(kept: Column, p: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        far = (F.size(kept) == 0) | (G.flat_m(last["lat"], last["lon"], p["lat"], p["lon"]) >= metres)
        return F.when(far, F.concat(kept, F.array(p))).otherwise(kept)

    return F.aggregate(points, F.slice(points, 1, 0), keep)


def thinned(points: Column, metres: float) -> Column:
    """Those farther than so much from every kept one, in the order of the array."""
    def keep(kept: Column, p: Column) -> Column:
        near = F.exists(kept, lambda q: G.flat_m(q["lat"], q["lon"], p["lat"], p["lon"]) <= metres)
        return F.when(near, kept).otherwise(F.concat(kept, F.array(p)))

    return F.aggregate(points, F.slice(points, 1, 0), keep)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = T.table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("place_id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("name"), (F.col("p_size") % 3).cast("long").alias("kind_rank"))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first letters of the first and last word of the places whose number is divisible by 100."""
    w = F.split(X.plain(F.col("name")), " ")
    text = F.concat_ws(" ", F.substring(F.element_at(w, 1), 1, 3), F.substring(F.element_at(w, -1), 1, 4))
    return places(spark, sf_dir).where("place_id % 100 = 0").select(text.alias("query")).distinct()


def plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "documents").select("doc_id", F.md5(X.plain(F.col("text"))).alias("plain"))


def house_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.table(spark, sf_dir, "orders")
    letter = F.element_at(F.array(F.lit(""), F.lit("b"), F.lit(" c"), F.lit("-1")), (F.col("o_custkey") % 4 + 1).cast("int"))
    raw = F.concat((F.col("o_orderkey") % 900).cast("string"), letter)
    return o.select("o_orderkey", X.house_number(raw).alias("number"))


def month_from_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the month that the name of their file tells, in each of four ways of naming one."""
    when, kind = F.add_months("o_orderdate", 144), F.col("o_orderkey") % 4  # files are of this century
    spanish = F.element_at(F.array(*map(F.lit, X.MONTHS)), F.month(when))
    name = F.when(kind == 0, F.concat(F.date_format(when, "yyyy-MM"), F.lit("-1.csv"))).when(kind == 1, F.concat(F.lit("datos_abiertos_"), F.date_format(when, "yyyy_MM"), F.lit("-1-1.csv")))
    name = name.when(kind == 2, F.concat(F.lit("DatosAbiertos_"), F.year(when), F.lit("_"), F.initcap(spanish), F.lit(".csv"))).otherwise(F.date_format(when, "yyyyMMdd"))
    return T.table(spark, sf_dir, "orders").groupBy(X.month_of_name(name).alias("month")).agg(F.count(F.lit(1)).alias("n"))


def token_prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = places(spark, sf_dir).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("place_id").alias("first_id"))
    return matches(names, _queries(spark, sf_dir)).groupBy("query").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"))


def place_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranked_places(matches(kinds_once(places(spark, sf_dir)), _queries(spark, sf_dir)))
    return rows.select("query", "place", "place_id", "name")


def merge_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(kinds_once(places(spark, sf_dir)), _queries(spark, sf_dir))
    first = ranked_places(found.where("kind_rank = 2"), 3).select("query", "place", "place_id", "name")
    second = ranked_places(found, 5).select("query", "place", "place_id", "name")
    return merged(first, second, ["query"], "name").select("query", "merged", "place_id", F.col("source").cast("long").alias("source"))


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known house numbers of streets with their places."""
    li = T.table(spark, sf_dir, "lineitem")
    rows = li.select((F.col("l_suppkey") % 40).alias("street"), (F.col("l_partkey") % 300).alias("number")).distinct()
    lat = F.lit(19.4) + F.col("number") * 0.00001 + F.col("street") * 0.001
    return rows.withColumn("lat", lat.cast("double")).withColumn("lon", (F.lit(-99.1) - F.col("number") * 0.00002).cast("double"))


def estimate_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number's place between its known neighbours of the same parity, if those are within 500 m."""
    known = numbers(spark, sf_dir)
    asked = T.table(spark, sf_dir, "customer").select((F.col("c_custkey") % 40).alias("street"), (F.col("c_custkey") * 7 % 300).alias("asked")).distinct()
    side = F.struct("number", "lat", "lon")
    both = known.select("street", "number", side.alias("side")).unionByName(asked.select("street", F.col("asked").alias("number"), "asked"), allowMissingColumns=True)
    order = Window.partitionBy("street", F.pmod("number", F.lit(2))).orderBy("number")  # one pass over a street's numbers
    a = F.last("side", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    b = F.first("side", ignorenulls=True).over(order.rangeBetween(0, Window.unboundedFollowing))
    ends = both.withColumns({"a": a, "b": b}).where("asked is not null")
    at = F.when(F.col("b.number") > F.col("a.number"), (F.col("asked") - F.col("a.number")) / F.nullif(F.col("b.number") - F.col("a.number"), F.lit(0))).otherwise(0.0)
    near = G.flat_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) < 500
    lerp = lambda c: F.round(F.col(f"a.{c}") + at * (F.col(f"b.{c}") - F.col(f"a.{c}")), 7).alias(c)
    return ends.where(near).select("street", "asked", lerp("lat"), lerp("lon"))


def number_least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines through the places of a street's numbers, by hundred."""
    fit = lambda c: [F.round(F.regr_slope(c, "number"), 9).alias(f"{c}_slope"), F.round(F.regr_intercept(c, "number"), 6).alias(f"{c}_start")]
    rows = numbers(spark, sf_dir).withColumn("hundred", F.floor(F.col("number") / 100))
    return rows.groupBy("street", "hundred").agg(F.count(F.lit(1)).alias("n"), *fit("lat"), *fit("lon")).where("n > 2")


def address_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact number on streets whose name the query's words start."""
    streets = T.table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_partkey") - 1) % 40).alias("street"), F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    asked = streets.where("p_partkey % 100 = 0").select(F.concat(F.substring("name", 1, 6), F.lit(" 42")).alias("address"))
    parts = asked.select("address", F.regexp_replace("address", " [0-9]+[A-Za-z]?$", "").alias("query"), F.regexp_extract("address", "([0-9]+)[A-Za-z]?$", 1).cast("long").alias("number")).distinct()
    found = matches(streets, parts)
    return found.join(numbers(spark, sf_dir), ["street", "number"]).select("address", "p_partkey", "street", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = F.struct("number", "lat", "lon")
    rows = numbers(spark, sf_dir).groupBy("street").agg(F.sort_array(F.collect_list(point)).alias("p"))
    return rows.select("street", F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("points"))


def polyline_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = G.nearest_on_polyline(F.lit(19.41), F.lit(-99.102), F.col("points"))
    return _lines(spark, sf_dir).where(F.size("points") > 1).select("street", F.round(far, 2).alias("metres"))


def spacing_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("street", F.size(spaced(F.col("points"), 100.0)).alias("kept"), F.size(thinned(F.col("points"), 100.0)).alias("apart"), F.size("points").alias("all"))


QUERIES = [plain_text, house_number, month_from_name, token_prefix_search, place_ranking, merge_ranked, estimate_number, number_least_squares, address_lookup, polyline_nearest, spacing_fold]

FOLD = f"trim(regexp_replace(lower(translate({{c}}, '{X.MARKED}', '{X.PLAIN}')), '[^a-z0-9]+', ' ', 'g'))"
PLACES = "places AS (SELECT p_partkey AS place_id, p_name || ' ' || p_brand || ' ' || p_type AS name, CAST(p_size % 3 AS BIGINT) AS kind_rank FROM part)"
ASKED = f"""words AS (SELECT place_id, string_split({FOLD.format(c="name")}, ' ') AS w FROM places WHERE place_id % 100 = 0),
queries AS (SELECT DISTINCT substr(w[1], 1, 3) || ' ' || substr(w[-1], 1, 4) AS query FROM words)"""
FOUND = f"""found AS (SELECT p.*, q.query, starts_with({FOLD.format(c="p.name")}, q.query) AS starts FROM places p, queries q WHERE len(list_filter(string_split(q.query, ' '), lambda t:
  t <> '' AND len(list_filter(string_split({FOLD.format(c="p.name")}, ' '), lambda w: starts_with(w, t))) = 0)) = 0)"""
ORDER = "starts DESC, kind_rank, length(name), name, place_id"


def _rank_sql(name: str, where: str, limit: int) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY {ORDER}) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query, name ORDER BY {ORDER}) AS k FROM found {where}) WHERE k = 1) WHERE place <= {limit})"""


NUMBERS = """numbers AS (SELECT *, CAST(19.4 + number * 0.00001::DOUBLE + street * 0.001::DOUBLE AS DOUBLE) AS lat, CAST(-99.1 - number * 0.00002::DOUBLE AS DOUBLE) AS lon
  FROM (SELECT DISTINCT l_suppkey % 40 AS street, l_partkey % 300 AS number FROM lineitem))"""
W = V.with_views
SQL = {
    "plain_text": f"SELECT doc_id, md5({FOLD.format(c='text')}) AS plain FROM documents",
    "house_number": """SELECT o_orderkey, upper(regexp_extract(trim(CAST(o_orderkey % 900 AS VARCHAR) || ['', 'b', ' c', '-1'][o_custkey % 4 + 1]), '^([0-9]+ ?[A-Za-z]?)$', 1)) AS number FROM orders""",
    "month_from_name": "SELECT CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate + INTERVAL 12 YEAR, '%Y-%m') END AS month, count(*) AS n FROM orders GROUP BY 1",
    "token_prefix_search": W(PLACES, ASKED, FOUND) + " SELECT query, count(*) AS n, min(place_id) AS first_id FROM found GROUP BY query",
    "place_ranking": W(PLACES, ASKED, FOUND, _rank_sql("r", "", 5)) + " SELECT query, place, place_id, name FROM r",
    "merge_ranked": W(PLACES, ASKED, FOUND, _rank_sql("r0", "WHERE kind_rank = 2", 3), _rank_sql("r1", "", 5)) + """, u AS (SELECT query, name, place_id, place, 0 AS source FROM r0 UNION ALL SELECT query, name, place_id, place, 1 FROM r1)
        SELECT query, row_number() OVER (PARTITION BY query ORDER BY source, place) AS merged, place_id, CAST(source AS BIGINT) AS source FROM (SELECT *, row_number() OVER (PARTITION BY query, name ORDER BY source, place) AS z FROM u) WHERE z = 1""",
    "estimate_number": W(NUMBERS) + """, asked AS (SELECT DISTINCT c_custkey % 40 AS street, c_custkey * 7 % 300 AS asked FROM customer),
        a AS (SELECT street, asked, max(number) AS n FROM asked JOIN numbers USING (street) WHERE number <= asked AND (asked - number) % 2 = 0 GROUP BY 1, 2),
        b AS (SELECT street, asked, min(number) AS n FROM asked JOIN numbers USING (street) WHERE number >= asked AND (number - asked) % 2 = 0 GROUP BY 1, 2),
        e AS (SELECT a.street, a.asked, x.lat AS lat0, x.lon AS lon0, y.lat AS lat1, y.lon AS lon1, CASE WHEN b.n > a.n THEN (a.asked - a.n)::DOUBLE / (b.n - a.n) ELSE 0 END AS f FROM a JOIN b USING (street, asked)
          JOIN numbers x ON x.street = a.street AND x.number = a.n JOIN numbers y ON y.street = a.street AND y.number = b.n)
        SELECT street, asked, round(lat0 + f * (lat1 - lat0), 7) AS lat, round(lon0 + f * (lon1 - lon0), 7) AS lon FROM e
        WHERE 6371000.0 * sqrt(pow(radians(lat1 - lat0), 2) + pow(radians(lon1 - lon0) * cos(radians((lat0 + lat1) / 2)), 2)) < 500""",
    "number_least_squares": W(NUMBERS) + """ SELECT street, number // 100 AS hundred, count(*) AS n, round(regr_slope(lat, number), 9) AS lat_slope, round(regr_intercept(lat, number), 6) AS lat_start,
        round(regr_slope(lon, number), 9) AS lon_slope, round(regr_intercept(lon, number), 6) AS lon_start FROM numbers GROUP BY 1, 2 HAVING count(*) > 2""",
    "polyline_nearest": W(NUMBERS) + """, xy AS (SELECT street, number, radians(lon + 99.102::DOUBLE) * cos(radians(19.41::DOUBLE)) * 6371000.0::DOUBLE AS x, radians(lat - 19.41::DOUBLE) * 6371000.0::DOUBLE AS y FROM numbers),
        s AS (SELECT street, x, y, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM xy WINDOW w AS (PARTITION BY street ORDER BY number)),
        c AS (SELECT *, coalesce(least(greatest(-(x * dx + y * dy) / nullif(dx * dx + dy * dy, 0), 0), 1), 0) AS f FROM s WHERE dx IS NOT NULL)
        SELECT street, round(min(sqrt(pow(x + f * dx, 2) + pow(y + f * dy, 2))), 2) AS metres FROM c GROUP BY 1""",
    "address_lookup": W(NUMBERS) + f""", streets AS (SELECT p_partkey, (p_partkey - 1) % 40 AS street, p_name || ' ' || p_brand AS name FROM part),
        asked AS (SELECT DISTINCT substr(name, 1, 6) AS query, substr(name, 1, 6) || ' 42' AS address, 42 AS number FROM streets WHERE p_partkey % 100 = 0)
        SELECT q.address, s.p_partkey, s.street, round(lat, 6) AS lat, round(lon, 6) AS lon FROM streets s, asked q, numbers n WHERE n.street = s.street AND n.number = q.number AND len(list_filter(string_split({FOLD.format(c="q.query")}, ' '), lambda t:
        t <> '' AND len(list_filter(string_split({FOLD.format(c="s.name")}, ' '), lambda w: starts_with(w, t))) = 0)) = 0""",
}
