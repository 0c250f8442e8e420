"""Projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from strider.functions import geo, text
from strider.sources.tables import table


def predicates(spark, d):
    o = table(spark, d, "orders")
    return o.where((F.col("o_orderstatus") != "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_totalprice") > 150_000)).select("o_orderkey", "o_custkey", "o_totalprice")


def quality_filter(spark, d):
    c = table(spark, d, "customer")
    segment = F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))
    return c.where((F.col("c_acctbal") >= 500) & ~segment.eqNullSafe("BUILDING")).select("c_custkey", segment.alias("segment"))


def name_exclusion(spark, d):
    return table(spark, d, "part").where(~F.col("p_name").rlike(r"(?i)\b(red|blue)\b")).select("p_partkey", "p_name")


def bit_fields(spark, d):
    flags = F.col("l_linenumber") + F.when(F.col("l_returnflag") == "R", 8).otherwise(0) + F.when(F.col("l_linestatus") == "O", 16).otherwise(0)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", flags.cast("int").alias("f"))
    return rows.where(F.col("f").bitwiseAND(16) != 0).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("f").bitwiseAND(7).alias("kind"), F.shiftright("f", 3).bitwiseAND(1).alias("side"), (F.col("l_orderkey") * 2048 + F.shiftright("f", 3).bitwiseAND(3) * 256 + F.col("l_linenumber")).alias("durable_key")
    )


def height_merge(spark, d):
    """The measured value wins, unless it is under half of the published one."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("published"))
    m = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_quantity").alias("measured"))
    height = F.when(F.col("measured").isNull() | (F.col("measured") < F.col("published") * 0.5), F.col("published").cast("double")).otherwise(F.col("measured"))
    return p.join(m, "p_partkey", "left").select("p_partkey", height.alias("height"))


def median_fill(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 9 != 0, F.col("p_size") * 2).otherwise(0).alias("dbh"))
    middle = p.where("dbh > 0").agg(F.percentile("dbh", F.lit(0.5)).alias("middle"))
    return p.join(F.broadcast(middle), F.lit(True), "cross").select("p_partkey", F.when(F.col("dbh") <= 0, F.col("middle")).when(F.col("dbh") > 60, 60.0).otherwise(F.col("dbh").cast("double")).alias("dbh"))


def json_fields(spark, d):
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").select("event_id", k.alias("k"), F.get_json_object("props", "$.k").alias("raw")).where("k >= 50")


def rounding(spark, d):
    x = F.col("l_quantity") / 4 - 5
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", geo.half_up(x).alias("half_up"), geo.fraction_byte(F.col("l_quantity") / 50).alias("byte"))


def distances(spark, d):
    p = table(spark, d, "part").select("p_partkey", (40.5 + F.col("p_size") / 100).alias("lat1"), (-74 + F.col("p_size") / 90).alias("lng1"), (40.6 + F.col("p_partkey") % 50 / 100).alias("lat2"), (-74.1 + F.col("p_partkey") % 70 / 100).alias("lng2"))
    c = [F.col(x) for x in ("lat1", "lng1", "lat2", "lng2")]
    return p.select("p_partkey", F.round(geo.haversine(*c), 3).alias("great_circle"), F.round(geo.local_meters(*c), 3).alias("local"), F.round(geo.bearing(c[1], c[0], c[3], c[2]), 5).alias("bearing"), geo.tile(geo.pixel_x(c[1], 12)).alias("x"), geo.tile(geo.pixel_y(c[0], 12)).alias("y"))


def walk_speeds(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_tax") * 255 / 255 * 0.35).alias("up"), (F.col("l_discount") * 0.35).alias("down"), "l_quantity")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_quantity") * 10 / (1.3 * geo.climb_speed(F.col("up"), F.col("down"))), 5).alias("seconds"))


def sun_and_leaves(spark, d):
    day = F.dayofyear(F.col("o_orderdate").cast("date"))
    dec = -23.44 * F.cos(2 * 3.141592653589793 * (day + 10) / 365)
    o = table(spark, d, "orders").select("o_orderkey", day.alias("day"), dec.alias("dec"), (F.col("o_orderkey") % 19 * 18 - 162).alias("hour"))
    leaf = geo.smoothstep((F.col("day") - 90) / 45) - geo.smoothstep((F.col("day") - 278) / 61)
    return o.select("o_orderkey", F.round(geo.solar_elevation(F.lit(40.7), F.col("dec"), F.col("hour").cast("double")), 5).alias("elevation"), geo.season_band(F.col("dec")).alias("band"), F.round(0.4 + (0.814 - 0.4) * leaf, 6).alias("tau"))


def crowns(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(geo.crown_diameter(F.col("p_size").cast("double"), 0.5, 1.1, 0.02), 5).alias("crown"))


def rings(spark, d):
    point = F.struct(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", point.alias("p")))), lambda r: r["p"]).alias("ring"))
    return rows.where(F.size("ring") >= 3).select("l_orderkey", F.round(geo.ring_area(F.col("ring")), 8).alias("area"))


def name_tokens(spark, d):
    rows = table(spark, d, "part").select("p_partkey", text.token_key(F.lower("p_name")).alias("key"), F.size(text.tokens(F.col("p_name"))).alias("n"))
    return rows


def folded_tokens(spark, d):
    rows = table(spark, d, "documents").select("doc_id", text.tokens(text.normalized(F.col("text"))).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n"), F.size(F.array_distinct("t")).alias("distinct"), F.get("t", F.lit(0)).alias("first"))


def street_names(spark, d):
    raw = F.concat_ws(" ", F.element_at(F.array(*[F.lit(x) for x in ("E.", "W", "North", "S.")]), (F.col("c_custkey") % 4 + 1).cast("int")), F.concat((F.col("c_custkey") % 99 + 1).cast("string"), F.lit("th")), F.element_at(F.array(*[F.lit(x) for x in ("St", "Ave.", "Blvd", "Broadway")]), (F.col("c_nationkey") % 4 + 1).cast("int")))
    return table(spark, d, "customer").select("c_custkey", text.street_name(raw).alias("street"), F.concat_ws(" ", text.ordinal_words(F.col("c_custkey") % 1000)).alias("spelled"))


def addresses(spark, d):
    raw = F.concat((F.col("c_custkey") % 200 + 1).cast("string"), F.when(F.col("c_custkey") % 3 == 0, "-12").when(F.col("c_custkey") % 3 == 1, "b").otherwise(""), F.lit(" Main St"), F.when(F.col("c_nationkey") > 12, ", Apt 4").otherwise(""))
    c = table(spark, d, "customer").select("c_custkey", text.split_address(raw).alias("a"))
    h = text.house_number(F.col("a.number"))
    return c.select("c_custkey", F.col("a.street").alias("street"), h["major"].alias("major"), h["minor"].alias("minor"), h["suffix"].alias("suffix"))


def hashes(spark, d):
    return table(spark, d, "part").select("p_partkey", text.fnv1a(F.col("p_name")).alias("fnv"), F.sha2("p_name", 256).alias("sha"), text.distance_label(F.col("p_retailprice")).alias("label"))


def clocks(spark, d):
    raw = F.format_string("%02d:%02d:%02d", (F.col("o_orderkey") % 30).cast("int"), (F.col("o_orderkey") % 60).cast("int"), (F.col("o_custkey") % 60).cast("int"))
    day = F.col("o_orderdate").cast("date")
    mixed = F.when(F.col("o_orderkey") % 5 == 0, F.date_format(day, "yyyy-MM-dd")).when(F.col("o_orderkey") % 5 == 1, F.date_format(day, "MM/dd/yyyy")).when(F.col("o_orderkey") % 5 == 2, F.date_format(day, "yyyyMMdd")).when(F.col("o_orderkey") % 5 == 3, F.date_format(day, "M/d/yy HH:mm")).otherwise(F.lit("n/a"))
    return table(spark, d, "orders").select("o_orderkey", text.clock_seconds(raw).alias("seconds"), F.weekday(day).alias("weekday"), text.any_date(mixed).alias("day"), F.datediff(day, F.lit("1992-01-01").cast("date")).alias("number"))


def prominence(spark, d):
    """An ordered list of rules; the first that fits decides."""
    n = F.col("p_type")
    return table(spark, d, "part").select("p_partkey", F.when(n.rlike("^PROMO"), 255).when(n.rlike("STEEL|TIN"), 180).when(F.col("p_size") > 25, 140).otherwise(90).alias("prominence"))


def edit_distances(spark, d):
    a = table(spark, d, "nation").select("n_regionkey", F.col("n_name").alias("a"))
    b = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("b"))
    return a.join(F.broadcast(b), "n_regionkey").select("a", "b", F.levenshtein("a", "b").alias("edits"))


QUERIES = {
    "predicates": predicates, "quality_filter": quality_filter, "name_exclusion": name_exclusion, "bit_fields": bit_fields, "height_merge": height_merge, "median_fill": median_fill, "json_fields": json_fields,
    "rounding": rounding, "distances": distances, "walk_speeds": walk_speeds, "sun_and_leaves": sun_and_leaves, "crowns": crowns, "ring_areas": rings, "name_tokens": name_tokens, "folded_tokens": folded_tokens,
    "street_names": street_names, "addresses": addresses, "hashes": hashes, "clocks": clocks, "prominence": prominence, "edit_distances": edit_distances,
}

ORACLES = {
    "predicates": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 150000",
    "quality_filter": "SELECT c_custkey, segment FROM (SELECT *, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS segment FROM customer) WHERE c_acctbal >= 500 AND segment IS DISTINCT FROM 'BUILDING'",
    "name_exclusion": r"SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(p_name, '(?i)\b(red|blue)\b')",
    "bit_fields": """
WITH f AS (SELECT *, CAST(l_linenumber + CASE WHEN l_returnflag = 'R' THEN 8 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 16 ELSE 0 END AS INTEGER) AS f FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, f & 7 AS kind, (f >> 3) & 1 AS side, l_orderkey * 2048 + ((f >> 3) & 3) * 256 + l_linenumber AS durable_key FROM f WHERE (f & 16) <> 0""",
    "height_merge": """
WITH m AS (SELECT l_partkey, max(l_quantity) AS measured FROM lineitem GROUP BY 1)
SELECT p_partkey, CASE WHEN measured IS NULL OR measured < p_size * 0.5 THEN CAST(p_size AS DOUBLE) ELSE measured END AS height FROM part LEFT JOIN m ON l_partkey = p_partkey""",
    "median_fill": """
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN p_size * 2 ELSE 0 END AS dbh FROM part), m AS (SELECT median(dbh) AS middle FROM p WHERE dbh > 0)
SELECT p_partkey, CASE WHEN dbh <= 0 THEN middle WHEN dbh > 60 THEN 60.0 ELSE CAST(dbh AS DOUBLE) END AS dbh FROM p, m""",
    "json_fields": "SELECT event_id, CAST(props->>'k' AS INTEGER) AS k, props->>'k' AS raw FROM events WHERE CAST(props->>'k' AS INTEGER) >= 50",
    "rounding": """SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(l_quantity / 4 - 5 + 0.5) AS BIGINT) AS half_up,
    CAST(least(254, greatest(0, floor(l_quantity / 50 * 254 + 0.5))) AS INTEGER) AS byte FROM lineitem""",
    "distances": """
WITH p AS (SELECT p_partkey, 40.5 + CAST(p_size AS DOUBLE) / 100 AS a, -74 + CAST(p_size AS DOUBLE) / 90 AS b, 40.6 + CAST(p_partkey % 50 AS DOUBLE) / 100 AS c, -74.1 + CAST(p_partkey % 70 AS DOUBLE) / 100 AS e FROM part)
SELECT p_partkey, round(2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(c - a) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(e - b) / 2), 2)))), 3) AS great_circle,
    round(sqrt(pow((e - b) * 111320.0 * cos(radians(a)), 2) + pow((c - a) * 111320.0, 2)), 3) AS local, round(fmod(degrees(atan2(e - b, c - a)) + 360, 360), 5) AS bearing,
    CAST(floor((b + 180) / 360 * 4096) AS INTEGER) AS x, CAST(floor((0.5 - ln((1 + sin(radians(a))) / (1 - sin(radians(a)))) / (4 * pi())) * 4096) AS INTEGER) AS y FROM p""",
    "walk_speeds": """
WITH g AS (SELECT *, l_tax * 0.35 AS u, l_discount * 0.35 AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * 10 / (1.3 * CASE WHEN u + v = 0 THEN 1 ELSE (u + v) / (u / exp(-3.5 * (abs(u + v + 0.05) - 0.05)) + v / exp(-3.5 * (abs(-(u + v) + 0.05) - 0.05))) END), 5) AS seconds FROM g""",
    "sun_and_leaves": """
WITH o AS (SELECT o_orderkey, dayofyear(o_orderdate) AS day, -23.44 * cos(2 * pi() * (dayofyear(o_orderdate) + 10) / 365) AS de, CAST(o_orderkey % 19 * 18 - 162 AS DOUBLE) AS h FROM orders),
s AS (SELECT *, greatest(0, least(1, CAST(day - 90 AS DOUBLE) / 45)) AS a, greatest(0, least(1, CAST(day - 278 AS DOUBLE) / 61)) AS b FROM o)
SELECT o_orderkey, round(degrees(asin(sin(radians(40.7)) * sin(radians(de)) + cos(radians(40.7)) * cos(radians(de)) * cos(radians(h)))), 5) AS elevation,
    CAST(greatest(0, least(5, floor((de + 23.44) / (2 * 23.44) * 6))) AS INTEGER) AS band, round(0.4 + 0.414 * (a * a * (3 - 2 * a) - b * b * (3 - 2 * b)), 6) AS tau FROM s""",
    "crowns": "SELECT p_partkey, round(exp(0.5 + 1.1 * ln(ln(p_size * 2.54 + 1)) + 0.02), 5) AS crown FROM part",
    "ring_areas": """
WITH r AS (SELECT l_orderkey, l_quantity AS x, l_extendedprice / 1000 AS y, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem
    WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice))
SELECT a.l_orderkey, round(sum(a.x * b.y - b.x * a.y) / 2, 8) AS area FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND b.i = a.i % a.n + 1 WHERE a.n >= 3 GROUP BY a.l_orderkey""",
    "name_tokens": """
WITH t AS (SELECT p_partkey, list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(t)), ' ') AS key, CAST(len(t) AS INTEGER) AS n FROM t""",
    "folded_tokens": r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(regexp_replace(strip_accents(text), '[''‘’ʼ`]', '', 'g')), '[^\pL\pN]+'), lambda x: x <> '') AS t FROM documents)
SELECT doc_id, CAST(len(t) AS INTEGER) AS n, CAST(len(list_distinct(t)) AS INTEGER) AS "distinct", t[1] AS first FROM t""",
    "street_names": """
WITH c AS (SELECT c_custkey, CAST(c_custkey % 1000 AS INTEGER) AS n, ['E', 'W', 'N', 'S'][c_custkey % 4 + 1] || ' ' || (c_custkey % 99 + 1) || ' ' || ['ST', 'AVE', 'BLVD', 'BROADWAY'][c_nationkey % 4 + 1] AS street FROM customer),
w AS (SELECT *, n // 100 AS h, n % 100 AS r, ['one','two','three','four','five','six','seven','eight','nine'] AS ones,
    ['first','second','third','fourth','fifth','sixth','seventh','eighth','ninth','tenth','eleventh','twelfth','thirteenth','fourteenth','fifteenth','sixteenth','seventeenth','eighteenth','nineteenth'] AS small,
    ['ten','twenty','thirty','forty','fifty','sixty','seventy','eighty','ninety'] AS tens FROM c)
SELECT c_custkey, street, CASE WHEN n = 0 THEN '' ELSE array_to_string(list_filter([CASE WHEN h > 0 THEN ones[h] END, CASE WHEN h > 0 THEN CASE WHEN r = 0 THEN 'hundredth' ELSE 'hundred' END END,
    CASE WHEN r >= 20 THEN CASE WHEN r % 10 = 0 THEN regexp_replace(tens[r // 10], 'y$', 'ie') || 'th' ELSE tens[r // 10] END END, CASE WHEN r > 0 AND r < 20 THEN small[r] WHEN r >= 20 AND r % 10 > 0 THEN small[r % 10] END], lambda x: x IS NOT NULL), ' ') END AS spelled FROM w""",
    "addresses": """SELECT c_custkey, 'Main St' AS street, CAST(c_custkey % 200 + 1 AS INTEGER) AS major, CASE WHEN c_custkey % 3 = 0 THEN 12 END AS minor, CASE WHEN c_custkey % 3 = 1 THEN 'B' END AS suffix FROM customer""",
    "hashes": """
WITH RECURSIVE f AS (SELECT p_partkey, p_name, 1 AS i, CAST(2166136261 AS BIGINT) AS h FROM part
    UNION ALL SELECT p_partkey, p_name, i + 1, CAST((xor(h, CAST(ascii(substr(p_name, i, 1)) AS BIGINT)) * 16777619) % 4294967296 AS BIGINT) FROM f WHERE i <= length(p_name))
SELECT f.p_partkey, h AS fnv, sha256(f.p_name) AS sha, CASE WHEN p_retailprice < 1000 THEN CAST(CAST(floor(p_retailprice / 10 + 0.5) * 10 AS INTEGER) AS VARCHAR) || ' m' ELSE printf('%.1f km', p_retailprice / 1000) END AS label
FROM f JOIN part USING (p_partkey) WHERE i = length(f.p_name) + 1""",
    "clocks": """SELECT o_orderkey, CAST(o_orderkey % 30 * 3600 + o_orderkey % 60 * 60 + o_custkey % 60 AS INTEGER) AS seconds, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday,
    CASE WHEN o_orderkey % 5 < 4 THEN CAST(o_orderdate AS DATE) END AS day, CAST(CAST(o_orderdate AS DATE) - DATE '1992-01-01' AS INTEGER) AS number FROM orders""",
    "prominence": "SELECT p_partkey, CASE WHEN p_type LIKE 'PROMO%' THEN 255 WHEN p_type LIKE '%STEEL%' OR p_type LIKE '%TIN%' THEN 180 WHEN p_size > 25 THEN 140 ELSE 90 END AS prominence FROM part",
    "edit_distances": "SELECT n_name AS a, r_name AS b, CAST(levenshtein(n_name, r_name) AS INTEGER) AS edits FROM nation JOIN region ON n_regionkey = r_regionkey",
}
