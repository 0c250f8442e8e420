"""Names, addresses, places and settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from strider.functions import text
from strider.operators import places, search
from strider.plans.spatial_graph import _E, _G, _P, _boxes, _grid, _points
from strider.sources.tables import table

STREETS = ("Main St", "Oak Avenue", "N. 5th St", "Saint Ann's Road")


def _street(key):
    return F.get(F.array(*[F.lit(x) for x in STREETS]), (key % 4).cast("int"))


def nearest_numbers(spark, d):
    """Customers ask for a house; suppliers are the houses."""
    houses = table(spark, d, "supplier").select(F.col("s_suppkey").alias("address"), (F.col("s_suppkey") % 4).alias("street"), (F.col("s_suppkey") * 17 % 400 * 10_000 + F.col("s_suppkey") % 3).alias("key"))
    asked = F.concat((F.col("c_custkey") * 7 % 420).cast("string"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("-"), (F.col("c_custkey") % 3).cast("string"))).otherwise(""), F.lit(" "), _street(F.col("c_custkey")))
    q = table(spark, d, "customer").select(F.col("c_custkey").alias("q"), places.address_query(asked).alias("a"), (F.col("c_custkey") % 4).alias("street"))
    q = q.select("q", "street", places.number_key(text.house_number(F.col("a.number"))).cast("bigint").alias("key"))
    return places.nearest_numbers(q, houses)


def trailing_places(spark, d):
    q = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    q = q.select(F.col("c_custkey").alias("q"), F.concat(_street(F.col("c_custkey")), F.when(F.col("c_custkey") % 3 == 0, ", ").when(F.col("c_custkey") % 3 == 1, " ").otherwise(""), F.col("n_name")).alias("text"))
    return places.trailing_place(q, table(spark, d, "nation").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("name")))


def query_caps(spark, d):
    """The words of each conversation's turn that a search would use."""
    t = table(spark, d, "conversations").select("conv_id", "turn", text.tokens(F.lower("text")).alias("t"))
    return t.select("conv_id", "turn", F.concat_ws(" ", search.capped(F.col("t"))).alias("words"))


def ordinal_values(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 1000).cast("int").alias("n"))
    ends = F.get(F.array(*[F.lit(x) for x in ("th", "st", "nd", "rd")]), (F.col("c_custkey") % 4).cast("int"))
    return c.select("c_custkey", text.ordinal_value(F.concat(F.col("n").cast("string"), ends)).alias("written"), text.ordinal_value(F.concat_ws(" ", text.ordinal_words(F.col("n")))).alias("spelled"))


def owned_names(spark, d):
    docs = _grid(spark, d).withColumn("radius", F.col("w") * 60).withColumn("head", F.col("rid") % 17 * 1.5)
    return places.owned_names(_points(spark, d, "id"), docs, 60.0)


def area_or_nearest(spark, d):
    near = _grid(spark, d).withColumn("area", -(F.col("rid") % 9) - 1)
    return places.area_or_nearest(_points(spark, d, "id"), _boxes(spark, d), near, 50.0, 30.0)


def named_or_nearest(spark, d):
    left = _points(spark, d).withColumn("name", F.col("lid") % 3)
    return places.named_or_nearest(left, _grid(spark, d).withColumn("name", F.col("rid") % 5), 45.0)


def merged_settings(spark, d):
    side = lambda t, key, at: table(spark, d, t).select(F.col(key).alias("path"), F.concat(F.lit(t), F.col(key).cast("string")).alias("value"), at.alias("at"))
    return places.merged_settings(side("customer", "c_custkey", F.col("c_custkey") * 31 % 50), side("part", "p_partkey", F.col("p_partkey") * 17 % 50))


def best_hits(spark, d):
    e = table(spark, d, "events")
    run = lambda kind: e.where(F.col("event_type") == kind).select((F.col("user_id") % 50).alias("q"), (F.col("event_id") % 20).alias("doc"), F.col("value").alias("score"))
    return places.best_hits([run("click"), run("view"), run("purchase")])


def hilbert_order(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", places.hilbert(F.col("p_partkey") * 37 % 16, F.col("p_partkey") * 91 % 16, 4).alias("place"))


def parcel_keys(spark, d):
    key = F.col("p_partkey")
    raw = F.concat((key % 1200).cast("string"), F.lit("-"), (key * 7 % 9000).cast("string"), F.when(key % 5 == 0, "").otherwise(F.concat(F.lit(" "), (key % 500).cast("string"))), F.when(key % 3 == 0, "/7").otherwise(""))
    return table(spark, d, "part").select("p_partkey", places.parcel_key(raw).alias("parcel"), places.shown_duration(key % 900).alias("shown"))


def road_classes(spark, d):
    key = F.col("p_partkey")
    kind = F.get(F.array(*[F.lit(x) for x in ("motorway", "motorway_link", "trunk", "trunk_link")]), (key % 4).cast("int"))
    side = places.side_state(F.when(key % 3 == 0, "no").when(key % 3 == 1, ""), F.when(key % 2 == 0, "both"))
    job = F.when(key % 4 == 0, F.concat(F.lit("M"), F.lpad(key.cast("string"), 8, "0"))).otherwise(key.cast("string"))
    return table(spark, d, "part").select("p_partkey", places.nuisance_class(kind, key % 5 == 0).alias("class"), side.alias("side"), job.rlike(r"^(?:[A-Z]\d{8}|\d{9})$").alias("is_job"))


def street_places(spark, d):
    c = table(spark, d, "customer").select(_street(F.col("c_custkey")).alias("street"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    return places.street_docs(c).select("street", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "n")


def unordered_lanes(spark, d):
    """Parts as boats between two nations, suppliers as lanes the other way or the same."""
    pair = lambda a, b: F.array_sort(F.array(a, b))
    boats = table(spark, d, "part").select("p_partkey", pair(F.col("p_partkey") % 5, F.col("p_partkey") % 7).alias("ends"))
    lanes = table(spark, d, "supplier").select(pair(F.col("s_suppkey") % 7, F.col("s_suppkey") % 5).alias("ends"), "s_suppkey").groupBy("ends").agg(F.min("s_suppkey").alias("lane"))
    return boats.join(lanes, "ends", "left").select("p_partkey", "lane")


def classified_lots(spark, d):
    """Customers as lots: now and then without a place, in classes 0 to 11."""
    c = table(spark, d, "customer")
    lat = F.when(F.col("c_custkey") % 10 == 0, "").when(F.col("c_custkey") % 10 == 1, "0.0").when(F.col("c_custkey") % 10 == 2, "n/a").otherwise(F.concat((F.col("c_custkey") % 90 + 1).cast("string"), F.lit(".25")))
    rows = c.select(F.col("c_custkey").alias("id"), F.lpad((F.col("c_nationkey") % 12).cast("string"), 2, "0").alias("landuse"), lat.alias("latitude"), F.concat(F.lit("-"), (F.col("c_nationkey") + 70).cast("string")).alias("longitude"))
    return places.classified_lots(rows)


def way_flags(spark, d):
    """Orders as ways, tagged by their columns."""
    key = F.col("o_orderkey")
    pick = lambda n, *of: F.get(F.array(*[F.lit(x) for x in of]), (F.floor(key / n) % len(of)).cast("int"))
    tags = F.map_from_arrays(F.array(*[F.lit(k) for k in ("tunnel", "covered", "golf", "highway", "service", "access", "foot", "area")]), F.array(F.when(F.col("o_orderstatus") == "F", "building_passage").when(F.col("o_orderstatus") == "O", "no"), pick(1, "yes", "arcade", "no"), pick(3, "path", "hole", "cartpath", None), pick(2, "service", "path"), pick(4, "alley", "drive", None), pick(5, "permissive", "private", "no", None), pick(7, None, "yes", "no"), pick(11, "no", "yes", None)))
    return table(spark, d, "orders").select("o_orderkey", *places.way_flags(F.map_filter(tags, lambda _, v: v.isNotNull())))


QUERIES = {
    "way_flags": way_flags,
    "classified_lots": classified_lots,
    "nearest_numbers": nearest_numbers, "trailing_places": trailing_places, "query_caps": query_caps, "ordinal_values": ordinal_values, "owned_names": owned_names, "area_or_nearest": area_or_nearest,
    "named_or_nearest": named_or_nearest, "merged_settings": merged_settings, "best_hits": best_hits, "hilbert_order": hilbert_order, "parcel_keys": parcel_keys, "road_classes": road_classes,
    "street_places": street_places, "unordered_lanes": unordered_lanes,
}

_D = "d AS (SELECT e.id AS id, g.id AS rid, w, sqrt((e.x - g.x) * (e.x - g.x) + (e.y - g.y) * (e.y - g.y)) AS dist FROM e, g)"
ORACLES = {
    "way_flags": """SELECT o_orderkey, o_orderstatus = 'F' OR o_orderkey % 3 = 0 AS tunneled, o_orderkey // 3 % 4 IN (0, 2) AS golf,
    o_orderkey // 2 % 2 = 0 AND o_orderkey // 4 % 3 <> 0 AND o_orderkey // 5 % 4 IN (0, 3) AND o_orderkey // 7 % 3 <> 2 AND o_orderkey // 11 % 3 <> 1 AS cemetery_lane FROM orders""",
    "classified_lots": "SELECT c_custkey AS id, c_custkey % 90 + 1.25e0 AS lat, (-70 - c_nationkey)::DOUBLE AS lng, (c_nationkey % 12)::INTEGER AS klass FROM customer WHERE c_custkey % 10 > 2 AND c_nationkey % 12 BETWEEN 1 AND 5",
    "nearest_numbers": """WITH a AS (SELECT s_suppkey AS address, s_suppkey % 4 AS street, s_suppkey * 17 % 400 * 10000 + s_suppkey % 3 AS key FROM supplier),
q AS (SELECT c_custkey AS q, c_custkey % 4 AS street, c_custkey * 7 % 420 * 10000 + CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 3 ELSE 0 END AS key FROM customer),
n AS (SELECT q.*, (SELECT arg_max(address, (key, address)) FROM a WHERE a.street = q.street AND a.key <= q.key) AS b, (SELECT max(key) FROM a WHERE a.street = q.street AND a.key <= q.key) AS bk,
    (SELECT arg_min(address, (key, address)) FROM a WHERE a.street = q.street AND a.key >= q.key) AS u, (SELECT min(key) FROM a WHERE a.street = q.street AND a.key >= q.key) AS uk FROM q)
SELECT q, CASE WHEN uk = key THEN u WHEN key - bk <= uk - key THEN b ELSE u END AS address, uk = key AS exact FROM n WHERE b IS NOT NULL AND u IS NOT NULL""",
    "trailing_places": """WITH q AS (SELECT c_custkey AS q, ['Main St', 'Oak Avenue', 'N. 5th St', 'Saint Ann''s Road'][c_custkey % 4 + 1] AS s, ['', ', ', ' '][CASE WHEN c_custkey % 3 = 2 THEN 1 ELSE c_custkey % 3 + 2 END] AS sep, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
t AS (SELECT q, s || sep || n_name AS t FROM q), m AS (SELECT q, n_nationkey AS place, n_name, rtrim(left(t, length(t) - length(n_name)), ', ') AS rest FROM t, nation
    WHERE length(t) > length(n_name) AND lower(right(t, length(n_name))) = lower(n_name) AND substr(t, length(t) - length(n_name), 1) IN (' ', ','))
SELECT q, arg_min(place, (-length(n_name), place)) AS place, arg_min(rest, (-length(n_name), place)) AS rest FROM m WHERE length(rest) >= 2 GROUP BY q""",
    "query_caps": r"""WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^\pL\pN]+'), lambda x: x <> '') AS t FROM conversations),
u AS (SELECT conv_id, turn, len(t) AS n, unnest(t) AS w, unnest(range(0, len(t))) AS i FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, i = n - 1 ORDER BY -length(w), i) AS k FROM u)
SELECT t.conv_id, t.turn, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (WHERE k <= 7), '') AS words FROM t LEFT JOIN r ON r.conv_id = t.conv_id AND r.turn = t.turn GROUP BY t.conv_id, t.turn""",
    "ordinal_values": """WITH c AS (SELECT c_custkey, CAST(c_custkey % 1000 AS INTEGER) AS n, c_custkey % 4 AS e FROM customer)
SELECT c_custkey, CASE WHEN n > 0 AND e = CASE WHEN n % 100 BETWEEN 11 AND 13 OR n % 10 > 3 THEN 0 ELSE n % 10 END THEN n END AS written, CASE WHEN n > 0 THEN n END AS spelled FROM c""",
    "owned_names": f"WITH {_E}, {_G}, {_D} SELECT id, arg_min(rid, (dist - rid % 17 * 1.5::DOUBLE, rid)) AS doc FROM d WHERE dist <= 60 AND dist <= w * 60 GROUP BY id",
    "area_or_nearest": f"""WITH {_E}, {_G}, {_P}, {_D}, i AS (SELECT id, min(poly) AS poly FROM (SELECT id, poly FROM e, pe WHERE (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) GROUP BY id, poly HAVING count(*) % 2 = 1) GROUP BY id),
n AS (SELECT id, -(arg_min(rid, (dist, rid)) % 9) - 1 AS area FROM d WHERE dist <= 30 GROUP BY id) SELECT e.id, coalesce(poly, area) AS area FROM e LEFT JOIN i USING (id) LEFT JOIN n USING (id)""",
    "named_or_nearest": f"WITH {_E}, {_G}, {_D} SELECT id AS lid, arg_min(rid, (id % 3 <> rid % 5, dist, rid)) AS rid, bool_or(id % 3 = rid % 5) AS named FROM d WHERE dist <= 45 GROUP BY id",
    "merged_settings": """SELECT coalesce(c_custkey, p_partkey) AS path, CASE WHEN c_custkey IS NULL OR p_partkey * 17 % 50 > c_custkey * 31 % 50 THEN 'part' || p_partkey ELSE 'customer' || c_custkey END AS value FROM customer FULL JOIN part ON c_custkey = p_partkey""",
    "best_hits": "SELECT user_id % 50 AS q, event_id % 20 AS doc, max(value) AS score FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY ALL",
    "hilbert_order": """WITH RECURSIVE h AS (SELECT p_partkey, p_partkey * 37 % 16 AS x, p_partkey * 91 % 16 AS y, 8 AS s, CAST(0 AS BIGINT) AS d FROM part UNION ALL
    SELECT p_partkey, CASE WHEN u THEN x WHEN r THEN s - 1 - y ELSE y END, CASE WHEN u THEN y WHEN r THEN s - 1 - x ELSE x END, s // 2, d + s * s * CASE WHEN r AND u THEN 2 WHEN r THEN 3 WHEN u THEN 1 ELSE 0 END
    FROM (SELECT *, (x & s) > 0 AS r, (y & s) > 0 AS u FROM h WHERE s > 0)) SELECT p_partkey, d AS place FROM h WHERE s = 0""",
    "parcel_keys": """WITH p AS (SELECT p_partkey, p_partkey % 1200 AS a, p_partkey * 7 % 9000 AS b, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 500 END AS c, CASE WHEN p_partkey % 3 = 0 THEN 7 END AS e FROM part)
SELECT p_partkey, CASE WHEN a < 1000 AND coalesce(c, e) IS NOT NULL THEN printf('%03d %04d%03d%02d', a, b, coalesce(c, e), CASE WHEN c IS NULL THEN 0 ELSE coalesce(e, 0) END) END AS parcel, CAST(greatest(1, floor(p_partkey % 900 / 60 + 0.5)) AS INTEGER) || ' min' AS shown FROM p""",
    "road_classes": """SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN CASE WHEN p_partkey % 4 < 2 THEN 'motorway' ELSE 'trunk' END END AS class,
    CASE WHEN p_partkey % 3 = 0 THEN 'no' WHEN p_partkey % 2 = 0 THEN 'both' END AS side, p_partkey % 4 = 0 AS is_job FROM part""",
    "street_places": """SELECT ['MAIN ST', 'OAK AVE', 'N 5 ST', 'ST ANNS RD'][c_custkey % 4 + 1] AS street, round(avg(c_acctbal), 4) AS x, round(avg(CAST(c_nationkey AS DOUBLE)), 4) AS y, count(*) AS n FROM customer GROUP BY 1""",
    "unordered_lanes": """WITH l AS (SELECT least(s_suppkey % 7, s_suppkey % 5) AS a, greatest(s_suppkey % 7, s_suppkey % 5) AS b, min(s_suppkey) AS lane FROM supplier GROUP BY ALL)
SELECT p_partkey, lane FROM part LEFT JOIN l ON a = least(p_partkey % 5, p_partkey % 7) AND b = greatest(p_partkey % 5, p_partkey % 7)""",
}
