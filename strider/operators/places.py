"""Names, addresses and settings: lookups that need a rule besides a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strider.functions import geo
from strider.functions import text as names
from strider.operators import spatial

#: Fixed: what the block of a two-part house number weighs; least letters of what a place leaves.
BLOCK_SPAN, LEAST_TEXT = 10_000, 2


def number_key(number: Column) -> Column:
    """House numbers in order: the block first, then the number in it."""
    return number["major"] * BLOCK_SPAN + F.coalesce(number["minor"], F.lit(0))


def address_query(text: Column) -> Column:
    """'12-34B Main St' as (number, street): one token of a number, then a name; else null parts."""
    pattern = r"^\s*(\d{1,7}(?:-\d{1,4})?[A-Za-z]?)\s+(.+?)\s*$"
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    return F.struct(part(1).alias("number"), part(2).alias("street"))


def nearest_numbers(queries: DataFrame, addresses: DataFrame) -> DataFrame:
    """q, address, exact: of queries (q, street, key) and addresses (address, street, key) the
    house itself or else the nearer neighbour (the lower of equals); none past either end.

    Both sides go through one sort by street and key; two running values look back and ahead."""
    a = addresses.select("street", "key", F.struct("key", "address").alias("house"), F.lit(None).cast("bigint").alias("q"))
    b = queries.select("street", "key", F.lit(None).cast(a.schema["house"].dataType).alias("house"), F.col("q").cast("bigint").alias("q"))
    both = a.unionByName(b).withColumn("asked", F.col("q").isNotNull())
    below = F.last("house", ignorenulls=True).over(Window.partitionBy("street").orderBy("key", "asked", "house.address").rowsBetween(Window.unboundedPreceding, 0))
    above = F.last("house", ignorenulls=True).over(Window.partitionBy("street").orderBy(F.desc("key"), "asked", F.desc("house.address")).rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("below", below).withColumn("above", above).where("asked AND below IS NOT NULL AND above IS NOT NULL")
    exact = F.col("above.key") == F.col("key")
    lower = F.col("key") - F.col("below.key") <= F.col("above.key") - F.col("key")
    return found.select("q", F.when(exact, F.col("above.address")).when(lower, F.col("below.address")).otherwise(F.col("above.address")).alias("address"), exact.alias("exact"))


def trailing_place(queries: DataFrame, places: DataFrame) -> DataFrame:
    """q, place, rest: queries (q, text) that end in a place's name (place, name) on a word's
    boundary, with the text before it; the longest name wins, then the smaller place. Each ending
    of a query is a key, so the join is by equality."""
    low = queries.select("q", F.rtrim("text").alias("text"))
    cuts = low.withColumn("at", F.explode(F.filter(F.sequence(F.lit(2), F.greatest(F.length("text"), F.lit(2))), lambda i: F.substring("text", i - 1, F.lit(1)).rlike(r"[\s,]"))))
    ends = cuts.select("q", F.lower(F.substring("text", F.col("at"), F.length("text"))).alias("end"), F.regexp_replace(F.substring("text", F.lit(1), F.col("at") - 1), r"[\s,]+$", "").alias("rest"))
    met = ends.where(F.length("rest") >= LEAST_TEXT).join(places.select("place", F.lower("name").alias("end")), "end")
    return met.groupBy("q").agg(F.min(F.struct((-F.length("end")).alias("n"), "place", "rest")).alias("m")).select("q", "m.place", "m.rest")


def owned_names(points: DataFrame, docs: DataFrame, reach: float) -> DataFrame:
    """id, doc: the name that a point belongs to: of docs (rid, x, y, radius, head) whose radius
    reaches it, the one with the least distance after its head start (ties by doc)."""
    met = spatial.within(points.withColumnRenamed("id", "lid"), docs, reach, "radius", "head").where("dist <= radius")
    return met.groupBy("lid").agg(F.min(F.struct((F.col("dist") - F.col("head")).alias("rank"), "rid")).alias("m")).select(F.col("lid").alias("id"), F.col("m.rid").alias("doc"))


def area_or_nearest(points: DataFrame, areas: DataFrame, addresses: DataFrame, band: float, reach: float) -> DataFrame:
    """id, area: the polygon of least area that holds a point (of equals the least id), else the area of the nearest address
    (rid, x, y, area) in reach, else null."""
    inside = spatial.point_in_polygon(points, areas, band).join(areas.select("poly", F.round(F.abs(geo.ring_area(F.col("ring"))), 6).alias("_area")), "poly")
    inside = inside.groupBy("id").agg(F.min_by("poly", F.struct("_area", "poly")).alias("inside"))
    near = spatial.nearest(points.withColumnRenamed("id", "lid"), addresses, reach).join(addresses.select("rid", "area"), "rid").select(F.col("lid").alias("id"), F.col("area").alias("near"))
    return points.select("id").join(inside, "id", "left").join(near, "id", "left").select("id", F.coalesce("inside", "near").alias("area"))


def named_or_nearest(left: DataFrame, right: DataFrame, reach: float) -> DataFrame:
    """lid, rid: of right points (rid, x, y, name) in reach of a left one (lid, x, y, name) the
    nearest of its name, else the nearest of any."""
    met = spatial.within(left, right.withColumnRenamed("name", "rn"), reach, "rn").join(left.select("lid", F.col("name").alias("ln")), "lid")
    best = met.groupBy("lid").agg(F.min(F.struct((F.col("ln") != F.col("rn")).alias("other"), "dist", "rid")).alias("m"))
    return best.select("lid", F.col("m.rid").alias("rid"), (~F.col("m.other")).alias("named"))


def merged_settings(local: DataFrame, remote: DataFrame) -> DataFrame:
    """path, value of two copies (path, value, at): the later one stands, of equals the local one."""
    a, b = local.select("path", F.struct("value", "at").alias("l")), remote.select("path", F.struct("value", "at").alias("r"))
    newer = F.col("l").isNull() | (F.col("r.at") > F.col("l.at"))
    return a.join(b, "path", "full").select("path", F.when(newer, F.col("r.value")).otherwise(F.col("l.value")).alias("value"))


def best_hits(runs: list[DataFrame]) -> DataFrame:
    """q, doc, score: each document's best score over several runs."""
    every = runs[0]
    for r in runs[1:]:
        every = every.unionByName(r)
    return every.groupBy("q", "doc").agg(F.max("score").alias("score"))


def hilbert(x: Column, y: Column, order: int) -> Column:
    """The place of a cell (x, y from 0 to 2^order - 1) on the Hilbert curve that starts at (0, 0)
    and runs along x first: near cells mostly get near places."""
    zero = F.lit(0).cast("bigint")
    start = F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"), zero.alias("d"))
    sides = F.array(*[F.lit(1 << k).cast("bigint") for k in range(order - 1, -1, -1)])

    def step(s: Column, side: Column) -> Column:
        right, up = (s["x"].bitwiseAND(side) > 0).cast("bigint"), (s["y"].bitwiseAND(side) > 0).cast("bigint")
        quarter = right * 3 + up - 2 * right * up  # 0 and 1 up the left side, 2 and 3 down the right
        turned, flipped = up == 0, (up == 0) & (right == 1)
        a, b = F.when(flipped, side - 1 - s["x"]).otherwise(s["x"]), F.when(flipped, side - 1 - s["y"]).otherwise(s["y"])
        return F.struct(F.when(turned, b).otherwise(a).alias("x"), F.when(turned, a).otherwise(b).alias("y"), (s["d"] + side * side * quarter).alias("d"))

    return F.aggregate(sides, start, step, lambda s: s["d"])


def parcel_key(text: Column) -> Column:
    """'8 649 5' or '070-0196-022' as book, page, parcel and part, padded to 3, 4, 3 and 2; null for
    fewer than three numbers, or where one is too long."""
    n = F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0))
    parts = [F.coalesce(F.get(n, F.lit(i)), F.lit("0")) for i in range(4)]
    widths = (3, 4, 3, 2)
    fits = F.size(n) >= 3
    for p, w in zip(parts, widths):
        fits = fits & (F.length(p) <= w)
    a, b, c, d = (F.lpad(p, w, "0") for p, w in zip(parts, widths))
    return F.when(fits, F.concat(a, F.lit(" "), b, c, d))


def shown_duration(seconds: Column) -> Column:
    """Whole minutes, one at least."""
    return F.concat(F.greatest(F.lit(1), F.floor(seconds / 60 + 0.5).cast("int")).cast("string"), F.lit(" min"))


def side_state(specific: Column, generic: Column) -> Column:
    """A side's own tag, else the street's."""
    return F.coalesce(F.nullif(specific, F.lit("")), F.nullif(generic, F.lit("")))


def nuisance_class(kind: Column, tunnel: Column) -> Column:
    """A ramp counts as the road it leads to; in a tunnel no road is a nuisance."""
    return F.when(~F.coalesce(tunnel, F.lit(False)), F.regexp_replace(kind, "_link$", ""))


def street_docs(addresses: DataFrame) -> DataFrame:
    """street, x, y, n: a street's place is the mean of its addresses (street, x, y)."""
    return addresses.groupBy(names.street_name(F.col("street")).alias("street")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))


def classified_lots(rows: DataFrame) -> DataFrame:
    """id, lat, lng, klass of the lots (id, landuse, latitude, longitude, all text) whose use is lived in or traded in (classes 1 to 5)
    and that have a place. Numbers are read from the beginning of the text, so '05' and '5b' are 5; a blank, a word or
    a coordinate of 0 is no place."""
    number = lambda c, rule: F.nullif(F.regexp_extract(c, rule, 1), F.lit(""))
    real = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
    out = rows.select("id", number("latitude", real).cast("double").alias("lat"), number("longitude", real).cast("double").alias("lng"), number("landuse", r"^\s*\+?0*(\d{1,9})").cast("int").alias("klass"))
    place = lambda c: (F.col(c) != 0) & (F.abs(c) < float("inf"))
    return out.where(F.col("klass").between(1, 5) & place("lat") & place("lng"))


#: Kinds of service lane that are not walked, and what bars walkers.
PRIVATE_LANES, BARRED = ("driveway", "parking_aisle", "alley", "drive-through", "emergency_access"), ("no", "private")


def way_flags(tags: Column) -> list[Column]:
    """tunneled, golf, cemetery_lane of a way's tags (a map; null is none): under a roof closed on both sides; a course's own path;
    a service lane that a cemetery's walkers may take, where it lies in one."""
    tag = lambda k: F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit(""))
    stated = F.coalesce(F.try_element_at(tags, F.lit("tunnel")), F.lit("no")) != "no"
    lane = (tag("highway") == "service") & ~tag("service").isin(*PRIVATE_LANES) & ~tag("access").isin(*BARRED) & ~tag("foot").isin(*BARRED)
    return [
        (stated | (tag("covered") == "yes")).alias("tunneled"),
        tag("golf").isin("cartpath", "path").alias("golf"),
        (lane & (tag("area") != "yes") & (tag("indoor") != "yes")).alias("cemetery_lane"),
    ]
