"""Rows of permit snapshots: lost job numbers, and which permits have moved.

A customer is a permit at an address; a month's orders list it, and an order still in process is a row whose number is lost."""

from __future__ import annotations

from pyspark.sql import functions as F

from strider.operators import permits
from strider.sources.tables import table


def recovered_rows(spark, d):
    records = table(spark, d, "customer").select(F.col("c_custkey").alias("job"), F.col("c_nationkey").alias("bin"), F.floor(F.col("c_acctbal") / 3000).alias("house"), F.col("c_mktsegment").alias("street"), F.lit(None).cast("date").alias("first_permit"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("row"), F.col("o_custkey").alias("job"), F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).cast("date").alias("day"), F.col("o_orderstatus").alias("status"))
    lost = o.where("status = 'P'").join(records, "job").drop("job", "status")
    return permits.recovered(lost, o.where("status <> 'P'").select("day", "job"), records)


def moved_permits(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("job"), F.to_date("o_orderdate").alias("day")).agg(F.min(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")).alias("m"))
    bbl = F.when(F.col("m.o_orderpriority") < "3", F.lit("")).otherwise(F.col("m.o_orderpriority"))
    feet = F.floor(F.col("m.o_totalprice") / 200000)
    return permits.moved(o.select("job", "day", F.lit("b").alias("bin"), F.col("m.o_orderstatus").alias("street"), bbl.alias("bbl"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"), feet.alias("feet")))


QUERIES = {"recovered_rows": recovered_rows, "moved_permits": moved_permits}

ORACLES = {
    "recovered_rows": """WITH r AS (SELECT c_custkey AS job, c_nationkey AS bin, floor(c_acctbal / 3000) AS house, c_mktsegment AS street FROM customer),
o AS (SELECT o_orderkey AS row_, o_custkey AS job, CAST(date_trunc('month', o_orderdate) AS DATE) AS day, o_orderstatus AS status FROM orders),
g AS (SELECT day, bin, house, street, min(row_) AS row_ FROM o JOIN r USING (job) WHERE status = 'P' GROUP BY ALL)
SELECT row_ AS "row", day, min(r.job) AS job FROM g JOIN r USING (bin, house, street) WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.job = r.job AND o.day = g.day AND status <> 'P') GROUP BY row_, day HAVING count(*) = 1""",
    "moved_permits": """WITH o AS (SELECT o_custkey AS job, CAST(o_orderdate AS DATE) AS day, arg_min(o_orderstatus, o_orderkey) AS street, arg_min(o_orderpriority, o_orderkey) AS p, floor(arg_min(o_totalprice, o_orderkey) / 200000) AS feet FROM orders GROUP BY ALL),
b AS (SELECT job, day, street, feet, last_value(CASE WHEN p >= '3' THEN p END IGNORE NULLS) OVER (PARTITION BY job ORDER BY day ROWS UNBOUNDED PRECEDING) AS bbl FROM o),
m AS (SELECT job, day, row_number() OVER w = 1 OR street IS DISTINCT FROM lag(street) OVER w OR feet IS DISTINCT FROM lag(feet) OVER w OR bbl IS DISTINCT FROM lag(bbl) OVER w AS moved FROM b WINDOW w AS (PARTITION BY job ORDER BY day))
SELECT job, day FROM m WHERE moved""",
}
