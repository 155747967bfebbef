"""The operator families over order, part, customer and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import linkage, ranking, reconcile
from ..sources.tables import table
from ..streaming.upserts import windowed_counts


def _q(value, digits: int = 4):
    return F.round(value + F.lit(1e-9), digits)


def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").filter("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    out = li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum(net).alias("revenue"), F.avg("l_discount").alias("avg_disc"), F.count("*").alias("n"))
    return out.select("l_returnflag", "l_linestatus", _q(F.col("sum_qty"), 2).alias("sum_qty"), _q(F.col("revenue"), 2).alias("revenue"), _q(F.col("avg_disc")).alias("avg_disc"), "n")


def supplier_unit_price(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "lineitem").groupBy("l_suppkey").agg(agg.ratio_of_sums(F.col("l_extendedprice"), F.col("l_quantity")).alias("unit_price"))
    return out.select("l_suppkey", _q(F.col("unit_price")).alias("unit_price"))


def part_ranks(spark: SparkSession, d: str) -> DataFrame:
    out = ranking.rank_in_group(table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice"), ["p_brand"], "p_retailprice", [F.col("p_partkey")])
    return out.select("p_partkey", "p_brand", "role_rank", _q(F.col("role_percentile"), 6).alias("percentile"), "role_bonus")


def largest_line(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_linenumber", "l_partkey", "l_suppkey")
    return li.groupBy("l_orderkey").agg(agg.largest([F.col("l_quantity"), -F.col("l_linenumber"), -F.col("l_partkey"), -F.col("l_suppkey")], F.struct("l_partkey", "l_suppkey")).alias("v")).select("l_orderkey", "v.*")


def returned_share(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_mktsegment").agg(_q(agg.share_where(F.col("l_quantity"), F.col("l_returnflag") == "R"), 6).alias("returned_share"))


def digits_link(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers whose names hold the same number, if it is unique on both sides."""
    customers, suppliers = table(spark, d, "customer"), table(spark, d, "supplier")
    key = lambda c: F.regexp_replace(F.regexp_extract(c, "([0-9]+)", 1), "^0+", "")
    return linkage.cascade_match(suppliers, customers, "s_suppkey", "c_custkey", [("number", key("s_name"), key("c_name"))])


def latest_event(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return reconcile.keep_first(e, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()])


def event_conflicts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("day", F.to_date("ts").cast("string"))
    return reconcile.conflicts(e, ["user_id", "event_type", "day"], ["value"])


def daily_events(spark: SparkSession, d: str) -> DataFrame:
    out = windowed_counts(table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", _q(F.col("total")).alias("total"))


def event_grid(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("month", F.date_format("ts", "yyyy-MM"))
    return agg.dense_grid(e, ["month"], ["event_type"], {"n": F.count("*")})


def signups_without_purchase(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), "event_type")
    return e.filter("event_type = 'signup'").select("user_id", "day").distinct().join(e.filter("event_type = 'purchase'"), ["user_id", "day"], "left_anti")


def near_orders(spark: SparkSession, d: str) -> DataFrame:
    """Each order's number of other orders of its customer within the seven days before: a range frame, no self-join."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.unix_date(F.to_date("o_orderdate")).cast("bigint").alias("day"))
    w = Window.partitionBy("o_custkey").orderBy("day").rangeBetween(-7, 0)
    return o.select("o_orderkey", (F.count("*").over(w) - 1).alias("within_week"))


def nation_sets(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("nationkey"))
    c = table(spark, d, "customer").filter("c_acctbal > 9900").select(F.col("c_nationkey").alias("nationkey"))
    tag = lambda df, name: df.select("nationkey", F.lit(name).alias("part"))
    return tag(s.intersect(c), "both").unionByName(tag(s.subtract(c), "suppliers")).unionByName(tag(c.subtract(s), "customers"))


def props_fields(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.from_json("props", "k int").getField("k").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("filled"), F.sum("k").alias("sum_k"))


def customer_overlay(spark: SparkSession, d: str) -> DataFrame:
    best = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_name").alias("c_mktsegment"))
    base = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return linkage.fill_blanks(base, best, "c_nationkey", ["c_mktsegment"])


QUERIES = {f.__name__: f for f in (pricing_summary, supplier_unit_price, part_ranks, largest_line, returned_share, digits_link, latest_event, event_conflicts, daily_events, event_grid, signups_without_purchase, near_orders, nation_sets, props_fields, customer_overlay)}

SQL = {
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity) + 1e-9, 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)) + 1e-9, 2) AS revenue, round(avg(l_discount) + 1e-9, 4) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "supplier_unit_price": "SELECT l_suppkey, round(coalesce(sum(l_extendedprice) / nullif(sum(l_quantity), 0), 0) + 1e-9, 4) AS unit_price FROM lineitem GROUP BY 1",
    "part_ranks": """
WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rk, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
q AS (SELECT *, CASE WHEN n = 1 THEN 1.0 ELSE CAST(n - rk AS DOUBLE) / (n - 1) END AS p FROM r)
SELECT p_partkey, p_brand, CAST(rk AS INTEGER) AS role_rank, round(p + 1e-9, 6) AS percentile, CAST(CASE WHEN rk <= 5 THEN 0.08 WHEN p >= 0.9 THEN 0.04 ELSE 0 END AS DOUBLE) AS role_bonus FROM q""",
    "largest_line": "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) = 1",
    "returned_share": "SELECT c_mktsegment, round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'R') / nullif(sum(l_quantity), 0), 0) + 1e-9, 6) AS returned_share FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "digits_link": """
WITH s AS (SELECT ltrim(regexp_extract(s_name, '([0-9]+)', 1), '0') AS k, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1 HAVING count(*) = 1 AND k <> ''),
c AS (SELECT ltrim(regexp_extract(c_name, '([0-9]+)', 1), '0') AS k, min(c_custkey) AS c_custkey FROM customer GROUP BY 1 HAVING count(*) = 1 AND k <> '')
SELECT p.s_suppkey, c.c_custkey, CASE WHEN c.c_custkey IS NOT NULL THEN 'number' END AS method FROM supplier p LEFT JOIN s USING (s_suppkey) LEFT JOIN c ON c.k = s.k""",
    "latest_event": "SELECT user_id, ts, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "event_conflicts": "SELECT user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS row_count, 'value' AS conflict_fields FROM events GROUP BY 1, 2, 3 HAVING min(value) <> max(value)",
    "daily_events": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value) + 1e-9, 4) AS total FROM events GROUP BY 1, 2",
    "event_grid": "SELECT m.month, t.event_type, count(e.event_id) AS n FROM (SELECT DISTINCT strftime(ts, '%Y-%m') AS month FROM events) m CROSS JOIN (SELECT DISTINCT event_type FROM events) t LEFT JOIN events e ON strftime(e.ts, '%Y-%m') = m.month AND e.event_type = t.event_type GROUP BY 1, 2",
    "signups_without_purchase": "SELECT DISTINCT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events s WHERE event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = s.user_id AND CAST(p.ts AS DATE) = CAST(s.ts AS DATE))",
    "near_orders": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) - 1 AS within_week FROM orders",
    "nation_sets": """
WITH s AS (SELECT DISTINCT s_nationkey AS nationkey FROM supplier WHERE s_acctbal > 5000), c AS (SELECT DISTINCT c_nationkey AS nationkey FROM customer WHERE c_acctbal > 9900)
SELECT coalesce(s.nationkey, c.nationkey) AS nationkey, CASE WHEN s.nationkey IS NULL THEN 'customers' WHEN c.nationkey IS NULL THEN 'suppliers' ELSE 'both' END AS part FROM s FULL JOIN c ON s.nationkey = c.nationkey""",
    "props_fields": "SELECT event_type, count(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS filled, CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS sum_k FROM events GROUP BY 1",
    "customer_overlay": "SELECT c_custkey, c_nationkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END, ''), s.n) AS c_mktsegment FROM customer LEFT JOIN (SELECT s_nationkey, min(s_name) AS n FROM supplier GROUP BY 1) s ON s_nationkey = c_nationkey",
}
