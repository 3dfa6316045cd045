"""Relational queries over the star schema: joins, grouping sets, windows, set operations, parametrised SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.readers import dimension, table
from .base import Catalog

catalog = Catalog()
query = catalog.query


def t(spark, d, name, *columns):
    return table(spark, d, name, *columns)


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS price, round(avg(l_discount), 6) AS disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark, d):
    rows = t(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("price"), F.round(F.avg("l_discount"), 6).alias("disc"), F.count(F.lit(1)).alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""")
def star_join(spark, d):
    nations = dimension(t(spark, d, "nation").join(dimension(t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name"))
    orders = t(spark, d, "orders", "o_orderkey", "o_custkey").join(t(spark, d, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    lines = t(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_extendedprice", "l_discount").join(dimension(t(spark, d, "supplier", "s_suppkey", "s_nationkey")), F.col("l_suppkey") == F.col("s_suppkey"))
    both = lines.join(orders, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("s_nationkey") == F.col("c_nationkey"))).join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return both.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_join(spark, d):
    big = t(spark, d, "orders", "o_custkey", "o_totalprice").where("o_totalprice > 300000")
    return t(spark, d, "customer", "c_custkey").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 200000)")
def anti_join(spark, d):
    return t(spark, d, "customer", "c_custkey").join(t(spark, d, "orders", "o_custkey", "o_orderpriority", "o_totalprice").where("o_orderpriority = '1-URGENT' and o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("SELECT coalesce(c.k, s.k) AS k, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 8000 GROUP BY 1) s ON c.k = s.k")
def full_outer_join(spark, d):
    c = t(spark, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    s = t(spark, d, "supplier").where("s_acctbal > 8000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return c.join(s, "k", "full").select("k", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("SELECT a.event_id AS e, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'purchase' GROUP BY 1")
def range_join(spark, d):
    """Events of the same user within an hour: an equi-join on user and time bucket, each event in its own and the next bucket."""
    ev = t(spark, d, "events", "event_id", "user_id", "ts", "event_type").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    hour = 3_600_000_000
    a = ev.where("event_type = 'purchase'").select(F.col("event_id").alias("e"), "user_id", F.col("at").alias("a"), F.explode(F.array(F.floor(F.col("at") / hour), F.floor(F.col("at") / hour) + 1)).alias("bucket"))
    b = ev.select("user_id", F.col("at").alias("b"), F.floor(F.col("at") / hour).alias("bucket"))
    return a.join(b, ["user_id", "bucket"]).where((F.col("b") > F.col("a")) & (F.col("b") <= F.col("a") + hour)).groupBy("e").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT e, c FROM (SELECT a.event_id AS e, max_by(b.event_id, b.ts) AS c FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'click' AND b.ts <= a.ts WHERE a.event_type = 'purchase' GROUP BY 1)")
def asof_join(spark, d):
    """The last click before each purchase: one sort per user of both sides together."""
    ev = t(spark, d, "events", "event_id", "user_id", "ts", "event_type").where(F.col("event_type").isin("purchase", "click"))
    past = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    click = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(past)
    return ev.withColumn("c", click).where("event_type = 'purchase' and c is not null").select(F.col("event_id").alias("e"), "c")


KEYS = "coalesce({0}, 'all') AS {0}"


@query("SELECT coalesce(l_returnflag, 'all') AS f, coalesce(l_linestatus, 'all') AS s, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, d):
    g = t(spark, d, "lineitem", "l_returnflag", "l_linestatus").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.coalesce("l_returnflag", F.lit("all")).alias("f"), F.coalesce("l_linestatus", F.lit("all")).alias("s"), "n")


@query("SELECT coalesce(r_name, 'all') AS region, coalesce(n_name, 'all') AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup(spark, d):
    rows = t(spark, d, "customer", "c_nationkey").join(dimension(t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(dimension(t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("r_name", F.lit("all")).alias("region"), F.coalesce("n_name", F.lit("all")).alias("nation"), "n")


@query("SELECT coalesce(p_brand, 'all') AS brand, coalesce(p_type, 'all') AS type, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())")
def grouping_sets(spark, d):
    g = t(spark, d, "part", "p_brand", "p_type").groupingSets([["p_brand"], ["p_type"], []], "p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.coalesce("p_brand", F.lit("all")).alias("brand"), F.coalesce("p_type", F.lit("all")).alias("type"), "n")


@query("""SELECT o_orderkey, CAST(row_number() OVER w AS INT) AS rn, CAST(ntile(4) OVER w AS INT) AS quarter, round(sum(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving, round(percent_rank() OVER w, 6) AS pr, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INT) AS dr
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window_frames(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t(spark, d, "orders").select("o_orderkey", F.row_number().over(w).alias("rn"), F.ntile(4).over(w).alias("quarter"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("moving"), F.round(F.percent_rank().over(w), 6).alias("pr"), F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority")).alias("dr"))


@query("SELECT k, 'both' AS s FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9500 INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'only' FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def set_ops(spark, d):
    c, s = t(spark, d, "customer"), t(spark, d, "supplier")
    both = c.where("c_acctbal > 9500").select(F.col("c_nationkey").alias("k")).intersect(s.select("s_nationkey"))
    only = c.select(F.col("c_nationkey").alias("k")).subtract(s.where("s_acctbal > 5000").select("s_nationkey"))
    return both.select("k", F.lit("both").alias("s")).unionByName(only.select("k", F.lit("only").alias("s")))


@query("SELECT source, count(*) AS n FROM documents WHERE contains(lower(text), 'thing') AND n_chars >= 500 GROUP BY source ORDER BY n DESC, source LIMIT 7")
def parametrised_tool(spark, d):
    """A named query with parameters, as the search tools are."""
    text = "SELECT source, count(*) AS n FROM {docs} WHERE contains(lower(text), :keyword) AND n_chars >= :least GROUP BY source ORDER BY n DESC, source LIMIT 7"
    return spark.sql(text, args={"keyword": "thing", "least": 500}, docs=t(spark, d, "documents"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY event_type")
def distinct_and_quantiles(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"))


@query()
def approximate_aggregates(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey").alias("orders"), F.percentile_approx("l_extendedprice", 0.5).alias("median"))


@query("SELECT r_name, o.o_orderkey, o.o_totalprice FROM region JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 3) o ON true")
def top_per_group(spark, d):
    orders = t(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice").join(t(spark, d, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    named = orders.join(dimension(t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(dimension(t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rank = F.row_number().over(Window.partitionBy("r_name").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return named.withColumn("n", rank).where("n <= 3").select("r_name", "o_orderkey", "o_totalprice")
