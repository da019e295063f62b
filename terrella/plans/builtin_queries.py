"""Queries that Spark's own operators answer: general relational cover, not operators of this engine."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrella.plans.scalar_queries import r, rs
from terrella.plans.virtual import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        ORACLE_SQL[fn.__name__] = sql
        return fn

    return keep


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity > 30 AND l_shipdate <= TIMESTAMP '1998-09-02'")
def b01_filter_project(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter("l_quantity > 30 AND l_shipdate <= TIMESTAMP '1998-09-02'").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


@query(f"SELECT n_name, {rs('sum(o_totalprice)', 2)} AS total, count(*)::BIGINT AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def b02_hash_join(spark, sf_dir):
    o, c, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    # The 25 nations are joined after the sums per nation key, so only 25 rows meet them.
    per = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("o_totalprice").alias("t"), F.count("*").alias("n"))
    return per.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", r(F.col("t"), 2).alias("total"), "n")


@query(f"SELECT l_returnflag, l_linestatus, {rs('sum(l_quantity)', 2)} AS sum_qty, {rs('avg(l_discount)')} AS avg_disc, count(*)::BIGINT AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def b03_group_by(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(r(F.sum("l_quantity"), 2).alias("sum_qty"), r(F.avg("l_discount")).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def b04_cube(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def b05_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag").distinct()


@query("SELECT c_custkey, c_nationkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC)::INT AS rk FROM customer")
def b06_rank(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.rank().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"))).alias("rk"))


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)::BIGINT AS n, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events")
def b07_running_window(spark, sf_dir):
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.count("*").over(by.rowsBetween(-4, 0)).alias("n"), F.lag("event_id").over(by).alias("prev"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def b08_top_k(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT n_nationkey + 100 FROM nation EXCEPT SELECT s_nationkey + 100 FROM supplier)")
def b09_set_ops(spark, sf_dir):
    c, s, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    both = c.select(F.col("c_nationkey").alias("k")).intersect(s.select("s_nationkey"))
    return both.union(n.select(F.col("n_nationkey") + 100).exceptAll(s.select(F.col("s_nationkey") + 100).distinct()))


@query(f"SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*)::BIGINT AS n, {rs('sum(value)', 2)} AS total FROM events GROUP BY ALL")
def b10_tumbling_window(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), r(F.sum("value"), 2).alias("total")).select(F.col("window.start").alias("hour"), "event_type", "n", "total")


@query("SELECT event_id, (props->>'$.k')::INT AS k FROM events")
def b11_json_field(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT user_id, count(*)::BIGINT AS n_sessions FROM (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS s FROM events) WHERE s = 1 GROUP BY user_id")
def b12_session_window(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes")).count().groupBy("user_id").agg(F.count("*").alias("n_sessions"))
