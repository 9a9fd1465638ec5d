"""The generic relational surface over the star schema and events: what comes with Spark, shown once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkcurate.plans.registry import query, table


@query(
    "rel_pricing_summary",
    """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""",
)
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query(
    "rel_revenue_by_nation",
    """select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_regionkey = 1 group by 1""",
)
def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region").filter("r_regionkey = 1"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("rel_cube", "select coalesce(o_orderstatus, '*') as status, coalesce(o_orderpriority, '*') as priority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)")
def cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).select(F.coalesce("o_orderstatus", F.lit("*")).alias("status"), F.coalesce("o_orderpriority", F.lit("*")).alias("priority"), "n")


@query("rel_top_orders", "select c_custkey, o_orderkey from (select c_custkey, o_orderkey, row_number() over (partition by c_custkey order by o_totalprice desc, o_orderkey) as rn from customer join orders on c_custkey = o_custkey) where rn <= 3")
def top_orders(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    rn = F.row_number().over(Window.partitionBy("c_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return rows.withColumn("rn", rn).filter("rn <= 3").select("c_custkey", "o_orderkey")


@query("rel_suppliers_without_lines", "select s_suppkey from supplier where not exists (select 1 from lineitem where l_suppkey = s_suppkey and l_quantity > 45)")
def suppliers_without_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, d, "supplier").join(lines, "s_suppkey", "left_anti").select("s_suppkey")


@query("rel_running_total", "select event_id, round(sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding), 6) as running from events")
def running_total(spark: SparkSession, d: str) -> DataFrame:
    own = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.round(F.sum("value").over(own), 6).alias("running"))


@query("rel_hourly", "select epoch_us(time_bucket(interval 1 hour, ts)) as hour, event_type, count(*) as n from events group by 1, 2")
def hourly(spark: SparkSession, d: str) -> DataFrame:
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    return table(spark, d, "events").groupBy(F.unix_micros(w["start"]).alias("hour"), "event_type").agg(F.count("*").alias("n"))


@query("rel_brand_sizes", "select p_brand, count(distinct p_size) as sizes, round(stddev_samp(p_retailprice), 6) as spread from part group by 1")
def brand_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(F.count_distinct("p_size").alias("sizes"), F.round(F.stddev_samp("p_retailprice"), 6).alias("spread"))


@query("rel_label_norms", "select label, count(*) as n, round(avg(sqrt(list_sum([x::double * x::double for x in embedding]))), 6) as mean_norm from embeddings group by 1")
def label_norms(spark: SparkSession, d: str) -> DataFrame:
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(norm), 6).alias("mean_norm"))
