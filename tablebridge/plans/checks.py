"""Ledgers, sheets, checks and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, console, verify
from ..sources import catalog, files
from .changes import shared
from .registry import load, query


@query("SELECT max(event_id) AS last_sequence FROM events")
def ledger_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """Events written as a ledger of JSON lines and read back."""
    path = shared(spark)
    load(spark, sf, "events").select(F.col("event_id").alias("sequence"), F.lit("insert").alias("action"), F.lit(True).alias("committed")).write.json(path)
    return files.last_sequence(files.ledger(spark, path))


@query("SELECT c_name AS src_host, CAST(c_custkey AS VARCHAR) AS src_port, c_mktsegment AS src_database FROM customer")
def batch_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """A sheet with other columns, capitals and blank rows."""
    path = shared(spark)
    c = load(spark, sf, "customer").select(F.lit("x").alias("other"), F.col("c_mktsegment").alias(" SRC_Database"), F.col("c_name").alias("Src_Host"), F.col("c_custkey").cast("string").alias("src_port"))
    c.unionByName(c.limit(3).select(*[F.lit(" " if n != "other" else "y").alias(n) for n in c.columns])).write.option("header", True).csv(path)
    return files.sheet(spark, path, ("src_host", "src_port", "src_database"))


@query("SELECT event_id AS sequence, CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id * 10 END AS ms FROM events WHERE event_id % 100 = 0 AND event_type = 'click'")
def latency_sampling(spark: SparkSession, sf: str) -> DataFrame:
    """Every hundredth insert, from commit to visibility; rows of every fifth user are not there yet."""
    e = load(spark, sf, "events")
    act = F.when(F.col("event_type") == "click", "insert").otherwise("update")
    led = e.select(F.col("event_id").alias("sequence"), F.lit("t").alias("table_name"), act.alias("action"), F.col("event_id").alias("row_id"), F.lit(True).alias("committed"), F.col("ts").alias("committed_at"))
    seen = e.where("user_id % 5 <> 0").select(F.lit("t").alias("table_name"), F.col("event_id").alias("row_id"), (F.col("ts") + F.make_dt_interval(secs=(F.col("user_id") / 100).cast("decimal(18,6)"))).alias("visible_at"))
    return checks.latency_samples(led, seen)


@query("SELECT 'ready_with_warnings' AS state")
def cutover_state(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    return checks.cutover(9, 9, 9, verify.compare_counts({"orders": o}, {"orders": o.where("o_orderkey > 0")}))


@query("SELECT 'c' || CAST(c_custkey AS VARCHAR) AS table_name, CASE WHEN c_custkey % 5 = 0 THEN 'timeout' ELSE 'source=' || CAST(c_custkey AS VARCHAR) || ' target=' || CAST(c_custkey - 1 AS VARCHAR) END AS error FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 7 = 0")
def cutover_count_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as tables: the counts of every fifth failed, those of every seventh differ."""
    c = load(spark, sf, "customer")
    dst = F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") - F.when(F.col("c_custkey") % 7 == 0, 1).otherwise(0))
    return checks.count_errors(c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("table_name"), F.col("c_custkey").alias("src_rows"), dst.alias("dst_rows"), F.lit("timeout").alias("failure")))


@query("SELECT n_regionkey::VARCHAR AS n_regionkey, count(*)::VARCHAR AS n FROM nation GROUP BY 1")
def console_execute(spark: SparkSession, sf: str) -> DataFrame:
    load(spark, sf, "nation").createOrReplaceTempView("console_nation")
    r = console.execute(spark, "select n_regionkey, count(*) as n from console_nation group by n_regionkey;", "user", shared(spark))
    return spark.createDataFrame(r.rows, "n_regionkey string, n string")


@query("SELECT * FROM (VALUES ('nation', 'n_nationkey', true), ('nation', 'n_name', false), ('nation', 'n_regionkey', false)) v(table_name, column_name, is_key)")
def console_columns(spark: SparkSession, sf: str) -> DataFrame:
    cols = catalog.columns_of(spark, {"nation": load(spark, sf, "nation")}).select("table_name", "column_name")
    return console.columns_with_keys(cols, spark.sql("SELECT 'nation' AS table_name, array('n_nationkey') AS columns"))
