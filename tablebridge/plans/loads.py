"""The workload: tables, writes, rows, fixtures and classes of errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import workload
from .registry import load, query

@query("SELECT event_id AS seq, 't' || printf('%03d', CASE WHEN event_id % 100 < 80 THEN (event_id // 100 + event_id * 7919) % 2 ELSE (event_id // 100 + event_id * 7919) % 200 END) AS table_name FROM events")
def workload_hot_skew(spark: SparkSession, sf: str) -> DataFrame:
    """Two hundred tables, of which the two largest take four fifths of the writes."""
    tables = spark.range(200).select(F.format_string("t%03d", "id").alias("table_name"), (1000 - F.col("id")).alias("rows"))
    return workload.pick_tables(load(spark, sf, "events").select(F.col("event_id").alias("seq")), tables)


@query("SELECT event_id, CASE WHEN event_id % 10 <= 5 THEN 'insert' WHEN event_id % 10 <= 7 THEN 'update' WHEN event_id % 10 = 8 THEN 'delete' ELSE 'rollback' END AS action FROM events")
def workload_action_mix(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select("event_id", workload.action(F.col("event_id")).alias("action"))
