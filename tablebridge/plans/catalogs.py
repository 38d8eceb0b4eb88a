"""Catalog relations, pages over a cursor, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import catalog, readers, sinks
from .changes import shared
from .registry import load, query


@query("SELECT n_name AS table_name, CAST(count(s_suppkey) AS BIGINT) AS triggers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_suppkey % 2 = 0 GROUP BY n_name")
def catalog_trigger_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as triggers of nations."""
    n, s = load(spark, sf, "nation"), load(spark, sf, "supplier").where("s_suppkey % 2 = 0")
    t = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("table_name"))
    return catalog.trigger_counts(n.select(F.col("n_name").alias("table_name")), t)


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber, l_partkey) > (100, 3, 50) ORDER BY ALL LIMIT 500")
def page_after_cursor(spark: SparkSession, sf: str) -> DataFrame:
    x = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return readers.page_after(x, ["l_orderkey", "l_linenumber", "l_partkey"], [100, 3, 50], 500)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation ORDER BY ALL LIMIT 7 OFFSET 7")
def page_without_key(spark: SparkSession, sf: str) -> DataFrame:
    return readers.page(load(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), [], 7, 7)


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def sink_store(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables through a sink, published together, and read back joined."""
    sink = sinks.sink_for(spark, "store", root=shared(spark))
    sink.write("nation", load(spark, sf, "nation"), keys=["n_nationkey"])
    sink.write("region", load(spark, sf, "region"))
    sink.publish()
    n, r = sink.store.read("nation"), sink.store.read("region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")


@query("""SELECT 'o' AS table_name, 'id' AS column_name, 'SELECT setval(pg_get_serial_sequence(''"app"."o"'', ''id''), ' || CAST(max(o_orderkey) + 1 AS VARCHAR) || ', false)' AS statement FROM orders
UNION ALL SELECT 'none', 'id', 'SELECT setval(pg_get_serial_sequence(''"app"."none"'', ''id''), 1, false)'""")
def sink_reseed(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return sinks.reseed(catalog.next_values({("o", "id"): o, ("none", "id"): o.where("false")}), "postgres", "app")
