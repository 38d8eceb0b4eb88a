"""Snapshot copy of a set of tables: names, types and values mapped lazily, written once, counted, published together."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import scrub_frame
from ..sources.store import TableStore

CATEGORIES = ("tables", "data", "primary_keys", "sequences", "indexes", "constraints", "views", "comments")


def map_table(df: DataFrame, name: Callable[[str], str] = str, values: Callable[[DataFrame], DataFrame] = scrub_frame) -> DataFrame:
    """Values changed by expression, then columns renamed; two columns of one new name are an error."""
    names = [name(c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"column names fall together: {names}")
    return values(df).toDF(*names)


def copy_tables(spark: SparkSession, tables: dict[str, DataFrame], store: TableStore, name: Callable[[str], str] = str, parallel: int = 10, keys: dict[str, list[str]] | None = None) -> DataFrame:
    """Copy all tables and publish those that succeeded as one version; returns the report's items.

    Tables are independent jobs on driver threads; each is scanned once, whatever its size, and all its partitions run in
    parallel. A table with keys is spread by them. A table that fails is reported and keeps its version before.
    """
    before = store.latest()

    def one(item: tuple[str, DataFrame]) -> tuple[str, str, str]:
        table, df = item
        try:
            out = map_table(df, name)
            out = out.repartition(*[name(k) for k in keys[table]]) if keys and table in keys else out
            return table, store.stage(name(table), out), ""
        except Exception as e:  # noqa: BLE001  goes to the report
            return table, "", str(e).splitlines()[0][:240]

    with ThreadPoolExecutor(parallel) as pool:
        done = list(pool.map(one, tables.items()))
    store.commit(before, {name(t): p for t, p, e in done if not e}, before["position"])
    return spark.createDataFrame([("data", t, not e, e) for t, _, e in done], "category string, name string, ok boolean, error string")


def report(items: DataFrame) -> DataFrame:
    """Totals of each category and its failed items."""
    failed = F.filter(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("name")))), lambda x: x.isNotNull())
    return items.groupBy("category").agg(F.count("*").alias("total"), F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("failed"), failed.alias("failed_items"))


def status(items: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """``status`` by the reported failures alone (comments aside), and ``verified`` by the counts too."""
    bad = items.where("not ok and category <> 'comments'").agg((F.count("*") > 0).alias("bad"))
    out = bad.select(F.when(F.col("bad"), "failed").otherwise("success").alias("status"))
    if counts is None:
        return out.withColumn("verified", F.lit(None).cast("boolean"))
    return out.crossJoin(counts.agg(F.bool_and("matches").alias("verified")))
