"""Session defaults and the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(name: str = "tablebridge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC and adaptive execution; settings of the cluster stay where they are given."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    return b.config(map=DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def shared_folder(spark: SparkSession, name: str = "table") -> str:
    """A fresh path in the folder of ``spark.checkpoint.dir``; where the session names none (tests), under the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """A path as a URI that tasks can open: without a scheme it lies where Spark would put it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file:///") else uri


def durable(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder: its lineage ends there, and a lost executor costs nothing."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
