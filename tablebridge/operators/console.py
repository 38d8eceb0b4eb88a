"""The SQL console: run one read-only statement, bounded in rows and time, with an audit row always."""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import console as rules
from ..functions.values import console_value

AUDIT = "id string, user string, namespace string, sql string, statement string, level string, status string, rows long, truncated boolean, ms long, error string, at timestamp"


@dataclass
class Result:
    columns: list[tuple[str, str]]
    rows: list[tuple]
    truncated: bool


def classified(statements: DataFrame, sql: str = "sql") -> DataFrame:
    """The frame's columns and ``statement, level, returns_rows, error`` of each SQL text: what it does, or why it is rejected.

    The scanner reads a text character by character; each batch of rows passes through it once.
    """
    schema = StructType([*statements.schema.fields, *StructType.fromDDL("statement string, level string, returns_rows boolean, error string").fields])

    def one(text: str | None) -> tuple[str, str, bool, str]:
        try:
            risk = rules.analyse(text or "")
            return risk.statement, risk.level, risk.returns_rows, ""
        except ValueError as e:
            return "", "rejected", False, str(e)

    def run(batches):
        for b in batches:
            told = [one(t) for t in b[sql]]
            yield b.assign(**{c: [x[i] for x in told] for i, c in enumerate(("statement", "level", "returns_rows", "error"))})

    return statements.mapInPandas(run, schema)


def execute(spark: SparkSession, sql: str, user: str, audit: str, namespace: str = "", most: int = 1000, seconds: float = 30.0) -> Result:
    """Run a statement and append to the audit table at ``audit``.

    Only read-only statements run. One row beyond the bound is read to tell whether there were more. After the time the
    statement's jobs are cancelled; the bound on rows is part of the plan, so the driver never holds more.
    """
    began, group = time.time(), uuid.uuid4().hex
    risk, status, error, out = None, "rejected", "", None
    timer = threading.Timer(seconds, lambda: spark.sparkContext.cancelJobGroup(group))
    before = spark.catalog.currentDatabase()
    try:
        risk = rules.analyse(sql)
        if risk.level != "readonly":
            raise ValueError(f"{risk.level} statements do not run here")
        status = "failed"
        if namespace:
            spark.catalog.setCurrentDatabase(namespace)
        spark.sparkContext.setJobGroup(group, "console", interruptOnCancel=True)
        timer.start()
        df = spark.sql(sql.strip().rstrip(";"))
        shown = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
        rows = [tuple(r) for r in shown.limit(most + 1).select(*[console_value(F.col(f.name), f.dataType).alias(f.name) for f in shown.schema]).collect()]
        out = Result([(f.name, f.dataType.simpleString()) for f in df.schema], rows[:most], len(rows) > most)
        status = "ok"
        return out
    except Exception as e:
        error = rules.cut_bytes(str(e))
        raise
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        if namespace:
            spark.catalog.setCurrentDatabase(before)
        row = (uuid.uuid4().hex, user, namespace, sql, risk.statement if risk else "", risk.level if risk else "rejected", status, len(out.rows) if out else 0, bool(out and out.truncated), int(1000 * (time.time() - began)), error)
        spark.createDataFrame([(*row, None)], AUDIT).withColumn("at", F.current_timestamp()).write.mode("append").parquet(audit)


def objects(spark: SparkSession, namespace: str = "default") -> DataFrame:
    """``name, kind`` of a namespace's tables and views."""
    rows = [(t.name, "view" if t.tableType in ("VIEW", "TEMPORARY") else "table") for t in spark.catalog.listTables(namespace)]
    return spark.createDataFrame(rows, "name string, kind string")


def columns_with_keys(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """Catalog columns with a flag for those in a primary key."""
    k = keys.select("table_name", F.explode("columns").alias("column_name"), F.lit(True).alias("k"))
    return columns.join(k, ["table_name", "column_name"], "left").withColumn("is_key", F.coalesce("k", F.lit(False))).drop("k")
