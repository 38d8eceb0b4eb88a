"""Files around a job: ledgers as JSON lines, sheets of connections, configuration."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "sequence long, txn string, table_name string, action string, row_id long, committed boolean, committed_at timestamp_ntz"
#: Columns of a sheet of jobs, wherever they stand in its header.
SHEET = ("src_host", "src_port", "src_database", "dst_host", "dst_port", "dst_schema")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """A workload's ledger; lines that a crash cut short are left out."""
    return spark.read.schema(LEDGER).json(path).where("sequence is not null")


def last_sequence(df: DataFrame) -> DataFrame:
    """One row: where a restarted workload goes on (0 for an empty ledger)."""
    return df.agg(F.coalesce(F.max("sequence"), F.lit(0).cast("long")).alias("last_sequence"))


def sheet(spark: SparkSession, path: str, columns: tuple[str, ...] = SHEET) -> DataFrame:
    """Rows of a CSV sheet by column name in either case, trimmed, blank rows skipped; a missing column is an error."""
    df = spark.read.option("header", True).csv(path)
    at = {c.strip().lower(): c for c in df.columns}
    if lost := [c for c in columns if c not in at]:
        raise ValueError(f"columns are missing: {', '.join(lost)}")
    rows = df.select(*[F.nullif(F.trim(F.col(f"`{at[c]}`")), F.lit("")).alias(c) for c in columns])
    return rows.where(F.coalesce(*columns).isNotNull())


def configuration(defaults: Mapping[str, object], text: str | None, env: Mapping[str, str], prefix: str = "TABLEBRIDGE_") -> dict[str, object]:
    """Environment before file before default; values of the environment take the type of the default. Unknown names are errors."""
    out = dict(defaults)
    given = json.loads(text) if text else {}
    if extra := set(given) - set(out):
        raise ValueError(f"unknown settings: {', '.join(sorted(extra))}")
    out |= given
    for name, default in defaults.items():
        raw = env.get(prefix + name.upper())
        if raw is not None:
            out[name] = raw.strip().lower() in ("1", "true", "yes") if isinstance(default, bool) else type(default)(raw) if default is not None else raw
    return out
