"""What can be plugged in: readers, sinks, type maps, value converters and hooks of a stream, each found by a name."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, Protocol

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType

from .functions.typemap import Column


class Reader(Protocol):
    """A source: its tables as DataFrames, so that filters, columns and partitions reach it through Spark."""

    def tables(self) -> DataFrame: ...

    def open(self, table: str) -> DataFrame: ...


class Mapper(Protocol):
    """Type of a target for a source's column."""

    def __call__(self, column: Column) -> str: ...


class Converter(Protocol):
    """Value of a target for a source's value, as an expression of Spark: no row passes through Python."""

    def __call__(self, value: SparkColumn, kind: DataType) -> SparkColumn: ...


class Hooks:
    """What a stream tells, each once a micro-batch; a hook does nothing unless it is overridden, and none may change what is applied."""

    def applied(self, manifest: dict) -> None: ...

    def paused(self, reason: str, position: int, details: dict) -> None: ...


_known: dict[tuple[str, str], Callable[..., Any]] = {}


def register(role: str, kind: str, factory: Callable[..., Any]) -> None:
    """Make a reader, sink, mapper or converter known by its kind; a kind that is taken is an error."""
    if role not in ("reader", "sink", "mapper", "converter"):
        raise ValueError(f"nothing of this role can be plugged in: {role}")
    if (role, kind) in _known:
        raise ValueError(f"{role} {kind} is registered already")
    _known[role, kind] = factory


def plugged(role: str, kind: str) -> Callable[..., Any] | None:
    return _known.get((role, kind))


class FolderReader:
    """The reader of a folder of Parquet tables."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def tables(self) -> DataFrame:
        """``table_name`` of what lies in the folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        names = [s.getPath().getName() for s in found]
        return self.spark.createDataFrame([(n.removesuffix(".parquet"),) for n in sorted(names) if n.endswith(".parquet")], "table_name string")

    def open(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}.parquet")


register("reader", "folder", FolderReader)
