"""Connections to other databases and pages of their tables.

No JDBC driver is part of this installation, so the builders are checked as text; the pages run on any DataFrame.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.typemap import PG_FAMILY, supported

#: Reference default page, and the partitions of a parallel read.
PAGE, PARTITIONS = 20_000, 10
SOURCES = ("mysql", "postgres", "oracle", "sqlserver", "gaussdb", "seabox", "highgo", "kingbase", "dameng")


@dataclass(frozen=True)
class Connection:
    kind: str
    host: str
    port: int
    database: str = ""
    user: str = ""
    password: str = ""


def dsn(c: Connection) -> str:
    """Connection text of the database's own form."""
    match c.kind:
        case "mysql":
            return f"{c.user}:{c.password}@tcp({c.host}:{c.port})/{c.database}?parseTime=true&charset=utf8mb4"
        case "oracle":
            return f"oracle://{c.user}:{c.password}@{c.host}:{c.port}/{c.database}"
        case "sqlserver":
            return f"server={c.host};port={c.port};database={c.database};user id={c.user};password={c.password};trustservercertificate=true;encrypt=DISABLE"
        case "dameng":
            return f"dm://{c.user}:{c.password}@{c.host}:{c.port}"
    return f"host={c.host} port={c.port} user={c.user} password={c.password} dbname={c.database} sslmode=disable" if c.kind in PG_FAMILY else ""


def jdbc_url(c: Connection) -> str:
    match c.kind:
        case "mysql":
            return f"jdbc:mysql://{c.host}:{c.port}/{c.database}?useUnicode=true&characterEncoding=utf8"
        case "oracle":
            return f"jdbc:oracle:thin:@//{c.host}:{c.port}/{c.database}"
        case "sqlserver":
            return f"jdbc:sqlserver://{c.host}:{c.port};databaseName={c.database};encrypt=false;trustServerCertificate=true"
        case "dameng":
            return f"jdbc:dm://{c.host}:{c.port}"
    if c.kind in PG_FAMILY:
        return f"jdbc:postgresql://{c.host}:{c.port}/{c.database}"
    raise ValueError(f"unknown database: {c.kind}")


def jdbc_options(c: Connection, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = PARTITIONS) -> dict[str, str]:
    """Options of spark.read.format('jdbc'): a range of keys for each partition instead of pages."""
    out = {"url": jdbc_url(c), "dbtable": table, "user": c.user, "password": c.password, "fetchsize": str(PAGE)}
    if key and bounds:
        out |= {"partitionColumn": key, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    return out


def open_table(spark: SparkSession, source: Connection | str, table: str, predicates: list[str] | None = None, **kw) -> DataFrame:
    """A table of a connection, or a Parquet table of a folder; with ``predicates`` (key_splits()) one partition for each."""
    if isinstance(source, str):
        return spark.read.parquet(f"{source}/{table}.parquet")
    if predicates:
        options = jdbc_options(source, table)
        return spark.read.jdbc(options.pop("url"), options.pop("dbtable"), predicates=predicates, properties=options)
    return spark.read.format("jdbc").options(**jdbc_options(source, table, **kw)).load()


def pair_supported(src: str, dst: str) -> bool:
    return supported("postgres" if src in PG_FAMILY else src, dst)


def page(df: DataFrame, keys: list[str], offset: int, size: int = PAGE) -> DataFrame:
    """One page in key order, without keys in the order of all columns, so that pages don't overlap. For parity only: a copy scans a table once instead."""
    return df.orderBy(*(keys or df.columns)).offset(offset).limit(size)


def page_after(df: DataFrame, keys: list[str], last: list | None = None, size: int = PAGE) -> DataFrame:
    """The page after a row of these key values (none for the first), as a cursor over a snapshot goes: no row before it is read again."""
    rows = df if last is None else df.where(F.struct(*keys) > F.struct(*[F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(keys, last, strict=True)]))
    return rows.orderBy(*keys).limit(size)


def page_by_rank(df: DataFrame, order: list[str | Column], first: int, last: int) -> DataFrame:
    """Rows first..last (from 1) in an order, without the rank. limit() lets Spark keep only that many rows of each partition."""
    top = df.orderBy(*order).limit(last)
    return top.withColumn("_n", F.row_number().over(Window.orderBy(*order))).where(F.col("_n") >= first).drop("_n")


SAMPLE = 200


def split_points(df: DataFrame, keys: list[str], parts: int, sample: int = SAMPLE, seed: int = 7) -> list[list]:
    """At most ``parts - 1`` key values, ascending, between which a table falls into stretches of about equal size.

    They come from a sample of about ``sample`` keys a part, which is all that reaches the driver, in the order of the table's own types with nulls
    first; keys may be of any number and of texts.
    """
    rows = df.select(*keys)
    wanted, total = parts * sample, df.count()
    if not total or parts < 2:
        return []
    if total > wanted:
        rows = rows.sample(fraction=min(1.0, 1.2 * wanted / total), seed=seed)
    ordered = rows.orderBy(*keys).limit(2 * wanted).collect()
    points = []
    for i in range(1, parts):
        p = list(ordered[i * len(ordered) // parts]) if ordered else None
        if p is not None and (not points or points[-1] != p) and p != list(ordered[0]):
            points.append(p)
    return points


def literal(value: object) -> str:
    """A value as SQL text that databases and Spark read alike."""
    match value:
        case bool():
            return "TRUE" if value else "FALSE"
        case int() | Decimal():
            return str(value)
        case float():
            return repr(value)
        case datetime.datetime():
            return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S.%f}'"
        case datetime.date():
            return f"DATE '{value:%Y-%m-%d}'"
        case str():
            return "'" + value.replace("'", "''") + "'"
    raise ValueError(f"no split by a {type(value).__name__}")


def _from(keys: list[str], point: list, above: bool) -> str:
    """SQL that holds for rows at or above a point (or all below it), column by column, where null is less than any value."""

    def same(k: str, v: object) -> str:
        return f"{k} IS NULL" if v is None else f"{k} = {literal(v)}"

    def beyond(k: str, v: object) -> str | None:
        if above:
            return f"{k} IS NOT NULL" if v is None else f"{k} > {literal(v)}"
        return None if v is None else f"({k} < {literal(v)} OR {k} IS NULL)"

    either = []
    for i, (k, v) in enumerate(zip(keys, point, strict=True)):
        if (b := beyond(k, v)) is not None:
            either.append(" AND ".join([*[same(*x) for x in zip(keys[:i], point[:i], strict=True)], b]))
    if above:
        either.append(" AND ".join(same(*x) for x in zip(keys, point, strict=True)))
    return "(" + " OR ".join(f"({e})" for e in either) + ")" if either else "(1 = 0)"


def key_splits(df: DataFrame, keys: list[str], parts: int = PARTITIONS, quote: Callable[[str], str] = str, points: list[list] | None = None) -> list[str]:
    """Predicates of which each row meets exactly one, nulls in keys too: a partition of a read for each, instead of numeric bounds.

    ``quote`` writes the columns as the database wants them. Without rows, or with one key for all, there is one predicate, that always holds. A table is
    split as evenly as its keys allow: rows of one key stay together.
    """
    points = split_points(df, keys, parts) if points is None else points
    names = [quote(k) for k in keys]
    if not points:
        return ["(1 = 1)"]
    inner = [f"{_from(names, a, True)} AND {_from(names, b, False)}" for a, b in pairwise(points)]
    return [_from(names, points[0], False), *inner, _from(names, points[-1], True)]


def pages(total: int, size: int = PAGE) -> int:
    return -(-total // size)
