"""Proof that two tables agree: counts, row hashes, ordered and order-free digests, latency ranks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import durable
from .scan import running

TWO64 = 18446744073709551616
NULL_TEXT = "<NULL>"


def _big(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(20,0)")


def canonical(c: Column, t: T.DataType) -> Column:
    """Text of a value that does not depend on the database: null as <NULL>, UTC microseconds, hex bytes, plain decimals."""
    if isinstance(t, T.BooleanType):
        text = F.when(c, "1").otherwise("0")
    elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    elif isinstance(t, T.BinaryType):
        text = F.concat(F.lit("hex:"), F.lower(F.hex(c)))
    elif isinstance(t, T.DecimalType):
        plain = F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        text = F.when(plain.isin("-0", ""), "0").otherwise(plain)
    elif isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return F.when(c.isNull(), NULL_TEXT).otherwise(text)


def eight_bytes(n: Column) -> Column:
    """A length as eight bytes, big-endian: small ones, of which most are, come from an array of constants."""
    small = F.array(*[F.lit(i.to_bytes(8, "big")) for i in range(256)])
    return F.when(n < 256, F.get(small, n)).otherwise(F.unhex(F.lpad(F.hex(n.cast("bigint")), 16, "0")))


def row_hash(df: DataFrame, columns: list[str] | None = None, strict: bool = False) -> Column:
    """SHA-256 over each column's text with its length in bytes before it (eight bytes, big-endian).

    A null and the text <NULL> fall together, as in the compared systems; ``strict`` adds a byte that tells them apart.
    """
    parts = []
    for name in columns or df.columns:
        text = canonical(F.col(f"`{name}`"), df.schema[name].dataType)
        if strict:
            parts.append(F.when(F.col(f"`{name}`").isNull(), F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("01"))))
        parts += [eight_bytes(F.octet_length(text)), F.encode(text, "UTF-8")]
    return F.sha2(F.concat(*parts), 256)


def ordered_digest(df: DataFrame, order: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row ``row_count, digest``: SHA-256 over all row hashes in key order.

    The hashes (32 bytes a row) meet in one value, by the nature of a chained digest: meant for tables of up to some
    million rows; digest_by_range() and multiset_digest() have no such bound.
    """
    rows = df.select(F.struct(*[F.col(f"`{k}`") for k in order]).alias("k"), row_hash(df, columns).alias("h"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), "")
    return rows.agg(F.count("*").alias("row_count"), F.sha2(F.unhex(listed), 256).alias("digest"))


def digest_by_range(df: DataFrame, bucket: Column, order: list[str], columns: list[str] | None = None) -> DataFrame:
    """An ordered digest for each bucket of keys, which also tells where tables differ; bounded by the size of a bucket."""
    rows = df.select(bucket.alias("bucket"), F.struct(*[F.col(f"`{k}`") for k in order]).alias("k"), row_hash(df, columns).alias("h"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), "")
    return rows.groupBy("bucket").agg(F.count("*").alias("row_count"), F.sha2(F.unhex(listed), 256).alias("digest"))


def chained_digest(df: DataFrame, bucket: Column, order: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row ``row_count, digest``: SHA-256 over the buckets' ordered digests in bucket order, for tables of any size.

    Equal tables have equal digests if they are cut by the same function of the key; no value holds more than a bucket or one digest a bucket.
    """
    return digest_by_range(df, bucket, order, columns).agg(
        F.sum("row_count").alias("row_count"), F.sha2(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "digest"))), lambda x: x["digest"]), "")), 256).alias("digest")
    )


# What orders the rows of a table of each kind.
ORDER_KEYS = {"composite": ["tenant_id", "id"], "unique": ["code"], "keyless": []}


def order_key(kind: str) -> list[str]:
    """Columns that a digest orders by; [] means that only a multiset digest fits."""
    return ORDER_KEYS.get(kind, ["id"])


def digest_of_kind(df: DataFrame, kind: str, columns: list[str] | None = None) -> DataFrame:
    key = order_key(kind)
    return ordered_digest(df, key, columns) if key else multiset_digest(df, columns)


def multiset_lanes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: count, and sum and xor modulo 2^64 of the four 64-bit lanes of all row hashes.

    Halves of 32 bits are summed as integers within each partition, where they can't overflow, and put together as decimals after that.
    """
    halves = [f"h{i}" for i in range(8)]
    rows = df.select(row_hash(df, columns).alias("h"), F.spark_partition_id().alias("p"))
    rows = rows.select("p", *[F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("bigint").alias(c) for i, c in enumerate(halves)])
    parts = rows.groupBy("p").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{c}") for c in halves], *[F.expr(f"bit_xor({c})").alias(f"x{c}") for c in halves])
    wide = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(28,0)")), F.lit(0)).cast("decimal(28,0)")
    both = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), *[wide(f"s{c}").alias(f"s{c}") for c in halves], *[F.coalesce(F.expr(f"bit_xor(x{c})"), F.lit(0)).alias(f"x{c}") for c in halves])
    total = [((F.col(f"sh{2 * i}") % _big(2**32)) * _big(2**32) + F.col(f"sh{2 * i + 1}")) % _big(TWO64) for i in range(4)]
    xor = [F.shiftleft(f"xh{2 * i}", 32).bitwiseOR(F.col(f"xh{2 * i + 1}")) for i in range(4)]
    return both.select("row_count", *[t.cast("decimal(20,0)").alias(f"sum{i}") for i, t in enumerate(total)], *[x.alias(f"xor{i}") for i, x in enumerate(xor)])


def multiset_digest(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row ``row_count, digest``: SHA-256 over count, sums and xors (72 bytes, big-endian). Order plays no part."""
    lanes = multiset_lanes(df, columns)
    eight = lambda c: F.unhex(F.lpad(F.conv(c.cast("string"), 10, 16), 16, "0"))
    unsigned = lambda c: F.when(c < 0, c.cast("decimal(20,0)") + _big(TWO64)).otherwise(c.cast("decimal(20,0)"))
    parts = [eight(F.col("row_count")), *[eight(F.col(f"sum{i}")) for i in range(4)], *[eight(unsigned(F.col(f"xor{i}"))) for i in range(4)]]
    return lanes.select("row_count", F.sha2(F.concat(*parts), 256).alias("digest"))


def plain_multiset_digest(hashes: list[bytes]) -> str:
    """The same digest of a few row hashes without Spark, for checks."""
    sums, xors = [0] * 4, [0] * 4
    for h in hashes:
        for i in range(4):
            v = int.from_bytes(h[8 * i : 8 * i + 8], "big")
            sums[i], xors[i] = (sums[i] + v) % TWO64, xors[i] ^ v
    return hashlib.sha256(b"".join(x.to_bytes(8, "big") for x in [len(hashes), *sums, *xors])).hexdigest()


def table_counts(tables: dict[str, DataFrame], name: str = "rows") -> DataFrame:
    """``table_name, <name>`` of many tables in one job."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias(name)).select(F.lit(t).alias("table_name"), name) for t, df in tables.items()])


def compare_counts(source: dict[str, DataFrame], target: dict[str, DataFrame]) -> DataFrame:
    """``table_name, src_rows, dst_rows, matches``; a table missing on a side counts 0 and does not match."""
    a, b = table_counts(source, "src_rows"), table_counts(target, "dst_rows")
    both = a.join(b, "table_name", "full")
    ok = F.coalesce(F.col("src_rows") == F.col("dst_rows"), F.lit(False))
    return both.select("table_name", F.coalesce("src_rows", F.lit(0)).alias("src_rows"), F.coalesce("dst_rows", F.lit(0)).alias("dst_rows"), ok.alias("matches"))


def out_of_scope(target_tables: DataFrame, allowed: DataFrame) -> DataFrame:
    """Names in the target that the job must not have made."""
    return target_tables.join(allowed, "table_name", "left_anti")


def floor_percentiles(df: DataFrame, group: list[str], value: str, ps: tuple[float, ...] = (0.5, 0.95, 0.99), keep: Callable[[DataFrame], DataFrame] = durable, parts: int | None = None) -> DataFrame:
    """Element at place floor((n - 1) p) of the sorted values, exactly; nulls don't count.

    Equal values are counted before the shuffle. The distinct ones are dealt to ranges between sampled splitters, whose exact counts add up to where
    each range begins (running()), so that a group of any size, and values of any spread, are no single task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_c"))
    ranked = running(counts, group, [value], {"_to": ("sum", F.col("_c"))}, keep, parts)
    totals = ranked.groupBy(*group).agg(F.max("_to").alias("_n")).select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_n")
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)], F.lit(True))
    at = ranked.join(totals, same)
    place = lambda p: F.floor((F.col("_n") - 1) * p)
    cols = [F.max(F.when((place(p) < F.col("_to")) & (place(p) >= F.col("_to") - F.col("_c")), F.col(value))).alias(f"p{round(p * 100)}") for p in ps]
    return at.groupBy(*group).agg(F.max("_n").alias("n"), *cols)
