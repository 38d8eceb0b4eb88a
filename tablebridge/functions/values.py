"""Neutral values to target values. Null passes through every expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scrub_text(c: Column) -> Column:
    """Text without U+0000."""
    return F.translate(c, "\x00", "")


def bit_text(c: Column) -> Column:
    """Text of a one-byte BIT value: its hex without the first digit. Right for 0 and 1 only; see bit_number()."""
    return F.substring(F.lower(F.hex(c)), 2, 2**31 - 1)


def bit_number(c: Column) -> Column:
    """Big-endian bytes as a signed 64-bit integer; the last eight bytes count."""
    unsigned = F.conv(F.right(F.hex(c), F.lit(16)), 16, 10).cast("decimal(20,0)")
    big = F.lit(str(2**63)).cast("decimal(20,0)")
    return F.when(F.octet_length(c) == 0, F.lit(0)).otherwise(F.when(unsigned >= big, unsigned - F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(unsigned)).cast("bigint")


def geometry_text(c: Column) -> Column:
    """Hex of a geometry without the four bytes of its reference system; shorter values whole."""
    h = F.lower(F.hex(c))
    return F.when(F.octet_length(c) < 4, h).otherwise(F.substring(h, 9, 2**31 - 1))


def bool_number(c: Column) -> Column:
    return c.cast("int")


def datetime_text(c: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss with the fraction's digits but for trailing zeros, and no dot without a fraction."""
    return F.rtrim(F.rtrim(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("0")), F.lit("."))


def console_value(c: Column, t: T.DataType) -> Column:
    """Value of a console result as text: RFC 3339 times, integers beyond 2^53 - 1 and all others as text, binary as base64:."""
    if isinstance(t, T.BinaryType):
        return F.concat(F.lit("base64:"), F.base64(c))
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.concat(F.rtrim(F.rtrim(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0")), F.lit(".")), F.lit("Z"))
    if isinstance(t, T.StringType):
        return F.when(F.is_valid_utf8(c), c).otherwise(F.concat(F.lit("base64:"), F.base64(c.cast("binary"))))
    if isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def scrub_frame(df: DataFrame) -> DataFrame:
    """U+0000 removed from the text columns; all others untouched."""
    return df.withColumns({f.name: scrub_text(F.col(f"`{f.name}`")).alias(f.name) for f in df.schema if isinstance(f.dataType, T.StringType)})
