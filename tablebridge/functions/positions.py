"""Algebra of log positions: binlog file and offset, and sets of global transaction ids."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scan import running
from ..session import durable


@dataclass(frozen=True)
class Position:
    file: str = ""
    pos: int = 0
    gtid: str = ""


def server_id(job: str) -> int:
    """A stream's number among a source's replicas: FNV-1a of 32 bits of the job's name, above 1000."""
    h = 0x811C9DC5
    for b in job.encode():
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return 1000 + h % 4_000_000_000


def parse_gtid(text: str) -> dict[str, list[tuple[int, int]]]:
    """``uuid:1-5:7,uuid2:3`` as closed, sorted, joined intervals by lower-case uuid."""
    out: dict[str, list[tuple[int, int]]] = {}
    for part in filter(None, (x.strip() for x in text.replace("\n", "").split(","))):
        uuid, *spans = part.split(":")
        if not re.fullmatch(r"[0-9a-fA-F]{8}(-?[0-9a-fA-F]{4}){3}-?[0-9a-fA-F]{12}", uuid) or not spans:
            raise ValueError(f"not a transaction id set: {part}")
        for s in spans:
            a, _, b = s.strip().partition("-")
            lo, hi = int(a), int(b or a)
            if lo < 1 or hi < lo:
                raise ValueError(f"bad interval: {s}")
            out.setdefault(uuid.lower(), []).append((lo, hi))
    return {u: _joined(v) for u, v in out.items()}


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def format_gtid(sets: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(u + "".join(f":{a}" if a == b else f":{a}-{b}" for a, b in sets[u]) for u in sorted(sets))


def gtid_contains(whole: str, part: str) -> bool:
    w = parse_gtid(whole)
    return all(any(a <= lo and hi <= b for a, b in w.get(u, ())) for u, spans in parse_gtid(part).items() for lo, hi in spans)


def gtid_merge(a: str, b: str) -> str:
    """Union; a side that can't be read leaves the first as it is."""
    if not a or not b:
        return a or b
    try:
        x, y = parse_gtid(a), parse_gtid(b)
    except ValueError:
        return a
    return format_gtid({u: _joined(x.get(u, []) + y.get(u, [])) for u in x.keys() | y.keys()})


def _number(file: str) -> int | None:
    tail = file.rpartition(".")[2] if "." in file else ""
    return int(tail) if tail.isascii() and tail.isdigit() else None


def reached(applied: Position, asked: Position) -> bool:
    if asked.gtid and applied.gtid:
        try:
            return gtid_contains(applied.gtid, asked.gtid)
        except ValueError:
            return False
    if not asked.file:
        return True
    if applied.file == asked.file:
        return applied.pos >= asked.pos
    a, b = _number(applied.file), _number(asked.file)
    return a > b if a is not None and b is not None else applied.file > asked.file


def equivalent(a: Position, b: Position) -> bool:
    if a.file and b.file and (a.file, a.pos) != (b.file, b.pos):
        return False
    if a.gtid and b.gtid:
        try:
            return parse_gtid(a.gtid) == parse_gtid(b.gtid)
        except ValueError:
            return False
    return bool(a.file and b.file)


def available(start: Position, executed: str = "", purged: str = "", logs: dict[str, int] | None = None) -> str:
    """'' if a stream can start there, else why not."""
    if start.gtid:
        if not gtid_contains(executed, start.gtid):
            return "start lies beyond what the source has executed"
        return "" if not purged or gtid_contains(start.gtid, purged) else "transactions after the start are purged"
    if start.file not in (logs or {}):
        return "log file is gone"
    return "" if start.pos <= logs[start.file] else "position lies beyond the end of the file"


def reached_column(file: str, pos: str, asked: Position):
    """reached() for file positions as an expression."""
    number = lambda f: F.when(f.rlike(r"\.[0-9]+$"), F.regexp_extract(f, r"([0-9]+)$", 1).cast("long"))
    a, b = number(F.col(file)), F.lit(_number(asked.file)).cast("long")
    later = F.when(a.isNotNull() & b.isNotNull(), a > b).otherwise(F.col(file) > asked.file)
    return F.when(F.lit(asked.file == ""), F.lit(True)).when(F.col(file) == asked.file, F.col(pos) >= asked.pos).otherwise(later)


def _islands(df: DataFrame, by: list[str]) -> DataFrame:
    """Intervals that touch, within each group, as one."""
    w = Window.partitionBy(*by).orderBy("lo", "hi")
    top = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("new", (top.isNull() | (F.col("lo") > top + 1)).cast("int"))
    grouped = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*by, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def merge_intervals(df: DataFrame, width: int = 1_000_000, keep: Callable[[DataFrame], DataFrame] = durable) -> DataFrame:
    """Union of interval rows ``uuid, lo, hi`` as disjoint intervals (gaps and islands), for sets too large for one string.

    A source has often one uuid alone. Intervals that begin in the same ``width`` numbers are merged first; what is left is swept in order by blocks
    (running()): the greatest end before each interval tells whether it begins an island, and a running count names that.
    """
    rows = df.select(F.lower("uuid").alias("uuid"), "lo", "hi", F.floor(F.col("lo") / width).alias("range"))
    some = _islands(rows, ["uuid", "range"]).select("uuid", "lo", "hi")
    upto = running(some, ["uuid"], ["lo", "hi"], {"top": ("max", F.col("hi"))}, keep, before=True)
    new = (F.col("top").isNull() | (F.col("lo") > F.col("top") + 1)).cast("long")
    island = running(upto, ["uuid"], ["lo", "hi"], {"island": ("sum", new)}, keep)
    return island.groupBy("uuid", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def _cover(a: DataFrame, b: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stretches ``uuid, lo, hi, in_a, in_b`` between neighbouring ends of two sets' intervals: how many of each hold the stretch.

    A sweep over all ends, by blocks: the running sums of what begins and ends, and the next end from the other side.
    """
    ends = lambda df, x, y: df.select(F.lower("uuid").alias("uuid"), F.explode(F.array(F.struct(F.col("lo").alias("lo"), F.lit(x).alias("a"), F.lit(y).alias("b")), F.struct((F.col("hi") + 1).alias("lo"), F.lit(-x).alias("a"), F.lit(-y).alias("b")))).alias("e")).select("uuid", "e.*")
    steps = ends(a, 1, 0).unionByName(ends(b, 0, 1)).groupBy("uuid", "lo").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    held = running(steps, ["uuid"], ["lo"], {"in_a": ("sum", F.col("a")), "in_b": ("sum", F.col("b"))}, keep)
    after = running(held, ["uuid"], [F.desc("lo")], {"next": ("min", F.col("lo"))}, keep, before=True)
    return after.where("next is not null").select("uuid", "lo", (F.col("next") - 1).alias("hi"), "in_a", "in_b")


def intersect_intervals(a: DataFrame, b: DataFrame, keep: Callable[[DataFrame], DataFrame] = durable) -> DataFrame:
    """Numbers that both sets hold, as disjoint intervals ``uuid, lo, hi``; intervals of a set may overlap."""
    return merge_intervals(_cover(a, b, keep).where("in_a > 0 and in_b > 0").select("uuid", "lo", "hi"), keep=keep)


def subtract_intervals(a: DataFrame, b: DataFrame, keep: Callable[[DataFrame], DataFrame] = durable) -> DataFrame:
    """Numbers of ``a`` that ``b`` lacks, as disjoint intervals: for instance what a source has executed and a target has not."""
    return merge_intervals(_cover(a, b, keep).where("in_a > 0 and in_b = 0").select("uuid", "lo", "hi"), keep=keep)


def contains_intervals(whole: DataFrame, part: DataFrame, keep: Callable[[DataFrame], DataFrame] = durable) -> DataFrame:
    """One row ``contains``: whether ``whole`` holds every number of ``part``."""
    lacking = _cover(part, whole, keep).where("in_a > 0 and in_b = 0")
    return lacking.agg((F.count("*") == 0).alias("contains"))
