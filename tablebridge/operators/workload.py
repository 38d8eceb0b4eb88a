"""Deterministic load: row counts by table, rows, transactions, and classes of errors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import durable
from .scan import running

KINDS = ("primary", "composite", "unique", "keyless", "wide", "mixed_case")
# Too many connections, lock wait timeout, deadlock.
CAPACITY = (1040, 1205, 1213)


def allocate(spark: SparkSession, tables: int, total: int, most: int | None = None) -> DataFrame:
    """``i, kind, rows``: weights 1 / (i + 8)^0.82, every 97th table empty, rounded down and capped.

    What is left over goes round the tables that have room, hottest first, a row each time. The number of rounds is
    found by sums over the tables' room instead of a loop: round r gives to the tables whose room is over r.
    """
    most = most or total
    t = spark.range(tables).select(F.col("id").cast("int").alias("i"), F.when((F.col("id") + 1) % 97 == 0, F.lit(0.0)).otherwise(1 / F.pow(F.col("id") + 8, F.lit(0.82))).alias("w"))
    if (tables - tables // 97) * most < total:
        raise ValueError("more rows than the tables may hold")
    one = Window.partitionBy()
    base = F.least(F.floor(F.lit(float(total)) * F.col("w") / F.sum("w").over(one)), F.lit(most)).cast("long")
    t = t.withColumn("base", base).withColumn("room", F.when(F.col("w") > 0, F.lit(most) - F.col("base")).otherwise(F.lit(0)))
    t = t.withColumn("left", F.lit(total) - F.sum("base").over(one))
    # Tables by room: a table of room c takes part in rounds 0..c-1. given(r) = sum of min(room, r) is what r rounds use.
    by = Window.orderBy("room").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("below", F.sum("room").over(by)).withColumn("above", F.count(F.when(F.col("room") > 0, 1)).over(one) - F.sum(F.when(F.col("room") > 0, 1).otherwise(0)).over(by))
    t = t.withColumn("used", F.col("below") + F.col("above") * F.col("room"))
    # The greatest full level that fits, and the rounds beyond it.
    level = F.coalesce(F.max(F.when(F.col("used") <= F.col("left"), F.struct("room", "used"))).over(one), F.struct(F.lit(0).cast("long").alias("room"), F.lit(0).cast("long").alias("used")))
    t = t.withColumn("lv", level)
    live = F.sum(F.when(F.col("room") > F.col("lv.room"), 1).otherwise(0)).over(one)
    t = t.withColumn("live", live).withColumn("more", F.when(F.col("live") > 0, F.floor((F.col("left") - F.col("lv.used")) / F.col("live"))).otherwise(0))
    t = t.withColumn("rest", F.col("left") - F.col("lv.used") - F.col("more") * F.col("live"))
    open_ = F.col("room") > F.col("lv.room") + F.col("more")
    rank = F.sum(F.when(open_, 1).otherwise(0)).over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    rows = F.col("base") + F.least(F.col("room"), F.col("lv.room") + F.col("more")) + F.when(open_ & (rank <= F.col("rest")), 1).otherwise(0)
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("i") % len(KINDS) + 1)
    return t.select("i", kind.alias("kind"), rows.cast("long").alias("rows"))


def token(run: str) -> str:
    """A run's name as part of a table's: at most twelve of its ASCII letters and digits, in lower case."""
    return "".join(c for c in run.lower() if c.isascii() and c.isalnum())[:12] or "run"


def profile(spark: SparkSession, run: str, tables: int, total: int, most: int | None = None, prefix: str = "load_") -> DataFrame:
    """``i, table_name, kind, rows``: tables numbered from 1; those of mixed case have a capital in their name."""
    number = F.format_string("%06d", F.col("i") + 1)
    name = F.concat(F.lit(f"{prefix}{token(run)}_"), F.when(F.col("kind") == "mixed_case", "Mixed_").otherwise(""), number)
    return allocate(spark, tables, total, most).select((F.col("i") + 1).alias("i"), name.alias("table_name"), "kind", "rows")


def hottest(tables: DataFrame, share: float = 0.01) -> DataFrame:
    """The first hundredth of the tables by rows (one at least), ties by number."""
    return tables.orderBy(F.desc("rows"), "i").limit(max(1, int(tables.count() * share)))


def action(seq: Column) -> Column:
    """Six inserts, two updates, a delete and a rollback of every ten."""
    m = F.pmod(seq, F.lit(10))
    return F.when(m <= 5, "insert").when(m <= 7, "update").when(m == 8, "delete").otherwise("rollback")


def pick_tables(seqs: DataFrame, tables: DataFrame, hot: int = 80, keep: Callable[[DataFrame], DataFrame] = durable) -> DataFrame:
    """``seq, table_name`` of writes: four of five go to the hottest hundredth of the tables, the rest to any; the number alone decides."""
    ranked = running(tables.select("table_name", "rows"), [], [F.desc("rows"), F.asc("table_name")], {"n": ("sum", F.lit(1))}, keep).withColumn("place", F.col("n") - 1)
    few = F.greatest(F.lit(1), F.floor(F.col("all") / 100))
    want = seqs.crossJoin(F.broadcast(tables.agg(F.count("*").alias("all")))).withColumn("of", F.when(F.pmod("seq", F.lit(100)) < hot, few).otherwise(F.col("all")))
    return want.withColumn("place", F.pmod(F.floor(F.col("seq") / 100) + F.col("seq") * 7919, F.col("of"))).join(ranked.select("table_name", "place"), "place").select("seq", "table_name")


def boundary_fixtures(tables: DataFrame, first: int) -> DataFrame:
    """Ledger rows ``seq, txn, table_name, action, row_id, committed`` of transactions that test the bounds.

    One over the first two tables with a plain key, one that is rolled back, and for the first table of each kind with a key one that moves a
    row's key. Tables: ``i, table_name, kind``.
    """
    plain = tables.where("kind in ('primary', 'wide')").orderBy("i").limit(2).select("i", "table_name")
    if plain.count() < 2:
        return tables.sparkSession.createDataFrame([], "seq long, txn string, table_name string, action string, row_id long, committed boolean")
    both = plain.select(F.lit(first).cast("long").alias("seq"), F.lit(f"cross-{first}").alias("txn"), "table_name", F.lit("insert").alias("action"), F.lit(first).cast("long").alias("row_id"), F.lit(True).alias("committed"))
    back = plain.orderBy("i").limit(1).select(F.lit(first + 1).cast("long").alias("seq"), F.lit(f"rollback-{first + 1}").alias("txn"), "table_name", F.lit("insert").alias("action"), F.lit(first + 1).cast("long").alias("row_id"), F.lit(False).alias("committed"))
    kinds = F.array_position(F.array(*[F.lit(k) for k in ("primary", "composite", "unique")]), F.col("kind"))
    firsts = tables.where(kinds > 0).groupBy(kinds.alias("k"), "kind").agg(F.min_by("table_name", "i").alias("table_name"))
    seq = F.row_number().over(Window.orderBy("k")) + first + 1
    moved = firsts.withColumn("seq", seq.cast("long")).select("seq", F.concat(F.lit("locator-"), F.col("seq").cast("string")).alias("txn"), "table_name", F.lit("locator_update").alias("action"), (F.col("seq") + F.when(F.col("kind") == "primary", 1_000_000_000).otherwise(0)).alias("row_id"), F.lit(True).alias("committed"))
    return both.unionByName(back).unionByName(moved)


def rows(spark: SparkSession, table: int, n: int, run: str = "run") -> DataFrame:
    """The rows of a generated table."""
    r = F.col("id")
    note = F.when(r % 1000 == 0, F.repeat(F.lit("long-note-"), 500)).when(r % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("note-"), (r % 1000).cast("string")))
    return spark.range(n).select(
        r, (r % 31 + 1).cast("int").alias("tenant_id"), F.format_string(f"t{table:06d}-r%012d", r).alias("code"), r.alias("event_id"), F.concat(F.lit(f"{run}/{table}/"), r.cast("string"), F.lit("/中文/emoji-🚀")).alias("payload"),
        ((r % 1_000_000) + (r % 10_000) / F.lit(10_000)).cast("decimal(18,4)").alias("amount"), (r % 1000).cast("double").alias("score"), (r % 2).cast("int").alias("active"),
        F.timestamp_micros((F.lit(1_700_000_000) + r % 10_000_000) * 1_000_000 + r % 1_000_000).cast("timestamp_ntz").alias("created_at"), note.alias("note"), F.encode(F.concat(F.lit(f"{table}:"), r.cast("string")), "UTF-8").alias("blob_data"),
    )


# Texts of errors of the network or the machine, not of the database.
ENVIRONMENT = (
    "can't assign requested address",
    "too many open files",
    "connection refused",
    "network is unreachable",
    "no route to host",
)


def error_class(number: Column, text: Column) -> Column:
    """Class of a failed statement by the database's error number, or its text where there is none; '' without an error.

    Numbers of a full or locked server are capacity, all others correctness; a text of the network or the machine is environment.
    """
    outside = F.lower(text).rlike("|".join(ENVIRONMENT))
    return F.when(number.isNull() & text.isNull(), "").when(number.isin(*CAPACITY), "capacity").when(number.isNull() & outside, "environment").otherwise("correctness")
