"""Transactional change logs on tables: keyed and keyless apply, cut points, checkpoints.

A change log has ``txn_seq long, op_seq int, action string, before struct, after struct`` for one table; actions are insert,
update and delete, before and after have the table's columns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .scan import running

# Fixed value: statements that change a schema.
DDL = r"(?is)^\s*(CREATE|ALTER|DROP|RENAME|TRUNCATE)\s+"


def committed(log: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Changes of committed transactions; ``outcomes(txn_seq, outcome)`` has commit or rollback, open ones are left for later."""
    return log.join(outcomes.where(F.lower("outcome") == "commit").select("txn_seq"), "txn_seq", "left_semi")


def pair_updates(rows: DataFrame) -> DataFrame:
    """A change log from rows as a source's log lists them: ``txn_seq, op_seq, kind, n, row``.

    One event is ``op_seq`` with its rows in the order of ``n``. Rows of an insert are images after, of a delete images before; an
    update's come in pairs, before and after, and a last one without its pair is left out. Result: a change log whose op_seq is
    (event, row), so that events of any number and size stay in order. Rows are paired by their number, not collected, so an event of any size spreads.
    """
    one = F.when(F.col("kind") == "update", F.floor(F.col("n") / 2)).otherwise(F.col("n"))
    first = (F.col("kind") != "update") | (F.col("n") % 2 == 0)
    paired = rows.groupBy("txn_seq", "op_seq", "kind", one.alias("i")).agg(F.max(F.when(first, F.col("row"))).alias("a"), F.max(F.when(~first, F.col("row"))).alias("b"), F.count("*").alias("c"))
    whole = paired.where("kind <> 'update' or c = 2")
    before, after = F.when(F.col("kind") != "insert", F.col("a")), F.when(F.col("kind") == "insert", F.col("a")).when(F.col("kind") == "update", F.col("b"))
    return whole.select("txn_seq", F.struct(F.col("op_seq").cast("long").alias("event"), F.col("i").cast("long").alias("row")).alias("op_seq"), F.col("kind").alias("action"), before.alias("before"), after.alias("after"))


def after_position(log: DataFrame, applied: int) -> DataFrame:
    """Replay skip: transactions up to the applied position are dropped."""
    return log.where(F.col("txn_seq") > applied)


def up_to(log: DataFrame, boundary: int | None) -> DataFrame:
    return log if boundary is None else log.where(F.col("txn_seq") <= boundary)


def first_ddl(statements: DataFrame) -> DataFrame:
    """One row ``first_ddl``: the first transaction whose statement changes the schema, or null."""
    return statements.where(F.col("statement").rlike(DDL)).agg(F.min("txn_seq").alias("first_ddl"))


def _key(row: str, keys: list[str]) -> Column:
    return F.struct(*[F.col(f"{row}.{k}").alias(k) for k in keys])


def expand_keyed(log: DataFrame, keys: list[str]) -> DataFrame:
    """Events ``key, live, row, txn_seq, op_seq, sub``: an update of a key is a delete of the old and an upsert of the new."""
    before, after = _key("before", keys), _key("after", keys)
    off = F.struct(F.lit(0).alias("sub"), before.alias("key"), F.lit(False).alias("live"))
    on = F.struct(F.lit(1).alias("sub"), after.alias("key"), F.lit(True).alias("live"))
    moved = (F.col("action") == "update") & ~before.eqNullSafe(after)
    events = F.when(F.col("action") == "delete", F.array(off)).when(moved, F.array(off, on)).otherwise(F.array(on))
    return log.select("txn_seq", "op_seq", "after", F.explode(events).alias("e")).select("txn_seq", "op_seq", F.col("e.sub").alias("sub"), F.col("e.key").alias("key"), F.col("e.live").alias("live"), F.col("after").alias("row"))


def last_events(log: DataFrame, keys: list[str]) -> DataFrame:
    """``key, live, row, reset``: the last event of each key, and whether it was ever deleted; one event of a key and task before the shuffle."""
    order = F.struct("txn_seq", "op_seq", "sub")
    return expand_keyed(log, keys).groupBy("key").agg(F.max_by("live", order).alias("live"), F.max_by("row", order).alias("row"), F.max(~F.col("live")).alias("reset"))


def last_rows(log: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The last event of each key as a row: ``live`` and the table's columns, of which a dead one has its key alone."""
    value = lambda c: F.col(f"key.{c}") if c in keys else F.when(F.col("live"), F.col(f"row.{c}"))
    return last_events(log, keys).select("live", *[value(c).alias(c) for c in columns])


def apply_keyed(base: DataFrame, log: DataFrame, keys: list[str], carried: list[str] | None = None) -> DataFrame:
    """The table after the log: the last event of each key decides.

    A key with many changes is no hot spot; the base is scanned once and joined with the touched keys only. ``carried`` columns exist in the target alone: an update leaves them, a
    delete resets them.
    """
    carried = carried or []
    last = last_events(log, keys)
    touched = last.select(*[F.col(f"key.{k}").alias(f"_k{i}") for i, k in enumerate(keys)], "live", "row", "reset")
    same = reduce(lambda a, b: a & b, [base[k] == touched[f"_k{i}"] for i, k in enumerate(keys)])
    kept = base.join(touched, same, "left_anti")
    rows = touched.where("live")
    if carried:
        old = base.select(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"_c_{c}") for c in carried])
        on = reduce(lambda a, b: a & b, [F.col(f"_k{i}") == F.col(f"_b{i}") for i in range(len(keys))])
        rows = rows.join(old, on, "left")
    cols = [(F.when(~F.col("reset"), F.col(f"_c_{c}")) if c in carried else F.col(f"row.{c}")).alias(c) for c in base.columns]
    return kept.unionByName(rows.select(*cols))


def keyless_deltas(log: DataFrame) -> DataFrame:
    """Events ``row, d, txn_seq, op_seq, sub`` of a table without key: rows come and go one at a time."""
    out = F.struct(F.lit(0).alias("sub"), F.lit(-1).alias("d"), F.col("before").alias("row"))
    into = F.struct(F.lit(1).alias("sub"), F.lit(1).alias("d"), F.col("after").alias("row"))
    events = F.when(F.col("action") == "delete", F.array(out)).when(F.col("action") == "insert", F.array(into)).otherwise(F.array(out, into))
    return log.select("txn_seq", "op_seq", "action", F.explode(events).alias("e")).select("txn_seq", "op_seq", "action", "e.sub", "e.d", "e.row")


def row_key(columns: list[str], row: str | None = None) -> Column:
    """Null-safe identity of a whole row."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"{row}.{c}" if row else c).alias(c) for c in columns]), {"ignoreNullFields": "false"}), 256)


def _touched(base: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of the base (left_semi) or all others (left_anti) by the row keys of a log.

    Adaptive execution broadcasts the keys if their measured size allows it; else it splits a key with very many equal rows
    over several tasks, which it can for the left side of these joins.
    """
    return base.withColumn("rk", row_key(base.columns)).join(keys, "rk", how)


def conflicts(base: DataFrame, log: DataFrame, keep: Callable[[DataFrame], DataFrame] = durable) -> DataFrame:
    """Changes that meet no row: ``txn_seq, op_seq, action, row_hash``, where the row's balance falls below zero.

    The balance starts at the row's count in the base, which is counted for rows of the log alone. The running sum goes by blocks, so one row
    that takes all changes is spread like others.
    """
    deltas = keyless_deltas(log).withColumn("rk", row_key(base.columns, "row")).drop("row")
    run = running(deltas, ["rk"], ["txn_seq", "op_seq", "sub"], {"sum": ("sum", F.col("d"))}, keep).where("d < 0")
    counts = _touched(base, run.select("rk").distinct(), "left_semi").groupBy("rk").agg(F.count("*").alias("n"))
    balance = run.where("sum < 0").join(counts, "rk", "left").withColumn("balance", F.coalesce("n", F.lit(0)) + F.col("sum"))
    return balance.where("balance < 0").select("txn_seq", "op_seq", "action", F.col("rk").alias("row_hash"))


def keyless_net(log: DataFrame, columns: list[str]) -> DataFrame:
    """``rk, d, row``: how many of each row come or go over the whole log."""
    deltas = keyless_deltas(log).withColumn("rk", row_key(columns, "row"))
    return deltas.groupBy("rk").agg(F.sum("d").alias("d"), F.any_value("row").alias("row")).where("d <> 0")


def repeated(net: DataFrame, columns: list[str], *more: str) -> DataFrame:
    """Each row of ``net`` d times, with its columns and ``more``."""
    each = net.where("d > 0").select(*[F.col(f"row.{c}").alias(c) for c in columns], *more, F.explode(F.sequence(F.lit(1), F.col("d").cast("int"))).alias("_i"))
    return each.drop("_i")


def apply_net(base: DataFrame, net: DataFrame) -> DataFrame:
    """The multiset after net changes: only rows that leave are counted, all others pass through."""
    fewer = net.where("d < 0")
    still = _touched(base, fewer.select("rk"), "left_anti").drop("rk")
    counts = _touched(base, fewer.select("rk"), "left_semi").groupBy("rk").agg(F.count("*").alias("n"))
    after = net.join(counts, "rk", "left").withColumn("d", F.coalesce("n", F.lit(0)) + F.col("d"))
    return still.unionByName(repeated(after, base.columns))


def apply_keyless(base: DataFrame, log: DataFrame) -> DataFrame:
    """The multiset after the log, which must have no conflict: rows that only come are appended; the base is held against the keys of rows that leave."""
    return apply_net(base, keyless_net(log, base.columns))


def cut(logs: list[DataFrame], stops: list[DataFrame], boundary: int | None = None) -> list[DataFrame]:
    """Whole transactions of all tables before the first stop (one-row frames with a position or null) and up to the boundary."""
    logs = [up_to(x, boundary) for x in logs]
    if not stops:
        return logs
    least = reduce(DataFrame.union, [s.toDF("p") for s in stops]).agg(F.min("p").alias("stop"))
    return [x.crossJoin(F.broadcast(least)).where(F.col("stop").isNull() | (F.col("txn_seq") < F.col("stop"))).drop("stop") for x in logs]


def batch_stats(log: DataFrame) -> DataFrame:
    """``txn_seq, inserts, updates, deletes, skipped, warnings`` of each transaction; optional columns skipped and warnings mark its changes."""
    of = lambda a: F.count_if(F.col("action") == a)
    marked = lambda c: F.count_if(F.col(c)) if c in log.columns else F.lit(0).cast("long")
    return log.groupBy("txn_seq").agg(of("insert").alias("inserts"), of("update").alias("updates"), of("delete").alias("deletes"), marked("skipped").alias("skipped"), marked("warnings").alias("warnings"))


def change_stats(batches: DataFrame) -> DataFrame:
    """One row of totals: all counts add up, the last position stays."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("inserts", "updates", "deletes", "skipped", "warnings")]
    return batches.agg(*sums, F.count_distinct("txn_seq").alias("txns"), F.max("txn_seq").alias("last_txn"))


def lag_peaks(stats: DataFrame) -> DataFrame:
    """``job, samples, max_lag, last_lag, caught_up_at`` of lag samples ``job, at, lag_seconds``: the peak, the last one, and since when there is none."""
    late = F.max(F.when(F.col("lag_seconds") > 0, F.col("at")))
    peaks = stats.groupBy("job").agg(F.count("*").alias("samples"), F.max("lag_seconds").alias("max_lag"), F.max_by("lag_seconds", "at").alias("last_lag"), late.alias("late"), F.min("at").alias("began"))
    after = stats.join(peaks.select("job", "late"), "job").where("late is null or at > late").groupBy("job").agg(F.min("at").alias("caught_up_at"))
    return peaks.join(after, "job", "left").select("job", "samples", "max_lag", "last_lag", "caught_up_at")


def choose_locators(tables: DataFrame, source_indexes: DataFrame, target_sets: DataFrame) -> DataFrame:
    """``table_name, strategy, index_name, columns``: the primary key, else the smallest unique index that the target has too, else the whole row.

    source_indexes: ``table_name, index_name, columns, is_primary, is_unique, usable``; target_sets: ``table_name, columns`` of unique
    constraints. Column sets compare without order; ties go to the name.
    """
    both = source_indexes.where("is_unique and usable").withColumn("cs", F.array_sort("columns")).join(target_sets.select("table_name", F.array_sort("columns").alias("cs")).distinct(), ["table_name", "cs"], "left_semi")
    usable = both.where(~F.col("is_primary")).unionByName(source_indexes.where("is_primary").withColumn("cs", F.array_sort("columns")))
    rank = F.struct((~F.col("is_primary")).alias("a"), F.size("columns").alias("b"), F.col("index_name").alias("c"))
    best = usable.groupBy("table_name").agg(F.min_by(F.struct("is_primary", "index_name", "columns"), rank).alias("x"))
    kind = F.when(F.col("x").isNull(), "full_row").when(F.col("x.is_primary"), "primary_key").otherwise("unique_key")
    return tables.select("table_name").join(best, "table_name", "left").select("table_name", kind.alias("strategy"), F.coalesce("x.index_name", F.lit("")).alias("index_name"), F.coalesce("x.columns", F.array().cast("array<string>")).alias("columns"))


#: Version of the rules by which choose_locators() chooses.
LOCATOR_VERSION = 1


def frozen_locators(frozen: DataFrame, chosen: DataFrame, version: int = LOCATOR_VERSION) -> DataFrame:
    """Locators of a job that goes on: what was frozen with it stays, also where the rules would choose otherwise now.

    frozen: choose_locators() columns and ``version``; tables without a frozen locator take the one chosen, and one that was frozen by other
    rules is an error. Adds ``version`` and ``problem`` ('', or changed, gone, other_version).
    """
    cols = ["strategy", "index_name", "columns"]
    old = frozen.select("table_name", F.struct(*cols).alias("f"), F.col("version").alias("fv"))
    both = chosen.select("table_name", F.struct(*cols).alias("c")).join(old, "table_name", "full")
    problem = F.when(F.col("fv").isNull(), "").when(F.col("fv") != version, "other_version").when(F.col("c").isNull(), "gone").when(F.col("f") != F.col("c"), "changed").otherwise("")
    use = F.coalesce("f", "c")
    return both.select("table_name", *[use[c].alias(c) for c in cols], F.coalesce("fv", F.lit(version)).alias("version"), problem.alias("problem"))
