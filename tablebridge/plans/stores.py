"""Bucketed tables, pinned versions, change log positions, splits, pages and log losses over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.positions import Position, contains_intervals, intersect_intervals, subtract_intervals
from ..operators import cdc, jobs
from ..session import shared_folder
from ..sources import pages, readers
from ..sources.store import TableStore
from ..streaming import apply as streaming
from ..streaming import changelog
from .changes import ORDER_COLS, _ORDERS_AFTER, order_log, order_outcomes
from .registry import load, query


def _row(df: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])


def _orders(spark: SparkSession, sf: str, buckets: int = 16) -> tuple[TableStore, DataFrame]:
    """A store with the orders in buckets and the suppliers, which nothing changes, as a second table."""
    store = TableStore(spark, shared_folder(spark, "store"))
    orders = load(spark, sf, "orders")
    store.commit(store.latest(), {"orders": store.stage_buckets("orders", orders, ["o_orderkey"], buckets), "supplier": store.stage_buckets("supplier", load(spark, sf, "supplier"), ["s_suppkey"], 4)}, -1)
    return store, orders


def _full_log(orders: DataFrame, log: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Changes and ends of transactions as a source's log has them."""
    row = _row(orders)
    none = F.lit(None).cast(row)
    full = log.select("txn_seq", "op_seq", F.lit("orders").alias("table_name"), "action", "before", "after", F.lit("").alias("statement"))
    ends = outcomes.select("txn_seq", F.lit(99).alias("op_seq"), F.lit("").alias("table_name"), F.col("outcome").alias("action"), none.alias("before"), none.alias("after"), F.lit("").alias("statement"))
    return full.unionByName(ends)


_O = ", ".join(ORDER_COLS)
KEYS = {"orders": ["o_orderkey"], "supplier": ["s_suppkey"]}


@query("SELECT " + _O + " FROM (" + _ORDERS_AFTER + ")")
def store_bucketed_apply(spark: SparkSession, sf: str) -> DataFrame:
    """The order log applied to a bucketed table in one batch."""
    store, orders = _orders(spark, sf)
    log = order_log(spark, sf)
    streaming.apply_batch(store, _full_log(orders, log, order_outcomes(log)), KEYS)
    return store.read("orders").select(ORDER_COLS)


@query("SELECT count(*) AS rows, count_if(o_orderkey % 100 = 0) AS marked, true AS few_bytes, true AS same_files FROM orders")
def store_small_batch(spark: SparkSession, sf: str) -> DataFrame:
    """A batch that changes every hundredth order writes less than half of the table's bytes, and nothing of an unchanged table."""
    store, orders = _orders(spark, sf, 4)
    before = store.latest()
    changed = orders.where("o_orderkey % 100 = 0")
    after = F.struct(*[(F.lit("X") if c == "o_orderstatus" else F.col(c)).alias(c) for c in orders.columns])
    log = changed.select(F.lit(1).cast("long").alias("txn_seq"), F.col("o_orderkey").cast("int").alias("op_seq"), F.lit("update").alias("action"), F.struct(*orders.columns).alias("before"), after.alias("after"))
    now = streaming.apply_batch(store, _full_log(orders, log, spark.createDataFrame([(1, "commit")], "txn_seq long, outcome string")), KEYS)
    old, new = (store.entry("orders", m).folders() for m in (before, now))
    few = store.size_of(new - old) < store.size_of(old) / 2
    same = old < new and now["tables"]["supplier"] == before["tables"]["supplier"]
    counts = store.read("orders").agg(F.count("*").alias("rows"), F.count_if(F.col("o_orderstatus") == "X").alias("marked"))
    return counts.withColumns({"few_bytes": F.lit(few), "same_files": F.lit(same)})


@query("SELECT (SELECT count(*) FROM orders) AS old_rows, (SELECT count(*) FROM (" + _ORDERS_AFTER + ")) AS new_rows, true AS rebuilt, CAST(1 AS BIGINT) AS kept_versions")
def store_pinned_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """A version stays readable while later ones are made; with the log from its position it gives the last one; then only that is kept."""
    store, orders = _orders(spark, sf)
    log, outcomes = order_log(spark, sf), order_outcomes(order_log(spark, sf))
    with store.pin() as snapshot:
        half = orders.agg((F.max("o_orderkey") / 2).cast("long")).first()[0]
        full = _full_log(orders, log, outcomes)
        streaming.apply_batch(store, full.where(F.col("txn_seq") <= half), KEYS)
        streaming.apply_batch(store, full, KEYS)
        store.collect(keep=1, grace=-1)
        old = store.read("orders", snapshot)
        rebuilt = cdc.apply_keyed(old, cdc.committed(cdc.after_position(log, snapshot["position"]), outcomes), ["o_orderkey"])
        now = store.read("orders").select(ORDER_COLS)
        same = rebuilt.select(ORDER_COLS).exceptAll(now).isEmpty() and now.exceptAll(rebuilt.select(ORDER_COLS)).isEmpty()
        counts = (old.count(), now.count(), same)
    store.collect(keep=1, grace=-1)
    return spark.createDataFrame([(*counts, len(store.versions()))], "old_rows long, new_rows long, rebuilt boolean, kept_versions long")


@query("SELECT count(*) AS pending_rows, 0 AS left_over, count(*) AS marked FROM orders WHERE o_orderkey % 10 = 6")
def store_open_transaction(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of one open transaction come in ten batches and are written once each; its end applies them all."""
    store, orders = _orders(spark, sf)
    log = order_log(spark, sf).where("action = 'update' and txn_seq % 10 = 6").withColumns({"op_seq": F.col("txn_seq").cast("int"), "txn_seq": F.lit(1).cast("long")})
    none = spark.createDataFrame([], "txn_seq long, outcome string")
    full = _full_log(orders, log, none)
    for n in range(10):
        streaming.apply_batch(store, full.where(F.floor(F.col("op_seq") / 10) % 10 == n), KEYS, batch=("stream", n))
    parts = store.latest()["state"].get("pending", [])
    rows = sum(spark.read.parquet(f"{p['path']}/changes").count() for p in parts)
    done = streaming.apply_batch(store, _full_log(orders, log.limit(0), spark.createDataFrame([(1, "commit")], "txn_seq long, outcome string")), KEYS, batch=("stream", 10))
    marked = store.read("orders").where("o_orderstatus = 'X'").count()
    return spark.createDataFrame([(rows, len(done["state"]["pending"]), marked)], "pending_rows long, left_over int, marked long")


@query(f"SELECT {_O}, CASE WHEN o_orderkey > (SELECT max(o_orderkey) // 2 FROM orders) THEN 'n' || o_custkey END AS note FROM orders")
def store_acknowledged_ddl(spark: SparkSession, sf: str) -> DataFrame:
    """A column comes in the middle of the log: the stream pauses there, the statement is acknowledged, and it goes on with rows of both schemas."""
    store, orders = _orders(spark, sf)
    root, half = shared_folder(spark, "log"), orders.agg((F.max("o_orderkey").cast("long") / 2).cast("long")).first()[0]
    wide = orders.withColumn("note", F.concat(F.lit("n"), "o_custkey"))
    old, new = _row(orders), _row(wide)
    update = lambda df: df.select(F.col("o_orderkey").alias("txn_seq"), F.lit(0).alias("op_seq"), F.lit("update").alias("action"), F.struct(*df.columns).alias("before"), F.struct(*df.columns).alias("after"))
    commits = lambda df: df.select(F.col("o_orderkey").alias("txn_seq"), F.lit("commit").alias("outcome"))
    early, late = orders.where(F.col("o_orderkey") < half), wide.where(F.col("o_orderkey") > half)
    _full_log(orders, update(early), commits(early)).write.json(f"{root}/log")
    spark.createDataFrame([(half, 0, "", "ddl", None, None, "alter table orders add note varchar(20)"), (half, 1, "", "commit", None, None, "")], streaming.log_schema(old)).coalesce(1).write.mode("append").json(f"{root}/log")
    _full_log(wide, update(late), commits(late)).write.mode("append").json(f"{root}/log")
    run = lambda row: streaming.stream(spark, store, f"{root}/log", streaming.log_schema(row), KEYS, f"{root}/check").awaitTermination()
    try:
        run(old)
    except Exception as e:
        if "Paused" not in str(e):
            raise
    store.acknowledge(half, {"orders": new})
    run(new)
    return store.read("orders")


@query("SELECT count(*) AS entries, count(DISTINCT o_orderkey) AS txns, CAST(2 AS BIGINT) AS runs FROM (SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders)")
def changelog_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """The order log as numbered files, read as a stream of positions in two runs, the second from the checkpoint of the first, in the middle of a file."""
    root, orders = shared_folder(spark, "changelog"), load(spark, sf, "orders")
    log = order_log(spark, sf)
    changelog.write_log(_full_log(orders, log, order_outcomes(log)), f"{root}/log", ["txn_seq", "op_seq"], 4)
    schema = streaming.log_schema(_row(orders))
    size = sum(changelog.Folder(changelog.qualified(spark, f"{root}/log")).sizes().values())
    for limit in (size // 2, 0):
        entries = changelog.follow(spark, f"{root}/log", schema, partitionBytes=200_000, triggerBytes=limit)
        entries.select("txn_seq", "action").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check").trigger(availableNow=True).start().awaitTermination()
    runs = spark.read.parquet(f"{root}/out").agg(F.count("*").alias("entries"), F.count_distinct("txn_seq").alias("txns"))
    return runs.withColumn("runs", F.lit(2).cast("long"))


@query("SELECT " + _O + " FROM (" + _ORDERS_AFTER + ")")
def changelog_applied(spark: SparkSession, sf: str) -> DataFrame:
    """The order log followed by position and applied to a bucketed table."""
    store, orders = _orders(spark, sf)
    root, log = shared_folder(spark, "changelog"), order_log(spark, sf)
    changelog.write_log(_full_log(orders, log, order_outcomes(log)), f"{root}/log", ["txn_seq", "op_seq"], 3)
    schema = streaming.log_schema(_row(orders))
    entries = changelog.follow(spark, f"{root}/log", schema, Position("binlog.000001", 0)).drop("log_file", "log_pos")
    streaming.stream(spark, store, entries, schema, KEYS, f"{root}/check").awaitTermination()
    return store.read("orders").select(ORDER_COLS)


# Interval sets: what one server has executed and another has not

def _executed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = load(spark, sf, "events").select(F.lit("U1").alias("uuid"), F.col("event_id").alias("lo"), "user_id")
    a = e.select("uuid", "lo", (F.col("lo") + F.col("user_id") % 3).alias("hi")).where("lo % 4 <> 3")
    return a, e.select(F.lower("uuid").alias("uuid"), "lo", (F.col("lo") + 1).alias("hi")).where("lo % 7 = 0")


_SETS = "WITH a AS (SELECT DISTINCT unnest(range(event_id, event_id + user_id % 3 + 1)) AS i FROM events WHERE event_id % 4 <> 3), b AS (SELECT DISTINCT unnest(range(event_id, event_id + 2)) AS i FROM events WHERE event_id % 7 = 0)"
_MERGED = "SELECT 'u1' AS uuid, min(i) AS lo, max(i) AS hi FROM (SELECT i, i - row_number() OVER (ORDER BY i) AS g FROM x) GROUP BY g"


@query(f"{_SETS}, x AS (SELECT i FROM a WHERE i NOT IN (SELECT i FROM b)) {_MERGED}")
def gtid_difference(spark: SparkSession, sf: str) -> DataFrame:
    return subtract_intervals(*_executed(spark, sf))


@query(f"{_SETS}, x AS (SELECT i FROM a WHERE i IN (SELECT i FROM b)) {_MERGED}")
def gtid_intersection(spark: SparkSession, sf: str) -> DataFrame:
    return intersect_intervals(*_executed(spark, sf))


@query(f"{_SETS} SELECT NOT EXISTS (SELECT i FROM b WHERE i NOT IN (SELECT i FROM a)) AS contains")
def gtid_contains(spark: SparkSession, sf: str) -> DataFrame:
    return contains_intervals(*_executed(spark, sf))


# Splits, pages, losses

@query("SELECT count(*) AS rows, CAST(1 AS BIGINT) AS times, true AS even FROM lineitem")
def read_key_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Line items by splits of a composite key: each row in one, the largest at most twice the mean."""
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    splits = readers.key_splits(lines, ["l_orderkey", "l_linenumber"], 8)
    met = lines.select(F.array_compact(F.array(*[F.when(F.expr(p), F.lit(i)) for i, p in enumerate(splits)])).alias("s"))
    each = met.select(F.size("s").alias("times"), F.col("s")[0].alias("i")).groupBy("times", "i").agg(F.count("*").alias("n"))
    return each.agg(F.sum("n").alias("rows"), F.max("times").cast("long").alias("times"), (F.max("n") * len(splits) <= 2 * F.sum("n")).alias("even"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def sink_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Line items written in pages by a job that fails on the way and is started again."""
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    path = shared_folder(spark, "pages")
    dealt = pages.dealt(lines, ["l_orderkey"], 4)
    try:
        pages.write_pages(dealt, path, "lines", 5000, failAfter=2)
    except Exception as e:
        if "stopped after" not in str(e):
            raise
    pages.write_pages(dealt, path, "lines", 5000)
    return pages.read_pages(spark, path, "lines", lines.schema)


@query("SELECT user_id % 10 AS job, min(event_id) AS first_seq, max(event_id) AS last_seq, count(*) AS lines, max(event_id) - min(event_id) + 1 - count(*) AS lost FROM events WHERE event_id % 13 <> 5 GROUP BY 1")
def log_losses(spark: SparkSession, sf: str) -> DataFrame:
    """Events as numbered lines of ten jobs, of which some were dropped, followed as a stream."""
    root = shared_folder(spark, "lines")
    load(spark, sf, "events").where("event_id % 13 <> 5").selectExpr("user_id % 10 AS job", "event_id AS seq", "event_type AS line").write.parquet(f"{root}/in")
    lines = spark.readStream.schema("job long, seq long, line string").parquet(f"{root}/in")
    for q in jobs.follow_lines(lines, f"{root}/out", f"{root}/check"):
        q.awaitTermination()
    return jobs.last_counts(spark, f"{root}/out")


@query("""WITH l AS (SELECT event_id AS seq, CASE WHEN event_id % 50 = 0 THEN event_id % 4 + 1 END AS p FROM events)
SELECT seq, 1 AS job, CASE WHEN p IS NULL THEN 'data' ELSE 'info' END AS level, CAST(last_value(p IGNORE NULLS) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS VARCHAR) AS phase FROM l""")
def log_journal_one_job(spark: SparkSession, sf: str) -> DataFrame:
    """All lines are one job's: its phases are found by blocks."""
    line = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("=== Phase "), (F.col("event_id") % 4 + 1).cast("string"), F.lit(": x"))).otherwise("[DATA] text")
    return jobs.journal(load(spark, sf, "events").select(F.col("event_id").alias("seq"), F.lit(1).alias("job"), line.alias("line"))).drop("line")
