"""Change log as a stream: each micro-batch becomes one version of all tables."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import cdc
from ..protocols import Hooks
from ..sources.store import TableStore



@dataclass
class Paused(Exception):
    """Apply stopped before a transaction; everything before it is published."""

    reason: str
    position: int
    details: dict = field(default_factory=dict)


def log_schema(row: StructType) -> StructType:
    """Of a change log; a source with several schemas adds ``schema_name string``."""
    return StructType().add("txn_seq", "long").add("op_seq", "integer").add("table_name", "string").add("action", "string").add("before", row).add("after", row).add("statement", "string")


ENDS = ("commit", "rollback")
CHANGES = ("insert", "update", "delete")


def scoped(log: DataFrame, schemas: list[str] | None) -> DataFrame:
    """Changes and statements of the named source schemas; ends of transactions belong to all."""
    if schemas is None or "schema_name" not in log.columns:
        return log
    return log.where(F.col("schema_name").isin(schemas) | F.col("action").isin(*ENDS)).drop("schema_name")


def summary(log: DataFrame) -> DataFrame:
    """A row for each transaction of a log: ``txn_seq, outcome, changes, ddl``, which says whether it may be applied without reading its changes."""
    outcome = F.max(F.when(F.col("action").isin(*ENDS), F.col("action")))
    ddl = F.coalesce(F.bool_or((F.col("action") == "ddl") & F.col("statement").rlike(cdc.DDL)), F.lit(False))
    return log.groupBy("txn_seq").agg(outcome.alias("outcome"), F.bool_or(F.col("action").isin(*CHANGES)).alias("changes"), ddl.alias("ddl"))


@dataclass
class Pending:
    """Changes that wait for the end of a transaction or for an acknowledgement: parts that are written once and never again.

    A part is a folder with its changes and their summary, and the manifest has the least and greatest transaction of it. A batch reads the
    summaries, and of the changes only what it applies. A part goes from the manifest once all its transactions are behind the position.
    """

    store: TableStore
    parts: list[dict]

    def summaries(self, like: DataFrame) -> DataFrame:
        paths = [f"{p['path']}/transactions" for p in self.parts]
        return self.store.spark.read.schema(like.schema).parquet(*paths) if paths else like.limit(0)

    def changes(self, schema: StructType, low: int, high: int) -> DataFrame | None:
        """Rows of transactions after ``low`` and up to ``high``; a column that came later is null."""
        paths = [f"{p['path']}/changes" for p in self.parts if p["first"] <= high and p["last"] > low]
        return self.store.spark.read.schema(schema).parquet(*paths).where((F.col("txn_seq") > low) & (F.col("txn_seq") <= high)) if paths else None

    def add(self, rows: DataFrame) -> None:
        path = f"{self.store.root}/_pending/{uuid.uuid4().hex}"
        rows.write.parquet(f"{path}/changes")
        written = self.store.spark.read.schema(rows.schema).parquet(f"{path}/changes")
        ends = written.agg(F.min("txn_seq").alias("first"), F.max("txn_seq").alias("last")).first()
        if ends["first"] is not None:
            summary(written).write.parquet(f"{path}/transactions")
            self.parts.append({"path": path, "first": ends["first"], "last": ends["last"]})

    def after(self, position: int) -> list[dict]:
        return [p for p in self.parts if p["last"] > position]


def apply_batch(store: TableStore, log: DataFrame, keys: dict[str, list[str]], boundary: int | None = None, acknowledged: int = -1, batch: tuple[str, int] | None = None, schemas: list[str] | None = None) -> dict:
    """Apply whole committed transactions of a batch to all tables and publish them in one manifest.

    A transaction counts as whole once its row of action ``commit`` is there; rollbacks and open ones change nothing. Positions
    up to the manifest's are skipped, so a batch that comes again does nothing; with its stream's name and number in ``batch`` its rows are not even
    kept again. Rows that come twice count once. What can't be applied yet is kept (Pending) and joins a later batch. The first DDL statement
    that is not yet acknowledged, or row conflict, stops before its transaction, for all tables alike. A stream brings a batch that stopped once
    more, then with the schema after the statement, so nothing of it is kept before. Keyless tables have an empty key list.

    A table without changes in the batch keeps its files; of a bucketed one only changed rows are written (TableStore).
    """
    now = store.latest()
    position, state = now["position"], now["state"]
    acknowledged = max(acknowledged, state.get("acknowledged", -1))
    pending, numbers = Pending(store, list(state.get("pending", []))), dict(state.get("batches", {}))
    log = cdc.after_position(scoped(log, schemas), position)
    if batch and numbers.get(batch[0], -1) >= batch[1]:
        log = log.limit(0)
    fresh = summary(log)
    known = pending.summaries(fresh).unionByName(fresh).where(F.col("txn_seq") > position).groupBy("txn_seq").agg(F.max("outcome").alias("outcome"), F.bool_or("changes").alias("changes"), F.bool_or("ddl").alias("ddl"))
    known = cdc.up_to(known, boundary).persist()
    try:
        # An open transaction holds back all that follow, and so does a statement that nobody acknowledged.
        walls = known.agg(F.min(F.when(F.col("changes") & F.col("outcome").isNull(), F.col("txn_seq"))).alias("open"), F.min(F.when(F.col("ddl") & (F.col("txn_seq") > acknowledged), F.col("txn_seq"))).alias("ddl")).first()

        def last_before(*stops: int | None) -> int | None:
            stop = min((s for s in stops if s is not None), default=None)
            ended = known.where(F.col("outcome").isNotNull())
            return (ended if stop is None else ended.where(F.col("txn_seq") < stop)).agg(F.max("txn_seq").alias("p")).first()["p"]

        to, bad, staged, used = last_before(walls["open"], walls["ddl"]), None, {}, []
        if to is not None:
            waiting = pending.changes(log.schema, position, to)
            rows = cdc.up_to(log, to) if waiting is None else cdc.up_to(log, to).unionByName(waiting)
            rows = rows.where(F.col("action").isin(*CHANGES) & F.col("table_name").isin(list(keys))).dropDuplicates(["txn_seq", "op_seq", "table_name", "action"])
            rows = cdc.committed(rows, known.where(F.col("outcome").isNotNull()).select("txn_seq", "outcome"))
            rows = rows.select("txn_seq", "op_seq", "table_name", "action", "before", "after").persist()
            used.append(rows)
            touched = {r[0] for r in rows.select("table_name").distinct().collect()}
            logs = {t: rows.where(F.col("table_name") == t).drop("table_name") for t in keys if t in touched}
            for t in (t for t in logs if not keys[t]):
                wrong = cdc.conflicts(_held(store, t, now, logs[t]), logs[t]).agg(F.min_by(F.struct("txn_seq", F.lit(t).alias("table_name"), "action", "row_hash"), F.struct("txn_seq", "op_seq")).alias("c")).first()["c"]
                bad = min(filter(None, (bad, wrong)), key=lambda c: (c["txn_seq"], c["table_name"]), default=None)
            if bad:
                to = last_before(bad["txn_seq"])
        if to is not None:
            for t, part in logs.items():
                staged[t] = _staged(store, t, now, cdc.up_to(part, to) if bad else part, keys[t])
        to = position if to is None else int(to)
        paused = bool(bad) or walls["ddl"] is not None
        if not (batch and paused):
            rest = cdc.after_position(log, to)
            if rest.limit(1).count():
                pending.add(rest)
            if batch:
                numbers[batch[0]] = max(batch[1], numbers.get(batch[0], -1))
        parts = pending.after(to)
        if staged or to != position or parts != state.get("pending", []) or numbers != state.get("batches", {}):
            now = store.commit(now, staged, to, pending=parts, batches=numbers, acknowledged=acknowledged)
    finally:
        for df in (known, *used):
            df.unpersist()
    if bad:
        raise Paused("row_conflict", now["position"], bad.asDict())
    if walls["ddl"] is not None:
        raise Paused("ddl", now["position"], {"txn_seq": walls["ddl"]})
    return now


def _held(store: TableStore, table: str, now: dict, log: DataFrame) -> DataFrame:
    """What a keyless table holds of the rows that a log takes away: of a bucketed one, their buckets alone."""
    t = store.entry(table, now)
    if isinstance(t, str):
        return store.read(table, now)
    leaves = cdc.keyless_deltas(log).where("d < 0").select(cdc.row_key(t.schema.names, "row").alias("rk"))
    return store.merged(t, [r[0] for r in leaves.select(t.bucket(F.xxhash64("rk"))).distinct().collect()])


def _staged(store: TableStore, table: str, now: dict, log: DataFrame, key: list[str]) -> object:
    t = store.entry(table, now)
    if isinstance(t, str):
        base = store.read(table, now)
        return store.stage(table, cdc.apply_keyed(base, log, key) if key else cdc.apply_keyless(base, log))
    if key:
        return store.stage_changes(table, t, cdc.last_rows(log, key, t.schema.names), now["version"] + 1)
    return store.stage_bag(table, t, cdc.keyless_net(log, t.schema.names))


def freeze_locators(store: TableStore, chosen: DataFrame) -> dict[str, list[str]]:
    """Keys by table that a job applies with, for good: choose_locators() of its first start, kept in the manifest.

    A later start brings what the rules choose now; where that differs from the frozen locator, or the rules have another version, the job pauses
    until somebody looks at it.
    """
    now, spark = store.latest(), store.spark
    cols = "table_name string, strategy string, index_name string, columns array<string>, version int"
    old = [(t, *x) for t, x in now["state"].get("locators", {}).items()]
    both = cdc.frozen_locators(spark.createDataFrame(old, cols), chosen).collect()
    if problems := {r["table_name"]: r["problem"] for r in both if r["problem"]}:
        raise Paused("locators", now["position"], problems)
    kept = {r["table_name"]: [r["strategy"], r["index_name"], r["columns"], r["version"]] for r in both}
    if kept != now["state"].get("locators", {}):
        store.commit(now, {}, now["position"], locators=kept)
    return {r["table_name"]: list(r["columns"]) for r in both}


def stream(spark: SparkSession, store: TableStore, path: str | DataFrame, schema: StructType, keys: dict[str, list[str]], checkpoint: str, on_batch: Callable[[dict], None] | None = None, every: str | None = None, control: Control | None = None, hooks: Hooks | None = None, schemas: list[str] | None = None, locators: DataFrame | None = None) -> StreamingQuery:
    """Follow a folder of change files, or another streamed log, and apply what has come; the manifest, not the stream's checkpoint, says what is applied.

    Without ``every`` the stream ends with what is there, with it (``5 seconds``) it looks again until ``control`` asks for a pause. A micro-batch
    is read once, whatever the number of its tables, and kept on the executors for the time of its apply. ``schemas`` names the source schemas
    whose changes and statements count. With ``locators`` (choose_locators()) the keys are those frozen at the first start. After a pause for DDL,
    TableStore.acknowledge() and a new start with the row's new schema go on where it stopped.
    """
    if locators is not None:
        keys = freeze_locators(store, locators)

    def each(rows: DataFrame, number: int) -> None:
        if control and control.asked.is_set():
            raise Paused("manual", store.latest()["position"])
        rows = rows.persist()
        try:
            done = apply_batch(store, rows, keys, control.boundary if control else None, batch=(checkpoint, number), schemas=schemas)
        except Paused as e:
            if hooks:
                hooks.paused(e.reason, e.position, e.details)
            raise
        finally:
            rows.unpersist()
        if control:
            control.position = done["position"]
        if on_batch:
            on_batch(done)
        if hooks:
            hooks.applied(done)

    source = path if isinstance(path, DataFrame) else spark.readStream.schema(schema).json(path)
    writer = source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


@dataclass
class Control:
    """Asks a running stream to pause between batches, so that no transaction is cut, and says how far it has come."""

    boundary: int | None = None
    position: int = -1
    asked: threading.Event = field(default_factory=threading.Event)

    def pause(self, query: StreamingQuery, seconds: float = 300.0) -> bool:
        """Let the batch at hand end, then stop; False if it took longer, and the version before stays the last."""
        self.asked.set()
        end = time.monotonic() + seconds
        while query.isActive and query.status["isTriggerActive"] and time.monotonic() < end:
            time.sleep(0.1)
        calm = not (query.isActive and query.status["isTriggerActive"])
        query.stop()
        return calm


def head_of(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One row ``head``: the last transaction that has ended in the folder, which the applied position is held against."""
    return spark.read.schema(schema).json(path).where("action in ('commit', 'rollback')").agg(F.max("txn_seq").alias("head"))
