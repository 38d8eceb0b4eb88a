"""Lists of jobs and logs: search, pages, cursors, review of a bootstrap, failed objects, retention."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import durable
from ..sources.store import Conflict, TableStore
from .scan import running

# States of a job by group, and the order of failed objects in an export.
STATUS_GROUPS = {
    "active": ["initializing", "snapshot", "catching_up", "running", "reconnecting", "pausing", "cutting_over", "validating"],
    "attention": ["paused_manual", "paused_restart", "paused_ddl", "paused_row_conflict", "paused_bootstrap_review", "ready_to_cutover", "ready_with_warnings", "cutover_blocked", "failed"],
    "completed": ["stopped"], "aborted": ["aborted"],
}
FAILED_ORDER = ["table", "primary_key", "sequence", "index", "foreign_key", "view", "comment", "data", "row_count", "cdc_compatibility"]
STAGES = ["schema", "data", "primary_key", "row_count", "cdc_compatibility"]
STAGE_OF = {"table": "schema", "data": "data"}  # all others fail with the objects
# Heads of the errors in which a database quotes a value of a row after a colon.
QUOTING = (
    "invalid input",
    "out of range",
    "incorrect",
    r"line \d+, column",
)
HIDDEN = "<redacted>"
#: A statement up to its semicolon; quoted text, dollar quotes and comments hide semicolons, an opening without end hides none.
STATEMENT = r"""(?s)(?>'(?:''|[^'])*'|"(?:""|[^"])*"|(\$\w*\$).*?\1|--[^\n]*|/\*.*?\*/|[^;])+;?"""
DESTRUCTIVE = ("DROP", "TRUNCATE", "DELETE")


def first_of(*cols: str) -> Column:
    """The first text that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols], F.lit(""))


def search(df: DataFrame, keyword: str, columns: list[Column]) -> DataFrame:
    """Rows in which one of the texts holds the keyword in either case; a blank keyword keeps all."""
    word = keyword.strip().lower()
    return df.where(reduce(lambda a, b: a | b, [F.lower(c).contains(word) for c in columns])) if word else df


def in_group(df: DataFrame, group: str, col: str = "status") -> DataFrame:
    """Rows of a group of states; an unknown group keeps all."""
    return df.where(F.col(col).isin(STATUS_GROUPS[group])) if group in STATUS_GROUPS else df


def page_with_total(df: DataFrame, key: str, page: int, size: int) -> tuple[DataFrame, DataFrame]:
    """The page (newest first) and the one-row total."""
    return df.orderBy(F.desc(key)).offset((page - 1) * size).limit(size), df.agg(F.count("*").alias("total"))


def keyset_page(df: DataFrame, key: str, before: int | None = None, size: int = 50) -> DataFrame:
    """Newest rows before a key, at most 100."""
    rows = df if not before else df.where(F.col(key) < before)
    return rows.orderBy(F.desc(key)).limit(size if 0 < size <= 100 else 50)


def cursor_page(df: DataFrame, key: str, size: int, after: int | None = None, before: int | None = None) -> DataFrame:
    """A page of a log in ascending order with ``has_older, has_newer``: the tail, or next to a key. Whether there is more is asked of one row each, by the key."""
    if after is not None:
        rows = df.where(F.col(key) > after).orderBy(key).limit(size)
    else:
        rows = (df if before is None else df.where(F.col(key) < before)).orderBy(F.desc(key)).limit(size)
    lo, hi = rows.agg(F.min(key), F.max(key)).first()  # of one page
    beyond = lambda c: F.lit(lo is not None and not df.where(c).limit(1).isEmpty())
    return rows.withColumns({"has_older": beyond(F.col(key) < lo), "has_newer": beyond(F.col(key) > hi)}).orderBy(key)


def bounded(df: DataFrame, order: list[str], most: int = 1000) -> DataFrame:
    """At most so many rows, and whether there were more: one row beyond is read, not the whole result."""
    top = df.orderBy(*order).limit(most + 1)
    n = top.agg((F.count("*") > most).alias("truncated"))
    return top.orderBy(*order).limit(most).crossJoin(F.broadcast(n))


def visible_to(df: DataFrame, user: int, admin: bool = False, owner: str = "owner_id") -> DataFrame:
    """Rows of a user; an administrator sees all."""
    return df if admin else df.where(F.col(owner) == user)


def of_origin(df: DataFrame, origin: str, batch: str = "batch_id") -> DataFrame:
    """``single``: jobs of their own, ``batch``: those that a batch made; another word keeps all."""
    alone = F.coalesce(F.col(batch), F.lit("")) == ""
    return df.where(alone) if origin == "single" else df.where(~alone) if origin == "batch" else df


def retained(df: DataFrame, at: str, now: str, days: int) -> DataFrame:
    return df.where(F.col(at) >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))


def retained_logs(logs: DataFrame, jobs: DataFrame, now: str, days: int) -> DataFrame:
    """Log lines without those of jobs that were stopped or aborted so many days ago; failed and paused jobs may go on and keep theirs.

    jobs: ``job, status, finished_at``.
    """
    old = jobs.where(F.col("status").isin("stopped", "aborted") & (F.col("finished_at") < F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))))
    return logs.join(old.select("job"), "job", "left_anti")


def journal(log: DataFrame, seq: str = "seq", text: str = "line", job: str = "job", keep: Callable[[DataFrame], DataFrame] = durable) -> DataFrame:
    """Level of each line by its tag, and the phase that the last heading of its job set, whatever part of all lines one job has written."""
    # Tags.
    tag = F.lower(F.regexp_extract(text, r"\[(INFO|DDL|DATA|INDEX|WARN|ERROR|DONE)\]", 1))
    phase = F.nullif(F.regexp_extract(text, r"=== Phase (\d+):", 1), F.lit(""))
    heading = F.when(phase.isNotNull(), F.struct(F.col(seq).alias("seq"), phase.alias("phase")))
    found = running(log, [job], [seq], {"_heading": ("max", heading)}, keep)
    return found.withColumn("level", F.when(tag == "", "info").otherwise(tag)).withColumn("phase", F.col("_heading.phase")).drop("_heading")


def redact(c: Column) -> Column:
    """Row values hidden in error texts of databases: quoted after a known head, or in parentheses after a key's columns."""
    quoted = F.regexp_replace(c, rf"(?i)\b((?:{'|'.join(QUOTING)})\b[^:\n]*:\s*)(?:\"[^\"\n]*\"|'[^'\n]*')", f'$1"{HIDDEN}"')
    return F.regexp_replace(quoted, r"(?i)\b(key \([^\n]*?\)=)\([^\n]*?\)(?=[\s.,;]|$)", f"$1({HIDDEN})")


def review(expected: DataFrame, issues: DataFrame) -> DataFrame:
    """``table_name, stage, error`` of every expected table: its gravest issue, or null if it is effective."""
    rank = F.element_at(F.create_map(*[x for i, s in enumerate(STAGES) for x in (F.lit(s), F.lit(i))]), F.col("stage"))
    worst = issues.groupBy("table_name").agg(F.min_by(F.struct("stage", "error"), F.struct(rank, "error")).alias("i"))
    stage = F.when(F.col("i.stage") == "primary_key", "cdc_compatibility").otherwise(F.col("i.stage"))
    return expected.join(worst, "table_name", "left").select("table_name", stage.alias("stage"), F.col("i.error").alias("error"))


def failed_objects(items: DataFrame) -> DataFrame:
    """Distinct failed objects."""
    return items.dropDuplicates(["category", "name", "error", "ddl", "stage"])


def failures_of(expected: DataFrame, items: DataFrame, counts: DataFrame, compatibility: DataFrame, lower: bool = False) -> DataFrame:
    """``category, name, error, ddl, stage`` of all that failed: the report's items, then what the counts and the target's columns say.

    items: ``category, name, error, ddl`` of failed objects; counts: ``table_name, src_rows, dst_rows, matches`` by target name;
    compatibility: ``table_name, error``. A table whose creation, data or key failed is not listed again for its counts or columns.
    """
    target = F.lower("table_name") if lower else F.col("table_name")
    stages = F.coalesce(F.element_at(F.create_map(*[x for k, v in STAGE_OF.items() for x in (F.lit(k), F.lit(v))]), F.col("category")), F.lit("objects"))
    reported = failed_objects(items.select("category", "name", "error", "ddl", stages.alias("stage")))
    wanted = expected.select("table_name", target.alias("target"))
    lost = reported.where(F.col("category").isin("table", "data")).select(F.col("name").alias("table_name"))
    lost = lost.unionByName(wanted.join(reported.where("category = 'primary_key'").select(F.col("name").alias("target")), "target", "left_semi").select("table_name"))
    rest = wanted.join(lost, "table_name", "left_anti")
    seen = rest.join(counts.select(F.col("table_name").alias("target"), "src_rows", "dst_rows", "matches"), "target", "left")
    text = F.when(F.col("matches").isNull(), "rows were not counted").otherwise(F.format_string("rows differ: source=%d target=%d", "src_rows", "dst_rows"))
    off = seen.where("matches is null or not matches").select(F.lit("row_count").alias("category"), F.col("table_name").alias("name"), text.alias("error"))
    odd = rest.join(compatibility.where("error <> ''"), "table_name").select(F.lit("cdc_compatibility").alias("category"), F.col("table_name").alias("name"), "error")
    return reported.unionByName(off.unionByName(odd).withColumns({"ddl": F.lit(None).cast("string"), "stage": F.lit("validation")}))


def object_warnings(items: DataFrame) -> DataFrame:
    """``message`` for each failed object that does not keep its table from being followed."""
    late = items.where(F.col("category").isin("index", "foreign_key", "sequence", "comment", "view"))
    return late.select(F.format_string("%s failed [%s]: %s", F.replace("category", F.lit("_"), F.lit(" ")), "name", redact(F.col("error"))).alias("message"))


def manifest_hash(effective: DataFrame, excluded: DataFrame, position: str) -> DataFrame:
    """One row: a SHA-256 of scope and position that no order of rows changes; excluded: ``table_name, stage, error, ddl``."""
    a = effective.agg(F.array_sort(F.collect_list("table_name")).alias("effective"))
    b = excluded.agg(F.array_sort(F.collect_list(F.struct("table_name", "stage", "error", "ddl"))).alias("excluded"))
    return a.crossJoin(b).select(F.sha2(F.to_json(F.struct("effective", "excluded", F.lit(position).alias("position"))), 256).alias("manifest_hash"))


def exclusions(selected: DataFrame, missing: DataFrame, requested: DataFrame) -> DataFrame:
    """``table_name, outcome`` of excluding tables that the target lacks.

    effective, excluded or unresolved for selected tables; duplicate, out_of_scope or not_missing for requests that are errors.
    """
    req = requested.groupBy("table_name").agg(F.count("*").alias("n"))
    sel = selected.select("table_name", F.lit(True).alias("s"))
    mis = missing.select("table_name", F.lit(True).alias("m"))
    all_ = sel.join(req, "table_name", "full").join(mis, "table_name", "left")
    of = F.when(F.col("s").isNull(), F.array(F.lit("out_of_scope"))).when(F.col("m").isNull() & F.col("n").isNotNull(), F.array(F.lit("effective"), F.lit("not_missing"))).when(F.col("m").isNull(), F.array(F.lit("effective"))).when(F.col("n").isNull(), F.array(F.lit("unresolved"))).otherwise(F.array(F.lit("excluded")))
    of = F.when(F.col("n") > 1, F.concat(of, F.array(F.lit("duplicate")))).otherwise(of)
    return all_.select("table_name", F.explode(of).alias("outcome"))


def target_compatibility(source_cols: DataFrame, target_cols: DataFrame) -> DataFrame:
    """Problems of target tables: columns that are missing, and extra ones that an insert can't leave out."""
    absent = source_cols.join(target_cols.select("table_name", "column_name"), ["table_name", "column_name"], "left_anti").select("table_name", "column_name", F.lit("missing").alias("problem"))
    extra = target_cols.where("not nullable and not has_default and not is_identity").join(source_cols.select("table_name", "column_name"), ["table_name", "column_name"], "left_anti").select("table_name", "column_name", F.lit("required").alias("problem"))
    return absent.unionByName(extra)


def key_compatibility(locators: DataFrame, target_sets: DataFrame) -> DataFrame:
    """``table_name, problem`` of tables whose rows are found by columns that no unique constraint of the target holds; whole rows need none.

    locators: ``table_name, strategy, columns``; target_sets: ``table_name, columns``; sets compare without order.
    """
    have = target_sets.select("table_name", F.array_sort("columns").alias("c")).distinct()
    need = locators.where("strategy <> 'full_row'").select("table_name", F.array_sort("columns").alias("c"))
    return need.join(have, ["table_name", "c"], "left_anti").select("table_name", F.concat(F.lit("not unique: "), F.array_join("c", ", ")).alias("problem"))


def retention_seconds(auto_purge: str | None, seconds: str | None, days: str | None) -> int | None:
    """How long the source keeps its log: 0 for ever, None unknown."""

    def number(x: str | None) -> int | None:
        x = (x or "").strip()
        return int(x) if x.isascii() and x.isdigit() and int(x) < 1 << 63 else None

    if (auto_purge or "").strip().upper() in ("OFF", "0"):
        return 0
    s, d = number(seconds), number(days)
    if s:
        return s
    return None if d is None or d > (2**63 - 1) // 86400 else d * 86400


def repair_script(ddl: Column) -> Column:
    """A script's statements, each with its semicolon; destructive ones are commented out, wherever they stand."""
    text = F.regexp_replace(F.trim(F.regexp_replace(ddl, r"\r\n?", "\n")), r"(?<!;)$", ";")

    def one(s: Column) -> Column:
        s = F.regexp_replace(s, r"^\s+", "")
        word = F.upper(F.regexp_extract(s, r"(?s)^(?:\s|--[^\n]*|/\*.*?\*/)*(\w+)", 1))
        return F.when(word.isin(*DESTRUCTIVE), F.concat(F.lit("-- disabled: destructive\n"), F.regexp_replace(s, r"(?m)^", "-- "))).otherwise(s)

    parts = F.filter(F.regexp_extract_all(text, F.lit(STATEMENT), F.lit(0)), lambda s: F.trim(F.translate(s, "\n\t", "  ")) != "")
    return F.array_join(F.transform(parts, one), "\n")


def failed_ddl(items: DataFrame, keep: Callable[[DataFrame], DataFrame] = durable) -> DataFrame:
    """``seq, category, name, script`` of failed objects in the order they must run, unknown categories last."""
    rank = F.array_position(F.array(*[F.lit(c) for c in FAILED_ORDER]), F.col("category"))
    error = F.concat(F.lit("-- "), F.regexp_replace(redact(F.col("error")), "\n", "\n-- "))
    script = F.concat_ws("\n", error, F.when(F.trim(F.coalesce("ddl", F.lit(""))) != "", repair_script(F.col("ddl"))))
    rows = items.select(F.when(rank == 0, len(FAILED_ORDER) + 1).otherwise(rank).alias("rank"), "category", "name", script.alias("script"))
    return running(rows, [], ["rank", "category", "name", "script"], {"seq": ("sum", F.lit(1))}, keep).select("seq", "category", "name", "script")


# Which state may follow which.
MOVES = {
    "initializing": ["snapshot", "catching_up", "failed", "aborted"], "snapshot": ["catching_up", "paused_bootstrap_review", "failed", "aborted"],
    "paused_bootstrap_review": ["catching_up", "aborted"], "catching_up": ["running", "pausing", "paused_ddl", "paused_row_conflict", "reconnecting", "failed", "aborted"],
    "running": ["pausing", "paused_ddl", "paused_row_conflict", "reconnecting", "cutting_over", "failed", "aborted"], "reconnecting": ["catching_up", "running", "failed", "aborted"],
    "pausing": ["paused_manual", "failed"], "paused_manual": ["catching_up", "aborted"], "paused_restart": ["catching_up", "aborted"], "paused_ddl": ["catching_up", "aborted"],
    "paused_row_conflict": ["catching_up", "aborted"], "cutting_over": ["validating", "cutover_blocked", "failed"], "validating": ["ready_to_cutover", "ready_with_warnings", "cutover_blocked", "failed"],
    "ready_to_cutover": ["stopped", "catching_up"], "ready_with_warnings": ["stopped", "catching_up"], "cutover_blocked": ["catching_up", "aborted"], "failed": ["catching_up", "aborted"], "stopped": [], "aborted": [],
}


def may_move(old: str, new: str) -> bool:
    return new in MOVES.get(old, ())


def move_job(store: TableStore, new: str) -> dict:
    """Set the state of a store's job, if it may go there from the one it has; Conflict if another writer changed anything in between.

    The state is part of the manifest, and a version is published once: of two that read one state, the second fails.
    """
    now = store.latest()
    old = now["state"].get("status", "initializing")
    if not may_move(old, new):
        raise Conflict(f"{old} does not become {new}")
    return store.commit(now, {}, now["position"], status=new)


def line_counts(lines: DataFrame, job: str = "job", seq: str = "seq") -> DataFrame:
    """``job, first_seq, last_seq, lines, lost`` of numbered log lines, batch or streamed: numbers that are missing between the first and last of a job.

    Three counters a job, added up within each task first, so that one job may have all lines. A number that comes twice counts twice.
    """
    per = lines.groupBy(job).agg(F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"), F.count("*").alias("lines"))
    return per.withColumn("lost", F.col("last_seq") - F.col("first_seq") + 1 - F.col("lines"))


def follow_lines(lines: DataFrame, root: str, checkpoint: str, every: str | None = None, job: str = "job", seq: str = "seq") -> tuple[StreamingQuery, StreamingQuery]:
    """Two streams of numbered log lines: lines go to ``root/lines`` in batches, counts of losses to ``root/counts``, a version of them a batch.

    Lines of a micro-batch are one append of Spark's file sink, which knows what it has written; a batch's counts replace the folder of its number, so
    that a batch that comes again is no second version. last_counts() reads the latest.
    """
    trigger = {"processingTime": every} if every else {"availableNow": True}
    kept = lines.writeStream.format("parquet").option("path", f"{root}/lines").option("checkpointLocation", f"{checkpoint}/lines").trigger(**trigger).start()

    def each(counts: DataFrame, number: int) -> None:
        counts.write.mode("overwrite").parquet(f"{root}/counts/batch={number}")

    told = line_counts(lines, job, seq).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", f"{checkpoint}/counts").trigger(**trigger).start()
    return kept, told


def last_counts(spark: SparkSession, root: str, job: str = "job") -> DataFrame:
    """The latest counts of each job."""
    every = spark.read.parquet(f"{root}/counts")
    cols = [c for c in every.columns if c not in (job, "batch")]
    return every.groupBy(job).agg(F.max_by(F.struct(*cols), "batch").alias("x")).select(job, "x.*")
