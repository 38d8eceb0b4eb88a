"""Checks before and after a stream starts, its end, and reports as text."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Source settings that a row-based stream needs.
NEEDED = {"log_bin": ("ON", "1"), "binlog_format": ("ROW",), "binlog_row_image": ("FULL",)}
GRANTS = ("SELECT", "REPLICATION SLAVE", "REPLICATION CLIENT")


def settings_problems(settings: DataFrame) -> DataFrame:
    """``name, value, problem`` of needed settings that are missing or have another value."""
    spark = settings.sparkSession
    need = spark.createDataFrame([(k, list(v)) for k, v in NEEDED.items()], "name string, wanted array<string>")
    got = settings.select(F.lower("name").alias("name"), F.upper(F.trim("value")).alias("value"))
    both = need.join(got, "name", "left")
    return both.where(F.col("value").isNull() | ~F.array_contains("wanted", F.col("value"))).select("name", F.coalesce("value", F.lit("")).alias("value"), F.when(F.col("value").isNull(), "missing").otherwise("wrong").alias("problem"))


def privileges(grants: DataFrame) -> DataFrame:
    """``privilege, scope`` of grant lines ``GRANT a, b (columns) ON scope TO user``; a line of another form holds none."""
    line = F.regexp_replace(F.upper(F.trim("line")), r"\([^)]*\)|`", "")
    part = F.regexp_extract(line, r"^GRANT\s+(.+?)\s+ON\s+(?:TABLE\s+)?(\S+)\s+TO\s", 1), F.regexp_extract(line, r"^GRANT\s+(.+?)\s+ON\s+(?:TABLE\s+)?(\S+)\s+TO\s", 2)
    rows = grants.select(F.explode(F.split(part[0], r"\s*,\s*")).alias("privilege"), part[1].alias("scope")).where("privilege <> ''")
    return rows.select(F.regexp_replace(F.trim("privilege"), r"\s+", " ").alias("privilege"), "scope").distinct()


def missing_grants(grants: DataFrame, needed: tuple[str, ...] = GRANTS) -> DataFrame:
    """Needed privileges that no line grants on everything; ALL PRIVILEGES holds all, one on a single database or table does not count."""
    need = grants.sparkSession.createDataFrame([(g,) for g in needed], "privilege string")
    has = privileges(grants).where("scope = '*.*'").select(F.col("privilege").alias("p"))
    return need.join(has, (F.col("p") == F.col("privilege")) | F.col("p").isin("ALL", "ALL PRIVILEGES"), "left_anti")


def preflight(settings: DataFrame, grants: DataFrame, tables: DataFrame, source_cols: DataFrame, target_cols: DataFrame, retention: int | None, start: str = "", lower: bool = False, reserved: str = "_checkpoint") -> DataFrame:
    """All that is to be known before a stream starts, as one relation ``severity, kind, name, detail``.

    Errors: settings, grants, an unusable start position (``start``: why, or ''), tables that the target lacks or whose columns do not
    fit, and names that the target keeps for itself. Warnings: a log kept for less than three days or an unknown time, and tables without key.
    tables: ``table_name, has_key``; columns as for target_compatibility().
    """
    from .jobs import target_compatibility

    spark = settings.sparkSession
    name = F.lower("table_name") if lower else F.col("table_name")
    row = lambda df, severity, kind, name, detail: df.select(F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), name.alias("name"), detail.alias("detail"))
    none = F.lit("")
    there = target_cols.select(F.col("table_name").alias("t")).distinct()
    wanted = tables.select("table_name", name.alias("t"), "has_key")
    cols = source_cols.withColumn("table_name", name).join(there.select(F.col("t").alias("table_name")), "table_name", "left_semi")
    plain = [("error", "start", "", start)] if start else []
    if (text := retention_warning(retention)) or retention is None:
        plain.append(("warning", "retention", "", text or "unknown"))
    return reduce(DataFrame.unionByName, [
        row(settings_problems(settings), "error", "setting", F.col("name"), F.col("problem")), row(missing_grants(grants), "error", "grant", F.col("privilege"), none),
        row(wanted.join(there, "t", "left_anti"), "error", "missing_table", F.col("table_name"), none), row(target_compatibility(cols, target_cols), "error", "column", F.concat_ws(".", "table_name", "column_name"), F.col("problem")),
        row(wanted.where(F.col("t") == reserved), "error", "reserved_name", F.col("table_name"), none), row(tables.where("not has_key"), "warning", "no_key", F.col("table_name"), none),
        spark.createDataFrame(plain, "severity string, kind string, name string, detail string"),
    ])


def retention_warning(seconds: int | None) -> str:
    """A log kept for less than 72 hours is a risk; 0 is for ever, None unknown."""
    return f"log kept for {seconds / 3600:.1f} hours only" if seconds and seconds < 72 * 3600 else ""


def strict_passes(review: DataFrame, failed: DataFrame) -> DataFrame:
    """One row ``passes``: no table excluded and no object failed."""
    return review.agg(F.count_if(F.col("stage").isNotNull()).alias("a")).crossJoin(failed.agg(F.count("*").alias("b"))).select(((F.col("a") == 0) & (F.col("b") == 0)).alias("passes"))


def finalise(review: DataFrame, keys: DataFrame) -> DataFrame:
    """``action, name`` of accepting a review: foreign keys of kept tables to excluded ones go, then excluded tables that exist."""
    out = review.where("stage is not null")
    kept = review.where("stage is null").select("table_name")
    gone = keys.join(kept, "table_name", "left_semi").join(out.select(F.col("table_name").alias("ref_table")), "ref_table", "left_semi")
    return gone.select(F.lit("drop_foreign_key").alias("action"), F.col("fk_name").alias("name")).unionByName(out.where("stage <> 'schema'").select(F.lit("drop_table").alias("action"), F.col("table_name").alias("name")))


def latency_samples(ledger: DataFrame, applied: DataFrame, every: int = 100) -> DataFrame:
    """``sequence, ms`` from commit to visibility of every so many inserts with an id; lost ones have null."""
    some = ledger.where((F.col("action") == "insert") & F.col("committed") & F.col("row_id").isNotNull() & (F.col("sequence") % every == 0))
    ms = (F.unix_millis(F.col("visible_at").cast("timestamp")) - F.unix_millis(F.col("committed_at").cast("timestamp"))).alias("ms")
    return some.join(applied.select("table_name", "row_id", "visible_at"), ["table_name", "row_id"], "left").select("sequence", ms)


def cutover(applied: int, head: int, boundary: int, counts: DataFrame) -> DataFrame:
    """One row: ``state`` of a cutover: draining until the boundary is applied, then ready, with warnings if counts differ, blocked if the source moved on."""
    ok = F.coalesce(F.bool_and("matches"), F.lit(True))
    state = F.when(F.lit(head > boundary), "cutover_blocked").when(F.lit(applied < boundary), "cutting_over").when(ok, "ready_to_cutover").otherwise("ready_with_warnings")
    return counts.agg(state.alias("state"))


def count_errors(counts: DataFrame) -> DataFrame:
    """``table_name, error`` of tables whose counts differ or could not be had; a count that failed is null and its reason is in ``failure``."""
    why = F.when(F.col("src_rows").isNull() | F.col("dst_rows").isNull(), F.coalesce("failure", F.lit("not counted"))).when(F.col("src_rows") != F.col("dst_rows"), F.format_string("source=%d target=%d", "src_rows", "dst_rows"))
    return counts.withColumn("error", why).where("error is not null").select("table_name", "error")


def report_lines(items: DataFrame, counts: DataFrame, triggers: DataFrame | None = None) -> DataFrame:
    """A job's report as lines of text: ``section, part, name, line``, to be read in that order.

    Section 1 has the totals of each category (of triggers their number alone, which are not moved); 2 each failed object with its reason and
    its DDL, indented; 3 the tables whose counts differ, by how much; 4 the counts of all. items: ``category, name, ok, error, ddl``; counts:
    ``table_name, src_rows, dst_rows, matches``; triggers: ``table_name, triggers``.
    """
    line = lambda df, section, part, name, text: df.select(F.lit(section).alias("section"), part.alias("part"), name.alias("name"), text.alias("line"))
    none = F.lit("")
    totals = items.groupBy("category").agg(F.count("*").alias("n"), F.count_if("ok").alias("good"))
    ddl = F.when(F.trim(F.coalesce("ddl", none)) == "", "  no DDL").otherwise(F.regexp_replace(F.concat(F.lit("DDL: "), "ddl"), r"(?m)^", "  "))
    failed = items.where("not ok")
    plain = F.format_string("%s: %d source, %d target", "table_name", "src_rows", "dst_rows")
    parts = [
        line(totals, 1, F.col("category"), none, F.format_string("%s: %d in all, %d done, %d failed", "category", "n", "good", F.col("n") - F.col("good"))),
        line(failed, 2, F.col("category"), F.col("name"), F.concat_ws("\n", F.concat("category", F.lit(" "), "name"), F.concat(F.lit("  reason: "), F.coalesce("error", none)), ddl)),
        line(counts.where("not matches"), 3, F.col("table_name"), none, F.concat(plain, F.format_string(", difference %d", F.col("dst_rows") - F.col("src_rows")))),
        line(counts, 4, F.col("table_name"), none, F.concat(plain, F.when(F.col("matches"), "").otherwise(" (differs)"))),
    ]
    if triggers is not None:
        parts.append(line(triggers.agg(F.coalesce(F.sum("triggers"), F.lit(0)).cast("long").alias("n")), 1, F.lit("~triggers"), none, F.format_string("triggers: %d in all, not moved", "n")))
    return reduce(DataFrame.unionByName, parts)


def export_report(lines: DataFrame, path: str) -> None:
    """The report as one text file in a folder: sorted lines of a job's objects and tables, which are as many as its catalog has."""
    lines.repartitionByRange(1, "section", "part", "name").sortWithinPartitions("section", "part", "name").select("line").write.text(path)


def report_json(report: DataFrame, counts: DataFrame) -> str:
    """A job's report; both frames have a row for each category or table of the job."""
    return json.dumps({"categories": [r.asDict() for r in report.orderBy("category").collect()], "row_counts": [r.asDict() for r in counts.orderBy("table_name").collect()]}, ensure_ascii=False, sort_keys=True)


def report_markdown(text: str) -> str:
    r = json.loads(text)
    lines = ["# Report", "", "| category | total | success | failed |", "|-|-|-|-|", *[f"| {c['category']} | {c['total']} | {c['success']} | {c['failed']} |" for c in r["categories"]]]
    lines += ["", "| table | source | target | difference |", "|-|-|-|-|", *[f"| {t['table_name']} | {t['src_rows']} | {t['dst_rows']} | {t['dst_rows'] - t['src_rows']} |" for t in sorted(r["row_counts"], key=lambda t: t["matches"])]]
    return "\n".join([*lines, *[f"- failed {c['category']}: {n}" for c in r["categories"] for n in c["failed_items"]]])
