"""Catalog relations as DataFrames, whatever database they come from."""

from __future__ import annotations

import fnmatch
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def columns_of(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, position, column_name, data_type, nullable`` from schemas; no table is read."""
    rows = [(t, i, f.name, f.dataType.simpleString(), f.nullable) for t, df in tables.items() for i, f in enumerate(df.schema)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string, nullable boolean")


def ordered_group(df: DataFrame, by: list[str], position: str, value: str, name: str) -> DataFrame:
    """Values of each group in their position's order, as keys and indexes list their columns."""
    return df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(position, value))), lambda x: x[value]).alias(name))


def glob_pattern(glob: str) -> str | None:
    """Anchored pattern of a file glob: * and ? stay within a path part; None for a malformed one, which matches nothing."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\":
            if i + 1 == len(glob):
                return None
            i += 1
            out += re.escape(glob[i])
        elif c == "[":
            end = glob.find("]", i + 2 if glob[i + 1 : i + 2] != "^" else i + 3)
            if end < 0:
                return None
            out += "[" + glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def filter_tables(df: DataFrame, mode: str, patterns: str = "", col: str = "table_name") -> DataFrame:
    """all, include or exclude by comma-separated globs; another mode selects nothing."""
    if mode == "all":
        return df
    found = [p for p in (glob_pattern(x.strip()) for x in patterns.split(",") if x.strip()) if p]
    hit = reduce(lambda a, b: a | b, [F.col(col).rlike(p) for p in found], F.lit(False))
    return df.where(hit) if mode == "include" else df.where(~hit) if mode == "exclude" else df.where(F.lit(False))


def exact_tables(catalog: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The wanted tables that exist, and those that do not."""
    return catalog.join(wanted, "table_name", "left_semi"), wanted.join(catalog, "table_name", "left_anti")


def next_values(auto: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """``table_name, column_name, start_value``: one more than the greatest value, 1 for an empty table."""
    return reduce(
        DataFrame.unionByName,
        [df.agg((F.coalesce(F.max(c), F.lit(0)) + 1).cast("long").alias("start_value")).select(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), "start_value") for (t, c), df in auto.items()],
    )


def trigger_sequence(body: Column) -> Column:
    """Name of the sequence that a trigger's body draws from."""
    return F.upper(F.regexp_extract(body, r'(?is)"?([\w$#]+)"?\s*\.\s*nextval', 1))


def merge_default(left: DataFrame, right: DataFrame, on: list[str], value: str, default) -> DataFrame:
    """Left rows with the other relation's value, or a default: two cheap catalog scans instead of one slow join at the source."""
    return left.join(right, on, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def foreign_keys(parts: DataFrame) -> DataFrame:
    """One row a key with local and referenced columns paired by position; actions with blanks for underscores."""
    pair = F.array_sort(F.collect_list(F.struct("position", "column_name", "ref_column")))
    grouped = parts.groupBy("table_name", "fk_name", "ref_table").agg(pair.alias("p"), F.replace(F.upper(F.first("on_delete")), F.lit("_"), F.lit(" ")).alias("on_delete"))
    return grouped.select("table_name", "fk_name", "ref_table", F.transform("p", lambda x: x["column_name"]).alias("columns"), F.transform("p", lambda x: x["ref_column"]).alias("ref_columns"), "on_delete")


def unpair(df: DataFrame, a: str, b: str, *keep: str) -> DataFrame:
    """Rows of two parallel arrays, by position."""
    return df.select(*keep, F.posexplode(F.arrays_zip(a, b)).alias("position", "z")).select(*keep, "position", F.col(f"z.{a}").alias(a), F.col(f"z.{b}").alias(b))


def comments(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Comments that are not empty; '' names the table itself."""
    both = tables.select("table_name", F.lit("").alias("column_name"), "comment").unionByName(columns.select("table_name", "column_name", "comment"))
    return both.where(F.coalesce("comment", F.lit("")) != "")


def routine_source(lines: DataFrame) -> DataFrame:
    """Source of each routine from its numbered lines."""
    return lines.groupBy("owner", "name", "type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "").alias("body"))


def routine_export(routines: DataFrame, triggers: DataFrame) -> DataFrame:
    """``part, type, name, script`` of routines and then triggers, each once, with a heading; sources stay as they are.

    Both: ``owner, name, type, body`` as routine_source() gives them; one that is listed under several owners or times with one body is one.
    """
    rows = routines.withColumn("part", F.lit(1)).unionByName(triggers.withColumn("part", F.lit(2))).where(F.trim(F.coalesce("body", F.lit(""))) != "")
    one = rows.dropDuplicates(["part", "type", "name", "body"])
    return one.select("part", "type", "name", F.concat(F.lit("-- "), "type", F.lit(": "), "name", F.lit("\n"), "body").alias("script"))


def eligible_unique(parts: DataFrame) -> DataFrame:
    """Unique indexes whose every part is a whole, not nullable, plain column in a B-tree, smallest first."""
    fine = F.every(F.col("column_name").isNotNull() & F.col("prefix_length").isNull() & ~F.col("nullable") & (F.upper("index_type") == "BTREE"))
    cols = F.transform(F.array_sort(F.collect_list(F.struct("position", "column_name"))), lambda x: x["column_name"])
    return parts.where("is_unique").groupBy("table_name", "index_name").agg(fine.alias("ok"), cols.alias("columns")).where("ok").drop("ok").orderBy("table_name", F.size("columns"), "index_name")


# Schemas that belong to the database itself.
SYSTEM_SCHEMAS = {
    "mysql": ("information_schema", "mysql", "performance_schema", "sys"), "postgres": ("information_schema", "pg_catalog", "pg_toast"),
    "oracle": ("sys", "system", "outln", "dbsnmp", "xdb"), "sqlserver": ("information_schema", "sys", "guest"), "dameng": ("sys", "sysdba", "sysauditor", "syssso", "ctisys"),
}


def namespaces(tables: DataFrame, kind: str) -> DataFrame:
    """``schema_name, tables`` of a catalog's ``schema_name, table_name`` (null for an empty schema), without those of the database itself."""
    own = ~F.lower("schema_name").isin(*SYSTEM_SCHEMAS.get(kind, ())) & ~F.lower("schema_name").startswith("pg_temp")
    return tables.where(own).groupBy("schema_name").agg(F.count("table_name").alias("tables"))


def schema_exists(tables: DataFrame, name: str, exact: bool = True) -> DataFrame:
    """One row ``exists``; other databases than case-sensitive ones compare without case."""
    same = F.col("schema_name") == name if exact else F.lower("schema_name") == name.lower()
    return tables.agg(F.coalesce(F.bool_or(same), F.lit(False)).alias("exists"))


def views_of(views: DataFrame, schema: str) -> DataFrame:
    """``view_name, body`` of a schema's views: the schema's name before its own objects goes, with or without quotes."""
    quoted = rf"(?i)(?:`{re.escape(schema)}`|\"{re.escape(schema)}\"|\b{re.escape(schema)})\."
    return views.where(F.col("schema_name") == schema).select("view_name", F.regexp_replace(F.trim("body"), quoted, "").alias("body"))


def trigger_counts(tables: DataFrame, triggers: DataFrame) -> DataFrame:
    """``table_name, triggers`` for each table, 0 for none."""
    return merge_default(tables.select("table_name"), triggers.groupBy("table_name").agg(F.count("*").alias("triggers")), ["table_name"], "triggers", 0)


def stream_tables(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """What a stream must know of each table: ``table_name, columns, key_places, auto_places, generated``; places count from 0.

    columns: ``table_name, position, column_name, auto, generated``; keys: ``table_name, position, column_name``.
    """
    names = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("position", c))), lambda x: x[c])
    t = columns.groupBy("table_name").agg(names("column_name").alias("columns"), names("auto").alias("a"), names("generated").alias("g"))
    t = t.join(keys.groupBy("table_name").agg(names("column_name").alias("k")), "table_name", "left")
    places = lambda flags: F.filter(F.transform(flags, lambda f, i: F.when(f, i)), lambda i: i.isNotNull())
    at = F.transform(F.coalesce("k", F.array().cast("array<string>")), lambda k: (F.array_position("columns", k) - 1).cast("int"))
    return t.select("table_name", "columns", at.alias("key_places"), places(F.col("a")).alias("auto_places"), places(F.col("g")).alias("generated"))


def unique_sets(parts: DataFrame) -> DataFrame:
    """``table_name, columns`` (sorted) of unique indexes that hold for every row at once: valid, immediate, whole, of columns alone."""
    fine = parts.where("is_unique and is_valid and is_immediate and not is_partial and not is_expression")
    return fine.groupBy("table_name", "index_name").agg(F.array_sort(F.collect_set("column_name")).alias("columns")).select("table_name", "columns").distinct()


def index_columns(parts: DataFrame) -> DataFrame:
    """``table_name, index_name, is_unique, columns`` of all indexes but those that the primary key brings along."""
    return ordered_group(parts.where("not is_primary"), ["table_name", "index_name", "is_unique"], "position", "column_name", "columns")


def matches(name: str, globs: list[str]) -> bool:
    """filter_tables() for one name on the driver."""
    return any(re.match(p, name) for g in globs if (p := glob_pattern(g)) is not None) or any(fnmatch.fnmatchcase(name, g) for g in globs if g == name)
