"""Catalog relations whose tables, columns, keys and indexes are rows of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ddl import DIALECTS, Table
from ..functions.defaults import clean_default
from ..functions.typemap import Column, map_type
from ..operators import cdc, checks, jobs, verify
from ..sources import catalog
from .registry import load, query


def of(spark: SparkSession, sf: str, table: str, *exprs: str) -> DataFrame:
    return load(spark, sf, table).selectExpr(*exprs)


@query("SELECT c_mktsegment AS schema_name, count(*) FILTER (WHERE c_custkey % 4 > 0) AS tables FROM customer WHERE c_custkey % 9 > 1 GROUP BY 1")
def catalog_namespaces(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as tables of their segment's schema; some schemas are the database's own, some rows only say that a schema is there."""
    return catalog.namespaces(of(spark, sf, "customer", "CASE c_custkey % 9 WHEN 0 THEN 'mysql' WHEN 1 THEN 'SYS' ELSE c_mktsegment END AS schema_name", "CASE WHEN c_custkey % 4 > 0 THEN c_name END AS table_name"), "mysql")


@query("""SELECT name, exact, EXISTS (SELECT 1 FROM customer WHERE CASE WHEN exact THEN c_mktsegment = name ELSE lower(c_mktsegment) = lower(name) END) AS "exists"
FROM (VALUES ('building', true), ('building', false), ('BUILDING', true), ('none', false)) v(name, exact)""")
def catalog_schema_exists(spark: SparkSession, sf: str) -> DataFrame:
    tables = of(spark, sf, "customer", "c_mktsegment AS schema_name")
    asked = (("building", True), ("building", False), ("BUILDING", True), ("none", False))
    each = [catalog.schema_exists(tables, name, exact).select(F.lit(name).alias("name"), F.lit(exact).alias("exact"), "exists") for name, exact in asked]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


@query("""SELECT 'v' || p_partkey AS view_name, CASE p_partkey % 3 WHEN 0 THEN 'select x from `t' || p_partkey || '` where b = ''' || p_brand || '''' WHEN 1 THEN 'select x from "t' || p_partkey || '"' ELSE 'select ''app2.x'' from ' || p_type END AS body FROM part WHERE p_size % 2 = 0""")
def catalog_views(spark: SparkSession, sf: str) -> DataFrame:
    body = """CASE p_partkey % 3 WHEN 0 THEN concat('select x from `app`.`t', p_partkey, '` where b = \\'', p_brand, '\\' ') WHEN 1 THEN concat('select x from App."t', p_partkey, '"') ELSE concat('select \\'app2.x\\' from ', p_type) END AS body"""
    return catalog.views_of(of(spark, sf, "part", "CASE WHEN p_size % 2 = 0 THEN 'app' ELSE 'other' END AS schema_name", "concat('v', p_partkey) AS view_name", body), "app")


@query("""WITH c AS (SELECT 'n' || c_nationkey AS table_name, c_name, c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INTEGER AS place FROM customer)
SELECT table_name, list(c_name ORDER BY c_custkey) AS columns, coalesce(list(place ORDER BY c_custkey DESC) FILTER (WHERE c_custkey % 11 = 0), []) AS key_places,
coalesce(list(place ORDER BY place) FILTER (WHERE c_custkey % 5 = 0), []) AS auto_places, coalesce(list(place ORDER BY place) FILTER (WHERE c_custkey % 7 = 0), []) AS generated FROM c GROUP BY table_name""")
def catalog_stream_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as columns of their nation's table; every eleventh is part of its key, last ones first."""
    columns = of(spark, sf, "customer", "concat('n', c_nationkey) AS table_name", "c_custkey AS position", "c_name AS column_name", "c_custkey % 5 = 0 AS auto", "c_custkey % 7 = 0 AS generated", "c_custkey")
    keys = columns.where("c_custkey % 11 = 0").selectExpr("table_name", "-position AS position", "column_name")
    return catalog.stream_tables(columns.drop("c_custkey"), keys)


@query("""SELECT DISTINCT table_name, columns FROM (SELECT 'n' || c_nationkey AS table_name, c_mktsegment, list_sort(list(DISTINCT 'col' || (c_custkey % 13))) AS columns FROM customer
WHERE c_custkey % 2 = 0 AND c_custkey % 3 > 0 AND c_custkey % 5 > 0 AND c_custkey % 7 > 0 AND c_custkey % 11 > 0 GROUP BY ALL)""")
def catalog_unique_sets(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.unique_sets(of(spark, sf, "customer", "concat('n', c_nationkey) AS table_name", "c_mktsegment AS index_name", "concat('col', c_custkey % 13) AS column_name", "c_custkey % 2 = 0 AS is_unique", "c_custkey % 3 > 0 AS is_valid", "c_custkey % 5 > 0 AS is_immediate", "c_custkey % 7 = 0 AS is_partial", "c_custkey % 11 = 0 AS is_expression"))


@query("SELECT 'n' || c_nationkey AS table_name, c_mktsegment AS index_name, c_nationkey % 2 = 0 AS is_unique, list(c_name ORDER BY c_custkey) AS columns FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY ALL")
def catalog_indexes_without_key(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.index_columns(of(spark, sf, "customer", "concat('n', c_nationkey) AS table_name", "c_mktsegment AS index_name", "c_nationkey % 2 = 0 AS is_unique", "c_mktsegment = 'BUILDING' AS is_primary", "c_custkey AS position", "c_name AS column_name"))


_LINES = "(SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem)"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as routines, keys or indexes, and their line numbers as the lines or columns of these."""
    return of(spark, sf, "lineitem", "l_orderkey AS k", "l_linenumber AS n").distinct()


@query(f"""WITH r AS (SELECT CASE WHEN k % 2 = 0 THEN 'FUNCTION' ELSE 'PROCEDURE' END AS type, 'r' || k AS name, string_agg('line ' || n || chr(10), '' ORDER BY n) AS body FROM {_LINES} WHERE k % 3 > 0 GROUP BY k)
SELECT 1 AS part, type, name, '-- ' || type || ': ' || name || chr(10) || body AS script FROM r UNION ALL SELECT 2, 'TRIGGER', 't' || o_orderkey, '-- TRIGGER: t' || o_orderkey || chr(10) || 'create trigger for ' || o_orderpriority FROM orders""")
def catalog_routine_export(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered lines put together; an object seen twice is exported once, one without source (every third) not at all."""
    lines = _lines(spark, sf).selectExpr("explode(array('a', 'b')) AS owner", "concat('r', k) AS name", "if(k % 2 = 0, 'FUNCTION', 'PROCEDURE') AS type", "n AS line", "if(k % 3 > 0, concat('line ', n, '\\n'), ' ') AS text")
    triggers = of(spark, sf, "orders", "'a' AS owner", "concat('t', o_orderkey) AS name", "'TRIGGER' AS type", "concat('create trigger for ', o_orderpriority) AS body")
    return catalog.routine_export(catalog.routine_source(lines), triggers.unionByName(triggers))


@query(f"SELECT 'o' || k % 2 AS owner, 'r' || k AS name, 'FUNCTION' AS type, string_agg('line ' || n || chr(10), '' ORDER BY n) AS body FROM {_LINES} GROUP BY k")
def routine_export(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.routine_source(_lines(spark, sf).selectExpr("concat('o', k % 2) AS owner", "concat('r', k) AS name", "'FUNCTION' AS type", "n AS line", "concat('line ', n, '\\n') AS text"))


@query(f"SELECT 'o' || k AS table_name, list('l' || n ORDER BY n DESC) AS columns FROM {_LINES} GROUP BY k")
def catalog_pk_grouped(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.ordered_group(_lines(spark, sf).selectExpr("concat('o', k) AS table_name", "10 - n AS position", "concat('l', n) AS column_name"), ["table_name"], "position", "column_name", "columns")


@query(f"SELECT 'o' || k AS table_name, string_agg('l' || n, ',' ORDER BY n DESC) AS columns FROM {_LINES} GROUP BY k")
def catalog_indexes_listagg(spark: SparkSession, sf: str) -> DataFrame:
    return catalog_pk_grouped(spark, sf).select("table_name", F.array_join("columns", ",").alias("columns"))


@query(f"SELECT 'o' || k AS table_name, 'fk' AS fk_name, 'p' || k % 100 AS ref_table, list('c' || n ORDER BY n) AS columns, list('r' || (10 - n) ORDER BY n) AS ref_columns, CASE WHEN k % 2 = 0 THEN 'SET NULL' ELSE 'NO ACTION' END AS on_delete FROM {_LINES} GROUP BY k")
def catalog_foreign_keys(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.foreign_keys(_lines(spark, sf).selectExpr("concat('o', k) AS table_name", "'fk' AS fk_name", "concat('p', k % 100) AS ref_table", "n AS position", "concat('c', n) AS column_name", "concat('r', 10 - n) AS ref_column", "if(k % 2 = 0, 'SET_NULL', 'no_action') AS on_delete"))


@query("SELECT p_partkey AS fk_name, 0 AS position, p_brand AS col, p_type AS ref FROM part UNION ALL SELECT p_partkey, 1, p_name, p_brand FROM part")
def catalog_fk_zip(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.unpair(of(spark, sf, "part", "p_partkey AS fk_name", "array(p_brand, p_name) AS col", "array(p_type, p_brand) AS ref"), "col", "ref", "fk_name")


@query("SELECT 'p' || p_partkey AS table_name, '' AS column_name, p_name AS comment FROM part WHERE p_partkey % 3 = 2 UNION ALL SELECT 'p' || c_nationkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 2 = 0")
def catalog_comments_union(spark: SparkSession, sf: str) -> DataFrame:
    tables = of(spark, sf, "part", "concat('p', p_partkey) AS table_name", "CASE p_partkey % 3 WHEN 0 THEN '' WHEN 2 THEN p_name END AS comment")
    return catalog.comments(tables, of(spark, sf, "customer", "concat('p', c_nationkey) AS table_name", "c_name AS column_name", "CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS comment"))


@query("SELECT p_partkey, 'SEQ_' || p_partkey AS seq FROM part")
def seq_from_trigger(spark: SparkSession, sf: str) -> DataFrame:
    body = """CASE p_partkey % 2 WHEN 0 THEN concat('select seq_', p_partkey, '.nextval into :new.id from dual') ELSE concat('BEGIN :NEW.ID := "Seq_', p_partkey, '" . NEXTVAL; END') END AS body"""
    return of(spark, sf, "part", "p_partkey", body).select("p_partkey", catalog.trigger_sequence(F.col("body")).alias("seq"))


@query("""SELECT 'n' || c_nationkey AS table_name, c_mktsegment AS index_name, list(c_name ORDER BY c_custkey) AS columns FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY ALL
HAVING bool_and(c_custkey % 41 > 0 AND c_custkey % 43 > 0 AND c_custkey % 47 > 0 AND c_nationkey % 5 > 0)""")
def catalog_eligible_unique(spark: SparkSession, sf: str) -> DataFrame:
    parts = of(spark, sf, "customer", "concat('n', c_nationkey) AS table_name", "c_mktsegment AS index_name", "c_custkey AS position", "if(c_custkey % 41 > 0, c_name, null) AS column_name", "if(c_custkey % 43 = 0, 10, null) AS prefix_length", "c_custkey % 47 = 0 AS nullable", "if(c_nationkey % 5 > 0, 'btree', 'HASH') AS index_type", "c_mktsegment <> 'BUILDING' AS is_unique")
    return catalog.eligible_unique(parts)


# Filters of names

def _names(spark: SparkSession, sf: str) -> DataFrame:
    return of(spark, sf, "customer", "c_name AS table_name").unionByName(of(spark, sf, "part", "replace(p_name, ' ', '_') AS table_name"))


_NAMES = "(SELECT c_name AS table_name FROM customer UNION ALL SELECT replace(p_name, ' ', '_') FROM part)"


@query(f"SELECT table_name FROM {_NAMES}")
def table_filter_all(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.filter_tables(_names(spark, sf), "all")


@query(f"SELECT table_name FROM {_NAMES} WHERE table_name GLOB '*1?' OR table_name GLOB 's*_ring' OR table_name GLOB 'Customer#00000002[3-7]'")
def table_filter_include(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.filter_tables(_names(spark, sf), "include", "*1?, s*_ring,Customer#00000002[3-7], [open")


@query(f"SELECT table_name FROM {_NAMES} WHERE NOT (table_name GLOB '*_ring' OR table_name GLOB '*0')")
def table_filter_exclude(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.filter_tables(_names(spark, sf), "exclude", "*_ring,*0")


@query("SELECT c_name AS table_name, true AS found FROM customer WHERE c_name IN (SELECT replace(s_name, 'Supplier', 'Customer') FROM supplier) UNION ALL SELECT 'x' || s_name, false FROM supplier")
def exact_table_list(spark: SparkSession, sf: str) -> DataFrame:
    wanted = of(spark, sf, "supplier", "explode(array(replace(s_name, 'Supplier', 'Customer'), concat('x', s_name))) AS table_name")
    there, gone = catalog.exact_tables(of(spark, sf, "customer", "c_name AS table_name"), wanted)
    return there.withColumn("found", F.lit(True)).unionByName(gone.withColumn("found", F.lit(False)))


@query("SELECT 'x' || p_partkey AS table_name FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)")
def scope_isolation(spark: SparkSession, sf: str) -> DataFrame:
    return verify.out_of_scope(of(spark, sf, "part", "concat('x', p_partkey) AS table_name"), of(spark, sf, "customer", "concat('x', c_custkey) AS table_name"))


# Types and DDL of the given tables' own columns

GIVEN = ("nation", "customer", "part", "orders", "events")
_GIVEN = ", ".join(f"'{t}'" for t in GIVEN)
_KIND = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "varchar", "TIMESTAMP": "datetime"}
_KIND_SQL = "CASE data_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KIND.items()) + " END"


def _columns(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of the given tables with MySQL's names of their types."""
    names = {"string": "varchar", "timestamp_ntz": "datetime", "timestamp": "datetime"}
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    cols = catalog.columns_of(spark, {t: load(spark, sf, t) for t in GIVEN})
    return cols.withColumn("data_type", F.coalesce(F.element_at(known, F.col("data_type")), F.col("data_type")))


_MAPPED = {"postgres": {"int": "int", "bigint": "bigint", "double": "decimal(22,4)", "varchar": "varchar(100)", "datetime": "timestamp"}, "dameng": {"int": "INT", "bigint": "BIGINT", "double": "DECIMAL(22,4)", "varchar": "VARCHAR2(100)", "datetime": "TIMESTAMP"}, "mysql": {"int": "int", "bigint": "bigint", "double": "double(22,4)", "varchar": "varchar(100)", "datetime": "datetime(6)"}}


def _mapped_sql(dst: str) -> str:
    return f"CASE {_KIND_SQL} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _MAPPED[dst].items()) + " END"


@query(" UNION ALL ".join(f"SELECT table_name, column_name, '{d}' AS dst, {_mapped_sql(d)} AS target_type FROM duckdb_columns() WHERE table_name IN ({_GIVEN})" for d in _MAPPED))
def typemap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(r.table_name, r.column_name, d, map_type("mysql", d, Column(r.column_name, r.data_type, 100 if r.data_type == "varchar" else 0, 22 if r.data_type == "double" else 0, 4 if r.data_type == "double" else 0))) for r in _columns(spark, sf).collect() for d in _MAPPED]
    return spark.createDataFrame(rows, "table_name string, column_name string, dst string, target_type string")


_PG_COLS = f"""string_agg('  "' || column_name || '" ' || {_mapped_sql("postgres")}, ',' || chr(10) ORDER BY column_index)"""
_MY_COLS = f"""string_agg('  `' || column_name || '` ' || {_mapped_sql("mysql")}, ',' || chr(10) ORDER BY column_index)"""


@query(f"""SELECT 'postgres' AS dialect, table_name, 0 AS seq, 'DROP TABLE IF EXISTS "app"."' || table_name || '" CASCADE;' || chr(10) || 'CREATE TABLE "app"."' || table_name || '" (' || chr(10) || {_PG_COLS} || chr(10) || ');' AS ddl FROM duckdb_columns() WHERE table_name IN ({_GIVEN}) GROUP BY table_name
UNION ALL SELECT 'mysql', table_name, 0, 'DROP TABLE IF EXISTS `app`.`' || table_name || '`' FROM duckdb_columns() WHERE table_name IN ({_GIVEN}) GROUP BY table_name
UNION ALL SELECT 'mysql', table_name, 1, 'CREATE TABLE `app`.`' || table_name || '` (' || chr(10) || {_MY_COLS} || chr(10) || ') ENGINE=InnoDB DEFAULT CHARSET=utf8mb4' FROM duckdb_columns() WHERE table_name IN ({_GIVEN}) GROUP BY table_name""")
def ddl_dialects(spark: SparkSession, sf: str) -> DataFrame:
    """CREATE TABLE of the given tables in two dialects, from their own columns."""
    rows = []
    for t in GIVEN:
        cols = [Column(r.column_name, r.data_type, 100 if r.data_type == "varchar" else 0, 22 if r.data_type == "double" else 0, 4 if r.data_type == "double" else 0) for r in _columns(spark, sf).where(F.col("table_name") == t).orderBy("position").collect()]
        rows += [(d, t, i, s) for d in ("postgres", "mysql") for i, s in enumerate(DIALECTS[d].create_table("app", Table(t, cols), "mysql"))]
    return spark.createDataFrame(rows, "dialect string, table_name string, seq int, ddl string")


_DEFAULT_SQL = """CASE p_partkey % 6 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_type WHEN 2 THEN CAST(p_size AS VARCHAR) WHEN 3 THEN '''' || p_type || '''' WHEN 4 THEN CAST(p_size AS VARCHAR) ELSE ' ' || p_brand || ' ' END"""


@query(f"SELECT p_partkey, {_DEFAULT_SQL} AS cleaned FROM part")
def default_strip(spark: SparkSession, sf: str) -> DataFrame:
    """A part's size or type as the default that each database would list, cleaned."""
    src = F.element_at(F.array(*[F.lit(s) for s in ("oracle", "postgres", "sqlserver", "sqlserver", "mysql", "other")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    raw = """CASE p_partkey % 6 WHEN 0 THEN concat("''", p_size, "''") WHEN 1 THEN concat("'", p_type, "'::character varying") WHEN 2 THEN concat('((', p_size, '))') WHEN 3 THEN concat("(N'", p_type, "')") WHEN 4 THEN concat("('", p_size, "')") ELSE concat(' ', p_brand, ' ') END AS raw"""
    rows = of(spark, sf, "part", "p_partkey", raw).withColumn("src", src)

    def clean(batches):
        for b in batches:
            b["cleaned"] = [clean_default(s, r) for s, r in zip(b["src"], b["raw"], strict=True)]
            yield b[["p_partkey", "cleaned"]]

    return rows.mapInPandas(clean, "p_partkey long, cleaned string")


# Locators and reviews

@query("""WITH f AS (SELECT 'x' || (c_custkey + 1000) AS table_name, CASE WHEN c_custkey % 4 = 0 THEN 'full_row' ELSE 'unique_key' END AS strategy, 'i' AS index_name, ['c' || (c_custkey % 7)] AS columns, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 1 END AS version FROM customer),
c AS (SELECT 'x' || p_partkey AS table_name, 'unique_key' AS strategy, 'i' AS index_name, ['c' || ((p_partkey + 1) % 7)] AS columns FROM part)
SELECT coalesce(f.table_name, c.table_name) AS table_name, coalesce(f.strategy, c.strategy) AS strategy, coalesce(f.index_name, c.index_name) AS index_name, coalesce(f.columns, c.columns) AS columns, coalesce(version, 1) AS version,
CASE WHEN version IS NULL THEN '' WHEN version <> 1 THEN 'other_version' WHEN c.table_name IS NULL THEN 'gone' WHEN f.strategy <> c.strategy THEN 'changed' ELSE '' END AS problem FROM f FULL JOIN c ON f.table_name = c.table_name""")
def locator_freeze(spark: SparkSession, sf: str) -> DataFrame:
    old = of(spark, sf, "customer", "concat('x', c_custkey + 1000) AS table_name", "if(c_custkey % 4 = 0, 'full_row', 'unique_key') AS strategy", "'i' AS index_name", "array(concat('c', c_custkey % 7)) AS columns", "if(c_custkey % 5 = 0, 0, 1) AS version")
    return cdc.frozen_locators(old, of(spark, sf, "part", "concat('x', p_partkey) AS table_name", "'unique_key' AS strategy", "'i' AS index_name", "array(concat('c', (p_partkey + 1) % 7)) AS columns"))


@query("""WITH i AS (SELECT 'n' || c_nationkey AS t, c_name AS n, CASE c_custkey % 3 WHEN 0 THEN ['a'] WHEN 1 THEN ['b', 'a'] ELSE ['c'] END AS cols, c_custkey % 97 = 0 AS p, c_custkey % 2 = 0 AND c_custkey % 5 > 0 AS u FROM customer),
s AS (SELECT 'n' || n_nationkey AS t, CASE WHEN n_nationkey % 2 = 0 THEN ['a', 'b'] ELSE ['c'] END AS cols FROM nation),
ok AS (SELECT t, n, cols, p FROM i WHERE p UNION ALL SELECT i.t, n, i.cols, p FROM i JOIN s ON i.t = s.t AND list_sort(i.cols) = s.cols WHERE NOT p AND u),
best AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY t ORDER BY p DESC, len(cols), n) = 1)
SELECT 'n' || n_nationkey AS table_name, CASE WHEN p IS NULL THEN 'full_row' WHEN p THEN 'primary_key' ELSE 'unique_key' END AS strategy, coalesce(n, '') AS index_name, coalesce(cols, []) AS columns FROM nation LEFT JOIN best ON t = 'n' || n_nationkey""")
def locator_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as indexes of their nation's table, which the target has with one unique set."""
    indexes = of(spark, sf, "customer", "concat('n', c_nationkey) AS table_name", "c_name AS index_name", "CASE c_custkey % 3 WHEN 0 THEN array('a') WHEN 1 THEN array('b', 'a') ELSE array('c') END AS columns", "c_custkey % 97 = 0 AS is_primary", "c_custkey % 2 = 0 AS is_unique", "c_custkey % 5 > 0 AS usable")
    sets = of(spark, sf, "nation", "concat('n', n_nationkey) AS table_name", "if(n_nationkey % 2 = 0, array('b', 'a'), array('c')) AS columns")
    return cdc.choose_locators(sets.select("table_name"), indexes, sets)


@query("""SELECT 'c' || c_custkey AS table_name, CASE WHEN c_custkey % 3 = 0 THEN 'not unique: id, tenant_id' ELSE 'not unique: code' END AS problem FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 1 OR c_custkey % 3 = 1 AND c_custkey % 2 = 0""")
def target_key_compatibility(spark: SparkSession, sf: str) -> DataFrame:
    locators = of(spark, sf, "customer", "concat('c', c_custkey) AS table_name", "CASE c_custkey % 3 WHEN 0 THEN 'primary_key' WHEN 1 THEN 'unique_key' ELSE 'full_row' END AS strategy", "CASE c_custkey % 3 WHEN 0 THEN array('tenant_id', 'id') WHEN 1 THEN array('code') ELSE cast(array() AS array<string>) END AS columns")
    return jobs.key_compatibility(locators, of(spark, sf, "customer", "concat('c', c_custkey) AS table_name", "if(c_custkey % 2 = 0, array('id', 'tenant_id'), array('code')) AS columns"))


@query("""SELECT 'n' || c_nationkey AS table_name, c_name AS column_name, 'missing' AS problem FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT 'n' || c_nationkey, 'x' || c_name, 'required' FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 2 = 1 AND c_custkey % 3 > 0 AND c_custkey % 7 > 0""")
def target_compatibility(spark: SparkSession, sf: str) -> DataFrame:
    source = of(spark, sf, "customer", "concat('n', c_nationkey) AS table_name", "c_name AS column_name")
    return jobs.target_compatibility(source, of(spark, sf, "customer", "concat('n', c_nationkey) AS table_name", "if(c_custkey % 5 = 0, concat('x', c_name), c_name) AS column_name", "c_custkey % 2 = 0 AS nullable", "c_custkey % 3 = 0 AS has_default", "c_custkey % 7 = 0 AS is_identity"))


@query("""WITH r AS (SELECT k, count(*) AS n FROM (SELECT s_suppkey * 7 AS k FROM supplier UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k), m AS (SELECT DISTINCT o_custkey AS k FROM orders),
a AS (SELECT coalesce(c_custkey, r.k) AS k, c_custkey IS NOT NULL AS sel, n FROM customer FULL JOIN r ON c_custkey = r.k), b AS (SELECT a.*, m.k IS NOT NULL AS mis FROM a LEFT JOIN m ON m.k = a.k)
SELECT 'x' || k AS table_name, 'out_of_scope' AS outcome FROM b WHERE NOT sel UNION ALL SELECT 'x' || k, 'effective' FROM b WHERE sel AND NOT mis UNION ALL SELECT 'x' || k, 'not_missing' FROM b WHERE sel AND NOT mis AND n IS NOT NULL
UNION ALL SELECT 'x' || k, CASE WHEN n IS NULL THEN 'unresolved' ELSE 'excluded' END FROM b WHERE sel AND mis UNION ALL SELECT 'x' || k, 'duplicate' FROM b WHERE n > 1""")
def preflight_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as selected tables, of which the target lacks those that have orders."""
    asked = of(spark, sf, "supplier", "concat('x', s_suppkey * 7) AS table_name").unionByName(of(spark, sf, "supplier", "concat('x', s_nationkey) AS table_name"))
    return jobs.exclusions(of(spark, sf, "customer", "concat('x', c_custkey) AS table_name"), of(spark, sf, "orders", "concat('x', o_custkey) AS table_name").distinct(), asked)


_STAGES = "['" + "', '".join(jobs.STAGES) + "']"


@query(f"""WITH i AS (SELECT o_custkey, {_STAGES}[o_orderkey % 5 + 1] AS stage, o_orderkey % 5 AS r, 'e' || o_orderkey AS error FROM orders), w AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY r, error) = 1)
SELECT 'c' || c_custkey AS table_name, CASE stage WHEN 'primary_key' THEN 'cdc_compatibility' ELSE stage END AS stage, error FROM customer LEFT JOIN w ON c_custkey = o_custkey""")
def bootstrap_review(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as issues of their customer's table."""
    stages = F.array(*[F.lit(s) for s in jobs.STAGES])
    issues = load(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("table_name"), F.element_at(stages, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("stage"), F.concat(F.lit("e"), "o_orderkey").alias("error"))
    return jobs.review(of(spark, sf, "customer", "concat('c', c_custkey) AS table_name"), issues)


@query("""SELECT 'drop_foreign_key' AS action, 'f' || c_custkey AS name FROM customer WHERE c_custkey % 3 > 0 AND (c_custkey + 1) % 3 = 0 AND c_custkey + 1 IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'drop_table', 'c' || c_custkey FROM customer WHERE c_custkey % 6 = 3""")
def bootstrap_finalise(spark: SparkSession, sf: str) -> DataFrame:
    review = of(spark, sf, "customer", "concat('c', c_custkey) AS table_name", "CASE c_custkey % 6 WHEN 0 THEN 'schema' WHEN 3 THEN 'data' END AS stage")
    return checks.finalise(review, of(spark, sf, "customer", "concat('c', c_custkey) AS table_name", "concat('f', c_custkey) AS fk_name", "concat('c', c_custkey + 1) AS ref_table"))


# Preflight

def _settings(spark: SparkSession, sf: str) -> DataFrame:
    return of(spark, sf, "nation", "CASE n_nationkey WHEN 0 THEN 'LOG_BIN' WHEN 1 THEN 'binlog_format' ELSE n_name END AS name", "CASE n_nationkey WHEN 0 THEN 'on' ELSE lower(n_name) END AS value")


def _grants(spark: SparkSession, sf: str) -> DataFrame:
    line = """CASE n_nationkey % 4 WHEN 0 THEN concat('GRANT USAGE, Replication  Slave ON *.* TO `', n_name, '`@`%`') WHEN 1 THEN concat('GRANT SELECT, INSERT (a, b) ON `', n_name, '`.`t` TO `u`@`%`')
        WHEN 2 THEN concat('GRANT ALL PRIVILEGES ON `', n_name, '`.* TO u') ELSE concat('REVOKE REPLICATION CLIENT ON *.* FROM ', n_name) END AS line"""
    return of(spark, sf, "nation", line)


_LACKING = "(SELECT p FROM (VALUES ('SELECT', -1), ('REPLICATION CLIENT', -1), ('REPLICATION SLAVE', 0)) v(p, k) WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey % 4 = k))"


@query("SELECT 'binlog_format' AS name, upper(n_name) AS value, 'wrong' AS problem FROM nation WHERE n_nationkey = 1 UNION ALL SELECT 'binlog_row_image', '', 'missing'")
def preflight_settings(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as settings, of which two have a needed name."""
    return checks.settings_problems(_settings(spark, sf))


@query(f"SELECT p AS privilege FROM {_LACKING}")
def preflight_grants(spark: SparkSession, sf: str) -> DataFrame:
    """A privilege on one nation's database is none on all."""
    return checks.missing_grants(_grants(spark, sf))


@query(f"""SELECT 'error' AS severity, 'setting' AS kind, 'binlog_format' AS name, 'wrong' AS detail UNION ALL SELECT 'error', 'setting', 'binlog_row_image', 'missing' UNION ALL SELECT 'error', 'grant', p, '' FROM {_LACKING}
UNION ALL SELECT 'error', 'missing_table', 'T' || c_custkey, '' FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT 'error', 'column', 't' || c_custkey || '.a', 'missing' FROM customer WHERE c_custkey % 2 = 1
UNION ALL SELECT 'error', 'column', 't' || c_custkey || '.z', 'required' FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT 'error', 'column', 'u' || c_custkey || '.a', 'required' FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT 'error', 'start', '', 'log file is gone' UNION ALL SELECT 'warning', 'retention', '', 'log kept for 10.0 hours only' UNION ALL SELECT 'warning', 'no_key', 'T' || c_custkey, '' FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT 'error', 'reserved_name', 'T' || c_custkey, '' FROM customer WHERE c_custkey = 6""")
def preflight_all(spark: SparkSession, sf: str) -> DataFrame:
    """Everything that is wrong before a stream of customers' tables, in one relation; the target keeps the name t6 for itself."""
    tables = of(spark, sf, "customer", "concat('T', c_custkey) AS table_name", "c_custkey % 3 > 0 AS has_key")
    source = of(spark, sf, "customer", "concat('T', c_custkey) AS table_name", "'a' AS column_name")
    target = of(spark, sf, "customer", "if(c_custkey % 4 > 0, concat('t', c_custkey), concat('u', c_custkey)) AS table_name", "if(c_custkey % 2 = 0, 'a', 'z') AS column_name", "false AS nullable", "false AS has_default", "false AS is_identity")
    return checks.preflight(_settings(spark, sf), _grants(spark, sf), tables, source, target, 36_000, "log file is gone", lower=True, reserved="t6")
