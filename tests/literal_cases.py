"""Cases of fixed rows: operators on small relations written out, each with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablebridge.functions import console
from tablebridge.functions.ddl import DIALECTS, Table
from tablebridge.functions.defaults import clean_default
from tablebridge.functions.positions import Position, reached_column
from tablebridge.functions.typemap import Column, map_type
from tablebridge.operators import cdc, checks, copy, jobs, verify, workload
from tablebridge.sources import catalog

CASES: dict[str, tuple] = {}


def query(sql: str):
    def add(f):
        CASES[f.__name__] = (f, sql)
        return f

    return add


def _catalog(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('app', 'a'), ('app', 'b'), ('empty', null), ('mysql', 'user'), ('SYS', 'x'), ('App2', 'a') AS v(schema_name, table_name)")


@query("SELECT * FROM (VALUES ('app', CAST(2 AS BIGINT)), ('empty', 0), ('App2', 1)) v(schema_name, tables)")
def catalog_namespaces(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.namespaces(_catalog(spark), "mysql")


@query("""SELECT * FROM (VALUES ('app2', true, false), ('app2', false, true), ('App2', true, true)) v(name, exact, "exists")""")
def catalog_schema_exists(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda name, exact: catalog.schema_exists(_catalog(spark), name, exact).select(F.lit(name).alias("name"), F.lit(exact).alias("exact"), "exists")
    return one("app2", True).unionByName(one("app2", False)).unionByName(one("App2", True))


@query("""SELECT * FROM (VALUES ('v1', 'select a.x from a join "b" on a.i = b.i where s = ''app2.x'''), ('v2', 'select 1')) v(view_name, body)""")
def catalog_views(spark: SparkSession, sf: str) -> DataFrame:
    rows = [("app", "v1", "select a.x from `app`.a join App.\"b\" on app.a.i = \"app\".b.i where s = 'app2.x' "), ("app", "v2", "select 1"), ("other", "v3", "select 2")]
    return catalog.views_of(spark.createDataFrame(rows, "schema_name string, view_name string, body string"), "app")


@query("SELECT * FROM (VALUES ('a', ['id', 'code', 'total'], [1, 0], [0], [2]), ('b', ['x'], [], [], [])) v(table_name, columns, key_places, auto_places, generated)")
def catalog_stream_tables(spark: SparkSession, sf: str) -> DataFrame:
    cols = spark.sql("SELECT * FROM VALUES ('a', 2, 'code', false, false), ('a', 1, 'id', true, false), ('a', 3, 'total', false, true), ('b', 1, 'x', false, false) AS v(table_name, position, column_name, auto, generated)")
    return catalog.stream_tables(cols, spark.sql("SELECT * FROM VALUES ('a', 2, 'id'), ('a', 1, 'code') AS v(table_name, position, column_name)"))


@query("SELECT * FROM (VALUES ('t', ['a', 'b']), ('t', ['c'])) v(table_name, columns)")
def catalog_unique_sets(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.unique_sets(spark.sql("""SELECT * FROM VALUES ('t', 'u1', 'b', true, true, true, false, false), ('t', 'u1', 'a', true, true, true, false, false), ('t', 'u2', 'c', true, true, true, false, false), ('t', 'u3', 'd', true, false, true, false, false),
        ('t', 'u4', 'e', true, true, false, false, false), ('t', 'u5', 'f', true, true, true, true, false), ('t', 'u6', 'g', true, true, true, false, true), ('t', 'i7', 'h', false, true, true, false, false), ('t', 'u8', 'c', true, true, true, false, false)
        AS v(table_name, index_name, column_name, is_unique, is_valid, is_immediate, is_partial, is_expression)"""))


@query("SELECT * FROM (VALUES ('t', 'i', false, ['b', 'a'])) v(table_name, index_name, is_unique, columns)")
def catalog_indexes_without_key(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.index_columns(spark.sql("SELECT * FROM VALUES ('t', 'PRIMARY', true, true, 1, 'id'), ('t', 'i', false, false, 2, 'a'), ('t', 'i', false, false, 1, 'b') AS v(table_name, index_name, is_unique, is_primary, position, column_name)"))


@query("""SELECT * FROM (VALUES (1, 'FUNCTION', 'f', '-- FUNCTION: f' || chr(10) || 'create function f' || chr(10) || 'return 1'), (1, 'PROCEDURE', 'p', '-- PROCEDURE: p' || chr(10) || 'create procedure p'), (2, 'TRIGGER', 't', '-- TRIGGER: t' || chr(10) || 'create trigger t')) v(part, type, name, script)""")
def catalog_routine_export(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered lines put together; an object seen twice is exported once, one without source not at all."""
    lines = spark.sql(r"SELECT * FROM VALUES ('o', 'f', 'FUNCTION', 2, 'return 1'), ('o', 'f', 'FUNCTION', 1, 'create function f\n'), ('o2', 'f', 'FUNCTION', 1, 'create function f\nreturn 1'), ('o', 'p', 'PROCEDURE', 1, 'create procedure p'), ('o', 'e', 'PROCEDURE', 1, ' ') AS v(owner, name, type, line, text)")
    triggers = spark.sql("SELECT * FROM VALUES ('o', 't', 'TRIGGER', 'create trigger t'), ('o', 't', 'TRIGGER', 'create trigger t') AS v(owner, name, type, body)")
    return catalog.routine_export(catalog.routine_source(lines), triggers)


_NAMES = "(VALUES ('users'), ('orders'), ('order_log'), ('tmp_cache'), ('audit')) AS v(table_name)"


def _names(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {_NAMES}")


@query(f"SELECT table_name FROM {_NAMES}")
def table_filter_all(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.filter_tables(_names(spark), "all")


@query(f"SELECT table_name FROM {_NAMES} WHERE table_name GLOB 'order*' OR table_name GLOB 'a?d*'")
def table_filter_include(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.filter_tables(_names(spark), "include", "order*, a?d*")


@query(f"SELECT table_name FROM {_NAMES} WHERE NOT (table_name GLOB '*_log' OR table_name GLOB 'tmp_*' OR table_name = 'audit')")
def table_filter_exclude(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.filter_tables(_names(spark), "exclude", "*_log,tmp_*,audit")


@query(f"SELECT table_name FROM {_NAMES} WHERE table_name IN ('users', 'audit')")
def exact_table_list(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.exact_tables(_names(spark), spark.sql("SELECT * FROM VALUES ('users'), ('audit'), ('gone') AS v(table_name)"))[0]


_KEYS = "(VALUES ('orders', 1, 'o_orderkey'), ('lines', 2, 'l_linenumber'), ('lines', 1, 'l_orderkey'), ('conv', 1, 'conv_id'), ('conv', 2, 'turn')) AS v(table_name, position, column_name)"


@query(f"SELECT table_name, list(column_name ORDER BY position) AS columns FROM {_KEYS} GROUP BY table_name")
def catalog_pk_grouped(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.ordered_group(spark.sql(f"SELECT * FROM {_KEYS}"), ["table_name"], "position", "column_name", "columns")


@query(f"SELECT table_name, string_agg(column_name, ',' ORDER BY position) AS columns FROM {_KEYS} GROUP BY table_name")
def catalog_indexes_listagg(spark: SparkSession, sf: str) -> DataFrame:
    keys = catalog.ordered_group(spark.sql(f"SELECT * FROM {_KEYS}"), ["table_name"], "position", "column_name", "c")
    return keys.select("table_name", F.array_join("c", ",").alias("columns"))


_PARTS = "(VALUES ('child', 'fk1', 'parent', 2, 'b', 'y', 'SET_NULL'), ('child', 'fk1', 'parent', 1, 'a', 'x', 'SET_NULL'), ('child', 'fk2', 'other', 1, 'c', 'id', 'no_action')) AS v(table_name, fk_name, ref_table, position, column_name, ref_column, on_delete)"


@query(f"SELECT table_name, fk_name, ref_table, list(column_name ORDER BY position) AS columns, list(ref_column ORDER BY position) AS ref_columns, replace(upper(any_value(on_delete)), '_', ' ') AS on_delete FROM {_PARTS} GROUP BY ALL HAVING true".replace("GROUP BY ALL HAVING true", "GROUP BY table_name, fk_name, ref_table"))
def catalog_foreign_keys(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.foreign_keys(spark.sql(f"SELECT * FROM {_PARTS}"))


@query("SELECT 'fk' AS fk_name, unnest(range(0, 2))::INTEGER AS position, unnest(['a', 'b']) AS col, unnest(['x', 'y']) AS ref")
def catalog_fk_zip(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.unpair(spark.sql("SELECT 'fk' AS fk_name, array('a', 'b') AS col, array('x', 'y') AS ref"), "col", "ref", "fk_name")


@query("SELECT * FROM (VALUES ('orders', '', 'all orders'), ('orders', 'o_custkey', 'buyer')) v(table_name, column_name, comment)")
def catalog_comments_union(spark: SparkSession, sf: str) -> DataFrame:
    t = spark.sql("SELECT * FROM VALUES ('orders', 'all orders'), ('part', ''), ('region', null) AS v(table_name, comment)")
    return catalog.comments(t, spark.sql("SELECT * FROM VALUES ('orders', 'o_custkey', 'buyer'), ('orders', 'o_orderkey', null) AS v(table_name, column_name, comment)"))


@query("SELECT 'SEQ_A' AS seq UNION ALL SELECT 'SEQ_B'")
def seq_from_trigger(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('select seq_a.nextval into :new.id from dual'), ('BEGIN :NEW.ID := \"SEQ_B\".NEXTVAL; END') AS v(body)").select(catalog.trigger_sequence(F.col("body")).alias("seq"))


@query("SELECT * FROM (VALUES ('t', 'u_code', ['code'])) v(table_name, index_name, columns)")
def catalog_eligible_unique(spark: SparkSession, sf: str) -> DataFrame:
    rows = """SELECT * FROM VALUES ('t', 'u_code', 1, 'code', null, false, 'BTREE', true), ('t', 'u_null', 1, 'x', null, true, 'BTREE', true), ('t', 'u_prefix', 1, 'y', 10, false, 'BTREE', true),
        ('t', 'u_fun', 1, null, null, false, 'BTREE', true), ('t', 'u_hash', 1, 'z', null, false, 'HASH', true), ('t', 'plain', 1, 'q', null, false, 'BTREE', false)
        AS v(table_name, index_name, position, column_name, prefix_length, nullable, index_type, is_unique)"""
    return catalog.eligible_unique(spark.sql(rows))


@query("SELECT 'o' AS owner, 'f' AS name, 'FUNCTION' AS type, 'a' || chr(10) || 'b' || chr(10) || 'c' AS body")
def routine_export(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.routine_source(spark.sql("SELECT * FROM VALUES ('o', 'f', 'FUNCTION', 2, 'b\\n'), ('o', 'f', 'FUNCTION', 1, 'a\\n'), ('o', 'f', 'FUNCTION', 3, 'c') AS v(owner, name, type, line, text)"))


_TYPES = [
    ("mysql", "postgres", Column("c", "mediumint"), "int"), ("mysql", "gaussdb", Column("c", "double", precision=22), "decimal(22,0)"), ("mysql", "postgres", Column("c", "varchar", 20), "varchar(20)"),
    ("mysql", "mysql", Column("c", "varchar", 20000), "text"), ("mysql", "dameng", Column("c", "json"), "CLOB"), ("oracle", "mysql", Column("c", "NUMBER", precision=9), "int"),
    ("oracle", "postgres", Column("c", "TIMESTAMP(6)"), "timestamp"), ("oracle", "mysql", Column("c", "INTERVAL YEAR(2) TO MONTH"), "varchar(50)"), ("sqlserver", "mysql", Column("c", "nvarchar", -1), "longtext"),
    ("sqlserver", "postgres", Column("c", "timestamp"), "bytea"), ("dameng", "mysql", Column("c", "bit"), "tinyint(1)"), ("dameng", "kingbase", Column("c", "clob"), "text"), ("postgres", "dameng", Column("c", "_int4"), "TEXT"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{d}', '{c.data_type}', '{want}')" for s, d, c, want in _TYPES) + ") v(src, dst, source_type, target_type)")
def typemap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(s, d, c.data_type, map_type(s, d, c)) for s, d, c, _ in _TYPES], "src string, dst string, source_type string, target_type string")


_DEFAULTS = [("oracle", "''0''", "0"), ("oracle", "'''abc'''", "'abc'"), ("oracle", "'0'", "0"), ("postgres", "'abc'::character varying", "abc"), ("sqlserver", "((0))", "0"), ("sqlserver", "(N'x')", "'x'"), ("mysql", "(' ')", " "), ("other", " x ", " x ")]


@query("SELECT * FROM (VALUES " + ", ".join("('{}', '{}', '{}')".format(*(x.replace("'", "''") for x in r)) for r in _DEFAULTS) + ") v(src, raw, cleaned)")
def default_strip(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(s, r, clean_default(s, r)) for s, r, _ in _DEFAULTS], "src string, raw string, cleaned string")


_CLASSES = """SELECT * FROM (VALUES ('select 1', 'select', 'readonly', true, ''), ('with x as (select 1) delete from t', 'delete', 'write', false, ''), ('insert into t values (1) returning id', 'insert', 'write', true, ''),
('drop table t', 'drop', 'dangerous', false, ''), ('select 1; select 2', '', 'rejected', false, 'not one statement'), ('begin', '', 'rejected', false, 'transaction control is not supported'),
('select * from t into outfile ''/tmp/x''', 'select', 'dangerous', true, ''), ('select ''a;b'' -- c', 'select', 'readonly', true, ''), ('/* open', '', 'rejected', false, 'comment is not closed')) v(sql, statement, level, returns_rows, error)"""


@query(_CLASSES)
def console_classify(spark: SparkSession, sf: str) -> DataFrame:
    texts = ["select 1", "with x as (select 1) delete from t", "insert into t values (1) returning id", "drop table t", "select 1; select 2", "begin", "select * from t into outfile '/tmp/x'", "select 'a;b' -- c", "/* open"]

    def one(sql: str) -> tuple[str, str, bool, str]:
        try:
            r = console.analyse(sql)
            return r.statement, r.level, r.returns_rows, ""
        except ValueError as e:
            return "", "rejected", False, str(e)

    return spark.createDataFrame([(t, *one(t)) for t in texts], "sql string, statement string, level string, returns_rows boolean, error string")


@query("""SELECT * FROM (VALUES ('invalid input syntax for type integer: "<redacted>"'), ('Key (a)=(<redacted>) exists'), ('plain text'), ('date/time field value out of range: "<redacted>"'), ('Incorrect integer value: "<redacted>" for column x'),
('COPY t, line 3, column a: "<redacted>"'), ('invalid input value for enum e: "<redacted>"'), ('DETAIL: Key (a, b)=(<redacted>) already exists.'), ('name "x" stays')) v(line)""")
def log_redaction(spark: SparkSession, sf: str) -> DataFrame:
    texts = ['invalid input syntax for type integer: "4711"', "Key (a)=(secret) exists", "plain text", 'date/time field value out of range: "2024-13-01"', "Incorrect integer value: 'abc' for column x", 'COPY t, line 3, column a: "secret"', 'invalid input value for enum e: "z"', "DETAIL: Key (a, b)=(1, x (y)) already exists.", 'name "x" stays']
    return spark.createDataFrame([(t,) for t in texts], "line string").select(jobs.redact(F.col("line")).alias("line"))


@query("SELECT * FROM (VALUES ('good', NULL, NULL), ('bad_schema', 'schema', 'e1'), ('bad_data', 'data', 'e2'), ('bad_pk', 'cdc_compatibility', 'e3'), ('bad_count', 'row_count', 'e4'), ('bad_both', 'schema', 'e5')) v(table_name, stage, error)")
def bootstrap_review(spark: SparkSession, sf: str) -> DataFrame:
    exp = spark.sql("SELECT * FROM VALUES ('good'), ('bad_schema'), ('bad_data'), ('bad_pk'), ('bad_count'), ('bad_both') AS v(table_name)")
    iss = spark.sql("SELECT * FROM VALUES ('bad_schema', 'schema', 'e1'), ('bad_data', 'data', 'e2'), ('bad_pk', 'primary_key', 'e3'), ('bad_count', 'row_count', 'e4'), ('bad_both', 'cdc_compatibility', 'e6'), ('bad_both', 'schema', 'e5') AS v(table_name, stage, error)")
    return jobs.review(exp, iss)


@query("SELECT * FROM (VALUES ('present', 'effective'), ('missing_a', 'excluded'), ('missing_b', 'unresolved'), ('other', 'out_of_scope')) v(table_name, outcome)")
def preflight_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    v = lambda *x: spark.createDataFrame([(y,) for y in x], "table_name string")
    return jobs.exclusions(v("present", "missing_a", "missing_b"), v("missing_a", "missing_b"), v("missing_a", "other"))


@query("SELECT * FROM (VALUES ('t', 'b', 'missing'), ('t', 'z', 'required')) v(table_name, column_name, problem)")
def target_compatibility(spark: SparkSession, sf: str) -> DataFrame:
    s = spark.sql("SELECT * FROM VALUES ('t', 'a'), ('t', 'b') AS v(table_name, column_name)")
    d = spark.sql("SELECT * FROM VALUES ('t', 'a', false, false, false), ('t', 'y', true, false, false), ('t', 'z', false, false, false), ('t', 'id', false, false, true) AS v(table_name, column_name, nullable, has_default, is_identity)")
    return jobs.target_compatibility(s, d)


_ALLOCATION = """WITH RECURSIVE t AS (SELECT i, CASE WHEN (i + 1) % 97 = 0 THEN 0 ELSE 1 / pow(i + 8, 0.82) END AS w FROM range(200) r(i)),
c AS (SELECT i, w, least(floor(1000000 * w / sum(w) OVER ()), 100000)::BIGINT AS base FROM t), d AS (SELECT i, base, CASE WHEN w > 0 THEN 100000 - base ELSE 0 END AS room FROM c),
g(k, rest) AS (SELECT 0, 1000000 - (SELECT sum(base) FROM d)::BIGINT UNION ALL SELECT k + 1, rest - (SELECT count(*) FROM d WHERE room > k) FROM g WHERE rest > 0),
e AS (SELECT i FROM (SELECT i, rest, row_number() OVER (PARTITION BY k ORDER BY i) AS n FROM d JOIN g ON room > k WHERE rest > 0) WHERE n <= rest),
a AS (SELECT d.i::INTEGER AS i, ['primary', 'composite', 'unique', 'keyless', 'wide', 'mixed_case'][d.i % 6 + 1] AS kind, base + coalesce(n, 0) AS rows FROM d LEFT JOIN (SELECT i, count(*) AS n FROM e GROUP BY i) USING (i))"""


@query(f"{_ALLOCATION} SELECT i, kind, rows FROM a")
def workload_zipf_alloc(spark: SparkSession, sf: str) -> DataFrame:
    return workload.allocate(spark, 200, 1_000_000, 100_000)


@query(f"{_ALLOCATION} SELECT i, kind, rows FROM a ORDER BY rows DESC, i LIMIT 2")
def hot_tables_top1pct(spark: SparkSession, sf: str) -> DataFrame:
    return workload.hottest(workload.allocate(spark, 200, 1_000_000, 100_000))


@query(f"{_ALLOCATION} SELECT i + 1 AS i, 'load_run2024x_' || CASE WHEN kind = 'mixed_case' THEN 'Mixed_' ELSE '' END || printf('%06d', i + 1) AS table_name, kind, rows FROM a")
def workload_profile(spark: SparkSession, sf: str) -> DataFrame:
    return workload.profile(spark, "Run-2024/x", 200, 1_000_000, 100_000)


@query("""SELECT * FROM (VALUES (100, 'cross-100', 't0', 'insert', 100, true), (100, 'cross-100', 't4', 'insert', 100, true), (101, 'rollback-101', 't0', 'insert', 101, false), (102, 'locator-102', 't0', 'locator_update', 1000000102, true),
(103, 'locator-103', 't1', 'locator_update', 103, true), (104, 'locator-104', 't2', 'locator_update', 104, true)) v(seq, txn, table_name, action, row_id, committed)""")
def workload_boundary_fixtures(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in workload.KINDS])
    return workload.boundary_fixtures(spark.range(12).select(F.col("id").alias("i"), F.format_string("t%d", "id").alias("table_name"), F.element_at(kinds, (F.col("id") % 6 + 1).cast("int")).alias("kind")), 100)


@query("""SELECT id, (id % 31 + 1)::INTEGER AS tenant_id, printf('t%06d-r%012d', 3, id) AS code, CAST((id % 1000000) + (id % 10000) / 10000.0 AS DECIMAL(18,4)) AS amount,
CASE WHEN id % 1000 = 0 THEN repeat('long-note-', 500) WHEN id % 7 = 0 THEN NULL ELSE 'note-' || CAST(id % 1000 AS VARCHAR) END AS note, make_timestamp((1700000000 + id % 10000000) * 1000000 + id % 1000000) AS created_at FROM (SELECT unnest(range(0, 5000)) AS id)""")
def workload_rows(spark: SparkSession, sf: str) -> DataFrame:
    return workload.rows(spark, 3, 5000).select("id", "tenant_id", "code", "amount", "note", "created_at")


@query("SELECT * FROM (VALUES ('binlog_format', 'MIXED', 'wrong'), ('binlog_row_image', '', 'missing')) v(name, value, problem)")
def preflight_settings(spark: SparkSession, sf: str) -> DataFrame:
    return checks.settings_problems(spark.sql("SELECT * FROM VALUES ('LOG_BIN', 'on'), ('binlog_format', 'mixed') AS v(name, value)"))


@query("SELECT * FROM (VALUES ('REPLICATION CLIENT'), ('SELECT')) v(privilege)")
def preflight_grants(spark: SparkSession, sf: str) -> DataFrame:
    """A privilege on one table is none on all."""
    return checks.missing_grants(spark.sql("SELECT * FROM VALUES ('GRANT USAGE, Replication  Slave ON *.* TO `u`@`%`'), ('GRANT SELECT, INSERT (a, b) ON `other`.`t` TO `u`@`%`'), ('GRANT ALL PRIVILEGES ON `app`.* TO u'), ('REVOKE REPLICATION CLIENT ON *.* FROM u') AS v(line)"))


@query("""SELECT * FROM (VALUES ('error', 'setting', 'binlog_row_image', 'missing'), ('error', 'grant', 'REPLICATION CLIENT', ''), ('error', 'missing_table', 'Gone', ''), ('error', 'column', 't.b', 'missing'), ('error', 'column', 't.z', 'required'),
('error', 'start', '', 'log file is gone'), ('warning', 'retention', '', 'log kept for 10.0 hours only'), ('warning', 'no_key', 'Gone', ''), ('error', 'reserved_name', '_Checkpoint', '')) v(severity, kind, name, detail)""")
def preflight_all(spark: SparkSession, sf: str) -> DataFrame:
    """Everything that is wrong before a stream, in one relation."""
    settings = spark.sql("SELECT * FROM VALUES ('log_bin', 'ON'), ('binlog_format', 'row') AS v(name, value)")
    grants = spark.sql("SELECT * FROM VALUES ('GRANT SELECT, REPLICATION SLAVE ON *.* TO u') AS v(line)")
    tables = spark.sql("SELECT * FROM VALUES ('T', true), ('Gone', false), ('_Checkpoint', true) AS v(table_name, has_key)")
    src = spark.sql("SELECT * FROM VALUES ('T', 'a'), ('T', 'b'), ('Gone', 'a'), ('_Checkpoint', 'a') AS v(table_name, column_name)")
    dst = spark.sql("SELECT * FROM VALUES ('t', 'a', false, false, false), ('t', 'z', false, false, false), ('_checkpoint', 'a', true, false, false) AS v(table_name, column_name, nullable, has_default, is_identity)")
    return checks.preflight(settings, grants, tables, src, dst, 36_000, "log file is gone", lower=True)


@query("SELECT * FROM (VALUES ('drop_foreign_key', 'fk1'), ('drop_table', 'b')) v(action, name)")
def bootstrap_finalise(spark: SparkSession, sf: str) -> DataFrame:
    rev = spark.sql("SELECT * FROM VALUES ('a', null), ('b', 'data'), ('c', 'schema') AS v(table_name, stage)")
    return checks.finalise(rev, spark.sql("SELECT * FROM VALUES ('a', 'fk1', 'b'), ('b', 'fk2', 'a'), ('a', 'fk3', 'a') AS v(table_name, fk_name, ref_table)"))


@query("SELECT 'data' AS category, CAST(2 AS BIGINT) AS total, CAST(1 AS BIGINT) AS success, CAST(1 AS BIGINT) AS failed, ['b'] AS failed_items UNION ALL SELECT 'views', 1, 1, 0, []")
def report_totals(spark: SparkSession, sf: str) -> DataFrame:
    return copy.report(spark.sql("SELECT * FROM VALUES ('data', 'a', true, ''), ('data', 'b', false, 'e'), ('views', 'v', true, '') AS v(category, name, ok, error)"))


@query("SELECT * FROM (VALUES ('index', 'i1', 'e', 'd', 'objects'), ('view', 'v1', 'e', NULL, 'objects')) v(category, name, error, ddl, stage)")
def failed_objects_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.failed_objects(spark.sql("SELECT * FROM VALUES ('index', 'i1', 'e', 'd', 'objects'), ('index', 'i1', 'e', 'd', 'objects'), ('view', 'v1', 'e', null, 'objects') AS v(category, name, error, ddl, stage)"))


@query("""SELECT * FROM (VALUES ('table', 'A', 'e1', 'd1', 'schema'), ('data', 'B', 'e2', NULL, 'data'), ('primary_key', 'c', 'e3', 'd3', 'objects'), ('view', 'v', 'e4', 'd4', 'objects'),
('row_count', 'D', 'rows differ: source=5 target=4', NULL, 'validation'), ('row_count', 'E', 'rows were not counted', NULL, 'validation'), ('cdc_compatibility', 'F', 'no key', NULL, 'validation')) v(category, name, error, ddl, stage)""")
def failed_objects_of_report(spark: SparkSession, sf: str) -> DataFrame:
    expected = spark.sql("SELECT * FROM VALUES ('A'), ('B'), ('C'), ('D'), ('E'), ('F'), ('G') AS v(table_name)")
    items = spark.sql("SELECT * FROM VALUES ('table', 'A', 'e1', 'd1'), ('data', 'B', 'e2', null), ('primary_key', 'c', 'e3', 'd3'), ('view', 'v', 'e4', 'd4'), ('view', 'v', 'e4', 'd4') AS v(category, name, error, ddl)")
    counts = spark.sql("SELECT * FROM VALUES ('a', 1L, 0L, false), ('c', 1L, 0L, false), ('d', 5L, 4L, false), ('f', 2L, 2L, true), ('g', 2L, 2L, true) AS v(table_name, src_rows, dst_rows, matches)")
    return jobs.failures_of(expected, items, counts, spark.sql("SELECT * FROM VALUES ('F', 'no key'), ('A', 'no key'), ('G', '') AS v(table_name, error)"), lower=True)


@query("""SELECT * FROM (VALUES (1, 'table', 't', '-- bad type
-- disabled: destructive
-- DROP TABLE IF EXISTS t CASCADE;
CREATE TABLE t (a int);'), (2, 'index', 'i', '-- x
-- y
CREATE INDEX i ON t (a);
-- disabled: destructive
-- dRoP TABLE "odd;name"
-- CASCADE
-- ;
-- disabled: destructive
-- TrUnCaTe TABLE audit;
ALTER TABLE audit ADD COLUMN note text DEFAULT ''a;
DROP TABLE b'';'), (3, 'data', 'd', '-- invalid input syntax for type integer: "<redacted>"'), (4, 'odd_kind', 'o', '-- z
-- a note
SELECT 1;')) v(seq, category, name, script)""")
def failed_ddl_export(spark: SparkSession, sf: str) -> DataFrame:
    """Statement by statement, wherever it stands; unknown categories come last."""
    many = "CREATE INDEX i ON t (a); dRoP TABLE \"odd;name\"\nCASCADE\n;\nTrUnCaTe TABLE audit;\nALTER TABLE audit ADD COLUMN note text DEFAULT 'a;\nDROP TABLE b'"
    rows = [("odd_kind", "o", "z", "-- a note\nSELECT 1"), ("data", "d", 'invalid input syntax for type integer: "secret"', None), ("index", "i", "x\ny", many), ("table", "t", "bad type", "DROP TABLE IF EXISTS t CASCADE;\r\nCREATE TABLE t (a int)")]
    return jobs.failed_ddl(spark.createDataFrame(rows, "category string, name string, error string, ddl string"))


_PG = """DROP TABLE IF EXISTS "app"."users" CASCADE;
CREATE TABLE "app"."users" (
  "id" bigint NOT NULL,
  "name" varchar(100),
  "age" int DEFAULT ''0'',
  "created" timestamp DEFAULT CURRENT_TIMESTAMP,
  "flag" bit DEFAULT B''0''
);"""


_MY = """CREATE TABLE `app`.`users` (
  `id` bigint NOT NULL AUTO_INCREMENT,
  `name` varchar(100),
  `age` int DEFAULT 0,
  `created` datetime(6) DEFAULT CURRENT_TIMESTAMP,
  `flag` bit(1) DEFAULT 0
) ENGINE=InnoDB DEFAULT CHARSET=utf8mb4"""


_DM = """CREATE TABLE "APP"."USERS" (
  "ID" BIGINT IDENTITY(1, 1) NOT NULL,
  "NAME" VARCHAR2(100),
  "AGE" INT DEFAULT ''0'',
  "CREATED" TIMESTAMP DEFAULT CURRENT_TIMESTAMP,
  "FLAG" NUMBER(1) DEFAULT 0
)"""


_SPARK = """CREATE TABLE `app`.`users` (
  `id` bigint NOT NULL,
  `name` string,
  `age` int,
  `created` timestamp_ntz,
  `flag` boolean
) USING parquet"""


_DROP = "DROP TABLE IF EXISTS `app`.`users`"


@query(f"""SELECT dialect, 0 AS seq, '{_PG}' AS ddl FROM (VALUES ('postgres'), ('gaussdb'), ('seabox'), ('highgo'), ('kingbase')) v(dialect) UNION ALL
SELECT * FROM (VALUES ('mysql', 0, '{_DROP}'), ('mysql', 1, '{_MY}'), ('dameng', 0, 'DROP TABLE "APP"."USERS" CASCADE CONSTRAINTS'), ('dameng', 1, '{_DM}'), ('spark', 0, '{_DROP}'), ('spark', 1, '{_SPARK}')) v""")
def ddl_dialects(spark: SparkSession, sf: str) -> DataFrame:
    t = Table("users", [Column("id", "bigint", nullable=False, extra="auto_increment"), Column("name", "varchar", 100), Column("age", "int", default="0"), Column("created", "datetime", default="CURRENT_TIMESTAMP"), Column("flag", "bit", 1, default="b'0'")])
    return spark.createDataFrame([(n, i, s) for n, d in DIALECTS.items() for i, s in enumerate(d.create_table("app", t, "mysql"))], "dialect string, seq int, ddl string")


@query("SELECT * FROM (VALUES ('index failed [i]: e'), ('foreign key failed [f]: Key (a)=(<redacted>) is missing')) v(message)")
def review_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.object_warnings(spark.sql("SELECT * FROM VALUES ('index', 'i', 'e'), ('foreign_key', 'f', 'Key (a)=(4711) is missing'), ('table', 't', 'e'), ('data', 'd', 'e') AS v(category, name, error)"))


@query("SELECT * FROM (VALUES ('b', 'not unique: code'), ('d', 'not unique: id, tenant_id')) v(table_name, problem)")
def target_key_compatibility(spark: SparkSession, sf: str) -> DataFrame:
    loc = spark.sql("SELECT * FROM VALUES ('a', 'primary_key', array('tenant_id', 'id')), ('b', 'unique_key', array('code')), ('c', 'full_row', cast(array() as array<string>)), ('d', 'primary_key', array('tenant_id', 'id')) AS v(table_name, strategy, columns)")
    return jobs.key_compatibility(loc, spark.sql("SELECT * FROM VALUES ('a', array('id', 'tenant_id')), ('b', array('code', 'x')), ('d', array('id')) AS v(table_name, columns)"))


@query("SELECT * FROM (VALUES ('a', 'unique_key', 'uq', ['x'], 1, ''), ('b', 'primary_key', 'PRIMARY', ['id'], 1, 'changed'), ('c', 'full_row', '', [], 0, 'other_version'), ('d', 'primary_key', 'PRIMARY', ['id'], 1, 'gone'), ('e', 'full_row', '', [], 1, '')) v(table_name, strategy, index_name, columns, version, problem)")
def locator_freeze(spark: SparkSession, sf: str) -> DataFrame:
    old = spark.sql("SELECT * FROM VALUES ('a', 'unique_key', 'uq', array('x'), 1), ('b', 'primary_key', 'PRIMARY', array('id'), 1), ('c', 'full_row', '', cast(array() as array<string>), 0), ('d', 'primary_key', 'PRIMARY', array('id'), 1) AS v(table_name, strategy, index_name, columns, version)")
    new = spark.sql("SELECT * FROM VALUES ('a', 'unique_key', 'uq', array('x')), ('b', 'unique_key', 'uq', array('x')), ('c', 'full_row', '', cast(array() as array<string>)), ('e', 'full_row', '', cast(array() as array<string>)) AS v(table_name, strategy, index_name, columns)")
    return cdc.frozen_locators(old, new)


@query("SELECT * FROM (VALUES ('a', 'primary_key', 'PRIMARY', ['id']), ('b', 'unique_key', 'uq_code', ['code']), ('c', 'full_row', '', [])) v(table_name, strategy, index_name, columns)")
def locator_choice(spark: SparkSession, sf: str) -> DataFrame:
    src = spark.sql("""SELECT * FROM VALUES ('a', 'PRIMARY', array('id'), true, true, true), ('b', 'uq_tenant_email', array('tenant_id', 'email'), false, true, true), ('b', 'uq_code', array('code'), false, true, true),
        ('c', 'uq_x', array('x'), false, true, true), ('c', 'uq_null', array('y'), false, true, false) AS v(table_name, index_name, columns, is_primary, is_unique, usable)""")
    dst = spark.sql("SELECT * FROM VALUES ('b', array('email', 'tenant_id')), ('b', array('code')), ('c', array('y')) AS v(table_name, columns)")
    return cdc.choose_locators(spark.sql("SELECT * FROM VALUES ('a'), ('b'), ('c') AS v(table_name)"), src, dst)


@query("SELECT 'noise' AS table_name")
def scope_isolation(spark: SparkSession, sf: str) -> DataFrame:
    return verify.out_of_scope(spark.sql("SELECT * FROM VALUES ('orders'), ('noise') AS v(table_name)"), spark.sql("SELECT * FROM VALUES ('orders'), ('part') AS v(table_name)"))


@query("SELECT file, pos, hit FROM (VALUES ('binlog.000009', 500, false), ('binlog.000010', 99, false), ('binlog.000010', 100, true), ('binlog.000011', 4, true), ('binlog.000100', 4, true)) v(file, pos, hit)")
def position_reached_file(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.sql("SELECT * FROM VALUES ('binlog.000009', 500), ('binlog.000010', 99), ('binlog.000010', 100), ('binlog.000011', 4), ('binlog.000100', 4) AS v(file, pos)")
    return rows.select("file", "pos", reached_column("file", "pos", Position("binlog.000010", 100)).alias("hit"))
