"""Reports, failed objects, error texts, statements and the workload, over rows of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.positions import Position, reached_column
from ..operators import checks, console, copy, jobs, workload
from .registry import load, query
from .relations import of

# Reports and failed objects

@query("""SELECT p_type AS category, count(*) AS total, count_if(p_partkey % 7 > 0) AS success, count_if(p_partkey % 7 = 0) AS failed, coalesce(list('p' || p_partkey ORDER BY 'p' || p_partkey) FILTER (WHERE p_partkey % 7 = 0), []) AS failed_items FROM part GROUP BY p_type""")
def report_totals(spark: SparkSession, sf: str) -> DataFrame:
    return copy.report(of(spark, sf, "part", "p_type AS category", "concat('p', p_partkey) AS name", "p_partkey % 7 > 0 AS ok", "'' AS error"))


@query("""WITH i AS (SELECT p_type AS c, 'p' || p_partkey AS name, p_partkey % 7 > 0 AS ok, p_brand AS error, CASE WHEN p_partkey % 14 = 0 THEN 'CREATE x' || chr(10) || '  (' || p_size || ')' END AS ddl FROM part),
n AS (SELECT c_custkey AS k, c_custkey - CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 0 END AS d FROM customer)
SELECT 1 AS section, c AS part, '' AS name, c || ': ' || count(*) || ' in all, ' || count_if(ok) || ' done, ' || count_if(NOT ok) || ' failed' AS line FROM i GROUP BY c
UNION ALL SELECT 2, c, name, c || ' ' || name || chr(10) || '  reason: ' || error || chr(10) || CASE WHEN ddl IS NULL THEN '  no DDL' ELSE '  DDL: ' || replace(ddl, chr(10), chr(10) || '  ') END FROM i WHERE NOT ok
UNION ALL SELECT 3, 'c' || k, '', 'c' || k || ': ' || k || ' source, ' || d || ' target, difference ' || (d - k) FROM n WHERE k <> d
UNION ALL SELECT 4, 'c' || k, '', 'c' || k || ': ' || k || ' source, ' || d || ' target' || CASE WHEN k = d THEN '' ELSE ' (differs)' END FROM n
UNION ALL SELECT 1, '~triggers', '', 'triggers: ' || count(*) || ' in all, not moved' FROM supplier""")
def report_text(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as objects of a job, customers as its tables, suppliers as triggers of their nations."""
    items = of(spark, sf, "part", "p_type AS category", "concat('p', p_partkey) AS name", "p_partkey % 7 > 0 AS ok", "p_brand AS error", "if(p_partkey % 14 = 0, concat('CREATE x\\n  (', p_size, ')'), null) AS ddl")
    counts = of(spark, sf, "customer", "concat('c', c_custkey) AS table_name", "c_custkey AS src_rows", "c_custkey - if(c_custkey % 5 = 0, 2, 0) AS dst_rows", "c_custkey % 5 > 0 AS matches")
    return checks.report_lines(items, counts, of(spark, sf, "supplier", "s_nationkey").groupBy(F.col("s_nationkey").alias("table_name")).agg(F.count("*").alias("triggers")))


@query("SELECT DISTINCT l_returnflag AS category, 'o' || l_orderkey % 100 AS name, l_linestatus AS error, CASE WHEN l_linenumber % 2 = 0 THEN 'ddl' || l_linenumber END AS ddl, 'objects' AS stage FROM lineitem")
def failed_objects_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.failed_objects(of(spark, sf, "lineitem", "l_returnflag AS category", "concat('o', l_orderkey % 100) AS name", "l_linestatus AS error", "if(l_linenumber % 2 = 0, concat('ddl', l_linenumber), null) AS ddl", "'objects' AS stage"))


@query("""WITH c AS (SELECT c_custkey AS k FROM customer)
SELECT CASE k % 5 WHEN 0 THEN 'table' WHEN 1 THEN 'data' WHEN 2 THEN 'primary_key' WHEN 3 THEN 'view' ELSE 'index' END AS category, CASE WHEN k % 5 < 2 THEN 'T' || k WHEN k % 5 = 2 THEN 't' || k ELSE 'v' || k END AS name, 'e' || k AS error, CASE WHEN k % 5 <> 1 THEN 'd' || k END AS ddl,
CASE k % 5 WHEN 0 THEN 'schema' WHEN 1 THEN 'data' ELSE 'objects' END AS stage FROM c
UNION ALL SELECT 'row_count', 'T' || k, CASE WHEN k % 11 = 0 THEN 'rows were not counted' ELSE 'rows differ: source=' || k || ' target=' || (k - 1) END, NULL, 'validation' FROM c WHERE k % 5 > 2 AND (k % 11 = 0 OR k % 7 = 0)
UNION ALL SELECT 'cdc_compatibility', 'T' || k, 'no key', NULL, 'validation' FROM c WHERE k % 5 > 2 AND k % 13 = 0""")
def failed_objects_of_report(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as tables: two of five fail as wholes, one by its key, of two others an object; counts and columns tell on the rest."""
    c = lambda *x: of(spark, sf, "customer", *x)
    kinds = "CASE c_custkey % 5 WHEN 0 THEN 'table' WHEN 1 THEN 'data' WHEN 2 THEN 'primary_key' WHEN 3 THEN 'view' ELSE 'index' END AS category"
    items = c(kinds, "concat(CASE WHEN c_custkey % 5 < 2 THEN 'T' WHEN c_custkey % 5 = 2 THEN 't' ELSE 'v' END, c_custkey) AS name", "concat('e', c_custkey) AS error", "if(c_custkey % 5 <> 1, concat('d', c_custkey), null) AS ddl")
    counts = c("concat(if(c_custkey % 11 = 0, 'n', 't'), c_custkey) AS table_name", "c_custkey AS src_rows", "c_custkey - if(c_custkey % 7 = 0, 1, 0) AS dst_rows", "c_custkey % 7 > 0 AS matches")
    return jobs.failures_of(c("concat('T', c_custkey) AS table_name"), items.unionByName(items), counts, c("concat('T', c_custkey) AS table_name", "if(c_custkey % 13 = 0, 'no key', '') AS error"), lower=True)


@query("""WITH p AS (SELECT p_partkey AS k, ['table', 'index', 'data', 'odd_kind'][p_partkey % 4 + 1] AS category, 'p' || p_partkey AS name FROM part),
s AS (SELECT *, CASE k % 4 WHEN 0 THEN '-- e' || k || chr(10) || '-- disabled: destructive' || chr(10) || '-- DROP TABLE IF EXISTS p' || k || ' CASCADE;' || chr(10) || 'CREATE TABLE p' || k || ' (a int);'
WHEN 1 THEN '-- e' || k || chr(10) || 'CREATE INDEX i ON p' || k || ' (a);' || chr(10) || '-- disabled: destructive' || chr(10) || '-- TrUnCaTe TABLE "a;b";' WHEN 2 THEN '-- invalid input syntax: "<redacted>"' ELSE '-- e' || k || chr(10) || '-- a note' || chr(10) || 'SELECT ' || k || ';' END AS script FROM p)
SELECT row_number() OVER (ORDER BY CASE category WHEN 'table' THEN 1 WHEN 'index' THEN 2 WHEN 'data' THEN 3 ELSE 4 END, category, name) AS seq, category, name, script FROM s""")
def failed_ddl_export(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as failed objects, each with a script: statement by statement, unknown categories last."""
    ddl = """CASE p_partkey % 4 WHEN 0 THEN concat('DROP TABLE IF EXISTS p', p_partkey, ' CASCADE;\\r\\nCREATE TABLE p', p_partkey, ' (a int)') WHEN 1 THEN concat('CREATE INDEX i ON p', p_partkey, ' (a); TrUnCaTe TABLE "a;b"') WHEN 3 THEN concat('-- a note\\nSELECT ', p_partkey) END AS ddl"""
    error = """if(p_partkey % 4 = 2, concat('invalid input syntax: "', p_name, '"'), concat('e', p_partkey)) AS error"""
    return jobs.failed_ddl(of(spark, sf, "part", "element_at(array('table', 'index', 'data', 'odd_kind'), cast(p_partkey % 4 + 1 AS int)) AS category", "concat('p', p_partkey) AS name", error, ddl))


@query("SELECT CASE WHEN p_partkey % 4 = 0 THEN 'index' ELSE 'foreign key' END || ' failed [p' || p_partkey || ']: Key (a, b)=(<redacted>) is missing' AS message FROM part WHERE p_partkey % 4 < 2")
def review_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.object_warnings(of(spark, sf, "part", "element_at(array('index', 'foreign_key', 'table', 'data'), cast(p_partkey % 4 + 1 AS int)) AS category", "concat('p', p_partkey) AS name", "concat('Key (a, b)=(', p_name, ', (x)) is missing') AS error"))


@query("""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'invalid input syntax for type integer: "<redacted>"' WHEN 1 THEN 'DETAIL: Key (a)=(<redacted>) already exists.' WHEN 2 THEN 'value out of range: "<redacted>"'
WHEN 3 THEN 'Incorrect integer value: "<redacted>" for column x' WHEN 4 THEN 'COPY t, line ' || p_size || ', column a: "<redacted>"' WHEN 5 THEN 'name "' || p_name || '" stays' ELSE p_name END AS line FROM part""")
def log_redaction(spark: SparkSession, sf: str) -> DataFrame:
    line = """CASE p_partkey % 7 WHEN 0 THEN concat('invalid input syntax for type integer: "', p_name, '"') WHEN 1 THEN concat('DETAIL: Key (a)=(', p_name, ') already exists.') WHEN 2 THEN concat('value out of range: "', p_brand, '"')
        WHEN 3 THEN concat("Incorrect integer value: '", p_name, "' for column x") WHEN 4 THEN concat('COPY t, line ', p_size, ', column a: "', p_type, '"') WHEN 5 THEN concat('name "', p_name, '" stays') ELSE p_name END AS line"""
    return of(spark, sf, "part", "p_partkey", line).select("p_partkey", jobs.redact(F.col("line")).alias("line"))


@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'capacity' WHEN 2 THEN 'capacity' WHEN 3 THEN 'environment' WHEN 4 THEN 'environment' WHEN 6 THEN '' ELSE 'correctness' END AS cls FROM events""")
def error_class(spark: SparkSession, sf: str) -> DataFrame:
    """Events as failed statements, with a number of the database's or a text alone."""
    number = "CASE event_id % 7 WHEN 0 THEN 1213 WHEN 1 THEN 1062 WHEN 2 THEN 1040 END AS number"
    text = "CASE event_id % 7 WHEN 3 THEN concat(event_type, ': Connection Refused') WHEN 4 THEN concat('no route to HOST ', user_id) WHEN 5 THEN event_type WHEN 6 THEN NULL ELSE 'too many open files' END AS text"
    return of(spark, sf, "events", "event_id", number, text).select("event_id", workload.error_class(F.col("number"), F.col("text")).alias("cls"))


_STATEMENTS = """CASE o_orderkey % 8 WHEN 0 THEN concat('select ', o_orderkey) WHEN 1 THEN concat('with x as (select 1) delete from t', o_custkey) WHEN 2 THEN concat('insert into t values (', o_orderkey, ') returning id')
WHEN 3 THEN concat('drop table t', o_orderkey) WHEN 4 THEN concat('select 1; select ', o_orderkey) WHEN 5 THEN 'begin' WHEN 6 THEN concat('select \\'a;', o_orderpriority, '\\' -- c') ELSE concat('/* open ', o_orderkey) END AS sql"""


@query("""SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'select' WHEN 1 THEN 'delete' WHEN 2 THEN 'insert' WHEN 3 THEN 'drop' WHEN 6 THEN 'select' ELSE '' END AS statement, CASE o_orderkey % 8 WHEN 0 THEN 'readonly' WHEN 1 THEN 'write' WHEN 2 THEN 'write' WHEN 3 THEN 'dangerous' WHEN 6 THEN 'readonly' ELSE 'rejected' END AS level,
o_orderkey % 8 IN (0, 2, 6) AS returns_rows, CASE o_orderkey % 8 WHEN 4 THEN 'not one statement' WHEN 5 THEN 'transaction control is not supported' WHEN 7 THEN 'comment is not closed' ELSE '' END AS error FROM orders""")
def console_classify(spark: SparkSession, sf: str) -> DataFrame:
    """An order as a statement of a console's log, classified."""
    return console.classified(of(spark, sf, "orders", "o_orderkey", _STATEMENTS)).select("o_orderkey", "statement", "level", "returns_rows", "error")


@query("SELECT event_id, CASE WHEN event_id // 1000 <> 3 THEN event_id // 1000 > 3 ELSE event_id % 1000 >= 500 END AS hit FROM events")
def position_reached_file(spark: SparkSession, sf: str) -> DataFrame:
    """Events as positions in files of a thousand each; numbers in names decide, not their texts."""
    at = of(spark, sf, "events", "event_id", "concat('binlog.', if(event_id < 10000, '00', ''), cast(event_id div 1000 AS string)) AS file", "event_id % 1000 AS pos")
    return at.select("event_id", reached_column("file", "pos", Position("binlog.003", 500)).alias("hit"))


# Workload: as many tables as suppliers and rows as line items

# Rounds of what is left over, one row of g each: a table with room takes a row a round as long as there are any.
_ALLOCATION = """WITH RECURSIVE n AS (SELECT (SELECT count(*) FROM supplier) AS tables, (SELECT count(*) FROM lineitem) AS total, (SELECT count(*) // 5 FROM lineitem) AS most), t AS (SELECT i, CASE WHEN (i + 1) % 97 = 0 THEN 0 ELSE 1 / pow(i + 8, 0.82) END AS w FROM (SELECT unnest(range(tables)) AS i FROM n)),
c AS (SELECT i, w, least(floor((SELECT total FROM n) * w / sum(w) OVER ()), (SELECT most FROM n))::BIGINT AS base FROM t), d AS (SELECT i, base, CASE WHEN w > 0 THEN (SELECT most FROM n) - base ELSE 0 END AS room FROM c),
g(k, rest) AS (SELECT 0::BIGINT, ((SELECT total FROM n) - (SELECT sum(base) FROM d))::BIGINT UNION ALL SELECT k + 1, rest - (SELECT count(*) FROM d WHERE room > k) FROM g WHERE rest > 0),
e AS (SELECT i FROM (SELECT i, rest, row_number() OVER (PARTITION BY k ORDER BY i) AS n FROM d JOIN g ON room > k WHERE rest > 0) WHERE n <= rest),
a AS (SELECT d.i::INTEGER AS i, ['primary', 'composite', 'unique', 'keyless', 'wide', 'mixed_case'][d.i % 6 + 1] AS kind, base + coalesce(n, 0) AS rows FROM d LEFT JOIN (SELECT i, count(*) AS n FROM e GROUP BY i) USING (i))"""


def _scale(spark: SparkSession, sf: str) -> tuple[int, int, int]:
    total = load(spark, sf, "lineitem").count()
    return load(spark, sf, "supplier").count(), total, total // 5


@query(f"{_ALLOCATION} SELECT i, kind, rows FROM a")
def workload_zipf_alloc(spark: SparkSession, sf: str) -> DataFrame:
    return workload.allocate(spark, *_scale(spark, sf))


@query(f"{_ALLOCATION} SELECT i, kind, rows FROM a ORDER BY rows DESC, i LIMIT greatest(1, (SELECT tables // 100 FROM n))")
def hot_tables_top1pct(spark: SparkSession, sf: str) -> DataFrame:
    return workload.hottest(workload.allocate(spark, *_scale(spark, sf)))


@query(f"{_ALLOCATION} SELECT i + 1 AS i, 'load_run2024x_' || CASE WHEN kind = 'mixed_case' THEN 'Mixed_' ELSE '' END || printf('%06d', i + 1) AS table_name, kind, rows FROM a")
def workload_profile(spark: SparkSession, sf: str) -> DataFrame:
    return workload.profile(spark, "Run-2024/x", *_scale(spark, sf))


@query("""WITH c AS (SELECT c_custkey AS i, c_name, c_custkey % 6 AS k FROM customer), f AS (SELECT (SELECT count(*) FROM orders) AS n), p AS (SELECT c_name FROM c WHERE k IN (0, 4) ORDER BY i LIMIT 2)
SELECT n AS seq, 'cross-' || n AS txn, c_name AS table_name, 'insert' AS action, n AS row_id, true AS committed FROM p, f UNION ALL SELECT n + 1, 'rollback-' || (n + 1), c_name, 'insert', n + 1, false FROM (SELECT c_name FROM c WHERE k IN (0, 4) ORDER BY i LIMIT 1), f
UNION ALL SELECT n + 2 + k, 'locator-' || (n + 2 + k), c_name, 'locator_update', n + 2 + k + CASE WHEN k = 0 THEN 1000000000 ELSE 0 END, true FROM (SELECT k, arg_min(c_name, i) AS c_name FROM c WHERE k < 3 GROUP BY k), f""")
def workload_boundary_fixtures(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as tables of all kinds; numbers begin after those of the orders."""
    kinds = F.array(*[F.lit(k) for k in workload.KINDS])
    tables = load(spark, sf, "customer").select(F.col("c_custkey").alias("i"), F.col("c_name").alias("table_name"), F.element_at(kinds, (F.col("c_custkey") % 6 + 1).cast("int")).alias("kind"))
    return workload.boundary_fixtures(tables, load(spark, sf, "orders").count())


@query("""SELECT id, (id % 31 + 1)::INTEGER AS tenant_id, printf('t%06d-r%012d', 3, id) AS code, CAST((id % 1000000) + (id % 10000) / 10000.0 AS DECIMAL(18,4)) AS amount,
CASE WHEN id % 1000 = 0 THEN repeat('long-note-', 500) WHEN id % 7 = 0 THEN NULL ELSE 'note-' || CAST(id % 1000 AS VARCHAR) END AS note, make_timestamp((1700000000 + id % 10000000) * 1000000 + id % 1000000) AS created_at FROM (SELECT unnest(range(0, (SELECT count(*) FROM orders))) AS id)""")
def workload_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A generated table of as many rows as there are orders."""
    return workload.rows(spark, 3, load(spark, sf, "orders").count()).select("id", "tenant_id", "code", "amount", "note", "created_at")
