"""Console, job lists, log pages, reviews and view rewriting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values, views
from ..operators import jobs
from .registry import load, query


@query("SELECT *, (SELECT count(*) FROM events) > 100 AS truncated FROM events ORDER BY event_id LIMIT 100")
def console_bounded_rows(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.bounded(load(spark, sf, "events"), ["event_id"], 100)


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE rtrim('.' || strftime(ts, '%f'), '0') END || 'Z' AS ts_text, 'base64:' || base64(encode(event_type)) AS raw_text FROM events")
def console_normalise(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").withColumn("raw", F.col("event_type").cast("binary"))
    return e.select("event_id", values.console_value(F.col("ts"), e.schema["ts"].dataType).alias("ts_text"), values.console_value(F.col("raw"), e.schema["raw"].dataType).alias("raw_text"))


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    states = F.array(*[F.lit(s) for v in jobs.STATUS_GROUPS.values() for s in v])
    e = load(spark, sf, "events")
    conn = load(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("conn_name"))
    e = e.select(F.col("event_id").alias("id"), "user_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise("").alias("own_name"), F.element_at(states, (F.col("event_id") % 19 + 1).cast("int")).alias("status"))
    return e.join(conn, "user_id", "left")


_STATES = "[" + ", ".join(f"'{s}'" for v in jobs.STATUS_GROUPS.values() for s in v) + "]"
_JOBS = f"(SELECT event_id AS id, e.user_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END AS own_name, {_STATES}[event_id % 19 + 1] AS status, c_name AS conn_name FROM events e LEFT JOIN customer ON c_custkey = e.user_id)"


@query(f"SELECT id, status FROM {_JOBS} WHERE lower(coalesce(nullif(own_name, ''), conn_name, '')) LIKE '%00012%' OR lower(status) LIKE '%00012%'")
def job_search(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.search(_jobs(spark, sf), " 00012 ", [jobs.first_of("own_name", "conn_name"), F.col("status")]).select("id", "status")


@query(f"SELECT id, status, (SELECT count(*) FROM {_JOBS} WHERE status IN ({', '.join(repr(s) for s in jobs.STATUS_GROUPS['attention'])})) AS total FROM {_JOBS} WHERE status IN ({', '.join(repr(s) for s in jobs.STATUS_GROUPS['attention'])}) ORDER BY id DESC LIMIT 20 OFFSET 40")
def job_page_total(spark: SparkSession, sf: str) -> DataFrame:
    rows, total = jobs.page_with_total(jobs.in_group(_jobs(spark, sf), "attention"), "id", 3, 20)
    return rows.select("id", "status").crossJoin(F.broadcast(total))


_GROUP_SQL = " ".join(f"WHEN status IN ({', '.join(repr(s) for s in v)}) THEN '{k}'" for k, v in jobs.STATUS_GROUPS.items())


@query(f"SELECT CASE {_GROUP_SQL} END AS status_group, count(*) AS n FROM {_JOBS} GROUP BY 1")
def status_group_counts(spark: SparkSession, sf: str) -> DataFrame:
    pairs = F.create_map(*[x for k, v in jobs.STATUS_GROUPS.items() for s in v for x in (F.lit(s), F.lit(k))])
    return _jobs(spark, sf).groupBy(F.element_at(pairs, F.col("status")).alias("status_group")).agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type FROM events WHERE event_id < 5000 ORDER BY event_id DESC LIMIT 50")
def audit_keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.keyset_page(load(spark, sf, "events").select("event_id", "event_type"), "event_id", 5000, 500)


_CUR = "SELECT event_id, event_type, (SELECT min(event_id) FROM events) < min(event_id) OVER () AS has_older, (SELECT max(event_id) FROM events) > max(event_id) OVER () AS has_newer FROM "


@query(_CUR + "(SELECT * FROM events ORDER BY event_id DESC LIMIT 40)")
def log_cursor_tail(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.cursor_page(load(spark, sf, "events").select("event_id", "event_type"), "event_id", 40)


@query(_CUR + "(SELECT * FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 40)")
def log_cursor_after(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.cursor_page(load(spark, sf, "events").select("event_id", "event_type"), "event_id", 40, after=100)


@query(_CUR + "(SELECT * FROM events WHERE event_id < 30 ORDER BY event_id DESC LIMIT 40)")
def log_cursor_before(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.cursor_page(load(spark, sf, "events").select("event_id", "event_type"), "event_id", 40, before=30)


@query("""WITH e AS (SELECT event_id AS id, user_id, CASE WHEN event_id % 3 = 0 THEN 'b' || CAST(event_id % 5 AS VARCHAR) WHEN event_id % 3 = 1 THEN '' END AS batch_id FROM events)
SELECT id, batch_id, 'single' AS origin FROM e WHERE user_id = 7 AND id % 3 <> 0 UNION ALL SELECT id, batch_id, 'batch' FROM e WHERE id % 3 = 0""")
def job_origin(spark: SparkSession, sf: str) -> DataFrame:
    """A user's own jobs, and for an administrator those that came of batches."""
    batch = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("b"), (F.col("event_id") % 5).cast("string"))).when(F.col("event_id") % 3 == 1, "")
    e = load(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("owner_id"), batch.alias("batch_id"))
    own, all_ = jobs.of_origin(jobs.visible_to(e, 7), "single"), jobs.of_origin(jobs.visible_to(e, 7, admin=True), "batch")
    return own.select("id", "batch_id", F.lit("single").alias("origin")).unionByName(all_.select("id", "batch_id", F.lit("batch").alias("origin")))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 10 DAY")
def retention_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.retained(load(spark, sf, "events"), "ts", "2024-01-30 00:00:00", 10).select("event_id")


@query("SELECT event_id, user_id AS job FROM events WHERE NOT (user_id % 4 IN (0, 1) AND user_id % 3 <> 0)")
def log_retention(spark: SparkSession, sf: str) -> DataFrame:
    """Every fourth job was stopped, every fourth aborted, the others failed or paused; a third of all has not ended long ago."""
    status = F.element_at(F.array(F.lit("stopped"), F.lit("aborted"), F.lit("failed"), F.lit("paused_manual")), (F.col("job") % 4 + 1).cast("int"))
    e = load(spark, sf, "events").select("event_id", F.col("user_id").alias("job"))
    ended = F.when(F.col("job") % 3 == 0, "2024-01-25 00:00:00").otherwise("2023-11-01 00:00:00").cast("timestamp_ntz")
    return jobs.retained_logs(e, e.select("job").distinct().select("job", status.alias("status"), ended.alias("finished_at")), "2024-01-30 00:00:00", 30)


_TAGS = ("INFO", "DDL", "DATA", "INDEX", "WARN", "ERROR", "DONE", "OTHER")


@query("""WITH l AS (SELECT event_id AS seq, user_id AS job, CASE WHEN event_id % 50 = 0 THEN '=== Phase ' || CAST(event_id % 4 + 1 AS VARCHAR) || ': x' ELSE '[' || ['INFO', 'DDL', 'DATA', 'INDEX', 'WARN', 'ERROR', 'DONE', 'OTHER'][event_id % 8 + 1] || '] text' END AS line FROM events)
SELECT seq, job, CASE WHEN line LIKE '[%' AND line NOT LIKE '[OTHER]%' THEN lower(substr(line, 2, position(']' IN line) - 2)) ELSE 'info' END AS level, last_value(CASE WHEN line LIKE '=== Phase%' THEN substr(line, 11, 1) END IGNORE NULLS) OVER (PARTITION BY job ORDER BY seq ROWS UNBOUNDED PRECEDING) AS phase FROM l""")
def log_journal(spark: SparkSession, sf: str) -> DataFrame:
    head = F.concat(F.lit("=== Phase "), (F.col("event_id") % 4 + 1).cast("string"), F.lit(": x"))
    tag = F.element_at(F.array(*[F.lit(t) for t in _TAGS]), (F.col("event_id") % 8 + 1).cast("int"))
    line = F.when(F.col("event_id") % 50 == 0, head).otherwise(F.concat(F.lit("["), tag, F.lit("] text")))
    return jobs.journal(load(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("job"), line.alias("line"))).drop("line")


def _view(spark: SparkSession, sf: str, dialect: str, body: str, *tables: str, **kw: bool) -> DataFrame:
    for t in tables:
        load(spark, sf, t).createOrReplaceTempView(t)
    return spark.sql(views.REWRITE[dialect](body, **kw))


@query("SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def view_group_concat(spark: SparkSession, sf: str) -> DataFrame:
    return _view(spark, sf, "mysql", "select n_regionkey, group_concat(n_name order by n_name separator ';') as names from nation group by n_regionkey", "nation")


@query("SELECT n_nationkey, CASE WHEN n_regionkey > 2 THEN 'hi, there' ELSE coalesce(n_name, 'x') END AS k FROM nation")
def view_if_ifnull(spark: SparkSession, sf: str) -> DataFrame:
    return _view(spark, sf, "mysql", "select n_nationkey, if(n_regionkey > 2, 'hi, there', ifnull(n_name, 'x')) as k from nation;", "nation")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) - DATE '0001-01-01' + 366 AS days, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS day_text FROM orders")
def view_dates(spark: SparkSession, sf: str) -> DataFrame:
    return _view(spark, sf, "mysql", "select o_orderkey, to_days(o_orderdate) as days, date_format(o_orderdate, '%Y-%m-%d %H:%i') as day_text from orders", "orders")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey")
def view_nested_from(spark: SparkSession, sf: str) -> DataFrame:
    return _view(spark, sf, "mysql", "select n_name, r_name from ((nation join region on((n_regionkey = r_regionkey))) join supplier on((s_nationkey = n_nationkey)))", "nation", "region", "supplier")


@query("SELECT n_name, coalesce(nullif(n_name, 'FRANCE'), 'none') AS f FROM nation")
def view_oracle_nvl(spark: SparkSession, sf: str) -> DataFrame:
    return _view(spark, sf, "oracle", 'select n_name, nvl(nullif(n_name, \'FRANCE\'), \'none\') as "f" from nation;', "nation")


@query("SELECT c_custkey, length(c_name) AS n, c_mktsegment || '-' || c_name AS label FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def view_sqlserver_top(spark: SparkSession, sf: str) -> DataFrame:
    body = "create view dbo.v with schemabinding as select top 10 c_custkey, len(c_name) as n, isnull(c_mktsegment, '') + '-' + c_name as 'label' from customer order by c_acctbal desc, c_custkey"
    return _view(spark, sf, "sqlserver", body, "customer", keep_top=True)


@query("SELECT c_custkey, c_custkey + c_nationkey AS total, c_name || 'a + b' AS label, c_custkey + 1 AS next FROM customer WHERE c_nationkey + 1 > 3")
def view_sqlserver_plus(spark: SparkSession, sf: str) -> DataFrame:
    """A sum of numbers stays one; with a string it is a concatenation."""
    return _view(spark, sf, "sqlserver", "select c_custkey, c_custkey + c_nationkey as total, c_name + 'a + b' as label, (c_custkey + 1) as next from customer where c_nationkey + 1 > 3", "customer")


@query("SELECT n_nationkey, 'it''s ' || n_name AS label FROM nation WHERE n_name <> 'FRANCE'")
def view_mysql_strings(spark: SparkSession, sf: str) -> DataFrame:
    return _view(spark, sf, "mysql", "select `n_nationkey`, concat(\"it's \", `n_name`) as `label` from `nation` where `n_name` <> \"FRANCE\"", "nation")


@query("SELECT p_partkey, coalesce(p_name, 'x') AS p FROM part")
def view_dameng(spark: SparkSession, sf: str) -> DataFrame:
    return _view(spark, sf, "dameng", 'CREATE OR REPLACE VIEW "A"."V" AS select p_partkey, ifnull(p_name, \'x\') as p from part;', "part")
