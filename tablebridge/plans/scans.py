"""Scans, pages, joins, sets, catalog relations and value mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import values
from ..operators import verify
from ..sources import catalog, readers
from .registry import load, query

TABLES = "region nation customer supplier part orders lineitem events".split()


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'")
def scan_parquet(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").where("o_orderdate < timestamp_ntz'1996-01-01'").select("o_orderkey", "o_custkey", "o_orderstatus")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES))
def count_tables(spark: SparkSession, sf: str) -> DataFrame:
    return verify.table_counts({t: load(spark, sf, t) for t in TABLES}, "row_count")


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 500 OFFSET 1000")
def page_keyed(spark: SparkSession, sf: str) -> DataFrame:
    return readers.page(load(spark, sf, "orders"), ["o_orderkey"], 1000, 500)


@query("SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n BETWEEN 201 AND 300")
def page_rownum(spark: SparkSession, sf: str) -> DataFrame:
    return readers.page_by_rank(load(spark, sf, "orders"), [F.desc("o_totalprice"), F.col("o_orderkey")], 201, 300)


@query("SELECT (SELECT count(*) FROM orders) AS total, ceil((SELECT count(*) FROM orders) / 20000.0)::BIGINT AS pages")
def page_count(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / readers.PAGE))


@query("SELECT v.* FROM (VALUES ('nation', 0, 'n_nationkey', 'int'), ('nation', 1, 'n_name', 'string'), ('nation', 2, 'n_regionkey', 'int'), ('region', 0, 'r_regionkey', 'int'), ('region', 1, 'r_name', 'string')) v(table_name, position, column_name, data_type)")
def catalog_columns(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.columns_of(spark, {t: load(spark, sf, t) for t in ("nation", "region")}).drop("nullable")


@query("SELECT 'orders' AS table_name, 'o_orderkey' AS column_name, max(o_orderkey) + 1 AS start_value FROM orders UNION ALL SELECT 'part', 'p_partkey', max(p_partkey) + 1 FROM part UNION ALL SELECT 'none', 'o_orderkey', 1")
def seq_next_value(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    return catalog.next_values({("orders", "o_orderkey"): o, ("part", "p_partkey"): load(spark, sf, "part"), ("none", "o_orderkey"): o.where("false")})


# Values

@query("SELECT p_partkey AS p_partkey, lower(p_brand) AS brand_text, p_size AS p_size FROM part")
def copy_rename_lower(spark: SparkSession, sf: str) -> DataFrame:
    df = load(spark, sf, "part").select(F.col("p_partkey").alias("P_PARTKEY"), F.lower("p_brand").alias("BRAND_TEXT"), F.col("p_size").alias("P_SIZE"))
    return df.toDF(*[c.lower() for c in df.columns])


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '0' ELSE '1' END AS bit_text, p_size::BIGINT AS bit_number FROM part")
def copy_value_bit(spark: SparkSession, sf: str) -> DataFrame:
    one = F.unhex(F.lpad(F.hex(F.col("p_size") % 2), 2, "0"))
    return load(spark, sf, "part").select("p_partkey", values.bit_text(one).alias("bit_text"), values.bit_number(F.unhex(F.lpad(F.hex("p_size"), 4, "0"))).alias("bit_number"))


@query("SELECT p_partkey, lower(printf('%08x', p_partkey)) AS geo FROM part")
def copy_value_geometry(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select("p_partkey", values.geometry_text(F.unhex(F.concat(F.lit("000000E6"), F.lpad(F.hex("p_partkey"), 8, "0")))).alias("geo"))


@query("SELECT p_partkey, p_name AS p_name FROM part")
def copy_text_scrub(spark: SparkSession, sf: str) -> DataFrame:
    dirty = load(spark, sf, "part").select("p_partkey", F.concat(F.substring("p_name", 1, 2), F.lit("\x00"), F.substring("p_name", 3, 100)).alias("p_name"))
    return values.scrub_frame(dirty)


@query("SELECT event_id, rtrim(rtrim(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS ts_text FROM events UNION ALL SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') FROM orders")
def copy_datetime_text(spark: SparkSession, sf: str) -> DataFrame:
    a = load(spark, sf, "events").select("event_id", values.datetime_text(F.col("ts")).alias("ts_text"))
    return a.union(load(spark, sf, "orders").select("o_orderkey", values.datetime_text(F.col("o_orderdate"))))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS flag FROM events")
def copy_bool_int(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select("event_id", values.bool_number(F.col("event_type") == "error").alias("flag"))


# Joins and sets

@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_inner(spark: SparkSession, sf: str) -> DataFrame:
    c, n, r = (load(spark, sf, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("c_custkey", "n_name", "r_name")


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def join_left(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id").join(load(spark, sf, "labels"), "doc_id", "left").select("doc_id", "quality")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_semi(spark: SparkSession, sf: str) -> DataFrame:
    c, o = load(spark, sf, "customer"), load(spark, sf, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def join_anti(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id").join(load(spark, sf, "labels"), "doc_id", "left_anti")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer")
def join_exists_flag(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.lit(True).alias("x"))
    return load(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("x", F.lit(False)).alias("has_orders"))


@query("WITH v AS (SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id) SELECT conv_id, unnest(range(0, len(roles)))::INTEGER AS position, unnest(roles) AS role FROM v")
def join_positional(spark: SparkSession, sf: str) -> DataFrame:
    v = catalog.ordered_group(load(spark, sf, "conversations"), ["conv_id"], "turn", "role", "roles")
    return v.select("conv_id", F.posexplode("roles").alias("position", "role"))


@query("SELECT s_suppkey, coalesce(n_name, 'unknown') AS n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 10) ON s_nationkey = n_nationkey")
def join_lookup_default(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return catalog.merge_default(load(spark, sf, "supplier"), n, ["s_nationkey"], "n_name", "unknown").select("s_suppkey", "n_name")


@query("""WITH a AS (SELECT nullif(p_size % 7, 0) AS k, count(*) AS n FROM part GROUP BY 1), b AS (SELECT nullif(s_nationkey % 7, 0) AS k, count(*) AS m FROM supplier GROUP BY 1)
SELECT a.k, n, m FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k""")
def join_null_safe(spark: SparkSession, sf: str) -> DataFrame:
    a = load(spark, sf, "part").groupBy(F.nullif(F.col("p_size") % 7, F.lit(0)).alias("k")).agg(F.count("*").alias("n"))
    b = load(spark, sf, "supplier").groupBy(F.nullif(F.col("s_nationkey") % 7, F.lit(0)).alias("k2")).agg(F.count("*").alias("m"))
    return a.join(b, a.k.eqNullSafe(b.k2)).select("k", "n", "m")


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def set_union_all(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "nation").select(F.col("n_name").alias("name")).unionByName(load(spark, sf, "region").select(F.col("r_name").alias("name")))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("k")).join(load(spark, sf, "orders").select(F.col("o_custkey").alias("k")), "k", "left_anti").distinct()


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def set_intersection(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("k")).intersect(load(spark, sf, "orders").select(F.col("o_custkey").alias("k")))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_values(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'NO ACTION' WHEN event_type = 'click' THEN 'CASCADE' ELSE 'SET NULL' END AS action, (event_id & 1) = 1 AS odd FROM events WHERE event_type NOT LIKE 'pur%'")
def predicates_case_bit(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").where(~F.col("event_type").like("pur%"))
    action = F.when(F.col("event_type") == "error", "NO ACTION").when(F.col("event_type") == "click", "CASCADE").otherwise("SET NULL")
    return e.select("event_id", action.alias("action"), (F.col("event_id").bitwiseAND(1) == 1).alias("odd"))


@query("SELECT s_suppkey, md5(s_name) AS m, lower(hex(encode(s_name))) AS h, base64(encode(s_name)) AS b FROM supplier")
def hash_encode(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "supplier").select("s_suppkey", F.md5("s_name").alias("m"), F.lower(F.hex("s_name")).alias("h"), F.base64(F.col("s_name").cast("binary")).alias("b"))


@query("SELECT * FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return load(spark, sf, "orders").select("o_orderkey", F.row_number().over(w).alias("n")).where("n = 1")
