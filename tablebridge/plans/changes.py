"""Verification and change apply over the driver's tables."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.positions import merge_intervals
from ..operators import cdc, verify
from ..sources.store import TableStore
from ..streaming import apply as streaming
from .registry import load, query

ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
SHIFT = 1_000_000_000


def changed(base: DataFrame, key: str, **new: object) -> object:
    """A row struct of a table with some columns replaced."""
    return F.struct(*[(new[c] if c in new else F.col(c)).alias(c) for c in base.columns])


def order_log(spark: SparkSession, sf: str) -> DataFrame:
    """Ten actions by key: inserts of shifted keys, updates, a delete, and a change that is rolled back; one transaction a key."""
    o = load(spark, sf, "orders")
    m = F.pmod("o_orderkey", F.lit(10))
    row = changed(o, "o_orderkey")
    moved = changed(o, "o_orderkey", o_orderkey=F.col("o_orderkey") + SHIFT)
    status = changed(o, "o_orderkey", o_orderstatus=F.lit("X"))
    act = F.when(m <= 5, "insert").when(m == 8, "delete").otherwise("update")
    after = F.when(m <= 5, moved).when(m == 7, changed(o, "o_orderkey", o_orderkey=F.col("o_orderkey") + 2 * SHIFT)).when(m == 8, F.lit(None)).otherwise(status)
    return o.select(F.col("o_orderkey").alias("txn_seq"), F.lit(0).alias("op_seq"), act.alias("action"), F.when(m > 5, row).alias("before"), after.alias("after"))


def order_outcomes(log: DataFrame) -> DataFrame:
    return log.select("txn_seq", F.when(F.pmod("txn_seq", F.lit(10)) == 9, "rollback").otherwise("commit").alias("outcome"))


_O = ", ".join(ORDER_COLS)
_ORDERS_AFTER = f"""SELECT {_O} FROM orders WHERE o_orderkey % 10 NOT IN (6, 7, 8)
UNION ALL SELECT o_orderkey + {SHIFT}, {", ".join(ORDER_COLS[1:])} FROM orders WHERE o_orderkey % 10 <= 5
UNION ALL SELECT o_orderkey, o_custkey, 'X', o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 10 = 6
UNION ALL SELECT o_orderkey + {2 * SHIFT}, {", ".join(ORDER_COLS[1:])} FROM orders WHERE o_orderkey % 10 = 7"""


@query(_ORDERS_AFTER)
def cdc_keyed(spark: SparkSession, sf: str) -> DataFrame:
    log = order_log(spark, sf)
    return cdc.apply_keyed(load(spark, sf, "orders"), cdc.committed(log, order_outcomes(log)), ["o_orderkey"])


@query(f"SELECT {_O} FROM orders UNION ALL SELECT o_orderkey + {SHIFT}, {', '.join(ORDER_COLS[1:])} FROM orders WHERE o_orderkey % 10 <= 5")
def cdc_insert(spark: SparkSession, sf: str) -> DataFrame:
    return cdc.apply_keyed(load(spark, sf, "orders"), order_log(spark, sf).where("action = 'insert'"), ["o_orderkey"])


@query(f"SELECT {_O} FROM orders WHERE o_orderkey % 10 <> 6 UNION ALL SELECT o_orderkey, o_custkey, 'X', o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 10 = 6")
def cdc_update(spark: SparkSession, sf: str) -> DataFrame:
    return cdc.apply_keyed(load(spark, sf, "orders"), order_log(spark, sf).where("action = 'update' and pmod(txn_seq, 10) = 6"), ["o_orderkey"])


@query(f"SELECT {_O} FROM orders WHERE o_orderkey % 10 <> 8")
def cdc_delete(spark: SparkSession, sf: str) -> DataFrame:
    return cdc.apply_keyed(load(spark, sf, "orders"), order_log(spark, sf).where("action = 'delete'"), ["o_orderkey"])


@query(_ORDERS_AFTER)
def cdc_upsert_idempotent(spark: SparkSession, sf: str) -> DataFrame:
    """The same log twice: the second time changes nothing."""
    log = order_log(spark, sf)
    done = cdc.committed(log, order_outcomes(log))
    return cdc.apply_keyed(cdc.apply_keyed(load(spark, sf, "orders"), done, ["o_orderkey"]), done, ["o_orderkey"])


@query(f"SELECT {_O} FROM orders")
def cdc_rollback(spark: SparkSession, sf: str) -> DataFrame:
    log = order_log(spark, sf).where("pmod(txn_seq, 10) = 9")
    return cdc.apply_keyed(load(spark, sf, "orders"), cdc.committed(log, order_outcomes(log)), ["o_orderkey"])


@query(f"SELECT {_O} FROM orders WHERE o_orderkey % 10 <> 7 UNION ALL SELECT o_orderkey + {2 * SHIFT}, {', '.join(ORDER_COLS[1:])} FROM orders WHERE o_orderkey % 10 = 7")
def cdc_key_change(spark: SparkSession, sf: str) -> DataFrame:
    return cdc.apply_keyed(load(spark, sf, "orders"), order_log(spark, sf).where("pmod(txn_seq, 10) = 7"), ["o_orderkey"])


@query("SELECT conv_id, turn, role, CASE WHEN turn = 1 THEN 'edited' ELSE text END AS text FROM conversations WHERE turn <> 2")
def cdc_composite_key(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "conversations")
    act = F.when(F.col("turn") == 2, "delete").otherwise("update")
    after = F.when(F.col("turn") == 1, F.struct("conv_id", "turn", "role", F.lit("edited").alias("text")))
    log = c.where("turn in (1, 2)").select(F.col("conv_id").alias("txn_seq"), F.col("turn").cast("int").alias("op_seq"), act.alias("action"), F.struct(*c.columns).alias("before"), after.alias("after"))
    return cdc.apply_keyed(c, log, ["conv_id", "turn"])


@query("SELECT c_name, c_custkey, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")
def cdc_unique_locator(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer").select("c_name", "c_custkey", "c_nationkey", "c_acctbal")
    after = F.struct("c_name", "c_custkey", "c_nationkey", F.lit(0.0).alias("c_acctbal"))
    log = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("txn_seq"), F.lit(0).alias("op_seq"), F.lit("update").alias("action"), F.struct(*c.columns).alias("before"), after.alias("after"))
    return cdc.apply_keyed(c, log, ["c_name"])


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'kept' END AS extra FROM supplier")
def cdc_target_only_columns(spark: SparkSession, sf: str) -> DataFrame:
    """A column of the target alone lives on through updates and is reset by a delete with a new insert."""
    s = load(spark, sf, "supplier").select("s_suppkey", "s_name")
    ins = F.array(F.struct(F.lit(1).alias("op"), F.lit("delete").alias("a")), F.struct(F.lit(2).alias("op"), F.lit("insert").alias("a")))
    upd = F.array(F.struct(F.lit(1).alias("op"), F.lit("update").alias("a")))
    log = s.select("*", F.explode(F.when(F.col("s_suppkey") % 5 == 0, ins).otherwise(upd)).alias("e"))
    log = log.select(F.col("s_suppkey").alias("txn_seq"), F.col("e.op").alias("op_seq"), F.col("e.a").alias("action"), F.struct("s_suppkey", "s_name").alias("before"), F.struct("s_suppkey", "s_name").alias("after"))
    return cdc.apply_keyed(s.withColumn("extra", F.lit("kept")), log, ["s_suppkey"], carried=["extra"])


LINE_COLS = ["l_returnflag", "l_linestatus", "l_quantity"]


def line_bag(spark: SparkSession, sf: str) -> DataFrame:
    """A table without key and with many equal rows."""
    return load(spark, sf, "lineitem").select(*LINE_COLS)


def line_log(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh order's lines: one row leaves, one changes its quantity, one comes."""
    x = load(spark, sf, "lineitem").where("l_orderkey % 7 = 0")
    m = F.pmod(F.col("l_linenumber") + F.col("l_partkey"), F.lit(3))
    row, zero = F.struct(*LINE_COLS), F.struct("l_returnflag", "l_linestatus", F.lit(0.0).alias("l_quantity"))
    return x.select(F.col("l_orderkey").alias("txn_seq"), F.col("l_linenumber").alias("op_seq"), F.when(m == 0, "delete").when(m == 1, "update").otherwise("insert").alias("action"), F.when(m < 2, row).alias("before"), F.when(m > 0, zero).alias("after"))


@query("""SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem WHERE NOT (l_orderkey % 7 = 0 AND (l_linenumber + l_partkey) % 3 < 2)
UNION ALL SELECT l_returnflag, l_linestatus, 0.0 FROM lineitem WHERE l_orderkey % 7 = 0 AND (l_linenumber + l_partkey) % 3 > 0""")
def cdc_keyless_multiset(spark: SparkSession, sf: str) -> DataFrame:
    return cdc.apply_keyless(line_bag(spark, sf), line_log(spark, sf))


@query("WITH c AS (SELECT l_returnflag, l_linestatus, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_returnflag, l_linestatus, l_quantity FROM (SELECT *, unnest(range(0, n - 1)) FROM c) WHERE n > 1 UNION ALL SELECT l_returnflag, l_linestatus, l_quantity FROM c WHERE false")
def cdc_keyless_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """One of each group of equal rows leaves, the others stay."""
    bag = line_bag(spark, sf)
    log = bag.distinct().select(F.lit(1).cast("long").alias("txn_seq"), F.lit(0).alias("op_seq"), F.lit("delete").alias("action"), F.struct(*LINE_COLS).alias("before"), F.lit(None).cast(bag.schema).alias("after"))
    return cdc.apply_keyless(bag, log)


_NONE = "[('Z', 'Z', -1.0)]"


def _bad_log(spark: SparkSession, sf: str, at: int) -> DataFrame:
    """The line log and a delete of a row that is not there."""
    log = line_log(spark, sf)
    bad = spark.createDataFrame([(at, 99, "delete", ("Z", "Z", -1.0), None)], log.schema)
    return log.unionByName(bad)


@query("SELECT CAST(700 AS BIGINT) AS txn_seq, 99 AS op_seq, 'delete' AS action")
def cdc_conflict(spark: SparkSession, sf: str) -> DataFrame:
    return cdc.conflicts(line_bag(spark, sf), _bad_log(spark, sf, 700)).select("txn_seq", "op_seq", "action")


@query("""SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem WHERE NOT (l_orderkey % 7 = 0 AND l_orderkey < 700 AND (l_linenumber + l_partkey) % 3 < 2)
UNION ALL SELECT l_returnflag, l_linestatus, 0.0 FROM lineitem WHERE l_orderkey % 7 = 0 AND l_orderkey < 700 AND (l_linenumber + l_partkey) % 3 > 0""")
def cdc_conflict_cut(spark: SparkSession, sf: str) -> DataFrame:
    bag, log = line_bag(spark, sf), _bad_log(spark, sf, 700)
    stop = cdc.conflicts(bag, log).agg(F.min("txn_seq"))
    return cdc.apply_keyless(bag, cdc.cut([log], [stop])[0])


@query(f"""WITH o AS ({_ORDERS_AFTER.replace("FROM orders WHERE ", "FROM orders WHERE o_orderkey < 700 AND ")} UNION ALL SELECT {_O} FROM orders WHERE o_orderkey >= 700),
l AS (SELECT l_quantity FROM lineitem WHERE NOT (l_orderkey % 7 = 0 AND l_orderkey < 700 AND (l_linenumber + l_partkey) % 3 < 2) UNION ALL SELECT 0.0 FROM lineitem WHERE l_orderkey % 7 = 0 AND l_orderkey < 700 AND (l_linenumber + l_partkey) % 3 > 0)
SELECT (SELECT count(*) FROM o) AS orders_rows, (SELECT count(*) FROM o WHERE o_orderstatus = 'X') AS marked, (SELECT count(*) FROM l) AS line_rows, (SELECT CAST(sum(l_quantity) AS BIGINT) FROM l) AS quantity""")
def cdc_txn_atomic_multi_table(spark: SparkSession, sf: str) -> DataFrame:
    """A conflict in one table stops all tables before the same transaction."""
    bag, lines, orders = line_bag(spark, sf), _bad_log(spark, sf, 700), order_log(spark, sf)
    stop = cdc.conflicts(bag, lines).agg(F.min("txn_seq"))
    o_log, l_log = cdc.cut([cdc.committed(orders, order_outcomes(orders)), lines], [stop])
    o = cdc.apply_keyed(load(spark, sf, "orders"), o_log, ["o_orderkey"]).agg(F.count("*").alias("orders_rows"), F.count_if(F.col("o_orderstatus") == "X").alias("marked"))
    return o.crossJoin(cdc.apply_keyless(bag, l_log).agg(F.count("*").alias("line_rows"), F.sum("l_quantity").cast("long").alias("quantity")))


@query("SELECT count(*) AS left_over, min(o_orderkey) AS first_txn FROM orders WHERE o_orderkey > 5000")
def cdc_replay_skip(spark: SparkSession, sf: str) -> DataFrame:
    return cdc.after_position(order_log(spark, sf), 5000).agg(F.count("*").alias("left_over"), F.min("txn_seq").alias("first_txn"))


@query("SELECT count(*) AS applied, max(o_orderkey) AS last_txn FROM orders WHERE o_orderkey < 120")
def cdc_ddl_pause(spark: SparkSession, sf: str) -> DataFrame:
    texts = spark.sql("SELECT * FROM VALUES (100L, 'insert into t values (1)'), (120L, ' alter table t add x int'), (300L, 'drop table t') AS v(txn_seq, statement)")
    return cdc.cut([order_log(spark, sf)], [cdc.first_ddl(texts)])[0].agg(F.count("*").alias("applied"), F.max("txn_seq").alias("last_txn"))


@query("SELECT count(*) AS applied, max(o_orderkey) AS last_txn FROM orders WHERE o_orderkey <= 250")
def cdc_boundary(spark: SparkSession, sf: str) -> DataFrame:
    return cdc.cut([order_log(spark, sf)], [], boundary=250)[0].agg(F.count("*").alias("applied"), F.max("txn_seq").alias("last_txn"))


@query("SELECT count_if(o_orderkey % 10 <= 5) AS inserts, count_if(o_orderkey % 10 IN (6, 7, 9)) AS updates, count_if(o_orderkey % 10 = 8) AS deletes, count_if(o_orderkey % 7 = 0) AS skipped, count_if(o_totalprice > 100000) AS warnings, count(*) AS txns, max(o_orderkey) AS last_txn FROM orders")
def cdc_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of transactions add up; every seventh was applied before, dear orders are warned of."""
    log = order_log(spark, sf)
    marked = log.withColumns({"skipped": F.pmod("txn_seq", F.lit(7)) == 0, "warnings": F.coalesce("before.o_totalprice", "after.o_totalprice") > 100000})
    return cdc.change_stats(cdc.batch_stats(marked))


@query("""WITH s AS (SELECT user_id AS job, ts AS seen, greatest(0, event_id % 40 - 20) AS behind FROM events), m AS (SELECT job, max(seen) FILTER (WHERE behind > 0) AS late FROM s GROUP BY job)
SELECT s.job, count(*) AS samples, max(behind) AS max_lag, arg_max(behind, seen) AS last_lag, min(seen) FILTER (WHERE late IS NULL OR seen > late) AS caught_up_at FROM s JOIN m USING (job) GROUP BY s.job""")
def lag_peaks(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select(F.col("user_id").alias("job"), F.col("ts").alias("at"), F.greatest(F.lit(0), F.col("event_id") % 40 - 20).alias("lag_seconds"))
    return cdc.lag_peaks(e)


@query("""WITH x AS (SELECT l_orderkey AS txn_seq, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY ALL), y AS (SELECT *, unnest(range(0, CASE n % 3 WHEN 1 THEN 2 ELSE 5 END)) AS i FROM x)
SELECT txn_seq, CAST(1000000 * n + i AS BIGINT) AS op_seq, CASE n % 3 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' ELSE 'delete' END AS action, CASE n % 3 WHEN 1 THEN p + 2 * i WHEN 2 THEN p + i END AS old_part, CASE n % 3 WHEN 0 THEN p + i WHEN 1 THEN p + 2 * i + 1 END AS new_part FROM y""")
def cdc_pair_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Events of five rows each: those of an update are two pairs and one row without its pair."""
    x = load(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    kind = F.element_at(F.array(F.lit("insert"), F.lit("update"), F.lit("delete")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    rows = x.select(F.col("l_orderkey").alias("txn_seq"), F.col("l_linenumber").cast("long").alias("op_seq"), kind.alias("kind"), "p", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("n"))
    log = cdc.pair_updates(rows.select("txn_seq", "op_seq", "kind", "n", F.struct((F.col("p") + F.col("n")).alias("part")).alias("row")))
    return log.select("txn_seq", (F.col("op_seq.event") * 1_000_000 + F.col("op_seq.row")).alias("op_seq"), "action", F.col("before.part").alias("old_part"), F.col("after.part").alias("new_part"))


@query("SELECT max(o_orderkey) AS head, max(o_orderkey) FILTER (WHERE o_orderkey <= 300) AS applied, count_if(o_orderkey <= 300 AND o_orderkey % 10 = 6) AS marked FROM orders")
def stream_boundary(spark: SparkSession, sf: str) -> DataFrame:
    """A stream that stops at a boundary; the source's head stays ahead of it."""
    root = shared(spark)
    orders, log = load(spark, sf, "orders"), order_log(spark, sf)
    store = TableStore(spark, f"{root}/store")
    store.commit(store.latest(), {"orders": store.stage("orders", orders)}, -1)
    row = T.StructType([T.StructField(f.name, f.dataType) for f in orders.schema])
    full = log.select("txn_seq", "op_seq", F.lit("orders").alias("table_name"), "action", "before", "after", F.lit("").alias("statement"))
    empty = F.lit(None).cast(row)
    ends = log.select("txn_seq", F.lit(99).alias("op_seq"), F.lit("").alias("table_name"), F.lit("commit").alias("action"), empty.alias("before"), empty.alias("after"), F.lit("").alias("statement"))
    full.unionByName(ends).write.json(f"{root}/log")
    control = streaming.Control(boundary=300)
    streaming.stream(spark, store, f"{root}/log", streaming.log_schema(row), {"orders": ["o_orderkey"]}, f"{root}/checkpoint", control=control).awaitTermination()
    marked = store.read("orders").where(f"o_orderkey < {SHIFT}").agg(F.count_if((F.col("o_orderstatus") == "X") & (F.pmod("o_orderkey", F.lit(10)) == 6)).alias("marked"))
    return streaming.head_of(spark, f"{root}/log", streaming.log_schema(row)).crossJoin(marked).withColumn("applied", F.lit(control.position).cast("long"))


@query("WITH e AS (SELECT max(ts) AS head, max(ts) FILTER (WHERE event_id < 9000) AS applied FROM events) SELECT applied >= head AS caught_up, CASE WHEN applied >= head THEN 0 ELSE epoch(head) - epoch(applied) END::BIGINT AS lag_seconds FROM (SELECT date_trunc('second', head) AS head, date_trunc('second', applied) AS applied FROM e)")
def cdc_lag(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").agg(F.date_trunc("second", F.max("ts")).alias("head"), F.date_trunc("second", F.max(F.when(F.col("event_id") < 9000, F.col("ts")))).alias("applied"))
    lag = F.unix_timestamp(F.col("head").cast("timestamp")) - F.unix_timestamp(F.col("applied").cast("timestamp"))
    done = F.col("applied") >= F.col("head")
    return e.select(done.alias("caught_up"), F.when(done, 0).otherwise(lag).cast("long").alias("lag_seconds"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, max(o_orderkey) AS last_key, count_if(o_orderstatus = 'X') AS marked FROM (" + _ORDERS_AFTER + ")")
def cdc_streaming_foreachbatch(spark: SparkSession, sf: str) -> DataFrame:
    """The order log as two files of a stream, applied by foreachBatch to a versioned store."""
    root = shared(spark)
    orders, log = load(spark, sf, "orders"), order_log(spark, sf)
    store = TableStore(spark, f"{root}/store")
    store.commit(store.latest(), {"orders": store.stage("orders", orders)}, -1)
    row = T.StructType([T.StructField(f.name, f.dataType) for f in orders.schema])
    full = log.select("txn_seq", "op_seq", F.lit("orders").alias("table_name"), "action", "before", "after", F.lit("").alias("statement"))
    empty = F.lit(None).cast(row)
    ends = order_outcomes(log).select("txn_seq", F.lit(99).alias("op_seq"), F.lit("").alias("table_name"), F.col("outcome").alias("action"), empty.alias("before"), empty.alias("after"), F.lit("").alias("statement"))
    full.unionByName(ends).repartition(2).write.json(f"{root}/log")
    streaming.stream(spark, store, f"{root}/log", streaming.log_schema(row), {"orders": ["o_orderkey"]}, f"{root}/checkpoint").awaitTermination()
    return store.read("orders").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last_key"), F.count_if(F.col("o_orderstatus") == "X").alias("marked"))


def shared(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


# Verification

_DEC = "CASE WHEN contains({0}, '.') THEN rtrim(rtrim({0}, '0'), '.') ELSE {0} END"


def _sql_hash(cols: list[str]) -> str:
    """Row hash of text columns in SQL."""
    return "sha256(" + " || ".join(f"unhex(printf('%016X', octet_length(encode({c})))) || encode({c})" for c in cols) + ")"


_NATION = ["CAST(n_nationkey AS VARCHAR)", "n_name", "CAST(n_regionkey AS VARCHAR)"]
_LINE = ["CAST(l_orderkey AS VARCHAR)", "CAST(l_linenumber AS VARCHAR)", "l_returnflag", "strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.%f')"]
_CUST = ["CAST(c_custkey AS VARCHAR)", "coalesce(nullif(c_mktsegment, 'BUILDING'), '<NULL>')"]


@query(f"SELECT c_custkey, {_sql_hash(_CUST)} AS row_hash FROM customer")
def row_hash(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer").select("c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("seg"))
    return c.select("c_custkey", verify.row_hash(c).alias("row_hash"))


@query(f"SELECT count(*) AS row_count, sha256(unhex(string_agg(h, '' ORDER BY n_nationkey))) AS digest FROM (SELECT n_nationkey, {_sql_hash(_NATION)} AS h FROM nation)")
def digest_ordered(spark: SparkSession, sf: str) -> DataFrame:
    return verify.ordered_digest(load(spark, sf, "nation"), ["n_nationkey"])


@query(f"SELECT o_orderkey // 1000 AS bucket, count(*) AS row_count, sha256(unhex(string_agg(h, '' ORDER BY o_orderkey))) AS digest FROM (SELECT o_orderkey, {_sql_hash(['CAST(o_orderkey AS VARCHAR)', 'o_orderstatus'])} AS h FROM orders) GROUP BY 1")
def digest_by_range(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    return verify.digest_by_range(o, F.floor(F.col("o_orderkey") / 1000), ["o_orderkey"], ["o_orderkey", "o_orderstatus"])


@query(f"SELECT sum(n)::BIGINT AS row_count, sha256(unhex(string_agg(d, '' ORDER BY bucket))) AS digest FROM (SELECT o_orderkey // 1000 AS bucket, count(*) AS n, sha256(unhex(string_agg(h, '' ORDER BY o_orderkey))) AS d FROM (SELECT o_orderkey, {_sql_hash(['CAST(o_orderkey AS VARCHAR)', 'o_orderstatus'])} AS h FROM orders) GROUP BY 1)")
def digest_chained(spark: SparkSession, sf: str) -> DataFrame:
    return verify.chained_digest(load(spark, sf, "orders"), F.floor(F.col("o_orderkey") / 1000), ["o_orderkey"], ["o_orderkey", "o_orderstatus"])


@query(f"SELECT 'unique' AS kind, count(*) AS row_count, sha256(unhex(string_agg(h, '' ORDER BY code))) AS digest FROM (SELECT n_name AS code, {_sql_hash(['n_name', 'CAST(n_regionkey AS VARCHAR)'])} AS h FROM nation) UNION ALL SELECT 'primary', count(*), sha256(unhex(string_agg(h, '' ORDER BY id))) FROM (SELECT n_nationkey AS id, {_sql_hash(['CAST(n_nationkey AS VARCHAR)', 'n_name'])} AS h FROM nation)")
def digest_order_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "nation")
    one = lambda df, kind: verify.digest_of_kind(df, kind).withColumn("kind", F.lit(kind))
    return one(n.select(F.col("n_name").alias("code"), "n_regionkey"), "unique").unionByName(one(n.select(F.col("n_nationkey").alias("id"), "n_name"), "primary"))


_LANES = ", ".join(f"CAST(sum(CAST(('0x' || substr(h, {16 * i + 1}, 16))::UBIGINT AS HUGEINT)) % 18446744073709551616 AS DECIMAL(20,0)) AS sum{i}, CAST(CASE WHEN bit_xor(('0x' || substr(h, {16 * i + 1}, 16))::UBIGINT) >= 9223372036854775808 THEN CAST(bit_xor(('0x' || substr(h, {16 * i + 1}, 16))::UBIGINT) AS HUGEINT) - 18446744073709551616 ELSE CAST(bit_xor(('0x' || substr(h, {16 * i + 1}, 16))::UBIGINT) AS HUGEINT) END AS BIGINT) AS xor{i}" for i in range(4))


@query(f"SELECT count(*) AS row_count, {_LANES} FROM (SELECT {_sql_hash(_LINE)} AS h FROM lineitem)")
def digest_multiset_lanes(spark: SparkSession, sf: str) -> DataFrame:
    return verify.multiset_lanes(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate"])


_ALL_LINE = [f"CAST({c} AS VARCHAR)" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")] + ["l_returnflag", "l_linestatus", "strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.%f')"]
_LANE = "('0x' || substr(h, {}, 16))::UBIGINT"
_DIGEST = ["count(*)", *[f"(sum({_LANE.format(16 * i + 1)}::HUGEINT) % 18446744073709551616)" for i in range(4)], *[f"bit_xor({_LANE.format(16 * i + 1)})" for i in range(4)]]


@query(f"SELECT count(*) AS row_count, sha256(unhex({' || '.join(f'lpad(hex({x}::UBIGINT), 16, {chr(39)}0{chr(39)})' for x in _DIGEST)})) AS digest FROM (SELECT {_sql_hash(_ALL_LINE)} AS h FROM lineitem)")
def digest_multiset(spark: SparkSession, sf: str) -> DataFrame:
    return verify.multiset_digest(load(spark, sf, "lineitem"))


@query("SELECT 'orders' AS table_name, count(*) AS src_rows, count(*) FILTER (WHERE o_orderkey % 100 <> 0) AS dst_rows, false AS matches FROM orders UNION ALL SELECT 'part', count(*), count(*), true FROM part UNION ALL SELECT 'nation', count(*), 0, false FROM nation")
def count_compare(spark: SparkSession, sf: str) -> DataFrame:
    o, p = load(spark, sf, "orders"), load(spark, sf, "part")
    return verify.compare_counts({"orders": o, "part": p, "nation": load(spark, sf, "nation")}, {"orders": o.where("o_orderkey % 100 <> 0"), "part": p})


_P = ", ".join(f"max(CASE WHEN r = floor((n - 1) * {p}) THEN value END) AS p{int(p * 100)}" for p in (0.5, 0.95, 0.99))


@query(f"SELECT event_type, max(n) AS n, {_P} FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type")
def latency_percentiles_floor(spark: SparkSession, sf: str) -> DataFrame:
    return verify.floor_percentiles(load(spark, sf, "events"), ["event_type"], "value")


@query("SELECT count(*) AS committed, CAST(round(1000000 * count(*) / (epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))))) AS BIGINT) AS per_million_seconds FROM events")
def throughput(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").agg(F.count("*").alias("committed"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    seconds = F.unix_timestamp(F.col("b").cast("timestamp")) - F.unix_timestamp(F.col("a").cast("timestamp"))
    return e.select("committed", F.round(1_000_000 * F.col("committed") / seconds).cast("long").alias("per_million_seconds"))


# Positions

@query("""WITH x AS (SELECT CAST(o_custkey % 50 AS VARCHAR) AS uuid, o_orderkey AS lo, o_orderkey + o_orderkey % 40 AS hi FROM orders),
y AS (SELECT *, max(hi) OVER (PARTITION BY uuid ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM x),
z AS (SELECT *, sum(CASE WHEN top IS NULL OR lo > top + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY uuid ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM y)
SELECT uuid, min(lo) AS lo, max(hi) AS hi FROM z GROUP BY uuid, island""")
def gtid_merge(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    return merge_intervals(o.select((F.col("o_custkey") % 50).cast("string").alias("uuid"), F.col("o_orderkey").alias("lo"), (F.col("o_orderkey") + F.col("o_orderkey") % 40).alias("hi")))
