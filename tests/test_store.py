"""Bucketed tables, pinned versions, pending transactions, acknowledged schema changes."""

import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablebridge.operators import cdc
from tablebridge.sources import store as stores
from tablebridge.sources.store import Conflict, TableStore
from tablebridge.streaming import apply as streaming

COLS = ["k", "v"]


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def logged(spark, schema, *entries):
    return spark.createDataFrame([(*e, "") if len(e) == 6 else e for e in entries], streaming.log_schema(schema))


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, f"file://{tmp_path}/store")


@pytest.fixture
def wide(spark, store):
    """A table of 20,000 rows in 20 buckets and one that nothing touches."""
    base = spark.range(20_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    store.commit(store.latest(), {"t": store.stage_buckets("t", base, ["k"], 20), "other": store.stage_buckets("other", base, ["k"], 4), "plain": store.stage("plain", base)}, 0)
    return base


def test_a_small_batch_writes_its_rows_alone(spark, store, wide):
    before = store.latest()
    changes = [(1, i, "t", "update", (100 * i, None), (100 * i, "new"), "") for i in range(199)] + [(1, 200, "t", "delete", (7, None), None, ""), (1, 201, "t", "update", (8, None), (90_000, "moved"), ""), (1, 300, "", "commit", None, None, "")]
    after = streaming.apply_batch(store, logged(spark, wide.schema, *changes), {"t": ["k"], "other": ["k"], "plain": ["k"]})
    assert after["tables"]["other"] == before["tables"]["other"] and after["tables"]["plain"] == before["tables"]["plain"]
    old, new = (store.entry("t", m).folders() for m in (before, after))
    assert old < new and store.size_of(new - old) < store.size_of(old) / 20
    want = wide.where("k not in (7, 8)").withColumn("v", F.when((F.col("k") % 100 == 0) & (F.col("k") < 19_900), "new").otherwise(F.col("v"))).union(spark.createDataFrame([(90_000, "moved")], wide.schema))
    assert told(store.read("t", after)) == told(want) and told(store.read("t", before)) == told(wide)
    # A batch on top of it, on keys that were changed, deleted and moved.
    again = logged(spark, wide.schema, (2, 0, "t", "insert", None, (7, "back")), (2, 1, "t", "delete", (90_000, "moved"), None), (2, 2, "t", "update", (0, "new"), (0, "newer")), (2, 9, "", "commit", None, None))
    assert streaming.apply_batch(store, again, {"t": ["k"]})["position"] == 2
    got = {r.k: r.v for r in store.read("t").where("k in (0, 7, 8, 90000, 100)").collect()}
    assert got == {0: "newer", 7: "back", 100: "new"}


def test_a_bucket_with_many_changes_is_written_anew(spark, store, wide):
    before = store.entry("t")
    keys = [r.k for r in wide.where(before.bucket() == 3).select("k").collect()]
    changes = [(1, i, "t", "update", (k, None), (k, "x"), "") for i, k in enumerate(keys)] + [(1, 99_999, "", "commit", None, None, "")]
    streaming.apply_batch(store, logged(spark, wide.schema, *changes), {"t": ["k"]})
    after = store.entry("t")
    assert after.parts["3"]["changes"] == [] and after.parts["3"]["base"] != before.parts["3"]["base"] and after.parts["3"]["rows"] == len(keys)
    assert all(after.parts[b] == p for b, p in before.parts.items() if b != "3")
    assert store.read("t", buckets=[3]).where("v <> 'x'").count() == 0 and store.read("t").count() == 20_000


def test_many_small_batches_are_merged(spark, store, wide, monkeypatch):
    monkeypatch.setattr(stores, "MOST_FOLDERS", 2)
    for n in range(1, 5):
        streaming.apply_batch(store, logged(spark, wide.schema, (n, 0, "t", "update", (5, None), (5, str(n))), (n, 1, "", "commit", None, None)), {"t": ["k"]})
    t = store.entry("t")
    assert max(len(p["changes"]) for p in t.parts.values()) == 1 and store.read("t").where("k = 5").first().v == "4"
    assert store.compact("t")["version"] == 6 and all(not p["changes"] for p in store.entry("t").parts.values()) and store.read("t").count() == 20_000


def test_keyless_buckets(spark, store):
    bag = spark.range(300).select((F.col("id") % 30).alias("k"), F.lit("x").alias("v"))
    store.commit(store.latest(), {"bag": store.stage_buckets("bag", bag, [], 8)}, 0)
    before = store.entry("bag")
    log = logged(spark, bag.schema, (1, 0, "bag", "delete", (3, "x"), None), (1, 1, "bag", "insert", None, (77, "y")), (1, 2, "bag", "update", (3, "x"), (4, "x")), (1, 9, "", "commit", None, None), (2, 0, "bag", "delete", (50, "x"), None), (2, 1, "", "commit", None, None))
    with pytest.raises(streaming.Paused) as p:
        streaming.apply_batch(store, log, {"bag": []})
    assert p.value.reason == "row_conflict" and p.value.position == 1
    counts = {(r.k, r.v): r["count"] for r in store.read("bag").groupBy("k", "v").count().collect()}
    assert counts == {**{(i, "x"): 10 for i in range(30)}, (3, "x"): 8, (4, "x"): 11, (77, "y"): 1}
    changed = [b for b, part in store.entry("bag").parts.items() if before.parts.get(b, {}).get("base") != part["base"]]
    rewritten = [b for b in changed if b in before.parts and before.parts[b]["base"][0] not in store.entry("bag").parts[b]["base"]]
    assert len(rewritten) == 1  # the one with (3, x)


def test_readers_of_an_old_version(spark, store, wide):
    with store.pin() as old:
        for n in (1, 2):
            streaming.apply_batch(store, logged(spark, wide.schema, (n, 0, "t", "delete", (n, None), None), (n, 1, "", "commit", None, None)), {"t": ["k"]})
        store.commit(store.latest(), {"plain": store.stage("plain", wide.limit(3))}, 2)
        store.collect(keep=1, grace=-1)
        assert store.versions() == [1, 4] and store.read("t", old).count() == 20_000 and store.read("plain", old).count() == 20_000
    gone = store.collect(keep=1, grace=-1)
    assert store.versions() == [4] and len(gone) == 1 and gone[0].startswith("plain/")
    assert store.read("t").count() == 19_998 and store.read("plain").count() == 3
    with pytest.raises(Conflict):
        store.at(1)
    # A folder that a writer has not published yet is young, a lease that ran out counts no more.
    store.stage("plain", wide.limit(1))
    assert store.collect(keep=1) == [] and len(store.collect(keep=1, grace=-1)) == 1
    with store.pin(seconds=-1):
        assert store.leased() == set()


def test_snapshot_and_log_from_its_position(spark, store, wide):
    keys = {"t": ["k"]}
    for n in (1, 2):
        streaming.apply_batch(store, logged(spark, wide.schema, (n, 0, "t", "update", (n, None), (n, f"v{n}")), (n, 1, "", "commit", None, None)), keys)
    log = logged(spark, wide.schema, *[(n, 0, "t", "update", (n, None), (n, f"v{n}")) for n in (1, 2, 3, 4)])
    with store.pin() as snapshot:
        streaming.apply_batch(store, logged(spark, wide.schema, *[e for n in (3, 4) for e in ((n, 0, "t", "update", (n, None), (n, f"v{n}")), (n, 1, "", "commit", None, None))]), keys)
        rebuilt = cdc.apply_keyed(store.read("t", snapshot), cdc.after_position(log, snapshot["position"]), ["k"])
        assert snapshot["position"] == 2 and told(rebuilt) == told(store.read("t"))


def test_an_open_transaction_costs_each_row_once(spark, store, wide):
    keys = {"t": ["k"]}
    first = logged(spark, wide.schema, (1, 0, "t", "update", (1, None), (1, "open")))
    assert streaming.apply_batch(store, first, keys, batch=("s", 0))["position"] == 0
    for n in range(1, 9):
        rows = [(n + 1, 0, "t", "update", (n + 1, None), (n + 1, f"v{n}"), ""), (n + 1, 1, "", "commit", None, None, "")]
        streaming.apply_batch(store, logged(spark, wide.schema, *rows), keys, batch=("s", n))
        if n == 4:  # a batch that comes again
            assert streaming.apply_batch(store, logged(spark, wide.schema, *rows), keys, batch=("s", n)) == store.latest()
    parts = store.latest()["state"]["pending"]
    assert len(parts) == 9 and sum(spark.read.parquet(f"{p['path']}/changes").count() for p in parts) == 17
    last = streaming.apply_batch(store, logged(spark, wide.schema, (1, 5, "", "commit", None, None)), keys, batch=("s", 9))
    assert last["position"] == 9 and last["state"]["pending"] == []
    assert {r.v for r in store.read("t").where("k between 1 and 9").collect()} == {"open", *(f"v{n}" for n in range(1, 9))}


def test_repeated_rows_of_the_first_batch_count_once(spark, store):
    bag = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a")], "k long, v string")
    store.commit(store.latest(), {"bag": store.stage("bag", bag)}, 0)
    row = (1, 0, "bag", "delete", (1, "a"), None)
    streaming.apply_batch(store, logged(spark, bag.schema, row, row, (1, 1, "bag", "insert", None, (2, "b")), (1, 1, "bag", "insert", None, (2, "b")), (1, 2, "", "commit", None, None)), {"bag": []})
    assert told(store.read("bag")) == [(1, "a"), (1, "a"), (2, "b")]


def test_acknowledged_statement_with_a_new_column(spark, store, wide, tmp_path):
    keys, folder = {"t": ["k"]}, f"file://{tmp_path}/log"
    more = StructType([*wide.schema.fields, *spark.createDataFrame([], "extra int").schema.fields])
    logged(spark, wide.schema, (1, 0, "t", "update", (1, "a"), (1, "b")), (1, 1, "", "commit", None, None), (2, 0, "", "ddl", None, None, "alter table t add extra int"), (2, 1, "", "commit", None, None)).coalesce(1).write.json(folder)
    logged(spark, more, (3, 0, "t", "insert", None, (50_000, "c", 7)), (3, 1, "t", "update", (2, "x", None), (2, "d", 8)), (3, 2, "", "commit", None, None)).coalesce(1).write.mode("append").json(folder)
    run = lambda row: streaming.stream(spark, store, folder, streaming.log_schema(row), keys, f"file://{tmp_path}/check").awaitTermination()
    for _ in range(2):
        with pytest.raises(Exception, match="Paused"):
            run(wide.schema)
        assert store.latest()["position"] == 1 and store.read("t").columns == COLS
    with pytest.raises(ValueError):
        store.acknowledge(2, {"t": StructType().add("k", "string").add("v", "string")})
    store.acknowledge(2, {"t": more})
    run(more)
    assert store.latest()["position"] == 3 and told(store.read("t").where("k in (1, 2, 3, 50000)").select("k", "extra")) == [(1, None), (2, 8), (3, None), (50_000, 7)]
    assert [s["since"] for s in store.entry("t").schemas] == [-1, 2]


def test_statements_of_other_schemas(spark, store, wide):
    log = logged(spark, wide.schema, (1, 0, "", "ddl", None, None, "drop table x"), (1, 1, "t", "delete", (1, None), None), (1, 2, "", "commit", None, None), (2, 0, "t", "delete", (2, None), None), (2, 1, "", "commit", None, None))
    log = log.withColumn("schema_name", F.when(F.col("txn_seq") == 1, "elsewhere").otherwise("shop"))
    assert streaming.apply_batch(store, log, {"t": ["k"]}, schemas=["shop"])["position"] == 2
    assert [r.k for r in store.read("t").where("k < 4").orderBy("k").collect()] == [0, 1, 3]


def test_frozen_locators(spark, store):
    cols = "table_name string, strategy string, index_name string, columns array<string>"
    chosen = spark.createDataFrame([("t", "primary_key", "PRIMARY", ["k"]), ("bag", "full_row", "", [])], cols)
    assert streaming.freeze_locators(store, chosen) == {"t": ["k"], "bag": []}
    version = store.latest()["version"]
    assert streaming.freeze_locators(store, chosen) == {"t": ["k"], "bag": []} and store.latest()["version"] == version
    with pytest.raises(streaming.Paused, match="locators"):
        streaming.freeze_locators(store, chosen.withColumn("strategy", F.lit("full_row")))


def test_events_of_any_number_and_size(spark):
    rows = spark.createDataFrame([(1, op, "insert", n, (10 * op + n,)) for op in (3000, 2_000_000_000) for n in range(3)], "txn_seq long, op_seq int, kind string, n int, row struct<a:long>")
    got = cdc.pair_updates(rows).orderBy("op_seq").collect()
    assert [(r.op_seq.event, r.op_seq.row, r.after.a) for r in got] == [(op, n, 10 * op + n) for op in (3000, 2_000_000_000) for n in range(3)]
    assert told(cdc.apply_keyed(spark.createDataFrame([], "a long"), cdc.pair_updates(rows), ["a"])) == told(rows.select("row.a"))


def test_time_of_a_lease(store, wide):
    with store.pin(1, seconds=60) as manifest:
        assert manifest["version"] == 1 and store.leased() == {1} and time.time() < store._load(f"{store.root}/_leases/{store._names('_leases')[0]}")["until"]
    assert store.leased() == set()
