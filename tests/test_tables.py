"""Operators on tables: change apply against a sequential interpreter, digests, store, stream, copy, allocation."""

import hashlib
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tablebridge import protocols
from tablebridge.functions.positions import merge_intervals
from tablebridge.operators import cdc, copy, jobs, verify, workload
from tablebridge.sources import readers, sinks
from tablebridge.sources.store import Conflict, TableStore
from tablebridge.streaming import apply as streaming

ROW = "struct<k:int,v:string>"
LOG = f"txn_seq long, op_seq int, action string, before {ROW}, after {ROW}"
FEW = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
rows = st.tuples(st.integers(0, 4), st.sampled_from(["a", "b", None]))


def interpret(base, log):
    """Keyed apply, one change after the other."""
    t = dict(base)
    for _, _, act, before, after in sorted(log, key=lambda x: x[:2]):
        if act == "delete" or (act == "update" and before[0] != after[0]):
            t.pop(before[0], None)
        if act != "delete":
            t[after[0]] = after[1]
    return t


@FEW
@given(base=st.dictionaries(st.integers(0, 4), st.sampled_from(["a", "b", None]), max_size=5), ops=st.lists(st.tuples(st.sampled_from(["insert", "update", "delete"]), rows, rows), max_size=8), at=st.integers(0, 8))
def test_keyed_equals_sequential(spark, base, ops, at):
    log = [(i, 0, a, None if a == "insert" else x, None if a == "delete" else y) for i, (a, x, y) in enumerate(ops)]
    df = spark.createDataFrame(list(base.items()), "k int, v string")
    want = interpret(base, log)
    parts = [spark.createDataFrame(p, LOG) for p in (log[:at], log[at:])]
    got = cdc.apply_keyed(cdc.apply_keyed(df, parts[0], ["k"]), parts[1], ["k"])
    assert Counter(map(tuple, got.collect())) == Counter(want.items())


@FEW
@given(base=st.lists(rows, max_size=6), ops=st.lists(st.tuples(st.sampled_from(["insert", "update", "delete"]), rows, rows), max_size=6))
def test_keyless_equals_sequential(spark, base, ops):
    log = [(i, 0, a, None if a == "insert" else x, None if a == "delete" else y) for i, (a, x, y) in enumerate(ops)]
    bag, stop = Counter(base), None
    for i, _, a, x, y in log:
        if a != "insert":
            if not bag[x]:
                stop = i
                break
            bag[x] -= 1
        if a != "delete":
            bag[y] += 1
    df, ldf = spark.createDataFrame(base, "k int, v string"), spark.createDataFrame(log, LOG)
    bad = cdc.conflicts(df, ldf)
    assert bad.agg({"txn_seq": "min"}).first()[0] == stop
    got = cdc.apply_keyless(df, cdc.cut([ldf], [bad.groupBy().min("txn_seq")])[0])
    assert Counter(map(tuple, got.collect())) == +bag


def test_digests(spark):
    import datetime
    import decimal

    df = spark.createDataFrame([(1, decimal.Decimal("12.3400"), True, datetime.datetime(2024, 1, 2, 3, 4, 5), b"\x00\x01\xff", None), (2, decimal.Decimal("0.0000"), False, None, None, "é")], "k int, d decimal(10,4), b boolean, t timestamp_ntz, x binary, s string")
    texts = [["1", "12.34", "1", "2024-01-02T03:04:05.000000", "hex:0001ff", "<NULL>"], ["2", "0", "0", "<NULL>", "<NULL>", "é"]]
    plain = [hashlib.sha256(b"".join(len(t.encode()).to_bytes(8, "big") + t.encode() for t in row)).hexdigest() for row in texts]
    assert [r[0] for r in df.select(verify.row_hash(df)).collect()] == plain
    assert verify.ordered_digest(df, ["k"]).first().digest == hashlib.sha256(bytes.fromhex("".join(plain))).hexdigest()
    both = verify.multiset_digest(df.union(df))
    assert both.first().digest == verify.plain_multiset_digest([bytes.fromhex(h) for h in plain] * 2)
    assert verify.multiset_digest(df.where("false")).first().row_count == 0
    strict = df.select(verify.row_hash(df, ["s"], strict=True).alias("h")).first().h
    assert strict != spark.createDataFrame([("<NULL>",)], "s string").select(verify.row_hash(spark.createDataFrame([], "s string"), strict=True)).first()[0]


def test_percentiles(spark):
    df = spark.createDataFrame([("g", x) for x in range(1, 11)], "g string, v int")
    assert tuple(verify.floor_percentiles(df, ["g"], "v").first())[2:] == (5, 9, 9)


def test_store_and_stream(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/store")
    v0 = store.latest()
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    bag = spark.createDataFrame([(10, "x"), (30, "y"), (30, "y")], "k int, v string")
    store.commit(v0, {"t": store.stage("t", base), "bag": store.stage("bag", bag)}, -1)
    with pytest.raises(Conflict):
        store.commit(v0, {}, 5)
    schema = streaming.log_schema(base.schema)
    keys = {"t": ["k"], "bag": []}

    def log(*entries):
        return spark.createDataFrame([(*e, "") if len(e) == 6 else e for e in entries], schema)

    first = log((1, 0, "t", "update", (1, "a"), (7, "up")), (1, 1, "bag", "delete", (30, "y"), None), (1, 9, "", "commit", None, None), (2, 0, "t", "insert", None, (9, "gone")), (2, 9, "", "rollback", None, None), (3, 0, "t", "delete", (2, "b"), None))
    assert streaming.apply_batch(store, first, keys)["position"] == 2
    assert {tuple(r) for r in store.read("t").collect()} == {(2, "b"), (7, "up")} and store.read("bag").count() == 2
    assert streaming.apply_batch(store, first, keys)["position"] == 2  # again: nothing
    # The open transaction ends, then a statement changes the schema.
    second = log((3, 9, "", "commit", None, None), (4, 0, "", "ddl", None, None, "alter table t add x int"), (4, 9, "", "commit", None, None), (5, 0, "t", "insert", None, (5, "late")), (5, 9, "", "commit", None, None))
    with pytest.raises(streaming.Paused) as p:
        streaming.apply_batch(store, second, keys)
    assert (p.value.reason, p.value.position) == ("ddl", 3) and {tuple(r) for r in store.read("t").collect()} == {(7, "up")}
    assert streaming.apply_batch(store, log(), keys, acknowledged=4)["position"] == 5 and store.read("t").count() == 2
    with pytest.raises(streaming.Paused) as p:
        streaming.apply_batch(store, log((6, 0, "bag", "delete", (99, "no"), None), (6, 9, "", "commit", None, None)), keys)
    assert p.value.reason == "row_conflict" and p.value.details["table_name"] == "bag" and p.value.position == 5


def test_copy(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/copy")
    good = spark.createDataFrame([(1, "te\x00xt")], "ID int, Name string")
    clash = spark.createDataFrame([(1, 2)], "a int, b int").toDF("A", "B").selectExpr("A", "B as a2").toDF("X", "x2")
    items = copy.copy_tables(spark, {"Good": good, "Clash": clash}, store, name=lambda n: "same" if n in ("X", "x2") else n.lower())
    assert {(r.name, r.ok) for r in items.collect()} == {("Good", True), ("Clash", False)}
    assert store.read("good").first().asDict() == {"id": 1, "name": "text"}
    assert copy.report(items).first().failed_items == ["Clash"] and copy.status(items).first().status == "failed"


@pytest.mark.parametrize(("n", "total", "most"), [(200, 1_000_000, 100_000), (10, 101, 11), (100, 990, 10), (5, 0, None), (97, 5000, 60)])
def test_allocation(spark, n, total, most):
    w = [0 if (i + 1) % 97 == 0 else 1 / (i + 8) ** 0.82 for i in range(n)]
    want = [min(int(total * x / sum(w)), most or total) for x in w]
    while sum(want) < total:
        for i in range(n):
            if w[i] and want[i] < (most or total) and sum(want) < total:
                want[i] += 1
    assert [r.rows for r in workload.allocate(spark, n, total, most).orderBy("i").collect()] == want


def test_allocation_too_much(spark):
    with pytest.raises(ValueError):
        workload.allocate(spark, 10, 101, 10)


def test_exclusion_errors(spark):
    v = lambda *x: spark.createDataFrame([(y,) for y in x], "table_name string")
    got = {tuple(r) for r in jobs.exclusions(v("a", "b"), v("b"), v("b", "b", "a", "z")).collect()}
    assert got == {("a", "effective"), ("a", "not_missing"), ("b", "excluded"), ("b", "duplicate"), ("z", "out_of_scope")}


def test_console_execute(spark, tmp_path):
    from tablebridge.operators import console

    audit = f"file://{tmp_path}/audit"
    r = console.execute(spark, "select id, cast('é' as binary) b from range(10) order by id", "u", audit, most=3)
    assert (len(r.rows), r.truncated, r.rows[0]) == (3, True, ("0", "base64:w6k="))
    for bad in ("drop table x", "select 1; select 2", "select nothing from nowhere"):
        with pytest.raises(Exception):
            console.execute(spark, bad, "u", audit)
    assert sorted((x.status, x.level) for x in spark.read.parquet(audit).collect()) == [("failed", "readonly"), ("ok", "readonly"), ("rejected", "dangerous"), ("rejected", "rejected")]


def test_reports_and_settings(spark):
    from tablebridge.operators import checks
    from tablebridge.sources import files

    items = spark.createDataFrame([("data", "a", True, ""), ("data", "b", False, "x")], "category string, name string, ok boolean, error string")
    counts = spark.createDataFrame([("a", 2, 2, True), ("b", 5, 1, False)], "table_name string, src_rows int, dst_rows int, matches boolean")
    text = checks.report_markdown(checks.report_json(copy.report(items), counts))
    assert "| data | 2 | 1 | 1 |" in text and "| b | 5 | 1 | -4 |" in text and text.endswith("- failed data: b")
    assert checks.retention_warning(72 * 3600 - 1) and not checks.retention_warning(72 * 3600) and not checks.retention_warning(None) and not checks.retention_warning(0)
    assert files.configuration({"rows": 5, "on": False}, '{"rows": 7}', {"TABLEBRIDGE_ON": "true", "TABLEBRIDGE_ROWS": "9"}) == {"rows": 9, "on": True}
    with pytest.raises(ValueError):
        files.configuration({}, '{"x": 1}', {})


def test_claims_of_versions(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/store")
    first = store.commit(store.latest(), {}, 1)
    with pytest.raises(Conflict):
        store.commit({**first, "version": 0}, {}, 2)
    store.fs.create(store._claim_path(2), False).close()  # a writer that died before it published
    with pytest.raises(Conflict):
        store.commit(first, {}, 3)
    store.abandon(2)
    assert store.commit(first, {}, 3)["version"] == 2 and store.latest()["position"] == 3
    with pytest.raises(Conflict):
        store.abandon(2)


def test_pause_between_batches(spark, tmp_path):
    root = f"file://{tmp_path}"
    base = spark.createDataFrame([(i, "a") for i in range(5)], "k long, v string")
    store = TableStore(spark, f"{root}/store")
    store.commit(store.latest(), {"t": store.stage("t", base)}, -1)
    schema = streaming.log_schema(base.schema)
    rows = [(i, 0, "t", "update", (i, "a"), (i, "b"), "") for i in range(3)] + [(i, 1, "", "commit", None, None, "") for i in range(3)]
    spark.createDataFrame(rows, schema).write.json(f"{root}/log")
    control = streaming.Control()
    query = streaming.stream(spark, store, f"{root}/log", schema, {"t": ["k"]}, f"{root}/check", every="1 second", control=control)
    while control.position < 2:
        assert query.isActive
        time.sleep(0.2)
    assert control.pause(query) and not query.isActive
    assert {tuple(r) for r in store.read("t").collect()} == {(0, "b"), (1, "b"), (2, "b"), (3, "a"), (4, "a")}
    assert streaming.head_of(spark, f"{root}/log", schema).first().head == 2


def test_percentiles_of_wide_values(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(v)) for g in ("a", "b") for v in np.concatenate([rng.normal(scale=1e6, size=300), rng.normal(scale=1e-6, size=200), np.zeros(50), -rng.exponential(size=100)])] + [("c", -3.0), ("c", None), (None, 2.0)]
    got = {r.g: r for r in verify.floor_percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    for g in ("a", "b", "c", None):
        v = sorted(x for k, x in rows if k == g and x is not None)
        assert (got[g].n, got[g].p50, got[g].p95, got[g].p99) == (len(v), *[v[int((len(v) - 1) * p)] for p in (0.5, 0.95, 0.99)])


def test_intervals_across_ranges(spark):
    rows = [("U", 1, 4), ("u", 5, 9), ("u", 8, 31), ("u", 11, 12), ("u", 33, 40), ("u", 40, 55), ("v", 2, 2)]
    got = {tuple(r) for r in merge_intervals(spark.createDataFrame(rows, "uuid string, lo long, hi long"), width=10).collect()}
    assert got == {("u", 1, 31), ("u", 33, 55), ("v", 2, 2)}


def test_keyless_rows_that_come_and_go(spark):
    base = spark.createDataFrame([(i % 3, "x") for i in range(30)], "a long, b string")
    log = spark.createDataFrame([(1, 0, "delete", (0, "x"), None), (2, 0, "update", (1, "x"), (1, "y")), (3, 0, "insert", None, (7, "z")), (4, 0, "delete", (9, "q"), None)], "txn_seq long, op_seq int, action string, before struct<a:long,b:string>, after struct<a:long,b:string>")
    want = [Counter(map(tuple, cdc.apply_keyless(base, log.where("txn_seq < 4")).collect())), cdc.conflicts(base, log).select("txn_seq").collect()]
    assert want[0] == Counter({(0, "x"): 9, (1, "x"): 9, (2, "x"): 10, (1, "y"): 1, (7, "z"): 1}) and [r.txn_seq for r in want[1]] == [4]


def test_answers(spark, tmp_path):
    assert sinks.answers(spark, f"file://{tmp_path}") == (True, "") and not sinks.answers(spark, f"file://{tmp_path}/none")[0]
    c = readers.Connection("oracle", "h", 1)
    assert sinks.answers(spark, c, lambda q: spark.sql("select 1"))[0] and not sinks.answers(spark, c)[0]


def test_plugs(spark, tmp_path):
    made = []
    protocols.register("sink", "memory", lambda spark, **kw: made.append(kw) or "sink")
    assert sinks.sink_for(spark, "memory", root="r", schema="s") == "sink" and made == [{"root": "r", "target": None, "schema": "s"}]
    for role, kind in (("sink", "memory"), ("engine", "x")):
        with pytest.raises(ValueError):
            protocols.register(role, kind, print)
    spark.range(3).write.parquet(f"file://{tmp_path}/t.parquet")
    reader = protocols.plugged("reader", "folder")(spark, f"file://{tmp_path}")
    assert [r.table_name for r in reader.tables().collect()] == ["t"] and reader.open("t").count() == 3 and protocols.plugged("mapper", "none") is None


def test_hooks_hear_of_batches_and_pauses(spark, tmp_path):
    heard = []

    class Ears(protocols.Hooks):
        def applied(self, manifest):
            heard.append(("applied", manifest["position"]))

        def paused(self, reason, position, details):
            heard.append((reason, position, details["txn_seq"]))

    root = f"file://{tmp_path}"
    base = spark.createDataFrame([(1, "a")], "k long, v string")
    store = TableStore(spark, f"{root}/store")
    store.commit(store.latest(), {"t": store.stage("t", base)}, -1)
    schema = streaming.log_schema(base.schema)
    rows = [(1, 0, "t", "update", (1, "a"), (1, "b"), ""), (1, 1, "", "commit", None, None, "")]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{root}/log")
    run = lambda: streaming.stream(spark, store, f"{root}/log", schema, {"t": ["k"]}, f"{root}/check", hooks=Ears()).awaitTermination()
    run()
    spark.createDataFrame([(2, 0, "", "ddl", None, None, "alter table t add x int"), (2, 1, "", "commit", None, None, "")], schema).coalesce(1).write.mode("append").json(f"{root}/log")
    with pytest.raises(Exception, match="Paused"):
        run()
    assert heard == [("applied", 1), ("ddl", 1, 2)]
