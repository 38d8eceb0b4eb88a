"""Key-range splits, change log source, pages written exactly once, sinks, log losses, interval sets."""

import datetime
import os
import tracemalloc
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablebridge.functions.positions import Position, contains_intervals, intersect_intervals, merge_intervals, subtract_intervals
from tablebridge.operators import checks, jobs, verify, workload
from tablebridge.sources import pages, readers, sinks
from tablebridge.sources.store import Conflict, TableStore
from tablebridge.streaming import apply as streaming
from tablebridge.streaming import changelog

UUID = "3E11FA47-71CA-11E1-9E33-C80AA9429562"
SF = "/root/testdata/sf0.01"


def split_sizes(df, keys, predicates):
    """Rows by the number of predicates that they meet, and rows of each predicate."""
    hits = df.select(F.array(*[F.coalesce(F.expr(p), F.lit(False)) for p in predicates]).alias("h"))
    met = {r.n: r["count"] for r in hits.select(F.size(F.filter("h", lambda x: x)).alias("n")).groupBy("n").count().collect()}
    return met, [hits.where(F.col("h")[i]).count() for i in range(len(predicates))]


def test_splits_of_composite_keys(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    keys = ["l_orderkey", "l_linenumber"]
    predicates = readers.key_splits(lines, keys, 8)
    met, sizes = split_sizes(lines, keys, predicates)
    assert len(predicates) == 8 and met == {1: lines.count()} and max(sizes) < 2 * lines.count() / 8


def test_splits_of_odd_keys(spark):
    rows = [(None if i % 5 == 0 else f"it's {i % 7}", None if i % 3 == 0 else i % 11, datetime.date(2024, 1, 1 + i % 28)) for i in range(600)]
    df = spark.createDataFrame(rows, "a string, b int, c date")
    for keys, parts in ((["a", "b"], 6), (["b", "a", "c"], 9), (["c"], 3), (["a"], 4)):
        predicates = readers.key_splits(df, keys, parts)
        met, sizes = split_sizes(df, keys, predicates)
        assert met == {1: 600} and 1 < len(predicates) <= parts and min(sizes) > 0
    assert readers.key_splits(df.limit(0), ["a"], 4) == ["(1 = 1)"] and readers.key_splits(df.where("a = \"it's 1\""), ["a"], 4) == ["(1 = 1)"]
    assert readers.key_splits(df, ["a"], 4, lambda c: f'"{c}"', [["x"]]) == ['(("a" < \'x\' OR "a" IS NULL))'.replace('(("a"', '((("a"').replace("NULL))", "NULL)))"), '(("a" > \'x\') OR ("a" = \'x\'))']


@pytest.fixture
def log(spark, tmp_path):
    """Forty entries in four numbered files."""
    path = f"file://{tmp_path}/log"
    changelog.write_log(spark.range(40).select("id", F.concat(F.lit("é"), F.repeat(F.lit("x"), F.col("id").cast("int"))).alias("v"), F.concat(F.lit(UUID + ":"), F.col("id") + 1).alias("gtid")), path, ["id"], 4)
    return path


def read_all(spark, path, check, out, **kw):
    entries = changelog.follow(spark, path, spark.createDataFrame([], "id long, v string").schema, **kw)
    entries.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def test_log_is_read_once_and_resumed(spark, log, tmp_path):
    out, check = f"file://{tmp_path}/out", f"file://{tmp_path}/check"
    first = read_all(spark, log, check, out, partitionBytes=70)
    assert sorted(r.id for r in first.collect()) == list(range(40)) and {r.v for r in first.collect()} == {"é" + "x" * i for i in range(40)}
    # More in the last file, whose last line is not whole yet, and then a new file.
    last = f"{tmp_path}/log/binlog.000004"
    with open(last, "a") as f:
        f.write('{"id":40,"v":"a"}\n{"id":41,"v')
    assert sorted(r.id for r in read_all(spark, log, check, out).collect()) == list(range(41))
    with open(last, "a") as f:
        f.write('":"b"}\n')
    with open(f"{tmp_path}/log/binlog.000005", "w") as f:
        f.write('{"id":42,"v":"c"}\n')
    assert sorted(r.id for r in read_all(spark, log, check, out).collect()) == list(range(43))
    os.remove(last)
    os.remove(f"{tmp_path}/log/binlog.000005")
    with open(f"{tmp_path}/log/binlog.000006", "w") as f:
        f.write('{"id":43,"v":"c"}\n')
    with pytest.raises(Exception, match="is gone"):
        read_all(spark, log, check, out)


def test_log_from_a_position_or_a_set(spark, log, tmp_path):
    places = read_all(spark, log, f"file://{tmp_path}/c0", f"file://{tmp_path}/o0").select("id", "log_file", "log_pos").collect()
    at = {r.id: Position(r.log_file, r.log_pos) for r in places}
    got = read_all(spark, log, f"file://{tmp_path}/c1", f"file://{tmp_path}/o1", start=at[25])
    assert sorted(r.id for r in got.collect()) == list(range(25, 40))
    got = read_all(spark, log, f"file://{tmp_path}/c2", f"file://{tmp_path}/o2", start=Position(gtid=UUID.lower() + ":1-10:31-38"))
    assert sorted(r.id for r in got.collect()) == [*range(10, 30), 38, 39]
    for bad in (Position("binlog.000009", 4), Position("binlog.000001", 10**6)):
        with pytest.raises(Exception, match="can't start"):
            read_all(spark, log, f"file://{tmp_path}/c3{bad.pos}", f"file://{tmp_path}/o3", start=bad)


def test_triggers_of_limited_size(spark, log):
    reader = changelog.ChangeLogReader({"path": log, "triggerbytes": "300"})
    at, seen, n = reader.initialOffset(), [], 0
    while (end := reader.latestOffset()) != at:
        seen += [line for p in reader.partitions(at, end) for _, line in changelog.Folder(log).lines(p)]
        at, n = end, n + 1
    assert len(seen) == 40 and n > 4


def test_a_stretch_reads_only_itself(tmp_path):
    begin = 200_000_000
    with open(f"{tmp_path}/binlog.000001", "wb") as f:  # what is before takes no disk
        f.seek(begin - 1)
        f.write(b"\n" + b"".join(b'{"id":%d}\n' % i for i in range(1000)) + b'{"id":1000')
    end = os.path.getsize(f"{tmp_path}/binlog.000001")
    tracemalloc.start()
    got = list(changelog.Folder(f"file://{tmp_path}").lines(changelog.Stretch("binlog.000001", begin, end)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [line for _, line in got] == [f'{{"id":{i}}}' for i in range(1000)] and got[0][0] == begin and most < 4_000_000


def test_long_entries_go_on_in_small_batches(tmp_path):
    with open(f"{tmp_path}/binlog.000001", "w") as f:
        f.writelines("x" * 200_000 + f"{i}\n" for i in range(200))
    reader = changelog.ChangeLogReader({"path": f"file://{tmp_path}"})
    batches = list(reader.read(changelog.Stretch("binlog.000001", 0, os.path.getsize(f"{tmp_path}/binlog.000001"))))
    assert [line[200_000:] for b in batches for line in b["line"].to_pylist()] == [str(i) for i in range(200)] and max(b.nbytes for b in batches) < 9_000_000


def test_partitions_of_a_large_trigger(tmp_path):
    for i, size in enumerate((3_000_000_000, 0, 1_000_000_001), 1):
        with open(f"{tmp_path}/binlog.{i:06d}", "wb") as f:
            f.truncate(size)
    reader = changelog.ChangeLogReader({"path": f"file://{tmp_path}", "partitionbytes": "200000"})
    parts = reader.partitions({"file": "binlog.000001", "pos": 7}, {"file": "binlog.000003", "pos": 1_000_000_001})
    at = {"binlog.000001": 7, "binlog.000003": 0}
    for p in parts:
        assert p.start == at[p.file] < p.end
        at[p.file] = p.end
    assert at == {"binlog.000001": 3_000_000_000, "binlog.000003": 1_000_000_001} and len(parts) <= changelog.MOST_PARTITIONS + 3
    assert len(reader.partitions({"file": "binlog.000001", "pos": 0}, {"file": "binlog.000001", "pos": 1_000_000})) == 5


def test_stream_of_a_log_with_positions(spark, tmp_path):
    base = spark.range(50).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    store = TableStore(spark, f"file://{tmp_path}/store")
    store.commit(store.latest(), {"t": store.stage_buckets("t", base, ["k"], 4)}, -1)
    schema = streaming.log_schema(base.schema)
    rows = [r for i in range(30) for r in ((i, 0, "t", "update", (i, "a"), (i, "b"), ""), (i, 1, "", "commit", None, None, ""))]
    changelog.write_log(spark.createDataFrame(rows, schema), f"file://{tmp_path}/log", ["txn_seq", "op_seq"], 3)
    for _ in range(2):
        entries = changelog.follow(spark, f"file://{tmp_path}/log", schema).drop("log_file", "log_pos")
        streaming.stream(spark, store, entries, schema, {"t": ["k"]}, f"file://{tmp_path}/check").awaitTermination()
    assert store.latest()["position"] == 29 and {r.v: r["count"] for r in store.read("t").groupBy("v").count().collect()} == {"b": 30, "a": 20}


def test_stream_from_a_position_far_into_a_file(spark, tmp_path):
    """Applying begins behind a terabyte (which takes no disk) that no task could hold."""
    base = spark.range(50).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    store = TableStore(spark, f"file://{tmp_path}/store")
    store.commit(store.latest(), {"t": store.stage_buckets("t", base, ["k"], 4)}, -1)
    schema, begin = streaming.log_schema(base.schema), 1 << 40
    rows = [r for i in range(30) for r in ((i, 0, "t", "update", (i, "a"), (i, "b"), ""), (i, 1, "", "commit", None, None, ""))]
    lines = spark.createDataFrame(rows, schema).select(F.to_json(F.struct("*"))).collect()
    os.mkdir(f"{tmp_path}/log")
    with open(f"{tmp_path}/log/binlog.000007", "wb") as f:
        f.seek(begin - 1)
        f.write(b"\n" + b"".join(r[0].encode() + b"\n" for r in lines))
    entries = changelog.follow(spark, f"file://{tmp_path}/log", schema, Position("binlog.000007", begin), partitionBytes=900).drop("log_file", "log_pos")
    streaming.stream(spark, store, entries, schema, {"t": ["k"]}, f"file://{tmp_path}/check").awaitTermination()
    assert store.latest()["position"] == 29 and {r.v: r["count"] for r in store.read("t").groupBy("v").count().collect()} == {"b": 30, "a": 20}


def test_pages_are_written_once(spark, tmp_path):
    path = f"file://{tmp_path}/target"
    df = spark.range(1000).selectExpr("id", "concat('v', id) as v")
    df = pages.dealt(df, ["id"], 4)
    with pytest.raises(Exception, match="stopped after 2 pages"):
        pages.write_pages(df, path, "copy1", 50, failAfter=2)
    with pytest.raises(ValueError, match="not ended"):
        pages.read_pages(spark, path, "copy1", df.schema)
    before = {n: os.stat(f"{tmp_path}/target/copy1/ledger/{n}").st_mtime_ns for n in os.listdir(f"{tmp_path}/target/copy1/ledger")}
    assert before
    pages.write_pages(df, path, "copy1", 50)
    pages.write_pages(df, path, "copy1", 50)  # started again although it had ended
    got = pages.read_pages(spark, path, "copy1", df.schema)
    assert Counter(tuple(r) for r in got.collect()) == Counter(tuple(r) for r in df.collect())
    assert all(os.stat(f"{tmp_path}/target/copy1/ledger/{n}").st_mtime_ns == at for n, at in before.items())
    with pytest.raises(Exception, match="other rows"):
        pages.write_pages(df.withColumn("v", F.lit("else")), path, "copy1", 50)
    pages.discard(spark, path, "copy1")
    assert not os.path.exists(f"{tmp_path}/target/copy1")
    pages.write_pages(df.limit(0), path, "none", 50)
    assert pages.read_pages(spark, path, "none", df.schema).count() == 0


def test_a_killed_task_leaves_no_doubled_page(spark, tmp_path):
    """A worker that dies after a page's file and before its entry, and one that dies after the entry."""
    from pyarrow import Table, fs

    writer = pages.PageWriter({"path": f"file://{tmp_path}/t", "job": "j", "rows": "2"}, False)
    store, root = writer._open()
    for d in ("ledger", "pages"):
        store.create_dir(f"{root}/{d}", recursive=True)
    with store.open_output_stream(f"{root}/pages/000000-000000-lost.parquet") as f:
        f.write(b"half of a page")
    first = writer._page(store, root, 0, 0, Table.from_pydict({"id": [1, 2]}))
    assert writer._page(store, root, 0, 0, Table.from_pydict({"id": [1, 2]})) == first
    writer.commit([pages.Written(0, [first]), None])
    assert [r.id for r in pages.read_pages(spark, f"file://{tmp_path}/t", "j", spark.range(1).schema).orderBy("id").collect()] == [1, 2]
    assert len(store.get_file_info(fs.FileSelector(f"{root}/pages"))) == 2


class Fake:
    """A JDBC connection that keeps what it is told."""

    def __init__(self, told, bad=""):
        self.told, self.bad = told, bad

    def setAutoCommit(self, on):
        pass

    def createStatement(self):
        return self

    def execute(self, s):
        if self.bad and self.bad in s:
            raise RuntimeError("refused")
        self.told.append(s)

    def commit(self):
        self.told.append("COMMIT")

    def rollback(self):
        self.told.append("ROLLBACK")

    def close(self):
        pass


def test_jdbc_sink_moves_all_tables_and_then_drops(spark):
    told = []
    sink = sinks.JdbcSink(spark, readers.Connection("postgres", "h", 1, "d"), "s", lambda: Fake(told), owner="app")
    for t in ("a", "b"):
        sink.stages.append(f"{t}__stage")
        sink.moved.append(t)
        sink.todo += sinks.promote("postgres", "s", t, f"{t}__stage", ["x"])
    sink.publish()
    assert told[:5] == ['INSERT INTO "s"."a" ("x") SELECT "x" FROM "s"."a__stage"', 'INSERT INTO "s"."b" ("x") SELECT "x" FROM "s"."b__stage"', 'ALTER TABLE "s"."a" OWNER TO "app"', 'ALTER TABLE "s"."b" OWNER TO "app"', "COMMIT"]
    assert told[5:] == ['DROP TABLE "s"."a__stage"', "COMMIT", 'DROP TABLE "s"."b__stage"', "COMMIT"] and not sink.todo
    told.clear()
    bad = sinks.JdbcSink(spark, readers.Connection("mysql", "h", 1, "d"), "s", lambda: Fake(told, "`b`"))
    bad.todo = sinks.promote("mysql", "s", "a", "a__stage", ["x"]) + sinks.promote("mysql", "s", "b", "b__stage", ["x"])
    bad.stages = ["a__stage", "b__stage"]
    with pytest.raises(RuntimeError):
        bad.publish()
    assert told[-1] == "ROLLBACK" and not [s for s in told if "DROP" in s]


def test_lost_lines_of_a_stream(spark, tmp_path):
    schema, root = "job string, seq long, line string", f"file://{tmp_path}"
    for lo, hi, part in ((0, 60, 0), (60, 100, 1)):
        spark.range(lo, hi).where("id % 7 <> 3").select(F.concat(F.lit("j"), F.col("id") % 2).alias("job"), F.floor(F.col("id") / 2).alias("seq"), F.lit("x").alias("line")).coalesce(1).write.mode("append").json(f"{root}/in")
        lines = spark.readStream.schema(schema).json(f"{root}/in")
        for q in jobs.follow_lines(lines, f"{root}/out", f"{root}/check"):
            q.awaitTermination()
    kept = [(i % 2, i // 2) for i in range(100) if i % 7 != 3]
    want = {(f"j{k}", min(s), max(s), len(s), max(s) - min(s) + 1 - len(s)) for k in (0, 1) if (s := [x for j, x in kept if j == k])}
    assert {tuple(r) for r in jobs.last_counts(spark, f"{root}/out").collect()} == want and spark.read.parquet(f"{root}/out/lines").count() == len(kept)


def test_states_move_by_compare_and_set(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/s")
    jobs.move_job(store, "snapshot")
    jobs.move_job(store, "catching_up")
    with pytest.raises(Conflict):
        jobs.move_job(store, "stopped")
    stale = store.latest()
    jobs.move_job(store, "running")
    with pytest.raises(Conflict):
        store.commit(stale, {}, stale["position"], status="failed")
    assert store.latest()["state"]["status"] == "running"


def test_percentiles_of_neighbouring_values(spark, tmp_path):
    base = 1_700_000_000_000
    df = spark.range(4000).select(F.lit("g").alias("g"), (F.lit(base) + F.pmod(F.hash("id"), F.lit(1000))).alias("v"))
    seen = []

    def keep(x):
        path = f"file://{tmp_path}/{len(seen)}"
        x.write.parquet(path)
        seen.append(spark.read.schema(x.schema).parquet(path))
        return seen[-1]

    got = verify.floor_percentiles(df, ["g"], "v", keep=keep, parts=8).first()
    v = sorted(r.v for r in df.collect())
    assert tuple(got) == ("g", 4000, v[1999], v[3799], v[3959])
    assert seen[0].select("_block").distinct().count() == 8


def test_interval_sets(spark):
    import random

    rnd = random.Random(4)
    sets = [[(u, lo, lo + rnd.randint(0, 9)) for u in "xY" for lo in rnd.sample(range(200), 15)] for _ in range(2)]
    a, b = (spark.createDataFrame(s, "uuid string, lo long, hi long") for s in sets)
    nums = [{(u.lower(), i) for u, lo, hi in s for i in range(lo, hi + 1)} for s in sets]
    spread = lambda df: {(r.uuid, i) for r in df.collect() for i in range(r.lo, r.hi + 1)}
    assert spread(intersect_intervals(a, b)) == nums[0] & nums[1] and spread(subtract_intervals(a, b)) == nums[0] - nums[1]
    assert merge_intervals(subtract_intervals(a, b)).count() == subtract_intervals(a, b).count()
    assert not contains_intervals(a, b).first().contains and contains_intervals(a.union(b), b).first().contains and contains_intervals(a, a.limit(0)).first().contains


def test_error_classes(spark):
    rows = [(1213, "Deadlock"), (1062, "Duplicate"), (None, "dial tcp: Connection REFUSED"), (None, "bad"), (None, None), (1040, "no route to host"), (1, "no route to host")]
    df = spark.createDataFrame(rows, "number int, text string")
    assert [r[0] for r in df.select(workload.error_class(F.col("number"), F.col("text"))).collect()] == ["capacity", "correctness", "environment", "correctness", "", "capacity", "correctness"]


def test_report_as_one_text(spark, tmp_path):
    items = spark.createDataFrame([("table", "a", True, None, None), ("view", "v", False, "bad", "CREATE\nVIEW v")], "category string, name string, ok boolean, error string, ddl string")
    counts = spark.createDataFrame([("a", 5, 3, False), ("b", 1, 1, True)], "table_name string, src_rows long, dst_rows long, matches boolean")
    checks.export_report(checks.report_lines(items, counts), f"file://{tmp_path}/report")
    text = "".join(open(f"{tmp_path}/report/{n}").read() for n in os.listdir(f"{tmp_path}/report") if n.startswith("part-"))
    assert text == "table: 1 in all, 1 done, 0 failed\nview: 1 in all, 0 done, 1 failed\nview v\n  reason: bad\n  DDL: CREATE\n  VIEW v\na: 5 source, 3 target, difference -2\na: 5 source, 3 target (differs)\nb: 1 source, 1 target\n"
