"""Running aggregates by blocks against plain windows."""

import uuid

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablebridge.operators.scan import running


@pytest.fixture
def keep(spark, tmp_path):
    def write(df):
        path = f"{tmp_path}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return write


@pytest.mark.parametrize("keys", [1, 3, 700])
def test_like_a_window(spark, keep, keys):
    df = spark.range(2000).select(F.when(F.col("id") % keys > 0, F.col("id") % keys).alias("k"), (F.hash("id") % 50).alias("at"), "id", F.when(F.col("id") % 7 > 0, F.xxhash64("id") % 1000).alias("v"))
    values = {k: (k, F.col("v")) for k in ("sum", "xor", "max", "min")} | {"n": ("sum", F.lit(1))}
    got = running(df, ["k"], ["at", "id"], values, keep, 16)
    w = Window.partitionBy("k").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.sum("v").over(w).alias("sum"), F.bit_xor("v").over(w).alias("xor"), F.max("v").over(w).alias("max"), F.min("v").over(w).alias("min"), F.count("*").over(w).alias("n"))
    assert sorted(got.collect(), key=lambda r: r.id) == sorted(want.collect(), key=lambda r: r.id)


def test_one_key_is_dealt_to_all_ranges(spark, keep):
    parts = []

    def seen(df):
        parts.append(keep(df))
        return parts[-1]

    got = running(spark.range(5000).withColumn("k", F.lit("hot")), ["k"], [F.desc("id")], {"n": ("sum", F.lit(1))}, seen, 10)
    assert sorted((r.id, r.n) for r in got.collect()) == [(i, 5000 - i) for i in range(5000)]
    sizes = [r["count"] for r in parts[0].groupBy("_block").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 1000


def test_no_key_and_no_rows(spark, keep):
    got = running(spark.range(100), [], ["id"], {"n": ("sum", F.lit(1))}, keep, 4)
    assert sorted((r.id, r.n) for r in got.collect()) == [(i, i + 1) for i in range(100)]
    assert running(spark.range(0), [], ["id"], {"n": ("sum", F.lit(1))}, keep, 4).collect() == []


def test_before_each_row(spark, keep):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    got = running(df, ["k"], [F.desc("id")], {"next": ("min", F.col("id")), "n": ("sum", F.lit(1))}, keep, 7, before=True)
    assert {(r.id, r.next, r.n) for r in got.collect()} == {(i, i + 3 if i + 3 < 500 else None, (499 - i) // 3 or None) for i in range(500)}
