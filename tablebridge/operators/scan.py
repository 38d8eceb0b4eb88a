"""Running aggregates within keys of any size: blocks of a sorted table, carries between blocks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of aggregate: within rows, and of a carry with what follows it.
KINDS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda a, b: a + b),
    "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def running(df: DataFrame, key: list[str], order: list[str | Column], values: dict[str, tuple[str, Column]], keep: Callable[[DataFrame], DataFrame], parts: int | None = None, before: bool = False) -> DataFrame:
    """``df`` and, for each of ``values`` (name: kind and column), its aggregate over the rows of the key up to this one, or ``before`` it (null if none).

    The rows are dealt by ranges of (key, order) and written by ``keep``, which returns the table it wrote. A window then runs within
    the part of a key that lies in one range; only a key that crosses ranges needs the totals of its parts before, and at most one key crosses
    each border, so that these carries are fewer than twice the ranges, whatever the data: they are broadcast. A key with all rows is spread
    like any other. An empty key list is one sequence of all rows. ``order`` must decide between rows (else equal ones take any order, and
    stay in one range). Null keys are a key; null values count for nothing.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block, held = _free(df, "_block"), {name: _free(df, f"_of_{name}") for name in values}
    dealt = df.withColumns({held[name]: column for name, (_, column) in values.items()})
    spread = keep(dealt.repartitionByRange(n, *key, *order).withColumn(block, F.spark_partition_id()))
    w = Window.partitionBy(*key, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    local = spread.withColumns({name: KINDS[kind][0](held[name]).over(w) for name, (kind, _) in values.items()})

    whole = F.struct(*[F.col(k) for k in key]) if key else F.struct(F.lit(0).alias("_all"))
    edges = spread.groupBy(block).agg(F.min(whole).alias("_lo"), F.max(whole).alias("_hi"))
    at_edge = spread.join(F.broadcast(edges), block).where(whole.eqNullSafe(F.col("_lo")) | whole.eqNullSafe(F.col("_hi")))
    totals = at_edge.groupBy(*key, block).agg(*[KINDS[kind][0](held[name]).alias(f"_t_{name}") for name, (kind, _) in values.items()])
    earlier = Window.partitionBy(*[F.col(k) for k in key] or [F.lit(0)]).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col(block).alias("_b"), F.count("*").over(earlier).alias("_earlier"),
        *[KINDS[kind][0](f"_t_{name}").over(earlier).alias(f"_c_{name}") for name, (kind, _) in values.items()],
    ).where("_earlier > 0")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)], F.col(block) == F.col("_b"))
    both = local.join(F.broadcast(carries), on, "left")
    out = {name: F.coalesce(KINDS[kind][1](F.col(f"_c_{name}"), F.col(name)), F.col(name), F.col(f"_c_{name}")) for name, (kind, _) in values.items()}
    return both.select(*df.columns, *[column.alias(name) for name, column in out.items()])


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name
