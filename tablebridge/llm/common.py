"""What the corpus operators share: durable tables, word hashing, connected components."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the cluster names none (tests), a folder under the warehouse is set for the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, remembered by the scope around it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends in a durable table.

    The table stays, since the result of an operator may read it; a scope() around the operator deletes it.
    """
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables made inside, at its end: what reads them must have been written by then.

    Runs in other threads, and scopes around this one, keep theirs.
    """
    token = _made.set([])
    try:
        yield
    finally:
        for path in _made.get():
            drop_path(spark, path)
        _made.reset(token)


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    while name in df.columns:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return WORD.findall(text.lower()) if text else []


def hash_words(flat: list[str]) -> np.ndarray:
    from pandas.util import hash_array

    if not flat:
        return np.empty(0, np.uint64)
    a = np.empty(len(flat), object)
    a[:] = flat
    return hash_array(a, categorize=False)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all n-grams of a sequence of word hashes; a shorter sequence is one gram."""
    if len(h) == 0:
        return h
    n = min(n, len(h))
    m = len(h) - n + 1
    acc = h[:m].copy()
    for k in range(1, n):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m]
    return mix64(acc)


def word_shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a text.

    A text of fewer than n words is one shingle; one without words but with other visible characters is one
    shingle of these; null and blank texts have none.
    """
    w = words(text)
    if not w and text and text.strip():
        w = [text.strip()]
    return np.unique(gram_hashes(hash_words(w), n))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges(src, dst)``: ``node, component`` (the smallest member).

    Each round takes the smallest label next to each node and then jumps along the labels, so that the number of
    rounds grows with the logarithm of the diameter. Every round is a written table. Sums are joined, nothing is
    collected; only the number of changed labels reaches the driver. Nulls and loops are left out.
    """
    e = edges.where("src is not null and dst is not null and src <> dst").select("src", "dst")
    both = materialise(e.union(e.select("dst", "src")).toDF("src", "dst").distinct(), "edges")
    labels = materialise(
        both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("component")), "labels"
    )
    for _ in range(max_rounds):
        near = (
            both.join(labels.toDF("dst", "label"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("m"))
            .join(labels, "node").select("node", F.least("m", "component").alias("up"), F.col("component").alias("old"))
        )
        jump = near.join(labels.toDF("up", "top"), "up", "left").select("node", F.least("up", F.coalesce("top", "up")).alias("component"), "old")
        step = materialise(jump, "labels")
        labels = step.select("node", "component")
        if not step.where("component <> old").limit(1).count():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def local_spanning(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star (member, root) for each component of the graph of n nodes with edges a-b."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        live = ra != rb
        if not live.any():
            break
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    m = np.flatnonzero(root != np.arange(n))
    return m, root[m]


def least_star(names: np.ndarray, member: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the names of a spanning star's nodes (positions ``member``, ``root``) to the least name of their component."""
    least = names.copy()
    np.minimum.at(least, root, names[member])
    tops = np.unique(root)
    src, dst = np.concatenate([names[member], names[tops]]), least[np.concatenate([root, tops])]
    return src[src != dst], dst[src != dst]


def thinned(edges: DataFrame, name: str = "thin") -> DataFrame:
    """``src, dst``: fewer edges with the same components, a durable table.

    Each node keeps the edge to the least of its smaller neighbours, to which the others are linked instead. Where a node meets its component in
    many tasks, each of which links it to the least of what met there (least_star()), one edge a node stays and those between the few ends.
    A node's smaller neighbours meet in one task, so stars around greatest nodes belong turned first.
    """
    e = edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    e = e.withColumn("m", F.min("dst").over(Window.partitionBy("src")))
    both = F.array(F.struct("src", F.col("m").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")))
    return materialise(e.select(F.explode(both).alias("e")).select("e.src", "e.dst").where("src <> dst").distinct(), name)


def spanning_pairs(hit: np.ndarray, rows: np.ndarray, cols: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """local_spanning() from a boolean matrix over rows x cols of m nodes: each node's row and column are read once, no edge list is made."""
    at_r, at_c = np.full(m, -1), np.full(m, -1)
    at_r[rows], at_c[cols] = np.arange(len(rows)), np.arange(len(cols))
    new = np.ones(m, bool)
    member, root = [], []
    for start in range(m):
        if not new[start]:
            continue
        new[start] = False
        todo = [start]
        while todo:
            x = todo.pop()
            near = np.zeros(m, bool)
            if at_r[x] >= 0:
                near[cols] = hit[at_r[x]]
            if at_c[x] >= 0:
                near[rows] |= hit[:, at_c[x]]
            found = np.flatnonzero(near & new).tolist()
            new[found] = False
            todo += found
            member += found
            root += [start] * len(found)
    return np.array(member, np.int64), np.array(root, np.int64)


#: A key with more than one HOT-th of a join's rows is hot; there are fewer than HOT such keys, whatever the data.
HOT = 1000


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: str, how: str = "inner") -> DataFrame:
    """Join (inner or left) with ``right``, a durable table of one row for each key whose column ``rows`` counts the key's rows in left.

    Hot keys are broadcast, at most HOT rows by arithmetic, and their rows in left stay where they are; all others are joined by
    shuffle, where no key fills a task. Of ``right`` the key and ``rows`` stay once.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    hot = right.where(F.col(rows) * HOT > total)
    if not hot.limit(1).count():
        return left.join(right, key, how)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(F.col(rows) * HOT <= total), key, how)
    return left.join(F.broadcast(hot), key).unionByName(rest)


def crc_fold(col: Column, folds: int) -> Column:
    return F.crc32(col.cast("string")) % folds


def sorted_groups(batches, key: str):
    """Slices of record batches with equal values in the long column ``key``, by which the rows are sorted."""
    import pyarrow as pa

    def joined(parts):
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    held, value = [], None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy()
        cut = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), b.num_rows]
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            if held and k[x] != value:
                yield joined(held)
                held = []
            held.append(b.slice(x, y - x))
            value = k[x]
    if held:
        yield joined(held)


def text_slices(batch, column: str, most: int = 2_000_000):
    """Slices of a record batch with about ``most`` bytes of text each, so that long texts in a row don't add up in memory."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False) + 1000
    part = np.cumsum(size) // most
    cut = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield batch.slice(a, b - a)


def by_group(df: DataFrame, key: str, run, schema: str) -> DataFrame:
    """Send groups of ``key`` to ``run``, which takes an iterator of groups and yields record batches."""
    spread = df.repartition(key).sortWithinPartitions(key)
    return spread.mapInArrow(lambda batches: run(sorted_groups(batches, key)), schema)
