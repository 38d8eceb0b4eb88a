"""Maximum inner product search: score-aware (anisotropic) 4-bit product quantisation with error bounds, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_group, materialise

SAMPLE = 8000  # vectors that the codebooks are fitted on, at most in expectation
INDEX_BLOCK = 65536
QUERY_BLOCK = 4096
#: Components of a block's vectors at most, so that blocks of long vectors hold fewer of them.
BLOCK_NUMBERS = 1 << 22
RERANK = 200


class Quantiser:
    """Product codebooks of 16 centroids for each dimension, or ``width`` dimensions together.

    The loss of a vector x with residual r is |r|^2 + (eta - 1) (r . x)^2 / |x|^2: error parallel to x, which shifts the
    greatest inner products, counts eta times. Codes and centroids descend on it in turn, one subspace at a time.
    """

    def __init__(self, books: np.ndarray, eta: float) -> None:
        self.books, self.eta = books, eta  # [subspaces, 16, width]

    @classmethod
    def fit(cls, x: np.ndarray, width: int = 1, threshold: float = 0.2, rounds: int = 8, seed: int = 1) -> Quantiser:
        dims = x.shape[1]
        parts = -(-dims // width)
        parts += parts % 2
        eta = max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))
        rng = np.random.default_rng(seed)
        split = cls._split(x, parts, width)
        books = np.stack([split[rng.choice(len(x), 16, replace=len(x) < 16), m] for m in range(parts)])
        q = cls(books, eta)
        codes = None
        for _ in range(rounds):
            codes = q.encode(x, codes, passes=1)
            approx = np.stack([books[m][codes[:, m]] for m in range(parts)], 1)
            weight = (eta - 1) / (split**2).sum((1, 2))
            gap = ((split - approx) * split).sum((1, 2))  # r . x
            for m in range(parts):
                s = split[:, m]
                rest = gap - ((s - approx[:, m]) * s).sum(1)
                for c in range(16):
                    mine = codes[:, m] == c
                    if not mine.any():
                        books[m, c] = s[rng.integers(len(x))]
                        continue
                    t, w = s[mine], weight[mine]
                    left = mine.sum() * np.eye(width) + (t * w[:, None]).T @ t
                    right = t.sum(0) + (t * (w * (rest[mine] + (t**2).sum(1)))[:, None]).sum(0)
                    books[m, c] = np.linalg.solve(left, right)
                approx[:, m] = books[m][codes[:, m]]
                gap = rest + ((s - approx[:, m]) * s).sum(1)
        return q

    @staticmethod
    def _split(x: np.ndarray, parts: int, width: int) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)

    def encode(self, x: np.ndarray, codes: np.ndarray | None = None, passes: int = 2) -> np.ndarray:
        parts, _, width = self.books.shape
        split = self._split(x, parts, width)
        far = ((split[:, :, None, :] - self.books) ** 2).sum(-1)  # [n, parts, 16]
        par = ((split[:, :, None, :] - self.books) * split[:, :, None, :]).sum(-1)
        codes = far.argmin(-1) if codes is None else codes.copy()
        weight = ((self.eta - 1) / (x**2).sum(1))[:, None]
        rows = np.arange(len(x))
        gap = np.take_along_axis(par, codes[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(passes):
            for m in range(parts):
                rest = gap - par[rows, m, codes[:, m]]
                codes[:, m] = (far[:, m] + weight * (rest[:, None] + par[:, m]) ** 2).argmin(1)
                gap = rest + par[rows, m, codes[:, m]]
        return codes

    def pack(self, x: np.ndarray, codes: np.ndarray | None = None) -> np.ndarray:
        codes = (self.encode(x) if codes is None else codes).astype(np.uint8)
        return codes[:, ::2] | codes[:, 1::2] << 4

    def gap(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How far a scan() of these codes for a query of length 1 can be from its inner product with x: |r|, and the rounding of scan()."""
        parts, _, width = self.books.shape
        r = np.sqrt(((self._split(x, parts, width) - self.books[np.arange(parts), codes]) ** 2).sum((1, 2)))
        return r + (parts / 2 + 4) * np.finfo(np.float32).eps * (np.sqrt((x**2).sum(1)) + r)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of each query with two subspaces' centroids: [queries, subspaces / 2, 256]."""
        parts, _, width = self.books.shape
        one = np.einsum("qmw,mcw->qmc", self._split(queries, parts, width), self.books).astype(np.float32)
        return (one[:, ::2, None, :] + one[:, 1::2, :, None]).reshape(len(queries), parts // 2, 256)

    def scan(self, queries: np.ndarray, packed: np.ndarray) -> np.ndarray:
        lut = self.tables(queries)
        out = np.zeros((len(queries), len(packed)), np.float32)
        for j in range(packed.shape[1]):
            out += np.take(lut[:, j], packed[:, j], axis=1)
        return out


def usable(col: str) -> object:
    v = F.col(col)
    return (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def matrix(lists: pa.Array) -> np.ndarray:
    """Rows of equal length, without nulls, in the type that they have."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 and the lengths, in double precision."""
    x = x.astype(np.float64)
    most = np.abs(x).max(1, keepdims=True)
    x /= most
    size = np.sqrt((x**2).sum(1, keepdims=True))
    return x / size, (most * size)[:, 0]


def greatest(q: np.ndarray, x: np.ndarray, near: np.ndarray, gap: np.ndarray, size: np.ndarray, first: np.ndarray, keep: int, rerank: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the rows of x with the ``keep`` greatest inner products, ties to the smaller ``first``, and these products.

    ``near`` has the inner products of directions by codes, each within ``gap`` of the true one. The ``rerank`` rows that may be the
    greatest by that are computed exactly, then all others that may still reach the least of the ``keep`` greatest among them.
    """

    def exact(v: np.ndarray, rows: np.ndarray) -> np.ndarray:
        step = max(1, BLOCK_NUMBERS // x.shape[1])
        return np.concatenate([np.einsum("rd,d->r", x[rows[k : k + step]].astype(np.float64), v) for k in range(0, len(rows), step)])

    length = directions(q)[1]
    m = min(max(rerank, keep), len(x))
    for v, reach, norm in zip(q.astype(np.float64), (near + gap) * size, length, strict=True):
        rows = np.argpartition(-reach, m - 1)[:m]
        score = exact(v, rows)
        if m < len(x):
            reach[rows] = -np.inf
            rest = np.flatnonzero(reach >= np.partition(score, m - keep)[m - keep] / norm)
            if len(rest):
                rows, score = np.concatenate([rows, rest]), np.concatenate([score, exact(v, rest)])
        best = np.lexsort((first[rows], -score))[:keep]
        yield rows[best], score[best] + 0.0


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, rerank: int = RERANK, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose key is divisible by ``every`` the k greatest inner products.

    Equal vectors are one index entry with their k + 1 least keys, which is all that a result can show of them; that bounds
    groups of copies without loss. Codebooks come from the directions of at most SAMPLE vectors; every vector is indexed, with its length and
    the distance of its direction to its code. Blocks of queries meet blocks of the index: a table scan over 4-bit codes bounds all inner products, those of the ``rerank``
    best are computed in double precision, and so are all that the bounds do not put behind them. So the result is that of a
    comparison with every row, whatever the rows; on rows that codes tell apart badly more of them are computed.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without key, take no part; vectors of
    different length never meet. Equal rows count once. Ties go to the smaller key. Columns other than key and vector play no part. No
    usable vector: an empty result.
    """
    spark = vectors.sparkSession
    plain = F.col(vec) if vectors.schema[vec].dataType.elementType.typeName() == "float" else F.col(vec).cast("array<double>")
    rows = vectors.where(F.col(key).isNotNull() & F.col(vec).isNotNull()).select(F.col(key).cast("long").alias("id"), plain.alias("v")).where(usable("v"))
    rows = materialise(rows.dropDuplicates(["id", "v"]), "vectors")
    least = Window.partitionBy("v").orderBy("id")
    groups = rows.withColumn("_r", F.row_number().over(least)).where(F.col("_r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    groups = materialise(groups, "entries").withColumn("h", F.xxhash64("v"))
    asked = materialise(rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "v", F.xxhash64("v").alias("h")), "queries")
    out = None
    for r in groups.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect():
        part = _search(groups.where(F.size("v") == r["d"]), asked.where(F.size("v") == r["d"]), r["n"], r["d"], k, rerank)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return out


def _search(groups: DataFrame, asked: DataFrame, n: int, d: int, k: int, rerank: int) -> DataFrame:
    """``h`` names a vector within its length; two that shared one would only be asked together."""
    spark = groups.sparkSession
    sample = np.array([r["v"] for r in groups.where(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / n))).select("v").collect() or groups.limit(64).select("v").collect()])
    model = spark.sparkContext.broadcast(Quantiser.fit(directions(sample)[0]))
    vector, most = groups.schema["v"].dataType, max(1, BLOCK_NUMBERS // d)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, size = directions(matrix(b.column("v")))
                codes = model.value.encode(x)
                packed = pa.array([c.tobytes() for c in model.value.pack(x, codes)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("h"), packed, pa.array(size), pa.array(model.value.gap(x, codes)), b.column("v"), b.column("ids")], names=["h", "codes", "size", "gap", "v", "ids"])

    index = groups.select("h", "v", "ids").mapInArrow(encode, f"h long, codes binary, size double, gap double, v {vector.simpleString()}, ids array<long>")
    index, distinct = materialise(index, "index"), materialise(asked.dropDuplicates(["v"]).select("h", "v"), "distinct")
    blocks, sets = max(1, -(-n // min(INDEX_BLOCK, most))), max(1, -(-distinct.count() // min(QUERY_BLOCK, most)))
    one = lambda col, m: F.pmod(F.xxhash64(F.lit(col), "h"), F.lit(m)).cast("int")
    left = index.withColumns({"i": one("i", blocks), "s": F.explode(F.sequence(F.lit(0), F.lit(sets - 1)))})
    right = distinct.withColumns({"i": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "s": one("s", sets)})
    tasks = left.unionByName(right, allowMissingColumns=True).withColumn("task", F.xxhash64("i", "s")).drop("i", "s")
    found_type = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int64()))]))

    def run(met: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in met:
            entry = g.column("codes").is_valid().to_numpy(zero_copy_only=False)
            if entry.all() or not entry.any():
                continue
            x, h, mine = matrix(g.column("v")), g.column("h"), pa.array(entry)
            q, qh, x = x[~entry], h.filter(pa.array(~entry)), x[entry]
            packed = np.frombuffer(b"".join(g.column("codes").filter(mine).to_pylist()), np.uint8).reshape(len(x), -1)
            size, gap = (g.column(c).filter(mine).to_numpy() for c in ("size", "gap"))
            ids = g.column("ids").filter(mine)
            first = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
            for lo in range(0, len(q), 64):
                some = q[lo : lo + 64]
                best = greatest(some, x, model.value.scan(directions(some)[0], packed), gap, size, first, k + 1, rerank)
                found = [[{"score": s, "ids": e} for s, e in zip(score.tolist(), ids.take(pa.array(at)).to_pylist(), strict=True)] for at, score in best]
                yield pa.RecordBatch.from_arrays([qh.slice(lo, 64), pa.array(found, found_type)], names=["h", "found"])

    top = by_group(tasks, "task", run, "h long, found array<struct<score:double,ids:array<long>>>")
    if blocks > 1:
        best = Window.partitionBy("h").orderBy(F.desc("f.score"), F.col("f.ids")[0])
        top = top.select("h", F.explode("found").alias("f")).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1).groupBy("h").agg(F.collect_list("f").alias("found"))
    top = materialise(top, "nearest")
    each = F.flatten(F.transform("found", lambda f: F.transform(F.filter(f["ids"], lambda i: i != F.col("query_id")), lambda i: F.struct((-f["score"]).alias("s"), i.alias("id")))))
    best = asked.select("query_id", "h").join(top, "h").select("query_id", F.posexplode(F.slice(F.array_sort(each), 1, k)).alias("p", "x"))
    return best.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))
