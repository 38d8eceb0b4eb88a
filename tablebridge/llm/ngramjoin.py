"""N-gram Jaccard join: a MinHash LSH forest whose matched prefixes are shortened by measured recall proposes, exact set comparison decides."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, components, free_name, join_hot, least_star, local_spanning, materialise, mix64, spanning_pairs, text_slices, thinned, word_shingles

GRAM = 5
LEAST = 0.8
TREES = 16
DEEPEST = 8
TARGET = 0.999
#: Lower ends of the strata of similarity in which recall is measured.
STRATA = (0.8, 0.85, 0.9, 0.95)
BLOCK = 1024
#: Shingles of a block in the exact comparison (eight bytes each), so that blocks of long texts hold fewer sets.
BLOCK_SHINGLES = 2_000_000


def recall(similarity: float, depth: int, trees: int = TREES) -> float:
    """Chance that two sets of this similarity share a prefix of ``depth`` values in one of the trees."""
    return 1 - (1 - similarity**depth) ** trees


def next_depth(found: dict[int, tuple[float, list[float]]], depth: int, target: float = TARGET) -> int:
    """How long a prefix may be, at most ``depth``, for each stratum of similarity to reach the target recall.

    ``found`` has for a stratum the estimated number of links and, for prefixes of 1, 2, ... values, how many of them are met.
    A stratum of which nothing was found gives no evidence; there the chance at its lower end counts.
    """
    for d in range(depth, 1, -1):
        reached = [found[k][1][d - 1] / found[k][0] if k in found else recall(low, d) for k, low in enumerate(STRATA)]
        if min(reached) >= target:
            return d
    return 1


@lru_cache(1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    seed = mix64(np.arange(1, 2 * TREES * DEEPEST + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seed[::2] | np.uint64(1), seed[1::2]


def signature(shingles: np.ndarray) -> np.ndarray:
    """TREES x DEEPEST MinHash values (high 16 bits of affine maps modulo 2^64): a label of DEEPEST values for each tree."""
    a, b = _permutations()
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 256):
        np.minimum(least, (shingles[k : k + 256, None] * a + b).min(0), out=least)
    return (least >> np.uint64(48)).astype(">u2").reshape(TREES, DEEPEST)


def signatures(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, rk, sid, n, sig`` of every row.

    rk names a row (its key and text), sid a shingle set (64 bits of a hash of it), null without shingles; n counts
    shingles; sig holds the labels of all trees, two bytes a value.
    """
    row = F.md5(F.concat_ws("\x00", F.col(key).cast("string"), F.length(text).cast("string"), F.col(text)))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), row.alias("rk"), F.col(text).alias("t"))
    schema = "doc_id long, rk string, sid long, n int, sig binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_slices(whole, "t"):
                sid, n, sig = [], [], []
                for t in b.column("t").to_pylist():
                    s = word_shingles(t, GRAM)
                    n.append(len(s))
                    sid.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None)
                    sig.append(signature(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rk"), pa.array(sid, pa.int64()), pa.array(n, pa.int32()), pa.array(sig, pa.binary())], names=["doc_id", "rk", "sid", "n", "sig"])

    return rows.mapInArrow(run, schema)


def forest(sets: DataFrame) -> DataFrame:
    """``tree, label, sid``: the tries of all trees, each set's label in each tree in sorted order; a node is a run of labels with one prefix."""
    labels = F.array(*[F.substring("sig", 2 * DEEPEST * t + 1, 2 * DEEPEST) for t in range(TREES)])
    rows = sets.select("sid", F.posexplode(labels).alias("tree", "label")).select("tree", "label", "sid")
    return materialise(rows.repartitionByRange("tree", "label", "sid").sortWithinPartitions("tree", "label", "sid"), "forest")


def _blocked(df: DataFrame, group: str, count: str, size: int = BLOCK) -> DataFrame:
    """Spread the rows of each group, ``count`` of them, over blocks of about ``size`` and send each row to all pairs of its block.

    Adds ``task`` (a pair of blocks) and ``side``: 0 all rows meet, 1 and 2 only rows of different sides meet.
    """
    df = df.withColumn("_p", F.ceil(F.col(count) / size).cast("int")).withColumn("_s", F.when(F.col("_p") > 1, F.pmod(F.xxhash64("sid", F.lit(7)), F.col("_p"))).otherwise(F.lit(0)).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("_p") - 1),
        lambda x: F.struct(F.xxhash64(F.col(group), F.least(x, F.col("_s")), F.greatest(x, F.col("_s"))).alias("task"), F.when(x == F.col("_s"), 0).when(x > F.col("_s"), 1).otherwise(2).alias("side")),
    )
    return df.withColumn("_t", F.explode(pairs)).withColumns({"task": F.col("_t.task"), "side": F.col("_t.side")}).drop("_p", "_s", "_t")


def _met(side: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which columns a block of rows is compared with: later rows of the same side 0, or the other side."""
    later = rows[:, None] < np.arange(len(side))[None, :]
    return later & ((side[rows][:, None] == 0) & (side[None, :] == 0) | (side[rows][:, None] != side[None, :]))


def matched(trees: DataFrame, sets: DataFrame, depth: int) -> DataFrame:
    """What meets under prefixes of ``depth`` values: links ``src, dst``, and sums ``stratum, prefix, met`` over the pairs.

    Sets of one node are compared in blocks by signature and by the sizes' ratio; a pair is open down to five standard
    deviations under the threshold. Only a spanning forest of the open pairs comes out, around the least set of each tree. Each pair that looks like a link is counted in the
    first tree in which it meets, by the inverse of its chance to meet at all (prefix 0) and by what other prefixes would have met of it.
    """
    hashes = TREES * DEEPEST
    open_from = int((LEAST - 5 * (LEAST * (1 - LEAST) / hashes) ** 0.5) * hashes)
    node = trees.select("sid", "tree", F.xxhash64("tree", F.substring("label", 1, 2 * depth)).alias("node"))
    full = materialise(node.groupBy("node").agg(F.count("*").alias("c")).where("c > 1"), "nodes")
    meeting = materialise(join_hot(node, full, "node", "c"), "meeting")
    rows = _blocked(meeting.join(sets.select("sid", "n", "sig"), "sid"), "node", "c")
    chance = np.array([[recall(k / hashes, d) for d in range(1, DEEPEST + 1)] for k in range(hashes + 1)])
    weight = np.concatenate([np.ones((hashes + 1, 1)), chance], 1) / np.maximum(chance[:, depth - 1 : depth], 1e-300)
    stratum = np.searchsorted(STRATA, np.arange(hashes + 1) / hashes + 1e-9, side="right") - 1

    def run(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst = [], []
        sums = np.zeros((len(STRATA), DEEPEST + 1))

        def links() -> pa.RecordBatch:
            x, y = np.concatenate(src), np.concatenate(dst)
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.nulls(len(x), pa.int32()), pa.nulls(len(x), pa.int32()), pa.nulls(len(x), pa.float64())], names=["src", "dst", "stratum", "prefix", "met"])

        for g in groups:
            m = g.num_rows
            sid, n, side = (g.column(c).to_numpy() for c in ("sid", "n", "side"))
            tree = g.column("tree")[0].as_py()
            sig = np.frombuffer(b"".join(g.column("sig").to_pylist()), np.uint16).reshape(m, TREES, DEEPEST)
            found_a, found_b = [], []
            for k in range(0, m, 128):
                some = np.arange(k, min(m, k + 128))
                a, b = np.nonzero(_met(side, some) & (10 * np.minimum(n[some, None], n) >= 10 * LEAST * np.maximum(n[some, None], n) - 1e-6))
                for at in range(0, len(a), 20_000):
                    x, y = some[a[at : at + 20_000]], b[at : at + 20_000]
                    equal = sig[x] == sig[y]
                    count = equal.sum((1, 2))
                    found_a.append(x[count >= open_from])
                    found_b.append(y[count >= open_from])
                    like = np.flatnonzero(stratum[count] >= 0)
                    like = like[equal[like, :, :depth].all(2).argmax(1) == tree]
                    np.add.at(sums, stratum[count[like]], weight[count[like]])
            if found_a:
                x, y = least_star(sid, *local_spanning(m, np.concatenate(found_a), np.concatenate(found_b)))
                src.append(x)
                dst.append(y)
            if sum(map(len, src)) > 50_000:
                yield links()
                src, dst = [], []
        if src:
            yield links()
        k, d = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(k), pa.int64()), pa.nulls(len(k), pa.int64()), pa.array(k.astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(sums[k, d])], names=["src", "dst", "stratum", "prefix", "met"])

    return by_group(rows.select("task", "side", "tree", "sid", "n", "sig"), "task", run, "src long, dst long, stratum int, prefix int, met double")


def candidate_edges(sets: DataFrame, target: float = TARGET) -> tuple[DataFrame, list[tuple[int, dict[int, float]]]]:
    """Links ``src, dst`` that join what meets in the forest, about one for each set, and the recall that was measured at each prefix tried.

    Rows: ``sid, n, sig``, one for each distinct set, a durable table. Prefixes begin at full length and are shortened until, in each stratum of
    similarity, the links that met are at least ``target`` of all, estimated from those that met and their chance to meet.
    Links found with longer prefixes stay.
    """
    trees = forest(sets)
    depth, seen, edges = DEEPEST, [], None
    while True:
        out = materialise(matched(trees, sets, depth), "matched")
        links = out.where("src is not null").select("src", "dst")
        edges = links if edges is None else edges.union(links)
        sums: dict[int, list[float]] = {}
        for r in out.where("stratum is not null").groupBy("stratum", "prefix").agg(F.sum("met").alias("met")).collect():  # a row for each stratum and prefix
            sums.setdefault(r["stratum"], [0.0] * (DEEPEST + 1))[r["prefix"]] = r["met"]
        found = {k: (v[0], v[1:]) for k, v in sums.items()}
        seen.append((depth, {k: v[1][depth - 1] / v[0] for k, v in found.items()}))
        shorter = next_depth(found, depth, target)
        if shorter == depth:
            return thinned(edges, "candidates"), seen
        depth = shorter


def common_counts(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[rows] with sets[columns], by products of incidence matrices."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, df = np.unique(flat, return_inverse=True, return_counts=True)
    shared = df[code] > 1
    owner, code = owner[shared], code[shared]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    out = np.zeros((len(rows), len(columns)), np.float32)
    where_r, where_c = np.full(len(sets), -1), np.full(len(sets), -1)
    where_r[rows], where_c[columns] = np.arange(len(rows)), np.arange(len(columns))
    if not len(code):
        return out
    _, dense = np.unique(code, return_inverse=True)
    width = 2048
    for lo in range(0, int(dense[-1]) + 1, width):
        x, y = np.searchsorted(dense, [lo, lo + width])
        o, c = owner[x:y], dense[x:y] - lo
        w = int(c.max()) + 1
        left, right = np.zeros((len(rows), w), np.float32), np.zeros((len(columns), w), np.float32)
        keep = where_r[o] >= 0
        left[where_r[o[keep]], c[keep]] = 1
        keep = where_c[o] >= 0
        right[where_c[o[keep]], c[keep]] = 1
        out += left @ right.T
    return out


def few_counts(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """common_counts() of a few sets but for those of a set with itself: equal neighbours of two sets sorted together are common."""
    out = np.zeros((len(rows), len(columns)), np.float32)
    known: dict[tuple[int, int], int] = {}
    for i, r in enumerate(rows.tolist()):
        for j, c in enumerate(columns.tolist()):
            if r == c:
                continue
            pair = (r, c) if r < c else (c, r)
            if pair not in known:
                both = np.concatenate((sets[r], sets[c]))
                both.sort()
                known[pair] = np.count_nonzero(both[1:] == both[:-1])
            out[i, j] = known[pair]
    return out


def verified(sets: DataFrame, least: float = LEAST) -> DataFrame:
    """Exact links among the sets of each ``comp``: rows ``sid, other, links``.

    Rows: ``comp, sid, n, copies, s`` (the shingles as bytes), a durable table. A row with null other adds to the number of documents linked
    to one of sid; the rest are a spanning forest of the links. Components of more than BLOCK sets or BLOCK_SHINGLES shingles are cut by size bands,
    of which only equal and neighbouring ones can hold a link, and by blocks.
    """
    band = F.floor(F.log("n") / F.log(F.lit(1 / least)) + 1e-9).cast("int")
    counts = materialise(sets.groupBy("comp").agg(F.count("*").alias("c"), F.sum("n").alias("t")).where("c > 1"), "counts")
    sets = join_hot(sets, counts, "comp", "c")
    fits = (F.col("c") <= BLOCK) & (F.col("t") <= BLOCK_SHINGLES)
    small = sets.where(fits).select(F.xxhash64("comp").alias("task"), F.lit(0).alias("side"), "sid", "n", "copies", "s")
    big = sets.where(~fits).withColumn("band", band)
    sizes = big.groupBy("comp", "band").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("p"))
    up, down = sizes.select("comp", (F.col("band") - 1).alias("band"), F.col("p").alias("up")), sizes.select("comp", (F.col("band") + 1).alias("band"), F.col("p").alias("down"))
    plan = sizes.join(up, ["comp", "band"], "left").join(down, ["comp", "band"], "left").fillna(0, ["up", "down"])
    big = big.join(plan, ["comp", "band"]).withColumn("own", F.pmod(F.xxhash64("sid", F.lit(11)), F.col("p")).cast("int"))

    def task(b, x, y):
        return F.xxhash64(F.col("comp"), b, x, y)

    own = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda x: F.struct(task(F.col("band") * 2, F.least(x, F.col("own")), F.greatest(x, F.col("own"))).alias("task"), F.when(x == F.col("own"), 0).when(x > F.col("own"), 1).otherwise(2).alias("side")))
    above = F.transform(F.filter(F.sequence(F.lit(0), F.col("up")), lambda x: x < F.col("up")), lambda x: F.struct(task(F.col("band") * 2 + 1, F.col("own"), x).alias("task"), F.lit(1).alias("side")))
    below = F.transform(F.filter(F.sequence(F.lit(0), F.col("down")), lambda x: x < F.col("down")), lambda x: F.struct(task(F.col("band") * 2 - 1, x, F.col("own")).alias("task"), F.lit(2).alias("side")))
    large = big.withColumn("t", F.explode(F.concat(own, above, below))).select("t.task", "t.side", "sid", "n", "copies", "s")

    def run(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups:
            if g.num_rows < 2:
                continue
            sid, n, side, copies = (g.column(c).to_numpy() for c in ("sid", "n", "side", "copies"))
            s = [np.frombuffer(x, np.uint64) for x in g.column("s").to_pylist()]
            rows, cols = np.flatnonzero(side < 2), np.flatnonzero(side != 1)
            if not len(rows) or not len(cols):
                continue
            same = (few_counts if g.num_rows <= 6 else common_counts)(s, rows, cols)
            hit = (1 + least) * same >= least * (n[rows, None] + n[None, cols]) - 1e-6
            hit &= rows[:, None] != cols[None, :]
            if not hit.any():
                continue
            if side.max() == 0:
                links = hit @ copies
                named = sid
            else:
                links = np.concatenate([hit @ copies[cols], hit.T @ copies[rows]])
                named = np.concatenate([sid[rows], sid[cols]])
            x, y = least_star(sid, *spanning_pairs(hit, rows, cols, g.num_rows))
            some = links > 0
            yield pa.RecordBatch.from_pydict({
                "sid": np.concatenate([named[some], x]), "other": pa.array([None] * int(some.sum()) + y.tolist(), pa.int64()), "links": np.concatenate([links[some], np.zeros(len(x), links.dtype)]).astype(np.int64),
            })

    return by_group(small.union(large), "task", run, "sid long, other long, links long")


def join_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, rk, class_id, n_links, first`` of every row.

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more; equal sets are
    linked. n_links counts all other documents linked to the row, class_id is the least key of its connected component, and
    first marks the row that stays for its component (least key, then rk; of repeated equal rows all are marked). Rows
    without shingles (null and blank texts) have no links and are a class each, named by their own key. Columns other than key and text play
    no part, whatever their names; texts are compared whole; an empty table gives an empty result.

    What one class costs: its G different sets are compared in blocks, so that each is sent G / BLOCK times, and exactly, since
    n_links counts all of them; equal texts are one set. Classes of millions of different near copies need time in proportion to G squared.
    """
    sigs = materialise(signatures(docs, text, key), "signatures")
    sets = materialise(sigs.where("sid is not null").groupBy("sid").agg(F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.min("rk").alias("rk"), F.min("doc_id").alias("key"), F.min(F.struct("doc_id", "rk")).alias("f")), "sets")
    near = components(candidate_edges(sets)[0]).select(F.col("node").alias("sid"), F.col("component").alias("comp"))
    chosen = sets.select("sid", "n", "copies", "rk").join(near, "sid")
    row = F.md5(F.concat_ws("\x00", F.col(key).cast("string"), F.length(text).cast("string"), F.col(text)))
    texts = chosen.join(docs.select(row.alias("rk"), F.col(text).alias("t")), "rk").dropDuplicates(["rk"]).drop("rk")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_slices(whole, "t"):
                s = pa.array([word_shingles(t, GRAM).tobytes() for t in b.column("t").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(c) for c in ("sid", "n", "copies", "comp")] + [s], names=["sid", "n", "copies", "comp", "s"])

    shingled = texts.select("sid", "n", "copies", "comp", "t").mapInArrow(shingle, "sid long, n int, copies long, comp long, s binary")
    found = materialise(verified(materialise(shingled, "shingles")), "links")
    classes = components(thinned(found.where("other is not null").select(F.col("sid").alias("src"), F.col("other").alias("dst"))))
    links = found.groupBy("sid").agg(F.sum("links").alias("links"))
    known = sets.select("sid", "copies", "key", "f").join(classes.toDF("sid", "comp"), "sid", "left").join(links, "sid", "left")
    known = materialise(known.select("sid", "copies", "key", "f", F.coalesce("comp", "sid").alias("comp"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "known")
    least = materialise(known.groupBy("comp").agg(F.min("key").alias("class_id"), F.min("f").alias("least"), F.count("*").alias("rows")), "classes")
    each = materialise(join_hot(known.drop("key", "f"), least, "comp", "rows").select("sid", "copies", "class_id", "n_links", "least"), "each")
    rows = join_hot(sigs.where("sid is not null").select("doc_id", "rk", "sid"), each, "sid", "copies").select("doc_id", "rk", "class_id", "n_links", (F.struct("doc_id", "rk") == F.col("least")).alias("first"))
    return rows.unionByName(sigs.where("sid is null").select("doc_id", "rk", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first")))


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One document of each class, that with the least key; all columns stay, rows of equal key and text fall together.

    Null and blank texts are classes of their own and stay; of equal keys with different texts of one class one stays; a null key counts
    as the least; an empty table stays empty.
    """
    stay = join_documents(docs, text, key).where("first").select("rk").distinct()
    row = F.md5(F.concat_ws("\x00", F.col(key).cast("string"), F.length(text).cast("string"), F.col(text)))
    rk = free_name(docs, "rk")
    return docs.withColumn(rk, row).join(stay.toDF(rk), rk, "left_semi").dropDuplicates([rk]).drop(rk)
