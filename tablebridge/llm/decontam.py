"""Benchmark decontamination by spaced seeds. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

# Token offsets that a seed reads; the others inside its span of eight may differ.
MASKS = ((0, 1, 2, 4, 5, 7), (0, 2, 3, 4, 6, 7))
SPAN = 8
#: Seeds (16 bytes each and as much again for the table) and benchmark tokens up to which a side is broadcast.
BROADCAST_ROWS = 2_000_000


def token_hashes(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits of a text; null has none."""
    parts = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(parts, lambda x: F.xxhash64(x))


def need(n: Column) -> Column:
    """Least score of an overlap with a benchmark text of n tokens."""
    return F.least(F.lit(12), F.greatest(F.lit(8), F.ceil(n * 0.6).cast("int")))


def _seeds(tokens: Column, at: Column) -> Column:
    return F.array(*[F.xxhash64(F.lit(k), *[F.get(tokens, at + d) for d in mask]) for k, mask in enumerate(MASKS)])


def _seeded(df: DataFrame, *keep: str) -> DataFrame:
    """A row for each position of column ``h`` and mask: ``keep..., h, at, seed``.

    The outer form keeps Spark from filtering on the size of ``h`` below, which would compute the tokens again.
    """
    places = df.select(*keep, "h", F.posexplode_outer("h").alias("at", "_")).where(F.col("at") <= F.size("h") - SPAN)
    return places.select(*keep, "h", "at", F.explode(_seeds(F.col("h"), F.col("at"))).alias("seed"))


def _score(doc: Column, item: Column) -> Column:
    """Greatest sum over a stretch of two aligned token lists, 1 for equal tokens and -1 for a substitution."""
    steps = F.zip_with(doc, item, lambda x, y: F.when(x == y, F.lit(1)).otherwise(F.lit(-1)))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        now = F.greatest(acc["now"] + x, F.lit(0))
        return F.struct(now.alias("now"), F.greatest(acc["best"], now).alias("best"))

    return F.aggregate(steps, start, step, lambda acc: acc["best"])


def _verified(hits: DataFrame, *keys: str) -> DataFrame:
    """Score hits (columns h, bh, diag) along their diagonal over the whole benchmark text; keep those that reach need()."""
    low, n = F.greatest(F.lit(0), F.col("diag")), F.size("bh")
    length = F.least(F.size("h"), F.col("diag") + n) - low
    scored = hits.withColumn("score", _score(F.slice("h", low + 1, length), F.slice("bh", low - F.col("diag") + 1, length)))
    return scored.where(F.col("score") >= need(n)).groupBy(*keys, "item_id").agg(F.max("score").cast("long").alias("score"), F.max(n).cast("long").alias("item_tokens"))


def overlaps(docs: DataFrame, bench: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """Pairs of a document and a benchmark text that it holds: ``doc_id, item_id, score, item_tokens``, one row a pair.

    Every position of every text is hashed with every mask and joined with the benchmark's seeds; a hit is verified along
    its diagonal, where a substituted token costs what an equal one adds. A benchmark text of fewer than eight tokens, in which no seed fits,
    is held by a document of the same tokens and no others. Texts without tokens (null and empty ones among them) overlap with nothing.
    Equal rows and equal keys share one result row; other columns play no part, whatever their names; empty tables give an empty result;
    a text of any length is read whole.

    Hits are reduced to distinct diagonals, which meet their documents again, so that the work grows with tokens and not with the square of a
    held text. The benchmark is broadcast only if its counted seeds stay under BROADCAST_ROWS; a larger one is joined by shuffle.
    """
    items = bench.select(F.col(item).alias("item_id"), token_hashes(F.col(text)).alias("bh")).where(F.size("bh") > 0).distinct()
    short, items = items.where(F.size("bh") < SPAN), items.where(F.size("bh") >= SPAN)
    size = items.unionByName(short).agg(F.coalesce(F.sum(F.size("bh")), F.lit(0)).alias("n")).first()["n"] * len(MASKS)
    few = size <= BROADCAST_ROWS
    near = F.broadcast if few else lambda df: df
    seeds = _seeded(items.select("item_id", F.col("bh").alias("h")), "item_id").select("seed", "item_id", F.col("at").alias("item_at")).distinct()
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), token_hashes(F.col(text)).alias("h"))
    same = rows.where((F.size("h") < SPAN) & (F.size("h") > 0)).withColumn("hh", F.xxhash64("h")).join(near(short.withColumn("hh", F.xxhash64("bh"))), "hh").where("h = bh")
    same = same.select("doc_id", "item_id", F.size("bh").cast("long").alias("score"), F.size("bh").cast("long").alias("item_tokens")).distinct()
    # However many seeds hit on a diagonal, it is verified once; positions travel without tokens, and only texts with a hit are read again.
    hits = _seeded(rows, "doc_id", "th").drop("h").join(near(seeds), "seed").select("doc_id", "th", "item_id", (F.col("at") - F.col("item_at")).alias("diag"))
    hits = materialise(hits.distinct(), "diagonals")
    held = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), F.col(text).alias("t")).dropDuplicates(["doc_id", "th"])
    some = hits.select("doc_id", "th").distinct()
    found = held.alias("d").join(some.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.th") == F.col("s.th")), "left_semi").withColumn("h", token_hashes(F.col("t"))).drop("t")
    each = hits.alias("a").join(found.alias("d"), F.col("a.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("a.th") == F.col("d.th")))
    return _verified(each.select("a.doc_id", "item_id", "diag", "h").join(near(items), "item_id"), "doc_id").unionByName(same)


def remove(docs: DataFrame, bench: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Documents that hold no benchmark text, as often as they are there; all columns stay, whatever their names.

    Keys decide: a key with an overlap takes all rows of the key along, a null key all null keys. Null and empty texts stay; an empty benchmark takes none.
    """
    bad = overlaps(docs, bench, text, key).select(F.col("doc_id").alias("bad")).distinct()
    return docs.join(bad, docs[key].eqNullSafe(bad["bad"]), "left_anti")
