"""Mixing sources to target weights: how many copies of each document the mix takes.

Each source aims at a share of all words by its weight, at most ``MOST`` times its own words; what a full source can't take is shared again by
weight. A document of a source whose target is f times its words is taken floor(f) times, and once more with probability f - floor(f). These
fractions are rounded by the pivotal method: of two documents one gives its fraction to the other until one of them is 0 or 1, in which
direction is drawn so that each document keeps its probability. What moves is words, so the sum of words stays as it is in every step. A document
much larger than its neighbours is paired with those behind it together.

Documents of a source are ordered by size and dealt to blocks of ``BLOCK``; within a block neighbours are paired, so that words move between documents of like
size. A block leaves at most one fraction, and the fractions of ``BLOCK`` blocks are a block of the next level: a tree with as many levels as the
logarithm of the largest source. The last fraction of a source goes to the nearer side, so a source misses its target by at most half of one
document (and less than a word of rounding).

Draws are hashes of the source's name, the place in its order and a seed, so that reruns agree. Rows: null texts have no words and are taken 0 times, as
all without words; a null source is one source, the last; equal rows are documents of their own, which may be taken unequally often; an
empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablebridge.operators.scan import running

from .common import by_group, join_hot, materialise, mix64

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = [5, 2, 1]
MOST = 3
#: Documents, or fractions of the level below, that one task rounds at a time.
BLOCK = 1024
SEED = 20260


def _keep(df: DataFrame) -> DataFrame:
    return materialise(df, "mix")


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size``; the text is read once and goes no further."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"))


def targets(sizes: DataFrame, weights: list[int] = WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """``source, nth, n_docs, source_size, factor, target`` of each source.

    Sources by code point, null last, have ``weights`` in turn and share ``share`` of all words. A source whose part is above ``most`` times its
    own words gets just that, and the others share the rest by weight, until none is above: a round for each time that more become
    full, of which only two sums reach the driver.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")).withColumn("last", F.col("source").isNull())
    numbered = running(per, [], ["last", "source"], {"nth": ("sum", F.lit(1))}, _keep)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = _keep(numbered.withColumn("weight", weight).drop("last"))
    total = ranked.agg(F.sum("source_size").alias("z"), F.sum("weight").alias("w")).first()
    words, parts, full = (total["z"] or 0) * share, total["w"] or 1, -1
    ceiling = (most * F.col("source_size")).cast("double")
    while True:
        part = F.col("weight") * F.lit(float(words)) / F.lit(float(parts))
        above = ranked.where(part > ceiling).agg(F.count("*").alias("n"), F.sum("source_size").alias("z"), F.sum("weight").alias("w")).first()
        if above["n"] <= full or above["w"] == total["w"]:
            break
        full, words, parts = above["n"], (total["z"] or 0) * share - most * (above["z"] or 0), total["w"] - (above["w"] or 0)
    target = F.least(F.col("weight") * F.lit(float(words)) / F.lit(float(parts)), ceiling)
    factor = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    return _keep(ranked.select("source", "nth", "n_docs", "source_size", factor.alias("factor"), target.alias("target")))


def round_pairs(fraction: np.ndarray, size: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Round one block in its order: the fractions, all 0 or 1 but for one at most, and the place of that one (-1 if none).

    The open document meets the next one. Moved words keep the sum; up with the chance of down's length and the other way round, so that
    the mean of each fraction stays. A document over twice as large as the next one would use up one after the other and stay open at the end, with
    all its words uncertain: its partner is all that follow, taken together, each by p * (1 - p). Each step settles one document at least.
    """
    p, open_, i, steps = fraction.copy(), -1, 0, 0
    p[p <= EPS], p[p >= 1 - EPS] = 0, 1
    while i < len(p):
        if p[i] in (0, 1):
            i += 1
            continue
        if open_ < 0:
            open_, i = i, i + 1
            continue
        with_ = np.array([i]) if size[open_] <= 2 * size[i] else i + np.flatnonzero((p[i:] > 0) & (p[i:] < 1))
        part = p[with_] * (1 - p[with_])
        part *= size[open_] / (part * size[with_]).sum()
        up, down = min(1 - p[open_], (p[with_] / part).min()), min(p[open_], ((1 - p[with_]) / part).min())
        step = up if draw[steps] * (up + down) < down else -down
        steps += 1
        p[open_] += step
        p[with_] -= step * part
        p[p <= EPS], p[p >= 1 - EPS] = 0, 1
        if p[open_] in (0, 1):
            open_ = -1
    return p, open_


EPS = 1e-9
LEVEL = "doc_id long, source string, size long, source_size long, target double, whole long, fraction double, at long, block long, name long, open boolean"
LEVEL_ARROW = pa.schema([(n, {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in LEVEL.split(", "))])


def rounded(level: int, last: bool):
    """Rounds blocks of one level; at the last one the open fraction goes to the nearer side."""

    def run(groups):
        for g in groups:
            t = pa.Table.from_batches([g]).sort_by("at")
            p, z, name = (t.column(c).to_numpy() for c in ("fraction", "size", "name"))
            draw = mix64(name.astype(np.uint64) ^ mix64(np.full(len(p), SEED + level, np.uint64))) / 2.0**64
            p, open_ = round_pairs(p, z.astype(float), draw)
            if last and open_ >= 0:
                p[open_], open_ = float(p[open_] >= 0.5), -1
            still = np.arange(len(p)) == open_
            t = t.set_column(t.schema.get_field_index("fraction"), "fraction", pa.array(p)).append_column("open", pa.array(still))
            yield t.select(LEVEL_ARROW.names).cast(LEVEL_ARROW).combine_chunks().to_batches()[0]

    return run


def mix(docs: DataFrame, weights: list[int] = WEIGHTS, most: int = MOST, share: float = 1.0, block: int = BLOCK) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document; the target is its source's, taken counts words, repeats included."""
    sizes = _keep(sized(docs))
    aims = targets(sizes, weights, most, share)
    null, named = F.col("source").isNull(), F.coalesce("source", F.lit(""))
    keyed = aims.select(null.alias("no_source"), named.alias("named"), "nth", "n_docs", "source_size", "factor", "target")
    each = join_hot(sizes.select("doc_id", "source", "size", null.alias("no_source"), named.alias("named")), keyed, ["no_source", "named"], "n_docs")
    whole = F.floor("factor").cast("long")
    each = each.select("doc_id", "source", "size", "source_size", "target", whole.alias("whole"), (F.col("factor") - whole).alias("fraction"), "nth")
    # Those without words move none, and are taken 0 times.
    empty = each.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    order = [F.desc("size"), F.asc("mixed"), F.asc("doc_id"), F.asc("tie")]
    full = each.where("size > 0").withColumns({"mixed": F.xxhash64(F.lit(SEED), "doc_id"), "tie": F.monotonically_increasing_id()})
    placed = running(full, ["nth"], order, {"place": ("sum", F.lit(1))}, _keep).withColumn("at", F.col("place") - 1)

    longest = aims.agg(F.max("n_docs")).first()[0] or 0
    todo = placed.select("doc_id", "source", "size", "source_size", "target", "whole", "fraction", "at", F.xxhash64("nth", "at").alias("name"), "nth")
    level, done = 0, []
    while True:
        longest = -(-longest // block)
        # Sources are numbered without gaps and have fewer than 2^32 blocks each.
        blocks = todo.withColumn("at", F.col("at")).withColumn("block", F.col("nth") * F.lit(1 << 32) + F.floor(F.col("at") / block))
        out = _keep(by_group(blocks.drop("nth"), "block", rounded(level, longest <= 1), LEVEL))
        done.append(out.where(~F.col("open")))
        if longest <= 1:
            break
        up = out.where("open").withColumn("nth", F.shiftright("block", 32)).withColumn("at", F.col("block").bitwiseAND(F.lit((1 << 32) - 1)))
        todo, level = up.drop("block", "open"), level + 1
    taken = reduce(DataFrame.unionByName, done).select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.round("fraction").cast("long"))).alias("taken"))
    return taken.unionByName(empty)
