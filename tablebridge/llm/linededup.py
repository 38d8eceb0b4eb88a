"""Line dedup by winnowing over line hashes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, join_hot, materialise

WINDOW = 2
MIN_CHARS = 50
LONG_CHARS = 200


def _content(text: Column) -> Column:
    """Lines with content: place ``i`` among all lines and trimmed text ``t``."""
    every = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("t")))
    return F.filter(every, lambda x: x["t"] != "")


def line_hashes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, th, l``: hash ``h`` and length ``c`` of each line with content, numbered from 0; documents without any have no row."""
    l = F.transform(_content(F.col(text)), lambda x: F.struct(F.xxhash64(x["t"]).alias("h"), F.char_length(x["t"]).alias("c")))
    return docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), l.alias("l")).where(F.size("l") > 0)


def _shortest(part: Column, window: int, min_chars: int, long_chars: int) -> Column:
    """How many of these lines, from the first on, make a stretch that counts; 0 if all don't."""

    def step(acc: Column, x: Column) -> Column:
        n, chars = acc["n"] + 1, acc["chars"] + x["c"]
        return F.when(acc["ok"], acc).otherwise(F.struct(n.alias("n"), chars.alias("chars"), (((n >= window) & (chars >= min_chars)) | (chars >= long_chars)).alias("ok")))

    return F.aggregate(part, F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars"), F.lit(False).alias("ok")), step, lambda acc: F.when(acc["ok"], acc["n"]).otherwise(0))


def stretches(lines: DataFrame, window: int = WINDOW, min_chars: int = MIN_CHARS, long_chars: int = LONG_CHARS) -> DataFrame:
    """The windows of the winnowing: ``doc_id, th, x, n, wh, at, fp``.

    A stretch of lines counts if it has ``window`` lines and ``min_chars`` characters, or ``long_chars`` characters. The windows are, for each
    line, the shortest such stretch that begins with it and the shortest that ends with it (``x``: first line, ``n``: lines); any stretch
    that counts is made up of windows. A document without one is a window of its own kind, which only equals whole documents.
    ``fp`` is the least line hash in the window and ``at`` its last place there: the fingerprint that is selected; ``wh`` hashes all lines.
    """
    most = max(min_chars, window, 1)  # a line has a character at least
    rule = (window, min_chars, long_chars)
    places = F.sequence(F.lit(0), F.size("l") - 1)
    ahead = F.transform(places, lambda i: _shortest(F.slice("l", i + 1, most), *rule))
    back = F.transform(places, lambda i: _shortest(F.reverse(F.slice("l", F.greatest(i + 2 - most, F.lit(1)), F.least(i + 1, F.lit(most)))), *rule))
    rows = lines.withColumns({"f": ahead, "b": back})
    begin = F.filter(F.transform("f", lambda n, i: F.struct(i.alias("x"), n.alias("n"))), lambda w: w["n"] > 0)
    end = F.filter(F.transform("b", lambda n, i: F.struct((i - n + 1).alias("x"), n.alias("n"))), lambda w: (w["n"] > 0) & (F.get("f", w["x"]) != w["n"]))
    every = F.concat(begin, end)
    whole = F.size(begin) == 0
    rows = rows.select("doc_id", "th", "l", whole.alias("whole"), F.when(whole, F.array(F.struct(F.lit(0).alias("x"), F.size("l").alias("n")))).otherwise(every).alias("w"))

    def one(w: Column) -> Column:
        h = F.transform(F.slice(F.col("l"), w["x"] + 1, w["n"]), lambda y: y["h"])
        at = w["x"] + w["n"] - F.array_position(F.reverse(h), F.array_min(h)).cast("int")
        return F.struct(w["x"].alias("x"), w["n"].alias("n"), F.xxhash64(h, "whole").alias("wh"), at.alias("at"), F.array_min(h).alias("fp"))

    return rows.select("doc_id", "th", F.explode(F.transform("w", one)).alias("w")).select("doc_id", "th", "w.*")


def fingerprints(windows: DataFrame) -> DataFrame:
    """Selected fingerprints that stand in more than one place: ``fp, places`` (windows that select it)."""
    place = F.struct("doc_id", "th", "at")
    return windows.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("places")).where("a <> b").select("fp", "places")


def repeated_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, min_chars: int = MIN_CHARS, long_chars: int = LONG_CHARS) -> DataFrame:
    """Later runs of lines and what they repeat: ``doc_id, th, start, lines, of_doc, of_start`` (lines with content, from 0).

    Order of the corpus: key (nulls first), hash of the text, line. Positions are joined by their fingerprint, which every repeated
    stretch that counts has in common with its earlier place. A joined position is extended both ways to its window and held against
    the first place of the same lines, and windows that repeat one document at the same distance grow together to runs. All runs together hold a
    line if, and only if, it lies in a stretch that counts and stands, line for line, in one earlier place.
    """
    lines = materialise(line_hashes(docs, text, key), "lines")
    windows = stretches(lines, window, min_chars, long_chars)
    joined = materialise(join_hot(windows, materialise(fingerprints(windows), "fingerprints"), "fp", "places").drop("fp", "places", "at"), "joined")
    place = F.struct("doc_id", "th", "x")
    first = joined.groupBy("wh").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("rows")).where("first <> last").select("wh", "first", "rows")
    later = join_hot(joined, materialise(first, "first"), "wh", "rows").where(place != F.col("first"))
    later = later.select("doc_id", "th", "x", (F.col("x") + F.col("n")).alias("y"), F.col("first.doc_id").alias("of_doc"), F.col("first.th").alias("of_th"), (F.col("x") - F.col("first.x")).alias("far"))
    pair = Window.partitionBy("doc_id", "th", "of_doc", "of_th", "far").orderBy("x", "y")
    apart = F.col("x") > F.coalesce(F.max("y").over(pair.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    run = later.withColumn("run", F.sum(apart.cast("int")).over(pair))
    runs = run.groupBy("doc_id", "th", "of_doc", "of_th", "far", "run").agg(F.min("x").alias("start"), F.max("y").alias("y"))
    return runs.select("doc_id", "th", "start", (F.col("y") - F.col("start")).alias("lines"), "of_doc", (F.col("start") - F.col("far")).alias("of_start"))


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, min_chars: int = MIN_CHARS, long_chars: int = LONG_CHARS) -> DataFrame:
    """All rows with the repeated lines deleted from ``text``; adds ``n_lines, n_gone``.

    A line goes if it is part of a later repeated run (repeated_runs()); the first place of a run stays, lines without content stay.
    Null stays null and counts no lines; an empty text is one line that stays. Rows repeated with key and text are one
    document and all get the same result; a null key is a key of its own. Columns of the new names are replaced, others stay. Texts of any
    length are read whole; an empty table stays empty.
    """
    docs = docs.drop("n_lines", "n_gone")
    k, th, lost, h = (free_name(docs, c) for c in ("_k", "_th", "_gone", "_h"))
    runs = repeated_runs(docs, text, key, window, min_chars, long_chars)
    gone = runs.groupBy(F.col("doc_id").alias(k), F.col("th").alias(th)).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("start", F.col("start") + F.col("lines") - 1))))).alias(lost))
    rows = docs.withColumn(h, F.xxhash64(F.coalesce(text, F.lit(""))))
    out = rows.join(gone, rows[key].eqNullSafe(gone[k]) & (rows[h] == gone[th]), "left")
    parts = F.split(F.col(text), "\n", -1)
    number = F.transform(_content(F.col(text)), lambda x: x["i"])
    gone_at = _marked(number, F.col(lost))
    left = F.filter(F.zip_with(parts, _mask(gone_at, F.size(parts)), lambda x, m: F.struct(x.alias("x"), m.alias("m"))), lambda y: ~y["m"])
    new = F.when(F.col(lost).isNull(), F.col(text)).otherwise(F.array_join(F.transform(left, lambda y: y["x"]), "\n"))
    out = out.withColumns({"n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size(parts)).cast("long"), "n_gone": F.coalesce(F.size(lost), F.lit(0)).cast("long"), text: new})
    return out.drop(k, th, lost, h)


def _mask(at: Column, n: Column) -> Column:
    """n booleans, true at the ascending places ``at``: built from the gaps between them, in steps as many as the places."""
    before = F.concat(F.array(F.lit(-1)), F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0))))
    pieces = F.zip_with(at, F.slice(before, F.lit(1), F.size(at)), lambda x, p: F.concat(F.array_repeat(F.lit(False), x - p - 1), F.array(F.lit(True))))
    last = F.coalesce(F.try_element_at(at, F.lit(-1)), F.lit(-1))
    return F.concat(F.flatten(pieces), F.array_repeat(F.lit(False), n - last - 1))


def _marked(values: Column, at: Column) -> Column:
    """The values at ascending places."""
    both = F.zip_with(values, _mask(at, F.size(values)), lambda x, m: F.struct(x.alias("x"), m.alias("m")))
    return F.transform(F.filter(both, lambda y: y["m"]), lambda y: y["x"])
