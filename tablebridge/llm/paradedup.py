"""Substring dedup: MinHash banding of paragraphs, exact Jaccard, removal by components."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, components, gram_hashes, hash_words, join_hot, materialise, mix64, text_slices
from .ngramjoin import verified

GRAM = 5
LEAST = 0.8
BANDS = 5
ROWS = 2
PARA_WORDS = 8
RUN_WORDS = 25
LONG_WORDS = 28
REACH = 6
STOPS = frozenset(".!?…。！？")
SENTENCE = re.compile(r"[^\n.!?…。！？]*[.!?…。！？]+|[^\n.!?…。！？]+|\n")


def recall(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Chance that a pair of this similarity collides: 0.994 at the threshold for 5 bands of 2 rows."""
    return 1 - (1 - similarity**rows) ** bands


def _low_words(s: str) -> list[str]:
    """Lower-cased words; where lower case is longer, each by itself, so that words stay one."""
    low = s.lower()
    return WORD.findall(low) if len(low) == len(s) else [w.lower() for w in WORD.findall(s)]


def _sentences(text: str | None, para_words: int = PARA_WORDS) -> list[tuple[int, int, list[str]]]:
    """Rows of sentences (start, end, words) up to one of ``para_words`` words or a line's end."""
    out, held, start, end = [], [], -1, 0
    for m in SENTENCE.finditer(text or ""):
        s = m.group()
        if s != "\n":
            words = _low_words(s)
            if words:
                if start < 0:
                    start = m.end() - len(s.lstrip())
                end = m.end()
                held += words
                if len(words) < para_words or s[-1] not in STOPS:
                    continue
            else:
                continue
        if len(held) >= para_words:
            out.append((start, end, held))
        held, start = [], -1
    if len(held) >= para_words:
        out.append((start, end, held))
    return out


def _least_near(h: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Which values are the least within ``reach`` places on both sides."""
    width = 2 * reach + 1
    low = np.pad(h, reach, constant_values=np.uint64(2**64 - 1))
    step = 1
    while 2 * step <= width:
        low, step = np.minimum(low[:-step], low[step:]), 2 * step
    if step < width:
        low = np.minimum(low[: -(width - step)], low[width - step :])
    return low == h


def _order(h: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Order of places by the word's hash and, for equal words, by that of the GRAM words from there, if the sentence has so many."""
    low = np.full(len(h), 2**32 - 1, np.uint64)
    grams = gram_hashes(h, GRAM)
    low[: len(grams)] = grams >> np.uint64(32)
    ends = np.cumsum(sizes)
    for k in range(1, GRAM):
        low[ends - k] = 2**32 - 1
    return (h >> np.uint64(32) << np.uint64(32)) | low


def _apart(places: np.ndarray, least: int = PARA_WORDS) -> list[int]:
    """Anchors at least this far apart: of a row of closer ones the last stays, then the next far enough before it."""
    if len(places) < 2 or np.diff(places).min() >= least:
        return places.tolist()
    out = [int(places[-1])]
    for p in places[-2::-1].tolist():
        if out[-1] - p >= least:
            out.append(p)
    return out[::-1]


def paragraphs(texts: list[str | None], para_words: int = PARA_WORDS) -> tuple[list[list[tuple[int, int, int]]], np.ndarray]:
    """Paragraphs (start, end, words) of some texts, and the hashes of all their words in a row.

    A line is one, and a line of several sentences is cut after each sentence of ``para_words`` words or more; one of more than
    LONG_WORDS words is cut before words whose hash is the least within REACH words around (of equal words that with the least
    hash of GRAM words from there). Of anchors closer than PARA_WORDS the later stays, so that every word is in a piece. But for
    rows of such anchors, neither rule depends on what stands further off, so a passage copied into the middle of other text has the same
    cuts inside. Shorter sentences belong to the next. Paragraphs under ``para_words`` words are left out; with 1 there is none, and
    every line or sentence with a word is one.
    """
    found = [_sentences(t, para_words) for t in texts]
    h = hash_words([w for ps in found for p in ps for w in p[2]])
    anchor = _least_near(_order(h, [len(p[2]) for ps in found for p in ps])) if len(h) else np.empty(0, bool)
    out, at = [], 0
    for text, ps in zip(texts, found, strict=True):
        mine = []
        for start, end, words in ps:
            n = len(words)
            if n <= LONG_WORDS:
                mine.append((start, end, n))
            else:
                places = np.flatnonzero(anchor[at + PARA_WORDS : at + n - PARA_WORDS + 1]) + PARA_WORDS
                cut = [0, *_apart(places), n]
                spans = [m.span() for m in WORD.finditer(text, start, end)]
                for x, y in zip(cut[:-1], cut[1:], strict=True):
                    mine.append((spans[x][0], end if y == n else spans[y - 1][1], y - x))
            at += n
        out.append(mine)
    return out, h


def _seeds() -> np.ndarray:
    return mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _row_key(key: str, text: str):
    """With the key itself it names a row: eight bytes, since it stands in every paragraph."""
    return F.xxhash64(F.col(key).cast("string"), F.col(text))


def shingled(texts: list[str | None], para_words: int = PARA_WORDS) -> tuple[list[list[tuple[int, int, int]]], np.ndarray, np.ndarray]:
    """Paragraphs of some texts, all their shingle hashes in a row, and where each paragraph's begin (and the end).

    A paragraph of fewer than GRAM words is one shingle.
    """
    found, h = paragraphs(texts, para_words)
    sizes = np.array([p[2] for ps in found for p in ps], np.int64)
    first = np.concatenate([[0], np.cumsum(np.maximum(sizes - GRAM + 1, 1))]) if len(sizes) else np.zeros(1, np.int64)
    if not len(sizes):
        return found, h, first
    last = np.cumsum(sizes)
    grams = np.zeros(len(h), np.uint64)
    grams[: max(0, len(h) - GRAM + 1)] = gram_hashes(h, GRAM)[: max(0, len(h) - GRAM + 1)]
    inside = np.ones(len(h), bool)  # the last GRAM - 1 words of a paragraph start no shingle
    for k in range(1, GRAM):
        inside[(last - k)[sizes > k]] = False
    for i in np.flatnonzero(sizes < GRAM):
        grams[last[i] - sizes[i]] = gram_hashes(h[last[i] - sizes[i] : last[i]], GRAM)[0]
    return found, grams[inside], first


def units(docs: DataFrame, text: str = "text", key: str = "doc_id", para_words: int = PARA_WORDS) -> DataFrame:
    """A row for each paragraph: ``doc_id, rk, u, start, end, words, sid, bands``.

    sid is a hash of its shingles (as often as they occur); bands, a function of the shingles, stands at the first paragraph of
    a sid in a slice of texts only.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), _row_key(key, text).alias("rk"), F.col(text).alias("t"))
    names = ["doc_id", "rk", "u", "start", "end", "words", "sid", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _seeds()
        for whole in batches:
            for b in text_slices(whole, "t"):
                found, grams, first = shingled(b.column("t").to_pylist(), para_words)
                if len(first) == 1:
                    continue
                flat = np.array([p for ps in found for p in ps], np.int32)
                counts = [len(ps) for ps in found]
                sid = mix64(np.add.reduceat(mix64(grams ^ seeds[0]), first[:-1]))
                least = [np.minimum.reduceat(mix64(grams * s), first[:-1]) for s in seeds]
                bands = np.stack([mix64(sum((least[ROWS * j + k] * np.uint64(2 * k + 3) for k in range(1, ROWS)), least[ROWS * j] + np.uint64(j))) for j in range(BANDS)], 1)
                again = np.ones(len(sid), bool)
                again[np.unique(sid, return_index=True)[1]] = False
                place = pa.array(np.repeat(np.arange(len(found)), counts))
                u = np.concatenate([np.arange(n, dtype=np.int32) for n in counts])
                ends = pa.array(np.arange(0, BANDS * len(sid) + 1, BANDS, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(place), b.column("rk").take(place), pa.array(u), *[pa.array(flat[:, k]) for k in range(3)], pa.array(sid.view(np.int64)),
                     pa.ListArray.from_arrays(ends, pa.array(bands.view(np.int64).ravel()), mask=pa.array(again))],
                    names=names,
                )

    return rows.mapInArrow(run, "doc_id long, rk long, u int, start int, end int, words int, sid long, bands array<long>")


def colliding(u: DataFrame) -> DataFrame:
    """``band, sid`` of the paragraphs that share a band with other shingles."""
    each = Window.partitionBy("band")
    rows = u.where("bands is not null").select(F.explode("bands").alias("band"), "sid")
    return rows.withColumns({"lo": F.min("sid").over(each), "hi": F.max("sid").over(each)}).where("lo <> hi").select("band", "sid").distinct()


def repeated(docs: DataFrame, text: str = "text", key: str = "doc_id", run_words: int = RUN_WORDS, para_words: int = PARA_WORDS) -> DataFrame:
    """Repeated stretches of texts: ``doc_id, start, end, words, removed, clusters``.

    Paragraphs with equal shingles are one entry; entries that collide in a band are joined, the Jaccard similarity of all pairs
    under a band is computed exactly, and links of 0.8 or more make clusters by connected components. A stretch is a row of repeated
    paragraphs of at least ``run_words`` words together (with 0, and ``para_words`` 1, every repeated line or sentence is one, however short); its parts are removed but for each cluster's
    first place by key, row and place. start and end count code points. Null, empty and short texts have no paragraphs; equal rows are one
    document and show the same stretches; a null key comes first; other columns, whatever their names, play no part; a text of any
    length is cut whole; an empty table gives an empty result.
    """
    place = F.struct("doc_id", "rk", "u")
    u = materialise(units(docs, text, key, para_words), "paragraphs")
    meeting = materialise(colliding(u), "meeting")
    met = meeting.groupBy("sid").agg(F.count("*").alias("met"))
    entries = u.groupBy("sid").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "rk", "u", "start", "end")).alias("first"))
    entries = materialise(entries.join(met, "sid", "left").where("copies > 1 or met is not null"), "entries")
    wanted = entries.where("met is not null").groupBy(F.col("first.doc_id").alias("_d"), F.col("first.rk").alias("_k")).agg(F.collect_list(F.struct(F.col("first.start").alias("start"), F.col("first.end").alias("end"), "sid")).alias("want"))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), _row_key(key, text).alias("rk"), F.col(text).alias("t"))
    same = (F.col("rk") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    texts = wanted.join(rows, same).dropDuplicates(["doc_id", "rk"]).select("t", "want")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_slices(whole, "t"):
                rows = []
                for t, want in zip(b.column("t").to_pylist(), b.column("want").to_pylist(), strict=True):
                    for w in want:
                        s = np.unique(gram_hashes(hash_words(_low_words(t[w["start"] : w["end"]])), GRAM))
                        rows.append((w["sid"], len(s), s.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["sid", "n", "s"])

    sets = texts.mapInArrow(shingle, "sid long, n int, s binary")
    groups = materialise(meeting.join(sets, "sid").select(F.col("band").alias("comp"), "sid", "n", F.lit(1).cast("long").alias("copies"), "s"), "shingles")
    links = verified(groups, LEAST).where("other is not null").select(F.col("sid").alias("src"), F.col("other").alias("dst"))
    classes = components(links).select(F.col("node").alias("sid"), F.col("component").alias("cluster"))
    named = materialise(entries.select("sid", "copies", F.struct("first.doc_id", "first.rk", "first.u").alias("first")).join(classes, "sid", "left").withColumn("cluster", F.coalesce("cluster", "sid")), "named")
    kept = materialise(named.groupBy("cluster").agg(F.sum("copies").alias("all"), F.count("*").alias("sets"), F.min("first").alias("kept")).where("all > 1"), "kept")
    flags = materialise(join_hot(named, kept, "cluster", "sets").select("sid", "copies", "cluster", "kept"), "flags")
    marked = join_hot(u.select("doc_id", "rk", "u", "start", "end", "words", "sid"), flags, "sid", "copies")
    per = marked.groupBy("doc_id", "rk").agg(F.collect_set(F.struct("u", "start", "end", "words", (place != F.col("kept")).alias("removed"), "cluster")).alias("p"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "end", "words", "removed", "clusters"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int64())]
        for b in batches:
            out = []
            for doc, ps in zip(b.column("doc_id").to_pylist(), b.column("p").to_pylist(), strict=True):
                ps = sorted({p["u"]: p for p in ps}.values(), key=lambda p: p["u"])
                run: list[dict] = []
                for p in [*ps, None]:
                    if run and (p is None or p["u"] != run[-1]["u"] + 1):
                        if sum(x["words"] for x in run) >= run_words:
                            part: list[dict] = []
                            for x in [*run, None]:
                                if part and (x is None or x["removed"] != part[-1]["removed"]):
                                    out.append((doc, part[0]["start"], part[-1]["end"], sum(y["words"] for y in part), part[0]["removed"], [y["cluster"] for y in part]))
                                    part = []
                                if x is not None:
                                    part.append(x)
                        run = []
                    if p is not None:
                        run.append(p)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return per.select("doc_id", "p").mapInArrow(runs, "doc_id long, start int, end int, words int, removed boolean, clusters array<long>")
