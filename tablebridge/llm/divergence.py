"""Divergence audit of sources: how differently the sources of a language use its vocabulary.

The vocabulary (terms in at least ``MIN_DOCS`` documents of a language) is a minimal acyclic transducer: built from the sorted terms, one state
for all equal rests of words, and each arc says how many terms come before those behind it, so that walking a term adds up its place in the
order of all terms (its ordinal). Texts stream through it to be counted again: what a task holds are counts by (language, source, ordinal).
Ordinals stand for the terms from there on and decide ties; words return by a join at the end.

Sorted terms are cut into shards of at most about ``SHARD`` terms, each a transducer of its own. Shards are broadcast up to ``PASS_BYTES`` at a time; a
vocabulary above that takes another pass over the texts for each further part, so that no task holds more than the bound, whatever its size.

Rows: null text, lang and source are ''. A text without a term counts as a document of its group, so the group is in the results. Repeated rows are
documents of their own. Empty tables give no rows. Extra columns are left out. Texts of any length are read in slices; the distinct terms of one
document are held for its document count.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablebridge.operators.scan import running

from .common import join_hot, materialise, text_slices

#: Terms are runs of ASCII letters and of what is beyond ASCII, in UTF-8: bytes between them become blanks, A to Z lower case.
PLAIN = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
BREAK = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
MIN_DOCS = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP = 50
#: Terms of one transducer, bytes of the transducers that are broadcast at a time, entries that a task counts before it passes them on.
SHARD = 200_000
PASS_BYTES = 64_000_000
HELD = 2_000_000
#: Bytes of text whose terms are handled together.
SLICE = 8_000_000
#: Sources on each side of one comparison, and counts that one task compares at a time.
TILE = 64
CELLS = 400_000


def _keep(df: DataFrame) -> DataFrame:
    return materialise(df, "audit")


def cuts(text: bytes, piece: int | None = None) -> Iterator[bytes]:
    """A text in pieces that end between terms (a term longer than a piece stays whole)."""
    at, piece = 0, piece or SLICE
    while at < len(text):
        cut = BREAK.search(text, at + piece)
        end = cut.start() if cut else len(text)
        yield text[at:end] if at or cut else text
        at = end


def terms(text: bytes, piece: int | None = None) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece."""
    return (part.translate(PLAIN).split() for part in cuts(text, piece))


def grouped(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _slices(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple[list[list], list[bytes]]]:
    """A batch in slices of about SLICE bytes of text: the columns' values, and the texts' UTF-8."""
    for some in text_slices(batch, "text", SLICE):
        yield [some.column(c).to_pylist() for c in columns], some.column("text").cast(pa.binary()).to_pylist()


def encoded(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms of some texts, and for each term of them in order its place among these and the number of its text.

    Letters without the blanks between them are the data of one binary array, whose offsets are where terms begin.
    """
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    flat = np.frombuffer(b"".join(texts).translate(PLAIN), np.uint8)
    letter = flat != 32
    begin = letter.copy()
    begin[1:] &= ~letter[:-1]
    first = ends[:-1][ends[:-1] < len(flat)]
    begin[first] = letter[first]
    starts = np.flatnonzero(begin)
    data = flat[letter]
    offsets = np.append(np.cumsum(letter, dtype=np.int32)[starts] - 1, len(data)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(), np.searchsorted(ends, starts, side="right")


def _numbered(values: Iterable) -> tuple[list, np.ndarray]:
    """Distinct values, and the number of each value among them."""
    known: dict = {}
    return known, np.fromiter((known.setdefault(v, len(known)) for v in values), np.int64)  # type: ignore[return-value]


def _doc_counts(batches):
    schema = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("n", pa.int64())])

    def rows(langs: list, of: np.ndarray, words: pa.Array, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(of)), words.take(pa.array(at)).cast(pa.binary()), pa.array(n)], schema=schema)

    for b in batches:
        for (langs,), texts in _slices(b, "lang"):
            for lang, text in zip(langs, texts, strict=True):
                if len(text) > SLICE:  # distinct terms of a long text, piece by piece
                    seen = list({t for part in terms(text) for t in part})
                    yield rows([lang], np.zeros(len(seen), np.int64), pa.array(seen, pa.binary()), np.arange(len(seen)), np.ones(len(seen), np.int64))
            words, code, doc = encoded([t if len(t) <= SLICE else b"" for t in texts])
            if len(code):
                names, of = _numbered(langs)
                pair = np.unique(doc * len(words) + code)  # a term once a text
                key, n = np.unique(of[pair // len(words)] * len(words) + pair % len(words), return_counts=True)
                yield rows(list(names), key // len(words), words, key % len(words), n)


def vocabulary(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, term`` (UTF-8 bytes) of the terms that at least so many documents of the language have."""
    partial = docs.select("lang", "text").mapInArrow(_doc_counts, "lang string, term binary, n long")
    return partial.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("lang", "term")


class Transducer:
    """Minimal acyclic automaton of sorted byte strings; an arc carries the number of terms that come before those behind it.

    Arcs are one sorted array of state * 256 + byte, with the arrays of their targets and of what they add.
    """

    def __init__(self, arcs: np.ndarray, target: np.ndarray, adds: np.ndarray, final: np.ndarray, root: int) -> None:
        self.arcs, self.target, self.adds, self.final, self.root = arcs, target, adds, final, root

    @classmethod
    def build(cls, ordered: Iterable[bytes]) -> Transducer:
        """From distinct strings in ascending order: what the next string no longer shares is finished and, if an equal state exists, is that one."""
        known: dict[tuple, int] = {}
        path: list[list] = [[False, []]]  # of the last string: is it an end, and its finished arcs (byte, state)
        last = b""

        def finish(down_to: int) -> None:
            while len(path) > down_to + 1:
                end, arcs = path.pop()
                state = known.setdefault((end, tuple(arcs)), len(known))
                path[-1][1].append((last[len(path) - 1], state))

        for term in ordered:
            common = next((i for i, (x, y) in enumerate(zip(last, term, strict=False)) if x != y), min(len(last), len(term)))
            finish(common)
            path.extend([False, []] for _ in range(common, len(term)))
            path[-1][0] = True
            last = term
        finish(0)
        root = known.setdefault((path[0][0], tuple(path[0][1])), len(known))
        below = np.zeros(len(known), np.int64)
        arcs, target, adds = [], [], []
        for (end, out), state in known.items():  # a state's targets are finished, and so listed, before it
            before = int(end)
            for byte, to in out:
                arcs.append(state * 256 + byte)
                target.append(to)
                adds.append(before)
                before += below[to]
            below[state] = before
        order = np.argsort(arcs) if arcs else np.empty(0, np.int64)
        pick = lambda x: np.array(x, np.int64)[order] if arcs else np.empty(0, np.int64)
        return cls(pick(arcs), pick(target), pick(adds), np.array([end for end, _ in known], bool), root)

    def ordinals(self, words: list[bytes] | pa.Array) -> np.ndarray:
        """The place of each word among the terms, -1 if it is none; all words go one byte further in each step."""
        words = pa.array(words, pa.binary())
        edges = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
        flat = np.frombuffer(words.buffers()[2] or b"", np.uint8) if len(words) else np.empty(0, np.uint8)
        start, size = edges[:-1].astype(np.int64), np.diff(edges)
        state, place = np.full(len(words), self.root), np.zeros(len(words), np.int64)
        live, step = np.flatnonzero(size > 0), 0
        while len(live) and len(self.arcs):
            want = state[live] * 256 + flat[start[live] + step]
            at = np.minimum(np.searchsorted(self.arcs, want), len(self.arcs) - 1)
            there = self.arcs[at] == want
            place[live[~there]] = -1
            live, at = live[there], at[there]
            state[live], place[live] = self.target[at], place[live] + self.adds[at]
            step += 1
            live = live[size[live] > step]
        if not len(self.arcs):
            place[size > 0] = -1
        place[~self.final[state] & (place >= 0)] = -1
        return place

    def terms(self) -> Iterator[bytes]:
        """All terms in order."""
        begin, end = (np.searchsorted(self.arcs, np.arange(len(self.final)) * 256 + x).tolist() for x in (0, 256))
        byte, target = (self.arcs % 256).tolist(), self.target.tolist()
        if self.final[self.root]:
            yield b""
        todo, word = [iter(range(begin[self.root], end[self.root]))], bytearray()
        while todo:
            arc = next(todo[-1], None)
            if arc is None:
                todo.pop()
                del word[-1:]
                continue
            word.append(byte[arc])
            if self.final[target[arc]]:
                yield bytes(word)
            todo.append(iter(range(begin[target[arc]], end[target[arc]])))

    def dump(self) -> bytes:
        head = np.array([len(self.arcs), len(self.final), self.root], np.int64)
        return b"".join(x.tobytes() for x in (head, self.arcs, self.target, self.adds, self.final))

    @classmethod
    def load(cls, data: bytes) -> Transducer:
        n, states, root = np.frombuffer(data, np.int64, 3).tolist()
        arcs, target, adds = (np.frombuffer(data, np.int64, n, 24 + 8 * n * k) for k in range(3))
        return cls(arcs, target, adds, np.frombuffer(data, bool, states, 24 + 24 * n), root)


def _build(batches):
    """Transducers of one range of sorted terms: first term, number of terms, bytes."""
    schema = pa.schema([("first", pa.binary()), ("n", pa.int64()), ("data", pa.binary()), ("size", pa.int64())])
    held: list[bytes] = []

    def row():
        data = Transducer.build(held).dump()
        return pa.RecordBatch.from_pylist([{"first": held[0], "n": len(held), "data": data, "size": len(data)}], schema=schema)

    for b in batches:
        for t in b.column("term").to_pylist():
            if len(held) >= SHARD:
                yield row()
                held = []
            held.append(t)
    if held:
        yield row()


def shards(kept: DataFrame) -> DataFrame:
    """Transducers over all kept terms in order: ``first, n, data, size``."""
    parts = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = kept.select("term").distinct().repartitionByRange(parts, "term").sortWithinPartitions("term")
    return _keep(ordered.mapInArrow(_build, "first binary, n long, data binary, size long"))


def _recount(broadcast):
    """Counts by (lang, source, ordinal) of the terms in the broadcast shards, which are ``(first, base, data)`` in order."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("ord", pa.int64()), ("n", pa.int64())])

    def run(batches):
        parts = broadcast.value
        firsts = [p[0] for p in parts]
        machines = [Transducer.load(p[2]) for p in parts]
        def walk(words: pa.Array) -> np.ndarray:
            """Each word through the shard whose range it lies in."""
            if len(parts) == 1:
                return np.where((p := machines[0].ordinals(words)) >= 0, p + parts[0][1], -1)
            shard = np.array([bisect_right(firsts, w) - 1 for w in words.to_pylist()])
            out = np.full(len(words), -1)
            for k in np.unique(shard[shard >= 0]):
                mine = np.flatnonzero(shard == k)
                p = machines[k].ordinals(words.take(pa.array(mine)))
                out[mine] = np.where(p >= 0, p + parts[k][1], -1)
            return out

        known: dict[tuple, int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def rows():
            """Counts so far by group and ordinal; groups are numbered by the order in which they came."""
            if held:
                group, at, n = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.lexsort((at, group))
                group, at, n = group[order], at[order], n[order]
                new = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (at[1:] != at[:-1])))
                names = list(known)
                lang, source = (pa.array([x[i] for x in names], pa.string()).take(pa.array(group[new])) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([lang, source, pa.array(at[new]), pa.array(np.add.reduceat(n, new))], schema=schema)
            held.clear()
            known.clear()

        size = 0
        for b in batches:
            for (langs, sources), texts in _slices(b, "lang", "source"):
                of = np.fromiter((known.setdefault(g, len(known)) for g in zip(langs, sources, strict=True)), np.int64)
                pieces = [(of, texts)] if max(map(len, texts)) <= 2 * SLICE else [(of[i : i + 1], [cut]) for i, t in enumerate(texts) for cut in cuts(t)]
                for group, some in pieces:
                    words, code, doc = encoded(some)
                    if len(code):
                        place = walk(words)[code]
                        key, n = np.unique(group[doc[place >= 0]] << 40 | place[place >= 0], return_counts=True)
                        held.append((key >> 40, key & ((1 << 40) - 1), n))
                        size += len(key)
                if size >= HELD:
                    yield from rows()
                    size = 0
        yield from rows()

    return run


def recount(docs: DataFrame, machines: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``lang, source, ord, n``: texts stream through the shards, as many of them in one pass as ``pass_bytes`` allow.

    The list of shards without their data (a row for each SHARD terms or range of them) is the driver's.
    """
    spark = docs.sparkSession
    listed = sorted((bytes(r["first"]), r["n"], r["size"]) for r in machines.select("first", "n", "size").collect())
    base = np.cumsum([0, *(n for _, n, _ in listed)]).tolist()
    passes: list[list[int]] = []
    held = pass_bytes
    for k, (_, _, size) in enumerate(listed):
        if held + size > pass_bytes and held:
            passes.append([])
            held = 0
        passes[-1].append(k)
        held += size
    out = None
    for part in passes:
        low, high = listed[part[0]][0], listed[part[-1]][0]
        data = {bytes(r["first"]): bytes(r["data"]) for r in machines.where((F.col("first") >= F.lit(low)) & (F.col("first") <= F.lit(high))).select("first", "data").collect()}
        sent = spark.sparkContext.broadcast([(listed[k][0], base[k], data[listed[k][0]]) for k in part])
        counts = docs.mapInArrow(_recount(sent), "lang string, source string, ord long, n long").groupBy("lang", "source", "ord").agg(F.sum("n").alias("n"))
        counts = _keep(counts)
        out = counts if out is None else out.unionByName(counts)
    return out if out is not None else spark.createDataFrame([], "lang string, source string, ord long, n long")


def dictionary(machines: DataFrame) -> DataFrame:
    """``ord, term``: what each ordinal stands for, read off the shards' arcs in order."""
    listed = sorted((bytes(r["first"]), r["n"]) for r in machines.select("first", "n").collect())
    base = np.cumsum([0, *(n for _, n in listed)]).tolist()
    index = machines.sparkSession.createDataFrame([(bytearray(f), base[k]) for k, (f, _) in enumerate(listed)], "first binary, base long")
    schema = pa.schema([("ord", pa.int64()), ("term", pa.string())])

    def spelled(batches):
        for b in batches:
            for start, data in zip(b.column("base").to_pylist(), b.column("data").to_pylist(), strict=True):
                words = [w.decode() for w in Transducer.load(bytes(data)).terms()]
                yield pa.RecordBatch.from_arrays([pa.array(range(start, start + len(words)), pa.int64()), pa.array(words, pa.string())], schema=schema)

    return machines.join(F.broadcast(index), "first").select("base", "data").mapInArrow(spelled, "ord long, term string")


def smoothed(count: Column, total: Column, vocabulary: Column) -> Column:
    """p of a term: 1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * vocabulary)) in whole numbers; 0 where there is no vocabulary."""
    share = F.call_function("div", (count + SMOOTH).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), (total + vocabulary * SMOOTH).cast("decimal(20,0)"))
    return F.when(vocabulary > 0, share + 1).otherwise(F.lit(0).cast("long"))


def tile_sums(group: pa.Table, width: int) -> pa.Table:
    """Sums of abs(p - q) over the terms that any source here has, for each pair of sources of one comparison.

    Rows without ord are the sources, with the p of a term they lack; the others are their terms. Columns are handled in slices, so that the
    matrix is bounded.
    """
    ord_, nth, p = (group.column(c).combine_chunks() for c in ("ord", "nth", "p"))
    named = ord_.is_null().to_numpy(zero_copy_only=False)
    nth, p = nth.to_numpy(), p.to_numpy()
    sources = np.unique(nth[named])
    plain = np.zeros(len(sources), np.int64)
    plain[np.searchsorted(sources, nth[named])] = p[named]
    at, which = np.unique(ord_.filter(pa.array(~named)).to_numpy(), return_inverse=True)
    rows, values = np.searchsorted(sources, nth[~named]), p[~named]
    tile = (sources - 1) // width
    left, right = np.flatnonzero(tile == tile.min()), np.flatnonzero(tile == tile.max())
    total = np.zeros((len(left), len(right)), np.int64)
    order = np.argsort(which, kind="stable")
    which, rows, values = which[order], rows[order], values[order]
    for low in range(0, len(at), 8192):
        columns = min(8192, len(at) - low)
        matrix = np.repeat(plain[:, None], columns, axis=1)
        a, b = np.searchsorted(which, [low, low + columns])
        matrix[rows[a:b], which[a:b] - low] = values[a:b]
        for i, x in enumerate(left):
            total[i] += np.abs(matrix[right] - matrix[x]).sum(axis=1)
    i, j = np.nonzero(sources[left][:, None] < sources[right][None, :])
    lang = [group.column("lang")[0].as_py()] * len(i)
    return pa.table([pa.array(lang, pa.string()), pa.array(sources[left][i]), pa.array(sources[right][j]), pa.array(total[i, j]), pa.array(np.full(len(i), len(at)), pa.int64())], names=["lang", "a", "b", "f", "met"])


def pairs(counts: DataFrame, stats: DataFrame) -> DataFrame:
    """``lang, a, b, value``: the divergence of each two sources of a language, by number, a before b.

    Sources are compared in tiles of TILE by TILE, terms in blocks by ordinal, so that a comparison reads about CELLS counts; terms that neither
    tile has enter by their number alone.
    """
    per = stats.groupBy("lang").agg(F.max("nth").alias("n_sources"), F.sum("rows").alias("cells"))
    shape = per.select("lang", F.floor((F.col("n_sources") - 1) / TILE).cast("int").alias("last_tile"), F.greatest(F.lit(1), F.ceil(F.col("cells") / CELLS)).alias("blocks"))
    placed = stats.join(shape, "lang").withColumn("tile", F.floor((F.col("nth") - 1) / TILE).cast("int"))
    null = F.lit(None).cast("long")
    sources = placed.select("lang", "nth", "tile", "last_tile", null.alias("ord"), F.col("p0").alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    full = join_hot(counts, _keep(placed.select("lang", "source", "nth", "tile", "last_tile", "blocks", "rows")), ["lang", "source"], "rows")
    cells = full.select("lang", "nth", "tile", "last_tile", "ord", "p", F.pmod("ord", "blocks").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.col("last_tile"))).alias("other")
    both = sources.unionByName(cells).select("lang", "nth", "tile", "ord", "p", "block", other)
    tiles = both.select("lang", "nth", "ord", "p", "block", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
    width = TILE
    sums = tiles.groupBy("lang", "i", "j", "block").applyInArrow(lambda group: tile_sums(group, width), "lang string, a long, b long, f long, met long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("f").alias("f"), F.sum("met").alias("met"))
    side = stats.select("lang", "nth", "p0", "v")
    sums = sums.join(side.select("lang", F.col("nth").alias("a"), F.col("p0").alias("p0a"), "v"), ["lang", "a"]).join(side.select("lang", F.col("nth").alias("b"), F.col("p0").alias("p0b")), ["lang", "b"])
    return sums.select("lang", "a", "b", (F.col("f") + (F.col("v") - F.col("met")) * F.abs(F.col("p0a") - F.col("p0b"))).alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    Part pair: each other source of the language, by the sum of abs(p - q) over its vocabulary. Part term: the ``top`` terms that the source
    has more of than its language. Ranks go by value and then by item in UTF-8 order, which the ordinals are.
    """
    docs = grouped(docs)
    kept = _keep(vocabulary(docs, min_docs))
    machines = shards(kept)
    spelled = _keep(kept.select("lang", F.col("term").cast("string").alias("term")).join(dictionary(machines), "term"))
    seen = recount(docs, machines, pass_bytes)
    counts = _keep(seen.join(spelled.select("lang", "ord"), ["lang", "ord"], "left_semi"))

    zero = F.lit(0).cast("long")
    groups = docs.groupBy("lang", "source").agg(F.count("*").alias("n_docs"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    size = kept.groupBy("lang").agg(F.count("*").alias("v"))
    of_lang = counts.groupBy("lang").agg(F.sum("n").alias("lang_total"))
    stats = groups.join(sums, ["lang", "source"], "left").join(size, "lang", "left").join(of_lang, "lang", "left")
    stats = stats.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "rows", "v", "lang_total")])
    stats = running(_keep(stats.withColumn("p0", smoothed(zero, F.col("total"), F.col("v")))), ["lang"], ["source"], {"nth": ("sum", F.lit(1))}, _keep)
    stats = _keep(stats)

    each = join_hot(counts, _keep(stats.select("lang", "source", "total", "rows", "v", "lang_total")), ["lang", "source"], "rows")
    each = _keep(each.select("lang", "source", "ord", "n", "lang_total", "v", smoothed(F.col("n"), F.col("total"), F.col("v")).alias("p")))
    in_lang = counts.groupBy("lang", "ord").agg(F.sum("n").alias("lang_n"))
    more = each.join(in_lang, ["lang", "ord"]).withColumn("value", F.col("p") - smoothed(F.col("lang_n"), F.col("lang_total"), F.col("v"))).where((F.col("n") > 0) & (F.col("value") > 0))
    w = Window.partitionBy("lang", "source")
    best = more.select("lang", "source", "ord", "value").withColumn("rank", F.row_number().over(w.orderBy(F.desc("value"), F.asc("ord")))).where(F.col("rank") <= top)
    term = best.join(spelled, ["lang", "ord"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    two = _keep(pairs(each.select("lang", "source", "ord", "p"), stats))
    names = stats.select("lang", "nth", "source")
    both = two.unionByName(two.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    told = both.join(names.withColumnRenamed("nth", "a"), ["lang", "a"]).join(names.select("lang", F.col("nth").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    pair = told.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(w.orderBy(F.desc("value"), F.asc("item"))))
    return pair.unionByName(term)
