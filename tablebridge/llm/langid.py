"""Language ID by rank-order profiles of character n-grams (out-of-place distance)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import crc_fold, text_slices

UND = "und"
PROFILE = 400
DOC_TOP = 300
MAX_N = 3
SHARE = 50_000  # an n-gram of a smaller share than 1 / SHARE of its language can't enter a profile


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def char_grams(text: str | None, max_n: int = MAX_N) -> np.ndarray:
    """Codes (21 bits a character) of all n-grams, n = 1 to max_n <= 3, of the lower-cased words of a text.

    Runs of other characters than letters count as one blank; no n-gram has a blank inside or is one.
    """
    if not text:
        return np.empty(0, np.int64)
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    cp = np.where(_letters()[cp], cp, 32).astype(np.int64)
    cp = np.concatenate(([32], cp, [32]))
    blank = cp == 32
    keep = ~(blank[1:] & blank[:-1])
    cp = cp[np.concatenate(([True], keep))]
    blank = cp == 32
    out = [cp[~blank]]
    if len(out[0]) == 0:
        return out[0]
    if max_n >= 2:
        out.append(cp[:-1] | cp[1:] << 21)
    if max_n >= 3:
        out.append((cp[:-2] | cp[1:-1] << 21 | cp[2:] << 42)[~blank[1:-1]])
    return np.concatenate(out)


def _top(codes: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent codes, ties to the smaller code; codes are in ascending order."""
    return codes[np.argsort(-counts, kind="stable")[:k]]


class Profiles:
    """Rank tables of all languages; ``place`` is the rank of a gram in a language or the penalty."""

    def __init__(self, ranked: dict[str, list[int]], size: int = PROFILE) -> None:
        self.langs = sorted(ranked)
        self.size = size
        self.codes = np.unique(np.array([g for v in ranked.values() for g in v], np.int64))
        self.place = np.full((len(self.codes) + 1, len(self.langs)), size, np.int32)
        for j, lang in enumerate(self.langs):
            self.place[np.searchsorted(self.codes, np.array(ranked[lang], np.int64)), j] = np.arange(len(ranked[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Nearest language (ties to the first by name) and 1 - its distance over the largest possible distance."""
        codes = char_grams(text)
        if len(codes) == 0 or not self.langs:
            return UND, 0.0
        top = _top(*np.unique(codes, return_counts=True), DOC_TOP)
        at = np.searchsorted(self.codes, top)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != top)] = len(self.codes)
        place = self.place[at]
        far = np.where(place == self.size, self.size, np.abs(place - np.arange(len(top))[:, None])).sum(0)
        j = int(np.argmin(far))
        return self.langs[j], float(min(1.0, max(0.0, 1.0 - far[j] / (self.size * len(top)))))


def learn_profiles(docs: DataFrame, per_lang: int = 3000, max_langs: int = 1000, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Profiles:
    """Count n-grams of about ``per_lang`` whole labelled texts of each language and rank them.

    The sample is a hash threshold on the key, at most ``per_lang`` texts of a language in expectation. Only grams
    of a share over 1 / SHARE in their language come to the driver: at most SHARE for each language by arithmetic.
    Rows with null text, null language or null key teach nothing; no labelled rows give no profiles. Of a column with more than
    ``max_langs`` different labels the most frequent ones are learned (ties by name), which bounds the model.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(key).isNotNull()).select(
        F.col(text).alias("t"), F.col(lang).cast("string").alias("l"), F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)).alias("h")
    )
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(max_langs).collect()}
    if not sizes:
        return Profiles({})
    limit = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(int((1 << 30) * min(1.0, per_lang / n))))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for k, v in held.items():
                codes, n = np.unique(np.concatenate(v), return_counts=True)
                yield pa.RecordBatch.from_pydict({"l": pa.array([k] * len(codes), pa.string()), "g": codes, "n": n.astype(np.int64)})
            held.clear()

        size = 0
        for b in batches:
            for t, k in zip(b.column("t").to_pylist(), b.column("l").to_pylist(), strict=True):
                held.setdefault(k, []).append(c := char_grams(t))
                size += len(c)
                if size > 2_000_000:
                    yield from flush()
                    size = 0
        yield from flush()

    counts = rows.where(F.col("h") < F.coalesce(limit[F.col("l")], F.lit(0))).select("t", "l").mapInArrow(count, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    totals = {r["l"]: r["n"] for r in counts.groupBy("l").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return Profiles({})
    least = F.create_map(*[x for k, n in totals.items() for x in (F.lit(k), F.lit(n // SHARE))])
    by: dict[str, list[tuple[int, int]]] = {}
    for r in counts.where(F.col("n") > least[F.col("l")]).collect():
        by.setdefault(r["l"], []).append((-r["n"], r["g"]))
    return Profiles({k: [g for _, g in sorted(v)[:PROFILE]] for k, v in by.items()})


def predict(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """Append ``lang_pred, score`` to every row from its whole text: a map, without shuffle.

    Null texts, empty texts and texts without a letter are ``und`` with score 0; so is every text if nothing was learned. Of languages
    equally near the first by name is taken. Columns of the two names are replaced, others pass unchanged; repeated rows stay repeated and
    get equal results; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    docs = docs.drop("lang_pred", "score")
    schema = StructType(docs.schema.fields[:]).add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for whole in batches:
            for b in text_slices(whole, text):
                found = [p.predict(t) for t in b.column(text).to_pylist()]
                yield b.append_column("lang_pred", pa.array([x for x, _ in found], pa.string())).append_column("score", pa.array([y for _, y in found], pa.float64()))

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, folds: int = 5, **kw: int) -> DataFrame:
    """Learn from rows outside the held-out fold and predict every row: adds ``held_out, lang_pred, score``.

    held_out: crc32 of the key as text is divisible by ``folds``; false where the key is null. Columns of the three names are replaced, others
    pass unchanged; nulls, repeated rows, long texts and empty tables as in predict().
    """
    held = F.coalesce(crc_fold(F.col("doc_id"), folds) == 0, F.lit(False))
    profiles = learn_profiles(docs.where(~held), **kw)
    return predict(docs.withColumn("held_out", held), profiles)
