"""Work in proportion to one long text; keys far apart; a ledger that stays."""

import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablebridge.llm import decontam, linededup, paradedup, queries, secretscan, tokenstore
from tests.llm.test_corpus import SECRETS, brute_spans

DOCS = "doc_id long, text string"


def seconds(run, *sizes):
    """The lesser of two times for each size, after one run that warms up."""
    run(sizes[0])
    out = []
    for n in sizes:
        times = []
        for _ in range(2):
            began = time.perf_counter()
            run(n)
            times.append(time.perf_counter() - began)
        out.append(min(times))
    return out


def words(seed, n):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, 10**6, n)]


def test_line_dedup_of_one_long_text(spark):
    def run(n):
        lines = [f"line {i} of a long text with some more words" for i in range(n)]
        df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines[::-1] + lines))], DOCS)
        return linededup.dedup_lines(df).agg(F.sum("n_gone")).first()[0]

    assert run(300) == 300
    small, large = seconds(run, 5000, 20_000)
    assert large < 8 * small


def test_secrets_of_one_long_text(spark):
    text = lambda n: " ".join(f"password = secret{i:012d} é" for i in range(n))

    def run(n):
        df = spark.createDataFrame([(1, text(n))], DOCS)
        return secretscan.scan_unseen(df).agg(F.sum(F.size("spans"))).first()[0]

    assert run(500) >= 500
    small, large = seconds(run, 5000, 20_000)
    assert large < 8 * small
    df = spark.createDataFrame([(1, text(400))], DOCS)
    assert secretscan.report(df, secretscan.scan_unseen(df)).first().spans == brute_spans(text(400))


def test_decontamination_of_a_long_held_text(spark):
    def run(n):
        held = " ".join(words(1, n))
        docs = spark.createDataFrame([(1, f"some words before {held} and after"), (2, " ".join(words(2, n)))], DOCS)
        return [tuple(r) for r in decontam.overlaps(docs, spark.createDataFrame([(7, held)], "item_id long, text string")).collect()]

    assert run(100) == [(1, 7, 100, 100)]
    small, large = seconds(run, 2000, 8000)
    assert large < 8 * small


@pytest.mark.parametrize("keys", [[None, -(2**63), -5, 0, 2**63 - 1], [-(2**63), 2**63 - 1], [-(2**62), 2**62 - 1, 2**62], [None, None]])
def test_token_files_with_keys_far_apart(spark, keys):
    docs = spark.createDataFrame([(k, f"text {i}") for i, k in enumerate(keys)], DOCS)
    for parts in (1, 3):
        out = f"{tokenstore.fresh(spark, 'tokens')}"
        files = tokenstore.write_tokens(docs, queries.vocabulary(), out, partitions=parts)
        rows = tokenstore.read_tokens(files, out).orderBy("start").collect()
        assert [r.doc_id for r in rows] == sorted(keys, key=lambda k: (k is not None, k)) and rows[0].start == 0
        assert [r.start for r in rows[1:]] == np.cumsum([r.n_tokens for r in rows])[:-1].tolist()


def test_stretches_of_near_keys():
    far = tokenstore.FAR
    assert list(tokenstore.near_keys([None, 1, 2], None)) == [(0, 3, 1)]
    assert list(tokenstore.near_keys([5, far, far + 1, 2 * far], 1)) == [(0, 2, 1), (2, 3, far + 1), (3, 4, 2 * far)][:1] + [(2, 4, far + 1)]
    assert list(tokenstore.near_keys([], 3)) == [(0, 0, 3)]


def test_ledger_that_stays(spark, tmp_path):
    docs = spark.createDataFrame([(i, SECRETS[i % 7]) for i in range(20)] + [(50, None)], DOCS)
    path = f"file://{tmp_path}/ledger"
    first = secretscan.Ledger(spark, path)
    assert first.read() is None and first.scan(docs.where("doc_id < 3")) == 9 and first.scan(docs) == 15
    # Another run at the same path scans nothing, and says the same.
    again = secretscan.Ledger(spark, path)
    assert again.scan(docs) == 0 and again.scan(docs.union(spark.createDataFrame([(99, "new")], DOCS))) == 3
    want = Counter((r.doc_id, brute_spans(r.text)) for r in docs.collect())
    told = lambda: Counter((r.doc_id, r.spans) for r in secretscan.report(docs, again.read()).collect())
    assert told() == want and len(again._parts()) == 4
    # An increment whose writer died is no part of it.
    again.read().write.parquet(lost := again._next("part"))
    again.fs.delete(again._hadoop(f"{lost}/_SUCCESS"), False)
    assert again.read().count() == 27
    again.compact()
    assert len(again._parts()) == 1 and again.read().count() == 27 and told() == want and again.scan(docs) == 0


def test_short_paragraphs_with_a_parameter(spark):
    rows = [(1, "Hi.\none two three\nalone here"), (2, "hi\nelse\nOne, two three!"), (3, "one two three four\nHi. Hi."), (4, None)]
    got = {(r.doc_id, (rows[r.doc_id - 1][1] or "")[r.start : r.end], r.removed) for r in paradedup.repeated(spark.createDataFrame(rows, DOCS), run_words=0, para_words=1).collect()}
    assert got == {(1, "Hi.\none two three", False), (2, "hi", True), (2, "One, two three!", True), (3, "Hi. Hi.", True)}
