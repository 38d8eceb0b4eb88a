"""The pipeline against a plain version of its stages, and its contract."""

import hashlib

import numpy as np
import pytest

import corpus_pipeline as cp
from tablebridge.llm import common

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_rows(spark):
    docs = common.table(spark, SF, "documents")
    for name, stage in cp.STAGES[:-1]:
        out = common.materialise(stage(spark, docs, SF), "stage")
        assert out.columns == cp.COLUMNS, name
        assert out.count() <= docs.count()
        docs = out
    assert docs.count() > 150


def test_run_against_brute_force(spark):
    from brute_pipeline import brute

    got = {r.doc_id: r for r in cp.run(spark, SF).collect()}
    want = brute(spark, SF)
    assert set(got) == set(want)
    for k, text in want.items():
        ids, back = want_tokens(text)
        assert got[k].text == text and got[k].ids == ids
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def want_tokens(text):
    global _T
    if "_T" not in globals():
        public = pytest.importorskip("public_tokenizers")
        from tokenizers import Tokenizer

        _T = Tokenizer.from_file(public.path("word_bpe_49k.json"))
        _T.no_truncation()
    ids = _T.encode(text or "", add_special_tokens=False).ids
    return ids, _T.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "123", None, "s", 3), (None, "some words of text here", "en", "s", 1), (4, "some words of text here", "en", "s", 1)]])
def test_odd_tables(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    bench = common.table(spark, SF, "benchmark")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    bench.write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = cp.run(spark, f"file://{tmp_path}").collect()
    assert len(got) == (1 if rows else 0)


def test_clashing_columns_repeats_and_a_long_text(spark, tmp_path):
    rng = np.random.default_rng(4)
    long = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(60_000))
    rows = [(1, "some words of text here", "en"), (1, "some words of text here", "en"), (2, long, "en"), (3, long, None), (4, None, "en"), (None, "another text without any key", None), (5, "9 8 7", "en"), (6, "", None)]
    clash = "n_tokens string, ids string, score string, lang_pred string, n_gone string, rk string, class_id string, item_id string, _k string, text_2 string"
    docs = spark.createDataFrame([(k, t, c, "s", 1, *["x"] * 10) for k, t, c in rows], f"doc_id long, text string, lang string, source string, n_chars long, {clash}")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    common.table(spark, SF, "benchmark").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    out = cp.run(spark, f"file://{tmp_path}")
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == [*cp.COLUMNS, "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert set(got) == {1, 2, None} and got[2].text == long and got[2].ids == want_tokens(long)[0]


def test_scopes_keep_each_other_s_tables(spark):
    outer = common.materialise(spark.range(3), "kept")
    with common.scope(spark):
        mine = common.materialise(spark.range(4), "outer")
        with common.scope(spark):
            gone = common.materialise(spark.range(5), "inner")
        assert mine.count() == 4 and outer.count() == 3
        with pytest.raises(Exception):  # noqa: B017
            gone.count()
    assert outer.count() == 3


def test_language_stage_without_labels_keeps_texts_with_a_letter(spark):
    rows = [(1, "some words", None, "s", 10), (2, "日本語", None, "s", 3), (3, "123 !", None, "s", 5), (4, None, None, "s", None), (5, "", None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in cp.language(spark, docs, SF).collect()) == [1, 2]
