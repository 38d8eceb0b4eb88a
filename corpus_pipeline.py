"""Cleaning of ``documents`` for training, in stages that each take what the one before kept.

Language ID drops documents without a letter or unlike every learned language (without labelled rows only the former); line dedup deletes later repeated runs of
lines, and documents of which nothing is left; of each group of near-duplicates one document stays; documents that
hold a benchmark text go; the last stage encodes what is left to token ids, which decode() turns back. Its rows keep
all columns and add the ids, their number and the hashes of ids and decoded text.

In every stage: extra columns of any name are left out, also those that an operator adds itself; a null key is a key of its own; null
and empty texts and texts without a letter go in the first stage; repeated rows are one document from the near-duplicate stage on;
an empty table stays empty; a text of any length is read whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablebridge.llm import bpe, decontam, langid, linededup, ngramjoin
from tablebridge.llm.common import crc_fold, scope, shared_dir, table
from tablebridge.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least closeness to the nearest language; the closest distance that chance gives is far below, clean texts lie far above.
MIN_SCORE = 0.15


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learned from the labelled rows outside the held-out fold; labels play no part in what is kept."""
    profiles = langid.learn_profiles(docs.where(F.coalesce(crc_fold(F.col("doc_id"), 5) != 0, F.lit(False))))
    if not len(profiles.langs):  # nothing learned, so nothing is unlike it
        return docs.where(F.col("text").rlike(r"\p{L}")).select(COLUMNS)
    kept = langid.predict(docs.select(COLUMNS), profiles).where((F.col("lang_pred") != langid.UND) & (F.col("score") >= MIN_SCORE))
    return kept.select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, and documents that lose all their content; n_chars follows the text."""
    done = linededup.dedup_lines(docs.select(COLUMNS))
    left = (F.col("n_gone") == 0) | (F.trim(F.col("text")) != "")
    return done.where(left).withColumn("n_chars", F.when(F.col("n_gone") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least key of each class stays; texts without a shingle are classes of their own."""
    return ngramjoin.keep_first(docs.select(COLUMNS)).select(COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text go, whole; an empty benchmark takes none."""
    return decontam.remove(docs.select(COLUMNS), table(spark, sf_dir, "benchmark")).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents and ``n_tokens, ids_sha256, decoded_sha256, ids``."""
    return bpe.encode_decode(docs.select(COLUMNS), vocabulary(), ids=True)


STAGES = [("language ID", language), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark), ("BPE encoding and decoding", tokens)]
ORACLE_SQL = None  # language ID, MinHash and BPE are beyond SQL; tests hold run() against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet to the shared folder and read again."""
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with scope(spark):  # the stage's own tables go once its result is written
            stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
