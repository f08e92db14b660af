"""A training corpus from ``documents``: language ID, line dedup, near-duplicate removal, decontamination, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows the stage before it kept; it is written as Parquet in the
shared folder and read again. All but the last return the columns of ``documents``; the last gives the token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import bpe, decontaminate, langid, linededup, simhash
from pagemill.llm.shared import fold_of, saved


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on the labelled rows outside fold 0; documents whose language isn't told with a score of 0.5 go, those
    with a null, empty or letterless text among them. Rows without an id are not learnt from; repeated rows share their lot."""
    model = langid.fit(docs.where(F.coalesce(fold_of("doc_id") != 0, F.lit(False))))
    return langid.keep_identified(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line equals or nearly equals go from the texts; documents left without text go."""
    return _measured(linededup.without_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id; links are fingerprints of three-word shingles within
    three bits. Null and blank texts have fingerprint zero; of repeated rows one stays; rows without an id come last."""
    return simhash.one_of_each(docs, distance=3, shingle=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark go from the texts; documents left without a word go."""
    return _measured(decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding them. A null or empty text has none; repeated rows are encoded each."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN).drop("decoded")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("tokens", tokens)]

ORACLE_SQL = None  # SQL can't express the fingerprints, the classifier or the tokens; tests/llm holds the operators and near_duplicates against brute force, run() against its stages


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
