"""Corpus preparation: five stages, each written as Parquet and read again.

``run`` keeps what a stage wrote in the shared checkpoint folder, so a lost
executor costs a task of one stage and nothing before it; a stage's folder is
removed once the next one is written.  This module needs the subpackage
``tessera.llm`` and can't be imported without it.

Defined results for odd tables, of every stage: an empty table gives an empty
one; columns beyond those of documents are kept by all stages, whatever their
names (``token_ids`` and ``token_offsets`` are replaced by the last).  Null,
empty and letterless texts have no language and go in the first stage; the
others keep them: they have no words to repeat, no window, no personal data and
no tokens.  Repeated rows: the first, third, fourth and fifth stage treat row by
row, the second keeps one of them.  Rows with a null id stay in all stages and
are not compared by the second.  Ties: of equal language shares the name that
sorts first counts, of near duplicates the smallest id stays.  Texts of any
length are processed whole.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, langid, ngram_join, pii
from tessera.runtime import ensure_checkpoint_dir

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is undetermined or a mixture without a majority."""
    return langid.keep_identified(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return ngram_join.drop_near_duplicates(docs)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold any window of a benchmark item."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows the text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token ids and their byte offsets."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language_id", keep_known_language),
    ("ngram_jaccard_join", keep_one_of_each),
    ("decontamination", drop_benchmark_text),
    ("pii", redact_personal_data),
    ("bpe", encode_tokens),
]

#: SQL can't express the mixture model, banding and tokeniser; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            _remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
