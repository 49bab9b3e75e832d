"""A corpus pipeline: language ID, near copies, secrets, source mixing, packing.

``STAGES`` lists (name, function); each takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes to
the shared folder as Parquet and reads back as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.common import free_names, keep_arrow_rows, materialize
from strandmill.llm.language import UNKNOWN, fit_profiles, identify
from strandmill.llm.mixing import mixed_copies
from strandmill.llm.ngram_join import drop_near_copies
from strandmill.llm.packing import pack
from strandmill.llm.secrets import redact

#: A text whose best cosine is below this is like no learned language: two and a half deviations of the cosines that
#: texts of unknown letters have by chance in 1,024 dimensions. It holds for texts of any length.
MIN_SCORE = 2.5 / 1024**0.5
#: Rows of an Arrow batch. Stages run in the same executors, where batches of whole texts lie outside the heap that the
#: near copies have filled. What a stage returns is planned when it is written, so the session keeps this bound.
BATCH_ROWS = 1000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops null texts, texts without letters, and those that are like no learned language.

    Every text is judged whole and on its own: very long ones as any other, equal ones alike. Columns of any name pass.
    """
    keep_arrow_rows(spark, BATCH_ROWS)
    names, profiles = fit_profiles(docs)
    (into,) = free_names(docs.columns, "_language")
    found = identify(docs, names, profiles, into=into)
    return found.where((F.col(into)["lang"] != UNKNOWN) & (F.col(into)["score"] >= MIN_SCORE)).drop(into)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five words, Jaccard of 0.8) stays, that of the smallest key.

    Texts without words are no copies of each other and stay, null ones too. Rows of one key are one document.
    """
    return drop_near_copies(docs, size=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, and the character counts follow; null texts stay as they are."""
    keep_arrow_rows(spark, BATCH_ROWS)
    clean = redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix leaves out go, those that it takes twice are there twice; null texts count no words."""
    return mixed_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1,024 tokens; a null text is one piece of the end token."""
    keep_arrow_rows(spark, BATCH_ROWS)
    return pack(docs)


STAGES = [("language_id", language_id), ("ngram_join", ngram_join), ("secret_scan", secret_scan), ("mix_sources", mix_sources), ("packing", packing)]

#: Fuzzy language profiles, lexing and tokenisation are not SQL; tests compare with a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
