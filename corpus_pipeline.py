"""A corpus pipeline: language, lines, near copies, benchmark leaks, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again for the next. All but the last return the columns of
``documents``.

* language: documents without a letter, or whose best language is unsure, go; a
  missing ``lang`` is filled in with the predicted one.
* lines: recurring lines go from documents; ``n_chars`` follows the text.
* near_copies: one document of each group stays; a group is linked at 0.8 of five-word shingles.
* leaks: documents that hold a benchmark window go.
* mixture: a sample by probabilities raked to source, language and topic targets,
  with mix_topic, n_tokens, weight and probability.

Nulls: a null text has no letter, so it goes at the first stage; empty tables
pass through every stage as empty tables. Texts are read whole, whatever their length. A row that repeats another one, id and all,
goes with the near copies. A copy whose every line recurs leaves the second stage as an empty text, is linked with nothing and stays. Ties go to the
least id. Further columns stay through all stages, whatever their names, but for those that mixture adds, which replace theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, language_id, line_dedup, mixing, near_dedup
from lodestone.llm.common import read, remainder, stored

SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(docs.where(remainder(F.col("doc_id"), 5) != 0))
    kept = language_id.identify(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= SURE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicated(docs)
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs).where("selected").drop("selected")


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_copies", near_copies),
    ("leaks", leaks),
    ("mixture", mixture),
]

#: The language model, the join and the raking aren't expressible in SQL; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
