"""From raw documents to token ids: five stages, each an operator of ``taskmine.llm``.

Every stage takes (spark, docs, folder of the given tables) and returns a DataFrame; all
but the last keep the columns of the documents. ``run`` writes each stage's rows to the
shared folder and reads them back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import taskmine
from taskmine.llm import bpe, contamination, near, pii, toxicity
from taskmine.llm.queries import default_ranks
from taskmine.sources.stages import staged


def without_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents scored under 0.5 by a classifier fitted on the labelled ones among them (but a fifth, held out)."""
    taskmine.ship(spark)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    sample = toxicity.sample_of(spark.read.parquet(f"{folder}/labels.parquet").where(~held))
    model = toxicity.train(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))  # at most 16,000 ids
    return toxicity.scored(docs, model).where("score < 0.5").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest id."""
    taskmine.ship(spark)
    return near.one_of_each(docs).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    taskmine.ship(spark)
    found = contamination.contaminated(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))
    return found.where(F.size("hits") == 0).select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, personal data and what discloses it replaced; n_chars follows the text."""
    clean = pii.sanitised(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def as_tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, token ids, the byte at which each token ends, and the text decoded from the ids."""
    taskmine.ship(spark)
    coded = bpe.round_trip(docs.select("doc_id", "text"), default_ranks())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "ends", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("tokens", as_tokens),
]
# fitted classifiers, MinHash and byte-pair merges have no SQL; tests hold the rows against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
