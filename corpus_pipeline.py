"""A training corpus from documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents.

The pipeline is an application with a session of its own: its stages set the
rows of an Arrow batch for all that follows, so that the Python workers which
earlier stages leave behind stay small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm import decontam, langid, linededup, packing, simhash
from inkstone.llm.shared import BATCH_ROWS, BATCH_SETTING, table, written

#: Share of the background from which on a text is not in any learned language.
REJECTED_BACKGROUND = 0.5


def _small_batches(spark: SparkSession) -> None:
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a learned language; text, not the label, decides."""
    _small_batches(spark)
    model = langid.learn(docs.where(~langid.held_out()))
    found = langid.with_language(docs, model, name="_language")
    kept = (F.col("_language.lang_pred") != langid.UNDETERMINED) & (F.col("_language.background") < REJECTED_BACKGROUND)
    return found.where(kept).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their duplicate lines, short ones included. Only documents of which nothing but
    white space is left go; untouched documents all stay."""
    _small_batches(spark)
    left = F.col("line_dedup.text").rlike(r"(?U)\S")
    found = linededup.dedup_lines(docs, short_lines=True).where(F.isnull("text") | (F.col("line_dedup.n_dropped") == 0) | left)
    text = F.col("line_dedup.text")
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the smallest id, of each group linked by five-word shingle sets of similarity 0.8 and more."""
    _small_batches(spark)
    return simhash.keep_one_similar(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("sequences", sequences),
]

#: Tokenising, edit distances and learned models are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
