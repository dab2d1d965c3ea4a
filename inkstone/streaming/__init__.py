"""The row-local operators over streams of documents.

Text functions, facts, attributes and keyword extracts are projections, so they
run on a stream as they are. Scores group the parts of one document; on a
stream each micro-batch holds whole documents, so they run batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import extract
from ..operators.summarize import summarize


def documents(spark: SparkSession, path: str, schema: str, per_trigger: int | None = None) -> DataFrame:
    """A stream of Parquet files with the given schema."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """A stream of facts, one row each, in append mode; ``keep`` are columns of
    the document that its facts carry along."""
    from ..functions import text as X

    sents = F.flatten(F.transform(X.split_sentences(text_col), extract.sentence_stats))
    return docs.select(id_col, *keep, F.inline(sents))


def fact_counts(facts: DataFrame, time_col: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Facts of each kind in tumbling windows of event time; state older than
    the watermark is dropped."""
    return facts.withWatermark(time_col, late).groupBy(F.window(time_col, window).alias("w"), "stat_type").agg(F.count("*").alias("n")).select("w.start", "w.end", "stat_type", "n")


def each_batch(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run an operator that groups on every micro-batch and append its rows to
    ``out``. A batch's files are written under its number, so a batch that is
    run again after a failure replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summaries(docs: DataFrame, out: str, checkpoint: str, max_length: int = 500, **how) -> StreamingQuery:
    """Summaries of a stream of documents."""
    return each_batch(docs, lambda batch: summarize(batch, max_length, **how), out, checkpoint)
