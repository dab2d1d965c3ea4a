"""Documents in and results out.

Everything goes through Spark's readers and writers, so any store that Spark
reads will do. A document source gives ``doc_id`` and ``text``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One document for each UTF-8 file: doc_id (a hash of its place), path, text."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.select(F.xxhash64("path").alias("doc_id"), "path", "text")


def read_jsonl(spark: SparkSession, path: str, id_field: str = "id", text_field: str = "text") -> DataFrame:
    """One document for each JSON line; the schema is stated, so nothing is read twice."""
    rows = spark.read.schema(f"`{id_field}` string, `{text_field}` string").json(path)
    return rows.select(F.col(id_field).alias("doc_id"), F.col(text_field).alias("text"))


def read_table(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", form: str = "parquet") -> DataFrame:
    """Two columns of a columnar table; the others are not read."""
    return spark.read.format(form).load(path).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def one_document(spark: SparkSession, text: str, doc_id: int = 0) -> DataFrame:
    """A text at hand, such as standard input."""
    return spark.createDataFrame([(doc_id, text)], "doc_id long, text string")


def read_headings(spark: SparkSession, path: str) -> list[str]:
    """Headings to retain, one for each line that is not blank, in order. A list
    of arguments: it is read whole."""
    return [s for s in (r["value"].strip() for r in spark.read.text(path).collect()) if s]


def chunks(docs: DataFrame, least: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk, text): blank-line paragraphs of at least ``least`` characters."""
    return docs.select(id_col, F.posexplode(X.split_paragraphs(text_col, least)).alias("chunk", "text"))


def write_text(df: DataFrame, path: str, column: str) -> None:
    """One string column as text files, a line end after each row."""
    df.select(F.col(column).cast("string").alias("value")).write.text(path)


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines; nulls stay, other alphabets stay as they are."""
    df.write.option("ignoreNullFields", "false").json(path)


def as_json(df: DataFrame, column: str = "json", pretty: bool = True) -> DataFrame:
    """All columns as one JSON string."""
    return df.select(F.to_json(F.struct(*df.columns), {"pretty": str(pretty).lower(), "ignoreNullFields": "false"}).alias(column))


def write_relations(df: DataFrame, path: str, id_col: str = "doc_id", files: int | None = None) -> None:
    """A result clustered by document, so that readers of a few documents read few files."""
    dealt = df.repartitionByRange(files, id_col) if files else df.repartitionByRange(id_col)
    dealt.sortWithinPartitions(id_col).write.parquet(path)
