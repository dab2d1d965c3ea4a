"""The queries of the operators over whole tables, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, embed_hnsw, html_blocks, langid, linededup, oracle, packing, pii, prefix_trie, repair, secrets, simhash, toxicity, warc
from .shared import table, written


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record with its place and digest, audited against a replica
    that has places and offsets of its own and is made to differ by the records'
    digests: those that start with 0 have another last character there, 1a are
    absent, 2b have a second record behind them, 3c lie at the end of their archive."""
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    html, good = F.col("html"), F.sha2(warc.record_bytes(F.col("page_id"), F.col("url"), F.col("html")), 256)
    starts = lambda text: F.startswith("good", F.lit(text))
    damaged = F.concat(F.left(html, F.greatest(F.length(html) - 1, F.lit(0))), F.when(F.right(html, F.lit(1)) == "?", "!").otherwise("?"))
    known = written(pages.withColumn("good", good)).where(~starts("1a"))
    kept = known.withColumn("html", F.when(starts("0"), F.coalesce(damaged, F.lit("?"))).otherwise(html))
    more = known.where(starts("2b")).withColumn("html", F.concat(F.coalesce(html, F.lit("")), F.lit("+")))
    replica = warc.leaves(kept.unionByName(more), order=starts("3c").cast("int"))
    found = warc.compare(warc.leaves(pages), replica, warc.levels_for(warc.ARCHIVE_RECORDS))
    archive = F.nullif("archive", F.lit(warc.NULL_IDS))
    return found.select(F.col("record_id").alias("page_id"), archive.alias("archive"), "seq", F.col("start").alias("start_offset"), F.col("end").alias("end_offset"), "digest", "status")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", "line_dedup.text")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_hnsw.near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.learn(docs.where(~langid.held_out()))
    return langid.identify(docs, model).withColumn("held_out", langid.held_out())


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontam.contamination(docs, items).drop("items")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents", "doc_id", "text")))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")
    return toxicity.toxicity(docs, toxicity.learn(docs.where(~toxicity.held_out()), labels.where(~toxicity.held_out())))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash, op2_packing, op3_merkle_fixity, op4_html_extraction, op5_line_dedup, op6_embedding_dedup, op7_language_id, op8_decontamination, op9_secrets, op10_pii, op11_toxicity, op12_prefix_trie, op13_conversation_repair)
}

#: The others hash, tokenise, lex or learn beyond SQL; tests hold them to brute force.
ORACLE: dict[str, str] = {
    "op3_merkle_fixity": oracle.merkle_fixity(),
    "op5_line_dedup": oracle.line_dedup(),
    "op6_embedding_dedup": oracle.embedding_dedup(),
    "op8_decontamination": oracle.decontamination(),
    "op10_pii": oracle.personal_data(),
    "op12_prefix_trie": oracle.prefix_trie(),
    "op13_conversation_repair": oracle.conversation_repair(),
}
