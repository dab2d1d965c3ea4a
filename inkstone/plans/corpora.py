"""Corpora made from the driver's tables, each with the SQL that makes it too."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


DOCUMENTS = "select doc_id, text from documents"

#: Parts of a narrative: literal text, and in braces the fields below.
_NARRATIVE = (
    "# Account {key}\n\n## Overview\nAccount {key} was opened on {date} by {name} and paid ${paid}. It ships {n} items in {days} days to Mr. Lee of No. {nation} Main St. in Paris."
    " The order volume fell by 3.5 percent.\n\n## Line items\nThe last order is from {last}. Customer {name} ordered {n} items and paid ${paid}."
    " See https://example.org/accounts/{key} for the order records.\n{segment}: market segment\n\n**Segment:** {segment}\n\nResolution: Account {key} closed with {n} documents and 2 units left over."
    "\n\nConclusion\nThe order volume was reviewed by Google and Dr. Mary Smith on {last}. Order volume increased 5 percent. Smith & Co of London paid 1,250 EUR for {n} items."
)


def narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report on each customer with orders: headings, amounts, dates, counts, names."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.sum(cents).alias("cents"), F.min("o_orderdate").alias("d1"), F.max("o_orderdate").alias("d2"))
    rows = orders.join(table(spark, sf_dir, "customer"), F.col("k") == F.col("c_custkey"))
    text = lambda c: c.cast("string")
    fields = {
        "key": text(F.col("c_custkey")),
        "date": F.date_format("d1", "yyyy-MM-dd"),
        "last": F.date_format("d2", "yyyy-MM-dd"),
        "name": F.col("c_name"),
        "paid": F.concat(text(F.expr("cents div 100")), F.lit("."), F.lpad(text(F.col("cents") % 100), 2, "0")),
        "n": text(F.col("n")),
        "days": text(F.col("cents") % 60 + 1),
        "nation": text(F.col("c_nationkey")),
        "segment": F.col("c_mktsegment"),
    }
    rows = _dealt(spark, rows, "c_custkey")
    return rows.select(F.col("c_custkey").alias("doc_id"), F.concat(*_parts(lambda t: F.lit(t), fields)).alias("text"))


def _dealt(spark: SparkSession, rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt out before long texts are made of them. What comes out of a join of small
    rows lies by ``key`` already, so a deal by the key itself would be left out and adaptive
    execution would leave all of it in one task; a hash of the key is dealt out as asked."""
    return rows.repartition(_tasks(spark), F.xxhash64(key))


def _tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _parts(literal, fields, of=_NARRATIVE):
    return [fields[p[1:-1]] if p[:1] == "{" else literal(p) for p in re.split(r"(\{\w+\})", of) if p]


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


NARRATIVES = (
    "select c_custkey as doc_id, "
    + " || ".join(
        _parts(
            quoted,
            {
                "key": "cast(c_custkey as varchar)",
                "date": "strftime(d1, '%Y-%m-%d')",
                "last": "strftime(d2, '%Y-%m-%d')",
                "name": "c_name",
                "paid": "cast(cents // 100 as varchar) || '.' || lpad(cast(cents % 100 as varchar), 2, '0')",
                "n": "cast(n as varchar)",
                "days": "cast(cents % 60 + 1 as varchar)",
                "nation": "cast(c_nationkey as varchar)",
                "segment": "c_mktsegment",
            },
        )
    )
    + " as text from (select o_custkey, count(*) as n, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as cents, min(o_orderdate) as d1, max(o_orderdate) as d2 from orders group by 1) o join customer on o_custkey = c_custkey"
)


def ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, each with statements on the orders of the customer of the same
    number behind it: long texts in several languages with facts in them."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.sum(cents).alias("cents"), F.min("o_orderdate").alias("d1"))
    rows = documents(spark, sf_dir).join(orders, F.col("doc_id") == F.col("k"), "left")
    fields = {"n": F.col("n").cast("string"), "days": (F.col("cents") % 60 + 1).cast("string"), "paid": F.concat(F.expr("cents div 100").cast("string"), F.lit("."), F.lpad((F.col("cents") % 100).cast("string"), 2, "0")), "date": F.date_format("d1", "yyyy-MM-dd")}
    facts = F.concat(*_parts(lambda t: F.lit(t), fields, _LEDGER))
    return rows.select("doc_id", F.concat("text", F.coalesce(facts, F.lit(""))).alias("text"))


_LEDGER = (
    "\n\n## Ledger\nGoogle ordered {n} items from Smith & Co for ${paid} on {date}. The new delivery plan of Mary Smith took {days} days. The order volume of Google rose by 3.5 percent in Paris."
    " Smith & Co delivered {n} items within {days} days, and the delivery plan fell short by 2 units."
)


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as ``Role: text`` lines in the order of their turns."""
    turns = table(spark, sf_dir, "conversations")
    # turns are small, and what is made of their texts is not: left to adaptive execution they lie in few tasks
    turns = turns.repartition(_tasks(spark), "conv_id")
    line = F.concat(F.initcap("role"), F.lit(": "), F.col("text"))
    packed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("t"))
    return packed.select(F.col("conv_id").alias("doc_id"), F.array_join(F.transform("t", lambda x: x["line"]), "\n").alias("text"))


DIALOGUES = (
    "select conv_id as doc_id, string_agg(upper(role[1]) || lower(role[2:]) || ': ' || text, chr(10) order by turn, upper(role[1]) || lower(role[2:]) || ': ' || text) as text"
    " from conversations group by 1"
)


def thoughts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a reasoning block before them."""
    text = F.concat(F.lit("  <think>plan\nfor "), F.col("doc_id").cast("string"), F.lit("</think>\n\n"), F.col("text"), F.lit("\n<think></think> "))
    return documents(spark, sf_dir).select("doc_id", text.alias("text"))


LEDGERS = (
    "select doc_id, text || coalesce("
    + " || ".join(_parts(quoted, {"n": "cast(n as varchar)", "days": "cast(cents % 60 + 1 as varchar)", "paid": "cast(cents // 100 as varchar) || '.' || lpad(cast(cents % 100 as varchar), 2, '0')", "date": "strftime(d1, '%Y-%m-%d')"}, _LEDGER))
    + ", '') as text from documents left join (select o_custkey as k, count(*) as n, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as cents, min(o_orderdate) as d1 from orders group by 1) on doc_id = k"
)

THOUGHTS = "select doc_id, '  <think>plan' || chr(10) || 'for ' || cast(doc_id as varchar) || '</think>' || chr(10) || chr(10) || text || chr(10) || '<think></think> ' as text from documents"


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without their tags: paragraphs become blank-line blocks."""
    html = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", ""), r"</?(p|h1|li|div)[^>]*>", "\n\n")
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), X.trim_ws(F.regexp_replace(html, "<[^>]*>", " ")).alias("text"))


PAGE_TEXT = (
    r"select page_id as doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'),"
    r" '</?(p|h1|li|div)[^>]*>', chr(10) || chr(10), 'g'), '<[^>]*>', ' ', 'g'), '^\s+|\s+$', '', 'g') as text from pages"
)
