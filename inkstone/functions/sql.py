"""The text functions as temporary SQL functions of a session.

Each is an SQL expression that Catalyst plans like any other; none is a UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import patterns as P
from . import text as X

#: Functions of a string whose expressions have no lambda: SQL text is derived from them.
SCALARS = {
    "strip_think": X.strip_think,
    "clean_text": X.clean_text,
    "is_heading": X.is_heading,
    "is_structural_heading": X.is_structural_heading,
    "heading_name": X.heading_name,
    "heading_depth": X.heading_depth,
    "normalize_key": X.normalize_key,
    "normalize_value": X.normalize_value,
    "compact_text": X.compact,
    "text_polarity": X.polarity,
}


def _sql(spark: SparkSession, c: Column) -> str:
    """The SQL of a column over a string column ``x``."""
    frame = spark.createDataFrame([], "x string").select(c.alias("y"))
    text = frame._jdf.queryExecution().analyzed().expressions().head().sql()
    return text[: text.rindex(" AS ")]


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Make the functions known to ``spark.sql``; returns their names."""
    x = F.col("x")
    bodies = {name: _sql(spark, f(x)) for name, f in SCALARS.items()}
    trimmed = "btrim(x, '" + "".join(f"\\u{ord(c):04x}" for c in X.SPACES) + "')"
    stop = ", ".join(f"'{w}'" for w in P.STOPWORDS)
    bodies["text_terms"] = rf"filter(regexp_extract_all(lower(x), r'[\p{{L}}\p{{N}}_]+', 0), w -> w rlike '^[a-z]{{3,}}$' and w not in ({stop}))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}trim_text(x STRING) RETURN {trimmed}")
    masked = _sql(spark, X._masked(F.coalesce(x, F.lit(""))))
    bodies["split_sentences"] = (
        rf"transform(filter(transform(split({masked}, r'(?<=[.!?]){X._S}+(?=[A-Z])|\n{X._S}*\n', -1), s -> {trimmed.replace('(x,', '(s,')}), s -> s <> ''), s -> translate(s, chr(0), '.'))"
    )
    bodies["split_paragraphs"] = rf"filter(transform(split(coalesce(x, ''), r'\n{X._S}*\n+', -1), s -> {trimmed.replace('(x,', '(s,')}), s -> length(s) >= 20)"
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(x STRING) RETURN {body}")
    return [f"{prefix}{n}" for n in ("trim_text", *bodies)]
