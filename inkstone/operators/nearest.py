"""Numbers and the names nearest to them, and noun chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions import rows as W
from ..functions import text as X
from ..stored import kept
from . import enrich, scoring

#: Pieces of a sentence: numbers with their signs, words, and marks.
PIECE = r"[$€£]?[0-9]+(?:[.,][0-9]+)*%?|[\p{L}\p{N}']+|[&.!?]"
#: Letters that stand for word classes in a sentence's string of classes.
CLASSES = {"ADJ": "J", "NUM": "M", "NOUN": "N", "PROPN": "N"}
#: A chunk: modifiers, then at least one noun; two words at least.
CHUNK = "[JM]+N+|NN+"


def canonical(name: Column) -> Column:
    """A name to compare: lower case, without a leading article and a trailing possessive."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"^(?:the|an?) ", ""), r" ?'s?$", "")


def polarities(sentence: Column | str) -> Column:
    """Growth and decline in the order in which a sentence's verbs say them;
    ``absolute`` where none does."""
    verbs = F.filter(enrich.tagged(sentence), lambda t: t["tag"] == "VERB")
    said = F.transform(verbs, lambda t: F.when(F.lower(t["token"]).isin(P.GROWTH_VERBS), "growth").when(F.lower(t["token"]).isin(P.DECLINE_VERBS), "decline"))
    return X.let(F.array_distinct(F.array_compact(said)), lambda a: F.when(F.size(a) > 0, a).otherwise(F.array(F.lit("absolute"))))


def nearest_facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sent_idx, pos, entity, number, polarity, distance, sentence): each
    number of a sentence with the name nearest to it, in pieces; of two as near
    the one before it.

    Names count that stand in two sentences of the document, or have two or three
    words of three letters and more; facts are kept whose name has two of them.
    A number takes the word behind it along if that is a noun. Numbers and names
    are laid out on one line for each sentence, and what was last and what comes
    next is carried along it: no number meets any other name. Only sentences with
    digits are taken apart and asked what they say; names are found once, in texts with digits.
    """
    docs = docs.where(F.col(text_col).rlike("[0-9]"))
    sentences = scoring.sentences(docs, id_col, text_col).withColumn("sid", F.struct(id_col, "sent_idx"))
    with_digits = sentences.where(F.col("sentence").rlike("[0-9]"))
    names = enrich.entity_spans(sentences, "sid", "sentence", PIECE).select("sid", "first", "last", canonical(F.col("entity")).alias("entity")).where(F.length("entity") >= 3)
    names = kept(names)
    places = names.select("sid", "entity").distinct().groupBy(F.col(f"sid.{id_col}").alias(id_col), "entity").agg(F.count("*").alias("in"))
    words = F.split("entity", " ")
    known = places.where((F.col("in") >= 2) | (F.size(words).between(2, 3) & F.forall(words, lambda w: F.length(w) >= 3))).select(F.col(id_col).alias("_of"), F.col("entity").alias("_name"))
    names = names.join(known, (F.col(f"sid.{id_col}") == F.col("_of")) & (F.col("entity") == F.col("_name"))).select("sid", F.col("first").alias("pos"), F.struct("entity", "first", "last").alias("name"))
    order = Window.partitionBy("sid").orderBy("pos")
    tokens = enrich.name_tokens(with_digits, "sid", "sentence", PIECE)
    behind = F.lead("word").over(order)
    follows = (F.lead("pos").over(order) == F.col("pos") + 1) & (enrich.word_class(behind) == "NOUN")
    numbers = tokens.withColumn("number", F.when(follows, F.concat_ws(" ", "word", behind)).otherwise(F.col("word"))).where(F.col("word").rlike("^[$€£]?[0-9]")).select("sid", "pos", "number")
    line = numbers.withColumn("name", F.lit(None).cast(names.schema["name"].dataType)).unionByName(names.withColumn("number", F.lit(None).cast("string")))
    along = Window.partitionBy("sid").orderBy("pos", F.col("name").isNull().cast("int"))
    so_far, ahead = along.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(0, Window.unboundedFollowing)
    met = line.withColumns({"a": F.last("name", ignorenulls=True).over(so_far), "b": F.first("name", ignorenulls=True).over(ahead)}).where("number is not null and (a is not null or b is not null)")
    before = F.greatest(F.col("pos") - F.col("a.last"), F.lit(0))
    after = F.col("b.first") - F.col("pos")
    nearer = F.col("b").isNull() | (F.col("a").isNotNull() & (before <= after))
    facts = met.select("sid", "pos", "number", F.when(nearer, F.col("a.entity")).otherwise(F.col("b.entity")).alias("entity"), F.when(nearer, before).otherwise(after).alias("distance"))
    said = with_digits.select(F.col("sid").alias("_sid"), "sentence", F.explode(polarities("sentence")).alias("polarity"))
    rows = facts.join(said, F.col("sid") == F.col("_sid")).groupBy("sid", "entity", "number", "polarity").agg(F.min(F.struct("pos", "distance", "sentence")).alias("x"))
    rows = rows.select(F.col(f"sid.{id_col}").alias(id_col), F.col("sid.sent_idx").alias("sent_idx"), "x.pos", "entity", "number", "polarity", "x.distance", "x.sentence")
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy(id_col, "entity"))).where("_n >= 2").drop("_n")


def noun_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sent_idx, pos, size, chunk): modifiers and nouns side by side, two
    words at least, lower case. A sentence's classes are written as a string of
    letters, on which the automaton is a pattern; leading articles are not in it."""
    letter = lambda t: F.coalesce(*(F.when(t["tag"] == c, x) for c, x in CLASSES.items()), F.lit("."))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<pos:int,size:int>>").alias("out"))
    step = lambda s, h: X.let(s["at"] + F.length(h["gap"]), lambda pos: F.struct((pos + F.length(h["hit"])).alias("at"), F.concat(s["out"], F.array(F.struct(pos.alias("pos"), F.length(h["hit"]).alias("size")))).alias("out")))

    def spans(kinds: Column) -> Column:
        hits = F.arrays_zip(F.split(kinds, CHUNK, -1).alias("gap"), F.regexp_extract_all(kinds, F.lit(CHUNK), F.lit(0)).alias("hit"))
        return F.aggregate(F.filter(hits, lambda h: h["hit"].isNotNull()), zero, step)["out"]

    # the classes and their string are bound: as columns they would be worked out again for each chunk
    def chunks(t: Column) -> Column:
        cut = lambda s: F.array_join(F.transform(F.slice(t, s["pos"] + 1, s["size"]), lambda w: F.lower(w["token"])), " ")
        found = X.let(F.array_join(F.transform(t, letter), ""), spans)
        return F.transform(found, lambda s: F.struct(s["pos"].alias("pos"), s["size"].alias("size"), cut(s).alias("chunk")))

    rows = scoring.sentences(docs, id_col, text_col).select(id_col, "sent_idx", X.let(enrich.tagged("sentence"), chunks).alias("c"))
    return W.fields(rows, [id_col, "sent_idx"], "c", "pos")


def noun_phrases(docs: DataFrame, keywords: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, phrases): chunks that a document has at least twice, by first
    appearance; behind them, given ``keywords``, those with one of its words. A
    document without any has an empty array."""
    counted = noun_chunks(docs, id_col, text_col).groupBy(id_col, "chunk").agg(F.count("*").alias("n"), F.min(F.struct("sent_idx", "pos")).alias("at"))
    wanted = F.regexp_extract_all(F.lower(F.lit(keywords or "")), F.lit("[a-z]{3,}"), F.lit(0))
    kept = counted.where((F.col("n") >= 2) | F.arrays_overlap(F.split("chunk", " "), wanted))
    listed = kept.groupBy(F.col(id_col).alias("_of")).agg(F.transform(F.array_sort(F.collect_list(F.struct((F.col("n") < 2).alias("once"), "at", "chunk"))), lambda x: x["chunk"]).alias("p"))
    return docs.select(id_col).join(listed, F.col(id_col) == F.col("_of"), "left").select(id_col, F.coalesce("p", F.array().cast("array<string>")).alias("phrases"))
