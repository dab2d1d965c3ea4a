"""Rule-based names, word classes, base forms, and sequence labelling helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions import rows as W
from ..functions import text as X
from ..stored import kept
from . import extract

_PIECE = r"[\p{L}\p{N}']+|[&.!?]"
#: Words and single marks.
SPANS = r"[\p{L}\p{N}']+|(?U)[^\s\p{L}\p{N}']"
STRINGS = "array<string>"


def _any_of(word: Column, *lists: list[str]) -> Column:
    return F.lower(word).isin([w for of in lists for w in of])


def name_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece: str = _PIECE) -> DataFrame:
    """(id, pos, word, starts): words and ``&``, and whether each begins a
    sentence. A period after a title ends none. ``piece`` says what a piece is."""
    pieces = docs.select(id_col, F.posexplode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(piece), F.lit(0))).alias("pos", "word"))
    before = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    is_end = F.col("word").isin(".", "!", "?")
    last_word = F.last(F.when(~is_end, F.col("word")), ignorenulls=True).over(before)
    rows = pieces.withColumn("end", is_end & ((F.col("word") != ".") | ~F.coalesce(_any_of(last_word, P.TITLES), F.lit(False))))
    rows = rows.withColumn("ends", F.count_if("end").over(before)).where(~is_end)
    ordered = Window.partitionBy(id_col).orderBy("pos")
    before_it = F.lag("ends").over(ordered)
    return rows.select(id_col, "pos", "word", (before_it.isNull() | (F.col("ends") > before_it)).alias("starts"))


def _runs(text: Column, piece: str) -> Column:
    """(pos, parts, places, starts) of a text's runs, in order. Only capitalised words are
    looked at: one belongs to the one before it where these touch, or a connector alone is between."""
    title = lambda w: _any_of(w, P.TITLES)

    def of(pieces: Column, words: Column) -> Column:
        def starts(x: Column, at: Column) -> Column:
            """Whether a word begins a sentence, by the marks behind the word before it."""
            before = F.get(words, at - 1)
            marks = F.slice(pieces, before["pos"] + 2, x["pos"] - before["pos"] - 1)
            return F.when(at == 0, True).when(before["pos"] + 1 == x["pos"], False).otherwise(F.exists(marks, lambda m: (m != ".") | ~title(before["word"])))

        def runs(caps: Column) -> Column:
            def linked(x: Column, i: Column) -> Column:
                gap, between = x["at"] - F.get(caps, i - 1)["at"], F.get(words, x["at"] - 1)
                return F.when((i == 0) | x["starts"], False).when(gap == 1, True).when(gap != 2, False).otherwise(_any_of(between["word"], P.CONNECTORS) & ~starts(between, x["at"] - 1))

            def run(first: Column, last: Column) -> Column:
                members = F.slice(words, first["at"] + 1, last["at"] - first["at"] + 1)
                return F.struct(first["pos"].alias("pos"), F.transform(members, lambda x: x["word"]).alias("parts"), F.transform(members, lambda x: x["pos"]).alias("places"), first["starts"].alias("starts"))

            new = F.filter(F.transform(caps, lambda x, i: F.when(~linked(x, i), i)), lambda i: i.isNotNull())
            return X.let(new, lambda n: F.transform(n, lambda i, k: run(F.get(caps, i), F.get(caps, F.coalesce(F.get(n, k + 1), F.size(caps)) - 1))))

        caps = F.transform(words, lambda x, i: F.when(x["word"].rlike(r"^\p{Lu}"), F.struct(x["pos"].alias("pos"), i.alias("at"), starts(x, i).alias("starts"))))
        return X.let(F.filter(caps, lambda x: x.isNotNull()), runs)

    def numbered(pieces: Column) -> Column:
        words = F.transform(pieces, lambda w, i: F.when(~w.isin(".", "!", "?"), F.struct(w.alias("word"), i.alias("pos"))))
        return X.let(F.filter(words, lambda x: x.isNotNull()), lambda words: of(pieces, words))

    return X.let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(piece), F.lit(0)), numbered)


def name_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece: str = _PIECE) -> DataFrame:
    """(id, pos, parts, places, starts): runs of capitalised words within a sentence,
    a connector between two of them included, with the words' places, each out of its
    text's own row: nothing is dealt out."""
    return W.fields(docs.select(id_col, _runs(F.col(text_col), piece).alias("runs")), [id_col], "runs", "pos")


def entity_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, entity): runs that are names. A leading title, possessive or
    sentence opener is taken off; single common words are none; a single word
    that begins a sentence needs a known name."""
    return entity_spans(docs, id_col, text_col).select(id_col, "pos", "entity")


def entity_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece: str = _PIECE) -> DataFrame:
    """(id, pos, first, last, entity): the same with the places of a name's first
    and last piece."""
    rows = name_runs(docs, id_col, text_col, piece).withColumn("first", F.get("parts", F.lit(0))).withColumn("many", F.size("parts") > 1)
    title = F.col("many") & _any_of(F.col("first"), P.TITLES)
    owner = F.col("many") & _any_of(F.col("first"), P.POSSESSIVES)
    opener = F.col("many") & F.col("starts") & _any_of(F.col("first"), P.SENTENCE_STOPWORDS)
    strip = title | owner | opener
    rows = rows.select(id_col, "pos", F.when(strip, F.slice("parts", F.lit(2), F.size("parts") - 1)).otherwise(F.col("parts")).alias("parts"), F.get("places", F.when(strip, 1).otherwise(0)).alias("first"), F.element_at("places", -1).alias("last"), title.alias("titled"), (F.col("starts") & ~strip).alias("starts"))
    common = (F.size("parts") == 1) & _any_of(F.get("parts", F.lit(0)), P.SENTENCE_STOPWORDS, P.TITLES, P.CALENDAR, P.COMMON_NOUNS, P.CURRENCY_CODES, P.POSSESSIVES)
    known = F.exists("parts", lambda w: _any_of(w, P.ORG_SUFFIXES, P.ORGS, P.COUNTRIES, P.PLACES, P.FIRST_NAMES))
    kept = rows.where(~common & (F.col("titled") | known | (F.size("parts") > 1) | ~F.col("starts")))
    return kept.select(id_col, "pos", "first", "last", F.array_join("parts", " ").alias("entity"))


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, entities): each name once, by first appearance."""
    first = entity_rows(docs, id_col, text_col).groupBy(id_col, "entity").agg(F.min("pos").alias("pos"))
    listed = first.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "entity"))).alias("e")).select(F.col(id_col).alias("_of"), F.transform("e", lambda x: x["entity"]).alias("e"))
    return docs.select(id_col).join(listed, F.col(id_col) == F.col("_of"), "left").select(id_col, F.coalesce("e", F.array().cast(STRINGS)).alias("entities"))


def _first_names(sentences: DataFrame) -> DataFrame:
    """(sid, entity): the first name in each sentence."""
    return entity_rows(sentences, "sid", "sentence").groupBy("sid").agg(F.min_by("entity", "pos").alias("named"))


def _by_sentence(rows: DataFrame, id_col: str) -> DataFrame:
    """Rows with ``sid``, one value for each sentence of a document."""
    return rows.withColumn("sid", F.concat_ws("\x01", F.col(id_col).cast("string"), "sentence"))


def named_facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, k, entity, number, polarity, sentence): correlated facts whose
    entity is the first name in the sentence, where there is one."""
    # facts are read twice, for their sentences and for themselves, and worked out once
    rows = _by_sentence(kept(extract.correlated_rows(docs, id_col, text_col)), id_col)
    names = _first_names(rows.select("sid", "sentence").distinct())
    return rows.join(names, "sid", "left").select(id_col, "k", F.coalesce("named", "entity").alias("entity"), "number", "polarity", "sentence")


def word_class(w: Column, low: Column | None = None) -> Column:
    """A coarse word class by closed lists, endings and capitals; ``low`` is the word in lower case, where it is at hand."""
    low = F.lower(w) if low is None else low
    out = F.when(w.startswith("$") | w.endswith("%") | w.rlike("^[0-9]"), "NUM")
    for name, listed in P.WORD_CLASSES.items():
        out = out.when(low.isin(listed), name)
    out = out.when(low.isin(P.GROWTH_VERBS + P.DECLINE_VERBS + P.OTHER_VERBS) | low.rlike("(?:ing|ed)$"), "VERB")
    out = out.when(low.endswith("ly"), "ADV").when(low.rlike("(?:tion|ment|ness|ity)$"), "NOUN").when(low.rlike("(?:ous|ful|ive|able)$"), "ADJ")
    return out.when(w.rlike(r"^\p{Lu}"), "PROPN").otherwise("NOUN")


def tagged(c: Column | str) -> Column:
    """(token, tag) structs of a text, in order."""
    edge = r"[^\p{L}\p{N}$%']+"
    words = F.transform(F.split(X.fold_ws(F.coalesce(X.col(c), F.lit(""))), " "), lambda w: F.regexp_replace(w, rf"^{edge}|{edge}$", ""))
    both = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.struct(w.alias("token"), F.lower(w).alias("low")))
    return F.transform(both, lambda x: F.struct(x["token"].alias("token"), word_class(x["token"], x["low"]).alias("tag")))


def verb_polarity(c: Column | str) -> Column:
    """Growth or decline by the first verb that says either."""
    verbs = F.filter(F.transform(tagged(c), lambda t: F.struct(F.lower(t["token"]).alias("w"), t["tag"].alias("tag"))), lambda t: (t["tag"] == "VERB") & t["w"].isin(P.GROWTH_VERBS + P.DECLINE_VERBS))
    first = F.get(verbs, F.lit(0))["w"]
    return F.when(first.isin(P.GROWTH_VERBS), "growth").when(first.isin(P.DECLINE_VERBS), "decline").otherwise("absolute")


def verb_facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, k, entity, number, polarity, sentence): every number in a sentence
    with a name, its polarity read off the verb; equal facts once."""
    rows = kept(W.numbered(extract.stats(docs, id_col, text_col), [id_col], "stats", "k", "f").select(id_col, "k", "f.*").withColumnRenamed("context_sentence", "sentence"))
    rows = _by_sentence(rows, id_col)
    named = rows.join(_first_names(rows.select("sid", "sentence").distinct()), "sid")
    number = F.concat_ws(" ", "value", F.nullif("unit", F.lit("")))
    facts = named.select(id_col, "k", F.col("named").alias("entity"), number.alias("number"), verb_polarity("sentence").alias("polarity"), "sentence")
    return facts.groupBy(id_col, "entity", "number", "polarity", "sentence").agg(F.min("k").alias("k")).select(id_col, "k", "entity", "number", "polarity", "sentence")


def lemma(c: Column | str) -> Column:
    """A coarse base form, lower case: irregular words, then endings."""
    w = F.lower(X.col(c))
    n = F.length(w)
    cut = lambda k: F.left(w, n - k)
    single = lambda x: F.regexp_replace(x, r"([bdgmnprt])\1$", "$1")
    out = None
    for base, forms in P.IRREGULAR.items():
        out = (F if out is None else out).when(w.isin(forms.split()), base)
    return (
        out.when(w.rlike(r"[^\x00-\x7F]"), w)
        .when((n > 4) & w.rlike("ie[sd]$"), F.concat(cut(3), F.lit("y")))
        .when((n > 5) & w.endswith("ing"), single(cut(3)))
        .when((n > 4) & w.endswith("ed"), single(cut(2)))
        .when((n > 4) & w.rlike("(?:[sxz]|ch|sh)es$"), cut(2))
        .when((n > 3) & w.rlike("[^s]s$"), cut(1))
        .otherwise(w)
    )


def expand_hints(hints: DataFrame, synonyms: DataFrame | None = None, weight: float = 0.5, mode: str = "forms", docs: DataFrame | None = None, top: int = 5, **columns: str) -> DataFrame:
    """(term, weight): hints as given, and their base forms and the synonyms of a
    (term, synonym) table at ``weight`` times theirs; the largest weight stays.
    ``mode="similar"`` adds the ``top`` terms of the corpus ``docs`` that keep the
    most alike company, at ``weight`` times their cosine."""
    if mode not in ("forms", "similar") or (mode == "similar") != (docs is not None):
        raise ValueError("mode is 'forms', or 'similar' with documents")
    own = hints.select(F.lower("term").alias("term"), F.col("weight").cast("double").alias("weight"))
    more = own.select(lemma("term").alias("term"), (F.col("weight") * weight).alias("weight"))
    out = own.unionByName(more)
    if synonyms is not None:
        other = synonyms.select(F.lower("term").alias("term"), F.lower("synonym").alias("synonym"))
        out = out.unionByName(own.join(other, "term").select(F.col("synonym").alias("term"), (F.col("weight") * weight).alias("weight")))
    if docs is not None:
        from .graph import similar_terms

        near = similar_terms(docs, own, top, **columns)
        out = out.unionByName(own.join(near, "term").select(F.col("similar").alias("term"), (F.col("weight") * weight * F.col("cosine")).alias("weight")))
    return out.groupBy("term").agg(F.max("weight").alias("weight"))


def span_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tok, token, start, end): words and single marks with byte offsets."""
    text, pattern = F.coalesce(F.col(text_col), F.lit("")), SPANS
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("token"))
    rows = docs.select(id_col, F.posexplode(F.filter(both, lambda x: x["token"].isNotNull())).alias("tok", "x"))
    rows = rows.select(id_col, "tok", F.col("x.token").alias("token"), F.octet_length("x.gap").alias("g"), F.octet_length("x.token").alias("n"))
    end = F.sum(F.col("g") + F.col("n")).over(Window.partitionBy(id_col).orderBy("tok").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return rows.withColumn("end", end).select(id_col, "tok", "token", (F.col("end") - F.col("n")).alias("start"), "end")


def project_bio(tokens: DataFrame, spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, tok, token, bio): a token wholly inside a span (start, end, label)
    is ``B-`` or ``I-`` of its label, else ``O``; a later span wins."""
    s = spans.select(F.col(id_col).alias("_i"), F.col("start").alias("_s"), F.col("end").alias("_e"), "label")
    inside = (F.col(id_col) == F.col("_i")) & (F.col("start") >= F.col("_s")) & (F.col("end") <= F.col("_e"))
    rows = tokens.join(s, inside, "left")
    first = F.min("tok").over(Window.partitionBy(id_col, "_s", "_e", "label")) == F.col("tok")
    tag = F.when(F.col("label").isNull(), "O").when(first, F.concat(F.lit("B-"), "label")).otherwise(F.concat(F.lit("I-"), "label"))
    return rows.withColumn("bio", tag).groupBy(id_col, "tok", "token").agg(F.max_by("bio", F.coalesce("_s", F.lit(-1))).alias("bio"))


def merge_bio(tags: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, label, first_tok, last_tok, text): runs of B and I tags as spans."""
    order = Window.partitionBy(id_col).orderBy("tok")
    label = F.regexp_extract("bio", "^[BI]-(.+)$", 1)
    rows = tags.withColumn("label", label).withColumn("before", F.lag(label).over(order))
    new = F.col("bio").startswith("B-") | (F.col("bio").startswith("I-") & ~F.col("before").eqNullSafe(F.col("label")))
    rows = rows.withColumn("run", F.count_if(new).over(order)).where("label <> ''")
    words = F.transform(F.array_sort(F.collect_list(F.struct("tok", "token"))), lambda x: x["token"])
    return rows.groupBy(id_col, "run", "label").agg(F.min("tok").alias("first_tok"), F.max("tok").alias("last_tok"), F.array_join(words, " ").alias("text")).drop("run")


def token_features(w: Column | str, known: set[str] | None = None) -> Column:
    """Features of one token for a sequence labeller: lower form, shape, ends,
    kinds of characters, and the small name lists. With ``known`` only those of
    kinds that are named there; others would be looked up in vain."""
    w = X.col(w)
    kinds = None if known is None else {f if f.startswith("gaz=") else f.split("=")[0] + "=" * ("=" in f) for f in known}
    wanted = lambda *parts: [c for name, c in parts if kinds is None or name in kinds]
    n, low = F.length(w), F.lower(w)
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.left(w, F.lit(8)), "[0-9]", "\x01"), r"\p{Lu}", "X"), r"\p{Ll}", "x")
    some = lambda cond, name: (name, F.when(cond, name))
    parts = [("w.lower=", F.concat(F.lit("w.lower="), low)), ("shape=", F.concat(F.lit("shape="), F.translate(shape, "\x01", "d")))]
    parts += [(f"pre{k}=", F.when(n >= k, F.concat(F.lit(f"pre{k}="), F.left(w, F.lit(k))))) for k in (1, 2, 3)]
    parts += [(f"suf{k}=", F.when(n >= k, F.concat(F.lit(f"suf{k}="), F.right(w, F.lit(k))))) for k in (1, 2, 3, 4)]
    parts += [some(w.rlike(r"^\p{Lu}"), "is_title"), some(w.rlike(r"^\p{Lu}+$"), "is_upper"), some(w.rlike("^[0-9]+$"), "is_digit"), some(w.contains("-"), "has_hyphen"), some(w.rlike("[0-9]"), "has_digit")]
    lists = {"ORGS": P.ORGS, "ORG_SUFFIXES": P.ORG_SUFFIXES, "COUNTRIES": P.COUNTRIES, "PLACES": P.PLACES, "FIRST_NAMES": P.FIRST_NAMES, "TITLES": P.TITLES, "CALENDAR": P.CALENDAR}
    parts += [some(low.isin(of), f"gaz={name}") for name, of in lists.items()]
    return F.array_compact(F.array(*wanted(*parts)).cast(STRINGS))


def sequence_features(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, tok, features): each token's own and those of two neighbours on either side."""
    order = Window.partitionBy(id_col).orderBy("tok")
    beside = {f"w{k}": F.lag("token", -k).over(order) if k < 0 else F.lead("token", k).over(order) for k in (-2, -1, 1, 2)}
    beside |= {"first": F.lag("tok").over(order).isNull(), "last": F.lead("tok").over(order).isNull()}
    rows = tokens.select(id_col, "tok", "token").withColumns(beside)
    return rows.select(id_col, "tok", _placed_features(*(F.col(c) for c in ("token", "w-1", "w-2", "w1", "w2", "first", "last"))).alias("features"))


def _placed_features(token: Column, before: Column, before2: Column, after: Column, after2: Column, first: Column, last: Column) -> Column:
    """Features of a token between its neighbours: words are carried to it, and features made of them there."""
    mark = lambda w, p: F.when(w.isNull(), F.array().cast(STRINGS)).otherwise(F.transform(token_features(w), lambda f: F.concat(F.lit(p), f)))
    edges = F.array_compact(F.array(F.when(first, "BOS"), F.when(last, "EOS")))
    return F.concat(token_features(token), F.array(F.lit("bias")), mark(before, "-1:"), mark(before2, "-2:"), mark(after, "+1:"), mark(after2, "+2:"), edges)


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tok, token, features): the tokens of ``span_tokens`` with their ``sequence_features``,
    each out of its document's row; nothing is dealt out."""
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(SPANS), F.lit(0))
    # each token's own features are made once; a row takes its neighbours' along
    near = lambda own: F.transform(own, lambda x, i: F.struct(x["w"].alias("w"), x["f"].alias("f"), *(F.get(own, i + k)["f"].alias(f"n{j}") for j, k in enumerate((-1, -2, 1, 2)))))
    own = F.transform(words, lambda w: F.struct(w.alias("w"), token_features(w).alias("f")))
    rows = W.numbered(docs.select(id_col, X.let(own, near).alias("t")), [id_col], "t", "tok", "x").select(id_col, "tok", "x.*")
    mark = lambda c, p: F.when(F.col(c).isNull(), F.array().cast(STRINGS)).otherwise(F.transform(c, lambda f: F.concat(F.lit(p), f)))
    edges = F.array_compact(F.array(F.when(F.col("n0").isNull(), "BOS"), F.when(F.col("n2").isNull(), "EOS")))
    features = F.concat("f", F.array(F.lit("bias")), mark("n0", "-1:"), mark("n1", "-2:"), mark("n2", "+1:"), mark("n3", "+2:"), edges)
    return rows.select(id_col, "tok", F.col("w").alias("token"), features.alias("features"))


def missing_backend(name: str, needs: str):
    """A backend that this library does not bring: using it says what is missing."""

    def run(*_, **__):
        raise ImportError(f"backend {name!r} needs {needs}, which is not installed")

    return run
