"""Inputs of the catalog queries, derived by Spark from the given tables, and the SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoflow import fixed_values as V
from orthoflow.functions.text import fold
from orthoflow.operators.lookup import lexicon_from_documents, out_of_lexicon
from orthoflow.operators.tokens import document_vocabulary, tokens
from orthoflow.plans.review import find_errors, judged_words
from orthoflow.session import cut


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark, sf):
    """The documents.  A setting can deal them anew: useful for one small file on many cores."""
    docs = table(spark, sf, "documents")
    parts = int(spark.conf.get("orthoflow.input.partitions", "0"))
    return docs.repartition(parts, "doc_id") if parts else docs


def all_tokens(spark, sf, keep=("doc_id", "lang")):
    return tokens(documents(spark, sf), list(keep))


def lexicon(spark, sf):
    """Words of each language that occur in three documents or more."""
    return cut(lexicon_from_documents(documents(spark, sf)), "words")


def errors(spark, sf):
    return find_errors(documents(spark, sf), lexicon(spark, sf))


def unknown_words(spark, sf):
    """Judged words of each document that the lexicon does not have."""
    vocabulary = document_vocabulary(documents(spark, sf), ["doc_id", "lang"])
    return out_of_lexicon(judged_words(vocabulary), lexicon(spark, sf))


def unknown_tokens(spark, sf):
    """The distinct (lang, token) of :func:`unknown_words`, stored: each is looked up once, not once per document."""
    vocabulary = document_vocabulary(documents(spark, sf), ["doc_id", "lang"])
    return cut(out_of_lexicon(judged_words(vocabulary).select("lang", "token").distinct(), lexicon(spark, sf)), "unknown")


def vocabulary_words(spark, sf):
    """Distinct lower-case words per language as package, (pkg, word)."""
    return all_tokens(spark, sf).select(F.col("lang").alias("pkg"), F.col("key").alias("word")).distinct()


def cased_words(spark, sf):
    """Distinct words as written per language, (pkg, word)."""
    return all_tokens(spark, sf).select(F.col("lang").alias("pkg"), F.col("token").alias("word")).distinct()


def stored_words(spark, sf):
    """:func:`cased_words`, stored: for queries that read them several times, each of which would read all texts anew."""
    return cut(cased_words(spark, sf), "cased")


def benchmark_words(spark, sf):
    from orthoflow.functions.text import words

    return (
        table(spark, sf, "benchmark")
        .select(F.explode_outer(words("text")).alias("word"))
        .where("word is not null")
        .distinct()
    )


def lines(spark, sf):
    """Non-empty lines of the documents: (doc_id, lang, unit_ix, text)."""
    return (
        documents(spark, sf)
        .select("doc_id", "lang", F.posexplode_outer(F.split("text", "\n", -1)).alias("unit_ix", "text"))
        .where(F.length("text") > 0)
    )


# --- the same inputs in SQL -------------------------------------------------

def q(pattern: str) -> str:
    return f"$r${pattern}$r$"


SCRUB = (
    f"regexp_replace(regexp_replace(regexp_replace(text, {q(V.MAILTO[5:])}, ' ', 'gi'), "
    f"{q(V.EMAIL[5:])}, ' ', 'gi'), {q(V.URL[5:])}, ' ', 'gi')"
)
FOLD = "strip_accents(lower({0}))"


def title(x):
    return f"regexp_matches({x}, {q(V.TITLE_WORD)})"


def upper(x):
    return f"regexp_matches({x}, {q(V.UPPER_WORD)})"


def diacritic(x):
    return f"regexp_matches({x}, {q(V.DIACRITIC)})"


def name(x):
    return (
        f"(length({x}) >= 2 AND ({title(x)} OR regexp_matches({x}, {q(V.APOSTROPHE_NAME)}) "
        f"OR (length({x}) >= 4 AND regexp_matches({x}, {q(V.MIXED_NAME)}))))"
    )


def ignored(x, low=2, high=12):
    return (
        f"(length({x}) = 0 OR ({upper(x)} AND length({x}) BETWEEN {low} AND {high}) "
        f"OR regexp_matches({x}, {q(V.NUMBER_WORD)}) OR regexp_matches(lower({x}), {q(V.ADDRESS_WORD)}) "
        f"OR regexp_matches({x}, {q(V.ACRONYM)}))"
    )


def bad(x, endings=V.BAD_ENDINGS, exact=V.BAD_EXACT):
    listed = ", ".join(f"'{w}'" for w in exact)
    hit = f"regexp_matches(lower({x}), {q('(' + '|'.join(endings) + ')$')})"
    if exact:
        hit = f"(lower({x}) IN ({listed}) OR {hit})"
    return f"(NOT {diacritic(x)} AND {hit})"


def english(x):
    listed = ", ".join(f"'{w}'" for w in V.ENGLISH_WORDS)
    return f"(lower({x}) IN ({listed}) OR regexp_matches(lower({x}), {q('(' + '|'.join(V.ENGLISH_ENDINGS) + ')$')}))"


def valid(x, low=3, high=45, pattern=V.LEXICON_WORD):
    return f"(length(trim({x})) BETWEEN {low} AND {high} AND regexp_matches(trim({x}), {q(pattern)}))"


TOK = f"""tok AS (SELECT doc_id, lang, source, unnest(w) AS token, (generate_subscripts(w, 1) - 1)::INTEGER AS pos
  FROM (SELECT doc_id, lang, source, regexp_extract_all({SCRUB}, {q(V.WORD)}) AS w FROM documents))"""
VOC = """voc AS (SELECT doc_id, lang, lower(token) AS key, arg_min(token, pos) AS token, min(pos) AS first_pos,
  count(*)::INTEGER AS n FROM tok GROUP BY doc_id, lang, lower(token))"""
LEX = """lex AS (SELECT lang, lower(token) AS word, count(DISTINCT doc_id) AS df FROM tok GROUP BY 1, 2
  HAVING count(DISTINCT doc_id) >= 3)"""


def known(v):
    return (
        f"(EXISTS (SELECT 1 FROM lex k WHERE k.lang = {v}.lang AND k.word = {v}.token) OR "
        f"(({title(v + '.token')} OR {upper(v + '.token')}) AND "
        f"EXISTS (SELECT 1 FROM lex k WHERE k.lang = {v}.lang AND k.word = lower({v}.token))))"
    )


def unknown_cte(source="voc", name_="unk"):
    return f"""{name_} AS (SELECT v.* FROM {source} v WHERE length(v.token) >= 3 AND NOT {ignored('v.token')}
  AND NOT {known('v')})"""


# letters of a word as bits: two words within two edits differ in at most four bits
MASK = "list_aggregate([1::BIGINT << (ascii(c) % 63) for c in string_split({0}, '')], 'bit_or')"
CANDIDATES = f"""folds AS (SELECT *, length(fold) + unnest([-2, -1, 0, 1, 2]) AS m, {MASK.format('fold')} AS mask FROM (SELECT DISTINCT lang, strip_accents(lower(token)) AS fold FROM unk)),
lexf AS (SELECT *, length(wf) AS m, {MASK.format('wf')} AS mask FROM (SELECT lang, word, df, strip_accents(word) AS wf FROM lex)),
cand AS (SELECT * FROM (SELECT f.lang, f.fold, l.word AS suggestion, l.df, levenshtein(f.fold, l.wf)::INTEGER AS dist
  FROM folds f JOIN lexf l ON f.lang = l.lang AND f.m = l.m
  AND bit_count(xor(f.mask, l.mask)) <= 4) WHERE dist <= 2),
rk AS (SELECT w.lang, w.token, c.suggestion, c.dist, (c.dist = 0 AND lower(w.token) <> lower(c.suggestion)) AS acc,
  row_number() OVER (PARTITION BY w.lang, w.token
    ORDER BY (c.dist = 0 AND lower(w.token) <> lower(c.suggestion)) DESC, c.dist, c.df DESC, c.suggestion) AS rn
  FROM (SELECT DISTINCT lang, token, strip_accents(lower(token)) AS fold FROM unk) w
  JOIN cand c ON c.lang = w.lang AND c.fold = w.fold),
ver AS (SELECT lang, token, CASE WHEN bool_or(acc) THEN 'tilde' ELSE 'ortografia' END AS kind,
  string_agg(suggestion, ',' ORDER BY rn) FILTER (WHERE rn <= 5) AS suggestions, arg_min(suggestion, rn) AS best
  FROM rk GROUP BY 1, 2)"""
ERR = f"""err AS (SELECT u.*, ver.kind, ver.suggestions, ver.best FROM unk u JOIN ver
  ON ver.lang = u.lang AND ver.token = u.token WHERE ver.kind = 'tilde' OR NOT {name('u.token')})"""
UNKNOWN = f"{TOK}, {VOC}, {LEX}, {unknown_cte()}"
ERRORS = f"{UNKNOWN}, {CANDIDATES}, {ERR}"
PIECES = q(V.PIECE)
LINES = """ln AS (SELECT doc_id, lang, (i - 1)::INTEGER AS unit_ix, text FROM (SELECT doc_id, lang,
  unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents) WHERE length(text) > 0)"""
PKG = "pkg AS (SELECT DISTINCT lang AS pkg, lower(token) AS word FROM tok)"
CASED = "cased AS (SELECT DISTINCT lang AS pkg, token AS word FROM tok)"
BENCH = f"bench AS (SELECT DISTINCT unnest(regexp_extract_all(text, {q(V.WORD)})) AS word FROM benchmark)"
