"""Queries: sources, text functions, tokens."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from orthoflow import fixed_values as V
from orthoflow.catalog.inputs import *  # noqa: F403
from orthoflow.catalog.inputs import BENCH, LEX, LINES, TOK, VOC, q
from orthoflow.catalog.registry import query
from orthoflow.functions import paths as P
from orthoflow.functions import text as T
from orthoflow.operators import marking as M
from orthoflow.operators import tokens as K
from orthoflow.sources import units as U


def _sources(spark, sf):
    docs = documents(spark, sf).select(
        "doc_id", F.lit("body").alias("unit_kind"), F.lit(0).cast("bigint").alias("part_ix"), "text"
    )
    turns = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.lit("turn").alias("unit_kind"), F.col("turn").alias("part_ix"), "text"
    )
    items = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("doc_id"), F.lit("cell").alias("unit_kind"), F.lit(0).cast("bigint").alias("part_ix"), "text"
    )
    return [docs, turns, items]


SOURCES = """src AS (SELECT doc_id, 'body' AS unit_kind, 0::BIGINT AS part_ix, text FROM documents
  UNION ALL SELECT conv_id, 'turn', turn, text FROM conversations
  UNION ALL SELECT item_id, 'cell', 0, text FROM benchmark),
units AS (SELECT * FROM (SELECT doc_id, unit_kind, part_ix,
  (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INTEGER AS unit_ix,
  unnest(string_split(text, chr(10))) AS text FROM src) WHERE length(text) > 0)"""


@query(f"WITH {SOURCES} SELECT * FROM units")
def text_units(spark, sf):
    return U.text_units(_sources(spark, sf))


@query(f"""WITH {SOURCES} SELECT doc_id, unit_kind, text, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) = 0 AS blank
  FROM (SELECT doc_id, unit_kind, string_agg(text, chr(10) ORDER BY part_ix, unit_ix) AS text FROM units GROUP BY 1, 2)""")
def document_text(spark, sf):
    return U.document_text(U.text_units(_sources(spark, sf)), ["doc_id", "unit_kind"])


@query(f"""WITH {LINES}, p AS (SELECT doc_id, unit_ix AS para_ix, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM ln)
  SELECT doc_id, min(para_ix) AS para_ix, text FROM p WHERE length(text) > 0 GROUP BY doc_id, text""")
def paragraphs_from_runs(spark, sf):
    return U.paragraphs_from_runs(U.runs_from_units(lines(spark, sf)))


URL_HOST = f"regexp_extract(url, {q(P.URL_PARTS)}, 1)"


@query(f"""WITH p AS (SELECT {URL_HOST} AS doc_id, url AS part_name, min(CASE WHEN url NOT LIKE '%?%' THEN -page_id END) AS pos
    FROM pages GROUP BY 1, 2),
  u AS (SELECT *, count(pos) OVER (PARTITION BY doc_id) > 0 AS usable FROM p)
  SELECT doc_id, part_name, (row_number() OVER (PARTITION BY doc_id ORDER BY pos, part_name) - 1)::INTEGER AS place
  FROM u WHERE pos IS NOT NULL OR NOT usable""")
def ordered_parts(spark, sf):
    pages = table(spark, sf, "pages").select(
        F.regexp_extract("url", P.URL_PARTS, 1).alias("doc_id"), F.col("url").alias("part_name"), "page_id"
    )
    parts = pages.select("doc_id", "part_name").distinct()
    manifest = (
        pages.where(~F.contains("part_name", F.lit("?")))
        .groupBy("doc_id", "part_name")
        .agg(F.min(-F.col("page_id")).alias("position"))
    )
    return U.ordered_parts(parts, manifest)


@query("""WITH p AS (SELECT doc_id, 0::BIGINT AS part_ix, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents
    UNION ALL SELECT conv_id, turn + 1, regexp_replace(text, '^\\s+|\\s+$', '', 'g') FROM conversations),
  o AS (SELECT doc_id, text, min(part_ix) AS part_ix FROM p WHERE length(text) > 0 GROUP BY 1, 2)
  SELECT doc_id, string_agg(text, chr(10) ORDER BY part_ix) AS text FROM o GROUP BY 1""")
def merge_text_sources(spark, sf):
    docs, turns, _ = _sources(spark, sf)
    return U.merge_text_sources(
        docs.select("doc_id", "part_ix", "text").unionByName(
            turns.select("doc_id", (F.col("part_ix") + 1).alias("part_ix"), "text")
        )
    )


def file_names(spark, sf):
    """File name per document, in folder ``source``, with the extensions of all formats."""
    kinds = F.array(*[F.lit(k) for k in ("docx", "PDF", "odt", "png")])
    name = F.concat("source", F.lit("/documento_"), F.col("doc_id").cast("string"), F.lit("."))
    return documents(spark, sf).select(
        "doc_id", F.concat(name, F.element_at(kinds, (F.length("text") % 4 + 1).cast("int"))).alias("name")
    )


NAMES = """names AS (SELECT doc_id, source || '/documento_' || doc_id || '.' ||
  ['docx', 'PDF', 'odt', 'png'][length(text) % 4 + 1] AS name FROM documents)"""
CHECKED = ", ".join(f"'{f}'" for f in V.CHECKED_FORMATS)
UPLOADED = ", ".join(f"'{f}'" for f in V.UPLOAD_FORMATS)


@query(f"""WITH {NAMES}, e AS (SELECT doc_id, name, lower(regexp_extract(name, '\\.([^./]*)$', 1)) AS ext FROM names
    UNION ALL SELECT page_id, regexp_extract(url, {q(P.URL_PARTS)}, 2),
      lower(regexp_extract(regexp_extract(url, {q(P.URL_PARTS)}, 2), '\\.([^./]*)$', 1)) FROM pages)
  SELECT doc_id, name, ext IN ({CHECKED}) AS supported, NOT ext IN ({CHECKED}) AS omitted, ext IN ({UPLOADED}) AS uploadable FROM e""")
def supported_format(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), P.url_path("url").alias("name"))
    return file_names(spark, sf).unionByName(pages).select(
        "doc_id",
        "name",
        P.supported_format("name").alias("supported"),
        (~P.supported_format("name")).alias("omitted"),
        P.supported_format("name", V.UPLOAD_FORMATS).alias("uploadable"),
    )


@query("""SELECT source, count(*) AS files, count(*) FILTER (WHERE lang IN ('fr', 'es')
  AND regexp_matches(text, '[\\x{80}-\\x{ff}]')) AS repaired FROM documents GROUP BY 1""")
def encoding_audit(spark, sf):
    latin = F.col("lang").isin("fr", "es")
    content = F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return U.encoding_audit(documents(spark, sf).select("source", content.alias("content")))


@query(r"""SELECT doc_id, CASE WHEN lang IN ('fr', 'es') THEN regexp_replace(text, '[^\x{00}-\x{ff}]', '?', 'g') ELSE text END AS text
  FROM documents""")
def encoding_repair(spark, sf):
    latin = F.col("lang").isin("fr", "es")
    content = F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return documents(spark, sf).select("doc_id", U.repaired_text(content).alias("text"))


HTML = "html"
for _p in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
    HTML = f"regexp_replace({HTML}, {q(_p)}, ' ', 'g')"
for _e, _s in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    HTML = f"replace({HTML}, '{_e}', '{_s}')"


@query(f"""WITH t AS (SELECT page_id, trim(regexp_replace({HTML}, '\\s+', ' ', 'g')) AS text FROM pages)
  SELECT page_id, text, length(text) = 0 AS empty_content FROM t""")
def text_units_from_html(spark, sf):
    return U.text_units_from_html(table(spark, sf, "pages"))


# --- text functions ---------------------------------------------------------

@query(f"SELECT doc_id, {SCRUB} AS text FROM documents")
def scrub_non_lexical(spark, sf):
    return documents(spark, sf).select("doc_id", T.scrub_non_lexical("text").alias("text"))


@query(f"WITH {TOK} SELECT doc_id, pos, token, lower(token) AS key FROM tok")
def tokenize(spark, sf):
    return all_tokens(spark, sf, ["doc_id"])


@query(f"""WITH {TOK} SELECT DISTINCT token, {FOLD.format('token')} AS fold, {diacritic('token')} AS has_diacritic FROM tok""")
def fold_words(spark, sf):
    return all_tokens(spark, sf, ["doc_id"]).select("token").distinct().select(
        "token", T.fold("token").alias("fold"), T.has_diacritic("token").alias("has_diacritic")
    )


@query(f"""WITH {TOK}, n AS (SELECT doc_id, pos, {FOLD.format('token')} AS a,
    lead({FOLD.format('token')}) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM tok)
  SELECT doc_id, pos, levenshtein(a, b)::INTEGER AS distance, (CASE WHEN levenshtein(a, b) <= 2 THEN levenshtein(a, b) ELSE -1 END)::INTEGER AS near
  FROM n WHERE b IS NOT NULL""")
def edit_distance(spark, sf):
    docs = documents(spark, sf).select("doc_id", T.words(T.scrub_non_lexical("text")).alias("w"))
    folds = docs.select("doc_id", F.transform("w", T.fold).alias("w"))
    pairs = folds.select(
        "doc_id", F.posexplode_outer(F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"))).alias("pos", "p")
    ).where("p.b is not null")
    return pairs.select(
        "doc_id",
        "pos",
        T.edit_distance("p.a", "p.b").alias("distance"),
        T.edit_distance("p.a", "p.b", 2).alias("near"),
    )


@query(f"""WITH {TOK}, d AS (SELECT DISTINCT lang, token FROM tok)
  SELECT DISTINCT a.lang, a.token AS word, b.token AS suggestion FROM d a JOIN d b ON a.lang = b.lang
  AND {FOLD.format('a.token')} = {FOLD.format('b.token')} WHERE lower(a.token) <> lower(b.token)""")
def is_accent_only(spark, sf):
    d = all_tokens(spark, sf).select("lang", "token").distinct()
    a = d.select("lang", F.col("token").alias("word"), T.fold("token").alias("fold"))
    b = d.select("lang", F.col("token").alias("suggestion"), T.fold("token").alias("fold"))
    return a.join(b, ["lang", "fold"]).where(T.is_accent_only("word", "suggestion")).select("lang", "word", "suggestion")


@query(f"WITH {TOK} SELECT DISTINCT token, {name('token')} AS proper FROM tok")
def looks_like_proper_name(spark, sf):
    return all_tokens(spark, sf, ["doc_id"]).select("token").distinct().select(
        "token", T.looks_like_proper_name("token").alias("proper")
    )


IGNORE_WORDS = f"w AS (SELECT DISTINCT unnest(string_split_regex(text, '\\s+')) AS word FROM documents)"


@query(f"""WITH {IGNORE_WORDS} SELECT word, {ignored('word')} OR {name('word')} AS ignored, {ignored('word')} AS structural,
  {ignored('word', 1, 8)} AS older FROM w""")
def should_ignore(spark, sf):
    pieces = documents(spark, sf).select(F.explode_outer(F.split("text", r"\s+", -1)).alias("word")).distinct()
    return pieces.select(
        "word",
        T.should_ignore("word").alias("ignored"),
        T.should_ignore("word", proper_names=False).alias("structural"),
        T.should_ignore_older("word").alias("older"),
    )


@query(f"""WITH {TOK}, {LEX}, d AS (SELECT DISTINCT lang, token FROM tok)
  SELECT d.lang, d.token, CASE WHEN {upper('d.token')} THEN upper(l.word)
    WHEN {title('d.token')} THEN upper(l.word[1]) || l.word[2:] ELSE l.word END AS cased
  FROM d JOIN lex l ON l.lang = d.lang AND l.word = lower(d.token)""")
def match_case(spark, sf):
    d = all_tokens(spark, sf).select("lang", "token").distinct().withColumn("word", F.lower("token"))
    return d.join(lexicon(spark, sf), ["lang", "word"]).select("lang", "token", T.match_case("token", "word").alias("cased"))


@query(f"""WITH {TOK}, d AS (SELECT lang, {FOLD.format('token')} AS fold, min(lower(token)) AS word,
    list_sort(list(DISTINCT lower(token))) AS s FROM tok GROUP BY 1, 2)
  SELECT lang, fold, 'Error: "' || word || '".' || CASE WHEN len(s) > 1 THEN ' Sugerencias: ' || array_to_string(s[2:6], ', ') ELSE '' END AS comment FROM d""")
def comment_text(spark, sf):
    d = (
        all_tokens(spark, sf)
        .select("lang", "key").distinct()  # counts of a fixed width are added up before words are collected
        .groupBy("lang", T.fold("key").alias("fold"))
        .agg(F.sort_array(F.collect_list("key")).alias("s"))
    )
    return d.select("lang", "fold", T.comment_text(F.col("s")[0], F.slice("s", 2, 100)).alias("comment"))


@query("""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)
  SELECT doc_id, array_to_string(string_split(t, ' ')[1:6], ' ')[1:48] AS reason FROM f""")
def short_reason(spark, sf):
    return documents(spark, sf).select("doc_id", T.short_reason("text").alias("reason"))


@query(f"""WITH {BENCH}, b AS (SELECT DISTINCT lower(word) AS key FROM bench),
  r AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), {q(V.RUN)})) AS run FROM documents),
  k AS (SELECT doc_id, run AS key FROM r UNION SELECT doc_id, unnest(string_split(run, '''')) FROM r WHERE contains(run, ''''))
  SELECT DISTINCT key, doc_id FROM k WHERE key IN (SELECT key FROM b)""")
def contains_word(spark, sf):
    words = benchmark_words(spark, sf).select(F.lower("word").alias("key"))
    return M.documents_with_words(documents(spark, sf), words)


@query(f"""WITH w AS (SELECT DISTINCT unnest(string_split_regex(text, '[\\s.,;:()]+')) AS word FROM documents)
  SELECT word, {valid('word')} AS plain, {valid('word', 2, 60, V.LEXICON_WORD_HYPHEN)} AS hyphen,
  {valid('word', 2, 45, V.LEXICON_WORD_DIGITS)} AS digits, {valid('word', 2, 45, V.LOANWORD)} AS loanword FROM w""")
def valid_word(spark, sf):
    pieces = documents(spark, sf).select(F.explode_outer(F.split("text", r"[\s.,;:()]+", -1)).alias("word")).distinct()
    return pieces.select(
        "word",
        T.valid_word("word").alias("plain"),
        T.valid_word("word", 2, 60, hyphen=True).alias("hyphen"),
        T.valid_word("word", 2, 45, digits=True).alias("digits"),
        T.valid_loanword("word").alias("loanword"),
    )


@query(f"WITH {TOK} SELECT DISTINCT token, {english('token')} AS english FROM tok")
def looks_english(spark, sf):
    return all_tokens(spark, sf, ["doc_id"]).select("token").distinct().select("token", T.looks_english("token").alias("english"))


@query(f"""WITH {TOK} SELECT DISTINCT token, {bad('token')} AS bad, {bad('token', V.BAD_ENDINGS_LOANWORD, ())} AS bad_loanword FROM tok""")
def bad_unaccented(spark, sf):
    return all_tokens(spark, sf, ["doc_id"]).select("token").distinct().select(
        "token",
        T.bad_unaccented("token").alias("bad"),
        T.bad_unaccented("token", (), V.BAD_ENDINGS_LOANWORD).alias("bad_loanword"),
    )


@query("SELECT doc_id, text FROM documents")
def normalize_nfc(spark, sf):
    import unicodedata

    text = F.col("text")
    for letter in V.COMPOSED_LETTERS:
        text = F.replace(text, F.lit(letter), F.lit(unicodedata.normalize("NFD", letter)))
    return documents(spark, sf).select("doc_id", T.normalize_nfc(text).alias("text"))


# --- tokens -----------------------------------------------------------------

@query(f"WITH {TOK}, {VOC} SELECT doc_id, lang, key, token, first_pos, n FROM voc")
def document_vocabulary(spark, sf):
    return K.document_vocabulary(documents(spark, sf), ["doc_id", "lang"])


@query(f"WITH {TOK} SELECT lang, lower(token) AS key, arg_min(token, (doc_id, pos)) AS token, min(doc_id) AS doc_id FROM tok GROUP BY 1, 2")
def first_occurrence_dedupe(spark, sf):
    t = all_tokens(spark, sf)
    return K.first_occurrence_dedupe(t, ["lang", "key"], ["doc_id", "pos"]).select("lang", "key", "token", "doc_id")


@query(f"""WITH p AS (SELECT doc_id, (generate_subscripts(x, 1))::INTEGER AS i, unnest(x) AS piece FROM
    (SELECT doc_id, regexp_extract_all(text, {q(V.WORD + '|[^A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+')}) AS x FROM documents)),
  o AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM p)
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS pos, piece AS token,
    (e - length(piece))::BIGINT AS start_at, e::BIGINT AS end_at
  FROM o WHERE regexp_matches(piece, '^[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]')""")
def token_offsets(spark, sf):
    return K.token_offsets(documents(spark, sf), keep=["doc_id"])
