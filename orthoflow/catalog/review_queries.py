"""Queries: lexicon lookups, review of documents, marking, corrections, second opinion."""

from pyspark.sql import functions as F

from orthoflow import fixed_values as V
from orthoflow.catalog.inputs import *  # noqa: F403
from orthoflow.catalog.inputs import (
    BENCH, CANDIDATES, ERR, ERRORS, FOLD, LEX, LINES, MASK, PIECES, TOK, UNKNOWN, VOC, known, name, q, title,
    unknown_cte, upper,
)
from orthoflow.catalog.registry import query
from orthoflow.functions import paths as P
from orthoflow.functions import text as T
from orthoflow.operators import lookup as J
from orthoflow.operators import marking as M
from orthoflow.operators import records as R
from orthoflow.operators import verdicts as D
from orthoflow.operators.prefilter import key_filter
from orthoflow.operators.tokens import token_offsets as offsets_of
from orthoflow.plans import review as Q
from orthoflow.sources import units as U


def _joined(column="suggestions"):
    return F.array_join(column, ",").alias(column)


# --- lookups ----------------------------------------------------------------

@query(f"WITH {UNKNOWN} SELECT doc_id, lang, key, token, first_pos, n FROM unk")
def out_of_lexicon(spark, sf):
    return unknown_words(spark, sf)


@query(f"""WITH {TOK}, {LEX}, t AS (SELECT DISTINCT lang, token FROM tok),
  e AS (SELECT DISTINCT word FROM lex WHERE lang IN ('es', 'en'))
  SELECT lang, token FROM t WHERE token IN (SELECT word FROM e)
    OR (({title('token')} OR {upper('token')}) AND lower(token) IN (SELECT word FROM e))""")
def valid_in_any(spark, sf):
    return J.valid_in_any(all_tokens(spark, sf).select("lang", "token").distinct(), lexicon(spark, sf), ["es", "en"])


@query(f"""WITH {TOK}, {LEX}, t AS (SELECT DISTINCT lang, token FROM tok)
  SELECT t.lang, t.token, {FOLD.format('t.token')} AS fold, l.word AS suggestion, l.df FROM t JOIN lex l
  ON l.lang = t.lang AND {FOLD.format('t.token')} = {FOLD.format('l.word')} WHERE lower(t.token) <> l.word""")
def accent_candidates(spark, sf):
    return J.accent_candidates(all_tokens(spark, sf).select("lang", "token").distinct(), lexicon(spark, sf))


@query(f"WITH {UNKNOWN}, {CANDIDATES} SELECT lang, fold, suggestion, df, dist FROM cand")
def near_candidates(spark, sf):
    folds = unknown_tokens(spark, sf).select("lang", T.fold("token").alias("fold")).distinct()
    return J.near_candidates(folds, lexicon(spark, sf)).select("lang", "fold", "suggestion", "df", "dist")


@query(f"WITH {UNKNOWN}, {CANDIDATES} SELECT lang, token, kind FROM ver")
def classify(spark, sf):
    words = unknown_tokens(spark, sf)
    near = J.best_candidates(words.select("lang", T.fold("token").alias("fold")).distinct(), lexicon(spark, sf), 6)
    return J.classify(words, near).select("lang", "token", "kind")


@query(f"WITH {UNKNOWN}, {CANDIDATES} SELECT lang, token, suggestions FROM ver")
def top_suggestions(spark, sf):
    words = unknown_tokens(spark, sf).withColumn("fold", T.fold("token"))
    near = J.near_candidates(words.select("lang", "fold").distinct(), lexicon(spark, sf))
    pairs = words.join(near, ["lang", "fold"]).withColumn(
        "accent", (F.col("dist") == 0) & (F.lower("token") != F.lower("suggestion"))
    )
    order = [F.desc("accent"), "dist", F.desc("df"), "suggestion"]
    return J.top_suggestions(pairs, ["lang", "token"], order).select("lang", "token", _joined())


TWO = f"""es AS (SELECT word, max(df) AS df FROM lex WHERE lang = 'es' GROUP BY 1),
en AS (SELECT word, max(df) AS df FROM lex WHERE lang = 'en' GROUP BY 1),
both2 AS (SELECT 'main' AS g, word, df FROM es UNION ALL SELECT 'other', word, df FROM en),
w2 AS (SELECT DISTINCT token, {FOLD.format('token')} AS fold FROM tok t WHERE lang IN ('es', 'en')
  AND NOT (length(token) = 0 OR ({upper('token')} AND length(token) <= 8)
    OR regexp_matches(token, {q(V.ACRONYM)})) AND token NOT IN (SELECT word FROM both2)
  AND NOT (({title('token')} OR {upper('token')}) AND lower(token) IN (SELECT word FROM both2))),
b2 AS (SELECT *, length(wf) AS m, {MASK.format('wf')} AS mask FROM (SELECT *, strip_accents(word) AS wf FROM both2)),
f2 AS (SELECT *, length(fold) + unnest([-2, -1, 0, 1, 2]) AS m, {MASK.format('fold')} AS mask FROM (SELECT DISTINCT fold FROM w2)),
c2 AS (SELECT * FROM (SELECT f2.fold, b2.g, b2.word, b2.df, levenshtein(f2.fold, b2.wf) AS dist FROM f2 JOIN b2
  ON f2.m = b2.m AND bit_count(xor(f2.mask, b2.mask)) <= 4) WHERE dist <= 2),
p2 AS (SELECT w2.token, c2.g, c2.word, c2.dist, (c2.dist = 0 AND lower(w2.token) <> c2.word) AS acc,
  row_number() OVER (PARTITION BY w2.token, c2.word ORDER BY c2.g) AS once,
  row_number() OVER (PARTITION BY w2.token, c2.g ORDER BY c2.dist, c2.df DESC, c2.word) AS place
  FROM w2 JOIN c2 USING (fold)),
k2 AS (SELECT token, CASE WHEN bool_or(acc) THEN 'tilde' WHEN min(dist) FILTER (g = 'main') <= 2 THEN 'ortografia' END AS kind
  FROM p2 GROUP BY 1),
s2 AS (SELECT token, word, row_number() OVER (PARTITION BY token ORDER BY g, acc DESC, place) AS rn FROM p2 WHERE once = 1)"""


@query(f"""WITH {TOK}, {LEX}, {TWO} SELECT k2.token, k2.kind,
  (SELECT string_agg(word, ',' ORDER BY rn) FROM s2 WHERE s2.token = k2.token AND rn <= 5) AS suggestions
  FROM k2 WHERE kind IS NOT NULL""")
def check_words_two_languages(spark, sf):
    words = all_tokens(spark, sf).where(F.col("lang").isin("es", "en")).select("token").distinct()
    return Q.check_words_two_languages(words, lexicon(spark, sf), ["es"], ["en"]).select("token", "kind", _joined())


@query(f"WITH {TOK}, {LEX}, {TWO} SELECT token, kind FROM k2 WHERE kind IS NOT NULL")
def classify_two_languages(spark, sf):
    words = all_tokens(spark, sf).where(F.col("lang").isin("es", "en")).select("token").distinct()
    return Q.check_words_two_languages(words, lexicon(spark, sf), ["es"], ["en"]).select("token", "kind")


# --- review -----------------------------------------------------------------

@query(f"""WITH {UNKNOWN}, {CANDIDATES} SELECT lang, token, kind, suggestions FROM ver WHERE kind = 'tilde' OR NOT {name('token')}""")
def check_words(spark, sf):
    words = unknown_tokens(spark, sf)
    return Q.check_words(words, lexicon(spark, sf)).select("lang", "token", "kind", _joined())


@query(f"WITH {ERRORS} SELECT doc_id, lang, first_pos, key, token, kind, suggestions FROM err")
def find_errors(spark, sf):
    return errors(spark, sf).select("doc_id", "lang", "first_pos", "key", "token", "kind", _joined())


RESULTS = """res AS (SELECT d.doc_id, d.source, length(regexp_replace(d.text, '\\s+', '', 'g')) > 0 AS ok, count(e.key) > 0 AS has_errors,
  count(e.key)::INTEGER AS total_errors,
  coalesce(string_agg(e.token || ':' || e.kind || ':' || e.suggestions, ';' ORDER BY e.first_pos), '') AS errors
  FROM documents d LEFT JOIN err e USING (doc_id) GROUP BY d.doc_id, d.source, d.text)"""


def _flat(results):
    one = lambda e: F.concat_ws(":", e["token"], e["kind"], F.array_join(e["suggestions"], ","))
    return results.withColumn("errors", F.array_join(F.transform("errors", one), ";"))


@query(f"WITH {ERRORS}, {RESULTS} SELECT doc_id, ok, has_errors, total_errors, errors FROM res")
def document_results(spark, sf):
    results = Q.document_results(documents(spark, sf), errors(spark, sf))
    return _flat(results).select("doc_id", "ok", "has_errors", "total_errors", "errors")


TOP = """c AS (SELECT d.source, e.key, count(*) AS documents FROM err e JOIN documents d USING (doc_id) GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY documents DESC, key)::INTEGER AS place FROM c)"""


@query(f"WITH {ERRORS}, {TOP} SELECT source, key, documents, place FROM top WHERE place <= 100")
def top_marked_words(spark, sf):
    found = errors(spark, sf).join(documents(spark, sf).select("doc_id", "source"), "doc_id")
    return Q.top_marked_words(found, ["source"])


@query(f"""WITH {ERRORS}, {TOP}, {BENCH}, b AS (SELECT DISTINCT lower(word) AS key FROM bench)
  SELECT source, key, documents, place, CASE WHEN key NOT IN (SELECT key FROM b) THEN 'open'
    WHEN length(key) % 2 = 0 THEN 'deny' ELSE 'add' END AS decision FROM top WHERE place <= 100""")
def word_telemetry(spark, sf):
    """Words of the benchmark were added first; those of even length were denied later."""
    found = errors(spark, sf).join(documents(spark, sf).select("doc_id", "source"), "doc_id")
    bench = benchmark_words(spark, sf)
    added = bench.select("word", F.lit("add").alias("decision"), F.lit(1).alias("ts"))
    denied = bench.where(F.length("word") % 2 == 0).select("word", F.lit("deny").alias("decision"), F.lit(2).alias("ts"))
    return Q.word_telemetry(found, added.unionByName(denied), ["source"])


@query(f"""WITH {ERRORS} SELECT doc_id, lower(token) AS key, arg_min(token, first_pos) AS token, min(first_pos) AS first_pos
  FROM err GROUP BY 1, 2""")
def error_word_list(spark, sf):
    return M.error_word_list(errors(spark, sf))


# --- marking ----------------------------------------------------------------

HITS = f"""p AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS piece FROM
    (SELECT doc_id, regexp_extract_all(text, {PIECES}) AS x FROM documents)),
o AS (SELECT doc_id, i, piece, lower(piece) AS low,
  (sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) - length(piece)) AS s FROM p),
sub AS (SELECT doc_id, i, low AS key, s AS a, s + length(piece) AS b FROM o WHERE regexp_matches(piece, {q(r'^[\p{L}\p{N}_]')})
  UNION ALL SELECT doc_id, i, split_part(low, '''', 1), s, s + length(split_part(low, '''', 1)) FROM o WHERE regexp_matches(piece, {q("^[^']+'.")}) AND regexp_matches(piece, {q(r'^[\p{L}\p{N}_]')})
  UNION ALL SELECT doc_id, i, split_part(low, '''', 2), s + length(split_part(low, '''', 1)) + 1, s + length(piece) FROM o WHERE regexp_matches(piece, {q("^[^']+'.")}) AND regexp_matches(piece, {q(r'^[\p{L}\p{N}_]')})),
hit AS (SELECT DISTINCT sub.doc_id, sub.i, sub.key, a::INTEGER AS start_at, b::INTEGER AS end_at FROM sub JOIN err
  ON err.doc_id = sub.doc_id AND err.key = sub.key)"""


@query(f"WITH {ERRORS}, {HITS} SELECT doc_id, key, start_at, end_at FROM hit")
def mark_occurrences(spark, sf):
    return M.mark_occurrences(documents(spark, sf), errors(spark, sf))


@query(f"WITH {ERRORS}, {HITS} SELECT doc_id, key, count(*) AS marks FROM hit GROUP BY 1, 2")
def mark_counts(spark, sf):
    return M.mark_counts(M.mark_occurrences(documents(spark, sf), errors(spark, sf)))


@query(f"""WITH {ERRORS}, {HITS}, m AS (SELECT o.doc_id, o.i, CASE
    WHEN EXISTS (SELECT 1 FROM err e WHERE e.doc_id = o.doc_id AND e.key = o.low) THEN '[[' || o.piece || ']]'
    WHEN contains(o.piece, '''') AND regexp_matches(o.piece, {q(r'^[\p{L}\p{N}_]')}) THEN
      (CASE WHEN EXISTS (SELECT 1 FROM err e WHERE e.doc_id = o.doc_id AND e.key = split_part(o.low, '''', 1))
        THEN '[[' || split_part(o.piece, '''', 1) || ']]' ELSE split_part(o.piece, '''', 1) END) || '''' ||
      (CASE WHEN EXISTS (SELECT 1 FROM err e WHERE e.doc_id = o.doc_id AND e.key = split_part(o.low, '''', 2))
        THEN '[[' || split_part(o.piece, '''', 2) || ']]' ELSE split_part(o.piece, '''', 2) END)
    ELSE o.piece END AS t FROM o)
  SELECT doc_id, string_agg(t, '' ORDER BY i) AS text FROM m GROUP BY 1""")
def highlight_text(spark, sf):
    return M.highlight_text(documents(spark, sf), errors(spark, sf))


UNIT_HITS = f"""r AS (SELECT doc_id, unit_ix, unnest(regexp_extract_all(lower(text), {q(V.RUN)})) AS run FROM ln),
uk AS (SELECT doc_id, unit_ix, run AS key FROM r UNION SELECT doc_id, unit_ix, unnest(string_split(run, '''')) FROM r WHERE contains(run, '''')),
uh AS (SELECT uk.doc_id, uk.unit_ix, e.key, e.token, e.first_pos, e.suggestions FROM uk JOIN err e ON e.doc_id = uk.doc_id AND e.key = uk.key)"""


@query(f"WITH {ERRORS}, {LINES}, {UNIT_HITS} SELECT doc_id, unit_ix, key FROM uh")
def errors_per_unit(spark, sf):
    units = lines(spark, sf).drop("lang")
    found = M.errors_per_unit(units, errors(spark, sf))
    return found.select("doc_id", "unit_ix", F.explode("found").alias("f")).select("doc_id", "unit_ix", F.col("f.key").alias("key"))


@query(f"""WITH {ERRORS}, {LINES}, {UNIT_HITS} SELECT doc_id, unit_ix, count(*)::INTEGER AS errors,
  string_agg('Error: "' || token || '". Sugerencias: ' || replace(suggestions, ',', ', '), chr(10) ORDER BY first_pos) AS comment
  FROM uh GROUP BY 1, 2""")
def unit_comments(spark, sf):
    return M.unit_comments(lines(spark, sf).drop("lang"), errors(spark, sf))


# the word that an error takes in a unit: itself, or the only longer word that begins with it
TAKEN = """CASE WHEN list_contains(acc.used, x.key) THEN NULL WHEN list_contains(ks, x.key) THEN x.key
    WHEN length(x.key) >= 4 AND len(list_filter(ks, lambda w: starts_with(w, x.key) AND length(w) > length(x.key)
      AND NOT list_contains(acc.used, w))) = 1
    THEN list_filter(ks, lambda w: starts_with(w, x.key) AND length(w) > length(x.key) AND NOT list_contains(acc.used, w))[1] END"""


@query(f"""WITH {ERRORS}, {LINES},
  u AS (SELECT doc_id, unit_ix, words, list_transform(words, lambda w: lower(w)) AS lows, list_distinct(list_transform(words, lambda w: lower(w))) AS ks
    FROM (SELECT doc_id, unit_ix, list_reverse(regexp_extract_all(text, '[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+')) AS words FROM ln)),
  e AS (SELECT doc_id, list({{'used': []::VARCHAR[], 'picked': []::VARCHAR[], 'key': key}} ORDER BY first_pos) AS es FROM err GROUP BY 1),
  f AS (SELECT doc_id, unit_ix, list_reduce(list_filter(es, lambda x: len(list_filter(ks, lambda w: starts_with(w, x.key))) > 0), lambda acc, x: (
    {{'used': CASE WHEN {TAKEN} IS NULL THEN acc.used ELSE list_append(acc.used, {TAKEN}) END,
      'picked': CASE WHEN {TAKEN} IS NULL THEN acc.picked ELSE list_append(acc.picked, words[list_position(lows, {TAKEN})]) END, 'key': x.key}}), {{'used': []::VARCHAR[], 'picked': []::VARCHAR[], 'key': ''}}) AS r FROM u JOIN e USING (doc_id))
  SELECT doc_id, unit_ix, array_to_string(r.picked, ',') AS highlight FROM f WHERE len(r.picked) > 0""")
def unit_highlight_words(spark, sf):
    found = M.unit_highlight_words(lines(spark, sf).drop("lang"), errors(spark, sf))
    return found.select("doc_id", "unit_ix", F.array_join("highlight", ",").alias("highlight"))


@query(f"""WITH {UNKNOWN}, {LINES},
  lp AS (SELECT doc_id, lang, unit_ix AS para_ix, generate_subscripts(x, 1) AS i, unnest(x) AS piece FROM
    (SELECT doc_id, lang, unit_ix, regexp_extract_all(text, {q(V.WORD + '|[^A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+')}) AS x FROM ln)),
  lo AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id, para_ix ORDER BY i) AS e FROM lp),
  span AS (SELECT lo.doc_id, para_ix, piece AS token, (e - length(piece))::BIGINT AS start_at, e::BIGINT AS end_at FROM lo
    WHERE EXISTS (SELECT 1 FROM unk u WHERE u.doc_id = lo.doc_id AND u.key = lower(lo.piece))),
  run AS (SELECT doc_id, unit_ix AS para_ix, unnest(range(0, length(text), 7)) AS rs, text, length(text) AS len FROM ln),
  hit AS (SELECT span.*, (rs // 7)::INTEGER AS run_ix, rs, least(rs + 7, len) AS re, text FROM span JOIN run USING (doc_id, para_ix)
    WHERE start_at < least(rs + 7, len) AND end_at > rs),
  n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, para_ix, start_at, end_at) AS runs FROM hit)
  SELECT doc_id, para_ix, token, start_at, end_at, run_ix, runs,
    CASE WHEN runs > 6 THEN 'left_alone' WHEN start_at <= rs AND end_at >= re THEN 'whole' WHEN start_at >= rs AND end_at <= re THEN 'inside' ELSE 'crossed' END AS cover,
    text[rs + 1:greatest(start_at, rs)] AS before, text[greatest(start_at, rs) + 1:least(end_at, re)] AS middle,
    text[least(end_at, re) + 1:re] AS after FROM n""")
def runs_of_error(spark, sf):
    paragraphs = lines(spark, sf).withColumnRenamed("unit_ix", "para_ix")
    # a paragraph is the document of its own offsets
    spans = offsets_of(
        paragraphs.select(F.struct("doc_id", "para_ix").alias("doc_id"), "text"), keep=["doc_id"]
    ).select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.para_ix").alias("para_ix"), "token", "start_at", "end_at")
    unknown = cut(unknown_words(spark, sf).select("doc_id", "key"), "unknown")
    # words that are unknown in no document leave next to the scan
    spans = key_filter(unknown).keep(spans.withColumn("key", F.lower("token")), "key")
    spans = spans.join(unknown, ["doc_id", "key"], "left_semi").drop("key")
    return M.runs_of_error(spans, U.runs_from_units(lines(spark, sf)))


STATS = """st AS (SELECT doc_id, unit_ix, count(*) AS n, min(key) AS first FROM uh GROUP BY 1, 2)"""


@query(f"""WITH {ERRORS}, {LINES}, {UNIT_HITS}, {STATS} SELECT doc_id, sum(n)::BIGINT AS highlighted, count(*)::BIGINT AS comments,
  sum(CASE WHEN n > 3 THEN 1 ELSE 0 END)::BIGINT AS failed_comments,
  coalesce(arg_min(CASE WHEN n > 1 THEN 'note_' || n END, unit_ix) FILTER (n > 1), '') AS strategy,
  coalesce(string_agg(first, ',' ORDER BY unit_ix) FILTER (n > 3), '') AS failures FROM st GROUP BY 1""")
def merge_mark_stats(spark, sf):
    found = M.errors_per_unit(lines(spark, sf).drop("lang"), errors(spark, sf))
    n = F.size("found")
    stats = found.select(
        "doc_id",
        F.col("unit_ix").alias("part_ix"),
        n.cast("bigint").alias("highlighted"),
        F.lit(1).cast("bigint").alias("comments"),
        F.when(n > 3, 1).otherwise(0).cast("bigint").alias("failed_comments"),
        F.when(n > 1, F.concat(F.lit("note_"), n.cast("string"))).otherwise("").alias("strategy"),
        F.when(n > 3, F.array(F.array_min(F.transform("found", lambda e: e["key"])))).otherwise(F.array().cast("array<string>")).alias("failures"),
    )
    return M.merge_mark_stats(stats).withColumn("failures", F.array_join("failures", ","))


# --- corrections ------------------------------------------------------------

CORR = f"""voc AS (SELECT doc_id, lang, token, lower(token) AS key, min(pos) AS first_pos FROM tok GROUP BY 1, 2, 3)"""
FIXED = f"""{TOK}, {CORR}, {LEX}, {unknown_cte()}, {CANDIDATES}, {ERR},
cx AS (SELECT doc_id, token AS original, CASE WHEN {upper('token')} THEN upper(best)
  WHEN {title('token')} THEN upper(best[1]) || best[2:] ELSE best END AS replacement FROM err),
corr AS MATERIALIZED (SELECT * FROM cx WHERE original <> replacement)"""


@query(f"WITH {FIXED} SELECT doc_id, original, replacement FROM corr")
def collect_corrections(spark, sf):
    return Q.collect_corrections(documents(spark, sf), lexicon(spark, sf))


@query(f"""WITH {FIXED}, p AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS piece FROM
    (SELECT doc_id, regexp_extract_all(text, {PIECES}) AS x FROM documents)),
  a AS (SELECT p.*, w.replacement AS w, l.replacement AS l, r.replacement AS r FROM p
    LEFT JOIN corr w ON w.doc_id = p.doc_id AND w.original = p.piece
    LEFT JOIN corr l ON l.doc_id = p.doc_id AND contains(p.piece, '''') AND regexp_matches(p.piece, {q(r'^[\p{L}\p{N}_]')}) AND l.original = split_part(p.piece, '''', 1)
    LEFT JOIN corr r ON r.doc_id = p.doc_id AND contains(p.piece, '''') AND regexp_matches(p.piece, {q(r'^[\p{L}\p{N}_]')}) AND r.original = split_part(p.piece, '''', 2))
  SELECT doc_id, string_agg(coalesce(w, CASE WHEN l IS NOT NULL OR r IS NOT NULL THEN
    coalesce(l, split_part(piece, '''', 1)) || '''' || coalesce(r, split_part(piece, '''', 2)) END, piece), '' ORDER BY i) AS text FROM a GROUP BY 1""")
def apply_corrections(spark, sf):
    return M.apply_corrections(documents(spark, sf), Q.collect_corrections(documents(spark, sf), lexicon(spark, sf)))


@query(f"""WITH {TOK}, {VOC}, corr AS (SELECT doc_id, key AS original, key[:-2] AS replacement FROM voc WHERE length(key) >= 3)
  SELECT a.doc_id, a.original, a.replacement, b.replacement AS "then" FROM corr a JOIN corr b
  ON a.doc_id = b.doc_id AND b.original = a.replacement""")
def correction_chains(spark, sf):
    """A table of fixes takes the last letter off each word, and some results are words that are fixed too."""
    keys = F.array_distinct(F.transform(T.words(T.scrub_non_lexical("text")), F.lower))
    words = documents(spark, sf).select("doc_id", F.explode_outer(keys).alias("word")).where(F.length("word") >= 3)
    words = cut(words, "words")
    fixes = cut(words.select("word").distinct().withColumn("fixed", F.expr("left(word, length(word) - 1)")), "fixes")
    corrections = words.join(fixes, "word").select(
        "doc_id", F.col("word").alias("original"), F.col("fixed").alias("replacement")
    )
    return M.correction_chains(cut(corrections, "corrections"))


@query(f"WITH {FIXED} SELECT doc_id, original, replacement FROM corr ORDER BY length(original) DESC, original")
def longest_first(spark, sf):
    return M.longest_first(Q.collect_corrections(documents(spark, sf), lexicon(spark, sf)))


# --- second opinion ---------------------------------------------------------

def candidates(spark, sf):
    return errors(spark, sf).select("doc_id", "first_pos", "key", "token", "kind", "suggestions")


def verdict_rows(spark, sf, found):
    """A verdict per candidate of the labelled documents; an earlier, opposite one is replaced."""
    labelled = found.join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id",
        F.col("token").alias("word"),
        (F.col("toxic") == 1).alias("is_error"),
        F.when(F.col("toxic") == 1, F.concat(F.lit("typo  claro en "), "key")).otherwise("palabra valida").alias("reason"),
        F.lit(2).cast("bigint").alias("arrival"),
    )
    first = labelled.withColumn("is_error", ~F.col("is_error")).withColumn("arrival", F.lit(1).cast("bigint"))
    return labelled.unionByName(first)


DECIDED = """dec AS (SELECT e.doc_id, e.first_pos, e.key, e.token, coalesce(l.toxic = 1, false) AS confirmed,
  CASE WHEN l.doc_id IS NULL THEN 'sin respuesta' WHEN l.toxic = 1 THEN ('typo claro en ' || e.key)[1:48] ELSE 'palabra valida' END AS reason,
  coalesce(l.quality = 0, false) AS fallback FROM err e LEFT JOIN labels l USING (doc_id))"""
LAYERED = f"""{DECIDED}, lay AS (SELECT doc_id, first_pos, key, token, confirmed OR fallback AS confirmed,
  CASE WHEN NOT fallback THEN reason END AS reason, fallback FROM dec)"""


def layered(spark, sf):
    found = cut(candidates(spark, sf), "candidates")
    failed = table(spark, sf, "labels").where("quality = 0")
    return D.second_layer(found, verdict_rows(spark, sf, found), failed), found


@query(f"""WITH {ERRORS} SELECT doc_id, key, (row_number() OVER (PARTITION BY doc_id ORDER BY first_pos) - 1)::INTEGER AS place,
  ((row_number() OVER (PARTITION BY doc_id ORDER BY first_pos) - 1) // 40)::INTEGER AS batch FROM err""")
def batches(spark, sf):
    return D.batches(candidates(spark, sf), ["doc_id"], ["first_pos"]).select("doc_id", "key", "place", "batch")


@query(f"""WITH {ERRORS}, b AS (SELECT doc_id, token, first_pos, ((row_number() OVER (PARTITION BY doc_id ORDER BY first_pos) - 1) // 40)::INTEGER AS batch FROM err)
  SELECT doc_id, batch, count(*) AS words, {q(V.PROMPT_HEAD)} || string_agg('- ' || token, chr(10) ORDER BY first_pos) AS prompt,
  greatest(200, least(800, 80 + 28 * count(*)))::BIGINT AS budget FROM b GROUP BY 1, 2""")
def batch_prompts(spark, sf):
    return D.batch_prompts(D.batches(candidates(spark, sf), ["doc_id"], ["first_pos"]), ["doc_id"])


@query(f"WITH {ERRORS}, {DECIDED} SELECT doc_id, key, token, confirmed, reason FROM dec")
def apply_verdicts(spark, sf):
    found = cut(candidates(spark, sf), "candidates")
    return D.apply_verdicts(found, verdict_rows(spark, sf, found)).select("doc_id", "key", "token", "confirmed", "reason")


@query(f"WITH {ERRORS}, {LAYERED} SELECT doc_id, key, token, confirmed, reason, fallback FROM lay")
def second_layer(spark, sf):
    return layered(spark, sf)[0].select("doc_id", "key", "token", "confirmed", "reason", "fallback")


@query(f"""WITH {ERRORS}, {LAYERED}, x AS (SELECT *, row_number() OVER (PARTITION BY doc_id, confirmed ORDER BY first_pos) AS rn FROM lay)
  SELECT doc_id, count(*) AS candidates, count(*) FILTER (confirmed) AS confirmed, count(*) FILTER (NOT confirmed) AS discarded,
  bool_or(fallback) AS fallback, coalesce(string_agg(token || ':' || reason, ';' ORDER BY first_pos) FILTER (NOT confirmed AND rn <= 100), '') AS discards
  FROM x GROUP BY 1""")
def verdict_summary(spark, sf):
    one = lambda d: F.concat_ws(":", d["token"], d["reason"])
    return D.verdict_summary(layered(spark, sf)[0]).withColumn("discards", F.array_join(F.transform("discards", one), ";"))


@query(f"""WITH {ERRORS}, {LAYERED} SELECT doc_id, count(*) AS candidates, count(*) FILTER (confirmed) AS confirmed,
  count(*) FILTER (NOT confirmed) AS discarded FROM lay GROUP BY 1""")
def compare_layers(spark, sf):
    decided, found = layered(spark, sf)
    return D.compare_layers(found, decided)


@query("""WITH w AS (SELECT conv_id AS doc_id, turn AS arrival, regexp_extract_all(text, '[A-Za-z]+') AS ws FROM conversations),
  i AS (SELECT doc_id, arrival, (unnest(range(len(ws))))::INTEGER AS pos, unnest(ws) AS word FROM w WHERE arrival % 3 <> 2)
  SELECT doc_id, arrival, pos, false AS failed, word, length(word) % 2 = 0 AS is_error, 'typo' AS reason FROM i
  UNION ALL SELECT doc_id, arrival, NULL, true, '', false, NULL FROM w WHERE arrival % 3 = 2""")
def parse_answers(spark, sf):
    """An answer per turn: an item for each word of its whole text; every third answer is broken off."""
    words_ = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    item = lambda w: F.struct(
        w.alias("palabra"), (F.length(w) % 2 == 0).alias("es_error_ortografico"), F.lit("typo").alias("motivo")
    )
    answer = F.when(F.col("turn") % 3 == 2, F.lit('{"items": [{"palabra": ')).otherwise(
        F.to_json(F.struct(F.transform(words_, item).alias("items")))
    )
    rows = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("arrival"), answer.alias("answer")
    )
    return D.parse_answers(rows)


ANSWERED = """ans AS (SELECT doc_id, first_pos, key, token, kind, suggestions, doc_id % 5 = 0 AND (max(p) OVER (PARTITION BY doc_id)) >= 0 AS broken,
    length(key) % 2 = 0 AS confirmed FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_pos) - 1 AS p FROM err)),
  sl AS (SELECT doc_id, first_pos, key, token, confirmed OR broken AS confirmed, CASE WHEN NOT broken THEN
    CASE WHEN confirmed THEN 'typo' ELSE 'valida' END END AS reason, broken AS fallback FROM ans)"""


def raw_answers(spark, sf, found):
    """One JSON answer per batch of candidates with two items per word, of which the second counts; the
    last batch of each fifth document is broken off."""
    batched = D.batches(found, ["doc_id"], ["first_pos"])
    good = F.length("key") % 2 == 0
    items = F.array(
        F.struct(F.upper("token").alias("palabra"), (~good).alias("es_error_ortografico"), F.lit("primero").alias("motivo")),
        F.struct(
            F.concat(F.lit(" "), F.col("token"), F.lit("\t")).alias("palabra"), good.alias("es_error_ortografico"),
            F.when(good, "typo").otherwise("valida").alias("motivo"),
        ),
    )
    ordered = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("place", items.alias("i")))), lambda x: x["i"]))
    answers = batched.groupBy("doc_id", "batch").agg(F.to_json(F.struct(ordered.alias("items"))).alias("answer"))
    last = answers.groupBy("doc_id").agg(F.max("batch").alias("last"))
    broken = (F.col("doc_id") % 5 == 0) & (F.col("batch") == F.col("last"))
    return answers.join(last, "doc_id").select(
        "doc_id", F.col("batch").cast("bigint").alias("arrival"),
        F.when(broken, F.substring("answer", 1, 20)).otherwise(F.col("answer")).alias("answer"),
    )


@query(f"WITH {ERRORS}, {ANSWERED} SELECT doc_id, key, token, confirmed, reason, fallback FROM sl")
def second_layer_from_answers(spark, sf):
    found = cut(candidates(spark, sf), "candidates")
    decided = D.second_layer_from_answers(found, raw_answers(spark, sf, found))
    return decided.select("doc_id", "key", "token", "confirmed", "reason", "fallback")


@query(f"WITH {ERRORS}, {RESULTS} SELECT doc_id, ok, has_errors, total_errors, errors FROM res")
def review_stream(spark, sf):
    """The documents as a stream of files gives the same results as the batch review."""
    from orthoflow.session import shared_dir
    from orthoflow.streaming.review_stream import review_stream as start
    from orthoflow.streaming.review_stream import reviewed
    import uuid

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf, "documents").schema
    # the pattern matches the one file, or the folder of part files
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{sf}/documents.parquet*")
    stream = files.withColumn("ts", F.col("_metadata.file_modification_time"))
    start(stream, "ts", lexicon(spark, sf), f"{base}/results", f"{base}/checkpoint").awaitTermination()
    return _flat(reviewed(spark, f"{base}/results")).select("doc_id", "ok", "has_errors", "total_errors", "errors")


@query(f"""WITH {ERRORS}, {ANSWERED}, n AS (SELECT d.source, d.doc_id, count(sl.key) AS candidates, count(*) FILTER (sl.confirmed) AS confirmed
  FROM documents d LEFT JOIN sl USING (doc_id) GROUP BY 1, 2)
  SELECT source, count(*) AS documents, count(*) FILTER (confirmed > 0) AS with_errors,
  sum(candidates)::BIGINT AS candidates, sum(confirmed)::BIGINT AS confirmed FROM n GROUP BY 1""")
def batch_summary(spark, sf):
    found = cut(candidates(spark, sf), "candidates")
    decided = D.second_layer_from_answers(found, raw_answers(spark, sf, found))
    counts = D.verdict_summary(decided).select("doc_id", "candidates", "confirmed")
    sources = documents(spark, sf).select("doc_id", "source")
    none = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return Q.batch_summary(
        sources.join(counts, "doc_id", "left").select("source", none("candidates"), none("confirmed")), ["source"]
    )


def confirmed_results(spark, sf):
    """Results with the errors that the second layer has confirmed, and its summary."""
    found = cut(candidates(spark, sf), "candidates")
    decided = cut(D.second_layer_from_answers(found, raw_answers(spark, sf, found)), "decided")
    return Q.document_results(documents(spark, sf), decided.where("confirmed")), D.verdict_summary(decided)


CONFIRMED = """cf AS (SELECT sl.*, a.kind, a.suggestions FROM sl JOIN ans a USING (doc_id, key) WHERE sl.confirmed)"""


@query(f"""WITH {ERRORS}, {ANSWERED}, {CONFIRMED} SELECT doc_id, coalesce((SELECT string_agg(
    concat_ws(':', token, suggestions, reason), ';' ORDER BY first_pos) FROM cf WHERE cf.doc_id = d.doc_id), '') AS shown FROM documents d""")
def public_errors(spark, sf):
    shown = Q.public_errors(confirmed_results(spark, sf)[0])
    one = lambda e: F.concat_ws(":", e["palabra"], F.array_join(e["sugerencias"], ","), e["llm_motivo"])
    return shown.select("doc_id", F.array_join(F.transform("errors", one), ";").alias("shown"))


@query(f"""WITH {ERRORS}, {ANSWERED}, {CONFIRMED},
  es AS (SELECT doc_id, list({{'palabra': token, 'tipo': kind, 'sugerencias': string_split(suggestions, ',')}} ORDER BY first_pos) AS errores FROM cf GROUP BY 1),
  su AS (SELECT doc_id, count(*) AS n, count(*) FILTER (confirmed) AS c, count(*) FILTER (NOT confirmed) AS x, bool_or(fallback) AS fb FROM sl GROUP BY 1),
  j AS (SELECT d.doc_id, d.source, coalesce(len(errores), 0)::INTEGER AS t, errores, coalesce(n, 0) AS n,
    {{'confirmados': coalesce(c, 0), 'descartados': coalesce(x, 0), 'fallback': coalesce(fb, false)}} AS llm
    FROM documents d LEFT JOIN es USING (doc_id) LEFT JOIN su USING (doc_id))
  SELECT doc_id, CASE WHEN t > 0 THEN to_json({{'generado_en': '2020-01-02T03:04:05.000000+00:00', 'id': doc_id,
      'archivo_original': source || '.docx', 'tiene_errores': true, 'total_errores': t, 'errores': errores, 'documento_rev': 'rev/' || doc_id,
      'reporte_errores': 'rep/' || doc_id, 'marcacion_detalle': {{'resaltados': t}}, 'capa_llm': true, 'candidatos_libreoffice': n, 'llm': llm}})::VARCHAR
    ELSE to_json({{'generado_en': '2020-01-02T03:04:05.000000+00:00', 'id': doc_id, 'archivo_original': source || '.docx', 'tiene_errores': false,
      'total_errores': 0, 'errores': []::VARCHAR[], 'documento_rev': 'rev/' || doc_id, 'reporte_errores': 'rep/' || doc_id,
      'capa_llm': true, 'candidatos_libreoffice': n, 'llm': llm}})::VARCHAR END AS report FROM j""")
def errors_report(spark, sf):
    results, summary = confirmed_results(spark, sf)
    results = cut(results, "results")
    details = results.select("doc_id", F.struct(F.col("total_errors").alias("resaltados")).alias("details"))
    of = lambda head: F.concat(F.lit(head), F.col("doc_id").cast("string"))
    files = documents(spark, sf).select(
        "doc_id", F.concat("source", F.lit(".docx")).alias("archivo_original"), of("rev/").alias("documento_rev"),
        of("rep/").alias("reporte_errores"),
    )
    second = summary.select("doc_id", "candidates", "confirmed", "discarded", "fallback")
    at = F.to_timestamp(F.lit("2020-01-02 03:04:05"))
    return Q.errors_report(results, details, files, second, at)
