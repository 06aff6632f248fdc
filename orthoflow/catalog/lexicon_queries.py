"""Queries: lexicon engineering."""

import uuid

from pyspark.sql import functions as F

from orthoflow import fixed_values as V
from orthoflow.catalog.inputs import *  # noqa: F403
from orthoflow.catalog.inputs import BENCH, CASED, FOLD, LEX, PKG, TOK, bad, diacritic, english, q, valid
from orthoflow.catalog.registry import query
from orthoflow.functions import morphology as N
from orthoflow.operators import lexicon as L
from orthoflow.plans import packages as G
from orthoflow.session import shared_dir
from orthoflow.sources import lexicon_files as S

MARKERS = ("ment", "tion", "ción", "ver", "ich", "ñ")
SUFFIXES = ("ción", "dad", "mente", "ment", "tion", "ung", "ing")
PREFIXES = ("con", "ver", "over", "re", "ein")
KEEP = ("und", "the", "que", "les")
DENIED = ("the", "of", "and")
ROOT_SUFFIXES = ("ismo", "ista", "mente", "al", "ción")
ROOT_PREFIXES = ("anti", "re", "sub")


def _in(column, values):
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


def _any(column, values):
    return f"regexp_matches({column}, {q('|'.join(values))})"


def _ends(column, values):
    return f"regexp_matches({column}, {q('(' + '|'.join(values) + ')$')})"


def _array(values):
    return "[" + ", ".join(repr(v) for v in values) + "]"


# --- files ------------------------------------------------------------------

@query(f"""WITH {TOK}, {CASED}, w AS (SELECT DISTINCT word FROM cased)
  SELECT word, '' AS flags, {diacritic('word')} AS has_diacritic FROM w""")
def write_and_read_lexicon(spark, sf):
    path = f"{shared_dir(spark)}/lexicon-{uuid.uuid4().hex}"
    S.write_lexicon(cased_words(spark, sf), path)
    return S.read_lexicon(spark, path)


@query(f"WITH {TOK}, {CASED}, w AS (SELECT DISTINCT word FROM cased) SELECT word FROM w WHERE {valid('word')}")
def read_wordlist(spark, sf):
    path = f"{shared_dir(spark)}/words-{uuid.uuid4().hex}"
    words = cased_words(spark, sf).select("word").distinct()
    lines_ = words.select(F.concat("word", F.lit(" 1")).alias("value"))
    lines_.unionByName(words.select(F.concat(F.lit("# "), "word").alias("value"))).write.text(path)
    return S.read_wordlist(spark, path)


@query(f"""WITH {TOK}, {PKG}, w AS (SELECT DISTINCT pkg, word, CASE WHEN length(word) % 2 = 0 THEN 'GS' ELSE '' END AS flags FROM pkg)
  SELECT pkg, word, flags, {diacritic('word')} AS has_diacritic FROM w""")
def parse_lexicon_lines(spark, sf):
    flagged = F.when(F.length("word") % 2 == 0, F.concat("word", F.lit("/GS"))).otherwise(F.col("word"))
    words = cut(vocabulary_words(spark, sf), "vocabulary").select("pkg", flagged.alias("line"))
    counts = words.groupBy("pkg").agg(F.count("*").cast("string").alias("line"))
    return S.parse_lexicon_lines(words.unionByName(counts))


@query(f"""WITH {TOK}, {CASED}, w AS (SELECT DISTINCT word FROM cased)
  SELECT word AS value FROM w UNION ALL SELECT count(*)::VARCHAR FROM w""")
def lexicon_lines(spark, sf):
    return S.lexicon_lines(cased_words(spark, sf))


@query(f"WITH {TOK}, {CASED} SELECT DISTINCT word FROM cased ORDER BY lower(word), word")
def lexicon_order(spark, sf):
    return S.lexicon_order(cased_words(spark, sf).select("word").distinct())


# --- set operations and joins -----------------------------------------------

@query(f"WITH {TOK}, {CASED}, {BENCH} SELECT word FROM cased UNION SELECT word FROM bench")
def merge_bags(spark, sf):
    return L.merge_bags(cased_words(spark, sf).select("word"), benchmark_words(spark, sf))


@query(f"WITH {TOK}, {CASED}, {BENCH} SELECT pkg, word FROM cased WHERE word NOT IN (SELECT word FROM bench)")
def subtract_base(spark, sf):
    return L.subtract_base(cased_words(spark, sf), benchmark_words(spark, sf)).select("pkg", "word")


@query(f"WITH {TOK}, {CASED}, {BENCH} SELECT pkg, word FROM cased WHERE lower(word) NOT IN (SELECT lower(word) FROM bench)")
def deny(spark, sf):
    return L.deny(cased_words(spark, sf), benchmark_words(spark, sf))


FIX = """fix AS (SELECT word, CASE WHEN length(word) % 3 = 0 THEN NULL ELSE word || 'x' END AS fixed FROM bench)"""


@query(f"""WITH {TOK}, {CASED}, {BENCH}, {FIX} SELECT DISTINCT pkg, coalesce(fixed, cased.word) AS word FROM cased
  LEFT JOIN fix ON fix.word = cased.word WHERE CASE WHEN fix.word IS NOT NULL THEN fixed IS NOT NULL ELSE {valid('cased.word')} END""")
def apply_fixes(spark, sf):
    fixes = benchmark_words(spark, sf).withColumn(
        "fixed", F.when(F.length("word") % 3 != 0, F.concat("word", F.lit("x")))
    )
    return L.apply_fixes(cased_words(spark, sf), fixes).select("pkg", "word")


MASKED_KEYS = f"""forms AS (SELECT pkg, word, CASE
    WHEN NOT {_ends('lower(word)', V.SAFE_ADJECTIVE_ENDINGS)} THEN [word]
    WHEN word LIKE '%o' THEN [word, word[:-2] || 'a', word[:-2] || 'os', word[:-2] || 'as']
    WHEN word LIKE '%a' THEN [word, word[:-2] || 'o', word[:-2] || 'os', word[:-2] || 'as']
    ELSE [word] END AS f FROM cased WHERE {diacritic('word')}),
ukeys AS (SELECT pkg, unnest(f) AS form FROM forms),
keys AS (SELECT DISTINCT pkg, {FOLD.format('form')} AS fold FROM ukeys WHERE {diacritic('form')})"""
REFKEYS = """refkeys AS (SELECT DISTINCT fold FROM keys WHERE pkg = 'es')"""
IS_MASKED = f"""(NOT {diacritic('c.word')} AND (EXISTS (SELECT 1 FROM keys k WHERE k.pkg = c.pkg AND k.fold = {FOLD.format('c.word')})
  OR {FOLD.format('c.word')} IN (SELECT fold FROM refkeys)))"""
MARKED = f"{TOK}, {CASED}, {MASKED_KEYS}, {REFKEYS}, c0 AS (SELECT c.*, {IS_MASKED} AS masked FROM cased c)"


def spanish(words):
    """The Spanish words of ``words`` as the base lexicon of the filter."""
    return words.where("pkg = 'es'").select("word")


def reference(spark, sf):
    return spanish(cased_words(spark, sf))


@query(f"WITH {TOK}, {CASED}, {MASKED_KEYS} SELECT pkg, fold FROM keys")
def accented_keys(spark, sf):
    return L.accented_keys(cased_words(spark, sf))


@query(f"WITH {MARKED} SELECT pkg, word FROM c0 WHERE NOT masked")
def drop_masked_forms(spark, sf):
    return L.drop_masked_forms(cased_words(spark, sf), reference(spark, sf))


REASON = f"""rs AS (SELECT pkg, word, CASE WHEN {english('word')} THEN 'english' WHEN masked THEN 'masked'
  WHEN {bad('word')} THEN 'bad_ending' ELSE 'kept' END AS reason FROM c0)"""


@query(f"WITH {MARKED}, {REASON} SELECT pkg, word, reason FROM rs")
def orthography_reasons(spark, sf):
    return L.orthography_reasons(cased_words(spark, sf), reference(spark, sf))


@query(f"WITH {MARKED}, {REASON} SELECT pkg, word FROM rs WHERE reason = 'kept'")
def orthography_filter(spark, sf):
    return L.orthography_filter(cased_words(spark, sf), reference(spark, sf))


@query(f"""WITH {TOK}, {CASED}, keys AS (SELECT DISTINCT pkg, {FOLD.format('word')} AS fold FROM cased WHERE {diacritic('word')}), {REFKEYS},
  c0 AS (SELECT c.*, {IS_MASKED} AS masked FROM cased c)
  SELECT pkg, word FROM c0 WHERE NOT masked AND NOT {bad('word', V.BAD_ENDINGS_LOANWORD, ())}""")
def orthography_filter_loanword(spark, sf):
    return L.orthography_filter(cased_words(spark, sf), reference(spark, sf), "loanword")


@query(f"WITH {MARKED} SELECT pkg, word FROM c0 WHERE NOT masked AND NOT {bad('word')}")
def scrub_missing_accents(spark, sf):
    return L.scrub_missing_accents(cased_words(spark, sf), reference(spark, sf))


@query(f"""WITH {MARKED}, {REASON} SELECT pkg, coalesce(reason, 'input') AS reason, count(*) AS words FROM rs
  GROUP BY ROLLUP (pkg, reason)""")
def filter_report(spark, sf):
    return L.filter_report(L.orthography_reasons(cased_words(spark, sf), reference(spark, sf)))


@query(f"""WITH {MARKED}, {REASON}, {BENCH} SELECT pkg, word FROM rs WHERE reason = 'kept' UNION SELECT 'en', word FROM bench
  EXCEPT SELECT pkg, word FROM rs WHERE length(word) = 4""")
def force_keep(spark, sf):
    words = cased_words(spark, sf)
    kept = L.orthography_filter(words, reference(spark, sf))
    keep = benchmark_words(spark, sf).select(F.lit("en").alias("pkg"), "word")
    return L.force_keep(kept, keep, removed=words.where(F.length("word") == 4))


@query(f"""WITH {TOK}, {BENCH}, cased AS (SELECT DISTINCT lang AS pkg, token AS word FROM tok UNION SELECT 'en', word FROM bench),
  {MASKED_KEYS}, refkeys AS (SELECT DISTINCT fold FROM keys WHERE pkg = 'es'), c0 AS (SELECT c.*, {IS_MASKED} AS masked FROM cased c),
  {REASON} SELECT pkg, word FROM rs WHERE reason = 'kept'""")
def seed_then_refilter(spark, sf):
    seeds = benchmark_words(spark, sf).select(F.lit("en").alias("pkg"), "word")
    return L.seed_then_refilter(cased_words(spark, sf), seeds, reference(spark, sf))


# --- harvests ---------------------------------------------------------------

@query(f"WITH {TOK}, {CASED} SELECT pkg, word FROM cased WHERE {_any('lower(word)', MARKERS)}")
def harvest(spark, sf):
    return L.harvest(cased_words(spark, sf), MARKERS)


@query(f"""WITH {TOK}, {CASED}, m AS (SELECT unnest({_array(MARKERS)}) AS marker)
  SELECT pkg, word, marker FROM cased, m WHERE contains(lower(word), marker)""")
def harvest_with_markers(spark, sf):
    return L.harvest_with_markers(cased_words(spark, sf), MARKERS)


IN_DOMAIN = f"""NOT {_in('lower(word)', DENIED)} AND ({_in('lower(word)', KEEP)} OR {_ends('lower(word)', SUFFIXES)}
  OR regexp_matches(lower(word), {q('^(' + '|'.join(PREFIXES) + ').{3,}')}))"""


@query(f"WITH {TOK}, {CASED} SELECT pkg, word FROM cased WHERE {IN_DOMAIN}")
def domain_harvest(spark, sf):
    return L.domain_harvest(cased_words(spark, sf), SUFFIXES, PREFIXES, KEEP, DENIED)


@query(f"""WITH {TOK}, {CASED} SELECT pkg, word FROM cased WHERE NOT {_in('lower(word)', DENIED)} AND (length(word) >= 6
  OR {_ends('lower(word)', SUFFIXES)} OR regexp_matches(lower(word), {q('^(' + '|'.join(PREFIXES) + ').{3,}')}))""")
def domain_harvest_broad(spark, sf):
    return L.domain_harvest(cased_words(spark, sf), SUFFIXES, PREFIXES, (), DENIED, long_from=6)


@query(f"""WITH {TOK}, {CASED} SELECT pkg, word, ([('-' || s) for s in {_array(SUFFIXES)} if ends_with(lower(word), s)] ||
  [(p || '-') for p in {_array(PREFIXES)} if starts_with(lower(word), p) AND length(word) > length(p) + 2])[1] AS rule FROM cased""")
def domain_rule(spark, sf):
    return cased_words(spark, sf).withColumn("rule", L.domain_rule("word", SUFFIXES, PREFIXES))


@query(f"""WITH {TOK}, {PKG} SELECT DISTINCT 'med' AS pkg, word FROM pkg WHERE pkg = 'es' AND {_any('word', ('ción', 'logía'))}
  UNION SELECT 'odo', word FROM pkg WHERE pkg = 'es' AND {_any('word', ('dad', 'ent'))}""")
def cross_lexicon_harvest(spark, sf):
    return L.cross_lexicon_harvest(vocabulary_words(spark, sf), "es", {"med": ("ción", "logía"), "odo": ("dad", "ent")})


@query(f"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]{{3,40}}')) AS word FROM documents
    WHERE {_any('lower(text)', ('ción', 'ung'))}) SELECT word FROM t WHERE {_in('lower(word)', KEEP)} OR {_any('lower(word)', MARKERS)}""")
def glossary_harvest(spark, sf):
    return L.glossary_harvest(documents(spark, sf), ("ción", "ung"), MARKERS, KEEP)


# --- morphology -------------------------------------------------------------

LETTERS_OK = f"regexp_matches(word, {q(V.LEXICON_WORD)})"


@query(f"""WITH {TOK}, {PKG}, a AS (SELECT pkg, word || unnest({_array(ROOT_SUFFIXES)}) AS word FROM pkg),
  b AS (SELECT pkg, unnest({_array(ROOT_PREFIXES)}) || word AS word FROM pkg)
  SELECT pkg, word FROM a WHERE length(word) BETWEEN 5 AND 42 AND {LETTERS_OK}
  UNION SELECT pkg, word FROM b WHERE length(word) BETWEEN 6 AND 42 AND {LETTERS_OK}""")
def word_affixes(spark, sf):
    words = vocabulary_words(spark, sf)
    return L.word_affixes(words, ROOT_SUFFIXES, ROOT_PREFIXES, words)


@query(f"""WITH {TOK}, {PKG}, {BENCH}, ok AS (SELECT DISTINCT lower(word) AS word FROM bench),
  a AS (SELECT pkg, word || unnest(CASE WHEN word IN (SELECT word FROM ok) THEN ['al', 'mente', 'emia'] ELSE ['al', 'mente'] END) AS word FROM pkg)
  SELECT DISTINCT pkg, word FROM a WHERE length(word) BETWEEN 5 AND 40""")
def restricted_affixes(spark, sf):
    allowed = benchmark_words(spark, sf).select(F.lower("word").alias("word"))
    return L.restricted_affixes(vocabulary_words(spark, sf), ("al", "mente"), ("emia",), allowed)


@query(f"""WITH w AS (SELECT DISTINCT unnest(string_split_regex(trim(text), '\\s+')) AS word FROM benchmark) SELECT word FROM w WHERE {valid('word')}""")
def seed_words(spark, sf):
    return L.seed_words(table(spark, sf, "benchmark").select("text"))


def _gender_sql(pairs, extra=""):
    parts = []
    for m, f in pairs:
        parts.append(
            f"CASE WHEN ends_with(word, '{m}') OR ends_with(word, '{f}') THEN "
            f"[word[:-{len(m) + 1}] || x for x in ['{m}', '{f}', '{m}s', '{f}s']] ELSE [] END"
        )
    return "[word] || " + " || ".join(parts) + extra


@query(f"""WITH {TOK}, {CASED}, g AS (SELECT pkg, unnest({_gender_sql(V.GENDER_PAIRS)} || CASE WHEN
    regexp_matches(word, '^\\p{{Ll}}') AND {_any('lower(word)', MARKERS)} THEN [upper(word[1]) || word[2:]] ELSE [] END) AS word
    FROM cased WHERE {valid('word')}) SELECT DISTINCT pkg, word FROM g""")
def gender_number(spark, sf):
    return L.gender_number(cased_words(spark, sf), title_markers=MARKERS)


@query(f"""WITH {TOK}, {CASED}, g AS (SELECT pkg, unnest({_gender_sql(V.CLINICAL_GENDER_PAIRS)} || CASE WHEN
    {_ends('word', V.ADVERB_ENDINGS)} THEN [word || 'mente'] ELSE [] END || CASE WHEN regexp_matches(word, '^\\p{{Ll}}')
    THEN [upper(word[1]) || word[2:]] ELSE [] END) AS word FROM cased WHERE {valid('word')}) SELECT DISTINCT pkg, word FROM g""")
def gender_number_clinical(spark, sf):
    return L.gender_number(cased_words(spark, sf), V.CLINICAL_GENDER_PAIRS, adverbs=True, title_markers=())


def _general_sql(es):
    return f"""CASE WHEN length(word) NOT BETWEEN 4 AND 35 OR {_ends('lower(word)', ('s', 'x'))} THEN NULL
      WHEN {_ends('lower(word)', ('a', 'e', 'i', 'o', 'u'))} THEN word || 's' WHEN {_ends('lower(word)', es)} THEN word || 'es' END"""


PLURAL_SQL = {
    "general": _general_sql(("al", "ar", "or", "en")),
    "dental": _general_sql(("al", "ar", "or")),
    "loanword": f"""CASE WHEN length(word) NOT BETWEEN 4 AND 35 OR {_ends('lower(word)', ('s', 'x'))} THEN NULL
      WHEN {_ends('lower(word)', ('a', 'e', 'i', 'o', 'u', 'y'))} THEN word || 's' WHEN {_ends('lower(word)', ('ch', 'sh'))} THEN word || 'es' END""",
    "clinical": f"""CASE WHEN length(word) NOT BETWEEN 4 AND 28 OR {_ends('lower(word)', V.CLINICAL_PLURAL_SKIP)} THEN NULL
      WHEN {_ends('lower(word)', ('z',))} THEN word[:-2] || 'ces' WHEN {_ends('lower(word)', tuple('áéíóúnlrdjy'))} THEN word || 'es'
      WHEN NOT {_ends('lower(word)', ('s',))} THEN word || 's' END""",
}
PLURAL_ALL = " UNION ".join(f"SELECT '{r}' AS rule, pkg, {x} AS plural FROM cased WHERE ({x}) IS NOT NULL" for r, x in PLURAL_SQL.items())


@query(f"WITH {TOK}, {CASED} {PLURAL_ALL}")
def plurals(spark, sf):
    words = stored_words(spark, sf)
    out = None
    for rule in PLURAL_SQL:
        part = L.plurals(words, rule).select(F.lit(rule).alias("rule"), "pkg", F.col("word").alias("plural"))
        out = part if out is None else out.unionByName(part)
    return out


TITLES = ("derecho", "que", "the", "und", "les", "con", "ist")


@query(f"""WITH {TOK}, {CASED} SELECT DISTINCT pkg, upper(word[1]) || word[2:] AS word FROM cased
  WHERE {_in('lower(word)', TITLES)} AND regexp_matches(word, '^\\p{{Ll}}')""")
def title_variants(spark, sf):
    return L.title_variants(cased_words(spark, sf), TITLES)


# --- checks and reports -----------------------------------------------------

@query(f"""WITH {TOK}, w AS (SELECT lang AS pkg, token AS word, count(*) AS c FROM tok GROUP BY 1, 2),
  e AS (SELECT pkg, word, CASE WHEN pkg = 'es' AND c > 50 THEN 2 ELSE 1 END AS n FROM w)
  SELECT pkg, CASE WHEN pkg = 'fr' THEN count(DISTINCT lower(word)) ELSE sum(n)::BIGINT END AS declared,
    sum(n)::BIGINT AS in_file, sum(CASE WHEN {diacritic('word')} THEN n ELSE 0 END)::BIGINT AS accented, (sum(n) - count(*))::BIGINT AS exact_duplicates,
    (sum(n) - count(DISTINCT lower(word)))::BIGINT AS case_pairs, pkg <> 'fr' AND sum(n) = count(*) AS passed FROM e GROUP BY 1""")
def verify_lexicon(spark, sf):
    """Spanish repeats frequent words, French declares only its lower-case words."""
    counted = all_tokens(spark, sf).groupBy(F.col("lang").alias("pkg"), F.col("token").alias("word")).agg(F.count("*").alias("c"))
    twice = (F.col("pkg") == "es") & (F.col("c") > 50)
    entries = counted.select("pkg", F.explode(F.array_repeat("word", F.when(twice, 2).otherwise(1))).alias("line"))
    header = entries.groupBy("pkg").agg(F.count("*").alias("n")).select(
        "pkg", F.when(F.col("pkg") == "fr", F.lit(0)).otherwise(F.col("n")).alias("n")
    )
    french = counted.where("pkg = 'fr'").groupBy("pkg").agg(F.count_distinct(F.lower("word")).alias("n"))
    header = header.where("pkg <> 'fr'").unionByName(french)
    return L.verify_lexicon(entries.unionByName(header.select("pkg", F.col("n").cast("string").alias("line"))))


@query(f"WITH {TOK}, {CASED} SELECT coalesce(pkg, 'total') AS pkg, count(*) AS lemmas FROM cased GROUP BY ROLLUP (pkg)")
def package_inventory(spark, sf):
    return L.package_inventory(cased_words(spark, sf))


PROBES = f"""probes AS (SELECT l.lang AS pkg, b.word, length(b.word) % 2 = 0 AS expect FROM bench b, (SELECT DISTINCT lang FROM documents) l)"""


def probes(spark, sf):
    languages = F.explode(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")]))
    return benchmark_words(spark, sf).select(languages.alias("pkg"), "word", (F.length("word") % 2 == 0).alias("expect"))


@query(f"""WITH {TOK}, {LEX}, {BENCH}, {PROBES}, x AS (SELECT p.*, EXISTS (SELECT 1 FROM lex WHERE lex.lang = p.pkg AND lex.word = p.word) AS present FROM probes p)
  SELECT pkg, word, expect, present, present = expect AS passed FROM x""")
def probe_lexicon(spark, sf):
    return L.probe_lexicon(lexicon(spark, sf).withColumnRenamed("lang", "pkg"), probes(spark, sf))


@query(f"""WITH {TOK}, {LEX}, {BENCH}, {PROBES}, x AS (SELECT p.*, EXISTS (SELECT 1 FROM lex WHERE lex.lang = p.pkg AND lex.word = p.word) AS present FROM probes p)
  SELECT pkg, count(*) AS sampled, count(*) FILTER (present) AS covered, count(*) FILTER (present) / count(*) AS share,
  count(*) FILTER (present) / count(*) >= 0.8 AS stop_growing FROM x GROUP BY 1""")
def coverage(spark, sf):
    return L.coverage(probes(spark, sf).drop("expect"), lexicon(spark, sf).withColumnRenamed("lang", "pkg"))


OLD_NEW = """old AS (SELECT DISTINCT lang AS pkg, token AS word FROM tok WHERE source < 'src5'), new AS (SELECT DISTINCT lang AS pkg, token AS word FROM tok WHERE source >= 'src5')"""


@query(f"""WITH {TOK}, {OLD_NEW}, f AS (SELECT coalesce(o.pkg, n.pkg) AS pkg, coalesce(o.word, n.word) AS word, o.word IS NOT NULL AS io, n.word IS NOT NULL AS i2
    FROM old o FULL JOIN new n ON o.pkg = n.pkg AND o.word = n.word),
  r AS (SELECT *, row_number() OVER (PARTITION BY pkg, io, i2 ORDER BY lower(word), word) AS rn FROM f)
  SELECT pkg, count(*) FILTER (io) AS "before", count(*) FILTER (i2) AS "after", count(*) FILTER (io AND NOT i2) AS dropped,
  count(*) FILTER (NOT io) AS added, string_agg(word, ',' ORDER BY rn) FILTER (io AND NOT i2 AND rn <= 30) AS sample FROM r GROUP BY 1""")
def lexicon_diff(spark, sf):
    words = all_tokens(spark, sf, ["doc_id", "lang", "source"]).select("source", F.col("lang").alias("pkg"), F.col("token").alias("word"))
    diff = L.lexicon_diff(words.where("source < 'src5'"), words.where("source >= 'src5'"))
    return diff.withColumn("sample", F.array_join("sample", ","))


# --- whole packages ---------------------------------------------------------

def _filtered(bag, out, ref="es_ref"):
    """SQL of the orthography filter over CTE ``bag`` (pkg, word)."""
    keys = MASKED_KEYS.replace("forms AS", f"{out}_forms AS").replace("FROM cased", f"FROM {bag}")
    keys = keys.replace("FROM forms", f"FROM {out}_forms").replace("ukeys", f"{out}_ukeys").replace("\nkeys AS", f"\n{out}_keys AS")
    masked = f"""(NOT {diacritic('c.word')} AND (EXISTS (SELECT 1 FROM {out}_keys k WHERE k.pkg = c.pkg AND k.fold = {FOLD.format('c.word')})
      OR {FOLD.format('c.word')} IN (SELECT fold FROM {ref})))"""
    return f"""{keys}, {out} AS (SELECT c.pkg, c.word FROM {bag} c WHERE NOT {english('c.word')} AND NOT {masked} AND NOT {bad('c.word')})"""


REF = f"{TOK}, {CASED}, {MASKED_KEYS}, es_ref AS (SELECT DISTINCT fold FROM keys WHERE pkg = 'es')"
BUILD = f"""{REF}, {BENCH}, bag0 AS (SELECT pkg, word FROM cased WHERE {valid('word', 2)} AND lower(word) NOT IN ('the', 'of', 'and')),
bag1 AS (SELECT * FROM bag0 UNION SELECT pkg, upper(word[1]) || word[2:] FROM bag0 WHERE {_in('lower(word)', TITLES)} AND regexp_matches(word, '^\\p{{Ll}}')),
pl AS (SELECT pkg, {PLURAL_SQL['general']} AS word FROM bag1),
bag2 AS (SELECT * FROM bag1 UNION SELECT * FROM pl WHERE word IS NOT NULL AND {valid('word', 2)} AND lower(word) NOT IN ('the', 'of', 'and')),
{_filtered('bag2', 'k1')}, bag3 AS (SELECT * FROM k1 UNION SELECT 'es', word FROM bench), {_filtered('bag3', 'k2')}"""


def denied_of(words):
    """The denied words among ``words``."""
    low = F.lower("word")
    return words.where(low.isin(*DENIED)).select(low.alias("word")).distinct()


def denied(spark, sf):
    return denied_of(cased_words(spark, sf))


@query(f"WITH {BUILD} SELECT pkg, word FROM k2")
def build_package(spark, sf):
    seeds, words = benchmark_words(spark, sf).select(F.lit("es").alias("pkg"), "word"), stored_words(spark, sf)
    return G.build_package(words, denied_of(words), TITLES, "general", seeds, spanish(words))


EXPAND = f"""{REF}, {LEX}, {BENCH}, seeds AS (SELECT 'en' AS pkg, word FROM bench WHERE {valid('word')}),
roots AS (SELECT lang AS pkg, word FROM lex),
a AS (SELECT pkg, word || unnest({_array(ROOT_SUFFIXES)}) AS word FROM roots),
b AS (SELECT pkg, unnest({_array(ROOT_PREFIXES)}) || word AS word FROM roots),
hv AS (SELECT pkg, word FROM cased WHERE {_any('lower(word)', MARKERS)}),
e0 AS (SELECT * FROM seeds UNION SELECT * FROM hv UNION SELECT * FROM a WHERE length(word) BETWEEN 5 AND 42 AND {LETTERS_OK}
  UNION SELECT * FROM b WHERE length(word) BETWEEN 6 AND 42 AND {LETTERS_OK}),
g0 AS (SELECT pkg, unnest({_gender_sql(V.GENDER_PAIRS)}) AS word FROM e0 WHERE {valid('word')}),
e1 AS (SELECT DISTINCT pkg, word FROM g0 WHERE {valid('word')} AND lower(word) NOT IN ('the', 'of', 'and')),
{_filtered('e1', 'x1')}, xk AS (SELECT * FROM x1 UNION SELECT 'es', word FROM bench WHERE {valid('word')})"""


@query(f"WITH {EXPAND} SELECT pkg, word FROM xk")
def expand_package(spark, sf):
    roots = lexicon(spark, sf).select(F.col("lang").alias("pkg"), "word")
    bench, words = cut(benchmark_words(spark, sf), "bench"), stored_words(spark, sf)
    return G.expand_package(
        seeds=bench.where(T_valid("word")).select(F.lit("en").alias("pkg"), "word"),
        roots=roots,
        harvested=L.harvest(words, MARKERS),
        reference=spanish(words),
        suffixes=ROOT_SUFFIXES,
        prefixes=ROOT_PREFIXES,
        bases=roots,
        keep=bench.select(F.lit("es").alias("pkg"), "word"),
        denied=denied_of(words),
    )


from orthoflow.functions.text import valid_word as T_valid  # noqa: E402


# Four packages, each with its own rule; the last one takes words of the first when that is finished.
PACKAGE_RULES = {
    "es": G.PackageRule("general", title_keys=TITLES),
    "en": G.PackageRule("dental", min_length=3, max_length=20),
    "fr": G.PackageRule("clinical", min_length=4),
    "de": G.PackageRule("general", min_length=5, harvest_from="es", harvest_markers=("ci", "est")),
}


def _package_sql(tag, source, pkg):
    """SQL of one package from the words of ``source`` (pkg, word), finished in CTE ``{tag}done``."""
    rule = PACKAGE_RULES[pkg]
    ok = f"{valid('word', rule.min_length, rule.max_length)} AND lower(word) NOT IN ('the', 'of', 'and')"
    titles = _in("lower(word)", rule.title_keys) if rule.title_keys else "false"
    seeds = f"UNION SELECT '{pkg}', word FROM bench" if pkg == "es" else ""
    return f"""{tag}0 AS (SELECT DISTINCT pkg, word FROM {source} WHERE {ok}),
{tag}1 AS (SELECT * FROM {tag}0 UNION SELECT pkg, upper(word[1]) || word[2:] FROM {tag}0 WHERE {titles} AND regexp_matches(word, '^\\p{{Ll}}')),
{tag}p AS (SELECT pkg, {PLURAL_SQL[rule.plural_rule]} AS word FROM {tag}1),
{tag}2 AS (SELECT * FROM {tag}1 UNION SELECT * FROM {tag}p WHERE word IS NOT NULL AND {ok}),
{_filtered(tag + '2', tag + 'k')}, {tag}3 AS (SELECT * FROM {tag}k {seeds}), {_filtered(tag + '3', tag + 'done')}"""


PACKAGES = ",\n".join(
    f"{p}w AS (SELECT pkg, word FROM cased WHERE pkg = '{p}'"
    + (f" UNION SELECT '{p}', word FROM {r.harvest_from}done WHERE {_any('lower(word)', r.harvest_markers)}" if r.harvest_from else "")
    + f"), {_package_sql(p, p + 'w', p)}"
    for p, r in PACKAGE_RULES.items()
)


@query(f"WITH {REF}, {BENCH}, {PACKAGES} " + " UNION ALL ".join(f"SELECT pkg, word FROM {p}done" for p in PACKAGE_RULES))
def build_packages(spark, sf):
    seeds, words = benchmark_words(spark, sf).select(F.lit("es").alias("pkg"), "word"), stored_words(spark, sf)
    return G.build_packages(words, PACKAGE_RULES, denied_of(words), seeds, spanish(words))
