"""Queries: stored tables that are changed in rounds, rules and package graphs as tables, feedback, composed text."""

import unicodedata
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoflow import fixed_values as V
from orthoflow.catalog import lexicon_queries as LQ
from orthoflow.catalog import record_queries as RQ
from orthoflow.catalog import review_queries as VQ
from orthoflow.catalog.inputs import *  # noqa: F403
from orthoflow.catalog.inputs import BENCH, ERRORS, TOK, q, valid
from orthoflow.catalog.lexicon_queries import CASED, DENIED, PLURAL_SQL, REF, TITLES, _any, _filtered, _gender_sql, _in
from orthoflow.catalog.registry import SQL, query
from orthoflow.functions import paths as P
from orthoflow.operators import marking as M
from orthoflow.operators import records as R
from orthoflow.operators import rules as S
from orthoflow.operators import verdicts as D
from orthoflow.plans import feedback as B
from orthoflow.plans import package_graph as G
from orthoflow.plans import packages as K
from orthoflow.plans import review as Q
from orthoflow.session import shared_dir
from orthoflow.sources.snapshots import KeyedTable

BUCKET_ROWS = 5_000


def new_folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def rounds(rows, key, n=3):
    """All rows, dealt in ``n`` rounds by a hash of their key."""
    stored = cut(rows.withColumn("_round", F.pmod(F.xxhash64(key), F.lit(n))), "rounds")
    return [cut(stored.where(F.col("_round") == i).drop("_round"), "round") for i in range(n)]


# --- stored tables ----------------------------------------------------------

@query(SQL["apply_row_changes"])
def stored_row_changes(spark, sf):
    """The changes come in three rounds by draft, and the last round comes twice."""
    table_ = KeyedTable(spark, new_folder(spark, "grades"), ["draft_id", "row_id"], BUCKET_ROWS)
    table_.upsert(cut(RQ.grades(spark, sf).drop("deleted"), "grades"))
    parts = rounds(RQ.row_changes(spark, sf), "draft_id")
    for mark, part in [*enumerate(parts), (len(parts) - 1, parts[-1])]:
        R.store_row_changes(table_, part, "label", ["pct"], mark)
    return table_.read()


@query(SQL["upsert_review_path"])
def stored_review_paths(spark, sf):
    items = KeyedTable(spark, new_folder(spark, "items"), ["id"], BUCKET_ROWS)
    items.upsert(cut(RQ.schedules(spark, sf), "items"))
    for part in rounds(RQ.path_results(spark, sf), "id"):
        R.store_review_paths(items, part)
    return items.read().select("id", "draft_id", "path_rev")


@query(f"SELECT id, course, start_ts, end_ts FROM ({SQL['publish_version']})")
def stored_publication(spark, sf):
    """Courses are published in three rounds; a second run of the last one opens no further draft."""
    versions = KeyedTable(spark, new_folder(spark, "versions"), ["course"], BUCKET_ROWS)
    versions.upsert(cut(RQ.dated_versions(spark, sf), "versions"))
    parts = rounds(RQ.publishing(spark, sf), "course")
    for mark, part in [*enumerate(parts), (len(parts) - 1, parts[-1])]:
        R.store_publication(versions, part, F.lit("2026-07-01").cast("timestamp"), mark)
    return versions.read()


@query(f"SELECT 'rev_' || doc_id || '_errores.json' AS key, doc_id, report FROM ({SQL['errors_report']})")
def stored_reports(spark, sf):
    """Reports under their revision key: first without content, then as they are, then once more."""
    made = cut(VQ.errors_report(spark, sf), "reports")
    key = P.revision_keys(F.concat(F.lit("documento_"), F.col("doc_id").cast("string"), F.lit(".docx")))
    keyed = cut(made.withColumn("k", key).select(F.element_at(F.array("k.*"), 2).alias("key"), "doc_id", "report"), "keyed")
    reports = KeyedTable(spark, new_folder(spark, "reports"), ["key"], BUCKET_ROWS)
    Q.store_reports(reports, keyed.withColumn("report", F.lit("{}")))
    Q.store_reports(reports, keyed)
    Q.store_reports(reports, keyed)
    return reports.read()


@query(f"""WITH {ERRORS}, n AS (SELECT doc_id, key, row_number() OVER (ORDER BY doc_id, first_pos) - 1 AS place FROM err)
  SELECT doc_id, key, place, place // 40 AS batch FROM n""")
def corpus_batches(spark, sf):
    """Candidates of all documents in batches of 40, in one order."""
    return D.corpus_batches(VQ.candidates(spark, sf), ["doc_id", "first_pos"]).select("doc_id", "key", "place", "batch")


# --- composed text ----------------------------------------------------------

def decomposed(spark, sf):
    """The documents with the Spanish letters as base letter and mark."""
    text = F.col("text")
    for letter in V.COMPOSED_LETTERS:
        text = F.replace(text, F.lit(letter), F.lit(unicodedata.normalize("NFD", letter)))
    return documents(spark, sf).withColumn("text", text)


@query(SQL["find_errors"])
def find_errors_composed(spark, sf):
    """Documents whose letters are decomposed have the errors of the composed ones."""
    found = Q.find_errors_composed(decomposed(spark, sf), lexicon(spark, sf))
    return found.select("doc_id", "lang", "first_pos", "key", "token", "kind", VQ._joined())


OTHERS = q(f"[^{V.COMPOSED_LETTERS}]")


@query(f"""WITH {ERRORS}, {VQ.HITS}, c AS (SELECT doc_id, i, piece, s, sum(length(regexp_replace(piece, {OTHERS}, '', 'g')))
      OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS moved FROM o),
  m AS (SELECT hit.*, coalesce(moved, 0) + length(regexp_replace(piece[1:start_at - s], {OTHERS}, '', 'g')) AS b,
    coalesce(moved, 0) + length(regexp_replace(piece[1:end_at - s], {OTHERS}, '', 'g')) AS e FROM hit JOIN c USING (doc_id, i))
  SELECT doc_id, key, (start_at + b)::INTEGER AS start_at, (end_at + e)::INTEGER AS end_at, e > b AS blocked FROM m""")
def mark_composed(spark, sf):
    docs = decomposed(spark, sf)
    return M.mark_composed(docs, Q.find_errors_composed(docs, lexicon(spark, sf)))


# --- rule tables ------------------------------------------------------------

RULES = """rl AS (SELECT DISTINCT 'p' || length(word) % 3 AS pkg, k.kind, lower(CASE k.kind WHEN 'contains' THEN word[2:6] WHEN 'suffix' THEN word[-4:]
    WHEN 'prefix' THEN word[1:4] ELSE word END) AS marker FROM bench, (SELECT unnest(['contains', 'suffix', 'prefix', 'keep']) AS kind) k
    WHERE length(word) >= 6
  UNION SELECT 'p' || (length(word) + 1) % 3, 'deny', lower(word) FROM bench WHERE length(word) >= 6
  UNION SELECT 'p2', 'longer', '16'),
f AS (SELECT DISTINCT lower(word) AS low FROM cased),
met AS (SELECT low, pkg, kind, marker FROM f, rl WHERE kind = 'contains' AND contains(low, marker)
  UNION ALL SELECT low, pkg, kind, marker FROM f JOIN rl ON kind = 'suffix' AND low[-length(marker):] = marker
  UNION ALL SELECT low, pkg, kind, marker FROM f JOIN rl ON kind = 'prefix' AND starts_with(low, marker) AND length(low) >= length(marker) + 3
  UNION ALL SELECT low, pkg, kind, marker FROM f JOIN rl ON kind IN ('keep', 'deny') AND low = marker
  UNION ALL SELECT low, pkg, kind, marker FROM f JOIN rl ON kind = 'longer' AND length(low) >= 16),
rh AS (SELECT DISTINCT pkg, word, kind, marker FROM met JOIN (SELECT DISTINCT word FROM cased) c ON lower(word) = low)"""


def rules(spark, sf):
    """Rules of three packages made of the benchmark's words."""
    words = benchmark_words(spark, sf).where(F.length("word") >= 6)
    pkg = lambda n: F.concat(F.lit("p"), (n % 3).cast("string")).alias("pkg")
    made = F.array(
        F.struct(F.lit("contains").alias("kind"), F.substring("word", 2, 5).alias("marker")),
        F.struct(F.lit("suffix").alias("kind"), F.right("word", F.lit(4)).alias("marker")),
        F.struct(F.lit("prefix").alias("kind"), F.substring("word", 1, 4).alias("marker")),
        F.struct(F.lit("keep").alias("kind"), F.col("word").alias("marker")),
    )
    positive = words.select(pkg(F.length("word")), F.explode(made).alias("r")).select("pkg", "r.kind", "r.marker")
    denied = words.select(pkg(F.length("word") + 1), F.lit("deny").alias("kind"), F.col("word").alias("marker"))
    longer = spark.createDataFrame([("p2", "longer", "16")], "pkg string, kind string, marker string")
    return cut(positive.unionByName(denied).unionByName(longer), "rules")


@query(f"WITH {TOK}, {CASED}, {BENCH}, {RULES} SELECT pkg, word, kind, marker FROM rh")
def rule_hits(spark, sf):
    return S.rule_hits(cased_words(spark, sf), rules(spark, sf))


@query(f"""WITH {TOK}, {CASED}, {BENCH}, {RULES} SELECT pkg, word FROM rh GROUP BY 1, 2
  HAVING bool_or(kind <> 'deny') AND NOT bool_or(kind = 'deny')""")
def harvest_by_rules(spark, sf):
    return S.harvest_by_rules(cased_words(spark, sf), rules(spark, sf))


@query(f"""WITH {TOK}, {CASED}, {BENCH}, {RULES}, o AS (SELECT *, row_number() OVER (PARTITION BY pkg, word ORDER BY
    list_position(['deny', 'keep', 'suffix', 'prefix', 'contains', 'longer'], kind), -length(marker), marker) AS rn FROM rh)
  SELECT pkg, word, kind, marker FROM o WHERE rn = 1""")
def deciding_rules(spark, sf):
    return S.deciding_rules(cased_words(spark, sf), rules(spark, sf))


# --- package graphs ---------------------------------------------------------

# Four packages with graphs of their own; the last harvests from the finished first one.
GRAPH_ROWS = [
    ("es", "words", "words", [], {}),
    ("es", "valid", "valid", ["words"], {"min_length": "2"}),
    ("es", "allowed", "deny", ["valid"], {}),
    ("es", "titles", "titles", ["allowed"], {}),
    ("es", "plurals", "plurals", ["titles"], {"rule": "general"}),
    ("es", "package", "filter", ["plurals"], {}),
    ("en", "words", "words", [], {}),
    ("en", "roots", "valid", ["words"], {"min_length": "6", "max_length": "12"}),
    ("en", "forms", "affixes", ["roots"], {}),
    ("en", "both", "merge", ["roots", "forms"], {}),
    ("en", "allowed", "deny", ["both"], {}),
    ("en", "filtered", "filter", ["allowed"], {}),
    ("en", "package", "keep", ["filtered"], {}),
    ("fr", "words", "words", [], {}),
    ("fr", "valid", "valid", ["words"], {"min_length": "4"}),
    ("fr", "gender", "gender", ["valid"], {}),
    ("fr", "package", "filter", ["gender"], {}),
    ("de", "words", "words", [], {}),
    ("de", "valid", "valid", ["words"], {"min_length": "5"}),
    ("de", "spanish", "harvest", ["es:package"], {}),
    ("de", "both", "merge", ["valid", "spanish"], {}),
    ("de", "plurals", "plurals", ["both"], {"rule": "general"}),
    ("de", "allowed", "deny", ["plurals"], {}),
    ("de", "package", "filter", ["allowed"], {}),
]
AFFIXES = [("en", "suffix", "ism"), ("en", "suffix", "ist"), ("en", "prefix", "anti"), ("fr", "suffix", "isme")]
GRAPH_RULES = [("de", "contains", "ci"), ("de", "contains", "est"), ("de", "suffix", "dad"), ("de", "deny", "ciudad")]
NOT_DENIED = "lower(word) NOT IN ('the', 'of', 'and')"
LETTERS = LQ.LETTERS_OK
GRAPH_SQL = f"""{REF}, {BENCH},
g1 AS (SELECT pkg, word FROM cased WHERE pkg = 'es' AND {valid('word', 2)} AND {NOT_DENIED}),
g2 AS (SELECT * FROM g1 UNION SELECT pkg, upper(word[1]) || word[2:] FROM g1 WHERE {_in('lower(word)', TITLES)} AND regexp_matches(word, '^\\p{{Ll}}')),
g3 AS (SELECT * FROM g2 UNION SELECT * FROM (SELECT pkg, {PLURAL_SQL['general']} AS word FROM g2) WHERE word IS NOT NULL),
{_filtered('g3', 'gs')},
g4 AS (SELECT pkg, word FROM cased WHERE pkg = 'en' AND {valid('word', 6, 12)}),
g5 AS (SELECT * FROM g4 UNION SELECT * FROM (SELECT pkg, word || unnest(['ism', 'ist']) AS word FROM g4) WHERE length(word) BETWEEN 5 AND 42 AND {LETTERS}
  UNION SELECT * FROM (SELECT pkg, 'anti' || word AS word FROM g4) WHERE length(word) BETWEEN 6 AND 42 AND {LETTERS}),
g6 AS (SELECT * FROM g5 WHERE {NOT_DENIED}), {_filtered('g6', 'g7')},
ge AS (SELECT * FROM g7 UNION SELECT 'en', word FROM bench WHERE {valid('word')}),
g8 AS (SELECT pkg, word FROM cased WHERE pkg = 'fr' AND {valid('word', 4)}),
g9 AS (SELECT DISTINCT pkg, unnest({_gender_sql(V.GENDER_PAIRS)}) AS word FROM g8 WHERE {valid('word')}), {_filtered('g9', 'gf')},
h1 AS (SELECT pkg, word FROM cased WHERE pkg = 'de' AND {valid('word', 5)}
  UNION SELECT 'de', word FROM gs WHERE ({_any('lower(word)', ('ci', 'est'))} OR ends_with(lower(word), 'dad')) AND lower(word) <> 'ciudad'),
h2 AS (SELECT * FROM h1 UNION SELECT * FROM (SELECT pkg, {PLURAL_SQL['general']} AS word FROM h1) WHERE word IS NOT NULL),
h3 AS (SELECT * FROM h2 WHERE {NOT_DENIED}), {_filtered('h3', 'gd')}"""


@query(f"WITH {GRAPH_SQL} SELECT pkg, word FROM gs UNION ALL SELECT * FROM ge UNION ALL SELECT * FROM gf UNION ALL SELECT * FROM gd")
def package_graph(spark, sf):
    steps = spark.createDataFrame(GRAPH_ROWS, G.STEPS)
    listed = "pkg string, kind string, marker string"
    tables = G.PackageTables(
        words=cut(cased_words(spark, sf), "cased"),
        denied=LQ.denied(spark, sf),
        affixes=spark.createDataFrame(AFFIXES, listed),
        rules=spark.createDataFrame(GRAPH_RULES, listed),
        titles=spark.createDataFrame([("es", w) for w in TITLES], "pkg string, word string"),
        keep=benchmark_words(spark, sf).select(F.lit("en").alias("pkg"), "word"),
        reference=cut(LQ.reference(spark, sf), "reference"),
    )
    return G.build_graphs(G.steps_of(steps), tables)


# --- feedback ---------------------------------------------------------------

# Decisions on the benchmark's words in two packages: (round, length that is divided, decision, time).
ROUNDS = [(1, 2, "add", 1), (2, 3, "deny", 2), (3, 5, "add", 3), (3, 7, "deny", 0)]
DECISIONS = " UNION ALL ".join(
    f"SELECT pkg, word, '{d}' AS decision, {ts} AS ts FROM bench, (SELECT unnest(['es', 'en']) AS pkg) WHERE length(word) % {n} = 0"
    for _, n, d, ts in ROUNDS
)
FEEDBACK = f"""{REF}, {BENCH}, dec AS ({DECISIONS}),
last AS (SELECT pkg, lower(word) AS key, arg_max(decision, (ts, decision)) AS decision FROM dec GROUP BY 1, 2),
gone AS (SELECT pkg, key FROM (SELECT pkg, unnest(['the', 'of', 'and']) AS key FROM (SELECT unnest(['de', 'en', 'es', 'fr']) AS pkg))
    ANTI JOIN last USING (pkg, key) UNION SELECT pkg, key FROM last WHERE decision = 'deny'),
src AS (SELECT pkg, word FROM cased UNION SELECT d.pkg, d.word FROM dec d JOIN last l ON l.pkg = d.pkg AND l.key = lower(d.word)
    WHERE d.decision = 'add' AND l.decision = 'add'),
f0 AS (SELECT pkg, word FROM src WHERE {valid('word', 2)} AND (pkg, lower(word)) NOT IN (SELECT pkg, key FROM gone)),
f1 AS (SELECT * FROM f0 UNION SELECT pkg, upper(word[1]) || word[2:] FROM f0 WHERE {_in('lower(word)', TITLES)} AND regexp_matches(word, '^\\p{{Ll}}')),
fp AS (SELECT pkg, {PLURAL_SQL['general']} AS word FROM f1),
f2 AS (SELECT * FROM f1 UNION SELECT * FROM fp WHERE word IS NOT NULL AND {valid('word', 2)} AND (pkg, lower(word)) NOT IN (SELECT pkg, key FROM gone)),
{_filtered('f2', 'f3')}, f4 AS (SELECT * FROM f3 UNION SELECT 'es', word FROM bench), {_filtered('f4', 'f5')}"""


@query(f"WITH {FEEDBACK} SELECT pkg, word FROM f5")
def package_feedback(spark, sf):
    """Packages after three rounds of decisions, of which each changes only what its words can change."""
    bench = cut(benchmark_words(spark, sf), "bench")
    cased = stored_words(spark, sf)
    seeds, reference = bench.select(F.lit("es").alias("pkg"), "word"), LQ.spanish(cased)
    packages = B.MaintainedPackages(
        spark,
        new_folder(spark, "packages"),
        lambda words, denied: K.build_package(words, denied, TITLES, "general", seeds, reference),
        B.plural_and_title("general"),
        BUCKET_ROWS,
    )
    languages = F.explode(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")])).alias("pkg")
    packages.start(cased, LQ.denied_of(cased).select(languages, "word"))
    two = F.explode(F.array(F.lit("es"), F.lit("en"))).alias("pkg")
    for mark in sorted({r for r, *_ in ROUNDS}):
        parts = [
            bench.where(F.length("word") % n == 0).select(two, "word", F.lit(d).alias("decision"), F.timestamp_seconds(F.lit(ts)).alias("ts"))
            for r, n, d, ts in ROUNDS
            if r == mark
        ]
        packages.apply(cut(reduce(DataFrame.unionByName, parts), "decisions"), mark)
    return packages.words()
