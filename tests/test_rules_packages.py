"""Rule tables, package graphs, feedback, numbering and prefilters against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from orthoflow.operators import lexicon as L
from orthoflow.operators import marking as M
from orthoflow.operators import rules as S
from orthoflow.operators import verdicts as D
from orthoflow.operators.numbering import numbered
from orthoflow.operators.prefilter import key_filter
from orthoflow.plans import feedback as B
from orthoflow.plans import package_graph as G
from orthoflow.plans import packages as K
from orthoflow.plans import review as Q
from orthoflow.session import cut
from orthoflow.sources.snapshots import KeyedTable
from orthoflow.sources.units import ordered_parts

LETTERS = "abcdeñ"


def words_of(rng, n, low=1, high=9):
    return ["".join(rng.choices(LETTERS, k=rng.randint(low, high))) for _ in range(n)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# rules


def brute_hits(words, rules):
    out = set()
    for word in words:
        low = word.lower()
        for pkg, kind, marker in rules:
            m = marker.lower()
            hit = {
                "contains": lambda: m != "" and m in low,
                "suffix": lambda: m != "" and low.endswith(m),
                "prefix": lambda: m != "" and low.startswith(m) and len(low) >= len(m) + 3,
                "keep": lambda: low == m,
                "deny": lambda: low == m,
                "longer": lambda: len(low) >= int(m),
            }[kind]()
            if hit:
                out.add((pkg, word, kind, m))
    return out


def test_rule_hits_against_brute_force(spark):
    rng = random.Random(3)
    words = [w.upper() if rng.random() < 0.1 else w for w in words_of(rng, 400)] + ["", None]
    rules = [(rng.choice("pqr"), rng.choice(["contains", "suffix", "prefix", "keep", "deny"]), m) for m in words_of(rng, 300, 1, 6)]
    rules += [("p", "longer", "8"), ("q", "longer", "3"), ("r", "contains", ""), ("r", "suffix", None)]
    given = spark.createDataFrame(rules, "pkg string, kind string, marker string")
    table = spark.createDataFrame([("x", w) for w in words], "pkg string, word string")
    got = {tuple(r) for r in S.rule_hits(table, given).collect()}
    want = brute_hits([w for w in words if w is not None], [r for r in rules if r[2] is not None])
    assert got == want
    wanted = {(p, w) for p, w, k, _ in want if k != "deny"} - {(p, w) for p, w, k, _ in want if k == "deny"}
    assert {tuple(r) for r in S.harvest_by_rules(table, given).collect()} == wanted
    order = ["deny", "keep", "suffix", "prefix", "contains", "longer"]
    first = {}
    for p, w, k, m in sorted(want, key=lambda h: (order.index(h[2]), -len(h[3]), h[3])):
        first.setdefault((p, w), (k, m))
    assert {(r.pkg, r.word): (r.kind, r.marker) for r in S.deciding_rules(table, given).collect()} == first


def test_a_hundred_thousand_markers_need_no_nested_loop(spark):
    rng = random.Random(4)
    markers = sorted({"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 6))) for _ in range(110_000)})[:100_000]
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(4, 14))) for _ in range(400)]
    rules = spark.createDataFrame([("p", "contains", m) for m in markers], "pkg string, kind string, marker string")
    hits = S.rule_hits(spark.createDataFrame([(w,) for w in words], "word string"), rules)
    assert not any(n in plan_of(hits) for n in ("NestedLoop", "Cartesian"))
    listed = set(markers)
    want = {(w, w[i:j]) for w in words for i in range(len(w)) for j in range(i + 3, min(i + 6, len(w)) + 1) if w[i:j] in listed}
    assert {(r.word, r.marker) for r in hits.collect()} == want and len(want) > 200


# prefilter, marks


def test_prefilter_loses_nothing_and_lets_little_through(spark):
    keys = cut(spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key")), "keys")
    rows = spark.range(200_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    kept = key_filter(keys).keep(rows, "key")
    assert kept.join(keys, "key").count() == 3000 and kept.count() < 1.1 * 3000 and kept.columns == rows.columns
    large = key_filter(keys, most_bytes=100)
    assert large.rows is None and large.keep(rows, "key").count() == 200_000
    assert key_filter(keys.limit(0)).keep(rows, "key").count() == 0


def test_few_rows_beside_the_hits_reach_the_join(spark):
    docs = [(d, " ".join([f"word{d}x{i}" for i in range(300)] + [f"errror{d % 7}"] * 5)) for d in range(200)]
    errors = cut(spark.createDataFrame([(d, f"errror{d % 7}") for d in range(200)], "doc_id long, key string"), "errors")
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    asked = key_filter(errors).keep(M._word_rows(documents, F.length), "key").count()
    hits = M.mark_occurrences(documents, errors).count()
    assert hits == 1000 and asked < 1.3 * hits


def test_splice_takes_whole_pieces_before_their_parts(spark):
    text = "Él dijo: l'área, O'Neill y área ÁREA; d'x"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "área"), (4, "")], "doc_id long, text string")
    errors = spark.createDataFrame([(1, k) for k in ("área", "o'neill", "neill", "y", "x")] + [(2, "y"), (4, "a")], "doc_id long, key string")
    got = {r.doc_id: r.text for r in M.highlight_text(docs, errors).collect()}
    assert got == {1: "Él dijo: l'[[área]], [[O'Neill]] [[y]] [[área]] [[ÁREA]]; d'[[x]]", 2: None, 3: "área", 4: ""}
    fixes = spark.createDataFrame([(1, "área", "zona"), (1, "área", "área!"), (1, "d'x", "")], "doc_id long, original string, replacement string")
    got = {r.doc_id: r.text for r in M.apply_corrections(docs, fixes).collect()}
    assert got[1] == "Él dijo: l'área!, O'Neill y área! ÁREA; "


def test_marks_of_decomposed_text_are_in_its_own_places(spark):
    text = "La casación y el año, casación: niños"
    docs = spark.createDataFrame([(1, text), (2, "la casación")], "doc_id long, text string")
    errors = spark.createDataFrame([(1, "casación"), (1, "niños"), (1, "la"), (2, "casación")], "doc_id long, key string")
    got = sorted((r.doc_id, r.key, text[r.start_at : r.end_at] if r.doc_id == 1 else "", r.blocked) for r in M.mark_composed(docs, errors).collect())
    assert got == [
        (1, "casación", "casación", True), (1, "casación", "casación", False), (1, "la", "La", False),
        (1, "niños", "niños", True), (2, "casación", "", False),
    ]


# numbering


def test_numbering_needs_no_task_for_a_whole_group(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, "hot", "hot", "hot", "cold"]), i, rng.random()) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, i long, x double").repartition(7)
    for keys in ([], ["g"]):
        got = numbered(df, keys, [F.desc("x"), "i"]).collect()
        want, seen = {}, {}
        for g, i, _ in sorted(rows, key=lambda r: (-r[2], r[1])):
            k = g if keys else 0
            want[i] = seen.get(k, 0)
            seen[k] = want[i] + 1
        assert {r.i: r.place for r in got} == want
    batches = D.corpus_batches(df, ["i"]).collect()
    assert all(r.batch == r.i // 40 for r in batches)
    assert numbered(df.limit(0), ["g"], ["i"]).count() == 0


def test_parts_of_a_document_with_very_many(spark):
    parts = [(1, f"p{i:05}") for i in range(3000)] + [(2, "b"), (2, "a"), (None, "z")]
    manifest = [(1, f"p{i:05}", -i) for i in range(0, 3000, 3)]
    got = ordered_parts(
        spark.createDataFrame(parts, "doc_id long, part_name string"), spark.createDataFrame(manifest, "doc_id long, part_name string, position long")
    ).collect()
    assert {(r.doc_id, r.part_name): r.place for r in got} == {
        **{(1, f"p{i:05}"): (2997 - i) // 3 for i in range(0, 3000, 3)}, (2, "a"): 0, (2, "b"): 1, (None, "z"): 0,
    }


# reports and decisions


def test_one_report_per_key_and_no_file_for_a_second_run(spark, tmp_path):
    reports = KeyedTable(spark, str(tmp_path / "r"), ["key"], bucket_rows=10)
    rows = lambda v: spark.createDataFrame([(f"rev_{i}_errores.json", v) for i in range(40)], "key string, report string")
    Q.store_reports(reports, rows("old"))
    Q.store_reports(reports, rows("new").unionByName(rows("a")))
    before = reports.snapshot()
    assert Q.store_reports(reports, rows("new")) is None and reports.snapshot() == before
    assert {tuple(r) for r in reports.read().collect()} == {(f"rev_{i}_errores.json", "new") for i in range(40)}


def test_newest_decision_counts(spark):
    rows = [("Foo", "add", 1), ("foo", "deny", 2), ("bar", "deny", 1), ("bar", "add", 3), ("x", "add", 1), ("x", "deny", 1)]
    got = Q.newest_decisions(spark.createDataFrame(rows, "word string, decision string, ts int")).collect()
    assert {r.key: r.decision for r in got} == {"foo": "deny", "bar": "add", "x": "deny"}


@pytest.mark.parametrize("seed", [1, 2])
def test_feedback_equals_a_full_build_after_every_round(spark, tmp_path, seed):
    rng = random.Random(seed)
    stems = ["técnic", "medic", "médic", "logic", "lógic", "accion", "acción", "arbol", "árbol", "casa", "que", "luz", "pez"]
    make = lambda: rng.choice(stems) + rng.choice(["", "o", "a", "os", "as", "es", "ción"])
    cased = lambda w: rng.choice([w, w, w.capitalize(), w.upper()])
    bag = spark.createDataFrame(sorted({(rng.choice("pq"), cased(make())) for _ in range(80)}), "pkg string, word string")
    denied = spark.createDataFrame([("p", make()) for _ in range(4)] + [("q", make())], "pkg string, word string")
    seeds = spark.createDataFrame([("p", "tecnicas"), ("q", "arbol")], "pkg string, word string")
    build = lambda words, no: K.build_package(words, no, ["que", "casa"], "general", seeds)
    packages = B.MaintainedPackages(spark, str(tmp_path / "p"), build, B.plural_and_title("general"), 20)
    packages.start(bag, denied)
    said = None
    for mark in range(3):
        rows = [(rng.choice("pq"), cased(make()), rng.choice(["add", "deny"]), rng.randrange(10)) for _ in range(4)]
        now = spark.createDataFrame(rows, "pkg string, word string, decision string, t int").selectExpr("pkg", "word", "decision", "timestamp_seconds(t) AS ts")
        now = cut(now, "round")
        said = now if said is None else said.unionByName(now)
        packages.apply(now, mark)
        assert not packages.apply(now, mark)
        words, no = B.decided_words(bag, denied, said)
        assert {tuple(r) for r in packages.words().collect()} == {tuple(r) for r in build(words, no).select("pkg", "word").collect()}, rows


# package graphs


def tables(spark, **more):
    words = spark.createDataFrame([("a", "técnico"), ("a", "tecnico"), ("a", "que"), ("b", "casa"), ("b", "x"), ("c", "bien")], "pkg string, word string")
    return G.PackageTables(words=words, **more)


def test_steps_of_many_packages_run_as_one_job(spark):
    rows = [(p, s, k, i, {}) for p in "abc" for s, k, i in (("w", "words", []), ("v", "valid", ["w"]), ("package", "filter", ["v"]))]
    rows[-1] = ("c", "package", "merge", ["v", "b:package"], {})
    done = G.run_steps(G.steps_of(spark.createDataFrame(rows, G.STEPS)), tables(spark))
    assert done["a", "w"] is done["b", "w"] is done["c", "w"] and done["a", "package"] is done["b", "package"] is not done["c", "package"]
    got = {tuple(r) for r in G.build_graphs(G.steps_of(spark.createDataFrame(rows, G.STEPS)), tables(spark)).collect()}
    assert got == {("a", "técnico"), ("a", "que"), ("b", "casa"), ("c", "bien"), ("c", "casa")}


def test_two_equal_steps_of_one_package_are_two_jobs(spark):
    steps = [
        G.Step("a", "w", "words"), G.Step("a", "x", "plurals", ("w",)), G.Step("a", "y", "plurals", ("w",)), G.Step("a", "package", "merge", ("x", "y")),
    ]
    got = {r.word for r in G.build_graphs(steps, tables(spark)).collect()}
    assert got == {"técnico", "técnicos", "tecnico", "tecnicos", "que"}


@pytest.mark.parametrize(
    ("steps", "message"),
    [
        ([("a", "package", "words", ()), ("a", "package", "words", ())], "twice"),
        ([("a", "package", "merge", ("b:package",))], "not there"),
        ([("a", "w", "words", ())], "without a step"),
        ([("a", "package", "magic", ("w",))], "no known kind"),
        ([("a", "package", "words", ("a:package",))], "must have no inputs"),
        ([("a", "package", "merge", ())], "must have inputs"),
        ([("a", "package", "merge", ("b:package",)), ("b", "package", "merge", ("a:package",))], "wait for one another"),
    ],
)
def test_wrong_graphs_are_refused(spark, steps, message):
    with pytest.raises(ValueError, match=message):
        G.run_steps([G.Step(p, s, k, tuple(i)) for p, s, k, i in steps], tables(spark))


def test_affixes_of_each_package(spark):
    roots = spark.createDataFrame([("a", "form"), ("b", "form"), ("c", "form"), ("a", "x")], "pkg string, word string")
    affixes = spark.createDataFrame([("a", "suffix", "ismo"), ("a", "prefix", "anti"), ("b", "suffix", "al")], "pkg string, kind string, marker string")
    got = {tuple(r) for r in G.affixed_forms(roots, affixes).collect()}
    assert got == {("a", "formismo"), ("a", "antiform"), ("b", "formal"), ("a", "xismo")}


def test_removed_words_of_a_package(spark):
    bag = lambda rows: spark.createDataFrame(rows, "pkg string, word string")
    got = L.force_keep(bag([("a", "x"), ("b", "x")]), bag([("a", "y")]), removed=bag([("a", "x")])).collect()
    assert {tuple(r) for r in got} == {("b", "x"), ("a", "y")}
