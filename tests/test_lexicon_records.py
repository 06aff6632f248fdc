import datetime
import os
import tempfile

from pyspark.sql import functions as F

from orthoflow.operators import lexicon as L
from orthoflow.operators import records as R
from orthoflow.plans import packages as G
from orthoflow.sources import lexicon_files as S
from orthoflow.session import cut, scratch
from orthoflow.sources.lexicon_files import read_wordlist
from orthoflow.sources.units import html_text, repaired_text
from orthoflow.streaming.review_stream import review_batch, review_stream, reviewed


def bag(spark, *words, pkg="p"):
    return spark.createDataFrame([(pkg, w) for w in words], "pkg string, word string")


def words(df):
    return {r.word for r in df.collect()}


def test_masked_forms_and_plurals(spark):
    b = bag(spark, "técnico", "tecnico", "tecnica", "elecciones", "eleccion", "the", "casa")
    assert words(L.orthography_filter(b)) == {"técnico", "elecciones", "casa"}
    assert words(L.orthography_filter(b, variant="loanword")) == {"técnico", "tecnica", "casa", "the"}
    assert words(L.scrub_missing_accents(b)) == {"técnico", "elecciones", "casa", "the"}


def test_filter_is_idempotent_and_adds_up(spark):
    b = bag(spark, "técnico", "tecnico", "running", "analisis", "casa", "Casa")
    once = L.orthography_filter(b)
    assert words(L.orthography_filter(once)) == words(once)
    report = {r.reason: r.words for r in L.filter_report(L.orthography_reasons(b)).where("pkg is not null").collect()}
    assert report.pop("input") == sum(report.values()) == 6


def test_seeds_do_not_bring_masked_forms_back(spark):
    kept, seeds = bag(spark, "técnico"), bag(spark, "tecnico", "nuevo")
    assert words(L.seed_then_refilter(kept, seeds)) == {"técnico", "nuevo"}
    assert words(L.seed_then_refilter(kept, seeds, variant="loanword")) == {"técnico", "tecnico", "nuevo"}


def test_build_package(spark):
    built = G.build_package(
        bag(spark, "amparo", "derecho", "Cosas", "casación", "casacion", "x1"),
        spark.createDataFrame([("cosas",)], "word string"), ["derecho"], "general", bag(spark, "habeas", "Casacion"),
    )
    assert words(built) == {"amparo", "amparos", "derecho", "derechos", "Derecho", "Derechos", "casación", "habeas"}


def test_files(spark):
    folder = tempfile.mkdtemp()
    path = os.path.join(folder, "x.dic")
    with open(path, "w", encoding="utf-8") as f:
        f.write("4\nacción/S\ncasa\n3d\nPerro/GS\n")
    rows = {(r.word, r.flags, r.has_diacritic) for r in S.read_lexicon(spark, path).collect()}
    assert rows == {("acción", "S", True), ("casa", "", False), ("Perro", "GS", False)}
    with open(path, "w", encoding="utf-8") as f:
        f.write("# nota\n\nuno 12\nd0s\ntres\n")
    assert words(S.read_wordlist(spark, path)) == {"uno", "tres"}
    S.write_lexicon(bag(spark, "b", "B", "a", "a"), os.path.join(folder, "out"))
    lines = []
    for name in sorted(os.listdir(os.path.join(folder, "out"))):
        if name.startswith("part-"):
            lines += open(os.path.join(folder, "out", name), encoding="utf-8").read().split()
    assert lines == ["3", "a", "B", "b"]


def test_verify_and_probe(spark):
    lines = spark.createDataFrame([("p", x) for x in ["3", "Uno", "uno", "dós"]], "pkg string, line string")
    r = L.verify_lexicon(lines).first()
    assert (r.declared, r.in_file, r.accented, r.exact_duplicates, r.case_pairs, r.passed) == (3, 3, 1, 0, 1, True)
    probes = spark.createDataFrame([("p", "a", True), ("p", "z", False)], "pkg string, word string, expect boolean")
    assert all(r.passed for r in L.probe_lexicon(bag(spark, "a"), probes).collect())


def test_reuse_plan(spark):
    items = spark.createDataFrame([(1, "r1"), (2, None), (3, None)], "id long, path_rev string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    plan = {r.id: r.action for r in R.plan_review(items, ids(1), ids(2)).collect()}
    assert plan == {1: "fresh", 2: "reuse", 3: "fresh"}
    assert [r.has_errors for r in R.reused_results(items).orderBy("id").collect()] == [True, False, False]


def test_row_changes(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, label string")
    at = lambda n: datetime.datetime(2026, 1, 1, 0, 0, n)
    changes = spark.createDataFrame(
        [(1, "D", "", at(1)), (2, "U", " bb ", at(1)), (2, "U", "bbb", at(2)), (3, "U", " ", at(1)), (4, "I", "d", at(1)), (5, "I", "", at(1)), (6, "U", "f", at(1))],
        "id long, op string, label string, ts timestamp",
    )
    got = {tuple(r) for r in R.apply_row_changes(table, changes, ["id"], "label", []).collect()}
    assert got == {(2, "bbb"), (3, "c"), (4, "d")}


def test_stream_reviews_new_and_changed_documents_once(spark):
    base = tempfile.mkdtemp()
    lexicon = spark.createDataFrame([("es", "casación", 5)], "lang string, word string, df long")
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("ts", F.current_timestamp())

    def run():
        stream = spark.readStream.schema("doc_id long, lang string, text string, ts timestamp").parquet(f"{base}/in")
        review_stream(stream, "ts", lexicon, f"{base}/out", f"{base}/ckpt").awaitTermination()
        return {r.doc_id: r.total_errors for r in reviewed(spark, f"{base}/out").collect()}

    docs((1, "es", "casacion"), (2, "es", "bien")).write.parquet(f"{base}/in/a.parquet".replace("a.parquet", ""), mode="append")
    assert run() == {1: 1, 2: 0}
    docs((1, "es", "casación"), (2, "es", "bien")).write.parquet(f"{base}/in/", mode="append")
    assert run() == {1: 0, 2: 0}
    batches = spark.read.parquet(f"{base}/out").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in batches} == {1: 2, 2: 1}


def test_stream_keeps_late_reverted_and_out_of_order_versions(spark):
    base = tempfile.mkdtemp()
    lexicon = spark.createDataFrame([("es", "casación", 5)], "lang string, word string, df long")
    day = lambda n: datetime.datetime(2026, 1, n)

    def run(*rows):
        new = spark.createDataFrame([(d, "es", t, day(n)) for d, t, n in rows], "doc_id long, lang string, text string, ts timestamp")
        new.coalesce(1).write.parquet(f"{base}/in", mode="append")
        stream = spark.readStream.schema(new.schema).parquet(f"{base}/in")
        review_stream(stream, "ts", lexicon, f"{base}/out", f"{base}/ckpt").awaitTermination()
        return {r.doc_id: r.total_errors for r in reviewed(spark, f"{base}/out").collect()}

    assert run((1, "casacion", 10), (2, "casacion", 10)) == {1: 1, 2: 1}
    assert run((1, "bien", 11), (3, "casacion", 2)) == {1: 0, 2: 1, 3: 1}  # a change, and a late new document
    assert run((1, "casacion", 12)) == {1: 1, 2: 1, 3: 1}  # back to earlier content
    assert run((1, "bien", 9), (2, "casacion", 13)) == {1: 1, 2: 1, 3: 1}  # older version; same content again
    assert run((2, "bien", 12)) == {1: 1, 2: 1, 3: 1}  # older than the repeat
    assert spark.read.parquet(f"{base}/out").where("doc_id = 2").count() == 1


def test_replayed_batch_stores_nothing_twice(spark):
    base = tempfile.mkdtemp()
    lexicon = spark.createDataFrame([("es", "casación", 5)], "lang string, word string, df long")
    batch = spark.createDataFrame([(1, "es", "casacion", datetime.datetime(2026, 1, 1))], "doc_id long, lang string, text string, ts timestamp")
    for _ in range(2):
        review_batch(batch, 0, lexicon, f"{base}/out")
    review_batch(batch, 1, lexicon, f"{base}/out")
    assert spark.read.parquet(f"{base}/out").count() == 1


def test_tables_of_a_scratch_scope_are_deleted(spark):
    with scratch(spark):
        table = cut(spark.range(3), "three")
        path = table.inputFiles()[0].split("//", 1)[-1]
        assert table.count() == 3
    assert not os.path.exists(path)


def test_tabs_and_line_ends_are_white_space(spark, tmp_path):
    (tmp_path / "words.txt").write_text("gastritis\t123\n\t# note\n  \n\tcolitis \n")
    words = {r.word for r in read_wordlist(spark, str(tmp_path / "words.txt")).collect()}
    assert words == {"gastritis", "colitis"}
    html = "<p>acci&oacute;n a&#241;o a&#xF1;o &lt;b&gt; &amp;lt; &nope; &#1114112;\u00a0x</p>"
    row = spark.createDataFrame([(html, b"\x93hola\x94 \x80 \xe9\x81")], "h string, b binary").select(
        html_text("h").alias("h"), repaired_text("b").alias("b")
    ).first()
    assert row.h == "acción año año <b> &lt; &nope; &#1114112; x" and row.b == "“hola” € é\x81"
