"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orthoflow.llm import (
    exact_dedup,
    fingerprint,
    line_dedup,
    mixing,
    near_dedup,
    pieces,
    pseudonyms,
    quality,
    toxicity,
    url_filter,
)

LONG = "one two three four five six seven eight nine ten " * 20_000
LINE = "this line is in many documents and should be read once only by all\n"
CLASH = "kept keep_id row text_sha256 id mark block place order_key token_ids pseudonyms h label source_key least digest values parts dropped_lines dropped n vector fingerprint url host key node score"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, "alpha beta gamma delta epsilon zeta"), (2, "alpha beta gamma delta epsilon zeta"), (3, ""), (4, None),
        (None, "no id here at all, it is none"), (5, LONG), (6, LINE + "own words six"), (7, LINE + "own words seven"),
        (8, "x"), (9, " \n\t "), (9, " \n\t "), (10, "mail a.b@c.org or 10.0.0.1 on 2020-02-30 and 2020-02-29"), (11, "😀 ñandú ß"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumns({"source": F.when(F.col("doc_id") % 2 == 0, "even"), "lang": F.lit("en"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH.split()}).cache()


@pytest.fixture(scope="module")
def no_rows(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (5, 1, 1), (6, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int")


def test_exact_dedup(odd, no_rows):
    rows = exact_dedup.exact_dedup(odd).collect()
    assert len(rows) == odd.count() and exact_dedup.exact_dedup(no_rows).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r.text_sha256, []).append(r)
    assert all(sum(r.kept for r in g) == 1 and all(r.group_size == len(g) for r in g) for g in by.values())
    assert {r.doc_id: r.keep_id for r in rows if r.doc_id in (1, 2, 3, 4)} == {1: 2, 2: 2, 3: 4, 4: 4}
    assert [r.kept for r in rows if r.doc_id is None] == [True]


def test_exact_dedup_with_few_heavy_digests(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), (F.when(F.col("id") < 100, 0).otherwise(F.col("id") % 50)).cast("string").alias("text"))
    rows = exact_dedup.exact_dedup(df, heavy=2, tracked=8).collect()
    want = {}
    for r in df.collect():
        want[r.text] = max(want.get(r.text, -1), r.doc_id)
    texts = {r.doc_id: r.text for r in df.collect()}
    assert all(r.keep_id == want[texts[r.doc_id]] and r.kept == (r.doc_id == r.keep_id) for r in rows) and len(rows) == 300


def test_classifiers(odd, no_rows, labels):
    for fit, scores, label in (
        (quality.fit_quality, quality.quality_scores, "quality"), (toxicity.fit_toxicity, toxicity.toxicity_scores, "toxic"),
    ):
        for docs, known in ((odd, labels), (odd, labels.limit(0)), (odd, labels.where("doc_id = 1")), (no_rows, labels)):
            model = fit(docs, known, F.lit(True), label)
            got = scores(odd, model).collect()
            assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
            assert scores(no_rows, model).count() == 0
        assert len({r.score for r in got if r.doc_id in (3, 4)}) == 1
    model = quality.fit_quality(odd, labels, F.lit(True))
    assert set(quality.keep_good(odd, model, 0.0).columns) == set(odd.columns)


def test_fingerprints(odd, no_rows):
    rows = {r.doc_id: r for r in fingerprint.edited_fingerprints(odd.where("doc_id is null or doc_id <> 9")).collect()}
    assert len(rows) == odd.count() - 2 and fingerprint.edited_fingerprints(no_rows).count() == 0
    assert rows[1].fingerprint == rows[2].fingerprint != rows[8].fingerprint and rows[3].n_chars == rows[4].n_chars == 0
    assert rows[1].near_next == 1.0 and rows[3].near_next == 1.0 and all(0 <= r.near_edited <= 1 for r in rows.values())
    assert fingerprint.edited_fingerprints(odd).count() == odd.count()
    assert fingerprint.fingerprints(odd).count() == odd.count()


def test_line_dedup(odd, no_rows):
    done = line_dedup.line_dedup(odd)
    rows = {r.doc_id: r for r in done.collect()}
    assert done.count() == odd.count() and set(done.columns) == set(odd.columns)
    assert rows[6].text == LINE + "own words six" and rows[7].text == "own words seven" and rows[7].dropped_lines == [0]
    assert rows[1].dropped_lines == [] and rows[2].text == "" and rows[4].text is None and rows[3].text == "" and rows[5].text == LONG
    assert rows[7].id == "own id" and rows[7].mark == "own mark" and line_dedup.line_dedup(no_rows).count() == 0


def test_templates_with_variable_fields(spark):
    lines = [f"Page printed on day {i} for the reader called {name} of the city library" for i, name in enumerate(["Ann", "Bob", "Eve"])]
    texts = [(i, f"clean words of document number {w} are only here and nowhere else, be sure of it\n{lines[i]}") for i, w in enumerate(["one", "two words", "three more words"])]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {0: texts[0][1], 1: texts[1][1].split("\n")[0], 2: texts[2][1].split("\n")[0]}


def test_mixing(odd, no_rows):
    done = mixing.mix_sources(odd)
    assert set(done.columns) == set(odd.columns) | {"block", "order_key", "place"} and mixing.mix_sources(no_rows).count() == 0
    assert {r.doc_id for r in done.collect()} == {r.doc_id for r in odd.collect()}
    assert mixing.mix_sources(odd.where("doc_id in (3, 4)")).count() == 2
    assert mixing.mix_sources(odd, target_entropy=0.1, max_repetition=None, budget_tokens=1000).count() > 0


def test_near_dedup(odd, no_rows):
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and near_dedup.near_duplicates(no_rows).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r.class_id, []).append(r)
    assert all(sum(r.kept for r in g) == 1 and all(r.class_size == len(g) for r in g) for g in by.values())
    assert {r.class_id for r in rows if r.doc_id in (1, 2)} == {1} and {r.class_id for r in rows if r.doc_id in (3, 4)} == {3}
    kept = near_dedup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len(by)


def test_pseudonyms(odd, no_rows):
    done = pseudonyms.pseudonymize(odd)
    rows = {r.doc_id: r for r in done.collect()}
    assert done.count() == odd.count() and set(done.columns) == set(odd.columns) and rows[10]["values"] == "own values"
    assert [p.kind for p in rows[10].pseudonyms] == ["email", "ip", "iso_date"] and "2020-02-30" in rows[10].text
    assert rows[4].text is None and rows[4].pseudonyms == [] and rows[5].text == LONG and pseudonyms.pseudonymize(no_rows).count() == 0


def test_pieces(odd, no_rows):
    encoded = pieces.encode_documents(odd)
    again = encoded.withColumn("again", pieces.decode(encoded)).collect()
    assert all(r.again == (r.text or "") for r in again) and len(again) == odd.count()
    assert set(encoded.columns) == set(odd.columns) and pieces.encode_documents(no_rows).count() == 0


def test_url_filter(spark):
    rows = [
        (1, None), (2, "no scheme"), (3, "http://A.Com?x"), (4, "https://www.a.com/p/?b=1&utm_source=x&a=2#f"), (4, "https://www.a.com/p/?b=1&utm_source=x&a=2#f"),
        (5, "http://a.com/p?a=2&b=1"), (6, "http://x.org/p"), (7, "http://xorg/p"), (8, "http://"), (9, "http://org"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "path", "canonical", "block", "rule", "listed")})
    listed = spark.createDataFrame([("http://a.com/p?b=1&a=2",), (None,), ("x",)], "url string")
    rules = [("allow", "org", "/"), ("block", "org", "/")]
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, listed, rules).collect() if r.page_id)
    verdicts = {g[0]: g[4] for g in got}
    assert len(got) == 10 and verdicts == {1: "allow", 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "block", 7: "allow", 8: "allow", 9: "allow"}
    assert got[0][1:4] == ("", "", None) and got[2][1:4] == ("a.com", "", None) and got[6][3] == "org/"
    assert url_filter.url_filter(pages, listed.limit(0), rules).where("verdict = 'block'").count() == 1
    assert url_filter.url_filter(pages.limit(0), listed, rules).count() == 0


def test_url_filter_beyond_the_broadcast(spark, monkeypatch):
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.com/"), (F.col("id") % 700).cast("string")).alias("url"))
    listed = pages.where("page_id % 3 = 0").select("url")
    want = sorted(map(tuple, url_filter.url_filter(pages, listed, []).collect()), key=str)
    monkeypatch.setattr(url_filter, "fits_broadcast", lambda *a: False)
    assert sorted(map(tuple, url_filter.url_filter(pages, listed, []).collect()), key=str) == want
    blocked = {r.url for r in listed.collect()}
    assert sum(r[4] == "block" for r in want) == sum(r.url in blocked for r in pages.collect())


def test_pipeline_stages(odd, no_rows, labels, tmp_path, spark):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, no_rows):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            done = stage(spark, docs, str(tmp_path))
            assert done.columns == docs.columns, name
            count = done.count()
            assert (count > 0) == (docs is odd), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
