"""Operators on cases where a part of the work would go unseen: edits that shift, families, many templates."""

import random

import pytest
from pyspark.sql import functions as F

from orthoflow.llm import common, fingerprint, line_dedup, near_dedup, pseudonyms, queries, training, url_filter


def test_one_word_put_in_keeps_the_likeness(spark):
    words = [f"w{i * 7919 % 1000}" for i in range(240)]
    texts = [(f"new {' '.join(words)}", "front"), (" ".join(words[:120] + ["new"] + words[120:]), "middle"), (" ".join(words[1:]), "out")]
    df = spark.createDataFrame([(" ".join(words), t, k) for t, k in texts], "a string, b string, k string")
    v = df.select("k", *[fingerprint.paragraph_vector(c).alias(c) for c in "ab"]).select("*", *[fingerprint.signs(c).alias(f"{c}s") for c in "ab"])
    got = {r.k: r.s for r in v.select("k", fingerprint.likeness("a", "b", "as", "bs").alias("s")).collect()}
    assert min(got.values()) > 0.9, got


def test_counters_of_very_long_texts_do_not_run_over(spark):
    df = spark.createDataFrame([("one two three four five six " * 20_000,)], "a string").withColumn("b", F.expr("left(a, length(a) / 2)"))
    v = df.select(*[fingerprint.paragraph_vector(c).alias(c) for c in "ab"]).select("*", *[fingerprint.signs(c).alias(f"{c}s") for c in "ab"])
    assert v.select(fingerprint.likeness("a", "b", "as", "bs").alias("s")).first().s > 0.9999


def test_next_document_one_word_longer_is_near(spark):
    text = " ".join(f"w{i * 7919 % 1000}" for i in range(240))
    df = spark.createDataFrame([(1, text), (2, f"new {text}")], "doc_id long, text string")
    assert all(r.near_next > 0.9 for r in fingerprint.edited_fingerprints(df).collect())


def test_pairs_inside_a_family(spark):
    rng = random.Random(5)

    def fill(n):
        return [f"x{rng.randrange(10**12)}" for _ in range(n)]

    common, texts = fill(430), []
    for _ in range(60):
        mine = fill(33)
        texts += [" ".join(common + mine + fill(38)) for _ in range(2)]
    flat = near_dedup.idf_table(near_dedup.np.zeros(1 << near_dedup.FEATURE_BITS), 120)
    assert 0.84 < near_dedup.similarity(texts[0], texts[1], flat) < 0.87 and 0.73 < near_dedup.similarity(texts[0], texts[2], flat) < 0.77
    order = list(range(120))
    rng.shuffle(order)
    df = spark.createDataFrame([(order[i], t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    lost = sum(got[order[i]] != got[order[i + 1]] for i in range(0, 120, 2))
    assert lost == 0 and len(set(got.values())) == 60, lost


def test_edited_copies_of_a_line(spark):
    rng, docs = random.Random(7), []
    base = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(60)]

    def edited(line, places):
        return " ".join("new" + "".join(rng.choices("abcdefgh", k=8)) if i in places else w for i, w in enumerate(line))

    docs.append(" ".join(base))
    docs += [edited(base, [8 + rng.randrange(52)]) for _ in range(20)]
    docs += [edited(base, places) for places in ([10, 40], [20, 58], [9, 30, 50], [15, 35, 55])]
    stranger = base[:4] + ["other" + "".join(rng.choices("abcdefgh", k=8)) for _ in range(56)]
    df = spark.createDataFrame(list(enumerate([*docs, " ".join(stranger)])), "doc_id long, text string")
    got = {r.doc_id: r.dropped_lines for r in line_dedup.line_dedup(df).collect()}
    assert got == {0: [], **{i: [0] for i in range(1, len(docs))}, len(docs): []}


def test_long_lines_with_two_or_three_changed_words(spark):
    base = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(60)]
    for places in ([10, 40], [20, 58], [9, 30, 50], [15, 35, 55]):
        copy = " ".join("changed" if i in places else w for i, w in enumerate(base))
        df = spark.createDataFrame([(1, " ".join(base)), (2, copy)], "doc_id long, text string")
        assert {r.doc_id: r.dropped_lines for r in line_dedup.line_dedup(df).collect()} == {1: [], 2: [0]}


def test_a_query_name_is_taken_once(spark):
    def op7_sentencepiece(spark, sf_dir):
        return None

    with pytest.raises(ValueError):
        queries.query()(op7_sentencepiece)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    with pytest.raises(Exception, match="no-such-folder"):
        queries.QUERIES["op7_sentencepiece"](spark, "/tmp/no-such-folder")
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"


def test_exact_join_removes_what_the_filter_alone_would_block(spark):
    urls = [(i, f"https://www.site{i % 50}.example/p/{i}?utm_source=x#top") for i in range(4000)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    listed = spark.createDataFrame([(f"http://m.site{i % 50}.example/p/{i}/",) for i in range(0, 4000, 8)], "url string")
    judged = url_filter.url_filter(pages, listed, [], bits_per_url=1)
    assert {r.page_id for r in judged.where("verdict = 'block'").collect()} == set(range(0, 4000, 8))
    keys = url_filter.with_url_parts(listed, "url").select("canonical").distinct()
    blocks = common.blocks(500, url_filter.BLOCK_BITS)
    bloom = url_filter.blocked_bloom(keys, blocks)
    asked = url_filter.with_url_parts(pages, "url").select(*url_filter.bloom_keys(F.col("canonical"), blocks)).join(bloom, "block")
    hits = asked.where(" AND ".join(f"w{i} & m{i} = m{i}" for i in range(url_filter.WORDS))).count()
    assert hits > 600


def test_social_numbers_become_other_valid_ones(spark):
    rows = spark.range(100_000).selectExpr(
        "concat_ws('-', lpad(cast(1 + id % 664 as string), 3, '0'), lpad(cast(1 + id % 99 as string), 2, '0'), lpad(cast(1 + id % 9999 as string), 4, '0')) AS v"
    ).distinct()
    edges = spark.createDataFrame([(v,) for v in ("001-01-0001", "665-99-9999", "667-01-0001", "899-99-9999")], "v string")
    df = rows.union(edges).distinct()
    new = df.select("v", pseudonyms.pseudonym(F.lit("social"), F.col("v")).alias("p")).cache()
    assert new.where(~F.col("p").rlike(f"^(?:{pseudonyms.SOCIAL})$")).count() == 0
    assert new.select("p").distinct().count() == df.count() and new.where("p = v").count() < 5


@pytest.mark.parametrize("long_id", range(4))
def test_one_very_long_labelled_text_leaves_the_others_in(spark, long_id):
    docs = spark.createDataFrame([(i, "word " * (400_000 if i == long_id else 5)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    sample, counts = training.labelled_sample(docs, labels, "toxic", F.lit(True), 100, 100_000)
    assert sorted(v for _, v in sample) == [v for v in (0, 1) for _ in range(20 - (long_id % 2 == v))] and counts == {0: 20, 1: 20}
