"""Hidden Markov scores against all paths of states, the base against SQL, and what Baum-Welch must improve."""

import itertools
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from orthoflow.llm import hidden_markov as hm
from orthoflow.llm import queries
from orthoflow.llm.training import held_out

SF = "/root/testdata/sf0.001"
CLASSES = 500


def random_model(k, rng):
    part = lambda *shape: rng.dirichlet(np.ones(shape[-1]), shape[:-1] or None)
    return hm.HiddenMarkov(part(k), part(k), part(k, k), part(k, CLASSES).T)


def test_forward_is_the_sum_over_all_paths():
    rng = np.random.default_rng(1)
    model, k = random_model(3, rng), 3
    texts = [rng.integers(0, CLASSES, n).astype(np.int32) for n in (1, 5, 2, 5, 4)]
    for text, got in zip(texts, hm.log10_likelihood(model, texts)):
        total = 0.0
        for path in itertools.product(range(k), repeat=len(text)):
            p = model.start[path[0]] * model.emit[text[0], path[0]]
            for a, b, o in zip(path, path[1:], text[1:]):
                p *= model.step[a, b] * model.emit[o, b]
            total += p
        assert math.isclose(got, math.log10(total), rel_tol=1e-12)
    long = rng.integers(0, CLASSES, 50_000).astype(np.int32)
    assert np.isfinite(hm.log10_likelihood(model, [long])).all()
    assert len(hm.log10_likelihood(model, [])) == 0


def test_expected_counts_are_those_of_all_paths():
    rng = np.random.default_rng(2)
    k = 2
    model = random_model(k, rng)
    texts = [rng.integers(0, 6, n).astype(np.int32) for n in (4, 1, 3)]
    emitted, moves = hm.expectations(model, texts)
    want_e, want_m = np.zeros((CLASSES, k)), np.zeros((2 + k, k))
    for text in texts:
        found = []
        for path in itertools.product(range(k), repeat=len(text)):
            p = model.start[path[0]] * model.emit[text[0], path[0]]
            for a, b, o in zip(path, path[1:], text[1:]):
                p *= model.step[a, b] * model.emit[o, b]
            found.append((p, path))
        total = sum(p for p, _ in found)
        for p, path in found:
            want_m[0, path[0]] += p / total
            for o, s in zip(text, path):
                want_e[o, s] += p / total
            for a, b in zip(path, path[1:]):
                want_m[2 + a, b] += p / total
    assert np.allclose(emitted, want_e, atol=1e-5) and np.allclose(moves, want_m, atol=1e-5)


def test_a_round_makes_the_training_texts_likelier():
    rng = np.random.default_rng(3)
    shares = np.full(CLASSES, 1 / CLASSES)
    texts = [rng.integers(50 * (i % 2), 50 * (i % 2) + 50, 400).astype(np.int32) for i in range(40)]
    model, before = hm.first_model(shares, 2), -math.inf
    for _ in range(8):
        now = hm.log10_likelihood(model, texts).sum()
        assert now > before - 1e-6
        model, before = hm.maximise(*hm.expectations(model, texts), shares), now


def test_tasks_and_driver_count_alike(spark):
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, CLASSES, int(n)).astype(np.int32) for n in rng.integers(1, 700, 60)]
    model = hm.first_model(np.full(CLASSES, 1 / CLASSES), 4)
    df = spark.createDataFrame([([int(x) for x in t],) for t in texts], "ids array<int>").repartition(3)
    for got, want in zip(hm.expected_counts(df, model), hm.expectations(model, texts)):
        assert np.allclose(got, want, atol=1e-2)


def plain_score(text, vocabulary, model):
    """The documented formula, word by word."""
    words = hm.words_of(text.encode())
    classes = hm.Classes(vocabulary.top, vocabulary.limit)
    path = hm.log10_likelihood(model, [np.array([*[classes[w] for w in words], 0], dtype=np.int32)])[0]
    counts = {bytes(r.word): r.n for r in vocabulary.counts.collect()}
    for w in words:
        if classes[w] > vocabulary.limit:
            b = classes[w] - vocabulary.limit - 1
            size = vocabulary.bucket_n[b] + hm.WORD_PRIOR * (vocabulary.bucket_v[b] + 1)
            path += math.log10((counts.get(w, 0) + hm.WORD_PRIOR) / size)
    return path


def test_scores_word_by_word_and_edges(spark):
    rows = [(1, "The cat and the dog", "x"), (2, "a dog  \t and\x0bthe cat cat", "x"), (2, "a dog  \t and\x0bthe cat cat", "x")]
    rows += [(3, None, "x"), (4, "", None), (None, "unseen É words é ab", "x"), (7, "far " * 3000 + "ÀB", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string").withColumn("known", F.lit(1)).withColumn("base", F.lit(2))
    scores, vocabulary, model = hm.language_model_scores(df, F.col("doc_id") <= 3, limit=5)
    got = scores.collect()
    assert len(got) == len(rows) and vocabulary.tokens == 5 + 1 + 2 * (6 + 1) + 1
    texts = {r[0]: r[1] or "" for r in rows}
    counts = {bytes(r.word): r.n for r in vocabulary.counts.collect()}
    for r in got:
        words = hm.words_of(texts[r.doc_id].encode())
        assert r.n_tokens == len(words) + 1 and r.n_known == 1 + sum(w in counts for w in words)
        base = sum(math.log10((c + 1) / (vocabulary.tokens + vocabulary.distinct + 1)) for c in [4, *[counts.get(w, 0) for w in words]])
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert math.isclose(r.score, plain_score(texts[r.doc_id], vocabulary, model), rel_tol=1e-9)
    none, _, _ = hm.language_model_scores(df, F.lit(False))
    assert all(r.n_known == 0 and r.base_score == 0 and math.isfinite(r.score) for r in none.collect())
    assert hm.language_model_scores(df.limit(0), F.lit(True))[0].count() == 0


def test_bucket_of_spark_and_python(spark):
    words = [b"a", b"ab", "é".encode(), b"abcd", b"abcde", "größe".encode()]
    got = spark.createDataFrame([(w,) for w in words], "word binary").select("word", hm.bucket(F.col("word")).alias("b")).collect()
    assert all(hm.Classes((), 9)[bytes(r.word)] == 10 + r.b for r in got)


@pytest.fixture(scope="module")
def scored(spark):
    return queries.op13_language_model(spark, SF).collect()


def test_query_against_sql(spark, scored):
    out = spark.read.parquet(f"{SF}/documents.parquet").where(held_out("doc_id", 7, 2)).select("doc_id").toPandas()
    con = duckdb.connect()
    con.register("out_ids", out)
    want = con.sql(
        rf"""
        WITH t AS (
          SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') || [chr(10)]) AS w FROM '{SF}/documents.parquet'),
        c AS (SELECT w, count(*) AS c FROM t WHERE doc_id NOT IN (SELECT doc_id FROM out_ids) GROUP BY w),
        s AS (SELECT sum(c) AS n, count(*) AS v FROM c)
        SELECT doc_id, doc_id IN (SELECT doc_id FROM out_ids) AS held_out, count(*) AS n_tokens, count(c) AS n_known,
          max(n) AS train_tokens, sum(log10((coalesce(c, 0) + 1) / (n + v + 1))) AS base_score
        FROM t LEFT JOIN c USING (w), s GROUP BY doc_id"""
    ).fetchall()
    got = {r.doc_id: r for r in scored}
    assert len(got) == len(want) == len(scored)
    for doc_id, out_, n, known, tokens, base in want:
        r = got[doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out_, n, known, tokens)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)


def test_model_beats_the_base_on_texts_it_has_not_seen(scored):
    held = [r for r in scored if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
