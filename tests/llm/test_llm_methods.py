"""Operators against brute force, the library, exact round trips and held-out labels."""

import itertools
import math
import os
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from compare import compare, connect
from orthoflow.llm import common, fingerprint, mixing, near_dedup, pieces, pseudonyms
from orthoflow.llm.queries import QUERIES, SQL

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
HAS = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


@HAS
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert compare(QUERIES[name](spark, SMALL), connect(SMALL), SQL[name]) == ""


def test_a_query_per_operator():
    assert {int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES} == set(range(1, 14)) and set(SQL) <= set(QUERIES)


def auc(scores, labels):
    pairs = [(a > b) + (a == b) / 2 for a, x in zip(scores, labels) if x for b, y in zip(scores, labels) if not y]
    return sum(pairs) / len(pairs)


@HAS
@pytest.mark.parametrize("name,label,least", [("op5_quality", "quality", 0.85), ("op4_toxicity", "toxic", 0.75)])
def test_held_out_labels(spark, name, label, least):
    scores = QUERIES[name](spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id")
    rows = scores.where("held_out").select("score", label).collect()
    assert len(rows) > 50 and auc([r.score for r in rows], [r[label] for r in rows]) >= least
    assert QUERIES[name](spark, MIDDLE).count() == spark.read.parquet(f"{MIDDLE}/documents.parquet").count()


# fingerprints

def xx(data: bytes, seed: int = 42) -> int:
    return xxhash.xxh64_intdigest(data, seed)


def brute_vector(text: str) -> list[int]:
    import hashlib
    import struct

    mask, low = (1 << 62) - 1, 1 | 1 << 31
    equal, like, n = [0] * 8, [0] * 32, 0
    for p in text.split("\n"):
        digest = hashlib.sha256(p.encode()).hexdigest().encode()
        for i in range(8):
            equal[i] = (equal[i] + (xx(struct.pack("<i", i), xx(digest)) & mask)) & mask
        words = p.split(" ")
        for i in range(len(words)):
            h = 42
            for w in words[i : i + 2]:
                h = xx(w.encode(), h)
            g, n = xx(struct.pack("<Q", h)), n + 1
            for j in range(32):
                v = h if j < 16 else g
                v = v - (1 << 64) if v >> 63 else v
                like[j] += (v >> (j % 16)) & low
    return equal + [v & mask for v in like] + [n]


def brute_likeness(a: list[int], b: list[int]) -> float:
    """Cosine of the signed counters of two fingerprints, by their numbers alone."""

    def signed(v):
        return [2 * (x >> s & (1 << 31) - 1) - v[-1] for x in v[8:-1] for s in (0, 31)]

    x, y = signed(a), signed(b)
    norm = sum(p * p for p in x) * sum(q * q for q in y)
    return 1.0 if a == b else min(1.0, max(0.0, sum(p * q for p, q in zip(x, y)) / norm**0.5)) if norm else 0.0


def test_fingerprint_is_the_sum_over_paragraphs(spark):
    texts = ["", "a", "a b c d\ne f\n\ng", "ñandú ß " * 200, "x\n" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in fingerprint.fingerprints(df).collect():
        assert r.vector == brute_vector(r.text) and r.fingerprint == "".join(f"{v:016x}" for v in r.vector)


def test_paragraphs_in_any_order_put_in_and_taken_out(spark):
    df = spark.createDataFrame([("p one\nq two\nr three", "r three\np one\nq two", "p one\nq two", "r three")], "a string, b string, c string, d string")
    v = df.select(*[fingerprint.paragraph_vector(c).alias(c) for c in "abcd"])
    r = v.select("a", "b", "c", fingerprint.add_fingerprints("c", "d").alias("cd"), fingerprint.subtract_fingerprints("a", "d").alias("a_d")).first()
    assert r.a == r.b == r.cd and r.a_d == r.c != r.a


@HAS
def test_edited_texts_and_their_likeness(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in QUERIES["op6_fingerprints"](spark, SMALL).collect()}
    import hashlib

    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(text)
        assert got[i].edited_fingerprint == "".join(f"{v:016x}" for v in brute_vector(edited))
        mine = brute_vector(text)
        assert abs(got[i].near_edited - brute_likeness(mine, brute_vector(edited))) < 1e-9
        assert abs(got[i].near_next - brute_likeness(mine, brute_vector(after))) < 1e-9
    long = [got[i] for i, t in docs if len(t) > 300]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.97 * len(long)


# near duplicates

def plain_shingles(text):
    words = text.lower().split()
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


@given(st.lists(st.text(alphabet="ab é\n", max_size=60), max_size=8))
@settings(max_examples=60, deadline=None)
def test_shingles(texts):
    h, tf, at = near_dedup.shingles(texts)
    for i, t in enumerate(texts):
        want = plain_shingles(t)
        assert at[i + 1] - at[i] == len(set(want)) and tf[at[i] : at[i + 1]].sum() == len(want)


def test_samples_agree_as_often_as_the_similarity():
    rng, idf = np.random.default_rng(1), np.ones(1 << near_dedup.FEATURE_BITS, np.float32)
    words = [f"w{i}" for i in range(5000)]
    got, want = [], []
    for _ in range(150):
        a = list(rng.choice(words, 300))
        b = list(a)
        for at in rng.integers(0, 300, rng.integers(0, 25)):
            b[at] = "other" + str(rng.integers(1e9))
        a, b = " ".join(a), " ".join(b)
        s = near_dedup.sign_texts([a, b], idf)
        got.append((s[0] == s[1]).mean())
        want.append(near_dedup.similarity(a, b, idf))
    assert abs(np.mean(got) - np.mean(want)) < 0.02 and np.corrcoef(got, want)[0, 1] > 0.9


def brute_classes(rows):
    ids, texts = [r[0] for r in rows], [r[1] or "" for r in rows]
    df = np.zeros(1 << near_dedup.FEATURE_BITS)
    for t in texts:
        np.add.at(df, np.unique(near_dedup.feature(near_dedup.shingles([t])[0])), 1)
    idf = near_dedup.idf_table(df, len(texts))
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [set(plain_shingles(t)) for t in texts]
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] & sets[j] or texts[i] == texts[j]:
            if texts[i] == texts[j] or near_dedup.similarity(texts[i], texts[j], idf) >= near_dedup.SIMILARITY:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(d, least.get(root(i), d))
    return {d: least[root(i)] for i, d in enumerate(ids)}


@HAS
@pytest.mark.parametrize("parts", [1, 7])
def test_near_duplicates_against_all_pairs(spark, parts):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text").repartition(parts)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute_classes([tuple(r) for r in docs.collect()])


def test_components(spark):
    links = [(i + 1, i) for i in range(40)] + [(100, 90), (101, 90), (102, 101)] + [(200 + i, 200) for i in range(1, 300)]
    got = {r.node: r.label for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 100: 90, 101: 90, 102: 90, **{200 + i: 200 for i in range(300)}}


# pieces

@pytest.fixture(scope="module")
def model():
    import sentencepiece

    vocabulary = pieces.Vocabulary.load(pieces.MODEL_FILE)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    return pieces.SharedPrefixEncoder(vocabulary), pieces.decoder(vocabulary), library


@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("the ing\n\tandéß日😀  aeo"), st.characters(blacklist_categories=["Cs"])), max_size=40), max_size=6))
@settings(max_examples=300, deadline=None)
def test_pieces_as_the_library_and_back(model, texts):
    encoder, decode, library = model
    got = encoder.encode_texts(texts)
    assert [g.tolist() for g in got] == library.encode(texts)
    assert [decode(g.tolist()) for g in got] == [t.replace(pieces.SPACE, " ") for t in texts]


@HAS
def test_pieces_of_the_documents(spark, model):
    rows = QUERIES["op7_sentencepiece"](spark, SMALL).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert all(r.round_trip and r.token_ids == model[2].encode(texts[r.doc_id]) for r in rows) and len(rows) == len(texts)


@given(st.lists(st.text(alphabet="abc", min_size=1, max_size=8), min_size=1, max_size=8))
def test_scores_of_probabilities(words):
    scores = {"a": -2.0, "b": -2.5, "c": -3.0, "ab": -3.1, "abc": -5.0, "bc": -4.0, "ca": -4.5}
    encoder = pieces.SharedPrefixEncoder(pieces.Vocabulary(list(scores), list(scores.values())), merges=False)

    def best(word):
        return max((scores[word[:i]] + (best(word[i:]) if word[i:] else 0.0) for i in range(1, len(word) + 1) if word[:i] in scores))

    for word, ids in encoder.encode_words(set(words)).items():
        names = [encoder.vocabulary.pieces[i] for i in ids]
        assert "".join(names) == word and math.isclose(sum(scores[p] for p in names), best(word))


# pseudonyms

def of(spark, texts, key="k"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.text for r in pseudonyms.pseudonymize(df, key).orderBy("doc_id").collect()]


def luhn(number):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(number)))) % 10 == 0


def test_values_stay_linked_in_their_format(spark):
    card, text = "4111 1111 1111 1111", "pay {} now, mail {} or call {} from {} on {}, {} or {}; {}"
    values = [card, "Ann.b-7@mail.example.org", "+44 (020) 555-1234", "192.168.10.1", "1999-12-31", "12/31/1999", "31.12.1999", "GB82WEST12345698765432"]
    a, b, other = of(spark, [text.format(*values), text.format(*values) + " x"]) + of(spark, [text.format(*values)], "k2")
    assert b == a + " x" and a != other and not any(v in a for v in values)
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "0", s)))
    ips = r"\d+\.\d+\.\d+\.\d+"
    assert shape(re.sub(ips, "I", a)) == shape(re.sub(ips, "I", text.format(*values)))
    assert luhn(re.sub(" ", "", re.search(r"pay ([\d ]+) now", a)[1])) and ".org or call +44 (" in a
    iban = a.rsplit("; ", 1)[1]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def test_what_is_not_valid_stays(spark):
    texts = ["4111111111111112", "999.1.1.1", "2021-02-29", "GB83WEST12345698765432", "1.2.3", "a@b", "no digits", "12345"]
    assert of(spark, texts) == texts


def test_permutations_are_one_to_one_and_as_in_plain_python(spark):
    import hashlib

    def stream(kind, i, half):
        seed = f"k|{kind}|{i}|{half}"
        return "".join(hashlib.sha512(f"{seed}|{n}".encode()).hexdigest() for n in (0, 1))

    def turn(c, step):
        for first, size in (("0", 10), ("a", 26), ("A", 26)):
            if ord(first) <= ord(c) < ord(first) + size:
                return chr(ord(first) + (ord(c) - ord(first) + step) % size)
        return c

    def brute(value, kind):
        a, b = value[: len(value) // 2], value[len(value) // 2 :]
        for i in range(8):
            s = stream(kind, i, b)
            a, b = b, "".join(turn(c, int(s[j % 128 * 2 : j % 128 * 2 + 2], 16)) for j, c in enumerate(a))
        return a + b

    values = [f"{i:03d}" for i in range(1000)] + ["aZ9-b@x", "", "q" * 300]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(pseudonyms.permute_text(F.col("v"), "k", "t")).collect()]
    assert got == [brute(v, "t") for v in values] and len(set(got)) == len(values)
    numbers = [r[0] for r in spark.range(189 * 3).select(pseudonyms.permute_number(F.col("id"), (189, 3), "k", "t")).collect()]
    assert sorted(numbers) == list(range(189 * 3))


# mixing and helpers

@HAS
def test_quotas_are_met_to_a_document(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").where("source < 'src15'")
    plan = mixing.plan_mixture(docs, mixing.count_tokens(F.col("text")), budget_tokens=200_000, max_repetition=2.0)
    mixed = mixing.mix_sources(docs, budget_tokens=200_000, max_repetition=2.0)
    got = {r.source: r.t for r in mixed.groupBy("source").agg(F.sum(mixing.count_tokens(F.col("text"))).alias("t")).collect()}
    longest = docs.agg(F.max(mixing.count_tokens(F.col("text")))).first()[0]
    for r in plan.sources.collect():
        assert 0 <= got[r.source] - r.repetition * r.tokens <= longest + 1 and r.repetition <= 2.0 + 1e-9
    blocks = mixed.groupBy("source", "block").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d")).collect()
    assert all(b.n == b.d for b in blocks)


def test_entropy_is_met(spark):
    shares = spark.createDataFrame([(0.7,), (0.2,), (0.06,), (0.04,)], "share double")
    a = mixing.find_exponent(shares, 1.0, None, None)
    w = np.array([0.7, 0.2, 0.06, 0.04]) ** a
    w /= w.sum()
    assert math.isclose(-(w * np.log(w)).sum(), 1.0, abs_tol=1e-9)
    assert mixing.find_exponent(shares, 2.0, None, None) == 0.0


def test_lookup_with_hot_keys(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, 7).when(F.col("id") % 30 == 0, None).otherwise(F.col("id") % 400).alias("k"))
    table = spark.range(300).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner"):
        want = sorted(map(str, rows.join(table, "k", how).collect()))
        assert sorted(map(str, common.lookup(rows, table, ["k"], how).select("k", "id", "v").collect())) == want


@HAS
def test_pipeline(spark):
    done = corpus_pipeline.run(spark, SMALL).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert done and all(r.round_trip and r.doc_id in docs for r in done)
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][2] == "near_dedup"
