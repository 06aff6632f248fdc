import itertools
import random

from pyspark.sql import functions as F

from orthoflow.catalog import QUERIES, inputs
from orthoflow.operators import lookup as J
from orthoflow.operators import marking as M
from orthoflow.operators import verdicts as D
from orthoflow.operators.tokens import block_of, document_vocabulary, running_ends, token_offsets
from orthoflow.plans import review as Q
from orthoflow.session import cut, spread_lookup
from orthoflow.sources import units as U

DOCS = "doc_id long, lang string, text string"
LEX = "lang string, word string, df long"


def lexicon(spark, *words):
    return spark.createDataFrame([("es", w, 10) for w in words], LEX)


def found(spark, text, *words):
    docs = spark.createDataFrame([(1, "es", text)], DOCS)
    rows = Q.find_errors(docs, lexicon(spark, *words)).orderBy("first_pos").collect()
    return [(r.token, r.kind, r.suggestions) for r in rows]


def test_mail_and_names(spark):
    text = "Contacto: Ana Perez (ana.perez@correo.org.gt) y casacion"
    assert found(spark, text, "casación", "contacto") == [("casacion", "tilde", ["casación"])]


def test_title_accents(spark):
    text = "Algebra lineal y Analisis de datos; Perez presente; casacion."
    base = ["álgebra", "análisis", "casación", "lineal", "datos", "presente"]
    assert [e[0] for e in found(spark, text, *base)] == ["Algebra", "Analisis", "casacion"]
    assert [e[0] for e in found(spark, text, *base, "Pérez")] == ["Algebra", "Analisis", "Perez", "casacion"]


def test_first_casing_short_capital_and_far_words(spark):
    assert found(spark, "Xqzt luego xqzt", "xqzs", "luego") == []
    assert found(spark, "TSE ABCDEFGHIJKLM ab", "tsf", "ac") == []
    assert found(spark, "murciélago", "casa") == []
    assert found(spark, "caza", "casa", "cazar") == [("caza", "ortografia", ["casa", "cazar"])]


def test_title_entry_does_not_accept_lower_case(spark):
    assert found(spark, "guatemala Guatemala", "Guatemala") == [("guatemala", "ortografia", ["Guatemala"])]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_candidates_equal_brute_force(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    entries = {word(rng.randint(1, 24)) for _ in range(250)}
    folds = {word(rng.randint(3, 24)) for _ in range(150)}
    for e in list(entries)[:150]:  # long words get neighbours by edits
        w = list(e)
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(w) + 1)
            rng.choice([lambda: w.insert(at, "b"), lambda: w and w.pop(min(at, len(w) - 1)), lambda: w.__setitem__(slice(at, at + 1), ["c"])])()
        if w:
            folds.add("".join(w))
    got = J.near_candidates(
        spark.createDataFrame([("es", f) for f in folds], "lang string, fold string"), lexicon(spark, *entries)
    )
    pairs = [(r.fold, r.suggestion, r.dist) for r in got.collect()]
    want = {(f, e, distance(f, e)) for f in folds for e in entries if distance(f, e) <= 2}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_keys_of_candidates_are_never_sent_out(spark):
    """A small stored lexicon has some fifty keys per word; a broadcast of them takes the driver's memory."""
    entries = cut(J.suggestion_entries(lexicon(spark, "revision", "palabra")), "entries")
    folds = cut(spark.createDataFrame([("es", "revisoin")], "lang string, fold string"), "folds")
    pairs = J.candidate_pairs(folds, entries)
    assert {r.word for r in pairs.where("dist >= 0").collect()} == {"revision"}
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_found_at_few_of_their_keys(spark):
    """Two words that share all their forms are one pair of distance 0, not one per form."""
    entries = J.suggestion_entries(lexicon(spark, "palabra", "palabras"))
    folds = spark.createDataFrame([("es", "palabra"), ("es", "palabr")], "lang string, fold string")
    near = J.candidate_pairs(folds, entries).where("dist >= 0").groupBy("fold", "word", "dist").count()
    rows = {(r.fold, r.word, r.dist): r["count"] for r in near.collect()}
    assert set(rows) == {("palabra", "palabra", 0), ("palabra", "palabras", 1), ("palabr", "palabra", 1), ("palabr", "palabras", 2)}
    assert max(rows.values()) == 1


def test_unknown_words_are_looked_up_once_each(spark, tmp_path):
    """The lexicon meets distinct words, not the words of each document, and what is found is stored for its readers."""
    texts = [(i, "es", "fr", "casacion casación palabra") for i in range(5)]
    spark.createDataFrame(texts, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tokens = inputs.unknown_tokens(spark, str(tmp_path))
    assert [tuple(r) for r in tokens.collect()] == []
    assert "documents.parquet" not in "".join(tokens.inputFiles())
    near = QUERIES["near_candidates"](spark, str(tmp_path))
    assert "text#" not in near._jdf.queryExecution().optimizedPlan().toString()


def test_spread_lookup_equals_join(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"w{i}") for i in range(300)], "doc_id long, token string")
    table = rows.groupBy("token").agg(F.count("*").alias("n")).withColumn("v", F.length("token"))
    plain = rows.join(table.drop("n"), "token").select("doc_id", "token", "v")
    salted = spread_lookup(rows, table, ["token"], "n", "doc_id", hot_rows=20).select("doc_id", "token", "v")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, salted.collect()))


def test_vocabulary_counts(spark):
    docs = spark.createDataFrame([(1, "es", "Casa casa, CASA y perro"), (2, "es", "")], DOCS)
    rows = {tuple(r) for r in document_vocabulary(docs, ["doc_id"]).collect()}
    assert rows == {(1, "casa", "Casa", 0, 3), (1, "y", "y", 3, 1), (1, "perro", "perro", 4, 1)}


ERR = "doc_id long, first_pos int, key string, token string, suggestions array<string>"


def test_marks_highlight_and_round_trip(spark):
    text = "casacion y O'Connor casacion2 CASACION Connor"
    docs = spark.createDataFrame([(1, text), (2, "sin errores")], "doc_id long, text string")
    errors = spark.createDataFrame([(1, 0, "casacion", "casacion", ["casación"]), (1, 5, "connor", "Connor", [])], ERR)
    marks = {(r.key, r.start_at, r.end_at) for r in M.mark_occurrences(docs, errors).collect()}
    assert marks == {("casacion", 0, 8), ("connor", 13, 19), ("casacion", 30, 38), ("connor", 39, 45)}
    marked = {r.doc_id: r.text for r in M.highlight_text(docs, errors).collect()}
    assert marked[1] == "[[casacion]] y O'[[Connor]] casacion2 [[CASACION]] [[Connor]]"
    assert marked[2] == "sin errores"
    assert marked[1].replace("[[", "").replace("]]", "") == text


def test_corrections(spark):
    docs = spark.createDataFrame([(1, "es", "Casacion y casacion, a casacionx")], DOCS)
    corrections = Q.collect_corrections(docs, lexicon(spark, "casación"))
    fixed = M.apply_corrections(docs, corrections).first().text
    assert fixed == "Casación y casación, a casación"
    chain = spark.createDataFrame([(1, "a", "b"), (1, "b", "c")], "doc_id long, original string, replacement string")
    swapped = M.apply_corrections(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), chain)
    assert swapped.first().text == "b c"
    assert [tuple(r) for r in M.correction_chains(chain).select("original", "then").collect()] == [("a", "c")]


def test_corrections_outside_chains_leave_before_the_join(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(4), f"w{rng.randrange(40)}", f"w{rng.randrange(400)}") for _ in range(300)] + [(None, "w1", "w2"), (1, "w3", None)]
    table = cut(spark.createDataFrame(rows, "doc_id long, original string, replacement string"), "corrections")
    chains = M.correction_chains(table)
    want = [(d, r, o, t) for d, o, r in rows for e, p, t in rows if d is not None and d == e and r is not None and r == p]
    assert sorted(map(str, chains.select("doc_id", "replacement", "original", "then").collect())) == sorted(
        str(r) for r in spark.createDataFrame(want, "doc_id long, replacement string, original string, then string").collect()
    )
    assert chains._jdf.queryExecution().optimizedPlan().toString().count("_block") >= 2


def test_split_word_over_runs(spark):
    runs = spark.createDataFrame(
        [(1, 0, 0, "La Introducci"), (1, 0, 1, "ó"), (1, 0, 2, "n al")],
        "doc_id long, para_ix int, run_ix int, text string",
    )
    assert U.paragraphs_from_runs(runs).first().text == "La Introducción al"
    spans = spark.createDataFrame([(1, 0, 3, 15)], "doc_id long, para_ix int, start_at int, end_at int")
    got = {r.run_ix: (r.cover, r.middle) for r in M.runs_of_error(spans, runs).collect()}
    assert got == {0: ("crossed", "Introducci"), 1: ("whole", "ó"), 2: ("crossed", "n")}
    assert {r.cover for r in M.runs_of_error(spans, runs, max_runs=2).collect()} == {"left_alone"}


def highlight(text, keys, extend=True):
    import re

    words = re.findall("[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+", text)
    last = {w.lower(): w for w in words}
    out, used = [], set()
    for key in keys:
        if key in used:
            continue
        if key in last:
            out.append(last[key])
            used.add(key)
        elif extend and len(key) >= 4:
            longer = [k for k in last if k not in used and k.startswith(key) and len(k) > len(key)]
            if len(longer) == 1:
                out.append(last[longer[0]])
                used.add(longer[0])
    return out


def test_unit_highlight_words_equal_brute_force(spark):
    rng = random.Random(3)
    stems = ["casa", "casas", "casona", "Casado", "perro", "perros", "pe", "sol", "solar"]
    units = [(d, u, " ".join(rng.choice(stems) for _ in range(5))) for d in range(6) for u in range(5)]
    keys = {d: rng.sample(["casa", "caso", "perr", "sol", "casad", "casas", "perro"], 5) for d in range(6)}
    errors = spark.createDataFrame([(d, i, k, k, []) for d, ks in keys.items() for i, k in enumerate(ks)], ERR)
    table = spark.createDataFrame(units, "doc_id long, unit_ix int, text string")
    for extend in (True, False):
        got = {(r.doc_id, r.unit_ix): r.highlight for r in M.unit_highlight_words(table, errors, extend).collect()}
        want = {(d, u): highlight(t, keys[d], extend) for d, u, t in units}
        assert got == {k: v for k, v in want.items() if v}


def test_verdicts_missing_failed_and_last(spark):
    candidates = spark.createDataFrame(
        [(1, 0, "a", "a"), (1, 1, "b", "b"), (2, 0, "c", "c")], "doc_id long, first_pos int, key string, token string"
    )
    verdicts = spark.createDataFrame(
        [(1, "A", False, "x", 1), (1, "a", True, "typo  claro", 2)],
        "doc_id long, word string, is_error boolean, reason string, arrival long",
    )
    failed = spark.createDataFrame([(2,)], "doc_id long")
    got = {r.key: (r.confirmed, r.reason, r.fallback) for r in D.second_layer(candidates, verdicts, failed).collect()}
    assert got == {"a": (True, "typo claro", False), "b": (False, "sin respuesta", False), "c": (True, None, True)}


def test_offsets(spark):
    docs = spark.createDataFrame([(1, "  año, O'Connor x")], "doc_id long, text string")
    assert [tuple(r)[2:] for r in token_offsets(docs).orderBy("pos").collect()] == [("año", 2, 5), ("O'Connor", 7, 15), ("x", 16, 17)]


def test_out_of_lexicon_without_broadcast(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(3)) for _ in range(400)]
    cased = [rng.choice([w, w.title(), w.upper()]) for w in words]
    known = set(words[:60])
    rows = spark.createDataFrame([(i, "es", w) for i, w in enumerate(cased)], "doc_id long, lang string, token string")
    want = {i for i, w in enumerate(cased) if not (w in known or (w.lower() in known and (w.isupper() or w.istitle())))}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert {r.doc_id for r in J.out_of_lexicon(rows, lexicon(spark, *known)).collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_last_item_of_an_answer_wins(spark):
    found = spark.createDataFrame([(1, 0, "x", "x", "tilde")], "doc_id long, first_pos int, key string, token string, kind string")
    answer = '{"items": [{"palabra": "x", "es_error_ortografico": true}, {"palabra": "\\tX\\n", "es_error_ortografico": false}]}'
    answers = spark.createDataFrame([(1, 0, answer)], "doc_id long, arrival long, answer string")
    assert [r.confirmed for r in D.second_layer_from_answers(found, answers).collect()] == [False]


def test_running_ends(spark):
    rng = random.Random(5)
    lists = [[rng.randrange(9) for _ in range(n)] for n in (0, 1, 255, 256, 257, 1300)]
    got = spark.createDataFrame([(x,) for x in lists], "x array<int>").select(running_ends("x").alias("e")).collect()
    assert [r.e for r in got] == [list(itertools.accumulate(x)) for x in lists]


def test_words_over_many_runs_are_left_alone(spark):
    spans = spark.createDataFrame([(1, 0, 2, 200), (1, 0, 3, 5)], "doc_id long, para_ix int, start_at long, end_at long")
    runs = U.runs_from_units(spark.createDataFrame([(1, 0, "x" * 210)], "doc_id long, unit_ix int, text string"), 20)
    got = sorted((r.start_at, r.run_ix, r.cover) for r in M.runs_of_error(spans, runs).collect())
    assert got == [(2, i, "left_alone") for i in range(10)] + [(3, 0, "inside")]


def test_runs_are_cut_in_one_pass(spark):
    texts = ["a😀b\n\r ñc", "é" * 5, "x", "  \x85 y"]
    units = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, unit_ix int, text string")
    for size in (1, 3, 7):
        got = U.runs_from_units(units, size)
        want = [(i, 0, k, t[k * size : (k + 1) * size]) for i, t in enumerate(texts) for k in range(-(-len(t) // size))]
        assert sorted(tuple(r) for r in got.collect()) == want
    assert "substr" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_of_running_sums_follow_the_length(spark):
    sizes = spark.createDataFrame([(n,) for n in (0, 1, 4, 300, 3000, 20_000)], "n int")
    got = [r.b for r in sizes.select(block_of(F.col("n")).alias("b")).collect()]
    assert got == [0, 2, 2, 9, 19, 35]


def test_an_array_of_sizes_is_made_once(spark):
    """Written out in the lambda of the blocks, it would be made anew for each block of the array."""
    pieces = spark.createDataFrame([(["a", "bc", ""] * 500,)], "x array<string>")
    sums = pieces.select(running_ends(F.transform("x", F.length)).alias("e"))
    assert sums.first().e == list(itertools.accumulate([1, 2, 0] * 500))
    assert sums._jdf.queryExecution().analyzed().toString().count("length(") == 1


def test_marks_are_placed_in_texts_of_many_blocks(spark):
    rng = random.Random(11)
    words = ["casa", "l'año", "ñu", "O'Connor", "x", "😀", "d''e", "fin2", "perro"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "'"]) for _ in range(n)) for n in (0, 1, 16, 17, 33, 400)]
    docs = spark.createDataFrame([*enumerate(texts), (9, None)], "doc_id long, text string")
    keys = ["casa", "año", "connor", "o'connor", "ñu", "e"]
    errors = spark.createDataFrame([(i, 0, k, k, []) for i in range(10) for k in keys], ERR)
    found = M.mark_occurrences(docs, errors).collect()
    assert len(found) > 200
    assert all(texts[r.doc_id][r.start_at : r.end_at].lower() == r.key for r in found)
    marked = {r.doc_id: r.text for r in M.highlight_text(docs, errors).collect()}
    assert [marked[i].replace("[[", "").replace("]]", "") for i in range(len(texts))] == texts
    assert marked[9] is None


def test_a_text_is_encoded_once(spark):
    hits = "hits array<struct<at: int, part: int, start_at: int, end_at: int, new: string>>"
    rows = spark.createDataFrame([("aé bb cc", [(0, 0, 0, 3, "x"), (4, 0, 4, 6, "yy")])], f"text string, {hits}")
    out = rows.select(M.splice("text", "hits").alias("t"))
    assert out.first().t == "x yy cc"
    assert out._jdf.queryExecution().analyzed().toString().count("encode(") == 1


def test_marks_of_long_decomposed_texts(spark):
    import unicodedata

    rng = random.Random(4)
    text = " ".join(rng.choice(["acción", "casacion", "ñandú", "fin"]) for _ in range(300))
    apart = unicodedata.normalize("NFD", text)
    docs = spark.createDataFrame([(1, apart), (2, text)], "doc_id long, text string")
    errors = spark.createDataFrame([(d, 0, k, k, []) for d in (1, 2) for k in ("casacion", "ñandú")], ERR)
    rows = M.mark_composed(docs, errors)
    got = {(r.doc_id, r.key, ({1: apart, 2: text}[r.doc_id])[r.start_at : r.end_at], r.blocked) for r in rows.collect()}
    assert got == {
        (1, "casacion", "casacion", False), (1, "ñandú", unicodedata.normalize("NFD", "ñandú"), True),
        (2, "casacion", "casacion", False), (2, "ñandú", "ñandú", False),
    }
    assert rows.count() == 2 * sum(w in ("casacion", "ñandú") for w in text.split())
    # the array of the letters meets a document and not each of its marks
    marks_side = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in marks_side


def test_runs_of_a_paragraph_are_shuffled_once(spark):
    rng = random.Random(8)
    runs, spans, want = [], [], []
    for p, n in enumerate((1, 7, 8, 9, 70)):
        texts = ["x" * rng.randint(0, 9) for _ in range(n)]
        runs += [(1, p, i, t) for i, t in enumerate(texts)]
        size = sum(map(len, texts))
        mine = [(a, a + rng.randint(0, 20)) for a in (rng.randrange(size + 1) for _ in range(25))]
        spans += [(1, p, f"t{k}", a, b) for k, (a, b) in enumerate(mine)]
        ends = list(itertools.accumulate(map(len, texts)))
        for k, (a, b) in enumerate(mine):
            hit = [i for i, t in enumerate(texts) if t and a < ends[i] and b > ends[i] - len(t)]
            want += [(p, f"t{k}", i, len(hit) * mine.count((a, b)), max(a, ends[i] - len(texts[i])), min(b, ends[i])) for i in hit]
    table = spark.createDataFrame(spans, "doc_id long, para_ix int, token string, start_at long, end_at long")
    pieces = spark.createDataFrame(runs, "doc_id long, para_ix int, run_ix int, text string")
    rows = M.runs_of_error(table, pieces)
    got = [(r.para_ix, r.token, r.run_ix, r.runs, len(r.middle)) for r in rows.collect()]
    assert sorted(got) == sorted((p, t, i, n, b - a) for p, t, i, n, a, b in want)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2 and plan.count("Window [") == 1
