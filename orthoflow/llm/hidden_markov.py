"""Hidden Markov language model: Baum-Welch over all training texts, exact likelihood by the scaled forward pass.

A token is a word of a text with A-Z lower-cased, and one end per text.  Its class is the token itself for
the end and the ``TOP_WORDS`` most frequent training words, else a bucket of its last four bytes.  States give
classes, and a class gives its words by their training counts, so the states have a size that does not depend
on the corpus, while the counts of words are those of the whole corpus in a table that grows with it:

    P(text) = sum over paths of states of  prod P(state | state before) P(class | state)  x  prod P(word | class)

Counts meet rare words in an equi join of words; only the fixed number of frequent words is sent to the tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthoflow.session import cut

STATES = 8
TOP_WORDS = 16_384
BUCKETS = 4_096
SUFFIX_BYTES = 4
SEED_DOCUMENTS, SEED_TOKENS, SEED_ROUNDS = 1_000, 400_000, 12
ROUNDS = 3
SEGMENT = 256
TRAIN_TOKENS, SCORE_TOKENS = 1 << 18, 1 << 21
HELD_WORDS = 200_000
STAY = 0.95
CLASS_PRIOR, STEP_PRIOR = 50.0, 1.0
WORD_PRIOR = 0.5
FIXED_POINT = 1 << 20


@dataclass(frozen=True)
class Vocabulary:
    """Counts of all training tokens: ``counts`` has every word (binary ``word``, long ``n``), the arrays have
    those of the end and the most frequent words by class, and how many words and tokens a bucket has.

    Class 0 is the end, classes 1 to ``limit`` are for frequent words, the others are buckets.
    """

    limit: int
    counts: DataFrame = field(repr=False)
    top: tuple[bytes, ...]
    top_n: np.ndarray
    bucket_n: np.ndarray
    bucket_v: np.ndarray
    tokens: int
    distinct: int

    def base(self, n: np.ndarray | int) -> np.ndarray:
        """Add-one log10 probability of a token that occurs ``n`` times."""
        return np.log10((n + 1) / (self.tokens + self.distinct + 1))

    def class_shares(self) -> np.ndarray:
        n = np.concatenate([self.top_n, np.zeros(1 + self.limit - len(self.top_n)), self.bucket_n]) + 1.0
        return n / n.sum()


@dataclass(frozen=True)
class HiddenMarkov:
    """``start`` of a text, ``again`` where a training segment goes on, ``step`` from state to state, and
    ``emit`` with one row of state probabilities per class."""

    start: np.ndarray
    again: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def words_of(text: bytes) -> list[bytes]:
    """Words between blanks (0x20, 0x09-0x0D) with A-Z lower-cased; other bytes stay as they are."""
    return text.lower().split()


def binary_text(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")


def count_words(texts: DataFrame) -> DataFrame:
    """``word`` and ``n`` of the binary column ``text``; tasks send sums of up to ``HELD_WORDS`` words at a time."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words, n = list(held.keys()), list(held.values())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(words_of(text))
                if len(held) > HELD_WORDS:
                    yield out()
        yield out()

    return texts.mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def bucket(word: Column) -> Column:
    return F.pmod(F.crc32(F.substring(word, -SUFFIX_BYTES, SUFFIX_BYTES)), F.lit(BUCKETS)).cast("int")


def fit_vocabulary(docs: DataFrame, usable: Column, text_col: str = "text", limit: int = TOP_WORDS) -> Vocabulary:
    """Counts over the ``usable`` rows of ``docs``, without a bound; at most ``limit`` words and
    ``BUCKETS`` sums come to the driver.

    Frequent words are those of at least a count that at most ``limit`` words have, found from how many
    words there are per sixteenth of an octave of counts; so no task sends words that are not among them.
    """
    training = docs.where(usable).select(binary_text(text_col).alias("text"))
    counts = cut(count_words(training), "words")
    ends = training.count()
    steps = counts.groupBy(F.floor(F.log2("n") * 16).alias("step")).agg(F.count(F.lit(1)).alias("v"), F.min("n").alias("n")).collect()
    many, least = 0, None
    for r in sorted(steps, key=lambda r: -r["step"]):
        many += r["v"]
        if many > limit:
            break
        least = r["n"]
    top = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").collect() if least else []
    words = tuple(bytes(r["word"]) for r in top)
    rest = counts.where(F.col("n") < least) if least else counts
    sums = rest.groupBy(bucket(F.col("word")).alias("b")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    bucket_n, bucket_v = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in sums:
        bucket_n[r["b"]], bucket_v[r["b"]] = r["n"], r["v"]
    top_n = np.array([ends, *[r["n"] for r in top]], dtype=np.float64)
    tokens, distinct = int(top_n.sum() + bucket_n.sum()), len(words) + int(bucket_v.sum()) + (ends > 0)
    return Vocabulary(limit, counts, words, top_n, bucket_n, bucket_v, tokens, int(distinct))


class Classes(dict):
    """Class of each word; buckets are kept for up to ``HELD_WORDS`` words beside the frequent ones."""

    def __init__(self, top: tuple[bytes, ...], limit: int):
        super().__init__((w, i) for i, w in enumerate(top, 1))
        self.top, self.limit = top, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) > HELD_WORDS + len(self.top):
            self.clear()
            self.update((w, i) for i, w in enumerate(self.top, 1))
        found = self[word] = 1 + self.limit + crc32(word[-SUFFIX_BYTES:]) % BUCKETS
        return found


def _lists(parts: list, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), values)


def encode(docs: DataFrame, vocabulary: Vocabulary, usable: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of every whole text, stored: ``rid`` (one per row), the id, ``usable``, ``n_tokens``, ``known`` and
    ``base`` of the tokens with classes of their own, ``ids`` with the end, and ``rare`` words with their number."""
    top, limit, top_n, base = vocabulary.top, vocabulary.limit, vocabulary.top_n, vocabulary.base(vocabulary.top_n)
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(f"`{id_col}`").alias("doc_id"),
        usable.alias("usable"),
        binary_text(text_col).alias("text"),
    )

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(top, limit)
        for batch in batches:
            ids, words, numbers, own = [], [], [], []
            for text in batch.column(3).to_pylist():
                tokens = words_of(text)
                found = np.fromiter(map(classes.__getitem__, tokens), np.int32, len(tokens))
                far = np.flatnonzero(found > limit)
                rare = Counter([tokens[i] for i in far])
                near = np.append(found[found <= limit], 0)
                own.append((len(tokens) + 1, int((top_n[near] > 0).sum()), float(base[near].sum())))
                ids.append(np.append(found, np.int32(0)))
                words.append(list(rare.keys()))
                numbers.append(list(rare.values()))
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            n, known, part = zip(*own) if own else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(3)],
                    pa.array(n, pa.int64()),
                    pa.array(known, pa.int64()),
                    pa.array(part, pa.float64()),
                    _lists(ids, pa.array(flat, pa.int32())),
                    _lists(words, pa.array([w for p in words for w in p], pa.binary())),
                    _lists(numbers, pa.array([x for p in numbers for x in p], pa.int32())),
                ],
                ["rid", "doc_id", "usable", "n_tokens", "known", "base", "ids", "rare", "rare_n"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"rid long, doc_id {kind}, usable boolean, n_tokens long, known long, base double, ids array<int>, rare array<binary>, rare_n array<int>"
    return cut(rows.mapInArrow(encoded, schema), "encoded")


def segments(texts: list[np.ndarray], length: int = SEGMENT) -> tuple[list[np.ndarray], np.ndarray]:
    """Texts in parts of ``length`` tokens, longest first, and which of them begin a text."""
    parts = [(t[i : i + length], i == 0) for t in texts for i in range(0, len(t), length)]
    parts.sort(key=lambda p: -len(p[0]))
    return [p for p, _ in parts], np.array([f for _, f in parts], dtype=bool)


def expectations(model: HiddenMarkov, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Expected counts of state and class, and of starts, goings-on and steps (rows of one array).

    All segments go forward and backward in step, so a batch is a few matrix products per position.
    """
    classes, k = model.emit.shape
    emitted, moves = np.zeros((classes, k)), np.zeros((2 + k, k))
    parts, first = segments(texts)
    if not parts:
        return emitted, moves
    lengths = np.array([len(p) for p in parts])
    n, steps = len(parts), int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # parts longer than t
    obs = np.zeros((steps, n), dtype=np.int32)
    for j, p in enumerate(parts):
        obs[: len(p), j] = p
    step, emit = model.step.astype(np.float32), model.emit.astype(np.float32)
    alpha, seen = np.zeros((steps, n, k), np.float32), np.zeros((steps, n, k), np.float32)
    scale = np.ones((steps, n, 1), np.float32)
    now = np.where(first[:, None], model.start, model.again).astype(np.float32)
    for t in range(steps):
        m = active[t]
        seen[t, :m] = emit[obs[t, :m]]
        here = now[:m] * seen[t, :m]
        scale[t, :m, 0] = np.maximum(here.sum(axis=1), 1e-30)
        alpha[t, :m] = here / scale[t, :m]
        now = alpha[t, :m] @ step
    beta = np.ones((n, k), np.float32)
    for t in range(steps - 1, -1, -1):
        m = active[t]
        if t + 1 < steps:
            go = active[t + 1]
            ahead = seen[t + 1, :go] * beta[:go] / scale[t + 1, :go]
            moves[2:] += alpha[t, :go].T @ ahead
            beta[:go] = ahead @ step.T
        gamma = alpha[t, :m] * beta[:m]
        alpha[t, :m] = gamma / gamma.sum(axis=1, keepdims=True)
    moves[2:] *= model.step
    moves[0], moves[1] = alpha[0][first].sum(axis=0), alpha[0][~first].sum(axis=0)
    inside = np.arange(n)[None, :] < active[:, None]
    flat, weights = obs[inside], alpha[inside]
    for s in range(k):
        emitted[:, s] = np.bincount(flat, weights[:, s], minlength=classes)
    return emitted, moves


def maximise(emitted: np.ndarray, moves: np.ndarray, shares: np.ndarray) -> HiddenMarkov:
    """Model of these counts; each state is smoothed towards the class shares of the corpus."""
    k = emitted.shape[1]
    emit = (emitted + CLASS_PRIOR * shares[:, None]) / (emitted.sum(axis=0) + CLASS_PRIOR)
    even = emitted.sum(axis=0) + STEP_PRIOR
    part = [(m + STEP_PRIOR * even / even.sum()) / (m.sum() + STEP_PRIOR) for m in moves]
    return HiddenMarkov(part[0], part[1], np.array(part[2:]).reshape(k, k), emit)


def first_model(shares: np.ndarray, states: int) -> HiddenMarkov:
    """States that differ by fixed noise and change rarely."""
    rng = np.random.default_rng(13)
    emit = shares[:, None] * rng.uniform(0.5, 1.5, (len(shares), states))
    step = np.full((states, states), (1 - STAY) / max(1, states - 1)) + np.eye(states) * (STAY - (1 - STAY) / max(1, states - 1))
    even = np.full(states, 1 / states)
    return HiddenMarkov(even, even, step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def id_lists(column: pa.ListArray) -> list[np.ndarray]:
    offsets = column.offsets.to_numpy()
    return np.split(column.flatten().to_numpy(), offsets[1:-1] - offsets[0]) if len(column) else []


def in_batches(batches: Iterator[pa.RecordBatch], column: str, tokens: int) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Record batches put together until they hold ``tokens`` tokens."""
    held, texts, size = [], [], 0
    for batch in batches:
        more = id_lists(batch.column(column))
        held.append(batch)
        texts += more
        size += sum(map(len, more))
        if size >= tokens:
            yield held, texts
            held, texts, size = [], [], 0
    if held:
        yield held, texts


def expected_counts(encoded: DataFrame, model: HiddenMarkov) -> tuple[np.ndarray, np.ndarray]:
    """Expected counts over all rows: each task adds its own up, Spark adds those of the tasks per class.

    Tasks send fixed-point numbers, so the sums do not depend on the order in which they are added.
    """
    classes, k = model.emit.shape
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emitted, moves = np.zeros((classes, k)), np.zeros((2 + k, k))
        for _, texts in in_batches(batches, "ids", TRAIN_TOKENS):
            for i in range(0, len(texts), 4 * SEGMENT):
                e, m = expectations(shared.value, texts[i : i + 4 * SEGMENT])
                emitted += e
                moves += m
        both = np.rint(np.concatenate([moves, emitted]) * FIXED_POINT).astype(np.int64)
        some = np.flatnonzero(both.any(axis=1))
        columns = [pa.array(some, pa.int64()), *[pa.array(both[some, s]) for s in range(k)]]
        yield pa.RecordBatch.from_arrays(columns, ["place", *[f"s{s}" for s in range(k)]])

    schema = "place long, " + ", ".join(f"s{s} long" for s in range(k))
    sums = encoded.select("ids").mapInArrow(counted, schema).groupBy("place").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(k)])
    both = np.zeros((2 + k + classes, k))
    for r in sums.collect():
        both[r["place"]] = [r[f"s{s}"] / FIXED_POINT for s in range(k)]
    shared.destroy()
    return both[2 + k :], both[: 2 + k]


def fit_states(encoded: DataFrame, vocabulary: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> HiddenMarkov:
    """Baum-Welch over the ``usable`` rows of :func:`encode`.

    The first states come from ``SEED_ROUNDS`` rounds over at most ``SEED_DOCUMENTS`` texts and
    ``SEED_TOKENS`` tokens, whole texts that are no longer than a tenth of this; the ``rounds`` that count then
    read all usable rows.  Without usable rows the states stay as they were made.
    """
    shares, training = vocabulary.class_shares(), encoded.where("usable")
    model = first_model(shares, states)
    order = (F.xxhash64("doc_id"), F.col("n_tokens"), F.col("rid"))
    seeds = training.where(F.col("n_tokens") <= SEED_TOKENS // 10).orderBy(*order).limit(SEED_DOCUMENTS).select("ids")
    texts = [np.array(r["ids"], dtype=np.int32) for r in seeds.toLocalIterator()]
    texts = [t for t, used in zip(texts, np.cumsum([0, *map(len, texts)])) if used < SEED_TOKENS]
    for _ in range(SEED_ROUNDS if texts else 0):
        model = maximise(*expectations(model, texts), shares)
    for _ in range(rounds):
        model = maximise(*expected_counts(training, model), shares)
    return model


def log10_likelihood(model: HiddenMarkov, texts: list[np.ndarray]) -> np.ndarray:
    """Exact log10 probability of each class sequence by the scaled forward pass, all texts in step."""
    if not texts:
        return np.zeros(0)
    order = np.argsort([-len(t) for t in texts], kind="stable")
    lengths = np.array([len(texts[i]) for i in order])
    starts = np.cumsum([0, *lengths])[:-1]
    flat = np.concatenate([texts[i] for i in order]) if lengths.sum() else np.zeros(0, np.int32)
    total = np.zeros(len(texts))
    ends = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left")
    now = np.tile(model.start, (len(texts), 1))
    for t, m in enumerate(ends):
        here = now[:m] * model.emit[flat[starts[:m] + t]]
        size = here.sum(axis=1)
        total[:m] += np.log10(size)
        now = (here / size[:, None]) @ model.step
    out = np.empty(len(texts))
    out[order] = total
    return out


def score_texts(encoded: DataFrame, vocabulary: Vocabulary, model: HiddenMarkov) -> DataFrame:
    """``doc_id``, ``usable``, ``n_tokens``, ``n_known``, ``base_score`` and ``score`` of each row of :func:`encode`.

    Rare words meet the counts of the corpus by an equi join; frequent words, which could be hot keys of
    it, have been counted in the row.  Sums of a row come together by its ``rid``.
    """
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(model)
    plain = [f for f in encoded.schema.fields if f.name not in ("ids", "rare", "rare_n")]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, texts in in_batches(batches, "ids", SCORE_TOKENS):
            scores, at = log10_likelihood(shared.value, texts), 0
            for batch in held:
                part = scores[at : at + batch.num_rows]
                at += batch.num_rows
                columns = [batch.column(f.name) for f in plain]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(part, pa.float64())], [*[f.name for f in plain], "path"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain) + ", path double"
    paths = encoded.select(*[f.name for f in plain], "ids").mapInArrow(scored, schema)

    v = vocabulary
    sizes = v.bucket_n + WORD_PRIOR * (v.bucket_v + 1)
    buckets = spark.createDataFrame([(i, float(x)) for i, x in enumerate(sizes)], "b int, size double")
    rare = encoded.select("rid", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select(
        "rid", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("times")
    )
    n = F.coalesce("n", F.lit(0))
    met = (
        rare.join(v.counts, "word", "left")
        .withColumn("b", bucket(F.col("word")))
        .join(F.broadcast(buckets), "b")
        .groupBy("rid")
        .agg(
            F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
            F.sum(F.col("times") * F.log10((n + 1) / F.lit(float(v.tokens + v.distinct + 1)))).alias("rare_base"),
            F.sum(F.col("times") * F.log10((n + WORD_PRIOR) / F.col("size"))).alias("rare_path"),
        )
    )
    zero = F.lit(0)
    return paths.join(met, "rid", "left").select(
        "doc_id",
        "usable",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", zero)).alias("n_known"),
        (F.col("base") + F.coalesce("rare_base", zero)).alias("base_score"),
        (F.col("path") + F.coalesce("rare_path", zero)).alias("score"),
    )


def language_model_scores(
    docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", limit: int = TOP_WORDS
) -> tuple[DataFrame, Vocabulary, HiddenMarkov]:
    """Learn from the ``usable`` rows of ``docs`` and score all of them; also gives what was learnt.

    Null text counts as empty and has the end alone.  Repeated rows are scored one by one, and null ids are
    ids like others.  Very long texts are scored as a whole, 20 bytes of state per token.  Without usable rows
    all words are unknown; an empty table gives an empty result.  Other columns are not read.
    """
    usable = F.coalesce(usable, F.lit(False))
    vocabulary = fit_vocabulary(docs, usable, text_col, limit)
    encoded = encode(docs, vocabulary, usable, id_col, text_col)
    model = fit_states(encoded, vocabulary)
    return score_texts(encoded, vocabulary, model), vocabulary, model
