"""Lexicon lookups: words outside the lexicon, accent and near candidates, classification."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthoflow import fixed_values as V
from orthoflow.functions.text import fold, is_title, is_upper, scrub_non_lexical, words
from orthoflow.session import FREQUENT_ENTRIES, cut

# Lexicon words up to this length are found by deleted letters, longer ones by segments.
SHORT_WORD = 14


def lexicon_from_documents(documents: DataFrame, min_documents: int = 3) -> DataFrame:
    """Lexicon of the keys that occur in at least ``min_documents`` documents per language.

    Repeats inside a document are removed in its row, so one count per word is enough.
    """
    keys = F.array_distinct(F.transform(words(scrub_non_lexical("text")), F.lower))
    return (
        documents.select("lang", F.explode_outer(keys).alias("word"))
        .where("word is not null")
        .groupBy("lang", "word")
        .agg(F.count("*").alias("df"))
        .where(F.col("df") >= min_documents)
    )


def out_of_lexicon(rows: DataFrame, lexicon: DataFrame, scope: list[str] = ["lang"]) -> DataFrame:
    """Rows whose ``token`` the lexicon does not accept.

    A word is accepted exactly, or by its lower-case entry when it is written in Title or
    UPPER form.  A Title entry does not accept the lower-case word.

    Rows of the ``FREQUENT_ENTRIES`` most frequent entries leave first, next to the scan (a broadcast of
    fixed length), so no frequent word is a hot key of the joins with the whole lexicon.  Those
    are planned on the stored size of the lexicon, and the second one has the word itself, not
    null, as key of words that have no other accepted form.
    """
    lexicon = words_of(lexicon)
    entries = lexicon.select(*scope, F.col("word").alias("_form"))
    weight = [F.desc("df")] if "df" in lexicon.columns else []
    frequent = F.broadcast(
        lexicon.orderBy(*weight, *scope, "word").limit(FREQUENT_ENTRIES).select(*scope, F.col("word").alias("_form"))
    )
    cased = F.when(is_title("token") | is_upper("token"), F.lower("token")).otherwise(F.col("token"))
    out = rows
    for known in (frequent, entries):
        for form in (F.col("token"), cased):
            out = out.withColumn("_form", form).join(known, [*scope, "_form"], "left_anti")
    return out.drop("_form")


@dataclass(frozen=True)
class PreparedLexicon:
    """A stored lexicon with its stored suggestion entries, for many reviews."""

    words: DataFrame
    entries: DataFrame


def prepare_lexicon(lexicon: DataFrame | PreparedLexicon, scope: list[str] = ["lang"]) -> PreparedLexicon:
    """Store a lexicon and its entries once; one that is prepared is returned as it is."""
    if isinstance(lexicon, PreparedLexicon):
        return lexicon
    words_ = cut(lexicon.select(*scope, "word", "df"), "lexicon")
    return PreparedLexicon(words_, cut(suggestion_entries(words_, scope), "entries"))


def words_of(lexicon: DataFrame | PreparedLexicon) -> DataFrame:
    return lexicon.words if isinstance(lexicon, PreparedLexicon) else lexicon


def entries_of(lexicon: DataFrame | PreparedLexicon, scope: list[str]) -> DataFrame:
    if isinstance(lexicon, PreparedLexicon):
        return lexicon.entries
    return cut(suggestion_entries(lexicon, scope), "entries")


def valid_in_any(rows: DataFrame, lexicon: DataFrame, locales: list[str]) -> DataFrame:
    """Rows whose ``token`` at least one of the locales accepts."""
    entries = words_of(lexicon).where(F.col("lang").isin(*locales)).select(F.col("word").alias("_form")).distinct()
    forms = F.array_distinct(
        F.array("token", F.when(is_title("token") | is_upper("token"), F.lower("token")).otherwise(F.col("token")))
    )
    by_form = rows.select(F.col("token")).distinct().select("token", F.explode_outer(forms).alias("_form"))
    accepted = by_form.join(entries, "_form", "left_semi").select("token").distinct()
    return rows.join(accepted, "token", "left_semi")


def suggestion_entries(lexicon: DataFrame, scope: list[str] = ["lang"]) -> DataFrame:
    """One suggestion per lower-case word: the most frequent casing, then the first by order."""
    low = F.lower("word")
    return (
        lexicon.select(*scope, "word", "df")
        .groupBy(*scope, low.alias("low"))
        .agg(F.min(F.struct((-F.col("df")).alias("rank"), F.col("word"))).alias("best"))
        .select(
            *scope,
            F.col("best.word").alias("word"),
            "low",
            fold("low").alias("word_fold"),
            (-F.col("best.rank")).alias("df"),
        )
    )


def accent_candidates(rows: DataFrame, lexicon: DataFrame, scope: list[str] = ["lang"]) -> DataFrame:
    """Lexicon words that differ from ``token`` by accents only."""
    entries = suggestion_entries(lexicon, scope).withColumnRenamed("word_fold", "fold")
    return (
        rows.withColumn("fold", fold("token"))
        .join(entries.withColumnRenamed("word", "suggestion"), [*scope, "fold"])
        .where(F.lower("token") != F.col("low"))
        .drop("low")
    )


# Pairs (length difference, segment, shift) that find every word within two edits: of three
# segments of the lexicon word at least one is unchanged at one of these places.
_PROBES = [
    (d, i, s)
    for d in (-2, -1, 0, 1, 2)
    for i in (1, 2, 3)
    for s in range(-2, 3)
    if abs(s) <= i - 1 and abs(s - d) <= 3 - i
]


# Bits of the hash in a key: the other bytes of the column are the same in most rows, so they take little place.
KEY_BITS = 40
_SEGMENT = 3


def _key(hashed: Column, cut_off: Column) -> Column:
    """A blocking key and, in its last two bits, the letters cut off for it (``_SEGMENT``: it is of a segment)."""
    return F.shiftleft(F.shiftright(hashed, 64 - KEY_BITS), 2) + cut_off


def _short_keys(df: DataFrame, word: str, scope: list[str]) -> DataFrame:
    """One row per form of ``word`` with none, one or two letters removed; ``_key`` ends with their number."""
    n = F.length(word)
    w, i, j = F.col(word), F.col("_i"), F.col("_j")
    form = (
        F.when(j == 0, w)
        .when(i == 0, F.concat(F.substring(w, F.lit(1), j - 1), F.substring(w, j + 1, n)))
        .otherwise(
            F.concat(
                F.substring(w, F.lit(1), i - 1),
                F.substring(w, i + 1, j - i - 1),
                F.substring(w, j + 1, n),
            )
        )
    )
    return (
        df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))))
        .withColumn("_j", F.explode(F.sequence(F.when(i > 0, i + 1).otherwise(0), n)))
        .withColumn("_key", _key(F.xxhash64(*scope, F.lit(0), form), (i > 0).cast("int") + (j > 0).cast("int")))
        .drop("_i", "_j")
    )


def _segment_start(length: Column, i: Column) -> Column:
    return F.floor((i - 1) * length / 3).cast("int")


def _segment_key(scope: list[str], word: Column, length: Column, i: Column, at: Column) -> Column:
    size = _segment_start(length, i + 1) - _segment_start(length, i)
    return _key(F.xxhash64(*scope, length, i, F.substring(word, at + 1, size)), F.lit(_SEGMENT))


def _long_keys_entry(df: DataFrame, word: str, scope: list[str]) -> DataFrame:
    """One row per third of ``word``."""
    n, i = F.length(word), F.col("_i")
    return (
        df.withColumn("_i", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
        .withColumn("_key", _segment_key(scope, F.col(word), n, i, _segment_start(n, i)))
        .drop("_i")
    )


def _long_keys_probe(df: DataFrame, word: str, scope: list[str]) -> DataFrame:
    """One row per place where a third of a lexicon word can stand unchanged."""
    n, m, at = F.length(word), F.col("_m"), F.col("_at")
    probes = F.array(
        *[F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(s).alias("s")) for d, i, s in _PROBES]
    )
    size = _segment_start(m, F.col("_p.i") + 1) - _segment_start(m, F.col("_p.i"))
    return (
        df.withColumn("_p", F.explode(probes))
        .withColumn("_m", n - F.col("_p.d"))
        .where(m > SHORT_WORD)
        .withColumn("_at", _segment_start(m, F.col("_p.i")) + F.col("_p.s"))
        .where((at >= 0) & (at + size <= n))
        .withColumn("_key", _segment_key(scope, F.col(word), m, F.col("_p.i"), at))
        .drop("_p", "_m", "_at")
    )


def _distance_at_key(cut_off: Column) -> Column:
    """Distance of ``fold`` and ``word_fold``, which share a key, or -1 where this key is not one of their own.

    Words at distance d reach a common form by at most d deletions each.  Of the keys that two words share, those of
    more deletions than their distance only repeat the pair, so they give -1.  ``cut_off``: letters that ``fold`` has
    lost at this key, or ``_SEGMENT``; what the other word has lost follows from the lengths.
    """
    other = cut_off + F.length("word_fold") - F.length("fold")
    most, least = F.greatest(cut_off, other), F.least(cut_off, other)
    equal = F.col("fold") == F.col("word_fold")
    distance = F.levenshtein("fold", "word_fold", V.MAX_DISTANCE)
    return (
        F.when(cut_off == _SEGMENT, distance)
        .when(most == 0, F.when(equal, 0).otherwise(-1))
        .when((most == 1) & (least == 1), F.when(equal, -1).otherwise(distance))
        .when(distance == most, most)
        .otherwise(-1)
    )


def candidate_pairs(folds: DataFrame, entries: DataFrame, scope: list[str] = ["lang"]) -> DataFrame:
    """Pairs of a folded word and a lexicon entry that share a blocking key (with repeats).

    Two words within distance 2 always share one: either both reach a common form by at most
    two deletions each, or one of three segments of the longer words is unchanged.  So the
    distance join is an equi join on one key and no pair is lost; pairs that only
    collide in the hash are told apart by ``dist``, which is -1 beyond distance 2, across
    scopes, and at keys that only repeat a pair.  A long word has a fixed number of keys, so junk words of any length stay cheap.

    One word becomes some fifty rows, so the words are spread evenly before that, their rows are kept narrow
    (an entry carries its word only where folding changes it), and the join is a merge
    join at every size: the stored size of the words says nothing of that of their keys, which are never sent out.
    """
    n = F.length("fold")
    folds = folds.select(*scope, "fold").repartition(*scope, "fold")
    left = _short_keys(folds.where(n <= SHORT_WORD + V.MAX_DISTANCE), "fold", scope).unionByName(
        _long_keys_probe(folds.where(n > SHORT_WORD - V.MAX_DISTANCE), "fold", scope)
    )
    m = F.length("word_fold")
    own_word = F.nullif(F.col("word"), F.col("word_fold")).alias("word")
    entries = entries.select(*scope, own_word, "word_fold", "df").repartition(*scope, "word_fold")
    right = _short_keys(entries.where(m <= SHORT_WORD), "word_fold", scope).unionByName(
        _long_keys_entry(entries.where(m > SHORT_WORD), "word_fold", scope)
    )
    right = right.withColumnsRenamed({c: f"_{c}" for c in [*scope, "_key"]})
    same = reduce(Column.__and__, [F.col(c) == F.col(f"_{c}") for c in scope], F.lit(True))
    return (
        left.hint("merge").join(right, F.shiftright("_key", 2) == F.shiftright("__key", 2))
        .withColumn("dist", F.when(same, _distance_at_key(F.col("_key").bitwiseAND(F.lit(3)).cast("int"))).otherwise(-1))
        .withColumn("word", F.coalesce("word", "word_fold"))
        .drop(*[f"_{c}" for c in scope], "_key", "__key")
    )


def _near_with_repeats(folds: DataFrame, lexicon: DataFrame, scope: list[str]) -> DataFrame:
    entries = entries_of(lexicon, scope)
    pairs = candidate_pairs(folds, entries, scope)
    return pairs.where("dist >= 0").withColumnRenamed("word", "suggestion")


def near_candidates(folds: DataFrame, lexicon: DataFrame, scope: list[str] = ["lang"]) -> DataFrame:
    """All lexicon words within distance 2 of the distinct ``fold`` values."""
    return _near_with_repeats(folds, lexicon, scope).dropDuplicates([*scope, "fold", "suggestion"])


def best_candidates(
    folds: DataFrame, lexicon: DataFrame, k: int, scope: list[str] = ["lang"]
) -> DataFrame:
    """The first ``k`` near candidates per fold by distance, document frequency and word, as
    one ordered array of fixed size.

    A dense rank gives repeats of a pair the same place, so they need no step of their own,
    and Spark drops everything beyond place ``k`` before the shuffle.
    """
    order = Window.partitionBy(*scope, "fold").orderBy("dist", F.desc("df"), "suggestion")
    return (
        _near_with_repeats(folds, lexicon, scope)
        .select(*scope, "fold", "dist", "df", "suggestion")
        .withColumn("_place", F.dense_rank().over(order))
        .where(F.col("_place") <= k)
        .groupBy(*scope, "fold")
        .agg(F.sort_array(F.collect_set(F.struct("_place", "dist", "suggestion"))).alias("near"))
    )


def _with_fold(words_: DataFrame) -> DataFrame:
    return words_ if "fold" in words_.columns else words_.withColumn("fold", fold("token"))


def classify(unknown: DataFrame, near: DataFrame, scope: list[str] = ["lang"]) -> DataFrame:
    """Kind and suggestions of each word.

    Accent-only suggestions come first and make the word ``tilde``; otherwise a distance of
    at most 2 makes it ``ortografia``.  Words without candidates are not returned.  ``near``
    holds one candidate more than is shown, because a candidate that equals the word apart
    from capitals moves behind the accent-only ones.
    """
    accent = lambda c: (c["dist"] == 0) & (F.lower(c["suggestion"]) != F.lower(F.col("token")))
    ranked = F.concat(F.filter("near", accent), F.filter("near", lambda c: ~accent(c)))
    return (
        _with_fold(unknown)
        .join(near, [*scope, "fold"])
        .withColumn("kind", F.when(F.exists("near", accent), "tilde").otherwise("ortografia"))
        .withColumn(
            "suggestions",
            F.transform(F.slice(ranked, 1, V.MAX_SUGGESTIONS), lambda c: c["suggestion"]),
        )
        .drop("near", "fold")
    )


def classify_two_languages(candidates: DataFrame, keys: list[str], main: str = "es") -> DataFrame:
    """Accent test over the suggestions of all languages, distance over the main one only."""
    accent = F.col("accent_only")
    return (
        candidates.groupBy(*keys)
        .agg(
            F.bool_or(accent).alias("any_accent"),
            F.min(F.when(F.col("lang") == main, F.col("dist"))).alias("main_dist"),
        )
        .withColumn(
            "kind",
            F.when(F.col("any_accent"), "tilde").when(F.col("main_dist") <= V.MAX_DISTANCE, "ortografia"),
        )
        .drop("any_accent", "main_dist")
    )


def top_suggestions(
    candidates: DataFrame, keys: list[str], order: list, k: int = V.MAX_SUGGESTIONS
) -> DataFrame:
    """First ``k`` suggestions per group, repeats by case removed, order kept."""
    once = Window.partitionBy(*keys, F.lower("suggestion")).orderBy(*order)
    place = Window.partitionBy(*keys).orderBy(*order)
    return (
        candidates.withColumn("_rn", F.row_number().over(once))
        .where("_rn = 1")
        .withColumn("_rn", F.row_number().over(place))
        .where(F.col("_rn") <= k)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("_rn", "suggestion"))).alias("s"))
        .select(*keys, F.transform("s", lambda x: x["suggestion"]).alias("suggestions"))
    )
