"""Lexicon engineering: bags of words as tables with an optional package column.

Rule lists (markers, endings, affixes) are fixed and short, so they are literals of the
expression: the row is widened in place instead of being cross joined with a rule table.
Word lists that can grow (deny, fixes, reference lexicons) are tables and are joined.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthoflow import fixed_values as V
from orthoflow.functions.morphology import (
    PLURALS,
    accented_forms,
    contains_any,
    gender_number_forms,
    string_array,
)
from orthoflow.functions.text import (
    any_ending,
    bad_unaccented,
    fold,
    has_diacritic,
    looks_english,
    strip,
    title_form,
    valid_loanword,
    valid_word,
    words as words_of,
)


def merge_bags(*bags: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, bags).distinct()


def subtract_base(words: DataFrame, base: DataFrame) -> DataFrame:
    """Words that the base lexicon does not have."""
    return words.join(base.select("word"), "word", "left_anti")


def deny(words: DataFrame, denied: DataFrame) -> DataFrame:
    """Remove denied words whatever their case; where both have ``pkg``, in the package that denies them."""
    scope = [c for c in _scope(words) if c in denied.columns]
    keys = denied.select(*scope, F.lower("word").alias("_low")).distinct()
    return words.withColumn("_low", F.lower("word")).join(keys, [*scope, "_low"], "left_anti").drop("_low")


def apply_fixes(words: DataFrame, fixes: DataFrame, **bounds) -> DataFrame:
    """Replace words by their fix; a null fix drops the word; other words are validated."""
    listed = fixes.select("word", F.col("fixed"), F.lit(True).alias("_listed"))
    return (
        words.join(listed, "word", "left")
        .where(F.when(F.col("_listed"), F.col("fixed").isNotNull()).otherwise(valid_word("word", **bounds)))
        .withColumn("word", F.coalesce("fixed", "word"))
        .drop("fixed", "_listed")
        .distinct()
    )


def force_keep(words: DataFrame, keep: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Add curated words after filtering; ``removed`` drops wrong twins of them, where it has ``pkg`` in that package."""
    bag = merge_bags(words, keep)
    if removed is None:
        return bag
    keys = [*[c for c in _scope(bag) if c in removed.columns], "word"]
    return bag.join(removed.select(*keys), keys, "left_anti")


def harvest(words: DataFrame, markers: Sequence[str]) -> DataFrame:
    """Words that contain any of the markers."""
    return words.where(contains_any(F.lower("word"), markers))


def harvest_with_markers(words: DataFrame, markers: Sequence[str]) -> DataFrame:
    """One row per word and marker that it contains."""
    low = F.lower("word")
    hits = F.filter(string_array(markers), lambda m: F.contains(low, m))
    return words.withColumn("marker", F.explode_outer(hits)).where("marker is not null")


def in_domain(
    word: Column | str,
    suffixes: Sequence[str],
    prefixes: Sequence[str],
    keep: Sequence[str] = (),
    denied: Sequence[str] = (),
    long_from: int | None = None,
) -> Column:
    """Keep list, domain ending, or domain beginning with more than two further letters.

    ``long_from`` is the broad form: words of that length or more are kept as well.
    """
    low = F.lower(F.col(word) if isinstance(word, str) else word)
    hit = F.rlike(low, F.lit(any_ending(suffixes))) | F.rlike(low, F.lit("^(" + "|".join(prefixes) + ").{3,}"))
    if long_from is not None:
        hit = hit | (F.length(low) >= long_from)
    if keep:
        hit = low.isin(*keep) | hit
    return ~low.isin(*denied) & hit if denied else hit


def domain_harvest(words: DataFrame, suffixes, prefixes, keep=(), denied=(), long_from=None) -> DataFrame:
    return words.where(in_domain("word", suffixes, prefixes, keep, denied, long_from))


def domain_rule(word: Column | str, suffixes: Sequence[str], prefixes: Sequence[str]) -> Column:
    """The first ending or beginning that makes a word part of the domain."""
    low = F.lower(F.col(word) if isinstance(word, str) else word)
    endings = F.transform(
        F.filter(string_array(suffixes), lambda s: F.endswith(low, s)), lambda s: F.concat(F.lit("-"), s)
    )
    starts = F.transform(
        F.filter(string_array(prefixes), lambda p: F.startswith(low, p) & (F.length(low) > F.length(p) + 2)),
        lambda p: F.concat(p, F.lit("-")),
    )
    return F.try_element_at(F.concat(endings, starts), F.lit(1))


def cross_lexicon_harvest(lexicon: DataFrame, source: str, needs: dict[str, Sequence[str]]) -> DataFrame:
    """Words of package ``source`` that other packages need, as (pkg, word)."""
    low = F.lower("word")
    takers = F.array(
        *[F.when(contains_any(low, markers), F.lit(pkg)) for pkg, markers in sorted(needs.items())]
    )
    return (
        lexicon.where(F.col("pkg") == source)
        .select(F.explode_outer(takers).alias("pkg"), "word")
        .where("pkg is not null")
        .distinct()
    )


def glossary_harvest(
    documents: DataFrame, document_markers: Sequence[str], word_markers: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """Words of 3 to 40 letters of the documents that mention the domain, if they contain a
    word marker or are listed."""
    low = F.lower("word")
    fits = contains_any(low, word_markers)
    return (
        documents.where(contains_any(F.lower("text"), document_markers))
        .select(F.explode_outer(F.regexp_extract_all("text", F.lit("[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]{3,40}"), F.lit(0))).alias("word"))
        .where("word is not null")
        .distinct()
        .where(low.isin(*keep) | fits if keep else fits)
    )


def _letters(word: Column, low: int, high: int) -> Column:
    return F.length(word).between(low, high) & F.rlike(word, F.lit(V.LEXICON_WORD))


def word_affixes(
    roots: DataFrame,
    suffixes: Sequence[str] = V.COMMON_SUFFIXES,
    prefixes: Sequence[str] = (),
    bases: DataFrame | None = None,
    skip_same_ending: bool = False,
) -> DataFrame:
    """Roots with every suffix and bases with every prefix, within length bounds.

    ``skip_same_ending``: a root that already ends with the suffix is left out.
    """
    suffixed = roots.select(*_scope(roots), "word", F.explode(string_array(suffixes)).alias("_s"))
    if skip_same_ending:
        suffixed = suffixed.where(~F.endswith("word", "_s"))
    low = 3 if skip_same_ending else 5
    out = suffixed.withColumn("word", F.concat("word", "_s")).drop("_s").where(_letters(F.col("word"), low, 45 if skip_same_ending else 42))
    if bases is not None:
        prefixed = (
            bases.select(*_scope(bases), "word", F.explode(string_array(prefixes)).alias("_p"))
            .withColumn("word", F.concat("_p", "word"))
            .drop("_p")
            .where(_letters(F.col("word"), 6, 42))
        )
        out = out.unionByName(prefixed)
    return out.distinct()


def restricted_affixes(
    roots: DataFrame, free: Sequence[str], limited: Sequence[str], allowed: DataFrame, max_length: int = 40
) -> DataFrame:
    """Free suffixes join every root, limited ones only the allowed roots."""
    listed = allowed.select("word").distinct().withColumn("_ok", F.lit(True))
    table = F.when(F.col("_ok"), string_array([*free, *limited])).otherwise(string_array(free))
    return (
        roots.join(listed, "word", "left")
        .select(*_scope(roots), F.explode_outer(F.transform(table, lambda s: F.concat(F.col("word"), s))).alias("word"))
        .where(F.length("word").between(5, max_length))
        .distinct()
    )


def _scope(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c == "pkg"]


def seed_words(blocks: DataFrame, **bounds) -> DataFrame:
    """Valid words of seed texts split at white space."""
    return (
        blocks.select(*_scope(blocks), F.explode_outer(F.split(strip("text"), r"\s+")).alias("word"))
        .where(valid_word("word", **bounds))
        .distinct()
    )


def gender_number(
    words: DataFrame, pairs=V.GENDER_PAIRS, adverbs: bool = False, title_markers: Sequence[str] | None = None
) -> DataFrame:
    """Valid words with their gender and number forms."""
    return (
        words.where(valid_word("word"))
        .select(*_scope(words), F.explode_outer(gender_number_forms("word", pairs, adverbs, title_markers)).alias("word"))
        .distinct()
    )


def plurals(words: DataFrame, rule: str = "general") -> DataFrame:
    return (
        words.select(*_scope(words), PLURALS[rule](F.col("word")).alias("word")).where("word is not null").distinct()
    )


def title_variants(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Title form of the listed words that are written in lower case."""
    low = F.lower("word")
    return (
        words.where(low.isin(*[k.lower() for k in keys]) & F.rlike("word", F.lit(r"^\p{Ll}")))
        .withColumn("word", title_form("word"))
        .distinct()
    )


def accented_keys(words: DataFrame, forms: bool = True) -> DataFrame:
    """Distinct folded keys of accented words and (``forms``) of their safe adjective forms."""
    if not forms:
        return words.where(has_diacritic("word")).select(*_scope(words), fold("word").alias("fold")).distinct()
    return (
        words.select(*_scope(words), F.explode_outer(accented_forms("word")).alias("form"))
        .where("form is not null")
        .select(*_scope(words), fold("form").alias("fold"))
        .distinct()
    )


def drop_masked_forms(words: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """Drop unaccented words that have an accented sibling in the bag or the reference."""
    return _with_masked(words, reference).where("not masked").drop("masked")


def _with_masked(words: DataFrame, reference: DataFrame | None, forms: bool = True) -> DataFrame:
    scope = _scope(words)
    plain = ~has_diacritic("word")
    own = accented_keys(words, forms).withColumn("_own", F.lit(True))
    marked = words.withColumn("fold", fold("word")).join(own, [*scope, "fold"], "left")
    masked = F.coalesce("_own", F.lit(False))
    if reference is not None:
        given = accented_keys(reference.select("word"), forms).withColumn("_ref", F.lit(True))
        marked = marked.join(given, "fold", "left")
        masked = masked | F.coalesce("_ref", F.lit(False))
    return marked.withColumn("masked", plain & masked).drop("fold", "_own", "_ref")


def orthography_reasons(
    words: DataFrame,
    reference: DataFrame | None = None,
    variant: str = "spanish",
    english: bool = True,
) -> DataFrame:
    """Every word with the reason that decides: english, masked, bad_ending or kept.

    ``variant="loanword"`` has no English test, its own list of endings, and looks at accented
    words only, not at their other forms.
    """
    loan = variant == "loanword"
    bad = bad_unaccented("word", (), V.BAD_ENDINGS_LOANWORD) if loan else bad_unaccented("word")
    reason = F.when(F.lit(english and not loan) & looks_english("word"), "english")
    reason = reason.when(F.col("masked"), "masked").when(bad, "bad_ending").otherwise("kept")
    return _with_masked(words, reference, forms=not loan).withColumn("reason", reason).drop("masked")


def orthography_filter(words, reference=None, variant="spanish", english=True) -> DataFrame:
    return orthography_reasons(words, reference, variant, english).where("reason = 'kept'").drop("reason")


def scrub_missing_accents(lexicon: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """Only the accent rules, never the English one."""
    return orthography_filter(lexicon, reference, english=False)


def filter_report(reasons: DataFrame) -> DataFrame:
    """Words per reason, with a total per package and overall."""
    return (
        reasons.rollup(*_scope(reasons), "reason")
        .agg(F.count("*").alias("words"))
        .withColumn("reason", F.coalesce("reason", F.lit("input")))
    )


def seed_then_refilter(words: DataFrame, seeds: DataFrame, reference=None, variant="spanish") -> DataFrame:
    """Add false-positive seeds; filter again so that they bring no masked form back.
    Loanwords are not filtered again."""
    bag = merge_bags(words, seeds)
    return bag if variant == "loanword" else orthography_filter(bag, reference)


def lexicon_diff(old: DataFrame, new: DataFrame, sample: int = 30) -> DataFrame:
    """Per package: before, after, dropped, added, and the first dropped words."""
    left = old.select("pkg", "word").distinct().withColumn("_old", F.lit(True))
    right = new.select("pkg", "word").distinct().withColumn("_new", F.lit(True))
    both = left.join(right, ["pkg", "word"], "full").withColumn(
        "status",
        F.when(F.col("_new").isNull(), "dropped").when(F.col("_old").isNull(), "added").otherwise("kept"),
    )
    counts = both.groupBy("pkg").agg(
        F.count("_old").alias("before"),
        F.count("_new").alias("after"),
        F.count_if(F.col("status") == "dropped").alias("dropped"),
        F.count_if(F.col("status") == "added").alias("added"),
    )
    order = Window.partitionBy("pkg").orderBy(F.lower("word"), "word")
    first = (
        both.where("status = 'dropped'")
        .withColumn("_rn", F.row_number().over(order))
        .where(F.col("_rn") <= sample)
        .groupBy("pkg")
        .agg(F.sort_array(F.collect_list(F.struct("_rn", "word"))).alias("s"))
        .select("pkg", F.transform("s", lambda x: x["word"]).alias("sample"))
    )
    return counts.join(first, "pkg", "left")


def verify_lexicon(lines: DataFrame) -> DataFrame:
    """Declared count, real count, accented words, exact duplicates, case-only pairs, verdict.

    Counted in steps (word, lower-case word, package), so no distinct count needs its own copy
    of the rows."""
    entry = strip("line")
    is_count = F.rlike(entry, F.lit(r"^\d+$"))
    by_word = (
        lines.where(F.length(entry) > 0)
        .groupBy("pkg", is_count.alias("header"), entry.alias("word"))
        .agg(F.count("*").alias("n"))
    )
    by_low = by_word.groupBy("pkg", "header", F.lower("word").alias("low")).agg(
        F.sum("n").alias("n"),
        F.count("*").alias("forms"),
        F.sum(F.when(has_diacritic("word"), F.col("n")).otherwise(0)).alias("accented"),
        F.max("word").alias("word"),
    )
    body = ~F.col("header")
    return (
        by_low.groupBy("pkg")
        .agg(
            F.max(F.when(F.col("header"), F.col("word").cast("bigint"))).alias("declared"),
            F.coalesce(F.sum(F.when(body, F.col("n"))), F.lit(0)).alias("in_file"),
            F.coalesce(F.sum(F.when(body, F.col("accented"))), F.lit(0)).alias("accented"),
            F.coalesce(F.sum(F.when(body, F.col("n") - F.col("forms"))), F.lit(0)).alias("exact_duplicates"),
            F.coalesce(F.sum(F.when(body, F.col("n") - 1)), F.lit(0)).alias("case_pairs"),
        )
        .withColumn("passed", F.coalesce((F.col("declared") == F.col("in_file")) & (F.col("exact_duplicates") == 0), F.lit(False)))
    )


def package_inventory(lexicon: DataFrame) -> DataFrame:
    """Words per package and the grand total."""
    return (
        lexicon.select("pkg", "word")
        .distinct()
        .rollup("pkg")
        .agg(F.count("*").alias("lemmas"))
        .withColumn("pkg", F.coalesce("pkg", F.lit("total")))
    )


def probe_lexicon(lexicon: DataFrame, probes: DataFrame) -> DataFrame:
    """Whether each probe word is present and whether that was expected."""
    entries = lexicon.select("pkg", "word").distinct().withColumn("_hit", F.lit(True))
    return (
        probes.join(entries, ["pkg", "word"], "left")
        .withColumn("present", F.coalesce("_hit", F.lit(False)))
        .drop("_hit")
        .withColumn("passed", F.col("present") == F.col("expect"))
    )


def coverage(false_positives: DataFrame, lexicon: DataFrame, enough: float = 0.8) -> DataFrame:
    """Share of false positives that a package already has, and whether growing can stop."""
    found = probe_lexicon(lexicon, false_positives.withColumn("expect", F.lit(True)))
    return (
        found.groupBy("pkg")
        .agg(F.count("*").alias("sampled"), F.count_if("present").alias("covered"))
        .withColumn("share", F.col("covered") / F.col("sampled"))
        .withColumn("stop_growing", F.col("share") >= enough)
    )


def valid_bag(words: DataFrame, variant: str = "spanish", **bounds) -> DataFrame:
    """Words that pass the letter test of the package variant."""
    if variant == "loanword":
        return words.where(valid_word("word", **{"min_length": 2, "digits": True, **bounds}))
    return words.where(valid_word("word", **bounds))
