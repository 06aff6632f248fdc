"""Column functions that build word forms: plurals, gender and number, affixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from orthoflow import fixed_values as V
from orthoflow.functions.text import any_ending, has_diacritic, title_form


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _ends(word: Column, *endings: str) -> Column:
    return F.rlike(word, F.lit(any_ending(endings)))


def string_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _without(word: Column, letters: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - letters)


def clinical_plural(word: Column | str) -> Column:
    word = _col(word)
    low = F.lower(word)
    plural = (
        F.when(_ends(low, *V.CLINICAL_PLURAL_SKIP), None)
        .when(_ends(low, "z"), F.concat(_without(word, 1), F.lit("ces")))
        .when(_ends(low, "á", "é", "í", "ó", "ú"), F.concat(word, F.lit("es")))
        .when(_ends(low, "n", "l", "r", "d", "j", "y"), F.concat(word, F.lit("es")))
        .when(~_ends(low, "s"), F.concat(word, F.lit("s")))
    )
    return F.when(F.length(word).between(4, 28), plural)


def general_plural(word: Column | str, es_endings: Sequence[str] = ("al", "ar", "or", "en")) -> Column:
    word = _col(word)
    low = F.lower(word)
    plural = (
        F.when(_ends(low, "s", "x"), None)
        .when(_ends(low, "a", "e", "i", "o", "u"), F.concat(word, F.lit("s")))
        .when(_ends(low, *es_endings), F.concat(word, F.lit("es")))
    )
    return F.when(F.length(word).between(4, 35), plural)


def dental_plural(word: Column | str) -> Column:
    return general_plural(word, ("al", "ar", "or"))


def loanword_plural(word: Column | str) -> Column:
    word = _col(word)
    low = F.lower(word)
    plural = (
        F.when(_ends(low, "s", "x") | F.rlike(word, F.lit(r"\d")), None)
        .when(_ends(low, "a", "e", "i", "o", "u", "y"), F.concat(word, F.lit("s")))
        .when(_ends(low, "ch", "sh"), F.concat(word, F.lit("es")))
    )
    return F.when(F.length(word).between(4, 35), plural)


PLURALS = {
    "clinical": clinical_plural,
    "general": general_plural,
    "dental": dental_plural,
    "loanword": loanword_plural,
}


def gender_number_forms(
    word: Column | str,
    pairs: Sequence[tuple[str, str]] = V.GENDER_PAIRS,
    adverbs: bool = False,
    title_markers: Sequence[str] | None = None,
) -> Column:
    """The word, and masculine, feminine and plural forms for every ending pair it has.

    ``title_markers``: words in lower case that contain a marker also get a Title form; an
    empty list gives one to every such word.
    """
    word = _col(word)
    table = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(f).alias("f")) for m, f in pairs])
    fitting = F.filter(table, lambda p: F.endswith(word, p["m"]) | F.endswith(word, p["f"]))
    forms = F.flatten(
        F.transform(
            fitting,
            lambda p: F.transform(
                F.array(
                    p["m"], p["f"], F.concat(p["m"], F.lit("s")), F.concat(p["f"], F.lit("s"))
                ),
                lambda end: F.concat(F.substring(word, F.lit(1), F.length(word) - F.length(p["m"])), end),
            ),
        )
    )
    none = F.array().cast("array<string>")
    parts = [F.array(word), forms]
    if adverbs:
        parts.append(F.when(_ends(word, *V.ADVERB_ENDINGS), F.array(F.concat(word, F.lit("mente")))).otherwise(none))
    if title_markers is not None:
        marked = F.rlike(word, F.lit(r"^\p{Ll}"))
        if title_markers:
            marked = marked & contains_any(F.lower(word), title_markers)
        parts.append(F.when(marked, F.array(title_form(word))).otherwise(none))
    return F.array_distinct(F.concat(*parts))


def contains_any(word: Column | str, markers: Sequence[str]) -> Column:
    """The word contains one of the markers (literal text)."""
    quoted = ["".join("\\" + c if not c.isalnum() and c.isascii() else c for c in m) for m in markers]
    return F.rlike(_col(word), F.lit("|".join(quoted)))


def accented_forms(word: Column | str) -> Column:
    """An accented word and, for safe adjective endings, its gender and number forms that
    keep an accent; empty for words without an accent."""
    word = _col(word)
    stem = _without(word, 1)
    with_ending = lambda *ends: F.transform(string_array(ends), lambda e: F.concat(stem, e))
    none = F.array().cast("array<string>")
    forms = (
        F.when(~_ends(F.lower(word), *V.SAFE_ADJECTIVE_ENDINGS), none)
        .when(F.endswith(word, F.lit("o")), with_ending("a", "os", "as"))
        .when(F.endswith(word, F.lit("a")), with_ending("o", "os", "as"))
        .otherwise(none)
    )
    all_forms = F.filter(F.concat(F.array(word), forms), has_diacritic)
    return F.when(has_diacritic(word), all_forms).otherwise(none)
