"""Column functions on text and words.  All stay inside the JVM, none is a UDF."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from orthoflow import fixed_values as V


def _fold_alphabet() -> tuple[str, str]:
    """Accented Latin letters and their base letters, then the marks to delete."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code))
        base = "".join(c for c in parts if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != chr(code) and chr(code) == chr(code).lower():
            source.append(chr(code))
            target.append(base)
    marks = [chr(code) for code in range(0x300, 0x370)]
    return "".join(source + marks), "".join(target)


_FOLD_FROM, _FOLD_TO = _fold_alphabet()


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# What counts as white space at the ends of a text.
WHITE_SPACE = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column | str) -> Column:
    """Trim every kind of white space at both ends."""
    return F.btrim(_col(text), F.lit(WHITE_SPACE))


def any_ending(endings: Sequence[str]) -> str:
    """One alternation that matches any of the endings."""
    return "(" + "|".join(endings) + ")$"


def scrub_non_lexical(text: Column | str) -> Column:
    """Replace mailto links, e-mail addresses and URLs by a space.

    Texts without ``:`` or ``@`` skip the patterns that need these signs.
    """
    text = _col(text)
    no_links = F.when(F.contains(text, F.lit(":")), F.regexp_replace(text, V.MAILTO, " ")).otherwise(text)
    no_mail = F.when(F.contains(text, F.lit("@")), F.regexp_replace(no_links, V.EMAIL, " ")).otherwise(no_links)
    return F.regexp_replace(no_mail, V.URL, " ")


def words(text: Column | str) -> Column:
    """Array of the words of a text, in order."""
    return F.regexp_extract_all(text, F.lit(V.WORD), F.lit(0))


def fold(text: Column | str) -> Column:
    """Lower case, trimmed, without accents (``ñ`` becomes ``n``)."""
    return F.translate(F.lower(strip(text)), _FOLD_FROM, _FOLD_TO)


def has_diacritic(word: Column | str) -> Column:
    return F.rlike(_col(word), F.lit(V.DIACRITIC))


def edit_distance(a: Column | str, b: Column | str, limit: int | None = None) -> Column:
    """Levenshtein distance with unit costs; -1 above ``limit``."""
    return F.levenshtein(a, b) if limit is None else F.levenshtein(a, b, limit)


def is_accent_only(word: Column | str, suggestion: Column | str) -> Column:
    word, suggestion = _col(word), _col(suggestion)
    return (fold(word) == fold(suggestion)) & (F.lower(word) != F.lower(suggestion))


def is_title(word: Column | str) -> Column:
    return F.rlike(_col(word), F.lit(V.TITLE_WORD))


def is_upper(word: Column | str) -> Column:
    return F.rlike(_col(word), F.lit(V.UPPER_WORD))


def looks_like_proper_name(word: Column | str) -> Column:
    word = _col(word)
    mixed = (F.length(word) >= 4) & F.rlike(word, F.lit(V.MIXED_NAME))
    return (F.length(word) >= 2) & (
        is_title(word) | F.rlike(word, F.lit(V.APOSTROPHE_NAME)) | mixed
    )


def should_ignore(
    word: Column | str, proper_names: bool = True, max_upper: int = V.MAX_UPPER, min_upper: int = 2
) -> Column:
    """Words that are never judged: capitals, numbers, addresses, and (optionally) names."""
    word = _col(word)
    ignored = (
        (F.length(word) == 0)
        | (is_upper(word) & F.length(word).between(min_upper, max_upper))
        | F.rlike(word, F.lit(V.NUMBER_WORD))
        | F.rlike(F.lower(word), F.lit(V.ADDRESS_WORD))
        | F.rlike(word, F.lit(V.ACRONYM))
    )
    return ignored | looks_like_proper_name(word) if proper_names else ignored


def should_ignore_older(word: Column | str) -> Column:
    """Older rule: capitals up to 8 letters, no proper-name rule."""
    return should_ignore(word, proper_names=False, max_upper=V.MAX_UPPER_OLDER, min_upper=1)


def title_form(word: Column | str) -> Column:
    """First letter upper case, the rest as it is."""
    word = _col(word)
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word)))


def match_case(reference: Column | str, suggestion: Column | str) -> Column:
    reference, suggestion = _col(reference), _col(suggestion)
    return (
        F.when(is_upper(reference), F.upper(suggestion))
        .when(is_title(reference), title_form(suggestion))
        .otherwise(suggestion)
    )


def comment_text(word: Column | str, suggestions: Column | str) -> Column:
    """Note for one error with at most five suggestions."""
    suggestions = _col(suggestions)
    head = F.concat(F.lit('Error: "'), F.coalesce(_col(word), F.lit("")), F.lit('".'))
    listed = F.array_join(F.slice(suggestions, 1, V.MAX_SUGGESTIONS), ", ")
    return F.when(F.size(suggestions) > 0, F.concat(head, F.lit(" Sugerencias: "), listed)).otherwise(head)


def short_reason(text: Column | str) -> Column:
    """Whitespace collapsed, first six words, first 48 characters."""
    flat = F.trim(F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"(?U)\s+", " "))
    return F.substring(F.array_join(F.slice(F.split(flat, " "), 1, V.REASON_WORDS), " "), 1, V.REASON_CHARS)


def contains_word(text: Column | str, word: str) -> Column:
    """Whole-word, case-insensitive test for a literal word."""
    quoted = "".join("\\" + c if not c.isalnum() and c.isascii() else c for c in word)
    return F.rlike(_col(text), F.lit(rf"(?iU)\b{quoted}\b"))


def valid_word(
    word: Column | str,
    min_length: int = 3,
    max_length: int = 45,
    digits: bool = False,
    hyphen: bool = False,
    bad_starts: Sequence[str] = (),
) -> Column:
    """Lexicon word test: length bounds and letter class."""
    word = strip(word)
    pattern = V.LEXICON_WORD_DIGITS if digits else V.LEXICON_WORD_HYPHEN if hyphen else V.LEXICON_WORD
    ok = F.length(word).between(min_length, max_length) & F.rlike(word, F.lit(pattern))
    if bad_starts:
        ok = ok & ~F.rlike(F.lower(word), F.lit("^(" + "|".join(bad_starts) + ")"))
    return ok


def valid_loanword(word: Column | str, min_length: int = 2, max_length: int = 45) -> Column:
    """Loanword test: ASCII letters and digits, hyphens after the first sign."""
    word = strip(word)
    return F.length(word).between(min_length, max_length) & F.rlike(word, F.lit(V.LOANWORD))


def looks_english(
    word: Column | str,
    listed: Sequence[str] = V.ENGLISH_WORDS,
    endings: Sequence[str] = V.ENGLISH_ENDINGS,
) -> Column:
    low = F.lower(_col(word))
    return low.isin(*listed) | F.rlike(low, F.lit(any_ending(endings)))


def bad_unaccented(
    word: Column | str,
    exact: Sequence[str] = V.BAD_EXACT,
    endings: Sequence[str] = V.BAD_ENDINGS,
) -> Column:
    """No accent although the exact word or its ending needs one."""
    word = _col(word)
    low = F.lower(word)
    hit = F.rlike(low, F.lit(any_ending(endings)))
    if exact:
        hit = low.isin(*exact) | hit
    return ~has_diacritic(word) & hit


def normalize_nfc(text: Column | str) -> Column:
    """Compose the Spanish letters that are written as base letter plus mark."""
    text = _col(text)
    composed = text
    for letter in V.COMPOSED_LETTERS:
        composed = F.replace(composed, F.lit(unicodedata.normalize("NFD", letter)), F.lit(letter))
    return F.when(F.rlike(text, F.lit("[\u0301\u0303\u0308]")), composed).otherwise(text)
