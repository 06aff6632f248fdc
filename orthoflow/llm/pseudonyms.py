"""Personal data: format-preserving pseudonyms of validated values by keyed Feistel permutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthoflow.llm.common import fresh

ROUNDS = 8
KEY_SETTING = "orthoflow.pseudonyms.key"
KEY = "change-me"
# What is looked for.  Each form begins where no longer token of its signs goes on.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,6}\.[A-Za-z]{2,24}(?![A-Za-z0-9-])"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\d|\.\d)"
ISO_DATE = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])"
SLASH_DATE = r"(?<![\d/])\d{2}/\d{2}/\d{4}(?![\d/])"
DOT_DATE = r"(?<![\d.])\d{2}\.\d{2}\.\d{4}(?!\d|\.\d)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
SOCIAL = r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])"
PHONE = (
    r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)"
    r"|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)"
    r"|(?<![\w+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
)
CARD = r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])"
FORMS = [
    ("email", EMAIL), ("ip", IP), ("iso_date", ISO_DATE), ("slash_date", SLASH_DATE), ("dot_date", DOT_DATE),
    ("iban", IBAN), ("social", SOCIAL), ("phone", PHONE), ("card", CARD),
]
ANY_FORM = "|".join(f"(?:{p})" for _, p in FORMS)
DATE_FORMATS = {"iso_date": "yyyy-MM-dd", "slash_date": "MM/dd/yyyy", "dot_date": "dd.MM.yyyy"}
FIRST_DAY, DAYS, DAY_PARTS = -62091, 146097, (189, 773)
AREAS, GROUPS, SERIALS, NO_AREA = 898, 99, 9_999, 666


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _stream(key: str, kind: str, i: Column, half: Column) -> Column:
    """256 keyed hexadecimal digits that depend on the round and on one half of the value."""
    seed = F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), half)
    return F.concat(F.sha2(F.concat(seed, F.lit("|0")), 512), F.sha2(F.concat(seed, F.lit("|1")), 512))


def _number(stream: Column, at: Column | int, digits: int) -> Column:
    position = at if isinstance(at, Column) else F.lit(at)
    return F.conv(F.substr(stream, position, F.lit(digits)), 16, 10).cast("long")


def permute_text(value: Column, key: str, kind: str) -> Column:
    """A keyed permutation of all texts of one format: digits stay digits, letters stay letters of their
    case, and every other sign stays.  Halves take turns: the signs of one are moved on within their
    alphabet by a stream that the key and the other half give."""
    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), half).alias("a"), F.substr(value, half + 1).alias("b"))

    def moved(sign: Column, step: Column) -> Column:
        code = F.ascii(sign)
        turn = lambda first, size: F.char(F.lit(first) + (code - first + step) % size)
        return (
            F.when(sign.rlike("^[0-9]$"), turn(48, 10))
            .when(sign.rlike("^[a-z]$"), turn(97, 26))
            .when(sign.rlike("^[A-Z]$"), turn(65, 26))
            .otherwise(sign)
        )

    def one_round(acc: Column, i: Column) -> Column:
        turned = _let(
            _stream(key, kind, i, acc["b"]),
            lambda s: F.array_join(
                F.transform(F.split(acc["a"], ""), lambda c, j: moved(c, _number(s, j % 128 * 2 + 1, 2))), ""
            ),
        )
        return F.struct(acc["b"].alias("a"), turned.alias("b"))

    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, start, one_round, lambda acc: F.concat(acc["a"], acc["b"]))


def permute_number(value: Column, parts: tuple[int, int], key: str, kind: str) -> Column:
    """A keyed permutation of 0..parts[0]*parts[1]-1, by a Feistel network on quotient and remainder."""
    m, n = parts
    start = F.struct(F.floor(value / n).cast("long").alias("a"), (value % n).cast("long").alias("b"))

    def one_round(acc: Column, i: Column) -> Column:
        a = (acc["a"] + _number(_stream(key, kind, i, acc["b"].cast("string")), 1, 12)) % m
        b = _let(a, lambda x: (acc["b"] + _number(_stream(key, kind, i + 100, x.cast("string")), 1, 12)) % n)
        return F.struct(a.alias("a"), b.alias("b"))

    rounds = F.sequence(F.lit(0), F.lit(ROUNDS // 2 - 1))
    return F.aggregate(rounds, start, one_round, lambda acc: acc["a"] * n + acc["b"])


def luhn_sum(digits: Column, doubled_from_end: int) -> Column:
    """Luhn sum; every second digit counts double, from the last (0) or the last but one (1) on."""
    marks = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.struct(c.try_cast("int").alias("d"), i.alias("i")))

    def weight(x: Column) -> Column:
        return F.when(x["i"] % 2 == doubled_from_end, F.when(x["d"] > 4, x["d"] * 2 - 9).otherwise(x["d"] * 2)).otherwise(x["d"])

    return F.aggregate(marks, F.lit(0), lambda s, x: s + F.coalesce(weight(x), F.lit(0)))


def iban_remainder(iban: Column) -> Column:
    """The value of an IBAN modulo 97, its first four signs moved to the end and letters read as 10..35."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def add(acc: Column, c: Column) -> Column:
        letter = c.rlike("^[A-Z]$")
        return F.when(letter, (acc * 100 + F.ascii(c) - 55) % 97).otherwise((acc * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), add)


def _social(value: Column, key: str) -> Column:
    """A permutation of all valid numbers: areas 001-899 but 666, groups 01-99, serials 0001-9999."""
    part = lambda at, n: F.substr(value, F.lit(at), F.lit(n)).try_cast("long")
    area = part(1, 3) - F.when(part(1, 3) > NO_AREA, 2).otherwise(1)
    number = (area * GROUPS + part(5, 2) - 1) * SERIALS + part(8, 4) - 1

    def written(x: Column) -> Column:
        area = F.floor(x / (GROUPS * SERIALS)).cast("long") + 1
        area = area + F.when(area >= NO_AREA, 1).otherwise(0)
        group, serial = F.floor(x / SERIALS).cast("long") % GROUPS + 1, x % SERIALS + 1
        return F.concat_ws("-", *[F.lpad(v.cast("string"), n, "0") for v, n in ((area, 3), (group, 2), (serial, 4))])

    return _let(permute_number(number, (AREAS * GROUPS, SERIALS), key, "social"), written)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _ip(value: Column, key: str) -> Column:
    number = F.aggregate(F.split(value, r"\."), F.lit(0).cast("long"), lambda s, o: s * 256 + o.try_cast("long"))
    octet = lambda x, i: F.shiftright(x, 8 * i).bitwiseAND(F.lit(255)).cast("string")
    return _let(
        permute_number(number, (65536, 65536), key, "ip"), lambda x: F.concat_ws(".", *[octet(x, i) for i in (3, 2, 1, 0)])
    )


def _date(value: Column, kind: str, key: str) -> Column:
    day = F.unix_date(F.to_date(F.try_to_timestamp(value, F.lit(DATE_FORMATS[kind])))) - FIRST_DAY
    moved = F.date_from_unix_date((permute_number(day, DAY_PARTS, key, "date") + FIRST_DAY).cast("int"))
    return F.when((day >= 0) & (day < DAYS), F.date_format(moved, DATE_FORMATS[kind]))


def _card(value: Column, key: str) -> Column:
    body = permute_text(F.substr(value, F.lit(1), F.length(value) - 1), key, "card")
    checked = _let(body, lambda b: F.concat(b, ((10 - luhn_sum(_digits(b), 0) % 10) % 10).cast("string")))
    return F.when(luhn_sum(_digits(value), 1) % 10 == 0, checked)


def _iban(value: Column, key: str) -> Column:
    country = F.substr(value, F.lit(1), F.lit(2))
    body = permute_text(F.substr(value, F.lit(5)), key, "iban")
    check = lambda b: F.lpad((98 - iban_remainder(F.concat(country, F.lit("00"), b))).cast("string"), 2, "0")
    return F.when(iban_remainder(value) == 1, _let(body, lambda b: F.concat(country, check(b), b)))


def kind_of(value: Column) -> Column:
    """The first form of ``FORMS`` that the whole value has."""
    found = F.lit(None).cast("string")
    for kind, pattern in reversed(FORMS):
        found = F.when(value.rlike(f"^(?:{pattern})$"), kind).otherwise(found)
    return found


def pseudonym(kind: Column, value: Column, key: str = KEY) -> Column:
    """Pseudonym of a value; null where it is not valid (an impossible date, a wrong check digit)."""
    email_name = F.regexp_replace(value, r"\.[A-Za-z]+$", "")
    country = F.regexp_extract(value, r"^\+\d{1,3}(?=[ .(-])", 0)
    by_kind = {
        "email": F.concat(permute_text(email_name, key, "email"), F.regexp_extract(value, r"\.[A-Za-z]+$", 0)),
        "ip": _ip(value, key),
        "iban": _iban(value, key),
        "social": _social(value, key),
        "phone": F.concat(country, permute_text(F.substr(value, F.length(country) + 1), key, "phone")),
        "card": _card(value, key),
        **{k: _date(value, k, key) for k in DATE_FORMATS},
    }
    out = F.lit(None).cast("string")
    for name, expression in by_kind.items():
        out = F.when(kind == name, expression).otherwise(out)
    return out


def _part(kind: Column, value: Column, new: Column) -> Column:
    """What stands in the text for a match, and its kind if it was valid."""
    return F.struct(F.when(new.isNotNull(), kind).alias("kind"), F.coalesce(new, value).alias("pseudonym"))


def pseudonymize(
    docs: DataFrame, key: str = KEY, text_col: str = "text", found_col: str = "pseudonyms"
) -> DataFrame:
    """``docs`` with every personal value of the text replaced, and a list of kind and pseudonym.

    Values are e-mail and IP addresses, dates, IBANs, social security, phone and card numbers.  They are
    validated (octets, calendar, check digits) and permuted within their format by a Feistel network
    under ``key``: the same value has the same pseudonym in all documents, different values have
    different ones, and whoever has the key can go back.  Card numbers and IBANs get valid check digits
    again, and a social security number becomes another valid one; numbers with wrong check digits and impossible dates are no personal values and stay.

    All is done in the row, by column expressions: nothing is shuffled, and texts without digit or ``@``
    are not searched.  Null text stays null and has no values; texts are read whole.  Repeated rows are
    treated alike.  Other columns are kept; a column called ``found_col`` is replaced.  An empty table
    gives an empty result.
    """
    value_col, parts_col = fresh([*docs.columns, found_col], "values", "parts")
    text = F.col(text_col)
    none = F.array().cast("array<string>")
    searched = docs.withColumn(
        value_col, F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY_FORM), F.lit(0))).otherwise(none)
    )
    replaced = searched.withColumn(
        parts_col,
        F.transform(
            F.coalesce(F.col(value_col), none),
            lambda v: _let(kind_of(v), lambda k: _let(pseudonym(k, v, key), lambda p: _part(k, v, p))),
        ),
    )
    between = F.split(text, ANY_FORM, -1)
    joined = F.array_join(
        F.zip_with(between, F.col(parts_col), lambda b, p: F.concat(b, F.coalesce(p["pseudonym"], F.lit("")))), ""
    )
    out = replaced.withColumn(text_col, F.when(F.size(parts_col) > 0, joined).otherwise(text))
    found = F.filter(F.col(parts_col), lambda p: p["kind"].isNotNull())
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c != found_col], found.alias(found_col))
