import unicodedata

import pytest
from pyspark.sql import functions as F

from orthoflow.functions import morphology as N
from orthoflow.functions import paths as P
from orthoflow.functions import text as T


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def one(spark, value, fn):
    return values(spark, [(value,)], "x string", fn(F.col("x")).alias("y"))[0][0]


def test_scrub_and_words(spark):
    text = "Contacto: Ana (ana.perez@correo.org.gt), mailto:x@y.org www.sitio.org/a?b y https://a.b/c fin"
    assert one(spark, text, lambda x: T.words(T.scrub_non_lexical(x))) == ["Contacto", "Ana", "y", "fin"]
    assert one(spark, "Ana O'Connor año-x è1 ça", T.words) == ["Ana", "O'Connor", "año", "x", "a"]
    assert one(spark, "ñwww.a.b", T.scrub_non_lexical) == "ñwww.a.b"


@pytest.mark.parametrize("word,folded", [("Casación ", "casacion"), ("AÑO", "ano"), ("pingüino", "pinguino"), ("á", "a")])
def test_fold(spark, word, folded):
    assert one(spark, word, T.fold) == folded


def test_names_and_ignored_words(spark):
    words = ["Perez", "O'Connor", "McDonald", "TSE", "ABCDEFGHIJKLM", "casacion", "B2", "3,5", "a@b", "X"]
    got = values(spark, [(w,) for w in words], "x string", "x", T.looks_like_proper_name("x"), T.should_ignore("x", False))
    names = {w for w, n, _ in got if n}
    ignored = {w for w, _, i in got if i}
    assert names == {"Perez", "O'Connor", "McDonald"}
    assert ignored == {"TSE", "ABCDEFGHIJKLM", "3,5", "a@b", "B2"}


def test_match_case(spark):
    got = values(spark, [("CASACION",), ("Casacion",), ("casacion",)], "x string", T.match_case("x", F.lit("casación")))
    assert [g[0] for g in got] == ["CASACIÓN", "Casación", "casación"]


def test_reasons_comments_and_nfc(spark):
    assert one(spark, " uno  dos tres cuatro cinco seis siete ", T.short_reason) == "uno dos tres cuatro cinco seis"
    assert one(spark, "w", lambda x: T.comment_text(x, F.array().cast("array<string>"))) == 'Error: "w".'
    text = "acción niño Ünico"
    assert one(spark, unicodedata.normalize("NFD", text), T.normalize_nfc) == text
    assert one(spark, "El año pasado", lambda x: T.contains_word(x, "AÑO"))
    assert not one(spark, "El año2 pasado", lambda x: T.contains_word(x, "año"))


def test_bad_endings_and_english(spark):
    words = ["elecciones", "eleccion", "metodologica", "analisis", "marketing", "accionable", "agenda"]
    got = values(spark, [(w,) for w in words], "x string", "x", T.bad_unaccented("x"), T.looks_english("x"))
    assert {w for w, b, _ in got if b} == {"eleccion", "metodologica", "analisis"}
    assert {w for w, _, e in got if e} == {"marketing", "agenda"}


def test_keys_and_urls(spark):
    r = one(spark, "documento_1_Foo.pptx", P.revision_keys)
    assert (r.correction_key, r.json_key) == ("rev_1_Foo.pptx", "rev_1_Foo_errores.json")
    r = one(spark, "/a/b.docx", P.revision_keys)
    assert (r.correction_key, r.json_key) == ("a/rev_b.docx", "a/rev_b_errores.json")
    with pytest.raises(Exception, match="source key is empty"):
        one(spark, " / ", P.revision_keys)
    assert tuple(one(spark, "s3://b/k/x", P.parse_object_url)) == ("b", "k/x")
    assert tuple(one(spark, "https://b.s3.us-east-1.amazonaws.com/k/x?y=1", P.parse_object_url)) == ("b", "k/x")
    assert tuple(one(spark, "https://s3.amazonaws.com/b/k", P.parse_object_url)) == ("b", "k")
    assert one(spark, "https://example.com/b/k", P.parse_object_url) is None
    assert one(spark, "s3://b/k", lambda x: P.object_uri_to_https(x, "r1")) == "https://b.s3.r1.amazonaws.com/k"
    assert one(spark, "Plan.Final.docx", P.corrected_name) == "Plan.Final_corregido.docx"


def test_plurals_and_forms(spark):
    assert one(spark, "raíz", N.clinical_plural) == "raíces"
    assert one(spark, "biopsia", N.clinical_plural) is None
    assert one(spark, "orden", N.general_plural) == "ordenes"
    assert one(spark, "orden", N.dental_plural) is None
    assert one(spark, "branch", N.loanword_plural) == "branches"
    forms = set(one(spark, "metodológico", N.gender_number_forms))
    assert forms == {"metodológico", "metodológica", "metodológicos", "metodológicas"}
    assert set(one(spark, "técnico", N.accented_forms)) == {"técnico", "técnica", "técnicos", "técnicas"}
    assert one(spark, "diálogo", N.accented_forms) == ["diálogo"]
