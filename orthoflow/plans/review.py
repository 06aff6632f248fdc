"""Review of documents against a lexicon: words, documents, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthoflow import fixed_values as V
from orthoflow.functions.text import (
    fold,
    looks_like_proper_name,
    match_case,
    normalize_nfc,
    scrub_non_lexical,
    should_ignore,
    should_ignore_older,
    strip,
    words,
)
from orthoflow.operators.lookup import (
    best_candidates,
    classify,
    classify_two_languages,
    out_of_lexicon,
    prepare_lexicon,
    top_suggestions,
)
from orthoflow.operators.tokens import document_vocabulary
from orthoflow.session import cut, spread_lookup
from orthoflow.sources.snapshots import KeyedTable, Snapshot


ERROR_FIELDS = ["first_pos", "token", "kind", "suggestions", "reason"]


def judged_words(vocabulary: DataFrame) -> DataFrame:
    """Words that the review looks at: three letters or more, not capitals, numbers, addresses."""
    return vocabulary.where(
        (F.length("token") >= V.MIN_WORD_LENGTH) & ~should_ignore("token", proper_names=False)
    )


def check_words(unknown: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Kind and suggestions for distinct unknown words (``lang``, ``token``, other columns kept).

    Names in Title case are reported only for a missing or wrong accent.
    """
    if "fold" not in unknown.columns:
        unknown = unknown.withColumn("fold", fold("token"))
    folds = unknown.select("lang", "fold").distinct()
    near = best_candidates(folds, lexicon, V.MAX_SUGGESTIONS + 1)
    return classify(unknown, near).where((F.col("kind") == "tilde") | ~looks_like_proper_name("token"))


def _errors(vocabulary: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Errors of a vocabulary table (doc_id, lang, first_pos, key, token).

    Known words are removed next to the scan, so only unknown words are stored, shuffled
    and compared with the lexicon, and each distinct one only once.
    """
    lexicon = prepare_lexicon(lexicon)
    unknown = cut(out_of_lexicon(judged_words(vocabulary), lexicon), "unknown")
    distinct = cut(
        unknown.groupBy("lang", "token").agg(F.count("*").alias("documents")).withColumn("fold", fold("token")),
        "distinct",
    )
    verdicts = cut(check_words(distinct, lexicon), "verdicts")
    return spread_lookup(unknown, verdicts, ["lang", "token"], weight="documents", spread_by="doc_id")


def find_errors(documents: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Errors of every document: (doc_id, lang, first_pos, key, token, n, kind, suggestions).

    Words are taken once per document by lower-case form, with the casing that comes first.
    """
    return _errors(document_vocabulary(documents, ["doc_id", "lang"]), lexicon)


def find_errors_composed(documents: DataFrame, lexicon: DataFrame) -> DataFrame:
    """:func:`find_errors` of texts whose accented letters may stand as letter and mark: as in the composed text."""
    return find_errors(documents.withColumn("text", normalize_nfc("text")), lexicon)


def collect_corrections(documents: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Corrections of every document: each distinct casing of an error word is replaced by its
    first suggestion in the same casing; corrections that change nothing are dropped."""
    exact = F.array_distinct(words(scrub_non_lexical("text")))
    vocabulary = (
        documents.select("doc_id", "lang", F.posexplode_outer(exact).alias("first_pos", "token"))
        .where("token is not null")
        .withColumn("key", F.lower("token"))
    )
    return (
        _errors(vocabulary, lexicon)
        .withColumn("replacement", match_case("token", F.col("suggestions")[0]))
        .where("replacement <> token")
        .select("doc_id", F.col("token").alias("original"), "replacement")
    )


def check_words_two_languages(words_: DataFrame, lexicon: DataFrame, main: list[str], other: list[str]) -> DataFrame:
    """Distinct words that no locale of either language accepts, with merged suggestions.

    Suggestions of the main language come first; the distance test looks at them only.
    """
    judged = words_.where(~should_ignore_older("token"))
    groups = lexicon.where(F.col("lang").isin(*main, *other)).withColumn(
        "lang", F.when(F.col("lang").isin(*main), "main").otherwise("other")
    )
    groups = cut(groups.groupBy("lang", "word").agg(F.max("df").alias("df")), "lexicon")
    entries = cut(groups.groupBy("word").agg(F.max("df").alias("df")), "entries")
    unknown = cut(out_of_lexicon(judged, entries, []).withColumn("fold", fold("token")), "unknown")
    folds = unknown.select("fold").distinct()
    both = F.explode(F.array(F.lit("main"), F.lit("other")))
    near = best_candidates(folds.select(both.alias("lang"), "fold"), groups, V.MAX_SUGGESTIONS + 1)
    candidates = (
        unknown.select("token", "fold")
        .join(near.select("lang", "fold", F.explode("near").alias("c")), "fold")
        .select("token", "lang", F.col("c.dist").alias("dist"), F.col("c._place").alias("place"), F.col("c.suggestion").alias("suggestion"))
        .withColumn("accent_only", (F.col("dist") == 0) & (F.lower("token") != F.lower("suggestion")))
    )
    kinds = classify_two_languages(candidates, ["token"], "main").where("kind is not null")
    order = ["lang", F.desc("accent_only"), "place"]
    return kinds.join(top_suggestions(candidates, ["token"], order), "token")


def document_results(documents: DataFrame, errors: DataFrame, marking: bool = False) -> DataFrame:
    """One row per document with its ordered errors; blank documents are flagged.

    Errors that a second layer has confirmed carry its ``reason``.  Documents and errors are stacked and grouped once, instead of joined.
    """
    blank = F.length(strip("text")) == 0
    stacked = documents.select("doc_id", blank.alias("blank"), F.lit(None).alias("error")).unionByName(
        errors.select(
            "doc_id",
            F.lit(None).cast("boolean").alias("blank"),
            F.struct(*[c for c in ERROR_FIELDS if c in errors.columns]).alias("error"),
        )
    )
    blank_message = V.NO_CONTENT if marking else V.NO_TEXT
    return (
        stacked.groupBy("doc_id")
        .agg(
            F.coalesce(F.max("blank"), F.lit(False)).alias("blank"),
            F.sort_array(F.collect_list("error")).alias("errors"),
        )
        .select(
            "doc_id",
            (F.lit(True) if marking else ~F.col("blank")).alias("ok"),
            (F.size("errors") > 0).alias("has_errors"),
            F.size("errors").alias("total_errors"),
            F.when(F.col("blank"), blank_message).alias("message"),
            "errors",
        )
    )


def public_errors(results: DataFrame) -> DataFrame:
    """Errors as shown to users: without the kind, and with ``llm_motivo`` only where there is a reason."""
    with_reason = "reason" in results.schema["errors"].dataType.elementType.names
    reason = lambda e: F.nullif(e["reason"], F.lit("")) if with_reason else F.lit(None).cast("string")
    return results.withColumn(
        "errors",
        F.transform(
            "errors",
            lambda e: F.struct(
                e["token"].alias("palabra"), e["suggestions"].alias("sugerencias"), reason(e).alias("llm_motivo")
            ),
        ),
    )


def errors_report(
    results: DataFrame,
    details: DataFrame | None = None,
    files: DataFrame | None = None,
    second_layer: DataFrame | None = None,
    at: Column | None = None,
) -> DataFrame:
    """One JSON report per document.

    ``details`` (doc_id, details): what marking did, reported only where errors exist.  ``files`` (doc_id,
    archivo_original, documento_rev, reporte_errores): name of the source and keys of the outputs.
    ``second_layer``: the summary of its verdicts (doc_id, candidates, confirmed, discarded, fallback); with
    it the report says that there was one.  ``at``: the time of the report, else now.  Fields without value
    are left out.
    """
    for more in (details, files, second_layer):
        if more is not None:
            results = results.join(more, "doc_id", "left")
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()) if at is None else at
    field = lambda there, name: F.col(name) if there is not None else F.lit(None).cast("string")
    report = [
        F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("generado_en"),
        F.col("doc_id").alias("id"),
        field(files, "archivo_original").alias("archivo_original"),
        F.col("has_errors").alias("tiene_errores"),
        F.col("total_errors").alias("total_errores"),
        F.transform(
            "errors",
            lambda e: F.struct(
                e["token"].alias("palabra"), e["kind"].alias("tipo"), e["suggestions"].alias("sugerencias")
            ),
        ).alias("errores"),
        field(files, "documento_rev").alias("documento_rev"),
        field(files, "reporte_errores").alias("reporte_errores"),
        F.when(F.col("has_errors"), field(details, "details")).alias("marcacion_detalle"),
    ]
    if second_layer is not None:
        zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
        report += [
            F.lit(True).alias("capa_llm"),
            zero("candidates").alias("candidatos_libreoffice"),
            F.struct(
                zero("confirmed").alias("confirmados"),
                zero("discarded").alias("descartados"),
                F.coalesce("fallback", F.lit(False)).alias("fallback"),
            ).alias("llm"),
        ]
    return results.select("doc_id", F.to_json(F.struct(*report)).alias("report"))


def store_reports(reports: KeyedTable, new: DataFrame, mark: int | None = None) -> Snapshot | None:
    """Put reports (``key``, ``report`` and any other columns) in a stored table by ``key``, one per key.

    A report takes the place of the one its key had before; one that is the same as before writes nothing, so a
    second run adds no file.  Of several new reports of a key the greatest one is taken.
    """
    rest = [c for c in new.columns if c != "key"]
    one = new.groupBy("key").agg(F.max(F.struct(*rest)).alias("_r")).select("key", *[F.col(f"_r.`{c}`") for c in rest])
    return reports.upsert(cut(one, "reports"), mark)


def batch_summary(results: DataFrame, group: list[str]) -> DataFrame:
    """Documents, documents with errors, candidates and confirmed errors per group."""
    return results.groupBy(*group).agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("confirmed") > 0).alias("with_errors"),
        F.sum("candidates").alias("candidates"),
        F.sum("confirmed").alias("confirmed"),
    )


def top_marked_words(errors: DataFrame, by: list[str], k: int = 100) -> DataFrame:
    """The ``k`` words marked in most documents per group."""
    counts = errors.groupBy(*by, "key").agg(F.count("*").alias("documents"))
    order = Window.partitionBy(*by).orderBy(F.desc("documents"), "key")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def newest_decisions(decisions: DataFrame, scope: list[str] = []) -> DataFrame:
    """The last decision (``word``, ``decision`` add or deny, ``ts``) per word, by lower-case ``key``; of two at the same
    time deny counts."""
    by = [*scope, F.lower("word").alias("key")]
    return decisions.groupBy(*by).agg(F.max_by("decision", F.struct("ts", "decision")).alias("decision"))


def word_telemetry(errors: DataFrame, decisions: DataFrame, by: list[str], k: int = 100) -> DataFrame:
    """Most marked words with the human decision (add, deny) where there is one; the newest counts if ``ts`` says when."""
    if "ts" in decisions.columns:
        known = newest_decisions(decisions)
    else:
        known = decisions.select(F.lower("word").alias("key"), "decision").distinct()
    return top_marked_words(errors, by, k).join(known, "key", "left").withColumn("decision", F.coalesce("decision", F.lit("open")))
