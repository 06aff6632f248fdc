"""Marking and correcting text.

A text is cut in alternating pieces: words with at most one inner apostrophe part, and what
stands between.  Words that are an error in no document leave next to the scan, by a Bloom filter of the
distinct errors; the others meet the errors in an equi join on document and word, so the work grows with the
text and not with text times errors.  A text is rebuilt from its hits as slices between them: hits and texts
meet once, by document, and no piece of a text is shuffled.  Hits are whole pieces or whole
apostrophe parts, never parts of a longer word.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthoflow import fixed_values as V
from orthoflow.functions.text import comment_text, normalize_nfc
from orthoflow.operators.prefilter import key_filter
from orthoflow.operators.tokens import heads_of, passed, running_ends
from orthoflow.session import cut

IS_WORD = r"^[\p{L}\p{N}_]"
RUN_BLOCK = 8
# Pieces that are exploded together: what a word needs to be placed is a block.
BLOCK = 32


def pieces(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit(V.PIECE), F.lit(0))


def _parts(piece: Column) -> Column:
    """Sub-words of a piece with an apostrophe; empty for other pieces."""
    return F.when(
        F.contains(piece, F.lit("'")) & F.rlike(piece, F.lit(IS_WORD)), F.split(piece, "'")
    ).otherwise(F.array().cast("array<string>"))


def unit_keys(text: Column | str) -> Column:
    """Distinct lower-case words and apostrophe parts of a text."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(V.RUN), F.lit(0))
    return F.array_distinct(F.concat(runs, F.flatten(F.transform(runs, _parts))))


def documents_with_words(documents: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs of a document and a listed word (``key``, lower case) that its text contains."""
    listed = cut(words.select("key").distinct(), "listed")
    keys = documents.select("doc_id", F.explode_outer(unit_keys("text")).alias("key"))
    return key_filter(listed).keep(keys, "key").join(listed, "key", "left_semi")


def error_word_list(errors: DataFrame) -> DataFrame:
    """Distinct error words per document by lower-case form, the first form kept."""
    first = F.min(F.struct("first_pos", "token"))
    return errors.groupBy("doc_id", F.lower("token").alias("key")).agg(first.alias("f")).select(
        "doc_id", "key", F.col("f.token").alias("token"), F.col("f.first_pos").alias("first_pos")
    )


def _sub_words(piece: Column) -> Column:
    """The words that a piece can be hit as: (part, word), part 0 being the whole piece."""
    entry = lambda part, word: F.struct(F.lit(part).alias("part"), word.alias("word"))
    whole = entry(0, piece)
    halves = F.array(whole, entry(1, F.substring_index(piece, "'", 1)), entry(2, F.substring_index(piece, "'", -1)))
    return F.when(F.contains(piece, F.lit("'")), halves).otherwise(F.array(whole))


def _word_rows(documents: DataFrame, size, key=F.lower, listed: DataFrame | None = None) -> DataFrame:
    """Every word that can be hit and whose ``key`` may be one of the stored ``listed`` (None: any): ``doc_id``, ``at`` (where its piece
    begins), ``part``, ``word``, ``key`` and its ``start_at`` and ``end_at``, in the unit that ``size`` measures a text in.

    Pieces are dealt in blocks of ``BLOCK``, and only the ends of blocks are summed up for all of a text.  Where a word
    stands in its block is measured after the others have left.
    """
    cut_up = documents.select("doc_id", pieces("text").alias("piece"))
    last = F.floor((F.size("piece") - 1) / BLOCK).cast("int")
    dealt = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice("piece", b * BLOCK + 1, F.lit(BLOCK)))
    blocks = cut_up.select("doc_id", F.when(F.size("piece") > 0, dealt).alias("blocks"))
    ends = running_ends(F.transform("blocks", lambda b: size(F.array_join(b, ""))))
    rows = (
        blocks.select("doc_id", F.explode_outer(F.arrays_zip("blocks", ends.alias("end"))).alias("b"))
        .select("doc_id", F.col("b.end").alias("end"), F.col("b.blocks").alias("block"), F.posexplode_outer("b.blocks").alias("i", "piece"))
        .where(F.rlike("piece", F.lit(IS_WORD)))
        .select("doc_id", "end", "block", "i", "piece", F.explode(_sub_words(F.col("piece"))).alias("s"))
        .select("doc_id", "end", "block", "i", "piece", F.col("s.part").alias("part"), F.col("s.word").alias("word"), key(F.col("s.word")).alias("key"))
    )
    at = F.col("end") - size(F.array_join(F.slice("block", F.col("i") + 1, F.lit(BLOCK)), ""))
    met = (rows if listed is None else key_filter(listed).keep(rows, "key")).withColumn("at", at)
    before = F.when(F.col("part") == 2, size(F.substring_index("piece", "'", 1)) + 1).otherwise(0)
    placed = met.withColumn("start_at", F.col("at") + before)
    return placed.select(
        "doc_id", "at", "part", "word", "key", "start_at", (F.col("start_at") + size(F.col("word"))).alias("end_at")
    )


def mark_occurrences(documents: DataFrame, errors: DataFrame) -> DataFrame:
    """Every whole-word, case-insensitive hit of a document's errors: 0-based start and end."""
    listed = cut(errors.select("doc_id", "key").distinct(), "marked")
    spots = _word_rows(documents, F.length, listed=listed).select("doc_id", "key", "start_at", "end_at")
    return spots.join(listed, ["doc_id", "key"])


PAIRS = "|".join(unicodedata.normalize("NFD", letter) for letter in V.COMPOSED_LETTERS)


def composed_ends(text: Column | str) -> Column:
    """Where, in the composed text, letters end that stand as letter and mark in ``text``."""
    sizes = lambda gaps: F.transform(F.slice(gaps, F.lit(1), F.size(gaps) - 1), lambda g: F.length(g) + 1)
    return running_ends(F.transform(F.array(F.split(text, PAIRS, -1)), sizes)[0])


def mark_composed(documents: DataFrame, errors: DataFrame) -> DataFrame:
    """:func:`mark_occurrences` on composed text, in places of the text as it is.

    ``errors`` are those of the composed documents.  Each letter that the text has as letter and mark moves what
    comes after it by one.  ``blocked``: the span has another length than the composed word, so a place that is
    counted in one text must not be used in the other.

    The marks of a document meet these letters once, in its row, and each searches its place among them.
    """
    ends = documents.where(F.rlike("text", F.lit(PAIRS))).select("doc_id", composed_ends("text").alias("ends"))
    composed = documents.select("doc_id", normalize_nfc("text").alias("text"))
    marks = mark_occurrences(composed, errors)
    by_document = marks.groupBy("doc_id").agg(F.collect_list(F.struct("key", "start_at", "end_at")).alias("marks"))
    met = by_document.join(ends, "doc_id", "left").select("doc_id", "marks", "ends", heads_of("ends").alias("heads"))
    moved = lambda at: at + passed("ends", "heads", at)
    placed = F.transform("marks", lambda m: F.struct(
        m["key"].alias("key"), moved(m["start_at"]).alias("start_at"), moved(m["end_at"]).alias("end_at"),
        (m["end_at"] - m["start_at"]).alias("size"),
    ))
    rows = met.select("doc_id", F.inline_outer(placed)).where("key is not null")
    return rows.select("doc_id", "key", "start_at", "end_at", (F.col("end_at") - F.col("start_at") != F.col("size")).alias("blocked"))


def mark_counts(marks: DataFrame) -> DataFrame:
    return marks.groupBy("doc_id", "key").agg(F.count("*").alias("marks"))


def splice(text: Column | str, hits: Column | str) -> Column:
    """``text`` with each hit replaced by its ``new`` text, as slices between consecutive hits.

    ``hits`` are sorted by ``at``, ``part`` and have ``start_at`` and ``end_at`` in bytes.  A hit of a whole piece goes
    before those of its apostrophe parts.
    """
    text, hits = (F.col(c) if isinstance(c, str) else c for c in (text, hits))
    same = lambda h, i, back: F.coalesce(
        (F.get(hits, i - back)["at"] == h["at"]) & (F.get(hits, i - back)["part"] == 0), F.lit(False)
    )
    kept = F.filter(hits, lambda h, i: (h["part"] == 0) | ~(same(h, i, 1) | same(h, i, 2)))

    def rebuilt(bound: Column) -> Column:
        data, hits = bound["data"], bound["hits"]
        end = lambda i: F.coalesce(F.get(hits, i)["end_at"], F.lit(0))
        between = lambda i, h: F.substr(data, end(i - 1) + 1, h["start_at"] - end(i - 1)).cast("string")
        parts = F.transform(hits, lambda h, i: F.concat(between(i, h), h["new"]))
        tail = F.substr(data, end(F.size(hits) - 1) + 1).cast("string")
        return F.concat(F.array_join(parts, ""), tail)

    # bound to a variable, the text is encoded once and not for each hit
    bound = F.struct(F.encode(text, "UTF-8").alias("data"), kept.alias("hits"))
    return F.transform(F.array(bound), rebuilt)[0]


def _rebuilt(documents: DataFrame, table: DataFrame, key) -> DataFrame:
    """Texts with each listed word replaced, once: ``table`` has doc_id, key and the texts ``before``, ``replacement``
    (null: the word as it stands) and ``after``.  ``key`` maps a word to its key."""
    texts = documents.select("doc_id", "text")
    listed = cut(table, "listed")
    spots = _word_rows(texts, F.octet_length, key, listed)
    new = F.concat("before", F.coalesce("replacement", "word"), "after")
    hit = F.struct("at", "part", "start_at", "end_at", new.alias("new"))
    hits = spots.join(listed, ["doc_id", "key"]).groupBy("doc_id").agg(F.sort_array(F.collect_list(hit)).alias("hits"))
    met = texts.join(hits, "doc_id", "left")
    return met.select("doc_id", F.when(F.col("hits").isNull(), F.col("text")).otherwise(splice("text", "hits")).alias("text"))


def highlight_text(documents: DataFrame, errors: DataFrame, opening: str = "[[", closing: str = "]]") -> DataFrame:
    """Texts with every error word between delimiters; each hit is marked once."""
    table = errors.select("doc_id", "key").distinct().select(
        "*", F.lit(opening).alias("before"), F.lit(None).cast("string").alias("replacement"), F.lit(closing).alias("after")
    )
    return _rebuilt(documents, table, F.lower)


def apply_corrections(documents: DataFrame, corrections: DataFrame) -> DataFrame:
    """Case-sensitive whole-word replacement of each original word, once."""
    table = corrections.groupBy("doc_id", F.col("original").alias("key")).agg(F.max("replacement").alias("replacement"))
    return _rebuilt(documents, table.select("*", F.lit("").alias("before"), F.lit("").alias("after")), lambda w: w)


def correction_chains(corrections: DataFrame) -> DataFrame:
    """Corrections whose result is itself corrected (one pass and repeated passes differ there).

    Those whose result is corrected in no document, and those that no result leads to, leave next to the scan, so only
    the others are shuffled.  ``corrections`` is read several times, so it should be a stored table.
    """
    first = key_filter(corrections, "original").keep(corrections, "replacement")
    second = key_filter(corrections, "replacement").keep(corrections, "original")
    next_step = second.select("doc_id", F.col("original").alias("replacement"), F.col("replacement").alias("then"))
    return first.select("doc_id", "original", "replacement").join(next_step, ["doc_id", "replacement"])


def longest_first(corrections: DataFrame) -> DataFrame:
    return corrections.orderBy(F.desc(F.length("original")), "original")


def errors_per_unit(units: DataFrame, errors: DataFrame) -> DataFrame:
    """The errors of the document that occur in each unit: array ``found`` in document order."""
    rest = [c for c in units.columns if c != "text"]
    listed = cut(errors.select("doc_id", "first_pos", "key", "token", "suggestions"), "listed")
    keys = units.select(*rest, F.explode_outer(unit_keys("text")).alias("key"))
    met = key_filter(listed).keep(keys, "key").join(listed, ["doc_id", "key"])
    found = F.sort_array(F.collect_list(F.struct("first_pos", "key", "token", "suggestions")))
    return met.groupBy(*rest).agg(found.alias("found"))


def unit_comments(units: DataFrame, errors: DataFrame) -> DataFrame:
    """One note per unit that lists its errors, one per line."""
    note = F.array_join(F.transform("found", lambda e: comment_text(e["token"], e["suggestions"])), "\n")
    return errors_per_unit(units, errors).select(
        *[c for c in units.columns if c != "text"], F.size("found").alias("errors"), note.alias("comment")
    )


def unit_highlight_words(units: DataFrame, errors: DataFrame, extend: bool = True) -> DataFrame:
    """Words to mark per unit, in error order.

    An error that is a word of the unit gives that word (last casing).  Otherwise, if
    ``extend`` and the error has four letters or more, the unit's only longer word that starts
    with it is taken, unless another error used it before.
    """
    letters = F.regexp_extract_all("text", F.lit("[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+"), F.lit(0))
    last = lambda key: F.element_at("words", F.array_position("lows", key).cast("int"))

    def step(acc: Column, key: Column) -> Column:
        longer = F.filter(
            "word_keys",
            lambda w: F.startswith(w, key) & (F.length(w) > F.length(key)) & ~F.array_contains(acc["used"], w),
        )
        extended = F.when(
            F.lit(extend) & (F.length(key) >= V.PREFIX_LENGTH) & (F.size(longer) == 1), longer[0]
        )
        used = F.when(F.array_contains("word_keys", key), key).otherwise(extended)
        taken = F.when(F.array_contains(acc["used"], key), F.lit(None)).otherwise(used)
        return F.when(
            taken.isNotNull(),
            F.struct(
                F.concat(acc["used"], F.array(taken)).alias("used"),
                F.concat(acc["out"], F.array(last(taken))).alias("out"),
            ),
        ).otherwise(acc)

    none = F.array().cast("array<string>")
    chosen = F.aggregate(
        "keys", F.struct(none.alias("used"), none.alias("out")), step, lambda acc: acc["out"]
    )
    rest = [c for c in units.columns if c != "text"]
    starts = F.flatten(
        F.transform(
            F.filter("word_keys", lambda w: F.length(w) > V.PREFIX_LENGTH),
            lambda w: F.transform(
                F.sequence(F.lit(V.PREFIX_LENGTH), F.length(w) - 1), lambda i: F.substring(w, F.lit(1), i)
            ),
        )
    )
    read = units.withColumn("words", F.reverse(letters)).withColumn("lows", F.transform("words", lambda w: F.lower(w)))
    read = read.withColumn("word_keys", F.array_distinct("lows"))
    # errors that are no word of the unit and no beginning of one cannot give anything
    listed = cut(errors.select("doc_id", "first_pos", "key"), "listed")
    asked = read.select(*rest, F.explode(F.array_distinct(F.concat("word_keys", starts))).alias("key"))
    met = key_filter(listed).keep(asked, "key").join(listed, ["doc_id", "key"])
    ordered = F.sort_array(F.collect_list(F.struct("first_pos", "key")))
    listed = met.groupBy(*rest).agg(F.transform(ordered, lambda e: e["key"]).alias("keys"))
    return read.join(listed, rest).select(*rest, chosen.alias("highlight")).where(F.size("highlight") > 0)


def runs_of_error(spans: DataFrame, runs: DataFrame, max_runs: int = V.SPLIT_RUNS) -> DataFrame:
    """Runs that a word span of a paragraph touches.

    ``spans``: doc_id, para_ix, start_at, end_at (0-based, end exclusive).  A run that the
    span covers is ``whole``; a run that contains the span is ``inside`` and is cut in
    before, middle and after; a run that the span only crosses is ``crossed`` and stays as
    it is.  Words split over more than ``max_runs`` runs are ``left_alone``.

    Runs and spans are dealt by paragraph once, in which a paragraph is one row; no run is shuffled for a second step.
    Runs stand in blocks of ``RUN_BLOCK``: a span searches its blocks, and only their runs are measured for it.
    """
    keys = ["doc_id", "para_ix"]
    rest = [c for c in spans.columns if c not in keys]
    same = Window.partitionBy(*keys, "start_at", "end_at")
    dealt = spans.where("start_at is not null and end_at is not null").repartition(*keys)
    asked = dealt.withColumn("_copies", F.count(F.lit(1)).over(same)).groupBy(*keys).agg(
        F.collect_list(F.struct(*rest, "_copies")).alias("_spans")
    )
    placed = runs.where(F.length("text") > 0).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("run_ix", "text"))).alias("_runs")
    )
    met = asked.join(placed, keys)
    last = F.floor((F.size("_runs") - 1) / RUN_BLOCK).cast("int")
    texts = lambda runs: F.array_join(runs["text"], "")
    sizes = F.transform(
        F.sequence(F.lit(0), last), lambda b: F.length(texts(F.slice("_runs", b * RUN_BLOCK + 1, F.lit(RUN_BLOCK))))
    )
    ended = met.select(*keys, "_spans", "_runs", running_ends(sizes).alias("_ends"))
    ended = ended.select("*", heads_of("_ends").alias("_heads"))
    first = lambda s: passed("_ends", "_heads", s["start_at"])
    beyond = lambda s: F.least(passed("_ends", "_heads", s["end_at"] - 1) + 1, F.size("_ends"))
    near = F.transform("_spans", lambda s: F.struct(s.alias("span"), first(s).alias("first"), beyond(s).alias("beyond")))
    each = ended.select(*keys, "_runs", "_ends", F.explode_outer(near).alias("_s")).select(
        *keys, F.col("_s.span").alias("_span"), F.coalesce(F.get("_ends", F.col("_s.first") - 1), F.lit(0)).alias("_base"),
        F.slice(
            "_runs", F.col("_s.first") * RUN_BLOCK + 1,
            F.greatest(F.col("_s.beyond") - F.col("_s.first"), F.lit(0)) * RUN_BLOCK,
        ).alias("_near"),
    )
    start, end = F.col("_span.start_at"), F.col("_span.end_at")
    measured = F.transform(
        "_near",
        lambda r, i: F.struct(
            r["run_ix"].alias("run_ix"), r["text"].alias("text"),
            (F.col("_base") + F.length(texts(F.slice("_near", F.lit(1), i)))).alias("run_start"),
        ),
    )
    touches = lambda r: (start < r["run_start"] + F.length(r["text"])) & (end > r["run_start"])
    touched = each.select(*keys, "_span", F.filter(measured, touches).alias("_touched")).select(
        *keys, "_span", (F.size("_touched") * F.col("_span._copies")).alias("runs"), F.explode_outer("_touched").alias("_run")
    ).where("_run is not null")
    touched = touched.select(
        *[F.col(c) if c in keys else F.col(f"_span.`{c}`").alias(c) for c in spans.columns], "runs", "_run.run_ix", "_run.text",
        "_run.run_start", (F.col("_run.run_start") + F.length("_run.text")).alias("run_end"),
    )
    local_start = F.greatest(F.col("start_at") - F.col("run_start"), F.lit(0))
    local_end = F.least(F.col("end_at"), F.col("run_end")) - F.col("run_start")
    cover = (
        F.when(F.col("runs") > max_runs, "left_alone")
        .when((F.col("start_at") <= F.col("run_start")) & (F.col("end_at") >= F.col("run_end")), "whole")
        .when((F.col("start_at") >= F.col("run_start")) & (F.col("end_at") <= F.col("run_end")), "inside")
        .otherwise("crossed")
    )
    return touched.select(
        *spans.columns,
        "run_ix",
        "runs",
        cover.alias("cover"),
        F.substring("text", F.lit(1), local_start).alias("before"),
        F.substring("text", local_start + 1, local_end - local_start).alias("middle"),
        F.substring("text", local_end + 1, F.length("text")).alias("after"),
    )


def merge_mark_stats(stats: DataFrame) -> DataFrame:
    """Counters summed, first non-empty strategy, failures joined, per document."""
    strategy = F.nullif(F.col("strategy"), F.lit(""))
    failures = F.sort_array(F.collect_list(F.struct("part_ix", "failures")))
    return stats.groupBy("doc_id").agg(
        F.sum("highlighted").alias("highlighted"),
        F.sum("comments").alias("comments"),
        F.sum("failed_comments").alias("failed_comments"),
        F.coalesce(
            F.min(F.when(strategy.isNotNull(), F.struct("part_ix", "strategy")))["strategy"], F.lit("")
        ).alias("strategy"),
        F.flatten(F.transform(failures, lambda f: f["failures"])).alias("failures"),
    )
