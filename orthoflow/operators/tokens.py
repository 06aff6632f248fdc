"""Words of documents: tokens, first occurrences and offsets.

A document is one row, so everything that looks at one document only is done inside the
row with array functions.  No token table is shuffled to find first occurrences.

Arrays are unnested with the outer variants plus a null test: the inner ones let the
optimizer derive a "size > 0" filter that evaluates the whole array expression again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthoflow import fixed_values as V
from orthoflow.functions.text import scrub_non_lexical, words


def tokens(documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per word: ``pos`` counts words from 0, ``key`` is the lower-case word."""
    keep = keep if keep is not None else [c for c in documents.columns if c != "text"]
    return documents.select(
        *keep, F.posexplode_outer(words(scrub_non_lexical("text"))).alias("pos", "token")
    ).where("token is not null").withColumn("key", F.lower("token"))


def document_vocabulary(documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per document and key, with casing and place of the first occurrence.

    Words are sorted by (key, pos) inside the row; a word whose key differs from its left
    neighbour is a first occurrence, and the distance to the next one is the count.
    """
    keep = keep if keep is not None else [c for c in documents.columns if c != "text"]
    ordered = documents.select(*keep, words(scrub_non_lexical("text")).alias("w")).select(
        *keep,
        F.sort_array(
            F.transform(
                "w", lambda w, i: F.struct(F.lower(w).alias("key"), i.alias("pos"), w.alias("token"))
            )
        ).alias("w"),
    )
    with_left = ordered.select(
        *keep,
        F.size("w").alias("total"),
        F.filter(
            F.transform(
                F.arrays_zip(
                    F.col("w").alias("w"),
                    F.concat(
                        F.array(F.lit(None).cast("string")),
                        F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), lambda x: x["key"]),
                    ).alias("left"),
                ),
                lambda z, i: F.struct(
                    z["w"]["key"].alias("key"),
                    z["w"]["pos"].alias("pos"),
                    z["w"]["token"].alias("token"),
                    i.alias("at"),
                    z["left"].alias("left"),
                ),
            ),
            lambda x: x["key"].isNotNull() & (x["left"].isNull() | (x["left"] != x["key"])),
        ).alias("firsts"),
    )
    counted = with_left.select(
        *keep,
        F.arrays_zip(
            F.col("firsts").alias("first"),
            F.concat(
                F.transform(F.slice("firsts", F.lit(2), F.size("firsts")), lambda x: x["at"]), F.array("total")
            ).alias("next_at"),
        ).alias("v"),
    )
    return counted.select(*keep, F.explode_outer("v").alias("v")).where("v.first is not null").select(
        *keep,
        F.col("v.first.key").alias("key"),
        F.col("v.first.token").alias("token"),
        F.col("v.first.pos").alias("first_pos"),
        (F.col("v.next_at") - F.col("v.first.at")).alias("n"),
    )


def first_occurrence_dedupe(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Keep the first row per key, by an aggregation with partial results on the map side.

    ``order``: column names, compared from left to right.  Null keys are a key of their own.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*rest).alias("row")))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, *[F.col(f"_best.row.`{c}`") for c in rest]).select(df.columns)


def block_of(size: Column) -> Column:
    """Length of the blocks of an array for which both growing them and growing their list copies least."""
    return F.ceil(F.cbrt(2 * size)).cast("int")


def running_ends(sizes: Column | str) -> Column:
    """Running sums of an array of numbers, in the row.

    The array is summed in blocks (:func:`block_of`): appending to an array copies it, so only short ones
    are grown.  ``sizes`` is bound to a variable first: written out in the lambda of the blocks, an expression would be
    evaluated anew for each of them.
    """
    sizes = F.col(sizes) if isinstance(sizes, str) else sizes
    with_block = lambda s: F.struct(s.alias("all"), block_of(F.size(s)).alias("block"))
    return F.transform(F.transform(F.array(sizes), with_block), _ends_of)[0]


def passed(ends: Column | str, heads: Column | str, at: Column) -> Column:
    """How many of the ascending ``ends``, whose :func:`heads_of` are ``heads``, are at most ``at``: two short searches."""
    ends, heads = (F.col(c) if isinstance(c, str) else c for c in (ends, heads))
    step = _step(ends)
    block = F.size(F.filter(heads, lambda h: h <= at)) - 1
    inside = F.size(F.filter(F.slice(ends, block * step + 1, step), lambda e: e <= at))
    return F.when(F.get(heads, F.lit(0)) <= at, block * step + inside).otherwise(0)


def _step(ends: Column) -> Column:
    return F.ceil(F.sqrt(F.size(ends))).cast("int")


def heads_of(ends: Column | str) -> Column:
    """The first of each block of the ascending numbers ``ends``; null for none."""
    ends = F.col(ends) if isinstance(ends, str) else ends
    heads = F.transform(F.sequence(F.lit(0), F.size(ends) - 1, _step(ends)), lambda i: F.get(ends, i))
    return F.when(F.size(ends) > 0, heads)


def _ends_of(bound: Column) -> Column:
    sizes, block = bound["all"], bound["block"]
    grow = lambda acc, x: F.struct(
        (acc["at"] + x).alias("at"), F.concat(acc["ends"], F.array(acc["at"] + x)).alias("ends")
    )
    none = F.array().cast("array<int>")
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / block).cast("int")), lambda b: F.slice(sizes, b * block + 1, block)
    )
    with_sum = F.transform(
        blocks, lambda b: F.struct(b.alias("b"), F.aggregate(b, F.lit(0), lambda s, x: s + x).alias("sum"))
    )
    started = F.aggregate(
        with_sum,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,b:array<int>>>").alias("out")),
        lambda acc, w: F.struct(
            (acc["at"] + w["sum"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), w["b"].alias("b")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    ends = F.flatten(
        F.transform(started, lambda s: F.aggregate(s["b"], F.struct(s["at"].alias("at"), none.alias("ends")), grow, lambda a: a["ends"]))
    )
    return F.when(F.size(sizes) > 0, ends).otherwise(none)


def token_offsets(documents: DataFrame, pattern: str = V.WORD, keep: list[str] | None = None) -> DataFrame:
    """Start and end (0-based, end exclusive) of every match of ``pattern``, found in the row.

    The text is cut in alternating gaps and matches, and a running sum of their lengths gives the
    ends.  Nothing is shuffled.
    """
    keep = keep if keep is not None else [c for c in documents.columns if c != "text"]
    hits = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    cut_up = documents.select(*keep, hits.alias("hits"), F.split("text", pattern, -1).alias("gaps"))
    sized = cut_up.select(
        *keep, "hits",
        F.zip_with("hits", F.slice("gaps", F.lit(1), F.size("hits")), lambda h, g: F.length(h) + F.length(g)).alias("sizes"),
    )
    ended = sized.select(*keep, F.arrays_zip(F.col("hits").alias("token"), running_ends("sizes").alias("end_at")).alias("found"))
    rows = ended.select(*keep, F.posexplode_outer("found").alias("pos", "f")).where("f is not null")
    return rows.select(
        *keep,
        "pos",
        F.col("f.token").alias("token"),
        (F.col("f.end_at") - F.length("f.token")).cast("bigint").alias("start_at"),
        F.col("f.end_at").cast("bigint").alias("end_at"),
    )
