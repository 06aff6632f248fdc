"""Document fingerprints: a homomorphic multiset hash of paragraphs, and a likeness read from sums over word pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthoflow.session import cut

EQUAL_LANES = 8
LIKE_WORDS = 32
LANE_BITS = 31
LANES_A_WORD = 2
WORD_BITS = LANE_BITS * LANES_A_WORD
WORD_MASK = (1 << WORD_BITS) - 1
LOW_BITS = sum(1 << (LANE_BITS * i) for i in range(LANES_A_WORD))
HEX_DIGITS = -(-WORD_BITS // 4)
BELOW_ANY_ID = -(2**63)


def _field(acc: Column, i: int) -> Column:
    return acc.getField(f"f{i}")


def _zero(n: int) -> Column:
    return F.struct(*[F.lit(0).cast("long").alias(f"f{i}") for i in range(n)])


def _pair_hashes(paragraph: Column) -> Column:
    """Hashes of each word of a paragraph together with the word after it."""
    hashes = F.transform(
        F.array(F.split(paragraph, " ", -1)),
        lambda words: F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1))),
    )
    return hashes[0]


def _like_sums(hashes: Column) -> Column:
    """``LIKE_WORDS`` numbers of two counters each: the sums of the bits of ``hashes``."""
    half = LIKE_WORDS // 2
    like = F.aggregate(
        F.transform(hashes, lambda h: F.struct(h.alias("a"), F.xxhash64(h).alias("b"))),
        _zero(LIKE_WORDS),
        lambda acc, h: F.struct(
            *[
                (
                    _field(acc, i)
                    + F.shiftright(h.getField("a" if i < half else "b"), i % half).bitwiseAND(F.lit(LOW_BITS))
                ).alias(f"f{i}")
                for i in range(LIKE_WORDS)
            ]
        ),
        lambda acc: F.struct(
            *[_field(acc, i).bitwiseAND(F.lit(WORD_MASK)).alias(f"f{i}") for i in range(LIKE_WORDS)]
        ),
    )
    return F.transform(F.array(like), lambda e: F.array(*[_field(e, i) for i in range(LIKE_WORDS)]))[0]


def _paragraphs(text: Column | str) -> Column:
    return F.split(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), "\n", -1)


def paragraph_vector(text: Column | str) -> Column:
    """The fingerprint of ``text`` as an array of 62-bit numbers.

    It is the sum over the paragraphs (lines) of a vector hashed from each paragraph alone, so the
    order of paragraphs does not matter, and paragraphs can be put in or taken out later:

    * ``EQUAL_LANES`` numbers, each a 62-bit hash of the paragraph, summed modulo 2**62: equal
      multisets of paragraphs have equal sums, and others differ but for a chance of about 2**-496;
    * ``LIKE_WORDS`` numbers of two counters modulo 2**31 each: one hash bit of each pair of
      neighbouring words of the paragraph (the last word is a pair with nothing);
    * the number of pairs.

    A word put in or taken out changes the pairs it is in and no others.  Counters hold texts of up to 2**30
    words, which is more than one value of a column can have.
    """
    paragraphs = _paragraphs(text)
    digests = F.transform(paragraphs, lambda p: F.sha2(p, 256))
    equal = F.aggregate(
        digests,
        _zero(EQUAL_LANES),
        lambda acc, d: F.struct(
            *[
                (_field(acc, i) + F.xxhash64(d, F.lit(i)).bitwiseAND(F.lit(WORD_MASK)))
                .bitwiseAND(F.lit(WORD_MASK))
                .alias(f"f{i}")
                for i in range(EQUAL_LANES)
            ]
        ),
    )
    pairs = F.flatten(F.transform(paragraphs, _pair_hashes))
    lanes = F.transform(F.array(equal), lambda e: F.array(*[_field(e, i) for i in range(EQUAL_LANES)]))[0]
    like = F.transform(F.array(pairs), lambda h: F.concat(_like_sums(h), F.array(F.size(h).cast("long"))))[0]
    return F.concat(lanes, like)


def add_fingerprints(a: Column | str, b: Column | str) -> Column:
    """Vector of two texts' paragraphs together: what inserting ``b`` into ``a`` gives."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(WORD_MASK)))


def subtract_fingerprints(a: Column | str, b: Column | str) -> Column:
    """Vector of ``a`` after the paragraphs of ``b``, which it holds, are deleted."""
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(F.lit(WORD_MASK)))


def fingerprint_text(vector: Column | str) -> Column:
    """The vector as lower-case hexadecimal, sixteen digits a number."""
    return F.lower(F.array_join(F.transform(vector, lambda v: F.lpad(F.hex(v), HEX_DIGITS, "0")), ""))


def signs(vector: Column | str) -> Column:
    """Signed sums of the counters of a fingerprint: twice the count less the number of pairs, centred modulo 2**31."""
    col = F.col(vector) if isinstance(vector, str) else vector
    n, top = F.element_at(col, EQUAL_LANES + LIKE_WORDS + 1), 1 << LANE_BITS
    lanes = F.flatten(
        F.transform(
            F.slice(col, EQUAL_LANES + 1, LIKE_WORDS),
            lambda v: F.array(
                *[F.shiftright(v, LANE_BITS * i).bitwiseAND(F.lit(top - 1)) for i in range(LANES_A_WORD)]
            ),
        )
    )
    return F.transform(lanes, lambda c: F.pmod(2 * c - n + top // 2, F.lit(top)) - top // 2)


def likeness(a: Column | str, b: Column | str, a_signs: Column | str, b_signs: Column | str) -> Column:
    """Estimated cosine of the word pairs of two texts, from their fingerprints alone: 1 for equal
    ones, 0 where one of them has no signs or the estimate is below 0."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a_signs, a_signs) * dot(b_signs, b_signs))
    cosine = F.when(norm > 0, dot(a_signs, b_signs) / norm).otherwise(0.0)
    same = (F.col(a) if isinstance(a, str) else a) == (F.col(b) if isinstance(b, str) else b)
    return F.when(same, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine)))


def next_ids(ids: DataFrame) -> DataFrame:
    """``id`` and ``next_id``: each distinct id and the next larger one, the smallest after the last.

    Only ids are moved.  They are stored in ranges, and the window runs within each range; the first
    id of the following range (one row per range) completes the last row of a range.
    """
    ranged = ids.select("id").distinct().repartitionByRange("id")
    stored = cut(ranged.select("id", F.spark_partition_id().alias("part")), "ids")
    inside = Window.partitionBy("part").orderBy("id")
    firsts = stored.groupBy("part").agg(F.min("id").alias("first"))
    order = Window.orderBy("part")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("part", F.coalesce(F.lead("first").over(order), F.first("first").over(everything)).alias("outer"))
    linked = stored.withColumn("inner", F.lead("id").over(inside)).join(after, "part")
    return linked.select("id", F.coalesce("inner", "outer").alias("next_id"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and ``vector`` of every text, in the row of its columns; no shuffle.

    Null text counts as empty; the empty text has one empty paragraph.  Columns of ``docs`` that are
    called ``vector`` or ``fingerprint`` are not read and give way; ids may repeat or be null.
    """
    kept = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    vector = kept.withColumn("vector", paragraph_vector("text"))
    return vector.withColumn("fingerprint", fingerprint_text("vector"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next document's, with their likeness.

    Result: ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next``.

    Edited text: the last floor(n/2) code points are replaced by the first as many (or all) of the next
    document by id, and after the last id by those of the first.  Texts go through one shuffle by id,
    and the kept first halves through a second one to the next document, which meets them there.  The
    fingerprint of a document is computed once, before the first shuffle, and moves with its text; likeness is
    read from the fingerprints alone.

    Null text counts as empty.  Rows that share an id are each reported; all have the same next id, and
    of rows that share the next id the smallest text is taken.  A null id comes first, as the smallest
    number.  With one id only the next document is the document itself.  Other columns are not read.
    An empty table gives an empty result.
    """
    by_id = docs.select(
        F.coalesce(F.col(id_col), F.lit(BELOW_ANY_ID)).alias("id"),
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        paragraph_vector(text_col).alias("vector"),
    ).repartition("id")
    links = cut(next_ids(docs.select(F.coalesce(F.col(id_col), F.lit(BELOW_ANY_ID)).alias("id"))), "links")
    own = (
        by_id.join(links, "id")
        .withColumn("n_chars", F.length("text").cast("long"))
        .select(
            "doc_id", F.col("next_id").alias("id"), "n_chars", "vector",
            F.expr("substr(text, 1, cast(n_chars - floor(n_chars / 2) as int))").alias("first_half"),
        )
    )
    # a struct with doc_id too, which is not pruned, so that both sides read one and the same exchange
    least = by_id.groupBy("id").agg(F.min(F.struct("text", "doc_id", "vector")).alias("least"))
    following = least.select("id", F.col("least.text").alias("text"), F.col("least.vector").alias("next_vector"))
    both = own.join(following, "id").select(
        "doc_id", "n_chars", "vector", "next_vector",
        F.concat("first_half", F.expr("substr(text, 1, cast(floor(n_chars / 2) as int))")).alias("edited"),
    )
    vectors = both.select(
        "doc_id", "n_chars", "vector", "next_vector",
        F.sha2("edited", 256).alias("edited_sha256"),
        paragraph_vector("edited").alias("edited_vector"),
    )
    signed = vectors.select("*", *[signs(f"{v}vector").alias(f"{v}signs") for v in ("", "edited_", "next_")])
    return signed.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint_text("vector").alias("fingerprint"),
        fingerprint_text("edited_vector").alias("edited_fingerprint"),
        likeness("vector", "edited_vector", "signs", "edited_signs").alias("near_edited"),
        likeness("vector", "next_vector", "signs", "next_signs").alias("near_next"),
    )
