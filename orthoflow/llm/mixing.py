"""Mixing sources to target weights: tempered token shares, realised as budgeted block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthoflow.llm.common import fits_broadcast, fresh, lookup
from orthoflow.session import cut

MAX_REPETITION = 1.25
HALVINGS_A_JOB, JOBS = 4, 12
BUCKET_DOCS = 20_000
ROW_BYTES = 256
NO_SOURCE = "\u0000"
SEED = "mix"


def count_tokens(text: Column) -> Column:
    """Number of words between white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \t\n\r\f]+")), F.lit(0)).cast("long")


def order_key(block: Column, doc_id: Column, seed: str = SEED) -> Column:
    """Place of a document in the permutation of a block, as text that sorts."""
    return F.md5(F.concat_ws("|", F.lit(seed), block.cast("string"), doc_id.cast("string")))


@dataclass(frozen=True)
class Mixture:
    """Exponent that was found, the token budget, and the table of sources with their quotas."""

    exponent: float
    budget: float
    sources: DataFrame


def _figures(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float, float, float]]:
    """For each exponent: sum of powers, entropy, and the largest and smallest power over share."""
    p = F.col("share")
    aggs = []
    for i, a in enumerate(exponents):
        power = F.pow(p, F.lit(a))
        aggs += [F.sum(power).alias(f"s{i}"), F.sum(power * F.ln(p)).alias(f"l{i}")]
        aggs += [F.max(F.pow(p, F.lit(a - 1))).alias(f"h{i}"), F.min(F.pow(p, F.lit(a - 1))).alias(f"m{i}")]
    row = shares.agg(*aggs).first()
    out = []
    for i, a in enumerate(exponents):
        s = row[f"s{i}"]
        out.append((s, math.log(s) - a * row[f"l{i}"] / s, row[f"h{i}"], row[f"m{i}"]))
    return out


def find_exponent(
    shares: DataFrame, target_entropy: float | None, max_repetition: float | None, budget_share: float | None
) -> float:
    """Bisect the exponent in 0..1; each job does ``HALVINGS_A_JOB`` halvings at once.

    With ``target_entropy`` (in nats): the exponent whose weights have it, or the nearer end.  Else: the
    smallest exponent, that is the most even weights, with which no source is repeated more than
    ``max_repetition`` times.
    """

    def too_flat(figures: tuple[float, float, float, float]) -> bool:
        total, entropy, high, low = figures
        if target_entropy is not None:
            return entropy > target_entropy
        return (high / low if budget_share is None else budget_share * high / total) > max_repetition

    at_zero, at_one = _figures(shares, [0.0, 1.0])
    if not too_flat(at_zero):
        return 0.0
    if too_flat(at_one):
        return 1.0
    low, high, parts = 0.0, 1.0, 1 << HALVINGS_A_JOB
    for _ in range(JOBS):
        grid = [low + (high - low) * j / parts for j in range(parts + 1)]
        flat = [True, *[too_flat(f) for f in _figures(shares, grid[1:-1])], False]
        j = flat.index(False)
        low, high = grid[j - 1], grid[j]
    return high


def plan_mixture(
    docs: DataFrame,
    tokens: Column,
    id_col: str = "doc_id",
    source_col: str = "source",
    target_entropy: float | None = None,
    max_repetition: float | None = MAX_REPETITION,
    budget_tokens: float | None = None,
    seed: str = SEED,
) -> Mixture:
    """Weights, quotas and the last documents of each source; only figures of sources reach the driver.

    The weight of a source is its token share to the power of the exponent, normalised.  Its quota is
    weight times budget: some whole blocks (each a permutation of all its documents) and a rest, which is
    filled with the first documents of one more block.  Without ``budget_tokens`` the budget is the
    smallest that takes every document once at least.

    The last document of the rest is found without sorting a source: sums by the leading digits of the
    order key show in which bucket the rest ends, and only documents of that bucket are put in order.
    """
    rows = cut(
        docs.select(
            F.coalesce(F.col(source_col), F.lit(NO_SOURCE)).alias("source"), F.col(id_col).alias("doc_id"), tokens.alias("n")
        ),
        "tokens",
    )
    sources = cut(rows.groupBy("source").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("docs")), "sources")
    whole = sources.agg(F.sum("tokens").alias("t"), F.sum("docs").alias("d")).first()
    total, n_docs = whole["t"] or 0, whole["d"] or 0
    if total:
        shares = sources.where("tokens > 0").select((F.col("tokens") / F.lit(total)).alias("share"))
        share_of_all = None if budget_tokens is None else budget_tokens / total
        exponent = find_exponent(shares, target_entropy, max_repetition, share_of_all)
        power_sum, _, _, least = _figures(shares, [exponent])[0]
        scale = 1 / least if budget_tokens is None else budget_tokens / (total * power_sum)
        budget = scale * power_sum * total
    else:
        exponent, scale, budget, power_sum = 1.0, 1.0, 0.0, 1.0
    share = F.col("tokens") / F.lit(max(total, 1))
    repetition = F.when(F.col("tokens") > 0, F.lit(scale) * F.pow(share, F.lit(exponent - 1))).otherwise(1.0)
    quotas = sources.select(
        "source", "tokens", "docs", repetition.alias("repetition"), F.floor(repetition + 1e-9).alias("blocks")
    ).withColumn(
        "rest", F.greatest(F.lit(0).cast("long"), F.round((F.col("repetition") - F.col("blocks")) * F.col("tokens")).cast("long"))
    )
    quotas = cut(quotas, "quotas")

    digits = max(1, math.ceil(math.log(max(n_docs / BUCKET_DOCS, 1), 16)))
    partial = _with_quota(rows, quotas.where("rest > 0").select("source", "blocks", "rest"), "inner")
    keyed = partial.select("source", "rest", "n", order_key(F.col("blocks"), F.col("doc_id"), seed).alias("key"))
    keyed = cut(keyed.withColumn("bucket", F.substring("key", 1, digits)), "keys")
    by_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = keyed.groupBy("source", "bucket").agg(F.sum("n").alias("n"), F.max("rest").alias("rest"))
    ends = (
        sums.withColumn("upto", F.sum("n").over(by_bucket))
        .where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("n") < F.col("rest")))
        .select("source", "bucket", (F.col("upto") - F.col("n")).alias("before"))
    )
    last_bucket = lookup(keyed, cut(ends, "ends"), ["source", "bucket"], "inner")
    by_key = Window.partitionBy("source").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    upto = F.sum("n").over(by_key) + F.col("before")
    lasts = last_bucket.withColumn("upto", upto).where(F.col("upto") >= F.col("rest"))
    cutoffs = lasts.groupBy("source").agg(F.min("key").alias("last_key"))
    planned = quotas.join(cutoffs, "source", "left")
    return Mixture(exponent, budget, cut(planned, "mixture"))


def _with_quota(rows: DataFrame, quotas: DataFrame, how: str) -> DataFrame:
    """Rows with the figures of their source: by broadcast if the counted table is small, else by the
    split join, in which only hot sources are broadcast."""
    if fits_broadcast(quotas.count(), ROW_BYTES):
        return rows.join(F.broadcast(quotas), quotas.columns[0], how)
    return lookup(rows, cut(quotas, "quota"), [quotas.columns[0]], how)


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    target_entropy: float | None = None,
    max_repetition: float | None = MAX_REPETITION,
    budget_tokens: float | None = None,
    seed: str = SEED,
    extra: tuple[str, str, str] = ("block", "order_key", "place"),
) -> DataFrame:
    """``docs`` as the mixture has them: a row for each time a document is taken, with its own columns.

    ``extra`` names three more columns: the block (0 for the first pass through the source), the order
    key inside it, and ``place`` in 0..1.  Sorted by source, block and key, the rows are block
    permutations; sorted by place, all sources run through at their weights from beginning to end.

    Tokens are words between white space.  Null text has none.  Documents with a null source are a source
    of their own.  A source without any token is taken once.  Rows with equal ids have equal keys and are
    taken together; the document that reaches the rest of a quota is still taken.  Columns of ``docs``
    with a name of ``extra`` give way.  An empty table gives an empty result.
    """
    mixture = plan_mixture(
        docs, count_tokens(F.col(text_col)), id_col, source_col, target_entropy, max_repetition, budget_tokens, seed
    )
    kept = [c for c in docs.columns if c not in extra]
    names = fresh(kept + list(extra), "source_key", "blocks", "repetition", "last_key")
    key, blocks, repetition, last = names
    quotas = mixture.sources.select("source", "blocks", "repetition", "last_key").toDF(*names)
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(source_col), F.lit(NO_SOURCE)).alias(key))
    met = _with_quota(rows, quotas, "inner")
    one_more = F.coalesce(order_key(F.col(blocks), F.col(id_col), seed) <= F.col(last), F.lit(False))
    times = (F.col(blocks) + one_more.cast("long")).cast("int")
    block, order, place = extra
    taken = met.where(times > 0).withColumn(block, F.explode(F.sequence(F.lit(0), times - 1)))
    taken = taken.withColumn(order, order_key(F.col(block), F.col(id_col), seed))
    fraction = F.conv(F.substring(order, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return taken.withColumn(place, F.least(F.lit(1.0), (F.col(block) + fraction) / F.col(repetition))).select(*kept, *extra)
