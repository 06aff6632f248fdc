"""URL filter: rules by host and path, and a list of URLs behind a blocked Bloom filter."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthoflow.llm.common import blocks, fits_broadcast, lookup
from orthoflow.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8
BITS_PER_URL = 16
BLOCK_BITS = 32 * WORDS
ROW_BYTES = 96
# Query parameters that name no other page, and host prefixes of the same site.
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
SAME_SITE = r"^(www|m)\."

Rule = tuple[str, str, str]


def url_host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(host: Column, path: Column, url: Column) -> Column:
    """One spelling of a page: no scheme, ``www.`` or ``m.``, standard port, final slashes, fragment or
    tracking parameters; the other parameters sorted.  Null without host."""
    site = F.regexp_replace(F.regexp_replace(host, SAME_SITE, ""), ":(80|443)$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(site, F.regexp_replace(path, "/+$", ""), tail))


def with_url_parts(pages: DataFrame, url_col: str) -> DataFrame:
    """``host``, ``path`` and ``canonical`` of each url beside the columns of ``pages``, which may not
    have these names."""
    parts = pages.withColumn("url", F.col(url_col)) if url_col != "url" else pages
    parts = parts.withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    return parts.withColumn("canonical", canonical_url(F.col("host"), F.col("path"), F.col("url")))


def bloom_keys(url: Column, n_blocks: int) -> list[Column]:
    """The block of a url and, for each of the block's words, the one bit it sets there."""
    bits = F.xxhash64(url, F.lit(1))
    masks = [
        F.call_function(
            "shiftleft", F.lit(1), F.shiftright(bits, 5 * i).bitwiseAND(F.lit(31)).cast("int")
        ).alias(f"m{i}")
        for i in range(WORDS)
    ]
    return [F.pmod(F.xxhash64(url), F.lit(n_blocks)).alias("block"), *masks]


def blocked_bloom(listed: DataFrame, n_blocks: int) -> DataFrame:
    """Filter of ``listed.canonical``: one row per block in use, each of ``WORDS`` 32-bit words.

    A row of a block is one cache line, so a probe costs one look-up; bits are set by ``bit_or``,
    which has map-side partial results.
    """
    keyed = listed.select(*bloom_keys(F.col("canonical"), n_blocks))
    return keyed.groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)])


def url_filter(
    pages: DataFrame,
    listed: DataFrame,
    rules: list[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    listed_col: str = "url",
    bits_per_url: int = BITS_PER_URL,
) -> DataFrame:
    """Verdict on each url: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``listed``.

    ``rules`` are (``allow`` or ``block``, host, path).  A rule fits its host and all subdomains if the
    path starts with the rule's; the longest (host and path) wins, and ``block`` wins a tie.  Where no
    rule fits, a url is blocked when its canonical form is that of a ``listed`` url.

    The Bloom filter is broadcast only if its size, which follows from the counted list, is within the
    bound; else it is joined by block.  Only possible hits go on to the exact join with the list, which
    removes false positives; a url that very many pages share is settled there on the map side.

    Null urls and urls without ``://`` have empty host and path, fit no rule and are in no list: they
    are allowed.  Repeated rows are judged one by one.  Other columns of ``pages`` and ``listed`` are
    not read; empty tables and an empty list give their natural results.
    """
    urls = listed.select(F.col(listed_col).alias("url"))
    known = cut(with_url_parts(urls, "url").select("canonical").where("canonical is not null").distinct(), "listed")
    n_listed = known.count()
    n_blocks = blocks(n_listed * bits_per_url, BLOCK_BITS)
    bloom = blocked_bloom(known, n_blocks)

    rows = with_url_parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")), "url")
    by_length = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block"))
    rule = verdict = F.lit(None).cast("string")
    for action, host, path in reversed(by_length):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, action).otherwise(verdict)
    judged = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), "canonical")

    keyed = judged.select("*", *bloom_keys(F.col("canonical"), n_blocks))
    small = fits_broadcast(min(n_blocks, n_listed), ROW_BYTES)
    if small:
        met = keyed.join(F.broadcast(bloom), "block", "left")
    else:
        met = lookup(cut(keyed, "urls"), cut(bloom, "bloom"), ["block"])
    hit = reduce(and_, [F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}") for i in range(WORDS)])
    possible = F.coalesce(hit, F.lit(False)) & F.col("ruled").isNull() & F.col("canonical").isNotNull()
    probed = cut(met.select(*judged.columns, possible.alias("possible")), "probed")

    hits = lookup(probed.where("possible"), known.withColumn("listed", F.lit(True)), ["canonical"])
    rest = probed.where("not possible").withColumn("listed", F.lit(False))
    both = hits.unionByName(rest).withColumn("listed", F.coalesce("listed", F.lit(False)))
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return both.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "listed")
