"""Harvests by tables of rules: any number of markers and affixes, each with its package.

A rule is a row (``pkg``, ``kind``, ``marker``); ``kind`` is

* ``contains``: the word contains the marker,
* ``suffix``: it ends in the marker, ``prefix``: it begins with it and has more than two further letters,
* ``keep``: it is the marker, ``deny``: it is the marker, and is not wanted whatever else holds,
* ``longer``: it has as many letters as the marker says, or more.

All compare lower-case forms.  Rules meet words in equi joins only: affixes by their text, one key of a word per
length of affix in use; contained markers by an index of letter groups (q-grams).  The index has each marker
under the one of its groups that fewest words have, and a group of a word that is in no index leaves next to the
scan.  Groups that very many words share are cut in parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthoflow.operators.prefilter import key_filter
from orthoflow.session import cut, spread_lookup

GRAM = 4
FURTHER_LETTERS = 3
WANTED = ("keep", "suffix", "prefix", "contains", "longer")


def letter_groups(text: Column | str, lengths: list[int]) -> Column:
    """Distinct groups of neighbouring letters of a text, of each of the ``lengths``."""
    text = F.col(text) if isinstance(text, str) else text
    # a sequence that would run backwards is not asked for: short texts have no group of this length
    one = lambda n: F.when(
        F.length(text) >= n,
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, n)),
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[one(n) for n in lengths])) if lengths else F.array().cast("array<string>")


def _lengths(rules: DataFrame, length: Column) -> list[int]:
    """Lengths in use; their number is bounded by that of the longest word."""
    return sorted(r[0] for r in rules.select(length.alias("n")).distinct().collect() if r[0])


def contained_markers(words: DataFrame, markers: DataFrame) -> DataFrame:
    """Pairs (``low``, ``marker``) of a stored ``words`` row and a stored ``markers`` row that it contains.

    ``low`` and ``marker`` are distinct lower-case texts.  Markers of ``GRAM`` letters or more are indexed by one of
    their groups of ``GRAM`` letters, the one in fewest words; shorter ones are their own group.
    """
    size = F.least(F.length("marker"), F.lit(GRAM))
    used = markers.where(F.length("marker") > 0).withColumn("size", size)
    lengths = _lengths(used, F.col("size"))
    if not lengths:
        return words.select("low").limit(0).withColumn("marker", F.lit(None).cast("string"))
    by_length = F.coalesce(*[F.when(F.col("size") == n, letter_groups("marker", [n])) for n in lengths])
    ways = cut(used.select("marker", F.explode(by_length).alias("gram")), "ways")
    grams = words.select("low", F.explode(letter_groups("low", lengths)).alias("gram"))
    asked = cut(key_filter(ways, "gram").keep(grams, "gram"), "grams")

    counts = asked.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    best = ways.join(counts, "gram").groupBy("marker").agg(F.min_by(F.struct("gram", "n"), F.struct("n", "gram")).alias("b"))
    index = best.groupBy(F.col("b.gram").alias("gram")).agg(F.max("b.n").alias("n"), F.collect_list("marker").alias("markers"))
    met = spread_lookup(asked, cut(index, "index"), ["gram"], weight="n", spread_by="low")
    hits = F.filter("markers", lambda m: F.contains(F.col("low"), m))
    return met.where(F.size("markers") > 0).select("low", F.explode_outer(hits).alias("marker")).where("marker is not null")


def affixed_words(words: DataFrame, affixes: DataFrame, suffix: bool) -> DataFrame:
    """Pairs (``low``, ``marker``) of a word and an affix it ends in or begins with, by the affix's text."""
    lengths = _lengths(affixes, F.length("marker"))
    if not lengths:
        return words.select("low").limit(0).withColumn("marker", F.lit(None).cast("string"))
    room = 0 if suffix else FURTHER_LETTERS
    part = (lambda n: F.right("low", F.lit(n))) if suffix else (lambda n: F.left("low", F.lit(n)))
    ends = F.array(*[F.when(F.length("low") >= n + room, part(n)) for n in lengths])
    keyed = words.select("low", F.explode_outer(F.array_compact(ends)).alias("marker")).where("marker is not null")
    return key_filter(affixes, "marker").keep(keyed, "marker").join(affixes.select("marker").distinct(), "marker").select("low", "marker")


def rule_hits(words: DataFrame, rules: DataFrame) -> DataFrame:
    """Each rule that a word meets: (``pkg``, ``word``, ``kind``, ``marker``), for words of any source (``word``).

    Words and markers are compared once per distinct lower-case form, and rules and words come back to the pairs
    by their text.  Null words and markers meet nothing.
    """
    asked = cut(words.select("word").where("word is not null").distinct().withColumn("low", F.lower("word")), "asked")
    given = cut(
        rules.where("marker is not null").select("pkg", "kind", F.lower("marker").alias("marker")).distinct(), "rules"
    )
    forms = cut(asked.select("low").distinct(), "forms")
    of = lambda kind: given.where(F.col("kind") == kind)
    markers = lambda kind: cut(of(kind).select("marker").distinct(), "markers")
    found = [
        contained_markers(forms, markers("contains")).withColumn("kind", F.lit("contains")),
        affixed_words(forms, markers("suffix"), True).withColumn("kind", F.lit("suffix")),
        affixed_words(forms, markers("prefix"), False).withColumn("kind", F.lit("prefix")),
    ]
    pairs = found[0].unionByName(found[1]).unionByName(found[2])
    ruled = pairs.join(given, ["kind", "marker"]).select("pkg", "low", "kind", "marker")
    named = given.where(F.col("kind").isin("keep", "deny")).select("pkg", F.col("marker").alias("low"), "kind", "marker")
    least = of("longer").groupBy("pkg", "kind").agg(F.min_by("marker", F.col("marker").cast("int")).alias("marker"))
    longest = forms.agg(F.coalesce(F.max(F.length("low")), F.lit(0)).alias("n")).first()["n"]
    from_ = F.col("marker").cast("int")
    sizes = least.where(from_ <= longest).withColumn("n", F.explode(F.sequence(from_, F.lit(longest))))
    long_ = forms.withColumn("n", F.length("low")).join(cut(sizes, "sizes"), "n").select("pkg", "low", "kind", "marker")
    hits = ruled.unionByName(named.join(forms, "low")).unionByName(long_)
    return hits.join(asked, "low").select("pkg", "word", "kind", "marker")


def harvest_by_rules(words: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (``pkg``, ``word``): the words of ``words`` (``word``) that a package's rules want and do not deny."""
    kinds = rule_hits(words, rules).groupBy("pkg", "word").agg(
        F.bool_or(F.col("kind").isin(*WANTED)).alias("wanted"), F.bool_or(F.col("kind") == "deny").alias("denied")
    )
    return kinds.where("wanted and not denied").select("pkg", "word")


def deciding_rules(words: DataFrame, rules: DataFrame) -> DataFrame:
    """(``pkg``, ``word``, ``kind``, ``marker``): of the rules a word meets in a package the first by kind (deny, keep,
    suffix, prefix, contains, longer), then the longest marker, then the smallest."""
    order = F.array_position(F.array(*[F.lit(k) for k in ("deny", *WANTED)]), F.col("kind"))
    best = F.min_by(F.struct("kind", "marker"), F.struct(order, -F.length("marker"), "marker"))
    return rule_hits(words, rules).groupBy("pkg", "word").agg(best.alias("b")).select("pkg", "word", "b.kind", "b.marker")
