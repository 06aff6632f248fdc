"""Whole lexicon packages, all packages in one job keyed by ``pkg``."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoflow import fixed_values as V
from orthoflow.functions.text import valid_word
from orthoflow.operators import lexicon as L
from orthoflow.session import cut


def curated(keep: DataFrame, variant: str) -> DataFrame:
    """Curated words that may be added: valid ones, and for loanwords all."""
    return keep if variant == "loanword" else keep.where(valid_word("word"))


def expand_package(
    seeds: DataFrame,
    roots: DataFrame,
    harvested: DataFrame,
    reference: DataFrame | None = None,
    suffixes: Sequence[str] = V.COMMON_SUFFIXES,
    prefixes: Sequence[str] = (),
    bases: DataFrame | None = None,
    keep: DataFrame | None = None,
    denied: DataFrame | None = None,
    title_markers: Sequence[str] | None = None,
    variant: str = "spanish",
) -> DataFrame:
    """Seeds, roots with affixes and harvested words, with gender and number forms; denied
    words removed, orthography filter, curated words kept.

    All bags have (pkg, word).  ``reference`` is the base lexicon of the filter (word).
    """
    bag = L.merge_bags(seeds, L.word_affixes(roots, suffixes, prefixes, bases), harvested)
    if variant != "loanword":
        bag = L.gender_number(bag, title_markers=title_markers)
    bag = bag.where(valid_word("word"))
    if denied is not None:
        bag = L.deny(bag, denied)
    bag = L.orthography_filter(bag, reference, variant)
    return bag if keep is None else L.force_keep(bag, curated(keep, variant))


def build_package(
    words: DataFrame,
    denied: DataFrame,
    title_keys: Sequence[str],
    plural_rule: str,
    seeds: DataFrame,
    reference: DataFrame | None = None,
    keep: DataFrame | None = None,
    variant: str = "spanish",
    **bounds,
) -> DataFrame:
    """Final words per package from collected words (pkg, word).

    Valid and not denied words, Title variants, plurals, orthography filter, curated words,
    false-positive seeds, second filter (not for loanwords).
    """
    bounds = {"min_length": 2, **bounds}
    bag = L.deny(L.valid_bag(words, variant, **bounds), denied)
    bag = L.merge_bags(bag, L.title_variants(bag, title_keys))
    bag = cut(bag.distinct(), "bag")
    forms = L.deny(L.valid_bag(L.plurals(bag, plural_rule), variant, **bounds), denied)
    kept = L.orthography_filter(L.merge_bags(bag, forms), reference, variant)
    if keep is not None:
        kept = L.force_keep(kept, curated(keep, variant))
    return L.seed_then_refilter(cut(kept, "kept"), seeds, reference, variant)


@dataclass(frozen=True)
class PackageRule:
    """How one package is built: plural rule, variant, lengths, words that get a Title form, and the
    finished package from which it takes the words that contain one of ``harvest_markers``."""

    plural_rule: str = "general"
    variant: str = "spanish"
    min_length: int = 2
    max_length: int = 45
    title_keys: tuple[str, ...] = ()
    harvest_from: str | None = None
    harvest_markers: tuple[str, ...] = ()


def build_packages(
    words: DataFrame,
    rules: dict[str, PackageRule],
    denied: DataFrame,
    seeds: DataFrame,
    reference: DataFrame | None = None,
    keep: DataFrame | None = None,
) -> DataFrame:
    """Final words of all packages that ``rules`` names, each by its own rule, as (pkg, word).

    Packages with equal rules are built together.  One that harvests from another is built after it,
    from the finished words of that package.
    """
    done: dict[str, DataFrame] = {}
    waiting = dict(rules)
    while waiting:
        ready = [p for p, r in waiting.items() if r.harvest_from is None or r.harvest_from in done]
        if not ready:
            raise ValueError(f"packages wait for one another: {sorted(waiting)}")
        for rule in dict.fromkeys(waiting[p] for p in ready):
            names = [p for p in ready if waiting[p] == rule]
            own = words.where(F.col("pkg").isin(names))
            if rule.harvest_from is not None:
                low = F.lower("word")
                marked = reduce(lambda a, m: a | F.contains(low, F.lit(m)), rule.harvest_markers, F.lit(False))
                found = done[rule.harvest_from].where((F.col("pkg") == rule.harvest_from) & marked)
                own = L.merge_bags(own, *[found.select(F.lit(p).alias("pkg"), "word") for p in names])
            built = build_package(
                own, denied, rule.title_keys, rule.plural_rule, seeds.where(F.col("pkg").isin(names)), reference,
                None if keep is None else keep.where(F.col("pkg").isin(names)), rule.variant, min_length=rule.min_length, max_length=rule.max_length,
            )
            stored = cut(built, "package")
            done.update(dict.fromkeys(names, stored))
        waiting = {p: r for p, r in waiting.items() if p not in ready}
    return reduce(DataFrame.unionByName, [frame.where(F.col("pkg") == p).select("pkg", "word") for p, frame in done.items()])
