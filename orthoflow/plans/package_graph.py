"""Lexicon packages as graphs of steps, many packages in the same jobs.

A step is a row (``pkg``, ``step``, ``kind``, ``inputs``, ``options``).  Its inputs are steps of the same package by name,
or ``pkg:step`` of another one, and its output is a bag of words; the step called ``package`` gives the finished words.
Steps run when their inputs are there, and all that are ready, of one kind with the same options, run as one job
over (pkg, word), so hundreds of packages with few kinds of steps need few jobs.

Kinds: ``words`` and ``seeds`` (the collected words and the words of the seed texts of the package), ``merge``, ``valid``
(options min_length, max_length, variant), ``deny``, ``affixes`` (roots with the package's affixes), ``gender``,
``plurals`` (option rule), ``titles``, ``harvest`` (words of the inputs that the package's rules want), ``filter`` (option
variant) and ``keep``.  All but ``affixes``, ``gender``, ``harvest`` and ``filter`` keep what came in and add to it, or remove from it.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoflow.functions.morphology import PLURALS
from orthoflow.functions.text import title_form, valid_word
from orthoflow.operators import lexicon as L
from orthoflow.operators.rules import harvest_by_rules
from orthoflow.session import cut

FINISHED = "package"
STEPS = "pkg string, step string, kind string, inputs array<string>, options map<string,string>"


@dataclass(frozen=True)
class Step:
    pkg: str
    step: str
    kind: str
    inputs: tuple[str, ...] = ()
    options: tuple[tuple[str, str], ...] = ()

    def sources(self) -> list[tuple[str, str]]:
        """Package and name of the steps that this one reads."""
        return [tuple(i.split(":", 1)) if ":" in i else (self.pkg, i) for i in self.inputs]

    def option(self, name: str, default: str) -> str:
        return dict(self.options).get(name, default)


@dataclass(frozen=True)
class PackageTables:
    """Words of all packages (pkg, word), seed texts (pkg, text), denied words (word), affixes and rules (pkg, kind,
    marker), words that get a Title form (pkg, word), curated words (pkg, word) and the base lexicon (word)."""

    words: DataFrame
    seeds: DataFrame | None = None
    denied: DataFrame | None = None
    affixes: DataFrame | None = None
    rules: DataFrame | None = None
    titles: DataFrame | None = None
    keep: DataFrame | None = None
    reference: DataFrame | None = None
    done: dict[tuple[str, str], DataFrame] = field(default_factory=dict)


def steps_of(table: DataFrame) -> list[Step]:
    """Steps of a rules table (``STEPS``); its length is the number of steps, not of words."""
    return [
        Step(r["pkg"], r["step"], r["kind"], tuple(r["inputs"] or ()), tuple(sorted((r["options"] or {}).items())))
        for r in table.orderBy("pkg", "step").collect()
    ]


def affixed_forms(roots: DataFrame, affixes: DataFrame) -> DataFrame:
    """(pkg, word): roots with each suffix and prefix of their package, within the length bounds of affixed words.

    The affixes of a package are one row, and Spark chooses by their stored size how they meet the roots.
    """
    per_package = affixes.groupBy("pkg").agg(F.collect_set(F.struct("kind", "marker")).alias("affixes"))
    pairs = roots.join(cut(per_package, "affixes"), "pkg").select("pkg", "word", F.explode("affixes").alias("a"))
    suffix = F.col("a.kind") == "suffix"
    made = pairs.select(
        "pkg",
        F.when(suffix, F.concat("word", "a.marker")).otherwise(F.concat("a.marker", "word")).alias("word"),
        F.when(suffix, 5).otherwise(6).alias("least"),
    )
    return made.where((F.length("word") >= F.col("least")) & L._letters(F.col("word"), 5, 42)).select("pkg", "word").distinct()


def listed_titles(words: DataFrame, titles: DataFrame) -> DataFrame:
    """Title form of the words that their package lists and that are written in lower case."""
    keys = titles.select("pkg", F.lower("word").alias("_low")).distinct()
    low = words.where(F.rlike("word", F.lit(r"^\p{Ll}"))).withColumn("_low", F.lower("word"))
    return low.join(keys, ["pkg", "_low"], "left_semi").select("pkg", title_form("word").alias("word")).distinct()


def _input_bag(steps: list[Step], done: dict[tuple[str, str], DataFrame]) -> DataFrame | None:
    """Inputs of the steps, under the package of the step that reads them.

    Steps of one job that read one stored table of their own packages do so in one scan.
    """
    own, other = defaultdict(set), []
    for s in steps:
        for pkg, name in s.sources():
            if pkg == s.pkg:
                own[id(done[pkg, name])].add((pkg, name))
            else:
                other.append(done[pkg, name].where((F.col("pkg") == pkg) & (F.col("step") == name)).select(F.lit(s.pkg).alias("pkg"), "word"))
    frames = []
    for group in own.values():
        frame = done[next(iter(group))]
        names = F.struct("pkg", "step").isin(*[F.struct(F.lit(p), F.lit(n)) for p, n in sorted(group)])
        frames.append(frame.where(names).select("pkg", "word"))
    both = [*frames, *other]
    return reduce(DataFrame.unionByName, both).distinct() if both else None


def _run(kind: str, steps: list[Step], tables: PackageTables) -> DataFrame:
    """One job: the bags of all ``steps``, which have the same kind and options."""
    names, one = [s.pkg for s in steps], steps[0]
    mine = lambda table: table.where(F.col("pkg").isin(*names))
    variant = one.option("variant", "spanish")
    if kind == "words":
        return mine(tables.words).select("pkg", "word").distinct()
    if kind == "seeds":
        return L.seed_words(mine(tables.seeds).select("pkg", "text"))
    if kind == "harvest":
        sources = [tables.done[key].where((F.col("pkg") == key[0]) & (F.col("step") == key[1])).select("word") for key in one.sources()]
        return harvest_by_rules(reduce(DataFrame.unionByName, sources), mine(tables.rules))
    bag = _input_bag(steps, tables.done)
    if kind == "merge":
        return bag
    if kind == "valid":
        return L.valid_bag(bag, variant, min_length=int(one.option("min_length", "2")), max_length=int(one.option("max_length", "45")))
    if kind == "deny":
        return L.deny(bag, tables.denied)
    if kind == "affixes":
        return affixed_forms(bag, mine(tables.affixes))
    if kind == "gender":
        return L.gender_number(bag)
    if kind == "plurals":
        return L.merge_bags(bag, L.plurals(bag, one.option("rule", "general")))
    if kind == "titles":
        return L.merge_bags(bag, listed_titles(bag, mine(tables.titles)))
    if kind == "filter":
        return L.orthography_filter(bag, tables.reference, variant)
    kept = mine(tables.keep)
    return L.force_keep(bag, kept if variant == "loanword" else kept.where(valid_word("word")))


KINDS = ("words", "seeds", "merge", "valid", "deny", "affixes", "gender", "plurals", "titles", "harvest", "filter", "keep")


def check_steps(steps: list[Step]) -> None:
    """Raise for a kind, rule or input that is not there, two steps of one name, and packages without end."""
    names = [(s.pkg, s.step) for s in steps]
    for s in steps:
        if s.kind not in KINDS:
            raise ValueError(f"{s.pkg}:{s.step} is of no known kind: {s.kind}")
        if s.kind == "plurals" and s.option("rule", "general") not in PLURALS:
            raise ValueError(f"{s.pkg}:{s.step} has no known plural rule")
        if missing := [f"{p}:{n}" for p, n in s.sources() if (p, n) not in names]:
            raise ValueError(f"{s.pkg}:{s.step} reads steps that are not there: {missing}")
        if bool(s.inputs) == (s.kind in ("words", "seeds")):
            raise ValueError(f"{s.pkg}:{s.step} must {'have no' if s.inputs else 'have'} inputs")
    if twice := sorted({f"{p}:{n}" for p, n in names if names.count((p, n)) > 1}):
        raise ValueError(f"steps are there twice: {twice}")
    if open_ := sorted({p for p, _ in names} - {p for p, n in names if n == FINISHED}):
        raise ValueError(f"packages without a step called {FINISHED}: {open_}")


def run_steps(steps: list[Step], tables: PackageTables) -> dict[tuple[str, str], DataFrame]:
    """Bags (pkg, step, word) of all steps; steps that ran as one job share a stored table."""
    check_steps(steps)
    done, waiting = tables.done, list(steps)
    while waiting:
        ready = [s for s in waiting if all(key in done for key in s.sources())]
        if not ready:
            raise ValueError(f"steps wait for one another: {sorted(f'{s.pkg}:{s.step}' for s in waiting)}")
        jobs: dict[tuple, list[Step]] = defaultdict(list)
        for s in ready:
            # a job names each package once, and a harvest has one source
            same = sum(s.pkg == t.pkg for t in ready[: ready.index(s)])
            jobs[s.kind, s.options, s.inputs if s.kind == "harvest" else None, same].append(s)
        for (kind, *_), group in jobs.items():
            names = F.create_map(*[F.lit(x) for s in group for x in (s.pkg, s.step)])
            stored = cut(_run(kind, group, tables).select("pkg", names[F.col("pkg")].alias("step"), "word"), "step")
            done.update({(s.pkg, s.step): stored for s in group})
        waiting = [s for s in waiting if s not in ready]
    return done


def build_graphs(steps: list[Step], tables: PackageTables) -> DataFrame:
    """Finished words (pkg, word) of all packages that ``steps`` names."""
    done = run_steps(steps, tables)
    frames: dict[int, tuple[DataFrame, set[str]]] = {}
    for s in steps:
        if s.step == FINISHED:
            frames.setdefault(id(done[s.pkg, FINISHED]), (done[s.pkg, FINISHED], set()))[1].add(s.pkg)
    parts = [f.where((F.col("step") == FINISHED) & F.col("pkg").isin(*sorted(p))).select("pkg", "word") for f, p in frames.values()]
    return reduce(DataFrame.unionByName, parts)
