"""Decisions of reviewers that keep a lexicon package up to date, without building it anew.

Whether a word is in a package depends on the words that share its folded form: they, their derived forms and the
forms of accented words.  So each source word influences a known set of folds, and a decision (add or deny) on a
word can change the package only at the folds that the word influences.  A round of decisions therefore
reads the source words of those folds, builds the package from them alone, and replaces the package's words at those
folds.  Sources, decisions and package are tables of key buckets, so the rest is neither read nor written.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoflow.functions.text import fold, title_form
from orthoflow.operators import lexicon as L
from orthoflow.plans.review import newest_decisions
from orthoflow.session import cut
from orthoflow.sources.snapshots import BUCKET_ROWS, KeyedTable

Build = Callable[[DataFrame, DataFrame], DataFrame]
Derive = Callable[[DataFrame], DataFrame]


def influenced_folds(words: DataFrame, derive: Derive) -> DataFrame:
    """(pkg, fold, word): the folds at which each of ``words`` (pkg, word) can change a package.

    They are those of the word, of the words that ``derive`` makes of it, and of the forms of these
    that have an accent.
    """
    named = words.select("pkg", "word").distinct().withColumn("source", F.col("word"))
    made = derive(named).select("pkg", "source", "word")
    all_ = named.select("pkg", "source", "word").unionByName(made)
    # the bag of a source is a package of its own while its forms are looked up
    scoped = all_.select(F.struct("pkg", "source").alias("pkg"), "word")
    forms = L.accented_keys(scoped).select("pkg.pkg", "pkg.source", "fold")
    plain = all_.select("pkg", "source", fold("word").alias("fold"))
    return plain.unionByName(forms).distinct().select("pkg", "fold", F.col("source").alias("word"))


def plural_and_title(rule: str) -> Derive:
    """What :func:`build_package` makes of a word: its Title form, and the plurals of both."""

    def derive(words: DataFrame) -> DataFrame:
        titled = words.withColumn("word", title_form("word"))
        both = words.unionByName(titled).withColumnRenamed("pkg", "_pkg")
        scoped = both.select(F.struct(F.col("_pkg").alias("pkg"), "source").alias("pkg"), "word")
        plural = L.plurals(scoped, rule).select("pkg.pkg", "pkg.source", "word")
        return titled.select("pkg", "source", "word").unionByName(plural)

    return derive


@dataclass(frozen=True)
class MaintainedPackages:
    """Packages in ``folder`` that are kept up to date by decisions.

    ``build(words, denied)`` gives the finished words (pkg, word) of source words (pkg, word) without the denied ones
    (pkg, word), and ``derive`` what it may make of a source word.  ``build`` must treat words of
    different folds alike, as the orthography filter does.
    """

    spark: SparkSession
    folder: str
    build: Build
    derive: Derive
    bucket_rows: int = BUCKET_ROWS

    def table(self, name: str, keys: list[str]) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.folder.rstrip('/')}/{name}", keys, self.bucket_rows)

    @property
    def sources(self) -> KeyedTable:
        return self.table("sources", ["pkg", "fold"])

    @property
    def decisions(self) -> KeyedTable:
        return self.table("decisions", ["pkg", "key"])

    @property
    def package(self) -> KeyedTable:
        return self.table("package", ["pkg", "fold"])

    def start(self, words: DataFrame, denied: DataFrame) -> None:
        """Full build of source words (pkg, word) without ``denied`` ones (pkg, word); denials are decisions of no time."""
        self.sources.upsert(cut(influenced_folds(words, self.derive), "influence"))
        none = F.lit(None).cast("timestamp")
        first = denied.select("pkg", F.lower("word").alias("key"), F.lit("deny").alias("decision"), none.alias("ts"), F.lower("word").alias("word"))
        self.decisions.upsert(cut(first.distinct(), "denied"))
        built = self.build(words, first.select("pkg", "word")).select("pkg", fold("word").alias("fold"), "word")
        self.package.upsert(cut(built, "built"))

    def _newest(self, decisions: DataFrame) -> DataFrame:
        """Decisions that are newer than what is known of their word, one per package and key."""
        ranked = decisions.groupBy("pkg", F.lower("word").alias("key")).agg(
            F.max(F.struct("ts", "decision", "word")).alias("d")
        ).select("pkg", "key", "d.decision", "d.ts", "d.word")
        ranked = cut(ranked, "ranked")
        known = self.decisions.near(ranked).select("pkg", "key", F.struct("ts", "decision", "word").alias("_known"))
        newer = F.col("_known").isNull() | (F.struct("ts", "decision", "word") > F.col("_known"))
        return cut(ranked.join(known, ["pkg", "key"], "left").where(newer).drop("_known"), "newer")

    def apply(self, decisions: DataFrame, mark: int) -> bool:
        """A round of ``decisions`` (pkg, word, decision add or deny, ts); the newest per word counts.

        Returns whether there was anything to do.  A round with a ``mark`` that was applied is skipped, and one that
        failed half way is done again as a whole: decisions become known last.
        """
        if self.package.seen(mark) and self.decisions.seen(mark):
            return False
        newer = self._newest(decisions)
        if newer.isEmpty() and decisions.where("decision = 'add'").isEmpty():
            return False
        changed = newer.select("pkg", F.explode(F.array("word", "key", title_form("key"), F.upper("key"))).alias("word")).distinct()
        touched = cut(influenced_folds(changed, self.derive).select("pkg", "fold").distinct(), "touched")

        # also words whose newest decision is another: they are denied now, and come back if that changes
        added = decisions.where("decision = 'add'").select("pkg", "word")
        rows = cut(influenced_folds(added, self.derive), "added")
        self.sources.merge(rows, lambda old, new: old.unionByName(new).distinct())
        here = self.sources.near(touched).join(touched, ["pkg", "fold"], "left_semi").select("pkg", "word").distinct()
        here = cut(here, "sources")

        keys = cut(here.select("pkg", F.lower("word").alias("key")).distinct(), "keys")
        derived = self.derive(here.withColumn("source", F.col("word"))).select("pkg", F.lower("word").alias("key"))
        asked = cut(keys.unionByName(derived).distinct(), "asked")
        known = self.decisions.near(asked).select("pkg", "key", "decision")
        after = known.join(newer.select("pkg", "key"), ["pkg", "key"], "left_anti").unionByName(newer.select("pkg", "key", "decision"))
        denied = after.where("decision = 'deny'").select("pkg", F.col("key").alias("word"))

        built = self.build(here, cut(denied, "denied")).select("pkg", fold("word").alias("fold"), "word")
        new = cut(built.join(touched, ["pkg", "fold"], "left_semi").select("pkg", "fold", "word"), "new")
        self.package.merge(
            touched, lambda old, keys: old.join(keys, ["pkg", "fold"], "left_anti").unionByName(new), mark
        )
        self.decisions.upsert(newer.select("pkg", "key", "decision", "ts", "word"), mark)
        return True

    def words(self) -> DataFrame:
        return self.package.read().select("pkg", "word")


def decided_words(words: DataFrame, denied: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Source and denied words (pkg, word) of a full build after all ``decisions``; the newest per word counts."""
    last = cut(newest_decisions(decisions, ["pkg"]), "last")
    cased = decisions.where("decision = 'add'").select("pkg", "word", F.lower("word").alias("key"))
    added = cased.join(last.where("decision = 'add'"), ["pkg", "key"], "left_semi").select("pkg", "word")
    before = denied.select("pkg", F.lower("word").alias("key")).join(last, ["pkg", "key"], "left_anti")
    now = before.unionByName(last.where("decision = 'deny'").select("pkg", "key"))
    return words.select("pkg", "word").unionByName(added).distinct(), now.select("pkg", F.col("key").alias("word")).distinct()
