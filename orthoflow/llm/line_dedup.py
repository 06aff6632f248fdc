"""Line dedup by a log-template tree of fixed depth: recurring templates across documents are dropped."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain, combinations
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoflow.llm.common import fresh, lookup
from orthoflow.operators.prefilter import key_filter
from orthoflow.session import cut

DEPTHS = (4, 8)
SEGMENTS = 4
PARTS, LEFT_OUT = 8, 3
MIN_WORDS = 5
MIN_TEMPLATE_WORDS = 10
MIN_CONSTANT = 0.6
BELOW_ANY_ID = -(2**63)
VARIABLE, MIXER = np.uint64(0x2A), np.uint64(0x9E3779B97F4A7C15)
BLANKS = " \t\r\f"
BLOCK_BYTES = 1 << 17


def mix(h: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit numbers (multiply and shift)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, kept up to the largest size asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 1 << 17)
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, self.base, np.uint64)]))
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, self.inverse, np.uint64)]))
        return self.up, self.down


class Sums:
    """Hashes of any run of a sequence of numbers, from running sums of the numbers times powers."""

    def __init__(self, values: np.ndarray, powers: Powers):
        up, self.down = powers.to(len(values))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(values.astype(np.uint64) * up[: len(values)])])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64) * MIXER)


BYTE_POWERS, WORD_POWERS = Powers(0x100000001B3), Powers(0x9E3779B97F4A7C15)
_KIND = np.zeros(256, np.uint8)
_KIND[[*BLANKS.encode()]] = 1
_KIND[10] = 1
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[[*b"0123456789"]] = True


def parsed(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The lines of at least ``MIN_WORDS`` words of ``texts``, by text (``doc``) and place (``pos``), with their hashes.

    Words stand between blanks, and one with a digit is a variable field.  ``k0``, ``k1`` and ``line`` are the keys of
    the line's nodes: number of words and first ``DEPTHS`` words, or all; ``p0``.. the ``PARTS`` parts after the first
    node's words, and ``s0``.. the ``SEGMENTS`` after the second's.  Short lines have no first and second node.
    """
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    apart = _KIND[data] != 0
    before = np.concatenate([[True], apart[:-1]])
    begins = np.flatnonzero(before & ~apart)
    ends = np.flatnonzero(apart & ~before)
    words = Sums(data, BYTE_POWERS).of(begins, ends)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    words[digits[ends] > digits[begins]] = VARIABLE
    breaks = np.flatnonzero(data == 10)
    first = np.searchsorted(begins, np.concatenate([[0], breaks[:-1] + 1]))
    n = np.searchsorted(begins, breaks) - first
    lines = np.cumsum([0, *[t.count(b"\n") + 1 for t in texts]])
    kept = np.flatnonzero(n >= MIN_WORDS)
    doc = np.searchsorted(lines, kept, "right") - 1
    n, a = n[kept], first[kept]
    sums = Sums(words, WORD_POWERS)
    size = n.astype(np.uint64) * MIXER
    key = lambda level, depth: mix(sums.of(a, a + depth) ^ (size + np.uint64(level))).view(np.int64)
    out = {"doc": doc, "pos": (kept - lines[doc]).astype(np.int32), "n": n.astype(np.int32), "line": key(len(DEPTHS), n)}
    out |= {f"k{i}": key(i, np.minimum(d, n)) for i, d in enumerate(DEPTHS)}
    for name, depth, count in (("p", DEPTHS[0], PARTS), ("s", DEPTHS[1], SEGMENTS)):
        rest = np.maximum(n - depth, 0)
        cuts = [np.minimum(a + depth, a + n) + rest * j // count for j in range(count + 1)]
        out |= {f"{name}{j}": sums.of(x, y).astype(np.uint32).view(np.int32) for j, (x, y) in enumerate(zip(cuts, cuts[1:]))}
    return out


PARTS_OF = [f"p{j}" for j in range(PARTS)]
SEGMENTS_OF = [f"s{j}" for j in range(SEGMENTS)]
LINES = "id long, mark long, pos int, n int, line long, " + ", ".join(
    [*[f"k{i} long" for i in range(len(DEPTHS))], *[f"{c} int" for c in (*PARTS_OF, *SEGMENTS_OF)]]
)


def parsed_lines(docs: DataFrame) -> DataFrame:
    """``LINES`` of ``docs`` (``id``, ``mark``, ``text``), each word hashed once; short lines have null keys."""
    names = [c.split()[0] for c in LINES.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = (batch.column(i).to_numpy() for i in range(2))
            texts, at = batch.column(2).to_pylist(), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (size < BLOCK_BYTES or end == at):
                    size += len(texts[end])
                    end += 1
                found = parsed(texts[at:end])
                doc, short = found["doc"] + at, found["n"] < MIN_TEMPLATE_WORDS
                found |= {"id": ids[doc], "mark": marks[doc]}
                yield pa.RecordBatch.from_arrays([pa.array(found[c], mask=short if c in KEYS else None) for c in names], names)
                at = end

    return docs.select("id", "mark", F.col("text").cast("binary").alias("text")).mapInArrow(rows, LINES)


KEYS = [f"k{i}" for i in range(len(DEPTHS))]


def distinct_lines(lines: DataFrame) -> DataFrame:
    """One row per masked line: smallest and largest id (``own``, ``last``), and its keys and parts; stored."""
    rest = [F.min(c).alias(c) for c in ("n", *KEYS, *PARTS_OF, *SEGMENTS_OF)]
    return cut(lines.groupBy("line").agg(F.min("id").alias("own"), F.max("id").alias("last"), *rest), "distinct")


def _recurring(lines: DataFrame, level: int, key: str, fields: list[list[str]], depth: int) -> DataFrame:
    """Nodes of one level with lines of two documents or more, whose template is constant enough."""
    figures = [F.min("own").alias("first"), F.max("last").alias("last"), F.max("n").alias("n")]
    for c in chain.from_iterable(fields):
        figures += [F.min(c).alias(f"low_{c}"), F.max(c).alias(f"high_{c}")]
    nodes = lines.where(F.col(key).isNotNull()).groupBy(key).agg(*figures).where("first < last")
    rest, variable = F.col("n") - depth, F.lit(0)
    for j, cs in enumerate(fields):
        differs = reduce(or_, [F.col(f"low_{c}") != F.col(f"high_{c}") for c in cs])
        words = F.floor(rest * (j + 1) / len(fields)) - F.floor(rest * j / len(fields))
        variable = variable + F.when(differs, words).otherwise(0)
    constant = nodes.where(F.col("n") - variable >= MIN_CONSTANT * F.col("n"))
    return constant.select(F.lit(level).alias("level"), F.col(key).alias("key"), "first")


def recurring_templates(lines: DataFrame) -> DataFrame:
    """``level``, ``key`` and the ``first`` document of each node of distinct ``lines`` whose template recurs across documents.

    A node is a number of words and the first ``depth`` words.  The rest of its lines is cut in ``SEGMENTS`` parts of
    words, and one that differs among them is a variable field of the node's template; the node counts only if at
    least ``MIN_CONSTANT`` of its words are constant.  The last level has all words.  All figures are minima
    and maxima, so they have partial results on the map side, however many lines a node has.
    """
    half = PARTS // SEGMENTS
    found = [
        _recurring(lines, 0, "k0", [PARTS_OF[j * half : (j + 1) * half] for j in range(SEGMENTS)], DEPTHS[0]),
        _recurring(lines, 1, "k1", [[c] for c in SEGMENTS_OF], DEPTHS[1]),
        _recurring(lines, 2, "line", [], 0),
    ]
    return reduce(DataFrame.union, found)


def recurring_passages(lines: DataFrame) -> DataFrame:
    """``level`` (the last), ``key`` and ``first`` document of distinct masked ``lines`` that others nearly equal.

    Lines of a first-level node are near if they differ in ``LEFT_OUT`` of their ``PARTS`` parts at most, so in
    any ``LEFT_OUT`` words after the leading ones, and always at least ``MIN_CONSTANT`` of the words are
    equal.  Each distinct line has one key for every choice of parts left out, and ``first`` is the smallest id
    of all lines that share a key with it.  Any number of templates can be in a node; only nodes with
    different lines from different documents are looked at, and all figures are minima.
    """
    top = lines.where("k0 is not null").select("line", "own", "last", "k0", *PARTS_OF)
    nodes = top.groupBy("k0").agg(F.min("own").alias("low"), F.max("last").alias("high"), F.count(F.lit(1)).alias("n"))
    nodes = cut(nodes.where("low < high and n > 1").select("k0"), "nodes")
    asked = lookup(top, nodes, ["k0"], "inner")
    kept = list(combinations(PARTS_OF, PARTS - LEFT_OUT))
    keys = F.array(*[F.xxhash64("k0", F.lit(k), *cs) for k, cs in enumerate(kept)])
    keyed = cut(asked.select("line", "own", F.explode(keys).alias("passage")), "passages")
    shared = keyed.groupBy("passage").agg(F.min("own").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = cut(shared.where("n > 1").drop("n"), "shared")
    wanted = key_filter(shared, "passage").keep(keyed.select("line", "passage"), "passage")
    met = lookup(cut(wanted, "wanted"), shared, ["passage"], "inner")
    return met.groupBy("line").agg(F.min("first").alias("first")).select(
        F.lit(len(DEPTHS)).alias("level"), F.col("line").alias("key"), "first"
    )


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passages: bool = True) -> DataFrame:
    """``id``, ``mark`` and the sorted positions ``dropped`` of the lines to drop, for documents with any.

    A line goes if a node on its path, or with ``passages`` a near line, recurs with a smaller id.  ``mark`` is a
    hash of the text: rows that share an id are one document for counting, but each text has its own positions.
    Lines without a recurring node leave next to the scan, by a Bloom filter of these nodes.
    """
    keyed = docs.select(
        F.coalesce(F.col(id_col), F.lit(BELOW_ANY_ID)).alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    lines = cut(parsed_lines(keyed), "lines")
    distinct = distinct_lines(lines)
    recurring = recurring_templates(distinct)
    if passages:
        recurring = recurring.union(recurring_passages(distinct))
    recurring = cut(recurring.groupBy("level", "key").agg(F.min("first").alias("first")), "templates")
    nodes = F.array(*[F.struct(F.lit(i).alias("level"), F.col(c).alias("key")) for i, c in enumerate((*KEYS, "line"))])
    paths = lines.select("id", "mark", "pos", F.explode(nodes).alias("node")).select("id", "mark", "pos", "node.level", "node.key")
    asked = cut(key_filter(recurring).keep(paths.where("key is not null"), "key"), "paths")
    met = lookup(asked, recurring, ["level", "key"], "inner")
    judged = met.repartition("id", "mark").groupBy("id", "mark", "pos").agg(F.max(F.expr("first < id")).alias("v")).where("v")
    return judged.groupBy("id", "mark").agg(F.sort_array(F.collect_list("pos")).alias("dropped"))


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dropped_col: str = "dropped_lines", passages: bool = True
) -> DataFrame:
    """``docs`` with recurring lines taken out of the text, and their positions in ``dropped_col``.

    Lines are parsed by a tree of fixed depth: number of words, then the leading words, words with a
    digit being a variable field.  Lines of a node whose other words are mostly constant share a template
    whose differing parts are variable fields.  A template that occurs in two documents or more recurs: its
    lines stay in the document with the smallest id and are dropped in all others, so that each text is
    kept once.  Lines of fewer than ``MIN_WORDS`` words stay, and lines of fewer than
    ``MIN_TEMPLATE_WORDS`` words recur only as they are.  Such a node has one template; with ``passages`` lines
    of a node are also compared with each other (:func:`recurring_passages`).

    Null and empty texts have no lines to drop and stay null or empty; a text that loses all lines becomes
    empty.  A null id is smaller than every other; rows that share an id count as one document, so
    repeated rows alone do not make a line recur.  Other columns are kept, whatever their names; a column
    called ``dropped_col`` is replaced.  An empty table gives an empty result.
    """
    own_id, mark, positions = fresh(docs.columns, "id", "mark", "dropped")
    verdicts = dropped_lines(docs, id_col, text_col, passages).toDF(own_id, mark, positions)
    keyed = docs.withColumns(
        {
            own_id: F.coalesce(F.col(id_col), F.lit(BELOW_ANY_ID)),
            mark: F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))),
        }
    )
    met = keyed.join(verdicts, [own_id, mark], "left")
    lines = F.split(F.col(text_col), "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(positions))
    rest = F.transform(F.array(lines), lambda ls: F.array_join(F.transform(stay, lambda i: F.get(ls, i)), "\n"))[0]
    no_lines = F.array().cast("array<int>")
    return met.withColumns(
        {
            text_col: F.when(F.col(positions).isNull(), F.col(text_col)).otherwise(rest),
            dropped_col: F.coalesce(F.col(positions), no_lines),
        }
    ).select(*[F.col(f"`{c}`") for c in docs.columns if c != dropped_col], F.col(dropped_col))
