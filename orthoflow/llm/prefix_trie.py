"""Prefix trie of conversations, from sparse-table range minima over sorted longest common prefixes.

Distinct sequences of turns are sorted and dealt in blocks by range.  The longest common prefix (LCP) of
neighbours is kept per block with a sparse table of range minima.  Each candidate prefix, the first ``d``
turns of a sequence, finds the first and last sequence that share it by two binary searches of its own,
without a stack or any other candidate; an interval that leaves its block goes on in the sparse table over
the minima of blocks and ends in an answer that the last block gives for its edge.  Every other figure of a
node is a difference of running sums at the two ends, or a range minimum.

A block has about ``BLOCK_ROWS`` sequences; what every task knows of the other blocks is five numbers each, of
at most ``MAX_BLOCKS`` blocks.  A conversation is one row of 24 bytes a turn.  Copies of a conversation are
one sequence; their ids are joined in pieces before they meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoflow.session import cut

BLOCK_ROWS = 1 << 16
MAX_BLOCKS = 1 << 16
PIECE_IDS = 1_024
HEAD_TURNS = 4
HEAD_GROUP = 20
# Fixed value: what counts as a word.
WORD = r"[^\x20\x09-\x0D]+"
FAR = np.iinfo(np.int64).max
NOTHING = hashlib.sha256(b"")


def sequences(conversations: DataFrame) -> DataFrame:
    """One row per ``conv_id``: ``seq`` with a digest of role and text of each turn, and ``words`` of its text.

    Turns are in order, null first; equal ones by role and digest of the text.  Null role or text is
    empty.  Rows without ``conv_id`` belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    both = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(
        F.col("turn"),
        role.alias("role"),
        F.md5(text).alias("by"),
        F.unhex(F.md5(both)).alias("digest"),
        F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("words"),
    )
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return turns.select("conv_id", F.col("t.digest").alias("seq"), F.col("t.words").alias("words"))


def with_heads_of_groups(rows: DataFrame, group: int = HEAD_GROUP, turns: int = HEAD_TURNS) -> DataFrame:
    """Sequences whose first ``h`` turns are those of the conversation that begins their group of ``group`` ids;
    ``h`` is the crc32 of the id modulo ``turns``.  Both sides are cut there, and neither has to be as long."""
    base = F.col("conv_id") - F.col("conv_id") % group
    heads = rows.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"), *[F.slice(c, 1, turns - 1).alias(f"head_{c}") for c in ("seq", "words")]
    )
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(turns)).cast("int")
    rest = lambda c: F.slice(c, h + 1, F.greatest(F.size(c) - h, F.lit(0)))
    head = lambda c: F.coalesce(F.slice(f"head_{c}", F.lit(1), h), F.slice(c, 1, 0))
    joined = rows.withColumn("base", base).join(heads, "base", "left")
    return joined.select("conv_id", *[F.concat(head(c), rest(c)).alias(c) for c in ("seq", "words")])


def same_sequences(rows: DataFrame) -> DataFrame:
    """Per ``sid``: number of conversations ``n``, the smallest id ``first`` and ``ends``, the SHA-256 of all ids.

    Ids are dealt by range of sequence and id, so those of a frequent sequence lie in many tasks; each joins
    them in pieces of ``PIECE_IDS``, and one task reads the pieces of a sequence in order, one at a time.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            new = np.flatnonzero(batch["sid"] != batch["sid"].shift())
            for a, b in zip(new, [*new[1:], len(batch)]):
                ids = batch["conv_id"].to_numpy()[a:b]
                for i in range(0, len(ids), PIECE_IDS):
                    part = ids[i : i + PIECE_IDS]
                    out.append((batch["sid"].iloc[a], int(part[0]), len(part), ",".join(map(str, part))))
            if out:
                yield pd.DataFrame(out, columns=["sid", "first", "n", "ids"])

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sid, first, n, sha = None, 0, 0, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.sid != sid:
                    if sid is not None:
                        out.append((sid, first, n, sha.digest()))
                    sid, first, n, sha = row.sid, row.first, 0, hashlib.sha256()
                else:
                    sha.update(b",")
                n += row.n
                sha.update(row.ids.encode())
            if out:
                yield pd.DataFrame(out, columns=["sid", "first", "n", "ends"])
        if sid is not None:
            yield pd.DataFrame([(sid, first, n, sha.digest())], columns=["sid", "first", "n", "ends"])

    ids = rows.select("sid", "conv_id")
    dealt = ids.repartitionByRange("sid", "conv_id").sortWithinPartitions("sid", "conv_id")
    parts = dealt.mapInPandas(pieces, "sid string, first long, n long, ids string")
    met = parts.repartition("sid").sortWithinPartitions("sid", "first")
    return met.mapInPandas(ends, "sid string, first long, n long, ends binary")


def common_prefixes(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """LCP of each sequence with the one before it; 0 for the first.  No sequence is empty."""
    lengths = np.diff(offsets)
    depth = np.arange(len(flat)) - np.repeat(offsets[:-1], lengths)
    before = np.concatenate([[0], offsets[:-2]])
    known = depth < np.repeat(np.concatenate([[0], lengths[:-1]]), lengths)
    other = np.where(known, np.repeat(before, lengths) + depth, 0)
    same = known & (flat[other] == flat).all(axis=1)
    longest = np.repeat(lengths, lengths)
    return np.minimum.reduceat(np.where(same, longest, depth), offsets[:-1])


def sparse_table(values: np.ndarray) -> np.ndarray:
    """Row ``k``, place ``i``: the least of ``2**k`` values from ``i`` on (less at the end)."""
    rows = [values]
    while 2 ** len(rows) <= len(values):
        half = 2 ** (len(rows) - 1)
        last = rows[-1]
        rows.append(np.concatenate([np.minimum(last[:-half], last[half:]), last[-half:]]))
    return np.array(rows)


def range_min(table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least value from ``a`` to ``b``; ``FAR`` where that is empty."""
    some = b >= a
    a, b = np.where(some, a, 0), np.where(some, b, 0)
    k = np.floor(np.log2(b - a + 1)).astype(np.int64)
    return np.where(some, np.minimum(table[k, a], table[k, b - 2**k + 1]), FAR)


def left_extent(table: np.ndarray, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Smallest place that all LCPs after it up to ``at`` are at least ``depth``, by binary search."""
    left = at.copy()
    for k in range(len(table) - 1, -1, -1):
        step = 2**k
        can = left >= step
        left = np.where(can & (table[k, np.where(can, left - step + 1, 0)] >= depth), left - step, left)
    return left


def right_extent(table: np.ndarray, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Largest place that all LCPs after ``at`` up to it are at least ``depth``, by binary search."""
    right, last = at.copy(), table.shape[1] - 1
    for k in range(len(table) - 1, -1, -1):
        step = 2**k
        can = right + step <= last
        right = np.where(can & (table[k, np.where(can, right + 1, 0)] >= depth), right + step, right)
    return right


BLOCK = (
    "block int, n long, least_id long, conversations long, words_all long, low long, lcp array<int>, length array<int>, "
    "count array<long>, id array<long>, words array<int>, ends array<binary>, first array<binary>, last array<binary>"
)


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted sequences of a task as one row (``BLOCK``); nothing for a task without sequences."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    column = lambda name: rows.column(name).chunk(0)
    seq = column("seq")
    offsets = seq.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    digests = seq.flatten().to_pylist()
    flat = np.frombuffer(b"".join(digests), dtype=np.uint64).reshape(-1, 2)
    lcp, lengths = common_prefixes(flat, offsets), np.diff(offsets)
    count, ids, words = column("n").to_numpy(), column("first").to_numpy(), column("words").flatten().to_numpy()
    total = np.add.reduceat(words, offsets[:-1]).astype(np.int64)
    low = int(lcp[1:].min()) if len(lcp) > 1 else int(FAR)
    given = [TaskContext.get().partitionId(), len(lcp), int(ids.min()), int(count.sum()), int((count * total).sum()), low]
    given += [lcp, lengths, count, ids, words, column("ends").to_pylist(), digests[: lengths[0]], digests[-lengths[-1] :]]
    kinds = [pa.int32(), *[pa.int64()] * 5, *[pa.list_(t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())]]
    kinds += [pa.list_(pa.binary())] * 3
    names = [c.split()[0] for c in BLOCK.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(given, kinds)], names)


@dataclass(frozen=True)
class Blocks:
    """What every task knows of all blocks with sequences, in order: their numbers, the LCP at their first
    sequence (``edge``, with a 0 after the last), the least LCP inside, and the smallest id."""

    block: np.ndarray
    edge: np.ndarray
    low: np.ndarray
    least_id: np.ndarray

    def rank(self, block: int) -> int:
        return int(np.searchsorted(self.block, block))

    def last_of(self, start: int, depth: np.ndarray) -> np.ndarray:
        """Rank of the block in which prefixes of ``depth`` end that come in at the left edge of block ``start``."""
        beyond = np.minimum(self.low, self.edge[1:])
        return self._search(beyond, np.full(len(depth), start), depth)

    def first_of(self, start: int, depth: np.ndarray) -> np.ndarray:
        """The same to the left: where prefixes begin that come in at the right edge of block ``start``."""
        beyond = np.minimum(self.low, self.edge[:-1])[::-1]
        return len(beyond) - 1 - self._search(beyond, np.full(len(depth), len(beyond) - 1 - start), depth)

    @staticmethod
    def _search(beyond: np.ndarray, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """First place from ``at`` on whose value is less than ``depth``; the last value is 0."""
        table = sparse_table(beyond)
        for k in range(len(table) - 1, -1, -1):
            can = at + 2**k <= len(beyond) - 1
            at = np.where(can & (table[k, np.where(can, at, 0)] >= depth), at + 2**k, at)
        return at


class Block:
    """Arrays of one block, with running sums over its sequences and sparse tables."""

    def __init__(self, row: dict, blocks: Blocks):
        self.rank = blocks.rank(row["block"])
        self.edge, self.next_edge = int(blocks.edge[self.rank]), int(blocks.edge[self.rank + 1])
        self.lcp, self.length = row["lcp"].astype(np.int64), row["length"].astype(np.int64)
        self.n = len(self.lcp)
        self.lcp[0] = self.edge
        self.count, self.id = row["count"], row["id"]
        self.start = np.cumsum([0, *self.length])
        self.before = np.concatenate([[0], np.cumsum(row["words"], dtype=np.int64)])
        self.total = self.before[self.start[1:]] - self.before[self.start[:-1]]
        self.leaf = (np.append(self.lcp[1:], self.next_edge) < self.length).astype(np.int64)
        self.own_words = self.total - self.words_to(np.arange(self.n), self.lcp)
        self.lcps, self.ids = sparse_table(self.lcp), sparse_table(self.id)

    def words_to(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Words of the first ``depth`` turns of the sequences ``at``."""
        return self.before[self.start[at] + depth] - self.before[self.start[at]]

    def sums(self) -> np.ndarray:
        """Running sums up to each sequence: conversations, their words, words of new nodes, leaves."""
        return np.cumsum([self.count, self.count * self.total, self.own_words, self.leaf], axis=1)


EDGES = "kind string, block int, depth long, idx long, s0 long, s1 long, s2 long, s3 long, id long"


def edge_answers(block: Block, number: int) -> list[tuple]:
    """Where prefixes end that come in over the left edge of a block (R), with the sums up to there, and where
    they begin that come in over its right edge (L); and the sums of the whole block (S)."""
    sums, last = block.sums(), block.n - 1
    out = [("S", number, 0, last, *map(int, sums[:, last]), int(block.id.min()))]
    depth = np.arange(1, block.edge + 1)
    right = right_extent(block.lcps, np.zeros(len(depth), np.int64), depth)
    least = range_min(block.ids, np.zeros(len(depth), np.int64), right)
    out += [("R", number, int(d), int(r), *map(int, sums[:, r]), int(i)) for d, r, i in zip(depth, right, least)]
    depth = np.arange(1, block.next_edge + 1)
    end = np.full(len(depth), last)
    left = left_extent(block.lcps, end, depth)
    least = range_min(block.ids, left, end)
    return out + [("L", number, int(d), int(x), 0, 0, 0, 0, int(i)) for d, x, i in zip(depth, left, least)]


NODES = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "block long, idx long, parent_block long, parent_idx long"
)


def block_nodes(block: Block, ends: list[bytes], blocks: Blocks, offsets: np.ndarray, met: dict[str, np.ndarray], root_id: int) -> list[np.ndarray]:
    """Columns of ``NODES`` for the prefixes that begin in a block.

    Candidates are all prefixes of all its sequences; those that begin further left are of another
    sequence or block.  ``met`` has the answers of other blocks for this block's edges, by depth.
    """
    at = np.repeat(np.arange(block.n), block.length)
    depth = np.arange(len(at)) - block.start[at] + 1
    left = left_extent(block.lcps, at, depth)
    own = (left == at) & ~((at == 0) & (depth <= block.edge))
    at, depth = at[own], depth[own]
    ids = sparse_table(blocks.least_id)
    sums = np.concatenate([np.zeros((4, 1), np.int64), block.sums()], axis=1) + offsets[:, block.rank : block.rank + 1]

    def reach(low: np.ndarray, high: np.ndarray, depth: np.ndarray):
        """Where the intervals around these places begin, their sums at the end, and their smallest id."""
        out_right = (high == block.n - 1) & (depth <= block.next_edge)
        out_left = (low == 0) & (depth <= block.edge)
        least, end = range_min(block.ids, low, high), sums[:, high + 1]
        begin_block, begin = np.full(len(low), block.rank), low.copy()
        j = np.flatnonzero(out_right)
        if len(j):
            r = met["R"][:, depth[j] - 1]
            end[:, j] = r[2:6] + offsets[:, r[0]]
            between = range_min(ids, np.full(len(j), block.rank + 1), r[0] - 1)
            least[j] = np.minimum(np.minimum(least[j], between), r[6])
        j = np.flatnonzero(out_left)
        if len(j):
            x = met["L"][:, depth[j] - 1]
            begin_block[j], begin[j] = x[0], x[1]
            between = range_min(ids, x[0] + 1, np.full(len(j), block.rank - 1))
            least[j] = np.minimum(np.minimum(least[j], between), x[6])
        return begin_block, begin, end, least

    _, _, end, least = reach(at, right_extent(block.lcps, at, depth), depth)
    n_convs, all_words, new_words, leaves = end - sums[:, at]
    up = np.maximum(depth - 1, 0)
    parent_block, parent_idx, _, parent_id = reach(
        left_extent(block.lcps, at, up), right_extent(block.lcps, at, up), np.where(up == 0, FAR, up)
    )
    root = up == 0
    before = block.words_to(at, up)
    first_words = block.own_words[at] - (block.total[at] - before)
    saved = all_words - n_convs * before - (new_words - first_words)
    nothing = NOTHING.hexdigest()
    sha = [ends[i].hex() if d == n else nothing for i, d, n in zip(at, depth, block.length[at])]
    return [
        least, depth, np.where(root, root_id, parent_id), n_convs, leaves, saved, sha,
        np.full(len(at), block.rank), at, np.where(root, -1, parent_block), np.where(root, -1, parent_idx),
    ]


def _row(batch: pa.RecordBatch, i: int) -> dict:
    arrays = {c: batch.column(c)[i].values.to_numpy() for c in ("lcp", "length", "count", "id", "words")}
    return {"block": batch.column("block")[i].as_py(), **arrays}


def prefix_trie(rows: DataFrame, block_rows_most: int = BLOCK_ROWS) -> DataFrame:
    """Every distinct prefix of ``rows`` (``conv_id``, ``seq``, ``words``), from the root that has no turn.

    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.  A conversation without turns is a
    member of the root.  Without conversations there are no nodes.
    """
    spark = rows.sparkSession
    sid = F.md5(F.array_join(F.transform("seq", lambda d: F.hex(d)), "")).alias("sid")
    stored = cut(rows.select("conv_id", "seq", "words", sid), "sequences")
    same = cut(same_sequences(stored), "same")
    none = hashlib.md5(b"").hexdigest()
    turnless = same.where(F.col("sid") == none).collect()
    distinct = stored.where(F.size("seq") > 0).withColumnRenamed("conv_id", "first").join(same, ["sid", "first"])
    n = same.count()
    if not n:
        return spark.createDataFrame([], RESULT)
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // block_rows_most))
    ordered = distinct.select("seq", "words", "n", "first", "ends").repartitionByRange(min(wanted, MAX_BLOCKS), "seq")
    stored_blocks = cut(ordered.sortWithinPartitions("seq").mapInArrow(block_rows, BLOCK), "blocks")

    known = sorted(stored_blocks.select("block", "low", "least_id").collect())
    place = np.array([r["block"] for r in known], dtype=np.int64)
    pairs = [(int(b), int(a)) for a, b in zip(place, place[1:])]
    differs = F.zip_with("first", "last", lambda a, b: F.coalesce(a == b, F.lit(False)))
    neighbours = (
        spark.createDataFrame(pairs, "block int, before int")
        .join(stored_blocks.select("block", "first"), "block")
        .join(stored_blocks.select(F.col("block").alias("before"), "last"), "before")
    )
    edges = {r["block"]: r["e"] for r in neighbours.select("block", (F.array_position(differs, F.lit(False)) - 1).alias("e")).collect()}
    edge = np.array([*[edges.get(int(b), 0) for b in place], 0], dtype=np.int64)
    blocks = Blocks(place, edge, np.array([r["low"] for r in known], np.int64), np.array([r["least_id"] for r in known], np.int64))
    shared = spark.sparkContext.broadcast(blocks)

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = _row(batch, i)
                columns = list(zip(*edge_answers(Block(row, shared.value), row["block"])))
                yield pa.RecordBatch.from_arrays([pa.array(c) if j != 1 else pa.array(c, pa.int32()) for j, c in enumerate(columns)], [c.split()[0] for c in EDGES.split(", ")])

    arrays = ["block", "lcp", "length", "count", "id", "words"]
    answered = cut(stored_blocks.select(*arrays).mapInArrow(answers, EDGES), "edges")
    whole = {r["block"]: r for r in answered.where("kind = 'S'").collect()}
    sums = np.array([[whole[int(b)][f"s{j}"] for b in place] for j in range(4)], dtype=np.int64).reshape(4, -1)
    offsets = np.concatenate([np.zeros((4, 1), np.int64), np.cumsum(sums, axis=1)], axis=1)

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = shared.value
        for batch in batches:
            for number in batch["block"]:
                r = b.rank(number)
                ahead, behind = np.arange(1, b.edge[r + 1] + 1), np.arange(1, b.edge[r] + 1)
                to = [*b.last_of(r + 1, ahead)] if len(ahead) else []
                back = [*b.first_of(r - 1, behind)] if len(behind) else []
                if to or back:
                    yield pd.DataFrame({
                        "asking": number,
                        "kind": ["R"] * len(to) + ["L"] * len(back),
                        "block": b.block[np.array(to + back, dtype=np.int64)],
                        "rank": np.array(to + back, dtype=np.int64),
                        "depth": np.concatenate([ahead, behind]),
                    })

    questions = stored_blocks.select("block").mapInPandas(asked, "asking int, kind string, block int, rank long, depth long")
    given = F.struct("kind", "depth", "rank", "idx", "s0", "s1", "s2", "s3", "id")
    met = questions.join(answered, ["kind", "block", "depth"]).groupBy(F.col("asking").alias("block")).agg(
        F.sort_array(F.collect_list(given)).alias("met")
    )
    smallest = min([*[int(i) for i in blocks.least_id], *[r["first"] for r in turnless]])

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = batch.column("met")[i].as_py() or []
                by = {k: np.array([[m[c] for m in found if m["kind"] == k] for c in ("rank", "idx", "s0", "s1", "s2", "s3", "id")], np.int64) for k in "RL"}
                ends = batch.column("ends")[i].as_py()
                columns = block_nodes(Block(_row(batch, i), shared.value), ends, shared.value, offsets, by, smallest)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in NODES.split(", ")])

    inner = stored_blocks.select(*arrays, "ends").join(met, "block", "left").mapInArrow(nodes, NODES)
    conversations, words, new_words, leaves = (int(x) for x in offsets[:, -1])
    at_root = turnless[0] if turnless else None
    sha = bytes(at_root["ends"]).hex() if at_root else NOTHING.hexdigest()
    top = (smallest, 0, None, conversations + (at_root["n"] if at_root else 0), max(1, leaves), words - new_words, sha, -1, -1, -2, -2)
    all_nodes = cut(inner.unionByName(spark.createDataFrame([top], NODES)), "nodes")
    children = all_nodes.groupBy(
        F.col("parent_block").alias("block"), F.col("parent_idx").alias("idx"), (F.col("depth") - 1).alias("depth")
    ).agg(F.count(F.lit(1)).alias("n_children"))
    joined = all_nodes.join(children, ["block", "idx", "depth"], "left")
    return joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves", "saved_tokens", "ends_sha256",
    )


RESULT = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
)
