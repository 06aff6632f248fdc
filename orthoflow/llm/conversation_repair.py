"""Repair of damaged conversations by the cheapest edits.

The faults of a conversation's rows are found by Spark, one byte a row then goes through a dynamic programme
over four states (nothing yet, system, user, assistant).  Backward cost vectors are kept at every
``sqrt(n)``-th row only; walking forward, the vectors of one block are computed again, and of all edits
that are still cheapest the ASCII-least is taken.  Rows are sorted and read one batch at a time, so a task
holds one byte a row of the conversation it is in, and never its texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthoflow.session import cut

# What damages a row, its faults, and what edits cost.
DAMAGE_OF = 20
DROPPED, EMPTIED, UNENDED, REPEATED, AS_USER = range(5)
MARKS = "[.!?]"
SOLID = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
OTHER = 0
NEXT = (USER, USER, ASSISTANT, USER)  # the role that may follow, for Rerole and Insert
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))
ENDLESS = 1 << 60


def conversation_key() -> Column:
    """``conv_id`` as text; a null id, one space, is an id like others."""
    return F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """``conv``, ``turn``, ``role`` and ``text`` of the rows after damage chosen by the crc32 of ``conv_id:turn``.

    Null role or text is one space; in the crc32 a null turn or id is one space.  A repeated row is there
    twice, with the same turn.
    """
    turn = F.coalesce(F.col("turn").cast("string"), F.lit(" "))
    hit = F.pmod(F.crc32(F.concat(conversation_key(), F.lit(":"), turn)), F.lit(DAMAGE_OF))
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = conversations.select(
        conversation_key().alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.when(hit == AS_USER, F.lit("user")).otherwise(role).alias("role"),
        F.when(hit == EMPTIED, F.lit("")).when(hit == UNENDED, F.regexp_replace(text, MARKS, "")).otherwise(text).alias("text"),
        F.when(hit == DROPPED, 0).when(hit == REPEATED, 2).otherwise(1).alias("times"),
    )
    return rows.select("conv", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("col")


def row_codes(rows: DataFrame) -> DataFrame:
    """Without its text, each row's place in the order (``turn``, ``role``, ``by``, ``nth``) and its ``code``: the
    first fault of the row and four times its kind of role.

    The order is by turn, null first; rows of the same turn are ordered by role and a digest of the text.
    """
    light = rows.select(
        "conv",
        "turn",
        "role",
        F.md5("text").alias("by"),
        (~F.rlike("text", F.lit(SOLID))).alias("blank"),
        (~F.rlike("text", F.lit(ENDED))).alias("open"),
    )
    same = Window.partitionBy("conv", "role", "by").orderBy("turn")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    fault = F.when(F.col("blank"), BLANK).when(F.col("nth") > 1, DUPLICATE).when(F.col("open"), TRUNCATED).otherwise(FINE)
    return light.withColumn("nth", F.row_number().over(same)).select(
        "conv", "turn", "role", "by", "nth", (kind * 4 + fault).cast("int").alias("code")
    )


def _closed(v: list[int]) -> list[int]:
    """Costs with insertions before the next row."""
    user, assistant = min(v[USER], INSERT + v[ASSISTANT]), min(v[ASSISTANT], INSERT + v[USER])
    return [min(v[NOTHING], INSERT + user), min(v[SYSTEM], INSERT + user), user, assistant]


def _row_edits(code: int, state: int) -> list[tuple[str, int, int]]:
    """Edits of a row in a state, ASCII-least first: letter, cost, state after it."""
    kind, fault = divmod(code, 4)
    edits = [("D", DELETE, state)]
    if fault in (FINE, TRUNCATED):
        more = UNFINISHED if fault == TRUNCATED else 0
        if kind == NEXT[state] or (kind == SYSTEM and state == NOTHING):
            edits.append(("K", KEEP + more, kind))
        edits.append(("R", REROLE + more, NEXT[state]))
    return edits


EDITS = [[_row_edits(code, state) for state in range(4)] for code in range(16)]
END = _closed([0, ENDLESS, ENDLESS, 0])


def _back(v: list[int], code: int) -> list[int]:
    """Least costs from before a row, from those after it."""
    return _closed([min(cost + v[to] for _, cost, to in edits) for edits in EDITS[code]])


def cheapest_edits(codes: bytes) -> tuple[int, str]:
    """Least cost and the ASCII-least of the cheapest edits, with cost vectors of about 2 sqrt(n) rows held."""
    n = len(codes)
    size = max(1, math.isqrt(n))
    held, v = {n: END}, END
    for i in range(n - 1, -1, -1):
        v = _back(v, codes[i])
        if i % size == 0:
            held[i] = v
    cost, state, out = v[NOTHING], NOTHING, bytearray()
    for start in range(0, n, size):
        stop = min(n, start + size)
        block = [held[stop]]
        for i in range(stop - 1, start - 1, -1):
            block.append(_back(block[-1], codes[i]))
        block.reverse()
        for i in range(start, stop):
            here, after = block[i - start], block[i - start + 1]
            while True:
                letter, to = _tight(EDITS[codes[i]][state], here, after, state)
                out += letter.encode()
                state = to
                if letter != "I":
                    break
    while END[state]:
        out += b"I"
        state = NEXT[state]
    return cost, out.decode()


def _tight(edits: list[tuple[str, int, int]], here: list[int], after: list[int], state: int) -> tuple[str, int]:
    """The ASCII-least edit that keeps to the least cost: D, then I, K and R."""
    for letter, cost, to in edits:
        if letter != "D" and INSERT + here[NEXT[state]] == here[state]:
            return "I", NEXT[state]
        if cost + after[to] == here[state]:
            return letter, to
    return "I", NEXT[state]


def repaired(roles: list[str], letters: str, state: int) -> tuple[list[tuple[str, int, str]], int]:
    """New role, place of the row (-1: inserted) and edit, for rows that are not deleted; and the state after them."""
    out, row = [], 0
    for letter in letters:
        if letter == "D":
            row += 1
            continue
        if letter == "K":
            role, state = roles[row], {"s": SYSTEM, "u": USER, "a": ASSISTANT}[roles[row][0]]
        else:
            state = NEXT[state]
            role = ROLES[state]
        out.append((role, -1 if letter == "I" else row, letter))
        row += letter != "I"
    return out, state


class _Conversation:
    """What is held of the conversation that a task is in."""

    def __init__(self, conv: str):
        self.conv, self.codes = conv, bytearray()
        self.low = self.high = None
        self.turns = 0

    def add(self, codes: np.ndarray, turns: np.ndarray) -> None:
        self.codes += codes.astype(np.uint8).tobytes()
        if len(turns):
            self.turns += int((np.diff(turns) != 0).sum()) + (self.high is None or int(turns[0]) != self.high)
            self.low = int(turns[0]) if self.low is None else self.low
            self.high = int(turns[-1])

    def row(self) -> tuple:
        codes = np.frombuffer(bytes(self.codes), np.uint8)
        kinds, faults = codes // 4, codes % 4
        pairs = np.zeros(max(0, len(codes) - 1), dtype=bool)
        for a, b in LEGAL:
            pairs |= (kinds[:-1] == a) & (kinds[1:] == b)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        counts = [int((faults == f).sum()) for f in (BLANK, DUPLICATE, TRUNCATED)]
        return (self.conv, gaps, *counts, int((~pairs).sum()), *cheapest_edits(bytes(self.codes)))


PLAN = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def repair_plans(rows: DataFrame) -> DataFrame:
    """Faults and cheapest edits (``PLAN``) of each conversation in ``rows`` (``conv``, ``turn``, ``role``, ``text``)."""

    def planned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for batch in batches:
            out = []
            conv, code = batch["conv"].to_numpy(), batch["code"].to_numpy()
            turn, some = batch["turn"].to_numpy(), batch["dated"].to_numpy()
            new = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]])) if len(conv) else []
            for a, b in zip(new, [*new[1:], len(conv)]):
                if now is None or now.conv != conv[a]:
                    if now is not None:
                        out.append(now.row())
                    now = _Conversation(conv[a])
                now.add(code[a:b], turn[a:b][some[a:b]])
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in PLAN.split(", ")])
        if now is not None:
            yield pd.DataFrame([now.row()], columns=[c.split()[0] for c in PLAN.split(", ")])

    ordered = row_codes(rows).repartition("conv").sortWithinPartitions("conv", "turn", "role", "by", "nth")
    turns = ordered.select("conv", F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNotNull().alias("dated"), "code")
    return turns.mapInPandas(planned, PLAN)


def repaired_rows(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Rows after repair: ``conv``, ``place`` from 0 on, ``role``, ``text`` and ``edit`` (K, R or I).

    Each plan is sorted before the rows of its conversation, so edits are applied while rows pass by; in
    every partition the rows of a conversation are together and in order.
    """
    parts = rows.select("conv", F.lit(1).alias("kind"), "turn", "role", F.md5("text").alias("by"), "text")
    empty = F.lit("")
    heads = plans.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.col("audit").alias("role"), empty.alias("by"), empty.alias("text"))
    ordered = heads.unionByName(parts).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "by")

    def applied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        audit, last, at, state, place = "", 0, 0, NOTHING, 0
        for batch in batches:
            out = []
            for conv, kind, role, text in zip(batch["conv"], batch["kind"], batch["role"], batch["text"]):
                if kind == 0:
                    audit, last, at, state, place = role, len(role.rstrip("I")), 0, NOTHING, 0
                    continue
                stop = at + 1
                while audit[stop - 1] == "I":
                    stop += 1
                if stop == last:
                    stop = len(audit)  # insertions after the last row
                letters, at = audit[at:stop], stop
                done, state = repaired([role], letters, state)
                for new, row, edit in done:
                    out.append((conv, place, new, "" if row < 0 else text, edit))
                    place += 1
            if out:
                yield pd.DataFrame(out, columns=["conv", "place", "role", "text", "edit"])

    return ordered.select("conv", "kind", "role", "text").mapInPandas(applied, "conv string, place long, role string, text string, edit string")


def repaired_digests(repaired: DataFrame) -> DataFrame:
    """SHA-256 of the ``role:text`` lines of each conversation in :func:`repaired_rows`, read as they pass by."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sha = None, None
        for batch in batches:
            out = []
            for conv, role, text in zip(batch["conv"], batch["role"], batch["text"]):
                if conv != now:
                    if now is not None:
                        out.append((now, sha.hexdigest()))
                    now, sha = conv, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            if out:
                yield pd.DataFrame(out, columns=["conv", "sha256"])
        if now is not None:
            yield pd.DataFrame([(now, sha.hexdigest())], columns=["conv", "sha256"])

    return repaired.select("conv", "role", "text").mapInPandas(hashed, "conv string, sha256 string")


def repair_report(conversations: DataFrame) -> DataFrame:
    """One row per original ``conv_id``: faults after :func:`damage`, cost and letters of the repair, its digest.

    A conversation that lost all its rows has zeros, no letters and the digest of nothing; an empty table
    has no rows.  Other columns are not read.
    """
    rows = damage(conversations)
    plans = cut(repair_plans(rows), "plans")
    digests = repaired_digests(repaired_rows(rows, plans))
    ids = conversations.groupBy("conv_id").agg(F.count(F.lit(1))).select("conv_id", conversation_key().alias("conv"))
    zero, none = F.lit(0).cast("long"), F.lit(hashlib.sha256(b"").hexdigest())
    return ids.join(plans, "conv", "left").join(digests, "conv", "left").select(
        "conv_id",
        *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", none).alias("repaired_sha256"),
    )
