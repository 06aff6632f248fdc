"""Prefix trie and repair of conversations against brute force and SQL."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from compare import compare, connect

from orthoflow.llm import conversation_repair as repair
from orthoflow.llm import prefix_trie as trie
from orthoflow.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(text):
    return zlib.crc32(text.encode())


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_conversation_repair"])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_queries_against_sql(spark, name, sf):
    folder = f"/root/testdata/{sf}"
    assert compare(queries.QUERIES[name](spark, folder), connect(folder), queries.SQL[name]) == ""


# trie


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.md5((r[3] or "").encode()).hexdigest()))


def brute_trie(rows):
    """Nodes by walking every rebuilt conversation."""
    turns = {}
    for r in in_order([r for r in rows if r[0] is not None]):
        turns.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    members, parts = {}, {}
    for c in turns:
        h = crc(str(c)) % 4
        base = c - int(np.fmod(c, 20))
        seq = tuple(turns.get(base, [])[:h] + turns[c][h:])
        parts[c] = seq
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    words = lambda seq: len(re.findall(r"[^\x20\x09-\x0D]+", seq[-1][1])) if seq else 0
    out = []
    for seq, ids in members.items():
        below = [s for s in members if s[: len(seq)] == seq]
        children = [s for s in below if len(s) == len(seq) + 1]
        leaves = [s for s in below if not any(len(t) == len(s) + 1 and t[: len(s)] == s for t in below)]
        ends = ",".join(str(c) for c in sorted(ids) if parts[c] == seq)
        saved = sum((len(members[s]) - 1) * words(s) for s in below)
        up = min(members[seq[:-1]]) if seq else None
        out.append((min(ids), len(seq), up, len(ids), len(children), len(leaves), saved, sha(ends)))
    return sorted(out, key=repr)


def spark_trie(spark, rows, block_rows=trie.BLOCK_ROWS):
    df = spark.createDataFrame(rows, SCHEMA)
    got = trie.prefix_trie(trie.with_heads_of_groups(trie.sequences(df)), block_rows)
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_trie_edges(spark):
    rows = [(5, 1, "user", "a b"), (5, None, "system", None), (5, 2, None, "x\x0by z"), (25, 1, "user", "a b"), (25, 1, "user", "a b")]
    rows += [(20, 0, "user", "head one"), (20, 3, "assistant", "head two"), (0, 0, "user", "Head"), (None, 0, "user", "no id")]
    rows += [(-7, 0, "user", "below zero"), (-20, 0, "user", "q")] + [(40, i, "u", f"turn {i % 3} " * 50) for i in range(300)]
    assert spark_trie(spark, rows) == brute_trie(rows)
    one = [(3, 0, "user", "x")]  # crc32("3") % 4 is 1: the only turn goes, the base is absent
    assert crc("3") % 4 > 0 and spark_trie(spark, one) == brute_trie(one) == [(3, 0, None, 1, 0, 1, 0, sha("3"))]
    assert spark_trie(spark, []) == []


@pytest.mark.parametrize("block_rows", [1, 3, 1000])
def test_trie_of_many_blocks(spark, block_rows):
    rng, rows = random.Random(block_rows), []
    for c in range(1, 200):
        n = rng.choice([1, 2, 3, 4, 5, 9])
        for t in range(n):
            rows.append((c, t, "user" if t % 2 else "assistant", "w " * rng.choice([0, 1, 2]) if t > 0 else "same first turn"))
    spark.conf.set("spark.sql.shuffle.partitions", 37 if block_rows == 3 else 4)
    try:
        assert spark_trie(spark, rows, block_rows) == brute_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_many_equal_conversations(spark):
    rows = [(c, t, "user", "x") for c in range(0, 60_000, 20) for t in range(2)]
    got = spark_trie(spark, rows)
    ids = sorted({r[0] for r in rows})
    ends = sha(",".join(map(str, ids)))
    assert [(r[1], r[3], r[7]) for r in got] == [(0, 3000, sha("")), (1, 3000, sha("")), (2, 3000, ends)]


def test_extents_are_found_by_each_candidate():
    rng = np.random.default_rng(0)
    lcp = rng.integers(0, 5, 300)
    table = trie.sparse_table(lcp)
    at, depth = rng.integers(0, 300, 500), rng.integers(1, 5, 500)
    for i, d, a, b in zip(at, depth, trie.left_extent(table, at, depth), trie.right_extent(table, at, depth)):
        left, right = i, i
        while left > 0 and lcp[left] >= d:
            left -= 1
        while right < 299 and lcp[right + 1] >= d:
            right += 1
        assert (a, b) == (left, right)
    a, b = np.minimum(at, at[::-1]), np.maximum(at, at[::-1])
    assert all(x == lcp[i : j + 1].min() for x, i, j in zip(trie.range_min(table, a, b), a, b))
    assert trie.range_min(table, np.array([5]), np.array([4]))[0] == trie.FAR


# repair


def brute_repair(codes):
    """Least cost and ASCII-least edits over all edit strings with up to four insertions."""
    best = None
    n = len(codes)
    for inserted in range(5):
        for slots in itertools.combinations_with_replacement(range(n + 1), inserted):
            for letters in itertools.product("DKR", repeat=n):
                cost, state, text = 5 * inserted, 0, ""
                for i in range(n + 1):
                    for _ in range(slots.count(i)):
                        text, state = text + "I", repair.NEXT[state]
                    if i == n:
                        break
                    found = [e for e in repair._row_edits(codes[i], state) if e[0] == letters[i]]
                    if not found:
                        cost = None
                        break
                    cost, state, text = cost + found[0][1], found[0][2], text + letters[i]
                if cost is not None and state in (repair.NOTHING, repair.ASSISTANT):
                    best = min(best, (cost, text)) if best else (cost, text)
    return best


def test_cheapest_edits_against_all():
    rng = random.Random(9)
    usual = [4 * k + f for k in (1, 2, 3) for f in (0, 0, 3)] + [0, 1, 2, 3, 9, 10]
    for _ in range(60):
        codes = bytes(rng.choice(usual) for _ in range(rng.randrange(5)))
        assert repair.cheapest_edits(codes) == brute_repair(codes), list(codes)


def plain_edits(codes):
    """The same programme with all vectors held."""
    v = [repair.END]
    for c in reversed(codes):
        v.append(repair._back(v[-1], c))
    return v[-1][0]


def test_long_conversations_keep_the_least_cost():
    rng = random.Random(1)
    for n in (10, 99, 100, 101, 5000):
        codes = bytes(rng.randrange(16) for _ in range(n))
        cost, audit = repair.cheapest_edits(codes)
        state, spent, i = 0, 0, 0
        for letter in audit:
            if letter == "I":
                spent, state = spent + 5, repair.NEXT[state]
                continue
            _, c, state = next(e for e in repair._row_edits(codes[i], state) if e[0] == letter)
            spent, i = spent + c, i + 1
        assert (spent, i) == (cost, n) and cost == plain_edits(codes) and state in (0, 3)


def brute_report(rows):
    """Damage, faults and repair row by row; the edits come from :func:`brute_repair`."""
    out = {}
    ids = {r[0] for r in rows}
    after = []
    for c, t, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        hit = crc(f"{' ' if c is None else c}:{' ' if t is None else t}") % 20
        if hit == 1:
            text = ""
        if hit == 2:
            text = re.sub("[.!?]", "", text)
        if hit == 4:
            role = "user"
        after += [(c, t, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    for c in ids:
        mine = in_order([r for r in after if r[0] == c])
        seen, codes, faults = set(), [], []
        for _, _, role, text in mine:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            f = 1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0
            seen.add((role, text))
            faults.append(f)
            codes.append(4 * {"s": 1, "u": 2, "a": 3}.get(role[:1], 0) + f)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit = brute_repair(bytes(codes))
        left, kept, state = list(mine), [], 0
        for letter in audit:
            row = left.pop(0) if letter != "I" else None
            if letter == "D":
                continue
            if letter == "K":
                state = {"s": 1, "u": 2, "a": 3}[row[2][0]]
                kept.append(f"{row[2]}:{row[3]}")
            else:
                state = repair.NEXT[state]
                kept.append(f"{repair.ROLES[state]}:{row[3] if row else ''}")
        out[c] = (gaps, *[faults.count(f) for f in (1, 2, 3)], illegal, cost, audit, sha("\n".join(kept)))
    return out


def test_report_against_brute_force(spark):
    rng, rows = random.Random(4), []
    texts = ["Fine.", "fine too!  ", "cut off", "", " \t", "Why?\x0b", None, "Fine."]
    for c in [*range(60), None, -3]:
        for t in [None, *range(rng.randrange(4))] if rng.random() < 0.5 else rng.sample(range(9), rng.randrange(4) + 1):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "tool", None, "", "User"]), rng.choice(texts)))
            if rng.random() < 0.15:
                rows.append(rows[-1])
    rows = [r for r in rows if sum(x[0] == r[0] for x in rows) <= 4]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).withColumn("conv", F.lit("x")).withColumn("code", F.lit(1)).repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_report(df).collect()}
    assert got == brute_report(rows)
    assert repair.repair_report(df.limit(0)).count() == 0


def test_repaired_rows_of_a_very_long_conversation(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}. " * 3) for t in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    damaged = repair.damage(df)
    plans = repair.repair_plans(damaged)
    got = sorted(repair.repaired_rows(damaged, plans).collect(), key=lambda r: r.place)
    assert [r.place for r in got] == list(range(len(got)))
    assert all(r.role == ("user", "assistant")[r.place % 2] for r in got)
    audit = plans.collect()[0].audit
    assert len(got) == len(audit) - audit.count("D")
