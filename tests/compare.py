"""Compare a catalog query with its SQL twin: columns, types, rows and values."""

import datetime
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "boolean": "BOOLEAN", "double": "DOUBLE"}


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql):
    """Empty string when equal, else what differs."""
    rel = con.sql(sql)
    want_names, want_types = rel.columns, [str(t) for t in rel.types]
    got_names = df.columns
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} vs {sorted(want_names)}"
    types = dict(zip(want_names, want_types))
    wrong = []
    for n, t in df.dtypes:
        want = types[n]
        if t.startswith("decimal"):
            ok = want.lower() == t
        elif t.startswith("timestamp"):
            ok = want.startswith("TIMESTAMP")
        else:
            ok = TYPES.get(t) == want
        if not ok:
            wrong.append(f"{n}: {t} vs {want}")
    if wrong:
        return "types " + "; ".join(wrong)
    got = rows_of([tuple(r) for r in df.collect()], got_names)
    want = rows_of(rel.fetchall(), want_names)
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:3] if len(got) < 20000 else []
        lost = [r for r in want if r not in set(got)][:3] if len(want) < 20000 else []
        return f"rows {len(got)} vs {len(want)} extra {extra} lost {lost}"
    for a, b in zip(got, want):
        if a != b:
            return f"values {str(a)[:300]} vs {str(b)[:300]}"
    return ""
