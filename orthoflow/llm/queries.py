"""One query per operator over its whole table, with SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoflow.llm import (
    conversation_repair,
    exact_dedup,
    fingerprint,
    hidden_markov,
    line_dedup,
    mixing,
    near_dedup,
    pieces,
    prefix_trie,
    pseudonyms,
    quality,
    toxicity,
    url_filter,
)
from orthoflow.llm.common import bound_batches
from orthoflow.llm.training import held_out
from orthoflow.session import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated function under its name, which must be free."""

    def add(fn):
        if fn.__name__ in QUERIES:
            raise ValueError(f"there is a query {fn.__name__} already")
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, in one file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
      row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
    FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
    WINDOW same AS (PARTITION BY text_sha256)
    """
)
def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query()
def op4_toxicity(spark, sf_dir):
    bound_batches(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = held_out("doc_id", 3, 1)
    model = toxicity.fit_toxicity(docs, labels, ~out)
    scores = toxicity.toxicity_scores(docs, model)
    return scores.select("doc_id", out.alias("held_out"), "score", "predicted")


@query()
def op5_quality(spark, sf_dir):
    bound_batches(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = held_out("doc_id", 5, 0)
    model = quality.fit_quality(docs, labels, ~out)
    scores = quality.quality_scores(docs, model)
    return scores.select("doc_id", out.alias("held_out"), "score", "predicted")


@query()
def op6_fingerprints(spark, sf_dir):
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


# The rules of the check, and how few paragraphs a page has that is worth nothing.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
PARAGRAPH, THIN = "<p>", 2


@query(
    r"""
    WITH parts AS (
      SELECT page_id, url,
        CASE WHEN contains(url, '://')
          THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
        CASE WHEN contains(url, '://')
          THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
        list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
          lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS params
      FROM pages),
    spelled AS (
      SELECT *, CASE WHEN host <> '' THEN
        regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '')
        || regexp_replace(path, '/+$', '')
        || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS canonical
      FROM parts),
    listed AS (
      SELECT DISTINCT canonical FROM spelled JOIN (SELECT page_id, html FROM pages) USING (page_id)
      WHERE length(html) - length(replace(html, '<p>', '')) <= 2 * length('<p>')),
    ruled AS (
      SELECT *, CASE
        WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1')
          THEN 'example.org/en/1'
        WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/')
          THEN 'example.org/es/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
      FROM spelled)
    SELECT page_id, host, path, rule,
      CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
        WHEN canonical IN (SELECT canonical FROM listed WHERE canonical IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict,
      rule IS NULL AND canonical IS NOT NULL
        AND canonical IN (SELECT canonical FROM listed WHERE canonical IS NOT NULL) AS listed
    FROM ruled
    """
)
def op8_url_filter(spark, sf_dir):
    """The list has the pages whose content is two paragraphs or less; the other spellings of their urls are
    caught by it, whatever these look like and whatever was found there."""
    pages = table(spark, sf_dir, "pages")
    without = F.length(F.replace("html", F.lit(PARAGRAPH), F.lit("")))
    listed = pages.where(F.length("html") - without <= THIN * len(PARAGRAPH)).select("url")
    return url_filter.url_filter(pages, listed, URL_RULES)


@query()
def op3_pseudonyms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    key = spark.conf.get(pseudonyms.KEY_SETTING, pseudonyms.KEY)
    return pseudonyms.pseudonymize(docs, key).select("doc_id", "text", F.size("pseudonyms").alias("n_values"), "pseudonyms")


@query(
    r"""
    WITH counted AS (
      SELECT doc_id, coalesce(source, chr(0)) AS source,
        len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f]+')) AS n FROM documents),
    sources AS (SELECT source, sum(n)::BIGINT AS tokens FROM counted GROUP BY source),
    shares AS (SELECT source, tokens, tokens / (SELECT sum(tokens) FROM sources)::DOUBLE AS p FROM sources),
    search(step, low, high) AS (
      SELECT * FROM (WITH RECURSIVE r(step, low, high) AS (
        SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
        UNION ALL
        SELECT step + 1,
          CASE WHEN (SELECT max(p ** ((low + high) / 2 - 1)) / min(p ** ((low + high) / 2 - 1))
                     FROM shares WHERE tokens > 0) > 1.25 THEN (low + high) / 2 ELSE low END,
          CASE WHEN (SELECT max(p ** ((low + high) / 2 - 1)) / min(p ** ((low + high) / 2 - 1))
                     FROM shares WHERE tokens > 0) > 1.25 THEN high ELSE (low + high) / 2 END
        FROM r WHERE step < 48) SELECT * FROM r)),
    chosen AS (
      SELECT CASE WHEN (SELECT max(p ** -1.0) / min(p ** -1.0) FROM shares WHERE tokens > 0) > 1.25
        THEN high ELSE 0.0 END AS a FROM search WHERE step = 48),
    least AS (SELECT min(p ** (a - 1)) AS m FROM shares, chosen WHERE tokens > 0),
    repeated AS (
      SELECT source, tokens, CASE WHEN tokens > 0 THEN (1 / m) * (p ** (a - 1)) ELSE 1.0 END AS r
      FROM shares, chosen, least),
    quotas AS (
      SELECT source, floor(r + 1e-9)::BIGINT AS blocks,
        greatest(0, round((r - floor(r + 1e-9)) * tokens)::BIGINT) AS rest FROM repeated),
    keyed AS (
      SELECT doc_id, source, blocks, rest, n, md5('mix|' || blocks || '|' || doc_id) AS key
      FROM counted JOIN quotas USING (source)),
    lasts AS (
      SELECT source, min(key) AS last_key FROM (
        SELECT source, key, rest,
          sum(n) OVER (PARTITION BY source ORDER BY key RANGE UNBOUNDED PRECEDING) AS upto FROM keyed)
      WHERE rest > 0 AND upto >= rest GROUP BY source),
    times AS (
      SELECT doc_id, source, blocks + CASE WHEN key <= last_key THEN 1 ELSE 0 END AS t
      FROM keyed LEFT JOIN lasts USING (source)),
    taken AS (SELECT doc_id, source, unnest(range(t)) AS block FROM times)
    SELECT doc_id, nullif(source, chr(0)) AS source, block::INTEGER AS block, md5('mix|' || block || '|' || doc_id) AS order_key FROM taken
    """
)
def op9_mixing(spark, sf_dir):
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "block", "order_key")


# SQL of the parts of a line of n words (w) after its leading words, and of all choices of parts that may not be left out.
LINE_PARTS = "[" + ", ".join(
    f"array_to_string(w[(n - 4) * {j} // {line_dedup.PARTS} + 5 : (n - 4) * {j + 1} // {line_dedup.PARTS} + 4], ' ')" for j in range(line_dedup.PARTS)
) + "]"
KEPT_PARTS = [list(c) for c in combinations(range(1, line_dedup.PARTS + 1), line_dedup.PARTS - line_dedup.LEFT_OUT)]


@query(
    rf"""
    WITH lines AS (
      SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line
      FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
    words AS (
      SELECT doc_id, pos, list_transform(
        list_filter(string_split_regex(line, '[ \t\r\f]+'), lambda x: x <> ''),
        lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w FROM lines),
    nodes AS (
      SELECT doc_id, pos, len(w) AS n, w, level, CASE level WHEN 0 THEN 4 WHEN 1 THEN 8 ELSE len(w) END AS depth
      FROM words, (SELECT unnest([0, 1, 2]) AS level)
      WHERE len(w) >= 5 AND (level = 2 OR len(w) >= 10)),
    paths AS (
      SELECT doc_id, pos, n, level, array_to_string(w[1:depth], ' ') AS key,
        list_transform([0, 1, 2, 3], lambda j: array_to_string(
          w[depth + ((n - depth) * j) // 4 + 1 : depth + ((n - depth) * (j + 1)) // 4], ' ')) AS s,
        list_transform([0, 1, 2, 3], lambda j: ((n - depth) * (j + 1)) // 4 - ((n - depth) * j) // 4) AS c
      FROM nodes),
    found AS (
      SELECT level, n, key, min(doc_id) AS first, max(c) AS c,
        CASE WHEN min(s[1]) <> max(s[1]) THEN max(c[1]) ELSE 0 END
        + CASE WHEN min(s[2]) <> max(s[2]) THEN max(c[2]) ELSE 0 END
        + CASE WHEN min(s[3]) <> max(s[3]) THEN max(c[3]) ELSE 0 END
        + CASE WHEN min(s[4]) <> max(s[4]) THEN max(c[4]) ELSE 0 END AS variable
      FROM paths GROUP BY level, n, key HAVING min(doc_id) < max(doc_id)),
    passages AS (
      SELECT n, w, array_to_string(w[1:4], ' ') AS node, array_to_string(w, ' ') AS line, min(doc_id) AS own, {LINE_PARTS} AS parts
      FROM nodes WHERE level = 0 GROUP BY n, w),
    choices AS (SELECT unnest(range({len(KEPT_PARTS)})) AS choice, unnest({KEPT_PARTS}) AS kept),
    kept AS (
      SELECT n, line, own, node, choice, list_transform(kept, lambda j: parts[j]) AS rest FROM passages, choices),
    shared AS (
      SELECT n, node, choice, rest, min(own) AS first FROM kept GROUP BY n, node, choice, rest HAVING count(*) > 1),
    near AS (
      SELECT n, line, min(first) AS first FROM kept JOIN shared USING (n, node, choice, rest) GROUP BY n, line),
    judged AS (
      SELECT doc_id, pos, bool_or(first < doc_id) AS go FROM (
        SELECT doc_id, pos, first FROM paths JOIN (SELECT * FROM found WHERE n - variable >= 0.6 * n) USING (level, n, key)
        UNION ALL
        SELECT doc_id, pos, first FROM paths JOIN near ON level = 2 AND paths.n = near.n AND key = line)
      GROUP BY doc_id, pos),
    gone AS (SELECT doc_id, list_sort(list(pos::INTEGER)) AS dropped FROM judged WHERE go GROUP BY doc_id),
    texts AS (
      SELECT doc_id, coalesce(dropped, []::INTEGER[]) AS dropped, string_split(text, chr(10)) AS ls
      FROM documents LEFT JOIN gone USING (doc_id))
    SELECT doc_id, len(ls) AS n_lines, len(dropped) AS n_dropped, array_to_string(dropped, ',') AS dropped,
      sha256(array_to_string(list_transform(
        list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(dropped, (i - 1)::INTEGER)), lambda i: ls[i]),
        chr(10))) AS text_sha256
    FROM texts
    """
)
def op10_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split("text", "\n", -1)).alias("n"))
    done = line_dedup.line_dedup(docs, dropped_col="lines")
    return done.select(
        "doc_id",
        F.col("n").cast("long").alias("n_lines"),
        F.size("lines").cast("long").alias("n_dropped"),
        F.array_join(F.transform("lines", lambda p: p.cast("string")), ",").alias("dropped"),
        F.sha2("text", 256).alias("text_sha256"),
    )


@query()
def op2_near_dedup(spark, sf_dir):
    bound_batches(spark)
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", "kept")


@query()
def op7_sentencepiece(spark, sf_dir):
    bound_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = pieces.encode_documents(docs, round_trip_col="round_trip")
    return encoded.select("doc_id", "token_ids", F.size("token_ids").alias("n_tokens"), "round_trip")


@query()
def op13_language_model(spark, sf_dir):
    bound_batches(spark)
    out = held_out("doc_id", 7, 2)
    scores, vocabulary, _ = hidden_markov.language_model_scores(table(spark, sf_dir, "documents"), ~out)
    return scores.select(
        "doc_id",
        (~F.col("usable")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


# crc32 of a decimal text, for SQL: the table of the remainders of all bytes, and one step per character.
CRC_TABLE = """
    crc_table AS (
      SELECT list(v ORDER BY i) AS t FROM (
        SELECT i, list_reduce([i] || range(8),
          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i)))"""


def crc32_sql(text: str) -> str:
    """SQL for the unsigned crc32 of an ASCII text, where ``t`` of ``crc_table`` is in scope."""
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce([4294967295] || {codes}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


@query(
    rf"""
    WITH {CRC_TABLE},
    ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
    turns AS (
      SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id
          ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS k FROM conversations),
    heads AS (
      SELECT conv_id, conv_id - conv_id % 20 AS base, {crc32_sql("conv_id::VARCHAR")} % 4 AS h FROM ids, crc_table),
    rebuilt AS (
      SELECT heads.conv_id, 0 AS part, k, role, text FROM heads JOIN turns ON turns.conv_id = base AND k <= h
      UNION ALL
      SELECT heads.conv_id, 1, k, role, text FROM heads JOIN turns ON turns.conv_id = heads.conv_id AND k > h),
    steps AS (
      SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS depth,
        len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, md5(length(role) || ':' || role || text) AS digest
      FROM rebuilt),
    paths AS (
      SELECT conv_id, 0 AS depth, 0 AS w, '' AS path FROM ids
      UNION ALL
      SELECT conv_id, depth, w, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth) FROM steps),
    lengths AS (SELECT conv_id, max(depth) AS n FROM paths GROUP BY conv_id),
    nodes AS (
      SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(w) AS w,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = n), '')) AS ends_sha256
      FROM paths JOIN lengths USING (conv_id) GROUP BY path, depth),
    children AS (SELECT left(path, 32 * (depth - 1)::BIGINT) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
    up AS (
      SELECT left(path, 32 * unnest(range(depth + 1))::BIGINT) AS path, (n_convs - 1) * w AS saved,
        (path NOT IN (SELECT path FROM children))::INTEGER AS leaf FROM nodes),
    sums AS (SELECT path, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves FROM up GROUP BY path)
    SELECT nodes.conv_id, nodes.depth::BIGINT AS depth, above.conv_id AS parent_conv_id, nodes.n_convs,
      coalesce(children.n, 0) AS n_children, n_leaves, saved_tokens, nodes.ends_sha256
    FROM nodes JOIN sums USING (path) LEFT JOIN children USING (path)
    LEFT JOIN nodes AS above ON nodes.depth > 0 AND above.path = left(nodes.path, 32 * (nodes.depth - 1)::BIGINT)
    """
)
def op11_prefix_trie(spark, sf_dir):
    bound_batches(spark)
    turns = cut(prefix_trie.sequences(table(spark, sf_dir, "conversations")), "turns")
    return prefix_trie.prefix_trie(prefix_trie.with_heads_of_groups(turns))


def _repair_sql() -> str:
    """The dynamic programme in SQL: per state (nothing, system, user, assistant) the least of cost, in 12
    digits, and edits as one text, so that the least text is the cheapest and ASCII-least way to it."""

    def more(way: str, cost: str, letter: str) -> str:
        return f"(lpad((left({way}, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || substr({way}, 13) || '{letter}')"

    def ways(v: str, code: str) -> list[str]:
        kind, fault = f"({code} // 4)", f"({code} % 4)"
        extra = f"CASE WHEN {fault} = 3 THEN 5 ELSE 0 END"
        gone = [more(f"{v}[{i}]", "2", "D") for i in (1, 2, 3, 4)]
        kept = lambda i, k: f"CASE WHEN {fault} IN (0, 3) AND {kind} = {k} THEN {more(f'{v}[{i}]', extra, 'K')} END"
        changed = lambda i: f"CASE WHEN {fault} IN (0, 3) THEN {more(f'{v}[{i}]', f'1 + {extra}', 'R')} END"
        return [
            gone[0],
            f"least({gone[1]}, {kept(1, 1)})",
            f"least({gone[2]}, {', '.join(f'{kept(i, 2)}, {changed(i)}' for i in (1, 2, 4))})",
            f"least({gone[3]}, {kept(3, 3)}, {changed(3)})",
        ]

    def inserted(g: list[str]) -> str:
        user = f"least({g[2]}, {more(g[0], '5', 'I')}, {more(g[1], '5', 'I')}, {more(g[3], '5', 'I')})"
        return f"[{g[0]}, {g[1]}, {user}, {g[3]}]"

    def closed(v: str) -> str:
        return f"[{v}[1], {v}[2], {v}[3], least({v}[4], {more(f'{v}[3]', '5', 'I')})]"

    start = "['000000000000', NULL, '000000000005I', '000000000010II']::VARCHAR[]"
    step = f"lambda acc, x: {{'code': 0, 'v': list_transform([{inserted([f'g[{i}]' for i in (1, 2, 3, 4)])}], lambda u: {closed('u')})[1]}}"
    step = step.replace("g[", "list_transform([acc.v], lambda v: [" + ", ".join(ways("v", "x.code")) + "])[1][")
    return rf"""
    WITH {CRC_TABLE},
    keyed AS (
      SELECT *, {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS hit
      FROM conversations, crc_table),
    rows_after AS (
      SELECT coalesce(conv_id::VARCHAR, ' ') AS conv, turn, CASE hit WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
        CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
        unnest(range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS nth FROM keyed),
    ordered AS (
      SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY place) AS seen FROM (
        SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, md5(text)) AS place FROM rows_after)),
    coded AS (
      SELECT *, CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS kind,
        CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN seen > 1 THEN 2
          WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault FROM ordered),
    paired AS (
      SELECT *, lag(kind) OVER (PARTITION BY conv ORDER BY place) AS kind_before FROM coded),
    faults AS (
      SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
        count(*) FILTER (WHERE fault = 3) AS truncated,
        count(*) FILTER (WHERE place > 1 AND NOT (kind_before, kind) IN ((1, 2), (2, 3), (3, 2))) AS illegal,
        list({{'code': (kind * 4 + fault)::INTEGER, 'v': []::VARCHAR[]}} ORDER BY place) AS codes
      FROM paired GROUP BY conv),
    solved AS (
      SELECT * EXCLUDE codes, list_reduce(list_prepend({{'code': 0, 'v': {start}}}, codes), {step}) AS s FROM faults),
    best AS (SELECT * EXCLUDE s, least(s.v[1], s.v[4]) AS way FROM solved),
    plans AS (SELECT *, left(way, 12)::BIGINT AS cost, substr(way, 13) AS audit FROM best),
    letters AS (
      SELECT conv, unnest(range(1, length(audit) + 1)) AS pos, unnest(string_split(audit, '')) AS letter FROM plans WHERE audit <> ''),
    placed AS (
      SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER run AS place, count(*) FILTER (WHERE letter <> 'D') OVER run AS nr
      FROM letters WINDOW run AS (PARTITION BY conv ORDER BY pos)),
    kept AS (
      SELECT p.conv, p.pos, p.nr, p.letter, coded.role, CASE WHEN p.letter = 'I' THEN '' ELSE coded.text END AS text,
        bool_or(p.nr = 1 AND p.letter = 'K' AND coded.kind = 1) OVER (PARTITION BY p.conv) AS led
      FROM placed AS p LEFT JOIN coded ON coded.conv = p.conv AND coded.place = p.place AND p.letter <> 'I' WHERE p.letter <> 'D'),
    lines AS (
      SELECT conv, pos, CASE WHEN letter = 'K' THEN role WHEN nr % 2 = (CASE WHEN led THEN 0 ELSE 1 END) THEN 'user'
        ELSE 'assistant' END || ':' || text AS line FROM kept),
    digests AS (SELECT conv, sha256(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM lines GROUP BY conv)
    SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
      coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
      coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS conv FROM conversations)
    LEFT JOIN plans USING (conv) LEFT JOIN digests USING (conv)
    """


@query(_repair_sql())
def op12_conversation_repair(spark, sf_dir):
    bound_batches(spark)
    return conversation_repair.repair_report(table(spark, sf_dir, "conversations"))
