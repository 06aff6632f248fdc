"""Queries: record keeping, headers, keys and URLs of objects."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from orthoflow.catalog.inputs import *  # noqa: F403
from orthoflow.catalog.inputs import q
from orthoflow.catalog.registry import query
from orthoflow.catalog.text_queries import NAMES, file_names
from orthoflow.functions import paths as P
from orthoflow.operators import records as R

REGION = "us-east-1"


def schedules(spark, sf):
    """Orders as schedule rows: some without a path, a third with a stored review."""
    key = F.col("o_orderkey")
    text = key.cast("string")
    return table(spark, sf, "orders").select(
        key.alias("id"),
        F.col("o_custkey").alias("draft_id"),
        F.when(key % 11 != 0, F.concat(F.lit("crono/documento_"), text, F.lit(".docx"))).alias("path"),
        F.when(key % 3 == 0, F.concat(F.lit("https://files.example.com/crono/rev_"), text, F.lit(".docx"))).alias("path_rev"),
        F.concat(F.lit("plan "), text).alias("name"),
        F.when(F.col("o_orderstatus") == "F", "N").otherwise("Y").alias("active"),
        F.col("o_orderdate").alias("add_ts"),
    )


SCHED = """s AS (SELECT o_orderkey AS id, o_custkey AS draft_id,
  CASE WHEN o_orderkey % 11 <> 0 THEN 'crono/documento_' || o_orderkey || '.docx' END AS path,
  CASE WHEN o_orderkey % 3 = 0 THEN 'https://files.example.com/crono/rev_' || o_orderkey || '.docx' END AS path_rev,
  'plan ' || o_orderkey AS name, CASE WHEN o_orderstatus = 'F' THEN 'N' ELSE 'Y' END AS active, o_orderdate AS add_ts FROM orders)"""


@query(f"""WITH {SCHED} SELECT id, draft_id, path, name, (row_number() OVER (PARTITION BY draft_id ORDER BY add_ts, id))::INTEGER AS place
  FROM s WHERE active = 'Y' AND path IS NOT NULL""")
def active_items(spark, sf):
    return R.active_items(schedules(spark, sf)).select("id", "draft_id", "path", "name", "place")


PLAN = f"""{SCHED}, ch AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity > 45),
rv AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_discount > 0.08),
pl AS (SELECT s.*, CASE WHEN id IN (SELECT id FROM ch) OR (path_rev IS NULL AND id NOT IN (SELECT id FROM rv)) THEN 'fresh' ELSE 'reuse' END AS action
  FROM s WHERE active = 'Y' AND path IS NOT NULL)"""


def planned(spark, sf):
    items = table(spark, sf, "lineitem")
    changed = items.where("l_quantity > 45").select(F.col("l_orderkey").alias("id"))
    seen = items.where("l_discount > 0.08").select(F.col("l_orderkey").alias("id"))
    return R.plan_review(R.active_items(schedules(spark, sf)), changed, seen)


@query(f"WITH {PLAN} SELECT id, draft_id, action FROM pl")
def plan_review(spark, sf):
    return planned(spark, sf).select("id", "draft_id", "action")


REUSED = """re AS (SELECT id, true AS ok, path_rev IS NOT NULL AS has_errors, 0::BIGINT AS total_errors, path_rev,
  CASE WHEN path_rev IS NOT NULL THEN 'rev_' || id || '.docx' END AS file_rev, 'reutilizado' AS origin FROM pl WHERE action = 'reuse')"""


@query(f"WITH {PLAN}, {REUSED} SELECT * FROM re")
def reused_results(spark, sf):
    return R.reused_results(planned(spark, sf).where("action = 'reuse'"))


def fresh_results(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("total_errors"))
    return planned(spark, sf).where("action = 'fresh'").select("id").join(counts, "id", "left").select(
        "id",
        F.lit(True).alias("ok"),
        (F.coalesce("total_errors", F.lit(0)) > 3).alias("has_errors"),
        F.coalesce("total_errors", F.lit(0)).alias("total_errors"),
    )


MERGED = f"""{PLAN}, {REUSED}, n AS (SELECT l_orderkey AS id, count(*) AS c FROM lineitem GROUP BY 1),
mr AS (SELECT id, true AS ok, coalesce(c, 0) > 3 AS has_errors, coalesce(c, 0) AS total_errors, NULL::VARCHAR AS path_rev, NULL::VARCHAR AS file_rev, 'fresco' AS origin
  FROM pl LEFT JOIN n USING (id) WHERE action = 'fresh' UNION ALL SELECT * FROM re),
mw AS (SELECT *, coalesce(has_errors OR path_rev IS NOT NULL, false) AS with_review FROM mr)"""


@query(f"WITH {MERGED} SELECT * FROM mw")
def merge_results(spark, sf):
    return R.merge_results(fresh_results(spark, sf), R.reused_results(planned(spark, sf).where("action = 'reuse'")))


@query(f"""WITH {MERGED} SELECT count(*) AS items, count(*) FILTER (origin = 'fresco') AS fresh, count(*) FILTER (origin = 'reutilizado') AS reused,
  count(*) FILTER (with_review) AS with_review, bool_or(with_review) AS has_errors FROM mw""")
def merge_summary(spark, sf):
    return R.merge_summary(
        R.merge_results(fresh_results(spark, sf), R.reused_results(planned(spark, sf).where("action = 'reuse'")))
    )


def contents(spark, sf):
    """Documents with fewer than 60 characters count as files without content."""
    return documents(spark, sf).select(
        "source", "doc_id", (F.length(F.trim("text")) < 60).alias("no_content"), F.when(F.col("lang") == "en", "plan").alias("name")
    )


@query("""SELECT source, count(*) FILTER (length(trim(text)) < 60) AS without_content, bool_or(length(trim(text)) < 60) AS blocked
  FROM documents GROUP BY 1""")
def empty_gate(spark, sf):
    return R.empty_gate(contents(spark, sf), ["source"])


@query("SELECT source, doc_id, true AS no_content, CASE WHEN lang = 'en' THEN 'plan' ELSE 'Cronograma' END AS name FROM documents WHERE length(trim(text)) < 60")
def items_without_content(spark, sf):
    return R.items_without_content(contents(spark, sf))


@query(f"""WITH {SCHED}, r AS (SELECT l_orderkey AS id, bool_and(l_quantity > 2) AS ok, bool_or(l_discount > 0.07) AS has_errors,
    CASE WHEN bool_or(l_discount > 0.09) THEN ' new/' || l_orderkey || ' ' END AS p, bool_or(l_tax > 0.07) AS replaced FROM lineitem GROUP BY 1)
  SELECT s.id, s.draft_id, CASE WHEN r.p IS NOT NULL THEN trim(r.p)[1:1000] WHEN (ok AND NOT has_errors) OR replaced THEN NULL ELSE path_rev END AS path_rev
  FROM s LEFT JOIN r USING (id)""")
def upsert_review_path(spark, sf):
    return R.upsert_review_path(schedules(spark, sf), path_results(spark, sf)).select("id", "draft_id", "path_rev")


def path_results(spark, sf):
    """Results of reviews, one per order that has lines."""
    results = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.bool_and(F.col("l_quantity") > 2).alias("ok"),
        F.bool_or(F.col("l_discount") > 0.07).alias("has_errors"),
        F.bool_or(F.col("l_discount") > 0.09).alias("big"),
        F.bool_or(F.col("l_tax") > 0.07).alias("replaced"),
    )
    path = F.when(F.col("big"), F.concat(F.lit(" new/"), F.col("id").cast("string"), F.lit(" ")))
    return results.withColumn("path_rev", path).drop("big")


def grades(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("draft_id"),
        F.col("l_linenumber").alias("row_id"),
        F.concat("l_returnflag", "l_linestatus").alias("label"),
        F.col("l_quantity").cast("decimal(9,2)").alias("pct"),
        (F.col("l_returnflag") == "R").alias("deleted"),
    )


GRADES = """g AS (SELECT l_orderkey AS draft_id, l_linenumber AS row_id, l_returnflag || l_linestatus AS label,
  l_quantity::DECIMAL(9,2) AS pct, l_returnflag = 'R' AS deleted FROM lineitem)"""


@query(f"""WITH {GRADES}, c0 AS (SELECT event_id // 4 AS draft_id, (user_id % 3 + 1)::INTEGER AS row_id,
    CASE event_type WHEN 'error' THEN 'D' WHEN 'purchase' THEN 'I' WHEN 'signup' THEN 'I' ELSE 'U' END AS op,
    CASE WHEN event_id % 7 = 0 THEN '  ' ELSE ' ' || event_type || event_id END AS label, floor(value)::DECIMAL(9,2) AS pct, ts FROM events),
  c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY draft_id, row_id ORDER BY ts DESC, op DESC) AS rn FROM c0)
    WHERE rn = 1 AND (op = 'D' OR length(trim(label)) > 0))
  SELECT coalesce(g.draft_id, c.draft_id) AS draft_id, coalesce(g.row_id, c.row_id) AS row_id,
    CASE WHEN g.draft_id IS NULL OR c.op = 'U' THEN trim(c.label)[1:500] ELSE g.label END AS label,
    CASE WHEN g.draft_id IS NULL OR c.op = 'U' THEN c.pct ELSE g.pct END AS pct
  FROM g FULL JOIN c ON g.draft_id = c.draft_id AND g.row_id = c.row_id
  WHERE (g.draft_id IS NOT NULL AND (c.op IS NULL OR c.op <> 'D')) OR (g.draft_id IS NULL AND c.op = 'I')""")
def apply_row_changes(spark, sf):
    return R.apply_row_changes(grades(spark, sf).drop("deleted"), row_changes(spark, sf), ["draft_id", "row_id"], "label", ["pct"])


def row_changes(spark, sf):
    """Events as changes of grade rows."""
    op = (
        F.when(F.col("event_type") == "error", "D")
        .when(F.col("event_type").isin("purchase", "signup"), "I")
        .otherwise("U")
    )
    label = F.when(F.col("event_id") % 7 == 0, "  ").otherwise(
        F.concat(F.lit(" "), "event_type", F.col("event_id").cast("string"))
    )
    return table(spark, sf, "events").select(
        F.floor(F.col("event_id") / 4).alias("draft_id"),
        (F.col("user_id") % 3 + 1).cast("int").alias("row_id"),
        op.alias("op"),
        label.alias("label"),
        F.floor("value").cast("decimal(9,2)").alias("pct"),
        "ts",
    )


def versions(spark, sf):
    """Orders of a customer as versions: the last is the draft, the one before is current."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    back = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    place = F.row_number().over(back)
    return (
        table(spark, sf, "orders")
        .select("o_orderkey", "o_custkey", "o_orderdate", place.alias("place"), F.lead("o_orderdate").over(order).alias("next_date"))
        .select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("course"),
            F.when(F.col("place") > 1, F.col("o_orderdate")).alias("start_ts"),
            F.when(F.col("place") > 2, F.col("next_date")).alias("end_ts"),
        )
    )


VERSIONS = """v AS (SELECT o_orderkey AS id, o_custkey AS course, CASE WHEN place > 1 THEN o_orderdate END AS start_ts,
  CASE WHEN place > 2 THEN nd END AS end_ts FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place,
    lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nd FROM orders))"""


@query(f"""WITH {VERSIONS}, p AS (SELECT c_custkey AS course FROM customer WHERE c_acctbal > 0),
  m AS (SELECT v.*, course IN (SELECT course FROM p) AS pub, start_ts IS NULL AND end_ts IS NULL AS draft, start_ts IS NOT NULL AND end_ts IS NULL AS cur FROM v)
  SELECT id, course, CASE WHEN pub AND draft THEN TIMESTAMP '2026-07-01' ELSE start_ts::TIMESTAMP END AS start_ts,
    CASE WHEN pub AND cur THEN TIMESTAMP '2026-07-01' ELSE end_ts::TIMESTAMP END AS end_ts,
    CASE WHEN pub AND cur THEN 'closed' WHEN pub AND draft THEN 'promoted' ELSE 'unchanged' END AS step FROM m
  UNION ALL SELECT NULL, course, NULL, NULL, 'opened' FROM m WHERE pub AND draft""")
def publish_version(spark, sf):
    return R.publish_version(dated_versions(spark, sf), publishing(spark, sf), F.lit("2026-07-01").cast("timestamp"))


def publishing(spark, sf):
    return table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("course"))


def dated_versions(spark, sf):
    return versions(spark, sf).withColumns({c: F.col(c).cast("timestamp") for c in ("start_ts", "end_ts")})


@query(f"""WITH {VERSIONS} SELECT course, max(CASE WHEN start_ts IS NOT NULL AND end_ts IS NULL THEN id END) AS current_id,
  max(CASE WHEN start_ts IS NULL AND end_ts IS NULL THEN id END) AS draft_id, count(start_ts) AS publications, max(start_ts) AS last_publication
  FROM v GROUP BY 1""")
def latest_version(spark, sf):
    return R.latest_version(versions(spark, sf))


@query(f"""WITH {SCHED} SELECT draft_id, count(*) AS items, count(path_rev) AS with_review,
  CASE WHEN count(path_rev) > 0 THEN 'review available' ELSE 'clean' END AS status FROM s GROUP BY 1""")
def status_view(spark, sf):
    return R.status_view(schedules(spark, sf))


@query("""WITH f AS (SELECT event_id, event_type = 'signup' AS is_new, event_type IN ('click', 'purchase', 'signup') AS is_edited,
    value > 90 AS is_deleted, (props->>'$.k')::INTEGER > 50 AS has_file FROM events)
  SELECT event_id, 'new' AS origin FROM f WHERE is_new AND has_file UNION ALL
  SELECT event_id, 'edited' FROM f WHERE is_edited AND NOT is_deleted AND NOT is_new AND has_file""")
def upload_changes(spark, sf):
    form = table(spark, sf, "events").select(
        "event_id",
        (F.col("event_type") == "signup").alias("is_new"),
        F.col("event_type").isin("click", "purchase", "signup").alias("is_edited"),
        (F.col("value") > 90).alias("is_deleted"),
        (F.get_json_object("props", "$.k").cast("int") > 50).alias("has_file"),
    )
    return R.upload_changes(form).select("event_id", "origin")


@query(f"""WITH {GRADES} SELECT draft_id, count(*) FILTER (NOT deleted) AS live_rows, coalesce(sum(pct) FILTER (NOT deleted), 0)::VARCHAR AS total,
  count(*) FILTER (NOT deleted AND pct <= 0) AS not_positive, coalesce(sum(pct) FILTER (NOT deleted), 0) = 100 AND count(*) FILTER (NOT deleted AND pct <= 0) = 0 AS complete
  FROM g GROUP BY 1""")
def grade_total(spark, sf):
    return R.grade_total(grades(spark, sf)).withColumn("total", F.col("total").cast("decimal(19,2)").cast("string"))


CHILDREN = """ch AS (SELECT l_orderkey AS draft_id, 'grade' AS kind, CASE WHEN l_tax > 0.07 THEN ' ' ELSE l_returnflag END AS label,
    (l_quantity - 3)::DECIMAL(9,2) AS pct, l_returnflag = 'R' AS deleted, l_linestatus = 'O' AS is_new, l_discount > 0.05 AS is_edited FROM lineitem
  UNION ALL SELECT event_id, CASE WHEN event_type = 'view' THEN 'reference' ELSE 'experience' END, CASE WHEN user_id % 5 = 0 THEN '' ELSE event_type END,
    NULL, event_type = 'error', event_type = 'signup', value > 50 FROM events)"""


def children(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("draft_id"),
        F.lit("grade").alias("kind"),
        F.when(F.col("l_tax") > 0.07, " ").otherwise(F.col("l_returnflag")).alias("label"),
        (F.col("l_quantity") - 3).cast("decimal(9,2)").alias("pct"),
        (F.col("l_returnflag") == "R").alias("deleted"),
        (F.col("l_linestatus") == "O").alias("is_new"),
        (F.col("l_discount") > 0.05).alias("is_edited"),
    )
    other = table(spark, sf, "events").select(
        F.col("event_id").alias("draft_id"),
        F.when(F.col("event_type") == "view", "reference").otherwise("experience").alias("kind"),
        F.when(F.col("user_id") % 5 == 0, "").otherwise(F.col("event_type")).alias("label"),
        F.lit(None).cast("decimal(9,2)").alias("pct"),
        (F.col("event_type") == "error").alias("deleted"),
        (F.col("event_type") == "signup").alias("is_new"),
        (F.col("value") > 50).alias("is_edited"),
    )
    return rows.unionByName(other)


def _violations_sql(publish):
    looked = "NOT deleted" if publish else "NOT deleted AND (is_new OR is_edited)"
    return f"""WITH {CHILDREN}, f AS (SELECT draft_id, bool_or({looked} AND length(trim(label)) = 0) AS e,
    coalesce(bool_or(CASE WHEN deleted OR kind <> 'grade' THEN false ELSE pct <= 0 END), false) AS z,
    coalesce(sum(pct) FILTER (NOT deleted AND kind = 'grade'), 0) AS total FROM ch GROUP BY 1)
  SELECT draft_id, e AS empty_text, z AS not_positive, total <> 100 AS wrong_total, CASE WHEN e AND z AND total <> 100 THEN 'fields, percents and total'
    WHEN e AND total <> 100 THEN 'fields and total' WHEN z AND total <> 100 THEN 'percents and total' WHEN z THEN 'percents'
    WHEN total <> 100 THEN 'total' WHEN e THEN 'fields' END AS message FROM f"""


@query(_violations_sql(True))
def row_violations_publish(spark, sf):
    return R.row_violations(children(spark, sf), publish=True).drop("total")


@query(_violations_sql(False))
def row_violations_save(spark, sf):
    return R.row_violations(children(spark, sf), publish=False).drop("total")


@query(f"""WITH {SCHED}, d AS (SELECT c_custkey AS draft_id, CASE WHEN c_nationkey = 3 THEN ' ' ELSE c_mktsegment END AS rules,
    CASE WHEN c_acctbal < 0 THEN '' ELSE 'x' END AS use_note, CASE WHEN c_nationkey = 7 THEN NULL ELSE 'y' END AS thinking_note FROM customer),
  g AS (SELECT o_custkey AS draft_id, (CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 25 END)::DECIMAL(9,2) AS pct, o_orderstatus = 'F' AS deleted FROM orders),
  gt AS (SELECT draft_id, count(*) FILTER (NOT deleted) AS live, coalesce(sum(pct) FILTER (NOT deleted), 0) AS total, count(*) FILTER (NOT deleted AND pct <= 0) AS np FROM g GROUP BY 1),
  sc AS (SELECT draft_id, count(*) AS n FROM s WHERE active = 'Y' AND id % 5 <> 0 GROUP BY 1),
  rf AS (SELECT user_id AS draft_id, count(*) FILTER (event_type = 'view') AS r, count(*) FILTER (event_type = 'click') AS x FROM events GROUP BY 1),
  k AS (SELECT d.draft_id, CASE WHEN length(trim(rules)) = 0 THEN 'rules' WHEN coalesce(live, 0) < 1 THEN 'grades' WHEN coalesce(n, 0) < 1 THEN 'schedule'
    WHEN coalesce(r, 0) < 1 THEN 'references' WHEN coalesce(x, 0) < 1 THEN 'experiences' WHEN length(trim(use_note)) = 0 THEN 'use_note'
    WHEN thinking_note IS NULL THEN 'thinking_note' WHEN coalesce(total, 0) <> 100 THEN 'total' WHEN np > 0 THEN 'percents' END AS failing_check
  FROM d LEFT JOIN gt USING (draft_id) LEFT JOIN sc USING (draft_id) LEFT JOIN rf USING (draft_id))
  SELECT draft_id, failing_check, failing_check IS NULL AS ready FROM k""")
def publication_readiness(spark, sf):
    drafts = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("draft_id"),
        F.when(F.col("c_nationkey") == 3, " ").otherwise(F.col("c_mktsegment")).alias("rules"),
        F.when(F.col("c_acctbal") < 0, "").otherwise("x").alias("use_note"),
        F.when(F.col("c_nationkey") != 7, "y").alias("thinking_note"),
    )
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("draft_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(25).cast("decimal(9,2)").alias("pct"),
        (F.col("o_orderstatus") == "F").alias("deleted"),
    )
    plans = schedules(spark, sf).withColumn("deleted", F.col("id") % 5 == 0)
    notes = table(spark, sf, "events").select(
        F.col("user_id").alias("draft_id"), F.col("event_type").alias("label"), F.lit(False).alias("deleted")
    )
    return R.publication_readiness(drafts, rows, plans, notes.where("label = 'view'"), notes.where("label = 'click'"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS section_id, l_returnflag AS section, p_name AS course, p_brand AS code, s_name AS person, ro.r_name AS role,
    n_name AS area, fa.r_name AS faculty, strftime(cy.o_orderdate, '%Y%m') AS cycle, strftime(cy.o_orderdate, '%Y') AS year, strftime(cy.o_orderdate, '%m') AS semester
  FROM (SELECT a.l_orderkey, a.l_linenumber, a.l_returnflag, a.l_partkey, b.l_suppkey, b.l_discount FROM lineitem a JOIN lineitem b
    ON a.l_orderkey * 10 + a.l_linenumber = b.l_orderkey * 10 + b.l_linenumber)
  JOIN supplier ON s_suppkey = l_suppkey JOIN region ro ON ro.r_regionkey = l_linenumber % 5 JOIN orders t ON t.o_orderkey = l_orderkey
  JOIN part ON p_partkey = l_partkey JOIN nation ON n_nationkey = p_size % 25 JOIN region fa ON fa.r_regionkey = n_regionkey
  LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') cy ON cy.o_orderkey = t.o_orderkey WHERE NOT l_discount > 0.05""")
def course_header(spark, sf):
    item = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders")
    region = table(spark, sf, "region")
    section_id = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("section_id")
    header = R.course_header(
        sections=item.select(
            section_id, F.col("l_returnflag").alias("section"), F.col("l_partkey").alias("course_id"), F.col("l_orderkey").alias("term_id")
        ),
        staff=item.select(
            section_id,
            F.col("l_suppkey").alias("person_id"),
            (F.col("l_linenumber") % 5).alias("role_id"),
            F.when(F.col("l_discount") > 0.05, "Y").otherwise("N").alias("blocked"),
        ),
        people=table(spark, sf, "supplier").select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("person")),
        roles=region.select(F.col("r_regionkey").alias("role_id"), F.col("r_name").alias("role")),
        terms=orders.select(F.col("o_orderkey").alias("term_id")),
        courses=table(spark, sf, "part").select(
            F.col("p_partkey").alias("course_id"), F.col("p_name").alias("course"), F.col("p_brand").alias("code"), (F.col("p_size") % 25).alias("area_id")
        ),
        areas=table(spark, sf, "nation").select(
            F.col("n_nationkey").alias("area_id"), F.col("n_name").alias("area"), F.col("n_regionkey").alias("faculty_id")
        ),
        faculties=region.select(F.col("r_regionkey").alias("faculty_id"), F.col("r_name").alias("faculty")),
        cycles=orders.where("o_orderstatus = 'P'").select(
            F.col("o_orderkey").alias("term_id"), F.date_format("o_orderdate", "yyyyMM").alias("cycle")
        ),
    )
    return header.select(
        "section_id", "section", "course", "code", "person", "role", "area", "faculty", "cycle", "year", "semester"
    )


@query("""SELECT o_orderkey AS outcome_id, o_custkey AS course, coalesce(o_orderpriority, '') AS description, coalesce(n_name, '') AS level
  FROM orders LEFT JOIN nation ON n_nationkey = o_custkey % 30""")
def outcomes_with_level(spark, sf):
    outcomes = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("outcome_id"), F.col("o_custkey").alias("course"), F.col("o_orderpriority").alias("description"),
        (F.col("o_custkey") % 30).cast("int").alias("level_id"),
    )
    levels = table(spark, sf, "nation").select(F.col("n_nationkey").alias("level_id"), F.col("n_name").alias("level"))
    return R.outcomes_with_level(outcomes, levels).drop("level_id")


@query("""SELECT c_custkey AS section_id, CASE WHEN c_nationkey < 5 AND c_acctbal > 0 THEN 'override ' || c_name ELSE c_name END AS name,
    CASE WHEN c_nationkey < 5 THEN 'E' || c_nationkey ELSE c_mktsegment END AS code, c_nationkey::VARCHAR AS section,
    CASE WHEN c_nationkey < 5 THEN CASE WHEN c_mktsegment = 'BUILDING' THEN 'Lab' ELSE 'Centre' END ELSE n_name END AS faculty, c_nationkey < 5 AS overridden
  FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def override_header(spark, sf):
    customer = table(spark, sf, "customer")
    nation = table(spark, sf, "nation")
    base = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("section_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("code"),
        F.col("c_nationkey").cast("string").alias("section"), F.col("n_name").alias("faculty"), F.col("c_mktsegment").alias("course_type"),
    )
    override = customer.where("c_nationkey < 5").select(
        F.col("c_custkey").alias("section_id"),
        F.when(F.col("c_acctbal") > 0, F.concat(F.lit("override "), "c_name")).alias("name"),
        F.concat(F.lit("E"), F.col("c_nationkey").cast("string")).alias("code"),
        F.lit(None).cast("string").alias("section"),
    )
    return R.override_header(base, override, "BUILDING", "Lab", "Centre")


# --- object keys and URLs ---------------------------------------------------

KEYS = f"""{NAMES}, k AS (SELECT doc_id AS id, name AS key FROM names UNION ALL
  SELECT page_id, ltrim(regexp_extract(url, {q(P.URL_PARTS)}, 2), '/') FROM pages),
kc AS (SELECT id, key, regexp_replace(regexp_replace(key, '/+', '/', 'g'), '/$', '') AS clean FROM k),
kk AS (SELECT id, key, regexp_extract(clean, '^(.*/)[^/]*$', 1) AS folder, regexp_extract(clean, '([^/]*)$', 1) AS name FROM kc),
kr AS (SELECT *, CASE WHEN contains(name, 'documento') THEN regexp_replace(name, '^(.*?)documento', '\\1rev') ELSE 'rev_' || name END AS rev FROM kk)"""


@query(f"""WITH {KEYS} SELECT id, key, folder || rev AS correction_key,
  folder || CASE WHEN regexp_matches(rev, '^.+\\.[^.]+$') THEN regexp_extract(rev, '^(.+)\\.[^.]+$', 1) ELSE rev END || '_errores.json' AS json_key,
  rev AS correction_basename, name AS original_basename FROM kr""")
def revision_keys(spark, sf):
    pages = table(spark, sf, "pages").select(
        F.col("page_id").alias("id"), F.regexp_replace(P.url_path("url"), "^/+", "").alias("key")
    )
    keys = file_names(spark, sf).select(F.col("doc_id").alias("id"), F.col("name").alias("key")).unionByName(pages)
    return keys.select("id", "key", P.revision_keys("key").alias("r")).select("id", "key", "r.*")


URLS = """urls AS (SELECT doc_id, ['s3://b' || (doc_id % 7) || '/' || source || '/' || doc_id || '.docx',
    'https://B' || (doc_id % 7) || '.s3.eu-west-1.amazonaws.com/' || source || '/' || doc_id || '.docx',
    'https://s3.amazonaws.com/b' || (doc_id % 7) || '/' || source || '/' || doc_id || '.docx',
    'https://files.example.com/' || doc_id, 'no url'][doc_id % 5 + 1] AS url, doc_id % 5 AS f, 'b' || (doc_id % 7) AS b, source || '/' || doc_id || '.docx' AS k FROM documents)"""


def object_urls(spark, sf):
    bucket = (F.col("doc_id") % 7).cast("string")
    tail = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".docx"))
    forms = F.array(
        F.concat(F.lit("s3://b"), bucket, F.lit("/"), tail),
        F.concat(F.lit("https://B"), bucket, F.lit(".s3.eu-west-1.amazonaws.com/"), tail),
        F.concat(F.lit("https://s3.amazonaws.com/b"), bucket, F.lit("/"), tail),
        F.concat(F.lit("https://files.example.com/"), F.col("doc_id").cast("string")),
        F.lit("no url"),
    )
    return documents(spark, sf).select("doc_id", F.element_at(forms, (F.col("doc_id") % 5 + 1).cast("int")).alias("url"))


@query(f"WITH {URLS} SELECT doc_id, url, CASE WHEN f < 3 THEN b END AS bucket, CASE WHEN f < 3 THEN k END AS key FROM urls")
def parse_object_url(spark, sf):
    parts = object_urls(spark, sf).withColumn("p", P.parse_object_url("url"))
    return parts.select("doc_id", "url", "p.bucket", "p.key")


@query(f"""WITH {URLS} SELECT doc_id, CASE WHEN f = 0 THEN 'https://' || b || '.s3.{REGION}.amazonaws.com/' || k WHEN f < 4 THEN url ELSE '' END AS https FROM urls""")
def object_uri_to_https(spark, sf):
    return object_urls(spark, sf).select("doc_id", P.object_uri_to_https("url", REGION).alias("https"))
