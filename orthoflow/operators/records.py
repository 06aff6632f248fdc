"""Record keeping around reviews: items, versions, row changes, readiness, headers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthoflow import fixed_values as V
from orthoflow.functions.text import strip
from orthoflow.sources.snapshots import KeyedTable, Snapshot


def _filled(column: str) -> Column:
    return F.length(strip(F.coalesce(F.col(column), F.lit("")))) > 0


def active_items(schedules: DataFrame) -> DataFrame:
    """Active items with a path, numbered per draft by date added and id."""
    order = Window.partitionBy("draft_id").orderBy("add_ts", "id")
    return schedules.where((F.col("active") == "Y") & _filled("path")).withColumn(
        "place", F.row_number().over(order)
    )


def plan_review(items: DataFrame, changed: DataFrame, reviewed: DataFrame) -> DataFrame:
    """``fresh`` for changed items and for items without a stored review that were never
    reviewed, ``reuse`` for the rest."""
    c = changed.select("id").distinct().withColumn("_changed", F.lit(True))
    r = reviewed.select("id").distinct().withColumn("_reviewed", F.lit(True))
    never = ~_filled("path_rev") & F.col("_reviewed").isNull()
    return (
        items.join(c, "id", "left")
        .join(r, "id", "left")
        .withColumn("action", F.when(F.col("_changed") | never, "fresh").otherwise("reuse"))
        .drop("_changed", "_reviewed")
    )


def reused_results(items: DataFrame) -> DataFrame:
    """Results of reused items without a new review: errors exist where a review is stored."""
    path = strip(F.coalesce("path_rev", F.lit("")))
    name = F.nullif(F.regexp_extract(F.regexp_replace(path, r"[?#].*$", ""), "([^/]*)/?$", 1), F.lit(""))
    stored = _filled("path_rev")
    return items.select(
        "id",
        F.lit(True).alias("ok"),
        stored.alias("has_errors"),
        F.lit(0).cast("bigint").alias("total_errors"),
        F.when(stored, path).alias("path_rev"),
        F.when(stored, F.coalesce(name, F.concat(F.lit("revision_"), F.col("id").cast("string")))).alias("file_rev"),
        F.lit("reutilizado").alias("origin"),
    )


def merge_results(fresh: DataFrame, reused: DataFrame) -> DataFrame:
    """Fresh and reused results stacked, with a flag for a review to show."""
    return (
        fresh.withColumn("origin", F.lit("fresco"))
        .unionByName(reused, allowMissingColumns=True)
        .withColumn("with_review", F.coalesce("has_errors", F.lit(False)) | _filled("path_rev"))
    )


def merge_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("items"),
        F.count_if(F.col("origin") == "fresco").alias("fresh"),
        F.count_if(F.col("origin") == "reutilizado").alias("reused"),
        F.count_if("with_review").alias("with_review"),
        F.coalesce(F.bool_or("with_review"), F.lit(False)).alias("has_errors"),
    )


def empty_gate(results: DataFrame, group: list[str]) -> DataFrame:
    """Items without content per group; any such item blocks."""
    return results.groupBy(*group).agg(
        F.count_if("no_content").alias("without_content"),
        F.coalesce(F.bool_or("no_content"), F.lit(False)).alias("blocked"),
    )


def items_without_content(results: DataFrame) -> DataFrame:
    return results.where("no_content").withColumn(
        "name", F.when(_filled("name"), F.col("name")).otherwise("Cronograma")
    )


def upsert_review_path(items: DataFrame, results: DataFrame) -> DataFrame:
    """New snapshot of the items: the review path is set when a review was made, cleared when
    the item is clean or its file was replaced, and left alone when the review failed."""
    new = results.select("id", "ok", "has_errors", F.col("path_rev").alias("_path"), "replaced")
    done = F.coalesce("ok", F.lit(False))
    clean = done & ~F.coalesce("has_errors", F.lit(False))
    path = (
        F.when(_filled("_path"), F.substring(strip("_path"), 1, V.PATH_CHARS))
        .when(clean | F.coalesce("replaced", F.lit(False)), None)
        .otherwise(F.col("path_rev"))
    )
    return (
        items.join(new, "id", "left")
        .withColumn("path_rev", path)
        .drop("ok", "has_errors", "_path", "replaced")
    )


def apply_row_changes(
    table: DataFrame, changes: DataFrame, keys: list[str], text: str, values: Sequence[str],
    max_chars: int = V.LABEL_CHARS,
) -> DataFrame:
    """New snapshot after deletes, inserts and updates (``op`` D, I, U; last change per key).

    Deletes come first, rows with an empty text are neither inserted nor updated, and an
    update needs a row to change.  Texts are trimmed and cut.
    """
    latest = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("op"))
    last = changes.withColumn("_rn", F.row_number().over(latest)).where("_rn = 1").drop("_rn")
    cut_text = F.substring(strip(text), 1, max_chars)
    usable = last.where((F.col("op") == "D") | _filled(text)).select(
        *keys, "op", cut_text.alias("_text"), *[F.col(v).alias(f"_{v}") for v in values]
    )
    both = table.select(*keys, text, *values, F.lit(True).alias("_old")).join(usable, keys, "full")
    update = F.col("op") == "U"
    kept = (F.col("_old") & (F.col("op").isNull() | (F.col("op") != "D"))) | (
        F.col("_old").isNull() & (F.col("op") == "I")
    )
    insert = F.col("_old").isNull()
    pick = lambda new, old: F.when(insert | F.coalesce(update, F.lit(False)), F.col(new)).otherwise(F.col(old)).alias(old)
    return both.where(kept).select(*keys, pick("_text", text), *[pick(f"_{v}", v) for v in values])


def publish_version(versions: DataFrame, publishing: DataFrame, at: Column) -> DataFrame:
    """For every published course: close the current version, promote the draft, open a new one.

    New drafts have no id yet (null); other rows keep theirs.
    """
    chosen = publishing.select("course").distinct().withColumn("_publish", F.lit(True))
    marked = versions.join(chosen, "course", "left").withColumn("_publish", F.coalesce("_publish", F.lit(False)))
    draft = F.col("start_ts").isNull() & F.col("end_ts").isNull()
    current = F.col("start_ts").isNotNull() & F.col("end_ts").isNull()
    step = (
        F.when(F.col("_publish") & current, "closed")
        .when(F.col("_publish") & draft, "promoted")
        .otherwise("unchanged")
    )
    changed = marked.select(
        "id",
        "course",
        F.when(F.col("_publish") & draft, at).otherwise(F.col("start_ts")).alias("start_ts"),
        F.when(F.col("_publish") & current, at).otherwise(F.col("end_ts")).alias("end_ts"),
        step.alias("step"),
    )
    opened = changed.where("step = 'promoted'").select(
        F.lit(None).cast("bigint").alias("id"),
        "course",
        F.lit(None).cast("timestamp").alias("start_ts"),
        F.lit(None).cast("timestamp").alias("end_ts"),
        F.lit("opened").alias("step"),
    )
    return changed.unionByName(opened)


def store_review_paths(items: KeyedTable, results: DataFrame, mark: int | None = None) -> Snapshot | None:
    """:func:`upsert_review_path` on a stored table of items by ``id``; only buckets of reviewed items are rewritten."""
    return items.merge(results, lambda old, new: old if old is None else upsert_review_path(old, new), mark)


def store_row_changes(
    table: KeyedTable, changes: DataFrame, text: str, values: Sequence[str], mark: int | None = None
) -> Snapshot | None:
    """:func:`apply_row_changes` on a stored table; only buckets of changed rows are rewritten."""
    return table.merge(changes, lambda old, new: apply_row_changes(old, new, table.keys, text, values), mark)


def store_publication(versions: KeyedTable, publishing: DataFrame, at: Column, mark: int) -> Snapshot | None:
    """:func:`publish_version` on a stored table of versions by ``course``, once per ``mark``: publishing the same
    courses again would open further drafts."""
    return versions.merge(
        publishing.select("course").distinct(), lambda old, new: publish_version(old, new, at).drop("step"), mark
    )


def latest_version(versions: DataFrame) -> DataFrame:
    """Per course: current and draft ids, number of publications, start of the last one."""
    draft = F.col("start_ts").isNull() & F.col("end_ts").isNull()
    current = F.col("start_ts").isNotNull() & F.col("end_ts").isNull()
    published = F.col("start_ts").isNotNull()
    return versions.groupBy("course").agg(
        F.max_by(F.when(current, F.col("id")), F.when(current, F.struct("start_ts", "id"))).alias("current_id"),
        F.max(F.when(draft, F.col("id"))).alias("draft_id"),
        F.count_if(published).alias("publications"),
        F.max("start_ts").alias("last_publication"),
    )


def status_view(items: DataFrame) -> DataFrame:
    """Per draft: how many items have a stored review to show."""
    return items.groupBy("draft_id").agg(
        F.count("*").alias("items"),
        F.count_if(_filled("path_rev")).alias("with_review"),
        F.when(F.bool_or(_filled("path_rev")), "review available").otherwise("clean").alias("status"),
    )


def upload_changes(form: DataFrame) -> DataFrame:
    """Files to upload: new rows, and edited rows that are neither new nor deleted."""
    has_file = F.col("has_file")
    new = form.where(F.col("is_new") & has_file).withColumn("origin", F.lit("new"))
    edited = form.where(
        F.col("is_edited") & ~F.col("is_deleted") & ~F.col("is_new") & has_file
    ).withColumn("origin", F.lit("edited"))
    return new.unionByName(edited)


def grade_total(rows: DataFrame) -> DataFrame:
    """Percents of the live rows per draft: total, rows that are not above zero, and whether
    the total is exactly 100."""
    live = ~F.col("deleted")
    total = F.coalesce(F.sum(F.when(live, F.col("pct"))), F.lit(0))
    return (
        rows.groupBy("draft_id")
        .agg(
            F.count_if(live).alias("live_rows"),
            total.alias("total"),
            F.count_if(live & (F.col("pct") <= 0)).alias("not_positive"),
        )
        .withColumn("complete", (F.col("total") == 100) & (F.col("not_positive") == 0))
    )


def row_violations(rows: DataFrame, publish: bool) -> DataFrame:
    """Which rules each draft breaks and the message that is shown.

    ``rows`` stacks the children of a draft by ``kind`` (grade, reference, experience).  When
    saving, empty texts count only on new or edited rows; when publishing, on all live rows.
    """
    live = ~F.col("deleted")
    looked_at = live if publish else live & (F.col("is_new") | F.col("is_edited"))
    empty = looked_at & ~_filled("label")
    grade = live & (F.col("kind") == "grade")
    total = F.coalesce(F.sum(F.when(grade, F.col("pct"))), F.lit(0))
    flags = rows.groupBy("draft_id").agg(
        F.bool_or(empty).alias("empty_text"),
        F.bool_or(grade & (F.col("pct") <= 0)).alias("not_positive"),
        total.alias("total"),
    ).withColumn("wrong_total", F.col("total") != 100)
    e, z, w = F.col("empty_text"), F.col("not_positive"), F.col("wrong_total")
    message = (
        F.when(e & w & z, "fields, percents and total")
        .when(e & w, "fields and total")
        .when(z & w, "percents and total")
        .when(z, "percents")
        .when(w, "total")
        .when(e, "fields")
    )
    return flags.withColumn("message", message)


def publication_readiness(
    drafts: DataFrame, grades: DataFrame, schedules: DataFrame, references: DataFrame, experiences: DataFrame
) -> DataFrame:
    """First failing check of each draft, in fixed order, or null when it can be published."""
    graded = grade_total(grades).select("draft_id", "live_rows", "total", "not_positive")
    counts = lambda df, name: df.groupBy("draft_id").agg(F.count("*").alias(name))
    active = counts(schedules.where((F.col("active") == "Y") & ~F.col("deleted")), "schedules")
    refs = counts(references.where(~F.col("deleted") & _filled("label")), "references")
    exps = counts(experiences.where(~F.col("deleted") & _filled("label")), "experiences")
    joined = drafts
    for side in (graded, active, refs, exps):
        joined = joined.join(side, "draft_id", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) < 1
    failing = (
        F.when(~_filled("rules"), "rules")
        .when(none("live_rows"), "grades")
        .when(none("schedules"), "schedule")
        .when(none("references"), "references")
        .when(none("experiences"), "experiences")
        .when(~_filled("use_note"), "use_note")
        .when(~_filled("thinking_note"), "thinking_note")
        .when(F.coalesce(F.col("total"), F.lit(0)) != 100, "total")
        .when(F.col("not_positive") > 0, "percents")
    )
    return joined.select("draft_id", failing.alias("failing_check"), failing.isNull().alias("ready"))


def course_header(
    sections: DataFrame, staff: DataFrame, people: DataFrame, roles: DataFrame, terms: DataFrame,
    courses: DataFrame, areas: DataFrame, faculties: DataFrame, cycles: DataFrame,
) -> DataFrame:
    """Course sections with staff, course, area, faculty and (optional) cycle.

    Blocked staff is left out before the join.  Dimensions are joined without hints: Spark
    broadcasts those that its statistics show to be small.
    """
    open_staff = staff.where("blocked = 'N'").drop("blocked")
    header = (
        sections.join(open_staff, "section_id")
        .join(people, "person_id")
        .join(roles, "role_id")
        .join(terms, "term_id")
        .join(courses, "course_id")
        .join(areas, "area_id")
        .join(faculties, "faculty_id")
        .join(cycles, "term_id", "left")
    )
    return header.withColumn("year", F.substring("cycle", 1, 4)).withColumn("semester", F.substring("cycle", 5, 2))


def outcomes_with_level(outcomes: DataFrame, levels: DataFrame) -> DataFrame:
    """Outcomes with the name of their level, or an empty name."""
    return outcomes.join(levels, "level_id", "left").withColumn("level", F.coalesce("level", F.lit(""))).withColumn(
        "description", F.coalesce("description", F.lit(""))
    )


def override_header(base: DataFrame, override: DataFrame, special_type: str, special: str, other: str) -> DataFrame:
    """Base headers where an override replaces name, code and section (if not null) and sets
    the faculty by the original course type."""
    o = override.select(
        "section_id",
        F.col("name").alias("_name"),
        F.col("code").alias("_code"),
        F.col("section").alias("_section"),
        F.lit(True).alias("_given"),
    )
    faculty = F.when(F.col("_given"), F.when(F.col("course_type") == special_type, special).otherwise(other))
    return base.join(o, "section_id", "left").select(
        "section_id",
        F.coalesce("_name", "name").alias("name"),
        F.coalesce("_code", "code").alias("code"),
        F.coalesce("_section", "section").alias("section"),
        F.coalesce(faculty, "faculty").alias("faculty"),
        F.coalesce("_given", F.lit(False)).alias("overridden"),
    )
