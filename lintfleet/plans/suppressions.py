"""Suppression comments (T09-T11) and how findings meet them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintfleet import constants as C
from lintfleet.functions.arrays import add_starts, pin
from lintfleet.operators.keyed import lookup
from lintfleet.operators.ranges import covered
from lintfleet.operators.scan import Chunks, Running, running
from lintfleet.plans.tokens import LINE_BREAK
from lintfleet.registry import LINT_RULES
from lintfleet.session import materialize

# Comment markers, tags and messages.
MARKERS = ["-- pgt-ignore", "-- pgls-ignore"]
TAG_KINDS = {"pgt-ignore-all": "file", "pgls-ignore-all": "file", "pgt-ignore-start": "start", "pgls-ignore-start": "start",
             "pgt-ignore-end": "end", "pgls-ignore-end": "end", "pgt-ignore": "line", "pgls-ignore": "line"}
BAD_TAG = "is not a valid suppression tag."
NO_SPECIFIER = "You must specify which lints to suppress."
BAD_RULE = "Invalid rule."
MISPLACED = "File suppressions should be at the top of the file."
NO_START = "This end suppression does not have a matching start."
NO_END = "This start suppression does not have a matching end."
NO_EFFECT = "This suppression has no effect."
DISABLED = "This rule has been disabled via the configuration. The suppression has no effect."

SUPPRESSION = "lint"  # category of rows about suppressions themselves


def known_specifiers() -> list[str]:
    """Every category a specifier may name: category, group, rule."""
    return ["lint", "lint/safety"] + [r.category for r in LINT_RULES.values()]


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def comments(scripts: DataFrame, content: str = "content") -> DataFrame:
    """One row per suppression comment, valid or not.

    Lines are filtered inside the script's row, so only comment rows are ever produced.
    """
    out = scripts.select("script_id", F.split(F.col(content), LINE_BREAK, -1).alias("_lines"))
    out = pin(out, _sizes=F.transform("_lines", lambda t: F.octet_length(t).cast("bigint")))
    out = add_starts(out, "_sizes", "_starts")
    trimmed = F.transform("_lines", lambda t, i: F.struct(i.alias("line"), t.alias("raw"), _trim(t).alias("text"), F.get("_starts", i).alias("at")))
    out = pin(out.select("script_id", "_starts", "_lines"), _trimmed=trimmed)
    marks = [m for m in MARKERS]

    def is_other(t: Column) -> Column:
        top = t["text"].startswith(f"{marks[0]}-all") | t["text"].startswith(f"{marks[1]}-all")
        return (t["text"] != "") & ~top

    others = F.filter("_trimmed", is_other)
    found = F.filter("_trimmed", lambda t: t["text"].startswith(marks[0]) | t["text"].startswith(marks[1]))
    out = pin(out, _first_other=F.get(others, F.lit(0))["line"])
    rows = pin(out, _marks=found).select("script_id", "_first_other", F.inline("_marks"))

    head = F.split_part("text", F.lit(":"), F.lit(1))
    words = F.split(_trim(head), r"\s+")
    explanation = F.when(F.col("text").contains(":"), _trim(F.substring(F.col("text"), F.length(head) + 2, F.lit(2147483647))))
    rows = rows.withColumn("tag", F.get(words, F.lit(1))).withColumn("specifier", F.get(words, F.lit(2)))
    pairs = [F.lit(x) for kv in TAG_KINDS.items() for x in kv]
    kind = F.element_at(F.create_map(*pairs), F.col("tag"))
    error = (
        F.when(kind.isNull(), F.concat(F.lit("'"), F.col("tag"), F.lit(f"' {BAD_TAG}")))
        .when(F.col("specifier").isNull(), NO_SPECIFIER)
        .when(~F.col("specifier").isin(known_specifiers()), BAD_RULE)
    )
    parts = F.split("specifier", "/")
    start = F.col("at") + F.octet_length("raw") - F.octet_length(F.regexp_replace("raw", r"^\s+", ""))
    leading = F.col("_first_other").isNull() | (F.col("line") < F.col("_first_other"))
    return rows.select(
        "script_id", "line", start.alias("start_byte"), (start + F.octet_length("text")).alias("end_byte"), kind.alias("kind"),
        F.when(error.isNull(), F.col("specifier")).alias("specifier"), F.when(error.isNull(), F.get(parts, F.lit(0))).alias("category"),
        F.when(error.isNull(), F.get(parts, F.lit(1))).alias("grp"), F.when(error.isNull(), F.get(parts, F.lit(2))).alias("rule"),
        explanation.alias("explanation"), error.alias("error"), leading.alias("leading"),
    )


def valid(parsed: DataFrame, *kinds: str) -> DataFrame:
    return parsed.filter(F.col("error").isNull() & F.col("kind").isin(*kinds))


def file_suppressions(parsed: DataFrame) -> DataFrame:
    """-all comments; only those of the leading run count, later ones are errors."""
    rows = valid(parsed, "file")
    return rows.select("script_id", "line", "start_byte", "end_byte", "specifier", F.when(~F.col("leading"), MISPLACED).alias("error"))


def range_suppressions(parsed: DataFrame, chunk: Chunks | int | None = None) -> DataFrame:
    """An END closes the latest open START of the same specifier; whatever stays single is an error row.

    Depth is the running sum of +1 and -1, lifted whenever a stray END would push it below zero. A START and its
    END share specifier and depth, and nothing of that depth lies between them.
    """
    keys = ["script_id", "specifier"]
    rows = valid(parsed, "start", "end").select(*keys, "line", "kind", "start_byte", "end_byte")
    change = F.when(F.col("kind") == "start", 1).otherwise(-1)
    rows = running(rows, keys, ["line"], [Running("_before", "sum", change)], chunk=chunk)
    rows = running(rows, keys, ["line"], [Running("_low", "min", F.col("_before"))], before=False, chunk=chunk)
    depth = F.col("_before") - F.least(F.lit(0), F.col("_low"))
    rows = rows.withColumn("depth", F.when(F.col("kind") == "start", depth + 1).otherwise(depth))
    later = F.struct("kind", "end_byte")
    rows = running(rows, [*keys, "depth"], ["line"], [Running("_next", "last", later)], reverse=True, chunk=chunk)
    error = (
        F.when((F.col("kind") == "end") & (F.col("depth") == 0), NO_START)
        .when((F.col("kind") == "start") & (F.coalesce(F.col("_next.kind"), F.lit("")) != "end"), NO_END)
    )
    rows = rows.withColumn("error", error).filter((F.col("kind") == "start") | F.col("error").isNotNull())
    end = F.when(F.col("error").isNull(), F.col("_next.end_byte")).otherwise(F.col("end_byte"))
    return rows.select("script_id", "specifier", "line", "start_byte", end.alias("end_byte"), "error")


def line_suppressions(parsed: DataFrame, chunk: Chunks | int | None = None) -> DataFrame:
    """Line comments with the line they aim at: the first following one that holds no line comment itself."""
    rows = valid(parsed, "line").select("script_id", "specifier", "line", "start_byte", "end_byte")
    rows = running(rows, ["script_id"], ["line"], [Running("_next", "last", F.col("line"))], reverse=True, chunk=chunk)
    last_of_run = F.when(F.col("_next").isNull() | (F.col("_next") != F.col("line") + 1), F.col("line"))
    rows = running(rows, ["script_id"], ["line"], [Running("_end", "last", last_of_run)], before=False, reverse=True, chunk=chunk)
    return rows.withColumn("target_line", F.col("_end") + 1).drop("_next", "_end")


# ------------------------------------------------------------------ findings against comments

SPAN = ["script_id", "category", "start_byte", "end_byte", "start_line", "end_line"]


def specifiers(category: Column) -> Column:
    """The specifiers that match a category: itself, its group, its kind."""
    parts = F.split(category, "/")
    return F.array_distinct(F.array(F.get(parts, F.lit(0)), F.array_join(F.slice(parts, 1, 2), "/"), category))


def spans_of(findings: DataFrame) -> DataFrame:
    """Suppression looks at category and span only, so equal ones are judged once."""
    return findings.select(*SPAN).distinct()


def _exploded(spans: DataFrame, having: DataFrame) -> DataFrame:
    """Spans of scripts that have comments, one row per matching specifier."""
    scripts = having.select("script_id").distinct()
    return lookup(spans, scripts, ["script_id"], "left_semi").withColumn("specifier", F.explode(specifiers(F.col("category"))))


def by_file(findings: DataFrame, parsed: DataFrame) -> DataFrame:
    """Adds `file_suppressed`. A script's file specifiers form a set no larger than the rule registry."""
    named = file_suppressions(parsed).filter("error is null").groupBy("script_id").agg(F.collect_set("specifier").alias("_named"))
    joined = lookup(findings, named, ["script_id"], "left")
    hit = F.coalesce(F.arrays_overlap("_named", specifiers(F.col("category"))), F.lit(False))
    return joined.withColumn("file_suppressed", hit).drop("_named")


def line_hits(findings: DataFrame, targets: DataFrame, chunk: Chunks | int | None = None) -> DataFrame:
    """Spans whose lines hold the target of a matching line comment."""
    asks = _exploded(spans_of(findings), targets)
    found = covered(
        asks, targets, ["script_id", "specifier"], ask_at=F.col("end_line"), ask_reach=F.col("start_line"),
        offer_at=F.col("target_line"), offer_reach=F.col("target_line"), name="_hit", chunk=chunk,
    )
    return found.filter("_hit").select(*SPAN).distinct()


def range_hits(findings: DataFrame, ranges: DataFrame, chunk: Chunks | int | None = None) -> DataFrame:
    """Spans that lie wholly inside a matching START/END range."""
    good = ranges.filter("error is null")
    asks = _exploded(spans_of(findings), good)
    found = covered(
        asks, good, ["script_id", "specifier"], ask_at=F.col("start_byte"), ask_reach=F.col("end_byte"),
        offer_at=F.col("start_byte"), offer_reach=F.col("end_byte"), name="_hit", chunk=chunk,
    )
    return found.filter("_hit").select(*SPAN).distinct()


def unused(findings: DataFrame, targets: DataFrame, chunk: Chunks | int | None = None) -> DataFrame:
    """Line comments whose target line no matching finding touches, judged before anything is suppressed."""
    offers = _exploded(spans_of(findings), targets)
    found = covered(
        targets, offers, ["script_id", "specifier"], ask_at=F.col("target_line"), ask_reach=F.col("target_line"),
        offer_at=F.col("start_line"), offer_reach=F.col("end_line"), name="_used", chunk=chunk,
    )
    return found.filter("not _used").select("script_id", "line", "start_byte", "end_byte", F.lit(NO_EFFECT).alias("message"))


def on_disabled(parsed: DataFrame, disabled: list[str], ranges: DataFrame) -> DataFrame:
    """Effective comments that name a disabled group (`safety`) or rule. Whole categories cannot be disabled."""
    groups = [d for d in disabled if d == "safety"]
    rules = [d for d in disabled if d != "safety"]
    good = ranges.filter("error is null").select("script_id", "line")
    starts = valid(parsed, "start").join(good, ["script_id", "line"], "left_semi")
    effective = valid(parsed, "line").unionByName(valid(parsed, "file").filter("leading")).unionByName(starts)
    named = F.coalesce(F.col("grp").isin(groups), F.lit(False)) | F.coalesce(F.col("rule").isin(rules), F.lit(False))
    return effective.filter(named).select("script_id", "line", "start_byte", "end_byte", F.lit(DISABLED).alias("message"))


def comment_errors(parsed: DataFrame, ranges: DataFrame) -> DataFrame:
    """Malformed, misplaced and unpaired comments as finding rows."""
    cols = ["script_id", "line", "start_byte", "end_byte"]
    bad = parsed.filter("error is not null").select(*cols, F.col("error").alias("message"))
    misplaced = file_suppressions(parsed).filter("error is not null").select(*cols, F.col("error").alias("message"))
    unpaired = ranges.filter("error is not null").select(*cols, F.col("error").alias("message"))
    return bad.unionByName(misplaced).unionByName(unpaired)


def drop_contained_syntax_errors(syntax: DataFrame, findings: DataFrame, chunk: Chunks | int | None = None) -> DataFrame:
    """A syntax error goes when a finding known before linting lies inside its span."""
    found = covered(
        syntax, findings.select("script_id", "start_byte", "end_byte").distinct(), ["script_id"], ask_at=-F.col("start_byte"),
        ask_reach=-F.col("end_byte"), offer_at=-F.col("start_byte"), offer_reach=-F.col("end_byte"), name="_subsumed", chunk=chunk,
    )
    return found.filter("not _subsumed").drop("_subsumed")


def about_comments(
    parsed: DataFrame, findings: DataFrame | None, disabled: list[str], ranges: DataFrame | None = None, targets: DataFrame | None = None,
    chunk: Chunks | int | None = None,
) -> DataFrame:
    """One finding row per faulty, ineffective or unused comment."""
    ranges = range_suppressions(parsed, chunk) if ranges is None else ranges
    targets = line_suppressions(parsed, chunk) if targets is None else targets
    about = comment_errors(parsed, ranges)
    if disabled:
        about = about.unionByName(on_disabled(parsed, disabled, ranges))
    if findings is None:
        idle = targets.select("script_id", "line", "start_byte", "end_byte", F.lit(NO_EFFECT).alias("message"))
    else:
        idle = unused(findings, targets, chunk)
    return about.unionByName(idle).select(
        "script_id", F.lit(SUPPRESSION).alias("category"), F.lit(C.WARNING).alias("severity"), "message", "start_byte", "end_byte",
        F.col("line").alias("start_line"), F.col("line").alias("end_line"),
    )


# ------------------------------------------------------------------ all of it in one sweep

KNOWN, SYNTAX, LINT = range(3)  # where a finding comes from: known before linting, a syntax error, a lint rule
AT = ["start_byte", "end_byte", "start_line", "end_line"]
_OF_COMMENTS = {"kind": "string", "leading": "boolean", "off": "boolean", "error": "string", "unpaired": "string", "reach": "long", "target": "long"}


def _by_script(rows: DataFrame, tasks: int | None) -> DataFrame:
    return rows.repartition(tasks, "script_id") if tasks else rows.repartition("script_id")


def _comment_events(parsed: DataFrame, disabled: list[str], tasks: int | None = None) -> DataFrame:
    """One row per comment with what findings may meet: where a range ends (`reach`), the line that is aimed at (`target`)."""
    rows = _by_script(parsed, tasks)
    whole, good = Window.unboundedPreceding, F.col("error").isNull()
    kind = F.when(good, F.col("kind"))

    # The running sum of starts and ends, lifted where a stray end would push it below zero, is a pair's depth
    by_line = Window.partitionBy("script_id", "specifier").orderBy("line")
    rows = rows.withColumn("_change", F.when(kind == "start", 1).when(kind == "end", -1))
    rows = rows.withColumn("_before", F.coalesce(F.sum("_change").over(by_line.rowsBetween(whole, -1)), F.lit(0)))
    low = F.min(F.when(F.col("_change").isNotNull(), F.col("_before"))).over(by_line.rowsBetween(whole, Window.currentRow))
    depth = F.col("_before") - F.least(F.lit(0), low) + F.when(F.col("_change") == 1, 1).otherwise(0)
    rows = rows.withColumn("_depth", F.when(F.col("_change").isNotNull(), depth))
    after = F.lead(F.struct(kind.alias("kind"), "end_byte")).over(Window.partitionBy("script_id", "specifier", "_depth").orderBy("line"))
    rows = rows.withColumn("_next", F.when(F.col("_change").isNotNull(), after))
    open_start = (F.col("_change") == 1) & (F.coalesce(F.col("_next.kind"), F.lit("")) != "end")
    rows = rows.withColumn("unpaired", F.when((F.col("_change") == -1) & (F.col("_depth") == 0), NO_START).when(open_start, NO_END))
    reach = F.when((F.col("_change") == 1) & F.col("unpaired").isNull(), F.col("_next.end_byte"))

    # the line that a line comment aims at is below the run of such lines that it stands in
    up = Window.partitionBy("script_id").orderBy(F.desc("line"))
    rows = rows.withColumn("_line", F.when(kind == "line", F.col("line")))
    rows = rows.withColumn("_below", F.last("_line", ignorenulls=True).over(up.rowsBetween(whole, -1)))
    ends_run = F.when(F.col("_below").isNull() | (F.col("_below") != F.col("_line") + 1), F.col("_line"))
    rows = rows.withColumn("_ends", ends_run).withColumn("_stop", F.last("_ends", ignorenulls=True).over(up.rowsBetween(whole, Window.currentRow)))

    off = F.coalesce(F.col("grp").isin([d for d in disabled if d == "safety"]), F.lit(False)) | F.coalesce(
        F.col("rule").isin([d for d in disabled if d != "safety"]), F.lit(False))
    return rows.select(
        "script_id", F.col("specifier").alias("spec"), "start_byte", "end_byte", F.col("line").alias("start_line"), F.col("line").alias("end_line"),
        kind.alias("kind"), "leading", off.alias("off"), "error", "unpaired", reach.cast("long").alias("reach"),
        F.when(F.col("_line").isNotNull(), F.col("_stop") + 1).cast("long").alias("target"),
    )


def judge(findings: DataFrame, parsed: DataFrame, disabled: list[str] | None = None, subsume: bool = False, tasks: int | None = None) -> DataFrame:
    """X03-X06 at once, and with `subsume` X02: findings and comments of a script in one exchange, then ordered scans over them.

    `findings` has script_id, category, the columns of AT, `origin` (see KNOWN) and any others. The result has one row per
    category and span of findings, with the findings as `found` (structs of the other columns) and whether a file comment, a
    line comment or a range suppresses them, and one row per comment, with `messages` about it and `idle` for a line comment
    without effect. Syntax errors that a finding known before linting lies inside of are gone. All windows are by
    script_id, or by it and more, so rows are dealt once; a script comes out of one cell, which bounds them. They are dealt out
    to as many `tasks` as given (see `tasks_for`), since each of the scans sorts a task's rows anew.
    """
    others = [c for c in findings.columns if c not in ("script_id", "category", "origin", *AT)]
    payload = F.struct(*others) if others else F.struct(F.lit(0).alias("none"))
    found = findings.select("script_id", "category", "origin", *AT, payload.alias("found"), F.lit(None).cast("string").alias("spec"),
                            *[F.lit(None).cast(t).alias(c) for c, t in _OF_COMMENTS.items()])
    about = _comment_events(parsed, disabled or [], tasks).select(
        "script_id", F.lit(None).cast("string").alias("category"), F.lit(None).cast("int").alias("origin"), *AT,
        F.lit(None).cast(found.schema["found"].dataType).alias("found"), "spec", *_OF_COMMENTS,
    )
    rows = _by_script(found.unionByName(about), tasks).withColumn("is_found", F.col("origin").isNotNull())
    whole, is_found, kind = Window.unboundedPreceding, F.col("is_found"), F.col("kind")
    if subsume:  # from the last start on, the least end among the findings known before linting
        down = Window.partitionBy("script_id").orderBy(F.desc("start_byte"), F.coalesce(F.col("origin"), F.lit(SYNTAX)) != KNOWN)
        inner = F.min(F.when(F.col("origin") == KNOWN, F.col("end_byte"))).over(down.rowsBetween(whole, Window.currentRow))
        rows = rows.withColumn("_inner", inner).filter(~F.coalesce((F.col("origin") == SYNTAX) & (F.col("_inner") <= F.col("end_byte")), F.lit(False))).drop("_inner")

    # a finding answers to up to three specifiers
    names = F.when(is_found, specifiers(F.col("category"))).otherwise(F.array("spec"))
    rows = rows.select(*[c for c in rows.columns if c != "spec"], F.posexplode(names).alias("_part", "spec"))
    rows = rows.withColumn("found", F.when(F.col("_part") == 0, F.col("found")))

    # each asks for the farthest reach among what begins before it; what is asked for comes first where both begin at one place
    def reach(value: Column, place: Column, asks: Column) -> Column:
        return F.max(value).over(Window.partitionBy("script_id", "spec").orderBy(place, asks).rowsBetween(whole, Window.currentRow))

    rows = rows.withColumn("_aimed", reach(F.col("target"), F.coalesce("target", "end_line"), is_found))
    rows = rows.withColumn("_closed", reach(F.col("reach"), F.col("start_byte"), is_found))
    rows = rows.withColumn("_touched", reach(F.when(is_found, F.col("end_line")), F.coalesce("target", "start_line"), ~is_found))
    rows = rows.withColumn("_file", F.max(F.when(kind == "file", F.col("leading"))).over(Window.partitionBy("script_id", "spec")))

    def hit(condition: Column) -> Column:
        return F.bool_or(is_found & F.coalesce(condition, F.lit(False)))

    idle = F.coalesce(kind == "line", F.lit(False)) & ~F.coalesce(F.col("_touched") >= F.col("target"), F.lit(False))
    effective = (kind == "line") | ((kind == "file") & F.col("leading")) | ((kind == "start") & F.col("unpaired").isNull())
    messages = F.array(
        F.col("error"), F.when((kind == "file") & ~F.col("leading"), MISPLACED), F.col("unpaired"), F.when(F.col("off") & effective, DISABLED),
        F.when(idle, NO_EFFECT),
    )
    return rows.groupBy("script_id", "is_found", "category", *AT).agg(
        hit(F.col("_file")).alias("by_file"), hit(F.col("_aimed") >= F.col("start_line")).alias("by_line"),
        hit(F.col("_closed") >= F.col("end_byte")).alias("by_range"), F.bool_or(idle).alias("idle"),
        F.collect_list("found").alias("found"), F.flatten(F.collect_list(F.filter(messages, lambda m: m.isNotNull()))).alias("messages"),
    )


def judged(findings: DataFrame, parsed: DataFrame, disabled: list[str] | None = None, subsume: bool = False, tasks: int | None = None) -> DataFrame:
    """Findings no comment suppresses, plus one row per faulty, ineffective or unused comment: severity and message are the other columns of `findings`."""
    rows = judge(findings, parsed, disabled, subsume, tasks)
    kept = F.when(F.col("is_found") & ~F.col("by_file") & ~F.col("by_line") & ~F.col("by_range"), F.transform("found", lambda f: F.struct(f["severity"].alias("severity"), f["message"].alias("message"))))
    said = F.transform("messages", lambda m: F.struct(F.lit(C.WARNING).alias("severity"), m.alias("message")))
    rows = rows.withColumn("_rows", F.when(F.col("is_found"), kept).otherwise(said))
    category = F.coalesce("category", F.lit(SUPPRESSION)).alias("category")
    return rows.select("script_id", category, *AT, F.inline("_rows")).select("script_id", "category", "severity", "message", *AT)


def suppress(findings: DataFrame, parsed: DataFrame, chunk: Chunks | int | None = None, disabled: list[str] | None = None) -> DataFrame:
    """Findings no comment suppresses, plus one row per faulty, ineffective or unused comment."""
    # each is read by several branches
    ranges = materialize(range_suppressions(parsed, chunk), "ranges")
    targets = materialize(line_suppressions(parsed, chunk), "targets")
    hits = line_hits(findings, targets, chunk).unionByName(range_hits(findings, ranges, chunk))
    kept = by_file(findings, parsed).filter("not file_suppressed").drop("file_suppressed").join(hits, SPAN, "left_anti")
    rows = about_comments(parsed, findings, disabled or [], ranges, targets, chunk)
    return kept.select(rows.columns).unionByName(rows)
