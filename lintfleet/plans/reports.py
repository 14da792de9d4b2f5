"""Reports over findings (Q01-Q08).

Findings carry path, category, severity, message, code, zero-based start/end line and column, and `verbose`.
Reports are rows; sinks write them from all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintfleet import constants as C
from lintfleet.operators.scan import Chunks, Running, running
from lintfleet.session import materialize


def emitted(findings: DataFrame, level: int = C.HINT, verbose: bool = False) -> DataFrame:
    kept = findings.filter(F.col("severity") >= level)
    return kept if verbose else kept.filter("not verbose")


def _counts() -> list[Column]:
    errors = F.count_if(F.col("severity") >= C.ERROR).alias("errors")
    return [errors, F.count_if(F.col("severity") == C.WARNING).alias("warnings")]


def severity_totals(findings: DataFrame) -> DataFrame:
    """Q01: errors (with fatal ones) and warnings; anything lower is not counted."""
    return findings.agg(*_counts())


def summary_by_path(findings: DataFrame, level: int = C.HINT, verbose: bool = False) -> DataFrame:
    """Q02: counts per path plus the total (path null), for findings of files."""
    rows = emitted(findings, level, verbose).filter("path is not null")
    return rows.rollup("path").agg(*_counts())


def traversal_summary(scripts: DataFrame, findings: DataFrame, limit: int) -> DataFrame:
    """Q03: files changed, unchanged, matching and skipped, and findings beyond the limit.

    `scripts` has a `status` per path: changed, unchanged, matched or skipped.
    """
    states = scripts.agg(*[F.count_if(F.col("status") == s).alias(n) for n, s in
                           (("changed", "changed"), ("unchanged", "unchanged"), ("matches", "matched"), ("skipped", "skipped"))])
    total = findings.agg(F.count("*").alias("n")).select(F.greatest(F.col("n") - limit, F.lit(0)).alias("not_printed"))
    return states.withColumn("_k", F.lit(1)).join(total.withColumn("_k", F.lit(1)), "_k").drop("_k")


# Severity words of each report.
QUALITY_SEVERITY = ["info", "minor", "major", "critical", "blocker"]
JSON_SEVERITY = ["hint", "info", "warning", "error", "fatal"]
ANNOTATION = ["notice", "notice", "warning", "error", "error"]
TEST_PREFIX = "org.pgls"


def _word(words: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, words)), F.col("severity"))


def code_quality(findings: DataFrame, level: int = C.HINT, verbose: bool = False, chunk: Chunks | int | None = None) -> DataFrame:
    """Q04: Code Quality rows. Fingerprints hash (code, check, path) and are rehashed with a counter when taken.

    In verbose mode only verbose findings are kept, as in the reference.
    """
    rows = findings.filter((F.col("severity") >= level) & F.col("start_byte").isNotNull())
    if verbose:
        rows = rows.filter("verbose")
    base = F.md5(F.concat_ws("|", "code", "category", "path"))
    rows = rows.withColumn("_base", base)
    order = ["start_byte", "ord", "message"]
    rows = running(rows, ["_base"], order, [Running("_taken", "count", F.lit(1))], chunk=chunk)
    unique = F.when(F.col("_taken") == 0, F.col("_base")).otherwise(F.md5(F.concat_ws("#", "_base", F.col("_taken").cast("string"))))
    return rows.select(
        F.col("message").alias("description"), F.col("category").alias("check_name"), unique.alias("fingerprint"),
        _word(QUALITY_SEVERITY).alias("severity"), "path", (F.col("start_line") + 1).alias("begin"),
    )


def code_quality_json(report: DataFrame) -> DataFrame:
    location = F.struct("path", F.struct("begin").alias("lines")).alias("location")
    return report.select(F.to_json(F.struct("description", "check_name", "fingerprint", "severity", location)).alias("value"))


def junit_cases(findings: DataFrame, level: int = C.HINT, verbose: bool = False) -> DataFrame:
    """Q05: one suite with one case per finding. Attributes count from one, the description from zero."""
    place = F.concat(F.lit("line "), F.col("start_line").cast("string"), F.lit(", col "), F.col("start_col").cast("string"), F.lit(", "), F.col("message"))
    return emitted(findings, level, verbose).select(
        F.col("path").alias("suite"), F.lit(TEST_PREFIX).alias("package"),
        F.concat(F.lit(f"{TEST_PREFIX}."), F.replace("category", F.lit("/"), F.lit("."))).alias("name"),
        (F.col("start_line") + 1).alias("line"), (F.col("start_col") + 1).alias("column"), "message", place.alias("description"),
    )


def write_junit(cases: DataFrame, path: str) -> None:
    failure = F.struct(F.col("message").alias("_message"), F.col("description").alias("_VALUE")).alias("failure")
    case = F.struct(F.col("name").alias("_name"), F.col("line").alias("_line"), F.col("column").alias("_column"), failure).alias("testcase")
    suites = cases.select(F.col("suite").alias("_name"), F.col("package").alias("_package"), case)
    suites.write.format("xml").option("rootTag", "testsuites").option("rowTag", "testsuite").save(path)


def json_report(findings: DataFrame, command: str, level: int = C.HINT, verbose: bool = False) -> DataFrame:
    """Q06: one row with the summary, and one per finding, all as JSON text."""
    rows = emitted(findings, level, verbose)

    def position(line: str, col: str) -> Column:
        return F.struct((F.col(line) + 1).alias("line"), (F.col(col) + 1).alias("column"))

    location = F.struct("path", position("start_line", "start_col").alias("start"), position("end_line", "end_col").alias("end")).alias("location")
    found = rows.select(F.lit("diagnostic").alias("part"), F.to_json(F.struct(_word(JSON_SEVERITY).alias("severity"), "message", "category", location)).alias("json"))
    summary = severity_totals(findings).select(F.lit("summary").alias("part"), F.to_json(F.struct("errors", "warnings", F.lit(command).alias("command"))).alias("json"))
    return summary.unionByName(found)


def _escape(text: Column, extra: dict[str, str] | None = None) -> Column:
    for ch, code in {"%": "%25", "\r": "%0D", "\n": "%0A", **(extra or {})}.items():
        text = F.replace(text, F.lit(ch), F.lit(code))
    return text


def annotations(findings: DataFrame, level: int = C.HINT, verbose: bool = False) -> DataFrame:
    """Q07: workflow annotation lines."""

    def one_based(name: str) -> Column:
        return (F.col(name) + 1).cast("string")

    line = F.concat(
        F.lit("::"), _word(ANNOTATION), F.lit(" title="), F.col("category"), F.lit(",file="), _escape(F.col("path"), {":": "%3A", ",": "%2C"}),
        F.lit(",line="), one_based("start_line"), F.lit(",endLine="), one_based("end_line"), F.lit(",col="), one_based("start_col"),
        F.lit(",endColumn="), one_based("end_col"), F.lit("::"), _escape(F.col("message")),
    )
    return emitted(findings, level, verbose).select(line.alias("value"))


def exit_status(scripts: DataFrame, findings: DataFrame, error_on_warnings: bool = False, allow_unmatched: bool = False) -> DataFrame:
    """Q08: one row saying whether the run fails, and why. Two totals read the findings, which are made once."""
    findings = materialize(findings.select("severity"), "severities")
    totals = traversal_summary(scripts, findings, 0).withColumn("_k", F.lit(1)).join(severity_totals(findings).withColumn("_k", F.lit(1)), "_k")
    processed = F.col("changed") + F.col("unchanged") + F.col("matches")
    reason = (
        F.when((processed == 0) & F.lit(not allow_unmatched), "no files processed")
        .when(F.col("errors") > 0, "errors")
        .when((F.col("warnings") > 0) & F.lit(error_on_warnings), "warnings")
    )
    return totals.select("errors", "warnings", reason.alias("reason"), reason.isNotNull().alias("failed"))
