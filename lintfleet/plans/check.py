"""The whole check of a script corpus (X09): texts in, findings out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintfleet.operators.keyed import union_all
from lintfleet.operators.scan import chunk_width
from lintfleet.plans import facts as FX
from lintfleet.plans import lint_rules as L
from lintfleet.plans import suppressions as X
from lintfleet.plans.known_facts import KnownFacts
from lintfleet.plans.selection import override_severity
from lintfleet.plans.statements import split_statements
from lintfleet.session import materialize, tasks_for
from lintfleet.sources.catalog import Catalog


SPAN = ["start_byte", "end_byte", "start_line", "end_line", "start_col", "end_col"]


def lint_scripts(scripts: DataFrame, rules: list[str] | None = None, cat: Catalog | None = None, write_facts: bool | None = None,
                 statements: DataFrame | None = None, code: bool = True, known: KnownFacts | None = None) -> DataFrame:
    """Findings with spans, and with the statement's text as `code`.

    `statements` are the scripts' statements where they have been split already (with db_id, for a catalog).

    `write_facts` puts the facts in a table first, so that the texts are read once and each state chain reads a few
    columns of it. By default that is done when any enabled rule needs more than its own statement. With `known`, only
    texts that no earlier run has seen are analysed.
    """
    if write_facts is None:
        write_facts = any((r.needs or r.build) for r in L.RULES.values() if rules is None or r.name in rules)
    if statements is None:
        statements = split_statements(scripts, ["script_id", *[c for c in ("db_id",) if c in scripts.columns]], "content")
    statements = statements.withColumnRenamed("stmt_no", "pos")
    extracted = known.extract(statements) if known else FX.extract(statements, arrays=L.arrays_of(rules))
    if write_facts:
        extracted = materialize(extracted, "facts")
        chunk, tasks = chunk_width(extracted, ["script_id"]), tasks_for(extracted)
    else:
        # statements of one script come out of one cell, which bounds them
        chunk = tasks = None
    # texts are wide, and state chains shuffle what they carry
    return L.lint(extracted, rules, cat, chunk, carry=[*SPAN, *["text"] * code], tasks=tasks).withColumnRenamed("text", "code")


def check(
    scripts: DataFrame,
    rules: list[str] | None = None,
    cat: Catalog | None = None,
    syntax_errors: DataFrame | None = None,
    write_facts: bool | None = None,
    database_findings: DataFrame | None = None,
    levels: dict[str, int] | None = None,
    disabled: list[str] | None = None,
    statements: DataFrame | None = None,
    known: KnownFacts | None = None,
) -> DataFrame:
    """The whole check of a corpus, in this order:

    1. a syntax error goes where a finding of the database (audit, function checks) lies inside its statement;
    2. the enabled rules run; `levels` gives severities by rule, the others are warnings;
    3. faulty, ineffective and unused comments become rows, unused ones judged against everything found so far;
    4. what a comment suppresses goes.

    `disabled` holds rules, or the group's name; comments that name one of them get a row. Without a catalog every
    database's version counts as unknown. `known` shares facts of equal texts between runs.
    """
    disabled = disabled or []
    enabled = [r.name for r in L.RULES.values() if (rules is None or r.name in rules) and r.name not in disabled and "safety" not in disabled]
    cols = ["script_id", "category", "severity", "message", "start_byte", "end_byte", "start_line", "end_line"]
    parts = []
    if database_findings is not None:
        parts.append(database_findings.select(*cols, F.lit(X.KNOWN).alias("origin")))
    if syntax_errors is not None:
        parts.append(syntax_errors.select(*cols, F.lit(X.SYNTAX).alias("origin")))
    if enabled:
        linted = lint_scripts(scripts, enabled, cat, write_facts, statements, code=False, known=known)
        parts.append(override_severity(linted, levels or {}).select(*cols, F.lit(X.LINT).alias("origin")))
    parsed = X.comments(scripts)
    if not parts:
        return X.about_comments(materialize(parsed, "comments"), None, disabled)
    # the tables hold findings and comments only, not the texts
    found, parsed = materialize(union_all(parts), "findings"), materialize(parsed, "comments")
    scripts_of = found.select("script_id").unionByName(parsed.select("script_id"))
    chunk = chunk_width(scripts_of, ["script_id"])
    if chunk is None:
        return X.judged(found, parsed, disabled, syntax_errors is not None and database_findings is not None, tasks_for(scripts_of))
    known, syntax = (found.filter(F.col("origin") == o).drop("origin") for o in (X.KNOWN, X.SYNTAX))
    syntax = X.drop_contained_syntax_errors(syntax, known, chunk)
    rest = found.filter(F.col("origin") != X.SYNTAX).drop("origin")
    return X.suppress(materialize(rest.unionByName(syntax.select(rest.columns)), "findings"), parsed, chunk, disabled)
