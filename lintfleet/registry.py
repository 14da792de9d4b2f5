"""The rule registry (U01) and its listing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession


@dataclass(frozen=True)
class LintRule:
    """A rule over statement facts.

    `hits` gives, per row, an array of (ord, message); `build` instead turns the facts into finding rows when a
    rule needs more than its own row, such as the target database's catalog.
    """

    id: str
    name: str
    severity: int
    recommended: bool
    group: str = "safety"
    needs: list[str] = field(default_factory=list)
    hits: Callable[[], Column] | None = None
    build: Callable[..., DataFrame] | None = None

    @property
    def category(self) -> str:
        return f"lint/{self.group}/{self.name}"


LINT_RULES: dict[str, LintRule] = {}


def rules_frame(spark: SparkSession) -> DataFrame:
    """All lint and catalog rules as rows; a fixed list, so always small enough to broadcast."""
    from lintfleet.plans import audit_rules, lint_rules, scorecard
    from lintfleet import constants as C

    rows = [("lint", r.group, r.name, r.category, r.severity, r.recommended) for r in lint_rules.RULES.values()]
    rows += [
        ("catalog", r.group, r.name, f"catalog/{r.group}/{r.name}", C.LEVEL_SEVERITY[r.level], True)
        for r in audit_rules.RULES.values()
    ]
    rows += [("scorecard", r.scope, r.name, f"scorecard/{r.scope}/{r.name}", C.WARNING, True) for r in scorecard.RULES.values()]
    return spark.createDataFrame(rows, "kind string, grp string, rule string, category string, severity int, recommended boolean")
