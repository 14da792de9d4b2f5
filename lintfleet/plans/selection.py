"""Which rules run, at which severity, and how many findings are kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintfleet import constants as C
from lintfleet.registry import LINT_RULES


def effective_rules(configs: DataFrame) -> DataFrame:
    """(project, rule) pairs that run.

    `configs` has one row per project: `all_rules`, `recommended` (nullable booleans), `group_present`, and the
    arrays `rules_on`, `rules_off`, `only`, `skip`. A selector is a rule name or the group name. The registry is
    a fixed list, exploded inside each project's row.
    """
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.recommended).alias("rec")) for r in LINT_RULES.values()])
    rows = configs.withColumn("_r", F.explode(rules))
    rule, recommended = F.col("_r.rule"), F.col("_r.rec")

    def names(selectors: str):
        return F.array_contains(selectors, rule) | F.array_contains(selectors, "safety")

    all_on = F.coalesce("all_rules", F.lit(False))
    preset = all_on | (recommended & F.coalesce("recommended", F.lit(True)))
    configured = F.when(F.col("group_present"), (preset | F.array_contains("rules_on", rule)) & ~F.array_contains("rules_off", rule)).otherwise(preset)
    enabled = F.when(F.size("only") > 0, names("only")).otherwise(configured)
    return rows.filter(enabled & ~names("skip")).select("project", rule.alias("rule"))


def override_severity(findings: DataFrame, levels: dict[str, int]) -> DataFrame:
    """The configured level of a rule, else warning. The levels are one configuration, so they travel as a literal map."""
    if not levels:
        return findings.withColumn("severity", F.lit(C.WARNING))
    pairs = [F.lit(x) for kv in levels.items() for x in kv]
    return findings.withColumn("severity", F.coalesce(F.element_at(F.create_map(*pairs), F.col("rule")), F.lit(C.WARNING)))


def cap(findings: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """The first `limit` findings per key, and per key how many were left out.

    Ranking with a constant limit is cut down before the shuffle, so a key with very many findings sends only its
    first ones; the rest is counted with partial aggregates.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    kept = findings.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= limit).drop("_rank")
    counts = findings.groupBy(*keys).agg(F.count("*").alias("found"))
    return kept, counts.withColumn("skipped", F.greatest(F.col("found") - limit, F.lit(0)))
