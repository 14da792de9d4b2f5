"""Catalog scorecard (P00, B, S, C): per database, the share of offending objects against two thresholds.

The predicates are our reading of the rule descriptions. Every rule is a base table of objects with one flag; the
flags are counted per database with partial aggregates, so the shuffle carries one row per task and database.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintfleet import constants as C
from lintfleet.functions import scalars as S
from lintfleet.operators.keyed import lookup, union_all
from lintfleet.plans import audit_rules as D
from lintfleet.plans import catalog_dims as K
from lintfleet.sources.catalog import Catalog

COLUMNS = ["db_id", "rule", "violations", "total", "percent", "level"]


@dataclass(frozen=True)
class ScoreRule:
    id: str
    name: str
    scope: str
    warning: int
    error: int
    objects: Callable[[Catalog], DataFrame]

    def score(self, cat: Catalog) -> DataFrame:
        """One row per database that has any such object."""
        counted = self.objects(cat).groupBy("db_id").agg(
            F.count_if("violates").alias("violations"), F.count("*").alias("total")
        )
        percent = F.round(F.col("violations") * 100.0 / F.col("total"), 2)
        level = F.when(F.col("percent") >= self.error, "error").when(F.col("percent") >= self.warning, "warning").otherwise("ok")
        return counted.withColumn("percent", percent).withColumn("level", level).withColumn("rule", F.lit(self.name)).select(COLUMNS)


RULES: dict[str, ScoreRule] = {}


def rule(id: str, name: str, scope: str, warning: int, error: int):
    """`objects` gives db_id, classid, objid, violates: one row per counted object."""

    def add(objects: Callable[[Catalog], DataFrame]):
        RULES[id] = ScoreRule(id, name, scope, warning, error, objects)
        return objects

    return add


def _tables(cat: Catalog) -> DataFrame:
    skip = ["pg_catalog", "information_schema"]
    return D.relations(cat, ["r"], skip).select("db_id", "oid", "relname", "nspname", "relnamespace", "relowner")


def _schemas(cat: Catalog) -> DataFrame:
    spaces = cat["namespace"].filter(~F.col("nspname").isin("pg_catalog", "information_schema") & ~F.col("nspname").startswith("pg_"))
    return spaces.select("db_id", F.col("oid").alias("nspoid"), "nspname", "nspowner")


def _objects(df: DataFrame, violates: Column, classid: int = C.PG_CLASS, oid: str = "oid") -> DataFrame:
    return df.select("db_id", F.lit(classid).cast("bigint").alias("classid"), F.col(oid).cast("bigint").alias("objid"),
                     F.coalesce(violates, F.lit(False)).alias("violates"))


def _flag(df: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(hits.select(*keys).distinct().withColumn("_hit", F.lit(True)), keys, "left")


@rule("B001", "how_many_table_without_primary_key", "base", 1, 80)
def _(cat: Catalog) -> DataFrame:
    keyed = cat["index"].filter("indisprimary").select("db_id", F.col("indrelid").alias("oid"))
    return _objects(_flag(_tables(cat), keyed, ["db_id", "oid"]), F.col("_hit").isNull())


def redundant_indexes(cat: Catalog) -> DataFrame:
    """Indexes whose columns start, or equal, those of another index of the table.

    Every index is expanded into its column prefixes, so the test is an equality on (table, prefix) and no two
    indexes of a table are paired: per prefix only the number of indexes and the longest one are kept.
    """
    idx = cat["index"].select("db_id", "indrelid", "indexrelid", S.int_list(F.col("indkey")).alias("cols"))
    prefixes = idx.select("db_id", "indrelid", F.explode(F.transform(F.sequence(F.lit(1), F.size("cols")), lambda n: F.slice("cols", 1, n))).alias("cols"))
    covered = prefixes.groupBy("db_id", "indrelid", "cols").agg(F.count("*").alias("holders")).filter("holders > 1")
    return idx.join(covered, ["db_id", "indrelid", "cols"]).select("db_id", "indexrelid")


@rule("B002", "how_many_redudant_index", "base", 1, 80)
def _(cat: Catalog) -> DataFrame:
    idx = cat["index"].select("db_id", "indexrelid")
    return _objects(_flag(idx, redundant_indexes(cat), ["db_id", "indexrelid"]), F.col("_hit"), oid="indexrelid")


@rule("B003", "how_many_table_without_index_on_fk", "base", 1, 80)
def _(cat: Catalog) -> DataFrame:
    bare = D.uncovered_foreign_keys(D.foreign_keys(cat), cat).select("db_id", F.col("conrelid").alias("oid"))
    return _objects(_flag(_tables(cat), bare, ["db_id", "oid"]), F.col("_hit"))


@rule("B004", "how_many_unused_index", "base", 20, 80)
def _(cat: Catalog) -> DataFrame:
    unused = cat["stat_index"].filter("idx_scan = 0").select("db_id", "indexrelid")
    idx = cat["index"].select("db_id", "indexrelid", "indisunique")
    return _objects(_flag(idx, unused, ["db_id", "indexrelid"]), F.col("_hit") & ~F.col("indisunique"), oid="indexrelid")


def _named_objects(cat: Catalog) -> DataFrame:
    """Tables, sequences, columns, indexes and functions with their names."""
    parts = [
        cat["class"].filter(F.col("relkind").isin("r", "S")).select("db_id", F.lit(C.PG_CLASS).alias("classid"), "oid", F.col("relname").alias("name")),
        cat["attribute"].filter("attnum > 0 and not attisdropped").select("db_id", F.lit(C.PG_ATTRIBUTE).alias("classid"), F.col("attrelid").alias("oid"), F.col("attname").alias("name")),
        cat["index_class"].select("db_id", F.lit(C.PG_CLASS).alias("classid"), "oid", F.col("relname").alias("name")),
        cat["proc"].select("db_id", F.lit(C.PG_PROC).alias("classid"), "oid", F.col("proname").alias("name")),
    ]
    return union_all(parts)


def _named(cat: Catalog, violates: Column) -> DataFrame:
    return _named_objects(cat).select("db_id", F.col("classid").cast("bigint").alias("classid"), F.col("oid").alias("objid"), violates.alias("violates"))


@rule("B005", "how_many_objects_with_uppercase", "base", 20, 80)
def _(cat: Catalog) -> DataFrame:
    return _named(cat, F.col("name") != F.lower("name"))


@rule("B006", "how_many_tables_never_selected", "base", 1, 80)
def _(cat: Catalog) -> DataFrame:
    scans = cat["stat_table"].select("db_id", F.col("relid").alias("oid"), (F.coalesce("seq_scan", F.lit(0)) + F.coalesce("idx_scan", F.lit(0))).alias("scans"))
    return _objects(_tables(cat).join(scans, ["db_id", "oid"], "left"), F.col("scans") == 0)


@rule("B007", "how_many_tables_with_fk_outside_schema", "base", 20, 80)
def _(cat: Catalog) -> DataFrame:
    spaces = cat["class"].select("db_id", "oid", "relnamespace")
    fks = cat["constraint"].filter(F.col("contype") == "f").select("db_id", F.col("conrelid").alias("oid"), "confrelid")
    targets = spaces.select("db_id", F.col("oid").alias("confrelid"), F.col("relnamespace").alias("target_space"))
    outside = fks.join(spaces, ["db_id", "oid"]).join(targets, ["db_id", "confrelid"]).filter("relnamespace <> target_space")
    return _objects(_flag(_tables(cat), outside, ["db_id", "oid"]), F.col("_hit"))


@rule("B008", "how_many_tables_with_fk_mismatch", "base", 1, 80)
def _(cat: Catalog) -> DataFrame:
    fks = cat["constraint"].filter(F.col("contype") == "f")
    pairs = fks.select("db_id", F.col("conrelid").alias("oid"), "confrelid",
                       F.explode(F.arrays_zip(S.int_list(F.col("conkey")).alias("a"), S.int_list(F.col("confkey")).alias("b"))).alias("p"))
    pairs = pairs.select("db_id", "oid", "confrelid", "p.a", "p.b")
    own = cat["attribute"].select("db_id", F.col("attrelid").alias("oid"), F.col("attnum").cast("bigint").alias("a"), F.col("atttypid").alias("own_type"))
    other = cat["attribute"].select("db_id", F.col("attrelid").alias("confrelid"), F.col("attnum").cast("bigint").alias("b"), F.col("atttypid").alias("other_type"))
    mismatched = pairs.join(own, ["db_id", "oid", "a"]).join(other, ["db_id", "confrelid", "b"]).filter("own_type <> other_type")
    return _objects(_flag(_tables(cat), mismatched, ["db_id", "oid"]), F.col("_hit"))


@rule("B009", "how_many_tables_with_same_trigger", "base", 20, 80)
def _(cat: Catalog) -> DataFrame:
    uses = cat["trigger"].filter("not tgisinternal").select("db_id", F.col("tgrelid").alias("oid"), "tgfoid").distinct()
    shared = uses.groupBy("db_id", "tgfoid").agg(F.count("*").alias("tables")).filter("tables > 1")
    hit = uses.join(shared, ["db_id", "tgfoid"], "left").groupBy("db_id", "oid").agg(F.bool_or(F.col("tables").isNotNull()).alias("violates"))
    return _objects(hit, F.col("violates"))


@rule("B010", "how_many_tables_with_reserved_keywords", "base", 20, 80)
def _(cat: Catalog) -> DataFrame:
    return _named(cat, S.in_words("lower(name)", C.RESERVED_WORDS))


@rule("B011", "several_table_owner_in_schema", "base", 1, 80)
def _(cat: Catalog) -> DataFrame:
    owners = _tables(cat).groupBy("db_id", F.col("relnamespace").alias("nspoid")).agg(F.count_distinct("relowner").alias("owners"))
    return _objects(_schemas(cat).join(owners, ["db_id", "nspoid"], "left"), F.col("owners") > 1, C.PG_NAMESPACE, "nspoid")


@rule("B012", "composite_primary_key_too_many_columns", "base", 1, 80)
def _(cat: Catalog) -> DataFrame:
    wide = cat["index"].filter(F.col("indisprimary") & (F.size(S.int_list(F.col("indkey"))) > 4))
    return _objects(_flag(_tables(cat), wide.select("db_id", F.col("indrelid").alias("oid")), ["db_id", "oid"]), F.col("_hit"))


@rule("S001", "schema_with_default_role_not_granted", "schema", 1, 1)
def _(cat: Catalog) -> DataFrame:
    granted = cat["default_acl"].select("db_id", F.col("defaclnamespace").alias("nspoid"))
    return _objects(_flag(_schemas(cat), granted, ["db_id", "nspoid"]), F.col("_hit").isNull(), C.PG_NAMESPACE, "nspoid")


@rule("S002", "schema_prefixed_or_suffixed_with_envt", "schema", 1, 1)
def _(cat: Catalog) -> DataFrame:
    words = "|".join(C.ENVIRONMENT_WORDS)
    return _objects(_schemas(cat), F.col("nspname").rlike(f"(?i)^(?:{words})|(?:{words})$"), C.PG_NAMESPACE, "nspoid")


@rule("S003", "unsecured_public_schema", "schema", 1, 80)
def _(cat: Catalog) -> DataFrame:
    open_to_all = cat["ns_acl"].filter((F.col("grantee") == "-") & (F.col("privilege_type") == "CREATE")).select("db_id", "nspoid")
    return _objects(_flag(_schemas(cat), open_to_all, ["db_id", "nspoid"]), F.col("_hit"), C.PG_NAMESPACE, "nspoid")


@rule("S004", "owner_schema_is_internal_role", "schema", 20, 80)
def _(cat: Catalog) -> DataFrame:
    owners = cat["role"].select("db_id", F.col("oid").alias("nspowner"), "rolname", "rolsuper")
    internal = F.col("rolsuper") | F.col("rolname").startswith("pg_") | (F.col("rolname") == "postgres")
    return _objects(_schemas(cat).join(owners, ["db_id", "nspowner"], "left"), internal, C.PG_NAMESPACE, "nspoid")


@rule("S005", "schema_owner_do_not_match_table_owner", "schema", 20, 80)
def _(cat: Catalog) -> DataFrame:
    owners = _schemas(cat).select("db_id", F.col("nspoid").alias("relnamespace"), "nspowner")
    return _objects(_tables(cat).join(owners, ["db_id", "relnamespace"]), F.col("relowner") != F.col("nspowner"))


def _hba(cat: Catalog, methods: list[str]) -> DataFrame:
    return cat["hba"].select("db_id", F.lit(0).cast("bigint").alias("classid"), F.col("line_number").alias("objid"), F.col("auth_method").isin(methods).alias("violates"))


@rule("C001", "pg_hba_entries_with_method_trust_should_not_exists", "cluster", 20, 80)
def _(cat: Catalog) -> DataFrame:
    return _hba(cat, ["trust"])


@rule("C002", "pg_hba_entries_with_method_trust_or_password_should_not_exists", "cluster", 20, 80)
def _(cat: Catalog) -> DataFrame:
    return _hba(cat, ["trust", "password"])


@rule("C003", "password_encryption_is_md5", "cluster", 20, 80)
def _(cat: Catalog) -> DataFrame:
    value = K.setting(cat, "password_encryption", "value")
    return value.select("db_id", F.lit(0).cast("bigint").alias("classid"), F.lit(0).cast("bigint").alias("objid"), (F.col("value") == "md5").alias("violates"))


EXTENSION = "pglinter"  # fixed value: the extension whose presence the scorecard needs


def scorecard(cat: Catalog, enabled: list[str] | None = None, disabled_upstream: list[str] | None = None) -> DataFrame:
    """All scores of the enabled rules that are not disabled upstream."""
    rules = [r for r in RULES.values() if (enabled is None or r.id in enabled) and r.id not in (disabled_upstream or [])]
    return union_all([r.score(cat) for r in rules])


def violations(cat: Catalog, rules: list[str]) -> DataFrame:
    """Single offending objects: rule_code, db_id, classid, objid, objsubid."""
    parts = [
        RULES[i].objects(cat).filter("violates").select(F.lit(i).alias("rule_code"), "db_id", "classid", "objid", F.lit(0).alias("objsubid"))
        for i in rules
    ]
    return union_all(parts)


def report(
    cat: Catalog, found: DataFrame, messages: DataFrame, enabled: list[str], disabled_upstream: list[str]
) -> DataFrame:
    """One row per violation of a runnable rule with its object and message, one per rule disabled upstream,
    and one per database that lacks the extension (which then gets nothing else)."""
    installed = cat["extension"].filter(F.col("extname") == EXTENSION).select("db_id")
    databases = cat["namespace"].select("db_id").distinct()
    runnable = [r for r in enabled if r not in disabled_upstream]
    resolved = K.resolve_objects(found.filter(F.col("rule_code").isin(runnable)).join(installed, "db_id", "left_semi"), cat)
    name = F.concat_ws(".", "schema", "object_name")
    text = F.coalesce(F.replace(F.col("message"), F.lit("{object}"), name), F.concat(F.col("rule_code"), F.lit(" violated by "), name))
    rows = lookup(resolved, messages, ["rule_code"]).select("db_id", "rule_code", "schema", "object_name", "object_type", text.alias("message"))
    none = F.lit(None).cast("string")
    mismatch = [r for r in enabled if r in disabled_upstream]
    if mismatch:
        notes = databases.join(installed, "db_id", "left_semi").withColumn("rule_code", F.explode(F.array(*[F.lit(r) for r in mismatch])))
        rows = rows.unionByName(notes.select("db_id", "rule_code", none.alias("schema"), none.alias("object_name"), none.alias("object_type"),
                                             F.concat(F.lit("rule "), F.col("rule_code"), F.lit(" is disabled in the extension")).alias("message")))
    missing = databases.join(installed, "db_id", "left_anti")
    return rows.unionByName(missing.select("db_id", none.alias("rule_code"), none.alias("schema"), none.alias("object_name"), none.alias("object_type"),
                                           F.lit("the extension is not installed").alias("message")))
