"""Catalog audit rules (D01-D23) and the driver that joins them into one report.

Every rule is a DataFrame over snapshot tables of all databases at once; each join starts with `db_id`.
Rows: db_id, rule, level, schema_name, object_name, object_type, detail, cache_key, extra (JSON or null).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintfleet import constants as C
from lintfleet.functions import scalars as S
from lintfleet.operators.keyed import lookup, union_all
from lintfleet.plans import catalog_dims as K
from lintfleet.plans.audit_messages import DETAILS
from lintfleet.session import materialize
from lintfleet.sources.catalog import Catalog
from lintfleet.sources.globs import globs_to_regex

COLUMNS = ["db_id", "rule", "level", "schema_name", "object_name", "object_type", "detail", "cache_key", "extra"]


@dataclass(frozen=True)
class AuditRule:
    id: str
    name: str
    group: str
    level: str
    gated: bool
    build: Callable[[Catalog], DataFrame]

    def rows(self, cat: Catalog) -> DataFrame:
        df = self.build(cat)
        if "extra" not in df.columns:
            df = df.withColumn("extra", F.lit(None).cast("string"))
        return df.withColumn("rule", F.lit(self.name)).withColumn("level", F.lit(self.level)).select(COLUMNS)


RULES: dict[str, AuditRule] = {}


def rule(id: str, name: str, group: str, level: str, gated: bool = False):
    def add(build: Callable[[Catalog], DataFrame]):
        RULES[id] = AuditRule(id, name, group, level, gated, build)
        return build

    return add


def _finding(df: DataFrame, detail: Column, cache_key: Column, kind: str | Column = "table", **extra: Column) -> DataFrame:
    kind_col = F.lit(kind) if isinstance(kind, str) else kind
    cols = ["db_id", F.col("nspname").alias("schema_name"), F.col("relname").alias("object_name"),
            kind_col.alias("object_type"), detail.alias("detail"), cache_key.alias("cache_key")]
    if extra:
        cols.append(S.json_of(**extra).alias("extra"))
    return df.select(*cols)


def _detail(rule_name: str, *args: Column) -> Column:
    return S.format_text(DETAILS[rule_name], *args)


def _key(prefix: str, *parts: str | Column) -> Column:
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return S.format_text(prefix + "_%s" * len(cols), *cols)


def relations(cat: Catalog, kinds: list[str] | None, excluded: list[str] | None = None) -> DataFrame:
    """Relations of the given kinds (or all) with their schema name; excluded schemas never reach the join."""
    skip = C.EXCLUDED_SCHEMAS if excluded is None else excluded
    if cat.base is not None:
        rows = cat.base.filter(F.col("relkind").isin(kinds)) if kinds else cat.base
        return rows.filter(~S.in_words("nspname", skip)) if skip else rows
    names = cat["namespace"].select("db_id", F.col("oid").alias("relnamespace"), "nspname")
    if skip:
        names = names.filter(~S.in_words("nspname", skip))
    classes = cat["class"].filter(F.col("relkind").isin(kinds)) if kinds else cat["class"]
    return classes.join(names, ["db_id", "relnamespace"])


def relation_base(cat: Catalog) -> DataFrame:
    """Relations with their schema and, as flags, what the rules would otherwise each join for: extension
    ownership and readability through the API. Both flags come from de-duplicated keys, so rows stay single."""
    names = cat["namespace"].select("db_id", F.col("oid").alias("relnamespace"), "nspname")
    owned = cat["depend"].filter(F.col("deptype") == "e").select("db_id", F.col("objid").alias("oid")).distinct()
    readers = api_readable(cat).groupBy("db_id", "oid").agg(F.min("rolname").alias("_reader"))
    exposed = exposed_schemas(cat).withColumn("_exposed", F.lit(True))
    return (
        cat["class"].join(names, ["db_id", "relnamespace"])
        .join(owned.withColumn("_owned", F.lit(True)), ["db_id", "oid"], "left")
        .join(readers, ["db_id", "oid"], "left")
        .join(exposed, ["db_id", "nspname"], "left")
        .withColumns({"_owned": F.coalesce("_owned", F.lit(False)), "_exposed": F.coalesce("_exposed", F.lit(False))})
    )


def not_extension_owned(df: DataFrame, cat: Catalog, key: str = "oid") -> DataFrame:
    if "_owned" in df.columns:
        return df.filter("not _owned")
    owned = cat["depend"].filter(F.col("deptype") == "e").select("db_id", F.col("objid").alias(key))
    return df.join(owned, ["db_id", key], "left_anti")


def exposed_schemas(cat: Catalog) -> DataFrame:
    """(db_id, nspname) of schemas the API serves: a comma-separated setting."""
    value = K.setting(cat, "pgrst.db_schemas", "schemas")
    return value.select("db_id", F.explode(S.split_setting(F.col("schemas"))).alias("nspname")).distinct()


def api_readable(cat: Catalog) -> DataFrame:
    grants = cat["privilege"].filter(F.col("rolname").isin(C.API_ROLES) & (F.col("privilege") == "SELECT"))
    return grants.select("db_id", "oid", "rolname")


def in_api(df: DataFrame, cat: Catalog) -> DataFrame:
    if "_reader" in df.columns:
        return df.filter("_reader is not null and _exposed")
    readable = df.join(api_readable(cat), ["db_id", "oid"], "left_semi")
    return readable.join(exposed_schemas(cat), ["db_id", "nspname"], "left_semi")


def table_policies(cat: Catalog, kinds: list[str] | None, excluded: list[str] | None = None) -> DataFrame:
    owners = relations(cat, kinds, excluded)
    owners = owners.select("db_id", F.col("oid").alias("polrelid"), "nspname", "relname", "relrowsecurity")
    return cat["policy"].join(owners, ["db_id", "polrelid"])


def pg_array(names: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", names), F.lit("}"))


# ------------------------------------------------------------------ performance


def valid_indexes(cat: Catalog) -> DataFrame:
    return cat["index"].filter("indisvalid").select("db_id", F.col("indrelid").alias("conrelid"),
                                                    S.int_list(F.col("indkey")).alias("index_cols"))


def foreign_keys(cat: Catalog) -> DataFrame:
    return cat["constraint"].filter(F.col("contype") == "f").withColumn("fk_cols", S.int_list(F.col("conkey")))


def uncovered_foreign_keys(fks: DataFrame, cat: Catalog) -> DataFrame:
    """Foreign keys for which no valid index of the table starts with their columns, in order."""
    idx = valid_indexes(cat)
    match = (
        (fks["db_id"] == idx["db_id"])
        & (fks["conrelid"] == idx["conrelid"])
        & S.has_prefix(idx["index_cols"], fks["fk_cols"])
    )
    return fks.join(idx, match, "left_anti")


@rule("D01", "unindexed_foreign_keys", "performance", "INFO")
def unindexed_foreign_keys(cat: Catalog) -> DataFrame:
    skip = sorted(set(C.EXCLUDED_SCHEMAS) | set(C.FK_EXCLUDED_SCHEMAS))
    owners = relations(cat, None, skip)
    owners = not_extension_owned(owners, cat).select("db_id", F.col("oid").alias("conrelid"), "nspname", "relname")
    fks = uncovered_foreign_keys(foreign_keys(cat), cat).join(owners, ["db_id", "conrelid"])
    detail = _detail(
        "unindexed_foreign_keys", F.col("nspname"), F.col("relname"), F.col("conname"),
    )
    return _finding(fks, detail, _key("unindexed_foreign_keys", "nspname", "relname", "conname"),
                    fkey_name=F.col("conname"), fkey_columns=F.col("fk_cols"))


# Calls that should be wrapped in a subselect.
INITPLAN_CALLS = ["auth.uid()", "auth.jwt()", "auth.role()", "auth.email()", "current\\_setting(%)"]


def _unwrapped_call(expr: str) -> Column:
    hits = [
        F.col(expr).like(f"%{call}%") & ~F.lower(expr).like(f"%select {call}%") for call in INITPLAN_CALLS
    ]
    return F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False))


@rule("D02", "auth_rls_initplan", "performance", "WARN", gated=True)
def auth_rls_initplan(cat: Catalog) -> DataFrame:
    skip = [s for s in C.EXCLUDED_SCHEMAS if s != "realtime"]
    rows = table_policies(cat, None, skip).filter("relrowsecurity")
    rows = rows.filter(_unwrapped_call("qual") | _unwrapped_call("with_check"))
    detail = _detail(
        "auth_rls_initplan", F.col("nspname"), F.col("relname"), F.col("polname"),
    )
    return _finding(rows, detail, _key("auth_rls_init_plan", "nspname", "relname", "polname"))


@rule("D03", "no_primary_key", "performance", "INFO")
def no_primary_key(cat: Catalog) -> DataFrame:
    keyed = cat["index"].filter("indisprimary").select("db_id", F.col("indrelid").alias("oid"))
    rows = not_extension_owned(relations(cat, ["r"]), cat).join(keyed, ["db_id", "oid"], "left_anti")
    detail = _detail("no_primary_key", F.col("nspname"), F.col("relname"))
    return _finding(rows, detail, _key("no_primary_key", "nspname", "relname"))


@rule("D04", "unused_index", "performance", "INFO")
def unused_index(cat: Catalog) -> DataFrame:
    plain = cat["index"].filter("not indisunique and not indisprimary").select("db_id", "indexrelid")
    rows = (
        cat["stat_index"]
        .filter((F.col("idx_scan") == 0) & ~S.in_words("schemaname", C.EXCLUDED_SCHEMAS))
        .join(plain, ["db_id", "indexrelid"], "left_semi")
        .withColumnRenamed("schemaname", "nspname")
    )
    rows = not_extension_owned(rows, cat, "relid")
    detail = _detail("unused_index", F.col("indexrelname"), F.col("nspname"), F.col("relname"))
    return _finding(rows, detail, _key("unused_index", "nspname", "relname", "indexrelname"))


COMMAND_LISTS = {"r": ["SELECT"], "a": ["INSERT"], "w": ["UPDATE"], "d": ["DELETE"],
                 "*": ["SELECT", "INSERT", "UPDATE", "DELETE"]}


def _commands(polcmd: Column) -> Column:
    out = F.array(F.lit("ERROR"))
    for code, names in COMMAND_LISTS.items():
        out = F.when(polcmd == code, F.array(*[F.lit(n) for n in names])).otherwise(out)
    return out


@rule("D05", "multiple_permissive_policies", "performance", "WARN")
def multiple_permissive_policies(cat: Catalog) -> DataFrame:
    """Public policies are counted per table first and meet the roles only where two of them alone
    already make a finding, so policies x roles is never built."""
    owners = not_extension_owned(relations(cat, ["r"]), cat)
    owners = owners.select("db_id", F.col("oid").alias("polrelid"), "nspname", "relname")
    per_command = (
        cat["policy"]
        .filter("polpermissive")
        .select("db_id", "polrelid", "polname", S.int_list(F.col("polroles")).alias("roles"),
                F.explode(_commands(F.col("polcmd"))).alias("cmd"))
        .join(owners, ["db_id", "polrelid"])
    )
    place = ["db_id", "nspname", "relname", "cmd"]
    is_public = F.col("roles") == F.array(F.lit(0).cast("bigint"))
    public = per_command.filter(is_public).groupBy(place).agg(
        F.count("*").alias("n_public"), F.collect_list("polname").alias("public_names")
    )
    roles = (
        cat["role"]
        .filter(~reduce(lambda a, b: a | b, [F.col("rolname").like(p) for p in C.IGNORED_ROLES]) & ~F.col("rolbypassrls"))
        .select("db_id", F.col("oid").alias("role_oid"), "rolname")
    )
    named = (
        per_command.filter(~is_public)
        .withColumn("role_oid", F.explode(F.array_distinct("roles")))
        .join(roles, ["db_id", "role_oid"])
        .groupBy(*place, "rolname")
        .agg(F.count("*").alias("n_named"), F.collect_list("polname").alias("named_names"))
    )
    # one row per table and command, with the few roles that its policies name
    said = F.collect_list(F.struct("rolname", "n_named", "named_names")).alias("said")
    empty = F.array().cast("array<string>")
    tables = (
        named.groupBy(place).agg(said).join(public, place, "full_outer")
        .filter("nspname is not null and relname is not null")
        .withColumn("public_names", F.coalesce("public_names", empty))
    )
    by_name = (
        tables.select(*place, "n_public", "public_names", F.inline("said")).filter(F.col("n_named") + F.coalesce("n_public", F.lit(0)) > 1)
        .withColumn("names", F.array_sort(F.concat("named_names", "public_names")))
    )
    # where two policies are public all other roles are findings too: as many as tables times roles, so they are not moved again
    crowded = tables.filter("n_public > 1").select(
        *place, F.array_sort("public_names").alias("names"), F.coalesce(F.transform("said", lambda x: x["rolname"]), empty).alias("_named")
    )
    by_table = lookup(crowded, roles.select("db_id", "rolname").distinct(), ["db_id"], "inner").filter(~F.array_contains("_named", F.col("rolname")))
    rows = by_name.select(*place, "rolname", "names").unionByName(by_table.select(*place, "rolname", "names"))
    detail = _detail(
        "multiple_permissive_policies", F.col("nspname"), F.col("relname"), F.col("rolname"), F.col("cmd"), pg_array(F.col("names")),
    )
    return _finding(rows, detail, _key("multiple_permissive_policies", "nspname", "relname", "rolname", "cmd"))


@rule("D06", "duplicate_index", "performance", "WARN")
def duplicate_index(cat: Catalog) -> DataFrame:
    owners = not_extension_owned(relations(cat, ["r", "m"]), cat)
    owners = owners.select("db_id", F.col("oid").alias("indrelid"), "nspname", "relname", "relkind")
    rows = (
        cat["index"]
        .join(owners, ["db_id", "indrelid"])
        .groupBy("db_id", "nspname", "relkind", "relname", F.replace("indexdef", "indexname", F.lit("")).alias("shape"))
        .agg(F.count("*").alias("n"), S.sorted_names(F.col("indexname")).alias("names"))
        .filter("n > 1")
    )
    names = pg_array(F.col("names"))
    detail = _detail("duplicate_index", F.col("nspname"), F.col("relname"), names)
    kind = F.when(F.col("relkind") == "r", "table").otherwise("materialized view")
    return _finding(rows, detail, _key("duplicate_index", "nspname", "relname", names), kind, indexes=F.col("names"))


def _align(width: Column) -> Column:
    """Width rounded up by the 4-byte alignment, a full step when already aligned."""
    rest = width % 4
    return width + 4 - F.when(rest == 0, F.lit(4)).otherwise(rest)


@rule("D07", "table_bloat", "performance", "INFO")
def table_bloat(cat: Catalog) -> DataFrame:
    widths = cat["stats"].groupBy("db_id", F.col("schemaname").alias("nspname"), F.col("tablename").alias("relname")).agg(
        F.sum((1 - F.col("null_frac")) * F.col("avg_width")).alias("data_width"),
        F.max("null_frac").alias("max_null"),
        (F.lit(23) + 1 + S.int_div(F.count_if(F.col("null_frac") != 0), 8)).alias("null_header"),
    )
    block = K.setting(cat, "block_size", "bs").withColumn("bs", F.col("bs").cast("double"))
    heap = relations(cat, ["r"], []).filter(F.col("amname") == "heap")
    row_header = F.col("data_width") + 24
    bytes_per_row = _align(row_header) + F.col("max_null") * _align(F.col("null_header")) + 4
    sized = (
        heap.join(widths, ["db_id", "nspname", "relname"])
        .join(block, "db_id")
        .withColumn("otta", F.ceil(F.col("reltuples") * bytes_per_row / (F.col("bs") - 20)).cast("double"))
        .withColumn("bloat", F.round(F.when(F.col("otta") == 0, 0.0).otherwise(F.col("relpages") / F.col("otta")), 1))
        .withColumn("waste", F.when(F.col("relpages") < F.col("otta"), 0.0).otherwise(F.col("bs") * (F.col("relpages") - F.col("otta"))))
    )
    rows = sized.filter((F.col("bloat") > C.BLOAT_FACTOR) & (F.col("waste") > C.BLOAT_WASTE_BYTES))
    detail = _detail("table_bloat", F.col("nspname"), F.col("relname"))
    return _finding(rows, detail, _key("table_bloat", "nspname", "relname"))


# ------------------------------------------------------------------ security


def _is_invoker_view() -> Column:
    options = S.word_list(F.lower("reloptions"))
    return S.overlaps(options, C.SECURITY_INVOKER_OPTIONS)


@rule("D08", "auth_users_exposed", "security", "ERROR", gated=True)
def auth_users_exposed(cat: Catalog) -> DataFrame:
    auth = cat["namespace"].filter(F.col("nspname") == "auth").select("db_id", F.col("oid").alias("relnamespace"))
    users = (
        cat["class"]
        .filter(F.col("relname") == "users")
        .join(auth, ["db_id", "relnamespace"], "left_semi")
        .select("db_id", F.col("oid").alias("refobjid"), F.col("relrowsecurity").alias("users_rls"))
    )
    rewrites = cat["rewrite"].select("db_id", F.col("oid").alias("objid"), F.col("ev_class").alias("oid"))
    dependants = (
        cat["depend"]
        .filter(F.col("deptype") == "n")
        .join(users, ["db_id", "refobjid"])
        .join(rewrites, ["db_id", "objid"])
        .groupBy("db_id", "oid")
        .agg(F.bool_and("users_rls").alias("users_rls"))
    )
    readers = api_readable(cat).groupBy("db_id", "oid").agg(F.min("rolname").alias("reader"))
    rows = relations(cat, ["m", "v"], []).join(dependants, ["db_id", "oid"]).join(readers, ["db_id", "oid"])
    rows = rows.join(exposed_schemas(cat), ["db_id", "nspname"], "left_semi")
    rows = rows.filter((F.col("relkind") == "m") | ~_is_invoker_view() | ~F.col("users_rls"))
    rows = rows.filter(F.col("relname") != "0002_auth_users_exposed")
    detail = _detail("auth_users_exposed",
        F.col("relname"),
    )
    return _finding(rows, detail, _key("auth_users_exposed", "nspname", "relname"), "view", exposed_to=F.array("reader"))


@rule("D09", "policy_exists_rls_disabled", "security", "ERROR")
def policy_exists_rls_disabled(cat: Catalog) -> DataFrame:
    owners = not_extension_owned(relations(cat, ["r"]).filter("not relrowsecurity"), cat)
    owners = owners.select("db_id", F.col("oid").alias("polrelid"), "nspname", "relname")
    rows = (
        cat["policy"].select("db_id", "polrelid", "polname").join(owners, ["db_id", "polrelid"])
        .groupBy("db_id", "nspname", "relname").agg(S.sorted_names(F.col("polname")).alias("names"))
    )
    detail = _detail("policy_exists_rls_disabled", F.col("nspname"), F.col("relname"), pg_array(F.col("names")))
    return _finding(rows, detail, _key("policy_exists_rls_disabled", "nspname", "relname"))


@rule("D10", "rls_enabled_no_policy", "security", "INFO")
def rls_enabled_no_policy(cat: Catalog) -> DataFrame:
    policied = cat["policy"].select("db_id", F.col("polrelid").alias("oid"))
    rows = not_extension_owned(relations(cat, ["r"]).filter("relrowsecurity"), cat)
    rows = rows.join(policied, ["db_id", "oid"], "left_anti").select("db_id", "nspname", "relname").distinct()
    detail = _detail("rls_enabled_no_policy", F.col("nspname"), F.col("relname"))
    return _finding(rows, detail, _key("rls_enabled_no_policy", "nspname", "relname"))


def _version_text(cat: Catalog) -> DataFrame:
    number = K.setting(cat, "server_version_num", "num")
    return number.select("db_id", S.text(S.int_div(F.col("num").cast("bigint"), 10000)).alias("major"))


@rule("D11", "security_definer_view", "security", "ERROR", gated=True)
def security_definer_view(cat: Catalog) -> DataFrame:
    # the version is compared as text, so '9' counts as later than '15'
    recent = _version_text(cat).filter(F.col("major") >= F.lit("15"))
    rows = in_api(not_extension_owned(relations(cat, ["v"]), cat), cat).filter(~_is_invoker_view())
    rows = rows.join(recent, "db_id", "left_semi")
    detail = _detail("security_definer_view", F.col("nspname"), F.col("relname"))
    return _finding(rows, detail, _key("security_definer_view", "nspname", "relname"), "view")


@rule("D12", "function_search_path_mutable", "security", "WARN")
def function_search_path_mutable(cat: Catalog) -> DataFrame:
    names = cat["namespace"].filter(~S.in_words("nspname", C.EXCLUDED_SCHEMAS))
    names = names.select("db_id", F.col("oid").alias("pronamespace"), "nspname")
    pinned = F.exists(S.word_list(F.col("proconfig")), lambda c: c.like("search_path=%"))
    rows = not_extension_owned(cat["proc"].filter(~pinned).join(names, ["db_id", "pronamespace"]), cat)
    rows = rows.withColumn("relname", F.col("proname"))
    detail = _detail("function_search_path_mutable", F.col("nspname"), F.col("proname"))
    key = _key("function_search_path_mutable", "nspname", "proname", F.md5("prosrc"))
    return _finding(rows, detail, key, "function")


@rule("D13", "rls_disabled_in_public", "security", "ERROR", gated=True)
def rls_disabled_in_public(cat: Catalog) -> DataFrame:
    rows = in_api(relations(cat, ["r"]).filter("not relrowsecurity"), cat)
    detail = _detail("rls_disabled_in_public", F.col("nspname"), F.col("relname"))
    return _finding(rows, detail, _key("rls_disabled_in_public", "nspname", "relname"))


@rule("D14", "extension_in_public", "security", "WARN")
def extension_in_public(cat: Catalog) -> DataFrame:
    public = cat["namespace"].filter(F.col("nspname") == "public").select("db_id", F.col("oid").alias("extnamespace"), "nspname")
    rows = cat["extension"].filter(F.col("extname") != "plpgsql").join(public, ["db_id", "extnamespace"])
    rows = rows.withColumn("relname", F.col("extname"))
    detail = _detail("extension_in_public", F.col("extname"))
    return _finding(rows, detail, _key("extension_in_public", "extname"), "extension")


# Expressions that read the user-editable claim.
USER_METADATA = ["%auth.jwt()%user_metadata%", "%current_setting(%request.jwt.claims%)%user_metadata%"]


@rule("D15", "rls_references_user_metadata", "security", "ERROR", gated=True)
def rls_references_user_metadata(cat: Catalog) -> DataFrame:
    hits = [F.coalesce(F.col(e).like(p), F.lit(False)) for e in ("qual", "with_check") for p in USER_METADATA]
    rows = table_policies(cat, None).filter(reduce(lambda a, b: a | b, hits))
    detail = _detail(
        "rls_references_user_metadata", F.col("nspname"), F.col("relname"), F.col("polname"),
    )
    return _finding(rows, detail, _key("rls_references_user_metadata", "nspname", "relname", "polname"))


def _api_relations(cat: Catalog, kind: str) -> DataFrame:
    return in_api(not_extension_owned(relations(cat, [kind]), cat), cat)


@rule("D16", "materialized_view_in_api", "security", "WARN", gated=True)
def materialized_view_in_api(cat: Catalog) -> DataFrame:
    detail = _detail("materialized_view_in_api", F.col("nspname"), F.col("relname"))
    return _finding(_api_relations(cat, "m"), detail, _key("materialized_view_in_api", "nspname", "relname"), "materialized view")


@rule("D17", "foreign_table_in_api", "security", "WARN", gated=True)
def foreign_table_in_api(cat: Catalog) -> DataFrame:
    detail = _detail("foreign_table_in_api", F.col("nspname"), F.col("relname"))
    return _finding(_api_relations(cat, "f"), detail, _key("foreign_table_in_api", "nspname", "relname"), "foreign table")


@rule("D18", "unsupported_reg_types", "security", "WARN")
def unsupported_reg_types(cat: Catalog) -> DataFrame:
    builtin = cat["namespace"].filter(F.col("nspname") == "pg_catalog").select("db_id", F.col("oid").alias("typnamespace"))
    reg = (
        cat["type"].filter(F.col("typname").isin(C.REG_TYPES)).join(builtin, ["db_id", "typnamespace"], "left_semi")
        .select("db_id", F.col("oid").alias("atttypid"), "typname")
    )
    owners = relations(cat, None, C.REG_EXCLUDED_SCHEMAS)
    owners = owners.select("db_id", F.col("oid").alias("attrelid"), "nspname", "relname")
    rows = cat["attribute"].join(reg, ["db_id", "atttypid"]).join(owners, ["db_id", "attrelid"])
    detail = _detail("unsupported_reg_types", F.col("nspname"), F.col("relname"), F.col("attname"), F.col("typname"))
    return _finding(rows, detail, _key("unsupported_reg_types", "nspname", "relname", "attname"), column=F.col("attname"))


@rule("D19", "insecure_queue_exposed_in_api", "security", "ERROR", gated=True)
def insecure_queue_exposed_in_api(cat: Catalog) -> DataFrame:
    served = exposed_schemas(cat).filter(F.col("nspname") == "pgmq_public").select("db_id")
    rows = (
        relations(cat, ["r", "I"], [])
        .filter((F.col("nspname") == "pgmq") & ~F.col("relrowsecurity") & F.col("relname").like("q_%"))
        .join(api_readable(cat), ["db_id", "oid"], "left_semi")
        .join(served, "db_id", "left_semi")
    )
    detail = _detail("insecure_queue_exposed_in_api", F.col("nspname"), F.col("relname"))
    return _finding(rows, detail, _key("rls_disabled_in_public", "nspname", "relname"))


@rule("D20", "fkey_to_auth_unique", "security", "ERROR", gated=True)
def fkey_to_auth_unique(cat: Catalog) -> DataFrame:
    owners = relations(cat, None, []).select("db_id", F.col("oid").alias("conrelid"), "nspname", "relname")
    targets = relations(cat, None, []).filter(F.col("nspname") == "auth")
    targets = targets.select("db_id", F.col("oid").alias("confrelid"))
    unique = cat["index"].filter("indisunique and not indisprimary").select("db_id", F.col("indexrelid").alias("conindid"))
    rows = (
        cat["constraint"].filter(F.col("contype") == "f")
        .join(targets, ["db_id", "confrelid"], "left_semi")
        .join(unique, ["db_id", "conindid"], "left_semi")
        .join(owners, ["db_id", "conrelid"])
    )
    detail = _detail("fkey_to_auth_unique", F.col("nspname"), F.col("relname"), F.col("conname"))
    return _finding(rows, detail, _key("fkey_to_auth_unique", "nspname", "relname", "conname"),
                    F.lit(None).cast("string"), foreign_key=F.col("conname"))


@rule("D21", "extension_versions_outdated", "security", "WARN")
def extension_versions_outdated(cat: Catalog) -> DataFrame:
    listed = cat["available_extension_version"].filter("installed").select("db_id", "name")
    rows = (
        cat["available_extension"]
        .filter(F.col("installed_version") != F.col("default_version"))
        .join(listed, ["db_id", "name"])
        .withColumn("nspname", F.lit(None).cast("string"))
        .withColumn("relname", F.lit(None).cast("string"))
    )
    detail = _detail(
        "extension_versions_outdated", F.col("name"), F.col("installed_version"), F.col("default_version"),
    )
    return _finding(rows, detail, _key("extension_versions_outdated", "name", "installed_version"),
                    F.lit(None).cast("string"), extension_name=F.col("name"),
                    installed_version=F.col("installed_version"), default_version=F.col("default_version"))


@rule("D22", "sensitive_columns_exposed", "security", "ERROR", gated=True)
def sensitive_columns_exposed(cat: Catalog) -> DataFrame:
    owners = in_api(relations(cat, ["r"]).filter("not relrowsecurity"), cat)
    owners = owners.select("db_id", F.col("oid").alias("attrelid"), "nspname", "relname")
    pattern = F.replace(F.lower("attname"), F.lit("-"), F.lit("_"))
    rows = (
        cat["attribute"]
        .filter((F.col("attnum") > 0) & ~F.col("attisdropped"))
        .withColumn("pattern", pattern)
        .filter(S.in_words("pattern", C.SENSITIVE_COLUMNS))
        .join(owners, ["db_id", "attrelid"])
        .groupBy("db_id", "nspname", "relname")
        .agg(F.array_sort(F.collect_set("attname")).alias("names"), F.array_sort(F.collect_set("pattern")).alias("patterns"))
    )
    detail = _detail(
        "sensitive_columns_exposed", F.col("nspname"), F.col("relname"), F.concat_ws(", ", "names"),
    )
    return _finding(rows, detail, _key("sensitive_columns_exposed", "nspname", "relname"),
                    sensitive_columns=F.col("names"), matched_patterns=F.col("patterns"))


@rule("D23", "rls_policy_always_true", "security", "WARN", gated=True)
def rls_policy_always_true(cat: Catalog) -> DataFrame:
    def plain(expr: str) -> Column:
        return F.translate(F.lower(F.coalesce(expr, F.lit(""))), " \n\t", "")

    command = S.lookup_map(F.col("polcmd"), K.COMMANDS, F.lit(None).cast("string"))
    open_using = plain("qual").isin(C.ALWAYS_TRUE)
    using = F.col("command").isin("UPDATE", "DELETE", "ALL") & (open_using | F.col("qual").isNull())
    check = (
        plain("with_check").isin(C.ALWAYS_TRUE)
        | (F.col("with_check").isNull() & (F.col("command") == "INSERT"))
        | (F.col("with_check").isNull() & F.col("command").isin("UPDATE", "ALL") & open_using)
    )
    rows = (
        table_policies(cat, ["r"])
        .filter("relrowsecurity and polpermissive")
        .withColumn("command", command)
        .withColumn("open_using", using)
        .withColumn("open_check", check)
        .filter("open_using or open_check")
        .withColumn("roles", S.int_list(F.col("polroles")))
    )
    # only the surviving policies meet the role table; one aggregate per policy restores the array order
    named = (
        rows.select("db_id", "polrelid", "polname", F.posexplode("roles").alias("ord", "oid"))
        .join(cat["role"].select("db_id", "oid", "rolname"), ["db_id", "oid"], "left")
        .groupBy("db_id", "polrelid", "polname")
        .agg(
            F.bool_or(F.coalesce(F.col("rolname").isin(C.API_ROLES), F.lit(False))).alias("api"),
            F.array_sort(F.collect_list(F.struct("ord", F.when(F.col("oid") == 0, "-").otherwise(F.coalesce("rolname", S.text(F.col("oid")))).alias("name")))).alias("ordered"),
        )
    )
    public = F.col("roles") == F.array(F.lit(0).cast("bigint"))
    rows = rows.join(named, ["db_id", "polrelid", "polname"]).filter(public | F.col("api"))
    role_names = F.transform("ordered", lambda r: r["name"])
    clause = (
        F.when(F.col("open_using") & F.col("open_check"), " (both USING and WITH CHECK are always true)")
        .when(F.col("open_using"), " (USING clause is always true)")
        .otherwise(" (WITH CHECK clause is always true)")
    )
    detail = _detail(
        "rls_policy_always_true", F.col("nspname"), F.col("relname"), F.col("polname"), F.col("command"), clause, F.concat_ws(", ", role_names),
    )
    return _finding(
        rows, detail, _key("rls_policy_always_true", "nspname", "relname", "polname"),
        policy_name=F.col("polname"), command=F.col("command"), roles=role_names,
        permissive_using=F.col("open_using"), permissive_with_check=F.col("open_check"),
    )


# ------------------------------------------------------------------ driver


def gated_databases(cat: Catalog) -> DataFrame:
    """Databases in which all roles that open the gated rules exist."""
    return (
        cat["role"].filter(F.col("rolname").isin(C.GATE_ROLES))
        .groupBy("db_id").agg(F.count_distinct("rolname").alias("n"))
        .filter(F.col("n") == len(C.GATE_ROLES)).select("db_id")
    )


def audit(
    cat: Catalog,
    rules: list[str] | None = None,
    ignore: list[str] | None = None,
    rule_ignore: dict[str, list[str]] | None = None,
) -> DataFrame:
    """All findings of the enabled rules, with a severity number, without ignored objects.

    Relations are joined with schemas, extensions and grants once, into a table all rules read. Only enabled
    rules are planned. Ignore globs are matched against `schema.name`; rows lacking either
    are kept. `rules` and the keys of `rule_ignore` are rule names.
    """
    gate = gated_databases(cat)
    if cat.base is None:
        cat.base = materialize(relation_base(cat), "relations")
    object_id = F.concat_ws(".", "schema_name", "object_name")
    unnamed = F.col("schema_name").isNull() | F.col("object_name").isNull()
    parts = []
    for entry in RULES.values():
        if rules is not None and entry.name not in rules:
            continue
        df = entry.rows(cat)
        if entry.gated:
            df = df.join(gate, "db_id", "left_semi")
        globs = list(ignore or []) + list((rule_ignore or {}).get(entry.name, []))
        if globs:
            df = df.filter(unnamed | ~object_id.rlike(globs_to_regex(globs)))
        parts.append(df.withColumn("category", F.lit(f"catalog/{entry.group}/{entry.name}")))
    severity = F.lit(C.INFORMATION)
    for level, number in C.LEVEL_SEVERITY.items():
        severity = F.when(F.col("level") == level, number).otherwise(severity)
    return union_all(parts).withColumn("severity", severity)
