"""Raw catalog snapshots to the twelve clean dimensions (K01-K12) and object lookup.

A snapshot holds what its reader was allowed to see, so the reference's privilege checks on the current
user are already applied when the snapshot is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintfleet import constants as C
from lintfleet.functions import scalars as S
from lintfleet.operators.keyed import union_all
from lintfleet.sources.catalog import Catalog

EMPTY = "array<string>"


def _named(df: DataFrame, oid: str, **renames: str) -> DataFrame:
    """(db_id, key, wanted columns) of a side table, ready to join on (db_id, key)."""
    return df.select("db_id", F.col(oid), *[F.col(src).alias(dst) for dst, src in renames.items()])


def _namespaces(cat: Catalog, key: str, alias: str) -> DataFrame:
    return cat["namespace"].select("db_id", F.col("oid").alias(key), F.col("nspname").alias(alias))


def _comments(cat: Catalog) -> DataFrame:
    return cat["description"].select("db_id", "objoid", "objsubid", F.col("description").alias("comment"))


def schemas(cat: Catalog) -> DataFrame:
    grants = (
        cat["ns_acl"]
        .filter(~F.col("grantee").isin("", "-"))
        .groupBy("db_id", F.col("nspoid").alias("oid"))
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("privilege_type") == "USAGE", F.col("grantee")))).alias("users"),
            F.array_sort(F.collect_list(F.when(F.col("privilege_type") == "CREATE", F.col("grantee")))).alias("creators"),
        )
    )
    relations = cat["class"].select("db_id", "relnamespace", "relkind", "relsize")
    relations = relations.unionByName(cat["index_class"].select("db_id", "relnamespace", "relkind", "relsize"))
    counts = relations.groupBy("db_id", F.col("relnamespace").alias("oid")).agg(
        F.count_if(F.col("relkind") == "r").alias("table_count"),
        F.count_if(F.col("relkind") == "v").alias("view_count"),
        F.sum(F.when(F.col("relkind").isin("r", "i", "m"), F.col("relsize"))).alias("bytes"),
    )
    functions = cat["proc"].groupBy("db_id", F.col("pronamespace").alias("oid")).agg(F.count("*").alias("function_count"))
    owners = _named(cat["role"].withColumnRenamed("oid", "nspowner"), "nspowner", owner="rolname")
    temporary = F.col("nspname").startswith("pg_temp_") | F.col("nspname").startswith("pg_toast_temp_")
    zero = F.lit(0).cast("bigint")
    return (
        cat["namespace"]
        .filter(~temporary)
        .join(owners, ["db_id", "nspowner"])
        .join(grants, ["db_id", "oid"], "left")
        .join(counts, ["db_id", "oid"], "left")
        .join(functions, ["db_id", "oid"], "left")
        .select(
            "db_id", F.col("oid").alias("id"), F.col("nspname").alias("name"), "owner",
            F.coalesce("users", F.array().cast(EMPTY)).alias("allowed_users"),
            F.coalesce("creators", F.array().cast(EMPTY)).alias("allowed_creators"),
            F.coalesce("table_count", zero).alias("table_count"),
            F.coalesce("view_count", zero).alias("view_count"),
            F.coalesce("function_count", zero).alias("function_count"),
            F.coalesce(S.pretty_size(F.col("bytes")), F.lit("0 bytes")).alias("total_size"),
        )
    )


def tables(cat: Catalog) -> DataFrame:
    identity = (
        F.when(F.col("relreplident") == "d", "DEFAULT")
        .when(F.col("relreplident") == "i", "INDEX")
        .when(F.col("relreplident") == "f", "FULL")
        .otherwise("NOTHING")
    )
    stats = cat["stat_table"].select("db_id", F.col("relid").alias("oid"), "n_live_tup", "n_dead_tup")
    comments = _comments(cat).filter(F.col("objsubid") == 0).select("db_id", F.col("objoid").alias("oid"), "comment")
    return (
        cat["class"]
        .filter(F.col("relkind").isin("r", "p", "v", "m"))
        .join(_namespaces(cat, "relnamespace", "schema"), ["db_id", "relnamespace"])
        .join(stats, ["db_id", "oid"], "left")
        .join(comments, ["db_id", "oid"], "left")
        .select(
            "db_id", F.col("oid").alias("id"), "schema", F.col("relname").alias("name"),
            F.col("relkind").alias("table_kind"), F.col("relrowsecurity").alias("rls_enabled"),
            F.col("relforcerowsecurity").alias("rls_forced"), identity.alias("replica_identity"),
            F.col("relsize").alias("bytes"), S.pretty_size(F.col("relsize")).alias("size"),
            F.col("n_live_tup").alias("live_rows_estimate"), F.col("n_dead_tup").alias("dead_rows_estimate"), "comment",
        )
    )


def _char_length(type_id: Column, typmod: Column) -> Column:
    # Postgres keeps a 4-byte header in the modifier of bpchar (1042) and varchar (1043); bit types keep none.
    length = F.when(typmod == -1, None).when(type_id.isin(1042, 1043), typmod - 4).when(type_id.isin(1560, 1562), typmod)
    return F.nullif(length, F.lit(-1))


def index_columns(cat: Catalog) -> DataFrame:
    """One row per (table, column) with whether any primary or unique index holds it."""
    real = cat["index_class"].filter(F.col("relkind") == "i").select("db_id", F.col("oid").alias("indexrelid"))
    return (
        cat["index"]
        .join(real, ["db_id", "indexrelid"], "left_semi")
        .select("db_id", F.col("indrelid").alias("attrelid"), "indisprimary", "indisunique",
                F.explode(S.int_list(F.col("indkey"))).alias("attnum"))
        .groupBy("db_id", "attrelid", "attnum")
        .agg(F.bool_or("indisprimary").alias("is_primary"), F.bool_or("indisunique").alias("is_unique"))
    )


def columns(cat: Catalog) -> DataFrame:
    owners = (
        cat["class"]
        .filter(F.col("relkind").isin("r", "v", "m", "f", "p"))
        .join(_namespaces(cat, "relnamespace", "schema_name"), ["db_id", "relnamespace"])
        .select("db_id", F.col("oid").alias("attrelid"), F.col("relname").alias("table_name"),
                F.col("relkind").alias("class_kind"), "schema_name")
    )
    defaults = cat["attrdef"].select("db_id", F.col("adrelid").alias("attrelid"), F.col("adnum").alias("attnum"),
                                     F.col("adsrc").alias("default_expr"))
    types = cat["type"].select("db_id", F.col("oid").alias("atttypid"), F.col("typname").alias("type_name"))
    comments = _comments(cat).select("db_id", F.col("objoid").alias("attrelid"), F.col("objsubid").alias("attnum"), "comment")
    return (
        cat["attribute"]
        .filter(F.col("attnum") >= 0)
        .join(owners, ["db_id", "attrelid"])
        .join(types, ["db_id", "atttypid"])
        .join(index_columns(cat), ["db_id", "attrelid", "attnum"], "left")
        .join(defaults, ["db_id", "attrelid", "attnum"], "left")
        .join(comments, ["db_id", "attrelid", "attnum"], "left")
        .select(
            "db_id", F.col("attname").alias("name"), F.col("attnum").alias("number"), "table_name",
            F.col("attrelid").alias("table_oid"), "class_kind", "schema_name", F.col("atttypid").alias("type_id"),
            "type_name", (~F.col("attnotnull")).alias("is_nullable"),
            _char_length(F.col("atttypid"), F.col("atttypmod")).alias("varchar_length"), "default_expr",
            F.coalesce("is_primary", F.lit(False)).alias("is_primary_key"),
            F.coalesce("is_unique", F.lit(False)).alias("is_unique"), "comment",
        )
    )


def functions(cat: Catalog) -> DataFrame:
    types = S.int_list(F.col("proargtypes"))
    count = F.size(types)
    modes = F.coalesce(F.split("proargmodes", " "), S.array_fill(F.lit("i"), count))
    names = F.coalesce(F.split("proargnames", " "), S.array_fill(F.lit(""), count))
    defaults = F.concat(
        S.array_fill(F.lit(False), F.col("pronargs") - F.col("pronargdefaults")),
        S.array_fill(F.lit(True), F.col("pronargdefaults")),
    )
    mode_names = {"i": "in", "o": "out", "b": "inout", "v": "variadic"}
    args = F.transform(
        F.arrays_zip(modes.alias("mode"), names.alias("name"), types.alias("type_id"), defaults.alias("has_default")),
        lambda a: F.struct(
            S.lookup_map(a["mode"], mode_names, F.lit("table")).alias("mode"),
            a["name"].alias("name"), a["type_id"].alias("type_id"), a["has_default"].alias("has_default"),
        ),
    )
    behavior = (
        F.when(F.col("provolatile") == "i", "IMMUTABLE")
        .when(F.col("provolatile") == "s", "STABLE")
        .when(F.col("provolatile") == "v", "VOLATILE")
    )
    languages = cat["language"].select("db_id", F.col("oid").alias("prolang"), F.col("lanname").alias("language"))
    result_types = cat["type"].select("db_id", F.col("oid").alias("prorettype"), F.col("typname").alias("return_type"),
                                      F.nullif("typrelid", F.lit(0)).alias("return_type_relation_id"))
    return (
        cat["proc"]
        .join(_namespaces(cat, "pronamespace", "schema"), ["db_id", "pronamespace"], "left")
        .join(languages, ["db_id", "prolang"], "left")
        .join(result_types, ["db_id", "prorettype"], "left")
        .select(
            "db_id", F.col("oid").alias("id"), "schema", F.col("proname").alias("name"), "language",
            F.col("prokind").alias("kind"),
            F.when(F.col("language") != "internal", F.col("prosrc")).alias("body"),
            args.alias("args"), F.col("prorettype").alias("return_type_id"), "return_type", "return_type_relation_id",
            F.col("proretset").alias("is_set_returning_function"), behavior.alias("behavior"),
            F.col("prosecdef").alias("security_definer"),
        )
    )


def types(cat: Catalog) -> DataFrame:
    enums = cat["enum"].groupBy("db_id", F.col("enumtypid").alias("oid")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("enumsortorder", "enumlabel"))), lambda x: x["enumlabel"]).alias("enums")
    )
    composites = cat["class"].filter(F.col("relkind") == "c").select("db_id", F.col("oid").alias("typrelid"))
    attributes = (
        cat["attribute"]
        .filter(~F.col("attisdropped"))
        .withColumnRenamed("attrelid", "typrelid")
        .join(composites, ["db_id", "typrelid"], "left_semi")
        .groupBy("db_id", "typrelid")
        .agg(F.transform(
            F.array_sort(F.collect_list(F.struct("attnum", "attname", "atttypid"))),
            lambda x: F.struct(x["attname"].alias("name"), x["atttypid"].alias("type_id")),
        ).alias("attributes"))
    )
    known = cat["type"].join(composites.withColumn("is_composite", F.lit(True)), ["db_id", "typrelid"], "left")
    return (
        known.filter((F.col("typrelid") == 0) | F.col("is_composite"))
        .join(_namespaces(cat, "typnamespace", "schema"), ["db_id", "typnamespace"], "left")
        .join(enums, ["db_id", "oid"], "left")
        .join(attributes, ["db_id", "typrelid"], "left")
        .select(
            "db_id", F.col("oid").alias("id"), F.col("typname").alias("name"), "schema",
            S.lookup_map(F.col("typname"), C.SQL_TYPE_NAMES, F.col("typname")).alias("format"),
            F.coalesce("enums", F.array().cast(EMPTY)).alias("enums"),
            F.coalesce("attributes", F.array().cast("array<struct<name:string,type_id:bigint>>")).alias("attributes"),
        )
    )


COMMANDS = {"r": "SELECT", "a": "INSERT", "w": "UPDATE", "d": "DELETE", "*": "ALL"}


def policies(cat: Catalog) -> DataFrame:
    role_names = (
        cat["policy"]
        .select("db_id", "polrelid", "polname", F.explode(S.int_list(F.col("polroles"))).alias("oid"))
        .join(cat["role"].select("db_id", "oid", "rolname"), ["db_id", "oid"], "left")
        .groupBy("db_id", "polrelid", "polname")
        .agg(F.array_sort(F.collect_list(F.when(F.col("oid") == 0, "public").otherwise(F.col("rolname")))).alias("role_names"))
    )
    owners = (
        cat["class"]
        .join(_namespaces(cat, "relnamespace", "schema_name"), ["db_id", "relnamespace"])
        .select("db_id", F.col("oid").alias("polrelid"), F.col("relname").alias("table_name"), "schema_name")
    )
    return (
        cat["policy"]
        .join(owners, ["db_id", "polrelid"])
        .join(role_names, ["db_id", "polrelid", "polname"], "left")
        .select(
            "db_id", F.col("polname").alias("name"), "table_name", "schema_name", F.col("polpermissive").alias("is_permissive"),
            S.lookup_map(F.col("polcmd"), COMMANDS, F.lit(None).cast("string")).alias("command"), "role_names",
            F.col("qual").alias("security_qualification"), "with_check",
        )
    )


TRIGGER_EVENTS = [(2, "insert"), (3, "delete"), (4, "update"), (5, "truncate")]


def triggers(cat: Catalog) -> DataFrame:
    mask = F.col("tgtype")
    procs = cat["proc"].select("db_id", F.col("oid").alias("tgfoid"), F.col("proname").alias("proc_name"), "pronamespace")
    owners = cat["class"].select("db_id", F.col("oid").alias("tgrelid"), F.col("relname").alias("table_name"), "relnamespace")
    events = F.filter(
        F.array(*[F.when(S.bit(mask, b), F.lit(name)) for b, name in TRIGGER_EVENTS]), lambda e: e.isNotNull()
    )
    return (
        cat["trigger"]
        .filter(~F.col("tgisinternal") & (F.col("tgconstraint") == 0))
        .join(procs, ["db_id", "tgfoid"], "left")
        .join(owners, ["db_id", "tgrelid"], "left")
        .join(_namespaces(cat, "relnamespace", "table_schema"), ["db_id", "relnamespace"], "left")
        .join(_namespaces(cat, "pronamespace", "proc_schema"), ["db_id", "pronamespace"], "left")
        .select(
            "db_id", F.col("tgname").alias("name"), "table_name", "table_schema", "proc_name", "proc_schema",
            F.when(S.bit(mask, 0), "row").otherwise("statement").alias("affected"),
            F.when(S.bit(mask, 1), "before").when(S.bit(mask, 6), "instead").otherwise("after").alias("timing"),
            events.alias("events"),
        )
    )


def roles(cat: Catalog) -> DataFrame:
    named = cat["role"].select("db_id", "oid", "rolname")
    members = cat["auth_member"]
    parents = (
        members.join(named.withColumnRenamed("oid", "roleid"), ["db_id", "roleid"])
        .groupBy("db_id", F.col("member").alias("oid"))
        .agg(S.sorted_names(F.col("rolname")).alias("member_of"))
    )
    children = (
        members.join(named.withColumnRenamed("oid", "member"), ["db_id", "member"])
        .groupBy("db_id", F.col("roleid").alias("oid"))
        .agg(S.sorted_names(F.col("rolname")).alias("has_member"))
    )
    empty = F.array().cast(EMPTY)
    return (
        cat["role"]
        .join(parents, ["db_id", "oid"], "left")
        .join(children, ["db_id", "oid"], "left")
        .select(
            "db_id", F.col("rolname").alias("name"), F.col("rolsuper").alias("is_super_user"),
            F.col("rolcreatedb").alias("can_create_db"), F.col("rolcanlogin").alias("can_login"),
            F.col("rolbypassrls").alias("can_bypass_rls"), F.col("rolcreaterole").alias("can_create_roles"),
            F.coalesce("member_of", empty).alias("member_of"), F.coalesce("has_member", empty).alias("has_member"),
        )
    )


def indexes(cat: Catalog) -> DataFrame:
    owners = cat["class"].select("db_id", F.col("oid").alias("indrelid"), F.col("relname").alias("table_name"))
    links = cat["index"].select("db_id", F.col("indexrelid").alias("oid"), "indrelid")
    return (
        cat["index_class"]
        .filter(F.col("relkind") == "i")
        .join(_namespaces(cat, "relnamespace", "schema").filter(~F.col("schema").isin(C.SYSTEM_SCHEMAS)), ["db_id", "relnamespace"])
        .join(links, ["db_id", "oid"])
        .join(owners, ["db_id", "indrelid"])
        .select("db_id", F.col("oid").alias("id"), "schema", F.col("relname").alias("name"), "table_name")
    )


def sequences(cat: Catalog) -> DataFrame:
    return (
        cat["class"]
        .filter(F.col("relkind") == "S")
        .join(_namespaces(cat, "relnamespace", "schema").filter(~F.col("schema").isin(C.SYSTEM_SCHEMAS)), ["db_id", "relnamespace"])
        .select("db_id", F.col("oid").alias("id"), "schema", F.col("relname").alias("name"))
    )


def extensions(cat: Catalog) -> DataFrame:
    installed = cat["extension"].select("db_id", F.col("extname").alias("name"), "extversion", "extnamespace")
    return (
        cat["available_extension"]
        .select("db_id", "name", "default_version", "comment")
        .join(installed, ["db_id", "name"], "left")
        .join(_namespaces(cat, "extnamespace", "schema"), ["db_id", "extnamespace"], "left")
        .select("db_id", "name", "schema", "default_version", F.col("extversion").alias("installed_version"), "comment")
    )


def setting(cat: Catalog, name: str, alias: str) -> DataFrame:
    return cat["setting"].filter(F.col("name") == name).select("db_id", F.col("value").alias(alias))


def major_versions(cat: Catalog) -> DataFrame:
    number = setting(cat, "server_version_num", "version_num")
    return number.select("db_id", S.int_div(F.col("version_num").cast("bigint"), 10000).alias("major_version"))


def versions(cat: Catalog) -> DataFrame:
    """One row per database, so every join on it is a small side table."""
    active = cat["activity"].groupBy("db_id").agg(F.count("*").alias("active_connections"))
    number = F.col("version_num").cast("bigint")
    return (
        setting(cat, "server_version_num", "version_num")
        .join(setting(cat, "max_connections", "max_connections"), "db_id", "left")
        .join(active, "db_id", "left")
        .select(
            "db_id", number.alias("version_num"), S.int_div(number, 10000).alias("major_version"),
            F.coalesce("active_connections", F.lit(0).cast("bigint")).alias("active_connections"),
            F.col("max_connections").cast("bigint").alias("max_connections"),
        )
    )


DIMENSIONS = {
    "schemas": schemas, "tables": tables, "columns": columns, "functions": functions, "types": types,
    "policies": policies, "triggers": triggers, "roles": roles, "indexes": indexes, "sequences": sequences,
    "extensions": extensions, "versions": versions,
}

TABLE_KINDS = {"r": "ordinary", "p": "partitioned", "v": "view", "m": "materializedview"}
FUNCTION_KINDS = {"f": "function", "p": "procedure", "a": "aggregate", "w": "window"}


def objects(cat: Catalog) -> DataFrame:
    """Every addressable object as (db_id, classid, objid, objsubid) -> (schema, name, type)."""

    def rows(df: DataFrame, classid: int, kind: Column, name: Column | None = None) -> DataFrame:
        return df.select(
            "db_id", F.lit(classid).cast("bigint").alias("classid"), F.col("id").alias("objid"), F.lit(0).alias("objsubid"),
            F.col("schema"), (name if name is not None else F.col("name")).alias("object_name"),
            kind.alias("object_type"),
        )

    cols = columns(cat).select(
        "db_id", F.lit(C.PG_ATTRIBUTE).cast("bigint").alias("classid"), F.col("table_oid").alias("objid"),
        F.col("number").cast("int").alias("objsubid"), F.col("schema_name").alias("schema"),
        F.concat_ws(".", "table_name", "name").alias("object_name"), F.lit("column").alias("object_type"),
    )
    parts = [
        rows(tables(cat), C.PG_CLASS, S.lookup_map(F.col("table_kind"), TABLE_KINDS, F.col("table_kind"))),
        rows(indexes(cat), C.PG_CLASS, F.lit("index")),
        rows(sequences(cat), C.PG_CLASS, F.lit("sequence")),
        rows(functions(cat), C.PG_PROC, S.lookup_map(F.col("kind"), FUNCTION_KINDS, F.col("kind"))),
        rows(types(cat), C.PG_TYPE, F.lit("type")),
        rows(schemas(cat).withColumn("schema", F.lit(None).cast("string")), C.PG_NAMESPACE, F.lit("schema")),
        cols,
    ]
    return union_all(parts)


def resolve_objects(refs: DataFrame, cat: Catalog) -> DataFrame:
    """Adds schema, object_name and object_type to (db_id, classid, objid, objsubid) rows, null when unknown.

    Only columns look at objsubid. A system catalog numbers its rows uniquely, so tables, indexes and sequences
    never share an id and the order in which they are tried cannot matter. The objects are joined as they are, which
    also lets a hot object's references be split over tasks.
    """
    best = objects(cat)
    sub = F.when(F.col("classid") == C.PG_ATTRIBUTE, F.col("objsubid")).otherwise(F.lit(0))
    keyed = refs.withColumn("_sub", sub)
    return (
        keyed.join(best.withColumnRenamed("objsubid", "_sub"), ["db_id", "classid", "objid", "_sub"], "left")
        .drop("_sub")
        .select(*refs.columns, "schema", "object_name", "object_type")
    )
