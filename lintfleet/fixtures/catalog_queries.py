"""Registered queries over the derived catalog (K, D) and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintfleet import constants as C
from lintfleet.fixtures.relations import cte, relation
from lintfleet.plans import audit_rules as D
from lintfleet.plans import catalog_dims as K
from lintfleet.session import configure
from lintfleet.sources.catalog import Catalog, export_json

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    configure(spark)
    return Catalog(lambda name: relation(spark, sf_dir, f"cat_{name}"))


def _structs(name: str, fields: list[str]) -> Column:
    return F.transform(name, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields]))


def plain(df: DataFrame) -> DataFrame:
    """Arrays as text, so that both engines print the same: words by comma, structs as JSON-free triples."""
    out = df
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if kind.startswith("array<struct"):
            out = out.withColumn(field.name, F.concat_ws(",", _structs(field.name, field.dataType.elementType.names)))
        elif kind.startswith("array<"):
            out = out.withColumn(field.name, F.concat_ws(",", F.col(field.name).cast("array<string>")))
    return out


def sql(relations: list[str], body: str, extra: str = "") -> str:
    return f"with {cte(relations)}{extra}\n{body}"


def quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


SYSTEM = quoted(C.SYSTEM_SCHEMAS)


def pretty(size: str) -> str:
    """pg_size_pretty as nested CASE over one numeric expression."""
    out, doubled = f"case when {size} < 10240 then concat({size}, ' bytes')", f"({size} // 512)"
    for unit in ("kB", "MB", "GB", "TB"):
        out += f" when {doubled} < 20479 then concat(({doubled} + 1) // 2, ' {unit}')"
        doubled = f"({doubled} // 1024)"
    return out + f" else concat(({doubled} + 1) // 2, ' PB') end"


# ------------------------------------------------------------------ K: dimensions

for _id, _name in zip(
    ["K01", "K02", "K03", "K04", "K05", "K06", "K07", "K08", "K09", "K10", "K11", "K12"], K.DIMENSIONS, strict=True
):
    QUERIES[f"{_id}_{_name}"] = lambda spark, sf, n=_name: plain(K.DIMENSIONS[n](catalog(spark, sf)))

SQL["K01_schemas"] = sql(
    ["cat_namespace", "cat_role", "cat_ns_acl", "cat_class", "cat_index_class", "cat_proc"],
    f"""
select n.db_id, n.oid id, n.nspname as name, r.rolname as owner,
  coalesce((select string_agg(grantee, ',' order by grantee) from cat_ns_acl a where a.db_id = n.db_id and a.nspoid = n.oid and privilege_type = 'USAGE' and grantee not in ('', '-')), '') allowed_users,
  coalesce((select string_agg(grantee, ',' order by grantee) from cat_ns_acl a where a.db_id = n.db_id and a.nspoid = n.oid and privilege_type = 'CREATE' and grantee not in ('', '-')), '') allowed_creators,
  (select count(*) from cat_class c where c.db_id = n.db_id and c.relnamespace = n.oid and c.relkind = 'r') table_count,
  (select count(*) from cat_class c where c.db_id = n.db_id and c.relnamespace = n.oid and c.relkind = 'v') view_count,
  (select count(*) from cat_proc p where p.db_id = n.db_id and p.pronamespace = n.oid) function_count,
  coalesce((select {pretty("cast(sum(relsize) as bigint)")} from rels c where c.db_id = n.db_id and c.relnamespace = n.oid and c.relkind in ('r', 'i', 'm') having sum(relsize) is not null), '0 bytes') total_size
from cat_namespace n join cat_role r on r.db_id = n.db_id and r.oid = n.nspowner
where not starts_with(n.nspname, 'pg_temp_') and not starts_with(n.nspname, 'pg_toast_temp_')""",
    ", rels as (select db_id, relnamespace, relkind, relsize from cat_class union all select db_id, relnamespace, relkind, relsize from cat_index_class)",
)
SQL["K02_tables"] = sql(
    ["cat_class", "cat_namespace", "cat_stat_table", "cat_description"],
    f"""
select c.db_id, c.oid id, n.nspname as schema, c.relname as name, c.relkind table_kind, c.relrowsecurity rls_enabled,
  c.relforcerowsecurity rls_forced,
  case c.relreplident when 'd' then 'DEFAULT' when 'i' then 'INDEX' when 'f' then 'FULL' else 'NOTHING' end replica_identity,
  c.relsize as bytes, {pretty("c.relsize")} as size, s.n_live_tup live_rows_estimate, s.n_dead_tup dead_rows_estimate,
  d.description as comment
from cat_class c join cat_namespace n on n.db_id = c.db_id and n.oid = c.relnamespace
left join cat_stat_table s on s.db_id = c.db_id and s.relid = c.oid
left join cat_description d on d.db_id = c.db_id and d.objoid = c.oid and d.objsubid = 0
where c.relkind in ('r', 'p', 'v', 'm')""",
)
COLUMNS_SQL = """
select a.db_id, a.attname as name, a.attnum as number, c.relname table_name, c.oid table_oid, c.relkind class_kind,
  n.nspname schema_name, a.atttypid type_id, t.typname type_name, not a.attnotnull is_nullable,
  case when a.atttypmod = -1 then null when a.atttypid in (1042, 1043) then a.atttypmod - 4 when a.atttypid in (1560, 1562) then a.atttypmod end varchar_length,
  f.adsrc default_expr, coalesce(i.p, false) is_primary_key, coalesce(i.u, false) is_unique, d.description as comment
from cat_attribute a
join cat_class c on c.db_id = a.db_id and c.oid = a.attrelid and c.relkind in ('r', 'v', 'm', 'f', 'p')
join cat_namespace n on n.db_id = c.db_id and n.oid = c.relnamespace
join cat_type t on t.db_id = a.db_id and t.oid = a.atttypid
left join (
  select db_id, indrelid, cast(k as int) k, bool_or(indisprimary) p, bool_or(indisunique) u
  from (select db_id, indrelid, unnest(string_split(indkey, ' ')) k, indisprimary, indisunique from cat_index) x group by all
) i on i.db_id = a.db_id and i.indrelid = a.attrelid and i.k = a.attnum
left join cat_attrdef f on f.db_id = a.db_id and f.adrelid = a.attrelid and f.adnum = a.attnum
left join cat_description d on d.db_id = a.db_id and d.objoid = a.attrelid and d.objsubid = a.attnum
where a.attnum >= 0"""
COLUMN_RELATIONS = ["cat_attribute", "cat_class", "cat_namespace", "cat_type", "cat_index", "cat_attrdef", "cat_description"]
SQL["K03_columns"] = sql(COLUMN_RELATIONS, COLUMNS_SQL)
SQL["K04_functions"] = sql(
    ["cat_proc", "cat_namespace", "cat_language", "cat_type"],
    """
select p.db_id, p.oid id, n.nspname as schema, p.proname as name, l.lanname as language, p.prokind kind,
  case when l.lanname <> 'internal' then p.prosrc end body,
  coalesce((select string_agg(concat_ws(':', coalesce(case string_split(p.proargmodes, ' ')[i] when 'i' then 'in' when 'o' then 'out' when 'b' then 'inout' when 'v' then 'variadic' else case when p.proargmodes is null then 'in' else 'table' end end, ''),
      case when p.proargnames is null then '' else string_split(p.proargnames, ' ')[i] end,
      string_split(p.proargtypes, ' ')[i], case when i > p.pronargs - p.pronargdefaults then 'true' else 'false' end), ',' order by i)
    from (select unnest(range(1, p.pronargs + 1)) i) g), '') args,
  p.prorettype return_type_id, t.typname return_type, nullif(t.typrelid, 0) return_type_relation_id,
  p.proretset is_set_returning_function,
  case p.provolatile when 'i' then 'IMMUTABLE' when 's' then 'STABLE' when 'v' then 'VOLATILE' end behavior,
  p.prosecdef security_definer
from cat_proc p left join cat_namespace n on n.db_id = p.db_id and n.oid = p.pronamespace
left join cat_language l on l.db_id = p.db_id and l.oid = p.prolang
left join cat_type t on t.db_id = p.db_id and t.oid = p.prorettype""",
)
_FORMAT = " ".join(f"when '{k}' then '{v}'" for k, v in C.SQL_TYPE_NAMES.items())
SQL["K05_types"] = sql(
    ["cat_type", "cat_namespace", "cat_enum", "cat_class", "cat_attribute"],
    f"""
select t.db_id, t.oid id, t.typname as name, n.nspname as schema, case t.typname {_FORMAT} else t.typname end format,
  coalesce((select string_agg(enumlabel, ',' order by enumsortorder) from cat_enum e where e.db_id = t.db_id and e.enumtypid = t.oid), '') enums,
  coalesce((select string_agg(concat(attname, ':', atttypid), ',' order by attnum) from cat_attribute a
    join cat_class c on c.db_id = a.db_id and c.oid = a.attrelid and c.relkind = 'c'
    where a.db_id = t.db_id and a.attrelid = t.typrelid and not a.attisdropped), '') attributes
from cat_type t left join cat_namespace n on n.db_id = t.db_id and n.oid = t.typnamespace
where t.typrelid = 0 or exists (select 1 from cat_class c where c.db_id = t.db_id and c.oid = t.typrelid and c.relkind = 'c')""",
)
SQL["K06_policies"] = sql(
    ["cat_policy", "cat_class", "cat_namespace", "cat_role"],
    """
select p.db_id, p.polname as name, c.relname table_name, n.nspname schema_name, p.polpermissive is_permissive,
  case p.polcmd when 'r' then 'SELECT' when 'a' then 'INSERT' when 'w' then 'UPDATE' when 'd' then 'DELETE' when '*' then 'ALL' end command,
  coalesce(string_agg(case when x.r = 0 then 'public' else o.rolname end, ',' order by case when x.r = 0 then 'public' else o.rolname end), '') role_names,
  p.qual security_qualification, p.with_check
from cat_policy p join cat_class c on c.db_id = p.db_id and c.oid = p.polrelid
join cat_namespace n on n.db_id = c.db_id and n.oid = c.relnamespace
join (select db_id, polrelid, polname, cast(unnest(string_split(polroles, ' ')) as bigint) r from cat_policy) x
  on x.db_id = p.db_id and x.polrelid = p.polrelid and x.polname = p.polname
left join cat_role o on o.db_id = x.db_id and o.oid = x.r
group by p.db_id, p.polname, c.relname, n.nspname, p.polpermissive, p.polcmd, p.qual, p.with_check, p.polrelid""",
)
SQL["K07_triggers"] = sql(
    ["cat_trigger", "cat_class", "cat_namespace", "cat_proc"],
    """
select t.db_id, t.tgname as name, c.relname table_name, n.nspname table_schema, p.proname proc_name, m.nspname proc_schema,
  case when t.tgtype & 1 <> 0 then 'row' else 'statement' end affected,
  case when t.tgtype & 2 <> 0 then 'before' when t.tgtype & 64 <> 0 then 'instead' else 'after' end timing,
  concat_ws(',', case when t.tgtype & 4 <> 0 then 'insert' end, case when t.tgtype & 8 <> 0 then 'delete' end,
    case when t.tgtype & 16 <> 0 then 'update' end, case when t.tgtype & 32 <> 0 then 'truncate' end) events
from cat_trigger t left join cat_class c on c.db_id = t.db_id and c.oid = t.tgrelid
left join cat_namespace n on n.db_id = c.db_id and n.oid = c.relnamespace
left join cat_proc p on p.db_id = t.db_id and p.oid = t.tgfoid
left join cat_namespace m on m.db_id = p.db_id and m.oid = p.pronamespace
where not t.tgisinternal and t.tgconstraint = 0""",
)
SQL["K08_roles"] = sql(
    ["cat_role", "cat_auth_member"],
    """
select r.db_id, r.rolname as name, r.rolsuper is_super_user, r.rolcreatedb can_create_db, r.rolcanlogin can_login,
  r.rolbypassrls can_bypass_rls, r.rolcreaterole can_create_roles,
  coalesce((select string_agg(p.rolname, ',' order by p.rolname) from cat_auth_member m join cat_role p on p.db_id = m.db_id and p.oid = m.roleid where m.db_id = r.db_id and m.member = r.oid), '') member_of,
  coalesce((select string_agg(p.rolname, ',' order by p.rolname) from cat_auth_member m join cat_role p on p.db_id = m.db_id and p.oid = m.member where m.db_id = r.db_id and m.roleid = r.oid), '') has_member
from cat_role r""",
)
SQL["K09_indexes"] = sql(
    ["cat_index_class", "cat_namespace", "cat_index", "cat_class"],
    f"""
select c.db_id, c.oid id, n.nspname as schema, c.relname as name, t.relname table_name
from cat_index_class c join cat_namespace n on n.db_id = c.db_id and n.oid = c.relnamespace
join cat_index i on i.db_id = c.db_id and i.indexrelid = c.oid join cat_class t on t.db_id = i.db_id and t.oid = i.indrelid
where c.relkind = 'i' and n.nspname not in ({SYSTEM})""",
)
SQL["K10_sequences"] = sql(
    ["cat_class", "cat_namespace"],
    f"""
select c.db_id, c.oid id, n.nspname as schema, c.relname as name
from cat_class c join cat_namespace n on n.db_id = c.db_id and n.oid = c.relnamespace
where c.relkind = 'S' and n.nspname not in ({SYSTEM})""",
)
SQL["K11_extensions"] = sql(
    ["cat_available_extension", "cat_extension", "cat_namespace"],
    """
select e.db_id, e.name, n.nspname as schema, e.default_version, x.extversion installed_version, e.comment
from cat_available_extension e left join cat_extension x on x.db_id = e.db_id and x.extname = e.name
left join cat_namespace n on n.db_id = x.db_id and n.oid = x.extnamespace""",
)
SQL["K12_versions"] = sql(
    ["cat_setting", "cat_activity"],
    """
select s.db_id, cast(s.value as bigint) version_num, cast(s.value as bigint) // 10000 major_version,
  (select count(*) from cat_activity a where a.db_id = s.db_id) active_connections, cast(m.value as bigint) max_connections
from cat_setting s left join cat_setting m on m.db_id = s.db_id and m.name = 'max_connections'
where s.name = 'server_version_num'""",
)


REFS_SQL = """
select cast(p_partkey % 5 as int) db_id,
  cast(case p_size % 6 when 0 then 1259 when 1 then 1255 when 2 then 1247 when 3 then 2615 when 4 then 1249 else 9999 end as bigint) classid,
  case p_size % 6 when 1 then 50000 + p_partkey when 2 then 10000 + cast(floor(p_partkey / 5) as bigint) when 3 then p_partkey % 6
    else p_partkey end objid,
  case p_size % 6 when 4 then cast(p_partkey % 8 as int) else 0 end objsubid
from part"""


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView("part")
    return spark.sql(REFS_SQL)


QUERIES["K13_objects_by_oid"] = lambda spark, sf: K.resolve_objects(_refs(spark, sf), catalog(spark, sf))
SQL["K13_objects_by_oid"] = sql(
    [*COLUMN_RELATIONS, "cat_index_class", "cat_proc"],
    f"""
select r.db_id, r.classid, r.objid, r.objsubid,
  case r.classid when 1259 then coalesce(case when c.relkind in ('r','p','v','m') then cn.nspname end, xn.nspname, case when c.relkind = 'S' and cn.nspname not in ({SYSTEM}) then cn.nspname end)
    when 1255 then pn.nspname when 1247 then case when {{TYPE_OK}} then tn.nspname end when 1249 then k.schema_name end as schema,
  case r.classid when 1259 then coalesce(case when c.relkind in ('r','p','v','m') then c.relname end, case when xn.nspname is not null then x.relname end, case when c.relkind = 'S' and cn.nspname not in ({SYSTEM}) then c.relname end)
    when 1255 then p.proname when 1247 then case when {{TYPE_OK}} then t.typname end
    when 2615 then n.nspname when 1249 then k.table_name || '.' || k.name end object_name,
  case r.classid when 1259 then case when c.relkind = 'r' then 'ordinary' when c.relkind = 'p' then 'partitioned' when c.relkind = 'v' then 'view' when c.relkind = 'm' then 'materializedview'
      when xn.nspname is not null then 'index' when c.relkind = 'S' and cn.nspname not in ({SYSTEM}) then 'sequence' end
    when 1255 then case p.prokind when 'f' then 'function' when 'p' then 'procedure' when 'a' then 'aggregate' end
    when 1247 then case when {{TYPE_OK}} then 'type' end
    when 2615 then case when n.oid is not null then 'schema' end when 1249 then case when k.name is not null then 'column' end end object_type
from refs r
left join cat_class c on c.db_id = r.db_id and c.oid = r.objid left join cat_namespace cn on cn.db_id = c.db_id and cn.oid = c.relnamespace
left join cat_index_class x on x.db_id = r.db_id and x.oid = r.objid left join cat_namespace xn on xn.db_id = x.db_id and xn.oid = x.relnamespace
left join cat_proc p on p.db_id = r.db_id and p.oid = r.objid left join cat_namespace pn on pn.db_id = p.db_id and pn.oid = p.pronamespace
left join cat_type t on t.db_id = r.db_id and t.oid = r.objid left join cat_namespace tn on tn.db_id = t.db_id and tn.oid = t.typnamespace
left join cat_class tc on tc.db_id = t.db_id and tc.oid = t.typrelid
left join cat_namespace n on n.db_id = r.db_id and n.oid = r.objid and not starts_with(n.nspname, 'pg_temp_')
left join cols k on k.db_id = r.db_id and k.table_oid = r.objid and k.number = r.objsubid and r.classid = 1249""".replace(
        "{TYPE_OK}", "t.typrelid = 0 or tc.relkind = 'c'"
    ),
    f", cols as ({COLUMNS_SQL}), refs as ({REFS_SQL})",
)

QUERIES["I07_catalog_export"] = lambda spark, sf: export_json(
    {n: plain(K.DIMENSIONS[n](catalog(spark, sf))) for n in ("versions", "extensions", "sequences")}
)
_VERSIONS, _EXT, _SEQ = SQL["K12_versions"], SQL["K11_extensions"], SQL["K10_sequences"]
SQL["I07_catalog_export"] = f"""
select 'extensions' kind, db_id, case when "schema" is null and installed_version is null then to_json({{'comment': "comment", 'db_id': db_id, 'default_version': default_version, 'name': name}})
  when "schema" is null then to_json({{'comment': "comment", 'db_id': db_id, 'default_version': default_version, 'installed_version': installed_version, 'name': name}})
  else to_json({{'comment': "comment", 'db_id': db_id, 'default_version': default_version, 'installed_version': installed_version, 'name': name, 'schema': "schema"}}) end::varchar json from ({_EXT})
union all select 'sequences', db_id, to_json({{'db_id': db_id, 'id': id, 'name': name, 'schema': "schema"}})::varchar from ({_SEQ})
union all select 'versions', db_id, to_json({{'active_connections': active_connections, 'db_id': db_id, 'major_version': major_version, 'max_connections': max_connections, 'version_num': version_num}})::varchar from ({_VERSIONS})"""

# ------------------------------------------------------------------ D: audit rules

EXCLUDED = quoted(C.EXCLUDED_SCHEMAS)
API = """
, exposed as (select distinct db_id, trim(unnest(string_split(value, ','))) nspname from cat_setting where name = 'pgrst.db_schemas')
, readable as (select db_id, oid, min(rolname) reader from cat_privilege where rolname in ('anon', 'authenticated') and privilege = 'SELECT' group by db_id, oid)
, rel as (select c.*, n.nspname from cat_class c join cat_namespace n on n.db_id = c.db_id and n.oid = c.relnamespace)
, api as (select r.*, a.reader from rel r join readable a on a.db_id = r.db_id and a.oid = r.oid join exposed e on e.db_id = r.db_id and e.nspname = r.nspname)
, ext as (select distinct db_id, objid from cat_depend where deptype = 'e')"""
API_RELATIONS = ["cat_setting", "cat_privilege", "cat_class", "cat_namespace", "cat_depend"]
NO_EXT = "not exists (select 1 from ext x where x.db_id = {t}.db_id and x.objid = {t}.{k})"


def finding(rule_id: str, detail: str, key: str, source: str, kind: str = "'table'", extra: str = "null",
            schema: str = "nspname", name: str = "relname") -> str:
    r = D.RULES[rule_id]
    return f"""select db_id, '{r.name}' as rule, '{r.level}' as level, cast({schema} as varchar) schema_name, cast({name} as varchar) object_name,
  cast({kind} as varchar) object_type, {detail} detail, {key} cache_key, cast({extra} as varchar) extra from ({source}) src"""


def text(template: str, *args: str) -> str:
    pieces = []
    for i, part in enumerate(template.split("%s")):
        if part:
            pieces.append("'" + part.replace("'", "''") + "'")
        if i < len(args):
            pieces.append(args[i])
    return f"concat({', '.join(pieces)})"


def key(prefix: str, *args: str) -> str:
    return text(prefix + "_%s" * len(args), *args)


INVOKER = "exists (select 1 from (select unnest(string_split(lower(reloptions), ' ')) o) z where o in ({}))".format(
    quoted(C.SECURITY_INVOKER_OPTIONS)
)
POLICIES = "select p.*, r.nspname, r.relname, r.relkind, r.relrowsecurity from cat_policy p join rel r on r.db_id = p.db_id and r.oid = p.polrelid"
ALWAYS = quoted(C.ALWAYS_TRUE)
_INIT = " or ".join(
    f"(coalesce({e} like '%{c}%', false) and lower({e}) not like '%select {c}%')"
    for e in ("qual", "with_check")
    for c in ("auth.uid()", "auth.jwt()", "auth.role()", "auth.email()", "current_setting(%)")
)
_NORM = "replace(replace(replace(lower(coalesce({e}, '')), ' ', ''), chr(10), ''), chr(9), '')"
_QUAL, _CHECK = _NORM.format(e="qual"), _NORM.format(e="with_check")
_CMD = "case polcmd when 'r' then 'SELECT' when 'a' then 'INSERT' when 'w' then 'UPDATE' when 'd' then 'DELETE' when '*' then 'ALL' end"

D_SQL: dict[str, tuple[list[str], str, str]] = {
    "D01": (["cat_constraint", "cat_index"], finding("D01",
        text("Table `%s.%s` has a foreign key `%s` without a covering index. This can lead to suboptimal query performance.", "nspname", "relname", "conname"),
        key("unindexed_foreign_keys", "nspname", "relname", "conname"),
        f"""select r.nspname, r.relname, k.* from cat_constraint k join rel r on r.db_id = k.db_id and r.oid = k.conrelid
          where k.contype = 'f' and r.nspname not in ({EXCLUDED}, 'pg_catalog', 'information_schema', 'auth', 'storage', 'vault', 'extensions') and {NO_EXT.format(t='r', k='oid')}
          and not exists (select 1 from cat_index i where i.db_id = k.db_id and i.indrelid = k.conrelid and i.indisvalid and (i.indkey = k.conkey or i.indkey like concat(k.conkey, ' %')))""",
        extra="concat('{\"fkey_name\":\"', conname, '\",\"fkey_columns\":[', replace(conkey, ' ', ','), ']}')"), ""),
    "D02": (["cat_policy"], finding("D02",
        text("Table `%s.%s` has a row level security policy `%s` that re-evaluates current_setting() or auth.<function>() for each row.", "nspname", "relname", "polname"),
        key("auth_rls_init_plan", "nspname", "relname", "polname"),
        f"{POLICIES} where r.relrowsecurity and r.nspname not in ({quoted([s for s in C.EXCLUDED_SCHEMAS if s != 'realtime'])}) and ({_INIT})"), ""),
    "D03": (["cat_index"], finding("D03", text("Table `%s.%s` does not have a primary key", "nspname", "relname"), key("no_primary_key", "nspname", "relname"),
        f"""select r.db_id, r.oid, r.nspname, r.relname from rel r left join cat_index i on i.db_id = r.db_id and i.indrelid = r.oid
          where r.relkind = 'r' and r.nspname not in ({EXCLUDED}) and {NO_EXT.format(t='r', k='oid')}
          group by r.db_id, r.oid, r.nspname, r.relname having max(case when i.indisprimary then 1 else 0 end) = 0"""), ""),
    "D04": (["cat_stat_index", "cat_index"], finding("D04", text("Index `%s` on table `%s.%s` has not been used", "indexrelname", "schemaname", "relname"),
        key("unused_index", "schemaname", "relname", "indexrelname"),
        f"""select s.* from cat_stat_index s join cat_index i on i.db_id = s.db_id and i.indexrelid = s.indexrelid
          where s.idx_scan = 0 and not i.indisunique and not i.indisprimary and s.schemaname not in ({EXCLUDED}) and {NO_EXT.format(t='s', k='relid')}""",
        schema="schemaname"), ""),
    "D05": (["cat_policy", "cat_role"], finding("D05",
        text("Table `%s.%s` has multiple permissive policies for role `%s` for action `%s`. Policies include `%s`", "nspname", "relname", "rolname", "cmd", "names"),
        key("multiple_permissive_policies", "nspname", "relname", "rolname", "cmd"),
        f"""select p.db_id, r.nspname, r.relname, o.rolname, p.cmd, concat('{{', string_agg(p.polname, ',' order by p.polname), '}}') names
          from (select *, unnest(case polcmd when 'r' then ['SELECT'] when 'a' then ['INSERT'] when 'w' then ['UPDATE'] when 'd' then ['DELETE'] else ['SELECT', 'INSERT', 'UPDATE', 'DELETE'] end) cmd from cat_policy) p
          join rel r on r.db_id = p.db_id and r.oid = p.polrelid
          join cat_role o on o.db_id = p.db_id and (p.polroles = '0' or list_contains(string_split(p.polroles, ' '), cast(o.oid as varchar)))
          where r.relkind = 'r' and p.polpermissive and r.nspname not in ({EXCLUDED}) and o.rolname not like 'pg_%' and o.rolname not like 'supabase%admin'
          and not o.rolbypassrls and {NO_EXT.format(t='r', k='oid')}
          group by p.db_id, r.nspname, r.relname, o.rolname, p.cmd having count(*) > 1"""), ""),
    "D06": (["cat_index"], finding("D06", text("Table `%s.%s` has identical indexes %s. Drop all except one of them", "nspname", "relname", "concat('{', names, '}')"),
        key("duplicate_index", "nspname", "relname", "concat('{', names, '}')"),
        f"""select r.db_id, r.nspname, r.relkind, r.relname, string_agg(i.indexname, ',' order by i.indexname) names
          from cat_index i join rel r on r.db_id = i.db_id and r.oid = i.indrelid
          where r.relkind in ('r', 'm') and r.nspname not in ({EXCLUDED}) and {NO_EXT.format(t='r', k='oid')}
          group by r.db_id, r.nspname, r.relkind, r.relname, replace(i.indexdef, i.indexname, '') having count(*) > 1""",
        kind="case when relkind = 'r' then 'table' else 'materialized view' end",
        extra="concat('{\"indexes\":[\"', replace(names, ',', '\",\"'), '\"]}')"), ""),
    "D07": (["cat_stats"], finding("D07", text("Table `%s`.`%s` has excessive bloat", "nspname", "relname"), key("table_bloat", "nspname", "relname"),
        """select * from (select *, case when otta = 0 then 0 else round(relpages / otta, 1) end bloat,
            case when relpages < otta then 0 else 8192 * (relpages - otta) end waste from (
          select r.db_id, r.nspname, r.relname, r.relpages,
            ceil(r.reltuples * (dh + 4 - case when dh % 4 = 0 then 4 else dh % 4 end + mx * (nh + 4 - case when nh % 4 = 0 then 4 else nh % 4 end) + 4) / (8192 - 20)) otta
          from rel r join (select db_id, schemaname, tablename, sum((1 - null_frac) * avg_width) + 24 dh, max(null_frac) mx,
              24 + (count(*) filter (where null_frac <> 0)) // 8 nh from cat_stats group by 1, 2, 3) w
            on w.db_id = r.db_id and w.schemaname = r.nspname and w.tablename = r.relname
          where r.relkind = 'r' and r.amname = 'heap') a) b where bloat > 70 and waste > 20 * 1024 * 1024"""), ""),
    "D08": (["cat_rewrite"], finding("D08",
        text('View/Materialized View "%s" in the public schema may expose `auth.users` data to anon or authenticated roles.', "relname"),
        key("auth_users_exposed", "nspname", "relname"),
        f"""select distinct a.db_id, a.oid, a.nspname, a.relname, a.reader from rel u
          join cat_depend d on d.db_id = u.db_id and d.refobjid = u.oid and d.deptype = 'n'
          join cat_rewrite w on w.db_id = d.db_id and w.oid = d.objid join api a on a.db_id = w.db_id and a.oid = w.ev_class
          where u.nspname = 'auth' and u.relname = 'users'
          and (a.relkind = 'm' or (a.relkind = 'v' and (not {INVOKER.replace('reloptions', 'a.reloptions')} or not u.relrowsecurity)))""",
        kind="'view'", extra="concat('{\"exposed_to\":[\"', reader, '\"]}')"), ""),
    "D09": (["cat_policy"], finding("D09",
        text("Table `%s.%s` has RLS policies but RLS is not enabled on the table. Policies include %s.", "nspname", "relname", "names"),
        key("policy_exists_rls_disabled", "nspname", "relname"),
        f"""select r.db_id, r.nspname, r.relname, concat('{{', string_agg(p.polname, ',' order by p.polname), '}}') names
          from cat_policy p join rel r on r.db_id = p.db_id and r.oid = p.polrelid
          where r.relkind = 'r' and r.nspname not in ({EXCLUDED}) and not r.relrowsecurity and {NO_EXT.format(t='r', k='oid')} group by 1, 2, 3"""), ""),
    "D10": (["cat_policy"], finding("D10", text("Table `%s.%s` has RLS enabled, but no policies exist", "nspname", "relname"), key("rls_enabled_no_policy", "nspname", "relname"),
        f"""select distinct r.db_id, r.nspname, r.relname from rel r left join cat_policy p on p.db_id = r.db_id and p.polrelid = r.oid
          where r.relkind = 'r' and r.nspname not in ({EXCLUDED}) and r.relrowsecurity and p.polname is null and {NO_EXT.format(t='r', k='oid')}"""), ""),
    "D11": ([], finding("D11", text("View `%s.%s` is defined with the SECURITY DEFINER property", "nspname", "relname"), key("security_definer_view", "nspname", "relname"),
        f"""select a.* from api a join cat_setting s on s.db_id = a.db_id and s.name = 'server_version_num'
          where a.relkind = 'v' and cast(try_cast(s.value as bigint) // 10000 as varchar) >= '15' and a.nspname not in ({EXCLUDED})
          and {NO_EXT.format(t='a', k='oid')} and not {INVOKER.replace('reloptions', 'a.reloptions')}""", kind="'view'"), ""),
    "D12": (["cat_proc"], finding("D12", text("Function `%s.%s` has a role mutable search_path", "nspname", "proname"),
        key("function_search_path_mutable", "nspname", "proname", "md5(prosrc)"),
        f"""select p.*, n.nspname from cat_proc p join cat_namespace n on n.db_id = p.db_id and n.oid = p.pronamespace
          where n.nspname not in ({EXCLUDED}) and {NO_EXT.format(t='p', k='oid')}
          and not (concat(' ', coalesce(p.proconfig, '')) like '% search\\_path=%' escape '\\')""", kind="'function'", name="proname"), ""),
    "D13": ([], finding("D13", text("Table `%s.%s` is public, but RLS has not been enabled.", "nspname", "relname"), key("rls_disabled_in_public", "nspname", "relname"),
        f"select * from api where relkind = 'r' and not relrowsecurity and nspname not in ({EXCLUDED})"), ""),
    "D14": (["cat_extension"], finding("D14", text("Extension `%s` is installed in the public schema. Move it to another schema.", "extname"), key("extension_in_public", "extname"),
        "select e.*, n.nspname from cat_extension e join cat_namespace n on n.db_id = e.db_id and n.oid = e.extnamespace where n.nspname = 'public' and e.extname <> 'plpgsql'",
        kind="'extension'", name="extname"), ""),
    "D15": (["cat_policy"], finding("D15",
        text("Table `%s.%s` has a row level security policy `%s` that references `user_metadata`. `user_metadata` is editable by end users and should never be used in a security context.", "nspname", "relname", "polname"),
        key("rls_references_user_metadata", "nspname", "relname", "polname"),
        f"""{POLICIES} where r.nspname not in ({EXCLUDED}) and (coalesce(qual, '') like '%auth.jwt()%user_metadata%' or coalesce(qual, '') like '%current_setting(%request.jwt.claims%)%user_metadata%'
          or coalesce(with_check, '') like '%auth.jwt()%user_metadata%' or coalesce(with_check, '') like '%current_setting(%request.jwt.claims%)%user_metadata%')"""), ""),
    "D16": ([], finding("D16", text("Materialized view `%s.%s` is selectable by anon or authenticated roles", "nspname", "relname"), key("materialized_view_in_api", "nspname", "relname"),
        f"select * from api a where relkind = 'm' and nspname not in ({EXCLUDED}) and {NO_EXT.format(t='a', k='oid')}", kind="'materialized view'"), ""),
    "D17": ([], finding("D17", text("Foreign table `%s.%s` is accessible over APIs", "nspname", "relname"), key("foreign_table_in_api", "nspname", "relname"),
        f"select * from api a where relkind = 'f' and nspname not in ({EXCLUDED}) and {NO_EXT.format(t='a', k='oid')}", kind="'foreign table'"), ""),
    "D18": (["cat_attribute", "cat_type"], finding("D18",
        text("Table `%s.%s` has a column `%s` with unsupported reg* type `%s`.", "nspname", "relname", "attname", "typname"),
        key("unsupported_reg_types", "nspname", "relname", "attname"),
        f"""select r.db_id, r.nspname, r.relname, a.attname, t.typname from cat_attribute a join rel r on r.db_id = a.db_id and r.oid = a.attrelid
          join cat_type t on t.db_id = a.db_id and t.oid = a.atttypid join cat_namespace n on n.db_id = t.db_id and n.oid = t.typnamespace
          where n.nspname = 'pg_catalog' and t.typname in ({quoted(C.REG_TYPES)}) and r.nspname not in ({quoted(C.REG_EXCLUDED_SCHEMAS)})""",
        extra="concat('{\"column\":\"', attname, '\"}')"), ""),
    "D19": ([], finding("D19", text("Table `%s.%s` is public, but RLS has not been enabled.", "nspname", "relname"), key("rls_disabled_in_public", "nspname", "relname"),
        """select r.* from rel r join readable a on a.db_id = r.db_id and a.oid = r.oid where r.nspname = 'pgmq' and r.relkind in ('r', 'I') and not r.relrowsecurity
          and r.relname like 'q_%' and exists (select 1 from exposed e where e.db_id = r.db_id and e.nspname = 'pgmq_public')"""), ""),
    "D20": (["cat_constraint", "cat_index"], finding("D20", text("Table `%s`.`%s` has a foreign key `%s` referencing an auth unique constraint", "nspname", "relname", "conname"),
        key("fkey_to_auth_unique", "nspname", "relname", "conname"),
        """select r.db_id, r.nspname, r.relname, k.conname from cat_constraint k join rel r on r.db_id = k.db_id and r.oid = k.conrelid
          join rel t on t.db_id = k.db_id and t.oid = k.confrelid join cat_index i on i.db_id = k.db_id and i.indexrelid = k.conindid
          where k.contype = 'f' and t.nspname = 'auth' and i.indisunique and not i.indisprimary""",
        kind="null", extra="concat('{\"foreign_key\":\"', conname, '\"}')"), ""),
    "D21": (["cat_available_extension", "cat_available_extension_version"], finding("D21",
        text("Extension `%s` is using version `%s` but version `%s` is available. Using outdated extension versions may expose the database to security vulnerabilities.", "name", "installed_version", "default_version"),
        key("extension_versions_outdated", "name", "installed_version"),
        "select e.* from cat_available_extension e join cat_available_extension_version v on v.db_id = e.db_id and v.name = e.name and v.installed where e.installed_version is not null and e.installed_version <> e.default_version",
        kind="null", schema="null", name="null",
        extra="concat('{\"extension_name\":\"', name, '\",\"installed_version\":\"', installed_version, '\",\"default_version\":\"', default_version, '\"}')"), ""),
    "D22": (["cat_attribute"], finding("D22",
        text("Table `%s.%s` is exposed via API without RLS and contains potentially sensitive column(s): %s. This may lead to data exposure.", "nspname", "relname", "array_to_string(names, ', ')"),
        key("sensitive_columns_exposed", "nspname", "relname"),
        f"""select a.db_id, a.nspname, a.relname, list_sort(list(distinct t.attname)) names, list_sort(list(distinct replace(lower(t.attname), '-', '_'))) pats
          from api a join cat_attribute t on t.db_id = a.db_id and t.attrelid = a.oid and t.attnum > 0 and not t.attisdropped
          where a.relkind = 'r' and not a.relrowsecurity and a.nspname not in ({EXCLUDED}) and replace(lower(t.attname), '-', '_') in ({quoted(C.SENSITIVE_COLUMNS)}) group by 1, 2, 3""",
        extra="concat('{\"sensitive_columns\":[\"', array_to_string(names, '\",\"'), '\"],\"matched_patterns\":[\"', array_to_string(pats, '\",\"'), '\"]}')"), ""),
    "D23": (["cat_policy", "cat_role"], finding("D23",
        text("Table `%s.%s` has an RLS policy `%s` for `%s` that allows unrestricted access%s. This effectively bypasses row-level security for %s.", "nspname", "relname", "polname", "cmd",
             "case when u and k then ' (both USING and WITH CHECK are always true)' when u then ' (USING clause is always true)' else ' (WITH CHECK clause is always true)' end", "array_to_string(names, ', ')"),
        key("rls_policy_always_true", "nspname", "relname", "polname"),
        f"""select * from (select *, (cmd in ('UPDATE', 'DELETE', 'ALL') and (nq in ({ALWAYS}) or qual is null)) u,
            (nk in ({ALWAYS}) or (with_check is null and cmd = 'INSERT') or (with_check is null and cmd in ('UPDATE', 'ALL') and nq in ({ALWAYS}))) k
          from (select p.*, {_CMD} cmd, {_QUAL} nq, {_CHECK} nk,
            (select list(case when x.r = '0' then '-' else coalesce(o.rolname, x.r) end order by x.i) from (select unnest(string_split(p.polroles, ' ')) r, unnest(range(1, len(string_split(p.polroles, ' ')) + 1)) i) x
              left join cat_role o on o.db_id = p.db_id and cast(o.oid as varchar) = x.r) names
            from ({POLICIES}) p where relkind = 'r' and nspname not in ({EXCLUDED}) and relrowsecurity and polpermissive) a) b
          where (u or k) and (polroles = '0' or list_has_any(names, ['anon', 'authenticated']))""",
        extra="concat('{\"policy_name\":\"', polname, '\",\"command\":\"', cmd, '\",\"roles\":[\"', array_to_string(names, '\",\"'), '\"],\"permissive_using\":', u, ',\"permissive_with_check\":', k, '}')"), ""),
}

for _id, _rule in D.RULES.items():
    _name = f"{_id}_{_rule.name}"
    QUERIES[_name] = lambda spark, sf, i=_id: D.RULES[i].rows(catalog(spark, sf))
    _rels, _body, _extra = D_SQL[_id]
    SQL[_name] = sql([*API_RELATIONS, *_rels], _body, API + _extra)

# The driver: every rule, gate, two ignore globs and one per-rule glob.
IGNORE = ["public.rel_1*", "audit.*"]
RULE_IGNORE = {"no_primary_key": ["app.*_2?"]}


def _audit(spark: SparkSession, sf: str) -> DataFrame:
    return D.audit(catalog(spark, sf), ignore=IGNORE, rule_ignore=RULE_IGNORE).select(*D.COLUMNS, "severity", "category")


QUERIES["D00_audit_driver"] = _audit
_ALL = []
for _id, _rule in D.RULES.items():
    _gate = " where db_id in (select db_id from cat_role where rolname in ('anon', 'authenticated', 'service_role') group by db_id having count(distinct rolname) = 3)" if _rule.gated else ""
    _ALL.append(f"select *, 'catalog/{_rule.group}/{_rule.name}' category from ({D_SQL[_id][1]}) x{_gate}")
SQL["D00_audit_driver"] = sql(
    [*API_RELATIONS, "cat_role", *{r for v in D_SQL.values() for r in v[0]}],
    "select *, case level when 'INFO' then 1 when 'WARN' then 2 else 3 end severity from ("
    + "\nunion all\n".join(_ALL)
    + """) f where schema_name is null or object_name is null or not (
  regexp_matches(concat(schema_name, '.', object_name), '^public\\.rel_1[^/]*$') or regexp_matches(concat(schema_name, '.', object_name), '^audit\\.[^/]*$')
  or (rule = 'no_primary_key' and regexp_matches(concat(schema_name, '.', object_name), '^app\\.[^/]*_2[^/]$')))""",
    API,
)
