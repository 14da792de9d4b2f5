"""Catalog relations derived in SQL from the TPC-H-like tables.

One text serves Spark and DuckDB; only the string type name differs ({S}). Every source row is used.
Arrays are kept as space-separated text. `db_id` is the fleet member. Within a member, parts, customers
and suppliers are numbered by `floor(key / 5)`, called q below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# name -> (relations it reads, select text)
RELATIONS: dict[str, tuple[list[str], str]] = {
    "cat_namespace": ([], """
select cast(n_nationkey % 5 as int) db_id, cast(floor(n_nationkey / 5) as bigint) + 1 oid,
  case cast(floor(n_nationkey / 5) as int) when 0 then 'public' when 1 then 'app' when 2 then 'auth' when 3 then 'pg_catalog'
    else case n_nationkey % 5 when 0 then 'audit' when 1 then 'pgmq' when 2 then 'app_staging' when 3 then 'sbox_tools' else 'pg_temp_3' end
  end nspname,
  cast(10 + n_nationkey % 4 as bigint) nspowner
from nation"""),
    "cat_class": ([], """
select cast(p_partkey % 5 as int) db_id, p_partkey oid,
  case when p_partkey < 5 then 'users'
       when p_size % 5 = 4 and p_partkey % 5 = 1 then concat('q_', cast(p_partkey as {S}))
       when p_partkey % 23 = 7 then concat('Rel_', cast(p_partkey as {S}))
       when p_partkey % 211 = 9 then 'order'
       else concat('rel_', cast(p_partkey as {S})) end relname,
  cast(case when p_partkey < 5 then 3 else p_size % 5 + 1 end as bigint) relnamespace,
  case when cast(floor(p_partkey / 5) as int) % 20 in (12, 13) then 'v'
       when cast(floor(p_partkey / 5) as int) % 20 = 14 then 'm'
       when cast(floor(p_partkey / 5) as int) % 20 = 15 then 'f'
       when cast(floor(p_partkey / 5) as int) % 20 = 16 then 'p'
       when cast(floor(p_partkey / 5) as int) % 20 = 17 then 'c'
       when cast(floor(p_partkey / 5) as int) % 20 = 18 then 'S'
       else 'r' end relkind,
  p_size % 3 = 0 relrowsecurity, p_size % 6 = 0 relforcerowsecurity,
  case p_size % 4 when 0 then 'd' when 1 then 'i' when 2 then 'f' else 'n' end relreplident,
  cast(10 + p_partkey % 4 as bigint) relowner,
  case p_size % 4 when 0 then '' when 1 then 'security_invoker=ON' when 2 then 'fillfactor=70' else 'security_invoker=false' end reloptions,
  'heap' amname, cast(p_size * p_size * 20 as bigint) relpages, cast(p_retailprice as double) reltuples,
  cast(p_size * p_size * p_size as bigint) * 4096 * (p_partkey % 7) relsize
from part"""),
    "cat_column_slot": ([], """
select distinct l_partkey, l_linenumber from lineitem"""),
    "cat_index": (["cat_column_slot"], """
select cast(l_partkey % 5 as int) db_id, 1000000000000 + l_partkey * 10 + l_linenumber indexrelid, l_partkey indrelid,
  case when l_partkey % 4 = 2 then case l_linenumber % 2 when 0 then '4' else '4 5' end
       else case l_linenumber % 3 when 0 then '1' when 1 then '1 2' else '2 3' end end indkey,
  (l_linenumber = 1 and l_partkey % 3 <> 0) indisprimary, l_linenumber <= 2 indisunique, l_linenumber % 4 <> 0 indisvalid,
  concat('ix_', cast(l_partkey as {S}), '_', cast(l_linenumber as {S})) indexname,
  concat('CREATE INDEX ix_', cast(l_partkey as {S}), '_', cast(l_linenumber as {S}), ' USING btree (c',
         cast(l_linenumber % 3 as {S}), ')') indexdef
from cat_column_slot"""),
    "cat_index_class": (["cat_index", "cat_class"], """
select i.db_id, i.indexrelid oid, i.indexname relname, c.relnamespace, 'i' relkind, c.relsize relsize
from cat_index i join cat_class c on c.db_id = i.db_id and c.oid = i.indrelid"""),
    "cat_constraint": ([], """
select cast(p_partkey % 5 as int) db_id, concat('con_', cast(p_partkey as {S})) conname,
  case p_partkey % 2 when 0 then 'f' else 'c' end contype, p_partkey conrelid,
  case when p_partkey % 3 = 0 then p_partkey % 5 else p_partkey + 5 end confrelid,
  case p_partkey % 3 when 0 then '1' when 1 then '2' else '2 3' end conkey,
  case p_partkey % 3 when 0 then '2' when 1 then '1' else '3 2' end confkey,
  1000000000000 + p_partkey * 10 + 2 conindid
from part"""),
    "cat_rewrite": ([], """
select cast(p_partkey % 5 as int) db_id, 70000000000 + p_partkey oid, p_partkey ev_class from part"""),
    "cat_depend": ([], """
select cast(p_partkey % 5 as int) db_id, p_partkey objid, cast(0 as bigint) refobjid,
  case when p_partkey % 17 = 0 and p_partkey >= 5 then 'e' else 'a' end deptype from part
union all
select cast(p_partkey % 5 as int) db_id, 70000000000 + p_partkey objid,
  case when p_size % 2 = 0 then p_partkey % 5 else p_partkey + 5 end refobjid, 'n' deptype from part"""),
    "cat_attribute": (["cat_column_slot"], """
select cast(l_partkey % 5 as int) db_id, l_partkey attrelid, l_linenumber attnum,
  case l_linenumber when 1 then 'id'
    when 2 then case l_partkey % 6 when 0 then 'Api-Key' when 1 then 'password' when 2 then 'ssn' else 'name' end
    when 3 then case l_partkey % 9 when 0 then 'order' when 1 then 'token' else 'amount' end
    else concat('col_', cast(l_linenumber as {S})) end attname,
  cast(case (l_partkey + l_linenumber) % 9 when 0 then 20 when 1 then 23 when 2 then 25 when 3 then 1043 when 4 then 24
    when 5 then 1114 when 6 then 16 when 7 then 2203 else 114 end as bigint) atttypid,
  l_linenumber % 2 = 1 attnotnull,
  cast(case when (l_partkey + l_linenumber) % 9 = 3 then l_linenumber * 10 + 4 else -1 end as int) atttypmod,
  l_linenumber = 7 and l_partkey % 5 = 0 attisdropped
from cat_column_slot"""),
    "cat_attrdef": (["cat_column_slot"], """
select cast(l_partkey % 5 as int) db_id, l_partkey adrelid, l_linenumber * 2 adnum,
  case l_partkey % 5 when 0 then 'now()' when 1 then concat(chr(39), 'anonymous', chr(39), '::text')
    when 2 then '(42)::int8' when 3 then concat(' ', chr(39), 'a b-c.d', chr(39), ' ') else 'a || b' end adsrc
from cat_column_slot"""),
    "cat_type": ([], """
select cast(c_custkey % 5 as int) db_id,
  cast(case cast(floor(c_custkey / 5) as int) when 0 then 21 when 1 then 23 when 2 then 20 when 3 then 700 when 4 then 701 when 5 then 16
    when 6 then 25 when 7 then 1043 when 8 then 114 when 9 then 1114 when 10 then 24 when 11 then 2203 when 12 then 2950
    when 13 then 1700 when 14 then 1082 when 15 then 2205 else 10000 + floor(c_custkey / 5) end as bigint) oid,
  case cast(floor(c_custkey / 5) as int) when 0 then 'int2' when 1 then 'int4' when 2 then 'int8' when 3 then 'float4' when 4 then 'float8'
    when 5 then 'bool' when 6 then 'text' when 7 then 'varchar' when 8 then 'json' when 9 then 'timestamp' when 10 then 'regproc'
    when 11 then 'regoper' when 12 then 'uuid' when 13 then 'numeric' when 14 then 'date' when 15 then 'regclass'
    else concat('type_', cast(cast(floor(c_custkey / 5) as int) as {S})) end typname,
  cast(case when floor(c_custkey / 5) < 16 then 4 else c_custkey % 2 + 1 end as bigint) typnamespace,
  cast(case when floor(c_custkey / 5) >= 16 and cast(floor(c_custkey / 5) as int) % 4 = 1 then c_custkey else 0 end as bigint) typrelid
from customer"""),
    "cat_enum": ([], """
select cast(o_custkey % 5 as int) db_id,
  cast(case when floor(o_custkey / 5) >= 16 and cast(floor(o_custkey / 5) as int) % 4 = 2 then 10000 + floor(o_custkey / 5)
    else 0 - floor(o_custkey / 5) end as bigint) enumtypid,
  concat('v', cast(o_orderkey % 50 as {S})) enumlabel, o_orderkey enumsortorder
from orders"""),
    "cat_proc": ([], """
select cast(c_custkey % 5 as int) db_id, 50000 + c_custkey oid,
  concat('fn_', cast(cast(floor(c_custkey / 5) as int) % 40 as {S})) proname,
  cast(cast(floor(c_custkey / 5) as int) % 5 + 1 as bigint) pronamespace,
  concat('select ', cast(c_custkey % 30 as {S})) prosrc,
  case c_custkey % 3 when 0 then 'i' when 1 then 's' else 'v' end provolatile,
  cast(floor(c_custkey / 5) as int) % 4 pronargs,
  case when cast(floor(c_custkey / 5) as int) % 4 = 3 then cast(c_custkey % 3 as int) else 0 end pronargdefaults,
  case when cast(floor(c_custkey / 5) as int) % 8 = 3 then 'i b o' when cast(floor(c_custkey / 5) as int) % 8 = 1 then 'v' end proargmodes,
  case when cast(floor(c_custkey / 5) as int) % 4 = 2 then 'a b' end proargnames,
  case cast(floor(c_custkey / 5) as int) % 4 when 0 then '' when 1 then '23' when 2 then '25 23' else '20 25 16' end proargtypes,
  case c_custkey % 4 when 0 then cast(null as {S}) when 1 then 'search_path=public' when 2 then 'work_mem=1MB' else 'work_mem=1MB search_path=app' end proconfig,
  case c_custkey % 9 when 0 then 'p' when 1 then 'a' else 'f' end prokind,
  cast(12 + c_custkey % 4 as bigint) prolang, c_custkey % 6 = 0 prosecdef, c_custkey % 7 = 0 proretset,
  cast(case c_custkey % 3 when 0 then 23 when 1 then 25 else 10021 end as bigint) prorettype
from customer"""),
    "cat_language": ([], """
select cast(n_nationkey % 5 as int) db_id, 12 + cast(floor(n_nationkey / 5) as bigint) oid,
  case cast(floor(n_nationkey / 5) as int) when 0 then 'internal' when 1 then 'c' when 2 then 'sql' when 3 then 'plpgsql' else 'plv8' end lanname
from nation"""),
    "cat_policy": ([], """
select cast(o_custkey % 5 as int) db_id, o_custkey polrelid, concat('pol_', cast(o_orderkey as {S})) polname,
  case o_orderkey % 5 when 0 then 'r' when 1 then 'a' when 2 then 'w' when 3 then 'd' else '*' end polcmd,
  o_orderkey % 7 <> 0 polpermissive,
  case o_orderkey % 15 when 0 then '0' when 1 then '10' when 2 then '11' when 3 then '10 11'
    else cast(100 + (o_orderkey % 20) * 5 + o_custkey % 5 as {S}) end polroles,
  case o_orderkey % 8 when 0 then cast(null as {S}) when 1 then 'auth.uid() = user_id' when 2 then '(Select auth.uid()) = user_id'
    when 3 then 'true' when 4 then concat(' ( TRUE', chr(10), chr(9), ') ') when 5 then 'current_setting(request.jwt.claims) -> user_metadata'
    when 6 then 'auth.jwt() -> user_metadata is not null' else 'tenant = 1' end qual,
  case cast(floor(o_orderkey / 8) as bigint) % 4 when 0 then cast(null as {S}) when 1 then 'true' when 2 then 'auth.role() = x' else '1 = 1' end with_check
from orders"""),
    "cat_role": ([], """
select cast(n_nationkey % 5 as int) db_id, 10 + cast(floor(n_nationkey / 5) as bigint) oid,
  case cast(floor(n_nationkey / 5) as int) when 0 then 'anon' when 1 then 'authenticated'
    when 2 then case n_nationkey % 5 when 4 then 'reporting' else 'service_role' end when 3 then 'postgres' else 'app_owner' end rolname,
  floor(n_nationkey / 5) = 3 rolsuper, false rolbypassrls, floor(n_nationkey / 5) = 3 rolcreatedb, n_nationkey % 2 = 0 rolcanlogin, false rolcreaterole
from nation
union all
select cast(s_suppkey % 5 as int) db_id, 100 + s_suppkey oid,
  case s_suppkey % 10 when 3 then concat('pg_role_', cast(s_suppkey as {S})) when 4 then concat('supabase_', cast(s_suppkey as {S}), '_admin')
    else concat('role_', cast(s_suppkey as {S})) end rolname,
  s_suppkey % 13 = 0 rolsuper, s_suppkey % 10 = 7 rolbypassrls, s_suppkey % 3 = 0 rolcreatedb, s_suppkey % 2 = 0 rolcanlogin, s_suppkey % 11 = 0 rolcreaterole
from supplier"""),
    "cat_auth_member": ([], """
select cast(s_suppkey % 5 as int) db_id, 10 + s_suppkey % 3 roleid, 100 + s_suppkey member from supplier
union all
select cast(s_suppkey % 5 as int) db_id, 100 + cast(floor(s_suppkey / 10) as bigint) * 5 + s_suppkey % 5 roleid, 100 + s_suppkey member from supplier"""),
    "cat_trigger": ([], """
select cast(o_custkey % 5 as int) db_id, concat('trg_', cast(o_orderkey as {S})) tgname, o_custkey tgrelid,
  50000 + (o_orderkey % 30) * 5 + o_custkey % 5 tgfoid, cast(o_orderkey % 128 as int) tgtype,
  o_orderkey % 11 = 0 tgisinternal, cast(case when o_orderkey % 13 = 0 then 5 else 0 end as bigint) tgconstraint
from orders"""),
    "cat_stat_index": (["cat_index", "cat_class", "cat_namespace"], """
select i.db_id, i.indexrelid, i.indrelid relid, n.nspname schemaname, c.relname, i.indexname indexrelname,
  cast(case when i.indexrelid % 3 = 0 then 0 else i.indexrelid % 100 end as bigint) idx_scan
from cat_index i join cat_class c on c.db_id = i.db_id and c.oid = i.indrelid
join cat_namespace n on n.db_id = c.db_id and n.oid = c.relnamespace"""),
    "cat_stat_table": ([], """
select cast(p_partkey % 5 as int) db_id, p_partkey relid, cast(p_size % 4 as bigint) seq_scan,
  case when p_size % 3 = 0 then cast(null as bigint) else cast(p_partkey % 3 as bigint) end idx_scan,
  cast(floor(p_retailprice) as bigint) n_live_tup, cast(p_size as bigint) n_dead_tup from part"""),
    "cat_stats": (["cat_attribute", "cat_class", "cat_namespace"], """
select a.db_id, n.nspname schemaname, c.relname tablename, a.attname,
  cast(((a.attrelid + a.attnum) % 4) * 0.25 as double) null_frac, cast(4 + (a.attnum * 3) % 17 as int) avg_width
from cat_attribute a join cat_class c on c.db_id = a.db_id and c.oid = a.attrelid
join cat_namespace n on n.db_id = c.db_id and n.oid = c.relnamespace"""),
    "cat_available_extension": ([], """
select cast(n_nationkey % 5 as int) db_id,
  case cast(floor(n_nationkey / 5) as int) when 0 then 'plpgsql' when 1 then 'pgcrypto' when 2 then 'postgis' when 3 then 'pg_trgm' else 'pglinter' end name,
  '1.3' default_version,
  case when floor(n_nationkey / 5) < 4 then case n_nationkey % 3 when 0 then '1.3' else '1.1' end end installed_version,
  concat('extension ', n_name) comment
from nation"""),
    "cat_extension": ([], """
select cast(n_nationkey % 5 as int) db_id,
  case cast(floor(n_nationkey / 5) as int) when 0 then 'plpgsql' when 1 then 'pgcrypto' when 2 then 'postgis' when 3 then 'pg_trgm' else case when n_nationkey % 5 < 3 then 'pglinter' else 'hstore' end end extname,
  case n_nationkey % 3 when 0 then '1.3' else '1.1' end extversion,
  cast(case when n_nationkey % 2 = 0 then 1 else 2 end as bigint) extnamespace
from nation"""),
    "cat_available_extension_version": ([], """
select cast(n_nationkey % 5 as int) db_id,
  case cast(floor(n_nationkey / 5) as int) when 0 then 'plpgsql' when 1 then 'pgcrypto' when 2 then 'postgis' when 3 then 'pg_trgm' else 'pglinter' end name,
  '1.1' version, n_nationkey % 4 <> 0 installed
from nation"""),
    "cat_privilege": (["cat_column_slot"], """
select cast(l_partkey % 5 as int) db_id, l_partkey oid,
  case l_linenumber when 1 then case when l_partkey % 3 = 0 then 'anon' else 'app_owner' end when 2 then 'authenticated' when 3 then 'anon' else 'app_owner' end rolname,
  case l_linenumber when 3 then 'INSERT' when 2 then case when l_partkey % 2 = 0 then 'SELECT' else 'UPDATE' end else 'SELECT' end privilege
from cat_column_slot"""),
    "cat_setting": ([], """
select cast(n_nationkey % 5 as int) db_id,
  case cast(floor(n_nationkey / 5) as int) when 0 then 'pgrst.db_schemas' when 1 then 'block_size' when 2 then 'server_version_num'
    when 3 then 'password_encryption' else 'max_connections' end name,
  case cast(floor(n_nationkey / 5) as int) when 0 then case n_nationkey % 5 when 1 then 'public, pgmq_public' when 3 then 'app' else ' public , app,audit' end
    when 1 then '8192'
    when 2 then case n_nationkey % 5 when 0 then '140005' when 1 then '150002' when 2 then '160001' when 3 then '90600' else '100010' end
    when 3 then case n_nationkey % 2 when 0 then 'md5' else 'scram-sha-256' end
    else '100' end value
from nation"""),
    "cat_activity": ([], "select cast(user_id % 5 as int) db_id, event_id pid from events"),
    "cat_hba": ([], """
select cast(c_custkey % 5 as int) db_id, cast(floor(c_custkey / 5) as bigint) + 1 line_number,
  case when c_mktsegment = 'HOUSEHOLD' then 'trust' when c_mktsegment = 'MACHINERY' then 'password' when c_custkey % 3 = 0 then 'md5' else 'scram-sha-256' end auth_method
from customer"""),
    "cat_default_acl": ([], """
select cast(n_nationkey % 5 as int) db_id,
  case when n_nationkey % 3 = 0 then cast(floor(n_nationkey / 5) as bigint) + 1 else cast(0 as bigint) end defaclnamespace from nation"""),
    "cat_ns_acl": ([], """
select cast(s_suppkey % 5 as int) db_id, cast(floor(s_suppkey / 5) as bigint) % 5 + 1 nspoid,
  case cast(floor(s_suppkey / 25) as int) % 5 when 0 then '-' when 1 then '' else concat('role_', cast(s_suppkey as {S})) end grantee,
  case s_suppkey % 3 when 0 then 'USAGE' else 'CREATE' end privilege_type
from supplier"""),
    "cat_description": ([], """
select cast(p_partkey % 5 as int) db_id, p_partkey objoid, p_size % 3 objsubid, concat('about ', p_name) description from part"""),
}


def needed(names: list[str], relations: dict[str, tuple[list[str], str]] | None = None) -> list[str]:
    """The named relations and all they read, in definition order."""
    relations = relations or RELATIONS
    wanted: set[str] = set()

    def visit(name: str) -> None:
        if name not in wanted:
            wanted.add(name)
            for dep in relations[name][0]:
                visit(dep)

    for name in names:
        visit(name)
    return [n for n in relations if n in wanted]


def cte(names: list[str], string: str = "varchar", relations: dict[str, tuple[list[str], str]] | None = None) -> str:
    relations = relations or RELATIONS
    parts = [f"{n} as ({relations[n][1].replace('{S}', string).strip()})" for n in needed(names, relations)]
    return ",\n".join(parts)


_SOURCES: dict[tuple[str, str, str], DataFrame] = {}


def source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table's scan; kept per application, so that its footer is read once."""
    key = (spark.sparkContext.applicationId, sf_dir, table)
    if key not in _SOURCES:
        _SOURCES[key] = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return _SOURCES[key]


def register(spark: SparkSession, sf_dir: str, tables: list[str] | None = None) -> None:
    for table in tables or TABLES:
        source(spark, sf_dir, table).createOrReplaceTempView(table)


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived relation as a DataFrame."""
    text = cte([name], "string")
    used = [t for t in TABLES if t in text]
    register(spark, sf_dir, used)
    return spark.sql(f"with {text} select * from {name}")
