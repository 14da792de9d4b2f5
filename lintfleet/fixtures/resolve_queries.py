"""Registered queries for name resolution and ranking (R) and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintfleet.fixtures import script_queries as SQ
from lintfleet.fixtures.catalog_queries import SQL as CAT
from lintfleet.fixtures.catalog_queries import catalog
from lintfleet.fixtures.corpus import SCRIPT_SQL
from lintfleet.fixtures.relations import relation, source
from lintfleet.plans import catalog_dims as K
from lintfleet.plans import facts as FX
from lintfleet.plans import resolve as R
from lintfleet.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def derived(spark: SparkSession, sf: str, table: str, text: str) -> DataFrame:
    source(configure(spark), sf, table).createOrReplaceTempView(table)
    return spark.sql(text.replace("{S}", "string"))


DIMS = f"""
tables as ({CAT["K02_tables"]}), columns_ as ({CAT["K03_columns"]}), functions as ({CAT["K04_functions"]}), types as ({CAT["K05_types"]}),
policies as ({CAT["K06_policies"]}), schemas as ({CAT["K01_schemas"]}), roles as ({CAT["K08_roles"]}),
objects as (
  select db_id, 'table' kind, "schema" sch, name tab, name as nm, false pk from tables
  union all select db_id, 'column', schema_name, table_name, name, is_primary_key from columns_
  union all select db_id, 'type', "schema", null, name, false from types
  union all select db_id, 'function', "schema", null, name, false from functions
  union all select db_id, 'schema', name, null, name, false from schemas
  union all select db_id, 'role', null, null, name, false from roles
  union all select db_id, 'policy', schema_name, table_name, name, false from policies)"""

LOOKUPS = """
select c_custkey lookup_id, cast(c_custkey % 5 as int) db_id,
  case c_custkey % 6 when 0 then 'table' when 1 then 'column' when 2 then 'type' when 3 then 'function' when 4 then 'schema' else 'role' end kind,
  case c_custkey % 6 when 0 then concat('"rel_', cast(c_custkey as {S}), '"') when 1 then case when c_custkey % 4 = 1 then 'password' else 'id' end
    when 2 then case when c_custkey % 4 = 0 then 'int4' else concat('type_', cast(c_custkey % 100 as {S})) end when 3 then concat('fn_', cast(c_custkey % 40 as {S}))
    when 4 then case c_custkey % 3 when 0 then 'app' else 'public' end else case c_custkey % 4 when 1 then 'anon' else concat('role_', cast(c_custkey % 100 as {S})) end end name,
  case when c_custkey % 6 in (0, 3) and c_custkey % 5 = 0 then 'public' when c_custkey % 6 = 1 and c_custkey % 7 = 0 then '"app"' end as q_schema,
  case when c_custkey % 6 = 1 then case when c_custkey % 8 = 1 then 'u' else concat('rel_', cast(c_custkey as {S})) end end as q_table
from customer"""
ALIASES = "select c_custkey lookup_id, 'u' alias, concat('rel_', cast(c_custkey - 1 as {S})) target from customer"


def lookups(spark: SparkSession, sf: str) -> DataFrame:
    rows = derived(spark, sf, "customer", LOOKUPS)
    return rows.withColumnsRenamed({"q_schema": "schema", "q_table": "table_name"})


QUERIES["R01_lookup"] = lambda spark, sf: R.find(lookups(spark, sf), R.objects(catalog(spark, sf)), derived(spark, sf, "customer", ALIASES))
SQL["R01_lookup"] = f"""
with {DIMS}, lk as ({LOOKUPS.replace("{S}", "varchar")}), al as ({ALIASES.replace("{S}", "varchar")}),
asked as (select l.lookup_id, db_id, kind, replace(name, '"', '') nm, replace(q_schema, '"', '') qs, coalesce(a.target, l.q_table) qt
  from lk l left join al a on a.lookup_id = l.lookup_id and a.alias = l.q_table)
select a.lookup_id, a.db_id, a.kind, o.sch as "schema", o.tab table_name, o.nm as name from asked a join objects o on o.db_id = a.db_id and o.kind = a.kind and o.nm = a.nm
where (a.qs is null or a.qs = o.sch) and (a.qt is null or a.qt = o.tab)"""

CALLS = """
select o_orderkey call_id, cast(o_custkey % 5 as int) db_id, case when o_orderkey % 4 = 0 then 'public' when o_orderkey % 9 = 0 then 'app' end q_schema,
  concat('fn_', cast(o_orderkey % 40 as {S})) name, cast(o_orderkey % 4 as int) n_args,
  case o_orderkey % 5 when 0 then 'int' when 1 then 'string' when 2 then 'null' when 3 then 'bool' else 'float' end l1, concat('v', cast(o_orderkey % 50 as {S})) v1,
  case cast(floor(o_orderkey / 5) as bigint) % 4 when 0 then 'int' when 1 then 'string' when 2 then 'null' else 'int' end l2,
  case cast(floor(o_orderkey / 20) as bigint) % 3 when 0 then 'bool' when 1 then 'null' else 'int' end l3 from orders"""


def calls(spark: SparkSession, sf: str) -> DataFrame:
    rows = derived(spark, sf, "orders", CALLS)
    arg = lambda i: F.struct(F.col(f"l{i}").alias("literal"), F.col("v1").alias("value"))
    return rows.select("call_id", "db_id", F.col("q_schema").alias("schema"), "name",
                       F.slice(F.array(arg(1), arg(2), arg(3)), 1, F.col("n_args")).alias("args"))


QUERIES["R02_overload_resolution"] = lambda spark, sf: R.resolve_calls(calls(spark, sf), catalog(spark, sf))


def _fits(i: int) -> str:
    return f"""(c.n_args < {i} or c.l{i} = 'null' or exists (select 1 from types t where t.db_id = f.db_id and cast(t.id as varchar) = string_split(f.targs, ' ')[{i}] and (
      (t."schema" = 'pg_catalog' and ((c.l{i} = 'int' and t.name in ('int2', 'int4', 'int8')) or (c.l{i} = 'float' and t.name in ('float4', 'float8')) or (c.l{i} = 'bool' and t.name = 'bool') or (c.l{i} = 'string' and t.name in ('text', 'varchar'))))
      or (c.l{i} = 'string' and list_contains(string_split(t.enums, ','), c.v1)))))"""


SQL["R02_overload_resolution"] = f"""
with {DIMS}, calls as ({CALLS.replace("{S}", "varchar")}),
fns as (select f.db_id, f.id, f."schema" sch, f.name, len(string_split(f.args, ',')) * (f.args <> '')::int n, regexp_replace(f.args, '(^|,)[^:]*:[^:]*:([^:]*):[^,]*', ' \\2', 'g') ta from functions f),
f as (select *, trim(ta) targs from fns),
m as (select c.call_id, c.db_id, f.id from calls c join f on f.db_id = c.db_id and f.name = c.name
  where (c.q_schema is null or c.q_schema = f.sch) and f.n >= c.n_args and {_fits(1)} and {_fits(2)} and {_fits(3)})
select c.call_id, c.db_id, x.id function_id from calls c left join (select call_id, db_id, max(id) id from m group by 1, 2 having count(*) = 1) x on x.call_id = c.call_id and x.db_id = c.db_id"""

LITERALS = """
select o_orderkey literal_id, cast(o_custkey % 5 as int) db_id, case o_orderkey % 5 when 0 then 'int' when 1 then 'string' when 2 then 'null' when 3 then 'bool' else 'float' end literal,
  concat('v', cast(o_orderkey % 60 as {S})) value from orders"""
QUERIES["R03_literal_types"] = lambda spark, sf: R.literal_types(derived(spark, sf, "orders", LITERALS), catalog(spark, sf))
SQL["R03_literal_types"] = f"""
with types as ({CAT["K05_types"]}), lit as ({LITERALS.replace("{S}", "varchar")})
select l.literal_id, l.db_id, t.id type_id from lit l join types t on t.db_id = l.db_id where
  (t."schema" = 'pg_catalog' and ((l.literal = 'int' and t.name in ('int2', 'int4', 'int8')) or (l.literal = 'float' and t.name in ('float4', 'float8'))
    or (l.literal = 'bool' and t.name = 'bool') or (l.literal = 'string' and t.name in ('text', 'varchar'))))
  or (l.literal = 'string' and list_contains(string_split(t.enums, ','), l.value))"""

# contexts: a few queries per customer segment and database
CONTEXTS = """
select distinct db_id, query, qualifier, clause, is_invocation, has_mentions, m_schema, m_name, m_column, concat_ws('/', cast(db_id as {S}), query, coalesce(qualifier, '-'), coalesce(clause, '-'), cast(is_invocation as {S}), m_name) context_id from (
  select cast(c_custkey % 5 as int) db_id,
    case c_nationkey % 8 when 0 then 'rel_1' when 1 then 'Pas' when 2 then 'fn_2' when 3 then 'u' when 4 then 'col7' when 5 then '"rol' when 6 then 'pub' else 'tk' end query,
    case when c_nationkey % 12 = 4 then 'public' when c_nationkey % 12 = 9 then 'users' end qualifier,
    case c_mktsegment when 'HOUSEHOLD' then 'select' when 'MACHINERY' then 'where' when 'BUILDING' then 'from' when 'FURNITURE' then 'join_on' end clause,
    c_nationkey % 8 = 2 and c_nationkey > 12 is_invocation, c_nationkey % 2 = 0 has_mentions,
    case when c_nationkey % 3 = 0 then 'auth' else '' end m_schema, case when c_nationkey % 2 = 0 then 'users' else 'rel_10' end m_name,
    case when c_nationkey % 5 = 0 then 'password' else 'col_7' end m_column from customer) x"""


def contexts(spark: SparkSession, sf: str) -> DataFrame:
    rows = derived(spark, sf, "customer", CONTEXTS)
    mention = F.array(F.struct(F.col("m_schema").alias("schema"), F.col("m_name").alias("name")))
    return rows.withColumn("mentions", mention).withColumn("mentioned_columns", F.array("m_column")).drop("m_schema", "m_name", "m_column")


_OWN = """(case when kind = 'role' then case when nm in ('pg_read_all_data', 'pg_monitor', 'postgres') then -20 else 0 end else
    case when sch in ('pg_catalog', 'information_schema', 'pg_toast') then -20 else 0 end
    + case when sch = 'public' then case when kind = 'schema' then -2 else 2 end else 0 end end
  + case when is_invocation then case when kind = 'function' then 30 else -10 end else case when kind = 'function' then -10 else 0 end end
  + case when qualifier is not null and kind in ('table', 'function') then case when qualifier = sch then 25 else -10 end else 0 end)"""
_CLAUSE = """(case when clause is null then 0
    when kind = 'function' and clause = 'select' then case when has_mentions then 0 else 15 end
    when kind = 'column' and clause = 'select' then case when has_mentions then 10 else 0 end
    when kind = 'column' and clause = 'join_on' then case when pk then 20 else 10 end
    when kind = 'schema' and clause = 'from' and qualifier is null then 15
    when kind = 'table' and clause = 'from' then 5 when kind = 'function' and clause = 'from' then 0 when kind = 'column' and clause = 'where' then 10
    when kind in ('table', 'function', 'schema', 'policy', 'role') then -50 when kind = 'column' then -15 else 0 end)"""
_STMT = """(case when kind in ('column', 'policy') then case when m_schema = sch and m_name = tab then 45 when m_schema = '' and m_name = tab then 30 else 0 end else 0 end
  + case when kind = 'column' and m_column = nm then -10 else 0 end)"""
_TEXT = "(case when qualifier is null then lower(nm) when qualifier = sch then lower(concat_ws('.', tab, nm)) when qualifier = tab then lower(nm) end)"
_Q = "lower(replace(query, '\"', ''))"
_SHARE = "(length(q) * 16 - least(length(txt) - length(q), 15) + case when starts_with(txt, q) then 20 else 0 end)"
SCORED = f"""
, ctx as ({CONTEXTS.replace("{S}", "varchar")})
, cand as (select *, {_TEXT} txt, {_Q} q, regexp_replace({_Q}, '(.)', '\\1.*', 'g') pat from ctx c join objects o using (db_id))
, sc as (select *, cast(floor({_SHARE} / case when txt = lower(nm) then 2.0 else 3.0 end) as int) match_score from cand where txt is not null and regexp_matches(txt, pat))"""


def ranked_sql(body: str) -> str:
    return f"with {DIMS}{SCORED}\n{body}"


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.candidates(contexts(spark, sf), R.objects(catalog(spark, sf)))
    return rows.withColumns({"own": R.own_score(), "by_clause": R.clause_score(), "by_statement": R.statement_score()})


def _term(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: (
        _terms(spark, sf).groupBy("context_id", "kind").agg(F.count("*").alias("n"), F.sum(name).cast("bigint").alias("total"), F.max(name).cast("int").alias("best"))
    )


for _id, _col, _expr in [("R04a_own_terms", "own", _OWN), ("R04b_clause_terms", "by_clause", _CLAUSE), ("R04c_statement_terms", "by_statement", _STMT), ("R04d_text_match", "match_score", "match_score")]:
    QUERIES[_id] = _term(_col)
    SQL[_id] = ranked_sql(f"select context_id, kind, count(*) n, cast(sum({_expr}) as bigint) total, cast(max({_expr}) as int) best from sc group by 1, 2")

QUERIES["R04_candidate_ranking"] = lambda spark, sf: R.rank(R.scored(contexts(spark, sf), R.objects(catalog(spark, sf)))).drop("kind", "schema")
SQL["R04_candidate_ranking"] = ranked_sql(
    f""", s as (select distinct context_id, cast({_OWN} + {_CLAUSE} + {_STMT} + match_score as int) score, nm label from sc)
, d as (select *, lag(label) over (partition by context_id order by score desc, label) above from s)
, k as (select *, row_number() over (partition by context_id order by score desc, label) rn from d where above is null or above <> label)
, t as (select *, count(*) over (partition by context_id) n, max(case when rn = 2 then score end) over (partition by context_id) runner_up from k where rn <= 50)
select context_id, cast(rn as int) rank, label, score, rn = 1 and (runner_up is null or score - runner_up > 15) and n >= 10 preselected,
  lpad(cast(rn - 1 as varchar), cast(length(cast(n as varchar)) as int), '0') sort_text from t"""
)


def _hover_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Column candidates of each distinct hover context with their relevance."""
    ctx = derived(spark, sf, "customer", HOVER).withColumn("mentions", F.array(F.struct(F.col("m_schema").alias("schema"), F.col("m_name").alias("name"))))
    cols = R.objects(catalog(spark, sf)).filter(F.col("kind").isin("column", "table"))
    joined = ctx.join(cols, ["db_id", "kind", "name"])
    score = F.when(F.col("kind") == "table", R.table_relevance()).otherwise(R.column_relevance())
    return joined.withColumn("score", score.cast("int"))


HOVER = """
select distinct *, concat_ws('/', cast(db_id as {S}), kind, name, coalesce(q_schema, '-'), coalesce(q_table, '-'), m_schema, m_name) context_id from (
  select cast(c_custkey % 5 as int) db_id, case when c_nationkey % 3 = 0 then 'table' else 'column' end kind,
    case when c_nationkey % 3 = 0 then case when c_nationkey % 2 = 0 then 'users' else concat('rel_', cast(c_custkey as {S})) end when c_nationkey % 4 = 0 then 'password' else 'id' end name,
    case when c_nationkey % 5 = 0 then 'public' end q_schema, case when c_nationkey % 2 = 1 then concat('rel_', cast(c_custkey % 50 as {S})) end q_table,
    case when c_nationkey % 7 = 0 then 'public' else '' end m_schema, case when c_nationkey % 2 = 0 then 'users' else concat('rel_', cast(c_custkey % 40 as {S})) end m_name from customer) x"""
_HOVER_SQL = f"""
with {DIMS}, hv as ({HOVER.replace("{S}", "varchar")}), hs as (select h.*, o.sch, o.tab, o.nm, o.pk,
  case when h.kind = 'table' then case when m_schema = sch and m_name = nm then 200 when m_schema = '' and m_name = nm then 150 when m_schema = sch then 50 when sch = 'public' then 10 else 0 end
  else case when (case when q_table = tab and (q_schema is null or q_schema = sch) then case when q_schema is not null then 300 else 250 end else 0 end
      + case when m_schema = sch and m_name = tab then 150 when m_schema = '' and m_name = tab then 100 else 0 end) > 0
    then (case when q_table = tab and (q_schema is null or q_schema = sch) then case when q_schema is not null then 300 else 250 end else 0 end
      + case when m_schema = sch and m_name = tab then 150 when m_schema = '' and m_name = tab then 100 else 0 end)
    when sch = 'public' then 10 when pk then 5 else 0 end end score
  from hv h join objects o on o.db_id = h.db_id and o.kind = h.kind and o.nm = h.name)"""
QUERIES["R05a_relevance"] = lambda spark, sf: (
    _hover_columns(spark, sf).groupBy("context_id", "score").agg(F.count("*").alias("n"))
)
SQL["R05a_relevance"] = f"{_HOVER_SQL} select context_id, score, count(*) n from hs group by 1, 2"
QUERIES["R05_relevance_cut"] = lambda spark, sf: (
    R.cut_by_relevance(_hover_columns(spark, sf).select("context_id", "schema", "table_name", "name", "score"), ["context_id"], "score")
)
SQL["R05_relevance_cut"] = f"""{_HOVER_SQL}, o as (select *, lag(score) over (partition by context_id order by score desc) prev from hs),
c as (select *, max(case when prev is not null and prev - score > prev * 0.3 then 1 else 0 end) over (partition by context_id order by score desc range between unbounded preceding and current row) cut from o)
select context_id, sch as "schema", tab table_name, name, score from c where cut = 0"""

QUERIES["R06_basic_default"] = lambda spark, sf: (
    relation(configure(spark), sf, "cat_attrdef").select("db_id", "adrelid", "adnum", R.basic_default(F.col("adsrc")).alias("literal"))
)
_ATTRDEF = CAT["K03_columns"].split("with ", 1)[1].split("cat_attrdef as (", 1)[1]


def _balanced(text: str) -> str:
    depth, out = 1, []
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if depth == 0:
            break
        out.append(ch)
    return "".join(out)


SQL["R06_basic_default"] = f"""
with cat_column_slot as (select distinct l_partkey, l_linenumber from lineitem), cat_attrdef as ({_balanced(_ATTRDEF)})
select db_id, adrelid, adnum, case l_val when '' then null else l_val end literal from (
  select *, case when regexp_matches(v, '^[A-Za-z0-9 _.\\-]+$') then v else '' end l_val from (
    select *, trim(regexp_replace(regexp_replace(trim(split_part(adsrc, '::', 1)), '^\\((.*)\\)$', '\\1'), '^''(.*)''$', '\\1')) v from cat_attrdef) a) b"""


def _unresolved(spark: SparkSession, sf: str) -> DataFrame:
    rows = SQ.statement_rows(spark, sf)
    named = FX.mentions(rows.withColumnRenamed("pos", "stmt_no")).filter(F.col("clause") == "relation")
    named = named.withColumn("db_id", (F.col("script_id") % 5).cast("int")).select("db_id", "script_id", F.col("stmt_no").alias("pos"), "schema", "name")
    return R.unresolved(named, catalog(spark, sf), ["app*", "auth"])


QUERIES["R07_unresolved_references"] = _unresolved
SQL["R07_unresolved_references"] = f"""
with {SCRIPT_SQL}, tables as ({CAT["K02_tables"]}), schemas as ({CAT["K01_schemas"]}),
men as ({SQ.SQL["F05_mentions"].split("con as (", 1)[1].split("\n", 1)[1]})
select cast(script_id % 5 as int) db_id, script_id, pos, "schema", name from men m where clause = 'relation' and not exists (
  select 1 from tables t where t.db_id = m.script_id % 5 and t.name = m.name and (t."schema" = m."schema" or (m."schema" = '' and exists (
    select 1 from schemas s where s.db_id = t.db_id and s.name = t."schema" and (s.name like 'app%' or s.name in ('auth', 'public'))))))"""

QUERIES["R08_type_default"] = lambda spark, sf: (
    K.types(catalog(spark, sf)).select("db_id", "id", "name", R.type_default(F.col("name"), F.col("enums"), F.col("id") % 3 == 0).alias("literal"))
)
SQL["R08_type_default"] = f"""
with types as ({CAT["K05_types"]}), d as (select db_id, id, name, case when enums <> '' then concat('''', string_split(enums, ',')[1], '''')
  when name in ('int2', 'int4', 'int8', 'float4', 'float8', 'numeric') then '0' when name = 'bool' then 'false' when name in ('text', 'varchar') then ''''''
  when name = 'date' then '''1970-01-01''' when name = 'timestamp' then '''1970-01-01 00:00:00''' when name = 'json' then '''null'''
  when name = 'uuid' then '''00000000-0000-0000-0000-000000000000''' else 'NULL' end v from types)
select db_id, id, name, case when id % 3 = 0 then concat('''{{', v, '}}''') else v end literal from d"""
