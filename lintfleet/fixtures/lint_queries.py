"""Registered queries for transaction state and lint rules (W, L, U) and the SQL that checks them.

The Spark side extracts facts from statement text; the SQL side starts from the facts written in the templates.
"""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintfleet import constants as C
from lintfleet.fixtures import corpus
from lintfleet.fixtures.catalog_queries import catalog
from lintfleet.fixtures.relations import cte
from lintfleet.fixtures.script_queries import statement_rows
from lintfleet.operators.scan import Chunks, chunk_width
from lintfleet.plans import audit_rules as D
from lintfleet.plans import facts as FX
from lintfleet.plans import lint_rules as L
from lintfleet.plans import scorecard as P
from lintfleet.plans import txstate as W
from lintfleet.plans.lint_messages import MESSAGES
from lintfleet.registry import rules_frame
from lintfleet.session import configure, materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def facts(spark: SparkSession, sf: str, arrays: Collection[str]) -> tuple[DataFrame, Chunks | None]:
    """Facts of all statements, and how their scripts must be scanned."""
    rows = statement_rows(spark, sf)
    return FX.extract(rows, arrays=arrays), chunk_width(rows, ["script_id"])


# ------------------------------------------------------------------ SQL state

_W = "over (partition by script_id order by pos rows between unbounded preceding and 1 preceding)"


def _flag(setting: str) -> str:
    return f"""coalesce(last_value(case when tx_kind in ('commit', 'rollback') or set_kind = 'reset_all' then false
    when set_name = '{setting}' then set_kind in ('value', 'current') end ignore nulls) {_W}, false)"""


STATE = f"""
, seg as (select *, case when rel_schema = '' then 'public' else rel_schema end sch,
  cast(coalesce(sum(case when tx_kind in ('commit', 'rollback') then 1 else 0 end) {_W}, 0) as bigint) segment,
  {_flag("lock_timeout")} lock_timeout_set, {_flag("statement_timeout")} statement_timeout_set,
  {_flag("idle_in_transaction_session_timeout")} idle_in_transaction_timeout_set,
  first_value(case when tx_kind in ('begin', 'start', 'commit', 'rollback') then tx_kind end ignore nulls) {_W} first_transaction,
  count(*) over (partition by script_id) n_statements from stmt)
, made as (select script_id, segment, pos, lower(sch) sch, lower(case when kind = 'create_index' then idx_name else rel_name end) obj
  from seg where kind in ('create_table', 'ctas') or (kind = 'create_index' and idx_name <> ''))
, cre as (select s.*, exists (select 1 from made m where m.script_id = s.script_id and m.segment = s.segment and m.pos < s.pos
    and m.sch = lower(s.sch) and m.obj = lower(s.rel_name)) created_before from seg s)
, loc as (select c.*, c.kind = 'alter_table' and not c.created_before
    and exists (select 1 from cmd x where x.script_id = c.script_id and x.pos = c.pos and x.subtype <> 'validate_constraint') takes_access_exclusive from cre c)
, hold as (select l.*,
  coalesce(max(case when takes_access_exclusive then 1 else 0 end) over (partition by script_id, segment order by pos rows between unbounded preceding and 1 preceding), 0) = 1 holding_access_exclusive,
  cast(coalesce(sum(case when takes_access_exclusive then 1 else 0 end) over (partition by script_id, segment order by pos rows between unbounded preceding and 1 preceding), 0) as bigint) locks_before,
  coalesce(max(case when takes_access_exclusive then 1 else 0 end) over (partition by script_id, segment, sch, rel_name order by pos rows between unbounded preceding and 1 preceding), 0) = 1 table_locked_before
  from loc l)
, danger as (select *, ((kind = 'alter_table' and not created_before) or (kind = 'create_index' and not concurrent and not created_before)
  or (kind = 'drop' and object_type in ('table', 'index', 'materialized view')) or kind = 'truncate' or vacuum_full
  or (kind = 'reindex' and not concurrent) or kind = 'rename' or (kind = 'refresh' and not concurrent)) is_dangerous_lock from hold)"""


def sql(body: str) -> str:
    return f"with {corpus.SCRIPT_SQL}{STATE}\n{body}"


def state(needs: list[str], *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df, chunk = facts(spark, sf, ["commands"] if {"locks", "locked_tables"} & {*needs} else [])
        return W.with_state(df, needs, chunk).select("script_id", "pos", *columns)

    return run


for _id, _needs, _columns in [
    ("W00_segment", ["segment"], ["segment"]),
    ("W01_lock_timeout_set", ["segment"], ["lock_timeout_set"]),
    ("W02_statement_timeout_set", ["segment"], ["statement_timeout_set"]),
    ("W03_idle_in_transaction_timeout_set", ["segment"], ["idle_in_transaction_timeout_set"]),
    ("W05_takes_access_exclusive", ["locks"], ["takes_access_exclusive"]),
    ("W06_holding_access_exclusive", ["locks"], ["holding_access_exclusive"]),
]:
    QUERIES[_id] = state(_needs, *_columns)
    SQL[_id] = sql(f"select script_id, pos, {', '.join(_columns)} from danger")


def _created(spark: SparkSession, sf: str) -> DataFrame:
    return state(["created"], "kind", "created_before")(spark, sf).filter(F.col("kind").isin("alter_table", "create_index")).drop("kind")


QUERIES["W04_created_before"] = _created
SQL["W04_created_before"] = sql("select script_id, pos, created_before from danger where kind in ('alter_table', 'create_index')")


def _locked(spark: SparkSession, sf: str) -> DataFrame:
    rows = state(["locked_tables"], "takes_access_exclusive", "table_locked_before", "locks_before")(spark, sf)
    return rows.filter("takes_access_exclusive").drop("takes_access_exclusive")


QUERIES["W07_locked_tables"] = _locked
SQL["W07_locked_tables"] = sql("select script_id, pos, table_locked_before, locks_before from danger where takes_access_exclusive")


def _not_valid(spark: SparkSession, sf: str) -> DataFrame:
    df, chunk = facts(spark, sf, ["constraints"])
    return W.not_valid_events(W.with_segment(df, chunk))


QUERIES["W08_not_valid_constraints"] = _not_valid
SQL["W08_not_valid_constraints"] = sql(
    """select s.script_id, s.segment, s.pos, lower(s.sch) as "schema", lower(s.rel_name) rel, lower(k.name) as name
from seg s join con k on k.script_id = s.script_id and k.pos = s.pos where k.context = 'add_constraint' and k.skip_validation and k.name <> ''"""
)


def _dangerous(spark: SparkSession, sf: str) -> DataFrame:
    df, chunk = facts(spark, sf, [])
    return W.with_state(df, ["created"], chunk).select("script_id", "pos", W.is_dangerous_lock().alias("is_dangerous_lock"))


QUERIES["W09_is_dangerous_lock"] = _dangerous
SQL["W09_is_dangerous_lock"] = sql("select script_id, pos, is_dangerous_lock from danger")


def _depth(spark: SparkSession, sf: str) -> DataFrame:
    df, chunk = facts(spark, sf, [])
    return W.with_depth(df, chunk).select("script_id", "pos", "depth")


QUERIES["W10_transaction_depth"] = _depth
SQL["W10_transaction_depth"] = sql(
    f"""select script_id, pos, cast(s - least(0, min(s) over (partition by script_id order by pos)) as int) depth from (
  select script_id, pos, coalesce(sum(case when tx_kind in ('begin', 'start', 'savepoint') then 1 when tx_kind in ('commit', 'rollback', 'release', 'rollback_to') then -1 else 0 end) {_W}, 0) s from stmt) x"""
)

# ------------------------------------------------------------------ SQL rules


def text(key: str, *args: str) -> str:
    pieces = []
    for i, part in enumerate(MESSAGES[key].split("%s")):
        if part:
            pieces.append("'" + part.replace("'", "''") + "'")
        if i < len(args):
            pieces.append(args[i])
    return f"concat({', '.join(pieces)})"


def on(where: str, message: str) -> str:
    return f"select script_id, pos, 0 ord, {message} message from danger where {where}"


def commands(where: str, key: str) -> str:
    return f"select script_id, pos, ord, {text(key)} message from cmd where {where}"


def columns(types: list[str], contexts: str, key: str) -> str:
    names = ", ".join(f"'{t}'" for t in types)
    return f"""select script_id, pos, ord, {text(key)} message from col
  where context in ({contexts}) and list_has_any(string_split(type_names, '.'), [{names}])"""


def constraints(where: str, key: str) -> str:
    return f"select script_id, pos, ord, {text(key)} message from con where {where}"


ALL, NEW = "'create', 'add', 'alter_type'", "'create', 'add'"
FULL = "concat(sch, '.', rel_name)"
_LATER = "exists (select 1 from stmt c where c.script_id = {t}.script_id and c.kind = 'create_table' and c.rel_name = {t}.rel_name{and_})"
_SAFE = """(d.default_kind = 'constant' or exists (select 1 from cat_proc p where p.db_id = s.db_id and p.proname = d.default_function and p.pronargs = 0 and p.provolatile <> 'v'))"""
_MAJOR = "(select cast(v.value as bigint) // 10000 from cat_setting v where v.db_id = s.db_id and v.name = 'server_version_num')"

RULE_SQL: dict[str, str] = {
    "L01": f"""select c.script_id, c.pos, c.ord, case when c.type_names in ({", ".join(f"'{t}'" for t in L.SERIAL_COLUMN_TYPES)}) then {text("addSerialColumn", "c.type_names")} else {text("addSerialColumn.generated")} end message
      from col c where c.context = 'add' and (c.type_names in ({", ".join(f"'{t}'" for t in L.SERIAL_COLUMN_TYPES)})
        or exists (select 1 from con g where g.script_id = c.script_id and g.pos = c.pos and g.ord = c.ord and g.contype = 'generated' and g.generated_when = 'a'))""",
    "L02": f"""select * from (select s.script_id, s.pos, d.ord, case when d.contype = 'generated' then {text("addingFieldWithDefault.generated")}
        when {_MAJOR} >= 11 then case when not {_SAFE} then {text("addingFieldWithDefault.volatile")} end else {text("addingFieldWithDefault")} end message
      from stmt s join con d on d.script_id = s.script_id and d.pos = s.pos where d.context = 'add_column' and d.contype in ('generated', 'default')) x where message is not null""",
    "L03": f"""select script_id, pos, ord, case when context = 'add_column' then {text("addingForeignKeyConstraint.inline")} else {text("addingForeignKeyConstraint")} end message
      from con where contype = 'foreign' and not skip_validation and context in ('add_constraint', 'add_column')""",
    "L04": f"""select s.script_id, s.pos, c.ord, {text("addingNotNullField")} message from stmt s join cmd c on c.script_id = s.script_id and c.pos = s.pos
      where c.subtype = 'set_not_null' and coalesce({_MAJOR}, 0) < 11""",
    "L05": constraints("contype = 'primary' and index_name = '' and context in ('add_constraint', 'add_column')", "addingPrimaryKeyConstraint"),
    "L06": f"""select c.script_id, c.pos, c.ord, {text("addingRequiredField")} message from cmd c join stmt s on s.script_id = c.script_id and s.pos = c.pos
      where c.subtype = 'add_column' and lower(s.body) like '%not null%' and lower(s.body) not like '%default%'""",
    "L07": constraints("contype = 'exclusion' and context in ('add_constraint', 'create')", "avoidAddingExclusionConstraint"),
    "L08": on("adds_value", text("avoidAlterEnumAddValue")),
    "L09": commands("subtype = 'attach_partition'", "avoidAttachingPartition"),
    "L10": on("kind = 'create_trigger'", text("avoidCreateTrigger")),
    "L11": commands("subtype like '%able_trigger%'", "avoidEnableDisableTrigger"),
    "L12": on("takes_access_exclusive and locks_before > 0 and not table_locked_before", text("avoidWideLockWindow", FULL)),
    "L13": columns(L.CHAR_TYPES, NEW, "banCharField"),
    "L14": on("kind = 'create_index' and concurrent and n_statements > 1", text("banConcurrentIndexCreationInTransaction")),
    "L15": on("kind = 'delete' and not has_where", text("banDeleteWithoutWhere")),
    "L16": commands("subtype = 'drop_column'", "banDropColumn"),
    "L17": on("kind = 'drop_database'", text("banDropDatabase")),
    "L18": commands("subtype = 'drop_not_null'", "banDropNotNull"),
    "L19": on("kind = 'drop' and object_type = 'schema'", text("banDropSchema")),
    "L20": on("kind = 'drop' and object_type = 'table'", text("banDropTable")),
    "L21": on("kind = 'drop' and object_type = 'trigger'", text("banDropTrigger")),
    "L22": on("kind = 'truncate'", text("banTruncate")),
    "L23": on("kind = 'truncate' and cascade", text("banTruncateCascade")),
    "L24": on("kind = 'update' and not has_where", text("banUpdateWithoutWhere")),
    "L25": on("vacuum_full", text("banVacuumFull")),
    "L26": f"""select script_id, pos, ord, {text("changingColumnType")} message from col where context = 'alter_type'
      and not (type_names = 'text' or (type_names in ('pg_catalog.varchar', 'pg_catalog.numeric') and not has_modifier))""",
    "L27": on("kind = 'refresh' and concurrent", text("concurrentRefreshMatviewLock")),
    "L28": constraints("context = 'add_constraint' and contype in ('check', 'foreign') and initially_valid", "constraintMissingNotValid"),
    "L29": on("kind = 'create_enum'", text("creatingEnum", "type_name")),
    "L30": constraints(f"contype = 'unique' and ((context = 'add_constraint' and index_name = '') or context = 'add_column') and not {_LATER.format(t='con', and_=' and c.pos < con.pos')}", "disallowUniqueConstraint"),
    "L31": f"""select script_id, pos, 0 ord, case when kind = 'alter_table' then {text("lockTimeoutWarning", FULL)} else {text("lockTimeoutWarning.index", FULL, "idx_name")} end message
      from danger where not lock_timeout_set and not created_before and (kind = 'alter_table' or (kind = 'create_index' and not concurrent))""",
    "L32": f"""select script_id, pos, 0 ord, {text("multipleAlterTable", FULL)} message from
      (select *, row_number() over (partition by script_id, sch, rel_name order by pos) rn from danger where kind = 'alter_table') x where rn > 1""",
    "L33": columns(L.SMALLER_THAN_BIGINT, ALL, "preferBigInt"),
    "L34": columns(["integer", "int4", "serial", "serial4"], ALL, "preferBigintOverInt"),
    "L35": columns(["smallint", "int2", "smallserial", "serial2"], ALL, "preferBigintOverSmallint"),
    "L36": columns(L.SERIAL_TYPES, ALL, "preferIdentity"),
    "L37": columns(["json"], ALL, "preferJsonb"),
    "L38": " union all ".join([
        on("kind = 'create_index' and concurrent and idx_name = ''", text("preferRobustStmts.name")),
        on("kind = 'create_index' and concurrent and not if_not_exists", text("preferRobustStmts.index")),
        on("kind = 'drop' and concurrent and not if_exists", text("preferRobustStmts.drop")),
        on("kind = 'drop' and object_type = 'table' and not if_exists", text("preferRobustStmts.drop_table")),
        on("kind = 'create_table' and not if_not_exists", text("preferRobustStmts.create_table"))]),
    "L39": f"select script_id, pos, ord, {text('preferTextField')} message from col where type_names = 'pg_catalog.varchar' and has_modifier",
    "L40": f"select script_id, pos, ord, {text('preferTimestamptz')} message from col where type_names = 'pg_catalog.timestamp'",
    "L41": on("kind = 'rename' and object_type = 'column'", text("renamingColumn")),
    "L42": on("kind = 'rename' and object_type = 'table'", text("renamingTable")),
    "L43": commands("subtype = 'detach_partition' and not detach_concurrent", "requireConcurrentDetachPartition"),
    "L44": on(f"kind = 'create_index' and not concurrent and not {_LATER.format(t='danger', and_='')}", text("requireConcurrentIndexCreation")),
    "L45": on("kind = 'drop' and object_type = 'index' and not concurrent", text("requireConcurrentIndexDeletion")),
    "L46": on("kind = 'refresh' and not concurrent", text("requireConcurrentRefreshMatview")),
    "L47": on("kind = 'reindex' and not concurrent", text("requireConcurrentReindex")),
    "L48": on("is_dangerous_lock and not idle_in_transaction_timeout_set", text("requireIdleInTransactionTimeout")),
    "L49": f"""select v.script_id, v.pos, v.ord, {text("requireSeparateConstraintValidation", "v.name")} message
      from cmd v join seg s on s.script_id = v.script_id and s.pos = v.pos where v.subtype = 'validate_constraint' and exists (
        select 1 from con k join seg t on t.script_id = k.script_id and t.pos = k.pos where k.script_id = v.script_id and t.segment = s.segment and k.pos < v.pos
          and k.context = 'add_constraint' and k.skip_validation and lower(k.name) = lower(v.name) and lower(t.sch) = lower(s.sch) and lower(t.rel_name) = lower(s.rel_name))""",
    "L50": on("is_dangerous_lock and not statement_timeout_set", text("requireStatementTimeout")),
    "L51": on("holding_access_exclusive", text("runningStatementWhileHoldingAccessExclusive")),
    "L52": " union all ".join([
        on("tx_kind in ('begin', 'start') and first_transaction in ('begin', 'start')", text("transactionNesting.nested")),
        on("tx_kind in ('begin', 'start')", text("transactionNesting.begin")),
        on("tx_kind in ('commit', 'rollback')", text("transactionNesting.end"))]),
}


def rule_rows(rule_id: str) -> str:
    r = L.RULES[rule_id]
    return f"select script_id, pos, ord, '{r.name}' as rule, message, {r.severity} severity, '{r.category}' category from ({RULE_SQL[rule_id]}) r"


CATALOG_SQL = cte(["cat_proc", "cat_setting"])


def lint_sql(body: str) -> str:
    return f"with {corpus.SCRIPT_SQL}{STATE},\n{CATALOG_SQL}\n{body}"


def lint(rules: list[str] | None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df, chunk = facts(spark, sf, L.arrays_of(rules))
        if rules is None:  # several state chains read the facts, each only a few columns of them
            df = materialize(df, "facts")
        return L.lint(df, rules, catalog(spark, sf), chunk)

    return run


for _id in sorted(L.RULES):
    _name = f"{_id}_{L.RULES[_id].name}"
    QUERIES[_name] = lint([L.RULES[_id].name])
    SQL[_name] = lint_sql(rule_rows(_id))


def _registry_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Every rule of the registry run in one go, counted."""
    return lint(None)(spark, sf).groupBy("category", "severity").agg(F.count("*").alias("findings"), F.count_distinct("script_id").alias("scripts"))


QUERIES["U01_rule_registry"] = _registry_counts
_EVERY = "\nunion all\n".join(rule_rows(i) for i in sorted(L.RULES))
SQL["U01_rule_registry"] = lint_sql(f"select category, severity, count(*) findings, count(distinct script_id) scripts from ({_EVERY}) x group by 1, 2")


def _listing(spark: SparkSession, sf: str) -> DataFrame:
    """The listing, with how often each lint rule fires on the corpus."""
    fired = lint([r.name for r in L.RULES.values() if r.hits and not r.needs])(spark, sf).groupBy("category").agg(F.count("*").alias("findings"))
    return rules_frame(configure(spark)).join(fired, "category", "left").withColumn("findings", F.coalesce("findings", F.lit(0).cast("bigint")))


QUERIES["U02_rule_listing"] = _listing
_REGISTERED = ", ".join(
    f"('lint', '{r.group}', '{r.name}', '{r.category}', {r.severity}, {str(r.recommended).lower()})" for r in L.RULES.values()
)
_REGISTERED += ", " + ", ".join(
    f"('catalog', '{r.group}', '{r.name}', 'catalog/{r.group}/{r.name}', {C.LEVEL_SEVERITY[r.level]}, true)" for r in D.RULES.values()
)
_REGISTERED += ", " + ", ".join(
    f"('scorecard', '{r.scope}', '{r.name}', 'scorecard/{r.scope}/{r.name}', {C.WARNING}, true)" for r in P.RULES.values()
)
_STATELESS = "\nunion all\n".join(rule_rows(i) for i, r in L.RULES.items() if r.hits and not r.needs)
SQL["U02_rule_listing"] = lint_sql(
    f"""select g.*, coalesce(n, 0) findings from (values {_REGISTERED}) g(kind, grp, rule, category, severity, recommended)
left join (select category c, count(*) n from ({_STATELESS}) x group by 1) f on f.c = g.category"""
)
