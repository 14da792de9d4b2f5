"""Registered queries for suppression, selection and merging (X) and the scorecard (P, B, S, C), with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintfleet import constants as C
from lintfleet.fixtures import lint_queries as LQ
from lintfleet.fixtures.catalog_queries import SQL as CATALOG_QUERY_SQL
from lintfleet.fixtures.catalog_queries import catalog
from lintfleet.fixtures.corpus import SCRIPT_SQL
from lintfleet.fixtures.relations import cte, source
from lintfleet.fixtures.script_queries import DECLARED, scripts, split
from lintfleet.plans import catalog_dims as K
from lintfleet.plans import check as CH
from lintfleet.plans import function_checks as FC
from lintfleet.plans import lint_rules as L
from lintfleet.plans import scorecard as P
from lintfleet.plans import selection as SEL
from lintfleet.plans import suppressions as X
from lintfleet.plans.statements import split_statements
from lintfleet.session import configure, materialize, tasks_for

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# rules whose findings the suppression queries work on: all that judge a statement by itself; X09 runs all others too
RULES = [i for i, r in L.RULES.items() if r.hits and not r.needs]
NAMES = [L.RULES[i].name for i in RULES]


def findings(spark: SparkSession, sf: str) -> DataFrame:
    return CH.lint_scripts(scripts(spark, sf), NAMES)


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    return X.comments(scripts(spark, sf))


_KNOWN = ", ".join(f"'{s}'" for s in X.known_specifiers())
_FOUND = f"""
, fnd as materialized (select r.*, p.stmt_no, p.start_byte, p.end_byte, p.start_line, p.end_line, p.start_col, p.end_col, p.text code
  from ({{rows}}) r join spans p on p.script_id = r.script_id and p.pos = r.pos)"""
COMMENTS = f"""
, ln as (select script_id, cast(i - 1 as int) line, x raw, regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '') t,
    cast(coalesce(sum(strlen(x) + 1) over (partition by script_id order by i rows between unbounded preceding and 1 preceding), 0) as bigint) at0
  from (select script_id, unnest(l) x, unnest(range(1, len(l) + 1)) i from (select script_id, string_split(content, chr(10)) l from script) a) b)
, fo as (select script_id, min(line) first_other from ln where t <> '' and not starts_with(t, '-- pgt-ignore-all') and not starts_with(t, '-- pgls-ignore-all') group by 1)
, mk as (select ln.*, first_other, string_split_regex(trim(split_part(t, ':', 1)), '\\s+') ws from ln left join fo using (script_id)
  where starts_with(t, '-- pgt-ignore') or starts_with(t, '-- pgls-ignore'))
, mk2 as (select *, regexp_extract(ws[2], '^(?:pgt|pgls)-ignore(.*)$', 1) suffix, ws[3] spec from mk)
, sup as (select script_id, line, at0 + strlen(raw) - strlen(regexp_replace(raw, '^\\s+', '')) start_byte,
    at0 + strlen(raw) - strlen(regexp_replace(raw, '^\\s+', '')) + strlen(t) end_byte,
    case suffix when '' then 'line' when '-all' then 'file' when '-start' then 'start' when '-end' then 'end' end kind,
    case when suffix not in ('', '-all', '-start', '-end') then concat('''', ws[2], ''' {X.BAD_TAG}') when spec is null then '{X.NO_SPECIFIER}'
      when spec not in ({_KNOWN}) then '{X.BAD_RULE}' end error, spec,
    case when strpos(t, ':') > 0 then regexp_replace(regexp_replace(substr(t, strpos(t, ':') + 1), '^\\s+', ''), '\\s+$', '') end explanation,
    first_other is null or line < first_other is_leading from mk2)
, ok as (select * from sup where error is null)
, se as (select *, coalesce(sum(case when kind = 'start' then 1 else -1 end) over (partition by script_id, spec order by line rows between unbounded preceding and 1 preceding), 0) b
  from ok where kind in ('start', 'end'))
, dp as (select *, b - least(0, min(b) over (partition by script_id, spec order by line)) + case when kind = 'start' then 1 else 0 end depth from se)
, nx as (select *, lead(kind) over w next_kind, lead(end_byte) over w next_end from dp window w as (partition by script_id, spec, depth order by line))
, rng as (select script_id, spec specifier, line, start_byte,
    case when kind = 'start' and next_kind = 'end' then next_end else end_byte end end_byte,
    case when kind = 'end' then '{X.NO_START}' when coalesce(next_kind, '') <> 'end' then '{X.NO_END}' end error
  from nx where kind = 'start' or depth = 0)
, tgt as (select o.*, (select min(n) from (select unnest(range(o.line + 1, o.line + 5)) n) z where not exists (select 1 from ok k where k.script_id = o.script_id and k.kind = 'line' and k.line = z.n)) target_line
  from ok o where kind = 'line')"""
MATCH = "(split_part(f.category, '/', 1) = {s} or concat(split_part(f.category, '/', 1), '/', split_part(f.category, '/', 2)) = {s} or f.category = {s})"


def sql(body: str, rules: list[str] = RULES) -> str:
    rows = "\nunion all ".join(LQ.rule_rows(i) for i in rules)
    relations = f", {LQ.CATALOG_SQL}" if rules is not RULES else ""
    return f"with {SCRIPT_SQL}{LQ.STATE}{DECLARED}{relations}{_FOUND.format(rows=rows)}{COMMENTS}\n{body}"


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """The sweep over findings and comments. What is no part of a result, such as the statement's text, is not moved."""
    found = CH.lint_scripts(scripts(spark, sf), NAMES, code=False).select("script_id", "pos", "ord", "category", "message", *X.AT)
    return X.judge(found.withColumn("origin", F.lit(X.LINT)), parsed(spark, sf), tasks=tasks_for(source(spark, sf, "orders")))  # a row per statement


# ------------------------------------------------------------------ T09-T11

QUERIES["T09_suppression_comments"] = lambda spark, sf: parsed(spark, sf).drop("specifier", "leading")
SQL["T09_suppression_comments"] = sql(
    """select script_id, line, start_byte, end_byte, kind, case when error is null then split_part(spec, '/', 1) end category,
  case when error is null then nullif(split_part(spec, '/', 2), '') end grp, case when error is null then nullif(split_part(spec, '/', 3), '') end as rule,
  explanation, error from sup"""
)
QUERIES["T10_file_suppressions"] = lambda spark, sf: X.file_suppressions(parsed(spark, sf))
SQL["T10_file_suppressions"] = sql(
    f"select script_id, line, start_byte, end_byte, spec specifier, case when not is_leading then '{X.MISPLACED}' end error from ok where kind = 'file'"
)
QUERIES["T11_start_end_pairs"] = lambda spark, sf: X.range_suppressions(parsed(spark, sf))
SQL["T11_start_end_pairs"] = sql("select * from rng")

# ------------------------------------------------------------------ X

_SYNTAX = ["script_id", "start_byte", "end_byte"]


def _syntax(statements: DataFrame) -> DataFrame:
    """Every statement as if it had failed to parse, so that each finding has something to subsume."""
    return statements.select(
        "script_id", F.lit("syntax").alias("category"), F.lit(C.ERROR).alias("severity"), F.lit("Invalid statement").alias("message"),
        "start_byte", "end_byte", "start_line", "end_line",
    )


def _database(statements: DataFrame) -> DataFrame:
    """Some statements as if the database had reported them; a third of these a little wider than the statement."""
    return statements.filter("stmt_no % 3 = 0").select(
        "script_id", F.lit("database/check").alias("category"), F.lit(C.HINT).alias("severity"), F.lit("Reported").alias("message"),
        "start_byte", (F.col("end_byte") + F.when(F.col("stmt_no") % 9 == 0, 1).otherwise(0)).alias("end_byte"), "start_line", "end_line",
    )


_DATABASE = f"""
, dbf as (select script_id, 'database/check' category, {C.HINT} severity, 'Reported' message, start_byte,
  end_byte + case when stmt_no % 9 = 0 then 1 else 0 end end_byte, start_line, end_line from spans where stmt_no % 3 = 0)"""
_INSIDE = "exists (select 1 from dbf f where f.script_id = s.script_id and f.start_byte >= s.start_byte and f.end_byte <= s.end_byte)"
QUERIES["X02_syntax_error_subsumption"] = lambda spark, sf: X.drop_contained_syntax_errors(_syntax(split(spark, sf)), _database(split(spark, sf))).select(*_SYNTAX)
SQL["X02_syntax_error_subsumption"] = sql(f"{_DATABASE} select script_id, start_byte, end_byte from spans s where not {_INSIDE}")
_FILE_HIT = f"exists (select 1 from ok k where k.script_id = f.script_id and k.kind = 'file' and k.is_leading and {MATCH.format(s='k.spec')})"
QUERIES["X03_file_suppression"] = lambda spark, sf: (
    judged(spark, sf).filter("is_found").select("script_id", "category", F.col("by_file").alias("file_suppressed"), F.inline("found"))
    .select("script_id", "pos", "ord", "category", "message", "file_suppressed")
)
SQL["X03_file_suppression"] = sql(f"select script_id, stmt_no pos, ord, category, message, {_FILE_HIT} file_suppressed from fnd f")
_LINE_HIT = f"exists (select 1 from tgt k where k.script_id = f.script_id and {MATCH.format(s='k.spec')} and k.target_line between f.start_line and f.end_line)"
_RANGE_HIT = f"exists (select 1 from rng k where k.script_id = f.script_id and k.error is null and {MATCH.format(s='k.specifier')} and k.start_byte <= f.start_byte and f.end_byte <= k.end_byte)"
_SPAN = ", ".join(X.SPAN)
QUERIES["X04_line_suppression"] = lambda spark, sf: judged(spark, sf).filter("by_line").select(*X.SPAN)
SQL["X04_line_suppression"] = sql(f"select distinct {_SPAN} from fnd f where {_LINE_HIT}")
QUERIES["X05_range_suppression"] = lambda spark, sf: judged(spark, sf).filter("by_range").select(*X.SPAN)
SQL["X05_range_suppression"] = sql(f"select distinct {_SPAN} from fnd f where {_RANGE_HIT}")
QUERIES["X06_unused_suppression"] = lambda spark, sf: judged(spark, sf).filter("idle").select(
    "script_id", F.col("start_line").alias("line"), "start_byte", "end_byte", F.lit(X.NO_EFFECT).alias("message")
)
_UNUSED = f"""select script_id, line, start_byte, end_byte, '{X.NO_EFFECT}' message from tgt k where not exists
  (select 1 from fnd f where f.script_id = k.script_id and {MATCH.format(s='k.spec')} and k.target_line between f.start_line and f.end_line)"""
SQL["X06_unused_suppression"] = sql(_UNUSED)
_DISABLED = ["banDropTable", "banDropColumn"]


def _on_disabled(spark: SparkSession, sf: str) -> DataFrame:
    rows = parsed(spark, sf)
    return X.on_disabled(rows, _DISABLED, X.range_suppressions(rows))


QUERIES["X06b_disabled_rule_suppression"] = _on_disabled
_NAMED_OFF = f"""select script_id, line, start_byte, end_byte, '{X.DISABLED}' message from ok k
where split_part(spec, '/', 3) in ('banDropTable', 'banDropColumn') and (kind = 'line' or (kind = 'file' and is_leading)
  or (kind = 'start' and exists (select 1 from rng r where r.script_id = k.script_id and r.line = k.line and r.error is null)))"""
SQL["X06b_disabled_rule_suppression"] = sql(_NAMED_OFF)
QUERIES["X06c_specifier_match"] = lambda spark, sf: (
    findings(spark, sf).withColumn("specifier", F.explode(X.specifiers(F.col("category"))))
    .groupBy("category", "specifier").agg(F.count("*").alias("findings"))
)
SQL["X06c_specifier_match"] = sql(
    """select category, s.specifier, count(*) findings from (select category, unnest([split_part(category, '/', 1),
  concat(split_part(category, '/', 1), '/', split_part(category, '/', 2)), category]) specifier from fnd) s group by 1, 2"""
)
_LEVELS = {"banDropTable": C.ERROR, "banTruncate": C.HINT}
QUERIES["X07_severity_override"] = lambda spark, sf: SEL.override_severity(findings(spark, sf), _LEVELS).select("script_id", "pos", "ord", "rule", "severity")
SQL["X07_severity_override"] = sql(
    "select script_id, stmt_no pos, ord, rule, case rule when 'banDropTable' then 3 when 'banTruncate' then 0 else 2 end severity from fnd"
)
_CAP = 3


def _capped(spark: SparkSession, sf: str) -> DataFrame:
    kept, counts = SEL.cap(materialize(findings(spark, sf), "findings"), ["script_id"], ["pos", "ord", "rule", "message"], _CAP)
    return kept.select("script_id", "pos", "ord", "rule").join(counts, "script_id")


QUERIES["X08_cap_with_remainder"] = _capped
SQL["X08_cap_with_remainder"] = sql(
    f"""select script_id, stmt_no pos, ord, rule, found, greatest(found - {_CAP}, 0) skipped from (
  select *, row_number() over (partition by script_id order by stmt_no, ord, rule, message) rn, count(*) over (partition by script_id) found from fnd) x where rn <= {_CAP}"""
)


def _check(spark: SparkSession, sf: str) -> DataFrame:
    """All rules with the catalog. Syntax errors and database findings are made of the statements, so these are split once."""
    corpus = scripts(spark, sf).withColumn("db_id", (F.col("script_id") % 5).cast("int"))
    statements = materialize(split_statements(corpus, ["script_id", "db_id"], "content"), "split")
    found = CH.check(corpus, None, catalog(spark, sf), _syntax(statements), database_findings=_database(statements), levels=_LEVELS,
                     disabled=_DISABLED, statements=statements)
    return found.drop("start_line", "end_line")


QUERIES["X09_check"] = _check
SQL["X09_check"] = sql(
    f"""{_DATABASE}
, everything as (select script_id, category, case rule when 'banDropTable' then 3 when 'banTruncate' then 0 else 2 end severity, message,
    start_byte, end_byte, start_line, end_line from fnd where rule not in ('banDropTable', 'banDropColumn')
  union all select * from dbf
  union all select script_id, 'syntax', 3, 'Invalid statement', start_byte, end_byte, start_line, end_line from spans s where not {_INSIDE})
select script_id, category, severity, message, start_byte, end_byte from everything f where not {_FILE_HIT} and not {_LINE_HIT} and not {_RANGE_HIT}
union all select script_id, 'lint', 2, error, start_byte, end_byte from sup where error is not null
union all select script_id, 'lint', 2, '{X.MISPLACED}', start_byte, end_byte from ok where kind = 'file' and not is_leading
union all select script_id, 'lint', 2, error, start_byte, end_byte from rng where error is not null
union all select script_id, 'lint', 2, message, start_byte, end_byte from ({_NAMED_OFF}) d
union all select script_id, 'lint', 2, message, start_byte, end_byte from (
  {_UNUSED.replace('from fnd f', 'from everything f')}) u""",
    sorted(L.RULES),
)

CONFIG_SQL = """
select c_custkey project, case when c_custkey % 7 = 0 then true when c_custkey % 2 = 0 then false end all_rules,
  case when c_custkey % 3 = 0 then false when c_custkey % 4 = 1 then true end recommended, c_nationkey % 2 = 0 group_present,
  case c_custkey % 5 when 0 then 'banDropDatabase creatingEnum' when 1 then 'preferJsonb' else '' end rules_on,
  case c_custkey % 6 when 0 then 'banDropTable creatingEnum' when 1 then 'banTruncate' else '' end rules_off,
  case c_custkey % 11 when 0 then 'banTruncate preferJsonb' when 5 then 'safety' else '' end only_text,
  case c_custkey % 13 when 0 then 'banTruncate' when 6 then 'safety' else '' end skip_text from customer"""


def _effective(spark: SparkSession, sf: str) -> DataFrame:
    source(configure(spark), sf, "customer").createOrReplaceTempView("customer")
    config = spark.sql(CONFIG_SQL).withColumnsRenamed({"only_text": "only", "skip_text": "skip"})
    for name in ("rules_on", "rules_off", "only", "skip"):
        config = config.withColumn(name, F.when(F.col(name) == "", F.array().cast("array<string>")).otherwise(F.split(name, " ")))
    return SEL.effective_rules(config)


QUERIES["X01_effective_rules"] = _effective
_REG = ", ".join(f"('{r.name}', {str(r.recommended).lower()})" for r in L.RULES.values())
SQL["X01_effective_rules"] = f"""
with config as ({CONFIG_SQL}), reg(rule, rec) as (values {_REG}),
x as (select *, coalesce(all_rules, false) or (rec and coalesce(recommended, true)) preset,
  list_contains(string_split(only_text, ' '), rule) or list_contains(string_split(only_text, ' '), 'safety') is_only,
  list_contains(string_split(skip_text, ' '), rule) or list_contains(string_split(skip_text, ' '), 'safety') is_skip,
  list_contains(string_split(rules_on, ' '), rule) is_on, list_contains(string_split(rules_off, ' '), rule) is_off from config, reg)
select project, rule from x where not is_skip and case when only_text <> '' then is_only when group_present then (preset or is_on) and not is_off else preset end"""

RESULTS_SQL = """
select cast(user_id % 5 as int) db_id, case when event_id % 3 = 0 then cast(null as {S}) else case cast(floor(event_id / 7) as bigint) % 5 when 0 then 'public' when 1 then 'app' when 2 then 'auth' else 'pg_catalog' end end proc_schema,
  concat('fn_', cast(event_id % 40 as {S})) proc_name, event_id % 4 = 0 is_trigger, event_id,
  concat('{{"function":"fn","issues":[{{"level":"', case event_type when 'error' then 'error' when 'click' then 'warning' when 'view' then 'notice' else 'other' end,
    '","message":"m', cast(event_id as {S}), '","detail":', case when event_id % 2 = 0 then '"some detail"' else 'null' end,
    ',"hint":', case when event_id % 5 = 0 then '" try this "' else '""' end, ',"statement":{{"lineNumber":"', cast(event_id % 9 as {S}),
    '","text":"x"}},"sqlState":"42P01"}},{{"level":"warning","message":"second"}}]}}') payload
from events""".replace("{{", "{").replace("}}", "}")


def _results(spark: SparkSession, sf: str) -> DataFrame:
    source(configure(spark), sf, "events").createOrReplaceTempView("events")
    return FC.parse_results(spark.sql(RESULTS_SQL.replace("{S}", "string")), K.triggers(catalog(spark, sf)))


QUERIES["X10_function_check_results"] = _results
SQL["X10_function_check_results"] = f"""
with results as ({RESULTS_SQL.replace("{S}", "varchar")}), trg as (select distinct db_id, proc_name, proc_schema, concat(table_schema, '.', table_name) relation
  from ({CATALOG_QUERY_SQL["K07_triggers"]}) t where table_name is not null),
issues as (select r.*, 0 issue_no, json_extract_string(payload, '$.issues[0].level') lv, json_extract_string(payload, '$.issues[0].message') message,
    json_extract_string(payload, '$.issues[0].detail') detail, trim(json_extract_string(payload, '$.issues[0].hint')) hint, json_extract_string(payload, '$.issues[0].sqlState') code,
    cast(json_extract_string(payload, '$.issues[0].statement.lineNumber') as int) statement_line from results r
  union all select r.*, 1, 'warning', 'second', null, null, null, null from results r)
select i.db_id, i.proc_schema, i.proc_name, issue_no, case lv when 'error' then 3 when 'warning' then 2 when 'notice' then 0 else 1 end severity, message,
  concat(message, case when coalesce(detail, '') <> '' then concat(chr(10), chr(10), 'Detail: ', detail) else '' end,
    case when coalesce(hint, '') <> '' then concat(chr(10), chr(10), 'Hint: ', hint) else '' end) description, code, statement_line, t.relation
from issues i left join trg t on i.is_trigger and t.db_id = i.db_id and t.proc_name = i.proc_name and (i.proc_schema is null or i.proc_schema = t.proc_schema)
where not i.is_trigger or t.relation is not null"""

# ------------------------------------------------------------------ P, B, S, C

_TAB = "tab as (select c.*, n.nspname from cat_class c join cat_namespace n on n.db_id = c.db_id and n.oid = c.relnamespace where c.relkind = 'r' and n.nspname not in ('pg_catalog', 'information_schema'))"
_SPACES = "spc as (select * from cat_namespace where nspname not in ('pg_catalog', 'information_schema') and not starts_with(nspname, 'pg_'))"
_NAMED = """nam as (select db_id, relname as name from cat_class where relkind in ('r', 'S') union all
  select db_id, attname from cat_attribute where attnum > 0 and not attisdropped union all select db_id, relname from cat_index_class union all select db_id, proname from cat_proc)"""
_RESERVED = ", ".join(f"'{w}'" for w in C.RESERVED_WORDS)
# rule -> relations, query of db_id and v (violates)
SCORE_SQL: dict[str, tuple[list[str], str]] = {
    "B001": (["cat_index"], "select db_id, not exists (select 1 from cat_index i where i.db_id = t.db_id and i.indrelid = t.oid and i.indisprimary) v from tab t"),
    "B002": (["cat_index"], "select db_id, exists (select 1 from cat_index o where o.db_id = i.db_id and o.indrelid = i.indrelid and o.indexrelid <> i.indexrelid and (o.indkey = i.indkey or o.indkey like concat(i.indkey, ' %'))) v from cat_index i"),
    "B003": (["cat_index", "cat_constraint"], """select db_id, exists (select 1 from cat_constraint k where k.db_id = t.db_id and k.conrelid = t.oid and k.contype = 'f' and not exists
      (select 1 from cat_index i where i.db_id = k.db_id and i.indrelid = k.conrelid and i.indisvalid and (i.indkey = k.conkey or i.indkey like concat(k.conkey, ' %')))) v from tab t"""),
    "B004": (["cat_index", "cat_stat_index"], "select i.db_id, s.idx_scan = 0 and not i.indisunique v from cat_index i left join cat_stat_index s on s.db_id = i.db_id and s.indexrelid = i.indexrelid"),
    "B005": ([], "select db_id, name <> lower(name) v from nam"),
    "B006": (["cat_stat_table"], "select t.db_id, coalesce(s.seq_scan, 0) + coalesce(s.idx_scan, 0) = 0 v from tab t left join cat_stat_table s on s.db_id = t.db_id and s.relid = t.oid"),
    "B007": (["cat_constraint"], """select db_id, exists (select 1 from cat_constraint k join cat_class a on a.db_id = k.db_id and a.oid = k.conrelid join cat_class b on b.db_id = k.db_id and b.oid = k.confrelid
      where k.db_id = t.db_id and k.conrelid = t.oid and k.contype = 'f' and a.relnamespace <> b.relnamespace) v from tab t"""),
    "B008": (["cat_constraint", "cat_attribute"], """select db_id, exists (select 1 from (select *, unnest(string_split(conkey, ' ')) a, unnest(string_split(confkey, ' ')) b from cat_constraint where contype = 'f') k
      join cat_attribute x on x.db_id = k.db_id and x.attrelid = k.conrelid and x.attnum = cast(k.a as int) join cat_attribute y on y.db_id = k.db_id and y.attrelid = k.confrelid and y.attnum = cast(k.b as int)
      where k.db_id = t.db_id and k.conrelid = t.oid and x.atttypid <> y.atttypid) v from tab t"""),
    "B009": (["cat_trigger"], """select db_id, bool_or(n > 1) v from (select distinct g.db_id, g.tgrelid, g.tgfoid, (select count(distinct h.tgrelid) from cat_trigger h where h.db_id = g.db_id and h.tgfoid = g.tgfoid and not h.tgisinternal) n
      from cat_trigger g where not g.tgisinternal) x group by db_id, tgrelid"""),
    "B010": ([], f"select db_id, lower(name) in ({_RESERVED}) v from nam"),
    "B011": ([], "select db_id, (select count(distinct relowner) from tab t where t.db_id = s.db_id and t.relnamespace = s.oid) > 1 v from spc s"),
    "B012": (["cat_index"], "select db_id, exists (select 1 from cat_index i where i.db_id = t.db_id and i.indrelid = t.oid and i.indisprimary and len(string_split(i.indkey, ' ')) > 4) v from tab t"),
    "S001": (["cat_default_acl"], "select db_id, not exists (select 1 from cat_default_acl a where a.db_id = s.db_id and a.defaclnamespace = s.oid) v from spc s"),
    "S002": ([], "select db_id, regexp_matches(lower(nspname), '^(staging|stg|preprod|prod|sandbox|sbox)|(staging|stg|preprod|prod|sandbox|sbox)$') v from spc"),
    "S003": (["cat_ns_acl"], "select db_id, exists (select 1 from cat_ns_acl a where a.db_id = s.db_id and a.nspoid = s.oid and a.grantee = '-' and a.privilege_type = 'CREATE') v from spc s"),
    "S004": (["cat_role"], "select s.db_id, coalesce(r.rolsuper or starts_with(r.rolname, 'pg_') or r.rolname = 'postgres', false) v from spc s left join cat_role r on r.db_id = s.db_id and r.oid = s.nspowner"),
    "S005": ([], "select t.db_id, t.relowner <> s.nspowner v from tab t join spc s on s.db_id = t.db_id and s.oid = t.relnamespace"),
    "C001": (["cat_hba"], "select db_id, auth_method = 'trust' v from cat_hba"),
    "C002": (["cat_hba"], "select db_id, auth_method in ('trust', 'password') v from cat_hba"),
    "C003": (["cat_setting"], "select db_id, value = 'md5' v from cat_setting where name = 'password_encryption'"),
}
_BASE = ["cat_class", "cat_namespace", "cat_attribute", "cat_index_class", "cat_proc"]


def score_rows(rule_id: str) -> str:
    r = P.RULES[rule_id]
    return f"""select db_id, '{r.name}' as rule, violations, total, percent, case when percent >= {r.error} then 'error' when percent >= {r.warning} then 'warning' else 'ok' end as level
from (select db_id, count(*) filter (where v) violations, count(*) total, round(count(*) filter (where v) * 100.0 / count(*), 2) percent from ({SCORE_SQL[rule_id][1]}) q group by db_id) z"""


def score_sql(ids: list[str], body: str) -> str:
    rels = sorted({*_BASE, *[x for i in ids for x in SCORE_SQL[i][0]]})
    return f"with {cte(rels)}, {_TAB}, {_SPACES}, {_NAMED}\n{body}"


for _id, _rule in P.RULES.items():
    QUERIES[f"{_id}_{_rule.name}"] = lambda spark, sf, i=_id: P.RULES[i].score(catalog(spark, sf))
    SQL[f"{_id}_{_rule.name}"] = score_sql([_id], score_rows(_id))

_ENABLED, _OFF = ["B001", "B003", "B012", "S002", "S003"], ["B012"]
_MESSAGES = [("B001", "table {object} has no primary key"), ("S002", "schema {object} is named after an environment")]


def _report(spark: SparkSession, sf: str) -> DataFrame:
    cat = catalog(spark, sf)
    messages = spark.createDataFrame(_MESSAGES, "rule_code string, message string")
    return P.report(cat, P.violations(cat, [r for r in _ENABLED if r not in _OFF]), messages, _ENABLED, _OFF)


QUERIES["P00_scorecard_driver"] = _report
_V = " union all ".join(
    f"select '{i}' code, t.db_id, t.oid, 'ordinary' typ, t.nspname, t.relname nm from tab t where {cond}"
    for i, cond in [
        ("B001", "not exists (select 1 from cat_index i where i.db_id = t.db_id and i.indrelid = t.oid and i.indisprimary)"),
        ("B003", "exists (select 1 from cat_constraint k where k.db_id = t.db_id and k.conrelid = t.oid and k.contype = 'f' and not exists (select 1 from cat_index i where i.db_id = k.db_id and i.indrelid = k.conrelid and i.indisvalid and (i.indkey = k.conkey or i.indkey like concat(k.conkey, ' %'))))"),
    ]
) + " union all " + " union all ".join(
    f"select '{i}', s.db_id, s.oid, 'schema', null, s.nspname from spc s where {cond}"
    for i, cond in [
        ("S002", "regexp_matches(lower(nspname), '^(staging|stg|preprod|prod|sandbox|sbox)|(staging|stg|preprod|prod|sandbox|sbox)$')"),
        ("S003", "exists (select 1 from cat_ns_acl a where a.db_id = s.db_id and a.nspoid = s.oid and a.grantee = '-' and a.privilege_type = 'CREATE')"),
    ]
)
SQL["P00_scorecard_driver"] = score_sql(
    ["B001", "B003", "S003"],
    f"""select v.db_id, code rule_code, v.nspname as "schema", nm object_name, typ object_type,
  case code when 'B001' then concat('table ', concat_ws('.', v.nspname, nm), ' has no primary key') when 'S002' then concat('schema ', nm, ' is named after an environment')
    else concat(code, ' violated by ', concat_ws('.', v.nspname, nm)) end message
from ({_V}) v where exists (select 1 from cat_extension e where e.db_id = v.db_id and e.extname = 'pglinter')
union all select distinct n.db_id, 'B012', null, null, null, 'rule B012 is disabled in the extension' from cat_namespace n where exists (select 1 from cat_extension e where e.db_id = n.db_id and e.extname = 'pglinter')
union all select distinct n.db_id, null, null, null, null, 'the extension is not installed' from cat_namespace n where not exists (select 1 from cat_extension e where e.db_id = n.db_id and e.extname = 'pglinter')""",
).replace("with ", f"with {cte(['cat_extension'])}, ", 1)
