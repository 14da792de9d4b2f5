"""Registered queries over the derived scripts (T, F) and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintfleet import constants as C
from lintfleet.fixtures import corpus
from lintfleet.fixtures.relations import source
from lintfleet.plans import facts as FX
from lintfleet.plans import statements as ST
from lintfleet.plans import tokens as TK
from lintfleet.session import configure, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.scripts(configure(spark), sf_dir)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(source(configure(spark), sf_dir, "documents").select("doc_id", "text"))


def statement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.statements(configure(spark), sf_dir).select("script_id", "pos", "db_id", "text")


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.split_statements(scripts(spark, sf_dir), ["script_id", "path"], "content")


def sql(body: str, extra: str = "") -> str:
    return f"with {corpus.SCRIPT_SQL}{extra}\n{body}"


# The token pattern without possessive repeats and lookarounds; the scripts use plain dollar quotes only.
_ID, _PART = "[A-Za-z_\\x{80}-\\x{FF}]", "[A-Za-z0-9_$\\x{80}-\\x{FF}]"
_SQ, _DQ = "'(?:[^']|'')*(?:'|\\z)", '"(?:[^"]|"")*(?:"|\\z)'
SQL_TOKEN = "|".join([
    " +|\\t+|\\x0B+|\\f+", "(?:\\r\\n|\\n|\\r)+", "--[^\\n]*", "/\\*[\\s\\S]*?(?:\\*/|\\z)",
    f"(?:[uU]&|[eEbBxX])?{_SQ}", f"(?:[uU]&)?{_DQ}", f"{_ID}{_PART}*", "[,;()]", "\\$\\$[\\s\\S]*?(?:\\$\\$|\\z)", "::",
    f"\\${_ID}{_PART}*", f":{_SQ}", f":{_DQ}", f"[:@]{_ID}{_PART}*", "\\$[0-9]*",
    "0[xX][0-9a-fA-F_]*|0[bBoO][0-9_]*|[0-9][0-9_]*(?:\\.(?:[0-9][0-9_]*)?)?(?:[eE][+-]?[0-9_]*)?|\\.[0-9][0-9_]*(?:[eE][+-]?[0-9_]*)?",
    "[\\s\\S]",
]).replace("'", "''")
SQL_KIND = f"""case when t like '--%' or t like '/*%' then 'comment'
  when regexp_matches(t, '^[\\r\\n]') then 'newline' when regexp_matches(t, '^[ \\t\\x0B\\f]') then 'space'
  when regexp_matches(t, '^(?:[uU]&|[eEbBxX])?''') then 'string' when regexp_matches(t, '^(?:[uU]&)?"') then 'quoted_ident'
  when t like '$$%' then 'dollar_string' when regexp_matches(t, '^\\$[0-9]*$') then 'positional_param'
  when t <> '::' and regexp_matches(t, '^[:@$][\\s\\S]') then 'named_param' when regexp_matches(t, '^\\.?[0-9]') then 'number'
  when regexp_matches(t, '^{_ID}') then 'word' else 'symbol' end"""

QUERIES["T01_tokens"] = lambda spark, sf: TK.tokens(scripts(spark, sf), ["script_id"], "content")
SQL["T01_tokens"] = sql(
    f"""select script_id, cast(ord as int) ord, t as token, {SQL_KIND} kind, cast(e - strlen(t) as bigint) start_byte, cast(e as bigint) end_byte from (
  select *, sum(strlen(t)) over (partition by script_id order by ord) e from (
    select script_id, unnest(l) t, unnest(range(1, len(l) + 1)) ord from (select script_id, regexp_extract_all(content, '{SQL_TOKEN}') l from script) a) b) c"""
)

QUERIES["T02_token_statistics"] = lambda spark, sf: TK.token_statistics(documents(spark, sf), "text")
_RESERVED, _OTHER = (", ".join(f"'{w}'" for w in ws) for ws in (C.RESERVED_WORDS, C.STATEMENT_WORDS))
SQL["T02_token_statistics"] = f"""
select kind, case when kind = 'word' then case when w in ({_RESERVED}) then 'reserved' when w in ({_OTHER}) then 'unreserved' else 'identifier' end end "class",
  case when kind = 'word' and (w in ({_RESERVED}) or w in ({_OTHER})) then w end keyword, count(*) n, cast(sum(strlen(t)) as bigint) bytes
from (select t, lower(t) w, {SQL_KIND} kind from (select unnest(regexp_extract_all(text, '{SQL_TOKEN}')) t from documents) a) b group by 1, 2, 3"""

DECLARED = """
, laid as (
  select script_id, pos, cast(row_number() over w as int) stmt_no, body, ender, prefix, gap,
    strlen(h.header) + coalesce(sum(strlen(concat(prefix, body, ender, gap))) over (w rows between unbounded preceding and 1 preceding), 0) + strlen(prefix) b,
    len(string_split(concat(h.header, coalesce(string_agg(concat(prefix, body, ender, gap), '') over (w rows between unbounded preceding and 1 preceding), ''), prefix), chr(10))) - 1 l
  from stmt join hdr h on h.hno = script_id % {hn} window w as (partition by script_id order by pos))
, spans as (
  select script_id, pos, stmt_no, cast(b as bigint) start_byte, cast(b + strlen(body) + strlen(ender) as bigint) end_byte, cast(l as int) start_line,
    cast(l + len(string_split(body, chr(10))) - 1 as int) end_line, 0 start_col,
    cast(length(regexp_extract(concat(body, ender), '[^\n]*$')) as int) end_col, concat(body, ender) text, ender = ';' has_semicolon from laid)""".replace(
    "{hn}", str(len(corpus.HEADERS))
)
QUERIES["T03_split_statements"] = lambda spark, sf: split(spark, sf).drop("path")
SQL["T03_split_statements"] = sql("select * exclude (pos) from spans", DECLARED)

QUERIES["T04_line_index"] = lambda spark, sf: TK.lines(documents(spark, sf), ["doc_id"], "text")
SQL["T04_line_index"] = """
select doc_id, cast(i - 1 as int) line, cast(coalesce(sum(strlen(x) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as bigint) start_byte, x line_text
from (select doc_id, unnest(l) x, unnest(range(1, len(l) + 1)) i from (select doc_id, string_split(text, chr(10)) l from documents) a) b"""

QUERIES["T05_meta_commands"] = lambda spark, sf: ST.meta_commands(scripts(spark, sf), ["script_id"], "content")
SQL["T05_meta_commands"] = sql(
    f"""select script_id, 0 line, cast(0 as bigint) start_byte, cast(8 as bigint) end_byte, '\\set x 1' as text
from script where script_id % {len(corpus.HEADERS)} = {[h.startswith(chr(92)) for h in corpus.HEADERS].index(True)}"""
)

QUERIES["T06_ends_with_semicolon"] = lambda spark, sf: (
    split(spark, sf).groupBy("script_id").agg(
        F.count_if("has_semicolon").alias("with_semicolon"), F.count("*").alias("statements"),
        F.max_by("has_semicolon", "stmt_no").alias("last_has_semicolon"),
    )
)
SQL["T06_ends_with_semicolon"] = sql(
    """select script_id, count(*) filter (where ender = ';') with_semicolon, count(*) statements, arg_max(ender = ';', pos) last_has_semicolon
from stmt group by script_id"""
)


def _nested(spark: SparkSession, sf: str) -> DataFrame:
    nested = ST.with_nested(split(spark, sf).drop("path"))
    return nested.select("script_id", "parent_stmt", "stmt_no", "start_byte", "end_byte", "text")


QUERIES["T07_nested_function_bodies"] = _nested
SQL["T07_nested_function_bodies"] = sql(
    """
select script_id, cast(null as int) parent_stmt, stmt_no, start_byte, end_byte, text from spans
union all
select script_id, stmt_no, v.k, start_byte + strpos(text, v.part) - 1, start_byte + strpos(text, v.part) - 1 + strlen(v.part), v.part
from spans join (values (1, 'SELECT 1;'), (2, 'SELECT a FROM users')) v(k, part) on text like 'CREATE FUNCTION %'""",
    DECLARED,
)
QUERIES["T08_statement_identity"] = lambda spark, sf: ST.distinct_statements(statement_rows(spark, sf))
SQL["T08_statement_identity"] = sql(
    """select sha256(body) stmt_key, body as text, count(*) occurrences, count(distinct script_id) scripts from stmt group by body"""
).replace("count(*) occurrences", "cast(count(*) as bigint) occurrences")


# ------------------------------------------------------------------ F: facts


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    return FX.statement_facts(statement_rows(spark, sf)).drop("masked", "db_id", "text")


QUERIES["F01_statement_facts"] = _facts
_F1 = ", ".join(corpus.FACT_FIELDS)
SQL["F01_statement_facts"] = sql(f"select script_id, pos, rel_schema, rel_name, {_F1} from stmt")

QUERIES["F02_command_facts"] = lambda spark, sf: (
    FX.add_commands(FX.statement_facts(statement_rows(spark, sf)))
    .select("script_id", "pos", F.inline("commands")).drop("definition")
)
SQL["F02_command_facts"] = sql("select script_id, pos, ord, subtype, name, detach_concurrent concurrent from cmd")

QUERIES["F03_column_facts"] = lambda spark, sf: (
    FX.extract(statement_rows(spark, sf), arrays=["columns"]).select("script_id", "pos", F.inline("columns"))
    .withColumn("type_names", F.array_join("type_names", "."))
)
SQL["F03_column_facts"] = sql("select script_id, pos, context, ord, name, type_names, has_modifier from col")

QUERIES["F04_constraint_facts"] = lambda spark, sf: (
    FX.extract(statement_rows(spark, sf), arrays=["constraints"]).select("script_id", "pos", F.inline("constraints")).drop("default_schema")
)
SQL["F04_constraint_facts"] = sql(
    """select script_id, pos, context, ord, contype, name, skip_validation, initially_valid, index_name, generated_when, default_kind, default_function from con"""
)

QUERIES["F05_mentions"] = lambda spark, sf: FX.mentions(
    statement_rows(spark, sf).withColumnRenamed("pos", "stmt_no")
).withColumnRenamed("stmt_no", "pos")
SQL["F05_mentions"] = sql(
    """
select distinct * from (
  select script_id, pos, 'relation' clause, tschema as "schema", tname as name, case when kind = 'select' then 'u' else '' end alias
    from stmt join tbl on tbl.target = stmt.target
    where kind in ('alter_table', 'rename', 'create_table', 'ctas', 'delete', 'update', 'select') or (kind = 'drop' and object_type = 'table')
      or (kind = 'truncate' and cascade) or (kind = 'reindex' and body like 'REINDEX TABLE%')
  union all select script_id, pos, 'relation', '', 'users', '' from stmt where body like '%REFERENCES users%' or body like '%max(x) FROM users%'
  union all select script_id, pos, 'select', '', 'a', '' from stmt where kind = 'select'
  union all select script_id, pos, 'select', '', 'b', 'u' from stmt where kind = 'select'
  union all select script_id, pos, 'where', '', 'c', 'u' from stmt where kind = 'select'
  union all select script_id, pos, 'where', '', 'id', '' from stmt where has_where
  union all select script_id, pos, 'where', '', 'y', '' from stmt where body like '%max(x) FROM users%') x"""
)
