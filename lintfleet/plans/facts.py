"""Facts about statements (F01-F05), read off their text with regular expressions.

All facts of a statement live in its row: scalar columns plus arrays for sub-commands, columns and constraints.
Extraction is therefore a projection. Shapes the patterns do not know stay "other"; nothing is guessed.
"""

from __future__ import annotations

import re
from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintfleet.functions.arrays import pin
from lintfleet.plans.tokens import BLOCK_COMMENT, IDENT_PART, IDENT_START, LINE_COMMENT, QUOTED_IDENT, STRING, TAG_PART, breaker, let, unnested

QUOTED = r'"(?:[^"]|"")*+"'
NAME = rf"(?:{QUOTED}|{IDENT_START}{IDENT_PART}*+)"
REL = rf"(?:({NAME}) ?\. ?)?({NAME})"
_TAG2 = rf"\$((?:{IDENT_START}{TAG_PART}*+)?)\$[\s\S]*?(?:\$\2\$|\z)"
_KEEP = rf"({STRING}|{QUOTED_IDENT}|{_TAG2})"
_COMMENTS = rf"{_KEEP}|{LINE_COMMENT}|{BLOCK_COMMENT}"
MARK = "\u0001"

# SQL type names and the catalog name a parser gives them.
TYPE_ALIASES = {
    "int": "int4", "integer": "int4", "bigint": "int8", "smallint": "int2", "real": "float4", "float": "float8",
    "double precision": "float8", "decimal": "numeric", "dec": "numeric", "numeric": "numeric", "boolean": "bool",
    "char": "bpchar", "character": "bpchar", "nchar": "bpchar", "national character": "bpchar", "national char": "bpchar",
    "varchar": "varchar", "character varying": "varchar", "char varying": "varchar", "bit": "bit", "bit varying": "varbit",
    "timestamp": "timestamp", "timestamp without time zone": "timestamp", "timestamp with time zone": "timestamptz",
    "time": "time", "time without time zone": "time", "time with time zone": "timetz", "interval": "interval", "json": "json",
}

COLUMN_FACT = "struct<context:string,ord:int,name:string,type_names:array<string>,has_modifier:boolean>"
CONSTRAINT_FACT = (
    "struct<context:string,ord:int,contype:string,name:string,skip_validation:boolean,initially_valid:boolean,"
    "index_name:string,generated_when:string,default_kind:string,default_schema:string,default_function:string>"
)
COMMAND_FACT = "struct<ord:int,subtype:string,name:string,definition:string,concurrent:boolean>"


def pick(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, f"(?is){pattern}", group)


def like(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?is){pattern}")


def ident(text: Column) -> Column:
    """Name as the parser stores it: quotes removed, unquoted names in lower case."""

    def stored(name: Column) -> Column:
        inner = F.replace(F.substring(name, F.lit(2), F.length(name) - 2), F.lit('""'), F.lit('"'))
        return F.when(name.startswith('"'), inner).otherwise(F.lower(name))

    return let(text, stored)


def _any_of(text: Column, *parts: str) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def _comments_gone(text: Column) -> Column:
    # the pattern finds nothing without one of these
    gone = F.regexp_replace(let(breaker(text), lambda b: unnested(text, b)), _COMMENTS, "$1 ")
    return F.when(_any_of(text, "'", '"', "$", "--", "/*"), gone).otherwise(text)


def without_comments(text: Column) -> Column:
    kept = _comments_gone(text)
    return F.regexp_replace(F.trim(F.regexp_replace(kept, rf"({QUOTED})\s*+|\s+", "$1 ")), r"[\s;]+$", "")


def masked(text: Column) -> Column:
    """Statement text with comments gone, literals emptied to '' and white space single."""

    def emptied(plain: Column) -> Column:
        marked = F.regexp_replace(plain, rf"({QUOTED})|{STRING}|{_TAG2}", f"$1{MARK}")
        bare = F.regexp_replace(F.regexp_replace(marked, f'"{MARK}', '"'), MARK, "''")
        return F.when(_any_of(plain, "'", '"', "$", MARK), bare).otherwise(plain)

    def spaced(bare: Column) -> Column:
        single = F.regexp_replace(bare, rf"({QUOTED})\s*+|\s+", "$1 ")
        return F.when(bare.rlike(r'"|  |[\t\n\x0B\f\r]'), single).otherwise(bare)

    return let(_comments_gone(text), lambda plain: let(emptied(plain), lambda bare: F.regexp_replace(F.trim(spaced(bare)), r"[\s;]+$", "")))


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf'{QUOTED}|[(),\[\]]|[^(),\[\]"]+|"'), F.lit(0))


def split_top_level(text: Column) -> Column:
    """Parts between commas that are not inside brackets."""
    zero = F.struct(F.lit(0).alias("depth"), F.lit("").alias("part"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, p: Column) -> Column:
        cut = (acc["depth"] == 0) & (p == ",")
        depth = acc["depth"] + p.isin("(", "[").cast("int") - p.isin(")", "]").cast("int")
        return F.struct(
            depth.alias("depth"),
            F.when(cut, "").otherwise(F.concat(acc["part"], p)).alias("part"),
            F.when(cut, F.array_append(acc["parts"], F.trim(acc["part"]))).otherwise(acc["parts"]).alias("parts"),
        )

    folded = F.aggregate(_pieces(text), zero, step, lambda a: F.array_append(a["parts"], F.trim(a["part"])))
    return F.when(text.contains(","), folded).otherwise(F.array(F.trim(text)))


def first_brackets(text: Column) -> Column:
    """What stands between the bracket a text begins with and the one that closes it; all the rest if none does."""
    zero = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"), F.lit(False).alias("closed"))

    def step(acc: Column, p: Column) -> Column:
        depth = acc["depth"] + (p == "(").cast("int") - (p == ")").cast("int")
        inside = ~acc["closed"] & (depth > 0) & (acc["depth"] > 0)
        return F.struct(depth.alias("depth"), F.when(inside, F.concat(acc["out"], p)).otherwise(acc["out"]).alias("out"),
                        (acc["closed"] | (depth == 0)).alias("closed"))

    return F.aggregate(_pieces(text), zero, step, lambda a: a["out"])


def outside_brackets(text: Column) -> Column:
    zero = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        depth = acc["depth"] + (p == "(").cast("int") - (p == ")").cast("int")
        return F.struct(depth.alias("depth"), F.when(acc["depth"] == 0, F.concat(acc["out"], p)).otherwise(acc["out"]).alias("out"))

    return F.when(text.contains("("), F.aggregate(_pieces(text), zero, step, lambda a: a["out"])).otherwise(text)


# relations that the same command serves; of a sequence only these sub-commands do
_ALTERED = "TABLE|FOREIGN TABLE|MATERIALIZED VIEW|VIEW|INDEX"
_SEQUENCE = rf"SEQUENCE(?= (?:IF EXISTS )?(?:{NAME} ?\. ?)?{NAME} (?:OWNER TO|SET LOGGED|SET UNLOGGED)\b)"
_TABLE_HEAD = rf"^ALTER (?:{_ALTERED}|{_SEQUENCE}) (?:IF EXISTS )?(?:ONLY )?{REL}(?: ?\*)? "
# a WITH list without what its brackets hold, see `outside_brackets`
_QUERY_NAME = rf"{NAME} ?(?:\( ?)?AS (?:(?:NOT )?MATERIALIZED )?\( ?"
_WITH_LIST = rf"^WITH (?:RECURSIVE )?{_QUERY_NAME}(?:, ?{_QUERY_NAME})*(?=(?:DELETE|UPDATE)\b)"
_CREATE_TABLE = rf"^CREATE (?:(?:GLOBAL |LOCAL )?(?:TEMP |TEMPORARY )|UNLOGGED )?TABLE (IF NOT EXISTS )?{REL} ?"
_CTAS = _CREATE_TABLE + r"(?:\([^()]*+\) ?)?(?:USING \w+ ?)?(?:WITH \([^()]*+\) ?|WITHOUT OIDS ?)?(?:ON COMMIT [A-Z ]+?)?(?:TABLESPACE \w+ ?)?AS\b"
_MATVIEW = rf"^CREATE MATERIALIZED VIEW (IF NOT EXISTS )?{REL}"
_CREATE_INDEX = rf"^CREATE (?:UNIQUE )?INDEX (CONCURRENTLY )?(IF NOT EXISTS )?(?:(?!ON\b)({NAME}) ?)?ON (?:ONLY )?{REL}"
_RENAME = rf"^ALTER (?:TABLE|VIEW|MATERIALIZED VIEW|INDEX|SEQUENCE|FOREIGN TABLE) (?:IF EXISTS )?(?:ONLY )?{REL}(?: ?\*)? RENAME "
_DROP = r"^DROP (MATERIALIZED VIEW|FOREIGN TABLE|TABLE|INDEX|SCHEMA|TRIGGER|VIEW|SEQUENCE|TYPE|FUNCTION|EXTENSION|POLICY)\b"
_TX = [
    ("rollback_to", r"^ROLLBACK (?:WORK |TRANSACTION )?TO\b"),
    ("begin", r"^BEGIN(?: (?:WORK|TRANSACTION|ISOLATION|READ|NOT|DEFERRABLE)\b.*)?$"),
    ("start", r"^START TRANSACTION\b"),
    ("commit", r"^(?:COMMIT|END)(?: (?:WORK|TRANSACTION|AND)\b.*)?$"),
    ("rollback", r"^(?:ROLLBACK|ABORT)(?: (?:WORK|TRANSACTION|AND)\b.*)?$"),
    ("savepoint", r"^SAVEPOINT\b"),
    ("release", r"^RELEASE\b"),
]
_KINDS = [
    ("rename", _RENAME),
    ("alter_table", rf"{_TABLE_HEAD}(?!SET SCHEMA\b)"),
    ("ctas", _CTAS),
    ("ctas", _MATVIEW),
    ("create_table", _CREATE_TABLE),
    ("create_index", _CREATE_INDEX),
    ("create_enum", r"^CREATE TYPE .+ AS ENUM\b"),
    ("alter_enum", r"^ALTER TYPE .+ (?:ADD|RENAME) VALUE\b"),
    ("create_trigger", r"^CREATE (?:OR REPLACE )?(?:CONSTRAINT )?TRIGGER\b"),
    ("create_function", r"^CREATE (?:OR REPLACE )?(?:FUNCTION|PROCEDURE)\b"),
    ("drop_database", r"^DROP DATABASE\b"),
    ("drop", _DROP),
    ("truncate", r"^TRUNCATE\b"),
    ("delete", r"^DELETE FROM\b"),
    ("update", r"^UPDATE\b"),
    ("vacuum", r"^VACUUM\b"),
    ("reindex", r"^REINDEX\b"),
    ("refresh", r"^REFRESH MATERIALIZED VIEW\b"),
    ("set", r"^(?:SET|RESET)\b"),
    ("select", r"^(?:SELECT|WITH|VALUES)\b"),
]


def _first_match(text: Column, table: list[tuple[str, str]], default: Column) -> Column:
    out: Column | None = None
    for name, pattern in table:
        out = F.when(like(text, pattern), name) if out is None else out.when(like(text, pattern), name)
    assert out is not None
    return out.otherwise(default)


def _kind(text: Column) -> Column:
    """The kind by `_KINDS`; only patterns that begin with the text's first word are tried."""
    by_word: dict[str, list[tuple[str, str]]] = {}
    for name, pattern in _KINDS:
        for word in re.findall("[A-Z]+", re.match(r"\^(?:\(\?:([A-Z|]+)\)|([A-Z]+))", pattern).group(0)):
            by_word.setdefault(word, []).append((name, pattern))

    def of(word: Column) -> Column:
        other = F.lit("other")
        out = F.when(word == "", other)
        for first, table in by_word.items():
            out = out.when(word == first, _first_match(text, table, other))
        return out.otherwise(other)

    return let(F.upper(F.regexp_extract(text, "^[A-Za-z]*", 0)), of)


def statement_facts(statements: DataFrame, text: str = "text") -> DataFrame:
    """one row per statement with its kind, target relation and flags."""
    df = pin(statements, masked=masked(F.col(text)))
    # DELETE and UPDATE after a WITH list are judged from their first word on
    after_with = F.regexp_replace(outside_brackets(F.col("masked")), f"(?is){_WITH_LIST}", "")
    df = pin(df, _main=F.when(like(F.col("masked"), r"^WITH\b.*\b(?:DELETE|UPDATE)\b") & ~like(after_with, r"^WITH\b"), after_with).otherwise(F.col("masked")))
    m = F.col("_main")
    tx = _first_match(m, _TX, F.lit(None).cast("string"))
    df = pin(df, tx_kind=F.when(like(m, r"^(?:BEGIN|START|COMMIT|END|ROLLBACK|ABORT|SAVEPOINT|RELEASE)\b"), tx))
    kind = F.when(F.col("tx_kind").isNotNull(), "transaction").otherwise(_kind(m))
    df = pin(df, kind=kind)
    k = F.col("kind")

    target = {
        "alter_table": (_TABLE_HEAD, 1), "rename": (_RENAME, 1), "create_table": (_CREATE_TABLE, 2),
        "create_index": (_CREATE_INDEX, 4), "truncate": (rf"^TRUNCATE (?:TABLE )?(?:ONLY )?{REL}", 1),
        "delete": (rf"^DELETE FROM (?:ONLY )?{REL}", 1), "update": (rf"^UPDATE (?:ONLY )?{REL}", 1),
        "refresh": (rf"^REFRESH MATERIALIZED VIEW (?:CONCURRENTLY )?{REL}", 1),
        "create_trigger": (rf" ON {REL}", 1),
    }

    def part(offset: int) -> Column:
        out = F.when(
            k == "ctas",
            F.when(like(m, _MATVIEW), pick(m, _MATVIEW, 2 + offset)).otherwise(pick(m, _CREATE_TABLE, 2 + offset)),
        )
        for name, (pattern, group) in target.items():
            out = out.when(k == name, pick(m, pattern, group + offset))
        return ident(out.otherwise(F.lit("")))

    object_type = F.when(k == "drop", F.lower(pick(m, _DROP))).when(
        # null for plain tables
        k == "alter_table", F.nullif(F.lower(pick(m, rf"^ALTER ({_ALTERED}|SEQUENCE)\b")), F.lit("table"))
    ).when(
        k == "rename",
        F.when(like(m, _RENAME + r"TO\b"), F.lower(pick(m, r"^ALTER (MATERIALIZED VIEW|FOREIGN TABLE|\w+)")))
        .when(like(m, _RENAME + r"CONSTRAINT\b"), "constraint")
        .otherwise("column"),
    )
    concurrent = (
        F.when(k == "create_index", pick(m, _CREATE_INDEX, 1) != "")
        .when(k == "drop", like(m, r"^DROP INDEX CONCURRENTLY\b"))
        .when(k == "refresh", like(m, r"^REFRESH MATERIALIZED VIEW CONCURRENTLY\b"))
        .when(k == "reindex", like(m, r"^REINDEX (?:\([^)]*\bCONCURRENTLY\b(?! (?:false|off|0))[^)]*\)|(?:\([^)]*\) )?\w+ CONCURRENTLY\b)"))
        .otherwise(False)
    )
    if_not_exists = (
        F.when(k == "create_index", pick(m, _CREATE_INDEX, 2) != "")
        .when(k.isin("create_table", "ctas"), like(m, r"^CREATE [A-Z ]*IF NOT EXISTS\b"))
        .otherwise(False)
    )
    top = F.when(k.isin("delete", "update"), outside_brackets(m))
    set_name = F.lower(
        F.when(like(m, r"^RESET\b"), pick(m, rf"^RESET ({NAME}(?: ?\. ?{NAME})?)"))
        .otherwise(pick(m, rf"^SET (?:SESSION |LOCAL )?({NAME}(?: ?\. ?{NAME})?)"))
    )
    set_kind = (
        F.when(like(m, r"^RESET ALL$"), "reset_all")
        .when(like(m, r"^RESET\b"), "reset")
        .when(like(m, r"(?:=|\bTO) ?DEFAULT$"), "default")
        .when(like(m, r" FROM CURRENT$"), "current")
        .otherwise("value")
    )
    full = like(m, r"^VACUUM FULL\b") | (
        like(m, r"^VACUUM \([^)]*\bFULL\b[^)]*\)") & ~like(m, r"^VACUUM \([^)]*\bFULL (?:false|off|0)\b[^)]*\)")
    )
    return df.select(
        "*",
        part(0).alias("rel_schema"), part(1).alias("rel_name"), object_type.alias("object_type"),
        concurrent.alias("concurrent"), like(m, r"^DROP [A-Z ]*IF EXISTS\b").alias("if_exists"), if_not_exists.alias("if_not_exists"),
        (k.isin("drop", "truncate") & like(m, r" CASCADE$")).alias("cascade"),
        F.coalesce(like(top, r"\bWHERE\b"), F.lit(False)).alias("has_where"),
        F.when(k == "create_index", ident(pick(m, _CREATE_INDEX, 3))).otherwise("").alias("idx_name"),
        F.when(k == "set", set_name).alias("set_name"), F.when(k == "set", set_kind).alias("set_kind"),
        F.when(k == "vacuum", full).otherwise(False).alias("vacuum_full"),
        F.when(k == "alter_enum", like(m, r" ADD VALUE\b")).otherwise(False).alias("adds_value"),
        F.when(k == "create_enum", dotted(pick(m, rf"^CREATE TYPE ((?:{NAME} ?\. ?)?{NAME})"))).alias("type_name"),
    ).drop("_main")


def dotted(qualified: Column) -> Column:
    names = F.transform(F.regexp_extract_all(qualified, F.lit(NAME), F.lit(0)), ident)
    return F.array_join(names, ".")


# ------------------------------------------------------------------ F02: sub-commands

_CONSTRAINT_HEAD = rf"(?:CONSTRAINT {NAME} ?)?(?:PRIMARY KEY|UNIQUE|CHECK|FOREIGN KEY|EXCLUDE)\b"
_ADD_COLUMN = rf"^ADD (?:COLUMN )?(?:IF NOT EXISTS )?({NAME}) ?(.*)$"
_COMMANDS = [
    ("add_constraint", rf"^ADD {_CONSTRAINT_HEAD}"),
    ("add_column", _ADD_COLUMN),
    ("validate_constraint", r"^VALIDATE CONSTRAINT\b"),
    ("drop_constraint", r"^DROP CONSTRAINT\b"),
    ("alter_type", rf"^ALTER (?:COLUMN )?{NAME} (?:SET DATA )?TYPE\b"),
    ("set_not_null", rf"^ALTER (?:COLUMN )?{NAME} SET NOT NULL$"),
    ("drop_not_null", rf"^ALTER (?:COLUMN )?{NAME} DROP NOT NULL$"),
    ("set_default", rf"^ALTER (?:COLUMN )?{NAME} SET DEFAULT\b"),
    ("drop_default", rf"^ALTER (?:COLUMN )?{NAME} DROP DEFAULT$"),
    ("drop_column", rf"^DROP (?:COLUMN )?(?:IF EXISTS )?{NAME}"),
    ("attach_partition", r"^ATTACH PARTITION\b"),
    ("detach_partition", r"^DETACH PARTITION\b"),
    ("enable_trigger_all", r"^ENABLE TRIGGER ALL$"),
    ("enable_trigger_user", r"^ENABLE TRIGGER USER$"),
    ("enable_trigger", r"^ENABLE TRIGGER\b"),
    ("disable_trigger_all", r"^DISABLE TRIGGER ALL$"),
    ("disable_trigger_user", r"^DISABLE TRIGGER USER$"),
    ("disable_trigger", r"^DISABLE TRIGGER\b"),
]
TRIGGER_SWITCHES = [n for n, _ in _COMMANDS if "trigger" in n]


def _command(text: Column, i: Column) -> Column:
    subtype = _first_match(text, _COMMANDS, F.lit("other"))
    name = (
        F.when(like(text, rf"^ADD {_CONSTRAINT_HEAD}"), pick(text, rf"^ADD CONSTRAINT ({NAME})"))
        .when(like(text, r"^ADD\b"), pick(text, _ADD_COLUMN))
        .when(like(text, r"^ALTER\b"), pick(text, rf"^ALTER (?:COLUMN )?({NAME})"))
        .when(like(text, r"^DROP\b"), pick(text, rf"^DROP (?:COLUMN |CONSTRAINT )?(?:IF EXISTS )?({NAME})"))
        .otherwise(pick(text, rf"^\w+ (?:CONSTRAINT|PARTITION|TRIGGER) ({NAME})"))
    )
    return F.struct(
        (i + 1).alias("ord"), subtype.alias("subtype"), ident(name).alias("name"), text.alias("definition"),
        like(text, r" CONCURRENTLY$").alias("concurrent"),
    )


def add_commands(facts: DataFrame) -> DataFrame:
    """`commands`, one struct per ALTER TABLE sub-command."""
    rest = F.regexp_replace("masked", f"(?is){_TABLE_HEAD}", "")
    empty = F.array().cast(f"array<{COMMAND_FACT}>")
    parts = F.transform(split_top_level(rest), _command)
    return pin(facts, commands=F.when(F.col("kind") == "alter_table", parts).otherwise(empty))


# ------------------------------------------------------------------ F03: columns

_TYPE = (
    r"^((?:double precision|character varying|char varying|national (?:character|char)(?: varying)?|bit varying"
    r"|time(?:stamp)? ?(?:\(\d+\) ?)?with(?:out)? time zone"
    rf"|(?:{NAME} ?\. ?)?{NAME}))(?: ?(\([^)]*\)))?"
)


def _column_fact(context: str, ord: Column, name: Column, rest: Column) -> Column:
    pairs = [F.lit(x) for kv in TYPE_ALIASES.items() for x in kv]

    def named(written: Column) -> Column:
        base = F.trim(F.regexp_replace(F.regexp_replace(F.lower(written), r" ?\(\d+\) ?", " "), " +", " "))
        own = F.transform(F.regexp_extract_all(written, F.lit(NAME), F.lit(0)), ident)
        return let(F.element_at(F.create_map(*pairs), base), lambda alias: F.when(alias.isNotNull(), F.array(F.lit("pg_catalog"), alias)).otherwise(own))

    return let(rest, lambda r: F.struct(
        F.lit(context).alias("context"), ord.alias("ord"), ident(name).alias("name"), let(pick(r, _TYPE), named).alias("type_names"),
        (pick(r, _TYPE, 2) != "").alias("has_modifier"),
    ))


_TABLE_BODY = _CREATE_TABLE + r"(\(.*)$"
_ELEMENT_CONSTRAINT = rf"^(?:{_CONSTRAINT_HEAD}|LIKE\b)"


def add_elements(facts: DataFrame) -> DataFrame:
    """`elements`: the top-level parts of a CREATE TABLE body."""
    empty = F.array().cast("array<string>")
    body = split_top_level(first_brackets(pick(F.col("masked"), _TABLE_BODY, 4)))
    return pin(facts, elements=F.when(F.col("kind") == "create_table", body).otherwise(empty))


def add_columns(facts: DataFrame) -> DataFrame:
    """`columns` from CREATE TABLE, ADD COLUMN and ALTER COLUMN TYPE."""
    created = F.transform(
        F.filter("elements", lambda e: (e != "") & ~like(e, _ELEMENT_CONSTRAINT)),
        lambda e, i: _column_fact("create", i + 1, pick(e, rf"^({NAME})"), pick(e, rf"^{NAME} ?(.*)$")),
    )
    altered = F.transform(
        F.filter("commands", lambda c: c["subtype"].isin("add_column", "alter_type")),
        lambda c: F.when(c["subtype"] == "add_column", _column_fact("add", c["ord"], pick(c["definition"], _ADD_COLUMN), pick(c["definition"], _ADD_COLUMN, 2)))
        .otherwise(_column_fact("alter_type", c["ord"], pick(c["definition"], rf"^ALTER (?:COLUMN )?({NAME})"),
                                pick(c["definition"], rf"^ALTER (?:COLUMN )?{NAME} (?:SET DATA )?TYPE (.*)$"))),
    )
    return pin(facts, columns=F.concat(created, altered).cast(f"array<{COLUMN_FACT}>"))


# ------------------------------------------------------------------ F04: constraints



def _constraint(context: str, ord: Column, contype: Column | str, **given: Column) -> Column:
    false, text = F.lit(False), F.lit(None).cast("string")
    value = {
        "context": F.lit(context), "ord": ord, "contype": F.lit(contype) if isinstance(contype, str) else contype,
        "name": F.lit(""), "skip_validation": false, "initially_valid": false, "index_name": F.lit(""),
        "generated_when": text, "default_kind": text, "default_schema": text, "default_function": text, **given,
    }
    return F.struct(*[v.alias(k) for k, v in value.items()])


def _table_constraint(context: str, ord: Column, text: Column) -> Column:
    contype = (
        F.when(like(text, rf"^(?:CONSTRAINT {NAME} ?)?PRIMARY KEY"), "primary")
        .when(like(text, rf"^(?:CONSTRAINT {NAME} ?)?UNIQUE"), "unique")
        .when(like(text, rf"^(?:CONSTRAINT {NAME} ?)?CHECK"), "check")
        .when(like(text, rf"^(?:CONSTRAINT {NAME} ?)?FOREIGN KEY"), "foreign")
        .when(like(text, rf"^(?:CONSTRAINT {NAME} ?)?EXCLUDE"), "exclusion")
    )
    skip = like(text, r" NOT VALID\b")
    checked = contype.isin("check", "foreign")
    return _constraint(
        context, ord, contype, name=ident(pick(text, rf"^CONSTRAINT ({NAME})")), skip_validation=checked & skip,
        initially_valid=checked & ~skip, index_name=ident(pick(text, rf"\bUSING INDEX ({NAME})")),
    )


# constants, casts of constants, and zero-argument calls
_CONSTANT = r"^\(*(?:[eEbBxX]?''|[+-]?[0-9.][0-9._eE+-]*|true|false|null)\)*(?: ?:: ?[\w\" .\[\]]+(?:\(\d+(?:, ?\d+)?\))?)*$"
_CALL = rf"^(?:({NAME}) ?\. ?)?({NAME}) ?\( ?\)$"
_DEFAULT_END = r"(?: (?:NOT NULL|NULL|UNIQUE|PRIMARY KEY|CHECK|REFERENCES|CONSTRAINT|GENERATED|COLLATE)\b.*)?$"


def _inline_constraints(ord: Column, rest: Column) -> Column:
    """What follows a new column's type; each part of the text is cut out once."""
    after_type = F.regexp_replace(rest, f"(?is){_TYPE}", "")
    return let(after_type, lambda after: let(outside_brackets(after), lambda flat: _found_inline(ord, after, flat)))


def _default(ord: Column, default: Column) -> Column:
    kind = F.when(like(default, _CONSTANT), "constant").when(like(default, _CALL), "function").otherwise("expression")
    return let(kind, lambda k: _constraint(
        "add_column", ord, "default", default_kind=k,
        default_schema=F.when(k == "function", ident(pick(default, _CALL))),
        default_function=F.when(k == "function", ident(pick(default, _CALL, 2)))))


def _found_inline(ord: Column, after_type: Column, flat: Column) -> Column:
    none = F.lit(None).cast(CONSTRAINT_FACT)
    default = F.trim(pick(after_type, rf"\bDEFAULT (.*?){_DEFAULT_END}"))
    generated = like(flat, r"\bGENERATED ALWAYS AS ?(?!IDENTITY)") & ~like(flat, r"\bGENERATED ALWAYS AS IDENTITY\b")
    found = [
        (like(flat, r"\bNOT NULL\b"), _constraint("add_column", ord, "not_null")),
        (like(flat, r"\bDEFAULT\b"), let(default, lambda d: _default(ord, d))),
        (generated, _constraint("add_column", ord, "generated", generated_when=F.lit("a"))),
        (like(flat, r"\bREFERENCES\b"), _constraint("add_column", ord, "foreign", initially_valid=F.lit(True))),
        (like(flat, r"\bCHECK\b"), _constraint("add_column", ord, "check", initially_valid=F.lit(True))),
        (like(flat, r"\bUNIQUE\b"), _constraint("add_column", ord, "unique")),
        (like(flat, r"\bPRIMARY KEY\b"), _constraint("add_column", ord, "primary")),
    ]
    rows = F.array(*[F.when(hit, value.cast(CONSTRAINT_FACT)).otherwise(none) for hit, value in found])
    return F.filter(rows, lambda c: c.isNotNull())


def add_constraints(facts: DataFrame) -> DataFrame:
    """`constraints` added by commands, given inline with a new column, or in a CREATE TABLE body."""
    empty = F.array().cast(f"array<{CONSTRAINT_FACT}>")
    created = F.transform(
        F.filter("elements", lambda e: like(e, rf"^{_CONSTRAINT_HEAD}")), lambda e, i: _table_constraint("create", i + 1, e)
    ).cast(f"array<{CONSTRAINT_FACT}>")
    altered = F.flatten(
        F.transform(
            "commands",
            lambda c: F.when(
                c["subtype"] == "add_constraint",
                F.array(_table_constraint("add_constraint", c["ord"], F.regexp_replace(c["definition"], r"(?i)^ADD ", "")).cast(CONSTRAINT_FACT)),
            )
            .when(c["subtype"] == "add_column", _inline_constraints(c["ord"], pick(c["definition"], _ADD_COLUMN, 2)))
            .otherwise(empty),
        )
    )
    return pin(facts, constraints=F.concat(created, altered))


ARRAYS = ("commands", "columns", "constraints")


def extract(statements: DataFrame, text: str = "text", arrays: Collection[str] = ARRAYS) -> DataFrame:
    """The facts of a statement table, in one pass over its text; of the arrays only those asked for."""
    df = statement_facts(statements, text)
    if arrays:
        df = add_commands(df)
    if "columns" in arrays or "constraints" in arrays:
        df = add_elements(df)
    if "columns" in arrays:
        df = add_columns(df)
    if "constraints" in arrays:
        df = add_constraints(df)
    return df.drop("elements", *[a for a in ARRAYS if a not in arrays])


# ------------------------------------------------------------------ F05: mentions

_MENTION = rf"(?is)\b(?:FROM|JOIN|INTO|UPDATE|TABLE(?: IF EXISTS| IF NOT EXISTS| CONCURRENTLY)?(?: ONLY)?|REFERENCES) (?!SELECT\b|ONLY\b|ON\b|OF\b|SET\b|NOWAIT\b|SKIP\b|\()((?:{NAME} ?\. ?)?{NAME}(?:(?: AS)? (?!AS\b|ON\b|WHERE\b|SET\b|USING\b|JOIN\b|LEFT\b|RIGHT\b|FULL\b|INNER\b|CROSS\b|NATURAL\b|GROUP\b|ORDER\b|LIMIT\b|UNION\b|VALUES\b|SELECT\b|RETURNING\b|HAVING\b|ADD\b|DROP\b|ALTER\b|RENAME\b|VALIDATE\b|ATTACH\b|DETACH\b|ENABLE\b|DISABLE\b|DEFAULT\b|CASCADE\b|RESTRICT\b|OWNER\b|REPLICA\b|INHERIT\b|NO\b|FORCE\b|NOT\b|WINDOW\b|FOR\b|OFFSET\b|FETCH\b|EXCEPT\b|INTERSECT\b|TABLESAMPLE\b){NAME})?)"
_SELECT_LIST = r"^SELECT (?:DISTINCT )?(.*?) FROM\b"
_WHERE_COLUMN = rf"(?is)((?:{NAME} ?\. ?)?{NAME}) ?(?:=|<>|!=|<=|>=|<|>| IN\b| IS\b| LIKE\b| BETWEEN\b)"


def mentions(statements: DataFrame, text: str = "text") -> DataFrame:
    """relations, aliases and columns each statement names: clause, schema, name, alias."""
    df = pin(statements.select("script_id", "stmt_no", text), masked=masked(F.col(text)))
    m = F.col("masked")
    pairs = F.transform(
        F.regexp_extract_all(m, F.lit(_MENTION), F.lit(1)),
        lambda r: F.struct(
            F.lit("relation").alias("clause"),
            ident(pick(r, rf"^({NAME}) ?\. ?{NAME}")).alias("schema"),
            ident(F.coalesce(F.nullif(pick(r, rf"^{NAME} ?\. ?({NAME})"), F.lit("")), pick(r, rf"^({NAME})"))).alias("name"),
            ident(pick(r, rf"^(?:{NAME} ?\. ?)?{NAME} (?:AS )?({NAME})$")).alias("alias"),
        ),
    )

    def column(clause: str):
        return lambda c: F.struct(
            F.lit(clause).alias("clause"), F.lit("").alias("schema"),
            ident(pick(c, rf"({NAME})$")).alias("name"), ident(pick(c, rf"^({NAME}) ?\. ?{NAME}$")).alias("alias"),
        )

    selected = F.filter(
        F.transform(split_top_level(pick(m, _SELECT_LIST)), lambda c: F.regexp_replace(c, r"(?is) (?:AS )?\S+$", "")),
        lambda c: like(c, rf"^(?:{NAME} ?\. ?)?{NAME}$"),
    )
    where = F.regexp_extract_all(pick(m, r"\bWHERE (.*)$"), F.lit(_WHERE_COLUMN), F.lit(1))
    found = F.concat(pairs, F.transform(selected, column("select")), F.transform(where, column("where")))
    return df.select("script_id", "stmt_no", F.inline(F.array_distinct(found)))
