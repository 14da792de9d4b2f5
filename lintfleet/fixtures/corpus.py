"""Migration scripts derived from `orders`: one statement per order, one script per customer.

Each template holds a statement's text and, written down by hand, the facts it should yield. The Spark side works
from the text; the checking SQL works from the written facts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintfleet.fixtures.relations import source
from lintfleet.session import dealt


@dataclass
class Template:
    text: str
    kind: str
    target: bool = False
    tx_kind: str | None = None
    object_type: str | None = None
    concurrent: bool = False
    if_exists: bool = False
    if_not_exists: bool = False
    cascade: bool = False
    has_where: bool = False
    idx_name: str = ""
    set_name: str | None = None
    set_kind: str | None = None
    vacuum_full: bool = False
    adds_value: bool = False
    type_name: str | None = None
    fixed_rel: tuple[str, str] | None = None
    commands: list[tuple[str, str, bool]] = field(default_factory=list)  # subtype, name, concurrent
    columns: list[tuple[str, int, str, str, bool]] = field(default_factory=list)  # context, ord, name, types, modifier
    # context, ord, contype, name, skip, valid, index, generated, default kind, default function
    constraints: list[tuple[str, int, str, str, bool, bool, str, str | None, str | None, str | None]] = field(default_factory=list)


def tx(text: str, kind: str) -> Template:
    return Template(text, "transaction", tx_kind=kind)


def setting(text: str, name: str, kind: str) -> Template:
    return Template(text, "set", set_name=name, set_kind=kind)


def alter(rest: str, *commands: tuple, columns: list = [], constraints: list = []) -> Template:  # noqa: B006
    cmds = [(c[0], c[1], len(c) > 2 and c[2]) for c in commands]
    return Template("ALTER TABLE {t} " + rest, "alter_table", True, commands=cmds, columns=list(columns), constraints=list(constraints))


def con(context: str, ord: int, contype: str, name: str = "", skip: bool = False, valid: bool = False, index: str = "",
        generated: str | None = None, default: str | None = None, function: str | None = None):
    return (context, ord, contype, name, skip, valid, index, generated, default, function)


def added(ord: int, name: str, types: str, modifier: bool = False):
    return ("add", ord, name, types, modifier)


def table(text: str, **kw) -> Template:
    return Template(text, "create_table", True, **kw)


def index(text: str, name: str, concurrent: bool = False, guarded: bool = False) -> Template:
    return Template(text, "create_index", True, concurrent=concurrent, if_not_exists=guarded, idx_name=name)


def drop(text: str, kind: str, **kw) -> Template:
    return Template(text, "drop", object_type=kind, **kw)


PG = "pg_catalog."
TEMPLATES: list[Template] = [
    tx("BEGIN", "begin"),
    tx("COMMIT", "commit"),
    tx("ROLLBACK", "rollback"),
    tx("SAVEPOINT s1", "savepoint"),
    tx("ROLLBACK TO s1", "rollback_to"),
    tx("START TRANSACTION", "start"),
    tx("RELEASE SAVEPOINT s1", "release"),
    setting("SET lock_timeout = '2s'", "lock_timeout", "value"),
    setting("SET LOCAL statement_timeout TO 5000", "statement_timeout", "value"),
    setting("set idle_in_transaction_session_timeout = '10s'", "idle_in_transaction_session_timeout", "value"),
    setting("RESET lock_timeout", "lock_timeout", "reset"),
    setting("RESET ALL", "all", "reset_all"),
    setting("SET LOCK_TIMEOUT TO DEFAULT", "lock_timeout", "default"),
    table(
        "CREATE TABLE {t} (\n  id serial PRIMARY KEY, -- key, first\n  code char(3) NOT NULL,\n  label varchar(20) DEFAULT 'a,b',\n"
        "  doc json,\n  seen timestamp,\n  n integer DEFAULT 0,\n  s smallint,\n  price numeric(10, 2)\n)",
        columns=[("create", 1, "id", "serial", False), ("create", 2, "code", PG + "bpchar", True),
                 ("create", 3, "label", PG + "varchar", True), ("create", 4, "doc", PG + "json", False),
                 ("create", 5, "seen", PG + "timestamp", False), ("create", 6, "n", PG + "int4", False),
                 ("create", 7, "s", PG + "int2", False), ("create", 8, "price", PG + "numeric", True)],
    ),
    table("CREATE TABLE IF NOT EXISTS {t} (id bigint GENERATED ALWAYS AS IDENTITY, body text, at timestamp with time zone)", if_not_exists=True,
          columns=[("create", 1, "id", PG + "int8", False), ("create", 2, "body", "text", False), ("create", 3, "at", PG + "timestamptz", False)]),
    Template("CREATE TABLE {t} AS SELECT 1 AS a", "ctas", True),
    index("CREATE INDEX ix_a ON {t} (code)", "ix_a"),
    index("CREATE INDEX CONCURRENTLY ix_b ON {t} (code)", "ix_b", True),
    index("CREATE INDEX CONCURRENTLY IF NOT EXISTS ix_c ON {t} USING btree (lower(code))", "ix_c", True, True),
    index("CREATE UNIQUE INDEX CONCURRENTLY ON {t} (code)", "", True),
    Template("CREATE TYPE app.mood AS ENUM ('a', 'b')", "create_enum", type_name="app.mood"),
    Template("CREATE TRIGGER trg BEFORE INSERT OR UPDATE ON {t} FOR EACH ROW EXECUTE FUNCTION f()", "create_trigger", True),
    table("CREATE TABLE {t} (a int, EXCLUDE USING gist (a WITH =), CONSTRAINT u UNIQUE (a))",
          columns=[("create", 1, "a", PG + "int4", False)],
          constraints=[con("create", 1, "exclusion"), con("create", 2, "unique", "u")]),
    Template("ALTER TYPE app.mood ADD VALUE 'c'", "alter_enum", adds_value=True),
    Template("ALTER TYPE app.mood RENAME VALUE 'a' TO 'z'", "alter_enum"),
    alter("ADD COLUMN note text", ("add_column", "note"), columns=[added(1, "note", "text")]),
    alter("ADD COLUMN kind int NOT NULL", ("add_column", "kind"), columns=[added(1, "kind", PG + "int4")], constraints=[con("add_column", 1, "not_null")]),
    alter("ADD COLUMN kind int NOT NULL DEFAULT 0", ("add_column", "kind"), columns=[added(1, "kind", PG + "int4")],
          constraints=[con("add_column", 1, "not_null"), con("add_column", 1, "default", default="constant")]),
    alter("ADD COLUMN at timestamptz DEFAULT now()", ("add_column", "at"), columns=[added(1, "at", "timestamptz")],
          constraints=[con("add_column", 1, "default", default="function", function="now")]),
    alter("ADD COLUMN k text DEFAULT fn_0()", ("add_column", "k"), columns=[added(1, "k", "text")],
          constraints=[con("add_column", 1, "default", default="function", function="fn_0")]),
    alter("ADD COLUMN total int GENERATED ALWAYS AS (a + b) STORED", ("add_column", "total"), columns=[added(1, "total", PG + "int4")],
          constraints=[con("add_column", 1, "generated", generated="a")]),
    alter("ADD COLUMN seq bigserial", ("add_column", "seq"), columns=[added(1, "seq", "bigserial")]),
    alter("ADD COLUMN owner_id bigint REFERENCES users (id)", ("add_column", "owner_id"), columns=[added(1, "owner_id", PG + "int8")],
          constraints=[con("add_column", 1, "foreign", valid=True)]),
    alter("ADD COLUMN email varchar(100) UNIQUE", ("add_column", "email"), columns=[added(1, "email", PG + "varchar", True)],
          constraints=[con("add_column", 1, "unique")]),
    alter("ADD COLUMN pk int PRIMARY KEY", ("add_column", "pk"), columns=[added(1, "pk", PG + "int4")], constraints=[con("add_column", 1, "primary")]),
    alter("DROP COLUMN note", ("drop_column", "note")),
    alter("ALTER COLUMN n TYPE bigint", ("alter_type", "n"), columns=[("alter_type", 1, "n", PG + "int8", False)]),
    alter("ALTER COLUMN n SET DATA TYPE text", ("alter_type", "n"), columns=[("alter_type", 1, "n", "text", False)]),
    alter("ALTER n TYPE varchar(10) USING n::varchar", ("alter_type", "n"), columns=[("alter_type", 1, "n", PG + "varchar", True)]),
    alter("ALTER COLUMN n TYPE numeric", ("alter_type", "n"), columns=[("alter_type", 1, "n", PG + "numeric", False)]),
    alter("ALTER COLUMN n SET NOT NULL", ("set_not_null", "n")),
    alter("ALTER COLUMN n DROP NOT NULL", ("drop_not_null", "n")),
    alter("ADD CONSTRAINT ck CHECK (n > 0)", ("add_constraint", "ck"), constraints=[con("add_constraint", 1, "check", "ck", valid=True)]),
    alter("ADD CONSTRAINT ck2 CHECK (n > 0) NOT VALID", ("add_constraint", "ck2"), constraints=[con("add_constraint", 1, "check", "ck2", skip=True)]),
    alter("ADD CONSTRAINT fk FOREIGN KEY (a) REFERENCES users (id)", ("add_constraint", "fk"),
          constraints=[con("add_constraint", 1, "foreign", "fk", valid=True)]),
    alter("ADD CONSTRAINT fk2 FOREIGN KEY (a, b) REFERENCES users (id, x) NOT VALID", ("add_constraint", "fk2"),
          constraints=[con("add_constraint", 1, "foreign", "fk2", skip=True)]),
    alter("VALIDATE CONSTRAINT ck2", ("validate_constraint", "ck2")),
    alter('VALIDATE CONSTRAINT "FK2"', ("validate_constraint", "FK2")),
    alter("ADD CONSTRAINT uq UNIQUE (a)", ("add_constraint", "uq"), constraints=[con("add_constraint", 1, "unique", "uq")]),
    alter("ADD CONSTRAINT uq2 UNIQUE USING INDEX ix_b", ("add_constraint", "uq2"), constraints=[con("add_constraint", 1, "unique", "uq2", index="ix_b")]),
    alter("ADD CONSTRAINT pk PRIMARY KEY (id)", ("add_constraint", "pk"), constraints=[con("add_constraint", 1, "primary", "pk")]),
    alter("ADD CONSTRAINT pk2 PRIMARY KEY USING INDEX ix_b", ("add_constraint", "pk2"), constraints=[con("add_constraint", 1, "primary", "pk2", index="ix_b")]),
    alter("ADD CONSTRAINT ex EXCLUDE USING gist (a WITH &&)", ("add_constraint", "ex"), constraints=[con("add_constraint", 1, "exclusion", "ex")]),
    alter("ATTACH PARTITION p1 FOR VALUES IN (1, 2)", ("attach_partition", "p1")),
    alter("DETACH PARTITION p1", ("detach_partition", "p1")),
    alter("DETACH PARTITION p1 CONCURRENTLY", ("detach_partition", "p1", True)),
    alter("ENABLE TRIGGER trg", ("enable_trigger", "trg")),
    alter("DISABLE TRIGGER ALL", ("disable_trigger_all", "all")),
    alter("ENABLE TRIGGER USER", ("enable_trigger_user", "user")),
    alter("ADD COLUMN a smallint, -- first, of four\n  DROP COLUMN b, ADD COLUMN c char(2) DEFAULT 'x,y', ALTER COLUMN d TYPE timestamp",
          ("add_column", "a"), ("drop_column", "b"), ("add_column", "c"), ("alter_type", "d"),
          columns=[added(1, "a", PG + "int2"), added(3, "c", PG + "bpchar", True), ("alter_type", 4, "d", PG + "timestamp", False)],
          constraints=[con("add_column", 3, "default", default="constant")]),
    Template("ALTER TABLE {t} RENAME COLUMN a TO b", "rename", True, object_type="column"),
    Template("ALTER TABLE {t} RENAME TO newer", "rename", True, object_type="table"),
    drop("DROP TABLE {t}", "table"),
    drop("DROP TABLE IF EXISTS {t} CASCADE", "table", if_exists=True, cascade=True),
    drop("DROP INDEX ix_a", "index"),
    drop("DROP INDEX CONCURRENTLY ix_a", "index", concurrent=True),
    drop("DROP INDEX CONCURRENTLY IF EXISTS ix_a", "index", concurrent=True, if_exists=True),
    drop("DROP SCHEMA app CASCADE", "schema", cascade=True),
    drop("DROP TRIGGER trg ON {t}", "trigger"),
    Template("DROP DATABASE old", "drop_database"),
    drop("DROP MATERIALIZED VIEW mv", "materialized view"),
    Template("TRUNCATE {t}", "truncate", True),
    Template("TRUNCATE TABLE {t} CASCADE", "truncate", True, cascade=True),
    Template("DELETE FROM {t}", "delete", True),
    Template("DELETE FROM {t} WHERE id = 1", "delete", True, has_where=True),
    Template("UPDATE {t} SET a = (SELECT max(x) FROM users WHERE y = 1)", "update", True),
    Template("UPDATE {t} SET a = 'x WHERE y' WHERE id = 2", "update", True, has_where=True),
    Template("VACUUM FULL {t}", "vacuum", vacuum_full=True),
    Template("VACUUM (FULL false, ANALYZE) {t}", "vacuum"),
    Template("VACUUM (VERBOSE, FULL) {t}", "vacuum", vacuum_full=True),
    Template("REINDEX TABLE {t}", "reindex"),
    Template("REINDEX TABLE CONCURRENTLY {t}", "reindex", concurrent=True),
    Template("REINDEX (CONCURRENTLY) INDEX ix_a", "reindex", concurrent=True),
    Template("REFRESH MATERIALIZED VIEW mv", "refresh", fixed_rel=("", "mv")),
    Template("REFRESH MATERIALIZED VIEW CONCURRENTLY mv", "refresh", concurrent=True, fixed_rel=("", "mv")),
    Template("SELECT a, u.b FROM {t} u WHERE u.c = 1", "select"),
    Template("CREATE FUNCTION add1(a int, b text[]) RETURNS int LANGUAGE sql AS $$ SELECT 1; SELECT a FROM users $$", "create_function"),
]
N = len(TEMPLATES)

# name in the text, schema and name after folding
TARGETS = [("users", "", "users"), ("app.items", "app", "items"), ('"Audit Log"', "", "Audit Log"),
           ("public.orders", "public", "orders"), ("USERS", "", "users")]

# Comment lines before a statement, chosen by order key.
COMMENTS = [
    "-- pgls-ignore lint/safety/banDropTable: legacy\n",
    "-- pgt-ignore lint/safety\n",
    "-- pgls-ignore-start lint/safety/banDropColumn: begin\n",
    "-- pgls-ignore-end lint/safety/banDropColumn\n",
    "-- pgls-ignore-all lint/safety/preferTextField\n",
    "-- pgls-ignoreX lint\n",
    "-- pgls-ignore\n",
    "-- pgls-ignore lint/safety/noSuchRule: typo\n",
    "-- plain comment\n",
    "-- pgls-ignore lint/safety/banDropTable\n-- pgls-ignore lint/safety/banTruncate: two: lines\n",
    "  -- pgls-ignore-start lint  \n",
    "-- pgls-ignore-end lint\n",
    "", "", "", "", "", "", "",
]
HEADERS = ["-- pgls-ignore-all lint/safety/preferJsonb\n\n-- pgls-ignore-all lint/safety/banTruncate: top\n", "\n-- header\n", "\\set x 1\n", ""]


def _literal(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return str(value)
    text = str(value).replace("'", "''")
    parts = text.split("\n")
    return "concat(" + ", chr(10), ".join(f"'{p}'" for p in parts) + ")" if len(parts) > 1 else f"'{text}'"


def _values(name: str, columns: list[str], rows: list[tuple]) -> str:
    body = ",\n".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return f"{name}({', '.join(columns)}) as (values {body})"


FACT_FIELDS = ["kind", "tx_kind", "object_type", "concurrent", "if_exists", "if_not_exists", "cascade", "has_where", "idx_name",
               "set_name", "set_kind", "vacuum_full", "adds_value", "type_name"]


def _template_rows() -> list[tuple]:
    rows = []
    for i, t in enumerate(TEMPLATES):
        fixed = t.fixed_rel or (None, None)
        rows.append((i, t.text, t.target, fixed[0], fixed[1], t.kind != "transaction", *[getattr(t, f) for f in FACT_FIELDS]))
    return rows


SCRIPT_SQL = f"""
{_values("tmpl", ["tid", "template", "has_target", "fixed_schema", "fixed_name", "may_lack_semicolon", *FACT_FIELDS], _template_rows())},
{_values("tbl", ["tno", "target", "tschema", "tname"], [(i, *t) for i, t in enumerate(TARGETS)])},
{_values("cmt", ["cno", "prefix"], list(enumerate(COMMENTS)))},
{_values("hdr", ["hno", "header"], list(enumerate(HEADERS)))},
{_values("tmpl_cmd", ["tid", "ord", "subtype", "name", "detach_concurrent"],
         [(i, j + 1, *c) for i, t in enumerate(TEMPLATES) for j, c in enumerate(t.commands)])},
{_values("tmpl_col", ["tid", "context", "ord", "name", "type_names", "has_modifier"], [(i, *c) for i, t in enumerate(TEMPLATES) for c in t.columns])},
{_values("tmpl_con", ["tid", "context", "ord", "contype", "name", "skip_validation", "initially_valid", "index_name", "generated_when", "default_kind", "default_function"],
         [(i, *c) for i, t in enumerate(TEMPLATES) for c in t.constraints])},
stmt as (
  select o_custkey script_id, o_orderkey pos, cast(o_custkey % 5 as int) db_id, p.*, g.target,
    case when has_target then tschema else coalesce(fixed_schema, '') end rel_schema,
    case when has_target then tname else coalesce(fixed_name, '') end rel_name,
    replace(template, '{{t}}', g.target) as body, c.prefix,
    case when may_lack_semicolon and o_orderkey % 3 = 2 then '' else ';' end ender,
    case when may_lack_semicolon and o_orderkey % 3 = 2 then concat(chr(10), chr(10)) else chr(10) end gap
  from orders join tmpl p on p.tid = o_orderkey % {N} join tbl g on g.tno = cast(floor(o_orderkey / {N}) as bigint) % {len(TARGETS)}
  join cmt c on c.cno = o_orderkey % {len(COMMENTS)}),
script as (
  select script_id, concat(min(h.header), string_agg(concat(prefix, body, ender, gap), '' order by pos)) content
  from stmt join hdr h on h.hno = script_id % {len(HEADERS)} group by script_id),
cmd as (select s.script_id, s.pos, s.rel_schema, s.rel_name, c.* from stmt s join tmpl_cmd c on c.tid = s.tid),
col as (select s.script_id, s.pos, c.* from stmt s join tmpl_col c on c.tid = s.tid),
con as (select s.script_id, s.pos, s.rel_schema, s.rel_name, c.* from stmt s join tmpl_con c on c.tid = s.tid)"""


STATEMENTS_PER_TASK = 25_000  # text work takes about half a millisecond a statement


def statements(spark: SparkSession, sf_dir: str, by_script: bool = False) -> DataFrame:
    """(script_id, pos, db_id, text) plus the pieces a script is put together from; `by_script` keeps a script's in one task."""
    templates = spark.createDataFrame(
        [(i, t.text, t.kind != "transaction") for i, t in enumerate(TEMPLATES)], "tid int, template string, may_lack boolean"
    )
    targets = spark.createDataFrame([(i, t[0]) for i, t in enumerate(TARGETS)], "tno int, target string")
    comments = spark.createDataFrame(list(enumerate(COMMENTS)), "cno int, prefix string")
    dealing = ["o_custkey"] if by_script else []
    orders = dealt(source(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), *dealing, rows=STATEMENTS_PER_TASK).select(
        F.col("o_custkey").alias("script_id"), F.col("o_orderkey").alias("pos"), (F.col("o_custkey") % 5).cast("int").alias("db_id"),
        (F.col("o_orderkey") % N).cast("int").alias("tid"),
        (F.floor(F.col("o_orderkey") / N) % len(TARGETS)).cast("int").alias("tno"),
        (F.col("o_orderkey") % len(COMMENTS)).cast("int").alias("cno"),
    )
    open_end = F.col("may_lack") & (F.col("pos") % 3 == 2)
    return (
        orders.join(F.broadcast(templates), "tid").join(F.broadcast(targets), "tno").join(F.broadcast(comments), "cno")
        .select(
            "script_id", "pos", "db_id", F.replace("template", F.lit("{t}"), F.col("target")).alias("text"), "prefix",
            F.when(open_end, "\n\n").otherwise(";\n").alias("ending"),
        )
    )


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(script_id, path, content): whole script texts."""
    headers = spark.createDataFrame(list(enumerate(HEADERS)), "hno int, header string")
    parts = statements(spark, sf_dir, by_script=True).select("script_id", "pos", F.concat("prefix", "text", "ending").alias("part"))
    bodies = parts.groupBy("script_id").agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("parts"))
    joined = bodies.withColumn("hno", (F.col("script_id") % len(HEADERS)).cast("int")).join(F.broadcast(headers), "hno")
    content = F.concat("header", F.array_join(F.transform("parts", lambda p: p["part"]), ""))
    return joined.select("script_id", script_path(F.col("script_id")).alias("path"), content.alias("content"))


def script_path(script_id):
    return F.concat(F.lit("migrations/"), F.lpad(script_id.cast("string"), 6, "0"), F.lit("_change.sql"))


PATH_SQL = "concat('migrations/', lpad(cast(script_id as varchar), 6, '0'), '_change.sql')"
