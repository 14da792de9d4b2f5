"""Tokens, statements, facts and mentions."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lintfleet.plans import facts as FX
from lintfleet.plans import statements as ST
from lintfleet.plans import tokens as TK

PIECES = ["select", " ", "\n", "\n\n", "\r\n", ";", "'a''b'", "'open", '"Q ""x"', "$$ b; c $$", "$t$ $$ $t$", "-- note", "/* a /* b */ c */", "(", ")", "é", "п", "1.5e3", ":p", "::", "$1", "begin", "end", "case",
          "insert into t", "with x as", "create table t", "alter table t", "\\set a", ",", "E'x'", "\t"]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=40).map("".join), min_size=15, max_size=15))
def test_tokens_tile_and_statements_lie_in_the_text(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "script_id int, content string")
    tokens = TK.tokens(df, ["script_id"], "content").collect()
    for i, text in enumerate(texts):
        mine = sorted((t for t in tokens if t.script_id == i), key=lambda t: t.ord)
        assert "".join(t.token for t in mine) == text
        at = 0
        for t in mine:
            assert t.start_byte == at and t.end_byte == at + len(t.token.encode())
            at = t.end_byte
    last = {}
    for s in ST.split_statements(df, ["script_id"], "content").orderBy("script_id", "stmt_no").collect():
        data = texts[s.script_id].encode()
        assert data[s.start_byte : s.end_byte].decode() == s.text
        assert s.start_byte >= last.get(s.script_id, 0)
        last[s.script_id] = s.end_byte
        lines = texts[s.script_id].encode()[: s.start_byte].decode()
        assert s.start_line == len(__import__("re").findall(r"\r\n|\n|\r", lines))


SPLITS = [
    ("select 1; select 2\n\nselect 3", ["select 1;", "select 2", "select 3"]),
    ("insert into t select 1\nselect 2", ["insert into t select 1\nselect 2"]),
    ("create view v as select 1\nselect 2", ["create view v as select 1", "select 2"]),
    ("select a,\n\nb from c", ["select a,\n\nb from c"]),
    ("begin;\nupdate t set a = 1;\ncommit;", ["begin;", "update t set a = 1;", "commit;"]),
    ("create function f() returns int begin atomic select 1; select 2; end;\nselect 3", ["create function f() returns int begin atomic select 1; select 2; end;", "select 3"]),
    ("select case when a then b end; select 2", ["select case when a then b end;", "select 2"]),
    ("grant select, insert on t to x; select 1", ["grant select, insert on t to x;", "select 1"]),
    ("\\set x 1\nselect 1\n\\echo done", ["select 1"]),
    ("-- only a comment\n", []),
    ("alter table t add column x timestamp with time zone;", ["alter table t add column x timestamp with time zone;"]),
    ("explain analyze select 1; select 2", ["explain analyze select 1;", "select 2"]),
    ("with a as (select 1; 2) select * from a;select 2", ["with a as (select 1; 2) select * from a;", "select 2"]),
    ("select 1 -- tail\n\n-- lead\nselect 2", ["select 1", "select 2"]),
    ("create trigger a before insert or update on t", ["create trigger a before insert or update on t"]),
    ("merge into a using b on c when matched then update set x = 1; select 1", ["merge into a using b on c when matched then update set x = 1;", "select 1"]),
]


def test_split(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SPLITS)], "id int, c string")
    got = ST.split_statements(df, ["id"], "c").orderBy("id", "stmt_no").collect()
    for i, (_, want) in enumerate(SPLITS):
        assert [r.text for r in got if r.id == i] == want


def test_split_of_a_long_script_in_blocks(spark):
    """Several fold blocks give the same statements as short scripts do."""
    part = "select a, b from t where x = 'it''s';\nalter table t add column y int default 3;\nupdate t set a = (select 1; 2)\n\n"
    df = spark.createDataFrame([(1, part * 300)], "id int, c string")
    texts = [r.text for r in ST.split_statements(df, ["id"], "c").orderBy("stmt_no").collect()]
    short = [r.text for r in ST.split_statements(spark.createDataFrame([(1, part)], "id int, c string"), ["id"], "c").orderBy("stmt_no").collect()]
    assert len(short) == 3 and texts == short * 300


def fact(spark, text):
    df = spark.createDataFrame([(1, 1, text)], "script_id int, pos int, text string")
    return FX.extract(df).first()


@pytest.mark.parametrize(
    "text, kind, schema, name",
    [
        ('ALTER TABLE ONLY "My Schema"."T" ADD x int', "alter_table", "My Schema", "T"),
        ("alter table if exists Users /* c */ drop column a", "alter_table", "", "users"),
        ("CREATE TEMP TABLE t (a int)", "create_table", "", "t"),
        ("create unlogged table a.b as select 1", "ctas", "a", "b"),
        ("CREATE MATERIALIZED VIEW mv AS SELECT 1", "ctas", "", "mv"),
        ("create unique index on t (a)", "create_index", "", "t"),
        ("select 'ALTER TABLE x'", "select", "", ""),
        ("comment on table x is 'drop table y'", "other", "", ""),
        ("ALTER TABLE t SET SCHEMA s", "other", "", ""),
    ],
)
def test_statement_kinds(spark, text, kind, schema, name):
    row = fact(spark, text)
    assert (row.kind, row.rel_schema, row.rel_name) == (kind, schema, name)


def test_commands_split_outside_brackets(spark):
    row = fact(spark, "ALTER TABLE t ADD COLUMN a numeric(10, 2) DEFAULT round(1.5, 0), DROP b, ADD CONSTRAINT c CHECK (x IN (1, 2)) NOT VALID, ALTER d TYPE varchar(3)")
    assert [(c.subtype, c.name) for c in row.commands] == [("add_column", "a"), ("drop_column", "b"), ("add_constraint", "c"), ("alter_type", "d")]
    assert [(c.name, list(c.type_names), c.has_modifier) for c in row.columns] == [("a", ["pg_catalog", "numeric"], True), ("d", ["pg_catalog", "varchar"], True)]
    kinds = {(c.contype, c.default_kind, c.skip_validation) for c in row.constraints}
    assert kinds == {("default", "expression", False), ("check", None, True)}


@pytest.mark.parametrize(
    "default, kind",
    [("0", "constant"), ("-1.5", "constant"), ("'x'::text", "constant"), ("'it''s'", "constant"), ("null", "constant"), ("now()", "function"), ("a.b()", "function"), ("f(1)", "expression"), ("1 + 1", "expression")],
)
def test_default_kinds(spark, default, kind):
    row = fact(spark, f"alter table t add column c text default {default} not null")
    assert [c.default_kind for c in row.constraints if c.contype == "default"] == [kind]


def test_identity_is_not_generated(spark):
    row = fact(spark, "alter table t add column c int generated always as identity")
    assert row.constraints == []


def test_where_inside_brackets_does_not_count(spark):
    assert not fact(spark, "delete from t using (select 1 where true) x").has_where
    assert fact(spark, "delete from t where a = 'b'").has_where


def test_nested_function_bodies(spark):
    text = "create function f(a int, b text[] default '{}') returns int language sql as $$ select 1; select é $$;"
    df = spark.createDataFrame([(1, text)], "script_id int, content string")
    statements = ST.split_statements(df, ["script_id"], "content")
    body = ST.function_bodies(statements).first()
    assert body.function_name == "f" and list(body.args) == ["a int", "b text[]"]
    inner = ST.with_nested(statements).filter("parent_stmt is not null").orderBy("stmt_no").collect()
    assert [text.encode()[r.start_byte : r.end_byte].decode() for r in inner] == ["select 1;", "select é"]


def test_mentions(spark):
    df = spark.createDataFrame([(1, 1, 'SELECT a, u.b AS c FROM app.users AS u JOIN "T" ON u.id = "T".x WHERE u.k = 1 AND z IN (2)')], "script_id int, stmt_no int, text string")
    got = {(r.clause, r.schema, r.name, r.alias) for r in FX.mentions(df).collect()}
    assert {("relation", "app", "users", "u"), ("relation", "", "T", ""), ("select", "", "a", ""), ("select", "", "b", "u"), ("where", "", "k", "u"), ("where", "", "z", "")} <= got


def test_token_counts(spark):
    df = spark.createDataFrame([("select a from b where 'x' -- y",)], "t string")
    counts = {(r.kind, r.keyword): r.n for r in TK.token_statistics(df, "t").collect()}
    assert counts[("word", "select")] == 1 and counts[("word", None)] == 2 and counts[("comment", None)] == 1


def test_lines(spark):
    df = spark.createDataFrame([(1, "a\r\nbé\n\nc\r")], "id int, t string")
    assert [(r.line, r.start_byte, r.line_text) for r in TK.lines(df, ["id"], "t").orderBy("line").collect()] == [(0, 0, "a"), (1, 3, "bé"), (2, 7, ""), (3, 8, "c"), (4, 10, "")]


def test_distinct_statements(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "script_id int, text string")
    got = {r.text: (r.occurrences, r.scripts) for r in ST.distinct_statements(df).collect()}
    assert got == {"a": (3, 2), "b": (1, 1)}
    assert FX.split_top_level(F.lit("a")) is not None


def test_comments_nest_to_any_depth(spark):
    depths = [*range(1, 41), 200]
    rows = [(d, f"select {d}; {'/* a ' * d}{' b */' * d} select 1;\n/**/-- /*\nselect 'it''s /*';") for d in depths]
    rows += [(0, "select 1; /* " * 3 + "*/ open"), (-1, "select 1; /*/ a */ select 2; /***/ select 3 */*/* b */ 2 */ 1;")]
    df = spark.createDataFrame(rows, "script_id int, content string")
    kinds = TK.tokens(df, ["script_id"], "content").filter("kind = 'comment'").groupBy("script_id").agg(F.sort_array(F.collect_list("token"))).collect()
    got = {r[0]: r[1] for r in kinds}
    assert all(got[d] == sorted([f"{'/* a ' * d}{' b */' * d}", "/**/", "-- /*"]) for d in depths)
    assert got[0] == [rows[-2][1][10:]] and got[-1] == ["/***/", "/*/ a */", "/*/* b */ 2 */"]
    counts = ST.split_statements(df, ["script_id"], "content").groupBy("script_id").count().collect()
    assert all(r["count"] == 3 for r in counts if r.script_id > 0)


def lexed(text):
    """Plain lexer of what matters to comments: the outermost block comments of a text."""
    out, i = [], 0
    while i < len(text):
        two = text[i : i + 2]
        if two == "/*":
            start, depth, i = i, 1, i + 2
            while i < len(text) and depth:
                step = {"/*": 1, "*/": -1}.get(text[i : i + 2], 0)
                depth, i = depth + step, i + (2 if step else 1)
            out.append(text[start:i])
        elif two == "--":
            end = text.find("\n", i)
            i = len(text) if end < 0 else end
        elif text[i] in "'\"":
            end = text.find(text[i], i + 1)
            i = len(text) if end < 0 else end + 1
        elif word := re.match(r"[A-Za-z_\x80-\xff][A-Za-z0-9_$\x80-\xff]*", text[i:]):
            i += len(word[0])
        elif tag := re.match(r"\$([A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*)?\$", text[i:]):
            end = text.find(tag[0], i + len(tag[0]))
            i = len(text) if end < 0 else end + len(tag[0])
        else:
            i += 1
    return out


def test_comments_are_found_as_by_a_plain_lexer(spark):
    rng = random.Random(4)
    some = ["/*", "*/", "/", "*", "-", "--", "'", '"', "\n", "\r", "$$", "$a$", "$b$", "$", "a", "b1", " ", "1", ";", "/*/", "*/*", "", "", "é", "日"]
    rows = [(n, "".join(rng.choice(some) for _ in range(rng.randrange(4, 40)))) for n in range(1500)]
    df = spark.createDataFrame(rows, "script_id int, content string").repartition(8)
    tokens = TK.tokens(df, ["script_id"], "content").groupBy("script_id").agg(F.sort_array(F.collect_list(F.struct("ord", "token", "kind"))).alias("t")).collect()
    texts = dict(rows)
    for row in tokens:
        assert "".join(t.token for t in row.t) == texts[row.script_id]
        found = [t.token for t in row.t if t.kind == "comment" and t.token.startswith("/*")]
        assert found == lexed(texts[row.script_id]), texts[row.script_id]


def test_thousands_of_open_marks(spark):
    """Nothing is written for the depth of a text, so no text can be too deep, and each is judged by itself."""
    n = 10_000
    rows = [(1, "select '/*';\n" * n), (2, f"select 1; {'/* ' * n}{'*/ ' * n}select 2;"), (3, "select 1; " + "/* " * n), (4, "select 1; /* a */ select 2;"),
            (5, "select 1; " + "/* /* a */ */ select 2; " * n)]
    df = spark.createDataFrame(rows, "script_id int, content string").repartition(5)
    statements = ST.split_statements(df, ["script_id"], "content")
    assert {r[0]: r[1] for r in statements.groupBy("script_id").count().collect()} == {1: n, 2: 2, 3: 1, 4: 2, 5: n + 1}
    facts = FX.statement_facts(statements.filter("script_id = 2")).select("masked").collect()
    assert [r.masked for r in facts] == ["select 1", "select 2"]
