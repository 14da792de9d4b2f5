"""Lint rules on small scripts in expectation style, state on its chunked path, and the merged check."""

import random

import pytest
from pyspark.sql import functions as F

from lintfleet import constants as C
from lintfleet.operators import scan
from lintfleet.plans import check as CH
from lintfleet.plans import facts as FX
from lintfleet.plans import lint_rules as L
from lintfleet.plans import selection as SEL
from lintfleet.plans import suppressions as X
from lintfleet.plans import txstate as W
from lintfleet.plans.known_facts import KnownFacts
from lintfleet.plans.statements import split_statements
from lintfleet.session import materialize

# script, expected findings per rule
CASES = [
    ("alter table t add column a serial, add column b int generated always as (1) stored;", {"addSerialColumn": 2, "preferIdentity": 1}),
    ("alter table t add column a bigint references u (id);", {"addingForeignKeyConstraint": 1}),
    ("alter table t add constraint f foreign key (a) references u not valid;", {"addingForeignKeyConstraint": 0, "constraintMissingNotValid": 0}),
    ("alter table t add column a int not null, add column b int not null;", {"addingRequiredField": 2}),
    ("alter table t add column a int not null, add column b int default 1;", {"addingRequiredField": 0}),
    ("create table t (a int, exclude using gist (a with =));", {"avoidAddingExclusionConstraint": 1, "preferRobustStmts": 1}),
    ("create index concurrently i on t (a);", {"banConcurrentIndexCreationInTransaction": 0, "preferRobustStmts": 1}),
    ("create index concurrently i on t (a); select 1;", {"banConcurrentIndexCreationInTransaction": 1}),
    ("create table t (a int); create index i on t (a);", {"requireConcurrentIndexCreation": 0, "lockTimeoutWarning": 0}),
    ("create index i on t (a); create table t (a int);", {"requireConcurrentIndexCreation": 0, "lockTimeoutWarning": 1}),
    ("create table T (a int); alter table t add constraint u unique (a);", {"disallowUniqueConstraint": 0}),
    ("alter table t add constraint u unique (a); create table t (a int);", {"disallowUniqueConstraint": 1}),
    ("alter table t drop column a; alter table public.t drop column b; alter table s.t drop column c;", {"multipleAlterTable": 1, "banDropColumn": 3}),
    ("set lock_timeout = 1; alter table t drop column a; commit; alter table t drop column b;", {"lockTimeoutWarning": 1}),
    ("set lock_timeout = 1; reset lock_timeout; alter table t drop column a;", {"lockTimeoutWarning": 1}),
    ("set statement_timeout = 1; set idle_in_transaction_session_timeout = 1; truncate t;", {"requireStatementTimeout": 0, "requireIdleInTransactionTimeout": 0}),
    ("vacuum full t; reindex table t; refresh materialized view m;", {"requireStatementTimeout": 3, "banVacuumFull": 1, "requireConcurrentReindex": 1}),
    ("alter table a drop column x; alter table b drop column x; alter table a drop column y; alter table b drop column z;", {"avoidWideLockWindow": 1}),
    ("alter table a drop column x; rollback; alter table b drop column x;", {"avoidWideLockWindow": 0, "runningStatementWhileHoldingAccessExclusive": 1}),
    ("alter table a validate constraint c; select 1;", {"runningStatementWhileHoldingAccessExclusive": 0}),
    ("alter table a add constraint c check (x) not valid; alter table A validate constraint C;", {"requireSeparateConstraintValidation": 1}),
    ("alter table a add constraint c check (x) not valid; commit; alter table a validate constraint c;", {"requireSeparateConstraintValidation": 0}),
    ("alter table t add column a int default 0; alter table t add column b timestamptz default now();", {"addingFieldWithDefault": 2}),
    ("alter table t add column a int generated always as (1) stored;", {"addingFieldWithDefault": 1}),
    ("alter table t alter column a set not null;", {"addingNotNullField": 1}),
    ("begin; begin; commit; begin;", {"transactionNesting": 6}),
    ("commit; begin; begin;", {"transactionNesting": 3}),
    ("alter table t alter a type text, alter b type varchar, alter c type varchar(9), alter d type numeric, alter e type int;", {"changingColumnType": 2, "preferTextField": 1}),
    ("drop table t; drop table if exists u; drop index concurrently i;", {"banDropTable": 2, "preferRobustStmts": 2, "requireConcurrentIndexDeletion": 0}),
    ("alter table t detach partition p; alter table t detach partition q concurrently;", {"requireConcurrentDetachPartition": 1}),
    ("create type s.e as enum ('a'); alter type s.e add value 'b';", {"creatingEnum": 1, "avoidAlterEnumAddValue": 1}),
    ("delete from t; update t set a = 1; delete from t where a = 1;", {"banDeleteWithoutWhere": 1, "banUpdateWithoutWhere": 1}),
    ("with x as (select 1 where true) delete from t; with x as (select 1), y (a, b) as materialized (select 1, 2) update t set a = 1;", {"banDeleteWithoutWhere": 1, "banUpdateWithoutWhere": 1}),
    ("with recursive x as (select 1) delete from t where a in (select 1); with x as (delete from u) select 1;", {"banDeleteWithoutWhere": 0}),
    ("create table t (a bigint, b text) partition by range (a, b); create table u (a bigint) inherits (t, v) with (fillfactor=70, c integer);", {"preferBigInt": 0}),
    ("create table t (a numeric(9, 2) check (a > (0)), b integer) with (fillfactor=70);", {"preferBigInt": 1}),
    ("alter foreign table t drop column a; alter view v alter column a drop default; alter foreign table if exists t drop column b;", {"banDropColumn": 2}),
    ("alter table t rename a to b; alter table t rename to u;", {"renamingColumn": 1, "renamingTable": 1}),
    ("create table t (a char, b json, c timestamp, d timestamptz, e smallint, f bigserial);", {"banCharField": 1, "preferJsonb": 1, "preferTimestamptz": 1, "preferBigintOverSmallint": 1, "preferBigInt": 1, "preferIdentity": 1}),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(CASES)], "script_id int, content string")
    rows = CH.lint_scripts(df).groupBy("script_id", "rule").count().collect()
    return {(r.script_id, r.rule): r["count"] for r in rows}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_expected_findings(found, i):
    for rule, n in CASES[i][1].items():
        assert found.get((i, rule), 0) == n, (CASES[i][0], rule)


def test_registry_is_complete():
    assert len(L.RULES) == 52 and len({r.name for r in L.RULES.values()}) == 52
    assert sum(r.recommended for r in L.RULES.values()) == 24


def test_state_is_the_same_when_scripts_are_cut(spark, monkeypatch):
    """A script too large for one task is scanned in chunks; every state column must come out equal."""
    parts = ["begin;", "create table t (a int);", "alter table t drop column a;", "commit;", "alter table u drop column b;", "set lock_timeout = 1;",
             "alter table v add constraint c check (x) not valid;\nselect 1;\nalter table v validate constraint c;", "create index i on u (a);", "rollback;", "savepoint s;"]
    text = "\n".join(parts[(i * 7 + i // 3) % len(parts)] for i in range(160))
    df = spark.createDataFrame([(1, text), (2, text[:900])], "script_id int, content string")
    facts = FX.extract(split_statements(df, ["script_id"], "content").withColumnRenamed("stmt_no", "pos"))
    needs = ["locked_tables", "neighbours", "first_transaction", "created_in_file", "earlier_alter"]
    names = ["script_id", "pos", "segment", "lock_timeout_set", "created_before", "takes_access_exclusive", "holding_access_exclusive",
             "table_locked_before", "locks_before", "has_other_statements", "first_transaction", "created_in_file", "altered_earlier_in_file"]
    whole = W.with_state(facts, needs).select(names).orderBy("script_id", "pos").collect()
    monkeypatch.setattr(scan, "CHUNK", 16)
    chunk = scan.chunk_width(facts, ["script_id"], limit=10)
    assert chunk.width == 16 and len(chunk.hot) == 2
    assert W.with_state(facts, needs, chunk).select(names).orderBy("script_id", "pos").collect() == whole
    flat = W.with_validated(W.with_segment(facts)).select("pos", "added_in_transaction").orderBy("pos").collect()
    cut = W.with_validated(W.with_segment(facts, chunk), chunk).select("pos", "added_in_transaction").orderBy("pos").collect()
    assert flat == cut and any(r.added_in_transaction for r in flat)
    depth = W.with_depth(facts).select("script_id", "pos", "depth").orderBy("script_id", "pos").collect()
    assert W.with_depth(facts, chunk).select("script_id", "pos", "depth").orderBy("script_id", "pos").collect() == depth
    assert min(r.depth for r in depth) == 0


def comment_frame(spark, text):
    return X.comments(spark.createDataFrame([(1, text)], "script_id int, content string"))


def stack_pairs(events):
    """Reference pairing with an explicit stack per specifier."""
    open_, pairs, errors = {}, set(), set()
    for line, kind, spec in events:
        if kind == "start":
            open_.setdefault(spec, []).append(line)
        elif open_.get(spec):
            pairs.add((open_[spec].pop(), line))
        else:
            errors.add(line)
    return pairs, errors | {x for v in open_.values() for x in v}


@pytest.mark.parametrize("chunk", [None, 4])
def test_start_end_pairs_follow_a_stack(spark, chunk):
    import random

    rnd = random.Random(5)
    events = [(i, rnd.choice(["start", "end"]), rnd.choice(["lint", "lint/safety"])) for i in range(60)]
    text = "\n".join(f"-- pgls-ignore-{kind} {spec}" for _, kind, spec in events)
    rows = X.range_suppressions(comment_frame(spark, text), chunk).collect()
    ends = {}
    at = 0
    for line, part in enumerate(text.split("\n")):
        ends[at + len(part)] = line
        at += len(part) + 1
    pairs, errors = stack_pairs(events)
    assert {(r.line, ends[r.end_byte]) for r in rows if r.error is None} == pairs
    assert {r.line for r in rows if r.error} == errors


def test_comment_errors(spark):
    text = "-- pgls-ignore-all lint: top\n\n-- pgls-ignorex lint\nselect 1;\n-- pgls-ignore\n-- pgt-ignore lint/safety/nope: x\n  -- pgls-ignore-all lint\n-- pgls-ignore lint/safety: a: b"
    rows = comment_frame(spark, text).orderBy("line").collect()
    assert [r.error for r in rows] == [None, f"'pgls-ignorex' {X.BAD_TAG}", X.NO_SPECIFIER, X.BAD_RULE, None, None]
    assert rows[0].leading and not rows[4].leading and rows[5].explanation == "a: b"
    assert [r.error for r in X.file_suppressions(comment_frame(spark, text)).orderBy("line").collect()] == [None, X.MISPLACED]


def test_check_end_to_end(spark):
    text = """-- pgls-ignore lint/safety/banDropTable
-- pgls-ignore lint/safety/banDropColumn: both aim at the next statement
drop table
  a;
-- pgls-ignore-start lint/safety/banTruncate
truncate b;
-- pgls-ignore-end lint/safety/banTruncate
truncate c;
"""
    df = spark.createDataFrame([(1, text)], "script_id int, content string")
    syntax = spark.createDataFrame([(1, "syntax", 3, "bad", text.index("truncate c"), text.index("truncate c") + 11, 7, 7), (1, "syntax", 3, "bad", 0, 1, 0, 0)],
                                   "script_id int, category string, severity int, message string, start_byte bigint, end_byte bigint, start_line int, end_line int")
    cols = syntax.columns
    known = syntax.filter("start_byte > 0").selectExpr("script_id", "'database/x' category", "0 severity", "message", "start_byte + 1 as start_byte", "end_byte", "start_line", "end_line").select(cols)
    names = ["banDropTable", "banTruncate", "banDropColumn"]
    rows = CH.check(df, names, syntax_errors=syntax, database_findings=known, levels={"banTruncate": C.ERROR}, disabled=["banDropTable"]).collect()
    at, column = text.index("truncate c"), text.index("-- pgls-ignore lint/safety/banDropColumn")
    got = sorted((r.category, r.start_byte, r.severity) for r in rows)
    assert got == sorted([
        ("lint/safety/banTruncate", at, C.ERROR), ("database/x", at + 1, 0), ("syntax", 0, C.ERROR), ("lint", column, C.WARNING),
        ("lint", 0, C.WARNING), ("lint", 0, C.WARNING),  # the first comment names a disabled rule and so has no effect
    ])
    # lint findings do not take a syntax error's place
    rows = CH.check(df, names, syntax_errors=syntax).collect()
    assert sorted((r.category, r.start_byte) for r in rows) == sorted([("lint/safety/banTruncate", at), ("lint", column), ("syntax", 0), ("syntax", at)])
    assert {r.message for r in CH.check(df, [], disabled=["safety"]).collect()} == {X.NO_EFFECT, X.DISABLED}


def test_check_with_written_facts(spark):
    df = spark.createDataFrame([(i, CASES[i][0]) for i in range(len(CASES))], "script_id int, content string")
    cols = ["script_id", "pos", "ord", "rule", "message"]
    plain = sorted(map(tuple, CH.lint_scripts(df).select(cols).collect()))
    assert sorted(map(tuple, CH.lint_scripts(df, write_facts=True).select(cols).collect())) == plain


def test_second_run_analyses_no_text_again(spark, tmp_path):
    df = spark.createDataFrame([(i, CASES[i % 7][0]) for i in range(14)], "script_id int, content string")
    cols = ["script_id", "pos", "ord", "rule", "message", "start_byte", "code"]
    names = ["banTruncate", "addSerialColumn", "preferRobustStmts", "lockTimeoutWarning"]

    def linted(frame, known=None):
        return sorted(map(tuple, CH.lint_scripts(frame, names, known=known).select(cols).collect()))

    def shared(frame):
        return linted(frame, KnownFacts(spark, str(tmp_path)))

    table, plain = KnownFacts(spark, str(tmp_path)).store, linted(df)
    assert plain and shared(df) == plain
    entries, texts = table.snapshot(), split_statements(df, ["script_id"], "content").select("text").distinct().count()
    assert table.read("facts").count() == texts and len(entries) == 1
    assert shared(df) == plain
    assert table.snapshot() == entries  # nothing was analysed, nothing written
    more = spark.createDataFrame([(20, "truncate only_here;"), (21, CASES[0][0])], "script_id int, content string")
    assert "banTruncate" in {r[3] for r in linted(more)} and shared(more) == linted(more)
    assert table.read("facts").count() == texts + 1 and len(table.snapshot()) == 2
    nothing = spark.createDataFrame([], "script_id int, content string")
    assert shared(nothing) == []
    missing = KnownFacts(spark, str(tmp_path)).extract(spark.createDataFrame([(1, None)], "script_id int, text string")).collect()
    assert [r.kind for r in missing] == [r.kind for r in FX.extract(spark.createDataFrame([(1, "")], "script_id int, text string")).collect()]


def test_facts_of_shapes_with_several_brackets(spark):
    texts = ["with x as (select 1) delete from a.t where b", "create table t (a bigint, b text) partition by range (a, b)",
             "create table t (a bigint) inherits (u, v) with (fillfactor=70, autovacuum_enabled=false)", "alter foreign table a.t drop column c",
             "alter sequence s owner to me", "alter sequence s restart"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "script_id int, text string")
    rows = FX.extract(df).orderBy("script_id").collect()
    assert [r.kind for r in rows] == ["delete", "create_table", "create_table", "alter_table", "alter_table", "other"]
    assert (rows[0].rel_schema, rows[0].rel_name, rows[0].has_where) == ("a", "t", True)
    assert [[c.name for c in r.columns] for r in rows[1:3]] == [["a", "b"], ["a"]]
    assert [r.object_type for r in rows[3:5]] == ["foreign table", "sequence"] and rows[3].commands[0].subtype == "drop_column"


def test_selection(spark):
    row = "project int, all_rules boolean, recommended boolean, group_present boolean, rules_on array<string>, rules_off array<string>, only array<string>, skip array<string>"
    config = spark.createDataFrame(
        [(1, None, None, False, [], [], [], []), (2, True, None, False, [], [], [], ["banTruncate"]), (3, None, False, True, ["banTruncate"], [], [], []),
         (4, None, None, True, [], ["banTruncate"], [], []), (5, None, None, True, [], [], ["banTruncate"], [])], row)
    got = SEL.effective_rules(config).groupBy("project").agg(F.collect_set("rule").alias("r")).collect()
    rules = {r.project: set(r.r) for r in got}
    recommended = {r.name for r in L.RULES.values() if r.recommended}
    assert rules[1] == recommended and len(rules[2]) == 51 and rules[3] == {"banTruncate"} and rules[5] == {"banTruncate"}
    assert rules[4] == recommended - {"banTruncate"}


def test_cap(spark):
    df = spark.createDataFrame([(k, i) for k in (1, 2) for i in range(k * 3)], "k int, i int")
    kept, counts = SEL.cap(df, ["k"], ["i"], 4)
    assert sorted(map(tuple, kept.collect())) == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (2, 3)]
    assert {r.k: r.skipped for r in counts.collect()} == {1: 0, 2: 2}
    assert SEL.override_severity(spark.createDataFrame([("a",), ("b",)], "rule string"), {"a": C.ERROR}).filter("severity = 3").count() == 1


def test_the_sweep_equals_the_chunked_path(spark):
    """Many findings and comments per script, at equal places, before, inside and behind ranges, with strays and runs of line comments."""
    rng = random.Random(11)
    marks = ["-- pgt-ignore lint/safety/banDropTable", "-- pgt-ignore lint/safety: all", "-- pgls-ignore lint", "-- pgt-ignore-all lint/safety/preferJsonb", "-- pgt-ignore",
             "-- pgt-ignore-start lint/safety/banDropTable", "-- pgt-ignore-end lint/safety/banDropTable", "-- pgt-ignore-start lint", "-- pgt-ignore-end lint",
             "-- pgt-ignore-what lint", "-- pgt-ignore lint/safety/nothing", "drop table a;", "select 1;", ""]
    texts = [(n, "\n".join(rng.choice(marks) for _ in range(rng.randrange(1, 30)))) for n in range(40)]
    parsed = X.comments(spark.createDataFrame(texts, "script_id int, content string"))
    rules = ["lint/safety/banDropTable", "lint/safety/preferJsonb", "database/check", "syntax"]
    found = []
    for n, text in texts:
        for _ in range(rng.randrange(25)):
            start, line = rng.randrange(len(text) + 1), rng.randrange(30)
            which = rng.randrange(4)
            found.append((n, rules[which], rng.choice([0, 2, 3]), rng.choice("ab"), start, start + rng.choice([0, 5, 60, 400]), line, line + rng.randrange(3), {2: X.KNOWN, 3: X.SYNTAX}.get(which, X.LINT)))
    shape = "script_id int, category string, severity int, message string, start_byte bigint, end_byte bigint, start_line int, end_line int, origin int"
    everything = materialize(spark.createDataFrame(found, shape).repartition(4), "found")
    known, syntax = (everything.filter(F.col("origin") == o) for o in (X.KNOWN, X.SYNTAX))
    left = everything.filter(F.col("origin") != X.SYNTAX).unionByName(X.drop_contained_syntax_errors(syntax, known, 4)).drop("origin")
    left = materialize(left, "left")
    off = ["banDropTable"]
    want = sorted(map(tuple, X.suppress(left, parsed, 4, off).collect()))
    got = X.judged(everything, parsed, off, subsume=True)
    assert got.columns == ["script_id", "category", "severity", "message", "start_byte", "end_byte", "start_line", "end_line"]
    assert sorted(map(tuple, got.collect())) == want
    assert len(want) > 200
    bare = X.judged(everything.filter("script_id < 0"), parsed, off)
    assert {r.message for r in bare.collect()} >= {X.NO_EFFECT, X.DISABLED, X.BAD_RULE}
