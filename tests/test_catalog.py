"""Catalog rules and resolution on a small hand-made catalog, and sources, reports and streams."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lintfleet.fixtures import report_queries as RQ
from lintfleet.functions import scalars as S
from lintfleet.plans import audit_rules as D
from lintfleet.plans import reports as Q
from lintfleet.plans import resolve as R
from lintfleet.plans import scorecard as P
from lintfleet.sources import scripts as I
from lintfleet.sources.catalog import Catalog, read_snapshot, write_snapshot
from lintfleet.sources.globs import glob_to_regex
from lintfleet.streaming import documents as MD
from lintfleet.streaming.folders import Folders


@pytest.fixture(scope="module")
def cat(spark):
    make = spark.createDataFrame
    tables = {
        "namespace": make([(1, 1, "public", 10), (1, 2, "auth", 10), (2, 1, "public", 10)], "db_id int, oid bigint, nspname string, nspowner bigint"),
        "class": make(
            [(1, 100, "t", 1, "r", False, "", 0, 5.0), (1, 101, "u", 1, "r", True, "", 0, 5.0), (1, 102, "users", 2, "r", False, "", 0, 5.0),
             (1, 103, "v", 1, "v", False, "Security_Invoker=true", 0, 0.0), (1, 104, "w", 1, "v", False, "", 0, 0.0), (2, 100, "t", 1, "r", False, "", 0, 5.0)],
            "db_id int, oid bigint, relname string, relnamespace bigint, relkind string, relrowsecurity boolean, reloptions string, relpages bigint, reltuples double")
        .withColumns({"relowner": F.lit(10).cast("bigint"), "amname": F.lit("heap"), "relforcerowsecurity": F.lit(False), "relreplident": F.lit("d"), "relsize": F.lit(0).cast("bigint")}),
        "index": make([(1, 1000, 100, "2 3", False, False, True, "i1", "on t"), (1, 1001, 101, "1", True, True, True, "i2", "on u"), (1, 1002, 100, "2", False, False, False, "i3", "on t2")],
                      "db_id int, indexrelid bigint, indrelid bigint, indkey string, indisprimary boolean, indisunique boolean, indisvalid boolean, indexname string, indexdef string"),
        "constraint": make([(1, "f1", "f", 100, 101, "2"), (1, "f2", "f", 100, 101, "3"), (1, "f3", "f", 101, 100, "2 3")], "db_id int, conname string, contype string, conrelid bigint, confrelid bigint, conkey string"),
        "depend": make([(1, 999, 0, "e")], "db_id int, objid bigint, refobjid bigint, deptype string"),
        "policy": make([(1, 101, "p1", "r", True, "0", None, None), (1, 101, "p2", "*", True, "10", "true", None), (1, 101, "p3", "r", True, "11", "x", None), (1, 100, "q", "r", True, "0", "x", None)],
                       "db_id int, polrelid bigint, polname string, polcmd string, polpermissive boolean, polroles string, qual string, with_check string"),
        "role": make([(1, 10, "anon", False), (1, 11, "authenticated", False), (1, 12, "service_role", False), (2, 10, "anon", False), (1, 13, "pg_x", False)], "db_id int, oid bigint, rolname string, rolbypassrls boolean"),
        "privilege": make([(d, o, "anon", "SELECT") for d in (1, 2) for o in range(100, 105)], "db_id int, oid bigint, rolname string, privilege string"),
        "setting": make([(d, "pgrst.db_schemas", " public ,x") for d in (1, 2)] + [(d, "server_version_num", "150001") for d in (1, 2)], "db_id int, name string, value string"),
    }
    return Catalog(tables.__getitem__)


def names(df):
    return sorted((r.db_id, r.object_name) for r in df.collect())


def test_index_prefix_must_match_in_order(cat):
    keys = {r.cache_key for r in D.RULES["D01"].rows(cat).collect()}
    assert keys == {"unindexed_foreign_keys_public_t_f2", "unindexed_foreign_keys_public_u_f3"}


def test_no_primary_key_and_excluded_schema(cat):
    assert names(D.RULES["D03"].rows(cat)) == [(1, "t"), (2, "t")]


def test_public_and_named_policies_add_up(cat):
    got = {r.cache_key for r in D.RULES["D05"].rows(cat).collect()}
    assert got == {f"multiple_permissive_policies_public_u_{r}_SELECT" for r in ("anon", "authenticated")}


def test_invoker_view_is_not_reported(cat):
    assert names(D.RULES["D11"].rows(cat)) == [(1, "w")]


def test_policy_without_rls(cat):
    assert names(D.RULES["D09"].rows(cat)) == [(1, "t")]


def test_gate_and_ignore(cat):
    only = ["rls_disabled_in_public", "no_primary_key"]
    rows = D.audit(cat, rules=only)
    got = sorted((r.db_id, r.rule, r.object_name) for r in rows.collect())
    assert got == [(1, "no_primary_key", "t"), (1, "rls_disabled_in_public", "t"), (2, "no_primary_key", "t")]
    assert {r.severity for r in rows.collect()} == {1, 3}
    assert D.audit(cat, rules=only, ignore=["public.*"]).count() == 0
    assert [r.rule for r in D.audit(cat, rules=only, rule_ignore={"no_primary_key": ["public.t"]}).collect()] == ["rls_disabled_in_public"]
    cat.base = None


def test_audit_rows_equal_single_rules(cat):
    rules = ["D01", "D03", "D05", "D09", "D10", "D13", "D16"]
    single = sorted(tuple(r) for i in rules for r in D.RULES[i].rows(cat).collect() if r.db_id == 1)
    together = D.audit(cat, rules=[D.RULES[i].name for i in rules]).filter("db_id = 1").select(D.COLUMNS).collect()
    cat.base = None
    assert sorted(map(str, map(tuple, together))) == sorted(map(str, single))


def test_redundant_index(cat):
    assert {r.indexrelid for r in P.redundant_indexes(cat).collect()} == {1002}
    row = P.RULES["B001"].score(cat).filter("db_id = 1").first()
    assert (row.violations, row.total, row.level) == (2, 3, "warning")


def test_snapshot_round_trip(spark, cat, tmp_path):
    write_snapshot(cat, str(tmp_path), "2024-01-01", ["role"])
    write_snapshot(cat, str(tmp_path), "2024-01-02", ["role"])
    assert read_snapshot(spark, str(tmp_path), "2024-01-02")["role"].count() == cat["role"].count()


@pytest.mark.parametrize(
    "size, text",
    [(0, "0 bytes"), (10239, "10239 bytes"), (10240, "10 kB"), (10752, "11 kB"), (10485247, "10239 kB"), (10485760, "10 MB"), (1 << 40, "1024 GB"), (20 << 40, "20 TB")],
)
def test_pretty_size(spark, size, text):
    assert spark.createDataFrame([(size,)], "s bigint").select(S.pretty_size(F.col("s"))).first()[0] == text


@pytest.mark.parametrize(
    "glob, path, hit",
    [("*.sql", "a.sql", True), ("*.sql", "a/b.sql", False), ("**/b.sql", "b.sql", True), ("**/b.sql", "a/c/b.sql", True), ("a/**", "a/x/y", True), ("a/**/z", "a/z", True),
     ("[!a-c]x", "dx", True), ("[!a-c]x", "bx", False), ("{a,b}/c", "b/c", True), ("a?c", "a/c", False), ("a.b", "axb", False), ("[]]x", "]x", True)],
)
def test_globs(spark, glob, path, hit):
    assert spark.createDataFrame([(path,)], "p string").select(F.col("p").rlike(glob_to_regex(glob))).first()[0] == hit


@pytest.mark.parametrize("glob", ["a**", "**b/c", "x/***/y", "[ab"])
def test_bad_globs(glob):
    with pytest.raises(ValueError):
        glob_to_regex(glob)


@pytest.mark.parametrize(
    "path, want",
    [("m/0012_add.sql", (12, "add")), ("m/20240101_x/up.sql", (20240101, "x")), ("m/000_x.sql", None), ("m/v1_x.sql", None), ("m/7_a_b.sql", (7, "a_b")), ("m/99999999999999999999999_x.sql", None)],
)
def test_migration_names(spark, path, want):
    m = spark.createDataFrame([(path,)], "p string").select(I.migration(F.col("p")).alias("m")).first().m
    assert (m and (int(m.sequence), m.name)) == want


def test_read_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.sql", "sub/b.pg", "c.txt", "d.SQL"):
        (tmp_path / name).write_text("select 1;\nselect 2;\n")
    rows = I.read_files(spark, [str(tmp_path)]).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in rows) == ["a.sql", "b.pg"] and all(r.content.count("\n") == 2 for r in rows)


def test_changed_scripts(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, content string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, content string")
    assert {(r.path, r.status) for r in I.changes(old, new).collect()} == {("b", "changed"), ("c", "removed"), ("d", "added")}
    assert {r.path for r in I.changed_scripts(old, new).collect()} == {"b", "d"}


@pytest.mark.parametrize(
    "expr, want",
    [("'anonymous'::text", "anonymous"), ("(42)::int8", "42"), ("now()", None), ("((1))", "1"), ("(1", None), ("'a'::x::y z(3)", "a"), ("1 + 1", None), ("'it''s'", None), ("", None), ("a::b;c", None)],
)
def test_basic_default(spark, expr, want):
    assert spark.createDataFrame([(expr,)], "e string").select(R.basic_default(F.col("e"))).first()[0] == want


def test_relevance_cut(spark):
    rows = [("a", s) for s in (200, 180, 150, 140)] + [("b", s) for s in (200, 180, 15, 10)] + [("c", s) for s in (200, 30, 20)] + [("d", 0), ("d", 0)]
    got = R.cut_by_relevance(spark.createDataFrame(rows, "k string, s int"), ["k"], "s").groupBy("k").count().collect()
    assert {r.k: r["count"] for r in got} == {"a": 4, "b": 2, "c": 1, "d": 2}


def test_rank_drops_repeated_labels(spark):
    rows = [(1, 10, "b"), (1, 10, "b"), (1, 9, "b"), (1, 9, "c"), (1, 8, "c"), (1, 7, "a"), (1, 6, "b")]
    df = spark.createDataFrame([(k, "table", "s", "t", label, score) for k, score, label in rows], "context_id int, kind string, schema string, table_name string, label string, score int")
    got = R.rank(df, 3).orderBy("rank").collect()
    assert [(r.label, r.score) for r in got] == [("b", 10), ("c", 9), ("a", 7)] and not got[0].preselected


def finding_rows(spark):
    rows = [("a.sql", "lint/safety/x", s, "m%\n", "c", 0, 2, 1, 3, 4, v, 5, 0) for s, v in ((0, False), (2, True), (3, False), (3, False))]
    return spark.createDataFrame(rows, "path string, category string, severity int, message string, code string, start_line int, end_line int, start_col int, end_col int, start_byte bigint, verbose boolean, pos int, ord int")


def test_reports(spark):
    df = finding_rows(spark)
    assert tuple(Q.severity_totals(df).first()) == (2, 1)
    prints = [r.fingerprint for r in Q.code_quality(df).collect()]
    assert len(set(prints)) == 4 and Q.code_quality(df, verbose=True).count() == 1
    line = Q.annotations(df, 3).first().value
    assert line == "::error title=lint/safety/x,file=a.sql,line=1,endLine=3,col=2,endColumn=4::m%25%0A"


def test_junit_file(spark, tmp_path):
    out = str(tmp_path / "junit")
    Q.write_junit(Q.junit_cases(finding_rows(spark)).coalesce(1), out)
    text = "".join(p.read_text() for p in (tmp_path / "junit").glob("part-*"))
    assert text.count("<testsuite ") == 3 and 'name="org.pgls.lint.safety.x"' in text and 'line="1"' in text


def test_latest_version_ignores_arrival_order(spark, tmp_path):
    folder = str(tmp_path / "feed")
    for part in ([(1, 3, "change", "new"), (2, 1, "open", "x")], [(1, 2, "change", "old"), (2, 2, "close", "")]):
        spark.createDataFrame(part, "doc_id int, version int, op string, content string").coalesce(1).write.mode("append").parquet(folder)
    stream = MD.read_stream(spark, folder, "*.parquet", max_files=1)
    got = MD.open_documents(MD.collected(MD.latest_versions(stream), "t-versions", "update")).collect()
    assert [tuple(r) for r in got] == [(1, 3, "change", "new")]


def test_incremental_lint_replays_a_batch(spark, tmp_path):
    linter = MD.IncrementalLint(spark, str(tmp_path), ["banDropTable", "banTruncate"])
    schema = "doc_id int, version int, op string, content string"
    first = spark.createDataFrame([(1, 1, "open", "drop table a; truncate b;"), (2, 1, "open", "drop table a;")], schema)
    second = spark.createDataFrame([(1, 2, "change", "drop table a; select 1;")], schema)
    for batch_id, batch in ((0, first), (1, second), (1, second)):
        linter.process(batch, batch_id)
    got = sorted((r.doc_id, r.version, r.stmt_no, r.rule) for r in linter.findings().collect())
    assert got == [(1, 2, 1, "banDropTable"), (2, 1, 1, "banDropTable")]
    assert [r.stmt_key for r in linter.store.read("known").filter("batch = 1").collect()] == [hashlib.sha256(b"select 1;").hexdigest()]
    with pytest.raises(ValueError):
        MD.IncrementalLint(spark, str(tmp_path), ["lockTimeoutWarning"])


def test_merged_batches_have_the_findings_of_one(spark, tmp_path):
    schema = "doc_id int, version int, op string, content string"
    linter = MD.IncrementalLint(spark, str(tmp_path / "many"), ["banDropTable"], fan=2)
    whole, everything = MD.IncrementalLint(spark, str(tmp_path / "one"), ["banDropTable"]), []
    for batch_id in range(7):
        rows = [(d, batch_id, "close" if (batch_id + d) % 5 == 4 else "change", f"drop table t{(batch_id + d) % 5};") for d in range(batch_id % 3, 6, 2)]
        everything += rows
        linter.process(spark.createDataFrame(rows, schema), batch_id)
        if batch_id == 3:  # a folder that a crash left behind, and the batch again
            linter.store.write("findings", linter.findings().withColumn("batch", F.lit(3)), 3)
            linter.process(spark.createDataFrame(rows, schema), batch_id)
    whole.process(spark.createDataFrame(everything, schema), 0)
    assert sorted(linter.findings().collect()) == sorted(whole.findings().collect())
    merged = [e for e in linter.store.snapshot() if e.table == "versions" and e.merges]
    assert merged and all(linter.store.read("versions", [e]).count() <= 6 for e in merged)  # one row per document
    with pytest.raises(ValueError, match="merged"):
        linter.process(spark.createDataFrame(everything[:1], schema), 1)


def test_fifty_batches_leave_two_levels_of_folders(spark, tmp_path):
    store = Folders(spark, str(tmp_path), {"a": "x int, y int"}, {"a": ["y"]})
    for batch in range(50):
        store.publish(batch, [store.write("a", spark.range(1).selectExpr(f"{batch} x", f"{batch % 3} y"), batch)])
    entries = store.snapshot()
    assert {e.merges for e in entries} == {0, 1} and len(entries) <= 2 * 8
    assert len(list((tmp_path / "a").iterdir())) <= len(entries) + 8  # those of the manifest before stay
    assert len(list((tmp_path / "manifest").glob("*.json"))) == 2
    assert sorted((r.x, r.y) for r in store.read("a").collect()) == [(b, b % 3) for b in range(50)]


def test_what_is_not_published_is_not_seen(spark, tmp_path):
    store = Folders(spark, str(tmp_path), {"a": "x int", "b": "x int"}, fan=2)
    rows = lambda *xs: spark.createDataFrame([(x,) for x in xs], "x int")
    seen = lambda t: sorted(r.x for r in store.read(t).collect())
    assert store.snapshot() == [] and seen("a") == []
    store.publish(0, [store.write("a", rows(1), 0), store.write("b", rows(10), 0)])
    lost = store.write("a", rows(2), 1)
    assert seen("a") == [1] and (tmp_path / "a" / lost.name).exists()
    old = store.snapshot()
    store.publish(1, [store.write("a", rows(2), 1)])  # the batch again: neither lost nor doubled
    assert seen("a") == [1, 2] and not (tmp_path / "a" / lost.name).exists()
    store.publish(2, [store.write("a", rows(3), 2)])
    assert [(e.low, e.high, e.merges) for e in store.snapshot() if e.table == "a"] == [(2, 2, 0), (0, 1, 1)]
    assert seen("a") == [1, 2, 3] and seen("b") == [10]
    assert sorted(r.x for r in store.read("a", old).collect()) == [1]  # still listed by the manifest before
    with pytest.raises(ValueError):
        store.before(0)
    store.publish(2, [store.write("a", rows(4), 2)])
    assert seen("a") == [1, 2, 4]


def test_incremental_lint_of_closed_emptied_repeated_and_late_versions(spark, tmp_path):
    linter = MD.IncrementalLint(spark, str(tmp_path), ["banDropTable"])
    schema = "doc_id int, version int, op string, content string"
    batches = [
        [(d, 1, "open", "drop table a;") for d in (1, 2, 3, 4, 5)],
        [(1, 2, "close", ""), (2, 2, "change", ""), (3, 1, "open", "drop table a;"), (4, 0, "open", "select 1; drop table b;")],
        [(1, 1, "open", "drop table a;"), (5, 2, "close", None), (5, 3, "open", "drop table c; drop table a;")],
    ]
    for batch_id, rows in enumerate(batches):
        linter.process(spark.createDataFrame(rows, schema), batch_id)
    got = sorted((r.doc_id, r.version, r.stmt_no) for r in linter.findings().collect())
    assert got == [(3, 1, 1), (4, 1, 1), (5, 3, 1), (5, 3, 2)]


def test_latest_of_equal_versions_is_the_one_that_arrived_last(spark):
    rows = [(1, 1, 2, "change", "b"), (1, 1, 1, "change", "z"), (2, 1, 1, "open", "x"), (2, 1, 1, "open", "y")]
    df = spark.createDataFrame(rows, "doc_id int, version int, at int, op string, content string")
    assert {r.doc_id: r.content for r in MD.latest_versions(df).collect()} == {1: "b", 2: "y"}


def test_function_check_query_has_all_severities(spark):
    from lintfleet.fixtures.selection_queries import QUERIES

    rows = QUERIES["X10_function_check_results"](spark, "/root/testdata/sf0.001")
    assert {r.severity for r in rows.select("severity").distinct().collect()} >= {1, 2, 3}
    assert RQ.QUERIES
