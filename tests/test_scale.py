"""What lets queries grow: tasks by rows, facts that are read, joins without pairs that do not fit. Rows are the tests' own."""

import pytest
from pyspark.sql import functions as F

from lintfleet.fixtures import selection_queries as XQ
from lintfleet.operators import keyed
from lintfleet.plans import facts as FX
from lintfleet.plans import lint_rules as L
from lintfleet.plans import reports as Q
from lintfleet.plans import resolve as R
from lintfleet.plans import statements as ST
from lintfleet.plans import suppressions as X
from lintfleet.plans import tokens as T
from lintfleet.session import dealt, tasks_for
from lintfleet.streaming.folders import Folders


def test_rows_are_dealt_out_by_their_number(spark):
    one_split = spark.range(0, 100_000, 1, 1)
    assert dealt(one_split, rows=1000).rdd.getNumPartitions() == 100
    wide = spark.range(0, 10, 1, 1).selectExpr("id % 3 k", "id")
    out = dealt(wide, "k", rows=1)
    assert out.count() == 10 and out.select("k", F.spark_partition_id()).distinct().count() == 3


def _ran(df):
    return df.rdd.getNumPartitions()  # after adaptive execution


def test_sweep_and_state_have_tasks_by_rows(spark):
    assert tasks_for(spark.range(0, 100_000, 1, 1), 1000) == 100 and tasks_for(spark.range(3), 1000) == spark.sparkContext.defaultParallelism
    rows = spark.createDataFrame([(i, 1, "ALTER TABLE a ADD COLUMN b int NOT NULL;") for i in range(200)], "script_id long, pos long, text string")
    scripts = spark.createDataFrame([(i, "-- pgls-ignore lint\n-- pgls-ignore-all x\n") for i in range(0, 200, 2)], "script_id long, content string")
    names = ["multipleAlterTable", "lockTimeoutWarning", "requireSeparateConstraintValidation"]
    linted = L.lint(FX.extract(rows), names, tasks=40)
    assert _ran(linted) >= 40 and _ran(L.lint(FX.extract(rows), names)) < 40
    zero = [F.lit(0).cast("long").alias(c) for c in X.AT]
    found = linted.select("script_id", "category", F.lit(X.LINT).alias("origin"), "severity", "message", *zero)
    few, many = X.judged(found, X.comments(scripts)), X.judged(found, X.comments(scripts), tasks=40)
    assert _ran(many) == 40 and _ran(few) < 40
    order = sorted(map(tuple, few.collect()))
    assert order == sorted(map(tuple, many.collect())) and order


def test_rules_name_the_arrays_they_read(spark):
    rows = spark.createDataFrame([(1, 1, "DROP TABLE a;")], "script_id long, pos long, text string")
    facts = spark.createDataFrame([], FX.extract(rows).schema)
    for r in L.RULES.values():
        arrays = L.arrays_of([r.name])
        L.lint(facts.drop(*[a for a in FX.ARRAYS if a not in arrays]), [r.name]).schema  # analysed
    assert L.arrays_of(["banDropTable"]) == [] and L.arrays_of() == list(FX.ARRAYS)
    found = L.lint(FX.extract(rows, arrays=[]), ["banDropTable"]).collect()
    assert [(f["rule"], f["pos"]) for f in found] == [("banDropTable", 1)]


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_lookup_joins_on_its_qualifiers(spark):
    known = [(1, "column", s, t, "id", False) for s in ("a", "b", None) for t in ("t1", "t2", None)]
    objects = spark.createDataFrame(known, "db_id int, kind string, schema string, table_name string, name string, is_primary_key boolean")
    asks = [(i, 1, "column", "id", s, t) for i, (s, t) in enumerate((s, t) for s in ("a", "x", None) for t in ("t2", "x", None))]
    lookups = spark.createDataFrame(asks, "lookup_id int, db_id int, kind string, name string, schema string, table_name string")
    found = R.find(lookups, objects)
    got = sorted((r["lookup_id"], r["schema"] or "", r["table_name"] or "") for r in found.collect())
    want = sorted((i, s or "", t or "") for i, _, _, _, qs, qt in asks for _, _, s, t, _, _ in known if (qs is None or qs == s) and (qt is None or qt == t))
    assert got == want
    joins = [line for line in _plan(found).splitlines() if "Join" in line]
    assert joins and all("q_table" in line.split("Inner")[0] for line in joins)


@pytest.mark.parametrize("text", ["a", "b"])
def test_literal_types_give_each_pair_once(spark, text, monkeypatch):
    types = [(1, 5, "pg_catalog", "text", []), (1, 6, "app", "mood", ["a", "a", "c"]), (1, 6, "app", "mood", ["a"]), (1, 7, "pg_catalog", "varchar", ["a"])]
    table = spark.createDataFrame(types, "db_id int, id long, schema string, name string, enums array<string>")
    monkeypatch.setattr(R.K, "types", lambda cat: table)
    literals = [(1, 1, "string", text), (1, 1, "string", text), (1, 1, "int", "x"), (2, 1, "string", "a"), (2, 1, "string", "c"), (None, 1, "string", "a"), (3, 1, "null", None)]
    found = R.literal_types(spark.createDataFrame(literals, "literal_id int, db_id int, literal string, value string"), None)
    got = sorted((r["literal_id"] or 0, r["type_id"]) for r in found.collect())
    own = [5, 6, 7] if text == "a" else [5, 7]
    assert got == sorted([(1, t) for t in own] + [(2, t) for t in (5, 6, 7)] + [(0, t) for t in (5, 6, 7)])


def test_sweep_moves_no_statement_text(spark, tmp_path):
    for name, schema, row in (("orders", "o_orderkey long, o_custkey long", (1, 1)),):
        spark.createDataFrame([row], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    found = XQ.judged(spark, str(tmp_path)).schema["found"].dataType.elementType
    assert found.names == ["pos", "ord", "message"]


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_side_repeated_per_salt_is_never_broadcast(spark, how, tmp_path):
    spark.range(1000).selectExpr("id % 7 k", "id a").write.parquet(f"{tmp_path}/left")
    spark.range(10).selectExpr("id k", "id b").write.parquet(f"{tmp_path}/right")  # few bytes, as compressed files are
    left, right = (spark.read.parquet(f"{tmp_path}/{side}") for side in ("left", "right"))
    found = keyed.lookup(left, right, ["k"], how, limit=5)
    assert found.count() == 1000
    assert "SortMergeJoin" in _plan(found) and "BroadcastHashJoin" not in _plan(found)
    assert "BroadcastHashJoin" in _plan(keyed.lookup(left, right, ["k"], how))


def test_exit_status_makes_findings_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def severity(i):
        made.add(1)
        return int(i % 4)

    findings = spark.range(0, 40, 1, 2).select(severity("id").alias("severity"))
    scripts = spark.createDataFrame([("a", "changed"), ("b", "skipped")], "path string, status string")
    got = Q.exit_status(scripts, findings).collect()
    assert [tuple(r) for r in got] == [(10, 10, "errors", True)] and made.value == 40


RUNS = [
    "CREATE TABLE t (a int, b text, c int);SELECT a, b FROM t AS select_x\nWHERE x = 'a;b' AND y IN (1, 2)\n\nSELECT 1",
    "INSERT INTO t (a, b)\n  SELECT 1, 2 UNION\nSELECT 3; GRANT SELECT, UPDATE ON t TO x; CREATE RULE r AS ON UPDATE TO t DO INSERT INTO x VALUES (1)",
    "WITH ORDINALITY x SELECT a, -- c ;\nselect b; BEGIN NOT ATOMIC x; BEGIN ISOLATION a; BEGIN x; y END; CASE (a END) SELECT",
    "EXPLAIN (ANALYZE, (a b)) SELECT 1 EXPLAIN x (y) SELECT 2; f((a), (b, (c)), $$ ;) $$, $t$ ; $t$, '(') alter table (a\n\nb) x",
    "a, b\n\\d foo, bar (x)\nselect 1 \\g\n\\set x 'y\nz'\nSELECT $1, :v, @p, 1.5e3 - -1 /* a /* ; */ ; */ AS /* x */ SELECT",
    "", "a", ",", "(a", "a, ", "a AS", "x \ue000 ß ; y(\ue000)\r\nz\r\rselect é$1 (é, 'ß')\t(",
]


def test_runs_of_tokens_split_like_single_tokens(spark, monkeypatch):
    texts = spark.createDataFrame(list(enumerate([*RUNS, "\n".join(RUNS), " ".join(RUNS[:4] * 20)])), "id int, t string")

    def split():
        found = [ST.split_statements(texts, ["id"], "t"), ST.meta_commands(texts, ["id"], "t")]
        return [sorted(map(tuple, f.collect())) for f in found]

    runs = split()
    for name in ("SIGNIFICANT", "SIGNIFICANT_IN_LINE"):
        monkeypatch.setattr(ST, name, rf"\G{ST.TRIVIA}(?:{T.CODE})")
    assert split() == runs and all(runs)


def test_a_run_of_tokens_is_folded_at_once(spark):
    text = "CREATE TABLE t (" + ", ".join(f"c{i} int DEFAULT {i}\n" for i in range(50)) + ");"
    found = spark.createDataFrame([(text,)], "t string").select(F.regexp_extract_all("t", F.lit(ST.SIGNIFICANT), F.lit(0)).alias("f")).first().f
    assert [f.split()[0] for f in found] == ["CREATE", "TABLE", ";"] and "".join(found) == text


def test_objects_answer_only_as_their_kind_is_asked_for(spark):
    known = [(1, kind, s, t, "id", False) for kind in ("column", "policy", "role") for s in ("a", None) for t in ("t", None)]
    objects = spark.createDataFrame(known, "db_id int, kind string, schema string, table_name string, name string, is_primary_key boolean")
    asks = [(1, 1, "column", "id", None, "t"), (2, 1, "role", '"id"', None, None), (3, 1, None, "id", None, None), (4, 1, "role", "id", "a", None)]
    lookups = spark.createDataFrame(asks, "lookup_id int, db_id int, kind string, name string, schema string, table_name string")
    found = R.find(lookups, objects)
    got = sorted((r["lookup_id"], r["schema"] or "", r["table_name"] or "") for r in found.collect())
    assert got == [(1, "", "t"), (1, "a", "t"), (2, "", ""), (2, "", "t"), (2, "a", ""), (2, "a", "t"), (4, "a", ""), (4, "a", "t")]
    assert _plan(found).count("Generate explode") == 1
    assert R.find(lookups.filter("lookup_id > 9"), objects).count() == 0


def test_manifests_are_read_without_jobs(spark, tmp_path):
    store = Folders(spark, str(tmp_path / "store"), {"t": "a long"})
    for batch in range(3):
        store.publish(batch, [store.write("t", spark.range(batch, batch + 1).toDF("a"), batch)])
    spark.sparkContext.setJobGroup("manifests", "")
    entries = store.snapshot()
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("manifests")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [e.low for e in entries] == [0, 1, 2] and sorted(r.a for r in store.read("t", entries).collect()) == [0, 1, 2]
