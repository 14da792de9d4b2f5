"""Registered queries for sources, reports, metrics, streams and scalar functions (I, Q, M, S), with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintfleet import constants as C
from lintfleet.fixtures import selection_queries as XQ
from lintfleet.fixtures.catalog_queries import pretty
from lintfleet.fixtures.corpus import PATH_SQL, script_path
from lintfleet.fixtures.relations import cte, relation, source
from lintfleet.fixtures.script_queries import scripts
from lintfleet.functions import scalars as S
from lintfleet.operators.scan import chunk_width, equi_depth
from lintfleet.plans import reports as Q
from lintfleet.session import configure, materialize, new_path
from lintfleet.sources import scripts as I
from lintfleet.streaming import documents as MD
from lintfleet.streaming import metrics as MM

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def derived(spark: SparkSession, sf: str, table: str, text: str) -> DataFrame:
    source(configure(spark), sf, table).createOrReplaceTempView(table)
    return spark.sql(text.replace("{S}", "string"))


def table_sql(text: str) -> str:
    return text.replace("{S}", "varchar")


# ------------------------------------------------------------------ I: sources

FILES = """
select o_orderkey file_id, concat(case o_orderkey % 4 when 0 then 'db/migrations/' when 1 then 'db/old/' when 2 then 'src/' else 'db/migrations/archive/' end,
  case o_orderkey % 6 when 0 then concat('000', cast(o_orderkey as {S}), '_add_') when 1 then '0000_' when 2 then concat(cast(o_orderkey as {S}), '_') when 3 then concat('20240101_', cast(o_orderkey as {S}), '/m') when 4 then 'v' else '00_' end,
  lower(o_orderstatus), cast(o_orderkey % 100 as {S}), case o_orderkey % 5 when 0 then '.sql' when 1 then '.pg' when 2 then '.SQL' when 3 then '.txt' else '.sql' end) path from orders"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, "orders", FILES)


def files_sql(body: str) -> str:
    return f"with files as ({table_sql(FILES)})\n{body}"


QUERIES["I01_script_source"] = lambda spark, sf: I.keep_scripts(files(spark, sf))
SQL["I01_script_source"] = files_sql("select * from files where path like '%.sql' or path like '%.pg'")

_INCLUDE, _IGNORE, _VCS = ["db/**/*.sql", "src/*[0-5].{sql,pg}"], ["db/old/*_f*", "**/archive/v?1.*"], ["db/migrations/archive/20240101_1*"]
QUERIES["I02_include_ignore"] = lambda spark, sf: files(spark, sf).filter(I.path_filter(F.col("path"), _INCLUDE, _IGNORE, _VCS))
SQL["I02_include_ignore"] = files_sql(
    """select * from files where (regexp_matches(path, '^db/(?:[^/]+/)*[^/]*\\.sql$') or regexp_matches(path, '^src/[^/]*[0-5]\\.(sql|pg)$'))
  and not regexp_matches(path, '^db/old/[^/]*_f[^/]*$') and not regexp_matches(path, '^(?:[^/]+/)*archive/v[^/]1\\.[^/]*$')
  and not regexp_matches(path, '^db/migrations/archive/20240101_1[^/]*(/.*)?$')"""
)
_GLOBS = {"question": ("src/v?1?.*", "^src/v[^/]1[^/]\\.[^/]*$"), "star": ("db/*/v*", "^db/[^/]*/v[^/]*$"), "deep": ("**/v*.pg", "^(?:[^/]+/)*v[^/]*\\.pg$"),
          "chars": ("**/*[0-3].sql", "^(?:[^/]+/)*[^/]*[0-3]\\.sql$"), "negated": ("src/*[!0-8].txt", "^src/[^/]*[^0-8]\\.txt$"),
          "either": ("{src,db/old}/*.{sql,SQL}", "^(src|db/old)/[^/]*\\.(sql|SQL)$")}


def _glob_table(spark: SparkSession, sf: str) -> DataFrame:
    from lintfleet.sources.globs import glob_to_regex

    return files(spark, sf).select("file_id", *[F.col("path").rlike(glob_to_regex(g)).alias(n) for n, (g, _) in _GLOBS.items()])


QUERIES["I03_glob_semantics"] = _glob_table
SQL["I03_glob_semantics"] = files_sql("select file_id, " + ", ".join(f"regexp_matches(path, '{r}') {n}" for n, (_, r) in _GLOBS.items()) + " from files")


def _migrations(spark: SparkSession, sf: str) -> DataFrame:
    m = I.migration(F.col("path"))
    return files(spark, sf).select("file_id", m["sequence"].cast("bigint").alias("sequence"), m["name"].alias("name"))


QUERIES["I04_migration_name"] = _migrations
_PARSED = """select file_id, path, coalesce(fseq, dseq) as sequence, case when fseq is not null then fname when dseq is not null then dname end as name from (
  select *, try_cast(nullif(ltrim(regexp_extract(f, '^([0-9]+)_', 1), '0'), '') as bigint) fseq, regexp_replace(regexp_replace(f, '^[0-9]+_', ''), '\\.sql$', '') fname,
    try_cast(nullif(ltrim(regexp_extract(d, '^([0-9]+)_', 1), '0'), '') as bigint) dseq, regexp_replace(regexp_replace(d, '^[0-9]+_', ''), '\\.sql$', '') dname
  from (select *, regexp_extract(path, '([^/]+)$', 1) f, regexp_extract(path, '([^/]+)/[^/]+$', 1) d from files) a) b"""
SQL["I04_migration_name"] = files_sql(f"select file_id, sequence, name from ({_PARSED}) p")
QUERIES["I05_migration_cutoff"] = lambda spark, sf: I.after_cutoff(files(spark, sf), 9000)
SQL["I05_migration_cutoff"] = files_sql(f"select file_id, path from ({_PARSED}) p where sequence is null or sequence > 9000")


def _snapshots(spark: SparkSession, sf: str) -> DataFrame:
    old = scripts(spark, sf).select("script_id", "path", "content")
    moved = F.when(F.col("script_id") % 7 == 0, F.concat(F.lit("moved/"), F.col("path"))).otherwise(F.col("path"))
    edited = F.when(F.col("script_id") % 5 == 0, F.concat("content", F.lit("-- edited\n"))).otherwise(F.col("content"))
    return I.changes(old, old.select(moved.alias("path"), edited.alias("content")))


QUERIES["I06_changed_set"] = _snapshots
SQL["I06_changed_set"] = XQ.sql(
    f"""select {PATH_SQL} path, case when script_id % 7 = 0 then 'removed' else 'changed' end status from script where script_id % 7 = 0 or script_id % 5 = 0
union all select concat('moved/', {PATH_SQL}), 'added' from script where script_id % 7 = 0"""
)

# ------------------------------------------------------------------ Q: reports


def findings(spark: SparkSession, sf: str) -> DataFrame:
    rows = XQ.findings(spark, sf).withColumn("path", script_path(F.col("script_id")))
    return rows.withColumn("verbose", F.col("pos") % 5 == 0)


REPORTED = f", rep as (select *, {PATH_SQL} path, stmt_no % 5 = 0 chatty from fnd)"


def rep_sql(body: str) -> str:
    return XQ.sql(f"{REPORTED}\n{body}")


QUERIES["Q01_severity_totals"] = lambda spark, sf: Q.severity_totals(findings(spark, sf))
SQL["Q01_severity_totals"] = rep_sql("select count(*) filter (where severity >= 3) errors, count(*) filter (where severity = 2) warnings from rep")
QUERIES["Q02_summary_by_path"] = lambda spark, sf: Q.summary_by_path(findings(spark, sf), C.WARNING)
SQL["Q02_summary_by_path"] = rep_sql(
    "select path, count(*) filter (where severity >= 3) errors, count(*) filter (where severity = 2) warnings from rep where not chatty and severity >= 2 group by rollup (path)"
)


def statuses(spark: SparkSession, sf: str) -> DataFrame:
    rows = scripts(spark, sf).select("path", "script_id")
    status = F.when(F.col("script_id") % 9 == 0, "skipped").when(F.col("script_id") % 4 == 0, "changed").otherwise("unchanged")
    return rows.select("path", status.alias("status"))


QUERIES["Q03_traversal_summary"] = lambda spark, sf: Q.traversal_summary(statuses(spark, sf), findings(spark, sf), 100)
SQL["Q03_traversal_summary"] = rep_sql(
    """select count(*) filter (where script_id % 9 <> 0 and script_id % 4 = 0) changed, count(*) filter (where script_id % 9 <> 0 and script_id % 4 <> 0) unchanged,
  count(*) filter (where false) matches, count(*) filter (where script_id % 9 = 0) skipped, (select greatest(count(*) - 100, 0) from rep) not_printed from script"""
)


def _quality(spark: SparkSession, sf: str) -> DataFrame:
    rows = materialize(findings(spark, sf), "findings")
    return Q.code_quality(rows, chunk=chunk_width(rows, ["script_id"]))


QUERIES["Q04_code_quality"] = _quality
SQL["Q04_code_quality"] = rep_sql(
    """select message description, category check_name, case when n = 0 then fp else md5(concat(fp, '#', n)) end fingerprint,
  case severity when 0 then 'info' when 1 then 'minor' when 2 then 'major' when 3 then 'critical' else 'blocker' end severity, path, start_line + 1 as "begin"
from (select *, row_number() over (partition by fp order by start_byte, ord, message) - 1 n from (select *, md5(concat_ws('|', code, category, path)) fp from rep) a) b"""
)
QUERIES["Q05_junit"] = lambda spark, sf: Q.junit_cases(findings(spark, sf))
SQL["Q05_junit"] = rep_sql(
    f"""select path suite, '{Q.TEST_PREFIX}' package, concat('{Q.TEST_PREFIX}.', replace(category, '/', '.')) as name, start_line + 1 line, start_col + 1 as "column", message,
  concat('line ', start_line, ', col ', start_col, ', ', message) description from rep where not chatty"""
)
QUERIES["Q06_json"] = lambda spark, sf: Q.json_report(findings(spark, sf), "check", C.ERROR, True)
SQL["Q06_json"] = rep_sql(
    """select 'summary' part, concat('{"errors":', count(*) filter (where severity >= 3), ',"warnings":', count(*) filter (where severity = 2), ',"command":"check"}') json from rep
union all select 'diagnostic', concat('{"severity":"error","message":"', message, '","category":"', category, '","location":{"path":"', path, '","start":{"line":', start_line + 1, ',"column":', start_col + 1,
  '},"end":{"line":', end_line + 1, ',"column":', end_col + 1, '}}}') from rep where severity = 3"""
)
QUERIES["Q07_annotations"] = lambda spark, sf: Q.annotations(findings(spark, sf).withColumn("path", F.concat("path", F.lit(":1,a%"))))
SQL["Q07_annotations"] = rep_sql(
    """select concat('::', case severity when 3 then 'error' when 2 then 'warning' else 'notice' end, ' title=', category, ',file=', path, '%3A1%2Ca%25,line=', start_line + 1,
  ',endLine=', end_line + 1, ',col=', start_col + 1, ',endColumn=', end_col + 1, '::', message) as "value" from rep where not chatty"""
)
QUERIES["Q08_exit_status"] = lambda spark, sf: Q.exit_status(statuses(spark, sf), findings(spark, sf).filter(F.col("severity") < C.ERROR), error_on_warnings=True)
SQL["Q08_exit_status"] = rep_sql(
    "select count(*) filter (where severity >= 3) errors, count(*) filter (where severity = 2) warnings, 'warnings' reason, true failed from rep where severity < 3"
)

# ------------------------------------------------------------------ M: metrics and streams


def spans(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 2 == 0, "enter").otherwise("exit")
    return source(configure(spark), sf, "events").select(
        F.col("user_id").alias("span_id"), F.col("event_type").alias("callsite"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind")
    )


def timings(spark: SparkSession, sf: str) -> DataFrame:
    rows = spans(spark, sf)
    return MM.span_timings(rows, equi_depth(rows, ["callsite", "span_id"], F.unix_micros("at")))


QUERIES["M01_span_timing"] = timings
_TIMING = """select callsite, span_id, cast(sum(case when event_id % 2 = 1 then d else 0 end) as bigint) busy, cast(sum(case when event_id % 2 = 0 then d else 0 end) as bigint) idle, cast(sum(d) as bigint) total
from (select event_type callsite, user_id span_id, event_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) over (partition by event_type, user_id order by ts, event_id), 0) d from events) x group by 1, 2"""
SQL["M01_span_timing"] = _TIMING
QUERIES["M02_timing_histogram"] = lambda spark, sf: MM.histogram(timings(spark, sf))
SQL["M02_timing_histogram"] = (
    "select callsite, count(*) samples, round(avg(total), 3) mean, round(stddev_pop(total), 3) stdev, "
    + ", ".join(f"quantile_disc(total, {q}) q{i + 1}" for i, q in enumerate(MM.QUANTILES))
    + f" from ({_TIMING}) t group by callsite"
)

FEED = """
select user_id doc_id, event_id version, ts as at, case when event_type = 'error' then 'close' when event_type = 'click' then 'open' else 'change' end op,
  concat(event_type, ' ', cast(event_id as {S})) content from events"""


def feed(spark: SparkSession, sf: str) -> DataFrame:
    """The change feed as a stream over the events file."""
    events = MD.read_stream(configure(spark), sf, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    op = F.when(F.col("event_type") == "error", "close").when(F.col("event_type") == "click", "open").otherwise("change")
    return events.select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("version"), F.col("ts").alias("at"), op.alias("op"),
        F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("content"),
    )


QUERIES["M03_latest_document_version"] = lambda spark, sf: (
    MD.open_documents(MD.collected(MD.latest_versions(feed(spark, sf)), "versions", "update"))
)
SQL["M03_latest_document_version"] = f"""
with feed as ({table_sql(FEED)}) select doc_id, version, op, content from (select *, row_number() over (partition by doc_id order by version desc) rn from feed) x where rn = 1 and op <> 'close'"""


def _incremental(spark: SparkSession, sf: str) -> DataFrame:
    """All scripts arrive twice, some longer the second time; then some are closed, emptied, sent again or come late."""
    first = scripts(spark, sf).select(F.col("script_id").alias("doc_id"), F.lit(1).alias("version"), F.lit("open").alias("op"), "content")
    more = F.when(F.col("doc_id") % 3 == 0, F.concat("content", F.lit("\nDROP TABLE extra;\n"))).otherwise(F.col("content"))
    second = first.select("doc_id", F.lit(2).alias("version"), F.lit("change").alias("op"), more.alias("content"))
    closed = second.filter("doc_id % 7 = 1").select("doc_id", F.lit(3).alias("version"), F.lit("close").alias("op"), F.lit("").alias("content"))
    emptied = second.filter("doc_id % 7 = 2").select("doc_id", F.lit(3).alias("version"), "op", F.lit("").alias("content"))
    late = first.filter("doc_id % 4 = 0").select("doc_id", F.lit(0).alias("version"), "op", F.lit("DROP TABLE late;").alias("content"))
    path, root = new_path(spark, "feed"), new_path(spark, "incremental")
    linter = MD.IncrementalLint(spark, root, XQ.NAMES)
    for part in (first, second, closed.unionByName(emptied).unionByName(late), second.filter("doc_id % 5 = 0")):
        part.write.mode("append").parquet(path)
    stream = MD.read_stream(spark, path, "*.parquet", max_files=16)
    MD.run(stream, "incremental", linter.process)
    return linter.findings()


QUERIES["M04_incremental_lint"] = _incremental
SQL["M04_incremental_lint"] = XQ.sql(
    """select * from (select script_id doc_id, 2 version, stmt_no, ord, rule, message from fnd
union all select script_id, 2, n, 0, rule, message from (select script_id, cast(count(*) + 1 as int) n from stmt where script_id % 3 = 0 group by script_id) s,
  (values ('banDropTable', 'Dropping a table may break existing clients.'), ('preferRobustStmts', 'DROP TABLE should use IF EXISTS.')) v(rule, message)) x
where doc_id % 7 not in (1, 2)"""
)


def _rates(spark: SparkSession, sf: str) -> DataFrame:
    """Tumbling windows from the stream, sliding and session windows from the table."""
    live = MD.read_stream(configure(spark), sf, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    tumbling = MD.collected(MM.rate(live, F.window("ts", "6 hours"), "tumbling"), "rates", "update")
    newest = tumbling.groupBy("kind", "event_type", "start", "end").agg(F.max_by(F.struct("n", "total"), MD.BATCH).alias("v"))
    events = source(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    sliding = MM.rate(events, F.window("ts", "2 days", "1 day"), "sliding")
    session = MM.sessions(events, 1800, equi_depth(events, ["event_type"], F.unix_micros("ts")))
    rates = newest.select("kind", "event_type", "start", "end", "v.n", "v.total").unionByName(sliding).unionByName(session)
    return rates.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


QUERIES["M05_rates"] = _rates
SQL["M05_rates"] = """
with tumbling as (select 'tumbling' kind, event_type, time_bucket(interval '6 hours', ts, timestamp '1970-01-01') s, count(*) n, round(sum("value"), 2) total from events group by 1, 2, 3),
sliding as (select 'sliding' kind, event_type, time_bucket(interval '1 day', ts, timestamp '1970-01-01') - k * interval '1 day' s, count(*) n, round(sum("value"), 2) total from events, (values (0), (1)) v(k) group by 1, 2, 3),
g as (select *, case when ts - lag(ts) over (partition by event_type order by ts) < interval '30 minutes' then 0 else 1 end b from events),
i as (select *, sum(b) over (partition by event_type order by ts, event_id rows between unbounded preceding and current row) k from g),
ses as (select 'session' kind, event_type, min(ts) s, max(ts) + interval '30 minutes' e, count(*) n, round(sum("value"), 2) total from i group by event_type, k)
select kind, event_type, s as "start", s + interval '6 hours' as "end", n, total from tumbling union all select kind, event_type, s, s + interval '2 days', n, total from sliding
union all select kind, event_type, s, e, n, total from ses"""


def _deduplicated(spark: SparkSession, sf: str) -> DataFrame:
    twice = feed(spark, sf).union(feed(spark, sf))
    return MD.collected(MD.without_duplicates(twice, "60 days"), "changes").select("doc_id", "version", "op", "content")


QUERIES["M06_duplicate_changes"] = _deduplicated
SQL["M06_duplicate_changes"] = f"select doc_id, version, op, content from ({table_sql(FEED)}) f"

# ------------------------------------------------------------------ S: scalar functions

QUERIES["S01_text"] = lambda spark, sf: source(configure(spark), sf, "customer").select(
    "c_custkey", F.lower("c_name").alias("lowered"), F.trim(F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).alias("trimmed"),
    F.replace("c_name", F.lit("#"), F.lit("_")).alias("replaced"), F.startswith("c_mktsegment", F.lit("H")).alias("starts"),
    F.col("c_name").like("Customer_0000%1").alias("matches"),
)
SQL["S01_text"] = """select c_custkey, lower(c_name) lowered, trim(concat('  ', c_mktsegment, ' ')) trimmed, replace(c_name, '#', '_') replaced,
  starts_with(c_mktsegment, 'H') starts, c_name like 'Customer_0000%1' matches from customer"""
QUERIES["S02_format"] = lambda spark, sf: source(configure(spark), sf, "part").select(
    "p_partkey", S.format_text("Part `%s` of %s: %s%%", F.col("p_name"), F.col("p_brand"), F.nullif(F.col("p_size"), F.lit(7))).alias("label")
)
SQL["S02_format"] = "select p_partkey, concat('Part `', p_name, '` of ', p_brand, ': ', nullif(p_size, 7), '%%') label from part"


def _arrays(spark: SparkSession, sf: str) -> DataFrame:
    cols = S.int_list(F.col("indkey"))
    return relation(configure(spark), sf, "cat_index").select(
        "db_id", "indexrelid", S.has_prefix(cols, F.array(F.lit(2).cast("bigint"))).alias("starts_with_2"), F.array_contains(cols, F.lit(5).cast("bigint")).alias("has_5"),
        S.overlaps(cols.cast("array<string>"), ["3", "4"]).alias("meets"), F.size(cols).alias("n"), F.element_at(cols, -1).alias("last"),
        F.array_join(F.concat(S.array_fill(F.lit("f"), F.size(cols)), S.array_fill(F.lit("t"), F.lit(1))), ",").alias("filled"),
    )


QUERIES["S03_arrays"] = _arrays
SQL["S03_arrays"] = f"""with {cte(["cat_index"])} select db_id, indexrelid, indkey = '2' or indkey like '2 %' starts_with_2, list_contains(string_split(indkey, ' '), '5') has_5,
  list_has_any(string_split(indkey, ' '), ['3', '4']) meets, cast(len(string_split(indkey, ' ')) as int) n, cast(string_split(indkey, ' ')[-1] as bigint) as last,
  concat(repeat('f,', cast(len(string_split(indkey, ' ')) as int)), 't') filled from cat_index"""
QUERIES["S04_split_setting"] = lambda spark, sf: relation(configure(spark), sf, "cat_setting").select("db_id", "name", F.posexplode(S.split_setting(F.col("value"))).alias("place", "word"))
SQL["S04_split_setting"] = f"""with {cte(["cat_setting"])} select db_id, name, cast(i - 1 as int) place, trim(w) word from (select *, unnest(string_split(value, ',')) w, unnest(range(1, len(string_split(value, ',')) + 1)) i from cat_setting) x"""


def _json(spark: SparkSession, sf: str) -> DataFrame:
    meta = F.create_map(F.lit("schema"), F.col("s_name"), F.lit("name"), F.lit("x"), F.lit("nation"), F.col("s_nationkey").cast("string"))
    rest = S.without_keys(meta, ["schema", "name"])
    return source(configure(spark), sf, "supplier").select("s_suppkey", F.to_json(rest).alias("rest"), S.json_of(key=F.col("s_suppkey"), name=F.col("s_name")).alias("object"))


QUERIES["S05_json"] = _json
SQL["S05_json"] = """select s_suppkey, concat('{"nation":"', s_nationkey, '"}') rest, concat('{"key":', s_suppkey, ',"name":"', s_name, '"}') as "object" from supplier"""
QUERIES["S06_bits"] = lambda spark, sf: source(configure(spark), sf, "orders").select("o_orderkey", *[S.bit(F.col("o_orderkey"), b).alias(f"bit{b}") for b in (0, 1, 6)])
SQL["S06_bits"] = "select o_orderkey, o_orderkey & 1 <> 0 bit0, o_orderkey & 2 <> 0 bit1, o_orderkey & 64 <> 0 bit6 from orders"
QUERIES["S07_hashes"] = lambda spark, sf: source(configure(spark), sf, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))
SQL["S07_hashes"] = "select doc_id, md5(text) md5, sha256(text) sha256 from documents"
QUERIES["S08_numbers"] = lambda spark, sf: source(configure(spark), sf, "lineitem").select(
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.ceil(F.col("l_extendedprice") / 100).alias("up"), F.round(F.col("l_quantity") / 8, 1).alias("rounded"),
    S.int_div(F.col("l_partkey"), 8).alias("quotient"), F.col("l_quantity").cast("bigint").alias("whole"),
)
SQL["S08_numbers"] = """select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(ceil(l_extendedprice / 100) as bigint) up, round(l_quantity / 8, 1) rounded, l_partkey // 8 quotient,
  cast(trunc(l_quantity) as bigint) whole from lineitem"""
_SIZE = "cast(floor(l_extendedprice) as bigint) * (case l_linenumber when 1 then 1 when 2 then 700 when 3 then 90000 when 4 then 40000000 else 900000000 end)"
QUERIES["S09_pretty_size"] = lambda spark, sf: derived(spark, sf, "lineitem", f"select l_orderkey, l_linenumber, l_partkey, {_SIZE} size from lineitem").withColumn("pretty", S.pretty_size(F.col("size")))
SQL["S09_pretty_size"] = f"select *, {pretty('size')} pretty from (select l_orderkey, l_linenumber, l_partkey, {_SIZE} size from lineitem) x"
QUERIES["S10_regex"] = lambda spark, sf: source(configure(spark), sf, "documents").select(
    "doc_id", F.size(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("words"), F.size(F.split("text", "[.,]")).alias("parts"),
    F.get(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)), F.lit(0)).alias("first_number"),
)
SQL["S10_regex"] = """select doc_id, cast(len(regexp_extract_all(text, '[a-z]+')) as int) words, cast(len(string_split_regex(text, '[.,]')) as int) parts,
  regexp_extract_all(text, '[0-9]+')[1] first_number from documents"""
