"""Name resolution and ranking of catalog objects (R01-R08), in batch over tables of lookups.

Lookups join the catalog on (db_id, name) or, for ranking, on (db_id, pair of letters); every join is an equality,
and scores are column expressions. Equal lookups should be given once: a ranking depends on its context only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintfleet import constants as C
from lintfleet.functions import scalars as S
from lintfleet.operators.keyed import lookup, union_all
from lintfleet.plans import catalog_dims as K
from lintfleet.session import materialize
from lintfleet.sources.catalog import Catalog
from lintfleet.sources.globs import glob_to_regex

# ------------------------------------------------------------------ R01: lookup by name


def objects(cat: Catalog) -> DataFrame:
    """All named objects: db_id, kind, schema, table_name, name, is_primary_key."""
    none = F.lit(None).cast("string")
    no = F.lit(False)

    def rows(df: DataFrame, kind: str, schema: Column, table: Column, name: str, pk: Column = no) -> DataFrame:
        return df.select("db_id", F.lit(kind).alias("kind"), schema.alias("schema"), table.alias("table_name"), F.col(name).alias("name"), pk.alias("is_primary_key"))

    parts = [
        rows(K.tables(cat), "table", F.col("schema"), F.col("name"), "name"),
        rows(K.columns(cat), "column", F.col("schema_name"), F.col("table_name"), "name", F.col("is_primary_key")),
        rows(K.types(cat), "type", F.col("schema"), none, "name"),
        rows(K.functions(cat), "function", F.col("schema"), none, "name"),
        rows(K.schemas(cat), "schema", F.col("name"), none, "name"),
        rows(K.roles(cat), "role", none, none, "name"),
        rows(K.policies(cat), "policy", F.col("schema_name"), F.col("table_name"), "name"),
    ]
    return union_all(parts)


def unquoted(name: Column) -> Column:
    return F.replace(name, F.lit('"'), F.lit(""))


def find(lookups: DataFrame, known: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Objects of a kind whose name equals the lookup's, with optional schema and table qualifiers.

    `lookups`: lookup_id, db_id, kind, name, schema, table_name (qualifiers nullable). For columns the table
    qualifier may be an alias; `aliases` (lookup_id, alias, target) says of which table.
    """
    asked = lookups.select("lookup_id", "db_id", "kind", unquoted(F.col("name")).alias("name"),
                           unquoted(F.col("schema")).alias("q_schema"), unquoted(F.col("table_name")).alias("q_table"))
    if aliases is not None:
        named = aliases.select("lookup_id", F.col("alias").alias("q_table"), "target")
        asked = asked.join(named, ["lookup_id", "q_table"], "left").withColumn("q_table", F.coalesce("target", "q_table")).drop("target")
    # an object answers to each way its kind is asked for, with or without a qualifier, so qualifiers are join keys too and a
    # common name makes no pairs that do not fit; kinds that nobody asks for are not moved
    shapes = asked.select("kind", F.col("q_schema").isNotNull().alias("schema"), F.col("q_table").isNotNull().alias("table_name")).distinct()
    shape = "struct<kind:string,schema:boolean,table_name:boolean>"  # at most four for each of the few kinds
    asked_for = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in s.asDict().items()]) for s in shapes.filter("kind is not null").collect()])

    def answers(s: Column) -> Column:
        return (s["kind"] == F.col("kind")) & (~s["schema"] | F.col("schema").isNotNull()) & (~s["table_name"] | F.col("table_name").isNotNull())

    answering = known.withColumn("_as", F.explode(F.filter(asked_for.cast(f"array<{shape}>"), answers)))
    answering = answering.withColumns({f"_{c}": F.when(F.col(f"_as.{q}"), F.col(q)) for c, q in (("schema", "schema"), ("table", "table_name"))})
    same = [F.col(f"a.{c}") == F.col(f"k.{c}") for c in ("db_id", "kind", "name")]
    fits = [F.col("a.q_schema").eqNullSafe(F.col("k._schema")), F.col("a.q_table").eqNullSafe(F.col("k._table"))]
    found = asked.alias("a").join(answering.alias("k"), same + fits)
    return found.select("a.lookup_id", "a.db_id", "a.kind", "k.schema", "k.table_name", "a.name")


# ------------------------------------------------------------------ R02, R03: literals and overloads

# Built-in types a literal may have.
LITERAL_TYPES = {"int": ["int2", "int4", "int8"], "float": ["float4", "float8"], "bool": ["bool"], "string": ["text", "varchar"]}


def literal_types(literals: DataFrame, cat: Catalog) -> DataFrame:
    """Type ids each literal (literal_id, db_id, literal, value) may have. A null literal fits every type and gets no row.

    Strings also fit enums with that label: an equality on (db_id, label) against the exploded labels. Of equal rows one comes out.
    """
    kinds = [F.struct(F.lit(k).alias("literal"), F.lit(t).alias("name")) for k, ts in LITERAL_TYPES.items() for t in ts]
    types = K.types(cat)
    builtin = types.filter(F.col("schema") == "pg_catalog").withColumn("_k", F.explode(F.array(*kinds)))
    builtin = builtin.filter(F.col("name") == F.col("_k.name")).select("db_id", F.col("_k.literal").alias("literal"), F.col("id").alias("type_id"))
    builtin = materialize(builtin.distinct(), "builtin")
    texts = builtin.filter(F.col("literal") == "string").select("db_id", "type_id")
    labels = types.select("db_id", F.col("id").alias("type_id"), F.explode(F.array_distinct("enums")).alias("value")).distinct()
    labels = materialize(labels.join(texts, ["db_id", "type_id"], "left_anti"), "labels")

    # Pairs can be as many as literals times types, so they are never shuffled: repeats go before the joins. Only ids given
    # with several literals may still meet a type twice.
    value = F.when(F.col("literal") == "string", F.col("value"))
    given = literals.groupBy("literal_id", "db_id").agg(F.collect_set(F.struct("literal", value.alias("value"))).alias("_given"))

    def paired(ids: DataFrame) -> DataFrame:
        rows = ids.select("literal_id", "db_id", F.inline("_given"))
        by_kind = lookup(rows.drop("value"), builtin, ["db_id", "literal"], "inner")
        by_label = lookup(rows.filter(F.col("literal") == "string").drop("literal"), labels, ["db_id", "value"], "inner")
        return union_all([found.select("literal_id", "db_id", "type_id") for found in (by_kind, by_label)])

    return paired(given.filter(F.size("_given") == 1)).unionByName(paired(given.filter(F.size("_given") > 1)).distinct())


def typed_functions(cat: Catalog) -> DataFrame:
    """Functions with, per argument, the type's name, schema and labels, so that overloads are judged in their row."""
    fns = K.functions(cat).select("db_id", "id", "schema", "name", "args")
    types = K.types(cat).select("db_id", F.col("id").alias("type_id"), F.col("name").alias("type_name"), F.col("schema").alias("type_schema"), "enums")
    described = (
        fns.select("db_id", "id", F.posexplode("args").alias("i", "a")).select("db_id", "id", "i", "a.type_id")
        .join(types, ["db_id", "type_id"], "left")
        .groupBy("db_id", "id")
        .agg(F.array_sort(F.collect_list(F.struct("i", "type_id", "type_name", "type_schema", "enums"))).alias("arg_types"))
    )
    return fns.join(described, ["db_id", "id"], "left")


def resolve_calls(calls: DataFrame, cat: Catalog) -> DataFrame:
    """The one function each call can mean, else null.

    `calls`: call_id, db_id, schema (nullable), name, args (array of struct literal, value). Calls of equal signature
    are judged once, so many calls of one popular function do not multiply.
    """
    signature = ["db_id", "schema", "name", "args"]
    keyed = calls.withColumn("_sig", F.xxhash64(*signature))
    distinct = keyed.groupBy("_sig", "db_id").agg(*[F.first(c).alias(c) for c in ("schema", "name", "args")])
    fns = typed_functions(cat).select(
        "db_id", F.col("id").alias("function_id"), F.col("schema").alias("fn_schema"), "name", F.col("args").alias("fn_args"), "arg_types"
    )
    n, total = F.size("args"), F.size("fn_args")
    with_entry = F.size(F.filter("fn_args", lambda a: a["has_default"].isNotNull()))

    def fits(given: Column, wanted: Column) -> Column:
        kind = given["literal"]
        pg = wanted["type_schema"] == "pg_catalog"
        by_name = F.lit(False)
        for literal, names in LITERAL_TYPES.items():
            by_name = by_name | ((kind == literal) & pg & wanted["type_name"].isin(names))
        label = (kind == "string") & F.array_contains(wanted["enums"], given["value"])
        return (kind == "null") | F.coalesce(by_name, F.lit(False)) | F.coalesce(label, F.lit(False))

    paired = F.zip_with("args", F.slice(F.coalesce("arg_types", F.array()), 1, n), fits)
    arity = (total >= n) & (total - with_entry <= n)
    named = distinct.join(fns, ["db_id", "name"]).filter(arity & (F.col("schema").isNull() | (F.col("schema") == F.col("fn_schema"))))
    matching = named.filter(F.when(n == 0, True).otherwise(F.forall(paired, lambda ok: F.coalesce(ok, F.lit(False)))))
    single = matching.groupBy("_sig", "db_id").agg(F.count("*").alias("n"), F.max("function_id").alias("function_id")).filter("n = 1")
    return keyed.join(single.drop("n"), ["_sig", "db_id"], "left").select("call_id", "db_id", "function_id")


# ------------------------------------------------------------------ R04: candidate ranking

# Weights of the ranking.
SYSTEM_SCHEMAS = ["pg_catalog", "information_schema", "pg_toast"]
BUILTIN_ROLES = [
    "pg_read_all_data", "pg_write_all_data", "pg_read_all_settings", "pg_read_all_stats", "pg_stat_scan_tables", "pg_monitor",
    "pg_database_owner", "pg_signal_backend", "pg_read_server_files", "pg_write_server_files", "pg_execute_server_program",
    "pg_checkpoint", "pg_maintain", "pg_use_reserved_connections", "pg_create_subscription", "postgres",
]
SCHEMA_CLAUSES = ["from", "join", "update", "delete", "alter_policy", "drop_policy", "create_policy"]
CLAUSE_WEIGHTS = {
    "table": {"update": 10, "delete": 10, "from": 5, "join": 5},
    "function": {"from": 0, "check_or_using": 0},
    "column": {"where": 10, "check_or_using": 0},
    "policy": {"alter_policy": 25, "drop_policy": 25},
    "role": {"alter_role": 25, "drop_role": 25},
}
CLAUSE_DEFAULTS = {"table": -50, "function": -50, "column": -15, "schema": -50, "policy": -50, "role": -50}
LIMIT = 50


def has_text(col: str, part: str) -> Column:
    return F.coalesce(F.col(col).contains(part), F.lit(False))


def own_score() -> Column:
    """What an object scores by itself and by the call and qualifier around it."""
    kind, schema = F.col("kind"), F.col("schema")
    public = F.when(schema == "public", F.when(kind == "schema", -2).otherwise(2)).otherwise(0)
    migrations = has_text("name", "migrations") | has_text("table_name", "migrations") | has_text("schema", "migrations")
    well_known = F.when(F.col("table_name").isin(C.MIGRATION_TABLES), -10).otherwise(0) + F.when(schema.isin(C.MIGRATION_SCHEMAS), -10).otherwise(0)
    invoked = F.when(F.col("is_invocation"), F.when(kind == "function", 30).otherwise(-10)).otherwise(F.when(kind == "function", -10).otherwise(0))
    qualified = F.when(
        F.col("qualifier").isNotNull() & kind.isin("table", "function"), F.when(F.col("qualifier") == schema, 25).otherwise(-10)
    ).otherwise(0)
    user_defined = F.when(kind == "role", F.when(F.col("name").isin(BUILTIN_ROLES), -20).otherwise(0)).otherwise(
        F.when(schema.isin(SYSTEM_SCHEMAS), -20).otherwise(0) + F.coalesce(public, F.lit(0)) + F.when(migrations, -15).otherwise(0)
    )
    keyword = F.when(kind == "keyword", -10).otherwise(0)
    return keyword + user_defined + invoked + qualified + well_known


def clause_score() -> Column:
    """How well a kind of object fits the clause."""
    kind, clause, mentioned = F.col("kind"), F.col("clause"), F.col("has_mentions")
    out = F.when(clause.isNull() | (kind == "keyword"), 0)
    out = out.when((kind == "function") & (clause == "select"), F.when(mentioned, 0).otherwise(15))
    out = out.when((kind == "column") & (clause == "select"), F.when(mentioned, 10).otherwise(0))
    out = out.when((kind == "column") & (clause == "join_on"), F.when(F.col("is_primary_key"), 20).otherwise(10))
    out = out.when((kind == "schema") & clause.isin(SCHEMA_CLAUSES) & F.col("qualifier").isNull(), 15)
    for name, weights in CLAUSE_WEIGHTS.items():
        for where, weight in weights.items():
            out = out.when((kind == name) & (clause == where), weight)
    for name, weight in CLAUSE_DEFAULTS.items():
        out = out.when(kind == name, weight)
    return out.otherwise(0)


def statement_score() -> Column:
    """Relations and columns the statement already mentions. `mentions` holds {schema, name}; schema '' when not given."""
    owned = F.col("kind").isin("column", "policy")
    with_schema = F.exists("mentions", lambda m: (m["schema"] == F.col("schema")) & (m["name"] == F.col("table_name")))
    by_name = F.exists("mentions", lambda m: (m["schema"] == "") & (m["name"] == F.col("table_name")))
    already = (F.col("kind") == "column") & F.array_contains("mentioned_columns", F.col("name"))
    return F.when(owned, F.when(with_schema, 45).when(by_name, 30).otherwise(0)).otherwise(0) + F.when(already, -10).otherwise(0)


def checked_text() -> Column:
    """The text a lookup is matched with: the name, or table.name after a schema qualifier; null skips the object."""
    qualifier = F.col("qualifier")
    return (
        F.when(qualifier.isNull(), F.lower("name"))
        .when(qualifier == F.col("schema"), F.lower(F.concat_ws(".", "table_name", "name")))
        .when(qualifier == F.col("table_name"), F.lower("name"))
    )


def text_score(query: Column, text: Column) -> Column:
    """R04d: null when the letters of the query do not occur in order; else a score for closeness, +20 for a prefix.

    The reference takes this number from an outside library; ours orders alike but is not equal to it.
    """
    pattern = F.concat(F.lit("^.*"), F.array_join(F.transform(F.split(query, ""), lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))), ".*"))
    length = F.length(query)
    base = length * 16 - F.least(F.length(text) - length, F.lit(15)) + F.when(text.startswith(query), 20).otherwise(0)
    share = F.when(text == F.lower("name"), F.floor(base / 2)).otherwise(F.floor(base / 3)).cast("int")
    return F.when(F.regexp_like(text, pattern), share)


ITEM = ["db_id", "kind", "schema", "table_name", "name", "is_primary_key"]
MATCH_KEY = ["db_id", "query", "qualifier"]


def matches(contexts: DataFrame, known: DataFrame) -> DataFrame:
    """Objects each distinct (db_id, query, qualifier) matches, with the text score.

    Objects and queries meet on database and a pair of letters: a query can only occur in order in a text that has
    its first two letters in order. Only pairs some query begins with are kept before the join, and contexts that
    share a query share its matching.
    """
    asked = contexts.select(*MATCH_KEY).distinct().withColumn("_q", F.lower(unquoted(F.col("query"))))
    asked = asked.withColumn("pair", F.substring("_q", 1, 2))
    needed = asked.groupBy("db_id").agg(F.collect_set("pair").alias("_pairs"))  # at most the square of the alphabet
    text = F.lower(F.concat_ws(".", "table_name", "name"))

    def in_order(pair: Column) -> Column:
        first, second = F.substring(pair, 1, 1), F.substring(pair, 2, 1)
        at = F.instr(F.col("_text"), first)
        return (at > 0) & ((second == "") | F.substring(F.col("_text"), at + 1, F.length("_text")).contains(second))

    items = lookup(known.withColumn("_text", text), needed, ["db_id"], "inner")
    items = items.withColumn("pair", F.explode(F.filter("_pairs", in_order))).select(*ITEM, "pair")
    joined = asked.join(items, ["db_id", "pair"]).withColumn("_text", checked_text())
    scored = joined.withColumn("match_score", text_score(F.col("_q"), F.col("_text")))
    return scored.filter("match_score is not null").select(*ITEM, "query", "qualifier", "match_score")


def candidates(contexts: DataFrame, known: DataFrame) -> DataFrame:
    """Matching objects per context. `contexts`: context_id, db_id, query, qualifier, clause, is_invocation,
    has_mentions, mentions, mentioned_columns."""
    found = matches(contexts, known).withColumn("_qualifier", F.coalesce("qualifier", F.lit(""))).drop("qualifier")
    asked = contexts.withColumn("_qualifier", F.coalesce("qualifier", F.lit("")))
    return found.join(asked, ["db_id", "query", "_qualifier"]).drop("_qualifier")


def scored(contexts: DataFrame, known: DataFrame) -> DataFrame:
    rows = candidates(contexts, known)
    total = own_score() + clause_score() + statement_score() + F.col("match_score")
    return rows.select("context_id", "db_id", "kind", "schema", "table_name", F.col("name").alias("label"), total.cast("int").alias("score"))


def rank(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Order by score and label, drop a label that repeats the one before, keep the first `limit`, preselect a clear winner.

    Equal (score, label) pairs are merged before any shuffle of full rows. Two neighbours in the order can then only
    share a label across a score boundary, so the repeat test needs one small row per (context, score), not the
    sorted list. The final ranking is limited before the shuffle.
    """
    merged = rows.groupBy("context_id", "score", "label").agg(F.min(F.struct("kind", "schema", "table_name")).alias("o"))
    edges = merged.groupBy("context_id", "score").agg(F.min("label").alias("first_label"), F.max("label").alias("last_label"), F.count("*").alias("n"))
    by_score = Window.partitionBy("context_id").orderBy(F.col("score").desc())
    edges = edges.withColumn("above", F.lag("last_label").over(by_score))
    repeated = F.coalesce(F.col("above") == F.col("first_label"), F.lit(False))
    edges = edges.withColumn("repeats", repeated)
    kept_here = F.col("n") - F.col("repeats").cast("int")
    edges = edges.withColumn("before", F.coalesce(F.sum(kept_here).over(by_score.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    edges = edges.filter(F.col("before") < limit).select("context_id", "score", "first_label", "repeats")
    kept = merged.join(edges, ["context_id", "score"]).filter(~(F.col("repeats") & (F.col("label") == F.col("first_label"))))
    order = Window.partitionBy("context_id").orderBy(F.col("score").desc(), "label")
    top = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    every = Window.partitionBy("context_id")
    top = top.withColumn("n", F.count("*").over(every)).withColumn("second", F.max(F.when(F.col("rank") == 2, F.col("score"))).over(every))
    lead_enough = F.coalesce(F.col("score") - F.col("second") > 15, F.col("second").isNull())
    width = F.length(F.col("n").cast("string"))
    return top.select(
        "context_id", "rank", "label", F.col("o.kind").alias("kind"), F.col("o.schema").alias("schema"), "score",
        ((F.col("rank") == 1) & lead_enough & (F.col("n") >= 10)).alias("preselected"),
        F.lpad((F.col("rank") - 1).cast("string"), width, F.lit("0")).alias("sort_text"),
    )


# ------------------------------------------------------------------ R05: relevance of found objects


def table_relevance() -> Column:
    """R05a for tables; `mentions` as in `statement_score`."""
    exact = F.exists("mentions", lambda m: (m["schema"] == F.col("schema")) & (m["name"] == F.col("name")))
    by_name = F.exists("mentions", lambda m: (m["schema"] == "") & (m["name"] == F.col("name")))
    same_schema = F.exists("mentions", lambda m: m["schema"] == F.col("schema"))
    return F.when(exact, 200).when(by_name, 150).when(same_schema, 50).when(F.col("schema") == "public", 10).otherwise(0)


def column_relevance() -> Column:
    """R05a for columns; `q_table` is already resolved from an alias."""
    fits = (F.col("q_table") == F.col("table_name")) & F.coalesce(F.col("q_schema") == F.col("schema"), F.lit(True))
    qualified = F.when(F.coalesce(fits, F.lit(False)), F.when(F.col("q_schema").isNotNull(), 300).otherwise(250)).otherwise(0)
    exact = F.exists("mentions", lambda m: (m["schema"] == F.col("schema")) & (m["name"] == F.col("table_name")))
    by_name = F.exists("mentions", lambda m: (m["schema"] == "") & (m["name"] == F.col("table_name")))
    score = qualified + F.when(exact, 150).when(by_name, 100).otherwise(0)
    return F.when(score > 0, score).when(F.col("schema") == "public", 10).when(F.col("is_primary_key"), 5).otherwise(0)


def cut_by_relevance(rows: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Keeps results from the best down to the first gap of more than 30 % of the score before.

    Equal scores leave no gap, so the cut is found on the few distinct scores per key and joined back.
    """
    scores = rows.select(*keys, score).distinct()
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc())
    before = F.lag(score).over(order)
    gap = F.coalesce((before - F.col(score)) > before * 0.3, F.lit(False))
    marked = scores.withColumn("_gap", gap)
    open_ = F.max(F.col("_gap").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 0
    kept = marked.withColumn("_open", open_).filter("_open").select(*keys, score)
    return rows.join(kept, [*keys, score], "left_semi")


# ------------------------------------------------------------------ R06, R08: defaults


def basic_default(expr: Column) -> Column:
    """The plain literal of a default: casts and brackets removed, calls and anything else null."""
    parts = F.split(expr, "::")
    casts = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    clean = F.forall(casts, lambda c: F.trim(c).rlike(r'^[A-Za-z0-9 _."\[\](),]*$'))
    whole = F.get(parts, F.lit(0))
    # brackets come off in pairs, and one left over could not pass the character test below
    opening, closing = F.regexp_extract(whole, r"^[\s(]*", 0), F.regexp_extract(whole, r"[\s)]*$", 0)
    paired = F.regexp_count(opening, F.lit(r"\(")) == F.regexp_count(closing, F.lit(r"\)"))
    value = F.regexp_replace(whole, r"^[\s(]+|[\s)]+$", "")
    value = F.when(value.rlike(r"(?s)^'.*'$") & (F.length(value) > 1), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    value = F.trim(value)
    return F.when(clean & paired & value.rlike(r"^[A-Za-z0-9 _.\-]+$"), value)


# The literal standing for each type.
TYPE_DEFAULTS = {
    "0": ["smallint", "int2", "integer", "int", "int4", "bigint", "int8", "decimal", "numeric", "real", "float4", "double precision",
          "float8", "smallserial", "serial2", "serial", "serial4", "bigserial", "serial8"],
    "false": ["boolean", "bool"],
    "''": ["character", "char", "character varying", "varchar", "text", "tsvector", "tsquery", "xml"],
    "'1970-01-01'": ["date"], "'00:00:00'": ["time", "time without time zone"], "'00:00:00+00'": ["time with time zone", "timetz"],
    "'1970-01-01 00:00:00'": ["timestamp", "timestamp without time zone"],
    "'1970-01-01 00:00:00+00'": ["timestamp with time zone", "timestamptz"], "'0'": ["interval"], "'null'": ["json", "jsonb"],
    "'00000000-0000-0000-0000-000000000000'": ["uuid"], "'\\x'": ["bytea"], "'0.0.0.0'": ["inet"], "'0.0.0.0/0'": ["cidr"],
    "'00:00:00:00:00:00'": ["macaddr"], "'00:00:00:00:00:00:00:00'": ["macaddr8"], "'0.00'": ["money"], "'(0,0)'": ["point"],
    "'{0,0,0}'": ["line"], "'[(0,0),(0,0)]'": ["lseg"], "'((0,0),(0,0))'": ["box", "path"], "'((0,0),(0,0),(0,0))'": ["polygon"],
    "'<(0,0),0>'": ["circle"], "'0/0'": ["pg_lsn"],
}


def type_default(name: Column, enums: Column, is_array: Column) -> Column:
    """An enum's first label, else the literal of the type, else NULL; arrays are wrapped."""
    by_name = {n: literal for literal, names in TYPE_DEFAULTS.items() for n in names}
    literal = S.lookup_map(name, by_name, F.lit("NULL"))
    single = F.when(F.size(enums) > 0, F.concat(F.lit("'"), F.get(enums, F.lit(0)), F.lit("'"))).otherwise(literal)
    return F.when(is_array, F.concat(F.lit("'{"), single, F.lit("}'"))).otherwise(single)


# ------------------------------------------------------------------ R07: unresolved references


def search_path(schemas: DataFrame, globs: list[str]) -> DataFrame:
    """(db_id, schema, place): schemas in the order of the globs that name them, `public` last."""
    place = F.lit(None).cast("int")
    for i, glob in reversed(list(enumerate(globs))):
        place = F.when(F.col("name").rlike(glob_to_regex(glob)), i).otherwise(place)
    rows = schemas.select("db_id", F.col("name").alias("schema"), place.alias("place"))
    return rows.withColumn("place", F.coalesce("place", F.when(F.col("schema") == "public", len(globs)))).filter("place is not null")


def unresolved(mentions: DataFrame, cat: Catalog, globs: list[str]) -> DataFrame:
    """Relations a statement names that its database does not have: by schema, or anywhere on the search path.

    `mentions`: db_id, schema ('' when not given), name, plus any other columns.
    """
    tables = K.tables(cat).select("db_id", "schema", "name")
    path = search_path(K.schemas(cat), globs).select("db_id", "schema")
    on_path = tables.join(path, ["db_id", "schema"], "left_semi").withColumn("schema", F.lit(""))
    known = tables.unionByName(on_path)
    # names are judged once; a name that very many statements mention is then spread by the lookup
    keys = ["db_id", "schema", "name"]
    missing = materialize(mentions.select(*keys).distinct().join(known, keys, "left_anti"), "missing")
    return lookup(mentions, missing, keys, "left_semi")
