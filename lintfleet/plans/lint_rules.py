"""Migration lint rules (L01-L52) over statement facts and transaction state.

A rule that only reads its own statement is a column expression giving an array of (ord, message); all of them are
evaluated in one pass and exploded once. Rules that read state name what they need, and the state is added first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintfleet import constants as C
from lintfleet.functions import scalars as S
from lintfleet.functions.arrays import pin
from lintfleet.operators.keyed import lookup, union_all
from lintfleet.operators.scan import Chunks
from lintfleet.plans import catalog_dims as K
from lintfleet.plans import facts as FX
from lintfleet.plans import txstate as W
from lintfleet.plans.lint_messages import MESSAGES
from lintfleet.registry import LINT_RULES as RULES
from lintfleet.registry import LintRule
from lintfleet.sources.catalog import Catalog

HIT = "struct<ord:int,message:string>"


def rule(id: str, name: str, severity: int = C.WARNING, recommended: bool = False, needs: list[str] | None = None):
    def add(hits: Callable[[], Column]):
        RULES[id] = LintRule(id, name, severity, recommended, needs=needs or [], hits=hits)
        return hits

    return add


def catalog_rule(id: str, name: str, recommended: bool):
    def add(build: Callable[..., DataFrame]):
        RULES[id] = LintRule(id, name, C.WARNING, recommended, build=build)
        return build

    return add


def _message(key: str, *args: Column) -> Column:
    return S.format_text(MESSAGES[key], *args)


def _none() -> Column:
    return F.array().cast(f"array<{HIT}>")


def on_statement(condition: Column, message: Column) -> Column:
    hit = F.struct(F.lit(0).alias("ord"), message.alias("message"))
    return F.when(F.coalesce(condition, F.lit(False)), F.array(hit)).otherwise(_none())


def each(array: str, condition: Callable[[Column], Column], message: Column | Callable[[Column], Column]) -> Column:
    text = message if callable(message) else lambda _: message
    return F.transform(
        F.filter(array, lambda x: F.coalesce(condition(x), F.lit(False))),
        lambda x: F.struct(x["ord"].alias("ord"), text(x).alias("message")),
    )


def kind(*names: str) -> Column:
    return F.col("kind").isin(*names)


def subtype(*names: str) -> Callable[[Column], Column]:
    return lambda c: c["subtype"].isin(*names)


def column_type(names: list[str], contexts: list[str], key: str) -> Column:
    return each("columns", lambda c: c["context"].isin(contexts) & F.arrays_overlap(c["type_names"], F.array(*map(F.lit, names))), _message(key))


def full_name() -> Column:
    return F.concat(W.schema_or_public(), F.lit("."), F.col("rel_name"))


EVERYWHERE = ["create", "add", "alter_type"]
# Type names the column rules look for.
SERIAL_TYPES = ["serial", "bigserial", "smallserial", "serial2", "serial4", "serial8"]
SERIAL_COLUMN_TYPES = SERIAL_TYPES + ["pg_catalog.serial", "pg_catalog.bigserial", "pg_catalog.smallserial"]
SMALLER_THAN_BIGINT = ["smallint", "integer", "int2", "int4", "serial", "serial2", "serial4", "smallserial"]
CHAR_TYPES = ["bpchar", "char", "character"]


@rule("L01", "addSerialColumn", recommended=True)
def _() -> Column:
    def type_text(c: Column) -> Column:
        return F.array_join(c["type_names"], ".")

    def generated(c: Column) -> Column:
        return F.exists("constraints", lambda k: (k["ord"] == c["ord"]) & (k["contype"] == "generated") & (k["generated_when"] == "a"))

    def serial(c: Column) -> Column:
        return type_text(c).isin(SERIAL_COLUMN_TYPES)

    return each(
        "columns",
        lambda c: (c["context"] == "add") & (serial(c) | generated(c)),
        lambda c: F.when(serial(c), _message("addSerialColumn", type_text(c))).otherwise(_message("addSerialColumn.generated")),
    )


def safe_functions(cat: Catalog) -> DataFrame:
    """(db_id, schema or '', name) of non-volatile functions without arguments."""
    found = K.functions(cat).filter((F.size("args") == 0) & (F.col("behavior") != "VOLATILE"))
    found = found.select("db_id", F.explode(F.array(F.lit(""), F.col("schema"))).alias("default_schema"), F.col("name").alias("default_function"))
    return found.distinct().withColumn("is_safe", F.lit(True))


@catalog_rule("L02", "addingFieldWithDefault", True)
def adding_field_with_default(facts: DataFrame, cat: Catalog | None) -> DataFrame:
    """Without a catalog the server counts as older than 11, where every default rewrites the table."""
    wanted = F.filter("constraints", lambda c: (c["context"] == "add_column") & c["contype"].isin("generated", "default"))
    keys = ["script_id", "pos"] if cat is None else ["script_id", "pos", "db_id"]
    rows = facts.select(*keys, F.inline(wanted))
    # a generated column hides its default
    per_column = rows.groupBy(*keys, "ord").agg(
        F.bool_or(F.col("contype") == "generated").alias("generated"),
        F.max("default_kind").alias("default_kind"),
        F.coalesce(F.max("default_schema"), F.lit("")).alias("default_schema"),
        F.max("default_function").alias("default_function"),
    )
    if cat is None:
        message = F.when(F.col("generated"), _message("addingFieldWithDefault.generated")).otherwise(_message("addingFieldWithDefault"))
        return per_column.select("script_id", "pos", "ord", message.alias("message"))
    # both are side tables of a database, whose statements may be a large part of the corpus
    known = lookup(per_column, K.major_versions(cat), ["db_id"])
    known = lookup(known, safe_functions(cat), ["db_id", "default_schema", "default_function"])
    modern = F.coalesce(F.col("major_version") >= 11, F.lit(False))
    safe = (F.col("default_kind") == "constant") | F.coalesce("is_safe", F.lit(False))
    message = (
        F.when(F.col("generated"), _message("addingFieldWithDefault.generated"))
        .when(modern, F.when(~safe, _message("addingFieldWithDefault.volatile")))
        .otherwise(_message("addingFieldWithDefault"))
    )
    return known.select("script_id", "pos", "ord", message.alias("message")).filter("message is not null")


@rule("L03", "addingForeignKeyConstraint", recommended=True)
def _() -> Column:
    return each(
        "constraints",
        lambda c: c["context"].isin("add_constraint", "add_column") & (c["contype"] == "foreign") & ~c["skip_validation"],
        lambda c: F.when(c["context"] == "add_column", MESSAGES["addingForeignKeyConstraint.inline"]).otherwise(MESSAGES["addingForeignKeyConstraint"]),
    )


@catalog_rule("L04", "addingNotNullField", True)
def adding_not_null_field(facts: DataFrame, cat: Catalog | None) -> DataFrame:
    """Without a catalog the server counts as older than 11, which scans the whole table."""
    wanted = F.filter("commands", lambda c: c["subtype"] == "set_not_null")
    keys = ["script_id", "pos"] if cat is None else ["script_id", "pos", "db_id"]
    known = facts.select(*keys, F.inline(wanted)).select(*keys, "ord")
    if cat is not None:
        known = lookup(known, K.major_versions(cat), ["db_id"]).filter(F.coalesce(F.col("major_version") < 11, F.lit(True)))
    return known.select("script_id", "pos", "ord", _message("addingNotNullField").alias("message"))


@rule("L05", "addingPrimaryKeyConstraint", recommended=True)
def _() -> Column:
    return each(
        "constraints",
        lambda c: c["context"].isin("add_constraint", "add_column") & (c["contype"] == "primary") & (c["index_name"] == ""),
        _message("addingPrimaryKeyConstraint"),
    )


@rule("L06", "addingRequiredField", C.ERROR)
def _() -> Column:
    # judged on the whole statement, so one DEFAULT anywhere clears all its columns
    text = F.lower("masked")
    required = text.contains("not null") & ~text.contains("default")
    return each("commands", lambda c: (c["subtype"] == "add_column") & required, _message("addingRequiredField"))


@rule("L07", "avoidAddingExclusionConstraint", recommended=True)
def _() -> Column:
    return each(
        "constraints", lambda c: c["context"].isin("add_constraint", "create") & (c["contype"] == "exclusion"), _message("avoidAddingExclusionConstraint")
    )


@rule("L08", "avoidAlterEnumAddValue")
def _() -> Column:
    return on_statement(F.col("adds_value"), _message("avoidAlterEnumAddValue"))


@rule("L09", "avoidAttachingPartition", recommended=True)
def _() -> Column:
    return each("commands", subtype("attach_partition"), _message("avoidAttachingPartition"))


@rule("L10", "avoidCreateTrigger")
def _() -> Column:
    return on_statement(kind("create_trigger"), _message("avoidCreateTrigger"))


@rule("L11", "avoidEnableDisableTrigger")
def _() -> Column:
    switches = [f"{a}_trigger{b}" for a in ("enable", "disable") for b in ("", "_all", "_user")]
    return each("commands", subtype(*switches), _message("avoidEnableDisableTrigger"))


@rule("L12", "avoidWideLockWindow", recommended=True, needs=["locked_tables"])
def _() -> Column:
    wide = F.col("takes_access_exclusive") & (F.col("locks_before") > 0) & ~F.col("table_locked_before")
    return on_statement(wide, _message("avoidWideLockWindow", full_name()))


@rule("L13", "banCharField")
def _() -> Column:
    return column_type(CHAR_TYPES, ["create", "add"], "banCharField")


@rule("L14", "banConcurrentIndexCreationInTransaction", C.ERROR, recommended=True, needs=["neighbours"])
def _() -> Column:
    return on_statement(kind("create_index") & F.col("concurrent") & F.col("has_other_statements"), _message("banConcurrentIndexCreationInTransaction"))


@rule("L15", "banDeleteWithoutWhere", recommended=True)
def _() -> Column:
    return on_statement(kind("delete") & ~F.col("has_where"), _message("banDeleteWithoutWhere"))


@rule("L16", "banDropColumn", recommended=True)
def _() -> Column:
    return each("commands", subtype("drop_column"), _message("banDropColumn"))


@rule("L17", "banDropDatabase")
def _() -> Column:
    return on_statement(kind("drop_database"), _message("banDropDatabase"))


@rule("L18", "banDropNotNull", recommended=True)
def _() -> Column:
    return each("commands", subtype("drop_not_null"), _message("banDropNotNull"))


def drops(object_type: str) -> Column:
    return kind("drop") & (F.col("object_type") == object_type)


@rule("L19", "banDropSchema", C.ERROR, recommended=True)
def _() -> Column:
    return on_statement(drops("schema"), _message("banDropSchema"))


@rule("L20", "banDropTable", recommended=True)
def _() -> Column:
    return on_statement(drops("table"), _message("banDropTable"))


@rule("L21", "banDropTrigger")
def _() -> Column:
    return on_statement(drops("trigger"), _message("banDropTrigger"))


@rule("L22", "banTruncate", C.ERROR, recommended=True)
def _() -> Column:
    return on_statement(kind("truncate"), _message("banTruncate"))


@rule("L23", "banTruncateCascade", C.ERROR)
def _() -> Column:
    return on_statement(kind("truncate") & F.col("cascade"), _message("banTruncateCascade"))


@rule("L24", "banUpdateWithoutWhere", recommended=True)
def _() -> Column:
    return on_statement(kind("update") & ~F.col("has_where"), _message("banUpdateWithoutWhere"))


@rule("L25", "banVacuumFull", C.ERROR, recommended=True)
def _() -> Column:
    return on_statement(F.col("vacuum_full"), _message("banVacuumFull"))


@rule("L26", "changingColumnType")
def _() -> Column:
    last = lambda c: F.lower(F.element_at(c["type_names"], -1))
    safe = lambda c: (last(c) == "text") | (last(c).isin("varchar", "numeric", "decimal") & ~c["has_modifier"])
    return each("columns", lambda c: (c["context"] == "alter_type") & ~safe(c), _message("changingColumnType"))


@rule("L27", "concurrentRefreshMatviewLock")
def _() -> Column:
    return on_statement(kind("refresh") & F.col("concurrent"), _message("concurrentRefreshMatviewLock"))


@rule("L28", "constraintMissingNotValid")
def _() -> Column:
    return each(
        "constraints",
        lambda c: (c["context"] == "add_constraint") & c["contype"].isin("check", "foreign") & c["initially_valid"],
        _message("constraintMissingNotValid"),
    )


@rule("L29", "creatingEnum")
def _() -> Column:
    return on_statement(kind("create_enum"), _message("creatingEnum", F.col("type_name")))


@rule("L30", "disallowUniqueConstraint", C.ERROR, needs=["created_in_file"])
def _() -> Column:
    return each(
        "constraints",
        lambda c: (c["contype"] == "unique") & ~F.col("created_earlier_in_file")
        & (((c["context"] == "add_constraint") & (c["index_name"] == "")) | (c["context"] == "add_column")),
        _message("disallowUniqueConstraint"),
    )


@rule("L31", "lockTimeoutWarning", recommended=True, needs=["created"])
def _() -> Column:
    exposed = ~F.col("lock_timeout_set") & ~F.col("created_before")
    message = F.when(kind("alter_table"), _message("lockTimeoutWarning", full_name())).otherwise(
        _message("lockTimeoutWarning.index", full_name(), F.col("idx_name"))
    )
    return on_statement(exposed & (kind("alter_table") | (kind("create_index") & ~F.col("concurrent"))), message)


@rule("L32", "multipleAlterTable", recommended=True, needs=["earlier_alter"])
def _() -> Column:
    return on_statement(kind("alter_table") & F.col("altered_earlier_in_file"), _message("multipleAlterTable", full_name()))


@rule("L33", "preferBigInt")
def _() -> Column:
    return column_type(SMALLER_THAN_BIGINT, EVERYWHERE, "preferBigInt")


@rule("L34", "preferBigintOverInt")
def _() -> Column:
    return column_type(["integer", "int4", "serial", "serial4"], EVERYWHERE, "preferBigintOverInt")


@rule("L35", "preferBigintOverSmallint")
def _() -> Column:
    return column_type(["smallint", "int2", "smallserial", "serial2"], EVERYWHERE, "preferBigintOverSmallint")


@rule("L36", "preferIdentity")
def _() -> Column:
    return column_type(SERIAL_TYPES, EVERYWHERE, "preferIdentity")


@rule("L37", "preferJsonb")
def _() -> Column:
    return column_type(["json"], EVERYWHERE, "preferJsonb")


@rule("L38", "preferRobustStmts")
def _() -> Column:
    concurrent_index = kind("create_index") & F.col("concurrent")
    found = [
        (concurrent_index & (F.col("idx_name") == ""), "preferRobustStmts.name"),
        (concurrent_index & ~F.col("if_not_exists"), "preferRobustStmts.index"),
        (kind("drop") & F.col("concurrent") & ~F.col("if_exists"), "preferRobustStmts.drop"),
        (drops("table") & ~F.col("if_exists"), "preferRobustStmts.drop_table"),
        (kind("create_table") & ~F.col("if_not_exists"), "preferRobustStmts.create_table"),
    ]
    return F.concat(*[on_statement(condition, _message(key)) for condition, key in found])


@rule("L39", "preferTextField")
def _() -> Column:
    return each("columns", lambda c: F.array_contains(c["type_names"], "varchar") & c["has_modifier"], _message("preferTextField"))


@rule("L40", "preferTimestamptz")
def _() -> Column:
    return each("columns", lambda c: F.element_at(c["type_names"], -1) == "timestamp", _message("preferTimestamptz"))


@rule("L41", "renamingColumn")
def _() -> Column:
    return on_statement(kind("rename") & (F.col("object_type") == "column"), _message("renamingColumn"))


@rule("L42", "renamingTable")
def _() -> Column:
    return on_statement(kind("rename") & (F.col("object_type") == "table"), _message("renamingTable"))


@rule("L43", "requireConcurrentDetachPartition", recommended=True)
def _() -> Column:
    return each("commands", lambda c: (c["subtype"] == "detach_partition") & ~c["concurrent"], _message("requireConcurrentDetachPartition"))


@rule("L44", "requireConcurrentIndexCreation", needs=["created_in_file"])
def _() -> Column:
    exposed = kind("create_index") & ~F.col("concurrent") & (F.col("rel_name") != "") & ~F.col("created_in_file")
    return on_statement(exposed, _message("requireConcurrentIndexCreation"))


@rule("L45", "requireConcurrentIndexDeletion")
def _() -> Column:
    return on_statement(drops("index") & ~F.col("concurrent"), _message("requireConcurrentIndexDeletion"))


@rule("L46", "requireConcurrentRefreshMatview", recommended=True)
def _() -> Column:
    return on_statement(kind("refresh") & ~F.col("concurrent"), _message("requireConcurrentRefreshMatview"))


@rule("L47", "requireConcurrentReindex", recommended=True)
def _() -> Column:
    return on_statement(kind("reindex") & ~F.col("concurrent"), _message("requireConcurrentReindex"))


@rule("L48", "requireIdleInTransactionTimeout", needs=["created"])
def _() -> Column:
    return on_statement(W.is_dangerous_lock() & ~F.col("idle_in_transaction_timeout_set"), _message("requireIdleInTransactionTimeout"))


def _separate_validation(
    facts: DataFrame, cat: Catalog | None = None, chunk: Chunks | int | None = None, dealt: Callable[[DataFrame], DataFrame] = lambda df: df
) -> DataFrame:
    # of the arrays only what is looked into is moved
    read = {"commands": W.validates, "constraints": W.not_valid}
    slim = dealt(facts.select(*W.SLIM, *[F.filter(a, reads).alias(a) for a, reads in read.items()]))
    rows = W.with_validated(W.with_segment(slim, chunk), chunk).filter("added_in_transaction")
    message = _message("requireSeparateConstraintValidation", F.col("constraint_name"))
    return rows.select("script_id", "pos", "ord", message.alias("message"))


RULES["L49"] = LintRule("L49", "requireSeparateConstraintValidation", C.ERROR, True, build=_separate_validation)


@rule("L50", "requireStatementTimeout", needs=["created"])
def _() -> Column:
    return on_statement(W.is_dangerous_lock() & ~F.col("statement_timeout_set"), _message("requireStatementTimeout"))


@rule("L51", "runningStatementWhileHoldingAccessExclusive", recommended=True, needs=["locks"])
def _() -> Column:
    return on_statement(F.col("holding_access_exclusive"), _message("runningStatementWhileHoldingAccessExclusive"))


@rule("L52", "transactionNesting", needs=["first_transaction"])
def _() -> Column:
    tx = F.col("tx_kind")
    begins = tx.isin("begin", "start")
    return F.concat(
        on_statement(begins & F.col("first_transaction").isin("begin", "start"), _message("transactionNesting.nested")),
        on_statement(begins, _message("transactionNesting.begin")),
        on_statement(tx.isin("commit", "rollback"), _message("transactionNesting.end")),
    )


# ------------------------------------------------------------------ driver

# Which arrays of facts a rule looks into, beside the one that state is built from.
_READS = {
    "commands": ["L04", "L06", "L09", "L11", "L16", "L18", "L43", "L49"],
    "columns": ["L01", "L13", "L26", "L33", "L34", "L35", "L36", "L37", "L39", "L40"],
    "constraints": ["L01", "L02", "L03", "L05", "L07", "L28", "L30", "L49"],
}
_PLAIN = ["L08", "L10", "L15", "L17", "L19", "L20", "L21", "L22", "L23", "L24", "L25", "L27", "L29", "L38", "L41", "L42", "L45", "L46", "L47"]


def arrays_of(rules: list[str] | None = None) -> list[str]:
    """The arrays of facts that the named rules (None: all) need; a rule not listed here may need any."""
    found: set[str] = set()
    for r in RULES.values():
        if rules is not None and r.name not in rules:
            continue
        reads = [a for a, ids in _READS.items() if r.id in ids]
        if r.needs:
            reads.append("commands")
            reads += ["constraints"] if r.needs[0] == "created_in_file" else []
        found.update(reads if reads or r.id in _PLAIN else FX.ARRAYS)
    return [a for a in FX.ARRAYS if a in found]

# state chains that one pass can serve together
_FAMILIES = [["locked_tables", "locks", "created"], ["neighbours"], ["first_transaction"], ["created_in_file"], ["earlier_alter"]]


def _hit_rows(state: DataFrame, rules: list[LintRule], carry: list[str]) -> DataFrame:
    # kept in a column: the optimizer also asks for the size of what is exploded, and would run all rules anew for it
    found = pin(state, _hits=F.flatten(F.array(*[_tagged(r) for r in rules])))
    return found.select("script_id", "pos", *carry, F.inline("_hits"))


def _tagged(r: LintRule) -> Column:
    assert r.hits is not None
    return F.transform(r.hits(), lambda h: F.struct(F.lit(r.name).alias("rule"), h["ord"].alias("ord"), h["message"].alias("message")))


def lint(
    facts: DataFrame,
    rules: list[str] | None = None,
    cat: Catalog | None = None,
    chunk: Chunks | int | None = None,
    carry: list[str] | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Findings of the enabled rules: script_id, pos, ord, rule, message, severity, category, and `carry` columns.

    `rules` are rule names; None enables all. Without `cat` the rules that ask
    for a database's version take it as unknown. When many state
    rules are enabled, give `facts` as a written table: each state chain then reads only its own columns of it. State is
    made in `tasks` tasks (see `tasks_for`), unless scripts are cut into chunks.
    """
    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(tasks, *W.SCRIPT) if tasks and chunk is None else df

    enabled = [r for r in RULES.values() if rules is None or r.name in rules]
    carry = carry or []
    parts = []
    simple = [r for r in enabled if r.hits and not r.needs]
    if simple:
        parts.append(_hit_rows(facts, simple, carry))
    for family in _FAMILIES:
        members = [r for r in enabled if r.hits and r.needs and r.needs[0] in family]
        if members:
            needs = [n for n in family if any(r.needs[0] == n for r in members)]
            arrays = ["constraints"] if family == ["created_in_file"] else []
            slim = dealt(W.slim(facts, [*arrays, *carry]))
            parts.append(_hit_rows(W.with_state(slim, needs, chunk), members, carry))
    for r in enabled:
        if r.build is _separate_validation:
            built = r.build(facts, None, chunk, dealt)
        elif r.build:
            built = r.build(facts, cat)
        else:
            continue
        if carry:
            built = built.join(facts.select("script_id", "pos", *carry), ["script_id", "pos"])
        parts.append(built.withColumn("rule", F.lit(r.name)))
    wanted = ["script_id", "pos", "ord", "rule", "message", *carry]
    out = union_all([p.select(*wanted) for p in parts])
    severity = F.lit(C.WARNING)
    errors = [r.name for r in enabled if r.severity == C.ERROR]
    if errors:
        severity = F.when(F.col("rule").isin(errors), C.ERROR).otherwise(C.WARNING)
    return out.withColumn("severity", severity).withColumn("category", F.concat(F.lit("lint/safety/"), F.col("rule")))
