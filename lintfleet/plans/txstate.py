"""Transaction and file state before each statement (W00-W10), as columns.

Input: statement facts. Each `with_*` function adds columns; the state never includes the row's own statement.
All of it runs per script, so one check of the largest script (`chunk`) decides how every scan here is run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintfleet.operators.scan import Chunks, Running, running, seen_before

SCRIPT = ["script_id"]
TIMEOUTS = {
    "lock_timeout_set": "lock_timeout",
    "statement_timeout_set": "statement_timeout",
    "idle_in_transaction_timeout_set": "idle_in_transaction_session_timeout",
}


def is_reset() -> Column:
    return F.coalesce(F.col("tx_kind").isin("commit", "rollback"), F.lit(False))


def schema_or_public(schema: str = "rel_schema") -> Column:
    return F.when(F.col(schema) == "", "public").otherwise(F.col(schema))


def _timeout_event(setting: str) -> Column:
    """true when set, false when reset, null when the statement does not touch the setting."""
    return (
        F.when(is_reset() | (F.col("set_kind") == "reset_all"), False)
        .when(F.col("set_name") == setting, F.col("set_kind").isin("value", "current"))
    )


def with_segment(facts: DataFrame, chunk: Chunks | int | None = None) -> DataFrame:
    """W00 segment, W01-W03 timeout flags."""
    aggs = [Running("segment", "sum", is_reset().cast("int"))]
    aggs += [Running(name, "last", _timeout_event(setting)) for name, setting in TIMEOUTS.items()]
    out = running(facts, SCRIPT, ["pos"], aggs, chunk=chunk)
    for name in TIMEOUTS:
        out = out.withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def with_created(state: DataFrame, chunk: Chunks | int | None = None) -> DataFrame:
    """Was the target relation created earlier in this transaction? Names ignore case."""
    schema = F.lower(schema_or_public())

    def key(name: str) -> Column:
        return F.struct(schema.alias("schema"), F.lower(F.col(name)).alias("name"))

    created = (
        F.when(F.col("kind").isin("create_table", "ctas"), key("rel_name"))
        .when((F.col("kind") == "create_index") & (F.col("idx_name") != ""), key("idx_name"))
    )
    return seen_before(state, ["script_id", "segment"], "pos", key("rel_name"), created, "created_before", chunk=chunk)


SLIM = ["script_id", "pos", "kind", "tx_kind", "set_name", "set_kind", "rel_schema", "rel_name", "idx_name", "object_type", "concurrent",
        "vacuum_full"]


def heavy_alter() -> Column:
    return (F.col("kind") == "alter_table") & F.exists("commands", lambda c: c["subtype"] != "validate_constraint")


def slim(facts: DataFrame, also: list[str]) -> DataFrame:
    """The columns state and its rules read: what is shuffled, and written when scripts are scanned in chunks."""
    return facts.select(*SLIM, heavy_alter().alias("heavy_alter"), *also)


def takes_lock(state: DataFrame) -> Column:
    """ALTER TABLE on an existing table with any sub-command but VALIDATE CONSTRAINT."""
    heavy = F.col("heavy_alter") if "heavy_alter" in state.columns else heavy_alter()
    return heavy & ~F.col("created_before")


def with_locks(state: DataFrame, chunk: Chunks | int | None = None) -> DataFrame:
    """W05 takes_access_exclusive, W06 holding_access_exclusive."""
    event = F.when(is_reset(), False).when(F.col("takes_access_exclusive"), True)
    out = state.withColumn("takes_access_exclusive", takes_lock(state))
    out = running(out, SCRIPT, ["pos"], [Running("holding_access_exclusive", "last", event)], chunk=chunk)
    return out.withColumn("holding_access_exclusive", F.coalesce("holding_access_exclusive", F.lit(False)))


def with_locked_tables(state: DataFrame, chunk: Chunks | int | None = None) -> DataFrame:
    """Does the target table already hold the lock in this transaction, and how many lock statements came before?"""
    key = F.struct(schema_or_public().alias("schema"), F.col("rel_name").alias("name"))
    event = F.when(F.col("takes_access_exclusive"), key)
    out = seen_before(state, ["script_id", "segment"], "pos", key, event, "table_locked_before", chunk=chunk)
    lock = F.col("takes_access_exclusive").cast("int")
    return running(out, ["script_id", "segment"], ["pos"], [Running("locks_before", "sum", lock)], chunk=chunk)


def with_depth(facts: DataFrame, chunk: Chunks | int | None = None) -> DataFrame:
    """Nesting depth, never below zero: running sum minus the lowest value it has reached."""
    tx = F.col("tx_kind")
    change = (
        F.when(tx.isin("begin", "start", "savepoint"), 1).when(tx.isin("commit", "rollback", "release", "rollback_to"), -1).otherwise(0)
    )
    out = running(facts, SCRIPT, ["pos"], [Running("_sum", "sum", change)], chunk=chunk)
    out = running(out, SCRIPT, ["pos"], [Running("_low", "min", F.col("_sum"))], before=False, chunk=chunk)
    return out.withColumn("depth", (F.col("_sum") - F.least(F.lit(0), F.col("_low"))).cast("int")).drop("_sum", "_low")


def is_dangerous_lock() -> Column:
    """Takes a lock that blocks others on an object that existed before."""
    k = F.col("kind")
    return (
        ((k == "alter_table") & ~F.col("created_before"))
        | ((k == "create_index") & ~F.col("concurrent") & ~F.col("created_before"))
        | ((k == "drop") & F.col("object_type").isin("table", "index", "materialized view"))
        | (k == "truncate")
        | F.col("vacuum_full")
        | ((k == "reindex") & ~F.col("concurrent"))
        | (k == "rename")
        | ((k == "refresh") & ~F.col("concurrent"))
    )


def not_valid_events(state: DataFrame) -> DataFrame:
    """Named constraints added NOT VALID, one row each, with the transaction they belong to."""
    return (
        state.select("script_id", "segment", "pos", "rel_schema", "rel_name", F.inline("constraints"))
        .filter((F.col("context") == "add_constraint") & F.col("skip_validation") & (F.col("name") != ""))
        .select("script_id", "segment", "pos", F.lower(schema_or_public()).alias("schema"), F.lower("rel_name").alias("rel"),
                F.lower("name").alias("name"))
    )


def validates(command: Column) -> Column:
    return command["subtype"] == "validate_constraint"


def not_valid(constraint: Column) -> Column:
    """Named, and added NOT VALID by a command of its own."""
    return (constraint["context"] == "add_constraint") & constraint["skip_validation"] & (constraint["name"] != "")


def with_validated(state: DataFrame, chunk: Chunks | int | None = None) -> DataFrame:
    """One row per VALIDATE CONSTRAINT or NOT VALID constraint; the flag says the validated one is from this transaction."""

    def key(name: Column) -> Column:
        return F.struct(F.lower(schema_or_public()).alias("schema"), F.lower("rel_name").alias("rel"), F.lower(name).alias("name"))

    validated = F.transform(
        F.filter("commands", validates),
        lambda c: F.struct(c["ord"].alias("ord"), key(c["name"]).alias("ask"), F.lit(None).cast("struct<schema:string,rel:string,name:string>").alias("raise"), c["name"].alias("constraint_name")),
    )
    added = F.transform(
        F.filter("constraints", not_valid),
        lambda c: F.struct(c["ord"].alias("ord"), key(c["name"]).alias("ask"), key(c["name"]).alias("raise"), c["name"].alias("constraint_name")),
    )
    rows = state.select("script_id", "segment", "pos", F.inline(F.concat(validated, added)))
    flagged = seen_before(rows, ["script_id", "segment"], "pos", F.col("ask"), F.col("raise"), "added_in_transaction", chunk=chunk)
    return flagged.filter(F.col("raise").isNull()).drop("ask", "raise")


# ------------------------------------------------------------------ state of the whole file


def with_neighbours(facts: DataFrame, chunk: Chunks | int | None = None) -> DataFrame:
    """Whether the script has any other statement."""
    out = running(facts, SCRIPT, ["pos"], [Running("_before", "count", F.lit(1))], chunk=chunk)
    out = running(out, SCRIPT, ["pos"], [Running("_after", "count", F.lit(1))], reverse=True, chunk=chunk)
    return out.withColumn("has_other_statements", (F.col("_before") + F.col("_after")) > 0).drop("_before", "_after")


def with_first_transaction(facts: DataFrame, chunk: Chunks | int | None = None) -> DataFrame:
    """The first of BEGIN, START, COMMIT, ROLLBACK among the earlier statements."""
    event = F.when(F.col("tx_kind").isin("begin", "start", "commit", "rollback"), F.col("tx_kind"))
    return running(facts, SCRIPT, ["pos"], [Running("first_transaction", "first", event)], chunk=chunk)


def _table_name() -> Column:
    return F.struct(F.col("rel_name").alias("name"))


def with_created_in_file(facts: DataFrame, chunk: Chunks | int | None = None) -> DataFrame:
    """Whether an earlier, or any, CREATE TABLE of the script makes a table of this name (schema ignored, exact case)."""
    event = F.when(F.col("kind") == "create_table", _table_name())
    out = seen_before(facts, SCRIPT, "pos", _table_name(), event, "created_earlier_in_file", chunk=chunk)
    out = seen_before(out, SCRIPT, "pos", _table_name(), event, "_later", reverse=True, chunk=chunk)
    return out.withColumn("created_in_file", F.col("created_earlier_in_file") | F.col("_later")).drop("_later")


def with_earlier_alter(facts: DataFrame, chunk: Chunks | int | None = None) -> DataFrame:
    key = F.struct(schema_or_public().alias("schema"), F.col("rel_name").alias("name"))
    event = F.when(F.col("kind") == "alter_table", key)
    return seen_before(facts, SCRIPT, "pos", key, event, "altered_earlier_in_file", chunk=chunk)


STEPS = {
    "segment": ([], with_segment),
    "created": (["segment"], with_created),
    "locks": (["created"], with_locks),
    "locked_tables": (["locks"], with_locked_tables),
    "neighbours": ([], with_neighbours),
    "first_transaction": ([], with_first_transaction),
    "created_in_file": ([], with_created_in_file),
    "earlier_alter": ([], with_earlier_alter),
}


def with_state(facts: DataFrame, needs: list[str], chunk: Chunks | int | None = None) -> DataFrame:
    """Adds the wanted parts of the state, and what they build on, each once."""
    done: set[str] = set()

    def add(df: DataFrame, need: str) -> DataFrame:
        if need in done:
            return df
        before, step = STEPS[need]
        for other in before:
            df = add(df, other)
        done.add(need)
        return step(df, chunk)

    for need in needs:
        facts = add(facts, need)
    return facts
