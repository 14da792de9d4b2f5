"""Scripts to statements.

Boundaries depend on what came before in the same script (open brackets, the statement's first keyword), so
each script's significant tokens are folded once, in order, inside their row. The fold keeps a small state and
the list of finished spans; nothing is shuffled and no script is split over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintfleet.functions.arrays import elements, pin
from lintfleet.plans.tokens import (
    BLOCK_COMMENT, DOLLAR_STRING, IDENT_PART, IDENT_START, LINE_COMMENT, NAMED_PARAM, NEWLINE, NUMBER, QUOTED_IDENT, SPACE, STRING, WORD,
    breaker, let, restored, unnested,
)

TRIVIA = rf"(?:{SPACE}|{NEWLINE}++|{LINE_COMMENT}|{BLOCK_COMMENT})*+"
AFTER_TRIVIA = rf"^{TRIVIA}([\s\S]*)$"
COMMENT = rf"{LINE_COMMENT}|{BLOCK_COMMENT}"

# Keywords that begin a statement, and the words that make such a keyword part of another one.
STARTS = ["WITH", "SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER"]
DML = ["INSERT", "UPDATE", "DELETE"]
BEFORE_SELECT = ["FOR", "AS", "ON", "ALSO", "INSTEAD", "UNION", "ALL", "EXCEPT", "GRANT", "REVOKE", ",", "ATOMIC"]
BEFORE_DML = ["BEFORE", "AFTER", "FOR", "OR", "OF", "ON", "ALSO", "INSTEAD", "GRANT", "REVOKE", ",", "DO", "KEY", "THEN"]
BEFORE_CREATE = ["GRANT", "REVOKE", ","]
AFTER_WITH = ["ORDINALITY", "CHECK", "TIME", "GRANT", "ADMIN", "INHERIT", "SET"]
AFTER_PLAIN_BEGIN = [";", "TRANSACTION", "WORK", "ISOLATION", "READ", "WRITE", "ONLY", "DEFERRABLE", "NOT"]
EXPLAIN_OPTIONS = ["ANALYZE", "ANALYSE", "VERBOSE", "("]
# Keywords that do not end a statement begun by the key.
PART_OF = {
    "INSERT": ["SELECT"], "WITH": ["SELECT", "INSERT", "UPDATE", "DELETE"], "CREATE": ["WITH"],
    "ALTER": ["ALTER", "WITH"],
}
BLOCK_WORDS = ["CASE", "END", "BEGIN", "EXPLAIN"]

WORDS = sorted(
    {w for ws in (STARTS, BEFORE_SELECT, BEFORE_DML, BEFORE_CREATE, AFTER_WITH, AFTER_PLAIN_BEGIN, EXPLAIN_OPTIONS, BLOCK_WORDS)
     for w in ws if w.isalpha()}
)


def _any_word(words: list[str]) -> str:
    by_letter = "|".join(f"{a}(?:{'|'.join(w[1:] for w in words if w[0] == a)})" for a in sorted({w[0] for w in words}))
    return rf"(?i:{by_letter})(?!{IDENT_PART})"


# Most tokens can only lengthen the open statement. A run of them is one token for the fold: no keyword, no blank line and no mark
# is in it that could begin, end or nest anything. These are always tokens of their own:
ALONE = [w for w in WORDS if w in {*STARTS, *BLOCK_WORDS, *EXPLAIN_OPTIONS}]
# these count right before a keyword that begins a statement, the others right behind WITH and BEGIN, which no run goes beyond
BEFORE = [w for w in WORDS if w in {*BEFORE_SELECT, *BEFORE_DML, *BEFORE_CREATE} and w not in ALONE]
_LITERALS = "|".join(["::", NAMED_PARAM, r"\$[0-9]*+", NUMBER, r"[^;,()\\\s]"])
_BLANKS = r"[ \t\x0B\f]*+"
_HARMLESS = rf"(?={_BLANKS}(?!{_any_word(['SELECT', *DML, 'CREATE'])})[A-Za-z0-9_\"'])"
_JOINS = rf"(?:{_any_word(BEFORE)}|,){_HARMLESS}"


def _significant(gap: str) -> str:
    """Trivia and a run, or a token of its own. `gap` may stand between the tokens of a run."""

    def plain(dollar: str) -> str:
        return rf"(?:{WORD}|{STRING}|{QUOTED_IDENT}|{dollar}{_LITERALS})"

    code = r"(?!--|/\*)"
    inner = rf"{code}(?!{_any_word(ALONE)})(?:{_JOINS}|(?![$,]|{_any_word(BEFORE)}){plain('')})"
    brackets = rf"\({gap}(?:{inner}{gap})*+\)"
    first = rf"(?:,{_HARMLESS}|(?!{_any_word(WORDS)}){plain(f'{DOLLAR_STRING}|')})"
    second_tag = DOLLAR_STRING.replace(r"\1", r"\2")
    later = rf"{code}(?!{_any_word(ALONE)})(?:{_JOINS}|{brackets}|(?!{_any_word(BEFORE)}){plain(f'{second_tag}|')})"
    return rf"\G{TRIVIA}(?:{first}(?:{gap}{later})*+|[;,()\\]|{IDENT_START}{IDENT_PART}*+)"


# a line's end may end a psql command, so runs go beyond it only in texts without any
SIGNIFICANT = _significant(rf"{_BLANKS}(?:{NEWLINE}{_BLANKS})?+")
SIGNIFICANT_IN_LINE = _significant(_BLANKS)

NORMAL, PAREN, CASE, BLOCK, META = range(5)
SPAN = "struct<meta:boolean,start:bigint,end:bigint,first:int,last:int,start_line:int,end_line:int,start_col:int,end_col:int>"
MIN_BLOCK = 256


def _describe(p: Column) -> Column:
    """Static facts of one token (or run of tokens) and the trivia before it."""

    def last_line(t: Column) -> Column:
        return F.substring_index(F.substring_index(t, "\n", -1), "\r", -1)

    lead, broken, core_broken = p["shown"], p["broken"], p["core_broken"]
    word = F.upper(p["core"])
    kind = (
        F.when(p["core"].isin(";", ",", "(", ")", "\\"), p["core"])
        .when(word.isin(WORDS), word)
        .otherwise("")
    )
    no_comments = F.regexp_replace(p["lead"], COMMENT, " ")
    return F.struct(
        F.octet_length(p["raw"]).cast("bigint").alias("size"),
        F.octet_length(p["core"]).cast("bigint").alias("core_size"),
        kind.alias("kind"),
        F.when(broken, no_comments.rlike(rf"{NEWLINE}{{2}}")).otherwise(False).alias("blank"),
        F.when(broken, no_comments.rlike(r"[\r\n]")).otherwise(False).alias("broken"),
        F.when(broken, F.regexp_count(lead, F.lit(NEWLINE))).otherwise(0).alias("lead_breaks"),
        F.when(core_broken, F.regexp_count(p["core"], F.lit(NEWLINE))).otherwise(0).alias("core_breaks"),
        F.length(F.when(broken, last_line(lead)).otherwise(lead)).alias("lead_tail"),
        F.length(F.when(core_broken, last_line(p["core"])).otherwise(p["core"])).alias("core_tail"),
    )


def _event(x: Column, i: Column) -> Column:
    """Whether a token may begin a new statement, judged by its neighbours."""
    before, after = F.get("_info", i - 1), F.get("_info", i + 1)
    previous = F.when(x["blank"], "BLANK").otherwise(F.coalesce(before["kind"], F.lit("")))
    following = F.when(after["blank"], "BLANK").otherwise(F.coalesce(after["kind"], F.lit("EOF")))
    kind = x["kind"]
    starts = (
        F.when(kind == "SELECT", ~previous.isin(BEFORE_SELECT))
        .when(kind.isin(DML), ~previous.isin(BEFORE_DML))
        .when(kind == "WITH", ~following.isin(AFTER_WITH))
        .when(kind == "CREATE", ~previous.isin(BEFORE_CREATE))
        .otherwise(kind == "ALTER")
    )
    hard = (x["blank"] & (F.coalesce(before["kind"], F.lit("")) != ",")) | ((kind == "\\") & x["broken"])
    return F.struct(
        i.alias("at"), x["size"].alias("size"), x["core_size"].alias("core_size"), kind.alias("kind"), hard.alias("hard"),
        F.when(starts, kind).alias("start"), ((kind == "BEGIN") & ~following.isin(AFTER_PLAIN_BEGIN)).alias("block"),
        x["broken"].alias("broken"), x["lead_breaks"].alias("lead_breaks"), x["core_breaks"].alias("core_breaks"),
        x["lead_tail"].alias("lead_tail"), x["core_tail"].alias("core_tail"),
    )


def _open_span(s: Column, meta: bool, last: Column) -> Column:
    return F.struct(
        F.lit(meta).alias("meta"), s["start"].alias("start"), s["end"].alias("end"), s["first"].alias("first"),
        last.alias("last"), s["start_line"].alias("start_line"), s["end_line"].alias("end_line"),
        s["start_col"].alias("start_col"), s["end_col"].alias("end_col"),
    )


STATE = ["mode", "depth", "open", "starter", "explain", "start", "end", "first", "at", "start_line", "end_line", "lines", "start_col",
         "end_col", "added"]


def _continue(s: Column, x: Column) -> Column:
    """A token that can only lengthen the open statement: most of a script's tokens."""
    lines = s["lines"] + x["lead_breaks"] + x["core_breaks"]
    token_col = x["lead_tail"] + F.when(x["lead_breaks"] == 0, s["end_col"]).otherwise(0)
    end_col = x["core_tail"] + F.when(x["core_breaks"] == 0, token_col).otherwise(0)
    moved = {
        "end": s["end"] + x["size"], "at": x["at"], "end_line": lines, "lines": lines, "end_col": end_col,
        "explain": F.lit(False), "added": F.array().cast(f"array<{SPAN}>"),
    }
    return F.struct(*[moved.get(f, s[f]).alias(f) for f in STATE])


def _step(s: Column, x: Column) -> Column:
    plain = (x["kind"] == "") & ~x["hard"] & s["open"] & (s["mode"] != META) & ((s["mode"] != PAREN) | ~s["explain"])
    return F.when(plain, _continue(s, x)).otherwise(_decide(s, x))


def _decide(s: Column, x: Column) -> Column:
    mode = F.when((s["mode"] == META) & x["broken"], NORMAL).otherwise(s["mode"])
    inside = F.lit(False)
    for starter, words in PART_OF.items():
        inside = inside | ((s["starter"] == starter) & x["start"].isin(words))
    explained = s["explain"] & x["start"].isNotNull()
    splits = s["open"] & (x["hard"] | (x["start"].isNotNull() & ~inside & ~explained))
    ends = (mode == NORMAL) & F.coalesce(splits, F.lit(False))
    fresh = (mode == NORMAL) & (~s["open"] | ends)
    decision = F.struct(
        mode.alias("mode"), ends.alias("ends"), (fresh & (x["kind"] == "\\")).alias("meta"),
        (fresh & (x["kind"] != "\\")).alias("opens"),
    )
    return let(decision, lambda v: _advance(s, x, v))


def _advance(s: Column, x: Column, v: Column) -> Column:
    kind = x["kind"]
    live = (v["mode"] == NORMAL) & ~v["meta"]
    closes = live & (kind == ";")
    begins = v["opens"] | v["meta"]
    token_start = s["end"] + x["size"] - x["core_size"]
    token_line = s["lines"] + x["lead_breaks"]
    token_end_line = token_line + x["core_breaks"]
    start = F.when(begins, token_start).otherwise(s["start"])
    first = F.when(begins, x["at"]).otherwise(s["first"])
    start_line = F.when(begins, token_line).otherwise(s["start_line"])
    token_col = x["lead_tail"] + F.when(x["lead_breaks"] == 0, s["end_col"]).otherwise(0)
    token_end_col = x["core_tail"] + F.when(x["core_breaks"] == 0, token_col).otherwise(0)
    start_col = F.when(begins, token_col).otherwise(s["start_col"])
    end = s["end"] + x["size"]

    mode = (
        F.when(v["meta"], META)
        .when(live, F.when(kind == "(", PAREN).when(kind == "CASE", CASE).when(x["block"], BLOCK).otherwise(NORMAL))
        .when((v["mode"] == PAREN) & (kind == ")") & (s["depth"] == 1), NORMAL)
        .when((v["mode"] == CASE) & (kind == "END"), NORMAL)
        .when((v["mode"] == BLOCK) & (kind == "END") & (s["depth"] == 1), NORMAL)
        .otherwise(v["mode"])
    )
    up = ((v["mode"] == PAREN) & (kind == "(")) | ((v["mode"] == BLOCK) & (kind == "BEGIN"))
    down = ((v["mode"] == PAREN) & (kind == ")")) | ((v["mode"] == BLOCK) & (kind == "END"))
    depth = F.when(live, 1).otherwise(s["depth"] + up.cast("int") - down.cast("int"))
    starter = F.when(v["opens"] | (live & s["explain"] & kind.isin(STARTS)), kind).otherwise(s["starter"])
    explain = (
        F.when(v["opens"], kind == "EXPLAIN")
        .when(live & s["explain"], kind.isin(EXPLAIN_OPTIONS))
        .otherwise(s["explain"])
    )
    still_open = F.when(closes | v["meta"], False).otherwise(s["open"] | v["opens"])

    none = F.array().cast(f"array<{SPAN}>")
    meta_over = (s["mode"] == META) & (v["mode"] == NORMAL)
    closed = F.struct(
        F.lit(False).alias("meta"), start.alias("start"), end.alias("end"), first.alias("first"), x["at"].alias("last"),
        start_line.alias("start_line"), token_end_line.alias("end_line"), start_col.alias("start_col"), token_end_col.alias("end_col"),
    )
    added = F.concat(
        F.when(meta_over, F.array(_open_span(s, True, x["at"] - 1))).otherwise(none),
        F.when(v["ends"], F.array(_open_span(s, False, x["at"] - 1))).otherwise(none),
        F.when(closes, F.array(closed)).otherwise(none),
    )
    any_added = meta_over | v["ends"] | closes
    after = {
        "mode": mode, "depth": depth, "open": still_open, "starter": starter, "explain": explain, "start": start, "end": end, "first": first,
        "at": x["at"], "start_line": start_line, "end_line": token_end_line, "lines": token_end_line, "start_col": start_col,
        "end_col": token_end_col, "added": F.when(any_added, added).otherwise(none),
    }
    return F.struct(*[after[f].alias(f) for f in STATE])


def _rest(s: Column) -> Column:
    """The span still open when the text ends."""
    none = F.array().cast(f"array<{SPAN}>")
    return (
        F.when(s["open"], F.array(_open_span(s, False, s["at"])))
        .when(s["mode"] == META, F.array(_open_span(s, True, s["at"])))
        .otherwise(none)
    )


def _with_spans(acc: Column, x: Column) -> Column:
    """One step that also collects the spans the step before has finished."""
    added = acc["state"]["added"]
    spans = F.when(F.size(added) > 0, F.concat(acc["spans"], added)).otherwise(acc["spans"])
    return F.struct(_step(acc["state"], x).alias("state"), spans.alias("spans"))


def _fold(df: DataFrame) -> DataFrame:
    """Adds `_spans`: all spans of `_events`.

    Every step of an array fold copies its state, so a state that held all spans would cost the square of
    their number. Long scripts are therefore cut into blocks: a first fold carries the small state to the
    start of each block, a second collects each block's spans.
    """
    long0, int0, false = F.lit(0).cast("bigint"), F.lit(0), F.lit(False)
    none = F.array().cast(f"array<{SPAN}>")
    zero = F.struct(
        int0.alias("mode"), int0.alias("depth"), false.alias("open"), F.lit("").alias("starter"), false.alias("explain"),
        long0.alias("start"), long0.alias("end"), int0.alias("first"), F.lit(-1).alias("at"), int0.alias("start_line"),
        int0.alias("end_line"), int0.alias("lines"), int0.alias("start_col"), int0.alias("end_col"), none.alias("added"),
    )
    n = F.size("_events")
    out = pin(df, _width=F.greatest(F.lit(MIN_BLOCK), F.ceil(F.cbrt(n) * 2).cast("int")))
    count = F.greatest(F.lit(1), F.ceil(n / F.col("_width")).cast("int"))
    blocks = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda k: elements("_events", k * F.col("_width"), F.least(n - 1, (k + 1) * F.col("_width") - 1)),
    )
    out = pin(out, _blocks=F.when(n <= F.col("_width"), F.array("_events")).otherwise(blocks)).drop("_events")
    whole = F.slice("_blocks", 1, F.size("_blocks") - 1)
    starts = F.aggregate(
        whole, F.array(zero), lambda acc, b: F.array_append(acc, F.aggregate(b, F.element_at(acc, -1), _step))
    )
    out = pin(out, _starts=starts)
    last_only = F.size("_blocks") - 1

    def collect(block: Column, i: Column) -> Column:
        # spans the block before finished in its last step are already its own
        start = F.get("_starts", i)
        first = F.struct(start.withField("added", none).alias("state"), none.alias("spans"))
        return F.aggregate(
            block, first, _with_spans,
            lambda a: F.concat(a["spans"], a["state"]["added"], F.when(i == last_only, _rest(a["state"])).otherwise(none)),
        )

    return pin(out, _spans=F.flatten(F.transform("_blocks", collect))).drop("_width", "_blocks", "_starts")


def _spans(df: DataFrame, ids: list[str], content: str) -> DataFrame:
    text, broken_by = F.col(content), F.col("_broken_by")
    out = pin(df.select(*ids, content), _broken_by=breaker(text))
    out = pin(out, _shown=unnested(text, broken_by))
    in_line, found = (F.regexp_extract_all("_shown", F.lit(p), F.lit(0)) for p in (SIGNIFICANT_IN_LINE, SIGNIFICANT))
    out = pin(out, _found=F.when(F.col("_shown").contains("\\"), in_line).otherwise(found)).drop("_shown")

    def has_break(t: Column) -> Column:
        return t.contains("\n") | t.contains("\r")

    def core_of(m: Column) -> Column:
        # most tokens have no trivia before them, or blanks only
        bare = F.ltrim(m)
        cut = F.when(F.ascii(bare).isin(9, 10, 11, 12, 13, 45, 47), F.regexp_extract(m, AFTER_TRIVIA, 1)).otherwise(bare)
        return F.when(F.ascii(m).isin(9, 10, 11, 12, 13, 32, 45, 47), cut).otherwise(m)

    def part(m: Column) -> Column:
        def with_lead(c: Column) -> Column:
            lead = F.substring(m, F.lit(1), F.length(m) - F.length(c))
            return let(F.struct(c.alias("core"), lead.alias("lead"), restored(lead, broken_by).alias("shown")), lambda l: let(
                F.struct(restored(m, broken_by).alias("raw"), restored(l["core"], broken_by).alias("core"), l["lead"].alias("lead"), l["shown"].alias("shown"),
                         has_break(l["shown"]).alias("broken"), has_break(l["core"]).alias("core_broken")), _describe))

        return let(core_of(m), with_lead)

    out = pin(out, _info=F.transform("_found", part)).drop("_found")
    out = pin(out, _events=F.transform("_info", _event))
    out = _fold(out)

    def with_text(whole: Column) -> Column:
        """Tokens tile the text, so a span's text is its bytes."""
        return F.transform("_spans", lambda s: F.struct(
            *[s[f].alias(f) for f in ("meta", "start", "end", "start_line", "end_line", "start_col", "end_col")],
            F.substring(whole, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).cast("string").alias("text"),
            (F.get("_info", s["last"])["kind"] == ";").alias("has_semicolon"),
        ))

    return pin(out, _found=let(F.make_valid_utf8(text).cast("binary"), with_text)).select(*ids, "_found")


def _rows(df: DataFrame, ids: list[str], content: str, meta: bool) -> DataFrame:
    found = _spans(df, ids, content)
    # kept in a column: the optimizer also asks for the size of what is exploded
    kept = pin(found, _kept=F.filter("_found", lambda s: s["meta"] if meta else ~s["meta"]))
    return kept.select(*ids, F.posexplode("_kept").alias("_no", "_s"))


def split_statements(df: DataFrame, ids: list[str], content: str) -> DataFrame:
    """One row per statement: ids, stmt_no (from 1), byte span, line and column span (from 0), text, has_semicolon."""
    rows = _rows(df, ids, content, meta=False)
    return rows.select(
        *ids, (F.col("_no") + 1).alias("stmt_no"), F.col("_s.start").alias("start_byte"), F.col("_s.end").alias("end_byte"),
        F.col("_s.start_line").alias("start_line"), F.col("_s.end_line").alias("end_line"),
        F.col("_s.start_col").alias("start_col"), F.col("_s.end_col").alias("end_col"), F.col("_s.text").alias("text"),
        F.col("_s.has_semicolon").alias("has_semicolon"),
    )


def meta_commands(df: DataFrame, ids: list[str], content: str) -> DataFrame:
    """psql commands (lines begun by a backslash between statements); they are no statements."""
    rows = _rows(df, ids, content, meta=True)
    return rows.select(
        *ids, F.col("_s.start_line").alias("line"), F.col("_s.start").alias("start_byte"), F.col("_s.end").alias("end_byte"),
        F.col("_s.text").alias("text"),
    )


def statement_key(text: Column) -> Column:
    """Statements with equal text share one identity, so shared results can be joined back by it."""
    return F.sha2(text, 256)


def distinct_statements(df: DataFrame) -> DataFrame:
    """Each distinct text once, with how often and in how many scripts it occurs; counted before the shuffle.

    Only the hash is grouped by; the text travels as an ordinary value.
    """
    keyed = df.select("script_id", F.col("text"), statement_key(F.col("text")).alias("stmt_key"))
    per_script = keyed.groupBy("stmt_key", "script_id").agg(F.count("*").alias("n"), F.first("text").alias("text"))
    return per_script.groupBy("stmt_key").agg(
        F.first("text").alias("text"), F.sum("n").alias("occurrences"), F.count("*").alias("scripts")
    )


# LANGUAGE sql functions: signature and body, out of the statement's text.
_NAME = r'(?:"(?:[^"]|"")*+"|[A-Za-z_][A-Za-z0-9_$]*+)'
_CREATE_FUNCTION = rf"(?is)^create\s+(?:or\s+replace\s+)?(?:function|procedure)\s+((?:{_NAME}\s*\.\s*)?{_NAME})\s*\("
_LANGUAGE = r"(?is)\blanguage\s+'?([a-z_]+)'?"
_BODY = r"(?is)\bas\s+(?:\$([A-Za-z_]*)\$(.*?)\$\1\$|'((?:[^']|'')*+)')"
_ARGS = rf"(?is)^create\s+(?:or\s+replace\s+)?(?:function|procedure)\s+(?:{_NAME}\s*\.\s*)?{_NAME}\s*\(([^()]*+(?:\([^()]*+\)[^()]*+)*+)\)"


def function_bodies(statements: DataFrame) -> DataFrame:
    """SQL functions of a statement table: name, argument types, body, and where the body lies in bytes."""
    name = F.regexp_extract("text", _CREATE_FUNCTION, 1)
    language = F.lower(F.regexp_extract("text", _LANGUAGE, 1))
    body = F.concat(F.regexp_extract("text", _BODY, 2), F.regexp_extract("text", _BODY, 3))
    args = F.transform(
        F.filter(F.split(F.regexp_extract("text", _ARGS, 1), r",(?![^(]*\))"), lambda a: F.trim(a) != ""),
        lambda a: F.trim(F.regexp_replace(a, r"(?is)\s+default\s.*$", "")),
    )
    rows = statements.withColumn("function_name", name).withColumn("body", body)
    rows = rows.filter((F.col("function_name") != "") & (language == "sql") & (F.col("body") != ""))
    before = F.call_function("substring_index", F.col("text"), F.col("body"), F.lit(1))
    return rows.select(
        "script_id", F.col("stmt_no").alias("parent_stmt"), F.regexp_replace("function_name", r"\s+", "").alias("function_name"),
        args.alias("args"), F.col("body"),
        (F.col("start_byte") + F.octet_length(before)).alias("body_start"),
    )


def with_nested(statements: DataFrame) -> DataFrame:
    """Statements plus those inside SQL function bodies, one level down, with their parent and byte offset."""
    bodies = function_bodies(statements).select("script_id", "parent_stmt", "body_start", "body")
    inner = split_statements(bodies, ["script_id", "parent_stmt", "body_start"], "body")
    inner = inner.select(
        "script_id", "parent_stmt", "stmt_no", (F.col("start_byte") + F.col("body_start")).alias("start_byte"),
        (F.col("end_byte") + F.col("body_start")).alias("end_byte"), "text",
    )
    top = statements.select("script_id", F.lit(None).cast("int").alias("parent_stmt"), "stmt_no", "start_byte", "end_byte", "text")
    return top.unionByName(inner)
