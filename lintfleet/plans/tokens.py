"""Tokens and lines of script texts.

A text is one cell. Splitting it, and adding up byte offsets, happens inside its row: no shuffle, and the
work of one row is bounded by the size of one cell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintfleet import constants as C
from lintfleet.functions.arrays import add_starts, pin

# Characters of identifiers.
IDENT_START = r"[A-Za-z_\x{80}-\x{FF}]"
IDENT_PART = r"[A-Za-z0-9_$\x{80}-\x{FF}]"
TAG_PART = r"[A-Za-z0-9_\x{80}-\x{FF}]"


# Block comments nest and a regular expression does not count. In texts where they may, `unnested` breaks up the marks inside
# of comments first, so that this pattern meets the ends of the outermost ones only.
BLOCK_COMMENT = r"/\*(?:[^*/]++|\*(?!/)|/(?!\*))*+(?:\*/|\z)"
LINE_COMMENT = r"--[^\n]*+"
NEWLINE = r"(?>\r\n|\n|\r)"
STRING = r"(?:[uU]&|[eEbBxX])?'(?:[^']++|'')*+(?:'|\z)"
QUOTED_IDENT = r'(?:[uU]&)?"(?:[^"]++|"")*+(?:"|\z)'
# the only group of the whole pattern is the dollar tag
DOLLAR_STRING = rf"\$((?:{IDENT_START}{TAG_PART}*+)?)\$[\s\S]*?(?:\$\1\$|\z)"
NAMED_PARAM = (
    rf"\${IDENT_START}{IDENT_PART}*+|:'(?:[^']++|'')*+(?:'|\z)|:\"(?:[^\"]++|\"\")*+(?:\"|\z)|[:@]{IDENT_START}{IDENT_PART}*+"
)
EXPONENT = r"(?:[eE][+-]?[0-9_]*+)?"
NUMBER = (
    rf"0[xX][0-9a-fA-F_]*+|0[bBoO][0-9_]*+|[0-9][0-9_]*+(?:\.(?:[0-9][0-9_]*+)?)?{EXPONENT}|\.[0-9][0-9_]*+{EXPONENT}"
)
# a word, unless its first letters are the prefix of a quoted token
WORD = rf"(?![eEbBxX]'|[uU]&['\"]){IDENT_START}{IDENT_PART}*+"
# the most frequent tokens come first, so that few alternatives are tried
CODE = "|".join([WORD, "[,;()]", STRING, QUOTED_IDENT, DOLLAR_STRING, "::", NAMED_PARAM, r"\$[0-9]*+", NUMBER, r"[\s\S]"])
SPACE = r" ++|\t++|\x0B++|\f++"
TOKEN = "|".join([SPACE, rf"{NEWLINE}++", LINE_COMMENT, BLOCK_COMMENT, CODE])

# Pieces that tile a text, the characters that marks consist of one by one
_IDENT_RUN = r"[A-Za-z0-9_\x{80}-\x{FF}]"
_PIECE = rf"['\"$\r\n*/-]|{_IDENT_RUN}++|(?!{_IDENT_RUN})[^'\"$\r\n*/-](?:(?!{_IDENT_RUN})[^'\"$\r\n*/-])*+"
_WHOLE_NUMBER = rf"^(?:0[xX][0-9a-fA-F_]*+|0[bBoO][0-9_]*+|[0-9][0-9_]*+{EXPONENT})\z"
_BREAK = "\ue000"
_OUTSIDE, _STRING, _QUOTED, _DOLLAR, _LINE, _BLOCK = range(6)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def may_nest(text: Column) -> Column:
    """False where no block comment can hold another one: at most one is open, wherever `/*` and `*/` stand.

    Where a `*` may belong to either mark, the opening one is counted.
    """
    marks = F.regexp_extract_all(text, F.lit(r"/\*|\*/(?!\*)"), F.lit(0))
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a: Column, mark: Column) -> Column:
        now = F.when(mark == "/*", a["now"] + 1).otherwise(F.greatest(a["now"] - 1, F.lit(0)))
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.when(text.rlike(r"/\*[\s\S]*?/\*"), F.aggregate(marks, zero, step, lambda a: a["most"] > 1)).otherwise(False)


def breaker(text: Column) -> Column:
    """What `unnested` puts into marks: longer than any run of its character in the text, so that taking it out gives the text back. Empty where nothing may nest."""
    runs = F.transform(F.regexp_extract_all(text, F.lit(f"{_BREAK}+"), F.lit(0)), lambda r: F.length(r))
    longest = F.when(text.contains(_BREAK), F.array_max(runs)).otherwise(0)
    return F.when(may_nest(text), F.repeat(F.lit(_BREAK), longest + 1)).otherwise("")


def restored(text: Column, broken_by: Column) -> Column:
    return F.replace(text, broken_by, F.lit(""))


def _after(s: Column, piece: Column) -> Column:
    """The state behind a piece: what it stands in (`mode`), open block comments, and what a mark may still be made of."""
    mode, prev, pend = s["mode"], s["prev"], s["pend"]
    is_run = piece.rlike(f"^{_IDENT_RUN}")
    is_dollar, opens, closes = piece == "$", (piece == "*") & (prev == "/"), (piece == "/") & (prev == "*")
    outside, block = mode == _OUTSIDE, mode == _BLOCK
    # $tag$ outside, not behind a word; inside of a dollar string the same tag again
    tagged = is_dollar & (pend > 0) & F.when(outside, ~s["word"]).otherwise(F.when(s["tag"] == "", pend == 1).otherwise(pend == 2))
    new_mode = (
        F.when(outside, F.when(piece == "'", _STRING).when(piece == '"', _QUOTED).when((piece == "-") & (prev == "-"), _LINE).when(opens, _BLOCK)
               .when(tagged, _DOLLAR).otherwise(_OUTSIDE))
        .when(mode == _STRING, F.when(piece == "'", _OUTSIDE).otherwise(_STRING))
        .when(mode == _QUOTED, F.when(piece == '"', _OUTSIDE).otherwise(_QUOTED))
        .when(mode == _DOLLAR, F.when(tagged, _OUTSIDE).otherwise(_DOLLAR))
        .when(mode == _LINE, F.when(piece == "\n", _OUTSIDE).otherwise(_LINE))
        .otherwise(F.when(closes & (s["depth"] == 1), _OUTSIDE).otherwise(_BLOCK))
    )
    depth = F.when(opens & (outside | block), s["depth"] + 1).when(closes & block, s["depth"] - 1).otherwise(s["depth"])
    mark = (block & (opens | closes)) | (outside & opens)
    first_dollar = is_dollar & ~tagged & ((mode == _DOLLAR) | (outside & ~s["word"]))
    named = is_run & (pend == 1) & F.when(outside, piece.rlike(f"^{IDENT_START}")).otherwise((mode == _DOLLAR) & (piece == s["tag"]))
    word = outside & F.when(is_run, ~named & (s["word"] | ~piece.rlike(_WHOLE_NUMBER))).otherwise(is_dollar & s["word"])
    tag = F.when(outside & named, piece).when(outside & first_dollar, "").otherwise(s["tag"])
    return F.struct(
        new_mode.alias("mode"), depth.alias("depth"), F.when(named, 2).when(first_dollar, 1).otherwise(0).alias("pend"), tag.alias("tag"),
        F.when(piece.isin("-", "*", "/") & ~mark, piece).otherwise("").alias("prev"), word.alias("word"),
        (block & (opens | (closes & (s["depth"] > 1)))).alias("inner"),
    )


def unnested(text: Column, broken_by: Column) -> Column:
    """The text with all comment marks inside of block comments broken up by `breaker`, all else as it is.

    Whether a mark counts depends on all before it, so the pieces are folded in order, with a small state, by blocks: only the
    text of one block is copied from step to step.
    """
    state = F.struct(F.lit(_OUTSIDE).alias("mode"), F.lit(0).alias("depth"), F.lit(0).alias("pend"), F.lit("").alias("tag"), F.lit("").alias("prev"),
                     F.lit(False).alias("word"), F.lit(False).alias("inner"))

    def step(acc: Column, piece: Column) -> Column:
        def joined(s: Column) -> Column:
            # on both sides: the last character of a mark may look like the first one of another
            shown = F.when(s["inner"], F.concat(broken_by, piece, broken_by)).otherwise(piece)
            return F.struct(s.alias("state"), F.concat(acc["text"], shown).alias("text"))

        return let(_after(acc["state"], piece), joined)

    def block(acc: Column, pieces: Column) -> Column:
        def added(found: Column) -> Column:
            return F.struct(found["state"].alias("state"), F.array_append(acc["texts"], found["text"]).alias("texts"))

        return let(F.aggregate(pieces, F.struct(acc["state"].alias("state"), F.lit("").alias("text")), step), added)

    def folded(pieces: Column) -> Column:
        width = F.greatest(F.lit(64), F.ceil(F.cbrt(F.size(pieces)) * 2)).cast("int")
        starts = F.sequence(F.lit(1), F.size(pieces), width)
        blocks = F.transform(starts, lambda at: F.slice(pieces, at, width))
        zero = F.struct(state.alias("state"), F.array().cast("array<string>").alias("texts"))
        return F.aggregate(blocks, zero, block, lambda a: F.array_join(a["texts"], ""))

    return F.when(broken_by != "", let(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)), folded)).otherwise(text)


def token_texts(text: Column) -> Column:
    """The tokens that tile a text."""

    def cut(broken_by: Column) -> Column:
        found = F.regexp_extract_all(unnested(text, broken_by), F.lit(TOKEN), F.lit(0))
        return F.when(broken_by == "", found).otherwise(F.transform(found, lambda t: restored(t, broken_by)))

    return let(breaker(text), cut)


def kind_of(token: Column) -> Column:
    """Token class, read off its first characters."""
    first, second = F.ascii(token), F.substring(token, 2, 1)
    is_letter = first.between(97, 122) | first.between(65, 90) | (first == 95) | first.between(128, 255)
    prefixed = F.when(second == "'", "string").when(
        second == "&", F.when(F.substring(token, 3, 1) == "'", "string").otherwise("quoted_ident")
    )
    after_dollar = (
        F.when(token.rlike(rf"^\$(?:{IDENT_START}{TAG_PART}*)?\$"), "dollar_string")
        .when((second == "") | second.between("0", "9"), "positional_param")
        .otherwise("named_param")
    )
    return (
        F.when(is_letter, F.coalesce(prefixed, F.lit("word")))
        .when(first.isin(32, 9, 11, 12), "space")
        .when(first.isin(10, 13), "newline")
        .when(first.between(48, 57), "number")
        .when(first == 39, "string")
        .when(first == 34, "quoted_ident")
        .when(token.startswith("--") | token.startswith("/*"), "comment")
        .when(first == 36, after_dollar)
        .when(first.isin(58, 64) & (second != "") & (token != "::"), "named_param")
        .when((first == 46) & (second != ""), "number")
        .otherwise("symbol")
    )


def tokens(df: DataFrame, ids: list[str], content: str) -> DataFrame:
    """One row per token: ids, ord (from 1), token, kind, start_byte, end_byte. Tokens tile the text."""
    out = df.select(*ids, token_texts(F.col(content)).alias("_tokens"))
    out = pin(out, _sizes=F.transform("_tokens", lambda t: F.octet_length(t).cast("bigint")))
    out = add_starts(out, "_sizes", "_starts")
    rows = out.select(*ids, F.posexplode(F.arrays_zip("_tokens", "_starts")).alias("_pos", "_t"))
    start, token = F.col("_t._starts"), F.col("_t._tokens")
    return rows.select(
        *ids, (F.col("_pos") + 1).alias("ord"), token.alias("token"), kind_of(token).alias("kind"),
        start.alias("start_byte"), (start + F.octet_length(token)).alias("end_byte"),
    )


def keywords(df: DataFrame) -> DataFrame:
    """The keyword table: fixed words, so it is always small enough to broadcast."""
    rows = [(w, "reserved") for w in C.RESERVED_WORDS] + [(w, "unreserved") for w in C.STATEMENT_WORDS]
    return df.sparkSession.createDataFrame(rows, "word string, class string")


def token_statistics(df: DataFrame, content: str) -> DataFrame:
    """Counts per token kind and keyword; words that are no keyword are counted together.

    Only the token text is needed, so offsets are not computed, and counts are added up before the shuffle.
    """
    rows = df.select(F.explode(token_texts(F.col(content))).alias("token"))
    rows = rows.select(kind_of(F.col("token")).alias("kind"), F.octet_length("token").alias("size"),
                       F.lower("token").alias("word"))
    rows = rows.withColumn("word", F.when(F.col("kind") == "word", F.col("word")))
    joined = rows.join(F.broadcast(keywords(df)), "word", "left")
    keyword = F.when(F.col("class").isNotNull(), F.col("word"))
    return (
        joined.select("kind", F.when(F.col("kind") == "word", F.coalesce("class", F.lit("identifier"))).alias("class"),
                      keyword.alias("keyword"), "size")
        .groupBy("kind", "class", "keyword")
        .agg(F.count("*").alias("n"), F.sum("size").cast("bigint").alias("bytes"))
    )


LINE_BREAK = r"(?<=\n)|(?<=\r)(?!\n)"


def lines(df: DataFrame, ids: list[str], content: str) -> DataFrame:
    """One row per line: ids, line (from 0), start_byte, line_text without its break."""
    out = df.select(*ids, F.split(F.col(content), LINE_BREAK, -1).alias("_lines"))
    out = pin(out, _sizes=F.transform("_lines", lambda t: F.octet_length(t).cast("bigint")))
    out = add_starts(out, "_sizes", "_starts")
    rows = out.select(*ids, F.posexplode(F.arrays_zip("_lines", "_starts")).alias("line", "_l"))
    return rows.select(*ids, "line", F.col("_l._starts").alias("start_byte"),
                       F.regexp_replace("_l._lines", r"[\r\n]+$", "").alias("line_text"))
