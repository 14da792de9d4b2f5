"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, checks on the digits (Luhn, remainder by 97, number ranges) confirm them, and words
nearby raise the score. Kinds without a check of their own count only where the context speaks for them. An account number
has the length that its country gives it, whatever follows; each possible start is tried for itself.

A kind's matches and the pieces of text between them come from the same pattern, so a running sum over their lengths
gives positions. Patterns are written so that no text makes them slow: runs are possessive and start where a run starts.
Sums, contexts and replacements are worked out in blocks, so that time grows with the text and its number of matches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintfleet.llm.inrow import blocks_of, let, piece, running, stretch

# ISO 13616: characters of an account number by country, blanks not counted
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY PT ST MZ", 26: "IS IR TR DZ", 27: "BI CF CG CM DJ FR GA GR IT KM MC MG MR SM TD GQ",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_LONGEST = 70  # characters that hold the longest number, a blank before each of its characters, and what stands behind it
IBAN = "^(?:" + "|".join(
    rf"(?:{'|'.join(codes.split())})[0-9]{{2}}(?:[\x20]?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items()
) + ")(?![A-Z0-9])"

NEAR = 40  # characters on either side that count as context
ACCEPT = 0.5
SPANS = "array<struct<kind:string,start:bigint,end:bigint,value:string,score:double>>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True for digits whose Luhn sum ends in 0."""

    def add(total: Column, place: Column) -> Column:
        digit = F.substring(number, -place, F.lit(1)).cast("int")
        doubled = digit * 2
        return total + F.when(place % 2 == 1, digit).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    places = F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1)))
    return F.aggregate(places, F.lit(0), add) % 10 == 0


def mod97(value: Column) -> Column:
    """True for an account number whose rearranged digits leave 1 on division by 97 (letters count 10 to 35)."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def step(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(step(r, c))) == 1


def parts_at_most_255(value: Column) -> Column:
    stripped = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(stripped, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    gate: Callable[[Column], Column]  # cheap, true for every text with a match
    check: Callable[[Column], Column] | None
    score: float  # of a match that passes the check
    context: str
    whole: str | None = None  # where `pattern` is only how a value starts: the value from there on


# fixed values: the four base kinds in their order, then what this operator adds
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda t: F.contains(t, F.lit("@")), None, 0.8, "mail|contact|write|kontakt|contacto"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         lambda t: t.rlike(r"[0-9]\.[0-9]"), parts_at_most_255, 0.7, "ip|address|host|server|adresse"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
         lambda v: F.length(digits(v)).between(16, 19) & luhn(digits(v)), 0.7, "card|visa|credit|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")),
         lambda v: F.length(digits(v)).between(8, 15), 0.6, "phone|tel|call|mobile|fax|anruf|appel"),
    Kind("iban", r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}", lambda t: t.rlike("[A-Z]{2}[0-9]{2}"), mod97, 0.7,
         "iban|account|bank|konto|compte|cuenta", IBAN),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda t: t.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"),
         lambda v: ~v.rlike("^(?:000|666|9)|-00-|-0000$"), 0.3, "ssn|social|security"),
)
BASE = ("email", "ip", "card", "phone")


def _sum(total: Column, value: Column) -> Column:
    return total + value


def _later(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def spans_of(text: Column, kind: Kind) -> Column:
    """This kind's accepted spans of a non-null text, by start; positions in characters, end exclusive."""
    values = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    between = F.split(text, kind.pattern, -1)

    def lengths(found: Column) -> Column:
        return F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda v, gap: F.struct(
            F.length(gap).cast("bigint").alias("gap"), F.length(v).cast("bigint").alias("long"), v.alias("value")))

    def located(steps: Column) -> Column:
        before = running(F.transform(steps, lambda s: s["gap"] + s["long"]), _sum, F.lit(0).cast("bigint"))
        return F.zip_with(steps, before, lambda s, at: F.struct(
            (at + s["gap"]).alias("start"), (at + s["gap"] + s["long"]).alias("end"), s["value"].alias("value")))

    def judged(blocks: Column) -> Column:
        found = let(let(values, lengths), located)
        if kind.whole:
            def grown(s: Column) -> Column:
                value = F.regexp_extract(piece(blocks, s["start"], F.lit(_LONGEST)), kind.whole, 0)
                return F.struct(s["start"].alias("start"), (s["start"] + F.length(value)).cast("bigint").alias("end"), value.alias("value"))

            found = F.filter(F.transform(found, grown), lambda s: F.length(s["value"]) > 0)
        if kind.check:
            found = F.filter(found, lambda s: kind.check(s["value"]))

        def scored(s: Column) -> Column:
            first = F.greatest(s["start"] - NEAR, F.lit(0))
            near = F.concat(piece(blocks, first, s["start"] - first), F.lit("\n"), piece(blocks, s["end"], F.lit(NEAR)))
            score = F.lit(kind.score) + F.when(F.lower(near).rlike(kind.context), F.lit(0.2)).otherwise(F.lit(0.0))
            return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), score.alias("score"))

        spans = F.transform(found, scored)
        if kind.name not in BASE:
            spans = F.filter(spans, lambda s: s["score"] >= ACCEPT)
        return spans

    return F.when(kind.gate(text), let(blocks_of(text), judged)).otherwise(F.expr(f"cast(array() as {SPANS})"))


def personal_data(text: Column) -> Column:
    """All accepted spans of a text (null: empty), by kind in the order of KINDS, then by start."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(*[spans_of(text, k) for k in KINDS])


def find_personal_data(docs: DataFrame, text_col: str = "text", into: str = "spans") -> DataFrame:
    """The input with `into` added: all accepted spans, by kind in the order of KINDS, then by start.

    A null or empty text has none. Spans of different kinds may overlap. Rows are judged one by one, so null ids and
    repeated rows change nothing; a column named like `into` is replaced.
    """
    return docs.drop(into).select("*", personal_data(F.col(f"`{text_col}`")).alias(into))


def replaced(text: Column, spans: Column) -> Column:
    """The text with each stretch of personal data replaced by its first span's kind in brackets. Overlapping spans are one stretch."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    zero = F.lit(0).cast("bigint")

    def stretches(found: Column) -> Column:
        """A stretch begins where all spans before have ended. Each with where the one before it ended."""
        ended = running(F.transform(found, lambda s: s["end"]), _later, zero)
        spans_after = F.zip_with(found, ended, lambda s, e: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), e.alias("ended")))
        return F.filter(spans_after, lambda s: s["start"] >= s["ended"])

    def joined(blocks: Column) -> Column:
        marked = F.transform(let(by_start, stretches), lambda s: F.concat(stretch(blocks, s["ended"], s["start"]), F.lit("["), s["kind"], F.lit("]")))
        rest = stretch(blocks, F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text).cast("bigint"))
        return F.concat(F.array_join(marked, ""), rest)

    return F.when(F.size(spans) > 0, let(blocks_of(text), joined)).otherwise(text)


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same columns and rows; in the text each stretch of personal data is replaced by its first span's kind in brackets.

    A null text stays null. No column is added on the way, so none of any name is lost.
    """
    text = F.col(f"`{text_col}`")
    kept = [let(personal_data(text), lambda spans: replaced(text, spans)).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return docs.select(*kept)
