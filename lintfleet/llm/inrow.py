"""Work inside one row, in time that grows with the row: running values over arrays, and pieces of long texts.

A fold that appends copies its array at each step, and a substring walks its text from the beginning. Both are cut into
blocks here, so that a row with a hundred thousand elements costs about a hundred thousand times one element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEPS = 64  # elements to a block of a running value
_CHARS = 256  # characters to a block of a text; the longest piece that `piece` gives


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` worked out once, however often a lambda reads it."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, merge: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each element of an array<bigint>, `merge` over all elements before it, from `zero` on. An empty array gives an empty one."""

    def scan(items: Column, first: Column) -> Column:
        start = F.struct(first.alias("now"), F.expr("cast(array() as array<bigint>)").alias("seen"))
        return F.aggregate(items, start, lambda d, x: F.struct(merge(d["now"], x).alias("now"), F.array_append(d["seen"], d["now"]).alias("seen")), lambda d: d["seen"])

    def blocks(all_values: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(all_values) - 1) / _STEPS).cast("int"))
        return F.transform(places, lambda b: F.slice(all_values, b * _STEPS + 1, F.lit(_STEPS)))

    def from_blocks(cut: Column) -> Column:
        firsts = scan(F.transform(cut, lambda b: F.aggregate(b, zero, merge)), zero)
        return F.flatten(F.zip_with(cut, firsts, scan))

    none = F.expr("cast(array() as array<bigint>)")
    return let(values, lambda v: F.when(F.size(v) == 0, none).otherwise(let(blocks(v), from_blocks)))


def blocks_of(text: Column) -> Column:
    """A text as blocks of equally many characters, for `piece` and `stretch`. A short text is one block."""
    return F.when(F.length(text) <= _CHARS, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHARS}}}"), F.lit(0)))


def _block(at: Column) -> Column:
    return F.floor(at / _CHARS).cast("int")


def piece(blocks: Column, start: Column, length: Column) -> Column:
    """At most 256 characters of a text given as blocks, from `start` (0 is the first) on."""

    def near(k: Column) -> Column:
        both = F.concat(F.coalesce(F.try_element_at(blocks, k + 1), F.lit("")), F.coalesce(F.try_element_at(blocks, k + 2), F.lit("")))
        return F.substring(both, (start - k * _CHARS + 1).cast("int"), length.cast("int"))

    return let(_block(start), near)


def stretch(blocks: Column, start: Column, end: Column) -> Column:
    """The characters from `start` to before `end` of a text given as blocks, however many."""

    def joined(k: Column) -> Column:
        held = F.array_join(F.slice(blocks, k + 1, _block(end) - k + 1), "")
        return F.substring(held, (start - k * _CHARS + 1).cast("int"), (end - start).cast("int"))

    return let(_block(start), joined)
