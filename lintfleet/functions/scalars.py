"""Column functions the rules share; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(value: Column) -> Column:
    return value.cast("string")


def format_text(template: str, *args: Column) -> Column:
    """Fills each %s of the template; a null argument becomes empty text, as in SQL's format()."""
    parts = template.split("%s")
    pieces: list[Column] = []
    for i, part in enumerate(parts):
        if part:
            pieces.append(F.lit(part))
        if i < len(args):
            pieces.append(F.coalesce(text(args[i]), F.lit("")))
    return F.concat(*pieces)


def int_list(value: Column) -> Column:
    """Space-separated numbers as array<bigint>; empty text is an empty array."""
    words = F.when(F.trim(value) == "", F.array().cast("array<string>")).otherwise(F.split(F.trim(value), " +"))
    return words.cast("array<bigint>")


def word_list(value: Column) -> Column:
    return F.when(F.coalesce(F.trim(value), F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(F.trim(value), " +")
    )


def has_prefix(values: Column, prefix: Column) -> Column:
    """True when the array starts with all elements of `prefix`, in order."""
    return F.slice(values, 1, F.greatest(F.size(prefix), F.lit(0))) == prefix


def array_fill(value: Column, length: Column) -> Column:
    return F.array_repeat(value, F.greatest(length.cast("int"), F.lit(0)))


def overlaps(values: Column, options: Sequence[str]) -> Column:
    return F.arrays_overlap(values, F.array(*[F.lit(o) for o in options]))


def split_setting(value: Column) -> Column:
    """A comma-separated setting as trimmed words."""
    return F.transform(F.split(value, ","), lambda x: F.trim(x))


def sorted_names(value: Column) -> Column:
    return F.array_sort(F.collect_list(value))


def bit(value: Column, position: int) -> Column:
    return value.bitwiseAND(F.lit(1 << position)) != 0


def int_div(value: Column, divisor: int) -> Column:
    return F.floor(value / F.lit(divisor)).cast("bigint")


def pretty_size(size: Column) -> Column:
    """Bytes as text the way Postgres prints them: bytes below 10 kB, then half-rounded larger units."""
    out = F.when(size < 10 * 1024, F.concat(text(size), F.lit(" bytes")))
    doubled = F.shiftright(size, 9)
    for unit in ("kB", "MB", "GB", "TB"):
        out = out.when(doubled < 20 * 1024 - 1, F.concat(text(F.shiftright(doubled + 1, 1)), F.lit(f" {unit}")))
        doubled = F.shiftright(doubled, 10)
    return out.otherwise(F.concat(text(F.shiftright(doubled + 1, 1)), F.lit(" PB")))


def json_of(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def without_keys(metadata: Column, keys: Sequence[str]) -> Column:
    """A string map without the given keys."""
    return F.map_filter(metadata, lambda k, _: ~k.isin(list(keys)))


def lookup_map(value: Column, table: dict[str, str], default: Column) -> Column:
    pairs: list[Column] = []
    for k, v in table.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.coalesce(F.element_at(F.create_map(*pairs), value), default)


def in_words(name: str, words: Sequence[str]) -> Column:
    """`name IN (...)` for a fixed word list, as one expression."""
    quoted = ", ".join("'" + w.replace("'", "\\'") + "'" for w in words)
    return F.expr(f"{name} IN ({quoted})")
