"""Row-local array work. Scripts are single cells, so their tokens are handled without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG = "bigint"


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once per row.

    A plain select may be merged into the next one, and an array used inside a lambda would then be
    recomputed for every element. A one-row generator keeps the optimizer from merging.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def elements(array: str, first: Column, last: Column) -> Column:
    """array[first..last], both from 0. `slice` would copy the whole array on every call."""
    ids = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.transform(ids, lambda i: F.get(array, i))


def add_starts(df: DataFrame, sizes: str, into: str) -> DataFrame:
    """Adds the running total before each element of the bigint array column `sizes`.

    A fold copies its state at every step, so a long array is added up in blocks of about cbrt(n) elements.
    """
    n = F.size(sizes)
    width = F.greatest(F.lit(1), F.ceil(F.cbrt(n)).cast("int"))
    block_ids = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / F.col("_width")).cast("int") - 1))
    out = pin(df, _width=width)
    last = F.size(sizes) - 1
    blocks = F.transform(
        block_ids,
        lambda k: elements(sizes, k * F.col("_width"), F.least(last, (k + 1) * F.col("_width") - 1)),
    )
    out = pin(out, _blocks=blocks)
    zero = F.array(F.lit(0).cast(LONG))

    def append_total(acc: Column, x: Column) -> Column:
        return F.array_append(acc, F.element_at(acc, -1) + x)

    out = pin(out, _local=F.transform("_blocks", lambda b: F.aggregate(b, zero, append_total)))
    out = pin(out, _carry=F.aggregate("_local", zero, lambda acc, b: append_total(acc, F.element_at(b, -1))))
    starts = F.flatten(
        F.zip_with(
            F.col("_local"),
            F.slice("_carry", 1, F.size("_local")),
            lambda b, c: F.transform(F.slice(b, 1, F.size(b) - 1), lambda x: x + c),
        )
    )
    return pin(out, **{into: starts}).drop("_width", "_blocks", "_local", "_carry")
