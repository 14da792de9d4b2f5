"""Joins against side tables, with the size of what is broadcast checked first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
SALTS = 32


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """True when the frame holds at most `limit` rows; reads no more than that."""
    return df.limit(limit + 1).count() <= limit


def lookup(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", limit: int = BROADCAST_ROWS
) -> DataFrame:
    """Joins `left` to a side table on keys that may be heavily skewed (one database, one script).

    A small right side is broadcast. A larger one is repeated per salt, and the left rows of a hot key
    are spread over the salts, so no task receives a whole hot key. The repeated side is never broadcast: its size is
    estimated from compressed files and without the repeats, which may pass for a small one.
    """
    keys = list(keys)
    if is_small(right, limit):
        return left.join(F.broadcast(right), keys, how)
    salted_right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted_left = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int"))
    return salted_left.join(salted_right.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """All parts by column name, paired up like a tree: a chain of unions is analysed anew at every link."""
    parts = list(parts)
    while len(parts) > 1:
        pairs = [parts[i : i + 2] for i in range(0, len(parts), 2)]
        parts = [p[0].unionByName(p[1]) if len(p) == 2 else p[0] for p in pairs]
    return parts[0]
