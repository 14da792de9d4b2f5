"""Containment between points, spans and ranges, without pairing rows of a key.

"Is there a range that starts at or before me and ends at or after me" needs only the largest end among the
ranges that start before: one running maximum over ranges and spans in one order. The work is linear however
many ranges and spans one script has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintfleet.operators.scan import Chunks, Running, running


def covered(
    asks: DataFrame,
    offers: DataFrame,
    keys: Sequence[str],
    *,
    ask_at: Column,
    ask_reach: Column,
    offer_at: Column,
    offer_reach: Column,
    name: str,
    chunk: Chunks | int | None = None,
) -> DataFrame:
    """Adds `name` to `asks`: some offer of the same key has offer_at <= ask_at and offer_reach >= ask_reach."""
    payload = [c for c in asks.columns if c not in keys]
    ask_rows = asks.select(
        *keys, F.struct(*payload).alias("_row") if payload else F.struct(F.lit(0)).alias("_row"),
        ask_at.cast("bigint").alias("_at"), F.lit(1).alias("_ask"), ask_reach.cast("bigint").alias("_reach"),
    )
    offer_rows = offers.select(
        *keys, F.lit(None).cast(ask_rows.schema["_row"].dataType).alias("_row"), offer_at.cast("bigint").alias("_at"),
        F.lit(0).alias("_ask"), offer_reach.cast("bigint").alias("_reach"),
    )
    value = F.when(F.col("_ask") == 0, F.col("_reach"))
    merged = running(ask_rows.unionByName(offer_rows), keys, ["_at", "_ask"], [Running("_best", "max", value)], chunk=chunk)
    hit = F.coalesce(F.col("_best") >= F.col("_reach"), F.lit(False))
    return merged.filter("_ask = 1").select(*keys, *[F.col(f"_row.{c}").alias(c) for c in payload], hit.alias(name))
