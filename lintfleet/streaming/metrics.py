"""Timing metrics and rates (M01, M02, M05); the same functions serve tables and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintfleet.operators.scan import Chunks, Running, running
from lintfleet.session import materialize

# Quantiles at which a histogram is cut: half of what is left each time.
QUANTILES = [0.5, 0.75, 0.875, 0.9375, 0.96875, 1.0]


def span_timings(events: DataFrame, chunk: Chunks | int | None = None) -> DataFrame:
    """Per span the time inside it (busy), outside it (idle) and both, in microseconds.

    `events`: span_id, callsite, seq (order), at (timestamp), kind (enter or exit). The time since the span's last
    event is idle when it is entered and busy when it is left.
    """
    rows = events.withColumn("_at", F.unix_micros("at"))
    rows = running(rows, ["callsite", "span_id"], ["_at", "seq"], [Running("_last", "last", F.col("_at"))], chunk=chunk)
    step = F.col("_at") - F.coalesce("_last", "_at")
    return rows.groupBy("callsite", "span_id").agg(
        F.sum(F.when(F.col("kind") == "exit", step).otherwise(0)).alias("busy"),
        F.sum(F.when(F.col("kind") == "enter", step).otherwise(0)).alias("idle"),
        F.sum(step).alias("total"),
    )


def histogram(timings: DataFrame, value: str = "total", chunk: Chunks | int | None = None) -> DataFrame:
    """Count, mean, deviation and exact quantiles per call site.

    Equal values are counted first; a quantile is the smallest value whose running count reaches its share. `chunk` cuts
    call sites with very many different values.
    """
    counts = timings.filter(F.col(value).isNotNull()).groupBy("callsite", F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    ranked = running(counts, ["callsite"], ["_v"], [Running("_to", "sum", F.col("_n"))], before=False, chunk=chunk)
    sums = timings.groupBy("callsite").agg(
        F.count("*").alias("samples"), F.count(value).alias("_all"), F.round(F.avg(value), 3).alias("mean"), F.round(F.stddev_pop(value), 3).alias("stdev"))
    reached = ranked.join(sums.select("callsite", "_all"), "callsite").groupBy("callsite").agg(
        *[F.min(F.when(F.col("_to") >= F.ceil(F.col("_all") * q), F.col("_v"))).alias(f"q{i + 1}") for i, q in enumerate(QUANTILES)])
    return sums.drop("_all").join(reached, "callsite", "left")


def sessions(events: DataFrame, gap_seconds: int, chunk: Chunks | None = None) -> DataFrame:
    """M05 over a table: sessions per type, for types of any size.

    A session ends where the next event comes `gap_seconds` or more after the last. Each chunk of a type's time makes its
    own sessions. Only a chunk's first and last one can go on in its neighbours, so these two alone are merged over the
    whole type; a session that fills several chunks is merged from one row of each. `chunk` comes from `equi_depth` over
    event_type and the microseconds of ts.
    """
    gap = 1_000_000 * gap_seconds
    rows = events.select("event_type", F.unix_micros("ts").alias("_at"), "value").filter("_at is not null")
    rows = chunk.add(rows, F.col("_at"), "_chunk") if chunk else rows.withColumn("_chunk", F.lit(0).cast("bigint"))
    part = ["event_type", "_chunk"]
    inside = Window.partitionBy(*part).orderBy("_at")
    begins = F.coalesce(F.col("_at") - F.lag("_at").over(inside) >= gap, F.lit(True))
    rows = rows.withColumn("_begins", begins.cast("int")).withColumn("_no", F.sum("_begins").over(inside))
    parts = rows.groupBy(*part, "_no").agg(F.min("_at").alias("_from"), F.max("_at").alias("_to"), F.count("*").alias("n"), F.sum("value").alias("total"))
    if chunk:
        parts = parts.withColumn("_last", F.max("_no").over(Window.partitionBy(*part)))
        parts = materialize(parts.withColumn("_edge", (F.col("_no") == 1) | (F.col("_no") == F.col("_last"))), "sessions")
        along = Window.partitionBy("event_type").orderBy("_from")
        edges = parts.filter("_edge").withColumn("_begins", F.coalesce(F.col("_from") - F.lag("_to").over(along) >= gap, F.lit(True)).cast("int"))
        merged = edges.withColumn("_no", F.sum("_begins").over(along)).groupBy("event_type", "_no").agg(
            F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.sum("n").alias("n"), F.sum("total").alias("total"))
        kept = ["event_type", "_from", "_to", "n", "total"]
        parts = parts.filter("not _edge").select(*kept).unionByName(merged.select(*kept))
    return parts.select(
        F.lit("session").alias("kind"), "event_type", F.timestamp_micros("_from").alias("start"), F.timestamp_micros(F.col("_to") + gap).alias("end"),
        "n", F.round("total", 2).alias("total"),
    )


def rate(events: DataFrame, window: Column, kind: str) -> DataFrame:
    """Events and their value per type and time window (tumbling, sliding or session)."""
    return events.groupBy(F.col("event_type"), window.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.lit(kind).alias("kind"), "event_type", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", F.round("total", 2).alias("total")
    )
