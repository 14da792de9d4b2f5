"""Running aggregates over one key's ordered rows, safe for keys of any size.

A plain window sorts all rows of a key in one task. That is the best plan while every key is small, and
`chunk_width` finds out with one pre-aggregated count. When some key is too large, that key is cut into chunks
of positions: rows are aggregated within (key, chunk), one summary row per chunk is carried forward, and the
carry is added back. A task then never holds more than one chunk of raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintfleet.session import materialize

ROWS_PER_TASK = 4_000_000
CHUNK = 1 << 16
NAMED_KEYS = 1000
CUTS = 200_000  # of all hot keys, 1.6 MB


@dataclass(frozen=True)
class Chunks:
    """How to cut keys: by `width` positions, and only the keys whose hash is in `hot` (all when None)."""

    keys: tuple[str, ...]
    width: int
    hot: tuple[int, ...] | None

    def column(self, position: Column) -> Column:
        cut = F.floor(position / F.lit(self.width))
        if self.hot is None:
            return cut
        return F.when(F.xxhash64(*self.keys).isin(list(self.hot)), cut).otherwise(F.lit(0).cast("bigint"))

    def add(self, df: DataFrame, position: Column, name: str) -> DataFrame:
        return df.withColumn(name, self.column(position))


@dataclass(frozen=True)
class EquiDepth(Chunks):
    """Cuts hot keys at quantiles of their positions, so chunks hold about as many rows each, however positions lie.

    `cuts` has one row per hot key: `keys` and `_cuts`, the ascending first positions of all chunks but the first. Rows of
    equal position stay in one chunk.
    """

    cuts: DataFrame

    def add(self, df: DataFrame, position: Column, name: str) -> DataFrame:
        cuts = F.col("_cuts")
        # binary search for the number of cuts at or before the position; a key without cuts is one chunk
        steps = F.lit([1 << k for k in range(CUTS.bit_length(), -1, -1)])
        reached = F.aggregate(steps, F.lit(0).cast("bigint"), lambda at, step: F.when(F.get(cuts, (at + step - 1).cast("int")) <= position, at + step).otherwise(at))
        joined = df.join(F.broadcast(self.cuts), list(self.keys), "left")
        return joined.withColumn(name, F.when(cuts.isNull(), F.lit(0).cast("bigint")).otherwise(reached)).select(*df.columns, name)


def equi_depth(df: DataFrame, keys: Sequence[str], position: Column, limit: int = ROWS_PER_TASK) -> Chunks | None:
    """None while every key has at most `limit` rows, else cuts of the larger ones into chunks of about `limit` / 2 rows.

    Counts and quantile sketches are combined before the shuffle. The table of cuts is broadcast, since it is bounded:
    at most NAMED_KEYS keys, and at most CUTS cuts in all. Beyond that keys are cut by position width.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit)
    hot = counts.limit(NAMED_KEYS + 1).collect()
    if not hot:
        return None
    pieces = max(-(-2 * r["_n"] // limit) for r in hot)
    if len(hot) > NAMED_KEYS or len(hot) * pieces > CUTS:
        return chunk_width(df, keys, limit)
    hot_keys = df.sparkSession.createDataFrame([r[:-1] for r in hot], counts.drop("_n").schema)
    shares = [k / pieces for k in range(1, pieces)]
    rows = df.withColumn("_position", position).join(F.broadcast(hot_keys), list(keys), "left_semi")
    sketch = F.percentile_approx("_position", shares, max(10_000, 20 * pieces))
    cuts = materialize(rows.groupBy(*keys).agg(F.array_distinct(sketch).alias("_cuts")), "cuts")
    return EquiDepth(tuple(keys), CHUNK, None, cuts)


def chunk_width(df: DataFrame, keys: Sequence[str], limit: int = ROWS_PER_TASK) -> Chunks | None:
    """None while every key has at most `limit` rows, else how to cut the larger ones.

    Counts are combined before the shuffle, so the check itself does not suffer from a hot key. At most NAMED_KEYS
    hashes come to the driver; with more hot keys than that, every key is cut. Keys that refine the checked ones are
    covered by the same answer, as long as the checked columns are still there.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > limit)
    hot = [r[0] for r in counts.select(F.xxhash64(*keys)).limit(NAMED_KEYS + 1).collect()]
    if not hot:
        return None
    return Chunks(tuple(keys), CHUNK, tuple(hot) if len(hot) <= NAMED_KEYS else None)


@dataclass(frozen=True)
class Running:
    """kind: sum, count, min, max, last or first (the last two skip nulls)."""

    name: str
    kind: str
    value: Column


def _local(agg: Running, value: Column, window) -> Column:
    return {
        "sum": lambda: F.sum(value),
        "count": lambda: F.count(value),
        "min": lambda: F.min(value),
        "max": lambda: F.max(value),
        "last": lambda: F.last(value, ignorenulls=True),
        "first": lambda: F.first(value, ignorenulls=True),
    }[agg.kind]().over(window)


def _summary(agg: Running, value: Column, order: Column) -> Column:
    present = F.when(value.isNotNull(), order)
    return {
        "sum": lambda: F.sum(value),
        "count": lambda: F.count(value),
        "min": lambda: F.min(value),
        "max": lambda: F.max(value),
        "last": lambda: F.max_by(value, present),
        "first": lambda: F.min_by(value, present),
    }[agg.kind]()


def _carry(agg: Running, value: Column, window) -> Column:
    if agg.kind == "count":
        return F.sum(value).over(window)
    return _local(agg, value, window)


def _finished(agg: Running, value: Column) -> Column:
    return F.coalesce(value, F.lit(0)) if agg.kind in ("sum", "count") else value


def _combine(agg: Running, carry: Column, local: Column) -> Column:
    if agg.kind in ("sum", "count"):
        return F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
    if agg.kind == "min":
        return F.least(carry, local)
    if agg.kind == "max":
        return F.greatest(carry, local)
    if agg.kind == "last":
        return F.coalesce(local, carry)
    return F.coalesce(carry, local)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    aggs: Sequence[Running],
    *,
    before: bool = True,
    reverse: bool = False,
    chunk: Chunks | int | None = None,
) -> DataFrame:
    """Adds each running aggregate as a column.

    `order[0]` is numeric and decides the chunk; further order columns break ties. `before` leaves the
    current row out. `reverse` runs from the largest position down, so "last" is the next value.
    `chunk` comes from `chunk_width`; None means one plain window per key. Keys are not null.
    """
    if chunk is None:
        directed = [F.col(c).desc() if reverse else F.col(c) for c in order]
        plain = Window.partitionBy(*keys).orderBy(*directed).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
        return df.select("*", *[_finished(a, _local(a, a.value, plain)).alias(a.name) for a in aggs])
    sign = -1 if reverse else 1
    order_cols = [F.col(c) if i else F.col(c) * sign for i, c in enumerate(order)]
    if reverse:
        order_cols = [order_cols[0]] + [F.col(c).desc() for c in order[1:]]
    summary_order = F.struct(*[F.col(c) for c in order])
    end = -1 if before else 0

    cut = Chunks((), chunk, None) if isinstance(chunk, int) else chunk
    rows = cut.add(df, F.col(order[0]), "_chunk").withColumn("_chunk", F.col("_chunk") * sign)
    for agg in aggs:
        rows = rows.withColumn(f"_in_{agg.name}", agg.value)
    group = [*keys, "_chunk"]
    # both levels read the rows, so they are written once instead of being computed twice
    rows = materialize(rows, "scan")

    window = Window.partitionBy(*group).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, end)
    local = rows.select("*", *[_local(a, F.col(f"_in_{a.name}"), window).alias(f"_lo_{a.name}") for a in aggs])

    def summarise(agg: Running) -> Column:
        value = F.col(f"_in_{agg.name}")
        if reverse and agg.kind in ("last", "first"):
            swapped = Running(agg.name, "first" if agg.kind == "last" else "last", agg.value)
            return _summary(swapped, value, summary_order)
        return _summary(agg, value, summary_order)

    chunks = rows.groupBy(*group).agg(*[summarise(a).alias(f"_su_{a.name}") for a in aggs])
    over_chunks = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = chunks.select(*group, *[_carry(a, F.col(f"_su_{a.name}"), over_chunks).alias(f"_ca_{a.name}") for a in aggs])
    # the raw rows are already partitioned and sorted by the group, so only the summary moves
    joined = local.join(carry, group, "left")
    keep = [F.col(c) for c in df.columns]
    return joined.select(
        *keep, *[_combine(a, F.col(f"_ca_{a.name}"), F.col(f"_lo_{a.name}")).alias(a.name) for a in aggs]
    )


def seen_before(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    lookup: Column,
    event: Column,
    name: str,
    *,
    reverse: bool = False,
    chunk: Chunks | int | None = None,
) -> DataFrame:
    """Adds a flag: did an earlier row raise an event for the key this row asks about?

    `lookup` is the struct a row asks about, `event` the struct it raises (null for none); both have the same
    fields. The two are exploded from one row, so the input is read once.
    """
    marked = F.array(F.struct(F.lit(0).alias("_is_event"), lookup.alias("_key")),
                     F.when(event.isNotNull(), F.struct(F.lit(1).alias("_is_event"), event.alias("_key"))))
    rows = df.select("*", F.explode(F.filter(marked, lambda m: m.isNotNull())).alias("_mark"))
    rows = rows.select(*df.columns, "_mark._is_event", "_mark._key")
    tie = F.col("_is_event") if not reverse else -F.col("_is_event")
    rows = rows.withColumn("_tie", tie)
    flag = Running(name, "max", F.col("_is_event"))
    found = running(rows, [*keys, "_key"], [order, "_tie"], [flag], reverse=reverse, chunk=chunk)
    found = found.filter(F.col("_is_event") == 0)
    return found.select(*df.columns, (F.coalesce(F.col(name), F.lit(0)) == 1).alias(name))
