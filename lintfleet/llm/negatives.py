"""Hard-negative mining by slot-decomposed selection.

A query (anchor) has positives, the best rows of its own label. Each positive has an upper limit for the scores of its
negatives. An anchor's limits cut the scores into disjoint slots, so windows that overlap share slots: a task keeps the best
rows of each slot only (a combiner), the combined slots are merged from the lowest one up, and the merged tail that begins at a
positive's limit holds the best rows below it. The lower limit then only cuts off its end.

Anchors are all asked against all rows, in blocks of bounded bytes: a block's anchors are broadcast, and each task
holds the best rows per anchor and slot, whatever it reads. Tasks put out a bounded number of rows per anchor.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintfleet.llm.common import bound_batches
from lintfleet.session import materialize, new_path

POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95  # percent of the positive's score
SCALE = 256
ANCHOR_BYTES = 16 << 20  # of the anchors of one block, as 64-bit numbers
CELLS = 1 << 20  # scores that a task holds at once
TOGETHER = 1024  # anchors whose best rows are kept, and sorted anew with each batch, together
_MOST = np.iinfo("i8").max


class Anchors(NamedTuple):
    """A block's anchors of one length: numbers, ids, label codes, integer vectors, and (in the second pass) limits."""

    number: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    uppers: np.ndarray | None = None  # (anchors, positives), descending; the lowest number where there are fewer positives
    lowest: np.ndarray | None = None


def whole(vectors: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows have a usable vector, their lengths, and floor(scale * x) of all their values one after the other.

    64-bit integers, or Python's where values are beyond those.
    """
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype("i8")
    flat = vectors.flatten()
    values = pc.fill_null(pc.cast(flat, pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(sizes)), np.maximum(sizes, 0))
    good = sizes >= 0
    good[owner[~np.isfinite(values)]] = False
    values = values[good[owner]]
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * values)
    if len(scaled) and not np.abs(scaled).max() < 2.0**62:
        exact = np.array([int(np.floor(v)) * scale + int(np.floor(scale * (v - np.floor(v)))) for v in values.tolist()], object)
        return good, sizes[good], exact
    return good, sizes[good], scaled.astype("i8")


def _rows(batches: Iterable[pa.RecordBatch], scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, matrix) of usable rows, for each batch and length of vectors."""
    for batch in batches:
        good, sizes, values = whole(batch.column(2), scale)
        ids, labels = (pc.cast(batch.column(i), pa.int64()).to_numpy(zero_copy_only=False)[good] for i in (0, 1))
        starts = np.cumsum(sizes) - sizes
        for size in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == size)
            yield ids[mine], labels[mine], values[starts[mine][:, None] + np.arange(size)]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors as 64-bit integers; what is beyond them becomes the outermost ones."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), "i8")
    if a.dtype != object and b.dtype != object:
        # no partial sum is larger than the product of the lengths, so floats below are exact
        norm = float(np.sqrt((a.astype("f8") ** 2).sum(1).max() * (b.astype("f8") ** 2).sum(1).max())) * 1.001
        for most, kind in ((2.0**24, "f4"), (2.0**53, "f8")):
            if norm < most:
                return (a.astype(kind) @ b.astype(kind).T).astype("i8")
        if norm < 2.0**62:
            return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -_MOST, _MOST).astype("i8")


class Best:
    """The first `keep` rows (score descending, id ascending) of each (anchor, slot) seen so far."""

    def __init__(self, anchors: int, slots: int, keep: int):
        self.slots, self.keep = slots, keep
        self.least = np.full(anchors * slots, -_MOST - 1, "i8")  # score that a further row needs
        self.cell, self.score, self.id = np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0, "i8")

    def add(self, anchor: np.ndarray, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        cell = np.concatenate([self.cell, anchor * self.slots + slot])
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, ~score, cell))  # ~score descends without overflow
        cell, score, ids = cell[order], score[order], ids[order]
        start = np.flatnonzero(np.diff(cell, prepend=-1))
        place = np.arange(len(cell)) - np.repeat(start, np.diff(start, append=len(cell)))
        kept = place < self.keep
        self.cell, self.score, self.id = cell[kept], score[kept], ids[kept]
        last = place == self.keep - 1
        self.least[cell[last]] = score[last]


def _scan(anchors: list[Anchors], keep: int, scale: int, negative: bool):
    """Per task: the best rows of each anchor, and with `negative` of each of its slots."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = anchors[0].uppers.shape[1] if negative and anchors else 1
        best = [Best(len(a.ids), slots, keep) for a in anchors]
        for ids, labels, matrix in _rows(batches, scale):
            for block, held in zip(anchors, best, strict=True):
                if block.vectors.shape[1] != matrix.shape[1]:  # of another length
                    continue
                step = max(1, CELLS // len(ids))
                for at in range(0, len(block.ids), step):
                    some = slice(at, at + step)
                    score = scores(block.vectors[some], matrix)
                    if negative:
                        use = (block.labels[some, None] != labels[None, :]) & (score <= block.uppers[some, :1]) & (score >= block.lowest[some, None])
                    else:
                        use = (block.labels[some, None] == labels[None, :]) & (block.ids[some, None] != ids[None, :])
                        use &= score >= held.least[some, None]
                    row, column = np.nonzero(use)
                    got = score[row, column]
                    # a score's slot is the lowest limit that it keeps
                    slot = (got[:, None] <= block.uppers[at + row]).sum(1) - 1 if negative else np.zeros(len(row), "i8")
                    enough = got >= held.least[(at + row) * slots + slot]
                    if enough.any():
                        held.add(at + row[enough], slot[enough], got[enough], ids[column[enough]])
        for block, held in zip(anchors, best, strict=True):
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.number[held.cell // slots]), pa.array((held.cell % slots).astype("i4")), pa.array(held.score), pa.array(held.id)],
                names=["anchor", "slot", "score", "vec_id"])

    return run


def _first(rows: DataFrame, keep: int, *keys: str) -> DataFrame:
    """The first rows of each key, cut down before and after the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep)


def _limits(score: np.ndarray, percent: int) -> np.ndarray:
    """floor(percent * score / 100) without overflow."""
    whole_part, rest = np.divmod(score, 100)
    return whole_part * percent + (rest * percent) // 100


def _block_of(table: pa.Table, scale: int) -> list[Anchors]:
    """The anchors of a block, by length, a bounded number together."""
    good, sizes, values = whole(table["vector"], scale)
    number, ids = (table[c].to_numpy()[good] for c in ("anchor", "vec_id"))
    labels, starts = table["label"].to_numpy()[good], np.cumsum(sizes) - sizes
    found = []
    for size in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == size)
        for at in range(0, len(mine), TOGETHER):
            some = mine[at : at + TOGETHER]
            found.append(Anchors(number[some], ids[some], labels[some], values[starts[some][:, None] + np.arange(size)]))
    return found


def _with_limits(anchors: list[Anchors], positives: pa.Table, places: int, low: int, high: int) -> list[Anchors]:
    number, place, score = (positives[c].to_numpy() for c in ("anchor", "place", "score"))
    out = []
    for block in anchors:
        order = np.argsort(block.number)
        at = np.searchsorted(block.number[order], number)
        mine = (at < len(order)) & (block.number[order][np.minimum(at, len(order) - 1)] == number)
        row = order[at[mine]]
        uppers = np.full((len(block.ids), places), -_MOST - 1, "i8")
        uppers[row, place[mine] - 1] = _limits(score[mine], high)
        # of scores below 0 the lower limit is over the upper one, and no row is between them
        lowest = np.full(len(block.ids), _MOST, "i8")
        np.minimum.at(lowest, row, -_limits(-score[mine], low))
        some = (uppers > -_MOST - 1).any(1)
        out.append(Anchors(block.number[some], block.ids[some], block.labels[some], block.vectors[some], uppers[some], lowest[some]))
    return out


def merged(slots: Column, count: int, keep: int) -> Column:
    """For each slot the best rows of it and all lower ones: slots are merged from the lowest (last) one up.

    `slots` is an array of (slot, score, vec_id); the result is an array over slots of arrays of (up, vec_id) with up = -score.
    """
    rows = F.transform(slots, lambda s: F.struct(s["slot"].alias("slot"), F.struct((-s["score"]).alias("up"), s["vec_id"].alias("vec_id")).alias("row")))

    def above(tails: Column, slot: Column) -> Column:
        own = F.transform(F.filter(rows, lambda r: r["slot"] == slot), lambda r: r["row"])
        return F.concat(F.array(F.slice(F.array_sort(F.concat(own, F.element_at(tails, 1))), 1, keep)), tails)

    none = F.array(F.array().cast("array<struct<up:bigint,vec_id:bigint>>"))
    return F.aggregate(F.sequence(F.lit(count - 1), F.lit(0), F.lit(-1)), none, above)


def mine_negatives(vectors: DataFrame, asks: Column, label: Column | str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
                   high: int = HIGH, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for which `asks` holds. Scores are inner products of floor(scale * x); higher ones come first, ties by
    smaller id. An anchor's positives are its first rows of the same label and another id. For each of them, the first
    `negatives` rows of other labels with low <= 100 * negative_score / positive_score <= high (as products, so none for
    scores below 0) are returned. Rows with a null id, label or vector, or a null or non-finite component, take no part;
    vectors of different lengths are not compared. Scores beyond a long become the outermost ones. Repeated rows are
    candidates of their own; an anchor that is repeated whole asks once, one with a repeated id and another label or vector asks for
    itself. Labels are integers. An empty table gives an empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).alias("vector"), F.coalesce(asks, F.lit(False)).alias("_asks"))
    rows = rows.filter("vec_id is not null and label is not null and vector is not null")
    asked = rows.filter("_asks").select("vec_id", "label", "vector").distinct()
    asked = materialize(asked.withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    size = asked.agg(F.sum(8 * F.size("vector") + 64)).first()[0] or 0
    blocks = -(-size // anchor_bytes)
    path = new_path(spark, "negatives")
    plain = rows.select("vec_id", "label", "vector")
    shape = "anchor bigint, slot int, score bigint, vec_id bigint"
    for block in range(blocks):
        table = asked.filter(F.pmod(F.xxhash64("anchor"), F.lit(blocks)) == block).toArrow()
        anchors = spark.sparkContext.broadcast(_block_of(table, scale))

        def best_positives(batches, held=anchors):
            return _scan(held.value, positives, scale, False)(batches)

        best = materialize(_first(plain.mapInArrow(best_positives, shape), positives, "anchor").select("anchor", "place", "score", "vec_id"), "positives")
        limits = spark.sparkContext.broadcast(_with_limits(anchors.value, best.toArrow(), positives, low, high))

        def best_negatives(batches, held=limits):
            return _scan(held.value, negatives, scale, True)(batches)

        kept = _first(plain.mapInArrow(best_negatives, shape), negatives, "anchor", "slot")
        slots = kept.groupBy("anchor").agg(F.collect_list(F.struct("slot", "score", "vec_id")).alias("slots"))
        tails = slots.select("anchor", merged(F.col("slots"), positives, negatives).alias("tails"))
        windows = best.withColumnRenamed("vec_id", "positive_id").join(tails, "anchor")
        # positives' limits descend with their place; equal limits share the last of their slots
        windows = windows.withColumn("tail", F.element_at("tails", F.col("place")))
        least = F.col("score").cast("decimal(20,0)") * low
        inside = F.filter("tail", lambda r: (-r["up"]).cast("decimal(20,0)") * 100 >= least)
        found = windows.select("anchor", "positive_id", F.col("score").alias("positive_score"), F.posexplode(inside).alias("rank", "row"))
        names = asked.select("anchor", F.col("vec_id").alias("anchor_id"))
        found.join(names, "anchor").select(
            "anchor_id", "positive_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("row.vec_id").alias("negative_id"), "positive_score",
            (-F.col("row.up")).alias("negative_score"),
        ).write.mode("append").parquet(path)
        anchors.unpersist()
        limits.unpersist()
    result = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    return spark.read.schema(result).parquet(path) if blocks else spark.createDataFrame([], result)
