"""Near duplicates among embeddings by an inverted multi-index.

Two codebooks, fitted independently on the first and the second half of the vectors, form a grid of cells; every vector is
filed in the cell of its nearest codewords. A vector then visits cells in the order of its distance to them (multi-sequence
traversal: the two sorted lists of codewords are walked by a heap). It stops where the excess over its own cell's distance is
more than a bound, which is set so that pairs right at the threshold meet with the target recall; nearer pairs meet more
often. What meets in a cell is verified by exact cosine.

The codebooks and the bound come from a bounded sample and only steer the work; every vector is filed, and a recall of 1
visits all cells, which is the exact way. Equal vectors are one row of the index with a count. Long cells are cut into blocks
and each two blocks meet in one task. Tasks put out counts and enough links to join what belongs together, never pairs.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintfleet.llm.common import bound_batches
from lintfleet.llm.components import components
from lintfleet.session import materialize

COSINE = 0.93
RECALL = 0.99  # of pairs right at the threshold, found from either side
SAMPLE = 10_000  # vectors that codebooks are fitted on
PROBES = 1_000  # of them that set the bound of the traversal
ROUNDS = 12  # of k-means
PER_CELL = 64  # distinct vectors of the largest group that a cell should hold, were they spread evenly
MOST_WORDS = 512  # of a codebook
BLOCK = 1024  # rows that meet as many others in one task
SIZED = 100_000  # cells that are broadcast; more are joined


class Grid(NamedTuple):
    first: np.ndarray  # codewords of the halves
    second: np.ndarray
    excess: float  # over the own cell's squared distance, up to which cells are visited


def halves(unit: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The two halves, filled up with zeros to the codebooks' width."""
    if unit.shape[1] < 2 * width:
        unit = np.pad(unit, ((0, 0), (0, 2 * width - unit.shape[1])))
    return unit[:, :width], unit[:, width : 2 * width]


def distances(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squared, but for the points' own lengths, which cancel out in all comparisons."""
    return (words**2).sum(1)[None, :] - 2 * points @ words.T


def fit_words(points: np.ndarray, count: int, seed: int) -> np.ndarray:
    """k-means; a codeword that loses all its points starts anew at a far one."""
    rng = np.random.default_rng(seed)
    words = points[rng.choice(len(points), min(count, len(points)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = distances(points, words)
        to = near.argmin(1)
        sums, n = np.zeros_like(words), np.bincount(to, minlength=len(words))
        np.add.at(sums, to, points)
        words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
        lost = np.flatnonzero(n == 0)
        words[lost] = points[np.argsort(-near[np.arange(len(points)), to], kind="stable")[: len(lost)]]
    return words


def traverse(first: np.ndarray, second: np.ndarray, excess: float) -> list[int]:
    """Cells (row * columns + column) in ascending order of first[row] + second[column], up to that much over the least sum."""
    rows, columns = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = (first[rows] - first[rows[0]]).tolist(), (second[columns] - second[columns[0]]).tolist()
    rows, columns, width = rows.tolist(), columns.tolist(), len(second)
    heap, out = [(0.0, 0, 0)], []
    while heap:
        cost, i, j = heapq.heappop(heap)
        if cost > excess:
            break
        out.append(rows[i] * width + columns[j])
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):  # each cell is pushed from one side only
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return out


def excess_of(points: tuple[np.ndarray, np.ndarray], partners: tuple[np.ndarray, np.ndarray], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """How far over the own cell's distance each point has to go to visit its partner's cell."""
    total = np.zeros(len(points[0]))
    for mine, other, words in zip(points, partners, (first, second), strict=True):
        near = distances(mine, words)
        total += near[np.arange(len(near)), distances(other, words).argmin(1)] - near.min(1)
    return total


def fit(sample: np.ndarray, words: int, cosine: float, recall: float, seed: int = 7) -> Grid:
    """Codebooks of a sample of unit vectors, and the bound of the traversal.

    For the bound, sampled vectors get partners in random directions at exactly the threshold; it is the excess at which the
    wanted share of them meets, from one side or the other.
    """
    width = -(-sample.shape[1] // 2)
    left, right = halves(sample, width)
    first, second = fit_words(left, words, seed), fit_words(right, words, seed + 1)
    if recall >= 1:
        return Grid(first, second, np.inf)
    rng = np.random.default_rng(seed + 2)
    some = sample[rng.permutation(len(sample))[:PROBES]]
    away = rng.normal(size=some.shape)
    away -= (away * some).sum(1, keepdims=True) * some
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
    partner = cosine * some + np.sqrt(max(0.0, 1 - cosine * cosine)) * away
    x, y = halves(some, width), halves(partner, width)
    least = np.minimum(excess_of(x, y, first, second), excess_of(y, x, first, second))
    return Grid(first, second, float(np.quantile(least, recall)) + 1e-9)


def unit_rows(raw: np.ndarray) -> np.ndarray:
    """In double precision, scaled to length 1. Rows are finite and not zero."""
    raw = raw.astype("f8")
    raw = raw / np.abs(raw).max(1, keepdims=True)  # else squares could leave the range
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


def _usable(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows are finite and not zero, all rows' lengths, and all values one after the other."""
    sizes = np.maximum(pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype("i8"), 0)
    values = pc.fill_null(vectors.flatten(), np.nan).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    good = np.zeros(len(sizes), bool)
    good[owner[values != 0]] = True
    good[owner[~np.isfinite(values)]] = False
    return good, sizes, values


def _keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as binary, null where unusable, with a key that equal ones share."""
    for batch in batches:
        good, sizes, values = _usable(batch.column(2))
        values = values + 0.0  # minus zero equals zero
        ends = np.cumsum(sizes) * values.itemsize
        whole = values.tobytes()
        raw = [whole[e - s * values.itemsize : e] if g else None for g, s, e in zip(good.tolist(), sizes.tolist(), ends.tolist(), strict=True)]
        keys = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "label", "key", "raw"])


def _matrix(raw: list[bytes], kind: str) -> np.ndarray:
    return unit_rows(np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1))


def _filing(grid: Grid, kind: str):
    """Adds to each row its cell and the cells that it visits, its own among them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = grid.first.shape[1]
        for batch in batches:
            raw = batch.column(batch.schema.get_field_index("raw")).to_pylist()
            cells, visits = [0] * len(raw), [[]] * len(raw)
            sizes = np.array([len(r) for r in raw])
            for size in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == size)
                left, right = halves(_matrix([raw[i] for i in mine], kind), width)
                for i, a, b in zip(mine.tolist(), distances(left, grid.first), distances(right, grid.second), strict=True):
                    visits[i] = traverse(a, b, grid.excess)
                    cells[i] = visits[i][0]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells, pa.int32()), pa.array(visits, pa.list_(pa.int32()))], names=[*batch.schema.names, "cell", "visits"])

    return run


def _reached(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray, count: int) -> np.ndarray:
    """For each of `count` places the smallest one that links (between places `rows` and `columns`) lead to."""
    label = np.arange(count)
    while True:
        new = label.copy()
        new[rows] = np.minimum(new[rows], np.where(linked, label[columns][None, :], count).min(1, initial=count))
        new[columns] = np.minimum(new[columns], np.where(linked, new[rows][:, None], count).min(0, initial=count))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verifying(cosine: float, kind: str):
    """What meets in a cell: per node the number of vectors it is linked with here, and one node that it reaches."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("node")
        node, n, cell, block = (table[c].to_numpy() for c in ("node", "n", "cell", "block"))
        at, low, high = (k.as_py() for k in key[2:])
        own = cell == at  # filed here; the others visit
        rows = np.flatnonzero(own & (block == low))
        columns = np.flatnonzero(block == high)
        unit = _matrix(table["raw"].to_pylist(), kind)
        linked = unit[rows] @ unit[columns].T >= cosine
        linked[rows[:, None] == columns[None, :]] = False
        # a pair can meet in the cells of both: then it counts where the larger node is filed
        guests = np.flatnonzero(~own[columns] & linked.any(0))
        if len(guests):
            homes, home = np.unique(cell[columns[guests]], return_inverse=True)
            visits = table["visits"].combine_chunks().take(pa.array(rows))
            seen, owner = visits.flatten().to_numpy(), np.repeat(np.arange(len(rows)), visits.value_lengths().to_numpy())
            place = np.minimum(np.searchsorted(homes, seen), len(homes) - 1)
            hit = homes[place] == seen
            back = np.zeros((len(rows), len(homes)), bool)  # does the one filed here visit the guest's cell?
            back[owner[hit], place[hit]] = True
            linked[:, guests] &= ~(back[:, home] & (node[rows][:, None] < node[columns[guests]][None, :]))
        links = np.zeros(len(node), "i8")
        links[rows] = linked @ n[columns]
        other = np.flatnonzero(~np.isin(columns, rows))
        links[columns[other]] = linked[:, other].T @ n[rows]
        some = np.flatnonzero(links)
        reached = _reached(linked, rows, columns, len(node))
        return pa.table({"node": pa.array(node[some]), "links": pa.array(links[some]), "reaches": pa.array(node[reached[some]])})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, id_col: str = "vec_id", label_col: str = "label",
                    vector_col: str = "embedding", per_cell: int = PER_CELL, block: int = BLOCK) -> DataFrame:
    """One row per input row: id_col, n_links, component_id, kept.

    Vectors are linked when their labels are equal and not null and their cosine, in double precision, is at least `cosine`
    (over 0). n_links counts the other vectors that a vector is linked with directly; component_id is the smallest id that
    links lead to, the own one included; kept says that it is the own one. Vectors that are null, empty, zero or hold a null or non-finite
    component are linked with nothing, as are rows with a null id, whose component is null (and which are kept). Vectors of different
    lengths are not linked. Repeated rows are vectors of their own. Found are at least `recall` of the pairs at the threshold,
    by the model of `fit`, and more of the nearer ones; a recall of 1 compares all. Ids are integers. Other columns are not read.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    source = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    kind = "<f4" if isinstance(source.schema["vector"].dataType.elementType, T.FloatType) else "<f8"
    if kind == "<f8":
        source = source.withColumn("vector", F.col("vector").cast("array<double>"))
    types = [f"{c} {source.schema[c].dataType.simpleString()}" for c in ("vec_id", "label")]
    rows = materialize(source.mapInArrow(_keyed, ", ".join([*types, "key binary, raw binary"])), "vectors")
    slim = rows.drop("raw")
    use = "vec_id is not null and label is not null and key is not null"
    classes = rows.filter(use).groupBy("label", "key").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"), F.first("raw").alias("raw"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    widest = classes.agg(F.max(F.length("raw"))).first()[0] or 0
    sample = classes.filter(F.length("raw") == widest).orderBy("key", "label").limit(SAMPLE).select("raw").toArrow()["raw"].to_pylist()  # keys are hashes
    if sample:
        words = int(np.clip(round((largest / per_cell) ** 0.5), 1, MOST_WORDS))
        grid = fit(_matrix(sample, kind), words, cosine, recall)
    else:
        grid = Grid(np.zeros((1, 1)), np.zeros((1, 1)), np.inf)
    held = spark.sparkContext.broadcast(grid)

    def file_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _filing(held.value, kind)(batches)

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    filed = materialize(classes.mapInArrow(file_rows, f"{shape}, cell int, visits array<int>"), "filed")
    return _finish(slim, classes, _met(filed, cosine, kind, block), use)


def _met(filed: DataFrame, cosine: float, kind: str, block: int) -> DataFrame:
    """What the cells give, written. A cell with more rows than a block is cut into blocks of those filed there and of its visitors."""
    at = ["label", "size", "at"]
    listed = filed.select("label", F.length("raw").alias("size"), F.explode("visits").alias("at"), "node", "n", "cell", "visits", "raw")
    is_own = F.col("cell") == F.col("at")
    sizes = listed.groupBy(*at).agg(F.count("*").alias("rows"), F.count(F.when(is_own, 1)).alias("own"))

    def blocks(rows):
        return F.when(F.col("rows") <= block, 0).otherwise(F.ceil(rows / block)).cast("int")

    # where nobody is filed, or one alone, nothing can be found
    cells = sizes.filter("own > 0 and rows > 1").select(*at, F.greatest(F.lit(1), blocks(F.col("own"))).alias("owns"), blocks(F.col("rows") - F.col("own")).alias("guests"))
    cells = materialize(cells, "cells")
    few = cells.limit(SIZED + 1).count() <= SIZED
    dealt = listed.join(F.broadcast(cells) if few else cells, at)
    hashed = F.xxhash64("node", F.lit(-1))
    guest = F.when(F.col("guests") > 0, F.col("owns") + F.pmod(hashed, F.greatest(F.col("guests"), F.lit(1)))).otherwise(0)
    dealt = dealt.withColumn("block", F.when(is_own, F.pmod(hashed, F.col("owns"))).otherwise(guest).cast("int"))
    # each block of those filed here meets all blocks, a block of guests meets only those
    last = F.when(is_own, F.col("owns") + F.col("guests")).otherwise(F.col("owns")) - 1
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    dealt = dealt.select(*at, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "n", "cell", "visits", "raw", "block")
    dealt = dealt.repartition(*at, "low", "high")  # also where the join has dealt by cell
    verified = dealt.groupBy(*at, "low", "high").applyInArrow(_verifying(cosine, kind), "node bigint, links bigint, reaches bigint")
    return materialize(verified, "links")


def _finish(slim: DataFrame, classes: DataFrame, met: DataFrame, use: str) -> DataFrame:
    counts = met.groupBy("node").agg(F.sum("links").alias("links"))
    edges = met.filter("node <> reaches").select(F.col("node").alias("a"), F.col("reaches").alias("b"))
    found = classes.select("label", "key", "node", "n", "first_id").join(counts, "node", "left")
    if edges.isEmpty():
        named = found.withColumn("component_id", F.col("first_id"))
    else:
        labels = materialize(components(edges), "labels")
        known = classes.select("node", "first_id").join(labels.withColumnRenamed("label", "root"), "node")
        least = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
        joined = known.join(least, "root").select("node", "component_id")
        named = found.join(joined, "node", "left").withColumn("component_id", F.coalesce("component_id", "first_id"))
    named = named.select("label", "key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = slim.filter(use).join(named, ["label", "key"], "left").select("vec_id", "n_links", F.col("component_id").cast("long").alias("component_id"))
    rest = slim.filter(~F.coalesce(F.expr(use), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
