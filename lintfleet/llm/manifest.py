"""Merkle manifest of a dataset: a leaf per row, a subroot per group, one root, and a proof for every row.

Nested-struct rollup: rows are ranked in their group, and the rank is written in digits. Inside a block of bounded size
the lowest digit is grouped away first, which nests the children of a node as an array of structs, then the next one.
A block's row then holds its whole subtree; transforms turn it into the siblings on each row's way up, and an explode
puts out one row per leaf, so proofs need no join with the nodes. Blocks are the leaves of the next tier, so the number of tiers
grows with the logarithm of the rows; only what lies above a block comes to it by a join, one small row per block.

Ranks come from range partitions: numbers inside a partition, plus the rows of the group in all partitions before. A
group that holds most rows is spread over partitions and blocks like any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintfleet.session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<before:string,after:string>>"


class Shape(NamedTuple):
    """Of the tree and its blocks: a block has at most fan ** (digit_levels * digits) leaves."""

    fan: int = 2  # nodes under one node
    digits: int = 2  # of the rank inside a block
    digit_levels: int = 5  # levels of the tree that one digit stands for

    @property
    def radix(self) -> int:
        return self.fan**self.digit_levels


SHAPE = Shape()


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def leaf_of(values: Sequence[Column]) -> Column:
    """Digest of the values one after the other: `-` for null, else UTF-8 byte count, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def _levels(nodes: Column, fan: int) -> Column:
    """Levels until one node is left of that many."""
    powers = [fan**i for i in range(63) if fan**i < 1 << 62]
    return F.size(F.filter(F.array(*[F.lit(p) for p in powers]), lambda p: p < nodes))


def _grid(leaves: Column, levels: Column, fan: int) -> Column:
    """The nodes of each level, the leaves first: array<array<string>>."""

    def above(rows: Column, _: Column) -> Column:
        last = F.element_at(rows, -1)
        starts = F.sequence(F.lit(1), F.size(last), F.lit(fan))
        return F.concat(rows, F.array(F.transform(starts, lambda s: digest(F.array_join(F.slice(last, s, F.lit(fan)), "")))))

    steps = F.when(levels > 0, F.sequence(F.lit(1), levels)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(leaves), above)


def _way(grid: Column, place: Column, fan: int) -> Column:
    """The siblings before and after a leaf of the grid and the nodes above it, lowest level first."""

    def step(level: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(fan), level)).cast("int")
        first, row = at - F.pmod(at, F.lit(fan)), F.element_at(grid, level + 1)
        before = F.array_join(F.slice(row, first + 1, at - first), "")
        after = F.array_join(F.slice(row, at + 2, first + fan - at - 1), "")
        return F.struct(before.alias("before"), after.alias("after"))

    return F.transform(F.slice(F.sequence(F.lit(0), F.size(grid)), 1, F.size(grid) - 1), step)


def ranked(leaves: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """The rows with _pos (place in the group, from 0) and _nodes (rows of the group)."""
    sorted_rows = leaves.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(group, *order, "_row")
    sorted_rows = sorted_rows.sortWithinPartitions(group, *order, "_row").drop("_row")
    # written, so that partitions and numbers stay what they are if a task is run again
    numbered = materialize(sorted_rows.withColumn("_id", F.monotonically_increasing_id()), "ranked").withColumn("_part", F.shiftright("_id", 33))
    parts = numbered.groupBy(group, "_part").agg(F.count("*").alias("_rows"), F.min("_id").alias("_first"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per partition
    parts = parts.select(
        group, "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(Window.partitionBy(group)).alias("_nodes"),
    )
    return numbered.join(parts, [group, "_part"]).withColumn("_pos", F.col("_id") + F.col("_shift")).drop("_id", "_shift", "_part")


def rolled(nodes: DataFrame, group: str, carried: Sequence[str], shape: Shape = SHAPE) -> DataFrame:
    """One row per block: the group, _block, _nodes, _blocks (in its group), root, and the nested subtree `tree`.

    `nodes` has the group, _pos, _nodes, hash and the carried columns. Digit after digit of _pos is grouped away.
    """
    fan, digits, digit_levels = shape
    size = shape.radix**digits
    left = _levels(F.col("_nodes"), fan)
    cut = nodes.select(
        group, "_nodes", F.floor(F.col("_pos") / size).alias("_block"),
        *[F.pmod(F.floor(F.col("_pos") / shape.radix**d), F.lit(shape.radix)).cast("int").alias(f"_d{d}") for d in range(digits)],
        "hash", F.struct(*carried).alias("tree"),
    )
    cut = cut.repartition(group, "_block")  # a block's digits are all grouped where its rows are
    for d in range(digits):
        kept = [group, "_nodes", "_block", *[f"_d{x}" for x in range(d + 1, digits)]]
        nested = cut.groupBy(*kept).agg(F.array_sort(F.collect_list(F.struct(F.col(f"_d{d}").alias("digit"), "hash", "tree")), _by_digit).alias("kids"))
        levels = F.least(F.lit(digit_levels), F.greatest(F.lit(0), left - d * digit_levels))
        gridded = nested.withColumn("grid", _grid(F.transform("kids", lambda k: k["hash"]), levels, fan))
        below = F.transform("kids", lambda k: k["tree"])
        cut = gridded.select(*kept, F.element_at(F.element_at("grid", -1), 1).alias("hash"), F.struct("grid", below.alias("kids")).alias("tree"))
    return cut.select(group, "_block", "_nodes", F.ceil(F.col("_nodes") / size).alias("_blocks"), F.col("hash").alias("root"), "tree")


def _by_digit(a: Column, b: Column) -> Column:
    return a["digit"] - b["digit"]


def unrolled(blocks: DataFrame, group: str, kept: Sequence[str], shape: Shape = SHAPE) -> DataFrame:
    """One row per leaf: the group, _block, the kept columns, _pos in the block's tier, the leaf's carried struct as `leaf`, and `path`.

    `blocks` has the tree and `above`, the steps from the block's root on. Each digit's array is exploded with the steps it adds.
    """
    rows = blocks.select(group, "_block", *kept, F.col("tree").alias("t"), F.col("above").alias("path"), F.col("_block").alias("_pos"))
    for _ in range(shape.digits):
        placed = rows.select(group, "_block", *kept, "_pos", "path", F.col("t.grid").alias("grid"), F.posexplode("t.kids").alias("place", "t"))
        path = F.concat(_way(F.col("grid"), F.col("place"), shape.fan), "path").alias("path")
        rows = placed.select(group, "_block", *kept, (F.col("_pos") * shape.radix + F.col("place")).alias("_pos"), "t", path)
    return rows.withColumnRenamed("t", "leaf")


def _tree(nodes: DataFrame, group: str, carried: Sequence[str], shape: Shape) -> list[DataFrame]:
    """The blocks of each tier, lowest first; in the last one each group is one block."""
    tiers = [materialize(rolled(nodes, group, carried, shape), "blocks")]
    while not tiers[-1].filter("_blocks > 1").isEmpty():
        upper = tiers[-1].select(group, F.col("_block").alias("_pos"), F.col("_blocks").alias("_nodes"), F.col("root").alias("hash"), F.lit(None).cast("string").alias("none"))
        # a group that is one block already stays as it is: one node needs no level
        tiers.append(materialize(rolled(upper, group, ["none"], shape), "blocks"))
    return tiers


def _paths(tiers: list[DataFrame], group: str, top: DataFrame, kept: Sequence[str], shape: Shape) -> DataFrame:
    """Leaves with their whole path; `top` has the group, the kept columns and `above`, the steps over the group's root."""
    above, on = top, [group]
    for tier in reversed(tiers):
        found = unrolled(tier.select(group, "_block", "tree").join(above, on), group, kept, shape)
        above, on = found.select(group, F.col("_pos").alias("_block"), *kept, F.col("path").alias("above")), [group, "_block"]
    return found


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: Sequence[str] = FIELDS, carry: Mapping[str, Column] | None = None,
             shape: Shape = SHAPE) -> DataFrame:
    """One row per input row: id_col, group_col, leaf, subroot, root, path, and the columns of `carry`.

    In each group leaves ascend by id (null first), equal ids by leaf; while several nodes remain, each `shape.fan` consecutive
    ones become their digest, also a last run with fewer. A group's last node is its subroot; subroots, ordered by group
    (null first, then UTF-8 bytewise), become the root alike. `path` lists, from the leaf to the root, the digests of the
    siblings before and after, each as one text. A null group is a group of its own, other than the empty text. Repeated
    rows are leaves of their own. Empty and long texts are values like any other. An empty table gives an empty result. Columns that are not
    named in `fields` are not read and may have any name.
    """
    group_text = F.col(f"`{group_col}`").cast("string")
    carry = dict(carry or {})
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), group_text), F.lit("")).alias("_group"),  # never null, in the same order
        F.col(f"`{id_col}`").alias("_key"),
        F.col(f"`{group_col}`").alias("_name"),
        leaf_of([F.col(f"`{c}`") for c in fields]).alias("hash"),
        F.struct(*[c.alias(n) for n, c in carry.items()], F.lit(None).cast("string").alias("_none")).alias("_more"),
    )
    leaves = materialize(leaves, "leaves")  # texts are read once; what is sorted and sampled below is slim
    nodes = ranked(leaves, "_group", ["_key", "hash"]).withColumn("_leaf", F.col("hash"))
    tiers = _tree(nodes, "_group", ["_key", "_name", "_leaf", "_more"], shape)

    subroots = tiers[-1].select(F.lit("").alias("_all"), F.col("_group").alias("_member"), F.col("root").alias("hash"))
    upper = _tree(ranked(subroots, "_all", ["_member"]).withColumn("_subroot", F.col("hash")), "_all", ["_member", "_subroot"], shape)
    root = upper[-1].select("_all", F.col("root").alias("_root"), F.array().cast(STEP).alias("above"))
    named = _paths(upper, "_all", root, ["_root"], shape)
    top = named.select(F.col("leaf._member").alias("_group"), F.col("leaf._subroot").alias("_subroot"), "_root", F.col("path").alias("above"))
    found = _paths(tiers, "_group", top, ["_subroot", "_root"], shape)
    return found.select(
        F.col("leaf._key").alias(id_col), F.col("leaf._name").alias(group_col), F.col("leaf._leaf").alias("leaf"),
        F.col("_subroot").alias("subroot"), F.col("_root").alias("root"), "path", *[F.col(f"leaf._more.{n}").alias(n) for n in carry],
    )


def proof_digest(path: Column) -> Column:
    """Digest of all siblings on the way, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda h, s: digest(F.concat(s["before"], h, s["after"])))
