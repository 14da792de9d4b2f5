"""Benchmark passages inside documents: Wu-Manber search over words.

All windows of the benchmark items that have the same number of words are searched together. A table tells for each
block of two neighbouring words how far the search may jump; where it may not, the window's last block selects the few
windows that end so, and these are compared word by word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintfleet.llm.common import ITEM_WORDS, bound_batches, free_name, take_worker, utf8
from lintfleet.llm.inrow import let, running
from lintfleet.session import materialize

WINDOW = 10
SLICE_BYTES = 4_000_000  # of item texts that one broadcast holds; a worker's tables take over a hundred times that


def words_of(text: str) -> list[bytes]:
    """Lower-case (A-Z only) runs of ASCII letters, digits and all characters beyond ASCII."""
    return utf8(text).translate(ITEM_WORDS).split()


class WuManber:
    """Finds many word sequences of one length m in a word list. `patterns`: sequence -> what it stands for."""

    def __init__(self, patterns: dict[tuple, list]):
        self.size = m = len(next(iter(patterns)))
        self.block = b = min(2, m)
        self.most = m - b + 1
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, dict[bytes, list]] = defaultdict(lambda: defaultdict(list))
        for pattern, stands_for in patterns.items():
            for end in range(b, m + 1):
                block = pattern[end - b : end]
                self.shift[block] = min(self.shift.get(block, self.most), m - end)
            self.bucket[pattern[m - b :]][pattern[0]].append((pattern, stands_for))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list]]:
        """(first word, what the pattern stands for) of each occurrence, from left to right."""
        m, b, most, shift, at, n = self.size, self.block, self.most, self.shift.get, self.size, len(words)
        while at <= n:
            block = (words[at - 2], words[at - 1]) if b == 2 else (words[at - 1],)
            jump = shift(block, most)
            if jump:
                at += jump
                continue
            starting = self.bucket[block].get(words[at - m])
            if starting:
                here = tuple(words[at - m : at])
                for pattern, stands_for in starting:
                    if pattern == here:
                        yield at - m, stands_for
            at += 1


def searchers(items: Iterable[tuple[str, str]], window: int) -> list[WuManber]:
    by_size: dict[int, dict[tuple, list]] = defaultdict(dict)
    for item, text in items:
        words = words_of(text or "")
        size = min(window, len(words))
        for at in range(len(words) - size + 1 if size else 0):
            owners = by_size[size].setdefault(tuple(words[at : at + size]), [])
            if item not in owners:
                owners.append(item)
    return [WuManber(p) for _, p in sorted(by_size.items())]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one, in order."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def _search(spark: SparkSession, items: list[tuple[str, str]], window: int):
    """A function of a text: its number of words, the merged spans of hit words, the ids of the items found."""
    held = spark.sparkContext.broadcast(items)
    span_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        take_worker("decontamination")
        tables = searchers(held.value, window)
        for batch in batches:
            counts, spans, found = [], [], []
            for value in batch:
                words = words_of(value.as_py() or "")
                hits: list[tuple[int, int]] = []
                owners: set[str] = set()
                for table in tables:
                    for first, stands_for in table.search(words):
                        hits.append((first, first + table.size))
                        owners.update(stands_for)
                counts.append(len(words))
                spans.append([{"first": a, "end": b} for a, b in merged(hits)])
                found.append(sorted(owners))
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(spans, span_type), pa.array(found, pa.list_(pa.string()))], ["n_words", "spans", "item_ids"])

    return F.arrow_udf(run, "n_words bigint, spans array<struct<first:bigint,end:bigint>>, item_ids array<string>")


def _pieces(item: str, text: str, window: int, piece_bytes: int) -> Iterator[tuple[str, str]]:
    """An item as it is, or, if it is over `piece_bytes`, in pieces that together hold each of its windows."""
    if len(text) <= piece_bytes:
        yield item, text
        return
    words = words_of(text)
    step = max(1, piece_bytes * len(words) // len(text))
    for first in range(0, max(1, len(words) - window + 1), step):
        yield item, b" ".join(words[first : first + step + window - 1]).decode("utf-8", "replace")


def _slices(items: DataFrame, slice_bytes: int, window: int) -> Iterator[list[tuple[str, str]]]:
    """The items in slices, one at a time: the driver never holds more than the one in use and a partition of the table."""
    held, room = [], slice_bytes
    for row in items.toLocalIterator():
        for piece in _pieces(row["item"], row["text"], window, slice_bytes):
            if held and room < len(piece[1]):
                yield held
                held, room = [], slice_bytes
            held.append(piece)
            room -= len(piece[1])
    yield held


def find_passages(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text", into: str = "passages",
                  item_col: str = "item_id", item_text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The input with a struct `into` added: n_words, n_hit (words inside an occurrence), spans of them, item_ids (as sorted text).

    A window is `window` consecutive words of an item; a shorter item is one window. Null and empty texts have no words;
    items with a null id or text are left out; an empty benchmark hits nothing. Rows are searched one by one, so null ids and
    repeated rows change nothing; a column named like `into` is replaced, all others stay, whatever their names.
    Items are broadcast in slices of at most `slice_bytes`. With one slice the result is a plain scan. With more, the rows
    are written once with the first slice's hits, each further slice adds a table of its hits alone, and these are joined.
    """
    listed = items.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{item_text_col}`").alias("text")).dropna()
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.drop(into)
    row, part = free_name(docs, "_row"), free_name(docs, "_part")
    text, kept = F.col(f"`{text_col}`"), [F.col(f"`{c}`") for c in docs.columns]
    slices = _slices(listed, slice_bytes, window)
    rows = docs.select("*", _search(spark, next(slices), window)(text).alias(part))
    spans, ids = F.col(f"{part}.spans"), F.col(f"{part}.item_ids")
    hits = None
    for n, some in enumerate(slices):
        if n == 0:
            rows = materialize(rows.withColumn(row, F.monotonically_increasing_id()), "passages")
        found = rows.select(row, _search(spark, some, window)(text).alias(part)).filter(F.size(F.col(f"{part}.spans")) > 0)
        found = materialize(found.select(row, F.col(f"{part}.spans").alias("spans"), F.col(f"{part}.item_ids").alias("item_ids")), "passages")
        hits = found if hits is None else hits.unionByName(found)
    if hits is not None:
        more = free_name(rows, "_more")
        hits = hits.groupBy(row).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("item_ids")).alias("item_ids"))
        rows = rows.join(hits.select(row, F.struct("spans", "item_ids").alias(more)), row, "left")
        spans = F.when(F.col(more).isNull(), spans).otherwise(_joined_up(F.array_sort(F.concat(spans, F.col(f"{more}.spans")))))
        ids = F.when(F.col(more).isNull(), ids).otherwise(F.array_sort(F.array_distinct(F.concat(ids, F.col(f"{more}.item_ids")))))
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["first"])
    result = F.struct(F.col(f"{part}.n_words").alias("n_words"), hit.alias("n_hit"), spans.alias("spans"), ids.alias("item_ids"))
    return rows.select(*kept, result.alias(into))


def _joined_up(spans: Column) -> Column:
    """Sorted spans, at least one, with overlapping or touching ones as one."""

    def starts(found: Column) -> Column:
        ended = running(F.transform(found, lambda s: s["end"]), lambda a, b: F.greatest(a, b), F.lit(-1).cast("bigint"))
        marked = F.zip_with(found, ended, lambda s, e: F.struct(s["first"].alias("first"), e.alias("ended")))
        # the last stretch ends where all have ended
        return F.array_append(F.filter(marked, lambda s: s["first"] > s["ended"]), F.struct(
            F.lit(None).cast("bigint").alias("first"), F.array_max(F.transform(found, lambda s: s["end"])).alias("ended")))

    def ends(marks: Column) -> Column:
        n = F.size(marks) - 1
        return F.zip_with(F.slice(marks, F.lit(1), n), F.slice(marks, F.lit(2), n), lambda s, after: F.struct(s["first"].alias("first"), after["ended"].alias("end")))

    return let(let(spans, starts), ends)
