"""N-gram Jaccard join: token-combination prefixes, then verification, then components of the links.

Tokens are a document's distinct shingles. All documents list their tokens in one order: rare ones first, then two
classes of frequent ones, each class cut into groups. Two documents that are similar enough differ in at most `slack`
tokens of either, so they share a signature if the signatures come from a prefix with coverage slack + 1, where t tokens
of one group of class k cover t - k + 1. Class 1 (rare) is indexed by single tokens, class 2 by pairs and class 3 by
triples of tokens of a group. The number of groups follows the document's size band; a document near the upper end of
its band is indexed in the next band too, so that partners always meet in the larger one's band.

Classes only steer the work, never the result: a token's class is a function of the token alone. They come from counts
over all documents, of which a bounded number of the most frequent tokens is broadcast. A bitmap of fixed size tells
which tokens may occur in a second document; the others come first in the order and need no index. Where the data fill
the bitmap, it only sorts out less.

Members of a signature are first compared with one pivot each in two rounds; signatures whose members are all in one
component are then done. What is left is compared block by block inside tasks, which put out only links, no pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintfleet.llm.common import SPACE_WORDS, bound_batches, take_worker, texts_of, utf8
from lintfleet.llm.components import components
from lintfleet.session import materialize

WORDS = 4
PERCENT = 85
FREQUENT = 64  # documents that make a token class 2
COMMON = 1024  # ... class 3
MAX_FREQUENT = 1_000_000  # most frequent tokens that are broadcast; the others count as rare
BITMAP_BITS = 1 << 27
FLUSH = 1_000_000  # tokens a task sorts at once
KNOWN_WORDS = 200_000
PIVOTS = 2  # rounds in which a signature's members are compared with one of them
BLOCK = 512  # members that meet as many others in one task
BLOCK_TOKENS = 200_000  # of all members of a block, about
COLUMNS = 4096  # tokens of them that are counted at once
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], "u8")


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) < KNOWN_WORDS:
            self[word] = value
        return value


_WORD_HASH = WordHash()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams; a shorter text is one n-gram, no words give none."""
    split = utf8(text).translate(SPACE_WORDS).split()
    if not split:
        return np.empty(0, "u8")
    if len(split) < words:
        return np.frombuffer(hashlib.blake2b(b" ".join(split), digest_size=8).digest(), "u8")
    if len(_WORD_HASH) >= KNOWN_WORDS:
        _WORD_HASH.clear()
    h = np.fromiter(map(_WORD_HASH.__getitem__, split), "u8", len(split))
    total = np.zeros(len(h) - words + 1, "u8")
    for j in range(words):
        total += h[j : j + len(total)] * (_MIX[j % 4] + np.uint64(2 * (j // 4)))
    return np.unique(_mixed(total))


def set_key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def slack(size: int, percent: int = PERCENT) -> int:
    """Tokens that may be missing in any partner."""
    return size - (percent * size + 99) // 100


def bands(size: int, percent: int = PERCENT) -> list[int]:
    """The document's own size band, and the next one if a partner may be there."""
    return sorted({size.bit_length(), (size * 100 // percent).bit_length()})


def groups_of(band: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """(class, groups) of the two frequent classes. A group of class k costs k - 1 of the coverage, so there are not too many."""
    base = 1 << (band - 1)
    return (2, max(1, base // 10)), (3, max(1, base // (4 if base >= 32 else 8)))


def signatures(tokens: np.ndarray, classes: np.ndarray, maybe_shared: np.ndarray, percent: int = PERCENT) -> list[int]:
    """Signatures of one document as signed 64-bit numbers.

    First in the order of tokens are those that no other document has: they use up slack and need no signature.
    """
    need = slack(len(tokens), percent) + 1 - int((~maybe_shared).sum())
    if need <= 0 or len(tokens) * 100 // percent == len(tokens):
        return []  # its own tokens alone are over the slack, or only an equal set can be a partner
    rare = np.flatnonzero(maybe_shared & (classes == 1))[:need]
    out = [_mixed(tokens[rare])]
    need -= len(rare)
    if need > 0:
        for band in bands(len(tokens), percent):
            out.append(_combined(tokens, classes, need, band))
    return np.unique(np.concatenate(out)).view("i8").tolist()


def _combined(tokens: np.ndarray, classes: np.ndarray, need: int, band: int) -> np.ndarray:
    found = []
    for k, groups in groups_of(band):
        mine = np.flatnonzero(classes == k)
        group = (_mixed(tokens[mine]) % np.uint64(groups)).astype("i8")
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[order])) + 1
        for members in np.split(mine[order], cuts) if len(mine) else []:
            members = members[: need + k - 1]
            need -= max(0, len(members) - k + 1)
            if len(members) >= k:
                picks = np.array(list(combinations(members.tolist(), k)))
                mark = np.uint64(band * 8 + k)
                found.append(_mixed(sum(_mixed(tokens[picks[:, i]] + np.uint64(i + 1)) for i in range(k)) + mark))
            if need <= 0:
                return np.concatenate(found) if found else np.empty(0, "u8")
    return np.concatenate(found) if found else np.empty(0, "u8")


def _counting(buckets: int, words: int):
    """Per document: id, size, key of the set. Per task and hash range: the tokens' next 32 bits, sorted, as differences."""
    shift = np.uint64(64 - (buckets.bit_length() - 1) - 32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("ngram_jaccard_join")
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held) >> shift)
            at = np.searchsorted(keys, np.arange(buckets + 1, dtype="u8") << np.uint64(32))
            which = np.flatnonzero(np.diff(at))
            low = keys.astype("u4")
            blobs = [planes(low[at[b] : at[b + 1]]) for b in which]
            none = len(which)
            return pa.RecordBatch.from_arrays(
                [pa.nulls(none, id_type[0]), pa.nulls(none, pa.int64()), pa.nulls(none, pa.binary()), pa.array(which, pa.int64()),
                 pa.array(blobs, pa.binary())], names=names)

        names, id_type = ["doc_id", "n_shingles", "node", "bucket", "blob"], [pa.int64()]
        for batch, texts in texts_of(batches):
            id_type[0] = batch.schema.field(0).type
            sets = [shingles(t, words) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                 pa.nulls(len(sets), pa.int64()), pa.nulls(len(sets), pa.binary())], names=names)
            held.extend(sets)
            size += sum(map(len, sets))
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()
        _WORD_HASH.clear()  # other operators' tasks use this worker too

    return run


def planes(low: np.ndarray) -> bytes:
    """Differences of sorted 32-bit numbers, their bytes by place: the high ones are zeros and compress away."""
    return np.diff(low, prepend=np.uint32(0)).view("u1").reshape(-1, 4).T.tobytes()


def unplaned(blob: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(blob, "u1").reshape(4, -1).T).view("u4")[:, 0], dtype="u4")


def _bucket_statistics(bits: int):
    """Of one hash range: a bitmap of the tokens with two or more documents, and the frequent tokens with their counts."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        low, n = np.unique(np.concatenate([unplaned(b) for b in group["blob"]]), return_counts=True)
        bitmap = np.zeros(bits, bool)
        bitmap[low[n > 1].astype("u8") >> np.uint64(32 - (bits.bit_length() - 1))] = True
        often = n >= FREQUENT
        return pd.DataFrame({
            "bucket": [group["bucket"].iloc[0]], "bitmap": [np.packbits(bitmap).tobytes()],
            "tokens": [low[often].astype("i8").tolist()], "counts": [n[often].astype("i8").tolist()]})

    return run


class TokenClasses:
    """What all tasks know about tokens: classes of the frequent ones, and the bitmap. Bounded by its two constants."""

    def __init__(self, buckets: int, bits: int, rows: list, frequent: pa.Table):
        self.shift = np.uint64(64 - (buckets.bit_length() - 1) - 32)
        self.bit_shift = np.uint64(64 - (buckets.bit_length() - 1) - (bits.bit_length() - 1))
        bitmap = np.zeros(buckets * bits // 8, "u1")
        for row in rows:
            at = row["bucket"] * bits // 8
            bitmap[at : at + bits // 8] = np.frombuffer(row["bitmap"], "u1")
        self.bitmap = bitmap
        bucket, token, n = (frequent[c].to_numpy() for c in ("bucket", "token", "n"))
        keys = (bucket.astype("u8") << np.uint64(32)) | token.astype("u8")
        order = np.argsort(keys)
        self.keys = keys[order]
        self.classes = np.where(n[order] >= COMMON, 3, 2).astype("i1")

    def of(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, may another document have it) of each token."""
        position = tokens >> self.bit_shift
        shared = (self.bitmap[position >> np.uint64(3)] >> (7 - (position & np.uint64(7)).astype("u1"))) & 1
        classes = np.ones(len(tokens), "i1")
        if len(self.keys):
            key = tokens >> self.shift
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            classes[hit] = self.classes[at[hit]]
        return classes, shared.astype(bool)


def token_classes(counted: DataFrame, buckets: int) -> TokenClasses:
    bits = max(8, BITMAP_BITS // buckets)
    blobs = counted.filter(F.col("bucket").isNotNull()).select("bucket", "blob")
    stats = materialize(
        blobs.groupBy("bucket").applyInPandas(_bucket_statistics(bits), "bucket long, bitmap binary, tokens array<long>, counts array<long>"),
        "token-statistics")
    often = stats.select("bucket", F.explode(F.arrays_zip("tokens", "counts")).alias("t"))
    often = often.select("bucket", F.col("t.tokens").alias("token"), F.col("t.counts").alias("n"))
    frequent = often.orderBy(F.desc("n"), "bucket", "token").limit(MAX_FREQUENT).toArrow()
    return TokenClasses(buckets, bits, stats.select("bucket", "bitmap").collect(), frequent)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that reach the threshold, counted on the whole sets."""
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("_a"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("_b"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):  # one pair at a time: sets can be long
                a, b = np.frombuffer(x.as_buffer(), "u8"), np.frombuffer(y.as_buffer(), "u8")
                if len(a) > len(b):
                    a, b = b, a
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                both = int((b[at] == a).sum())
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "_a", "_b")
    return joined.mapInArrow(run, "a binary, b binary")


def _compare_blocks(percent: int):
    """Links between members with different labels of one or two blocks; enough of them to join what belongs together."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", kind="stable")
        nodes, labels, sides = group["node"].tolist(), group["label"].tolist(), group["side"].to_numpy()
        sets = [np.frombuffer(t, "u8") for t in group["tokens"]]
        size = np.array([len(x) for x in sets], "i8")
        owner = np.repeat(np.arange(len(sets)), size)
        _, token, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        often = n > 1  # only tokens of two members can be common
        column = np.cumsum(often) - 1
        row, token = owner[often[token]], column[token[often[token]]]
        order = np.argsort(token, kind="stable")
        row, token = row[order], token[order]
        common = np.zeros((len(sets), len(sets)), "f4")
        for at in range(0, int(often.sum()), COLUMNS):
            first, end = np.searchsorted(token, [at, at + COLUMNS])
            some = np.zeros((len(sets), COLUMNS), "f4")
            some[row[first:end], token[first:end] - at] = 1
            common += some @ some.T
        common = common.astype("i8")
        linked = np.triu(100 * common >= percent * (size[:, None] + size[None, :] - common), 1)
        if key[1] != key[2]:
            linked &= sides[:, None] != sides[None, :]
        root: dict = {}

        def find(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        out = []
        for i, j in zip(*np.nonzero(linked), strict=True):
            a, b = find(labels[i]), find(labels[j])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((nodes[i], nodes[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def _compare_all(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Compares all members of each signature that are left.

    Signatures with the same pivot mostly have the same members; they are taken together, so that a pair is not
    compared for each of them. Members are cut into blocks, and each two blocks meet in one task.
    """
    members = rows.groupBy(F.col("pivot.node").alias("pivot"), "node").agg(F.first("label").alias("label"), F.first("n").alias("n"))
    needed = F.greatest(F.count("*") / F.lit(BLOCK), F.sum("n") / F.lit(BLOCK_TOKENS))
    blocks = members.groupBy("pivot").agg(F.ceil(needed).cast("int").alias("blocks"))
    members = members.drop("n")
    dealt = members.join(blocks, "pivot").withColumn("side", F.pmod(F.xxhash64("node", F.lit(-1)), F.col("blocks")).cast("int"))
    dealt = dealt.join(sets, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("pivot", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "node", "label", "side", "tokens")
    return dealt.groupBy("pivot", "low", "high").applyInPandas(_compare_blocks(percent), "a binary, b binary").distinct()


def _links(index: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """(node, label) of all nodes with a link; None without any. `index`: signature, node, n."""
    index = index.withColumn("label", F.col("node"))
    labels = None
    for turn in range(PIVOTS + 1):
        pivot = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "label")).alias("pivot")
        live = index.groupBy("signature", "label").agg(pivot).groupBy("signature").agg(F.count("*").alias("labels"), F.min("pivot").alias("pivot"))
        live = materialize(live.filter("labels > 1").drop("labels"), "signatures")
        if live.isEmpty():
            break
        rows = index.join(live, "signature")
        if turn < PIVOTS:
            sizes = F.least(F.col("x.n"), F.col("y.n")) * 100 >= percent * F.greatest(F.col("x.n"), F.col("y.n"))
            apart = sizes & (F.col("x.label") != F.col("y.label")) & (F.col("x.signature") == F.col("y.signature"))
            met = index.alias("x").join(live.select("signature", "pivot.node", "pivot.n", "pivot.label").alias("y"), apart)
            pairs = met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
            found = _verify(pairs, sets, percent)
        else:
            found = _compare_all(rows, sets, percent)
        found = materialize(found, "links")
        if not found.isEmpty():
            known = found if labels is None else found.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
            labels = materialize(components(known), "labels")
        if turn < PIVOTS:  # a pivot has met its whole bucket
            rest = rows.filter(F.col("node") != F.col("pivot.node")).drop("pivot")
            if labels is not None:
                rest = rest.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            index = materialize(rest.select("signature", "node", "n", "label"), "index")
    return labels


def join_similar(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Documents are linked when 100 * common shingles >= percent * shingles of either. component_id is the smallest
    doc_id reachable over links (and equal sets), the own one included. A null or empty text, or one without words, has
    no shingle and no link. Rows with a null id are linked with nothing and keep a null component. Repeated rows are equal sets.
    Other columns are not read. percent is 50 to 99.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    bound_batches(source.sparkSession)
    buckets = 1 << max(6, (8 * source.rdd.getNumPartitions() - 1).bit_length())
    buckets = min(buckets, 1 << 24)
    id_type = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_shingles bigint, node binary, bucket bigint, blob binary"
    counted = materialize(source.mapInArrow(_counting(buckets, words), schema), "shingles")
    rows = counted.filter("bucket is null").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    nodes = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"))

    known = source.sparkSession.sparkContext.broadcast(token_classes(counted, buckets))

    def index_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in texts_of(batches):
            node, size, signature = [], [], []
            for text in texts:
                tokens = shingles(text, words)
                if len(tokens):
                    found = signatures(tokens, *known.value.of(tokens), percent)
                    node += [set_key(tokens)] * len(found)
                    size += [len(tokens)] * len(found)
                    signature += found
            yield pa.RecordBatch.from_arrays(
                [pa.array(signature, pa.int64()), pa.array(node, pa.binary()), pa.array(size, pa.int64())], names=["signature", "node", "n"])
        _WORD_HASH.clear()

    with_id = source.filter("doc_id is not null")
    index = with_id.mapInArrow(index_of, "signature bigint, node binary, n bigint").distinct()
    index = materialize(index, "index")
    shared = index.groupBy("signature").agg(F.count("*").alias("members")).filter("members > 1").drop("members")
    index = materialize(index.join(shared, "signature", "left_semi"), "index")
    wanted = index.select("node").distinct()
    ids = wanted.join(nodes, "node").select(F.col("first_id").alias("doc_id")).distinct()

    def sets_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in texts_of(batches):
            sets = [s for s in (shingles(t, words) for t in texts) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "tokens"])

    sets = with_id.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(sets_of, "node binary, tokens binary")
    sets = materialize(sets.dropDuplicates(["node"]).join(wanted, "node", "left_semi"), "sets")

    labels = _links(index, sets, percent)
    if labels is None:
        named = nodes.select("node", F.col("first_id").alias("component_id"))
    else:
        joined = labels.join(nodes, "node")
        smallest = joined.groupBy("label").agg(F.min("first_id").alias("component_id"))
        linked = joined.join(smallest, "label").select("node", "component_id")
        named = nodes.join(linked, "node", "left").select("node", F.coalesce("component_id", "first_id").alias("component_id"))
    return rows.join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
