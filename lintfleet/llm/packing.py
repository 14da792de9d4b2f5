"""Documents as token sequences of bounded length, by sum-of-squares packing.

Tokens: the vocabulary's pre-tokenizer cuts a text into parts before anything else. The same cut is made here for all texts
of a batch at once; each distinct part is tokenized once per worker and remembered, new ones together, which gives the same
ids as the whole text.

Packing: only pieces shorter than a sequence are packed. They are dealt into blocks of bounded size; in a block, longest
first, each goes into the open sequence (or a new one) that leaves the sum over all gaps of (open sequences with that
gap) squared smallest. The number of open sequences that a block leaves is small against the block.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, pre_tokenizers

from lintfleet.llm.common import bound_batches, take_worker, texts_of
from lintfleet.session import materialize

LENGTH = 2048
END = 0
BLOCK = 100_000
CACHED = 100_000  # parts, and foreign chunks, of each of two generations
CACHED_CHARS = 48
BATCH_CHARS = 2_000_000  # of texts that are tokenized together
# Parts are cut here for ASCII, Latin-1 and Latin Extended-A, but for U+0130, whose lower case is two characters. A chunk
# with another character, or with what may begin a special token, is foreign: it goes to the tokenizer as it is.
_SPACES, _LETTERS, _DIGITS = "\t-\r \x85\xa0", "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_NEAR = "\x00-\u012f\u0131-\u017f"
_IS_NEAR = re.compile(f"[{_NEAR}]*").fullmatch
# in a foreign text, white space is what the vocabulary takes as such: to Python U+001C to U+001F are white space too
_FOREIGN = re.compile(rf"(?:[^\s]|[\x1c-\x1f])*?(?:[^{_NEAR}\s]|<\|)(?:[^\s]|[\x1c-\x1f])*")
_FAR_SPACE = re.compile(r"(?![\x00-\xff])\s")
_MARK, _END = "\u0180", "\u0183"  # lower-case letters; stand for a foreign chunk and for a text's end
_BLANK, _LETTER, _DIGIT, _OTHER, _ALONE = range(5)
_APOSTROPHE = 39
_ONE, _TWO = [ord(c) for c in "stmd"], [ord(a) << 16 | ord(b) for a, b in ("re", "ve", "ll")]  # after it, parts of their own with it


def _kinds() -> np.ndarray:
    table = np.full(0x184, _OTHER, "i1")
    for kind, pattern in ((_BLANK, _SPACES), (_LETTER, _LETTERS), (_DIGIT, _DIGITS), (_ALONE, _MARK + _END)):
        table[[ord(c) for c in re.findall(f"[{pattern}]", "".join(map(chr, range(0x184))))]] = kind
    return table


_KINDS = _kinds()


def cut_parts(text: str) -> pa.Array:
    """The parts that the vocabulary cuts a text into: runs of letters, single digits, runs of other characters, and 's, 't, 're and the like.

    The text is in lower case and holds no foreign chunk but marks.
    """
    code = np.frombuffer((text + "  ").encode("utf-32-le"), "<u4")
    kind = _KINDS[code]
    before = np.concatenate([[_BLANK], kind[:-1]])
    starts = (kind != _BLANK) & ((kind != before) | (kind == _DIGIT) | (kind == _ALONE))
    at = np.flatnonzero((code == _APOSTROPHE) & (before != _OTHER))
    for width, found in ((2, np.isin(code[at + 1], _ONE)), (3, np.isin(code[at + 1] << 16 | code[at + 2], _TWO))):
        mine = at[found]
        starts[mine + 1] = False
        after = mine + width
        after = after[after < len(kind)]
        starts[after] = kind[after] != _BLANK
    full = kind != _BLANK
    code, starts = code[full], starts[full]
    sizes = np.where(code < 128, 1, 2)
    offsets = np.append((np.cumsum(sizes) - sizes)[starts], sizes.sum())
    raw = code.tobytes().decode("utf-32-le").encode()
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


class Generations(dict):
    """A bounded cache: what was not asked for while as many others came in as a generation holds is forgotten."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most
        self.old: dict[str, bytes] = {}

    def lacking(self, keys: set[str]) -> set[str]:
        """Those of the keys that are not known; the others are in the younger generation from now on."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        missing = keys.difference(self)
        known = missing.intersection(self.old)
        self.update((k, self.old[k]) for k in known)
        return missing - known


class TextIds:
    """Ids of texts. What is new in a batch of texts is tokenized in one call."""

    def __init__(self, path: str, cached: int = CACHED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.parts, self.foreign = Generations(cached), Generations(cached)
        self.words = self._of_words()

    def _of_words(self) -> tuple[Tokenizer, np.ndarray] | None:
        """The vocabulary without its own cutting, for parts between blanks, and which ids end a word; None where words have no end mark."""
        spec = json.loads(self.tokenizer.to_str())
        steps, mark = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [], spec["model"].get("end_of_word_suffix")
        if [x["type"] for x in steps] != ["Split", "ByteLevel"] or not mark:
            return None
        words = Tokenizer(self.tokenizer.model)
        words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        ends[[i for token, i in words.get_vocab().items() if token.endswith(mark)]] = True
        return words, ends

    def encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        """As `encode`, for texts in lower case that the vocabulary takes as one word each: they go as one text, cut behind each last id of a word."""
        if self.words and parts:
            words, ends = self.words
            ids = np.array(words.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, "<u4")
            at = 4 * (np.flatnonzero(ends[ids]) + 1)
            if len(at) == len(parts):
                raw = ids.tobytes()
                return [raw[a:b] for a, b in zip([0, *at.tolist()], at.tolist(), strict=False)]
        return self.encode(parts)

    def known(self, cache: Generations, wanted: list[str], encode: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        new = list(cache.lacking(set(wanted)))
        cache.update(zip(new, encode(new), strict=True))
        ids = [cache[w] for w in wanted]
        for w in new:
            if len(w) > CACHED_CHARS:
                del cache[w]
        return ids

    def of(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each text's followed by `end`, and where each text's begin and the last one's end."""
        foreign: list[str] = []
        near = []
        for text in texts:
            if "<|" in text or not _IS_NEAR(text):
                text = _FAR_SPACE.sub(" ", text)
                foreign += _FOREIGN.findall(text)
                text = _FOREIGN.sub(_MARK, text)
            near.append(text)
        coded = cut_parts((_END.join(near) + _END).lower()).dictionary_encode()
        code, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        special = {_MARK: b"", _END: np.array([end], "<u4").tobytes()}
        ids = dict(zip(plain := [p for p in distinct if p not in special], self.known(self.parts, plain, self.encode_parts), strict=True)) | special
        ids = [ids[p] for p in distinct]
        stops = code == distinct.index(_END)
        if foreign:
            place, chunks = pd.factorize(np.array(foreign, object))
            code = code.astype("i8")
            code[code == distinct.index(_MARK)] = len(ids) + place
            ids += self.known(self.foreign, chunks.tolist(), self.encode)
        size = np.array([len(x) for x in ids], "i8") // 4
        first = np.cumsum(size) - size
        here = np.cumsum(size[code])
        source = np.repeat(first[code] - (here - size[code]), size[code]) + np.arange(here[-1])
        return np.frombuffer(b"".join(ids), "<u4")[source], np.concatenate([[0], here[stops]])


_CACHES: dict[str, TextIds] = {}


def text_ids(path: str) -> TextIds:
    """One per worker process and vocabulary."""
    if path not in _CACHES:
        _CACHES[path] = TextIds(path)
    return _CACHES[path]


def bounded(batches: Iterable[tuple[pa.RecordBatch, list[str]]], chars: int = BATCH_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The same rows in batches of about that many characters, or one text if that is longer."""
    for batch, texts in batches:
        first, held = 0, 0
        for n, text in enumerate(texts):
            if held and held + len(text) > chars:
                yield batch.slice(first, n - first), texts[first:n]
                first, held = n, 0
            held += len(text)
        if texts:
            yield batch.slice(first), texts[first:]


def tokenize(docs: DataFrame, vocabulary: str, length: int = LENGTH, end: int = END, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian 32-bit numbers as binary).

    Each document's ids end with `end`; only what is longer than `length` is cut. A null or empty text is the end id
    alone. Null ids and repeated rows give rows like any other; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([
        T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("packing", _CACHES.clear)
        cache = text_ids(vocabulary)
        for batch, texts in bounded(texts_of(batches)):
            ids, at = cache.of(texts, end)
            pieces = -(-np.diff(at) // length)
            row = np.repeat(np.arange(len(texts)), pieces)
            number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = at[row] + number * length
            ends = np.append(begin, at[-1])
            raw = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(4 * ends), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(number.astype("i4")), pa.array(number * length), pa.array(np.diff(ends)), raw.cast(pa.binary())],
                names=["doc_id", "piece", "start", "length", "ids"],
            )

    return source.mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, longest items first.

    Moving a bin from gap g to g - s changes the sum of squares by 2 (N[g - s] - N[g] + 1); full bins (gap 0) and unused
    ones (gap = capacity) are not counted. Among equal changes the smallest gap is taken.
    """
    bins, offsets = np.zeros(len(lengths), "i8"), np.zeros(len(lengths), "i8")
    count = np.zeros(capacity + 1, "i8")  # open bins by gap
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    far = np.iinfo("i8").max // 4
    for item in np.argsort(-lengths, kind="stable"):
        size = int(lengths[item])
        have = count[size : capacity + 1]  # gaps size .. capacity
        change = 2 * (count[: capacity + 1 - size] - have + 1)
        change[0] -= 1  # a bin that becomes full leaves the sum
        change[have == 0] = far
        change[-1] = 2 * count[capacity - size] + 1 if size < capacity else 0  # a new bin
        gap = size + int(change.argmin())
        if gap == capacity:
            bin_no, used = used, used + 1
        else:
            bin_no = open_bins[gap].pop()
            count[gap] -= 1
        bins[item], offsets[item] = bin_no, capacity - gap
        if gap > size:
            open_bins[gap - size].append(bin_no)
            count[gap - size] += 1
    return bins, offsets


def pack(pieces: DataFrame, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """The pieces with sequence_id and offset added; `pieces` has a column `length` of 1 to `length`.

    All columns are carried along, so leave out wide ones. Full pieces are sequences by themselves. Repeated rows
    are packed each for itself; an empty table gives an empty result.
    """
    columns = pieces.columns
    held = materialize(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    short = F.col("length") < length
    blocks = max(1, -(-held.filter(short).count() // block))
    dealt = held.filter(short).withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks)))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_row", kind="stable")  # the same result when a task is run again
        bins, offsets = sum_of_squares(group["length"].to_numpy(), length)
        # odd numbers here, even ones for full pieces
        group["sequence_id"] = 2 * (group["_block"].iloc[0] + bins * blocks) + 1
        group["offset"] = offsets
        return group[[*columns, "sequence_id", "offset"]]

    placed = dealt.groupBy("_block").applyInPandas(place, schema)
    full = held.filter(~short).select(*columns, (2 * F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)
