"""Class-based bigram language model: exchange clustering gives word classes, class transitions and word emissions the score.

Passes over the documents, each summed up in its tasks first:
1. words, 2. neighbouring pairs of the most frequent words, 3. the other words' neighbour classes,
4. every document as a line of classes, from which transitions are counted and scores are made.

The most frequent words are clustered by exchange: each in turn moves to the class that raises the likelihood of the
class bigrams most, until nothing moves. Every other word of the training documents goes where its neighbours' classes fit
best. How many words are exchanged and how many classes there are follows the vocabulary. A class's share for unseen words
is paid by a discount on each of its words; unseen words are one symbol. The end of a document is a class of its own and
also what stands before the first word.

Class and count of frequent words are broadcast, those of all others are joined: documents are taken in blocks, and a block
puts out a row for each distinct one. Both ways give the same scores.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import compress, count, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintfleet.llm.common import SPACE_WORDS, held_out, texts_of, utf8
from lintfleet.session import materialize

KNOWN = 30_000  # words of at most KNOWN_BYTES that every task knows by class and count; the others are joined
KNOWN_BYTES = 64
CLUSTERED = 600  # words that are exchanged one by one, at least; beyond that the root of the vocabulary
CLASSES = 16  # at least; beyond that the fourth root of the vocabulary
EXCHANGES = 12  # rounds at most
STARTS = 8
DISCOUNT = 0.5
FLUSH = 600_000  # distinct words a task counts before it puts them out
TOKENS = 2_000_000  # tokens whose neighbours a task gathers before it sums them up
BLOCK_WORDS = 200_000  # distinct joined words of a block of documents, about; it has about TOKENS tokens at most
GATHERED = 8_000  # rows of words that get their classes at once
STEPS = 2.0**16  # logarithms are whole numbers of such steps where words are assigned, so sums don't depend on their order
TAIL = 65_535  # in a line: a word that is joined
END = b" "  # no word holds a blank


def words_of(text: str) -> list[bytes]:
    return utf8(text).translate(SPACE_WORDS).split()


def _x_log_x(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def sizes(words: int) -> tuple[int, int]:
    """How many words are exchanged and how many classes there are for so many distinct words."""
    return max(CLUSTERED, math.isqrt(words)), max(CLASSES, round(words**0.25))


def exchange(pairs: np.ndarray, words: int, classes: int = CLASSES, rounds: int = EXCHANGES) -> np.ndarray:
    """Class of each of the first `words` symbols of a bigram count matrix; each further symbol is a class of its own."""
    a, b = np.nonzero(pairs)
    return exchange_cells(a, b, pairs[a, b], len(pairs), words, classes, rounds)


def exchange_cells(a: np.ndarray, b: np.ndarray, n: np.ndarray, symbols: int, words: int, classes: int, rounds: int = EXCHANGES) -> np.ndarray:
    """The same for the cells (a, b, n) of the matrix that are not 0.

    Maximizes the sum of N(c, c') log N(c, c') over class pairs, less that of 2 N(c) log N(c) over classes. Exchange stops at
    a local best, so the best of several starts counts: words dealt out in turn by frequency, and fixed random ones.
    """
    rng = np.random.default_rng(17)
    starts = [np.arange(words) % classes, *[rng.integers(0, classes, words) for _ in range(STARTS - 1)]]
    by_first, by_second = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    after = np.split(np.stack([b, n])[:, by_first], np.searchsorted(a[by_first], np.arange(1, symbols)), axis=1)
    before = np.split(np.stack([a, n])[:, by_second], np.searchsorted(b[by_second], np.arange(1, symbols)), axis=1)
    itself = np.bincount(a[a == b].astype("i8"), weights=n[a == b], minlength=symbols)
    followers = [(x[0].astype("i8"), x[1].astype("f8")) for x in after[:words]]
    leaders = [(x[0].astype("i8"), x[1].astype("f8")) for x in before[:words]]
    found = [_exchange((a, b, n), followers, leaders, itself, symbols, words, classes, rounds, start) for start in starts]
    return max(found, key=lambda x: x[0])[1]


def _exchange(cells: tuple, followers: list, leaders: list, loops: np.ndarray, symbols: int, words: int, classes: int, rounds: int,
              start: np.ndarray) -> tuple[float, np.ndarray]:
    cls = np.concatenate([start, classes + np.arange(symbols - words)])
    n = classes + symbols - words
    total = np.bincount(cls[cells[0]] * n + cls[cells[1]], weights=cells[2], minlength=n * n).reshape(n, n)
    for _ in range(rounds):
        moved = 0
        for w in range(words):
            after = np.bincount(cls[followers[w][0]], weights=followers[w][1], minlength=n)  # what follows w, by class
            before = np.bincount(cls[leaders[w][0]], weights=leaders[w][1], minlength=n)
            itself = loops[w]
            old = cls[w]
            after[old] -= itself
            before[old] -= itself
            total[old, :] -= after
            total[:, old] -= before
            total[old, old] -= itself
            # gain of joining each class k: its row grows by `after`, its column by `before`
            row, col = total[:classes], total[:, :classes].T
            gain = (_x_log_x(row + after) - _x_log_x(row)).sum(1) + (_x_log_x(col + before) - _x_log_x(col)).sum(1)
            k = np.arange(classes)
            diagonal = total[k, k]
            both = _x_log_x(diagonal + after[k] + before[k] + itself) - _x_log_x(diagonal)
            gain += both - (_x_log_x(diagonal + after[k]) - _x_log_x(diagonal)) - (_x_log_x(diagonal + before[k]) - _x_log_x(diagonal))
            out, into = row.sum(1), col.sum(1)
            gain -= _x_log_x(out + after.sum() + itself) - _x_log_x(out) + _x_log_x(into + before.sum() + itself) - _x_log_x(into)
            new = int(gain.argmax()) if gain.max() > gain[old] + 1e-9 else old
            moved += new != old
            cls[w] = new
            total[new, :] += after
            total[:, new] += before
            total[new, new] += itself
        if not moved:
            break
    likelihood = _x_log_x(total).sum() - _x_log_x(total.sum(0)).sum() - _x_log_x(total.sum(1)).sum()
    return float(likelihood), cls[:words]


@dataclass
class Model:
    """Classes 0 .. classes - 1 hold the words of the training documents, then come the unseen word and the end."""

    known: dict[bytes, int]  # word -> place
    cls: np.ndarray  # class of each known word
    count: np.ndarray  # count of each known word
    train_tokens: int
    distinct: int
    end_count: int
    class_tokens: np.ndarray
    class_words: np.ndarray
    classes: int = CLASSES
    log_transition: np.ndarray | None = None  # log10 P(symbol | symbol before)

    @property
    def unseen(self) -> int:
        return self.classes

    @property
    def end(self) -> int:
        return self.classes + 1

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10(count + 1) - math.log10(self.train_tokens + self.distinct + 1)

    def emission(self, count: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 P(word | its class) of words seen so often."""
        return np.log10(count - DISCOUNT) - np.log10(np.maximum(self.class_tokens - DISCOUNT * self.class_words, DISCOUNT))[cls]


def _arrays(names: list[str], *columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=names)


def _symbols(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """The end, then each text's words and the end, in one list; and where the ends are."""
    out, ends = [END], [0]
    for text in texts:
        out += words_of(text)
        ends.append(len(out))
        out.append(END)
    return out, np.array(ends)


def _lookup(known: dict[bytes, int]) -> dict[bytes, int]:
    return {**known, END: len(known) + 1}


def _places(symbols: list[bytes], lookup: dict[bytes, int]) -> np.ndarray:
    """Places of symbols by `_lookup`: words that are none of the known ones have their number, the end has one more."""
    return np.fromiter(map(lookup.get, symbols, repeat(len(lookup) - 1)), "i8", len(symbols))


def _numbers() -> defaultdict:
    """Numbers things from 0 as they are looked up first."""
    return defaultdict(count().__next__)


def _whole_groups(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Rows ordered by their first column in batches of about `rows` or more, each value of that column in one batch."""
    held: list[pa.RecordBatch] = []
    waiting = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and waiting >= rows:
            keys = batch.column(0)
            start = pc.index(keys, keys[-1]).as_py()  # where the last group begins, or goes on
            if start or keys[0] != held[-1].column(0)[-1]:
                yield pa.concat_batches([*held, batch.slice(0, start)])
                held, waiting, batch = [], 0, batch.slice(start)
        held.append(batch)
        waiting += batch.num_rows
    if held:
        yield pa.concat_batches(held)


def _starts(keys: pa.Array) -> np.ndarray:
    """True where a row's key is not that of the row before."""
    return np.concatenate([[True], pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)])


def count_words(docs: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return _arrays(["word", "n"], pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64()))

        for _, texts in texts_of(batches, 200):
            for text in texts:
                counts.update(words_of(text))
            counts[END] += len(texts)
            if len(counts) > FLUSH:
                yield out()
                counts.clear()
        if counts:
            yield out()

    return docs.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _pairs(docs: DataFrame, first: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells (symbol, next symbol, n) over all documents, where all words but the first ones are one symbol."""
    held, symbols = docs.sparkSession.sparkContext.broadcast(_lookup(first)), len(first) + 2

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            at, n = np.unique(np.concatenate(cells), return_counts=True)
            cells.clear()
            return _arrays(["cell", "n"], pa.array(at, pa.int64()), pa.array(n, pa.int64()))

        waiting = 0
        for _, texts in texts_of(batches, 200):
            line = _places(_symbols(texts)[0], held.value)
            cells.append(line[:-1] * symbols + line[1:])
            waiting += len(line)
            if waiting > TOKENS:
                yield out()
                waiting = 0
        if cells:
            yield out()

    sums = docs.select("text").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cell, n = sums.column("cell").to_numpy(), sums.column("n").to_numpy()
    order = np.argsort(cell)
    return cell[order] // symbols, cell[order] % symbols, n[order].astype("f8")


def _assign(docs: DataFrame, first: dict[bytes, int], class_of: np.ndarray, fit: np.ndarray, share: np.ndarray) -> DataFrame:
    """word, n, class of every word but the first ones: the class that its neighbours' classes fit best.

    fit: by class before, then by class behind, and by the word's class. Counts of a word's neighbour classes are packed as
    pairs of 32-bit numbers, so a word takes one row of each task. Nearly all of these words differ, so they are not summed up
    before the shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast((_lookup(first), class_of, fit, share))
    width = len(fit)

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, class_of = held.value[:2]
        other = len(lookup) - 1
        ids = _numbers()
        cells: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            nonlocal ids
            at, n = np.unique(np.concatenate(cells), return_counts=True)
            ends = np.searchsorted(at, np.arange(len(ids) + 1) * width)
            packed = np.stack([at % width, n], 1).astype("<i4").tobytes()
            seen = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((ends * 8).astype("i4").tobytes()), pa.py_buffer(packed)])
            batch = _arrays(["word", "seen"], pa.array(list(ids), pa.binary()), seen)
            ids = _numbers()
            cells.clear()
            return batch

        waiting = 0
        for _, texts in texts_of(batches, 200):
            symbols, _ = _symbols(texts)
            line = _places(symbols, lookup)
            mask = line == other
            at = np.flatnonzero(mask)
            word = np.fromiter(map(ids.__getitem__, compress(symbols, mask.tobytes())), "i8", len(at)) * width
            c = class_of[line]
            cells += [word + c[at - 1], word + width // 2 + c[at + 1]]
            waiting += len(at)
            if waiting > TOKENS or len(ids) > FLUSH:
                yield out()
                waiting = 0
        if ids:
            yield out()

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, fit, share = held.value
        for batch in _whole_groups(batches, GATHERED):
            starts, parts = _starts(batch.column(0)), batch.column(1)
            at = np.flatnonzero(starts)
            word = np.repeat(np.cumsum(starts) - 1, pc.binary_length(parts).to_numpy() // 8)
            pairs = np.frombuffer(b"".join(parts.to_pylist()), "<i4").reshape(-1, 2)
            seen = np.bincount(word * width + pairs[:, 0], weights=pairs[:, 1], minlength=len(at) * width).reshape(-1, width)
            best = (seen @ fit + share).argmax(1)
            n = seen[:, : width // 2].sum(1)
            yield _arrays(["word", "n", "class"], batch.column(0).take(pa.array(at)), pa.array(n.astype("i8")), pa.array(best, pa.int32()))

    gathered = docs.select("text").mapInArrow(gather, "word binary, seen binary").repartition("word").sortWithinPartitions("word")
    return gathered.mapInArrow(choose, "word binary, n bigint, class int")


def learn_classes(docs: DataFrame) -> tuple[Model | None, DataFrame]:
    """The model without transitions, and word, n, class of all words that it doesn't know. None if there is no document."""
    counts = materialize(count_words(docs), "word-counts")
    whole = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    if not whole["n"]:
        return None, counts
    clustered, classes = sizes(whole["v"] - 1)
    by_count = [F.desc("n"), F.col("word")]
    candidates = counts.filter((F.col("word") != F.lit(END)) & (F.length("word") <= KNOWN_BYTES))
    top = [(bytes(r["word"]), r["n"]) for r in candidates.orderBy(*by_count).limit(clustered).collect()]
    end_count = counts.filter(F.col("word") == F.lit(END)).first()["n"]

    first = {w: i for i, (w, _) in enumerate(top)}
    symbols, n = len(top) + 2, classes + 2  # all other words, the end
    a, b, times = _pairs(docs, first)
    cls = exchange_cells(a, b, times, symbols, len(top), classes)
    class_of = np.concatenate([cls, [classes, classes + 1]]).astype("i8")
    total = np.bincount(class_of[a] * n + class_of[b], weights=times, minlength=n * n).reshape(n, n) + 0.5
    log_p = np.log(total / total.sum(1, keepdims=True))
    mass = np.array([m for _, m in top], "f8")
    share = np.log(np.bincount(cls, weights=mass, minlength=classes) + 1.0)
    fit = np.concatenate([log_p[:, :classes], log_p[:classes].T])  # log P(class | class before), log P(class after | class)
    words = materialize(_assign(docs, first, class_of, np.rint(fit * STEPS), np.rint(1e-3 * share * STEPS)), "word-classes")

    more = words.filter(F.length("word") <= KNOWN_BYTES).orderBy(*by_count).limit(max(0, KNOWN - len(top))).collect()
    known = {**first, **{bytes(r["word"]): len(first) + i for i, r in enumerate(more)}}
    rest = words
    if more:
        last = (F.col("n") < F.lit(more[-1]["n"])) | ((F.col("n") == F.lit(more[-1]["n"])) & (F.col("word") > F.lit(more[-1]["word"])))
        rest = words.filter(last | (F.length("word") > KNOWN_BYTES))
    tokens, distinct = np.bincount(cls, weights=mass, minlength=classes), np.bincount(cls, minlength=classes)
    for r in words.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        tokens[r["class"]] += r["n"]
        distinct[r["class"]] += r["v"]
    model = Model(known, np.concatenate([cls, [r["class"] for r in more]]).astype("i8"), np.array([m for _, m in top] + [r["n"] for r in more], "i8"),
                  whole["n"], whole["v"], end_count, tokens, distinct, classes)
    return model, rest


def class_lines(source: DataFrame, model: Model, rest: DataFrame) -> DataFrame:
    """doc_id, tokens, known, base, emission, line: each row of `source` (_row, doc_id, text) with its sums over words, and
    its symbols' classes as 16-bit numbers, the end first and last.

    A block of documents puts out each word to be joined once, and has the number of its first row. A document's own row has a
    key that no word has, so these rows are spread like those of the joined words.
    """
    held = source.sparkSession.sparkContext.broadcast(model)
    id_type = source.schema["doc_id"].dataType.simpleString()
    names = ["_block", "doc_id", "word", "at", "base", "emission", "line", "rare"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = held.value
        lookup, other = _lookup(m.known), len(m.known)
        class_of = np.concatenate([m.cls, [TAIL, m.end]]).astype("<u2")
        base = np.concatenate([m.base(m.count), [0.0], m.base(np.array([m.end_count]))])
        emission = np.concatenate([m.emission(m.count, m.cls), [0.0, 0.0]])
        ids, doc_ids, docs, waiting = _numbers(), [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            block, n = docs[0][0], len(ids)
            columns = list(zip(*docs, strict=True))
            keys = [END + row.to_bytes(8, "little", signed=True) for row in columns[0]]
            yield _arrays(names, pa.array([block] * len(docs), pa.int64()), pa.concat_arrays(doc_ids), pa.array(keys, pa.binary()), pa.array([-1] * len(docs), pa.int32()),
                          *[pa.array(x, pa.float64()) for x in columns[1:3]], *[pa.array(x, pa.binary()) for x in columns[3:]])
            if n:
                yield _arrays(names, pa.array(np.full(n, block)), pa.nulls(n, doc_ids[0].type), pa.array(list(ids), pa.binary()), pa.array(np.arange(n, dtype="i4")),
                              *[pa.nulls(n, pa.float64())] * 2, *[pa.nulls(n, pa.binary())] * 2)

        for batch, texts in texts_of(batches, 200):
            symbols, ends = _symbols(texts)
            line = _places(symbols, lookup)
            mask = line == other
            places = np.fromiter(map(ids.__getitem__, compress(symbols, mask.tobytes())), "<i4", np.count_nonzero(mask))
            before = np.concatenate([[0], np.cumsum(mask)])  # joined words up to each symbol
            cls, bases, emissions = class_of[line], base[line], emission[line]
            for row, start, end in zip(batch.column(1).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                here = slice(start + 1, end + 1)
                docs.append((row, bases[here].sum(), emissions[here].sum(), cls[start : end + 1].tobytes(), places[before[start] : before[end]].tobytes()))
            doc_ids.append(batch.column(0))
            waiting += len(line)
            if waiting > TOKENS or len(ids) > BLOCK_WORDS:
                yield from out()
                ids, doc_ids, docs, waiting = _numbers(), [], [], 0
        if docs:
            yield from out()

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = held.value
        for batch in _whole_groups(batches, 1):
            starts = np.flatnonzero(_starts(batch.column(0)))
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
                part = batch.slice(start, end - start)
                at, n, cls = (pc.fill_null(part.column(k), x).to_numpy(zero_copy_only=False) for k, x in ((1, 0), (2, 0), (3, m.unseen)))
                joined = np.flatnonzero(at >= 0)
                times, classes = np.zeros(len(joined), "i8"), np.zeros(len(joined), "<u2")
                times[at[joined]], classes[at[joined]] = n[joined], cls[joined]
                seen, word_base, word_emission = times > 0, m.base(times), np.zeros(len(joined))
                word_emission[seen] = m.emission(times[seen], classes[seen])
                docs = part.take(pa.array(np.flatnonzero(at < 0)))
                base, emission = docs.column(5).to_numpy().copy(), docs.column(6).to_numpy().copy()
                lines, tokens, known = [], [], []
                for i, (line, rare) in enumerate(zip(docs.column(7).to_pylist(), docs.column(8).to_pylist(), strict=True)):
                    line, rare = np.frombuffer(line, "<u2").copy(), np.frombuffer(rare, "<i4")
                    line[line == TAIL] = classes[rare]
                    met = rare[seen[rare]]
                    base[i] += word_base[rare].sum()
                    emission[i] += word_emission[met].sum()
                    lines.append(line.tobytes())
                    tokens.append(len(line) - 1)
                    known.append(len(line) - 1 - len(rare) + len(met))
                yield _arrays(["doc_id", "tokens", "known", "base", "emission", "line"], docs.column(4), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()),
                              pa.array(base), pa.array(emission), pa.array(lines, pa.binary()))

    shape = f"_block bigint, doc_id {id_type}, word binary, at int, base double, emission double, line binary, rare binary"
    joined = source.select("doc_id", "_row", "text").mapInArrow(run, shape).join(rest, "word", "left")
    blocks = joined.select("_block", "at", "n", "class", "doc_id", "base", "emission", "line", "rare").repartition("_block").sortWithinPartitions("_block")
    return blocks.mapInArrow(fill, f"doc_id {id_type}, tokens bigint, known bigint, base double, emission double, line binary")


def transitions(lines: DataFrame, model: Model) -> np.ndarray:
    """log10 P(symbol | symbol before), from the training documents' lines.

    Class moves are discounted towards the classes' overall shares. Of a class's probability the unseen word gets what the
    class's words were discounted; as the symbol before, it stands for each class by that class's number of words.
    """
    n = model.classes + 2

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, "i8")
        for batch in batches:
            line = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2").astype("i8")
            if len(line):
                total += np.bincount(line[:-1] * n + line[1:], minlength=n * n)
                total[-1] -= batch.num_rows - 1  # from one document's end to the next one's
        at = np.flatnonzero(total)
        yield _arrays(["cell", "n"], pa.array(at, pa.int64()), pa.array(total[at], pa.int64()))

    moves = np.zeros(n * n)
    for row in lines.select("line").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        moves[row["cell"]] = row["n"]
    moves = moves.reshape(n, n)
    holds = np.concatenate([model.class_words > 0, [True, True]])
    unigram = (moves.sum(0) + DISCOUNT) * holds
    unigram /= unigram.sum()
    sums, used = moves.sum(1, keepdims=True), (moves > 0).sum(1, keepdims=True)
    rows = np.maximum(sums, 1e-9)
    p = np.where(sums > 0, np.maximum(moves - DISCOUNT, 0) / rows + DISCOUNT * used / rows * unigram, unigram)
    if model.class_words.sum():
        p[model.unseen] = model.class_words / model.class_words.sum() @ p[: model.classes]
    share = DISCOUNT * model.class_words / np.maximum(model.class_tokens, 1)
    p[:, model.unseen] += p[:, : model.classes] @ share
    p[:, : model.classes] *= 1 - share
    with np.errstate(divide="ignore"):  # a class without words is never met
        return np.log10(p)


def train(docs: DataFrame) -> tuple[Model | None, DataFrame]:
    """The model and the words it doesn't know of `docs` (column text). None if there is no document."""
    model, rest = learn_classes(docs)
    if model is not None:
        source = docs.select(F.lit(None).cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("_row"))
        model.log_transition = transitions(class_lines(source, model, rest), model)
    return model, rest


def score_documents(docs: DataFrame, modulus: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from all rows outside the held-out fold and scores every row. A text's tokens are its words and one end; a null
    or empty text is the end alone. score is log10 P(text) of the class model, whose words and one unseen word
    add up to probability 1 at each place. Null ids and repeated rows are rows like any other. With nothing to learn from,
    all words count as unseen. Other columns are not read.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("_row"))
    model, rest = learn_classes(source.filter(~held_out(F.col("doc_id"), modulus)))
    if model is None:
        tokens = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")) + 1
        return source.select("doc_id", held_out(F.col("doc_id"), modulus).alias("held_out"), tokens.cast("long").alias("n_tokens"),
                             F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"),
                             F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    lines = materialize(class_lines(source, model, rest), "class-lines")
    flat = source.sparkSession.sparkContext.broadcast(transitions(lines.filter(~held_out(F.col("doc_id"), modulus)), model).ravel())
    n = model.classes + 2

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x, "<u2").astype("i8") for x in batch.column(5).to_pylist()]
            score = np.array([flat.value[x[:-1] * n + x[1:]].sum() for x in found], "f8") + batch.column(4).to_numpy()
            yield _arrays(["doc_id", "n_tokens", "n_known", "base_score", "score"], *batch.columns[:4], pa.array(score))

    id_type = source.schema["doc_id"].dataType.simpleString()
    scored = lines.mapInArrow(run, f"doc_id {id_type}, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), modulus).alias("held_out"), "n_tokens", "n_known",
                         F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
