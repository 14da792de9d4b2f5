"""Language of a text: a byte convolutional network, trained in numpy.

A text is cut into windows of 128 bytes. Filters of several widths run over a window's bytes, each filter keeps its
largest value, and a softmax layer gives the languages' probabilities. A document's probabilities are the mean over
its windows, weighted by their bytes. For prediction the weights of neighbouring bytes are added beforehand, so a
filter of width 6 takes three look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintfleet.llm.common import bound_batches, free_name, held_out, take_worker, texts_of, utf8

WINDOW = 128
WIDTHS = (2, 4, 6)
FILTERS = 8
SAMPLE_DOCS = 400  # per language: the documented bound of what is learned from
SAMPLE_WINDOWS = 6  # of each of these, evenly spread
EPOCHS = 8
UNKNOWN = "und"


def windows_of(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, the text each belongs to, and how many bytes it holds.

    A window shows some bytes of the next one, so that filters start at each byte of a text; behind a text come zeros.
    """
    beyond = max(WIDTHS) - 1
    lengths = np.array([len(t) for t in texts], "i8")
    counts = (lengths + beyond + size - 1) // size
    flat = b"".join([t.ljust(int(n) * size, b"\0") for t, n in zip(texts, counts, strict=True)]) + bytes(beyond)
    shown = np.lib.stride_tricks.sliding_window_view(np.frombuffer(flat, "u1"), size + beyond)[::size]
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return shown, owner, np.clip(lengths[owner] - place * size, 0, size)


@dataclass
class ByteCNN:
    """filters[k]: (width, 256, FILTERS); out: (filters in all, languages)."""

    languages: list[str]
    filters: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 7) -> ByteCNN:
        rng = np.random.default_rng(seed)
        filters = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype("f4") for w in WIDTHS]
        return cls(languages, filters, rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype("f4"),
                   np.zeros(len(languages), "f4"))

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest value of each filter in each window, and where it was."""
        values, places = [], []
        for f in self.filters:
            span = x.shape[1] - max(WIDTHS) + 1
            total = sum(f[j][x[:, j : j + span]] for j in range(len(f)))
            places.append(total.argmax(axis=1))
            values.append(np.take_along_axis(total, places[-1][:, None, :], 1)[:, 0])
        return np.concatenate(values, 1), places

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.08, seed: int = 7) -> None:
        """Adagrad on the cross entropy; each language weighs the same."""
        rng = np.random.default_rng(seed)
        weight = (1 / np.maximum(1, np.bincount(y, minlength=len(self.languages))))[y].astype("f4")
        weight *= len(y) / weight.sum()
        sums = [np.full_like(p, 1e-2) for p in (*self.filters, self.out, self.bias)]

        def step(param: np.ndarray, grad: np.ndarray, total: np.ndarray) -> None:
            total += grad * grad
            param -= rate * grad / np.sqrt(total)

        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), 64):
                pick = order[at : at + 64]
                xs, ys = x[pick], y[pick]
                h, places = self.pooled(xs)
                active = np.maximum(h, 0)
                p = softmax(active @ self.out + self.bias)
                p[np.arange(len(ys)), ys] -= 1
                p *= weight[pick, None] / len(ys)
                back = (p @ self.out.T) * (h > 0)
                step(self.out, active.T @ p, sums[-2])
                step(self.bias, p.sum(0), sums[-1])
                for k, f in enumerate(self.filters):
                    grad, part = np.zeros_like(f), back[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(len(f)):
                        byte = np.take_along_axis(xs, places[k] + j, 1)
                        np.add.at(grad[j], (byte, np.arange(FILTERS)[None, :]), part)
                    step(f, grad, sums[k])

    def pairs(self) -> list[np.ndarray]:
        """Summed weights for each pair of neighbouring bytes: all filters' first pairs, then the second pairs of those that have one, ..."""
        tables = []
        for j in range(0, max(WIDTHS), 2):
            parts = [(f[j][:, None, :] + f[j + 1][None, :, :]).reshape(65536, FILTERS) for f in self.filters if len(f) > j]
            tables.append(np.ascontiguousarray(np.concatenate(parts, 1)))
        return tables


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def predict(model: ByteCNN, tables: list[np.ndarray], texts: list[bytes], chunk: int = 48) -> np.ndarray:
    """Probabilities (texts, languages)."""
    x, owner, held = windows_of(texts)
    total = np.zeros((len(texts), len(model.languages)))
    starts = x.shape[1] - max(WIDTHS) + 1
    for at in range(0, len(x), chunk):
        part = x[at : at + chunk]
        pair = part[:, :-1].astype("i8") * 256 + part[:, 1:]
        sums = tables[0].take(pair[:, :starts], axis=0)
        for j, table in enumerate(tables[1:], 1):
            sums[:, :, -table.shape[1] :] += table.take(pair[:, 2 * j : 2 * j + starts], axis=0)
        h = np.maximum(sums.max(axis=1), 0)
        # an all-zero window behind a text's last byte weighs nothing, an empty text's only one weighs alone
        weight = held[at : at + chunk] + 1e-9
        np.add.at(total, owner[at : at + chunk], softmax(h @ model.out + model.bias) * weight[:, None])
    return total / total.sum(axis=1, keepdims=True)


def train(docs: DataFrame, sample: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          modulus: int = 4) -> ByteCNN | None:
    """Learns from `sample` documents of each language, those with the smallest id hash; held-out ids are never read.

    None when no document has a language and a text.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), modulus))
    ids = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("_h"))
    for keys in (["lang", F.pmod("_h", F.lit(64))], ["lang"]):  # in two steps, so that no task ranks a whole language
        ids = ids.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_h", "doc_id"))).filter(F.col("_n") <= sample)
    # the ids are bounded by sample x languages; the limit holds even where ids repeat
    picked = rows.join(F.broadcast(ids.select("doc_id", "lang").distinct()), ["doc_id", "lang"], "left_semi")
    found = sorted(tuple(r) for r in picked.select("lang", "doc_id", "text").dropDuplicates(["lang", "doc_id"]).toLocalIterator())
    found = [(lang, text) for lang, _, text in found if any(c.isalpha() for c in text)]
    if not found:
        return None
    languages = sorted({lang for lang, _ in found})
    xs, ys = [], []
    for lang, text in found:
        x, _, held = windows_of([utf8(text.lower())])
        keep = np.unique(np.linspace(0, max(0, np.count_nonzero(held) - 1), SAMPLE_WINDOWS).astype(int))
        xs.append(x[keep])
        ys += [languages.index(lang)] * len(keep)
    model = ByteCNN.fresh(languages)
    model.train(np.concatenate(xs), np.array(ys))
    return model


def identify(docs: DataFrame, model: ByteCNN | None, text_col: str = "text", prefix: str = "") -> DataFrame:
    """The input with `<prefix>lang_pred` and `<prefix>score` (probability of that language) added.

    Null texts and texts without a letter are `und` with score 0. Without a model all texts are. Every window of a
    text counts, however long it is. Columns of these names in the input are replaced.
    """
    out = [f"{prefix}lang_pred", f"{prefix}score"]
    docs = docs.drop(*out)
    if model is None:
        return docs.select("*", F.lit(UNKNOWN).alias(out[0]), F.lit(0.0).alias(out[1]))
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    tables: list = []

    def classify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        take_worker("language_id")
        if not tables:
            tables.append(held.value.pairs())
        names = np.array(held.value.languages, object)
        for batch in batches:
            pred, score = [], []
            record = pa.RecordBatch.from_arrays([batch], names=["text"])
            for _, texts in texts_of([record], 200):
                p = predict(held.value, tables[0], [utf8(t.lower()) for t in texts])
                pred += list(names[p.argmax(axis=1)])
                score += list(p.max(axis=1))
            yield pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    text = F.col(f"`{text_col}`")
    has_letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    udf = F.arrow_udf(classify, "lang string, score double")
    found = free_name(docs, "_language")
    both = docs.withColumn(found, udf(text))
    return both.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.when(has_letter, F.col(f"{found}.lang")).otherwise(UNKNOWN).alias(out[0]),
        F.when(has_letter, F.col(f"{found}.score")).otherwise(0.0).alias(out[1]),
    )
