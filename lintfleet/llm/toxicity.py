"""Toxic passages: maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

Learning. Word counts in labelled toxic and clean documents give log-odds with a Dirichlet prior (the overall word
rates). A word's opening characters count as features too, since a stem takes many endings; a word is scored by
its most certain feature. Words without evidence get a small negative score, so a passage has to earn its length.

Scoring. One scan finds all maximal segments of positive total score. By extreme-value theory the number of chance
segments with a score of at least S in n words is about K n exp(-lambda S); lambda solves sum p(s) exp(lambda s) = 1 on
clean documents. A document's evidence is the sum over its segments of how much less likely than chance they are, and
two numbers fitted on the labelled sample turn it into a probability.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintfleet.llm.common import ITEM_WORDS, held_out, texts_of, utf8
from lintfleet.session import materialize

SAMPLE = 4000  # labelled documents of each class: the documented bound of what is learned from
STEMS = (4, 5, 6, 7, 8)  # characters of a word's beginning that are features
PRIOR = 1.0  # documents that the prior counts as, for each class
CERTAIN = 4.0  # standard errors, as the root of the likelihood ratio counts them, that a feature needs
LEAST_ODDS = 3.0  # log-odds that it needs
MAX_FEATURES = 100_000
DRIFT = -0.3
MEMORY = 300_000  # words whose score a worker remembers


def words_of(text: str) -> list[bytes]:
    return utf8(text.lower()).translate(ITEM_WORDS).split()


def features(word: bytes) -> list[bytes]:
    """The word, and its stems marked by a blank at the end (no word has one)."""
    chars = word.decode("utf-8", "replace")
    return [word] + [chars[:n].encode() + b" " for n in STEMS if n < len(chars)]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) by the linear-time scan over positive scores.

    Each candidate keeps the running total before it (left) and behind it (right). A new one looks back for the nearest
    candidate with a smaller left; if that one's right is smaller too, the two stay apart, else they grow together.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list] = []  # first, end, left, right
    back: list[int] = []  # for each candidate, the nearest earlier one with a smaller left (-1: none)
    for at in np.flatnonzero(scores > 0).tolist():
        new = [at, at + 1, total[at], total[at + 1]]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = back[j]
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                back.append(j)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:], back[j:]
    return [(a, b, right - left) for a, b, left, right in found]


@dataclass
class Model:
    odds: dict[bytes, float]
    rate: float = 1.0  # lambda
    chance: float = 0.1  # K
    weights: tuple[float, float] = (-4.0, 1.0)
    memory: dict[bytes, float] = field(default_factory=dict)

    def word(self, word: bytes) -> float:
        score = self.memory.get(word)
        if score is None:
            score = max((self.odds[f] for f in features(word) if f in self.odds), default=DRIFT)
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            self.memory[word] = score
        return score

    def beyond(self, score: float, words: int) -> float:
        """-log of the number of segments this good that chance gives in so many words; 0 where chance explains it."""
        return max(0.0, self.rate * score - math.log(self.chance * max(1, words)))

    def total(self, scores: list[float], words: int) -> float:
        return math.log1p(sum(self.beyond(s, words) for s in scores))

    def evidence(self, words: list[bytes]) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's evidence, and the segments that chance doesn't explain."""
        found = segments(np.fromiter(map(self.word, words), "f8", len(words)))
        return self.total([s for _, _, s in found], len(words)), [
            (a, b, self.beyond(s, len(words))) for a, b, s in found if self.beyond(s, len(words)) > 0
        ]

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.weights[0] + self.weights[1] * evidence))))


def sample_of(docs: DataFrame, labels: DataFrame, size: int, modulus: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """doc_id, text, toxic, weight: at most `size` documents of each label, those with the smallest id hash.

    weight: how many labelled documents of the training fold each stands for.
    """
    said = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("toxic")).dropna()
    said = said.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"), modulus))
    said = said.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # a document with two labels counts as toxic
    picked = said.filter("toxic = 1").orderBy(F.xxhash64("doc_id")).limit(size)
    picked = picked.unionByName(said.filter("toxic = 0").orderBy(F.xxhash64("doc_id")).limit(size))
    weights = said.groupBy("toxic").agg(F.greatest(F.count("*") / size, F.lit(1.0)).alias("weight"))
    picked = picked.join(F.broadcast(weights), "toxic")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    return rows.join(F.broadcast(picked), "doc_id")


def count_features(sample: DataFrame) -> DataFrame:
    """feature, toxic, n: how many documents have each feature, summed up in each task first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[bytes]] = {}
        counts = (Counter(), Counter())

        def out() -> Iterator[pa.RecordBatch]:
            for toxic, c in enumerate(counts):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), pa.binary()), pa.array([toxic] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())],
                    names=["feature", "toxic", "n"],
                )
                c.clear()

        for part, texts in texts_of(batches):
            for text, toxic in zip(texts, part.column(part.schema.get_field_index("toxic")).to_pylist(), strict=True):
                seen: set[bytes] = set()
                for word in set(words_of(text)):
                    seen.update(known.get(word) or known.setdefault(word, features(word)))
                counts[toxic].update(seen)
            if len(known) > MEMORY or max(map(len, counts)) > MEMORY:
                known.clear()
                yield from out()
        yield from out()

    return sample.select("text", "toxic").mapInArrow(run, "feature binary, toxic int, n long")


def certainty(t: Column, c: Column, nt: float, nc: float) -> Column:
    """Root of the likelihood ratio statistic that t of nt toxic and c of nc clean documents have different rates; sound at 0."""

    def term(seen: Column, of: float, both: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / (both * F.lit(of / (nt + nc))))).otherwise(0.0)

    have, lack = t + c, F.lit(nt + nc) - t - c
    ratio = term(t, nt, have) + term(c, nc, have) + term(F.lit(nt) - t, nt, lack) + term(F.lit(nc) - c, nc, lack)
    return F.sqrt(F.greatest(2 * ratio, F.lit(0.0)))


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, modulus: int = 4, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> Model:
    """Learns from at most `size` labelled documents of each class outside the held-out fold.

    Without documents of both classes the model knows no feature and gives every text the same low probability.
    """
    sample = materialize(sample_of(docs, labels, size, modulus, id_col, text_col, label_col), "labelled")
    documents = {r["toxic"]: r for r in sample.groupBy("toxic").agg(F.count("*").alias("n"), F.first("weight").alias("weight")).collect()}
    nt, nc = (float(documents[k]["n"]) if k in documents else 0.0 for k in (1, 0))
    if not nt or not nc:
        return Model({})
    toxic = F.col("toxic") == 1
    counts = count_features(sample).groupBy("feature").agg(
        F.sum(F.when(toxic, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(toxic, 0).otherwise(F.col("n"))).alias("c"))
    wt, wc = documents[1]["weight"], documents[0]["weight"]
    rate = (F.col("t") * wt + F.col("c") * wc) / (nt * wt + nc * wc)  # the Dirichlet prior: this feature's overall rate, worth PRIOR documents
    yt, yc = F.col("t") + rate * PRIOR + 0.3, F.col("c") + rate * PRIOR + 0.3
    odds = F.log(yt / (nt + PRIOR + 1 - yt)) - F.log(yc / (nc + PRIOR + 1 - yc))
    kept = counts.select("feature", odds.alias("odds"), certainty(F.col("t"), F.col("c"), nt, nc).alias("z"))
    rows = kept.filter((F.col("z") > CERTAIN) & (F.col("odds") > LEAST_ODDS) & (F.length("feature") <= 64))
    rows = rows.orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).collect()
    return calibrate(Model({bytes(r["feature"]): min(6.0, r["odds"]) for r in rows}), sample)


def calibrate(model: Model, sample: DataFrame) -> Model:
    """lambda and K from clean documents, then the two weights by Newton steps on the sample's evidence."""
    held = sample.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in texts_of(batches):
            toxic = part.column(part.schema.get_field_index("toxic")).to_pylist()
            words = [words_of(t) for t in texts]
            line = [np.fromiter(map(held.value.word, w), "f8", len(w)) for w in words]
            weight = part.column(part.schema.get_field_index("weight"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(toxic, pa.int32()), weight, pa.array([len(w) for w in words], pa.int64()),
                 pa.array([s[s > 0].tolist() for s in line], pa.list_(pa.float64())),
                 pa.array([[x for _, _, x in segments(s)] for s in line], pa.list_(pa.float64()))],
                names=["toxic", "weight", "words", "marks", "segments"],
            )

    shape = "toxic int, weight double, words long, marks array<double>, segments array<double>"
    rows = sample.select("text", "toxic", "weight").mapInArrow(scores, shape).collect()
    clean = [r for r in rows if not r["toxic"]]
    n_words = sum(r["words"] for r in clean) + 1
    marks = np.array([m for r in clean for m in r["marks"]] + [3.0])  # one mark more than seen: lambda stays finite
    low, high = 1e-3, 5.0
    for _ in range(60):
        rate = (low + high) / 2
        mean = (np.exp(rate * marks).sum() + (n_words - len(marks)) * math.exp(rate * DRIFT)) / n_words
        low, high = (rate, high) if mean < 1 else (low, rate)
    model.rate = low
    reached = sum(x >= LEAST_ODDS for r in clean for x in r["segments"]) + 0.5
    model.chance = min(1.0, reached / n_words * math.exp(model.rate * LEAST_ODDS))
    x = np.array([model.total(r["segments"], r["words"]) for r in rows])
    y, stands_for = np.array([r["toxic"] for r in rows], "f8"), np.array([r["weight"] for r in rows])
    w, design = np.array([-2.0, 0.5]), np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = design.T @ (design * (stands_for * p * (1 - p))[:, None]) + 0.05 * np.eye(2)
        w = w + np.clip(np.linalg.solve(hessian, design.T @ (stands_for * (y - p)) - 0.05 * w), -2, 2)
    model.weights = (float(w[0]), float(w[1]))
    model.memory = {}
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score, passages (first word, end, evidence of each significant segment).

    Null and empty texts have no words and get the probability of no evidence. Repeated rows give repeated results;
    other columns, labels among them, are not read. Each text is scanned whole, in time linear in its words.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in texts_of(batches):
            results = [held.value.evidence(words_of(t)) for t in texts]
            passages = [[{"first": a, "end": b, "evidence": e} for a, b, e in found] for _, found in results]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([held.value.probability(e) for e, _ in results], pa.float64()), pa.array(passages, kind)],
                names=["doc_id", "score", "passages"],
            )

    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {id_type}, score double, passages array<struct<first:bigint,end:bigint,evidence:double>>")
