"""Toxicity by non-negative positive-unlabelled learning.

The learner sees confirmed toxic texts (P) and unlabelled texts (U), never confirmed clean ones. With the class prior
p, the risk is p R_P(+) + max(0, R_U(-) - p R_P(-)): the negative part is estimated from unlabelled text less what its
toxic share contributes, and when that estimate turns negative (overfitting) the step goes back up that part instead.
The classifier is linear and trained in numpy on the driver, on at most ``max_positive`` and
``max_unlabelled`` texts, chosen by the hash of their id; all rows are scored.

Features are hashed: for each distinct word, lower-cased and stripped of punctuation, the word and its prefixes of 4
to 6 letters. A feature counts only if it is in ``min_texts`` of the sampled positives and its share there differs
from the unlabelled share by ``min_z`` standard errors, so texts of any length have few features and a long
clean text gathers no noise. Texts are counted by feature in Spark; the driver gets the few features that count and
how often each sampled text has them, never the texts' features.

Defined cases: a null or empty text has no features; its score comes from the bias, so below 1/2 for priors below
1/2. Without positives every score is 0. Repeated rows get the same score, and each counts where it is sampled; rows of
labels without a document, and null labels, are ignored; an id labelled twice is toxic if any of its labels says so; null
ids are scored and never learned from; empty tables give empty results; a very long text is one row of its distinct words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import fold, some_of, stored

#: Bounds of the samples that the classifier is fitted on.
MAX_POSITIVE, MAX_UNLABELLED = 3000, 9000
MIN_TEXTS, MIN_Z = 2, 3.5
STEPS, DECAY = 400, 3e-4
BUCKETS, THRESHOLD = 1 << 22, 0.7
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")


def tokens(text: str | None) -> set[str]:
    return set(TOKEN.findall(text.lower())) if text else set()


def features(word: str) -> set[int]:
    """Buckets of a word and of its prefixes; a prefix is marked, so it isn't taken for a word."""
    return {zlib.crc32(x.encode()) % BUCKETS for x in (word, *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) >= n))}


def bags(texts: list[str]) -> list[np.ndarray]:
    """Each text's feature buckets, one for each distinct word that has it."""
    known: dict[str, set[int]] = {}
    out = []
    for text in texts:
        got: list[int] = []
        for w in tokens(text):
            if w not in known:
                if len(known) > 120_000:
                    known.clear()
                known[w] = features(w)
            got.extend(known[w])
        out.append(np.array(got, np.int32))
    return out


@dataclass
class Rows:
    """Sparse rows: ``values`` at (``row``, ``column``) of n rows."""

    column: np.ndarray
    value: np.ndarray
    row: np.ndarray
    n: int

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.n)

    def transposed_times(self, by: np.ndarray, n_columns: int) -> np.ndarray:
        return np.bincount(self.column, self.value * by[self.row], n_columns)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk_and_slope(v: np.ndarray, pos: Rows, unl: Rows, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Of weights and bias v: the positive part p R_P(+) and the negative part R_U(-) - p R_P(-) of the risk under the logistic loss, and the gradient of each."""
    w, b = v[:-1], v[-1]
    zp, zu = pos.times(w) + b, unl.times(w) + b

    def slope(rows: Rows, by: np.ndarray) -> np.ndarray:
        return np.append(rows.transposed_times(by, len(w)), by.sum())

    positive = prior * np.logaddexp(0, -zp).mean()
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    g_positive = -prior * slope(pos, (1 - sigmoid(zp)) / pos.n)
    g_negative = slope(unl, sigmoid(zu) / unl.n) - prior * slope(pos, sigmoid(zp) / pos.n)
    return positive, negative, g_positive, g_negative


def nn_pu(pos: Rows, unl: Rows, n_features: int, prior: float, steps: int = STEPS, rate: float = 0.1, decay: float = DECAY) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk under the logistic loss, by Adam.

    Each step takes the whole samples: in small batches the unlabelled sample's toxic share varies by more than the
    risk that is left for clean texts, and the correction would undo every other step.
    """
    x = np.append(np.zeros(n_features), np.log(prior / (1 - prior)))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, steps + 1):
        _, negative, up, down = risk_and_slope(x, pos, unl, prior)
        g = -down if negative < 0 else up + down
        g[:-1] += decay * x[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return x[:-1], float(x[-1])


class Model:
    """Weights by bucket; a word's weight is the sum over its features, cached in each worker."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias, self.cache = weights, bias, {}

    def score(self, text: str | None) -> float:
        cache, z = self.cache, self.bias
        for w in tokens(text):
            x = cache.get(w)
            if x is None:
                if len(cache) > 120_000:
                    cache.clear()
                x = cache[w] = sum(self.weights.get(f, 0.0) for f in features(w))
            z += x
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def telling(bags_: DataFrame, n_pos: int, n_unl: int, min_texts: int, min_z: float) -> DataFrame:
    """(bucket) of bags_ (pos, bag) whose share of texts differs between positives and unlabelled ones."""
    each = bags_.select(F.col("pos").cast("int").alias("p"), F.explode(F.array_distinct("bag")).alias("bucket"))
    n = each.groupBy("bucket").agg(F.sum("p").alias("a"), F.sum(1 - F.col("p")).alias("b")).where(F.col("a") >= min_texts)
    both = (F.col("a") + F.col("b")) / (n_pos + n_unl)
    error = F.sqrt(F.greatest(both * (1 - both) * (1 / n_pos + 1 / n_unl), F.lit(1e-12)))
    return n.where(F.abs(F.col("a") / n_pos - F.col("b") / n_unl) / error >= min_z).select("bucket")


def fit(docs: DataFrame, labels: DataFrame, held_out: int | None = 1, folds: int = 3, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, min_texts: int = MIN_TEXTS, min_z: float = MIN_Z) -> Model:
    """Learn from labels outside the held-out fold. The prior is the toxic share of those labels."""
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null")
    if held_out is not None:
        keep = fold(F.col("doc_id"), folds) != held_out
        docs, labels = docs.where(keep), labels.where(keep)
    labels = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = labels.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic:
        return Model({}, -30.0)
    known = some_of(labels.where("toxic = 1").select("doc_id"), "doc_id", max_positive, toxic)
    others = some_of(docs.select("doc_id"), "doc_id", max_unlabelled, docs.count())
    ids = known.select("doc_id", F.lit(True).alias("pos")).union(others.select("doc_id", F.lit(False).alias("pos"))).distinct()
    bags_ = stored(_bags(docs.join(F.broadcast(ids), "doc_id")).withColumn("row", F.monotonically_increasing_id()), "bags")
    n_pos, n_unl = bags_.agg(F.count(F.when(F.col("pos"), 1)), F.count(F.when(~F.col("pos"), 1))).first()
    if not n_pos or not n_unl:
        return Model({}, -30.0)
    kept = np.array(sorted(r.bucket for r in telling(bags_, n_pos, n_unl, min_texts, min_z).collect()), np.int64)
    sent = docs.sparkSession.sparkContext.broadcast(kept)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """How many distinct words of each text have each feature that counts, packed: a text is one small row."""
        kept = sent.value
        for b in batches:
            found = []
            for bag in b["bag"]:
                at = np.searchsorted(kept, bag)
                at = at[(at < len(kept)) & (kept[np.minimum(at, len(kept) - 1)] == bag)] if len(kept) else np.empty(0, np.int64)
                found.append(np.unique(at, return_counts=True))
            if found:
                yield pd.DataFrame({"pos": b["pos"].to_numpy(), "row": b["row"].to_numpy(), "at": [x.astype(np.int32).tobytes() for x, _ in found], "n": [x.astype(np.int32).tobytes() for _, x in found]})

    packed: dict[bool, list] = {True: [], False: []}
    for r in bags_.mapInPandas(cells, "pos boolean, row long, at binary, n binary").toLocalIterator():
        packed[r.pos].append((r.row, np.frombuffer(r.at, np.int32), np.frombuffer(r.n, np.int32)))

    def side(pos: bool, n: int) -> Rows:
        rows = sorted(packed.pop(pos), key=lambda x: x[0])
        joined = lambda k: np.concatenate([x[k] for x in rows])
        return Rows(joined(1).astype(np.int64), joined(2).astype(float), np.repeat(np.arange(n), [len(x[1]) for x in rows]), n)

    w, b = nn_pu(side(True, n_pos), side(False, n_unl), len(kept), min(0.9, max(0.01, toxic / n)))
    return Model({int(k): float(x) for k, x in zip(kept, w, strict=True)}, b)


def _bags(docs: DataFrame) -> DataFrame:
    """(pos, bag): each row's feature buckets, one for each distinct word that has it."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"pos": batch["pos"].to_numpy(), "bag": [x.tolist() for x in bags(list(batch["text"]))]})

    return docs.select("pos", "text").mapInPandas(make, "pos boolean, bag array<int>")


def score_column(docs: DataFrame, model: Model):
    """A column of scores over text."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Model(*sent.value)
        for x in texts:
            yield pd.Series([scorer.score(t) for t in x], dtype="float64")

    return score(F.col("text"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, score, predicted."""
    score = score_column(docs, fit(docs, labels, **how))
    scored = docs.select("doc_id", (fold(F.col("doc_id"), how.get("folds", 3)) == how.get("held_out", 1)).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns."""
    score = score_column(docs, fit(docs, labels, **how))
    return docs.where(score < threshold)
