"""Quality by hierarchical empirical Bayes: document evidence, path and host posteriors, global prior.

1. Evidence. A logistic model over a few figures of the text, trained in numpy on at most ``max_rows`` labelled rows
   outside the held-out fold, gives every document a probability of being good.
2. Sites. A document adds its label, if it is a training row, else its probability, to its host and to its path within
   the host. Over hosts, the prior Beta(k m, k (1 - m)) has the global mean m and a precision k from the moments of
   the host rates, sampling variance taken off. A host's posterior mean is (k m + s) / (k + n): few documents leave
   it near m. Paths are shrunk to their host's posterior in the same way, with a precision from the path rates.
3. Score. The evidence's log-odds plus the log-odds that the document's path, without the document itself, has over
   the global mean.

Texts are scored where they are; all joins move ids and figures, no texts. The sums are grouped aggregations with partial
sums, so a hot host is a row per task in the shuffle; the join back to documents has one row for each path on its other
side, so a hot path's rows may be split over any number of tasks, as adaptive execution does. Result: doc_id, held_out, host, path, evidence, host_rate, path_rate,
score, kept (score >= threshold).

Defined cases: a null text is the empty text; null hosts and paths are sites of their own; null or repeated labels:
nulls are ignored, a document labelled twice takes the mean; without labels of both kinds the evidence is 1/2 for all;
rows alike are scored each; empty tables give empty results; very long texts take time in proportion to their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import fold, some_of, stored, words

MAX_ROWS, THRESHOLD = 8000, 0.5
#: The moments give no finite precision where rates differ by no more than chance; then a site of so many documents
#: still counts as much as its prior.
MAX_PRECISION = 200.0


def figures(text: str | None) -> list[float]:
    """What the evidence looks at."""
    text = text or ""
    w = words(text)
    n, chars = max(1, len(w)), max(1, len(text))
    letters = len(re.findall(r"[^\W\d_]", text))
    upper = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))
    same = sum(a == b for a, b in zip(w, w[1:], strict=False))
    tail = len(re.findall(r"[!#*$%&|<>]", text))
    return [
        np.log1p(len(w)), len(set(w)) / n, same / n, letters / chars, upper / max(1, letters), tail / n,
        len(re.findall(r"[.,;:?]", text)) / n, len(re.findall(r"\d", text)) / chars, len(text) / n, len(re.findall(r"!!|\|", text)) / n, float(not w),
    ]


N_FIGURES = len(figures("a b"))


class Evidence:
    """A standardised logistic model."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, w: np.ndarray, b: float):
        self.mean, self.std, self.w, self.b = mean, std, w, b

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -6, 6) @ self.w + self.b
        return 1 / (1 + np.exp(-np.clip(z, -12, 12)))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 40, decay: float = 1.0) -> Evidence:
    """Newton's method on the penalised log-likelihood."""
    mean, std = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.hstack([np.clip((x - mean) / std, -6, 6), np.ones((len(x), 1))])
    v, penalty = np.zeros(z.shape[1]), np.diag([decay] * (z.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(v)), z.T @ (y - p) - penalty @ v)
        v = v + step
        if np.abs(step).max() < 1e-8:
            break
    return Evidence(mean, std, v[:-1], float(v[-1]))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Evidence | None:
    """Evidence from labels (doc_id, y), by the hash order of the ids."""
    ids = some_of(labels, "doc_id", max_rows, labels.count())

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "x": [figures(t) for t in b["text"]]})

    got = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").mapInPandas(measure, "doc_id long, y double, x array<double>").toPandas()
    got = got.sort_values("doc_id", kind="stable")
    if got.empty or got["y"].round().nunique() < 2:
        return None
    return logistic(np.stack(got["x"].to_list()).astype(float), got["y"].to_numpy())


def precision(rates: DataFrame, mean) -> F.Column:
    """Beta precision from moments of group rates (n, s) around a mean column: m (1 - m) / between-group variance - 1."""
    m = F.sum(F.col("n") * mean) / F.sum("n")
    spread = F.sum(F.col("n") * (F.col("s") / F.col("n") - mean) ** 2) / F.sum("n")
    # Within-group variance of a rate is about m (1 - m) / n; weighted by n it sums to groups over rows.
    between = spread - m * (1 - m) * F.count("*") / F.sum("n")
    return F.when(between > 1e-9, F.greatest(F.lit(1.0), F.least(F.lit(MAX_PRECISION), m * (1 - m) / between - 1))).otherwise(F.lit(MAX_PRECISION))


def quality(docs: DataFrame, labels: DataFrame, held_out: int = 1, folds: int = 3, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS, place=None) -> DataFrame:
    """The columns named above for docs (doc_id, text, host, path) and labels (doc_id, quality).

    place, if given, adds host and path to docs' other columns once texts are scored and left behind.
    """
    labels = labels.select("doc_id", F.col("quality").cast("double").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    labels = labels.groupBy("doc_id").agg(F.avg("y").alias("y"))
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_rows))

    @F.pandas_udf("double")
    def evidence(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = sent.value
        for x in texts:
            yield pd.Series(model(np.array([figures(t) for t in x], float).reshape(-1, N_FIGURES)) if model else np.full(len(x), 0.5))

    scored = docs.withColumn("_evidence", evidence("text")).drop("text")
    scored = (place(scored) if place else scored).select("doc_id", "host", "path", F.col("_evidence").alias("evidence")).join(labels, "doc_id", "left")
    scored = stored(scored.withColumn("add", F.coalesce("y", "evidence")), "evidence")
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("add").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    mean = hosts.agg((F.sum("s") / F.sum("n")).alias("m")).first().m
    if mean is None:
        mean = 0.5
    k = hosts.agg(precision(hosts, F.lit(mean)).alias("k")).first().k or MAX_PRECISION
    hosts = hosts.select("host", F.col("n").alias("hn"), F.col("s").alias("hs"), ((k * mean + F.col("s")) / (k + F.col("n"))).alias("host_rate"))
    # Joined by text with a mark for null, so that the joins stay plain equalities.
    key = lambda c, to: F.concat(F.when(F.col(c).isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(F.col(c), F.lit(""))).alias(to)
    paths = paths.select("*", key("host", "_h")).join(hosts.select(key("host", "_h"), "hn", "hs", "host_rate"), "_h")
    k2 = paths.agg(precision(paths, F.col("host_rate")).alias("k")).first().k or MAX_PRECISION
    paths = paths.select("_h", key("path", "_p"), "n", "s", "hn", "hs", "host_rate", ((k2 * F.col("host_rate") + F.col("s")) / (k2 + F.col("n"))).alias("path_rate"))
    out = scored.select("*", key("host", "_h"), key("path", "_p")).join(paths, ["_h", "_p"])
    host_without = (k * mean + F.col("hs") - F.col("add")) / (k + F.col("hn") - 1)
    without = (k2 * host_without + F.col("s") - F.col("add")) / (k2 + F.col("n") - 1)
    clip = lambda p: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    logit = lambda p: F.log(clip(p) / (1 - clip(p)))
    z = logit(F.col("evidence")) + logit(without) - logit(F.lit(mean))
    out = out.withColumn("score", 1 / (1 + F.exp(-z))).withColumn("held_out", fold(F.col("doc_id"), folds) == held_out)
    return out.select("doc_id", "held_out", "host", "path", "evidence", "host_rate", "path_rate", "score").withColumn("kept", F.col("score") >= threshold)


def with_sites(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """docs (doc_id, lang, source, further columns) with host and path: of the first url that shows the document, else its source and source/lang.

    The path is the url's host and the first part of its path. Columns host and path of docs give way to these.
    """
    from spanwise.llm.html_extraction import doc_of_url

    urls = pages.select(doc_of_url(F.col("url")).alias("doc_id"), "url").where("doc_id is not null").groupBy("doc_id").agg(F.min("url").alias("url"))
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    first = F.regexp_extract("url", r"^[a-z]+://[^/?#]+/([^/?#]*)/", 1)
    sites = urls.select("doc_id", host.alias("_host"), F.concat_ws("/", host, first).alias("_path"))
    out = docs.drop("host", "path").join(sites, "doc_id", "left")
    return out.withColumns({"host": F.coalesce("_host", "source"), "path": F.coalesce("_path", F.concat_ws("/", "source", "lang"))}).drop("_host", "_path")
