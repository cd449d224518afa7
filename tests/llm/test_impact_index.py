"""Ranked search against a plain loop over all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from spanwise.llm import impact_index as ii

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def plainly(docs, items, k=20):
    """(item_id, rank, doc_id, score), all in whole numbers."""
    texts = [(i, words(t)) for i, t in docs if words(t)]
    n_docs, n_terms = len(texts), sum(len(w) for _, w in texts)
    df = Counter(t for _, w in texts for t in set(w))
    out = []
    for item, text in sorted(set(items), key=str):
        scores = []
        for i, w in texts:
            m, tf = 100 - 25 + 25 * len(w) * n_docs // n_terms, Counter(w)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m)) for t in words(text) if tf[t])
            if s:
                scores.append((-s, i is None, i, s))
        out += [(item, r, x[2], x[3]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdé1") for _ in range(rng.randrange(1, 4))) for _ in range(120)]
    docs = [(i, " ".join(rng.choice(vocabulary).upper() if rng.random() < 0.2 else rng.choice(vocabulary[:40]) for _ in range(rng.randrange(1, 60)))) for i in range(300)]
    docs += [(500, docs[3][1]), (501, docs[3][1]), (3, docs[3][1]), (None, docs[3][1]), (502, None), (503, ""), (504, "...\n"), (505, "a1 " * 30_000), (506, "Ünïcode ÀB cd-ef_gh")]
    items = [(n, " ".join(rng.choice(vocabulary) for _ in range(12))) for n in range(15)] + [(20, "a1 A1 a1, a1"), (21, None), (22, "?!"), (23, "nowhere"), (24, docs[3][1]), (24, docs[3][1]), (25, "ünïcode àb CD")]
    return docs, items


@pytest.mark.parametrize("how", [{}, {"block": 7, "max_terms": 20}, {"sample": 2}, {"k": 3, "block": 64}])
def test_against_plain_loop(spark, case, how):
    docs, items = case
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int").repartition(3)
    got = ii.ranked_search(df, spark.createDataFrame(items, "item_id long, text string"), **how)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plainly(docs, items, how.get("k", 20))


def test_string_ids(spark):
    docs = spark.createDataFrame([("x", "one two"), ("b", "two one"), (None, "two")], "doc_id string, text string")
    got = ii.ranked_search(docs, spark.createDataFrame([("q", "two one")], "item_id string, text string")).collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in got] == [("q", 1, "b"), ("q", 2, "x"), ("q", 3, None)]


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ii.ranked_search(docs, items).collect() == []
    assert ii.ranked_search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.where("false")).collect() == []


def test_bit_slices():
    rng = np.random.default_rng(2)
    total, want = [], np.zeros(90, np.int64)
    for _ in range(20):
        docs = np.unique(rng.integers(0, 90, 30))
        values, shift = rng.integers(0, 1 << 30, len(docs)), int(rng.integers(0, 3))
        ii.add(total, ii.sliced(docs, values, 90), shift)
        want[docs] += values << shift
    assert [sum((s >> d & 1) << i for i, s in enumerate(total)) for d in range(90)] == want.tolist()
    for k in (1, 5, 89, 200):
        assert ii.best(total, k) == sorted(sorted((d for d in range(90) if want[d]), key=lambda d: (-want[d], d))[:k])
    even = ii.sliced(np.arange(50), np.repeat([5, 9], 25), 50)
    assert ii.best(even, 30) == [*range(5), *range(25, 50)]
