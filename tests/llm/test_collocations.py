"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from spanwise.llm import collocations as co

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plainly(rows, least, top=2000, longest=5):
    f, n, cands = Counter(), Counter(), {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, w[i : i + k]) for i in range(len(w) - k + 1))
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            s, k = min(cuts)
            cands[lang, p] = (s, a, f[lang, p[:k]], f[lang, p[k:]])
    dropped = set()
    for lang, p in cands:
        for i in range(len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p) and (lang, p[i:j]) in cands and cands[lang, p][1] >= cands[lang, p[i:j]][1]:
                    dropped.add((lang, p[i:j]))
    out = []
    for lang in n:
        mine = sorted((-s, -a, " ".join(p).encode(), l, r) for (g, p), (s, a, l, r) in cands.items() if g == lang and (g, p) not in dropped)
        out += [(lang, k, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for k, x in enumerate(mine[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    stock = ["new york city", "of the", "A B c d e f", "x x x x", "É à", "日本 語", "san\tfrancisco bay", "the same old"]
    make = lambda: " ".join(rng.choice(stock) + rng.choice(["", "", ".", ",", "\n", " w%d" % rng.randrange(30)]) for _ in range(rng.randrange(1, 50)))
    out = [(rng.choice(["en", "en", "fr", None, "und"]), make()) for _ in range(120)]
    return [*out, ("en", None), ("en", ""), (None, " \t"), ("en", "x " * 20_000), out[0], out[0], ("de", "a. b! c"), ("", "of the of the " * 9)]


@pytest.mark.parametrize("how", [{}, {"chunk": 5, "flush": 3}, {"top": 4}])
def test_against_plain_counting(spark, rows, how):
    df = spark.createDataFrame([(*r, 7) for r in rows], "lang string, text string, phrase int").repartition(3)
    got = sorted(tuple(r) for r in co.collocations(df, least=8, **how).collect())
    want = plainly(rows, 8, how.get("top", 2000))
    assert got == want
    assert len(want) > 10


def test_nothing_frequent(spark):
    df = spark.createDataFrame([("en", "a b c")], "lang string, text string")
    assert co.collocations(df).collect() == []
    assert co.collocations(df.where("false")).collect() == []


def test_large_numbers(spark):
    """1000 a n and l r go beyond 64 bits."""
    total = spark.createDataFrame([("en", 10**16)], "lang string, n long")
    one = spark.createDataFrame([("en", "a", 3 * 10**15), ("en", "b", 7 * 10**14)], "lang string, phrase string, f long")
    two = spark.createDataFrame([("en", "a b", 6 * 10**14 + 1)], "lang string, phrase string, f long")
    (r,) = co.scored(total, [one, two]).collect()
    assert r.score == 1000 * (6 * 10**14 + 1) * 10**16 // (3 * 10**15 * 7 * 10**14)


def test_bitmap_has_all_frequent(spark):
    h = np.random.default_rng(4).integers(0, 1 << 64, 5000, np.uint64)
    f = co.frequent_bits(spark.createDataFrame([(x,) for x in h.view(np.int64).tolist()], "hash long"))
    assert f.has(h).all()
    assert f.has(h ^ np.uint64(0x5555_5555_5555_5555)).mean() < 0.05
