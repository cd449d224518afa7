"""Substring dedup against a dictionary of all strings; suffix arrays against sorting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from spanwise.llm import suffix_dedup as sd


def plainly(rows, length):
    first = {}
    key = lambda i, s: (i is not None, i or 0, s)
    for i, t in rows:
        raw = (t or "").encode()
        for s in range(len(raw) - length + 1):
            g = raw[s : s + length]
            first[g] = min(first.get(g, (True, float("inf"), 0)), key(i, s))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if key(i, s) > first[raw[s : s + length]]:
                gone[s : s + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return Counter(out)


def made(seed, n, alphabet, most):
    """Texts that copy from each other, whole, in part, and with changes."""
    rng = random.Random(seed)
    new = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    texts = []
    for _ in range(n):
        t = new(rng.randrange(most))
        for _ in range(rng.randrange(3)):
            if texts and (o := rng.choice(texts)):
                a = rng.randrange(len(o))
                t += o[a : a + rng.randrange(most)] + new(rng.randrange(20))
        texts.append(t)
    return [(k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize(
    ("rows", "length", "how"),
    [
        (made(1, 60, "ab", 60), 12, {"most": 3}),
        (made(2, 80, "abcdefgh é", 400), 40, {}),
        (made(3, 80, "abcdefghijklmnopqrstuvwxyz ñ", 900), 100, {"chunk": 300, "held": 50, "block": 2000}),
        (made(4, 50, "abcdefghijklmnopqrstuvwxyz ñ", 900), 100, {"most": 0}),
    ],
)
def test_against_dictionary(spark, rows, length, how):
    rows = [*rows, (900, None), (901, ""), (902, "short"), (903, "x" * 500), (904, "yz" * 400), (905, rows[5][1]), (5, rows[5][1]), (6, rows[5][1]), (None, rows[7][1] + "x" * 150), (None, rows[8][1]), (906, "é" * 120), (907, "\x00" * 130)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(5)
    got = Counter(tuple(r) for r in sd.substring_dedup(df, length, **how).collect())
    assert Counter((*r[:5], bytes(r[5])) for r in got.elements()) == plainly(rows, length)


def test_string_ids_and_empty(spark):
    rows = [("b", "z" * 30 + "the same words again"), ("a", "the same words again")]
    got = {r.doc_id: r.n_removed for r in sd.substring_dedup(spark.createDataFrame(rows, "doc_id string, text string"), 20).collect()}
    assert got == {"a": 0, "b": 49}
    assert sd.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("seed", range(40))
def test_suffix_array(seed):
    rng = random.Random(seed)
    size = [1, 2, 3, 50, 400][seed % 5]
    text = bytes(rng.choice([b"a", b"ab", b"\x00\xff", bytes(range(256))][seed % 4]) for _ in range(size))
    arr = np.frombuffer(text, np.uint8)
    order = sd.suffix_array(arr, 600).tolist()
    assert order == sorted(range(size), key=lambda i: text[i:])
    shallow = sd.suffix_array(arr, 8).tolist()
    assert sorted(shallow) == list(range(size))
    assert [text[i : i + 8] for i in shallow] == sorted(text[i : i + 8] for i in range(size))
    lcp = sd.common_prefixes(arr, np.array(order), 30).tolist()
    for k in range(1, size):
        a, b = text[order[k - 1] :], text[order[k] :]
        same = next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert lcp[k] == min(30, same)


def test_equal_strings_have_equal_anchors():
    rng = random.Random(9)
    same = bytes(rng.randrange(256) for _ in range(100))
    parts = [bytes(rng.randrange(256) for _ in range(rng.randrange(5, 300))) + same + b"tail" for _ in range(9)]
    part, start, n, _, anchor, _ = sd.runs(parts, 100)
    of = {(p, s + k): a for p, s, m, a in zip(part.tolist(), start.tolist(), n.tolist(), anchor.tolist(), strict=True) for k in range(m)}
    assert len({of[p, len(t) - 104] for p, t in enumerate(parts)}) == 1
    assert len(of) == sum(len(t) - 99 for t in parts)
