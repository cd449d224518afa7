"""Text operators against brute force, on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from spanwise.llm import bagminhash, html_extraction, language_model, mixing, quality_classifier, quality_rules, token_counts, toxicity

ROWS = [(1, None), (2, ""), (3, "one"), (4, "a b c d e f g " * 30), (4, "a b c d e f g " * 30), (None, "some words here"), (5, "é ü 日本 \n\n x" * 40), (6, "word " * 20_000), (7, "\n \t\r\n"), (8, "the cat sat on the mat " * 3)]


def collected(df):
    return [r.asDict() for r in df.collect()]


def judged_plainly(text, press):
    """Every column of the quality rules, by plain loops."""
    text = text or ""
    w, raw = text.encode().split(), text.encode()
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = set()
    for k in range(len(w) - 2):
        if tri[w[k], w[k + 1], w[k + 2]] > 1:
            hit |= {k, k + 1, k + 2}
    lines = [x for x in text.split("\n")]
    dup = sum(bool(x.strip(" \t\n\x0b\x0c\r")) and x in lines[:k] for k, x in enumerate(lines))
    ratio = lambda b: len(press(b)) / len(b)
    size = quality_rules.CHUNK
    chunks = []
    if len(raw) > size:
        at = 0
        while at < len(raw):
            chunks.append(raw[at : at + size] if at + size <= len(raw) else raw[-size:])
            at += size
    bad = sum(not quality_rules.CHUNK_BAND[0] <= ratio(c) <= quality_rules.CHUNK_BAND[1] for c in chunks)
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    low, high = [(a, b) for n, a, b in quality_rules.BANDS if len(raw) <= n][0]
    whole = ratio(raw) if raw else 0.0
    kept = not failed and low <= whole <= high and bad <= quality_rules.BAD_SHARE * len(chunks)
    return len(w), sum(len(x.decode()) for x in w), sum(text.count(x) for x in "#*$%&|<>"), dup, len(hit), whole, len(chunks), bad, failed, kept


def test_quality_rules(docs_of):
    """All columns of the query's result by brute force, on odd texts, prose, noise and texts that go bad at their end."""
    zstandard = pytest.importorskip("zstandard")
    press = zstandard.ZstdCompressor(level=3).compress
    rng = random.Random(1)
    prose = " ".join("".join(rng.choice("aeiou") + rng.choice("bcdfgklmnprst") for _ in range(rng.randrange(1, 4))) for _ in range(900))
    noise = " ".join("".join(chr(rng.randrange(33, 127)) for _ in range(8)) for _ in range(900))
    tail = prose[:2048] + " " + "spam " * 390
    long = " ".join(f"{prose} {k}" for k in range(200))
    rows = [*ROWS, (20, prose), (21, noise), (22, "again and again " * 400), (23, tail), (24, long), (25, "# a\n# a\n\n \n# b|<x>\n# a" + prose), (26, "x" * 2048), (27, "x y" * 683)]
    got = collected(quality_rules.quality_rules(docs_of(rows, "kept")))
    names = [x.split()[0] for x in quality_rules.OUT.split(", ")]
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in got) == Counter((i, *judged_plainly(t, press)) for i, t in rows)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert kept[20] and not any(kept[k] for k in (21, 22, 23, 1, 2, 7))


def test_quality_rules_empty(docs_of):
    assert quality_rules.quality_rules(docs_of([])).count() == 0


def test_token_counts(docs_of):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = [*ROWS, (9, "x<|endoftext|>y <|endoftext|>"), (10, "don't   stop\n\n now  "), (11, "\x1c\x85  a​"), (12, "ab" * 3000)]
    got = collected(token_counts.token_counts(docs_of(rows, "n_tokens"), path, cache_size=5))
    want = Counter((i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert token_counts.token_counts(docs_of([]), path).count() == 0


def test_mixing(docs_of):
    rng = random.Random(4)
    rows = [*ROWS, *((100 + k, "w " * rng.randrange(0, 400)) for k in range(300))]
    df = docs_of(rows, "size").drop("size").withColumnRenamed("n_chars", "taken")
    got = collected(mixing.mix(df, shard_rows=20))
    again = collected(mixing.mix(df.repartition(5), shard_rows=20))
    order = lambda rs: sorted(map(str, rs))
    assert order(got) == order(again) and len(got) == len(rows)
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        s = by.setdefault(r["source"], {"size": 0, "taken": 0, "target": r["target"], "shards": set(), "source_size": r["source_size"]})
        s["size"] += r["size"]
        s["taken"] += r["taken"]
        s["shards"].add(r["shard"])
    # Water-filling by hand.
    names = sorted((s for s in by if s is not None)) + [None] * (None in by)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, full = 1.5 * total, set()
    while True:
        level = left / sum(weight[s] for s in names if s not in full) if len(full) < len(names) else 0
        over = [s for s in names if s not in full and level * weight[s] > 2 * by[s]["size"]]
        if not over:
            break
        for s in over:
            full.add(s)
            left -= 2 * by[s]["size"]
    for s in names:
        want = 2 * by[s]["size"] if s in full else level * weight[s]
        assert by[s]["source_size"] == by[s]["size"] and math.isclose(by[s]["target"], want, rel_tol=1e-9, abs_tol=1e-6)
        assert abs(by[s]["taken"] - want) <= mixing.BLOCK * (1 + 2 * len(by[s]["shards"]))
    assert mixing.mix(docs_of([])).count() == 0


def test_apportionment_is_by_highest_quotients(spark):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    for _ in range(3):
        sizes = [rng.choice([0, 1, 1, 2, 5, 400, 10_000]) for _ in range(12)]
        seats = rng.randrange(1, 300)
        df = spark.createDataFrame([("s", k, n) for k, n in enumerate(sizes)], "source string, shard long, n long")
        got = {r.shard: r.quota for r in mixing.apportion(df, F.lit(seats).cast("long"), F.col("n")).collect()}
        best = sorted(((-n / (2 * j + 1), k) for k, n in enumerate(sizes) if n for j in range(seats)))[:seats]
        assert got == {k: sum(b == k for _, b in best) for k in range(12)}


def test_bagminhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 300).astype(np.uint64)
    c = rng.integers(1, 9, 300)
    d = np.where(rng.random(300) < 0.7, c, rng.integers(1, 9, 300))
    want = np.minimum(c, d).sum() / np.maximum(c, d).sum()
    got = (bagminhash.signature(h, c, 3000) == bagminhash.signature(h, d, 3000)).mean()
    assert abs(got - want) < 4 * math.sqrt(want * (1 - want) / 3000)


def test_bagminhash_points(monkeypatch):
    """Registers hold the first points below the weights, drawn one by one; all are drawn in a few rounds."""
    mix, u, m = bagminhash.mix64, np.uint64, 40
    one = lambda x: int(mix(np.array([x], u))[0])
    for counts in ([1] * 30, [1, 5, 2, 9, 1, 3], [1]):
        h = np.random.default_rng(len(counts)).integers(0, 2**63, len(counts)).astype(u)
        first = {}
        for x, c in zip(map(int, h), counts, strict=True):
            for j in range(c.bit_length() + 1):
                if j and (1 << (j - 1)) >= c:
                    break
                key, length, low = (one(x + j), 1 << (j - 1), 1 << (j - 1)) if j else (x, 1, 0)
                at = 0.0
                for i in range(1, 600):
                    r = one((key + int(bagminhash._STEP) * i) % 2**64)
                    at -= math.log(((r >> 11) + 0.5) / 2.0**53) / (m * length)
                    r2 = one(r ^ int(bagminhash._M1))
                    if low + length * ((r2 & 0xFFFFFFFF) / 2.0**32) < c:
                        reg = (r2 >> 32) % m
                        first[reg] = min(first.get(reg, (math.inf, 0)), (at, r2))
        got = bagminhash.signature(h, np.array(counts), m)
        assert [int(x) for x in got] == [first[reg][1] for reg in range(m)]
    drawn = []
    monkeypatch.setattr(bagminhash, "mix64", lambda x: [drawn.append(x.size), mix(x)][1])
    bagminhash.signature(np.random.default_rng(1).integers(0, 2**63, 250).astype(u), np.ones(250, int), 352)
    # 2268 points fill 352 registers on average; each is mixed twice.
    assert sum(drawn) < 5 * 2268 and len(drawn) <= 6, drawn


def classes(rows):
    """{row number: members} by exact multiset similarity of all pairs."""
    bags = []
    for _, t in rows:
        w = (t or "").encode().split()
        n = max(1, len(w) - 4)
        bags.append(Counter(tuple(w[k : k + 5]) for k in range(n)) if w else None)
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and 5 * sum((bags[i] & bags[j]).values()) >= 4 * sum((bags[i] | bags[j]).values()):
                up[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("star", [512, 3])
def test_near_duplicates(docs_of, monkeypatch, star):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(90)]
    rows = list(ROWS)
    for d in range(20, 90):
        t = list(base)
        for _ in range(rng.randrange(0, 6)):
            t[rng.randrange(len(t))] = rng.choice(words) if rng.random() < 0.8 else "same"
        rows.append((d, " ".join(t[: rng.choice([90, 90, 85])])))
    rows.append((20, rows[10][1]))
    monkeypatch.setattr(bagminhash, "SMALL", 4)
    monkeypatch.setattr(bagminhash, "LATER", 4)
    monkeypatch.setattr(bagminhash, "STAR", star)
    monkeypatch.setattr(bagminhash, "LONE", star)
    got = collected(bagminhash.near_duplicates(docs_of(rows, "key")))
    of = classes(rows)
    want = Counter()
    for k, (i, t) in enumerate(rows):
        members = [rows[j][0] for j in range(len(rows)) if of[j] == of[k]]
        want[i, min((m for m in members if m is not None), default=None), len(members) if (t or "").split() else 1] += 1
    assert Counter((r["doc_id"], r["class_id"], r["class_rows"]) for r in got) == want
    # The least doc_id of each class stays, however the table is split.
    stays = lambda df: Counter(r["doc_id"] for r in collected(df) if r["is_kept"])
    least = {}
    for k, (i, t) in enumerate(rows):
        least.setdefault(of[k] if (t or "").split() else -1 - k, []).append((i is None, i or 0, i))
    assert stays(bagminhash.near_duplicates(docs_of(rows).repartition(7))) == Counter(min(m)[2] for m in least.values())
    kept = collected(bagminhash.drop_near_duplicates(docs_of(rows, "key")))
    assert len(kept) == len({of[k] for k in range(len(rows))})
    assert bagminhash.near_duplicates(docs_of([])).count() == 0


def test_toxicity(spark, docs_of):
    rng = random.Random(8)
    words = [f"word{chr(97 + k % 26)}{k}x" for k in range(500)]
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(500)]
    bad = ["nastyword", "vileterm", "uglyslur"]
    rows, toxic = [], {}
    for d in range(900):
        t = [rng.choice(words) for _ in range(rng.randrange(10, 80))]
        toxic[d] = int(rng.random() < 0.15)
        for _ in range(3 * toxic[d]):
            t[rng.randrange(len(t))] = rng.choice(bad)
        rows.append((d, " ".join(t)))
    labels = spark.createDataFrame([(d, toxic[d]) for d in range(600)] + [(None, 1), (5000, 1), (3, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in collected(toxicity.toxicity(docs_of([*rows, (9001, None), (9002, "")], "score"), labels))}
    held = [d for d in range(900) if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(got[d]["held_out"] == (d in set(held)) for d in range(900))
    right = [got[d]["predicted"] == toxic[d] for d in held]
    assert sum(right) / len(right) > 0.95
    assert got[9001]["score"] == got[9002]["score"] < 0.5
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in collected(toxicity.toxicity(docs_of(rows[:5]), none))} < {x / 1e13 for x in range(3)} | {1 / (1 + math.exp(30))}


def test_non_negative_risk_against_plain_loops():
    """The risk and its slope by loops and finite differences, on both sides of the correction."""
    rng = np.random.default_rng(3)
    dense = [rng.integers(0, 3, (n, 4)).astype(float) for n in (7, 11)]
    pos, unl = (toxicity.Rows(*(lambda r, c: (c, x[r, c], r))(*np.nonzero(x)), len(x)) for x in dense)
    loss = lambda z: math.log1p(math.exp(-z))
    for prior, v in ((0.3, rng.normal(0, 1, 5)), (0.9, rng.normal(0, 1, 5))):

        def parts(v, prior=prior):
            z = [[sum(a * b for a, b in zip(row, v, strict=False)) + v[-1] for row in x] for x in dense]
            mean = lambda zs, sign: sum(loss(sign * t) for t in zs) / len(zs)
            return prior * mean(z[0], 1), mean(z[1], -1) - prior * mean(z[0], -1)

        up, down, g_up, g_down = toxicity.risk_and_slope(v, pos, unl, prior)
        assert np.allclose((up, down), parts(v))
        for k in range(5):
            e = np.eye(5)[k] * 1e-6
            assert np.allclose((np.array(parts(v + e)) - parts(v - e)) / 2e-6, (g_up[k], g_down[k]), atol=1e-6)
    # Adam by hand, down the whole risk or up its negative part: texts that only one side has let that part fall below 0.
    pos, unl = toxicity.Rows(np.array([0, 1]), np.ones(2), np.array([0, 1]), 2), toxicity.Rows(np.array([2, 0]), np.ones(2), np.array([0, 1]), 2)
    x, m, v, signs = np.append(np.zeros(3), np.log(0.4 / 0.6)), np.zeros(4), np.zeros(4), set()
    for step in range(1, 301):
        _, negative, up, down = toxicity.risk_and_slope(x, pos, unl, 0.4)
        signs.add(negative < 0)
        g = (-down if negative < 0 else up + down) + np.append(1e-4 * x[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - 0.1 * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w, b = toxicity.nn_pu(pos, unl, 3, 0.4, steps=300, decay=1e-4)
    assert np.allclose(np.append(w, b), x) and signs == {True, False}


def test_toxicity_samples_and_odd_tables(spark, docs_of):
    """What the fit takes from its sample, by plain counts; empty tables, very long and repeated rows, ids of null."""
    rows = [(d, ("badword thing " if d % 3 == 0 else "fine thing ") + f"w{'abcdefghij'[d % 10]}q") for d in range(90)]
    labels = spark.createDataFrame([(d, int(d % 3 == 0)) for d in range(90)], "doc_id long, toxic int")
    docs = docs_of([*rows, *rows[:9], (None, "badword"), (500, "badword " * 200_000), (501, "fine " * 200_000)], "score")
    model = toxicity.fit(docs, labels, held_out=None)
    bad = toxicity.features("badword")
    assert bad <= model.weights.keys() and all(model.weights[k] > 0 for k in bad)
    p, u = [t for d, t in [*rows, *rows[:9]] if d % 3 == 0], [t for _, t in [*rows, *rows[:9], (500, "badword"), (501, "fine")]]
    share = lambda side, k: sum(any(k in toxicity.features(w) for w in toxicity.tokens(t)) for t in side)
    for k in {k for w in ("badword", "fine", "thing", "waq", "wbq") for k in toxicity.features(w)}:
        a, b = share(p, k), share(u, k)
        both = (a + b) / (len(p) + len(u))
        z = abs(a / len(p) - b / len(u)) / math.sqrt(max(both * (1 - both) * (1 / len(p) + 1 / len(u)), 1e-12))
        assert (k in model.weights) == (a >= toxicity.MIN_TEXTS and z >= toxicity.MIN_Z)
    got = collected(toxicity.toxicity(docs, labels))
    assert len(got) == 102 and {r["score"] for r in got if r["doc_id"] == 0} == {r["score"] for r in got if r["doc_id"] in (3, 30)} and len({r["score"] for r in got if r["doc_id"] == 500}) == 1
    assert toxicity.toxicity(docs_of([]), labels).count() == 0 and toxicity.drop_toxic(docs_of([]), labels.limit(0)).count() == 0
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_language_model(spark, docs_of):
    """All columns by brute force; the score by a plain softmax over every output, unit and word."""
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = list(ROWS) + [(50 + d, " ".join(rng.choice([["Aa", "bb"], ["cc", "dd", f"odd{d % 7}"]][d % 2]) for _ in range(40)) + f" rare{d}") for d in range(120)]
    how = {"n_words": 5, "table_size": 12, "n_vectors": 4, "dim": 6}
    docs = docs_of(rows, "word")
    got = collected(language_model.lm_scores(docs, **how))
    low = lambda t: (t or "").encode().lower().split()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(w for i, t in rows if not held(i) for w in [*low(t), b""])
    n, v = sum(c.values()), len(c)
    marked = docs.select("doc_id", "text", (language_model.fold(F.col("doc_id"), 5) == 1).alias("held_out"))
    vocab, model = language_model.fit(marked, language_model.word_counts(marked).cache(), **how)
    codes, seen = vocab.codes(), sorted(w for w in c if w)
    assert 2 < vocab.first_class < 8 and vocab.n_units == language_model.CLASSES + 4
    rest = Counter()
    place = {}
    for w in [*seen, b"new"]:
        out, unit = (int(x[0]) for x in vocab.outputs(np.array([codes([w])[0]])))
        place[w] = (out, unit)
        rest[unit] += (c[w] + 0.5) * (out >= vocab.first_class)
    # A class's unseen words share half a count.
    share = {u: k if u == place[b"new"][1] else k + 0.5 for u, k in rest.items()}

    def softmax(z):
        e = np.exp(z - z.max())
        return e / e.sum()

    def p(w, o1, o2):
        z = model.Q @ (model.pos[0] * model.R[o1] + model.pos[1] * model.R[o2]) + model.b
        z[language_model.BOS] = -np.inf
        z = softmax(z)
        if w == b"":
            return z[language_model.END]
        out, unit = place.get(w, (None, None))
        if out is None:
            out, unit = (int(x[0]) for x in vocab.outputs(np.array([codes([w])[0]])))
        if out < vocab.first_class:
            return z[out]
        k = out - vocab.first_class
        at = slice(vocab.start[k], vocab.start[k + 1])
        inner = softmax(model.U[at] @ (model.pos[2] * model.R[o1]) + model.d[at])[unit - vocab.start[k]]
        whole = vocab.rest[0][k] + 0.5 * (vocab.rest[1][k] + 1)
        return z[out] * inner * ((c[w] + 0.5) / whole if unit == vocab.start[k + 1] - 1 else 1)

    # What a class's unseen words have in all is the part of "new" in its class; other classes' halves are added.
    for o1, o2 in ((0, 0), (2, 3), (vocab.size - 1, 4)):
        z = model.Q @ (model.pos[0] * model.R[o1] + model.pos[1] * model.R[o2]) + model.b
        z[language_model.BOS] = -np.inf
        z = softmax(z)
        unseen = 0.0
        for k in range(language_model.CLASSES):
            at = slice(vocab.start[k], vocab.start[k + 1])
            inner = softmax(model.U[at] @ (model.pos[2] * model.R[o1]) + model.d[at])[-1]
            unseen += z[vocab.first_class + k] * inner * 0.5 / (vocab.rest[0][k] + 0.5 * (vocab.rest[1][k] + 1))
        assert math.isclose(sum(p(w, o1, o2) for w in [*seen, b""]) + unseen, 1, abs_tol=1e-4)
    want, score = Counter(), {}
    for i, t in rows:
        w = [*low(t), b""]
        want[i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)] += 1
        if len(w) < 1000:
            out = [0, 0, *(language_model.END if x == b"" else int(vocab.outputs(np.array([codes([x])[0]]))[0][0]) for x in w)]
            score[i] = sum(math.log10(p(x, out[k + 1], out[k])) for k, x in enumerate(w))
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    again = {r["doc_id"]: r["score"] for r in collected(language_model.scores(marked, language_model.word_counts(marked), vocab, model))}
    assert all(math.isclose(again[i], s, rel_tol=1e-4, abs_tol=1e-3) for i, s in score.items())
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    rerun = collected(language_model.lm_scores(docs, **how))
    assert math.isclose(sum(r["score"] for r in got), sum(r["score"] for r in rerun), rel_tol=1e-6)
    assert language_model.lm_scores(docs_of([])).count() == 0


def test_language_model_bears_tasks_without_rows(docs_of):
    got = language_model.lm_scores(docs_of([(1, "a b"), (2, None), (3, "c d e"), (4, "")]).repartition(50))
    assert {(r.doc_id, r.n_tokens) for r in got.collect()} == {(1, 3), (2, 1), (3, 4), (4, 1)}


def test_language_model_learns():
    """On a chain of two kinds of words, the model beats the unigram distribution, for outputs and for units."""
    import pandas as pd

    rng = np.random.default_rng(1)
    names = [f"{x}{y}{k}" for x in "ab" for y in "cd" for k in range(6)]
    kind = np.repeat(rng.integers(0, 2, 400), 50)
    words = kind * 12 + rng.integers(0, 12, 20_000)
    table = pd.DataFrame({"word": names, "c": np.bincount(words, minlength=24)})
    of = np.zeros((2, language_model.CLASSES), np.int64)
    for w, k in zip(names, table["c"], strict=True):
        of[:, language_model.suffix_class(w.encode())] += (k, 1)
    vocab = language_model.Vocabulary(table, len(words), 24, of, 1, 6, 18)
    out, unit = vocab.outputs(words)
    unit[out < vocab.first_class] = -1
    h1, h2 = np.roll(out, 1), np.roll(out, 2)
    model = language_model.LogBilinear(vocab, 8)
    before = language_model.Scorer(model).logs(out, h1, h2, unit).mean()
    for _ in range(15):
        for k in range(0, len(words), 2000):
            at = slice(k, k + 2000)
            model.train(out[at], h1[at], h2[at], unit[at])
    p = np.bincount(words) / len(words)
    assert language_model.Scorer(model).logs(out, h1, h2, unit).mean() > max(before, np.log10(p[words]).mean() + 0.15)


PAGE = (
    '<html><head><title>T</title><script>var a="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/">Home page</a></li></ul></nav>'
    '<div class="ad">Buy this thing now</div><article><h1>Head &amp; line</h1><p>First  block<br>of text.</p><aside>side note words</aside><p>Second <b>bl</b>ock&nbsp;here.</p>'
    '<form><label>Name</label></form></article><section id="comments"><p>a reader says much about it all</p></section><footer>foot</footer></body></html>'
)


def test_html(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain & text"), (5, "u", "<p>a<p>b"), (6, "u", "<nav>only</nav>"), (1, "u", PAGE)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extraction.html_extraction(df, html_extraction.Weights()).collect()}
    want = "Head & line\nFirst block of text.\nSecond block here."
    assert [got[i].text for i in range(1, 7)] == [want, "", "", "plain & text", "a\nb", ""]
    assert got[1].n_chars == len(want)
    assert html_extraction.extract(PAGE.replace("article", "div"), html_extraction.Weights()) == want
    learned = html_extraction.learn([(PAGE, "First block of text. Second block here.")] * 30)
    assert html_extraction.extract(PAGE, learned) == want and learned.tags["p"] < 0 and ".ad" in learned.never


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_html_keeps_whole_articles():
    """Class names beside an article, elements amid it, and what stands after it."""
    rng = random.Random(4)
    a, b, c = prose(rng, 60), prose(rng, 60), prose(rng, 12)
    get = lambda page, weights=html_extraction.Weights(): html_extraction.extract(f"<html><body>{page}</body></html>", weights)
    trained = html_extraction.learn([(PAGE, "First block of text. Second block here.")] * 30)
    for w in (html_extraction.Weights(), trained):
        assert get(f'<div class="content with-sidebar"><p>{a}</p></div>', w) == a
        assert get(f'<div class="layout has-comments"><article><p>{a}</p></article></div>', w) == a
        assert get(f'<article><p>{a}</p><div class="related-work">{c}</div><p class="search">{b}</p></article>', w) == f"{a}\n{c}\n{b}"
        assert get(f"<article><p>{a}</p><video src='x'><p>{b}</p></article>", w) == f"{a}\n{b}"
        assert get(f"<article><p>{a} <math><mi>x</mi></math> {c}</p></article>", w) == f"{a} x {c}"
        links = "".join(f'<li><a href="/{k}">link{k}</a></li>' for k in range(40))
        got = get(f"<article><p>{a}</p><ul>{links}</ul><p>{b}</p></article>", w)
        assert got.startswith(a) and got.endswith(b)
        assert get(f"<nav>{c}</nav><main><p>{a}</p></main><p>After.</p>", w) == a
        assert get(f'<main><p>{a}</p><div class="ad-slot">{c}</div><aside>{c}</aside><div class="cookie-banner">{c}</div><p>{b}</p></main>', w) == f"{a}\n{b}"
        assert get(f'<article><p>{a}</p></article><section id="comments">{prose(rng, 300)}</section>', w) == a
        assert get(f"<p>{a}<script>{c}", w) == a
    assert get(f'<div class="notice"><h1>Head</h1><p>{a}</p></div>') == f"Head\n{a}"
    assert get('<a href="/">only links here</a>') == "only links here"
    learned = html_extraction.learn([(f'<body><div class="blurb">{c}</div><div class="ad"><p>{a}</p></div></body>', a)] * 25)
    assert ".blurb" in learned.never and ".ad" in learned.always
    assert get(f'<div class="ad"><p>{b}</p><div class="blurb">{a}</div></div>', learned) == b


def test_html_region_is_the_best(spark):
    """Whole extraction with the region found by trying all regions."""
    rng = random.Random(8)
    for _ in range(150):
        page = "".join(rng.choice(["<p>", "</p>", "<div>", "</div>", "<a href='/'>", "</a>", "<nav>", "</nav>", "<article>", "</article>", "<br>", "<h1>", "</h1>", "one two ", "three", " four five six "]) for _ in range(rng.randrange(14)))
        w = html_extraction.Weights()
        toks = html_extraction.tokens(page)
        out = html_extraction.excluded(toks, w)
        scores = html_extraction.scored(toks, out, w)
        if not any(x > 0 for x in scores):
            scores = [w.word if s < 0 and k == "text" and not o and t.strip() else s for s, (k, t, _), o in zip(scores, toks, out, strict=True)]
        regions = [(sum(scores[a:b]), -a, b) for a in range(len(toks)) for b in range(a + 1, len(toks) + 1)]
        best = max(regions, default=(0, 0, 0))
        _, a, b = best if best[0] > 0 else (0, 0, 0)
        text = "".join(("\n" if t in html_extraction.BLOCKS else " " if t == "br" else "") if k != "text" else "" if o else t for (k, t, _), o in zip(toks[-a:b], out[-a:b], strict=True))
        want = "\n".join(x for x in (" ".join(line.split()) for line in text.split("\n")) if x)
        got = html_extraction.extract(page, w)
        assert sorted(got.split()) == sorted(want.split()) and got == want, page


def test_html_takes_linear_time():
    """Unclosed tags, quotes, comments and scripts: four times the page takes about four times as long."""
    import time

    def took(page):
        began = time.process_time()
        html_extraction.extract(page, html_extraction.Weights())
        return time.process_time() - began

    for part in ("</ ", "<! ", "<? ", "<a '", '<a "', "<a x=' \" ", "<!-- ", "</script ", "<svg ", "<div ", "< "):
        page = "<p>some words</p><script>" * (part == "</script ") + part * 10_000
        assert took(page * 8) < 24 * took(page) + 0.3, part


def test_html_fit_and_odd_tables(spark):
    """What is learned over Spark equals what is learned in one place; empty tables, very long, repeated and null rows."""
    rng = random.Random(6)
    texts = [(d, prose(rng, 80)) for d in range(30)] + [(30, None)]
    pages = [(d, f'<body><div class="blurb">{prose(rng, 9)}</div><article><p>{t}</p></article></body>' if t else None, d) for d, t in texts] + [(99, "<p>x</p>", None), (98, None, 4)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    df = spark.createDataFrame(pages, "page_id long, html string, doc_id long")
    got, want = html_extraction.fit(df, docs), html_extraction.learn([(h, t) for (_, h, _), (_, t) in zip(pages, texts, strict=False)])
    assert (got.tags, got.never, got.always, got.linked) == (want.tags, want.never, want.always, want.linked) and ".blurb" in got.never
    assert html_extraction.fit(df.limit(0), docs).tags == html_extraction.Weights().tags
    long = "<article>" + "<div class='x'><p>some more words stand <b>in bold</b> here</p></div>" * 20_000 + "</article>"
    rows = [(1, "u", long, 1), (1, "u", long, 1), (None, None, None, 2)]
    out = html_extraction.html_extraction(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long"), got).collect()
    assert sorted((r.n_chars for r in out)) == [0, 699_999, 699_999]
    assert html_extraction.html_extraction(spark.createDataFrame([], "page_id long, url string, html string"), got).count() == 0


def test_best_region_is_the_best():
    rng = random.Random(2)
    for _ in range(200):
        s = [rng.choice([-2.0, -1.0, 0.5, 1.0]) for _ in range(rng.randrange(0, 12))]
        a, b = html_extraction.best_region(s)
        best = max((sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=0)
        assert math.isclose(sum(s[a:b]), max(0, best))


def test_quality_classifier_by_plain_sums(spark):
    """Host and path posteriors and scores from the evidence, by plain loops over sites; hot, sparse and null sites, repeated and very long rows."""
    rng = random.Random(9)
    rows = []
    for d in range(300):
        host = rng.choice(["hot"] * 6 + ["b", "c", None, "d"])
        path = rng.choice([f"{host}/x", f"{host}/y", None]) if host != "d" else f"d/{d}"
        rows.append((d, " ".join(rng.choice(["good", "fine", "word", "!!!!", "spam"]) for _ in range(rng.randrange(0, 40))), host, path))
    rows += [rows[0], rows[0], (400, None, "hot", "hot/x"), (401, "long word " * 100_000, "b", "b/x"), (None, "no id", "c", "c/x")]
    y = {d: int(rng.random() < (0.8 if (rows[d][2] or "") > "c" else 0.4)) for d in range(0, 300, 2)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame([*y.items(), (4, 1 - y[4]), (6, None)], "doc_id long, quality int")
    got = collected(quality_classifier.quality(docs, labels))
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1
    add = lambda r: 0.5 if r["doc_id"] == 4 and not held(4) else y[r["doc_id"]] if r["doc_id"] in y and not held(r["doc_id"]) else r["evidence"]
    sums: dict = {}
    for r in got:
        for k in ((r["host"],), (r["host"], r["path"])):
            n, s = sums.get(k, (0, 0.0))
            sums[k] = n + 1, s + add(r)
    hosts = {k: v for k, v in sums.items() if len(k) == 1}
    mean = sum(s for _, s in hosts.values()) / len(got)

    def precision(groups):
        total = sum(n for n, _, _ in groups)
        m = sum(n * c for n, _, c in groups) / total
        between = sum(n * (s / n - c) ** 2 for n, s, c in groups) / total - m * (1 - m) * len(groups) / total
        return max(1.0, min(quality_classifier.MAX_PRECISION, m * (1 - m) / between - 1)) if between > 1e-9 else quality_classifier.MAX_PRECISION

    k = precision([(n, s, mean) for n, s in hosts.values()])
    rate = {h: (k * mean + s) / (k + n) for h, (n, s) in hosts.items()}
    paths = {p: v for p, v in sums.items() if len(p) == 2}
    k2 = precision([(n, s, rate[p[:1]]) for p, (n, s) in paths.items()])
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    for r in got:
        h, p = (r["host"],), (r["host"], r["path"])
        (hn, hs), (n, s), a = sums[h], sums[p], add(r)
        assert math.isclose(r["host_rate"], rate[h], rel_tol=1e-9) and math.isclose(r["path_rate"], (k2 * rate[h] + s) / (k2 + n), rel_tol=1e-9)
        alone = (k2 * (k * mean + hs - a) / (k + hn - 1) + s - a) / (k2 + n - 1)
        z = logit(r["evidence"]) + logit(alone) - logit(mean)
        assert math.isclose(r["score"], 1 / (1 + math.exp(-z)), rel_tol=1e-7, abs_tol=1e-12) and r["kept"] == (r["score"] >= quality_classifier.THRESHOLD) and r["held_out"] == held(r["doc_id"])
    assert len(got) == len(rows) and quality_classifier.quality(docs, labels.limit(0)).select("evidence").distinct().collect()[0][0] == 0.5


def test_sites_come_without_texts(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", "mine"), (2, "b", "de", None, "mine"), (3, "c", "en", "t", "mine")], "doc_id long, text string, lang string, source string, host string")
    pages = spark.createDataFrame([("http://x.org/en/1?q", None), ("http://a.org/fr/1", None), (None, None), ("http://b.org/3", None)], "url string, html string")
    got = quality_classifier.with_sites(docs, pages)
    assert {(r.doc_id, r.host, r.path) for r in got.collect()} == {(1, "a.org", "a.org/fr"), (2, None, "de"), (3, "b.org", "b.org/")}


def test_quality_classifier(spark, docs_of):
    rng = random.Random(5)
    good = lambda: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 8))) for _ in range(60)) + "."
    rows, y = [], {}
    for d in range(240):
        y[d] = int(rng.random() < 0.7)
        rows.append((d, good() if y[d] else "SPAM!! " * 60, "h" + str(d % 4), f"h{d % 4}/p{d % 8}", d))
    rows += [(900, None, None, None, 0), (901, good(), "new", "new/p", 0), (901, good(), "new", "new/p", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string, n long")
    labels = spark.createDataFrame([(d, y[d]) for d in range(240)] + [(0, None), (None, 1)], "doc_id long, quality int")
    got = collected(quality_classifier.quality(docs, labels))
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[d]["kept"] == bool(y[d]) for d in range(240)) and by[901]["kept"]
    rate = sum(y.values()) / 240
    assert all(abs(by[d]["path_rate"] - rate) < 0.25 for d in range(240))
    assert quality_classifier.quality(docs.limit(0), labels.limit(0)).count() == 0


def test_large_star_gives_shared_shingles_only(spark):
    """Of a star of 700 short texts, what only one of them has beyond the centre isn't given out; what two have is."""
    words = [f"w{k}" for k in range(30)]
    text = lambda n: " ".join([*words, f"own{n}", *(["both", "have", "these", "five", "words"] if n in (5, 600) else [])])
    texts = spark.createDataFrame([(0, " ".join(words)), *((n, text(n)) for n in range(1, 701))], "node long, text string").coalesce(1)
    total = sum(len(text(n).split()) - 4 for n in range(1, 701))
    pairs = spark.createDataFrame([(0, n, 26, 700, total) for n in range(1, 701)], "a long, b long, least long, k long, total long").coalesce(1)
    got = bagminhash.verify(pairs, texts, 0.8).where("size(beyond) > 0").collect()
    assert sorted(r.b for r in got) == [5, 600] and {len(r.beyond) for r in got} == {1}
