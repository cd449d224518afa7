"""BM25 retrieval by block-max WAND against full scoring, and planted items."""

import random

from spanwise.llm import decontamination as D


def items(rng, n=60):
    vocab = [f"w{i}" for i in range(300)]
    return [(i, " ".join(rng.choice(vocab[: rng.choice([20, 300])]) for _ in range(rng.randrange(5, 30))), " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 4)))) for i in range(n)]


def test_search_equals_full_scoring():
    rng = random.Random(2)
    for block in (1, 3, 16):
        ix = D.Index(items(rng), share=0.3, block=block)
        for _ in range(40):
            q = sorted(rng.sample(range(len(ix.number)), 80))
            score: dict[int, float] = {}
            for t in q:
                for n, g in zip(ix.item[t], ix.gain[t], strict=True):
                    score[n] = score.get(n, 0) + g
            want = {n: round(s, 9) for n, s in score.items() if s >= 0.3}
            assert {n: round(s, 9) for n, s in ix.search(q)} == want


def test_planted(spark, docs_of):
    rng = random.Random(3)
    its = items(rng)
    noise = lambda n: " ".join(f"n{rng.randrange(5000)}" for _ in range(n))
    rows, want = [(1000, None), (1001, ""), (1002, noise(3000))], set()
    for d in range(60):
        i, q, a = its[d]
        rows.append((d, f"{noise(rng.randrange(0, 400))} {q.upper()}, {a}.\n{noise(rng.randrange(0, 400))}"))
        want.add((d, i))
    bench = spark.createDataFrame([*its, (None, "a b c d e f", None), (99, None, None)], "item_id long, question string, answer string")
    got = D.contaminated(docs_of([*rows, rows[5]], "overlap"), bench)
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    assert want <= found
    assert all(d < 60 for d, _ in found)
    assert {r.doc_id for r in D.drop_contaminated(docs_of(rows), bench).collect()} == {1000, 1001, 1002}
    figures = lambda df: {(r.doc_id, r.item_id): (round(r.bm25, 9), r.overlap) for r in df.collect()}
    assert figures(D.contaminated(docs_of(rows), bench, max_terms=100)) == figures(got)


def test_empty(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(docs_of([(1, "a")]), D.items_of(none)).count() == 0
    assert D.drop_contaminated(docs_of([(1, "a")]), D.items_of(none)).count() == 1
    some = D.items_of(spark.createDataFrame([(1, "one two\nthree four \n"), (2, "five"), (3, None)], "item_id long, text string"))
    assert [(r.question, r.answer) for r in some.orderBy("item_id").collect()] == [("one two", "three four"), ("five", ""), (None, None)]
    assert D.contaminated(docs_of([]), some).count() == 0
    spread = docs_of([(1, "one two three four"), (2, None), (3, ""), (4, "six"), (5, "seven")]).repartition(200)
    assert D.usual_terms(spread, 10) == {}
    assert [(r.doc_id, r.item_id) for r in D.contaminated(spread, some).collect()] == [(1, 1)]


def test_hits_equal_all_windows():
    rng = random.Random(7)
    its = items(rng, 40)
    ix = D.Index(its, share=0.5, step=32, usual={b"w1": 9, b"w2": 5})
    for _ in range(60):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 300))]
        for _ in range(rng.randrange(0, 3)):
            _, q, a = its[rng.randrange(40)]
            p = rng.randrange(len(words) + 1)
            words[p:p] = [w for w in f"{q} {a}".split() if rng.random() < 0.93]
        want = {}
        for s in range(0, max(1, len(words) - ix.step), ix.step):
            part = D.terms(" ".join(words[s : s + 2 * ix.step]))
            for n in range(40):
                score = sum(g for t in set(part) if t in ix.number for m, g in zip(ix.item[ix.number[t]], ix.gain[ix.number[t]], strict=True) if m == n)
                there = ix.question[n]
                shared = len(there & D.grams(part, min(5, *map(len, there)))) / len(there)
                if score >= 0.5 - 1e-9 and shared >= 0.8 - 1e-9 and len(ix.answer[n] & set(part)) >= 0.8 * len(ix.answer[n]) - 1e-9:
                    want[n] = max(want.get(n, 0), round(score, 9))
        assert {n: round(s, 9) for n, (s, _) in ix.hits(" ".join(words)).items()} == want


def test_string_ids(spark):
    """Ids of any type; documents and items."""
    question = "which of these seven words comes last in the row"
    docs = spark.createDataFrame([("d1", f"noise {question} noise"), ("d2", "nothing here"), (None, None)], "doc_id string, text string")
    bench = spark.createDataFrame([("q1", question, None)], "item_id string, question string, answer string")
    assert [(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()] == [("d1", "q1")]
    assert {r.doc_id for r in D.drop_contaminated(docs, bench).collect()} == {"d2", None}
    assert D.contaminated(docs, bench.limit(0)).dtypes[:2] == [("doc_id", "string"), ("item_id", "string")]
