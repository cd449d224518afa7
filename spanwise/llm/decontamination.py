"""Benchmark decontamination: a BM25 inverted index of test items, queried with every training passage by block-max WAND.

The index holds the items: per term its postings (item, contribution) in item order, cut into blocks with their
greatest contribution. An item's contribution for a term is its BM25 weight with the item as the document and the term
counted once in the query, so the sum over an item's terms is its own score. A passage retrieves each item
whose BM25 score reaches ``share`` of the item's own. For one common bar, contributions are divided by the item's own
score: an item is above threshold if its scaled score reaches ``share``. WAND sorts the passage's term cursors by item,
finds the pivot where their bounds add up to the bar, checks the block bounds there, and skips items that can't
reach it. Before that, sums by item of what the less common terms can add rule out most passages.

Passages are windows of ``2 * step`` words at every multiple of ``step``, where step is at least the longest item's
number of words: any copy of an item lies wholly in some passage. An item found in a passage is verified on the passage:
of its question's 5-word shingles (words without punctuation and case) a share of ``overlap`` or more must be there,
and, if it has an answer, of the answer's words too.

The index is broadcast; its size is bounded: items are taken in shards of at most ``max_terms`` postings, and each
shard is one broadcast and one pass over the documents. Term statistics, the mean length and the passage step are taken over
all items beforehand, so results don't depend on the shards. Result: (doc_id, item_id, bm25, overlap), a row for each contaminated
document and item; bm25 is the scaled score, overlap the verified share, both the best over passages.

Defined cases: null or empty texts, and items without a word or an id, give no rows; items of fewer than 5 words are one shingle;
equal items with ids of their own are each reported, a repeated row counts once; documents alike in doc_id give one row per
item; empty tables, and tasks without rows, give no rows.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import stored

K1, B = 1.2, 0.75
SHINGLE, OVERLAP, SHARE = 5, 0.8, 0.5
STEP, BLOCK, MAX_TERMS = 64, 16, 2_000_000
SPARE, SAMPLE = 0.6, 1000
STRIP = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _stripped(words: list[bytes]) -> list[bytes]:
    return [w for w in (x.strip(STRIP) for x in words) if w]


def terms(text: str | None) -> list[bytes]:
    """Words in lower case without ASCII punctuation at their ends."""
    return _stripped(text.lower().encode().split()) if text else []


class Codes(dict):
    """Word as it stands to the number of its term, or of none; kept for a bounded number of words."""

    def __init__(self, number: dict[bytes, int]):
        super().__init__()
        self.number = number

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        n = self[word] = self.number.get(word.strip(STRIP), len(self.number))
        return n

    def __reduce__(self):
        return Codes, (self.number,)


def grams(words: list, k: int = SHINGLE) -> set:
    n = max(1, len(words) - k + 1)
    return {tuple(words[i : i + k]) for i in range(n)} if words else set()


@dataclass
class Statistics:
    """What BM25 takes from all items: how many have each term, their number, mean length, and the longest one's words."""

    df: dict[bytes, int]
    n_items: int
    mean_len: float
    longest: int


def statistics_of(items: list[tuple]) -> Statistics:
    whole = [terms(q) + terms(a) for _, q, a in items]
    longest = max(len(f"{q or ''} {a or ''}".split()) for _, q, a in items)
    return Statistics(Counter(t for w in whole for t in set(w)), len(items), sum(map(len, whole)) / len(items), longest)


class Index:
    """Postings of one shard of items (item_id, question, answer), scored with the statistics of all items (by default: of these)."""

    def __init__(self, items: list[tuple], share: float = SHARE, step: int = STEP, block: int = BLOCK, usual: dict[bytes, int] | None = None, statistics: Statistics | None = None):
        self.ids = [i for i, _, _ in items]
        self.question = [grams(terms(q)) for _, q, _ in items]
        self.answer = [set(terms(a)) for _, _, a in items]
        self.share, self.block = share, block
        whole = [terms(q) + terms(a) for _, q, a in items]
        stats = statistics or statistics_of(items)
        df, n_items, mean_len = stats.df, stats.n_items, stats.mean_len
        self.step = max(step, stats.longest)
        posts: dict[bytes, list[tuple[int, float]]] = {}
        for n, w in enumerate(whole):
            got = {t: math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / mean_len)) for t, f in Counter(w).items()}
            own = sum(got.values())
            for t, v in got.items():
                posts.setdefault(t, []).append((n, v / own))
        self.number = {t: k for k, t in enumerate(posts)}
        self.codes = Codes(self.number)
        self.item = [[n for n, _ in p] for p in posts.values()]
        self.gain = [[g for _, g in p] for p in posts.values()]
        self.bound = np.array([max(g) for g in self.gain] + [0.0])
        self.blocks = [[max(g[i : i + block]) for i in range(0, len(g), block)] for g in self.gain]
        # What rules passages out. An item's commonest terms, up to SPARE of the bar, may all be there; the rest of the
        # bar must come from its other terms, so their parts of that rest must add up to 1 or more, item by item. How
        # common terms are in the corpus is only an estimate (``usual``); any order gives the same results.
        usual, rows = usual or {}, []
        for n, w in enumerate(whole):
            gains = {self.number[t]: (-usual.get(t, 0), -df[t], len(t), t) for t in set(w)}
            mine = {k: self.gain[k][bisect.bisect_left(self.item[k], n)] for k in gains}
            spare, order = share * SPARE, sorted(gains, key=gains.get)
            free = 0
            while free < len(order) and mine[order[free]] <= spare:
                spare -= mine[order[free]]
                free += 1
            rows += [(k, n, mine[k] / (share * (1 - SPARE) + spare)) for k in order[free:]]
        rows.sort()
        term = np.array([k for k, _, _ in rows], np.int64)
        self.part_item, self.part = np.array([n for _, n, _ in rows], np.int64), np.array([x for _, _, x in rows])
        self.part_at = np.searchsorted(term, np.arange(len(posts) + 2))

    def passages(self, t: np.ndarray) -> np.ndarray:
        """Numbers of the passages of a text, given as its terms, that may hold an item."""
        n = self.part_at[t + 1] - self.part_at[t]
        total = int(n.sum())
        if not total:
            return np.empty(0, np.int64)
        at = np.repeat(self.part_at[t] - np.cumsum(n) + n, n) + np.arange(total)
        key = np.repeat(np.arange(len(t)) // self.step, n) * len(self.ids) + self.part_item[at]
        key, which = np.unique(key, return_inverse=True)
        here = np.bincount(which, self.part[at])
        # A passage is two steps of words: its own and the next.
        after = np.minimum(np.searchsorted(key, key + len(self.ids)), len(key) - 1)
        both = here + np.where(key[after] == key + len(self.ids), here[after], 0.0)
        return np.unique(key[both >= 1 - 1e-6] // len(self.ids))

    def search(self, query: list[int]) -> list[tuple[int, float]]:
        """(item, score) of all items whose score for these distinct terms reaches the share. Block-max WAND."""
        end, bar, size = len(self.ids), self.share - 1e-9, self.block
        cursors = [[self.item[t][0], 0, t] for t in query]
        found = []
        while True:
            cursors.sort()
            total, pivot = 0.0, -1
            for k, (at, _, t) in enumerate(cursors):
                if at == end:
                    break
                total += self.bound[t]
                if total >= bar:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            if cursors[0][0] == item:
                near = cursors[: pivot + 1]
                if sum(self.blocks[t][p // size] for _, p, t in near) < bar:
                    # No item of these blocks can reach the bar before one of them ends or another term joins in.
                    stop = min([self._last(p, t) + 1 for _, p, t in near] + [c[0] for c in cursors[pivot + 1 : pivot + 2]])
                    self._move(near, max(stop, item + 1), end)
                    continue
                score = sum(self.gain[t][p] for _, p, t in near)
                if score >= bar:
                    found.append((item, score))
                self._move(near, item + 1, end)
            else:
                self._move(cursors[:pivot], item, end)

    def _last(self, p: int, t: int) -> int:
        """The last item of the block that holds posting p."""
        post = self.item[t]
        return post[min(len(post), (p // self.block + 1) * self.block) - 1]

    def _move(self, cursors: list[list], item: int, end: int) -> None:
        for c in cursors:
            post, p = self.item[c[2]], c[1]
            while p < len(post) and post[p] < item:
                p += 1
            c[0], c[1] = (post[p], p) if p < len(post) else (end, p)

    def hits(self, text: str | None, overlap: float = OVERLAP) -> dict[int, tuple[float, float]]:
        """item -> (score, overlap) of the items that some passage of the text holds."""
        if not text:
            return {}
        w = text.lower().encode().split()
        if not w:
            return {}
        none = len(self.number)
        t = np.fromiter(map(self.codes.__getitem__, w), np.int64, len(w))
        starts = np.arange(0, max(1, len(w) - self.step), self.step)
        ends = np.minimum(starts + 2 * self.step, len(w))
        out: dict[int, tuple[float, float]] = {}
        for k in np.unique(np.minimum(self.passages(t), len(starts) - 1)):
            a, b = int(starts[k]), int(ends[k])
            q = np.unique(t[a:b])
            if self.bound[q].sum() < self.share - 1e-6:
                continue
            part, q = _stripped(w[a:b]), q[q < none]
            for item, score in self.search(q.tolist()):
                there = self.question[item]
                shared = len(there & grams(part, min(SHINGLE, *map(len, there)))) / len(there) if there else 0.0
                answer = self.answer[item]
                if shared >= overlap - 1e-9 and (not answer or len(answer & set(part)) >= overlap * len(answer) - 1e-9):
                    best = out.get(item, (0.0, 0.0))
                    out[item] = (max(best[0], score), max(best[1], shared))
        return out


def described(items: DataFrame) -> DataFrame:
    """items (item_id, question, answer) with a word and an id, each once: key, words, length (its terms) and its distinct terms."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = [(terms(q) + terms(a), len(f"{q} {a}".split())) for q, a in zip(b["question"], b["answer"], strict=True)]
            b = b.assign(length=[len(w) for w, _ in both], words=[n for _, n in both], terms=[sorted({t.decode() for t in w}) for w, _ in both])
            b = b[b["length"] > 0]
            if len(b):
                yield b

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    items = items.where("item_id is not null").select("item_id", text("question"), text("answer")).distinct().withColumn("key", F.monotonically_increasing_id())
    return items.mapInPandas(describe, f"item_id {items.schema['item_id'].dataType.simpleString()}, question string, answer string, key long, length long, words long, terms array<string>")


def indexes(items: DataFrame, max_terms: int = MAX_TERMS, **how) -> Iterator[Index]:
    """Shards of the index of items (item_id, question, answer) in item order, each of max_terms postings at most (or one item).

    How many items have a term is a grouped count over all items, joined back to the items' terms; the driver holds one shard.
    """
    items = stored(described(items), "items")
    n_items, length, longest = items.agg(F.count("*"), F.sum("length"), F.max("words")).first()
    if not n_items:
        return
    posts = items.select("key", F.explode("terms").alias("t"))
    counts = posts.groupBy("t").agg(F.count("*").alias("df"))
    of = posts.join(counts, "t").groupBy("key").agg(F.collect_list(F.struct("t", "df")).alias("dfs"))
    rows = stored(items.drop("terms").join(of, "key"), "postings").orderBy("item_id", "question", "answer")
    shard, df = [], {}

    def index() -> Index:
        return Index(shard, statistics=Statistics(df, n_items, length / n_items, longest), **how)

    room = max_terms
    for r in rows.toLocalIterator():
        if shard and len(r.dfs) > room:
            yield index()
            shard, df, room = [], {}, max_terms
        shard.append((r.item_id, r.question, r.answer))
        df.update((x.t.encode(), x.df) for x in r.dfs)
        room -= len(r.dfs)
    yield index()


def hits_column(index, overlap: float, kind: str = "bigint"):
    """Over text: the items of a broadcast index that it holds, as an array of (item_id, bm25, overlap); kind: the type of item ids."""

    @F.pandas_udf(f"array<struct<item_id: {kind}, bm25: double, overlap: double>>")
    def hits(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ix = index.value
        for x in texts:
            yield pd.Series([[{"item_id": ix.ids[i], "bm25": s, "overlap": o} for i, (s, o) in ix.hits(t, overlap).items()] for t in x], dtype=object)

    return hits(F.col("text"))


def usual_terms(docs: DataFrame, n_docs: int = SAMPLE) -> dict[bytes, int]:
    """How many of about n_docs sampled texts have each term, where two or more have: what is tried first, not what is found."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Counter()
        for b in batches:
            for t in b["text"]:
                seen.update(set(terms(t)))
        # An empty column would have no text type.
        if seen:
            yield pd.DataFrame({"t": [t.decode() for t in seen], "n": list(seen.values())})

    some = docs.select("text").where(F.rand(3) < n_docs / max(1, docs.count()))
    top = some.mapInPandas(count, "t string, n long").groupBy("t").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "t").limit(50_000)
    return {r.t.encode(): r.n for r in top.collect()}


def contaminated(docs: DataFrame, items: DataFrame, overlap: float = OVERLAP, **how) -> DataFrame:
    """The rows named above for docs (doc_id, text) and items (item_id, question, answer)."""
    spark, out = docs.sparkSession, None
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (items, "item_id"))]
    for index in indexes(items, usual=usual_terms(docs), **how):
        hits = hits_column(spark.sparkContext.broadcast(index), overlap, kinds[1])
        one = docs.select("doc_id", F.explode(hits).alias("h")).select("doc_id", "h.*")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], f"doc_id {kinds[0]}, item_id {kinds[1]}, bm25 double, overlap double")
    return out.groupBy("doc_id", "item_id").agg(F.max("bm25").alias("bm25"), F.max("overlap").alias("overlap"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """Items (item_id, question, answer) from (item_id, text): the text's last line is the answer if there are several lines, else there is none."""
    text = F.regexp_replace("text", r"\s+$", "")
    return benchmark.select("item_id", F.regexp_extract(text, r"^([\s\S]*?)(?:\n[^\n]*)?$", 1).alias("question"), F.regexp_extract(text, r"\n([^\n]*)$", 1).alias("answer"))


def drop_contaminated(docs: DataFrame, items: DataFrame, overlap: float = OVERLAP, **how) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    spark, keep = docs.sparkSession, None
    for index in indexes(items, usual=usual_terms(docs), **how):
        clean = F.size(hits_column(spark.sparkContext.broadcast(index), overlap, items.schema["item_id"].dataType.simpleString())) == 0
        keep = clean if keep is None else keep & clean
    return docs if keep is None else docs.where(keep)
