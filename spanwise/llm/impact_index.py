"""Ranked lexical search with a bit-sliced impact index.

The impact of a term in a document is the whole number that it adds to a score: its weight times its saturated frequency. Each
task takes the documents of its partition in blocks. In a block, a term's impacts are slices: slice i is a bitmap with a bit for
every document whose impact has bit i set. A query's scores are the sum of its terms' slices by bitwise carry arithmetic over all
documents of the block at once. The best k are found by walking the sum's slices from the most significant one down: those with
the bit set come first if they are few enough, else they are all that stays in question. Ties at the end go to the least ids,
which are the lowest bits, as a block is in the order of ids.

Two passes over the documents: statistics (documents, terms, and in how many documents each term of the queries occurs), then
blocks and search. Queries are broadcast in shards of at most ``max_terms`` terms; a shard is one such pair of passes. A task sends its
best k of each query only. Where there are many documents, a hashed sample of them is searched first: its k-th score is a lower
bound for the k-th of all, so tasks needn't send what lies below it. That changes no result.

Defined cases: a text without terms (null, empty) is no document; a query without terms, or one whose terms are nowhere, has no
rows. Documents alike in id are each ranked, null ids after others. Equal rows of queries count once; queries alike in id
only are each answered. Very long texts are one document. Empty tables give no rows. Only the named columns are read, so
others may have any name.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP, BLOCK = 20, 16_384
MAX_TERMS, SAMPLE = 200_000, 20_000
#: Terms are runs of ASCII letters and digits and of anything beyond ASCII; in UTF-8, these bytes after lower-casing A-Z.
found_terms = re.compile(rb"[0-9a-z\x80-\xff]+").findall


def terms(text: str | None) -> list[bytes]:
    return found_terms(text.encode().lower()) if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norm(n: int, n_docs: int, n_terms: int) -> int:
    """75 and a quarter of the document's length in per cent of the mean."""
    return 75 + 25 * n * n_docs // n_terms


def sliced(docs: np.ndarray, values: np.ndarray, size: int) -> list[int]:
    """Bitmaps, least significant first, of the values that documents (below ``size``) have."""
    bits = int(values.max()).bit_length()
    plane = np.zeros((bits, size), bool)
    plane[:, docs] = (values >> np.arange(bits)[:, None]) & 1
    return [int.from_bytes(row.tobytes(), "little") for row in np.packbits(plane, axis=1, bitorder="little")]


def add(total: list[int], more: list[int], shift: int = 0) -> None:
    """total += more << shift, for all documents at once: a ripple-carry adder over bitmaps."""
    total.extend([0] * (len(more) + shift - len(total)))
    carry = 0
    for i, b in enumerate(more, shift):
        a = total[i]
        x = a ^ b
        total[i] = x ^ carry
        carry = a & b | carry & x
    i = len(more) + shift
    while carry:
        if i == len(total):
            total.append(0)
        total[i], carry = total[i] ^ carry, total[i] & carry
        i += 1


def best(total: list[int], k: int) -> list[int]:
    """The k documents of the greatest sums above 0, ties to the lowest; in order of number."""
    inside, maybe = 0, 0
    for s in total:
        maybe |= s
    for s in reversed(total):
        if inside.bit_count() + maybe.bit_count() <= k:
            break
        more = inside | (maybe & s)
        n = more.bit_count()
        if n > k:
            maybe &= s
        else:
            inside, maybe = more, maybe & ~s
            if n == k:
                maybe = 0
    out = _members(inside)
    while maybe and len(out) < k:
        low = maybe & -maybe
        out.append(low.bit_length() - 1)
        maybe ^= low
    return sorted(out)


def _members(bitmap: int) -> list[int]:
    out = []
    while bitmap:
        low = bitmap & -bitmap
        out.append(low.bit_length() - 1)
        bitmap ^= low
    return out


class Block:
    """Postings of up to ``size`` documents. Slices of a term are made when a query first asks for it."""

    def __init__(self, ids: list, docs: np.ndarray, term: np.ndarray, impact: np.ndarray):
        # Bits in the order of ids, so that the lowest bit wins a tie.
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids = [ids[i] for i in order]
        by = np.argsort(term, kind="stable")
        self.docs, self.impact = place[docs[by]], impact[by]
        self.term, self.start = np.unique(term[by], return_index=True)
        self.end = np.append(self.start[1:], len(by))
        self.at = {int(t): i for i, t in enumerate(self.term)}
        self.slices: dict[int, list[int]] = {}

    def of(self, term: int) -> list[int]:
        """A term's slices; none where no document of the block has it."""
        i = self.at.get(term)
        if i is None:
            return []
        if term not in self.slices:
            a, b = self.start[i], self.end[i]
            self.slices[term] = sliced(self.docs[a:b], self.impact[a:b], len(self.ids)) if self.impact[a:b].any() else []
        return self.slices[term]

    def search(self, query: dict[int, int], k: int) -> list[tuple[int, object]]:
        """(score, id) of the best k for the terms of a query and how often it repeats each."""
        total: list[int] = []
        for t, times in query.items():
            if s := self.of(t):
                for shift in range(times.bit_length()):
                    if times >> shift & 1:
                        add(total, s, shift)
        return [(sum((s >> d & 1) << i for i, s in enumerate(total)), self.ids[d]) for d in best(total, k)]


class Statistics:
    def __init__(self, n_docs: int, n_terms: int, df: dict[int, int]):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weight = {t: weight(n_docs, n) for t, n in df.items()}


def statistics(docs: DataFrame, number: dict[bytes, int]) -> Statistics:
    """Over all documents: their number, their terms, and in how many each numbered term is. A task sends one row for each of these."""
    known = docs.sparkSession.sparkContext.broadcast(number)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, df, n_docs, n_terms = known.value, Counter(), 0, 0
        for b in batches:
            for text in b.column(0).to_pylist():
                if t := terms(text):
                    n_docs, n_terms = n_docs + 1, n_terms + len(t)
                    df.update(get.keys() & set(t))
        rows = [(-1, n_docs), (-2, n_terms), *((get[t], n) for t, n in df.items())]
        yield pa.RecordBatch.from_pydict({"term": pa.array([t for t, _ in rows], pa.int64()), "n": pa.array([n for _, n in rows], pa.int64())})

    rows = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n = {r.term: r.n for r in rows}
    return Statistics(n.pop(-1, 0), n.pop(-2, 0), n)


def postings(b: pa.RecordBatch, number: dict[bytes, int], stats: Statistics) -> Iterator[tuple[object, list[int], list[int]]]:
    """(id, numbered terms, impacts) of each document of (doc_id, text) with such a term."""
    for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
        t = terms(text)
        if not t:
            continue
        tf = Counter(map(number.get, t))
        tf.pop(None, None)
        if tf:
            m = 12 * length_norm(len(t), stats.n_docs, stats.n_terms)
            yield i, list(tf), [stats.weight[x] * (1_000_000_000 * f // (1000 * f + m)) for x, f in tf.items()]


def blocks(batches: Iterator[pa.RecordBatch], number: dict[bytes, int], stats: Statistics, size: int = BLOCK) -> Iterator[Block]:
    ids, docs, term, impact = [], [], [], []
    for b in batches:
        for i, t, v in postings(b, number, stats):
            docs += [len(ids)] * len(t)
            term += t
            impact += v
            ids.append(i)
            if len(ids) == size:
                yield Block(ids, np.array(docs), np.array(term), np.array(impact))
                ids, docs, term, impact = [], [], [], []
    if ids:
        yield Block(ids, np.array(docs), np.array(term), np.array(impact))


def found(docs: DataFrame, queries: list[dict[int, int]], number: dict[bytes, int], stats: Statistics, k: int, least: list[int], size: int) -> DataFrame:
    """(query, doc_id, score): each task's best k for each query, where their score is no less than the query's bound."""
    shared = docs.sparkSession.sparkContext.broadcast((queries, number, stats, least))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"query int, doc_id {kind}, score long"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, number, stats, least = shared.value
        top: list[list] = [[] for _ in queries]
        id_type = None

        def typed(batches):
            nonlocal id_type
            for b in batches:
                id_type = b.schema.field(0).type
                yield b

        for block in blocks(typed(batches), number, stats, size):
            for q, query in enumerate(queries):
                hits = block.search(query, k)
                if hits:
                    top[q] = heapq.nsmallest(k, top[q] + [h for h in hits if h[0] >= least[q]], key=lambda h: (-h[0], h[1] is None, h[1]))
        rows = [(q, i, s) for q, hits in enumerate(top) for s, i in hits]
        if rows:
            yield pa.RecordBatch.from_pydict({"query": pa.array([r[0] for r in rows], pa.int32()), "doc_id": pa.array([r[1] for r in rows], id_type), "score": pa.array([r[2] for r in rows], pa.int64())})

    return docs.select("doc_id", "text").mapInArrow(search, schema)


def top_of(rows: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def shards(queries: DataFrame, max_terms: int) -> Iterator[list[tuple[object, Counter]]]:
    """Queries (item_id, text) with their terms, of at most max_terms distinct terms a shard (or one query)."""
    out, room = [], max_terms
    for r in queries.select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        t = Counter(terms(r.text))
        if not t:
            continue
        if out and len(t) > room:
            yield out
            out, room = [], max_terms
        out.append((r.item_id, t))
        room -= len(t)
    if out:
        yield out


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = TOP, max_terms: int = MAX_TERMS, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(item_id, rank, doc_id, score): the best k of docs (doc_id, text) for each row of queries (item_id, text)."""
    spark, out = docs.sparkSession, None
    item, kind = queries.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    for shard in shards(queries, max_terms):
        number = {t: i for i, t in enumerate(dict.fromkeys(t for _, q in shard for t in q))}
        stats = statistics(docs, number)
        if not stats.n_docs:
            break
        asked = [{number[t]: n for t, n in q.items()} for _, q in shard]
        least = [1] * len(asked)
        if stats.n_docs > 50 * sample:
            share = int(sample / stats.n_docs * (1 << 40)) + 1
            some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 40)) < share)
            bound = top_of(found(some, asked, number, stats, k, least, block), k).where(F.col("rank") == k)
            for r in bound.select("query", "score").collect():  # a row for each query of the shard at most
                least[r.query] = r.score
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(shard)], f"query int, item_id {item}")
        one = top_of(found(docs, asked, number, stats, k, least, block), k).join(F.broadcast(names), "query")  # the shard's queries
        one = one.select("item_id", "rank", "doc_id", "score")
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], f"item_id {item}, rank int, doc_id {kind}, score long") if out is None else out
