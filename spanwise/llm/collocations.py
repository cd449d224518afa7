"""Phrase collocations by level-wise (Apriori) passes.

A phrase is 2 to ``longest`` words in a row of one piece of a text; its language is the document's, and everything is counted by
language. Pass 1 counts words. Texts are then coded once: a frequent word becomes a 64-bit code, all else, ends of pieces too, a gap that no
frequent phrase can hold. Pass k counts phrases of k words: it is given which phrases of k - 1 words are frequent, and emits one of
k words only where both of its overlapping parts are. Cutting a frequent phrase in two gives frequent parts, so all that the
scores need stands in the tables of the levels.

A pass emits hashes with counts, in parts; hashes whose sum is large enough are candidates, and the next pass counts these again by
their words, so no two phrases are ever taken for one. What is broadcast is a bitmap over hashes, built where they are, of at most 2**28 bits
whatever their number: a bit that two phrases share may let a phrase be counted in vain, and its exact count then tells. Scores
are whole numbers of up to 38 digits, so they are exact.

Defined cases: a null or empty text has no piece; a null language is ``und``, and so counts with documents that say ``und``;
repeated rows count each; a text of any length counts whole. Ties go to higher counts, then to the phrase that is first in the
order of UTF-8 bytes. Empty tables give no rows. Only lang and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.llm.common import stored

LEAST, LONGEST, TOP = 100, 5, 2000
#: Words that are hashed at once; entries that a task holds before it sends them; words whose codes a worker keeps.
CHUNK, FLUSH, WORDS = 1 << 20, 1 << 20, 400_000
#: Bits for each frequent phrase, and the binary logarithm of most of all.
SPARSE, MOST_BITS, SEGMENT_BITS = 64, 28, 20
#: What ends a piece becomes a byte that UTF-8 never has; a tab is a space.
ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\xff" * 10 + b" ")
BLANKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b" " * 11)
UNKNOWN, SALT = "und", 64

_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def code_of(word: bytes) -> int:
    """64 bits, never 0."""
    return xxhash.xxh3_64_intdigest(word) | 1


def seed_of(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode())


def hashes(codes: np.ndarray, k: int, seeds: np.ndarray) -> np.ndarray:
    """Of k words from each place on, with the language's seed there."""
    h = seeds[: max(0, len(codes) - k + 1)]
    for j in range(k):
        h = (h ^ (h >> _STEP)) * _MIX + codes[j : j + len(h)]
    return (h ^ (h >> _STEP)) * _MIX


class Frequent:
    """A bitmap over hashes: whether a phrase may be frequent."""

    def __init__(self, bits: int, data: np.ndarray):
        self.shift, self.data = np.uint64(64 - bits), data

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> self.shift
        return (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def frequent_bits(rows: DataFrame) -> Frequent:
    """The bitmap of a column ``hash``: segments of 2**20 bits at most are put together by group, and there are 2**8 of them at most."""
    bits = min(MOST_BITS, max(16, (SPARSE * rows.count()).bit_length()))
    low = min(bits, SEGMENT_BITS)

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        plane = np.zeros(1 << low, bool)
        plane[group["bit"].to_numpy()] = True
        return pd.DataFrame({"segment": [group["segment"].iloc[0]], "data": [np.packbits(plane, bitorder="little").tobytes()]})

    at = F.shiftrightunsigned("hash", 64 - bits)
    places = rows.select(F.shiftrightunsigned(at, low).alias("segment"), at.bitwiseAND((1 << low) - 1).cast("int").alias("bit")).distinct()
    data = np.zeros(1 << (bits - 3), np.uint8)
    for r in places.groupBy("segment").applyInPandas(pack, "segment long, data binary").collect():  # 32 MB in all
        data[r.segment << (low - 3) : (r.segment + 1) << (low - 3)] = np.frombuffer(r.data, np.uint8)
    return Frequent(bits, data)


def _langs_and_texts(b: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """Languages and texts in lower case."""
    for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
        if text:
            yield lang, text.encode().lower()


def word_counts(docs: DataFrame, flush: int = FLUSH) -> DataFrame:
    """(lang, word, n): n in parts, over docs (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, Counter] = {}

        def sent() -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, own in sums.items() for w, n in own.items()]
            sums.clear()
            return pa.RecordBatch.from_pydict({"lang": pa.array([r[0] for r in rows], pa.string()), "word": pa.array([r[1] for r in rows], pa.binary()).cast(pa.string()), "n": pa.array([r[2] for r in rows], pa.int64())})

        for b in batches:
            for k, (lang, text) in enumerate(_langs_and_texts(b)):
                sums.setdefault(lang, Counter()).update(text.translate(BLANKS).split())
                if k % 100 == 0 and sum(map(len, sums.values())) >= flush:
                    yield sent()
        yield sent()

    return docs.mapInArrow(count, "lang string, word string, n long")


class Codes:
    """Words of a language to their codes, or to 0 if they aren't frequent; the end of a piece is 0, too. Kept for a bounded number of words; new ones are looked up together."""

    def __init__(self, lang: str, words: Frequent):
        self.lang, self.words, self.known = lang, words, {b"\xff": 0}

    def of(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        known = self.known
        if len(known) > WORDS:
            known = self.known = {b"\xff": 0}
        if new := list(set().union(*texts).difference(known)):
            codes = np.fromiter(map(code_of, new), np.uint64, len(new))
            codes[~self.words.has(hashes(codes, 1, np.full(len(new), seed_of(self.lang), np.uint64)))] = 0
            known.update(zip(new, codes.tolist(), strict=True))
        return [np.fromiter(map(known.__getitem__, w), np.uint64, len(w)) for w in texts]


def coded(docs: DataFrame, words: Frequent) -> DataFrame:
    """(lang, codes): each text of docs (lang, text) with a frequent word, as codes with gaps."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Codes] = {}
        held: dict[str, list[list[bytes]]] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                if len(known) > 200:
                    known.clear()
                rows = [c for c in known.setdefault(lang, Codes(lang, shared.value)).of(texts) if c.any()]
                if rows:
                    yield _coded_batch([lang] * len(rows), rows)
            held.clear()

        size = 0
        for b in batches:
            for lang, text in _langs_and_texts(b):
                held.setdefault(lang, []).append(text.translate(ENDS).replace(b"\xff", b" \xff ").split())
                size += len(text)
                if size > CHUNK:
                    yield from sent()
                    size = 0
        yield from sent()

    return docs.mapInArrow(encode, "lang string, codes array<bigint>")


def _coded_batch(langs: list[str], rows: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows).view(np.int64)))], ["lang", "codes"])


def stretches(b: pa.RecordBatch, chunk: int) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """Coded texts in parts of about ``chunk`` words, whole texts each: their languages, codes with a gap after each text, seeds, and whose text a place is in."""
    lists = b.column(1)
    offsets, values, langs = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64), b.column(0).to_pylist()
    a = 0
    while a < b.num_rows:
        z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + chunk, "right")) - 1)
        size = np.diff(offsets[a : z + 1])
        doc = np.repeat(np.arange(z - a), size + 1)
        codes = np.zeros(len(doc), np.uint64)
        codes[np.arange(offsets[z] - offsets[a]) + np.repeat(np.arange(z - a), size)] = values[offsets[a] : offsets[z]]
        yield langs[a:z], codes, np.array([seed_of(x) for x in langs[a:z]], np.uint64)[doc], doc
        a = z


def level_pass(texts: DataFrame, k: int, before: Frequent | None, emit: bool = True, chunk: int = CHUNK, flush: int = FLUSH) -> DataFrame:
    """(hash, lang, codes, n) over coded texts: phrases of k words by hash (codes null; none if not emit), and candidates of k - 1 words by their codes (hash 0)."""
    shared = texts.sparkSession.sparkContext.broadcast(before)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, hashed, held, exact = shared.value, [], 0, Counter()

        def sent() -> Iterator[pa.RecordBatch]:
            if hashed:
                h, n = (np.concatenate(x) for x in zip(*hashed, strict=True))
                order = np.argsort(h)
                h, n = h[order], n[order]
                first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                yield _pass_rows(h[first].view(np.int64), np.add.reduceat(n, first), None, None)
                hashed.clear()
            if exact:
                yield _pass_rows(np.zeros(len(exact), np.int64), list(exact.values()), [x for x, _ in exact], [x for _, x in exact])
                exact.clear()

        for b in batches:
            for langs, codes, seeds, doc in stretches(b, chunk):
                gaps = np.concatenate([[0], np.cumsum(codes == 0)])
                whole = lambda m: gaps[m:] == gaps[: len(gaps) - m]  # noqa: B023,E731
                keep = whole(k)
                if before is not None:
                    part = hashes(codes, k - 1, seeds)
                    may = before.has(part) & whole(k - 1)
                    keep = keep & may[:-1] & may[1:]
                    at = np.flatnonzero(may)
                    _, first, n = np.unique(part[at], return_index=True, return_counts=True)
                    for p, c in zip(at[first].tolist(), n.tolist(), strict=True):
                        exact[langs[doc[p]], codes[p : p + k - 1].tobytes()] += c
                if emit:
                    h, n = np.unique(hashes(codes, k, seeds)[keep], return_counts=True)
                    if len(h):
                        hashed.append((h, n))
                        held += len(h)
                if held >= flush or len(exact) >= flush:
                    yield from sent()
                    held = 0
        yield from sent()

    return texts.mapInArrow(count, "hash long, lang string, codes binary, n long")


def _pass_rows(h, n, langs, codes) -> pa.RecordBatch:
    null = lambda kind: pa.nulls(len(n), kind)
    return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), null(pa.string()) if langs is None else pa.array(langs, pa.string()), null(pa.binary()) if codes is None else pa.array(codes, pa.binary()), pa.array(n, pa.int64())], ["hash", "lang", "codes", "n"])


def with_codes(words: DataFrame) -> DataFrame:
    """words (lang, phrase, f) with their code, and their hash as phrases of one word."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = np.array([code_of(w.encode()) for w in b.column(1).to_pylist()], np.uint64)
            h = hashes(codes, 1, np.array([seed_of(x) for x in b.column(0).to_pylist()], np.uint64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes.view(np.int64)), pa.array(h.view(np.int64))], ["lang", "phrase", "f", "code", "hash"])

    return words.select("lang", "phrase", "f").mapInArrow(add, "lang string, phrase string, f long, code long, hash long")


def spelled(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, f) of phrases (lang, codes, f) by words (lang, phrase, code)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
            take = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            place = np.concatenate([np.arange(len(x)) for x in lists]) if lists else np.empty(0, np.int64)
            code = np.concatenate(lists) if lists else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(take, pa.int64())) for c in b.columns), pa.array(place, pa.int64()), pa.array(code, pa.int64())], ["lang", "codes", "f", "place", "code"])

    rows = phrases.select("lang", "codes", "f").mapInArrow(each, "lang string, codes binary, f long, place long, code long")
    rows = rows.join(words.select("lang", "code", F.col("phrase").alias("word")), ["lang", "code"])
    lists = rows.groupBy("lang", "codes", "f").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w"))
    return lists.select("lang", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("phrase"), "f")


def levels(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, **how) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) of all words, and for each number of words the frequent phrases (lang, phrase, f)."""
    docs = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    every = stored(word_counts(docs).groupBy("lang", F.col("word").alias("phrase")).agg(F.sum("n").alias("f")), "words")
    total = stored(every.groupBy("lang").agg(F.sum("f").alias("n")), "total")
    words = stored(with_codes(every.where(F.col("f") >= least)), "level1")
    texts, out, before = stored(coded(docs, frequent_bits(words)), "coded"), [words.select("lang", "phrase", "f")], None
    for k in range(2, longest + 2):
        rows = level_pass(texts, k, before, k <= longest, **how).groupBy("hash", "lang", "codes").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        rows = stored(rows, f"level{k}")
        if k > 2:
            out.append(stored(spelled(rows.where("codes is not null"), words), f"phrases{k - 1}"))
        before = frequent_bits(rows.where("codes is null").select("hash"))
    return total, out


def _cut(phrase: str, first, n) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, n), " ")


def scored(total: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of every phrase of two or more words: of its lowest-scoring cut, ties to the earliest."""
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    words = F.size(F.split("phrase", " "))
    many = every.select("lang", "phrase", words.alias("words"), F.col("f").alias("a")).where("words > 1")
    cuts = many.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.select("*", _cut("phrase", F.lit(1), F.col("cut")).alias("one"), _cut("phrase", F.col("cut") + 1, F.col("words") - F.col("cut")).alias("two"))
    part = lambda name, value: every.select("lang", F.col("phrase").alias(name), F.col("f").alias(value))
    cuts = cuts.join(part("one", "l"), ["lang", "one"]).join(part("two", "r"), ["lang", "two"]).join(total, "lang")
    big = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"(1000 * {big('a')} * {big('n')}) div ({big('l')} * {big('r')})")
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r", "words", "a", "n")).alias("x"))
    return best.select("lang", "phrase", "x.words", "x.a", "x.l", "x.r", "x.n", "x.score")


def without_parts(phrases: DataFrame, percent: int = 100) -> DataFrame:
    """Phrases but those that lie inside a longer one which is there ``percent`` or more times in a hundred of theirs."""
    inner = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), s -> array_join(slice(split(phrase, ' '), s, m), ' '))))")
    inside = phrases.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return phrases.join(inside, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {percent} * a").drop("longer")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, percent: int = 100, top: int = TOP, **how) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` of docs (lang, text).

    Parts of a language are ranked first, so its phrases never meet in one task.
    """
    left = without_parts(scored(*levels(docs, least, longest, **how)), percent)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALT))
    left = left.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
