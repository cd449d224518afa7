"""Near-duplicates by BagMinHash: weighted-Jaccard signatures of 5-word shingle multisets, bands, exact verification.

Signature. A shingle with count w owns the strip (0, w] of weights. On it lives a Poisson process of points with a
time, a weight and a register; it is built hierarchically over the discretised weights, in bands (0, 1], (1, 2],
(2, 4], ... whose processes depend on the shingle's hash alone, so that texts which share part of a strip share its
points. A register keeps the first point below its shingle's weight. Two registers agree with a probability equal to
the weighted Jaccard similarity sum(min) / sum(max). Points are drawn only up to a time that fills all registers, so
a text of n shingles costs about n + m log m draws, in numpy.

Classes. Texts with the same md5 are one node. Band buckets give candidates; in a bucket all are held against one
member b, the one with most bucket mates, so a bucket of any size gives as many pairs as members. Nothing is lost by
that: for x and y of the bucket, with I = overlap with b, overlap(x, y) is at most min(I_x, I_y) plus what x and y
share *beyond b*. If x isn't similar to b and y isn't smaller than b, the first part alone is too small for similarity.
So a link that the star misses needs a common shingle beyond b (or a y smaller than b, which is marked by a shingle of
its own). While a star has members of different components, those are grouped again by such shingles (of a text that
must share at least k of its r, the first r - k + 1 in hash order suffice), and each group is held against one member,
until no new pair turns up. All links are verified on the whole texts. Components of the links are the classes.

Result per row: doc_id, n_shingles, class_id (least doc_id of the class), class_rows, is_kept (one row of the class: that
of the least doc_id, null last, then of the least text hash, however the table is split into files).
Defined cases: a text of 1 to 4 words is one shingle of all of them; a null text or one without words is in no group:
its class_id is its own doc_id, class_rows 1, is_kept true. Rows with the same doc_id are rows of their own; a class
whose doc_ids are all null has class_id null. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import pair_components, stored, words

SHINGLE, SIMILARITY = 5, 0.8
ROWS, BANDS = 8, 44
#: Stands for "may be similar to a smaller text without sharing anything beyond the star's centre".
SMALLER = 0
#: Groups of so many texts are compared pair by pair: buckets, and the groups after them, which are fewer.
SMALL, LATER = 24, 64
#: So many shingles of a star's texts (32 MB), and so many lone pairs of a text, come together in one task; the text in the middle is sent once to each.
STAR, LONE = 1 << 22, 32

_U = np.uint64
#: The multipliers of the splitmix64 finaliser and its increment.
_M1, _M2, _STEP = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    x = x + _STEP
    x ^= x >> _U(30)
    x *= _M1
    x ^= x >> _U(27)
    x *= _M2
    x ^= x >> _U(31)
    return x


def shingles(text: str | None, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of a text's k-word shingles and their counts."""
    from xxhash import xxh3_64_intdigest

    w = words(text)
    if not w:
        return np.empty(0, _U), np.empty(0, np.int64)
    # Hashing a word takes less than looking it up in a large table of words.
    h = np.fromiter(map(xxh3_64_intdigest, w), _U, len(w))
    n = max(1, len(h) - k + 1)
    out = np.full(n, len(h) if len(h) < k else k, _U)
    for i in range(min(k, len(h))):
        out = mix64(out ^ h[i : i + n])
    return np.unique(out, return_counts=True)


def signature(h: np.ndarray, count: np.ndarray, m: int) -> np.ndarray:
    """m registers of 64 bits for the multiset with these shingle hashes and counts."""
    keys, length, low, weight = [h], [np.ones(len(h))], [np.zeros(len(h))], [count.astype(float)]
    j, top = 1, count.max()
    while (1 << (j - 1)) < top:
        more = count > (1 << (j - 1))
        keys.append(mix64(h[more] + _U(j)))
        length.append(np.full(more.sum(), float(1 << (j - 1))))
        low.append(length[-1])
        weight.append(count[more].astype(float))
        j += 1
    # Where no shingle is repeated, every point is below its shingle's weight.
    plain = top == 1
    key0, length0, low0, weight0 = (x[0] if plain else np.concatenate(x) for x in (keys, length, low, weight))
    end = (np.log(m) + 3) / count.sum()
    while True:
        key, length, low, weight = key0, length0, low0, weight0
        at, drawn = np.zeros(len(key)), 0
        times, ids = [], []
        while len(key):
            # So many points that hardly a key needs more to pass the end.
            some = m * float((length * (end - at)).mean())
            n = max(1, min(64, int(some + 4 * some**0.5 + 1)))
            r = mix64(key[:, None] + _STEP * np.arange(drawn + 1, drawn + n + 1, dtype=_U))
            t = ((r >> _U(11)).astype(float) + 0.5) / 2.0**53
            np.cumsum(np.log(t, out=t), axis=1, out=t)
            t /= -m * length[:, None]
            t += at[:, None]
            more, last = t[:, -1] <= end, t[:, -1].copy()
            # What is still of interest of a point is made for those before the end alone.
            where = np.flatnonzero(t.ravel() <= end)
            t, r2 = t.ravel()[where], mix64(r.ravel()[where] ^ _M1)
            if not plain:
                of = where // n
                hit = low[of] + length[of] * ((r2 & _U(0xFFFFFFFF)).astype(float) / 2.0**32) < weight[of]
                t, r2 = t[hit], r2[hit]
            times.append(t)
            ids.append(r2)
            key, at, length, low, weight, drawn = key[more], last[more], length[more], low[more], weight[more], drawn + n
        time, id_ = np.concatenate(times), np.concatenate(ids)
        reg = ((id_ >> _U(32)) % _U(m)).astype(np.int64)
        first = np.full(m, np.inf)
        np.minimum.at(first, reg, time)
        if np.isfinite(first).all():
            out, is_first = np.empty(m, _U), time == first[reg]
            out[reg[is_first]] = id_[is_first]
            return out
        end *= 1.5


def band_hashes(sigs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Hashes of the bands of many signatures, a row each."""
    out = np.tile(np.arange(bands, dtype=_U), (len(sigs), 1))
    for col in sigs.reshape(len(sigs), bands, rows).transpose(2, 0, 1):
        out = mix64(out ^ col)
    return out.astype(np.int64)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, np.ndarray]:
    """Sum of the lesser counts, and the hashes of b with as many entries as its count exceeds a's."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    mine = np.where(a[0][at] == b[0], a[1][at], 0)
    both = np.minimum(mine, b[1])
    return int(both.sum()), np.repeat(b[0], b[1] - both)


def signatures(docs: DataFrame, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """docs (doc_id, text) with key (md5 of the text), n (shingles) and bands (their hashes; null without words)."""

    @F.pandas_udf("n long, bands array<long>")
    def signed(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in texts:
            sizes, sigs = np.zeros(len(x), np.int64), []
            for i, t in enumerate(x):
                h, c = shingles(t)
                sizes[i] = c.sum()
                if len(h):
                    sigs.append(signature(h, c, rows * bands))
            made = iter(band_hashes(np.array(sigs, _U).reshape(-1, rows * bands), bands, rows))
            yield pd.DataFrame({"n": sizes, "bands": pd.Series([next(made) if n else None for n in sizes], dtype=object)})

    return docs.select("doc_id", F.md5("text").alias("key"), signed("text").alias("s")).select("doc_id", "key", "s.n", "s.bands")


def verify(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """pairs (a, b, least, k, total) with linked and, for the k texts of a star, the shingles that a further link of b must share.

    No text of the star a has fewer than ``least`` shingles, and all have ``total``. A star comes together in one task up to STAR shingles, and a
    shingle that only one of its texts has is left out there; of a larger star, each task gives all. k is 0 for a lone pair.
    The text of a goes once to each task that holds some of its pairs, ahead of them.
    """

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, left, star, out = None, None, [], []
        share = similarity / (1 + similarity)

        def closed() -> None:
            """Give out the star that has gathered."""
            if star and len(star) == star[0][5]:
                keys, n = np.unique(np.concatenate([x[3] for x in star]), return_counts=True)
                alone = keys[n == 1]
                star[:] = [(*x[:3], np.setdiff1d(x[3], alone, assume_unique=True), *x[4:]) for x in star]
            out.extend((a, b, linked, np.append(keys, SMALLER) if smaller else keys, k) for a, b, linked, keys, smaller, k in star)
            star.clear()

        for batch in batches:
            for a, lone, part, centre, b, least, k, text in zip(*(batch[c] for c in ("a", "lone", "part", "centre", "b", "least", "k", "text")), strict=True):
                if centre:
                    closed()
                    last, left = (a, lone, part), shingles(text)
                    na = int(left[1].sum())
                    continue
                assert last == (a, lone, part)
                right = shingles(text)
                nb = int(right[1].sum())
                both, beyond = overlap(left, right)
                linked = both >= similarity * (na + nb - both) - 1e-9
                if lone:
                    out.append((a, b, linked, np.empty(0, np.int64), 0))
                    continue
                must = int(np.ceil(share * (least + nb) - both - 1e-9))
                if not linked:
                    beyond = beyond[: max(0, len(beyond) - max(1, must) + 1)]
                star.append((a, b, linked, np.unique(beyond).astype(np.int64), nb < na or (must <= 0 and not linked), k))
            yield pd.DataFrame(out, columns=["a", "b", "linked", "beyond", "k"])
            out = []
        closed()
        yield pd.DataFrame(out, columns=["a", "b", "linked", "beyond", "k"])

    lone = F.col("k") == 0
    n_lone = pairs.where(lone).groupBy("a").agg(F.count("*").alias("_n"))
    size = F.when(lone, F.col("_n") / LONE).otherwise(F.col("total") / STAR)
    dealt = pairs.join(n_lone, "a", "left").select("a", lone.alias("lone"), F.pmod(F.xxhash64("b"), F.greatest(F.ceil(size), F.lit(1))).alias("part"), "b", "least", "k")
    text = texts.select("node", "text")
    members = dealt.withColumn("centre", F.lit(False)).join(text.withColumnRenamed("node", "b"), "b")
    centres = dealt.groupBy("a", "lone", "part").agg(F.max("least").alias("least"), F.max("k").alias("k")).withColumns({"centre": F.lit(True), "b": F.lit(0).cast("long")})
    order = ["a", "lone", "part", "centre", "b", "least", "k", "text"]
    both = members.select(order).unionByName(centres.join(text.withColumnRenamed("node", "a"), "a").select(order)).repartition("a", "lone", "part")
    both = both.sortWithinPartitions("a", "lone", "part", F.desc("centre"))
    return both.mapInPandas(held, "a long, b long, linked boolean, beyond array<long>, k long")


def near_classes(nodes: DataFrame, texts_of, similarity: float) -> DataFrame:
    """nodes (node, n, bands): rows (node, class_id) for all nodes that have a link. texts_of(nodes): (node, text)."""
    buckets = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1")
    live = stored(buckets.join(sizes, "bucket"), "buckets")
    members = stored(live.groupBy("node").agg(F.max("n").alias("n"), F.sum("k").alias("mates")), "members")
    texts = stored(texts_of(members.select("node")), "texts")
    facts = members.select(F.col("node").alias("b"), "n", "mates")
    groups, key, history, comps = live.select("bucket", "k", F.col("node").alias("b"), F.col("node").alias("c")), ["bucket"], None, None
    size, room = SMALL, 16 * members.count()
    while True:
        # Small groups: all their pairs at once, which ends them.
        small, large = groups.where(F.col("k") <= size), groups.where(F.col("k") > size)
        other = small.select(*key, F.col("b").alias("a"), F.col("c").alias("ca"))
        pairs = small.join(other, key).where("a < b and c <> ca").select("a", "b").distinct()
        # Large groups: a star around the member with the most mates. Its members rank below it, so stars end.
        facts_of = large.join(facts, "b")
        centre = facts_of.groupBy(*key).agg(F.max(F.struct("mates", -F.col("b"))).alias("top"), F.min("n").alias("least"))
        centre = centre.select(*key, (-F.col("top.col2")).alias("a"), "least")
        stars = large.join(centre, key).where("a <> b").groupBy("a", "b").agg(F.min("least").alias("least"))
        stars = stored(stars, "stars")
        size_of = stars.join(facts.select("b", "n"), "b").groupBy("a").agg(F.count("*").alias("k"), F.min("least").alias("least"), F.sum("n").alias("total"))
        asked = pairs.join(stars.select("a", "b"), ["a", "b"], "left_anti")
        if history is not None:
            asked = asked.join(history.select("a", "b"), ["a", "b"], "left_anti")
        asked = asked.select("a", "b", F.lit(0).cast("long").alias("least"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("total")).unionByName(stars.select("a", "b").join(size_of, "a"))
        found = stored(verify(stored(asked, "pairs"), texts, similarity), "verified")
        history = found if history is None else history.unionByName(found)
        links = found.where("linked").select("a", "b")
        if comps is not None:
            # Links within a component change nothing.
            of = comps.select(F.col("node").alias("a"), F.col("class_id").alias("ca"))
            links = links.join(of, "a", "left").join(of.toDF("b", "cb"), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
            links = stored(links, "links")
        if comps is None or not links.isEmpty():
            comps = stored(pair_components(history.where("linked").select("a", "b") if comps is None else comps.select(F.col("node").alias("a"), F.col("class_id").alias("b")).union(links)), "components")
        if stars.isEmpty():
            return comps
        # A star all of whose members are in one component has nothing more to find.
        of = comps.select(F.col("node").alias("b"), F.col("class_id").alias("c"))
        known = found.where("k > 0").drop("k").join(of, "b", "left").withColumn("c", F.coalesce("c", "b"))
        mixed = known.groupBy("a").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("a")
        # Dealt out by member before the shingles are told apart: a large star is spread over all tasks.
        rest = known.join(mixed, "a").repartition("a", "b").select(F.col("a").alias("star"), "b", "c", F.explode("beyond").alias("z"))
        split = rest.groupBy("star", "z").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("k")).where("lo <> hi").select("star", "z", "k")
        groups, key = stored(rest.join(split, ["star", "z"]), "groups"), ["star", "z"]
        # If all groups together have a few pairs for each text, none is large.
        n_pairs = groups.agg(F.sum((F.col("k") - 1) / 2)).first()[0] or 0
        size = (1 << 62) if n_pairs <= room else LATER


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """The columns named above for every row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    rows_ = stored(signatures(docs, rows, bands).withColumn("row", F.monotonically_increasing_id()), "signatures")
    full = rows_.where("bands is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    nodes = full.groupBy("key").agg(first.alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"))
    nodes = nodes.select("key", F.col("first.row").alias("node"), F.col("first.doc_id").alias("least"), "copies", "n")
    nodes = stored(nodes, "nodes")
    banded = full.select(F.col("row").alias("node"), "n", "bands").join(nodes.select("node"), "node", "left_semi")

    def texts_of(wanted: DataFrame) -> DataFrame:
        ids = full.select(F.col("row").alias("node"), F.col("doc_id").alias("_id"), "key").join(wanted, "node")
        there = docs.withColumn("key", F.md5("text"))
        same = (there["key"] == ids["key"]) & there["doc_id"].eqNullSafe(ids["_id"])
        return there.join(ids, same).select("node", "text").dropDuplicates(["node"])

    comps = near_classes(banded, texts_of, similarity)
    classed = nodes.join(comps, "node", "left").withColumn("class", F.coalesce("class_id", "node")).drop("class_id")
    best = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "key", "node"))["node"]
    sums = classed.groupBy("class").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_rows"), best.alias("kept"))
    # One row stays: the first row of the class's first node.
    of_key = classed.select("key", "node", "class").join(sums, "class")
    out = rows_.join(of_key, "key", "left")
    alone = F.col("bands").isNull()
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_rows")).cast("long").alias("class_rows"),
        (alone | (F.col("row") == F.col("kept"))).alias("is_kept"),
        "key",
    )


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """docs with one row of each class, all columns kept. Of rows alike in doc_id and text one stays."""
    # A row travels as one column, so no name of its own can clash.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row_"), "doc_id", F.coalesce(F.md5("text"), F.lit("")).alias("_key_"))
    found = near_duplicates(docs.select("doc_id", "text"), **how).withColumn("_key2_", F.coalesce("key", F.lit("")))
    kept = found.groupBy(F.col("doc_id").alias("_doc_"), "_key2_").agg(F.max(F.col("is_kept").cast("int")).alias("_kept_"), F.count("*").alias("_times_"), F.max("n_shingles").alias("_n_")).where("_kept_ = 1")
    kept = stored(kept, "kept")

    def those(which) -> DataFrame:
        k = kept.where(which)
        return rows.join(k, rows["doc_id"].eqNullSafe(k["_doc_"]) & (rows["_key_"] == k["_key2_"]), "left_semi")

    again = (F.col("_times_") > 1) & (F.col("_n_") > 0)
    out = those(F.lit(True)) if kept.where(again).isEmpty() else those(~again).unionByName(those(again).dropDuplicates(["doc_id", "_key_"]))
    return out.select(*(F.col(f"_row_.`{c}`").alias(c) for c in docs.columns))
