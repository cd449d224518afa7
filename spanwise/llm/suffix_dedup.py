"""Exact substring dedup with suffix arrays that are sorted in two stages.

Every byte that lies in a string of ``length`` bytes which also starts earlier (less id, or same id and earlier start) is removed.
A suffix array over all documents can't be held by one task, so strings that could be equal are brought together first:

1. A string's anchor is the least hash of its ``length // 4``-byte parts, so equal strings have equal anchors. Places in a row
   with one anchor are a run; a run of an average text has some 40 places. Runs travel as two hashes, of anchor and bytes, with
   their place, never as text. Of equal runs all but the first are removed: tasks settle those of their own rows before anything
   travels, and a window by anchor settles the rest.
2. Runs of an anchor that has runs of other bytes may share strings in part. Only their bytes travel, to the task of their anchor.
   It joins the bytes of whole anchors to blocks of bounded size and makes a block's suffix array: suffixes smaller than
   their successors are sorted directly, by ``length`` bytes; the others are induced by scanning buckets in order. Adjacent
   common prefixes of ``length`` or more tie equal strings, of which all but the first are removed.
3. An anchor with more than ``most`` different runs isn't gathered: its strings are counted one by one, by hash, in a grouped minimum.
4. Removed places meet their document, whose kept bytes are hashed.

Defined cases: a null text is empty; a text of fewer bytes is kept; documents alike in id and text are alike in result, as neither is
earlier; of rows alike in id only, earlier starts come first; null ids come before others. A text of any length is cut
into overlapping parts, so it is never a problem of memory but as the one row that it is. Empty tables give no rows. Only
doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.llm.common import stored

LENGTH = 100
#: Places of a run at most; bytes that are hashed at once; runs that a task holds at once; bytes of a block; runs of an anchor in a block.
RUN, CHUNK, HELD, BLOCK, MOST, SEEN = 127, 1 << 20, 1 << 20, 1 << 21, 20_000, 100_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)


def mixed(a: np.ndarray) -> np.ndarray:
    return (a ^ (a >> np.uint64(29))) * _MIX


def window_hash(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k bytes from each place on, by doubling."""
    part, size, out, done = _BYTE[data], 1, None, 0
    while True:
        if k & size:
            n = len(data) - done - size + 1
            out = part if out is None else mixed(out[:n]) + part[done : done + n]
            done += size
        if done == k:
            return mixed(out)
        part, size = mixed(part[:-size]) + part[size:], 2 * size


def over_windows(least_or_most: np.ufunc, x: np.ndarray, w: int) -> np.ndarray:
    """np.minimum or np.maximum of the w values from each place on, by doubling."""
    size = 1
    while 2 * size <= w:
        x, size = least_or_most(x[:-size], x[size:]), 2 * size
    return least_or_most(x[: len(x) - w + size], x[w - size :])


def runs(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of ``length`` bytes or more: part, start in it, number of places, whether strings may repeat inside, hash of anchor and hash of bytes of each run."""
    joined = b"".join(parts)
    size = np.array([len(p) for p in parts])
    at = np.cumsum(size) - size
    k = max(1, length // 4)
    w = length - k + 1
    hashed = window_hash(np.frombuffer(joined, np.uint8), k)
    anchor = over_windows(np.minimum, hashed, w)
    # A run ends where the anchor changes, where its part has no more places, and after RUN places.
    new = np.empty(len(anchor) + 1, bool)
    new[0], new[-1], new[1:-1] = True, True, anchor[1:] != anchor[:-1]
    new[at], new[at + size - length + 1] = True, True
    start = np.flatnonzero(new)
    n = np.diff(start)
    start = start[:-1]
    # Equal strings of one run hold the anchor at two places of it. A part is where an anchor is if it is the most that the anchors of
    # strings over it are; two such in a row with one hash mark all runs that could hold both.
    around = np.concatenate([np.zeros(w - 1, np.uint64), anchor, np.zeros(w - 1, np.uint64)])
    found = np.flatnonzero(hashed == over_windows(np.maximum, around, w))
    twice = np.flatnonzero(hashed[found[1:]] == hashed[found[:-1]])
    low, high = np.minimum(found[twice + 1] - w + 1, found[twice]), np.minimum(found[twice], len(anchor) - 1)
    marks = np.zeros(len(start) + 1, np.int64)
    np.add.at(marks, np.maximum(np.searchsorted(start, low, "right") - 1, 0), 1)
    np.add.at(marks, np.searchsorted(start, high, "right"), -1)
    inner = np.cumsum(marks)[:-1] > 0
    part = np.searchsorted(at, start, "right") - 1
    real = start - at[part] <= size[part] - length
    start, n, part, inner = start[real], n[real], part[real], inner[real]
    pieces = -(-n // RUN)
    step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start, n, part = np.repeat(start, pieces) + RUN * step, np.minimum(np.repeat(n, pieces) - RUN * step, RUN), np.repeat(part, pieces)
    inner = np.repeat(inner, pieces)
    view, digest = memoryview(joined), xxhash.xxh3_64_intdigest
    content = np.array([digest(view[a:b]) for a, b in zip(start.tolist(), (start + n + length - 1).tolist(), strict=True)], np.uint64)
    return part, start - at[part], n, inner, anchor[start], content


def small_suffixes(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that starts a byte later."""
    differs = np.flatnonzero(text[:-1] != text[1:])
    last = np.append(differs, len(text) - 1)
    rises = np.append(text[differs] < text[differs + 1], False)  # at the end, the successor is empty
    return np.repeat(rises, np.diff(np.append(-1, last)))


def _eight(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as numbers in their order."""
    return np.lib.stride_tricks.sliding_window_view(padded, 8)[at].view(">u8")[:, 0].astype(np.uint64)


def sorted_directly(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes or a few more: by 8 bytes, then ties by the next 8."""
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    key = _eight(padded, at)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    new = np.append(True, key[1:] != key[:-1])
    for done in range(8, depth, 8):
        tied = ~(new & np.append(new[1:], True))
        here = np.flatnonzero(tied)
        if not len(here):
            break
        group, key = np.cumsum(new[here]), _eight(padded, at[here] + done)
        order = np.lexsort((key, group))
        at[here] = at[here[order]]
        group, key = group[order], key[order]
        new[here] = np.append(True, (group[1:] != group[:-1]) | (key[1:] != key[:-1]))
    return at


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes in the order of their first ``depth`` bytes, in two stages.

    Suffixes smaller than their successors are sorted directly. The rest is induced: buckets, by first byte, are scanned in
    order; a suffix's predecessor that is larger than it goes to the next free place of its own bucket, ahead of the sorted ones.
    """
    if not len(text):
        return np.empty(0, np.int64)
    small = small_suffixes(text)
    sorted_ = sorted_directly(text, np.flatnonzero(small), depth)
    ends = np.cumsum(np.bincount(text[sorted_], minlength=256))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def scan(zone: np.ndarray, c: int) -> np.ndarray:
        """Puts the larger predecessors of a zone into their buckets; those of this very bucket are returned."""
        p = zone[zone > 0] - 1
        p = p[~small[p]]
        first = text[p]
        same, more = p[first == c], p[first != c]
        first = text[more]
        order = np.argsort(first, kind="stable")
        more, counts = more[order], np.bincount(first, minlength=256)
        for b, part in zip(np.flatnonzero(counts), np.split(more, np.cumsum(counts[counts > 0])[:-1]), strict=True) if len(more) else ():
            induced[b].append(part)
        return same

    induced[text[-1]].append(np.array([len(text) - 1]))  # the predecessor of the empty suffix
    for c in range(256):
        zone = np.concatenate(induced[c]) if induced[c] else np.empty(0, np.int64)
        while len(zone):
            out.append(zone)
            zone = scan(zone, c)
        direct = sorted_[ends[c - 1] if c else 0 : ends[c]]
        if len(direct):
            out.append(direct)
            scan(direct, c)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes, ``most`` at most, that each suffix shares with the one before it in an order; 0 for the first."""
    padded = np.concatenate([text, np.zeros(most + 16, np.uint8)])
    out = np.zeros(len(order), np.int64)
    here = np.arange(1, len(order))
    for done in range(0, most, 8):
        if not len(here):
            break
        x = _eight(padded, order[here] + done) ^ _eight(padded, order[here - 1] + done)
        out[here] = done + sum((x < np.uint64(1 << b)).astype(np.int64) for b in range(56, -1, -8))
        here = here[x == 0]
    rest = np.minimum(len(text) - order, most)
    out[1:] = np.minimum(out[1:], np.minimum(rest[1:], rest[:-1]))
    return out


def _ranks(ids: list) -> np.ndarray:
    """Of ids, null first, equal ones alike."""
    place = {x: r for r, x in enumerate(sorted({x for x in ids if x is not None}), 1)}
    return np.array([place.get(x, 0) for x in ids], np.int64)


def repeated_places(pieces: list[bytes], rank: np.ndarray, start: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of runs' bytes, with their documents' ranks, starts and numbers of places: (piece, first place in it, number) of strings that also start earlier."""
    text = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.array([len(p) for p in pieces])
    at = np.cumsum(size) - size
    piece = np.repeat(np.arange(len(pieces)), size)
    inside = np.arange(len(text)) - at[piece]
    order = suffix_array(text, length)
    order = order[inside[order] < n[piece[order]]]
    new = common_prefixes(text, order, length) < length
    where = (rank[piece[order]] << 32) + start[piece[order]] + inside[order]
    first = np.minimum.reduceat(where, np.flatnonzero(new))[np.cumsum(new) - 1] if len(order) else where
    hit = np.zeros(len(text) + 1, bool)
    hit[order[where > first]] = True
    edge = np.flatnonzero(np.diff(np.append(False, hit).astype(np.int8)))  # a piece's last bytes start no string, so no stretch passes its end
    a, b = edge[::2], edge[1::2]
    return piece[a], inside[a], b - a


# A place is packed: its start from bit 9, number of places from bit 2, whether strings may repeat inside, whether it is known to be repeated.
def _packed(start: np.ndarray, n: np.ndarray, inner: np.ndarray, known: np.ndarray) -> np.ndarray:
    return (start << 9) + (n << 2) + (inner.astype(np.int64) << 1) + known


def _start(place: str = "place") -> Column:
    return F.shiftright(place, 9)


def _number(place: str = "place") -> Column:
    return F.shiftright(place, 2).bitwiseAND(127)


def run_table(docs: DataFrame, length: int, held: int = HELD, chunk: int = CHUNK) -> DataFrame:
    """(anchor, content, doc_id, tid, place) of docs (doc_id, tid, text): runs, where equal runs of a task's rows show only the first; the others are known."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tids, got, size = [], [], [], 0
        parts, owner, base, room = [], [], [], chunk
        types = pa.null()

        def hash_parts() -> int:
            nonlocal room
            if not parts:
                return 0
            part, start, n, inner, a, h = runs(parts, length)
            got.append((np.array(owner)[part], start + np.array(base)[part], n, inner, a, h))
            parts.clear(), owner.clear(), base.clear()
            room = chunk
            return len(n)

        def sent() -> pa.RecordBatch:
            row, start, n, inner, a, h = (np.concatenate(x) for x in zip(*got, strict=True))
            where = (_ranks(ids)[row] << 32) + start
            by = np.lexsort((where, h, a))
            new = np.append(True, (a[by[1:]] != a[by[:-1]]) | (h[by[1:]] != h[by[:-1]]))
            first = where[by[np.flatnonzero(new)]][np.cumsum(new) - 1]
            known = np.empty(len(by), bool)
            known[by] = where[by] > first
            # A known run needs no partner: its key only deals it out.
            a = np.where(known, mixed(h + start.astype(np.uint64)), a)
            take = pa.array(row, pa.int64())
            cols = [pa.array(a.view(np.int64)), pa.array(h.view(np.int64)), pa.array(ids, types).take(take), pa.array(tids, pa.int64()).take(take), pa.array(_packed(start, n, inner, known))]
            out = pa.RecordBatch.from_arrays(cols, ["anchor", "content", "doc_id", "tid", "place"])
            ids.clear(), tids.clear(), got.clear()
            return out

        for b in batches:
            types = b.schema.field(0).type
            for i, tid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = text.encode() if text else b""
                if len(raw) < length:
                    continue
                ids.append(i), tids.append(tid)
                for s in range(0, len(raw) - length + 1, chunk):
                    p = raw[s : s + chunk + length - 1]
                    parts.append(p), owner.append(len(ids) - 1), base.append(s)
                    room -= len(p)
                    if room <= 0:
                        size += hash_parts()
                if size >= held:
                    hash_parts()
                    yield sent()
                    size = 0
        hash_parts()
        if got:
            yield sent()

    return docs.mapInArrow(cut, f"anchor long, content long, doc_id {kind}, tid long, place long")


def marked(table: DataFrame) -> DataFrame:
    """Runs that need a look: ``repeated`` ones, and the first of each content of anchors that have several (``kinds``), or that may repeat inside."""
    known = F.col("place").bitwiseAND(1) == 1
    same = Window.partitionBy("anchor", "content", "known").orderBy(F.asc_nulls_first("doc_id"), _start())
    # One exchange for all windows: all of an anchor is together.
    rows = table.repartition("anchor").withColumn("known", known).withColumn("later", F.rank().over(same) > 1).withColumn("one", F.row_number().over(same) == 1)
    rows = rows.withColumn("kinds", F.sum((F.col("one") & ~F.col("known")).cast("int")).over(Window.partitionBy("anchor")))
    repeated = F.col("known") | F.col("later")
    inner = F.col("place").bitwiseAND(2) == 2
    return rows.where(repeated | (F.col("one") & ((F.col("kinds") > 1) | inner))).select("doc_id", "tid", "anchor", "place", repeated.alias("repeated"), "kinds")


def pieces_of(wanted: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """(anchor, hot, doc_id, tid, start, n, bytes) of wanted runs (doc_id, tid, anchor, place, hot), cut from docs (doc_id, tid, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    lists = wanted.groupBy("doc_id", "tid").agg(F.collect_list(F.struct("anchor", "hot", "place")).alias("runs"))
    both = docs.alias("d").join(lists.alias("w"), _alike("d", "w")).select("d.doc_id", "d.tid", "d.text", "w.runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # rows alike in id and text are cut once by a task
        for b in batches:
            ids, tids, texts, lists = (b.column(k) for k in range(4))
            for at in range(0, b.num_rows, 256):
                row, out = [], []
                for r in range(at, min(at + 256, b.num_rows)):
                    if len(seen) > SEEN:
                        seen.clear()
                    if (key := (ids[r].as_py(), tids[r].as_py())) in seen:
                        continue
                    seen.add(key)
                    raw = texts[r].as_py().encode()
                    for x in lists[r].as_py():
                        start, n = x["place"] >> 9, x["place"] >> 2 & 127
                        out.append((x["anchor"], x["hot"], start, n, raw[start : start + n + length - 1]))
                        row.append(r)
                if row:
                    take, cols = pa.array(row, pa.int64()), list(zip(*out, strict=True))
                    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
                    a, hot, start, n, raw = (pa.array(c, k) for c, k in zip(cols, kinds, strict=True))
                    yield pa.RecordBatch.from_arrays([a, hot, ids.take(take), tids.take(take), start, n, raw], ["anchor", "hot", "doc_id", "tid", "start", "n", "bytes"])

    return both.mapInArrow(cut, f"anchor long, hot boolean, doc_id {kind}, tid long, start long, n long, bytes binary")


def _alike(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.tid") == F.col(f"{b}.tid"))


def repeats_in_blocks(pieces: DataFrame, length: int, block: int = BLOCK) -> DataFrame:
    """(doc_id, tid, start, n) of repeated places, by suffix arrays over blocks of whole anchors."""
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def result() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            start, n = t["start"].to_numpy(), t["n"].to_numpy()
            piece, inside, many = repeated_places(t["bytes"].to_pylist(), _ranks(t["doc_id"].to_pylist()), start, n, length)
            take = pa.array(piece, pa.int64())
            cols = [t["doc_id"].combine_chunks().take(take), t["tid"].combine_chunks().take(take), pa.array(start[piece] + inside, pa.int64()), pa.array(many, pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "tid", "start", "n"])

        size = 0
        for b in batches:
            anchor = b.column("anchor").to_numpy()
            cuts = [0, *(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1).tolist(), len(anchor)]
            weight = np.cumsum(np.append(0, pa.compute.binary_length(b.column("bytes")).to_numpy()))
            last, begun = (held[-1].column("anchor")[-1].as_py() if held else None), 0
            for a, z in zip(cuts, cuts[1:], strict=False):
                if size >= block and (a or anchor[0] != last):
                    if a > begun:
                        held.append(b.slice(begun, a - begun))
                    yield result()
                    held.clear()
                    size, begun = 0, a
                size += int(weight[z] - weight[a])
            if begun < b.num_rows:
                held.append(b.slice(begun))
        if held:
            yield result()

    return pieces.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(search, f"doc_id {kind}, tid long, start long, n long")


def repeats_one_by_one(pieces: DataFrame, length: int) -> DataFrame:
    """(doc_id, tid, start, n) of repeated places, n = 1, by a grouped minimum over the strings' hashes; for anchors with too many runs for a block."""
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, at, one, two = [], [], [], []
            for r, (start, n, raw) in enumerate(zip(b.column("start").to_pylist(), b.column("n").to_pylist(), b.column("bytes").to_pylist(), strict=True)):
                for k in range(n):
                    h = xxhash.xxh3_128_intdigest(raw[k : k + length])
                    row.append(r), at.append(start + k), one.append((h >> 64) - (1 << 63)), two.append((h & (1 << 64) - 1) - (1 << 63))
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64()), b.column("doc_id").take(take), b.column("tid").take(take), pa.array(at, pa.int64())], ["one", "two", "doc_id", "tid", "start"])

    rows = pieces.mapInArrow(strings, f"one long, two long, doc_id {kind}, tid long, start long")
    first = rows.groupBy("one", "two").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "start")).alias("first"), F.count("*").alias("many")).where("many > 1")
    later = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "start") > F.col("first")
    return rows.join(first, ["one", "two"]).where(later).select("doc_id", "tid", "start", F.lit(1).cast("long").alias("n"))


def removed(starts: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal stretches of bytes that repeated strings (start, n) cover."""
    out: list[list[int]] = []
    for a, b in sorted((x["start"], x["start"] + x["n"] + length - 1) for x in starts):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_strings(docs: DataFrame, length: int = LENGTH, most: int = MOST, block: int = BLOCK, **how) -> DataFrame:
    """(doc_id, tid, start, n): n places from start on whose strings also start earlier, over docs (doc_id, tid, text)."""
    marks = stored(marked(run_table(docs, length, **how)), "runs")
    settled = marks.where("repeated").select("doc_id", "tid", _start().alias("start"), _number().alias("n"))
    pieces = pieces_of(marks.where("not repeated").withColumn("hot", F.col("kinds") > most), docs, length)
    return settled.unionByName(repeats_in_blocks(pieces.where("not hot"), length, block)).unionByName(repeats_one_by_one(pieces.where("hot"), length))


def substring_dedup(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes as ``kept``."""
    docs = docs.select("doc_id", F.xxhash64("text").alias("tid"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = repeated_strings(docs, length, **how).groupBy("doc_id", "tid").agg(F.collect_list(F.struct("start", "n")).alias("starts"))
    both = docs.alias("d").join(spans.alias("s"), _alike("d", "s"), "left").select("d.doc_id", "d.text", "s.starts")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, many, sha, kept = [], [], [], [], []
            for text, starts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                out = removed(starts, length) if starts else []
                ends = [0, *(x for s in out for x in s), len(raw)]
                left = b"".join(raw[x:y] for x, y in zip(ends[::2], ends[1::2], strict=True))
                n.append(len(raw)), gone.append(len(raw) - len(left)), many.append(len(out)), sha.append(hashlib.sha256(left).hexdigest()), kept.append(left)
            long = pa.int64()
            cols = [b.column(0), pa.array(n, long), pa.array(gone, long), pa.array(many, long), pa.array(sha, pa.string()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return both.mapInArrow(keep, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
