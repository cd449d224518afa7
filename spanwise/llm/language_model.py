"""LM scoring by a log-bilinear model, trained in numpy with noise-contrastive estimation.

Tokens. Words in lower case (A-Z), then one end per text. A word's probability has up to three factors:

1. its output: one of the ``n_words`` most frequent training words, or one of ``CLASSES`` classes of all other words, by a
   hash of a word's last two bytes;
2. within a class, its unit: one of the class's words with a vector of their own, or the class's rest. How many words
   have vectors grows with the corpus, as VECTORS_PER_ROOT times the root of its training tokens, which is about how
   vocabularies grow, up to ``table_size``, the bound of what workers hold;
3. within the rest, its share (c + 0.5) / (C + 0.5 (V + 1)) of the rest's counts, which cover the whole corpus. So every
   word, seen or not, has a probability, and all of them add up to 1.

Model. For the two tokens before, q = r1 * R[w1] + r2 * R[w2] (position vectors r) and the score of an output w is
q . Q[w] + b[w]; the score of a unit u is (g * R[w1]) . U[u] + d[u]. Training tells each token from noise: outputs from noise drawn
from the unigram distribution (shared by a mini-batch, so that all is matrix products), units from noise of their own
class; normalisers are taken as 1.

Training covers all training texts, in ``rounds`` over disjoint parts of them. In a round every run of tasks starts from the
parameters that the round before left, and the runs' rows are averaged, weighted by how often a run saw the row, so
rare words aren't diluted by runs that lack them. Rows are summed by slots of ``SLOT`` rows, so neither tasks nor the
driver get more than one model; a run has RUN_ROWS tokens a row or more, so that models are small beside the texts.

Scoring is normalised exactly. exp of a sum factors, so the normalisers of all pairs of contexts are one matrix
product, Z = exp(S1) (exp(S2 + b))' with S1 = (r1 * R) Q' and S2 = (r2 * R) Q'; those of units are sums over each class.
A worker builds both once, block by block.

Counts. Training and total counts of all words are summed over the corpus and stay a distributed table. Workers get
the ``table_size`` most frequent words by total count, as hashes; other words of a text are joined with the table. So no hot
word is ever a join key, and the broadcast doesn't grow.

Defined cases: a null text is the empty one, just an end; null ids belong to the fold of the empty string; without
training texts c = N = V = 0, and the model is uniform over its outputs. Rows alike are scored each. Reruns over the same
files agree; other splits of the files train in other runs, so ``score`` moves a little.
"""

from __future__ import annotations

import copy
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import fold, stored, words

N_WORDS, CLASSES, DIM = 1790, 255, 24
VECTORS_PER_ROOT = 4
TABLE_SIZE = 1 << 18
NOISE, UNIT_NOISE, BATCH, RATE, SEED, ROUNDS = 32, 3, 4096, 0.1, 5, 4
#: The end has no bytes, as no word has; BOS only occurs as a context.
BOS, END = 0, 1
SLOT, RUN_ROWS = 1024, 40
FREQUENT = 1 << 16


def suffix_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


class Codes:
    """Words to their places in the table; a word that the table lacks to -1 - its class.

    The first words of the table, which most tokens are, are a dict; the others are looked up together, by their 64-bit hashes in
    two arrays: a dict of all words would be several times larger.
    """

    def __init__(self, frequent: bytes, hashes: np.ndarray, places: np.ndarray):
        self.frequent = {w: k for k, w in enumerate(frequent.split(b" "))} if frequent else {}
        self.hashes, self.places = hashes, places

    def __call__(self, tokens: list[bytes]) -> np.ndarray:
        import xxhash

        get = self.frequent.get
        out = np.array([get(w, -1) for w in tokens], np.int64)
        rare = np.flatnonzero(out < 0)
        if len(rare):
            missed = [tokens[i] for i in rare.tolist()]
            h = np.array([xxhash.xxh3_64_intdigest(w) for w in missed], np.uint64)
            at = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
            found = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)
            out[rare[found]] = self.places[at[found]]
            out[rare[~found]] = [-1 - suffix_class(missed[i]) for i in np.flatnonzero(~found).tolist()]
        return out


class Vocabulary:
    """The broadcast part of the counts.

    table: the most frequent words by total count, in that order, with their training counts c. of_class: training tokens and
    distinct words by class, over all words.
    """

    def __init__(self, table: pd.DataFrame, total: int, distinct: int, of_class: np.ndarray, n_docs: int, n_words: int, n_vectors: int):
        import xxhash

        self.id, self.total, self.distinct, self.n_docs = uuid.uuid4().hex, total, distinct, n_docs
        raw = [w.encode() for w in table["word"]]
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in raw], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.places, self.frequent = hashes[order], order.astype(np.int64), b" ".join(raw[:FREQUENT])
        self.count = table["c"].to_numpy(np.int64)
        known = np.lexsort((np.arange(len(table)), -self.count))
        known = known[self.count[known] > 0]
        best, own = np.sort(known[:n_words]), np.sort(known[n_words : n_words + n_vectors])
        of = np.array([suffix_class(w) for w in raw], np.int64).reshape(-1)
        self.first_class, self.size = 2 + len(best), 2 + len(best) + CLASSES
        self.out = of + self.first_class
        self.out[best] = 2 + np.arange(len(best))
        # Units in the order of classes, each class's rest last.
        own = own[np.argsort(of[own], kind="stable")]
        per = np.bincount(of[own], minlength=CLASSES)
        self.start = np.concatenate([[0], np.cumsum(per + 1)])
        self.n_units = int(self.start[-1])
        self.unit = self.start[of + 1] - 1
        self.unit[own] = np.arange(len(own)) + of[own]
        left = np.array(of_class, np.int64).reshape(2, CLASSES)
        for w in (best, own):
            left = left - np.stack([np.bincount(of[w], self.count[w], CLASSES), np.bincount(of[w], minlength=CLASSES)]).astype(np.int64)
        self.rest = left
        self.rest_log = np.log10(left[0] + 0.5 * (left[1] + 1))
        self.unit_count = np.zeros(self.n_units)
        self.unit_count[self.start[1:] - 1] = left[0]
        self.unit_count[self.unit[own]] = self.count[own]

    def codes(self) -> Codes:
        return Codes(self.frequent, self.hashes, self.places)

    def outputs(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outputs and units of word codes; a unit means nothing for a word that is an output."""
        if not len(self.out):
            return self.first_class - 1 - code, self.start[-code] - 1
        at, known = np.maximum(code, 0), code >= 0
        of = np.where(known, 0, -1 - code)
        return np.where(known, self.out[at], self.first_class + of), np.where(known, self.unit[at], self.start[of + 1] - 1)

    def unigram(self) -> np.ndarray:
        """Distribution over the outputs; BOS has none."""
        p = np.full(self.size, 0.5)
        p[BOS], p[END] = 0.0, p[END] + self.n_docs
        mine = self.out < self.first_class
        p[self.out[mine]] += self.count[mine]
        p[self.first_class :] += np.add.reduceat(self.unit_count, self.start[:-1])
        return p / p.sum()

    def unit_unigram(self) -> np.ndarray:
        """Distribution over each class's units."""
        p = self.unit_count + 0.5
        return p / np.repeat(np.add.reduceat(p, self.start[:-1]), np.diff(self.start))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class LogBilinear:
    """Parameters by rows: outputs (R, Q, b), units (U, d), and the three position vectors r1, r2, g."""

    def __init__(self, vocab: Vocabulary, dim: int = DIM, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.dim, self.rng, self.start = dim, rng, vocab.start
        self.p, self.pu = vocab.unigram(), vocab.unit_unigram()
        small = lambda n: rng.normal(0, 0.3, (n, dim)).astype(np.float32)
        self.R, self.Q, self.U = small(vocab.size), small(vocab.size), small(vocab.n_units) * np.float32(0.3)
        self.pos = np.full((3, dim), 0.5, np.float32)
        self.b = np.log(np.maximum(self.p, 1e-12)).astype(np.float32)
        self.d = np.log(self.pu).astype(np.float32)
        self.sums = {k: np.ones(len(getattr(self, k)), np.float32) for k in ("R", "Q", "b", "U", "d", "pos")}
        self.begun()

    def begun(self) -> LogBilinear:
        """Ready for a run: nothing seen."""
        self.seen, self.seen_units = np.zeros(len(self.R)), np.zeros(len(self.U))
        self.cumulative, self.unit_cumulative = np.cumsum(self.p), np.concatenate([[0.0], np.cumsum(self.pu)])
        self.log_p, self.log_pu = (np.log(np.maximum(x, 1e-12)).astype(np.float32) for x in (self.p, self.pu))
        return self

    def move(self, name: str, rows: np.ndarray, g: np.ndarray, rate: float) -> None:
        """A step of Adagrad with one accumulator for each row; rows are distinct."""
        s, x = self.sums[name], getattr(self, name)
        s[rows] += (g * g).mean(1) if g.ndim > 1 else g * g
        scale = (rate / np.sqrt(s[rows])).astype(np.float32)
        x[rows] += (scale[:, None] * g if g.ndim > 1 else scale * g).astype(np.float32)

    def train(self, w: np.ndarray, h1: np.ndarray, h2: np.ndarray, u: np.ndarray, k: int = NOISE, ku: int = UNIT_NOISE, rate: float = RATE) -> None:
        """One step on a mini-batch: outputs, the two before, and units (-1 where the output is a word)."""
        n, dim = self.Q.shape
        drawn = np.minimum(np.searchsorted(self.cumulative, self.rng.random(k)), n - 1)
        log_noise = self.log_p + np.float32(np.log(k))
        x1, x2, own, other = self.R[h1], self.R[h2], self.Q[w], self.Q[drawn]
        q = x1 * self.pos[0] + x2 * self.pos[1]
        gd = 1 - sigmoid(np.einsum("ij,ij->i", q, own) + self.b[w] - log_noise[w])
        ge = -sigmoid(q @ other.T + (self.b[drawn] - log_noise[drawn]))
        dq = gd[:, None] * own + ge @ other
        at = np.arange(dim)

        def scatter(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
            return np.bincount((rows[:, None] * dim + at).ravel(), values.ravel(), size * dim).reshape(size, dim)

        gQ = scatter(w, gd[:, None] * q, n)
        np.add.at(gQ, drawn, ge.T @ q)
        d1 = dq * self.pos[0]
        gb = np.bincount(w, gd, n) + np.bincount(drawn, ge.sum(0), n)
        gp = np.stack([(dq * x1).sum(0), (dq * x2).sum(0), np.zeros(dim)])
        self.seen += np.bincount(w, minlength=n)

        i = np.flatnonzero(u >= 0)
        if len(i):
            ui, x = u[i], x1[i]
            cls = w[i] - (n - CLASSES)
            a, b = self.unit_cumulative[self.start[cls]], self.unit_cumulative[self.start[cls + 1]]
            draw = np.searchsorted(self.unit_cumulative, a[:, None] + self.rng.random((len(i), ku)) * (b - a)[:, None], "right") - 1
            both = np.concatenate([ui[:, None], np.clip(draw, self.start[cls][:, None], self.start[cls + 1][:, None] - 1)], 1)
            v, qx = self.U[both], x * self.pos[2]
            s = np.einsum("ijk,ik->ij", v, qx) + self.d[both] - self.log_pu[both] - np.float32(np.log(ku))
            e = -sigmoid(s)
            e[:, 0] += 1
            dv = np.einsum("ij,ijk->ik", e, v)
            rows, inverse = np.unique(both.ravel(), return_inverse=True)
            gU = scatter(inverse, (e[:, :, None] * qx[:, None, :]).reshape(-1, dim), len(rows))
            self.move("U", rows, gU, rate)
            self.move("d", rows, np.bincount(inverse, e.ravel(), len(rows)), rate)
            d1[i] += dv * self.pos[2]
            gp[2] = (dv * x).sum(0)
            self.seen_units += np.bincount(ui, minlength=len(self.U))
        gR = scatter(h1, d1, n) + scatter(h2, dq * self.pos[1], n)
        for name, rows, g in (("Q", slice(None), gQ), ("R", slice(None), gR), ("b", slice(None), gb), ("pos", slice(None), gp / len(w))):
            self.move(name, rows, g, rate)

    # Rows for the average over runs: weight, then parameters and accumulators.

    def tables(self) -> dict[str, np.ndarray]:
        """Views of the parameters by part, each with its accumulators."""
        s = self.sums
        return {
            "out": np.concatenate([self.R, self.Q, self.b[:, None], s["R"][:, None], s["Q"][:, None], s["b"][:, None]], 1),
            "unit": np.concatenate([self.U, self.d[:, None], s["U"][:, None], s["d"][:, None]], 1),
            "pos": np.concatenate([self.pos, s["pos"][:, None]], 1),
        }

    def slots(self) -> Iterator[tuple[str, int, bytes, bytes]]:
        """(part, slot, row numbers in it, weights and values) of the rows this run saw."""
        weights = {"out": self.seen + 1e-3, "unit": self.seen_units, "pos": np.full(3, self.seen.sum())}
        for part, table in self.tables().items():
            for a in range(0, len(table), SLOT):
                w = weights[part][a : a + SLOT]
                rows = np.flatnonzero(w > 0)
                if len(rows):
                    yield part, a // SLOT, rows.astype(np.int32).tobytes(), np.concatenate([w[rows, None], table[a + rows]], 1).astype(np.float32).tobytes()

    def load(self, part: str, slot: int, rows: np.ndarray, values: np.ndarray) -> None:
        at, d, s = slot * SLOT + rows, self.dim, self.sums
        if part == "out":
            self.R[at], self.Q[at], self.b[at] = values[:, :d], values[:, d : 2 * d], values[:, 2 * d]
            s["R"][at], s["Q"][at], s["b"][at] = values[:, 2 * d + 1 :].T
        elif part == "unit":
            self.U[at], self.d[at], s["U"][at], s["d"][at] = values[:, :d], values[:, d], values[:, d + 1], values[:, d + 2]
        else:
            self.pos[at], s["pos"][at] = values[:, :d], values[:, d]

    def slim(self) -> LogBilinear:
        """Without what only training needs."""
        self.sums = self.seen = self.seen_units = self.cumulative = self.unit_cumulative = self.log_p = self.log_pu = None
        return self


class Scorer:
    """A model with its normalisers, in log10."""

    def __init__(self, model: LogBilinear, block: int = 256):
        m = self.m = model
        self.e1, self.e2, self.e3 = m.R * m.pos[0], m.R * m.pos[1], m.R * m.pos[2]
        n, dim = m.Q.shape
        s2 = self.e2 @ m.Q.T + m.b
        s2[:, BOS] = -1e4
        t2 = s2.max(1)
        s2 = np.exp(s2 - t2[:, None]).T.copy()
        self.z, self.zu = np.empty((n, n), np.float32), np.empty((n, CLASSES), np.float32)
        for a in range(0, n, block):
            s1 = self.e1[a : a + block] @ m.Q.T
            s1[:, BOS] = -1e4
            t1 = s1.max(1, keepdims=True)
            self.z[a : a + block] = np.log(np.maximum(np.exp(s1 - t1) @ s2, 1e-37)) + t1 + t2
        del s2
        for c in range(CLASSES):
            at = slice(m.start[c], m.start[c + 1])
            for a in range(0, n, block):
                s = self.e3[a : a + block] @ m.U[at].T + m.d[at]
                top = s.max(1)
                self.zu[a : a + block, c] = np.log(np.exp(s - top[:, None]).sum(1)) + top

    def logs(self, w: np.ndarray, h1: np.ndarray, h2: np.ndarray, u: np.ndarray) -> np.ndarray:
        """log10 P(output) of tokens, and of their units where they have one."""
        m, out = self.m, np.empty(len(w))
        for a in range(0, len(w), 50_000):
            at = slice(a, a + 50_000)
            wa, ha, ua = w[at], h1[at], u[at]
            x = np.einsum("ij,ij->i", self.e1[ha] + self.e2[h2[at]], m.Q[wa]) + m.b[wa] - self.z[ha, h2[at]]
            i = np.flatnonzero(ua >= 0)
            c = wa[i] - (len(m.Q) - CLASSES)
            x[i] += np.einsum("ij,ij->i", self.e3[ha[i]], m.U[ua[i]]) + m.d[ua[i]] - self.zu[ha[i], c]
            out[at] = x / np.log(10)
        return out


def contexts(texts: list[list[bytes]], codes: Codes, vocab: Vocabulary) -> tuple[np.ndarray, ...]:
    """Codes of all words of the texts; outputs with an end after each text, the two outputs before, units (-1: none), where texts start."""
    n = [len(t) for t in texts]
    code = codes([w for t in texts for w in t])
    starts = np.concatenate([[0], np.cumsum(np.array(n, np.int64) + 1)])
    out, unit = np.full(starts[-1], END, np.int64), np.full(starts[-1], -1, np.int64)
    place = np.ones(starts[-1], bool)
    place[starts[1:] - 1] = False
    out[place], unit[place] = vocab.outputs(code)
    unit[out < vocab.first_class] = -1
    h1, h2 = np.roll(out, 1), np.roll(out, 2)
    h1[starts[:-1]] = h2[starts[:-1]] = BOS
    h2[np.minimum(starts[:-1] + 1, starts[1:] - 1)] = BOS
    return code, out, h1, h2, unit, starts


_KEPT: dict[str, object] = {}


def kept(key: str, make):
    """What a worker builds once from a broadcast; one thing of a kind, "kind:id"."""
    if key not in _KEPT:
        for old in [k for k in _KEPT if k.split(":")[0] == key.split(":")[0]]:
            del _KEPT[old]
        _KEPT[key] = make()
    return _KEPT[key]


def word_counts(docs: DataFrame, flush: int = 100_000) -> DataFrame:
    """(word, class, c, a) with the training and total count of every word; the end is the empty word. docs (text, held_out)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, rest = Counter(), Counter()

        def rows() -> pa.RecordBatch:
            keys = list(train.keys() | rest.keys())
            cols = [[w.decode() for w in keys], [suffix_class(w) for w in keys], [train[w] for w in keys], [train[w] + rest[w] for w in keys]]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["word", "class", "c", "a"])
            train.clear()
            rest.clear()
            return out

        for batch in batches:
            for text, held in zip(batch["text"], batch["held_out"].to_pylist(), strict=True):
                text, to = text.as_py(), rest if held else train
                to.update(words(text.lower() if text and text.isascii() else lower(text)))
                to[b""] += 1
                if len(train) + len(rest) > flush:
                    yield rows()
        if train or rest:
            yield rows()

    got = docs.select("text", "held_out").mapInArrow(count, "word string, class int, c long, a long")
    return got.groupBy("word", "class").agg(F.sum("c").alias("c"), F.sum("a").alias("a"))


def lower(text: str | None) -> str:
    """A-Z in lower case, nothing else."""
    return text.encode().lower().decode() if text else ""


def vocabulary(counts: DataFrame, n_words: int = N_WORDS, table_size: int = TABLE_SIZE, n_vectors: int | None = None) -> Vocabulary:
    """The broadcast part of the counts."""
    total, distinct, n_docs = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)), F.coalesce(F.sum(F.when(F.col("word") == "", F.col("c"))), F.lit(0))).first()
    real = counts.where("word <> ''")
    # The least count that leaves at most table_size words, from a histogram of some hundred rows; then no task sends more than it has of these.
    level = F.floor(F.log2("a") * 8).cast("int")
    sizes = sorted(((r.level, r["n"]) for r in real.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, room = 1 << 30, table_size
    for at, n in sizes:
        if n > room:
            break
        least, room = at, room - n
    top = real.where(level >= least).select("word", "c", "a").toPandas().sort_values(["a", "word"], ascending=[False, True], ignore_index=True)
    of_class = np.zeros((2, CLASSES), np.int64)
    for r in real.groupBy("class").agg(F.sum("c").alias("c"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).collect():
        of_class[:, r["class"]] = r["c"], r["v"]
    vectors = int(VECTORS_PER_ROOT * total**0.5) if n_vectors is None else n_vectors
    return Vocabulary(top[["word", "c"]], total, distinct, of_class, n_docs, n_words, min(vectors, table_size))


def train(docs: DataFrame, vocab: Vocabulary, dim: int = DIM, rounds: int = ROUNDS) -> LogBilinear:
    """NCE over all training texts of docs (doc_id, text, held_out): rounds over disjoint parts, each averaged over its runs."""
    model = LogBilinear(vocab, dim)
    texts = docs.where("not held_out").select("text", F.pmod(F.xxhash64("doc_id"), F.lit(rounds)).alias("part"))
    runs = max(1, int(vocab.total / rounds / (RUN_ROWS * (vocab.size + vocab.n_units))))
    if texts.rdd.getNumPartitions() > runs:
        texts = texts.coalesce(runs)
    if not vocab.n_docs:
        return model.slim()
    schema = "part string, slot int, rows binary, values binary"
    for k in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast((vocab, model))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pd.DataFrame]:
            vocab, model = sent.value
            codes, left, size, used = kept(f"codes:{vocab.id}", vocab.codes), [], 0, False
            # A worker keeps the broadcast value for its next task.
            model = copy.deepcopy(model).begun()
            for batch in batches:
                for i in range(0, len(batch), 200):
                    _, *data, _ = contexts([lower(t).encode().split() for t in batch["text"].iloc[i : i + 200]], codes, vocab)
                    left.append(np.stack(data))
                    size += left[-1].shape[1]
                    used = True
                    if size >= 8 * BATCH:
                        left, size = steps(model, left, BATCH)
            if used:
                steps(model, left, 1)
                yield pd.DataFrame(list(model.slots()), columns=["part", "slot", "rows", "values"])

        def average(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[tuple[str, int], np.ndarray] = {}
            for batch in batches:
                for part, slot, rows, values in zip(batch["part"], batch["slot"], batch["rows"], batch["values"], strict=True):
                    rows = np.frombuffer(rows, np.int32)
                    x = np.frombuffer(values, np.float32).reshape(len(rows), -1).astype(float)
                    to = sums.setdefault((part, slot), np.zeros((SLOT, x.shape[1])))
                    x[:, 1:] *= x[:, :1]
                    to[rows] += x
            for (part, slot), x in sums.items():
                rows = np.flatnonzero(x[:, 0] > 0)
                yield pd.DataFrame({"part": [part], "slot": [slot], "rows": [rows.astype(np.int32).tobytes()], "values": [(x[rows, 1:] / x[rows, :1]).astype(np.float32).tobytes()]})

        got = texts.where(F.col("part") == k).select("text").mapInPandas(run, schema)
        model = LogBilinear(vocab, dim) if k == 0 else model
        for r in got.repartition("part", "slot").mapInPandas(average, schema).toLocalIterator():
            rows = np.frombuffer(r.rows, np.int32)
            model.load(r.part, r.slot, rows, np.frombuffer(r["values"], np.float32).reshape(len(rows), -1))
        sent.unpersist()
    return model.slim()


def steps(model: LogBilinear, left: list[np.ndarray], least: int) -> tuple[list[np.ndarray], int]:
    """Train on what has gathered, in shuffled mini-batches; what is left over, and how much."""
    data = np.concatenate(left, axis=1) if left else np.empty((4, 0), np.int64)
    data = data[:, model.rng.permutation(data.shape[1])]
    for i in range(0, data.shape[1], BATCH):
        x = data[:, i : i + BATCH]
        if x.shape[1] < least:
            return [x], x.shape[1]
        model.train(*x)
    return [], 0


def fit(docs: DataFrame, counts: DataFrame, n_words: int = N_WORDS, table_size: int = TABLE_SIZE, n_vectors: int | None = None, dim: int = DIM, rounds: int = ROUNDS) -> tuple[Vocabulary, LogBilinear]:
    """Vocabulary and model of docs (doc_id, text, held_out) with their word counts."""
    vocab = vocabulary(counts, n_words, table_size, n_vectors)
    return vocab, train(docs, vocab, dim, rounds)


def scores(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, model: LogBilinear) -> DataFrame:
    """The columns of lm_scores for docs (doc_id, text, held_out)."""
    sent = docs.sparkSession.sparkContext.broadcast((vocab, model))

    @F.pandas_udf("n_tokens long, n_known long, base double, score double, rare array<string>")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocab, model = sent.value
        codes, scorer = kept(f"codes:{vocab.id}", vocab.codes), kept(f"scorer:{vocab.id}", lambda: Scorer(model))
        log_c = np.log10(np.append(vocab.count, 0) + 0.5)
        known = np.append(vocab.count > 0, False)
        end_log, all_log = np.log10(vocab.n_docs + 0.5), np.log10(vocab.total + 0.5 * (vocab.distinct + 1))
        rest = np.zeros(vocab.n_units, bool)
        rest[vocab.start[1:] - 1] = True
        for x in texts:
            parts = []
            for i in range(0, len(x), 200):
                split = [lower(t).encode().split() for t in x.iloc[i : i + 200]]
                code, out, h1, h2, unit, starts = contexts(split, codes, vocab)
                logs = scorer.logs(out, h1, h2, unit)
                # Words stand one place later for each text before them.
                n = np.diff(starts) - 1
                where = np.arange(len(code)) + np.repeat(np.arange(len(n)), n)
                rare = code < 0
                own = np.zeros(len(out))
                own[where] = np.where(rare, 0.0, log_c[np.where(rare, -1, code)])
                other = (unit >= 0) & rest[unit]
                logs[other] += own[other] - vocab.rest_log[out[other] - vocab.first_class]
                own[starts[1:] - 1] = end_log
                hit = np.zeros(len(out))
                hit[where] = known[np.where(rare, -1, code)]
                hit[starts[1:] - 1] = vocab.n_docs > 0
                at = starts[:-1]
                sums = [np.add.reduceat(v, at) for v in (hit, own, logs)]
                lists = [[t[j - a].decode() for j in js] for t, (a, js) in zip(split, _rare_places(where, rare, starts), strict=True)]
                parts.append(pd.DataFrame({"n_tokens": n + 1, "n_known": sums[0].astype(np.int64), "base": sums[1] - (n + 1) * all_log, "score": sums[2], "rare": lists}))
            if parts:
                yield pd.concat(parts)
            else:
                yield pd.DataFrame({"n_tokens": np.empty(0, np.int64), "n_known": np.empty(0, np.int64), "base": np.empty(0), "score": np.empty(0), "rare": np.empty(0, object)})

    part = docs.select("doc_id", "held_out", scored("text").alias("s")).select("doc_id", "held_out", "s.*", F.monotonically_increasing_id().alias("row"))
    part = stored(part, "scored")
    rare = part.select("row", F.explode("rare").alias("word")).join(counts.where("c > 0").select("word", "c"), "word", "left")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_log"), F.count("c").alias("rare_known"))
    more = F.coalesce("rare_log", F.lit(0.0))
    return part.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(vocab.total)).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )


def _rare_places(where: np.ndarray, rare: np.ndarray, starts: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """For each text its start and the places of its words that the table lacks."""
    places = where[rare]
    cuts = np.searchsorted(places, starts)
    return [(int(a), places[i:j]) for a, i, j in zip(starts[:-1], cuts[:-1], cuts[1:], strict=True)]


def lm_scores(docs: DataFrame, held_out: int = 1, folds: int = 5, **how) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = docs.select("doc_id", "text", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"))
    counts = stored(word_counts(docs), "counts")
    return scores(docs, counts, *fit(docs, counts, **how))
