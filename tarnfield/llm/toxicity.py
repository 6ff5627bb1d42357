"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters the network twice: as a learned vector of its own, if the
training sample holds it often enough, and as the sum of learned vectors of its
character runs, so unseen forms of a known stem score too. A window is
``WINDOW`` words, and one starts at every word. ``SPAN`` windows that start at
words in turn share one pass: both directions of a gated recurrent layer read
the words that these windows cover, from a zero state at either end, and
attention pools the states of each window to one logit. A logit is a weighted
mean of one number a word, so all windows of a pass are sliding sums, and a
window at every word costs 1.5 steps a word and direction. A document scores as
its highest window, over its whole text.

Training sees a bounded, hash-ordered sample of labelled documents and learns
from each document's highest window. Labels are used for nothing else.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.sampling import bounded_sample
from tarnfield.llm.superkmers import _parts
from tarnfield.plans.workspace import Workspace, ship, tidy

WINDOW, SPAN = 32, 64  # words of a window, windows of a pass
SAMPLE = 3000  # labelled documents of each class to train on, at most
SAMPLE_WORDS, SAMPLE_CHARS = 250, 1750  # longest training document; if a class has only longer ones, their beginnings
PASSES = 1024  # passes that are read at once
STEPS, BATCH, RATE = 350, 64, 0.01
SEEN_IN = 4  # training documents that must hold a word for it to get a vector
WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 12, 16, 12, 8
RUNS, RUN_LENGTHS = 1 << 14, (3, 5)
LONGEST = 64  # bytes of a word; longer ones are read as several
THRESHOLD = 0.3
_KNOWN_WORDS = 150_000
_PART_BYTES = 2 << 20  # text that is scored at once
_LEVEL = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))  # ASCII marks separate words


def words_of(text: str) -> list[bytes]:
    """Words in order; one over ``LONGEST`` bytes as pieces of it that overlap, so that each of its character runs is whole in one."""
    words = text.encode().lower().translate(_LEVEL).split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    back = max(RUN_LENGTHS) - 1
    return [w[a : a + LONGEST] for w in words for a in range(0, max(1, len(w) - back), LONGEST - back)]


def char_runs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words' character runs in turn, number of runs of each word); ends of words are marked."""
    marked = [b"<" + w + b">" for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
    begin = np.cumsum(size) - size
    counts = sum(np.maximum(size - n + 1, 0) for n in RUN_LENGTHS)
    out = np.zeros(int(counts.sum()), np.int64)
    to = np.cumsum(counts) - counts
    for n in RUN_LENGTHS:
        own = np.maximum(size - n + 1, 0)
        step = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
        at = np.repeat(begin, own) + step
        h = np.full(len(at), n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ data[at + k]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        out[np.repeat(to, own) + step] = h * np.uint32(0x85EBCA6B) >> np.uint32(18)
        to = to + own
    return out, counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """Weights by name; ``vocabulary`` numbers the words that have vectors, from 1."""

    def __init__(self, weights: dict[str, np.ndarray], vocabulary: dict[bytes, int]):
        self.w, self.vocabulary = weights, vocabulary
        self.rows: dict[bytes, int] = _Numbered()
        self.inputs: list[np.ndarray] | None = None  # what each word adds to the gates of either direction

    @staticmethod
    def fresh(vocabulary: dict[bytes, int], seed: int = 7) -> "Network":
        r = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        n = lambda *s, k=1.0: (r.standard_normal(s) * k).astype(np.float32)
        w = {"word": n(len(vocabulary) + 1, WORD_DIM, k=0.1), "char": n(RUNS, CHAR_DIM, k=0.1), "attend": n(2 * h, ATTEND, k=0.3), "focus": n(ATTEND, k=0.3), "out": n(2 * h, k=0.3), "bias": np.zeros(1, np.float32) - 1}
        for side in "fb":
            w |= {f"x{side}": n(d, 3 * h, k=d**-0.5), f"u{side}": n(h, 3 * h, k=h**-0.5), f"c{side}": np.zeros(3 * h, np.float32)}
        return Network(w, vocabulary)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """What the inputs add to the gates of both directions."""
        return np.concatenate([x @ self.w[f"x{s}"] + self.w[f"c{s}"] for s in "fb"], axis=-1)

    def states(self, gates: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(windows, time, 2 * HIDDEN) states; ``mask`` marks words, and padding holds the state."""
        n, t, _ = gates.shape
        h = HIDDEN
        out = np.zeros((n, t, 2 * h), np.float32)
        for s, side in enumerate("fb"):
            u, state = self.w[f"u{side}"], np.zeros((n, h), np.float32)
            for at in range(t) if s == 0 else range(t - 1, -1, -1):
                g = gates[:, at, s * 3 * h : (s + 1) * 3 * h]
                rec = state @ u
                zr = _sigmoid(g[:, : 2 * h] + rec[:, : 2 * h])
                new = np.tanh(g[:, 2 * h :] + zr[:, h:] * rec[:, 2 * h :])
                z = zr[:, :h] * mask[:, at, None]
                if keep is not None:
                    keep.append((s, at, state, rec, zr, new, z))
                state = state + z * (new - state)
                out[:, at, s * h : (s + 1) * h] = state
        return out

    def pooled(self, out: np.ndarray, mask: np.ndarray) -> tuple:
        """Logits of one window each: the words that ``mask`` marks."""
        hidden = np.tanh(out @ self.w["attend"])
        e = hidden @ self.w["focus"] + (mask - 1) * 30
        e = np.exp(e - e.max(1, keepdims=True))
        share = e / e.sum(1, keepdims=True)
        pool = (share[:, :, None] * out).sum(1)
        return pool @ self.w["out"] + self.w["bias"], pool, share, hidden

    def windows(self, attention: np.ndarray, value: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Logits of the windows at every word of each pass; (passes, time) before attention's exponential, what a word adds, and words."""
        weight = np.exp((attention - attention.max(1, keepdims=True)).astype(np.float64)) * mask
        whole = _sums(weight)
        return _sums(weight * value) / np.where(whole > 0, whole, 1) + self.w["bias"]

    def gradient(self, x: np.ndarray, mask: np.ndarray, labels: np.ndarray, window: np.ndarray | None = None) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """(gradients of the dense weights, of the inputs, mean loss) for passes ``x`` (n, time, dim); ``window`` marks the words to pool, else all."""
        n, t, _ = x.shape
        h, w, g = HIDDEN, self.w, {}
        kept: list = []
        gates = self.gates(x)
        out = self.states(gates, mask, kept)
        logit, pool, share, hidden = self.pooled(out, mask if window is None else window)
        p = _sigmoid(logit)
        d = (p - labels) / n
        g["out"], g["bias"] = pool.T @ d, d.sum(keepdims=True)
        d_pool = d[:, None] * w["out"]
        d_share = (out * d_pool[:, None, :]).sum(2)
        d_out = share[:, :, None] * d_pool[:, None, :]
        d_e = share * (d_share - (share * d_share).sum(1, keepdims=True))
        g["focus"] = (hidden * d_e[:, :, None]).sum((0, 1))
        d_hidden = d_e[:, :, None] * w["focus"] * (1 - hidden**2)
        g["attend"] = out.reshape(-1, 2 * h).T @ d_hidden.reshape(-1, ATTEND)
        d_out = d_out + d_hidden @ w["attend"].T
        d_gates = np.zeros_like(gates)
        d_state = {0: np.zeros((n, h), np.float32), 1: np.zeros((n, h), np.float32)}
        for side in "fb":
            g[f"u{side}"] = np.zeros_like(w[f"u{side}"])
        for s, at, state, rec, zr, new, z in reversed(kept):
            side = "fb"[s]
            d_h = d_state[s] + d_out[:, at, s * h : (s + 1) * h]
            d_z = d_h * (new - state) * mask[:, at, None]
            d_new = d_h * z * (1 - new**2)
            d_r = d_new * rec[:, 2 * h :]
            d_zr = np.concatenate([d_z, d_r], 1) * zr * (1 - zr)
            d_gates[:, at, s * 3 * h : (s + 1) * 3 * h] = np.concatenate([d_zr, d_new], 1)
            d_rec = np.concatenate([d_zr, d_new * zr[:, h:]], 1)
            g[f"u{side}"] += state.T @ d_rec
            d_state[s] = d_h * (1 - z) + d_rec @ w[f"u{side}"].T
        d_x = np.zeros_like(x)
        for s, side in enumerate("fb"):
            part = d_gates[:, :, s * 3 * h : (s + 1) * 3 * h]
            g[f"x{side}"] = x.reshape(-1, x.shape[2]).T @ part.reshape(-1, 3 * h)
            g[f"c{side}"] = part.sum((0, 1))
            d_x += part @ w[f"x{side}"].T
        loss = float(np.mean(np.logaddexp(0, logit) - labels * logit))
        return g, d_x, loss

    # --- scoring ---

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """Rows of ``inputs`` of the words, computing those of new words."""
        if self.inputs is None or len(self.rows) > _KNOWN_WORDS:
            self.rows, self.inputs = _Numbered(), [np.zeros((1, 3 * HIDDEN), np.float32) for _ in "fb"]
        known = len(self.rows)
        numbers = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        new = list(self.rows)[known:]
        parts = [[x] for x in self.inputs]
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            own = self.w["word"][[self.vocabulary.get(x, 0) for x in part]]
            gates = self.gates(np.concatenate([own, char_sums(self.w["char"], *char_runs(part))], 1))
            for side, given in enumerate(parts):
                given.append(gates[:, side * 3 * HIDDEN : (side + 1) * 3 * HIDDEN])
        self.inputs = [np.concatenate(x) for x in parts]
        return numbers

    def _read(self, side: int, numbers: np.ndarray) -> np.ndarray:
        """(time, passes, ATTEND + 1): what one direction's states add to attention and to the logit; ``numbers`` (time, passes) in its order."""
        t, n = numbers.shape
        h, u = HIDDEN, self.w[f"u{'fb'[side]}"]
        states, state = np.empty((t, n, h), np.float32), np.zeros((n, h), np.float32)
        for at in range(t):
            g = self.inputs[side].take(numbers[at], 0)
            rec = state @ u
            zr = g[:, : 2 * h] + rec[:, : 2 * h]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            new = rec[:, 2 * h :] * zr[:, h:]
            new += g[:, 2 * h :]
            np.tanh(new, out=new)
            new -= state
            new *= zr[:, :h]
            state = np.add(state, new, out=states[at])
        own = slice(side * h, (side + 1) * h)
        return states @ np.concatenate([self.w["attend"][own], self.w["out"][own, None]], 1)

    def _pass_logits(self, numbers: np.ndarray, size: np.ndarray) -> np.ndarray:
        """(passes, windows) logits; ``numbers`` (passes, time) with ``size`` words each, in front."""
        t = np.arange(numbers.shape[1])[:, None]
        inside = t < size
        back = np.where(inside, size - 1 - t, t)  # the backward direction reads each pass from its last word
        ahead = np.ascontiguousarray(numbers.T)
        both = self._read(0, ahead) + np.take_along_axis(self._read(1, np.take_along_axis(ahead, back, 0)), back[:, :, None], 0)
        attention = np.tanh(both[:, :, :ATTEND]) @ self.w["focus"]
        return self.windows(attention.T, both[:, :, ATTEND].T, inside.T)

    def score(self, texts: list[str]) -> np.ndarray:
        """The highest window score of each text; a text without words scores as one empty window."""
        docs = [words_of(t) for t in texts]
        numbers = np.append(self._numbers([x for d in docs for x in d]), 0)
        begin = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        each = [passes(len(d)) for d in docs]
        owner = np.repeat(np.arange(len(docs)), [len(first) for first, _, _ in each])
        first, size, windows = (np.concatenate([np.zeros(0, np.int64), *[x[i] for x in each]]) for i in range(3))
        first = first + begin[owner]
        best = np.full(len(docs), -np.inf)
        by_size = np.argsort(size, kind="stable")
        for a in range(0, len(by_size), PASSES):
            pick = by_size[a : a + PASSES]
            time = np.arange(max(WINDOW, int(size[pick].max())))
            at = np.where(time < size[pick, None], first[pick, None] + time, len(numbers) - 1)
            logits = self._pass_logits(numbers[at], size[pick])
            logits[np.arange(logits.shape[1]) >= windows[pick, None]] = -np.inf
            np.maximum.at(best, owner[pick], logits.max(1))
        return _sigmoid(best)


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums of each ``WINDOW`` values in turn, by doubling."""
    width = 1
    while width < WINDOW:
        x = x[:, :-width] + x[:, width:]
        width *= 2
    return x


class _Numbered(dict):
    """Numbers words from 1 in the order they come."""

    def __missing__(self, word: bytes) -> int:
        got = self[word] = len(self) + 1
        return got


def char_sums(vectors: np.ndarray, runs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each word's sum over its runs, divided by the root of their number."""
    return np.add.reduceat(vectors[runs], np.cumsum(counts) - counts) / np.sqrt(counts)[:, None].astype(np.float32)


def passes(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, windows) of each pass over ``n`` words: a window at every word that has a whole one, or one window if there are no more words than fit."""
    starts = max(1, n - WINDOW + 1)
    first = np.arange(0, starts, SPAN)
    windows = np.minimum(SPAN, starts - first)
    return first, np.minimum(windows + WINDOW - 1, n - first), windows


def train(texts: list[str], labels: list[int], steps: int = STEPS, seed: int = 7) -> Network:
    """A network fitted to the labelled texts; one that has learned nothing if a class is missing."""
    docs = [words_of(t) for t in texts]
    seen = Counter(w for d in docs for w in dict.fromkeys(d))
    vocabulary = {w: i + 1 for i, w in enumerate(sorted(w for w, n in seen.items() if n >= SEEN_IN))}
    net = Network.fresh(vocabulary, seed)
    y = np.array(labels, np.float32)
    if len(docs) == 0 or y.min() == y.max():
        return net
    r = np.random.default_rng(seed)
    numbers = {w: i for i, w in enumerate(seen)}
    flat, size = char_runs(list(seen))
    own = np.array([vocabulary.get(w, 0) for w in seen], np.int64)
    ends = np.cumsum(size)
    ids = [np.array([numbers[w] for w in d], np.int64) for d in docs]
    sides = [np.flatnonzero(y == 1), np.flatnonzero(y == 0)]
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items()}
    for step in range(steps):
        pick = np.concatenate([r.choice(s, BATCH // 2) for s in sides])
        read, owner, counts = [], [], []
        for j, i in enumerate(pick):
            for first, size_, windows in zip(*passes(len(ids[i])), strict=True):
                read.append(ids[i][first : first + size_])
                owner.append(j)
                counts.append(windows)
        owner, time = np.array(owner), np.arange(max(WINDOW, *map(len, read)))
        mask = time < np.array([len(x) for x in read])[:, None]
        grid = np.zeros(mask.shape, np.int64)
        grid[mask] = np.concatenate(read)
        used, inverse = np.unique(grid, return_inverse=True)
        inverse = inverse.reshape(grid.shape)
        places = np.concatenate([np.arange(ends[u] - size[u], ends[u]) for u in used])
        runs_used, scale = flat[places], (1 / np.sqrt(size[used])).astype(np.float32)
        cuts = np.concatenate([[0], np.cumsum(size[used])[:-1]])
        table = np.concatenate([net.w["word"][own[used]], np.add.reduceat(net.w["char"][runs_used], cuts) * scale[:, None]], 1)
        drop = (r.random(len(used)) < 0.3).astype(np.float32)  # at times a word is known by its characters alone
        table[:, :WORD_DIM] *= 1 - drop[:, None]
        maskf = mask.astype(np.float32)
        out = net.states(net.gates(table)[inverse], maskf)
        logit = net.windows(np.tanh(out @ net.w["attend"]) @ net.w["focus"], out @ net.w["out"], maskf)
        logit[np.arange(logit.shape[1]) >= np.array(counts)[:, None]] = -np.inf
        at, logit = logit.argmax(1), logit.max(1)
        top = np.lexsort((-logit, owner))
        top = top[np.concatenate([[True], owner[top][1:] != owner[top][:-1]])]
        x = table[inverse[top]]
        inside = (time >= at[top, None]) & (time < at[top, None] + WINDOW) & mask[top]
        grads, d_x, _ = net.gradient(x, maskf[top], y[pick], inside.astype(np.float32))
        d_table = np.zeros_like(table)
        np.add.at(d_table, inverse[top].ravel(), d_x.reshape(-1, x.shape[2]))
        grads["word"], grads["char"] = np.zeros_like(net.w["word"]), np.zeros_like(net.w["char"])
        np.add.at(grads["word"], own[used], d_table[:, :WORD_DIM] * (1 - drop[:, None]))
        np.add.at(grads["char"], runs_used, np.repeat(d_table[:, WORD_DIM:] * scale[:, None], size[used], axis=0))
        rate = RATE * min(1, (step + 1) / 50) * (1 - 0.9 * step / steps)
        for k, g in grads.items():
            m, v = moment[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            net.w[k] -= (rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.99 ** (step + 1))) + 1e-6)).astype(np.float32)
            net.w[k] *= 1 - 1e-4
    return net


def scored(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """``docs`` plus ``score``, with null as empty text; a column of that name is replaced."""
    spark = docs.sparkSession
    ship(spark)
    given = spark.sparkContext.broadcast((net.w, net.vocabulary))
    keep = [c for c in docs.columns if c != "score"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + ["score double"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(*given.value)
        for batch in batches:
            scores = [net.score([t or "" for t in p.column(text).to_pylist()]) for p in _parts(batch, text, _PART_BYTES)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=[*keep, "score"])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """Trained on at most ``sample`` labelled documents of each class that are not held out, of 1 to ``SAMPLE_WORDS`` words.

    If all documents of a class are over ``SAMPLE_CHARS``, their beginnings stand for them in training.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    filled, key = docs.where(F.length("text") > 0), F.xxhash64("doc_id", "text").alias("key")
    # Labels meet keys and lengths alone; only the texts of the sample, which is bounded, are fetched.
    work = Workspace(docs.sparkSession, "toxicity")
    narrow = filled.select("doc_id", key, (F.length("text") <= SAMPLE_CHARS).alias("short"))
    narrow = work.save("labelled", narrow.join(known, F.col("doc_id") == F.col("_id")).select("key", "short", "toxic"))
    have = {r["toxic"]: r["n"] for r in narrow.groupBy("toxic").agg(F.count(F.when(F.col("short"), 1)).alias("n")).collect()}
    usable = narrow.where(F.col("short") | F.col("toxic").isin([k for k, n in have.items() if not n]))
    chosen = [(r["key"], kind) for kind, r in bounded_sample(usable.select("key", "toxic"), F.col("toxic"), F.col("key"), sample)]
    keys = F.broadcast(docs.sparkSession.createDataFrame(chosen, "key long, toxic int"))
    texts = filled.select("doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text"), key).join(keys, "key").groupBy("key", "toxic").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))
    rows = sorted((r["doc_id"], r["text"], r["toxic"]) for r in texts.collect())
    work.drop("labelled")
    rows = [r for r in rows if words_of(r[1])]
    rows = [r for r in rows if len(words_of(r[1])) <= SAMPLE_WORDS or not have[r[2]]]
    return train([r[1] for r in rows], [r[2] for r in rows])


def document_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Null and empty texts score as an empty window, repeated rows score alike,
    an empty table gives an empty result, labels without a document are unused.
    """
    net = toxicity_model(docs, labels)
    out = scored(docs.select("doc_id", "text"), net)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
