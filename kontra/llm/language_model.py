"""Operator 8: document log-likelihood under a gated recurrent language model in numpy."""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontra.llm import textkit as tk
from kontra.llm.learn import fold, ragged
from kontra.llm.scratch import Scratch

SHAPES = 8
#: The end token; the low three bits of a token are its shape, which its word tells.
END = np.uint64(0x5DEECE668 | 7)
SHAPE = np.uint64(SHAPES - 1)
#: Bytes tokenised at a time, so that a kernel's arrays stay in the processor's cache.
SPAN = 1 << 17
_ENDS = np.zeros(256, dtype=np.int64)
_ENDS[[ord(c) for c in ".!?"]] = 1
_ENDS[[ord(c) for c in ",;:"]] = 2
_ENDS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".!?,;:"]] = 6


@dataclass(frozen=True)
class Recurrent:
    """Parameters.  The network starts from weights fitted to ``rows`` whole documents and then learns from all
    training documents, in groups of about ``group_tokens``.  ``head`` and ``words`` are least sizes.
    """

    head: int = 200_000
    words: int = 1500
    hidden: int = 32
    embed: int = 24
    rows: int = 900
    lanes: int = 32
    window: int = 16
    epochs: int = 3
    rate: float = 0.008
    group_tokens: int = 1 << 21
    group_lanes: int = 256
    group_rate: float = 0.008
    scored_together: int = 2048


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(every token, first token of each row); every row ends with the end token.

    A token is the word's 61-bit hash and its shape, which its bytes alone tell: how it ends, and whether it has
    letters beyond ASCII.
    """
    h, starts, ends, rows = tk.words(data, offsets)
    kind = _ENDS[data[ends - 1]] if len(ends) else np.zeros(0, np.int64)
    # between two words there is white space only, which is ASCII
    wide = np.maximum.reduceat(data, starts) >= 0x80 if len(starts) else np.zeros(0, bool)
    shape = np.where(kind == 6, 6, kind + 3 * wide)
    n = np.diff(rows)
    first = rows + np.arange(len(rows))
    out = np.full(first[-1], END, dtype=np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = (h & ~SHAPE) | shape.astype(np.uint64)
    return out, first


def counted(docs: DataFrame) -> DataFrame:
    """(h, c): how often each token occurs in the training documents (column t); partial counts of a batch are summed before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.buffers(batch.column(0))
            seen = [tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])[0] for lo, hi in tk.spans(offsets, SPAN)]
            if seen:
                values, c = np.unique(np.concatenate(seen), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(c)], names=["h", "c"])

    return docs.select("t").mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The frequent words (sorted hashes, counts, symbol or -1), the tail's mass by shape, and the training totals.

    Symbols: 0 is the end token, 1 to n-1 the most frequent words, n to n+6 the tail shapes.
    Within its tail shape a word has probability (c + 0.5) / mass, unknown words of that
    shape sharing one 0.5.
    """

    hashes: np.ndarray
    counts: np.ndarray
    symbol: np.ndarray
    unigram: np.ndarray
    log_mass: np.ndarray
    tokens: int
    types: int

    def __post_init__(self):
        # the first of the sorted hashes with each value of the upper bits
        self.shift = np.uint64(64 - max(1, (2 * len(self.hashes)).bit_length()))
        upper = (self.hashes >> self.shift).astype(np.int64)
        self.start = np.searchsorted(upper, np.arange(1 << int(64 - self.shift))).astype(np.int32)
        self.longest = int(np.bincount(upper).max())

    @property
    def n_words(self) -> int:
        return len(self.unigram) - SHAPES + 1

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count or -1 if not among the frequent words, symbol) of tokens."""
        at = self.start[(h >> self.shift).astype(np.int64)]
        last = np.int32(len(self.hashes) - 1)
        at = np.minimum(at, last)
        found = self.hashes[at] == h
        for _ in range(1, self.longest):
            rest = np.flatnonzero(~found & (self.hashes[at] < h) & (at < last))
            if not len(rest):
                break
            at[rest] += 1
            found[rest] = self.hashes[at[rest]] == h[rest]
        symbol = np.where(found, self.symbol[at], -1)
        return np.where(found, self.counts[at], -1), np.where(symbol < 0, self.n_words + np.minimum(h & SHAPE, SHAPES - 2).astype(np.int64), symbol)


def vocabulary(counts: DataFrame, how: Recurrent) -> Vocabulary:
    """Only totals and the most frequent words reach the driver; the network's words grow with the square root of the types."""
    shape = counts.groupBy(F.col("h").bitwiseAND(F.lit(SHAPES - 1)).cast("int").alias("shape")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()
    mass = np.full(SHAPES, 0.5)
    for r in shape:
        mass[r["shape"]] += r["c"] + 0.5 * r["n"]
    total, types = sum(r["c"] for r in shape), sum(r["n"] for r in shape)
    words = max(how.words, 2 * isqrt(types))
    most = max(how.head, words)
    # the least count at which no more than ``most`` words are as frequent, by steps of an eighth of a power of two
    step = F.floor(F.log2("c") * 8).cast("int")
    sizes = sorted(((r["s"], r["n"]) for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, sum_ = None, 0
    for s, n in sizes:
        if sum_ + n > most:
            break
        least, sum_ = s, sum_ + n
    head = counts.where(step >= least).toArrow() if least is not None else None
    h = np.asarray(head["h"]).view(np.uint64) if head is not None else np.zeros(0, np.uint64)
    c = np.asarray(head["c"]) if head is not None else np.zeros(0, np.int64)
    kind = (h & SHAPE).astype(np.int64)
    best = np.lexsort((h, -c))
    best = best[h[best] != END][:words]
    symbol = np.full(len(h), -1, dtype=np.int64)
    symbol[best] = np.arange(1, len(best) + 1)
    symbol[h == END] = 0
    np.subtract.at(mass, kind[best], c[best] + 0.5)
    ends = c[h == END]
    unigram = np.concatenate([[float(ends[0]) if len(ends) else 0.5], c[best].astype(float), np.maximum(mass[:-1], 0.5)])
    order = np.argsort(h)
    if not len(h):
        h, c, symbol, order = np.array([END]), np.array([0]), np.array([0]), np.array([0])
    return Vocabulary(h[order], c[order], symbol[order], unigram / unigram.sum(), np.log10(np.maximum(mass[:-1], 0.5)), int(total), int(types))


class Adam:
    """Steps of Adam on clipped gradients, in place; the gradients are spent.  A gradient (rows, values) moves only those rows and their averages."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.t = p, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.s = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict[str, np.ndarray | tuple[np.ndarray, np.ndarray]], rate: float) -> None:
        self.t += 1
        # Python's numbers, since numpy's would take the arrays through double precision
        norm = sqrt(sum(float(np.vdot(v, v)) for v in (v[1] if isinstance(v, tuple) else v for v in g.values())))
        scale = min(1.0, 1.0 / max(norm, 1e-9))
        first, second = rate / (1 - 0.9**self.t), 1 / sqrt(1 - 0.99**self.t)
        for k, v in g.items():
            if isinstance(v, tuple):
                at, v = v
                p, m, s = self.p[k][at], self.m[k][at], self.s[k][at]
            else:
                at, p, m, s = None, self.p[k], self.m[k], self.s[k]
            p_, m_, s_, v_ = p.reshape(-1), m.reshape(-1), s.reshape(-1), v.reshape(-1)
            if scale < 1:
                v_ *= scale
            for lo in range(0, len(v_), CHUNK):
                moved(*(x[lo : lo + CHUNK] for x in (p_, m_, s_, v_)), first / second, 1e-5 / second)
            if at is not None:
                self.p[k][at], self.m[k][at], self.s[k][at] = p, m, s


#: Numbers that a step of Adam moves together, so that they and their averages stay in the processor's cache.
CHUNK = 1 << 14


def moved(p: np.ndarray, m: np.ndarray, s: np.ndarray, v: np.ndarray, first: float, least: float) -> None:
    """Adam's step of parameters p by gradients v, in place; m and s are decayed sums, 10 and 100 times the averages."""
    w = np.multiply(v, v)
    s *= 0.99
    s += w
    m *= 0.9
    m += v
    np.sqrt(s, out=w)
    w += least
    np.divide(m, w, out=w)
    w *= first
    p -= w


PRODUCT = 1.5


def word_classes(p: np.ndarray) -> np.ndarray:
    """The class of each word, in order of frequency: classes of about equal square-root mass, as many as make a token cheapest.

    A class costs its own logit and, if it has several words, as much as PRODUCT logits for its products.
    """
    body, best = np.cumsum(np.sqrt(p)) / np.sqrt(p).sum(), None
    for classes in range(4, 4 * isqrt(len(p)) + 5):
        cut = np.minimum((body * classes - 1e-9).astype(np.int64), classes - 1)
        size = np.bincount(cut)
        cost = np.count_nonzero(size) + PRODUCT * np.count_nonzero(size > 1) + float((p * np.where(size == 1, 0, size)[cut]).sum())
        if best is None or cost < best[0]:
            best = cost, cut
    return np.unique(best[1], return_inverse=True)[1]


def sums(a: np.ndarray) -> np.ndarray:
    """The sum of each row; for short rows several times as fast as a.sum(1)."""
    return np.einsum("ij->i", a)


def with_one(a: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Rows of a in this order, each followed by a 1, which meets the bias."""
    out = np.empty((len(order), a.shape[1] + 1), a.dtype)
    out[:, :-1], out[:, -1] = np.take(a, order, axis=0), 1
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T b of tall matrices, by pieces of 256 rows, which stay in the processor's cache."""
    cut = len(a) - len(a) % 256
    out = a[cut:].T @ b[cut:]
    if cut:
        out += np.matmul(a[:cut].reshape(-1, 256, a.shape[1]).swapaxes(1, 2), b[:cut].reshape(-1, 256, b.shape[1])).sum(0)
    return out


class Network:
    """GRU with a softmax over classes and one within each class; float32."""

    def __init__(self, vocab: Vocabulary, how: Recurrent):
        self.how = how
        rng = np.random.Generator(np.random.PCG64(23))
        n, h, e = len(vocab.unigram), how.hidden, how.embed
        p = vocab.unigram
        # each tail shape is a class of its own
        cut = word_classes(p[: vocab.n_words])
        self.of = np.concatenate([cut, cut.max() + 1 + np.arange(SHAPES - 1)])
        k = int(self.of.max()) + 1
        self.first = np.searchsorted(self.of, np.arange(k + 1))
        mass = np.bincount(self.of, p, minlength=k)
        g = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        # a class or symbol has a row of output weights, its bias last
        with_bias = lambda w, b: np.ascontiguousarray(np.concatenate([w.T * np.float32(0.1), np.log(b)[:, None]], 1), np.float32)
        self.p = {"e": (rng.standard_normal((n, e)) * 0.3).astype(np.float32), "w": g(e, 3 * h), "u": g(h, 3 * h), "b": np.zeros(3 * h, np.float32), "c": with_bias(g(h, k), mass), "o": with_bias(g(h, n), p / mass[self.of])}
        self.p["b"][:h] = -1.0

    def blocks(self, weights: str) -> np.ndarray:
        """The weights or biases of the update gate, the reset gate and the candidate, each on its own, those of the gates halved (``forward``)."""
        out = self.p[weights].reshape(-1, 3, self.how.hidden).swapaxes(0, 1).copy()
        out[:2] *= 0.5
        return out

    def forward(self, x: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
        """One step from blocks x of inputs e w + b, state h and blocks u of weights: (new state, gates, candidate, its recurrent part).

        Every block lies contiguous.  The logistic function comes from the hyperbolic tangent of half its argument,
        which cannot overflow.
        """
        a = np.matmul(h, u)
        g, part = a[:2], a[2]
        g += x[:2]
        np.tanh(g, out=g)
        g *= 0.5
        g += 0.5
        part *= g[1]
        c = part + x[2]
        np.tanh(c, out=c)
        new = h - c
        new *= g[0]
        new += c
        return new, g, c, part

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """``forward`` from inputs whose rows hold the three blocks side by side."""
        x = x.reshape(len(x), 3, -1).swapaxes(0, 1).copy()
        x[:2] *= 0.5
        return self.forward(x, h, self.blocks("u"))

    def bounded(self, weights: str) -> bool:
        """Whether no logit can leave +-60, so that a softmax in float32 needs no greatest logit taken off."""
        return float(sums(np.abs(self.p[weights])).max()) < 60

    def log_p(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log probability of symbols y after states h (within +-1, as a GRU's are)."""
        k = self.of[y].astype(np.int16)
        order = np.argsort(k, kind="stable")
        edge = np.searchsorted(k[order], np.arange(len(self.first)))
        h, y, k = with_one(h, order), y[order], k[order]
        inside = bool(np.abs(h).max(initial=0) <= 1)
        near, close = inside and self.bounded("c"), inside and self.bounded("o")
        total, weights = np.empty(len(y)), self.p["c"].T
        for lo in range(0, len(y), TOGETHER):
            a = h[lo : lo + TOGETHER] @ weights
            if not near:
                a -= a.max(1, keepdims=True)
            total[lo : lo + TOGETHER] = np.take(a, np.arange(0, a.size, a.shape[1]) + k[lo : lo + TOGETHER])
            np.exp(a, out=a)
            total[lo : lo + TOGETHER] -= np.log(sums(a))
        for c in np.flatnonzero(np.diff(edge)):
            lo, hi, i, j = self.first[c], self.first[c + 1], edge[c], edge[c + 1]
            if hi - lo == 1:
                continue
            b = h[i:j] @ self.p["o"][lo:hi].T
            if not close:
                b -= b.max(1, keepdims=True)
            total[i:j] += np.take(b, np.arange(-lo, b.size - lo, hi - lo) + y[i:j])
            np.exp(b, out=b)
            total[i:j] -= np.log(sums(b))
        out = np.empty(len(y))
        out[order] = total
        return out

    def fit(self, symbols: np.ndarray, first: np.ndarray) -> Network:
        """Truncated backpropagation: documents in lanes, the state carried from window to window and cleared at each document's start; Adam."""
        how, adam = self.how, Adam(self.p)
        rng = np.random.Generator(np.random.PCG64(29))
        n = how.hidden
        for epoch in range(how.epochs):
            docs = rng.permutation(len(first) - 1)
            stream = np.concatenate([symbols[first[d] : first[d + 1]] for d in docs])
            width = len(stream) // how.lanes
            if width < 2:
                return self
            lanes = stream[: width * how.lanes].reshape(how.lanes, width)
            before = np.concatenate([np.zeros((how.lanes, 1), np.int64), lanes[:, :-1]], 1)
            state = np.zeros((how.lanes, n), np.float32)
            rate = how.rate * (1.0, 0.5, 0.2, 0.1)[min(epoch, 3)]
            for lo in range(0, width, how.window):
                x, y = before[:, lo : lo + how.window], lanes[:, lo : lo + how.window]
                g, state = self.gradients(x, y, state)
                adam.step(g, rate)
        return self

    def learn(self, pieces: Iterator[np.ndarray], tokens: int) -> int:
        """One pass over all symbols of ``pieces`` (whole documents) from the present weights, as in ``fit``; the rate falls to a tenth over ``tokens``. Returns their number."""
        how, adam, done = self.how, Adam(self.p), 0
        for stream in pieces:
            before = np.concatenate([[0], stream[:-1]])
            lo = 0
            # the last rows shorter than a lane each go through fewer lanes, so that no symbol is left out
            while lo < len(stream):
                lanes = int(np.clip((len(stream) - lo) // how.window, 1, how.group_lanes))
                width = (len(stream) - lo) // lanes
                x, y = (v[lo : lo + lanes * width].reshape(lanes, width) for v in (before, stream))
                state = np.zeros((lanes, how.hidden), np.float32)
                for at in range(0, width, how.window):
                    g, state = self.gradients(x[:, at : at + how.window], y[:, at : at + how.window], state)
                    adam.step(g, how.group_rate * max(0.1, 1 - done / max(tokens, 1)))
                    done += y[:, at : at + how.window].size
                lo += lanes * width
        return done

    def gradients(self, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Mean gradients over one window (lanes x steps) from states h, and the states after it; that of the embedding has only the rows used."""
        p, n = self.p, self.how.hidden
        lanes, steps = x.shape
        kind = p["u"].dtype
        ids, want, total = x.T.ravel(), y.T.ravel(), x.size
        # of the words only those in the window, each once, go through the input weights
        by_id = np.argsort(ids.astype(np.uint16) if len(self.of) <= 1 << 16 else ids, kind="stable")
        starts = np.flatnonzero(np.diff(ids[by_id], prepend=-1))
        used = ids[by_id[starts]]
        place = np.empty(total, np.int32)
        place[by_id] = np.repeat(np.arange(len(used), dtype=np.int32), np.diff(starts, append=total))
        w, u, back_w, back_u = self.blocks("w"), self.blocks("u"), *(np.ascontiguousarray(p[k].reshape(-1, 3, n).transpose(1, 2, 0)) for k in "wu")
        back_w = back_w[[2, 0, 1]]
        inputs = np.take(np.matmul(p["e"][used], w) + self.blocks("b"), place, axis=1).reshape(3, steps, lanes, n)
        # the lanes where a document starts, by step
        fresh = np.flatnonzero(ids == 0)
        fresh = np.split(fresh % lanes, np.searchsorted(fresh, np.arange(lanes, total, lanes)))
        before, after, kept = np.empty((steps, lanes, n), kind), np.empty((steps, lanes, n), kind), []
        for j in range(steps):
            before[j] = h
            before[j, fresh[j]] = 0
            h, *parts = self.forward(inputs[:, j], before[j], u)
            after[j] = h
            kept.append(parts)
        inside = bool(np.abs(before[0]).max(initial=0) <= 1)
        near, close = inside and self.bounded("c"), inside and self.bounded("o")
        grad = {"o": np.empty_like(p["o"])}
        # symbols in order of their classes
        k = self.of[want].astype(np.int16)
        order = np.argsort(k, kind="stable")
        edge = np.searchsorted(k[order], np.arange(len(self.first))).tolist()
        flat, aim, share = with_one(after.reshape(total, n), order), want[order], kind.type(1 / total)
        a = flat @ p["c"].T
        if not near:
            a -= a.max(1, keepdims=True)
        np.exp(a, out=a)
        a *= (share / sums(a))[:, None]
        for c in range(len(edge) - 1):
            a[edge[c] : edge[c + 1], c] -= share
        grad["c"] = product(a, flat)
        dh = a @ p["c"][:, :n]
        for c, (lo, hi, i, j) in enumerate(zip(self.first[:-1].tolist(), self.first[1:].tolist(), edge[:-1], edge[1:], strict=True)):
            if hi - lo == 1 or i == j:
                grad["o"][lo:hi] = 0
                continue
            o = p["o"][lo:hi]
            b = flat[i:j] @ o.T
            if not close:
                b -= b.max(1, keepdims=True)
            np.exp(b, out=b)
            b *= (share / sums(b))[:, None]
            b.reshape(-1)[np.arange(-lo, b.size - lo, hi - lo) + aim[i:j]] -= share
            np.matmul(b.T, flat[i:j], out=grad["o"][lo:hi])
            dh[i:j] += b @ o[:, :n]
        back_order = np.empty(total, np.int64)
        back_order[order] = np.arange(total)
        dh = np.take(dh, back_order, axis=0).reshape(steps, lanes, n)
        back = np.zeros((lanes, n), kind)
        # blocks: the candidate, the update and the reset gate, the candidate's recurrent part before its gate
        d_all = np.empty((4, steps, lanes, n), kind)
        for j in range(steps - 1, -1, -1):
            hp, ((z, r), c, part) = before[j], kept[j]
            dc, dz, dr, du = d_all[:, j]
            d = dh[j]
            d += back
            np.subtract(1, z, out=dz)
            dz *= d
            np.multiply(c, c, out=dc)
            np.subtract(1, dc, out=dc)
            dc *= dz
            np.subtract(hp, c, out=c)
            dz *= c
            dz *= z
            np.multiply(dc, r, out=du)
            np.subtract(1, r, out=dr)
            dr *= dc
            dr *= part
            d *= z
            back, more, last = np.matmul(d_all[1:, j], back_u)
            back += more
            back += last
            back += d
            back[fresh[j]] = 0
        d_all = d_all.reshape(4, total, n)
        beside = lambda blocks: np.concatenate(blocks, -1)
        grad["u"] = beside([product(before.reshape(total, n), d_all[i]) for i in (1, 2, 3)])
        e = np.take(p["e"], ids, axis=0)
        grad["w"], grad["b"] = (beside([f(d_all[i]) for i in (1, 2, 0)]) for f in (lambda d: product(e, d), lambda d: np.ones(total, kind) @ d))
        by_word = np.matmul(d_all[:3], back_w).sum(0).T
        grad["e"] = used, np.stack([np.bincount(place, v, len(used)) for v in by_word], 1).astype(kind)
        return {name: grad[name] for name in p}, h

    def score(self, symbols: np.ndarray, first: np.ndarray, window: int = 64) -> np.ndarray:
        """Sum of natural log probabilities of each row's symbols (its last one is the end token, which also stands before its first)."""
        u, table = self.blocks("u"), np.matmul(self.p["e"], self.blocks("w")) + self.blocks("b")
        n = np.diff(first)
        out = np.zeros(len(n))
        order = np.argsort(-n, kind="stable")
        for lo in range(0, len(order), self.how.scored_together):
            rows = order[lo : lo + self.how.scored_together]
            size, at = n[rows], first[rows]
            # how many rows still have a symbol at each step
            lives = np.searchsorted(-size, -np.arange(int(size[0])), side="left").tolist()
            h = np.zeros((len(rows), self.how.hidden), np.float32)
            last = np.zeros(len(rows), np.int64)
            total = np.zeros(len(rows))
            states, wants, owners, held = [], [], [], 0
            for j, live in enumerate(lives):
                h = self.forward(np.take(table, last[:live], axis=1), h[:live], u)[0]
                last = symbols[at[:live] + j]
                states.append(h)
                wants.append(last)
                owners.append(live)
                held += live
                if len(states) == window or held >= 1 << 14 or j + 1 == len(lives):
                    lp = self.log_p(np.concatenate(states), np.concatenate(wants))
                    done = 0
                    for o in owners:
                        total[:o] += lp[done : done + o]
                        done += o
                    states, wants, owners, held = [], [], [], 0
            out[rows] = total
        return out


#: Rows whose class logits are in the processor's cache together.
TOGETHER = 4096
BLOCK = 1 << 16


def taught(symbols: DataFrame, network: Network, tokens: int) -> None:
    """The network's weights become the mean, by tokens, of those that each group of documents (s, id) reaches from them.

    Groups are dealt and ordered by hash of the id, so how the input is partitioned changes nothing.  Weights are
    summed by the executors, block by block; one network reaches the driver.
    """
    how = network.how
    groups = max(1, round(tokens / how.group_tokens))
    sent = symbols.sparkSession.sparkContext.broadcast(network)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[np.ndarray]:
            held, n = [], 0
            for batch in batches:
                s = ragged(batch.column(0))[0]
                held.append(s.astype(np.int64))
                n += len(s)
                if 2 * n >= how.group_tokens:
                    yield np.concatenate(held)
                    held, n = [], 0
            if n:
                yield np.concatenate(held)

        net = copy.deepcopy(sent.value)
        done = net.learn(pieces(), tokens // groups)
        if done:
            flat = np.concatenate([v.ravel() for v in net.p.values()])
            for i, lo in enumerate(range(0, len(flat), BLOCK)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([done]), pa.array([flat[lo : lo + BLOCK].tobytes()])], names=["block", "n", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for i, n, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                old = total.get(i, (0, 0.0))
                total[i] = (old[0] + n, old[1] + n * np.frombuffer(v, np.float32).astype(np.float64))
        for i, (n, v) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([(v / n).astype(np.float32).tobytes()])], names=["block", "v"])

    group = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")
    dealt = symbols.repartitionById(groups, group).sortWithinPartitions(F.xxhash64("id"), "id", F.xxhash64("s")).select("s")
    got = dealt.mapInArrow(learn, "block int, n bigint, v binary").repartition("block").mapInArrow(add, "block int, v binary").toArrow().sort_by("block")
    sent.unpersist()
    if got.num_rows:
        flat, at = np.concatenate([np.frombuffer(v, np.float32) for v in got["v"].to_pylist()]), 0
        for k, v in network.p.items():
            network.p[k], at = flat[at : at + v.size].reshape(v.shape).copy(), at + v.size


def language_model(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", parts: int = 5, held: int = 1, how: Recurrent = Recurrent()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Tokens are runs outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased, then one end
    token.  Learnt from documents whose crc32(doc_id) mod ``parts`` is not ``held`` (rows
    with a null id are scored, not learnt from and not held out): counts of all tokens,
    and the network's weights, which start from a sample, in hash order, of whole
    documents and are then learnt from every one (``taught``).
    base_score is the add-half unigram's log10 probability; score the network's: class,
    word within its class, and within a tail shape the word's share of the counts; it is
    of the complete document, with the state carried through.  A null or empty text is
    its end token alone.  Repeated rows count as documents; further columns are not read.
    Words are known by a 64-bit hash.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "language-model")
    plain = docs.select(F.col(text).alias("t"), F.col(doc_id).alias("doc_id"))
    learnt = plain.where(fold("doc_id", parts) != held)
    counts = scratch.save(counted(learnt), "counts", release=True)
    vocab = vocabulary(counts, how)
    sample = learnt.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(how.rows)
    network = Network(vocab, how)
    sent_words = spark.sparkContext.broadcast(vocab)

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.buffers(batch.column(0))
            for lo, hi in tk.spans(offsets, SPAN):
                h, first = tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                s = sent_words.value.look(h)[1].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(s)), batch.column(1).slice(lo, hi - lo)], names=["s", "id"])

    kind = docs.schema[doc_id].dataType.simpleString()
    got = learnt.join(F.broadcast(sample), "doc_id").select("t", "doc_id").mapInArrow(symbols, f"s array<int>, id {kind}").toArrow().sort_by("id")
    if got.num_rows:
        s, first = ragged(got["s"])
        network.fit(s.astype(np.int64), first)
        taught(learnt.select("t", "doc_id").mapInArrow(symbols, f"s array<int>, id {kind}"), network, vocab.tokens)
    sent = spark.sparkContext.broadcast((vocab, network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, net = sent.value
        for batch in batches:
            data, offsets = tk.buffers(batch.column(0))
            for lo, hi in tk.spans(offsets, 12 << 20):
                c_, s_, h_, n_ = [], [], [], []
                for a, b in tk.spans(offsets[lo : hi + 1] - offsets[lo], SPAN):
                    a, b = a + lo, b + lo
                    h, first = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    c, s = v.look(h)
                    c_.append(c), s_.append(s), h_.append(h), n_.append(np.diff(first))
                c, s, h, n = (np.concatenate(x) for x in (c_, s_, h_, n_))
                first = np.concatenate([[0], np.cumsum(n)])
                total = net.score(s, first) / np.log(10)
                known = c >= 0
                head = np.where(known, np.log10(np.maximum(c, 0) + 0.5), 0.0)
                tail = s >= v.n_words
                cut = first[:-1]
                within = np.add.reduceat(np.where(tail, head, 0.0) - np.where(tail, v.log_mass[np.where(tail, s - v.n_words, 0)], 0.0), cut)
                rest = np.concatenate([[0], np.cumsum(np.add.reduceat((~known).astype(np.int64), cut))])
                columns = [batch.column(1).slice(lo, hi - lo), pa.array(n), pa.array(np.add.reduceat((c > 0).astype(np.int64), cut)), pa.array(np.add.reduceat(head, cut)), pa.array(total + within), pa.ListArray.from_arrays(pa.array(rest.astype(np.int32)), pa.array(h[~known].view(np.int64)))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "base", "net", "rest"])

    schema = f"doc_id {kind}, n_tokens bigint, n_known bigint, base double, net double, rest array<bigint>"
    scored = scratch.save(plain.mapInArrow(run, schema).withColumn("uid", F.monotonically_increasing_id()), "scored", release=True)
    # words beyond the frequent ones meet their counts by a join
    rare = scored.select("uid", F.explode("rest").alias("h")).join(counts.select("h", "c"), "h", "left")
    rare = rare.groupBy("uid").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.count("c").alias("found"))
    out = scored.drop("rest").join(rare, "uid", "left")
    unit = float(np.log10(vocab.tokens + 0.5 * (vocab.types + 1)))
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id",
        F.coalesce(fold("doc_id", parts) == held, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * unit).alias("base_score"),
        (F.col("net") + more).alias("score"),
    )


def op8_query(spark, sf_dir: str) -> DataFrame:
    return language_model(spark.read.parquet(f"{sf_dir}/documents.parquet"))
