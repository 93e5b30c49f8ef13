"""Operator 10: toxicity by a character n-gram linear model scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontra.llm import textkit as tk
from kontra.llm.fuzzy import squeezed
from kontra.llm.learn import fold, sampled, segment_sum, sigmoid
from kontra.llm.scratch import Scratch


@dataclass(frozen=True)
class Grams:
    """Parameters.  At most ``rows`` labelled documents are learnt from, in groups of about ``group_rows``; every n-gram has a place among 2^bits."""

    sizes: tuple[int, ...] = (3, 4, 5, 6)
    bits: int = 18
    rows: int = 20000
    group_rows: int = 5000
    smooth: float = 0.5
    epochs: int = 8
    rate: float = 0.1
    decay: float = 1e-5
    threshold: float = 0.3


def grams(data: np.ndarray, offsets: np.ndarray, how: Grams) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, first of each row) of the distinct character n-grams of each row, squeezed."""
    codes, at = tk.characters(*squeezed(data, offsets))
    n = len(codes)
    pad = np.concatenate([codes, np.zeros(max(how.sizes), dtype=np.uint64)])
    run = np.zeros(n, dtype=np.uint64)
    found = []
    for k in range(1, max(how.sizes) + 1):
        run += pad[k - 1 : k - 1 + n] * tk.STEP[k - 1]
        if k in how.sizes:
            found.append((((run ^ (run >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - how.bits)).astype(np.int32))
    seen = np.zeros(1 << how.bits, dtype=bool)
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        here = np.concatenate([b[lo : max(lo, hi - k + 1)] for k, b in zip(how.sizes, found, strict=True)])
        if len(here) < 1024:
            out.append(np.unique(here))
        else:
            seen[here] = True
            here = np.flatnonzero(seen)
            seen[here] = False
            out.append(here.astype(np.int32))
    first = np.concatenate([[0], np.cumsum([len(o) for o in out])]).astype(np.int64)
    return np.concatenate(out) if out else np.zeros(0, np.int32), first


@dataclass
class Linear:
    """The log-count ratio and the weight of each bucket, and the intercept; a text's scaled features have length 1."""

    how: Grams
    ratio: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        b, first = grams(data, offsets, self.how)
        length = np.sqrt(segment_sum((self.ratio**2)[b], first))
        return sigmoid(self.bias + segment_sum((self.weight * self.ratio)[b], first) / np.maximum(length, 1e-12))


def counted(some: DataFrame, how: Grams) -> tuple[np.ndarray, np.ndarray]:
    """(documents of each class with each bucket, documents of each class); at most 2^bits + 1 rows reach the driver."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << how.bits), dtype=np.int64)
        rows = np.zeros(2, dtype=np.int64)
        for batch in batches:
            data, offsets = tk.buffers(batch.column(0))
            y = np.asarray(batch.column(1))
            rows += np.bincount(y, minlength=2)
            for lo, hi in tk.spans(offsets, 1 << 18):
                b, first = grams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], how)
                each = np.repeat(y[lo:hi], np.diff(first))
                for c in (0, 1):
                    n[c] += np.bincount(b[each == c], minlength=1 << how.bits)
        has = np.flatnonzero(n.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(has, -1)), pa.array(np.append(n[0, has], rows[0])), pa.array(np.append(n[1, has], rows[1]))], names=["b", "n0", "n1"])

    got = some.select("t", "y").mapInArrow(counts, "b bigint, n0 bigint, n1 bigint").groupBy("b").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    b, n0, n1 = (np.asarray(got[c]) for c in ("b", "n0", "n1"))
    n = np.zeros((2, 1 << how.bits))
    n[0, b[b >= 0]], n[1, b[b >= 0]] = n0[b >= 0], n1[b >= 0]
    return n, np.array([n0[b == -1].sum(), n1[b == -1].sum()], dtype=float)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", target: str = "toxic", parts: int = 4, held: int = 2, how: Grams = Grams()) -> Linear:
    """Log-count ratios over the sample, then logistic regression on all n-grams so scaled, by the executors.

    The sample is written once.  Groups of it, dealt by hash of the id, are fitted on their
    own and their weights averaged; 2^bits numbers a group reach the driver, and the groups
    are as many as the bounded sample has ``group_rows``.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    some = scratch.save(sampled(docs, labels, text, target, parts, held, how.rows), "sample")
    n, total = counted(some, how)
    ratio = np.zeros(1 << how.bits)
    if total.min() == 0:
        return Linear(how, ratio, ratio, 0.0 if total.sum() == 0 else float(np.log((total[1] + how.smooth) / (total[0] + how.smooth))))
    used = n.sum(0) > 0
    ratio[used] = (np.log((n[1] + how.smooth) / (total[1] + 2 * how.smooth)) - np.log((n[0] + how.smooth) / (total[0] + 2 * how.smooth)))[used]
    groups = max(1, round(float(total.sum()) / how.group_rows))
    sent = docs.sparkSession.sparkContext.broadcast(ratio)
    prior = float(np.log(total[1] / total[0]))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = Logistic(sent.value, prior, how)
        index, sizes, ys = [], [], []
        for batch in batches:
            data, offsets = tk.buffers(batch.column(0))
            y = np.asarray(batch.column(1)).astype(float)
            for lo, hi in tk.spans(offsets, 1 << 18):
                x, first = grams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], how)
                index.append(x), sizes.append(np.diff(first)), ys.append(y[lo:hi])
                if sum(map(len, index)) > HELD:
                    fit.more(index, sizes, ys)
                    index, sizes, ys = [], [], []
        fit.more(index, sizes, ys)
        if fit.rows:
            yield pa.RecordBatch.from_arrays([pa.array([fit.rows]), pa.array([fit.bias]), pa.array([fit.weight.astype(np.float32).tobytes()])], names=["n", "bias", "w"])

    dealt = some.repartitionById(groups, F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).sortWithinPartitions(F.xxhash64("id"), "id")
    got = dealt.select("t", "y").mapInArrow(learn, "n bigint, bias double, w binary").toArrow().sort_by([("n", "ascending"), ("bias", "ascending")])
    sent.unpersist()
    scratch.drop("sample")
    share = np.asarray(got["n"]) / np.asarray(got["n"]).sum()
    weight = sum(a * np.frombuffer(w, np.float32).astype(float) for a, w in zip(share, got["w"].to_pylist(), strict=True))
    return Linear(how, ratio, weight, float(share @ np.asarray(got["bias"])))


#: n-grams of documents held together while a group is fitted; a group with more is fitted piece by piece.
HELD = 40_000_000


class Logistic:
    """Logistic regression by Adagrad in a fixed order; a document's features are the ratios of its n-grams, of length 1."""

    def __init__(self, ratio: np.ndarray, prior: float, how: Grams):
        self.how, self.ratio, self.bias, self.rows = how, ratio, prior, 0
        self.weight, self.g, self.gb = np.zeros(len(ratio)), np.full(len(ratio), 1e-6), 1e-2

    def more(self, index: list[np.ndarray], sizes: list[np.ndarray], ys: list[np.ndarray]) -> None:
        if not index:
            return
        x, n, y = np.concatenate(index), np.concatenate(sizes), np.concatenate(ys)
        first = np.concatenate([[0], np.cumsum(n)])
        length = np.maximum(np.sqrt(segment_sum((self.ratio**2)[x], first)), 1e-12)
        rng, size = np.random.Generator(np.random.PCG64(3)), len(self.ratio)
        for _ in range(self.how.epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), 64):
                rows = order[lo : lo + 64]
                f = np.concatenate([[0], np.cumsum(n[rows])])
                i = np.concatenate([x[first[r] : first[r + 1]] for r in rows])
                v = self.ratio[i] / np.repeat(length[rows], n[rows])
                err = (sigmoid(self.bias + segment_sum(self.weight[i] * v, f)) - y[rows]) / len(rows)
                d = np.bincount(i, np.repeat(err, n[rows]) * v, minlength=size) + self.how.decay * self.weight
                self.g += d * d
                self.weight -= self.how.rate * d / np.sqrt(self.g)
                self.gb += err.sum() ** 2
                self.bias -= self.how.rate * err.sum() / np.sqrt(self.gb)
        self.rows += len(y)


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", parts: int = 4, held: int = 2, how: Grams = Grams()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    score is the probability of toxic 1, from the text alone.  Null and empty texts, and
    those of under three characters, have no n-grams and get the intercept's score.  Rows with a null doc_id are scored, never
    learnt from and not held out.  Where the labels hold one class or none, every
    document gets the same score.  Repeated rows are scored alike, and of documents with one
    doc_id the least text is learnt from; further columns are not read.  An empty table
    gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, text, "toxic", parts, held, how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.buffers(batch.column(0))
            s = [sent.value.score(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in tk.spans(offsets, 1 << 18)]
            s = np.concatenate(s) if s else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(s), pa.array((s >= how.threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select(F.col(text).alias("t"), F.col("doc_id").alias("id")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    return out.select("doc_id", F.coalesce(fold("doc_id", parts) == held, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_query(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
