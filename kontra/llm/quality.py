"""Operator 6: quality by a factorisation machine over hashed words, structure and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontra.llm import textkit as tk
from kontra.llm.learn import fold, labelled, ragged, segment_sum, sigmoid

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()?"]] = True
STATS = 14


@dataclass(frozen=True)
class Machine:
    """Parameters.  At most ``rows`` labelled documents are learnt from."""

    buckets: int = 1 << 15
    rank: int = 8
    rows: int = 8000
    epochs: int = 12
    rate: float = 0.1
    decay: float = 2e-5
    threshold: float = 0.3


def features(data: np.ndarray, offsets: np.ndarray, length: np.ndarray, how: Machine) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, value, first of each row): hashed words, then structure statistics, then metadata.

    ``length`` is the documents' own length column, NaN where null.
    """
    h, starts, ends, rows = tk.words(data, offsets)
    n = np.diff(rows)
    owner = np.repeat(np.arange(len(n)), n)
    code = (owner.astype(np.uint64) << np.uint64(32)) | (h % np.uint64(how.buckets))
    code, count = np.unique(code, return_counts=True)
    row = (code >> np.uint64(32)).astype(np.int64)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(row, value**2, minlength=len(n)))
    value = value / np.maximum(norm[row], 1e-9)
    distinct = np.bincount(row, minlength=len(n))

    def share(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask)])
        return (c[offsets[1:]] - c[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)

    size = np.diff(offsets)
    lens = ends - starts
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    per_word = lambda x: np.bincount(owner, x, minlength=len(n)) / np.maximum(n, 1)
    mean = per_word(lens)
    stats = np.stack([
        np.ones(len(n)),
        np.log1p(size) / 8,
        np.log1p(n) / 6,
        mean / 8,
        np.sqrt(np.maximum(per_word(lens.astype(float) ** 2) - mean**2, 0)) / 5,
        share((data >= 65) & (data <= 90)) * 3,
        share((data >= 48) & (data <= 57)) * 5,
        share(SYMBOLS[data]) * 4,
        share(data == 124) * 8,
        share(data == 10) * 10,
        share(data >= 128) * 3,
        distinct / np.maximum(n, 1),
        per_word(SYMBOLS[last]) * 2,
        np.where(np.isnan(length), -1.0, np.log1p(np.maximum(np.nan_to_num(length), 0)) / 8),
    ], 1)
    per = distinct + STATS
    first = np.concatenate([[0], np.cumsum(per)])
    index, out = np.empty(first[-1], np.int64), np.empty(first[-1])
    at = np.arange(len(code)) - np.repeat(np.cumsum(distinct) - distinct, distinct) + np.repeat(first[:-1], distinct)
    index[at], out[at] = (code & np.uint64(0xFFFFFFFF)).astype(np.int64), value
    tail = (first[1:] - STATS)[:, None] + np.arange(STATS)
    index[tail], out[tail] = how.buckets + np.arange(STATS), stats
    return index, out, first


class Factors:
    """score = w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2), linear in the features."""

    def __init__(self, how: Machine, seed: int = 11):
        n = how.buckets + STATS
        self.how, self.w0, self.w = how, 0.0, np.zeros(n)
        self.v = np.random.Generator(np.random.PCG64(seed)).normal(0, 0.02, (n, how.rank))

    def margin(self, index: np.ndarray, value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vx = self.v[index] * value[:, None]
        total = segment_sum(vx, first)
        pairs = 0.5 * ((total**2).sum(1) - segment_sum((vx**2).sum(1), first))
        return self.w0 + segment_sum(self.w[index] * value, first) + pairs, total, vx

    def fit(self, index: np.ndarray, value: np.ndarray, first: np.ndarray, y: np.ndarray) -> Factors:
        """Adagrad over small batches in a fixed order."""
        how, rng = self.how, np.random.Generator(np.random.PCG64(5))
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.w0 = float(np.log(p / (1 - p)))
        gw, gv = np.full(len(self.w), 1e-2), np.full(self.v.shape, 1e-2)
        for _ in range(how.epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), 64):
                rows = order[lo : lo + 64]
                n = first[rows + 1] - first[rows]
                f = np.concatenate([[0], np.cumsum(n)])
                at = np.arange(f[-1]) - np.repeat(f[:-1], n) + np.repeat(first[rows], n)
                i, x = index[at], value[at]
                m, total, vx = self.margin(i, x, f)
                err = np.repeat(sigmoid(m) - y[rows], n) / len(rows)
                used, where = np.unique(i, return_inverse=True)
                dw = np.bincount(where, err * x, minlength=len(used)) + how.decay * self.w[used]
                each = (err * x)[:, None] * (np.repeat(total, n, axis=0) - vx)
                dv = np.stack([np.bincount(where, each[:, k], minlength=len(used)) for k in range(how.rank)], 1) + how.decay * self.v[used]
                gw[used] += dw**2
                gv[used] += dv**2
                self.w[used] -= how.rate * dw / np.sqrt(gw[used])
                self.v[used] -= how.rate * 0.5 * dv / np.sqrt(gv[used])
        return self


def _batches(batches: Iterator[pa.RecordBatch], how: Machine, text: int = 0, length_: int = 1):
    """(batch, rows lo to hi, features); ``text`` and ``length_``: places of these columns."""
    for batch in batches:
        data, offsets = tk.buffers(batch.column(text))
        length = np.asarray(batch.column(length_).cast(pa.float64()).fill_null(float("nan")))
        for lo, hi in tk.spans(offsets, 1 << 19):
            yield batch, lo, hi, features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], length[lo:hi], how)


def _inputs(docs: DataFrame, text: str) -> DataFrame:
    """text and n_chars (null where there is no such column) under fixed names, then doc_id."""
    length = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select(F.col(text).alias("t"), length.alias("n"), F.col("doc_id").alias("id"))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", target: str = "quality", parts: int = 5, held: int = 0, how: Machine = Machine()) -> Factors:
    """Fit on at most ``how.rows`` labelled documents (their features, not their texts, reach the driver)."""
    sample = labelled(labels, target, parts, held, how.rows).withColumnRenamed("doc_id", "id")
    # of documents with one id the least text is learnt from, so that no more rows than the bound reach the driver
    some = _inputs(docs, text).join(F.broadcast(sample), "id").groupBy("id").agg(F.min(F.struct("t", "n")).alias("d"), F.first("y").alias("y"))
    some = some.select("d.t", "d.n", "y", "id")

    def run(batches):
        for batch, lo, hi, (i, x, f) in _batches(batches, how):
            lists = [pa.ListArray.from_arrays(pa.array(f.astype(np.int32)), pa.array(a)) for a in (i.astype(np.int32), x.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([*lists, batch.column(2).slice(lo, hi - lo), batch.column(3).slice(lo, hi - lo)], names=["i", "x", "y", "id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = some.mapInArrow(run, f"i array<int>, x array<float>, y int, id {kind}").toArrow()
    model = Factors(how)
    if not got.num_rows:
        model.v[:] = 0
        return model
    got = got.sort_by("id")
    (i, f), (x, _) = ragged(got["i"]), ragged(got["x"])
    return model.fit(i.astype(np.int64), x.astype(np.float64), f, np.asarray(got["y"]).astype(float))


def scored(docs: DataFrame, model: Factors, text: str = "text") -> DataFrame:
    """doc_id, score, predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    how = model.how

    def run(batches):
        for batch, lo, hi, (i, x, f) in _batches(batches, how):
            s = sigmoid(sent.value.margin(i, x, f)[0])
            yield pa.RecordBatch.from_arrays([batch.column(2).slice(lo, hi - lo), pa.array(s), pa.array((s >= how.threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _inputs(docs, text).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, text: str = "text", parts: int = 5, held: int = 0, how: Machine = Machine()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    score is the probability of quality 1.  Inputs are the text and the length column
    n_chars (metadata; may be absent or null); labels, lang, source and doc_id are not.
    Null and empty texts get the score of a text without words.  Rows with a null doc_id
    are scored, never learnt from and not held out.  Without labels every score is 0.5.
    Repeated rows are scored alike; further columns are not read.  An empty table gives an
    empty one.
    """
    out = scored(docs, train(docs, labels, text, "quality", parts, held, how), text)
    return out.select("doc_id", F.coalesce(fold("doc_id", parts) == held, F.lit(False)).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, text: str = "text", how: Machine = Machine()) -> DataFrame:
    """``docs`` without those that the classifier rejects; the rest are unchanged."""
    model = train(docs, labels, text, how=how)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    length = F.col("n_chars").cast("double") if "n_chars" in names else F.lit(None).cast("double")
    # the text goes to the workers once, as the column that they return
    flat = docs.select(length.alias("n"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at = names.index(text) + 1
    schema = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names))

    def run(batches):
        for batch, lo, hi, (i, x, f) in _batches(batches, how, at, 0):
            keep = sent.value.margin(i, x, f)[0]
            part = batch.slice(lo, hi - lo).filter(pa.array(sigmoid(keep) >= how.threshold))
            yield pa.RecordBatch.from_arrays(part.columns[1:], names=part.schema.names[1:])

    return flat.mapInArrow(run, schema).toDF(*names)


def op6_query(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
