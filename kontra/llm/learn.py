"""What the two classifiers share: folds, and the bounded sample of labelled rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str, parts: int) -> Column:
    """crc32(doc_id as text) mod parts; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def labelled(labels: DataFrame, target: str, parts: int, held: int, bound: int) -> DataFrame:
    """(doc_id, y) of at most ``bound`` labelled rows outside the held-out fold, in hash order.

    A fold, a null id or a null label is never learnt from; of contradicting labels of one
    document the larger counts.  The result is small by its bound and can be broadcast.
    """
    some = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & (fold("doc_id", parts) != held))
    some = some.groupBy("doc_id").agg(F.max(F.col(target).cast("int")).alias("y")).where("y in (0, 1)")
    return some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def sampled(docs: DataFrame, labels: DataFrame, text: str, target: str, parts: int, held: int, bound: int) -> DataFrame:
    """(t, y, id): the texts of ``labelled``; of documents with one id the least text, so that there are no more rows than ``bound``."""
    few = labelled(labels, target, parts, held, bound).withColumnRenamed("doc_id", "id")
    some = docs.select(F.col(text).alias("t"), F.col("doc_id").alias("id")).join(F.broadcast(few), "id")
    return some.groupBy("id").agg(F.min("t").alias("t"), F.first("y").alias("y")).select("t", "y", "id")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def ragged(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()), np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths()).astype(np.int64))])


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the rows values[offsets[i]:offsets[i+1]]; empty ones are 0."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), dtype=values.dtype)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], axis=0)
    return out
