"""Operator 13: packing of token sequences by minimum bin slack.

What decides a packing is how many pieces there are of each length, a table of no more
rows than a sequence has tokens, whatever the number of documents.  A bin takes the
longest piece left, and of the others the combination that fills it best, found by a
subset sum over the available lengths with one bit for each sum; those pieces are then
removed.  The same combination stays the choice while its pieces last, so it is taken
that many times at once.  Pieces are numbered within their length by counts of each
task, and a piece's number tells its place.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kontra.llm import textkit as tk
from kontra.llm.scratch import Scratch, if_small
from kontra.llm.tokens import byte_symbols, default_path


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, uses) of a combination with the greatest sum up to ``room``; longer pieces are preferred."""
    mask, sums, tried = (1 << (room + 1)) - 1, [1], []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        s, left, some = sums[-1], min(counts[length], room // length), 1
        while left:
            some = min(some, left)
            s |= (s << (some * length)) & mask
            left, some = left - some, 2 * some
        sums.append(s)
        tried.append(length)
        if s >> room & 1:
            break
    at, out = sums[-1].bit_length() - 1, []
    for length, before in zip(reversed(tried), reversed(sums[:-1]), strict=True):
        uses = 0
        while not before >> (at - uses * length) & 1:
            uses += 1
        if uses:
            out.append((length, uses))
            at -= uses * length
    return out[::-1]


def bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins of this kind, [(length, pieces of it in one bin)]) until no piece is left."""
    left, out = {k: n for k, n in counts.items() if n}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        more = dict(fullest(left, capacity - longest))
        left[longest] += 1
        more[longest] = more.get(longest, 0) + 1
        times = min(left[k] // n for k, n in more.items())
        for k, n in more.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((times, sorted(more.items(), reverse=True)))
    return out


def places(plan: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first and end of the numbers, pieces in one bin, first sequence, first offset)."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for times, kinds in plan:
        offset = 0
        for length, n in kinds:
            lo = used.get(length, 0)
            used[length] = lo + times * n
            out.append((length, lo, used[length], n, sequence, offset))
            offset += length * n
        sequence += times
    return out


#: Fixed value: how a byte-level vocabulary file cuts texts into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Token ids of texts, equal to those of the tokenizers library for the vocabulary file.

    Where the file's ids ascend with its merges, an encoder that always merges the pair
    with the least id gives the same ids in a third of the time, and is used.  Files of
    another make, and texts that it refuses (white space of some 100,000 characters in a
    row), are encoded by the library itself.
    """

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        path = path or default_path()
        self.library, self.fast = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        usual = model.get("type") == "BPE" and not spec.get("normalizer") and not spec.get("post_processor") and not model.get("ignore_merges")
        if usual and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space"):
            special = {t["content"]: t["id"] for t in spec["added_tokens"]}
            made = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
            plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
            if plain and made == sorted(made):
                import tiktoken

                symbols = byte_symbols()
                ranks = {bytes(symbols[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
                self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # its pattern gives up on long white space
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@cache
def _shared(path: str | None) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path)


def pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = 2048, path: str | None = None, end: int = 0, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; task and nth number the pieces of one length.

    ``ids`` adds the ids themselves.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = _shared(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            offsets = tk.buffers(batch.column(1))[1]
            for lo, hi in tk.spans(offsets):
                got = [encoder(t or "") for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                n = np.array([len(g) + 1 for g in got], dtype=np.int64)
                stop = np.array([end], dtype="<u4")
                out = np.concatenate([x for g in got for x in (g, stop)]).astype("<u4", copy=False)
                rows, begin = np.arange(hi - lo), np.cumsum(n) - n
                count = -(-n // capacity)
                of = np.repeat(rows, count)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                head = n - (count - 1) * capacity
                start = np.where(piece == 0, 0, head[of] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[of], capacity)
                at = begin[of] + start
                raw = memoryview(out).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                sorted_ = length[order]
                nth = np.empty(len(of), dtype=np.int64)
                nth[order] = np.arange(len(of)) - np.searchsorted(sorted_, sorted_) + seen[sorted_]
                seen += np.bincount(length, minlength=capacity + 1)
                columns = [batch.column(0).take(pa.array(of + lo)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(of), task), pa.int32()), pa.array(nth)]
                if ids:
                    # pieces follow one another, so they are the rows of one list array
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(out)), pa.int32()), pa.array(out.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"] + ["ids"] * ids
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint" + ", ids array<int>" * ids
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, schema)


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = 2048, path: str | None = None, end: int = 0, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece, and ``ids`` if asked for.

    A document is its ids as the tokenizers library gives them for the vocabulary file,
    then ``end``; null text counts as empty, so the least document has one id.  Documents
    over ``capacity`` are cut into pieces of that length, the first taking what is over.
    Sequences hold ``capacity`` ids at most, their pieces follow one another from offset
    0, and their number is what minimum bin slack needs.  Every row is packed, repeated
    ones too; null ids are passed on; further columns are not read; an empty table gives
    an empty one.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.save(pieces(docs, text, doc_id, capacity, path, end, ids), "pieces", release=True)
    # each task's share of the pieces of a length; a window sees a row for each task
    shares = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shares = scratch.save(shares.withColumn("number", F.coalesce(F.sum("c").over(before), F.lit(0))), "shares")
    # at most ``capacity`` rows
    counts = {r["length"]: r["n"] for r in shares.groupBy("length").agg(F.sum("c").alias("n")).collect()}
    plan = docs.sparkSession.createDataFrame(places(bins(counts, capacity)), "l long, lo long, hi long, uses long, sequence long, first long")
    plan, _ = if_small(scratch.save(plan, "plan"))
    deals = shares.join(plan, (F.col("length") == F.col("l")) & (F.col("lo") < F.col("number") + F.col("c")) & (F.col("number") < F.col("hi")))
    deals = deals.select(F.col("task").alias("task0"), F.col("l"), (F.col("lo") - F.col("number")).alias("lo"), (F.col("hi") - F.col("number")).alias("hi"), "uses", "sequence", "first")
    deals, _ = if_small(scratch.save(deals, "deals"))
    out = cut.join(deals, (F.col("task") == F.col("task0")) & (F.col("length") == F.col("l")) & (F.col("nth") >= F.col("lo")) & (F.col("nth") < F.col("hi")))
    k = F.col("nth") - F.col("lo")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.floor(k / F.col("uses"))).alias("sequence_id"), (F.col("first") + k % F.col("uses") * F.col("length")).alias("offset"), *["ids"] * ids)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, lengths) of what ``pack`` gives with ``ids``; a sequence is a row of bounded size."""
    one = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "length"))).alias("p")
    return packed.groupBy("sequence_id").agg(one).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))


def op13_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
