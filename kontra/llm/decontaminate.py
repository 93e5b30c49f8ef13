"""Operator 9: benchmark decontamination by SimHash of item-sized windows.

Windows that share a shingle with an item of their size meet that item as 128-bit
fingerprints.  A fingerprint has two blocks of 64 bits; two that differ in at most
``radius`` bits differ in at most half of these in one of the blocks, which few others do:
a pair is dropped by its blocks, then by all bits, and what is left is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontra.llm import textkit as tk
from kontra.llm.scratch import Scratch

BITS, BLOCKS = 128, 2


@dataclass(frozen=True)
class Windows:
    """Parameters.  Any fingerprint within ``radius`` of an item's has a block of 64 bits that differs in at most radius // 2.

    A radius of 128 lets every fingerprint pass: then nothing but the exact similarity
    decides.  ``bytes_per_pass`` bounds the index that is sent to the executors at once.
    """

    k: int = 5
    threshold: float = 0.8
    radius: int = 47
    bytes_per_pass: int = 64 << 20


#: Bytes of the index, and of the text that it is made from, for an item and for each of its words.
PER_ITEM, PER_WORD = 160, 64
#: Pairs of a window and an item that are looked at together.
PAIRS = 1 << 19


def signs(words: np.ndarray) -> np.ndarray:
    """One row of +1 and -1 for each word."""
    both = np.stack([words, tk.mix64(words ^ tk.BASE)], 1)
    return np.unpackbits(both.view(np.uint8), axis=1).astype(np.int32) * 2 - 1


def fingerprints(words: np.ndarray, size: int, starts: np.ndarray) -> np.ndarray:
    """SimHash (BLOCKS numbers of 64 bits) of the windows of ``size`` words at ``starts``, which ascend."""
    out = np.zeros((len(starts), BLOCKS), dtype=np.uint64)
    for part in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(starts) > size) + 1):
        for lo in range(0, len(part), 4096):
            at = starts[part[lo : lo + 4096]]
            if not len(at):
                continue
            total = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(signs(words[at[0] : at[-1] + size]), axis=0, dtype=np.int32)])
            at = at - at[0]
            out[part[lo : lo + 4096]] = np.packbits(total[at + size] > total[at], axis=1).view(np.uint64)
    return out


def near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which rows of fingerprints are within the radius: some block must be near, then all bits are counted."""
    apart = np.bitwise_count(a ^ b)
    some = np.flatnonzero((apart <= radius // BLOCKS).any(axis=1))
    return some[apart[some].sum(axis=1, dtype=np.int64) <= radius]


def spread(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the entries of these rows of a ragged array, how many each row has)."""
    n = first[rows + 1] - first[rows]
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[rows], n), n


class Items:
    """Benchmark items as flat arrays: shingles and where they occur, each item's bag of shingles, fingerprints."""

    def __init__(self, texts: list[str], how: Windows):
        self.how, self.ratio = how, Fraction(str(how.threshold))
        h, _, _, rows = tk.words(*tk.buffers(pa.array(texts, pa.large_string())))
        self.size = np.diff(rows)
        self.prints = np.zeros((len(texts), BLOCKS), dtype=np.uint64)
        gram = np.minimum(how.k, self.size)
        #: gram length -> (distinct shingles, first of their items and the end, items)
        self.grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        owner, value = [], []
        for g in np.unique(gram[gram > 0]).tolist():
            for i in np.flatnonzero(gram == g):
                s, _ = tk.word_shingles(h[rows[i] : rows[i + 1]], np.array([0, self.size[i]]), g)
                owner.append(np.full(len(s), i, dtype=np.int32))
                value.append(s)
                self.prints[i] = fingerprints(h[rows[i] : rows[i + 1]], int(self.size[i]), np.zeros(1, np.int64))
        owner, value = (np.concatenate(owner), np.concatenate(value)) if owner else (np.zeros(0, np.int32), np.zeros(0, np.uint64))
        order = np.lexsort((value, owner))
        owner, value = owner[order], value[order]
        new = np.ones(len(value), dtype=bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        #: each item's distinct shingles, ascending, and how often it has them
        self.bag_of, self.bag, self.count = owner[at], value[at], np.diff(np.append(at, len(value))).astype(np.int32)
        self.first = np.searchsorted(self.bag_of, np.arange(len(texts) + 1))
        for g in np.unique(gram[gram > 0]).tolist():
            mine = np.flatnonzero(gram[self.bag_of] == g)
            by = mine[np.argsort(self.bag[mine], kind="stable")]
            values, begin = np.unique(self.bag[by], return_index=True)
            seen = np.zeros(1 << 20, dtype=bool)
            seen[(values >> np.uint64(44)).astype(np.int64)] = True
            self.grams[g] = (values, np.append(begin, len(by)), self.bag_of[by], np.packbits(seen))
        del self.bag_of

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.size, self.prints, self.bag, self.count, self.first)) + sum(x.nbytes for t in self.grams.values() for x in t)

    def hits(self, h: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each gram length: shingles and each row's first; then where rows have a shingle of an item, its number, and the row."""
        for g, (values, _, _, packed) in self.grams.items():
            s, first = tk.word_shingles(h, rows, g)
            at = np.flatnonzero(np.unpackbits(packed)[(s >> np.uint64(44)).astype(np.int64)])
            place = np.minimum(np.searchsorted(values, s[at]), len(values) - 1)
            same = values[place] == s[at]
            at, place = at[same], place[same]
            owner = np.searchsorted(first, at, side="right") - 1
            long = rows[owner + 1] - rows[owner] >= g
            yield g, s, first, at[long], place[long], owner[long]

    def scan(self, h: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """(row, item, first word, words, similarity): the best window of each item that a row of words holds."""
        for g, s, first, at, place, owner in self.hits(h, rows):
            _, begin, members, _ = self.grams[g]
            for row in np.unique(owner):
                mine = owner == row
                here, lists = at[mine] - first[row], place[mine]
                entry, n = spread(begin, lists)
                item, where = members[entry], np.repeat(here, n)
                words, shingles = h[rows[row] : rows[row + 1]], s[first[row] : first[row + 1]]
                size = self.size[item]
                for n_words in np.unique(size).tolist():
                    of = size == n_words
                    yield from self.windows(int(row), g, n_words, where[of], item[of], words, shingles)

    def windows(self, row: int, g: int, size: int, where: np.ndarray, item: np.ndarray, words: np.ndarray, shingles: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """The windows of an item's size around each shared shingle against that item; any other has similarity 0 with it."""
        n = min(size, len(words))
        lo, hi = np.maximum(where - (n - g), 0), np.minimum(where, len(words) - n) + 1
        best: dict[int, tuple[float, int]] = {}
        # items in parts of a bounded number of pairs; an item's pairs stay together
        order = np.argsort(item, kind="stable")
        lo, hi, item = lo[order], hi[order], item[order]
        upto = np.cumsum(hi - lo)
        begin = 0
        while begin < len(item):
            end = int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS, side="right"))
            end = max(end, begin + 1)
            end = int(np.searchsorted(item, item[end - 1], side="right"))
            pair = self.pairs(lo[begin:end], hi[begin:end], item[begin:end], len(words))
            start, of = pair // len(self.size), pair % len(self.size)
            distinct, back = np.unique(start, return_inverse=True)
            prints = fingerprints(words, n, distinct)
            for i in range(0, len(pair), PAIRS):
                for j in near(prints[back[i : i + PAIRS]], self.prints[of[i : i + PAIRS]], self.how.radius) + i:
                    x, y = int(start[j]), int(of[j])
                    sim = self.similarity(shingles[x : x + n - g + 1], y)
                    if sim is not None and (y not in best or sim > best[y][0]):
                        best[y] = (sim, x)
            begin = end
        for y, (sim, x) in best.items():
            yield row, y, x, n, sim

    def pairs(self, lo: np.ndarray, hi: np.ndarray, item: np.ndarray, n: int) -> np.ndarray:
        """start * items + item of every window of the ranges, once each, ascending."""
        out = []
        for k in np.unique(item):
            mine = item == k
            mark = np.zeros(n + 2, dtype=np.int32)
            np.add.at(mark, lo[mine], 1)
            np.add.at(mark, hi[mine], -1)
            out.append(np.flatnonzero(np.cumsum(mark) > 0) * len(self.size) + k)
        return np.sort(np.concatenate(out))

    def similarity(self, window: np.ndarray, item: int) -> float | None:
        """Weighted Jaccard of shingle counts (sum of least over sum of greatest), or None below the threshold."""
        own, counts = self.bag[self.first[item] : self.first[item + 1]], self.count[self.first[item] : self.first[item + 1]]
        values, n = np.unique(window, return_counts=True)
        at = np.minimum(np.searchsorted(own, values), len(own) - 1)
        same = own[at] == values
        least = int(np.minimum(n[same], counts[at[same]]).sum())
        most = len(window) + int(counts.sum()) - least
        return least / most if least * self.ratio.denominator >= most * self.ratio.numerator else None


def passes(benchmark: DataFrame, item_id: str, text: str, how: Windows) -> Iterator[tuple[Items, list]]:
    """The items in as many parts as keep each index, and the text that it is made from, under ``bytes_per_pass``; by hash, so a part may pass it by a little."""
    items = benchmark.select(F.col(item_id).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    words = F.regexp_count("t", F.lit(r"[^\x20\x09-\x0D]+"))
    size = items.agg(F.sum((F.octet_length("t") + PER_ITEM + PER_WORD * words).cast("bigint"))).first()[0] or 0
    parts = -(-size // how.bytes_per_pass) or 1
    for p in range(parts):
        got = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == p).orderBy("i", "t").collect()
        if got:
            yield Items([r.t for r in got], how), [r.i for r in got]


def text_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, first word of each row and the end) of texts, half a MiB at a time."""
    data, offsets = tk.buffers(column)
    for lo, hi in tk.spans(offsets, 1 << 19):
        h, _, _, rows = tk.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        yield lo, h, rows


def kept_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The same of the rows that ``hashed`` gives."""
    raw = column.to_pylist()
    yield 0, np.frombuffer(b"".join(raw), dtype=np.uint64), np.concatenate([[0], np.cumsum([len(r) // 8 for r in raw])]).astype(np.int64)


def hashed(docs: DataFrame, kind: str) -> DataFrame:
    """doc_id and the hashes of the words, eight bytes each, of (doc_id, t); texts without words go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, h, rows in text_words(batch.column(1)):
                some = np.flatnonzero(np.diff(rows))
                if len(some):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some + lo)), pa.array([h[rows[i] : rows[i + 1]].tobytes() for i in some.tolist()], pa.binary())], names=["doc_id", "words"])

    return docs.mapInArrow(run, f"doc_id {kind}, words binary")


#: Bits of the filter of all items' shingles, and how many each shingle sets.
FILTER, PROBES = 1 << 28, 4


def probes(shingles: np.ndarray, g: int) -> np.ndarray:
    """Places in the filter, PROBES rows."""
    h = tk.mix64(shingles + np.uint64(g))
    return np.stack([(h >> np.uint64(9 * i)) % np.uint64(FILTER) for i in range(PROBES)])


def with_shingles(words: DataFrame, benchmark: DataFrame, text: str, how: Windows, kind: str) -> DataFrame:
    """The rows of ``hashed`` that may hold a shingle of some item, by a filter of fixed size over all of them."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, _, _, rows = tk.words(*tk.buffers(batch.column(0)))
            size = np.diff(rows)
            for g in range(1, how.k + 1):
                fit = np.flatnonzero(size == g if g < how.k else size >= g)
                bits = [np.unique(probes(tk.word_shingles(h[rows[i] : rows[i + 1]], np.array([0, size[i]]), g)[0], g)) for i in fit.tolist()]
                if bits:
                    at = np.unique(np.concatenate(bits))
                    yield pa.RecordBatch.from_arrays([pa.array([g] * len(at), pa.int32()), pa.array(at.astype(np.int64))], names=["g", "at"])

    # as bytes, 2^16 bits a row, so that no more than the filter reaches the driver
    marked = benchmark.select(F.col(text)).mapInArrow(place, "g int, at bigint")
    pieces = marked.groupBy(F.shiftright("at", 16).alias("piece")).agg(F.collect_set((F.col("at") % 65536).cast("int")).alias("bits"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b in batch.column(1).to_pylist():
                bits = np.zeros(65536, dtype=bool)
                bits[b] = True
                out.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["piece", "bits"])

    whole = np.zeros(FILTER // 8, dtype=np.uint8)
    for r in pieces.mapInArrow(pack, "piece bigint, bits binary").toLocalIterator():
        whole[r["piece"] * 8192 : (r["piece"] + 1) * 8192] = np.frombuffer(r["bits"], dtype=np.uint8)
    lengths = [r["g"] for r in marked.select("g").distinct().collect()]
    sent = words.sparkSession.sparkContext.broadcast(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, h, rows = next(kept_words(batch.column(1)))
            keep = np.zeros(batch.num_rows, dtype=bool)
            for g in lengths:
                s, first = tk.word_shingles(h, rows, g)
                at = probes(s, g)
                found = np.flatnonzero((sent.value[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0))
                keep[np.searchsorted(first, found, side="right") - 1] = True
            if keep.any():
                yield batch.filter(pa.array(keep))

    return words.mapInArrow(run, f"doc_id {kind}, words binary")


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", how: Windows = Windows()) -> DataFrame:
    """One row for each document and benchmark item whose passage it holds.

    A document holds an item of n words if one of its windows of n words (all its words,
    if fewer) has weighted Jaccard similarity of five-word shingle counts of 0.8 or more
    with it.  Words are runs outside ``[\\x20\\x09-\\x0D]``, A-Z lower-cased.  Items of
    one to four words take that many words as their only shingle; items and documents
    without words match nothing; null texts are empty.  Columns: doc_id, item_id,
    first_word (of the best window, the first of equals), n_words, similarity.  Repeated
    rows give repeated results; null ids are passed on; further columns are not read.  Of
    items with one id each is looked for.  An empty table of either kind gives no rows.
    """
    spark, out = docs.sparkSession, None
    kind, key = docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType
    schema = f"doc_id {kind}, item int, first_word bigint, n_words bigint, similarity double"
    todo = passes(benchmark, item_id, item_text, how)
    first, second = next(todo, None), next(todo, None)
    if first is None:
        return spark.createDataFrame([], f"doc_id {kind}, item_id {key.simpleString()}, first_word bigint, n_words bigint, similarity double")
    source, read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")), text_words
    if second is not None:
        # several indexes: the documents are read once, those without any item's shingle stay behind
        source, read = Scratch(spark, "decontaminate").save(with_shingles(hashed(source, kind), benchmark, item_text, how, kind), "words"), kept_words
    for items, ids in (x for part in ([first, second], todo) for x in part if x is not None):
        sent = spark.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            for batch in batches:
                for lo, h, rows in read(batch.column(1)):
                    found = list(sent.value.scan(h, rows))
                    if found:
                        row, item, start, n, sim = (np.array(x) for x in zip(*found, strict=True))
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + lo)), pa.array(item.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(sim)], names=["doc_id", "item", "first_word", "n_words", "similarity"])

        names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {key.simpleString()}")
        part = source.mapInArrow(run, schema).join(F.broadcast(names), "item").select("doc_id", "item_id", "first_word", "n_words", "similarity")
        out = part if out is None else out.unionByName(part)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", how: Windows = Windows()) -> DataFrame:
    """``docs`` without those that hold a benchmark item (see ``contaminated``); the rest are unchanged, whatever their columns, null and empty texts included."""
    names = docs.columns
    at = names.index(text)
    for items, _ in passes(benchmark, item_id, item_text, how):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for lo, h, rows in text_words(batch.column(at)):
                    for row, *_ in sent.value.scan(h, rows):
                        keep[row + lo] = False
                yield batch if keep.all() else batch.filter(pa.array(keep))

        flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
        docs = flat.mapInArrow(run, flat.schema).toDF(*names)
    return docs


def op9_query(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
