"""Similarity join of texts: MinHash bands, Bayesian pruning, exact Jaccard.

The join works on *units* (a whole document, or one line of it).  Units with equal
normal form are one *class*, known by a 128-bit hash of that form.  Steps:

1. one Arrow pass over the documents: classes and band keys of each unit;
2. keys shared by two or more classes stay (a pre-aggregated count of 64-bit
   fingerprints), and of keys
   with the very same members only the first band's;
3. a key with many or long members is cut into slices by hash (about ``slice_rows``
   of them or ``slice_values`` shingles), and
   each pair of slices is one tile, so no task holds an unbounded group;
4. in a tile: a pair counts only under its first common band (so once over all
   tiles), is compared MinHash value by value and dropped when the posterior chance
   of reaching the threshold falls below ``tolerance``; the rest get their exact
   Jaccard similarity.  A tile returns each class's number of links and a spanning
   forest of them, never the pairs;
5. components of the forests.

Loss: a pair at similarity s shares no band with probability (1 - s^rows)^bands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontra.llm import textkit as tk
from kontra.llm.components import components
from kontra.llm.scratch import Scratch, if_small

#: Bytes handled at a time, so that a kernel's arrays stay in the processor's cache, rows of a small group,
#: and bytes of text verified together.
SPAN, SMALL, PART = 1 << 17, 8, 2 << 20
#: Pairs looked at together; a tile has up to ``slice_rows`` squared.
PAIRS = 1 << 14
#: ``one``: the unit's band keys, 8 bytes each, stand in ``bands``, in the order of the units.
UNIT, BANDS = "array<struct<pos:int,fp1:bigint,fp2:bigint,n:bigint,one:boolean>>", "binary"


@dataclass(frozen=True)
class Join:
    """Parameters.  ``unit``: "text" or "line"; ``kind``: "words" or "chars" shingles of ``k``."""

    unit: str
    kind: str
    k: int
    bands: int
    rows: int
    threshold: float = 0.8
    tolerance: float = 1e-7
    slice_rows: int = 768
    slice_values: int = 1 << 20

    def hasher(self) -> tk.MinHash:
        return tk.MinHash(self.bands, self.rows)

    def shingles(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Shingle hashes, each row's first, and what the class hash is made of (values, first)."""
        if self.kind == "words":
            h, _, _, rows = tk.words(data, offsets)
            s, first = tk.word_shingles(h, rows, self.k)
            return s, first, (h, rows)
        codes, at = tk.characters(*squeezed(data, offsets))
        s, first = tk.char_shingles(codes, at, self.k)
        # every k-th shingle and the last one of a row hold all of it
        n = np.diff(first)
        m = np.where(n > 0, (n + 2 * self.k - 2) // self.k, 0)
        f = np.concatenate([[0], np.cumsum(m)])
        i = (np.arange(f[-1]) - np.repeat(f[:-1], m)) * self.k
        return s, first, (s[np.minimum(i + np.repeat(first[:-1], m), np.repeat(first[1:] - 1, m))], f)


PLAIN = tk.LOWER.copy()
PLAIN[tk.IS_SPACE] = 32


def squeezed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased rows with runs of white space made one blank and none at the ends."""
    n = len(data)
    if n == 0:
        return data, offsets
    space = tk.IS_SPACE[data]
    blank = np.flatnonzero(space)
    # the last blank of a run stays, if a word of its row follows it ...
    stays = np.append(~space, False)[blank + 1]
    edge = offsets[1:-1][offsets[1:-1] < n]
    at = np.searchsorted(blank, edge - 1)
    hit = (at < len(blank)) & (edge > 0)
    at, edge = at[hit], edge[hit]
    stays[at[blank[at] == edge - 1]] = False
    # ... and one stands before it
    starts, stops = offsets[:-1], offsets[1:]
    led = (starts < stops) & space[np.minimum(starts, n - 1)]
    if led.any():
        last = np.flatnonzero(stays)
        k = np.searchsorted(blank[last], starts[led])
        ok = k < len(last)
        k, stop = last[k[ok]], stops[led][ok]
        k = k[blank[k] < stop]
        stays[k] = False
    gone = blank[~stays]
    out = PLAIN[data]
    return (np.delete(out, gone) if len(gone) else out), offsets - np.searchsorted(gone, offsets)


def line_offsets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of all lines, first line of each row); a line's own LF stays in it as trailing white space."""
    cuts = np.flatnonzero(data == 10) + 1
    row = np.searchsorted(offsets, cuts - 1, side="right") - 1
    n = np.bincount(row, minlength=len(offsets) - 1) + 1
    marks = np.concatenate([cuts, offsets[1:]])
    order = np.lexsort((np.concatenate([np.zeros(len(cuts), np.int8), np.ones(len(offsets) - 1, np.int8)]), marks, np.concatenate([row, np.arange(len(offsets) - 1)])))
    return np.concatenate([[0], marks[order]]), np.concatenate([[0], np.cumsum(n)])


def annotate(docs: DataFrame, text: str, how: Join, scratch: Scratch, name: str) -> DataFrame:
    """Written table: ``row_uid``, all columns of ``docs`` (under c0, c1, ...), ``units`` and their ``bands``, which few steps read."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields) + f", units {UNIT}, bands {BANDS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = how.hasher()
        for batch in batches:
            data, offsets = tk.buffers(batch.column(at))
            for lo, hi in tk.spans(offsets, 4 << 20):
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in batch.columns], *units(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], hasher)], names=[*batch.schema.names, "units", "bands"])

    def units(data: np.ndarray, offsets: np.ndarray, hasher: tk.MinHash) -> list[pa.Array]:
        rows = len(offsets) - 1
        if how.unit == "line":
            lines, first = line_offsets(data, offsets)
        else:
            lines, first = offsets, np.arange(rows + 1)
        got: list[list[np.ndarray]] = [[], [], [], [], []]
        for lo, hi in tk.spans(lines, SPAN):
            s, f, (v, vf) = how.shingles(data[lines[lo] : lines[hi]], lines[lo : hi + 1] - lines[lo])
            full = np.flatnonzero(np.diff(f))
            got[0].append(full + lo)
            got[1].append(tk.rows_hash(v, vf, 0x5BD1E995)[full].view(np.int64))
            got[2].append(tk.rows_hash(v, vf, 0x1B873593)[full].view(np.int64))
            got[3].append(np.diff(f)[full])
            got[4].append(hasher.keys(hasher.values(s, f)[full]))
        unit, fp1, fp2, values = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in got[:4])
        keys = np.concatenate(got[4]) if got[4] else np.zeros((0, how.bands), np.int64)
        # one of equal units stands for all in the search for keys
        one = np.zeros(len(unit), dtype=bool)
        one[np.unique(np.stack([fp1, fp2], 1), axis=0, return_index=True)[1]] = True
        owner = np.searchsorted(first, unit, side="right") - 1
        n = np.bincount(owner, minlength=rows) if len(owner) else np.zeros(rows, np.int64)
        inner = pa.StructArray.from_arrays([pa.array((unit - first[owner]).astype(np.int32)), pa.array(fp1), pa.array(fp2), pa.array(values.astype(np.int64)), pa.array(one)], names=["pos", "fp1", "fp2", "n", "one"])
        cut = np.concatenate([[0], np.cumsum(n)])
        bytes_ = (8 * how.bands * np.concatenate([[0], np.cumsum(one)])[cut]).astype(np.int32)
        bands = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(bytes_), pa.py_buffer(np.ascontiguousarray(keys[one]))])
        return [pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), inner), bands]

    return scratch.save(plain.mapInArrow(run, schema).withColumn("row_uid", F.monotonically_increasing_id()), name, release=True)


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest of n equal MinHash values at which P(similarity >= threshold), from a flat prior, is at least ``tolerance``."""
    total = 0.0
    for m in range(n + 1):
        # the posterior is Beta(m+1, n-m+1); its upper tail is a binomial sum
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


#: Band keys that one task brings together.
KEYS = 1 << 20


def ends(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, least and greatest fingerprint of each)."""
    order = np.argsort(key)
    key, fp = key[order], fp[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.minimum.reduceat(fp, first), np.maximum.reduceat(fp, first)


def banded(batch: pa.RecordBatch, bands: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of the units with band keys (given as columns of lists, the last one ``one``, then ``bands``), and their keys."""
    one = np.asarray(batch.column(batch.num_columns - 2).flatten())
    raw = pa.concat_arrays([batch.column(batch.num_columns - 1)])
    at = np.frombuffer(raw.buffers()[1], np.int32)[: len(raw) + 1] if len(raw) else np.zeros(1, np.int32)
    keys = np.frombuffer(raw.buffers()[2] or b"", np.int64)[at[0] // 8 : at[-1] // 8].reshape(-1, bands)
    return [np.asarray(batch.column(i).flatten())[one] for i in range(batch.num_columns - 2)], keys


def shared(annotated: DataFrame, how: Join, scratch: Scratch) -> DataFrame:
    """Written table of the keys that two or more classes have.

    Of each key in a batch the least and greatest fingerprint are sent on, so equal and
    crowded units meet before the shuffle; they go as blocks of bytes, one for each range
    of keys, not as rows.
    """
    units = annotated.agg(F.sum(F.size("units"))).first()[0] or 0
    parts = max(1, min(-(-units * how.bands // KEYS), 1 << 14))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (fp,), keys = banded(batch, how.bands)
            if not len(keys):
                continue
            key, lo, hi = ends(keys.ravel().view(np.uint64), np.repeat(fp, how.bands))
            more = lo != hi
            part = ((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            p = np.concatenate([part, part[more]]).astype(np.int32)
            order = np.argsort(p, kind="stable")
            both = np.stack([np.concatenate([key.view(np.int64), key[more].view(np.int64)]), np.concatenate([lo, hi[more]])], 1)[order]
            cut = np.searchsorted(p[order], np.arange(parts + 1))
            has = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array([both[cut[i] : cut[i + 1]].tobytes() for i in has], pa.binary())], names=["p", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(b, np.int64).reshape(-1, 2) for batch in batches for b in batch.column(1).to_pylist()]
        if held:
            both = np.concatenate(held)
            key, lo, hi = ends(both[:, 0], both[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(key[lo != hi])], names=["key"])

    dealt = annotated.select(F.col("units.fp1").alias("fp1"), F.col("units.one").alias("one"), "bands").mapInArrow(deal, "p int, b binary").repartitionById(parts, "p")
    return scratch.save(dealt.mapInArrow(meet, "key bigint"), "live", release=True)


def near(annotated: DataFrame, bodies: Callable[[DataFrame], DataFrame], how: Join, scratch: Scratch) -> DataFrame:
    """``bodies`` gives (fp1, fp2, body) of every unit.  Written table of the classes with links: node struct<fp1,fp2>, root, n_texts, n_rows (links to other classes, and to their rows)."""
    # 2. keys of two or more classes, and their members
    live = shared(annotated, how, scratch)
    _, few = if_small(live, 16)
    sent = annotated.sparkSession.sparkContext.broadcast(np.sort(np.asarray(live.toArrow()["key"])) if few else None)

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        for batch in batches:
            columns, keys = banded(batch, how.bands)
            if wanted is None:
                hit = np.ones(keys.shape, dtype=bool)
            elif len(wanted):
                hit = wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys
            else:
                continue
            row, band = np.nonzero(hit)
            yield pa.RecordBatch.from_arrays([*[pa.array(c[row]) for c in columns], pa.array(band.astype(np.int32)), pa.array(keys[row, band])], names=["fp1", "fp2", "n", "band", "key"])

    held = annotated.select(*[F.col(f"units.{c}").alias(c) for c in ("fp1", "fp2", "n", "one")], "bands")
    members = held.mapInArrow(holders, "fp1 bigint, fp2 bigint, n bigint, band int, key bigint")
    members = (members if few else members.join(live, "key", "left_semi")).distinct()
    members = scratch.save(members, "members", release=True)
    sets = members.groupBy("key", "band").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("fp1", "fp2").cast("decimal(20,0)")).alias("s"), F.bit_xor("fp2").alias("x"), F.sum("n").alias("v"))
    first = sets.where("n > 1").groupBy("n", "s", "x", "v").agg(F.min(F.struct("band", "key")).alias("b"))
    slices = F.greatest(F.ceil(F.col("n") / how.slice_rows), F.ceil(F.col("v") / how.slice_values))
    first = scratch.save(first.select("b.key", "b.band", slices.cast("int").alias("slices")), "buckets")
    kept, _ = if_small(first, 24)
    tiles = scratch.save(members.join(kept, ["key", "band"]), "placed")
    scratch.drop("members")
    active = scratch.save(tiles.select("fp1", "fp2").distinct(), "active")
    active, _ = if_small(active, 24)
    # one body and the number of rows for each class that shares a key
    rows = bodies(annotated).join(active, ["fp1", "fp2"], "left_semi")
    texts = scratch.save(rows.groupBy("fp1", "fp2").agg(F.min("body").alias("body"), F.count(F.lit(1)).alias("weight")), "bodies", release=True)
    own = F.pmod(F.xxhash64("fp1", "fp2", "key"), F.col("slices")).cast("int")
    tiles = tiles.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    tiles = tiles.select("fp1", "fp2", "key", F.least("own", "other").alias("ti"), F.greatest("own", "other").alias("tj"), (F.col("own") > F.col("other")).alias("right"))
    tiles = tiles.join(texts, ["fp1", "fp2"])
    tiles = tiles.repartition("key", "ti", "tj").sortWithinPartitions("key", "ti", "tj")
    out = "a1 bigint, a2 bigint, b1 bigint, b2 bigint, texts bigint, rows bigint"
    links = scratch.save(tiles.select("key", "ti", "tj", "right", "fp1", "fp2", "weight", "body").mapInArrow(Tiles(how), out), "links", release=True)
    scratch.drop("placed", "bodies", "active", "buckets", "live")
    node = F.struct(F.col("a1").alias("fp1"), F.col("a2").alias("fp2"))
    edges = links.where("b1 is not null").select(node.alias("a"), F.struct(F.col("b1").alias("fp1"), F.col("b2").alias("fp2")).alias("b"))
    roots = components(edges, scratch)
    counts = links.where("b1 is null").groupBy(node.alias("node")).agg(F.sum("texts").alias("n_texts"), F.sum("rows").alias("n_rows"))
    return scratch.save(roots.join(counts, "node").select("node.fp1", "node.fp2", "root", "n_texts", "n_rows"), "linked")


class Tiles:
    """Arrow function over tiles in sorted order; holds one tile and one batch at a time."""

    def __init__(self, how: Join):
        self.how = how
        self.checks = [(n, least_matches(n, how.threshold, how.tolerance)) for n in range(16, how.bands * how.rows + 1, 16)]
        self.ratio = Fraction(str(how.threshold))

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        self.hasher = self.how.hasher()
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks().to_batches()
            if not table:
                continue
            table = table[0]
            id_ = [np.asarray(table.column(i)) for i in range(3)]
            cut = np.flatnonzero((id_[0][1:] != id_[0][:-1]) | (id_[1][1:] != id_[1][:-1]) | (id_[2][1:] != id_[2][:-1])) + 1
            last = int(cut[-1]) if len(cut) else 0
            if last:
                # whole groups of about PART bytes of text together
                size = np.asarray(pa.compute.binary_length(table.column(7))).astype(np.int64)
                total = np.concatenate([[0], np.cumsum(size)])
                ends = np.concatenate([[0], cut])
                lo = 0
                while lo < len(ends) - 1:
                    hi = max(int(np.searchsorted(total[ends], total[ends[lo]] + PART, side="right")) - 1, lo + 1)
                    yield from self.some(table.slice(ends[lo], ends[hi] - ends[lo]), ends[lo : hi + 1] - ends[lo])
                    lo = hi
            rest = table.slice(last)
        if rest is not None and rest.num_rows:
            yield from self.some(rest, np.array([0, rest.num_rows]))

    def some(self, batch: pa.RecordBatch, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, right = np.asarray(batch.column(0)), np.asarray(batch.column(3).cast(pa.int8()))
        cross = np.asarray(batch.column(1)) != np.asarray(batch.column(2))
        fp = np.stack([np.asarray(batch.column(4)), np.asarray(batch.column(5))], 1)
        weight = np.asarray(batch.column(6))
        data, offsets = tk.buffers(batch.column(7))
        sets, sigs = [], []
        for lo, hi in tk.spans(offsets, SPAN):
            s, f, _ = self.how.shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            sigs.append(self.hasher.values(s, f))
            sets += [s[f[i] : f[i + 1]] for i in range(hi - lo)]
        sig = np.concatenate(sigs)
        keys = self.hasher.keys(sig)
        counts, edges = [], []
        size = np.diff(cuts)
        self.small(cuts, size, key, cross, right, sets, sig, keys, weight, fp, counts, edges)
        for g in np.flatnonzero(size > SMALL):
            lo, hi = cuts[g], cuts[g + 1]
            self.tile(key[lo], cross[lo], right[lo:hi], sets[lo:hi], sig[lo:hi], keys[lo:hi], weight[lo:hi], fp[lo:hi], counts, edges)
        if counts:
            c = np.concatenate(counts)
            e = np.concatenate(edges)
            n, m = len(c), len(e)
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([*[pa.array(np.concatenate([c[:, i], e[:, i]])) for i in (0, 1)], *[pa.chunked_array([none, pa.array(e[:, i])]).combine_chunks() for i in (2, 3)], *[pa.array(np.concatenate([c[:, i], np.zeros(m, np.int64)])) for i in (2, 3)]], names=["a1", "a2", "b1", "b2", "texts", "rows"])

    def small(self, cuts, size, key, cross, right, sets, sig, keys, weight, fp, counts, edges) -> None:
        """All groups of 2 to SMALL rows at once."""
        xs, ys = [], []
        for n in range(2, SMALL + 1):
            lo = cuts[:-1][size == n]
            if len(lo):
                i, j = np.triu_indices(n, 1)
                xs.append((lo[:, None] + i).ravel())
                ys.append((lo[:, None] + j).ravel())
        if not xs:
            return
        x, y = np.concatenate(xs), np.concatenate(ys)
        # in a tile of two slices, one of which may be empty, only pairs of one with the other count
        ok = ~cross[x] | (right[x] != right[y])
        x, y = x[ok].astype(np.int32), y[ok].astype(np.int32)
        ok = np.empty(len(x), dtype=bool)
        for lo in range(0, len(x), PAIRS):
            a, b = x[lo : lo + PAIRS], y[lo : lo + PAIRS]
            ok[lo : lo + PAIRS] = (keys[a] == keys[b]).argmax(1) == (key[a][:, None] == keys[a]).argmax(1)
        self.settle(x[ok], y[ok], sets, sig, weight, fp, counts, edges)

    def tile(self, key, cross, right, sets, sig, keys, weight, fp, counts, edges) -> None:
        band = int(np.flatnonzero(keys[0] == key)[0])
        if cross:
            left_i, right_i = np.flatnonzero(right == 0).astype(np.int32), np.flatnonzero(right).astype(np.int32)
            if not len(left_i) or not len(right_i):
                return
        else:
            left_i = right_i = np.arange(len(right), dtype=np.int32)
        early = np.zeros((len(left_i), len(right_i)), dtype=bool)
        for b in range(band):
            early |= keys[left_i, b][:, None] == keys[right_i, b][None, :]
        if left_i is right_i:
            early |= np.tri(len(left_i), dtype=bool)
        x, y = np.nonzero(~early)
        self.settle(left_i[x], right_i[y], sets, sig, weight, fp, counts, edges)

    def settle(self, x, y, sets, sig, weight, fp, counts, edges) -> None:
        """Prune the pairs by their MinHash values, verify the rest, and note links and their forest."""
        m = np.zeros(len(x), dtype=np.int32)
        for n, least in self.checks:
            if not len(x):
                return
            for lo in range(0, len(x), PAIRS):
                m[lo : lo + PAIRS] += (sig[x[lo : lo + PAIRS], n - 16 : n] == sig[y[lo : lo + PAIRS], n - 16 : n]).sum(1)
            ok = m >= least
            if not ok.all():
                x, y, m = x[ok], y[ok], m[ok]
        if not len(x):
            return
        ok = self.exact(x, y, sets)
        x, y = x[ok], y[ok]
        if not len(x):
            return
        size = len(sets)
        texts, rows = np.zeros(size, np.int64), np.zeros(size)
        for a, b in ((x, y), (y, x)):
            for lo in range(0, len(a), PAIRS):
                texts += np.bincount(a[lo : lo + PAIRS], minlength=size)
                rows += np.bincount(a[lo : lo + PAIRS], weights=weight[b[lo : lo + PAIRS]], minlength=size)
        rows = rows.astype(np.int64)
        has = np.flatnonzero(texts)
        counts.append(np.column_stack([fp[has], texts[has], rows[has]]))
        up = {int(i): int(i) for i in has}
        forest = []
        for a, b in (pair for lo in range(0, len(x), PAIRS) for pair in zip(x[lo : lo + PAIRS].tolist(), y[lo : lo + PAIRS].tolist(), strict=True)):
            while up[a] != a:
                up[a] = a = up[up[a]]
            while up[b] != b:
                up[b] = b = up[up[b]]
            if a != b:
                up[b] = a
                forest.append((a, b))
                if len(forest) == len(up) - 1:
                    break
        f = np.array(forest, dtype=np.int64)
        edges.append(np.column_stack([fp[f[:, 0]], fp[f[:, 1]]]))

    def exact(self, x: np.ndarray, y: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
        """Which of the pairs reach the threshold, by their whole shingle sets."""
        mask = np.zeros(len(sets), dtype=bool)
        mask[x] = mask[y] = True
        used, where = np.flatnonzero(mask), (np.cumsum(mask) - 1).astype(np.int32)
        i, j = where[x], where[y]
        values, size = distinct([sets[r] for r in used])
        inter = (products if len(x) >= 64 and len(x) > 8 * len(used) else merges)(i, j, values, size)
        num, den = self.ratio.numerator, self.ratio.denominator
        return inter * den >= (size[i] + size[j] - inter) * num


#: Sets and pairs are told apart by the upper 12 bits of a sorted key, shingles by the other 52.
TAG, LOW = np.uint64(52), np.uint64(12)
#: Values that are sorted together: some seven arrays of them are alive at once.
GROUP, VALUES = 4096, 1 << 18


def chunks(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of at most GROUP entries with about VALUES values together."""
    total = np.concatenate([[0], np.cumsum(n)])
    lo = 0
    while lo < len(n):
        hi = min(int(np.searchsorted(total, total[lo] + VALUES, side="right")) - 1, lo + GROUP)
        yield lo, max(hi, lo + 1)
        lo = max(hi, lo + 1)


def distinct(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All sets' distinct values in a row, in order, and how many each has."""
    out, size = [], np.zeros(len(sets), dtype=np.int64)
    n = np.array([len(s) for s in sets], dtype=np.int64)
    for lo, hi in chunks(n):
        key = (np.concatenate(sets[lo:hi]) >> LOW) | (np.repeat(np.arange(hi - lo, dtype=np.uint64), n[lo:hi]) << TAG)
        key.sort()
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        size[lo:hi] = np.bincount((key >> TAG).astype(np.int64), minlength=hi - lo)
        out.append(key & ((np.uint64(1) << TAG) - np.uint64(1)))
    return np.concatenate(out), size


def merges(i: np.ndarray, j: np.ndarray, values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Common values of few pairs of sets: the two of a pair sorted together."""
    first = np.cumsum(size) - size
    inter = np.zeros(len(i), dtype=np.int64)
    for lo, hi in chunks(size[i] + size[j]):
        both = np.concatenate([i[lo:hi], j[lo:hi]])
        n = size[both]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[both], n)
        pair = np.arange(hi - lo, dtype=np.uint64)
        key = values[at] | (np.repeat(np.concatenate([pair, pair]), n) << TAG)
        key.sort()
        twice = key[1:][key[1:] == key[:-1]]
        inter[lo:hi] = np.bincount((twice >> TAG).astype(np.int64), minlength=hi - lo)
    return inter


def products(i: np.ndarray, j: np.ndarray, values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Common values of many pairs of sets: products of 0/1 matrices over a block of values at a time."""
    owner = np.repeat(np.arange(len(size)), size)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    col = np.cumsum(np.concatenate([[True], values[1:] != values[:-1]])) - 1
    keep = np.bincount(col)[col] > 1
    owner, col = owner[keep], col[keep]
    # only sets on the left of a pair meet those on its right
    left, right = (np.bincount(r, minlength=len(size)) > 0 for r in (i, j))
    total = np.zeros((np.count_nonzero(left), np.count_nonzero(right)), dtype=np.float32)
    if len(col):
        col = np.cumsum(np.concatenate([[0], np.diff(col) > 0]))
        width = 1024
        for lo in range(0, int(col[-1]) + 1, width):
            a, b = np.searchsorted(col, [lo, lo + width])
            part = np.zeros((len(size), width), dtype=np.float32)
            part[owner[a:b], col[a:b] - lo] = 1
            total += part[left] @ part[right].T
    return total[(np.cumsum(left) - 1)[i], (np.cumsum(right) - 1)[j]].astype(np.int64)
