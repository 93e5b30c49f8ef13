"""Operator 1: embedding near-duplicates by a subspace pigeonhole join."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import fsum, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontra.llm.components import components
from kontra.llm.scratch import Scratch, if_small


#: Rows of a small group, and pairs looked at together.
SMALL, PAIRS = 16, 1 << 18


@dataclass(frozen=True)
class Pigeonhole:
    """Parameters: cosine threshold, dimensions of a block (8 at most), cell width in radii, rows of a slice."""

    threshold: float = 0.98
    block: int = 8
    width: float = 4.0
    slice_rows: int = 1024

    def radii(self, dim: int) -> np.ndarray:
        """For each block the distance within which it must be for a pair to be its candidate; the slack covers float32."""
        size = np.minimum(self.block, dim - np.arange(0, dim, self.block))
        return np.sqrt((2 - 2 * self.threshold) * size / dim) + 1e-6


def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(dim)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest component is taken out first, so that no square overflows or vanishes."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the rotated unit vector; all later steps read these very numbers, so their decisions agree."""
    for batch in batches:
        out: list = [None] * batch.num_rows
        for sel, v in by_length(batch.column(1)):
            turned = unit(v).astype(np.float64) @ rotation(v.shape[1])
            for i, r in enumerate(sel.tolist()):
                out[r] = turned[i].astype(np.float32)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float32()))], names=[*batch.schema.names, "y"])


def place(how: Pigeonhole):
    """(key, block, mask, near, cid): every cell in which a block of a vector may meet that of another one.

    Unit vectors u, v of cosine c have squared distance 2 - 2c.  If that is at most T, the
    squared distances of the blocks of the rotated vectors add up to at most T, so in some
    block of d of the D dimensions it is at most T d / D: the block's radius, squared.  All
    dimensions of the block are cut into cells.  A vector stands in its home cell and in
    the cells above it, in the dimensions of ``mask``, whose edges together are within the
    radius.  Two blocks within the radius meet, with disjoint masks, in one cell: the
    upper of the two homes in each dimension.  ``near`` is the place in the cell, a byte
    for each dimension.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, label = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for sel, y in by_length(batch.column(2)):
                dim, radii = y.shape[1], how.radii(y.shape[1])
                for lo in range(0, len(sel), 2000):
                    some = np.pad(y[lo : lo + 2000], ((0, 0), (0, len(radii) * how.block - dim)))
                    at = some.reshape(-1, how.block) / np.tile(radii * how.width, len(some))[:, None]
                    home = np.floor(at)
                    gap = ((home + 1 - at) * how.width) ** 2
                    who, mask, used = np.arange(len(at)), np.zeros(len(at), np.int64), np.zeros(len(at))
                    for j in range(how.block):
                        more = np.flatnonzero(used + gap[who, j] <= 1 + 1e-6)
                        who, mask, used = np.append(who, who[more]), np.append(mask, mask[more] | (1 << j)), np.append(used, used[more] + gap[who[more], j])
                    cell = home[who] + ((mask[:, None] >> np.arange(how.block)) & 1)
                    row, block = who // len(radii), who % len(radii)
                    h = label[sel[lo + row]].astype(np.uint64) + np.uint64(dim * 1000003) + block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    for j in range(how.block):
                        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + cell[:, j].astype(np.int64).astype(np.uint64)
                    inside = np.clip((at[who] - cell) * how.width + 1, 0, how.width + 1) * (255 / (how.width + 1))
                    near = np.zeros((len(who), 8), np.uint8)
                    near[:, : how.block] = np.rint(inside)
                    columns = [(h ^ (h >> np.uint64(32))).view(np.int64), block.astype(np.int16), mask.astype(np.int16), near.view(np.int64)[:, 0], cid[sel[lo + row]]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "block", "mask", "near", "cid"])

    return run


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    flat = np.asarray(column.values).astype(np.float64)
    n = np.diff(offsets)
    for size in np.unique(n):
        sel = np.flatnonzero(n == size)
        yield sel, flat[offsets[sel][:, None] + np.arange(size)]


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted batches cut so that no group of equal first three columns (key, ti, tj) is split, and the groups' edges."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks().to_batches()
        if not t:
            continue
        t = t[0]
        k = [np.asarray(t.column(i)) for i in range(3)]
        cut = np.flatnonzero((k[0][1:] != k[0][:-1]) | (k[1][1:] != k[1][:-1]) | (k[2][1:] != k[2][:-1])) + 1
        last = int(cut[-1]) if len(cut) else 0
        if last:
            yield t.slice(0, last), np.concatenate([[0], cut])
        rest = t.slice(last)
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def alive(how: Pigeonhole):
    """Arrow function over tiles of placed blocks: the rows with a partner whose block is within the radius.

    Rounding to bytes moves a block by at most sqrt(8) half steps, which the limit allows for: nothing is lost here.
    """
    limit = (1 + sqrt(8) * (how.width + 1) / 255 + 1e-6) ** 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cuts in grouped(batches):
            right, mask = np.asarray(batch.column(3)), np.asarray(batch.column(5))
            cross = np.asarray(batch.column(1)) != np.asarray(batch.column(2))
            at = np.asarray(batch.column(6)).view(np.uint8).reshape(-1, 8).astype(np.float32) * np.float32((how.width + 1) / 255)
            live = np.zeros(batch.num_rows, dtype=bool)
            size = np.diff(cuts)
            for n in range(2, SMALL + 1):
                lo = cuts[:-1][size == n]
                i, j = np.triu_indices(n, 1)
                for k in range(0, len(lo), max(1, PAIRS // len(i))):
                    some = lo[k : k + max(1, PAIRS // len(i)), None]
                    x, y = (some + i).ravel(), (some + j).ravel()
                    ok = ((mask[x] & mask[y]) == 0) & (~cross[x] | (right[x] != right[y]))
                    x, y = x[ok], y[ok]
                    ok = ((at[x] - at[y]) ** 2).sum(1) <= limit
                    live[x[ok]] = live[y[ok]] = True
            for g in np.flatnonzero(size > SMALL):
                rows = np.arange(cuts[g], cuts[g + 1])
                a, b = (rows[right[rows] == 0], rows[right[rows] != 0]) if cross[rows[0]] else (rows, rows)
                if len(a) and len(b):
                    d = (at[a] ** 2).sum(1)[:, None] + (at[b] ** 2).sum(1) - 2 * (at[a] @ at[b].T)
                    near = (d <= limit + 1e-3) & ((mask[a][:, None] & mask[b]) == 0)
                    if a is b:
                        np.fill_diagonal(near, False)
                    live[a[near.any(1)]] = live[b[near.any(0)]] = True
            yield batch.filter(pa.array(live)).select(["key", "ti", "tj", "right", "block", "mask", "cid"])

    return run


class Verify:
    """Arrow function over tiles of live rows: exact cosines of the pairs that meet here first."""

    def __init__(self, how: Pigeonhole):
        self.how = how

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cuts in grouped(batches):
            yield from self.some(batch, cuts)

    def some(self, batch: pa.RecordBatch, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        right, block, mask, cid, label, weight = (np.asarray(batch.column(i).cast(pa.int64())) for i in range(3, 9))
        cross = np.asarray(batch.column(1)) != np.asarray(batch.column(2))
        units: list = [None] * batch.num_rows
        turned: list = [None] * batch.num_rows
        for column, out, make in ((batch.column(9), units, unit), (batch.column(10), turned, lambda v: v)):
            for sel, v in by_length(column):
                v = make(v)
                for i, r in enumerate(sel.tolist()):
                    out[r] = v[i]
        counts, edges = [], []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if hi - lo < 2 or len({len(u) for u in units[lo:hi]}) > 1:
                continue
            self.tile(np.stack(units[lo:hi]), np.stack(turned[lo:hi]), cross[lo], right[lo:hi], int(block[lo]), mask[lo:hi], cid[lo:hi], label[lo:hi], weight[lo:hi], counts, edges)
        if counts:
            c, e = np.concatenate(counts), np.concatenate(edges)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([c[:, 0], e[:, 0]])), pa.chunked_array([pa.nulls(len(c), pa.int64()), pa.array(e[:, 1])]).combine_chunks(), pa.array(np.concatenate([c[:, 1], np.zeros(len(e), np.int64)]))], names=["a", "b", "rows"])

    def within(self, y: np.ndarray, i: np.ndarray, j: np.ndarray, block: int, radius: float) -> np.ndarray:
        """Whether the block of each pair is within its radius: the same sum, in the same order, in whatever tile it is asked."""
        total = np.zeros(len(i))
        for k in range(block * self.how.block, min((block + 1) * self.how.block, y.shape[1])):
            total += (y[i, k] - y[j, k]) ** 2
        return total <= radius * radius

    def tile(self, u, y, cross, right, block, mask, cid, label, weight, counts, edges) -> None:
        n, radii = len(right), self.how.radii(u.shape[1])
        if cross:
            a, b = np.flatnonzero(right == 0), np.flatnonzero(right)
            if not len(a) or not len(b):
                return
        else:
            a = b = np.arange(n)
        lo = block * self.how.block
        part = y[:, lo : lo + self.how.block]
        square = (part * part).sum(1)
        near = square[a][:, None] + square[b] - 2 * (part[a] @ part[b].T) <= radii[block] ** 2 + 1e-9
        if a is b:
            near &= ~np.tri(n, dtype=bool)
        i, j = np.nonzero(near)
        cos = u[a] @ u[b].T if 16 * len(i) > len(a) * len(b) else None
        xs, ys = [], []
        for k in range(0, len(i), PAIRS):
            p, q = i[k : k + PAIRS], j[k : k + PAIRS]
            x, z = a[p], b[q]
            # one meeting place for each pair in this block, and none in an earlier block
            ok = ((mask[x] & mask[z]) == 0) & (label[x] == label[z]) & self.within(y, x, z, block, radii[block])
            for e in range(block):
                at = np.flatnonzero(ok)
                ok[at[self.within(y, x[at], z[at], e, radii[e])]] = False
            p, q, x, z = p[ok], q[ok], x[ok], z[ok]
            c = cos[p, q] if cos is not None else np.concatenate([np.zeros(0), *[(u[x[s : s + 4096]] * u[z[s : s + 4096]]).sum(1) for s in range(0, len(x), 4096)]])
            for s in np.flatnonzero(np.abs(c - self.how.threshold) < 2e-9):
                c[s] = fsum(u[x[s]] * u[z[s]]) / sqrt(fsum(u[x[s]] ** 2) * fsum(u[z[s]] ** 2))
            xs.append(x[c >= self.how.threshold]), ys.append(z[c >= self.how.threshold])
        x, z = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (xs, ys))
        if not len(x):
            return
        rows = np.bincount(np.concatenate([x, z]), weights=weight[np.concatenate([z, x])].astype(float), minlength=n).astype(np.int64)
        has = np.flatnonzero(rows)
        counts.append(np.column_stack([cid[has], rows[has]]))
        up = list(range(n))
        forest = []
        for p, q in zip(x.tolist(), z.tolist(), strict=True):
            while up[p] != p:
                up[p] = p = up[up[p]]
            while up[q] != q:
                up[q] = q = up[up[q]]
            if p != q:
                up[q] = p
                forest.append((p, q))
                if len(forest) == len(has) - 1:
                    break
        f = np.array(forest, dtype=np.int64).reshape(-1, 2)
        edges.append(np.column_stack([cid[f[:, 0]], cid[f[:, 1]]]))


def embedding_dedup(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", how: Pigeonhole = Pigeonhole()) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept.

    Two vectors are linked if their labels are equal and not null, their lengths equal
    and their cosine, in double precision, is ``threshold`` or more.  A vector that is
    null, empty, zero or holds a null or a value that is not finite links with nothing.
    n_links counts the other rows linked directly, component_id is the smallest vec_id
    that links reach (its own included) and kept is vec_id = component_id.  Repeated rows
    are vectors of their own; a null vec_id stays null and is never the smallest, unless
    all are null.  Columns besides the three are not read.

    Equal vectors are one class with a weight.  Blocks of classes that share a cell of a
    block's grid meet in a task, first by their place in the cell alone; a crowded cell is
    cut into slices, pairs of which are tiles.  Rows with a partner within the block's
    budget meet again with their vectors.  Tasks return link counts and spanning forests,
    not pairs.  Vectors are scaled by their largest component before any square is taken,
    so no finite vector overflows.  An empty table gives an empty one.
    """
    scratch = Scratch(vectors.sparkSession, "embedding-dedup")
    plain = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), F.col(label).alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("v", lambda x: x != 0)
    good = F.coalesce(F.col("label").isNotNull() & finite & some, F.lit(False))
    classes = plain.where(good).groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    kind = ", ".join(f"{n} {classes.schema[n].dataType.simpleString()}" for n in ("label", "v", "rep", "weight"))
    classes = classes.select("label", "v", "rep", "weight").mapInArrow(turn, f"{kind}, y array<float>")
    classes = scratch.save(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    where = classes.select("cid", F.xxhash64("label").alias("l"), "y").mapInArrow(place(how), "key bigint, block smallint, mask smallint, near bigint, cid bigint")
    where = scratch.save(where, "placed")
    crowded = where.groupBy("key", "block").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "block", F.ceil(F.col("n") / how.slice_rows).cast("int").alias("slices"))
    crowded, _ = if_small(scratch.save(crowded, "crowded"), 24)
    tiles = where.join(crowded, ["key", "block"])
    tiles = tiles.withColumn("own", F.pmod(F.xxhash64("cid", "key"), F.col("slices")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    tiles = tiles.select("key", F.least("own", "other").alias("ti"), F.greatest("own", "other").alias("tj"), (F.col("own") > F.col("other")).cast("int").alias("right"), "block", "mask", "near", "cid")
    tiles = tiles.repartition("key", "ti", "tj").sortWithinPartitions("key", "ti", "tj")
    live = scratch.save(tiles.mapInArrow(alive(how), "key bigint, ti int, tj int, right int, block smallint, mask smallint, cid bigint"), "live", release=True)
    scratch.drop("placed", "crowded")
    live = live.join(classes.select("cid", F.xxhash64("label").alias("l"), "weight", "v", "y"), "cid")
    live = live.select("key", "ti", "tj", "right", "block", "mask", "cid", "l", "weight", "v", "y").repartition("key", "ti", "tj").sortWithinPartitions("key", "ti", "tj")
    links = scratch.save(live.mapInArrow(Verify(how), "a bigint, b bigint, rows bigint"), "links", release=True)
    scratch.drop("live")
    roots = components(links.where("b is not null").select("a", "b"), scratch)
    n = links.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("rows").alias("rows"))
    told = classes.join(n, "cid", "left").where("weight > 1 or rows is not null").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    told = scratch.save(told.select("label", "v", "root", "rep", (F.coalesce("rows", F.lit(0)) + F.col("weight") - 1).alias("links")), "told")
    least = told.groupBy("root").agg(F.min("rep").alias("component"))
    told = scratch.save(told.join(least, "root").select("label", "v", "links", "component"), "named")
    scratch.drop("classes", "links", "told", "cc-roots")
    told, _ = if_small(told)
    out = plain.where(good).join(told, ["label", "v"], "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    # vectors that link with nothing have no key in common, so they take no part in the join
    out = out.unionByName(plain.where(~good).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op1_query(spark, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
      AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
          WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least.c AS component_id, v.vec_id = least.c AS kept
FROM v JOIN least ON least.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
