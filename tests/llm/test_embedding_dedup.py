"""The subspace join against all pairs, and its defined edge cases."""

import numpy as np
import pyarrow as pa

from kontra.llm.embedding_dedup import Pigeonhole, Verify, alive, embedding_dedup, place, unit


def brute(rows):
    good = [(i, np.array(v, float), lab) for i, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, up = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, v, x) in enumerate(good):
        for j, w, y in good[:a]:
            if x == y and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                n[i] += 1
                n[j] += 1
                up[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return sorted((rows[i][0], n[i], least[top(i)], least[top(i)] == rows[i][0]) for i in range(len(rows)))


def vectors(seed, dim):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(60):
        out.append((r.normal(size=dim), int(r.integers(0, 3))))
    hot = r.normal(size=dim)
    for _ in range(120):
        out.append((hot + r.normal(size=dim) * 0.11, 1))
    for _ in range(40):
        v, lab = out[int(r.integers(0, 60))]
        out.append((v * r.uniform(0.5, 3) + r.normal(size=dim) * 0.05, lab))
    out += [(hot, 1)] * 30
    rows = [(i * 37 % 1009, [float(np.float32(x)) for x in v], lab) for i, (v, lab) in enumerate(out)]
    return rows + [(2000, None, 1), (2001, [0.0] * dim, 1), (2002, [None] + [1.0] * (dim - 1), 1), (2003, [float("nan")] * dim, 1), (2004, [float("inf")] * dim, 1), (2005, rows[-1][1], None), (2006, [], 1), (2007, rows[-1][1][:3], 1), (2008, rows[-1][1], 1), (2008, rows[-1][1], 1)]


def run(spark, rows, how=Pigeonhole()):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, v string").repartition(3)
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup(df, how=how).collect())


def test_same_as_all_pairs(spark):
    rows = vectors(1, 64)
    assert run(spark, rows) == brute(rows)


def test_other_sizes_and_slices(spark):
    rows = vectors(2, 20)
    assert run(spark, rows, Pigeonhole(slice_rows=9)) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_a_tile_with_an_empty_slice_has_no_pairs():
    def tile(ti, tj, right):
        n = len(right)
        columns = [[5] * n, [ti] * n, [tj] * n, right, [0] * n, [0] * n, list(range(n)), [1] * n, [1] * n, [[1.0] + [0.0] * 63] * n, [[1.0] + [0.0] * 63] * n]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[str(i) for i in range(11)])
        return sum(sum(b.column(2).to_pylist()) for b in Verify(Pigeonhole())(iter([batch])))

    assert tile(0, 0, [0, 0]) == 2 and tile(0, 1, [0, 1]) == 2
    assert tile(0, 1, [0, 0]) == 0 and tile(0, 1, [1, 1]) == 0


def test_extreme_lengths(spark):
    rows = [(1, [1e160, 2e160, 0.0], 1), (2, [1e160, 2.001e160, 0.0], 1), (3, [1e-170, 2e-170, 0.0], 1), (4, [1.0, 2.0, 0.0], 1), (5, [1e308, -1e308, 1e308], 1), (None, [1.0, 2.0, 0.0], 2), (6, [1.0, 2.0, 0.0], 2)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup(df).collect()}
    assert got == {1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False), 4: (3, 1, False), 5: (0, 5, True), None: (1, 6, True), 6: (1, 6, True)}


def test_the_grid_prunes():
    """Of random vectors with one label few reach the full product, and no pair within a block's budget is lost."""
    r, how = np.random.default_rng(5), Pigeonhole()
    y = unit(r.normal(size=(1500, 64))).astype(np.float32)
    y[750:] = unit(y[:750] + r.normal(size=(750, 64)) * 0.03).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array([7] * 1500), pa.array(list(y), pa.list_(pa.float32()))], names=["cid", "l", "y"])
    t = pa.Table.from_batches(place(how)(iter([batch]))).sort_by("key").to_pydict()
    n = len(t["key"])
    columns = [t["key"], [0] * n, [0] * n, [0] * n, t["block"], t["mask"], t["near"], t["cid"]]
    tiles = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "ti", "tj", "right", "block", "mask", "near", "cid"])
    out = pa.Table.from_batches(alive(how)(iter([tiles]))).to_pydict()
    meets: dict = {}
    for k, b, m, c in zip(out["key"], out["block"], out["mask"], out["cid"], strict=True):
        meets.setdefault((k, b), []).append((m, c))
    pairs = {}
    for (_, b), rows in meets.items():
        for i, (m, c) in enumerate(rows):
            for m2, c2 in rows[:i]:
                if not m & m2:
                    pairs[min(c, c2), max(c, c2), b] = pairs.get((min(c, c2), max(c, c2), b), 0) + 1
    assert sum(pairs.values()) < 0.01 * 1500 * 1499 / 2 and max(pairs.values()) == 1
    radius = how.radii(64)[0]
    for b in range(8):
        part = y[:, 8 * b : 8 * b + 8].astype(float)
        d = ((part[:, None] - part) ** 2).sum(2)
        i, j = np.nonzero(np.triu(d <= radius * radius, 1))
        assert all((x, z, b) in pairs for x, z in zip(i.tolist(), j.tolist(), strict=True))
