"""Codes of Yinyang Lloyd against plain Lloyd in Python's whole numbers."""

import math
import random
from collections import defaultdict
from fractions import Fraction
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from kontra.llm import vector_codes
from kontra.llm.scratch import Scratch
from kontra.llm.vector_codes import LONGEST, Codebooks, assign, compress, fit, grouped, limbs, op11_query, whole

SCHEMA = "vec_id bigint, embedding array<double>, label int, code int, error string, v string"


def brute(rows, entries=16, rounds=6, parts=8):
    """{vec_id: (code, error, label_error)} and the digest of the codebooks, for distinct ids."""
    kept = [(i, lab, [math.floor(Fraction(x) * 4096) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    size = len(kept[0][2]) // parts
    cut = lambda q, p: q[p * size : (p + 1) * size]
    books = [[cut(q, p) for _, _, q in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, _, q in kept:
                own[near(cut(q, p), books[p])[1]].append(cut(q, p))
            books[p] = [[sum(c) // len(own[j]) for c in zip(*own[j], strict=True)] if own[j] else e for j, e in enumerate(books[p])]
    out, total = {}, defaultdict(int)
    for i, lab, q in kept:
        got = [near(cut(q, p), books[p]) for p in range(parts)]
        error = min(sum(d for d, _ in got), LONGEST)
        total[lab] += error
        out[i] = ("".join(f"{j:02x}" for _, j in got), error, lab)
    digest = sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {i: (c, e, min(total[lab], LONGEST)) for i, (c, e, lab) in out.items()}, digest


def some(n, dim=16, seed=1, spread=0.3):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 1, (12, dim))
    rows = [(int(i), (centres[r.integers(12)] + r.normal(0, spread, dim)).tolist(), [None, 1, 2, 3][r.integers(4)]) for i in range(n)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, "x", "y") for i, v, lab in rows], SCHEMA)


def check(spark, rows, parts=3, **how):
    got = compress(frame(spark, rows).repartition(parts), **how).collect()
    want, digest = brute(rows, **how)
    assert {r.vec_id: (r.code, r.error, r.label_error) for r in got} == want and len(got) == len(want)
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_against_plain_lloyd_with_bad_rows_and_ties(spark):
    rows = some(400)
    bad = [None, [None] + [0.1] * 15, [float("nan")] + [0.1] * 15, [float("inf")] * 16]
    rows += [(1000 + k, v, 1) for k, v in enumerate(bad)]
    rows += [(2000 + k, rows[3][1], 2) for k in range(30)]  # copies: ties in distance
    rows += [(-5, [0.0] * 16, None), (-4, [-0.0] * 16, None), (-3, [-1e-30] * 16, 3)]
    random.Random(2).shuffle(rows)
    check(spark, rows)


def test_codebook_of_equal_entries_and_fewer_rows_than_entries(spark):
    rows = [(i, [0.25] * 16, 1) for i in range(20)] + [(30, [0.5] * 16, 1)]
    check(spark, rows)
    check(spark, some(5))


def test_huge_components(spark):
    rows = some(40) + [(-1, [1e160] * 16, 1), (50, [1.7e308, -1.7e308] * 8, 2), (51, [3e5] * 16, 2), (52, [1e-320] * 16, 2)]
    check(spark, rows, rounds=3)


def test_repeated_ids_other_lengths_and_empty_tables(spark):
    rows = some(30)
    odd = frame(spark, [*rows, rows[4], rows[4], (None, rows[5][1], 1), (90, [0.5] * 8, 1), (91, [], 1)])
    got = compress(odd).collect()
    assert len(got) == 33 and len({(r.code, r.error) for r in got if r.vec_id == 4}) == 1
    assert {r.vec_id for r in got} == {*range(30), None}
    assert compress(frame(spark, [])).count() == 0
    assert compress(frame(spark, [(1, None, 1), (2, [0.5] * 3, None)])).count() == 0


@pytest.mark.parametrize("scale", [0.01, 1.0, 300.0])
def test_bounds_never_change_a_code(scale):
    """Rounds with bounds give what rounds that scan everything give, and scan less."""
    r = np.random.default_rng(4)
    x = whole(r.normal(0, scale, (600, 2, 4)) + r.integers(0, 3, (600, 1, 1)) * 4 * scale)
    start = x[:16].transpose(1, 0, 2).copy()
    group = grouped(start, 4)
    books = Codebooks(start, group, np.zeros((2, int(group.max()) + 1)))
    code, low, done = np.zeros((600, 2), dtype=np.uint8), np.zeros((600, 2, books.drift.shape[1]), dtype=np.float32), []
    for _ in range(12):
        code, error, low, n = assign(x, code, low, books)
        d = ((x[:, :, None] - books.entries[None]) ** 2).sum(axis=3)
        assert (code == d.argmin(axis=2)).all() and (error == d.min(axis=2)).all()
        for p in range(2):
            for g in range(low.shape[2]):
                other = (group[p] == g)[None] & (np.arange(16)[None] != code[:, p, None])
                assert (low[:, p, g].astype(np.float64) ** 2 <= np.where(other, d[:, p], np.iinfo(np.int64).max).min(axis=1) * (1 + 1e-6) + 1e60 * ~other.any(axis=1)).all() or not other.any()
        sums = np.zeros((2, 16, 5), dtype=object)
        for p in range(2):
            for j in range(16):
                sums[p, j] = [*x[code[:, p] == j, p].sum(axis=0), int((code[:, p] == j).sum())]
        books = books.moved(sums)
        done.append(n)
    assert done[-1] < 0.8 * done[0]


def test_fewer_distances_than_plain_rounds(spark):
    rows = some(600, spread=0.05)
    _, books, work = fit(frame(spark, rows), Scratch(spark, "t"))
    plain = 600 * 8 * 17
    assert work[0] == plain and work[-1] < 0.7 * plain and books.entries.shape == (8, 16, 2)


def test_limbs():
    for t in (0, 5, -5, 2**40, -(2**100) + 3, 10**400):
        assert sum(s * 2 ** (40 * k) for k, s in limbs(t)) == t


def test_query_and_sql(spark, tmp_path):
    rows = [*some(120), (500, None, 1), (501, [float("nan")] * 16, 2)]
    frame(spark, rows).select("vec_id", "embedding", "label").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(tuple(r) for r in op11_query(spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(db.execute(vector_codes.ORACLE).fetchall()) == got
    want, digest = brute(rows)
    assert {r[0]: r[1:4] for r in got} == want and {r[4] for r in got} == {digest}
