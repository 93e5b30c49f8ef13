"""Mixing: targets against the rule read literally, sums near targets, reruns, and edge cases."""

import random
from collections import defaultdict

from kontra.llm.mixing import mix, numbered


def goals(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, source string, size int").repartition(4)
    got = [(r.doc_id, r.source, r.size, r.source_size, r.target, r.taken) for r in mix(df).collect()]
    assert sorted((str(g[0]), g[2]) for g in got) == sorted((str(r[0]), len((r[1] or "").split())) for r in rows)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, s, n, *_, t in got:
        sizes[s] += n
        taken[s] += t
        largest[s] = max(largest[s], n)
        assert t in (0, n, 2 * n)
    want = goals(sizes)
    for _, s, _, source_size, target, _ in got:
        assert source_size == sizes[s] and abs(target - want[s]) < 1e-6 * max(1, want[s])
    for s, t in taken.items():
        assert abs(t - want[s]) <= largest[s] / 2 + 1e-6
    again = [(r.doc_id, r.source, r.size, r.source_size, r.target, r.taken) for r in mix(df.repartition(9)).collect()]
    key = lambda x: tuple((v is None, v) for v in x)
    strip = lambda rows: sorted(((*g[:4], round(g[4], 6), g[5]) for g in rows), key=key)
    assert strip(got) == strip(again)


def test_mix(spark):
    r = random.Random(4)
    rows = [(i, " ".join("w" * r.randint(1, 5) for _ in range(int(r.paretovariate(0.9)) % 4000)), r.choice(["hot", "hot", "hot", "a", "b", "c", "é", "z", None])) for i in range(3000)]
    rows += [(9000, None, "a"), (None, "some words", "b"), (None, "some words", "b"), (9002, "", "only empty"), (9003, "x y z", "single")]
    check(spark, rows + [(7, "same row", "a")] * 300)


def test_empty(spark):
    assert mix(spark.createDataFrame([], "doc_id bigint, text string, source string")).count() == 0
    check(spark, [(1, None, "a"), (2, "", None)])


def test_rows_that_stand_for_many_are_numbered_in_chunks(spark):
    from kontra.llm.mixing import numbered

    t = spark.createDataFrame([(1, 5), (2, 3), (None, 7)], "doc_id bigint, m bigint")
    for chunk in (2, 3, 100):
        got = sorted((r.doc_id or 0, r.dup) for r in numbered(t, chunk).collect())
        assert got == sorted((d, k) for d, m in ((1, 5), (2, 3), (0, 7)) for k in range(1, m + 1))
