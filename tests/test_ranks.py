"""Numbers, ranks and step-up values of whole groups against plain Python, with ties and hot values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kontra.functions import ranks
from kontra.functions.stats import beta_tail, benjamini_hochberg, incomplete_beta


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    data = [(g, i, r.choice([0.0, 0.0, 0.0, r.random(), -1.5, 2.0**-r.randrange(9)])) for g in "ab" for i in range(400)] + [("c", 1, 0.5)]
    return spark.createDataFrame(data, "g string, id bigint, v double"), data


def test_cuts_deal_evenly(spark, rows):
    df, data = rows
    cuts = ranks.cut_points(df, [F.col("g"), F.col("id")], 8)
    assert cuts == sorted(set(cuts)) and 1 <= len(cuts) <= 8
    n = [r["count"] for r in df.withColumn("b", ranks.bucket(df, [F.col("g"), F.col("id")], cuts)).groupBy("b").count().collect()]
    assert len(n) == len(cuts) + 1 and max(n) < 3 * min(n)


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_numbers(spark, rows, buckets):
    df, data = rows
    got = {(r.g, r.id): r.n for r in ranks.numbered(df, ["g"], [F.col("v"), F.col("id")], "n", buckets).collect()}
    want = {}
    for g in "abc":
        for n, (_, i, _) in enumerate(sorted([d for d in data if d[0] == g], key=lambda d: (d[2], d[1])), 1):
            want[g, i] = n
    assert got == want
    whole = ranks.numbered(df, [], [F.col("g"), F.col("id")], "n", buckets).collect()
    assert [(r.g, r.id) for r in sorted(whole, key=lambda r: r.n)] == sorted((g, i) for g, i, _ in data)


def test_numbers_by_key(spark, rows):
    df, _ = rows
    t = df.withColumn("k", F.md5(F.col("id").cast("string").cast("binary")))
    got = sorted(ranks.numbered_by_key(t, ["g"], "k", [F.col("id")], "n").where("g = 'a'").collect(), key=lambda r: r.n)
    assert [r.n for r in got] == list(range(1, 401)) and [r.k for r in got] == sorted(r.k for r in got)


@pytest.mark.parametrize("buckets", [1, 5, 64])
def test_average_ranks_and_step_up(spark, rows, buckets):
    df, data = rows
    more = df.unionByName(spark.createDataFrame([("a", 900, None)], df.schema))
    got = {(r.g, r.id): r.s for r in ranks.average_rank_share(more, "v", ["g"], "s", buckets).collect()}
    for g in "abc":
        vs = [v for h, _, v in data if h == g]
        for h, i, v in data:
            if h == g:
                assert got[g, i] == pytest.approx((sum(x < v for x in vs) + (sum(x == v for x in vs) + 1) / 2) / len(vs))
    assert got["a", 900] is None
    p = df.withColumn("p", F.abs("v") / 2)
    q = {(r.g, r.id): r.q for r in ranks.step_up(p, "p", ["g"], "q", buckets).collect()}
    small = {(r.g, r.id): r.q for r in benjamini_hochberg(p, "p", ["id"], ["g"]).collect()}
    assert set(q) == set(small) and all(q[k] == pytest.approx(small[k]) for k in q)


def test_empty(spark, rows):
    none = rows[0].limit(0)
    assert ranks.numbered(none, ["g"], [F.col("v")], "n").count() == 0 and ranks.step_up(none, "v", ["g"]).count() == 0


def students_tail(t, df):
    """P(|T| > t) by Simpson's rule."""
    a, n = math.atan(t / math.sqrt(df)), 4000
    f = lambda x: math.cos(x) ** (df - 1)
    s = sum((1 if i in (0, n) else 4 if i % 2 else 2) * f(a * i / n) for i in range(n + 1)) * a / n / 3
    return 1 - 2 * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi) * s


def test_students_t(spark):
    cases = [(t, df) for df in (3, 43, 998) for t in (0.0, 0.01, 0.5, 1.7, 4.0)] + [(1e9, 5), (2.0, 1), (2.0, 2)]
    df = spark.createDataFrame(cases, "t double, df int")
    x = F.col("df") / (F.col("df") + F.col("t") * F.col("t"))
    for r in df.withColumn("p", beta_tail(x, F.col("df"))).collect():
        assert r.p == pytest.approx(students_tail(r.t, r.df), abs=1e-9)
    closed = spark.range(1).select(incomplete_beta(F.lit(0.3), F.lit(2.0), F.lit(3.0)).alias("a"), incomplete_beta(F.lit(0.25), F.lit(0.5), F.lit(0.5)).alias("b")).first()
    assert closed.a == pytest.approx(0.3483) and closed.b == pytest.approx(2 / math.pi * math.asin(0.5))
