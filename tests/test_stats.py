"""Golden values and identities of the statistics."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kontra.functions import stats
from kontra.operators import matrix


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_fisher_golden(spark):
    # module 0 under the first condition: 1915 of 1915 against 7246 of 8340 elsewhere
    r = one(spark, p=stats.fisher(F.lit(1915), F.lit(9161), F.lit(1915), F.lit(10255)), q=stats.fisher(F.lit(79), F.lit(320), F.lit(105), F.lit(742)), o=stats.odds_ratio(F.lit(616), F.lit(8545), F.lit(880), F.lit(214)), none=stats.odds_ratio(F.lit(1), F.lit(0), F.lit(1), F.lit(1)))
    assert r.p == pytest.approx(5.5876e-105, rel=1e-4)
    assert r.q == pytest.approx(9.3478e-13, rel=1e-4)
    assert r.o == pytest.approx(0.01753072, rel=1e-6) and r.none == math.inf


def test_fisher_small_tables(spark):
    def pmf(k, n, K, M):
        return math.comb(K, k) * math.comb(M - K, n - k) / math.comb(M, n)

    rows = [(k, n, K, M) for M in (7, 12) for K in (0, 3, 5) for n in (0, 2, 6) for k in range(max(0, n + K - M), min(n, K) + 1)]
    df = spark.createDataFrame(rows, "k int, n int, K2 int, M int").select("*", stats.fisher(F.col("k"), F.col("n"), F.col("K2"), F.col("M")).alias("two"), stats.fisher(F.col("k"), F.col("n"), F.col("K2"), F.col("M"), "greater").alias("up"))
    for r in df.collect():
        support = range(max(0, r.n + r.K2 - r.M), min(r.n, r.K2) + 1)
        p = {j: pmf(j, r.n, r.K2, r.M) for j in support}
        assert r.up == pytest.approx(sum(v for j, v in p.items() if j >= r.k))
        assert r.two == pytest.approx(min(1, sum(v for v in p.values() if v <= p[r.k] * (1 + 1e-7))))


def test_fisher_tails_of_long_supports(spark):
    """Tails found by halving and summed outward give the whole sum, also where p underflows a relative search."""
    r = random.Random(2)
    rows = [(k, n, K, M) for M in (7, 12) for K in (0, 3, 5) for n in (0, 2, 6) for k in range(max(0, n + K - M), min(n, K) + 1)]
    for M, n, K in ((3000, 1200, 900), (3000, 2900, 2800), (20_000, 900, 9000), (5000, 700, 5), (4000, 2000, 2000)):
        lo, hi, mean = max(0, n + K - M), min(n, K), n * K // M
        rows += [(k, n, K, M) for k in {lo, hi, mean, mean - 1, mean + 1, (lo + mean) // 2, (hi + mean) // 2, r.randint(lo, hi), max(lo, mean - 40), min(hi, mean + 40)} if lo <= k <= hi]
    df = spark.createDataFrame(rows, "k long, n long, K2 long, M long")
    args = [F.col(c) for c in ("k", "n", "K2", "M")]
    cols = [stats.fisher(*args, side, whole).alias(f"{side[0]}{whole}") for side in ("two-sided", "greater") for whole in (-1, 10**9)]
    for x in df.select("*", *cols).collect():
        assert x["t-1"] == pytest.approx(x["t1000000000"], rel=1e-9, abs=1e-300), x
        assert x["g-1"] == pytest.approx(x["g1000000000"], rel=1e-9, abs=1e-300), x
    big = one(spark, p=stats.fisher(F.lit(10**7 + 9000), F.lit(10**8), F.lit(10**8), F.lit(10**9)), q=stats.fisher(F.lit(10**7), F.lit(10**8), F.lit(10**8), F.lit(10**9)))
    z = 9000 / math.sqrt(10**8 * 0.1 * 0.9 * 0.9)
    assert big.p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=0.01) and big.q == pytest.approx(1, abs=1e-3)


def test_fisher_of_constants_walks_no_long_support(spark):
    """Spark folds constants before it chooses the branch: two billion places would not fit."""
    n = F.lit(2 * 10**9)
    r = one(spark, p=stats.fisher(F.lit(2 * 10**8), n, n, F.lit(2 * 10**10)), g=stats.fisher(F.lit(2 * 10**8), n, n, F.lit(2 * 10**10), "greater"))
    assert r.p == pytest.approx(1, abs=1e-3) and r.g == pytest.approx(0.5, abs=1e-3)


def test_log_factorial(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 2, 20, 21, 100, 10256, 10**9)], "n bigint").select("n", stats.log_factorial(F.col("n")).alias("v"))
    for r in df.collect():
        assert r.v == pytest.approx(math.lgamma(r.n + 1), rel=1e-13, abs=1e-12)


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("a", 0.0099, "x"), ("b", 0.0099, "x"), ("c", 0.0099, "x"), ("d", 0.5, "x"), ("e", 0.9, "x"), ("z", 0.4, "y")], "k string, p double, f string")
    got = {r.k: r.q for r in stats.benjamini_hochberg(df, "p", ["k"], ["f"]).collect()}
    assert got["a"] == got["b"] == got["c"] == pytest.approx(0.0099 * 5 / 3)
    assert got["d"] == pytest.approx(0.5 * 5 / 4) and got["e"] == pytest.approx(0.9) and got["z"] == pytest.approx(0.4)


def test_wilson_chi2_ari(spark):
    r = one(spark, lo=stats.wilson(F.lit(0), F.lit(1), False), hi=stats.wilson(F.lit(0), F.lit(1), True), none=stats.wilson(F.lit(0), F.lit(0), True), chi=stats.chi2_tail(F.lit(769.3421), 4))
    assert r.lo == pytest.approx(0, abs=1e-9) and r.hi == pytest.approx(79.345068562) and r.none is None
    assert r.chi == pytest.approx(3.355e-165, rel=1e-3)
    for df, x, p in ((9, 1.0, 0.999437), (9, 16.918977604620448, 0.05), (1, 3.841458820694124, 0.05), (3, 30.0, 1.3800570312932545e-06), (1, 0.0, 1.0), (5, 100.0, 5.285e-20)):
        assert one(spark, v=stats.chi2_tail(F.lit(x), df)).v == pytest.approx(p, rel=1e-4 if p > 0.9 or p < 1e-9 else 1e-9)
    for x in (0.0, 0.3, 1.0, 1.99, 2.0, 2.5, 5.0, 20.0):
        assert one(spark, v=stats.erfc(F.lit(x))).v == pytest.approx(math.erfc(x), rel=1e-11)
    cells = spark.createDataFrame([(0, 0, 2), (1, 1, 1), (1, 2, 1)], "la int, lb int, n bigint")
    assert stats.adjusted_rand(cells, [], "la", "lb").first().ari == pytest.approx(4 / 7)
    same = spark.createDataFrame([(0, 0, 5)], "la int, lb int, n bigint")
    assert stats.adjusted_rand(same, [], "la", "lb").first().ari == 1.0


def test_average_rank_and_constant_profiles(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0), (3, "a", 5.0), (4, "a", 0.0)], "entity int, condition string, effect double")
    got = {r.entity: r.pct_rank for r in matrix.percent_rank_matrix(df).collect()}
    assert got == {4: 0.25, 1: 0.625, 2: 0.625, 3: 1.0}
    flat = spark.createDataFrame([(m, c, 2.0 if c == "a" else float(m)) for m in range(3) for c in "ab"], "module int, condition string, v double")
    assert matrix.correlations(flat, "v").first().pearson is None
    assert matrix.zscore(df.withColumn("effect", F.lit(1.0))).count() == 0
