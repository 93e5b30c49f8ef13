"""Statistics as column expressions and window functions; all stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def log_factorial(n: Column) -> Column:
    """ln n!, exact products up to 20 and Stirling's series beyond (relative error below 1e-15)."""
    x = F.greatest(n, F.lit(1)).cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n <= 20, F.log(F.factorial(F.greatest(F.least(n, F.lit(20)), F.lit(0)).cast("int")).cast("double"))).otherwise(series)


#: Supports up to this length are summed whole; of longer ones the terms that matter.
WHOLE = 512


def fisher(k: Column, study: Column, category: Column, universe: Column, side: str = "two-sided", whole: int = WHOLE) -> Column:
    """Fisher's exact p for k hits of a study among a category of a universe.

    A sum over the support, taken by a higher-order function, so that no rows are
    multiplied.  ``greater``: j >= k; ``two-sided``: all j no likelier than k.  Of a
    support longer than ``whole`` the two places where the tails begin are found by
    halving, and each tail is summed outward while its terms are above 1e-18 of its first:
    some ten standard deviations, whatever the support's length.
    """
    k, study, category, universe = (c.cast("bigint") for c in (k, study, category, universe))
    lo = F.greatest(F.lit(0).cast("bigint"), study + category - universe)
    hi = F.least(study, category)
    rest = universe - category - study
    fixed = log_factorial(category) + log_factorial(universe - category) + log_factorial(study) + log_factorial(universe - study) - log_factorial(universe)

    def log_p(j: Column) -> Column:
        return fixed - log_factorial(j) - log_factorial(category - j) - log_factorial(study - j) - log_factorial(rest + j)

    def up(j: Column) -> Column:
        """The next term over this one."""
        return (category - j).cast("double") * (study - j) / ((j + 1).cast("double") * (rest + j + 1))

    first, at = (k, F.lit(1.0)) if side == "greater" else (lo, log_p(k) + 1e-7)
    kind = "struct<t:double,s:double,at:double>"
    begin = F.struct(log_p(first).alias("t"), F.lit(0.0).alias("s"), at.alias("at")).cast(kind)

    def step(a: Column, j: Column) -> Column:
        # the next term by its ratio to this one: one logarithm instead of four factorials
        more = F.when(a["t"] <= a["at"], F.exp(a["t"])).otherwise(F.lit(0.0))
        return F.struct((a["t"] + F.log(up(j))).alias("t"), (a["s"] + more).alias("s"), a["at"].alias("at")).cast(kind)

    # constants are folded before their branch is chosen: no longer sequence than that branch may walk
    short = F.aggregate(F.sequence(first, F.least(hi, first + F.lit(max(whole, 0)))), begin, step, lambda a: a["s"])

    return F.least(F.lit(1.0), F.when(hi - lo <= whole, short).otherwise(_long_fisher(k, study, category, universe, lo, hi, fixed, side)))


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _long_fisher(k: Column, study: Column, category: Column, universe: Column, lo: Column, hi: Column, fixed: Column, side: str) -> Column:
    """The sum over a long support by its tails; see ``fisher``."""
    given = {"k": k, "n": study, "c": category, "rest": universe - category - study, "lo": lo, "hi": hi, "fixed": fixed}
    share = category.cast("double") / F.greatest(universe, F.lit(1))
    spread = F.sqrt(F.greatest(study * share * (1 - share) * (universe - study) / F.greatest(universe - 1, F.lit(1)), F.lit(0.0)))
    given["reach"] = F.ceil(9.5 * spread).cast("bigint") + 60
    given["mode"] = F.least(hi, F.greatest(lo, F.floor((study + 1).cast("double") * (category + 1) / (universe + 2)).cast("bigint")))

    def of(v: Column) -> Column:
        def log_p(j: Column) -> Column:
            return F.aggregate(F.array(j, v["c"] - j, v["n"] - j, v["rest"] + j), v["fixed"], lambda total, x: total - log_factorial(x))

        def up(j: Column) -> Column:
            return (v["c"] - j).cast("double") * (v["n"] - j) / ((j + 1).cast("double") * (v["rest"] + j + 1))

        def down(j: Column) -> Column:
            return j.cast("double") * (v["rest"] + j) / ((v["c"] - j + 1).cast("double") * (v["n"] - j + 1))

        def tail(start: Column, stop: Column, ratio: Callable[[Column], Column]) -> Column:
            pair = "struct<t:double,s:double>"
            add = lambda a, j: F.struct((a["t"] * ratio(j)).alias("t"), (a["s"] + a["t"]).alias("s")).cast(pair)
            # relative to the first term, so that nothing underflows
            total = F.aggregate(F.sequence(start, stop), F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")).cast(pair), add, lambda a: a["s"])
            return F.exp(log_p(start) + F.log(total))

        if side == "greater":
            # below the mode nearly everything counts: from the mode's reach on
            start = F.greatest(v["k"], v["mode"] - v["reach"])
            return F.when(v["k"] > v["hi"], F.lit(0.0)).otherwise(bound(start, lambda x: tail(x, F.least(v["hi"], F.greatest(v["k"], v["mode"]) + v["reach"]), up)))

        def tails(at: Column) -> Column:
            def first(a: Column, b: Column, low: bool) -> Column:
                """The least place of a to b - 1 whose term is (or is not) as low as k's, b if there is none; one run comes after the other."""
                ends = "struct<a:bigint,b:bigint>"
                pick = lambda mid, e: bound((log_p(mid) <= at) == F.lit(low), lambda yes: F.struct(F.when(yes, e["a"]).otherwise(mid + 1).alias("a"), F.when(yes, mid).otherwise(e["b"]).alias("b")).cast(ends))
                halve = lambda e, _: F.when(e["a"] >= e["b"], e).otherwise(bound(F.floor((e["a"] + e["b"]) / 2).cast("bigint"), lambda mid: pick(mid, e)))
                return F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(a.alias("a"), b.alias("b")).cast(ends), halve, lambda e: e["a"])

            right = bound(first(v["mode"], v["hi"] + 1, True), lambda x: F.when(x > v["hi"], F.lit(0.0)).otherwise(tail(x, F.least(v["hi"], x + v["reach"]), up)))
            left = bound(first(v["lo"], v["mode"] + 1, False) - 1, lambda x: F.when(x < v["lo"], F.lit(0.0)).otherwise(tail(x, F.greatest(v["lo"], x - v["reach"]), down)))
            return F.when(log_p(v["mode"]) <= at, F.lit(1.0)).otherwise(left + right)

        return bound(log_p(v["k"]) + 1e-7, tails)

    return bound(F.struct(*[c.alias(n) for n, c in given.items()]), of)


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """ad / bc; where bc is 0, infinite, or NaN if ad is 0 too."""
    top, bottom = (a * d).cast("double"), (b * c).cast("double")
    return F.when(bottom != 0, F.try_divide(top, bottom)).otherwise(F.when(top > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))


def benjamini_hochberg(df: DataFrame, p: str, key: list[str], family: list[str] | None = None, name: str = "q") -> DataFrame:
    """Adds step-up adjusted p values within each declared family (ties in p get the same q)."""
    part = Window.partitionBy(*[F.col(c) for c in family or []])
    rank = part.orderBy(F.col(p), *[F.col(c) for c in key])
    back = part.orderBy(F.col("_rn").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_rn", F.row_number().over(rank)).withColumn("_m", F.count(F.lit(1)).over(part))
    q = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rn")).over(back))
    return df.withColumn(name, q).drop("_rn", "_m")


def wilson(up: Column, n: Column, upper: bool) -> Column:
    """A bound of the 95 % score interval in percent; null without observations."""
    m = F.greatest(n, F.lit(1)).cast("double")
    share = up / m
    centre = (share + Z95**2 / (2 * m)) / (1 + Z95**2 / m)
    half = Z95 * F.sqrt(share * (1 - share) / m + Z95**2 / (4 * m * m)) / (1 + Z95**2 / m)
    return F.when(n > 0, 100 * (centre + half if upper else centre - half))


def erfc(x: Column) -> Column:
    """The complementary error function of x >= 0: a series of positive terms below 2, a continued fraction beyond."""
    steps = F.sequence(F.lit(0), F.lit(59))
    pair = "struct<term:double,sum:double>"
    begin = F.struct(x.cast("double").alias("term"), F.lit(0.0).alias("sum")).cast(pair)
    series = F.aggregate(steps, begin, lambda a, n: F.struct((a.term * 2 * x * x / (2 * n + 3)).alias("term"), (a.sum + a.term).alias("sum")).cast(pair), lambda a: a.sum)
    fraction = F.aggregate(steps, F.lit(1.0), lambda f, n: 1 + (60 - n) / (2 * x * x) / f)
    return F.when(x < 2, 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * series).otherwise(F.exp(-x * x) / (F.greatest(x, F.lit(1.0)) * math.sqrt(math.pi) * fraction))


def chi2_tail(x: Column, df: int) -> Column:
    """P(chi-square > x): a finite sum, and for odd degrees of freedom the normal tail."""
    half = x / 2
    if df % 2:
        # each term is the one before by half / (i + 1/2)
        term, total = F.sqrt(half) * (2 / math.sqrt(math.pi)), F.lit(0.0)
        for i in range(1, (df + 1) // 2):
            total = total + term
            term = term * half / (i + 0.5)
        return erfc(F.sqrt(half)) + F.exp(-half) * total
    total = F.lit(1.0)
    for i in range(1, df // 2):
        total = total + F.pow(half, F.lit(i)) / float(math.factorial(i))
    return F.exp(-half) * total


def log_gamma(x: Column) -> Column:
    """ln gamma(x) for x > 0: Stirling's series eight steps higher."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - 1 / (1680 * F.pow(y, F.lit(7)))
    below = F.log(x)
    for i in range(1, 8):
        below = below + F.log(x + i)
    return series - below


def incomplete_beta(x: Column, a: Column, b: Column, terms: int = 600) -> Column:
    """The regularised incomplete beta function for 0 <= x <= 1 by its continued fraction, from the last term back."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x)) / a

    def term(k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(k % 2 == 1, odd).otherwise(m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)))

    fraction = F.aggregate(F.sequence(F.lit(terms), F.lit(1), F.lit(-1)), F.lit(1.0), lambda f, k: 1 + term(k) / f)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(front / fraction)


def beta_tail(x: Column, df: Column) -> Column:
    """P(|T| > t) of Student's t with ``df`` degrees of freedom, where x = df / (df + t^2)."""
    a, b = df.cast("double") / 2, F.lit(0.5)
    # each side where its fraction converges
    return F.when(x < (a + 1) / (a + 2.5), incomplete_beta(x, a, b)).otherwise(1 - incomplete_beta(1 - x, b, a))


def pearson(x: Column, y: Column) -> Column:
    """Aggregate correlation; null for a constant side (the built-in one raises or gives NaN there)."""
    return F.when((F.stddev_pop(x) > 1e-12) & (F.stddev_pop(y) > 1e-12), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def pairs2(n: Column) -> Column:
    """n choose 2."""
    return n * (n - 1) / 2


def adjusted_rand(cells: DataFrame, by: list[str], a: str, b: str, n: str = "n") -> DataFrame:
    """``by`` and ``ari`` from a contingency table; 1 where the denominator is 0."""
    rows = cells.groupBy(*by, a).agg(F.sum(n).alias("t")).groupBy(*by).agg(F.sum(pairs2(F.col("t"))).alias("sum_a"))
    cols = cells.groupBy(*by, b).agg(F.sum(n).alias("t")).groupBy(*by).agg(F.sum(pairs2(F.col("t"))).alias("sum_b"))
    both = cells.groupBy(*by).agg(F.sum(pairs2(F.col(n))).alias("sum_ab"), F.sum(n).alias("total"))
    both = both.join(rows, by).join(cols, by) if by else both.crossJoin(rows).crossJoin(cols)
    expected = F.try_divide(F.col("sum_a") * F.col("sum_b"), F.nullif(pairs2(F.col("total")), F.lit(0.0)))
    bottom = (F.col("sum_a") + F.col("sum_b")) / 2 - expected
    return both.select(*by, F.when(F.coalesce(bottom, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.try_divide(F.col("sum_ab") - expected, bottom)).alias("ari"))


def keyed(*parts: Column) -> Column:
    """md5 of parts joined by ':'; the engine's source of reproducible randomness."""
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))


def draw(n: Column, *parts: Column) -> Column:
    """A reproducible integer in [0, n)."""
    return F.pmod(F.conv(F.substring(keyed(*parts), 1, 8), 16, 10).cast("bigint"), n)


def display(c: str | Column, digits: int) -> Column:
    """Rounded for a report, ties to the even digit."""
    return F.bround(c, digits)
