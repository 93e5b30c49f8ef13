"""Numbers, ranks and step-up values over whole groups without a group in one task.

A window over a group sorts it in one task.  Here a group is cut into buckets that
follow one another in the order asked for; a row's number is the count of rows in the
buckets before, from a small aggregate, plus its number in its own bucket.  Buckets
come from cut points of a bounded sample, or from the first digits of an md5 key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a group, and rows of the sample for each cut.
BUCKETS, PER_CUT = 64, 64


def cut_points(df: DataFrame, order: list[Column], buckets: int = BUCKETS) -> list[tuple]:
    """At most ``buckets`` - 1 ascending values of ``order``, from a bounded sample in hash order; a value that only sets the buckets' sizes."""
    key = df.select(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("o"))
    few = key.orderBy(F.xxhash64("o")).limit(buckets * PER_CUT).orderBy("o")
    got = [tuple(r["o"]) for r in few.collect()]
    step = -(-len(got) // buckets) or 1
    return list(dict.fromkeys(got[step::step]))


def bucket(df: DataFrame, order: list[Column], cuts: list[tuple]) -> Column:
    """Number of cuts that are not above a row, by halving."""
    kinds = [f.dataType for f in df.select(*[c.alias(f"o{i}") for i, c in enumerate(order)]).schema.fields]
    lits = [F.struct(*[F.lit(v).cast(k).alias(f"o{i}") for i, (v, k) in enumerate(zip(c, kinds, strict=True))]) for c in cuts]
    row = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])

    def place(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(row < lits[mid], place(lo, mid)).otherwise(place(mid + 1, hi))

    return place(0, len(lits))


def number_in_buckets(df: DataFrame, group: list[str], place: Column, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``, the row number from 1 within ``group``, for buckets that follow one another in ``order``."""
    t = df.withColumn("_b", place)
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = t.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_above"))
    own = Window.partitionBy(*group, "_b").orderBy(*order)
    return t.join(sizes, [*group, "_b"]).withColumn(name, F.row_number().over(own) + F.col("_above")).drop("_b", "_above")


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str, buckets: int = BUCKETS) -> DataFrame:
    """Adds the row number within ``group`` (which may be empty) by ``order``; rows equal in it are told apart arbitrarily."""
    return number_in_buckets(df, group, bucket(df, order, cut_points(df, order, buckets)), order, name)


def numbered_by_key(df: DataFrame, group: list[str], key: str, ties: list[Column], name: str) -> DataFrame:
    """As ``numbered`` in the order of an md5 ``key``, whose first two digits are even buckets."""
    return number_in_buckets(df, group, F.substring(key, 1, 2), [F.col(key), *ties], name)


def _values(df: DataFrame, value: str, group: list[str], buckets: int) -> DataFrame:
    """group, value, ties, upto (rows with that value or less), all: one row for each distinct value, with its bucket ``_b``."""
    v = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("ties"))
    # of all rows, not of distinct values: one pass that combines in the tasks
    shares = [F.lit((k + 1) / buckets) for k in range(buckets - 1)] or [F.lit(0.5)]
    cuts = df.agg(F.percentile_approx(F.col(value).cast("double"), F.array(*shares), 1000).alias("c")).first()["c"] or []
    v = v.withColumn("_b", bucket(v, [F.col(value)], [(c,) for c in sorted(set(cuts))]))
    sizes = v.groupBy(*group, "_b").agg(F.sum("ties").alias("_n"))
    every = Window.partitionBy(*group)
    before = every.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_above"), F.sum("_n").over(every).alias("all"))
    own = Window.partitionBy(*group, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return v.join(sizes, [*group, "_b"]).withColumn("upto", F.col("_above") + F.sum("ties").over(own)).drop("_above")


def average_rank_share(df: DataFrame, value: str, group: list[str], name: str, buckets: int = BUCKETS) -> DataFrame:
    """Adds the average rank of ties over the number of rows within ``group``; null values get none.

    Ranks come from the counts of distinct values, so that a value which most rows have is one row.
    """
    v = _values(df, value, group, buckets)
    share = v.select(*group, value, ((F.col("upto") - (F.col("ties") - 1) / 2) / F.col("all")).alias(name))
    return df.join(share, [*group, value], "left") if group else df.join(share, value, "left")


def step_up(df: DataFrame, p: str, family: list[str], name: str = "q", buckets: int = BUCKETS) -> DataFrame:
    """Adds Benjamini-Hochberg's adjusted p values within large families; null p values get none.

    Of tied values the last one's rank counts, so a family's distinct values suffice.
    """
    v = _values(df, p, family, buckets).withColumn("_s", F.col(p) * F.col("all") / F.col("upto"))
    later = Window.partitionBy(*family).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    least = v.groupBy(*family, "_b").agg(F.min("_s").alias("_m")).select(*family, "_b", F.min("_m").over(later).alias("_later"))
    back = Window.partitionBy(*family, "_b").orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v = v.join(least, [*family, "_b"]).withColumn(name, F.least(F.lit(1.0), F.min("_s").over(back), F.col("_later")))
    return df.join(v.select(*family, p, name), [*family, p], "left")
