"""The entity x condition matrix in long form: standardised, ranked, selected, profiled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kontra.functions.ranks import average_rank_share
from kontra.functions.stats import benjamini_hochberg, beta_tail, chi2_tail, pearson


def zscore(matrix: DataFrame, value: str = "effect") -> DataFrame:
    """Row-standardised values (population sd); entities without variation go."""
    row = Window.partitionBy("entity")
    t = matrix.withColumn("_sd", F.stddev_pop(value).over(row)).withColumn("_mean", F.avg(value).over(row))
    return t.where("_sd > 1e-12").select("entity", "condition", ((F.col(value) - F.col("_mean")) / F.col("_sd")).alias("z"))


def percent_rank_matrix(contrast: DataFrame) -> DataFrame:
    return average_rank_share(contrast.select("entity", "condition", "effect"), "effect", ["condition"], "pct_rank").select("entity", "condition", "pct_rank")


def top_n(contrast: DataFrame, n: int) -> DataFrame:
    """Union of each condition's n rows of least fdr, then greatest absolute effect."""
    order = Window.partitionBy("condition").orderBy("fdr", F.abs("effect").desc(), "entity")
    return contrast.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n).groupBy("entity").agg(F.count(F.lit(1)).alias("chosen_by"))


def largest_significant(contrast: DataFrame, threshold: float, n: int) -> DataFrame:
    """Entities among some condition's n largest significant effects."""
    order = Window.partitionBy("condition").orderBy(F.abs("effect").desc(), "entity")
    return contrast.where(F.col("fdr") < threshold).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n).select("entity").distinct()


def zero_masked(contrast: DataFrame, threshold: float, n: int) -> DataFrame:
    """The audited legacy matrix: effects that are not significant become 0; entities are the union of
    each condition's n largest significant effects; values are percent ranks, standardised by row."""
    hit = F.col("fdr") < threshold
    chosen = largest_significant(contrast, threshold, n)
    kept = contrast.join(chosen, "entity", "left_semi").withColumn("masked", F.when(hit, F.col("effect")).otherwise(F.lit(0.0)))
    return zscore(average_rank_share(kept, "masked", ["condition"], "rank"), "rank")


def mask_diagnostics(contrast: DataFrame, threshold: float, n: int) -> DataFrame:
    """Per condition, over the entities of ``zero_masked``: their number, the share forced to zero, of them with an effect, and the size of the tie at zero."""
    off = F.col("fdr") >= threshold
    chosen = contrast.join(largest_significant(contrast, threshold, n), "entity", "left_semi")
    return chosen.groupBy("condition").agg(F.count(F.lit(1)).alias("entities"), F.avg(off.cast("double")).alias("forced_zero"), F.count_if(off & (F.col("effect") != 0)).alias("nonzero_forced"), F.count_if(off | (F.col("effect") == 0)).alias("zero_tie"))


def profile_mean(matrix: DataFrame, labels: DataFrame, value: str = "z") -> DataFrame:
    return matrix.join(labels.select("entity", "module"), "entity").groupBy("module", "condition").agg(F.avg(value).alias("mean"))


def profile_pct(cells: DataFrame, hits: DataFrame) -> DataFrame:
    """Share of a condition's detections in each module: of all its detections, and of those that are labelled."""
    every = hits.groupBy("condition").agg(F.count(F.lit(1)).alias("all_detected"))
    t = cells.join(F.broadcast(every), "condition", "left")
    return t.select("condition", "module", F.try_divide(100.0 * F.col("observed"), F.col("all_detected")).alias("pct_of_all"), F.try_divide(100.0 * F.col("observed"), F.nullif(F.col("detected"), F.lit(0))).alias("pct_of_labelled"))


def pair_rows(profile: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """a, b, x, y for each unordered pair of conditions and each module."""
    by = by or []
    a = profile.select(*by, "module", F.col("condition").alias("a"), F.col(value).alias("x"))
    b = profile.select(*by, "module", F.col("condition").alias("b"), F.col(value).alias("y"))
    return a.join(b, [*by, "module"]).where("a < b")


def correlations(profile: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Pearson and cosine similarity of the conditions' profiles over modules."""
    x, y = F.col("x"), F.col("y")
    cosine = F.try_divide(F.sum(x * y), F.nullif(F.sqrt(F.sum(x * x) * F.sum(y * y)), F.lit(0.0)))
    return pair_rows(profile, value, by).groupBy(*(by or []), "a", "b").agg(pearson(x, y).alias("pearson"), cosine.alias("cosine"))


def spearman(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """spearman, pairs, p_value: Pearson's correlation of average ranks, and its two-sided p by Student's t.

    t = r sqrt((n - 2) / (1 - r^2)) with n - 2 degrees of freedom; p is null below three pairs, and 0 where r is 1 or -1.
    """
    held = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y")).persist()
    t = average_rank_share(average_rank_share(held, "x", [], "rx"), "y", [], "ry")
    # one row: the table that is ranked is read many times, and let go here
    one = t.groupBy().agg(pearson(F.col("rx"), F.col("ry")).alias("r"), F.count(F.lit(1)).alias("pairs")).first()
    held.unpersist()
    t = pairs.sparkSession.createDataFrame([tuple(one)], "r double, pairs bigint")
    r2 = F.least(F.col("r") * F.col("r"), F.lit(1.0))
    return t.select(F.col("r").alias("spearman"), "pairs", F.when(F.col("pairs") > 2, beta_tail(1 - r2, F.col("pairs") - 2)).alias("p_value"))


def uniformity(cells: DataFrame, modules: int) -> DataFrame:
    """Chi-square of each condition's counts against the module sizes, BH over conditions."""
    e = F.col("detected") * F.col("size") / F.col("universe")
    t = cells.groupBy("condition").agg(F.sum(F.try_divide((F.col("observed") - e) * (F.col("observed") - e), e)).alias("chi2"))
    return benjamini_hochberg(t.withColumn("p_raw", chi2_tail(F.col("chi2"), modules - 1)), "p_raw", ["condition"])


def extremes(profile: DataFrame) -> DataFrame:
    """Highest and lowest condition of each module."""
    return profile.groupBy("module").agg(F.max_by("condition", F.struct("mean", "condition")).alias("highest"), F.min_by("condition", F.struct("mean", "condition")).alias("lowest"))


def flows(cells: DataFrame, best: DataFrame) -> DataFrame:
    """Edges condition -> module (detections) and module -> its best term, without empty ones."""
    a = cells.select(F.col("condition").alias("source"), F.concat(F.lit("M"), F.col("module").cast("string")).alias("target"), F.col("observed").cast("bigint").alias("value"))
    b = best.select(F.concat(F.lit("M"), F.col("module").cast("string")).alias("source"), F.col("term").alias("target"), F.col("study_count").cast("bigint").alias("value"))
    return a.unionByName(b).where("value > 0")
