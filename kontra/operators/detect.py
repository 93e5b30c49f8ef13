"""Detections of entities under conditions: counts, patterns, overlaps, contributions.

Inputs are the long contrast table (entity, condition, ord, effect, ..., fdr) and, where
modules matter, labels (entity, module, strength).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontra.functions.stats import benjamini_hochberg, fisher, odds_ratio, wilson


def check_threshold(threshold: float) -> float:
    if not 0 < threshold <= 1:
        raise ValueError("a threshold lies in (0, 1]")
    return threshold


def detected(contrast: DataFrame, threshold: float = 0.05, sign: int = 0) -> DataFrame:
    """Rows below the threshold (strictly); of effects above or below zero only, if ``sign`` is 1 or -1."""
    rows = contrast.where(F.col("fdr") < check_threshold(threshold))
    return rows.where(F.col("effect") * sign > 0) if sign else rows


def deg_counts(contrast: DataFrame, threshold: float = 0.05) -> DataFrame:
    return contrast.groupBy("condition").agg(F.count_if(F.col("fdr") < check_threshold(threshold)).alias("detected"))


def summary(contrast: DataFrame, wanted: list[str], threshold: float) -> DataFrame:
    """Tested and detected entities of the wanted conditions."""
    rows = contrast.where(F.col("condition").isin(wanted))
    return rows.groupBy("condition").agg(F.count(F.lit(1)).alias("tested"), F.lit(check_threshold(threshold)).alias("threshold"), F.count_if(F.col("fdr") < threshold).alias("detected"))


def multiplicity_class(m: Column) -> Column:
    """Right-closed classes of how many conditions detect an entity."""
    return F.when(m == 0, "none").when(m == 1, "unique").when(m <= 9, "shared").otherwise("all")


def evidence(contrast: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Every row with its detection, direction, and the entity's multiplicity and class."""
    hit = F.col("fdr") < check_threshold(threshold)
    m = F.sum(hit.cast("int")).over(Window.partitionBy("entity"))
    rows = contrast.withColumn("detected", hit).withColumn("multiplicity", m)
    direction = F.when(F.col("effect") > 0, "up").when(F.col("effect") < 0, "down").otherwise("zero")
    return rows.select("entity", "condition", "effect", "fdr", "detected", direction.alias("direction"), "multiplicity", multiplicity_class(F.col("multiplicity")).alias("category"))


def sensitivity(contrast: DataFrame, thresholds: list[float], n_conditions: int = 10) -> DataFrame:
    """Union, exactly-one and all-conditions sizes at each threshold, in one pass over the table."""
    t = F.explode(F.array(*[F.lit(check_threshold(x)) for x in thresholds]))
    each = contrast.select("entity", "fdr", t.alias("threshold")).groupBy("threshold", "entity").agg(F.count_if(F.col("fdr") < F.col("threshold")).alias("m"))
    return each.groupBy("threshold").agg(F.count_if(F.expr("m > 0")).alias("union_size"), F.count_if(F.expr("m = 1")).alias("exactly_one"), F.count_if(F.col("m") == n_conditions).alias("all_conditions"))


def exact_patterns(hits: DataFrame, names: list[str], universe: DataFrame | None = None) -> DataFrame:
    """Entities by exact set of detecting conditions: label, degree, count; with ``universe`` also those of it under none.

    The set is a bit mask per entity, so the second aggregate has at most 2^10 groups.
    """
    masks = hits.groupBy("entity").agg(F.sum(F.expr("shiftleft(1, ord - 1)")).alias("mask"))
    if universe is not None:
        masks = universe.select("entity").distinct().join(masks, "entity", "left").fillna(0, ["mask"])
    by = masks.groupBy("mask").agg(F.count(F.lit(1)).alias("gene_count"))
    active = [F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.lit(c)) for i, c in enumerate(names)]
    return by.select(F.when(F.col("mask") == 0, "none").otherwise(F.concat_ws(" & ", *active)).alias("intersection"), F.bit_count("mask").alias("degree"), "gene_count")


def unique_shared(hits: DataFrame) -> DataFrame:
    m = F.count(F.lit(1)).over(Window.partitionBy("entity"))
    return hits.withColumn("m", m).groupBy("condition").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.expr("m = 1")).alias("exclusive"), F.count_if(F.expr("m > 1")).alias("shared"))


def exclusive_effects(contrast: DataFrame, hits: DataFrame, names: list[str]) -> DataFrame:
    """Entities detected under one condition only, with their effects and adjusted p values under all of them."""
    one = hits.groupBy("entity").agg(F.count(F.lit(1)).alias("m"), F.min("condition").alias("exclusive_to")).where("m = 1").drop("m")
    wide = contrast.join(one, "entity").groupBy("entity", "exclusive_to").pivot("condition", names).agg(F.round(F.first("effect"), 6), F.round(F.first("fdr"), 6))
    return wide.toDF("entity", "exclusive_to", *[f"{n}_{i + 1}" for i in range(len(names)) for n in ("effect", "fdr")])


def pairwise_overlap(contrast: DataFrame, hits: DataFrame) -> DataFrame:
    """45 pairs of conditions: overlap, Jaccard, overlap coefficient, sign concordance, Fisher (greater), BH.

    The self-join is on the entity, so a pair's rows are its common detections only.
    """
    a = hits.select("entity", F.col("ord").alias("ord_a"), F.signum("effect").alias("sa"))
    b = hits.select("entity", F.col("ord").alias("ord_b"), F.signum("effect").alias("sb"))
    both = a.join(b, "entity").where("ord_a < ord_b").groupBy("ord_a", "ord_b").agg(F.count(F.lit(1)).alias("overlap"), F.count_if(F.expr("sa = sb")).alias("agree"))
    sizes = contrast.groupBy("condition", "ord").agg(F.count(F.lit(1)).alias("universe"))
    n = hits.groupBy("ord").agg(F.count(F.lit(1)).alias("n"))
    sizes = F.broadcast(sizes.join(F.broadcast(n), "ord", "left").select("ord", "condition", "universe", F.coalesce("n", F.lit(0)).alias("n")))
    left = sizes.select(F.col("ord").alias("ord_a"), F.col("condition").alias("a"), "universe", F.col("n").alias("na"))
    right = sizes.select(F.col("ord").alias("ord_b"), F.col("condition").alias("b"), F.col("n").alias("nb"))
    t = left.join(right, F.col("ord_a") < F.col("ord_b")).join(both, ["ord_a", "ord_b"], "left").fillna(0, ["overlap", "agree"])
    o, na, nb = F.col("overlap"), F.col("na"), F.col("nb")
    t = t.select(
        "a", "b", "overlap",
        F.try_divide(o, F.nullif(na + nb - o, F.lit(0))).alias("jaccard"),
        F.try_divide(o, F.nullif(F.least(na, nb), F.lit(0))).alias("overlap_coefficient"),
        F.try_divide(F.col("agree") * 100.0, F.nullif(o, F.lit(0))).alias("concordant_pct"),
        odds_ratio(o, na - o, nb - o, F.col("universe") - na - nb + o).alias("odds_ratio"),
        fisher(o, na, nb, F.col("universe"), "greater").alias("p_raw"),
    )
    return benjamini_hochberg(t, "p_raw", ["a", "b"])


def module_cells(hits: DataFrame, labels: DataFrame, contrast: DataFrame) -> DataFrame:
    """condition x module, dense: observed, detected (of the condition), size (of the module), universe; labelled entities only."""
    seen = labels.groupBy("module").agg(F.count(F.lit(1)).alias("size"))
    seen = seen.withColumn("universe", F.sum("size").over(Window.partitionBy()))
    grid = contrast.select("condition").distinct().crossJoin(F.broadcast(seen))
    o = hits.join(labels.select("entity", "module"), "entity").groupBy("condition", "module").agg(F.count(F.lit(1)).alias("observed"))
    t = grid.join(o, ["condition", "module"], "left").fillna(0, ["observed"])
    return t.withColumn("detected", F.sum("observed").over(Window.partitionBy("condition")))


def residuals(cells: DataFrame) -> DataFrame:
    """Adds expected, log2 observed/expected with half a count added, and the Pearson residual."""
    e = F.col("detected") * F.col("size") / F.col("universe")
    t = cells.withColumn("expected", e)
    return t.withColumn("log2_ratio", F.log2((F.col("observed") + 0.5) / (F.col("expected") + 0.5))).withColumn("pearson_residual", F.try_divide(F.col("observed") - F.col("expected"), F.sqrt("expected")))


def module_preference(cells: DataFrame) -> DataFrame:
    """Residuals with odds ratio, Fisher (two-sided) and BH over the family of cells."""
    o, d, s, u = (F.col(c) for c in ("observed", "detected", "size", "universe"))
    t = residuals(cells).withColumn("odds_ratio", odds_ratio(o, d - o, s - o, u - d - s + o)).withColumn("p_raw", fisher(o, d, s, u))
    return benjamini_hochberg(t, "p_raw", ["condition", "module"])


def contributions(contrast: DataFrame, hits: DataFrame, labels: DataFrame) -> DataFrame:
    """Thirteen measures of each module under each condition, with a 95 % interval of the share of ups.

    Effects, strength and core are those of the whole module, detected or not; a labelled
    entity without a row under a condition counts as one that is not detected.
    """
    hit = hits.select("entity", "condition", F.lit(True).alias("hit"))
    grid = labels.crossJoin(F.broadcast(contrast.select("condition").distinct()))
    t = grid.join(contrast.select("entity", "condition", "effect"), ["entity", "condition"], "left").join(hit, ["entity", "condition"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    g = t.groupBy("condition", "module").agg(
        F.count(F.lit(1)).alias("module_entities"),
        F.count_if("hit").alias("detected"),
        F.count_if(F.col("hit") & (F.col("effect") > 0)).alias("up"),
        F.count_if(F.col("hit") & (F.col("effect") < 0)).alias("down"),
        F.avg("effect").alias("mean_effect"),
        F.percentile("effect", 0.5).alias("median_effect"),
        F.avg("strength").alias("mean_strength"),
        F.count_if(F.col("strength") >= 0.8).alias("core"),
    )
    n = F.col("detected")
    total = F.sum("detected").over(Window.partitionBy("condition"))
    return g.select(
        "*",
        F.try_divide(100.0 * n, F.col("module_entities")).alias("pct_module_detected"),
        F.try_divide(100.0 * n, F.nullif(total, F.lit(0))).alias("pct_condition_in_module"),
        F.try_divide(100.0 * F.col("up"), F.nullif(n, F.lit(0))).alias("pct_up"),
        wilson(F.col("up"), n, False).alias("pct_up_low"),
        wilson(F.col("up"), n, True).alias("pct_up_high"),
    )
