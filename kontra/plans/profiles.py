"""Queries on matrices, ranks, profiles and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from kontra.functions.stats import benjamini_hochberg
from kontra.operators import detect, matrix, resample
from kontra.plans.detection import HITS_SQL, LABELS_SQL, bh_sql, cells, cells_sql, labels, rounded
from kontra.sources.tables import CONTRAST_SQL, contrasts, kept

REPS = 40
#: The reference's counts of label shuffles, bootstrap draws and attribute permutations; the *_full queries run these.
SHUFFLES, DRAWS, PERMUTATIONS = 100, 200, 10_000


def hits(s, d):
    return detect.detected(contrasts(s, d))


def ratio(s, d, modules=5):
    return detect.residuals(cells(s, d, modules)).select("condition", "module", "log2_ratio")


def z(s, d):
    return matrix.zscore(contrasts(s, d))


def null_correlations(s, d, reps=REPS, modules=5):
    def make():
        c = contrasts(s, d)
        shuffled = resample.shuffled_labels(labels(c, modules=modules), resample.repetitions(s, reps))
        t = detect.residuals(resample.null_cells(hits(s, d), shuffled, c))
        return matrix.correlations(t, "log2_ratio", ["rep"])

    return kept(s, d, f"null_correlations{reps}_{modules}", make)


def empirical_pairs(s, d, reps=REPS, modules=5):
    seen = matrix.correlations(ratio(s, d, modules), "log2_ratio").select("a", "b", "pearson")
    t = resample.empirical(seen, null_correlations(s, d, reps, modules), ["a", "b"], "pearson")
    return rounded(benjamini_hochberg(t, "p_empirical", ["a", "b"]))


def bootstrap(s, d, reps=REPS):
    c = contrasts(s, d)
    lab = labels(c)
    t = detect.residuals(resample.bootstrap_cells(hits(s, d), lab, resample.draws(lab, resample.repetitions(s, reps)), c))
    per = matrix.correlations(t, "log2_ratio", ["rep"])
    return rounded(resample.bootstrap_ci(per, ["a", "b"], "pearson"), 5)


def attribute(s, d, reps=200):
    pairs = matrix.correlations(ratio(s, d), "log2_ratio").select("a", "b", "pearson")
    kinds = contrasts(s, d).select("condition").distinct().withColumn("attribute", F.when(F.col("condition").rlike("^[0-9]"), "priority").otherwise("segment"))
    return rounded(resample.attribute_permutation(pairs, kinds, "pearson", resample.repetitions(s, reps)))


def spearman(s, d):
    t = matrix.correlations(ratio(s, d), "log2_ratio")
    return rounded(matrix.spearman(t.select(F.round("pearson", 9).alias("pearson"), F.round("cosine", 9).alias("cosine")), "pearson", "cosine"))


_KEY = "md5(rep::VARCHAR || ':' || {})"
_CORR = "CASE WHEN stddev_pop(x) > 1e-12 AND stddev_pop(y) > 1e-12 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END"
_COS = "sum(x * y) / nullif(sqrt(sum(x * x) * sum(y * y)), 0)"
_PAIR = "prof AS ({src}), pr AS (SELECT {by} x.condition AS a, y.condition AS b, x.v AS x, y.v AS y FROM prof x JOIN prof y ON x.module = y.module AND x.condition < y.condition {on})"
_RATIO = "SELECT condition, module, log2((observed + 0.5) / (expected + 0.5)) AS v FROM r"
_REAL = cells_sql() + ", " + _PAIR.format(src=_RATIO, by="", on="") + f", cor AS (SELECT a, b, {_CORR} AS pearson, {_COS} AS cosine FROM pr GROUP BY ALL)"
_DENSE = """conds AS (SELECT DISTINCT condition FROM contrast),
ng AS (SELECT s.rep, c.condition, s.module, s.size, coalesce(o.observed, 0) AS observed FROM ns s CROSS JOIN conds c LEFT JOIN no_ o ON o.rep = s.rep AND o.condition = c.condition AND o.module = s.module),
nr AS (SELECT rep, condition, module, log2((observed + 0.5) / (sum(observed) OVER (PARTITION BY rep, condition) * size / (sum(size) OVER (PARTITION BY rep, condition))::DOUBLE + 0.5)) AS v FROM ng),
np AS (SELECT x.rep, x.condition AS a, y.condition AS b, x.v AS x, y.v AS y FROM nr x JOIN nr y ON x.rep = y.rep AND x.module = y.module AND x.condition < y.condition),
nc AS (SELECT rep, a, b, """ + _CORR + """ AS pearson FROM np GROUP BY ALL)"""
_NULL = f""", reps AS (SELECT range::INTEGER AS rep FROM range({REPS})), num AS (SELECT entity, module, row_number() OVER (ORDER BY entity) AS i FROM labels),
dealt AS (SELECT rep, entity, module, i, row_number() OVER (PARTITION BY rep ORDER BY {_KEY.format('entity::VARCHAR')}, entity) AS j FROM num CROSS JOIN reps),
sh AS (SELECT x.rep, x.entity, y.module FROM dealt x JOIN dealt y ON x.rep = y.rep AND x.j = y.i),
no_ AS (SELECT rep, condition, module, count(*) AS observed FROM hits JOIN sh USING (entity) GROUP BY ALL), ns AS (SELECT rep, module, count(*) AS size FROM sh GROUP BY ALL), """ + _DENSE
_BOOT = f""", reps AS (SELECT range::INTEGER AS rep FROM range({REPS})), num AS (SELECT entity, module, row_number() OVER (ORDER BY entity) - 1 AS i, count(*) OVER () AS n FROM labels),
dr AS (SELECT rep, ('0x' || substr({_KEY.format('i::VARCHAR')}, 1, 8))::UBIGINT % n AS i, count(*) AS copies FROM num CROSS JOIN reps GROUP BY ALL),
bl AS (SELECT rep, entity, module, copies FROM dr JOIN num ON dr.i = num.i),
no_ AS (SELECT rep, condition, module, sum(copies) AS observed FROM hits JOIN bl USING (entity) GROUP BY ALL), ns AS (SELECT rep, module, sum(copies) AS size FROM bl GROUP BY ALL), """ + _DENSE
_Z = f"WITH {CONTRAST_SQL}, z AS (SELECT entity, condition, (effect - avg(effect) OVER w) / stddev_pop(effect) OVER w AS z FROM contrast WINDOW w AS (PARTITION BY entity))"


def _avg_rank(value: str, part: str) -> str:
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {value}) + (count(*) OVER (PARTITION BY {part}, {value}) - 1) / 2.0) / (count(*) OVER (PARTITION BY {part}))::DOUBLE"


QUERIES = {
    "zscore_matrix": (lambda s, d: rounded(z(s, d)), f"{_Z} SELECT entity, condition, round(z, 6) AS z FROM z"),
    "pct_rank_matrix": (lambda s, d: rounded(matrix.percent_rank_matrix(contrasts(s, d))), f"WITH {CONTRAST_SQL} SELECT entity, condition, round({_avg_rank('effect', 'condition')}, 6) AS pct_rank FROM contrast"),
    "topn_variant": (
        lambda s, d: matrix.top_n(contrasts(s, d), 50),
        f"WITH {CONTRAST_SQL}, t AS (SELECT entity, row_number() OVER (PARTITION BY condition ORDER BY fdr, abs(effect) DESC, entity) AS rn FROM contrast) SELECT entity, count(*) AS chosen_by FROM t WHERE rn <= 50 GROUP BY entity",
    ),
    "legacy_masked_matrix": (
        lambda s, d: rounded(matrix.zero_masked(contrasts(s, d), 0.05, 300)),
        f"WITH {CONTRAST_SQL}, ch AS (SELECT DISTINCT entity FROM (SELECT entity, row_number() OVER (PARTITION BY condition ORDER BY abs(effect) DESC, entity) AS rn FROM contrast WHERE fdr < 0.05) WHERE rn <= 300), m AS (SELECT entity, condition, CASE WHEN fdr < 0.05 THEN effect ELSE 0 END AS masked FROM contrast SEMI JOIN ch USING (entity)), r AS (SELECT entity, condition, {_avg_rank('masked', 'condition')} AS rk FROM m), q AS (SELECT entity, condition, rk, avg(rk) OVER w AS mu, stddev_pop(rk) OVER w AS sd FROM r WINDOW w AS (PARTITION BY entity)) SELECT entity, condition, round((rk - mu) / sd, 6) AS z FROM q WHERE sd > 1e-12",
    ),
    "legacy_mask_diagnostics": (
        lambda s, d: rounded(matrix.mask_diagnostics(contrasts(s, d), 0.05, 300)),
        f"WITH {CONTRAST_SQL}, ch AS (SELECT DISTINCT entity FROM (SELECT entity, row_number() OVER (PARTITION BY condition ORDER BY abs(effect) DESC, entity) AS rn FROM contrast WHERE fdr < 0.05) WHERE rn <= 300) SELECT condition, count(*) AS entities, round(avg((fdr >= 0.05)::INT), 6) AS forced_zero, count(*) FILTER (fdr >= 0.05 AND effect <> 0) AS nonzero_forced, count(*) FILTER (fdr >= 0.05 OR effect = 0) AS zero_tie FROM contrast SEMI JOIN ch USING (entity) GROUP BY condition",
    ),
    "module_profile_mean": (
        lambda s, d: rounded(matrix.profile_mean(z(s, d), labels(contrasts(s, d)))),
        f"{_Z}, {LABELS_SQL} SELECT module, condition, round(avg(z), 6) AS mean FROM z JOIN labels USING (entity) GROUP BY ALL",
    ),
    "module_extremes": (
        lambda s, d: matrix.extremes(matrix.profile_mean(z(s, d), labels(contrasts(s, d)))),
        f"{_Z}, {LABELS_SQL}, p AS (SELECT module, condition, avg(z) AS mean FROM z JOIN labels USING (entity) GROUP BY ALL) SELECT module, arg_max(condition, mean) AS highest, arg_min(condition, mean) AS lowest FROM p GROUP BY module",
    ),
    "module_profile_pct": (
        lambda s, d: rounded(matrix.profile_pct(cells(s, d), hits(s, d))),
        f"{cells_sql()}, e AS (SELECT condition, count(*) AS n FROM hits GROUP BY condition) SELECT condition, module, round(100.0::DOUBLE * observed / n, 6) AS pct_of_all, round(100.0::DOUBLE * observed / nullif(detected, 0), 6) AS pct_of_labelled FROM r LEFT JOIN e USING (condition)",
    ),
    "profile_similarity": (lambda s, d: rounded(matrix.correlations(ratio(s, d), "log2_ratio")), f"{_REAL} SELECT a, b, round(pearson, 6) AS pearson, round(cosine, 6) AS cosine FROM cor"),
    "profile_spearman": (
        spearman,
        # the p value by Simpson's rule over the angle whose sine is the correlation
        f"{_REAL}, rr AS (SELECT 1 AS g, round(pearson, 9) AS p, round(cosine, 9) AS c FROM cor WHERE pearson IS NOT NULL AND cosine IS NOT NULL), k AS (SELECT {_avg_rank('p', 'g')} AS x, {_avg_rank('c', 'g')} AS y FROM rr), sp AS (SELECT {_CORR} AS r, count(*) AS n FROM k), "
        "an AS (SELECT *, asin(least(abs(r), 1)) AS t FROM sp) SELECT round(r, 6) AS spearman, n AS pairs, round(CASE WHEN n > 2 THEN 1 - 2 * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0) - lgamma(0.5)) * (SELECT sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * cos(t * i / 4000.0) ^ (n - 3)) * t / 12000.0 FROM range(4001) a(i)) END, 6) AS p_value FROM an",
    ),
    "residual_chisq": (
        lambda s, d: rounded(matrix.uniformity(cells(s, d), 5)),
        f"{cells_sql()}, t AS (SELECT condition, sum((observed - expected) ^ 2 / expected) AS chi2 FROM r GROUP BY condition), u AS (SELECT *, exp(-chi2 / 2) * (1 + chi2 / 2) AS p_raw FROM t) SELECT condition, round(chi2, 6) AS chi2, round(p_raw, 6) AS p_raw, round(q, 6) AS q FROM {bh_sql('u', 'p_raw', 'condition')}",
    ),
    "label_shuffle_null": (
        lambda s, d: rounded(null_correlations(s, d).select("rep", "a", "b", "pearson")),
        f"WITH {CONTRAST_SQL}, {HITS_SQL}, {LABELS_SQL}{_NULL} SELECT rep, a, b, round(pearson, 6) AS pearson FROM nc",
    ),
    "null_summary": (
        lambda s, d: rounded(resample.null_summary(null_correlations(s, d), "pearson"), 5),
        f"WITH {CONTRAST_SQL}, {HITS_SQL}, {LABELS_SQL}{_NULL} SELECT round(avg(pearson), 5) AS mean, round(stddev_pop(pearson), 5) AS sd, round(quantile_cont(pearson, 0.05), 5) AS q05, round(quantile_cont(pearson, 0.5), 5) AS q50, round(quantile_cont(pearson, 0.95), 5) AS q95 FROM nc",
    ),
    "empirical_p_pairs": (
        empirical_pairs,
        f"{_REAL}{_NULL}, t AS (SELECT c.a, c.b, c.pearson, (count(*) FILTER (n.pearson >= c.pearson - 1e-9) + 1)::DOUBLE / (count(*) + 1) AS p_empirical, 100.0::DOUBLE * count(*) FILTER (n.pearson < c.pearson - 1e-9) / count(*) AS percentile_vs_null, avg(n.pearson) AS null_mean FROM cor c JOIN nc n ON c.a = n.a AND c.b = n.b GROUP BY c.a, c.b, c.pearson) SELECT a, b, round(pearson, 6) AS pearson, round(p_empirical, 6) AS p_empirical, round(percentile_vs_null, 6) AS percentile_vs_null, round(null_mean, 6) AS null_mean, round(q, 6) AS q FROM {bh_sql('t', 'p_empirical', 'a, b')}",
    ),
    "bootstrap_ci": (
        bootstrap,
        f"WITH {CONTRAST_SQL}, {HITS_SQL}, {LABELS_SQL}{_BOOT}, q AS (SELECT a, b, quantile_cont(pearson, 0.025) AS low, quantile_cont(pearson, 0.975) AS high, count(pearson) AS reps FROM nc GROUP BY ALL) SELECT a, b, round(low, 5) AS low, round(high, 5) AS high, reps, NOT (low < 0 AND high > 0) AS excludes_zero FROM q",
    ),
    "attr_permutation": (
        attribute,
        f"{_REAL}, reps AS (SELECT range::INTEGER AS rep FROM range(200)), att AS (SELECT condition, CASE WHEN regexp_matches(condition, '^[0-9]') THEN 'priority' ELSE 'segment' END AS attribute, row_number() OVER (ORDER BY condition) AS i FROM (SELECT DISTINCT condition FROM contrast)), "
        f"dl AS (SELECT rep, condition, attribute, i, row_number() OVER (PARTITION BY rep ORDER BY {_KEY.format('condition')}, condition) AS j FROM att CROSS JOIN reps), ev AS (SELECT x.rep, x.condition, y.attribute FROM dl x JOIN dl y ON x.rep = y.rep AND x.j = y.i UNION ALL SELECT -1, condition, attribute FROM att), "
        "gp AS (SELECT l.rep, avg(pearson) FILTER (l.attribute = r.attribute) - avg(pearson) FILTER (l.attribute <> r.attribute) AS gap FROM cor JOIN ev l ON l.condition = a JOIN ev r ON r.condition = b AND r.rep = l.rep GROUP BY l.rep), ob AS (SELECT gap AS observed FROM gp WHERE rep = -1) "
        "SELECT round(observed, 6) AS observed, round((count(*) FILTER (abs(gap) >= abs(observed) - 1e-9) + 1)::DOUBLE / (count(*) + 1), 6) AS p_value, count(*) AS valid FROM gp CROSS JOIN ob WHERE rep >= 0 AND gap IS NOT NULL GROUP BY observed",
    ),
}


def _counted(name: str, old: int, new: int) -> str:
    """A query's SQL with another number of repetitions."""
    sql = QUERIES[name][1]
    assert sql.count(f"range({old})") == 1
    return sql.replace(f"range({old})", f"range({new})")


QUERIES |= {
    "empirical_p_pairs_full": (lambda s, d: empirical_pairs(s, d, SHUFFLES), _counted("empirical_p_pairs", REPS, SHUFFLES)),
    "bootstrap_ci_full": (lambda s, d: bootstrap(s, d, DRAWS), _counted("bootstrap_ci", REPS, DRAWS)),
    "attr_permutation_full": (lambda s, d: attribute(s, d, PERMUTATIONS), _counted("attr_permutation", 200, PERMUTATIONS)),
}
