"""Queries on labelings and mixtures of subspaces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import numpy as np

from kontra.functions.stats import adjusted_rand, draw
from kontra.operators import cluster, matrix, resample, subspace
from kontra.operators.subspace import ANNEALED, Model, Spec
from kontra.plans.detection import LABELS_SQL, cells, labels, rounded
from kontra.plans.profiles import _Z, hits, z
from kontra.sources.tables import CONTRAST_SQL, conditions, contrasts, kept, table

RUNS, K = 8, 5
#: Starts and most passes of a fit, and shuffles of the likelihood test, as in the reference.
STARTS, PASSES, SHUFFLES = 10, 100, 30
#: Most passes of the comparisons of configurations and dimensions, their trials, and resamples of a stability check, likewise.
LONG, TRIALS, BOOTS = 150, 5, 15


def runs(s, d):
    """Noisy relabelings of the stand-in modules, one for each run."""

    def make():
        base = labels(contrasts(s, d)).select("entity", "module").crossJoin(F.broadcast(resample.repetitions(s, RUNS).withColumnRenamed("rep", "run")))
        noisy = draw(F.lit(10), F.col("run"), F.col("entity")) < 2
        other = draw(F.lit(K), F.lit("x"), F.col("run"), F.col("entity"))
        label = F.when(noisy, other).otherwise(F.pmod(F.col("module") + F.col("run"), F.lit(K)))
        return base.select("run", "entity", label.cast("int").alias("label"))

    return kept(s, d, "runs", make)


def aligned(s, d):
    return kept(s, d, "aligned", lambda: cluster.aligned(runs(s, d), K))


def base_labels(s, d):
    return labels(contrasts(s, d)).select("entity", F.col("module").alias("label"))


def vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")


def rows(s, d):
    """Standardised responses as vectors: id, grp, x."""

    def make():
        names = conditions(s, d)
        wide = z(s, d).groupBy("entity").pivot("condition", names).agg(F.first("z"))
        return wide.select(F.col("entity").alias("id"), F.lit(0).alias("grp"), F.array(*[F.col(f"`{c}`") for c in names]).alias("x"))

    return kept(s, d, "rows", make)


def frame(s, models, **more):
    data = [(m.spec.name, len(m.spec.latent), m.parameters, float(m.log_likelihood), float(m.bic), float(m.icl)) for m in models]
    return s.createDataFrame(data, "config string, k int, df int, log_likelihood double, bic double, icl double")


def model_selection(s, d):
    specs = [Spec(f"k{k}_d{q}", (q,) * k, seed) for k in range(2, 26) for q in (0, 1) for seed in range(STARTS)]
    return frame(s, subspace.best(subspace.fit(rows(s, d), specs, PASSES)).values())


def heterogeneous(s, d):
    """config, k, total latent dimensions, df, likelihood, BIC: one subspace of a higher dimension among lines, at two k."""
    kinds = {"all lines, k=5": (1,) * 5, "a plane among lines, k=5": (2, 1, 1, 1, 1), "all lines, k=6": (1,) * 6, "a plane among lines, k=6": (2, 1, 1, 1, 1, 1), "two planes among lines, k=5": (2, 2, 1, 1, 1), "a point among lines, k=5": (0, 1, 1, 1, 1)}
    models = subspace.best(subspace.fit(rows(s, d), [Spec(n, q, seed) for n, q in kinds.items() for seed in range(15)], LONG)).values()
    latent = s.createDataFrame([(n, sum(q)) for n, q in kinds.items()], "config string, latent int")
    return frame(s, models).join(F.broadcast(latent), "config").orderBy("bic")


def lines(s, d, n=RUNS, **more):
    """Fits of lines from ``n`` starts, all of one name, so that ``best`` chooses."""
    return subspace.fit(rows(s, d), [Spec("lines", (1,) * K, i, **more) for i in range(n)], PASSES)


def mixture(s, d):
    return subspace.assign(rows(s, d), list(subspace.best(lines(s, d)).values())).select("entity", "label")


#: Ways of fitting that are compared: starts, and inverse temperatures.
CONFIGURATIONS = {"20 starts": (20, (1.0,)), "50 starts": (50, (1.0,)), "20 starts, annealed": (20, ANNEALED)}


def em_configurations(s, d):
    """config, best, mean, sd: log-likelihoods of independent trials, each the best of its starts, for more starts and for annealing."""
    specs = [Spec(f"{c}|{t}", (1,) * K, 1000 * t + i, heat=heat) for c, (starts, heat) in CONFIGURATIONS.items() for t in range(TRIALS) for i in range(starts)]
    found = [(n.split("|")[0], float(m.log_likelihood)) for n, m in subspace.best(subspace.fit(rows(s, d), specs, LONG)).items()]
    t = s.createDataFrame(found, "config string, ll double")
    return t.groupBy("config").agg(F.max("ll").alias("best"), F.avg("ll").alias("mean"), F.stddev_pop("ll").alias("sd"), F.count("ll").alias("trials"))


def em_steps(s, d):
    """step, component, weight, noise, centre_sq, log_likelihood, bic, icl: a mixture of three points from fixed starts and after each of two passes."""
    names = conditions(s, d)
    first = [r["x"] for r in rows(s, d).orderBy("id").limit(3).collect()]
    if len(first) < 3:
        return s.createDataFrame([], "step int, component int, weight double, noise double, centre_sq double, log_likelihood double, bic double, icl double")
    none = np.zeros((len(names), 0))
    start = Model(Spec("points", (0, 0, 0)), np.full(3, 1 / 3), np.array(first), [none] * 3, [np.zeros(0)] * 3, np.ones(3))
    data = [(k, j, float(m.weight[j]), float(m.noise[j]), float((m.mean[j] ** 2).sum()), m.log_likelihood, float(m.bic), float(m.icl)) for k, (m,) in enumerate(subspace.steps(rows(s, d), [start], 2)) for j in range(3)]
    return rounded(s.createDataFrame(data, "step int, component int, weight double, noise double, centre_sq double, log_likelihood double, bic double, icl double"), 4)


def consensus_runs(name, runs, starts, **more):
    """Specs of independent runs, each the best of its starts."""
    return [Spec(f"{name}|{r}", (1,) * K, r * starts + i, **more) for r in range(runs) for i in range(starts)]


def consensus_of(s, d, models):
    return cluster.consensus(cluster.aligned(subspace.assign(rows(s, d), models), K))


def mixture_consensus(s, d):
    return consensus_of(s, d, list(subspace.best(subspace.fit(rows(s, d), consensus_runs("run", 30, 20), PASSES)).values()))


def bootstrap_stability(s, d):
    """k, mean, sd, n, bic: agreement of resampled fits with the fit of all rows, for each k, and that fit's BIC."""
    ks = range(3, 16)
    specs = [Spec(f"{k}|all", (1,) * k, i) for k in ks for i in range(STARTS)]
    specs += [Spec(f"{k}|{r}", (1,) * k, 100 + 5 * r + i, resample=r) for k in ks for r in range(15) for i in range(5)]
    found = subspace.best(subspace.fit(rows(s, d), specs, PASSES))
    # every fit's labels of a row stay together; each meets that of all rows at its k
    every = [(k, n) for k in ks for n in ("all", *range(15)) if f"{k}|{n}" in found and f"{k}|all" in found]
    base = [every.index((k, "all")) for k, _ in every]
    of = s.createDataFrame([(i, k) for i, (k, n) in enumerate(every) if n != "all"], "run int, k int")
    labels = subspace.assigned(rows(s, d), [found[f"{k}|{n}"] for k, n in every])
    t = adjusted_rand(cluster.contingencies(labels, base).join(F.broadcast(of), "run"), ["k", "run"], "la", "lb")
    t = t.groupBy("k").agg(F.avg("ari").alias("mean"), F.stddev_pop("ari").alias("sd"), F.count("ari").alias("n"))
    whole = [(k, "lines", float(found[f"{k}|all"].bic)) for k in ks if f"{k}|all" in found]
    return cluster.with_selection(t, s.createDataFrame(whole, "k int, config string, bic double"), "lines")


def jackknife(s, d):
    """config, ari: agreement of the consensus of 10 runs without a condition with that of all conditions."""
    names = conditions(s, d)
    configs = {f"without {c}": tuple(j for j in range(len(names)) if j != i) for i, c in enumerate(names)}
    specs = consensus_runs("all", 10, 15) + [x for name, dims in configs.items() for x in consensus_runs(name, 10, 15, dims=dims)]
    found = subspace.best(subspace.fit(rows(s, d), specs, PASSES))
    if not found:
        return s.createDataFrame([], "config string, ari double")
    labels = subspace.assigned(rows(s, d), [found[f"{name}|{r}"] for name in ("all", *configs) for r in range(10)])
    each = cluster.consensus_groups(labels, 10, K)
    of = s.createDataFrame(list(enumerate(configs, 1)), "run int, config string")
    return adjusted_rand(cluster.contingencies(each, [0] * (1 + len(configs))).join(F.broadcast(of), "run"), ["config"], "la", "lb").select("config", "ari").orderBy("ari")


def subsample_stability(s, d):
    """ARI of every two of RUNS fits, each on its own subsample of 0.8 of the rows, on the rows they share."""
    full = rows(s, d)
    taken = resample.subsamples(full.select(F.col("id").alias("entity")), resample.repetitions(s, RUNS), 0.8)
    part = full.drop("grp").join(taken.select(F.col("entity").alias("id"), F.col("rep").cast("int").alias("grp")), "id").select("id", "grp", "x")
    models = subspace.fit(part, [Spec(f"sub{g}", (1,) * K, seed, group=g) for g in range(RUNS) for seed in range(STARTS)], PASSES)
    return resample.stability(subspace.assign(part, list(subspace.best(models).values())))


def likelihood_permutation(s, d):
    """log_likelihood, null_mean, null_sd, z, least and greatest of the null, plus-one p: all columns shuffled on their own against the responses."""
    models = subspace.fit(rows(s, d).unionByName(shuffled_rows(s, d, SHUFFLES)), [Spec(f"g{g}", (1,) * K, seed, group=g) for g in range(SHUFFLES + 1) for seed in range(STARTS)], PASSES)
    by = {m.spec.group: m.log_likelihood for m in subspace.best(models).values()}
    real = by.pop(0)
    null = np.array(list(by.values()))
    sd = float(null.std())
    z_score = float((real - null.mean()) / sd) if sd > 0 else None
    return s.createDataFrame([(float(real), float(null.mean()), sd, z_score, float(null.min()), float(null.max()), float((int((null >= real).sum()) + 1) / (len(null) + 1)))], "log_likelihood double, null_mean double, null_sd double, z double, null_least double, null_greatest double, p_value double")


def shuffled_rows(s, d, reps):
    """The rows with each condition's values permuted over the entities: id, grp (from 1), x."""
    return resample.shuffled_vectors(rows(s, d), reps)


def fitted(data, starts, passes, group=0, hard=False):
    """Fits of lines (or k-means) for the bootstrap protocol: each resample's best of ``starts``, all in the same passes."""

    def fit(resamples):
        specs = [Spec(str(r), ((0 if hard else 1),) * K, 100 * (0 if r is None else r + 1) + i, group=group, resample=r, hard=hard) for r in resamples for i in range(starts)]
        return {r: m for r, m in ((None if n == "None" else int(n), m) for n, m in subspace.best(subspace.fit(data.where(F.col("grp") == group), specs, passes)).items())}

    return fit


def kmeans_baseline(s, d):
    """mean, sd, n: agreement of k-means of resampled entities with k-means of all, by the protocol that the mixture is held to."""
    data = rows(s, d)
    return resample.bootstrap_ari(fitted(data, 10, 300, hard=True), lambda models: subspace.assign(data, models), BOOTS)


def baseline_checks(s, d):
    """check, value: the mixture against shuffled columns and against k-means."""
    both = rows(s, d).unionByName(shuffled_rows(s, d, 1)).persist()
    one = subspace.best(subspace.fit(both, [Spec(f"g{g}", (1,) * K, i, group=g) for g in (0, 1) for i in range(20)], LONG))
    real, null = one["g0"], one["g1"]
    mean = lambda fit, group: resample.bootstrap_ari(fit, lambda models: subspace.assign(both.where(F.col("grp") == group), models), BOOTS).first()["mean"]
    means = subspace.best(subspace.fit(rows(s, d), [Spec("means", (0,) * K, i, hard=True) for i in range(10)], 300))["means"]
    labels_of = lambda m: subspace.assign(rows(s, d), [m]).select("entity", "label")
    data = [
        ("likelihood over that of shuffled columns", real.log_likelihood - null.log_likelihood),
        ("BIC under that of shuffled columns", float(null.bic - real.bic)),
        ("agreement of resampled mixtures", mean(fitted(both, 8, LONG), 0)),
        ("agreement of resampled mixtures, shuffled columns", mean(fitted(both, 8, LONG, group=1), 1)),
        ("agreement of resampled k-means", mean(fitted(both, 10, 300, hard=True), 0)),
        ("agreement of k-means with the mixture", cluster.agreement(labels_of(means), labels_of(real)).first()["ari"]),
    ]
    both.unpersist()
    return s.createDataFrame(data, "check string, value double")


def variants(s, d):
    """Matrices of other strategies, in groups of one table: 0 all entities' responses, 1 standardised percent ranks, 2 the union of each condition's 1,000 strongest."""
    names, c = conditions(s, d), contrasts(s, d)
    ranked = matrix.zscore(matrix.percent_rank_matrix(c), "pct_rank").groupBy("entity").pivot("condition", names).agg(F.first("z"))
    ranked = ranked.select(F.col("entity").alias("id"), F.lit(1).alias("grp"), F.array(*[F.col(f"`{x}`") for x in names]).alias("x"))
    top = rows(s, d).join(matrix.top_n(c, 1000).select(F.col("entity").alias("id")), "id", "left_semi").select("id", F.lit(2).alias("grp"), "x")
    return rows(s, d).unionByName(ranked).unionByName(top)


STRATEGIES = ["responses", "percent ranks", "top 1000"]


def cross_strategy(s, d, runs=30, starts=20):
    """variant_a, variant_b, shared, ari_single, ari_consensus: agreement of every two strategies on the entities that both have."""
    data = variants(s, d).persist()
    specs = [Spec(f"{g}|{r}", (1,) * K, r * starts + i, group=g) for g in range(len(STRATEGIES)) for r in range(runs) for i in range(starts)]
    found = subspace.best(subspace.fit(data, specs, LONG))
    of = lambda g, n: cluster.aligned(subspace.assign(data, [found[f"{g}|{r}"] for r in range(n)]), K)
    every = [g for g in range(len(STRATEGIES)) if f"{g}|0" in found]
    tag = lambda g: F.lit(STRATEGIES[g]).alias("variant")
    single = [of(g, 1).select(tag(g), "entity", "label") for g in every]
    whole = [cluster.consensus(of(g, runs)).select(tag(g), "entity", "label") for g in every]
    return cluster.pairwise_agreement(reduce(DataFrame.unionByName, single), reduce(DataFrame.unionByName, whole))


def pca_conditions(s, d):
    """profile, condition, pc1, pc2, share1, share2: conditions as observations, modules as features; scores on two components, of mean responses and of shares of detections in percent."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    lab = labels(contrasts(s, d))
    profiles = {"mean": (matrix.profile_mean(z(s, d), lab), "mean"), "percent": (matrix.profile_pct(cells(s, d), hits(s, d)), "pct_of_all")}
    out = []
    for name, (p, value) in profiles.items():
        t = p.groupBy("condition").pivot("module", list(range(K))).agg(F.first(value)).fillna(0.0)
        t = t.select("condition", array_to_vector(F.array(*[F.col(f"`{i}`") for i in range(K)])).alias("raw"))
        t = StandardScaler(inputCol="raw", outputCol="v", withMean=True, withStd=False).fit(t).transform(t)
        model = PCA(k=2, inputCol="v", outputCol="pc").fit(t)
        share = [float(x) for x in model.explainedVariance]
        t = model.transform(t).select("condition", vector_to_array("pc").alias("pc"))
        out.append(t.select(F.lit(name).alias("profile"), "condition", F.col("pc")[0].alias("pc1"), F.col("pc")[1].alias("pc2"), F.lit(share[0]).alias("share1"), F.lit(share[1]).alias("share2")))
    return reduce(DataFrame.unionByName, out)


_RUNS = f"""WITH {CONTRAST_SQL}, {LABELS_SQL}, nums AS (SELECT range::INTEGER AS run FROM range({RUNS})),
runs AS (SELECT run, entity, module, CASE WHEN ('0x' || substr(md5(run || ':' || entity), 1, 8))::UBIGINT % 10 < 2 THEN (('0x' || substr(md5('x:' || run || ':' || entity), 1, 8))::UBIGINT % {K})::INTEGER ELSE (module + run) % {K} END AS label FROM labels CROSS JOIN nums)"""
_ARI = """rs AS (SELECT {by} sum(t * (t - 1) / 2) AS A FROM (SELECT {by} la, sum(n) AS t FROM ct GROUP BY ALL) GROUP BY ALL), cs AS (SELECT {by} sum(t * (t - 1) / 2) AS B FROM (SELECT {by} lb, sum(n) AS t FROM ct GROUP BY ALL) GROUP BY ALL),
ss AS (SELECT {by} sum(n * (n - 1) / 2) AS S, sum(n) AS N FROM ct GROUP BY ALL), ar AS (SELECT {by} A, B, S, A * B / (N * (N - 1) / 2)::DOUBLE AS E {keep} FROM ss {join}), ari AS (SELECT {by} CASE WHEN (A + B) / 2 - E = 0 THEN 1 ELSE (S - E) / ((A + B) / 2 - E) END AS ari {keep} FROM ar)"""
_ALIGN = _RUNS + f""", ct0 AS (SELECT r.run, r.label, b.label AS ref, count(*) AS n FROM runs r JOIN runs b ON b.entity = r.entity AND b.run = 0 GROUP BY ALL),
p AS (SELECT a.range AS p0, b.range AS p1, c.range AS p2, d.range AS p3, e.range AS p4 FROM range(5) a, range(5) b, range(5) c, range(5) d, range(5) e WHERE len(list_distinct([a.range, b.range, c.range, d.range, e.range])) = 5),
sc AS (SELECT run, p0, p1, p2, p3, p4, sum(CASE WHEN ref = [p0, p1, p2, p3, p4][label + 1] THEN n ELSE 0 END) AS score FROM ct0 CROSS JOIN p GROUP BY ALL),
bp AS (SELECT run, [p0, p1, p2, p3, p4] AS m FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY score DESC, p0, p1, p2, p3, p4) AS rn FROM sc) WHERE rn = 1),
al AS (SELECT run, entity, m[label + 1]::INTEGER AS label FROM runs JOIN bp USING (run)),
vt AS (SELECT entity, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY entity) AS t FROM al GROUP BY entity, label),
cons AS (SELECT entity, label, n / t::DOUBLE AS strength FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, label) AS rn FROM vt) WHERE rn = 1)"""
_DIST = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_PTS = "pts AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label FROM embeddings)"
_CENTRE = "(SELECT label, list(v ORDER BY d) AS centre FROM (SELECT label, d, avg(v) AS v FROM (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) AS d FROM {src}) GROUP BY ALL) GROUP BY label)"
_NEAR = "(SELECT id, x, label, dist FROM (SELECT p.id, p.x, c.label, " + _DIST.format(a="p.x", b="c.centre") + " AS dist, row_number() OVER (PARTITION BY p.id ORDER BY " + _DIST.format(a="p.x", b="c.centre") + ", c.label) AS rn FROM pts p CROSS JOIN {c} c) WHERE rn = 1)"

_LP = "list_transform([0, 1, 2], lambda j: ln(w[j + 1]) - dims / 2.0 * ln(2 * pi() * s[j + 1]) - list_sum(list_transform(range(1, dims + 1), lambda i: (x[i] - c[j + 1][i]) ^ 2)) / (2 * s[j + 1]))"


def _em_sql(steps: int = 2) -> str:
    """EM of three points: responsibilities, then weights, means and mean squared distances a dimension."""
    parts = ["pts AS MATERIALIZED (SELECT entity, list(z ORDER BY condition) AS x, count(*) AS dims FROM z GROUP BY entity)", "m0 AS (SELECT [1 / 3.0::DOUBLE, 1 / 3.0::DOUBLE, 1 / 3.0::DOUBLE] AS w, [1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE] AS s, list(x ORDER BY entity) AS c FROM (SELECT * FROM pts ORDER BY entity LIMIT 3))"]
    for k in range(steps + 1):
        parts.append(f"l{k} AS MATERIALIZED (SELECT entity, x, dims, {_LP} AS lp FROM pts CROSS JOIN m{k})")
        parts.append(f"r{k} AS MATERIALIZED (SELECT *, list_transform(lp, lambda v: exp(v - top - ln(total))) AS r FROM (SELECT *, list_sum(list_transform(lp, lambda v: exp(v - top))) AS total FROM (SELECT *, list_max(lp) AS top FROM l{k})))")
        parts.append(f"f{k} AS (SELECT sum(top + ln(total)) AS ll, -sum(list_sum(list_transform(r, lambda v: v * ln(greatest(v, 1e-300))))) AS entropy, count(*) AS n, any_value(dims) AS dims FROM r{k})")
        if k < steps:
            parts.append(f"e{k} AS (SELECT j, i, sum(r[j]) AS w, sum(r[j] * x[i]) / sum(r[j]) AS c, sum(r[j] * x[i] * x[i]) / sum(r[j]) AS q FROM r{k}, range(1, 4) a(j), range(1, 1 + (SELECT max(dims) FROM pts)) b(i) GROUP BY j, i)")
            parts.append(f"m{k + 1} AS (SELECT list(w / t ORDER BY j) AS w, list(s ORDER BY j) AS s, list(c ORDER BY j) AS c FROM (SELECT j, any_value(w) AS w, avg(q - c * c) AS s, list(c ORDER BY i) AS c, sum(any_value(w)) OVER () AS t FROM e{k} GROUP BY j))")
    rows = " UNION ALL ".join(f"SELECT {k} AS step, j::INTEGER AS component, w[j + 1] AS weight, s[j + 1] AS noise, list_sum(list_transform(c[j + 1], lambda v: v * v)) AS centre_sq, ll, entropy, n, dims FROM m{k}, f{k}, range(3) a(j)" for k in range(steps + 1))
    return f"{_Z}, {', '.join(parts)}, every AS ({rows}) SELECT step, component, round(weight, 4) AS weight, round(noise, 4) AS noise, round(centre_sq, 4) AS centre_sq, round(ll, 4) AS log_likelihood, round(3 * (dims + 1) * ln(n) - 2 * ll, 4) AS bic, round(3 * (dims + 1) * ln(n) - 2 * ll + 2 * entropy, 4) AS icl FROM every"


_EM = _em_sql()

QUERIES = {
    "ari_runs": (
        lambda s, d: rounded(resample.stability(runs(s, d))),
        f"{_RUNS}, ct AS (SELECT a.run AS run_a, b.run AS run_b, a.label AS la, b.label AS lb, count(*) AS n FROM runs a JOIN runs b ON a.entity = b.entity AND a.run < b.run GROUP BY ALL), " + _ARI.format(by="run_a, run_b,", keep=", N", join="JOIN rs USING (run_a, run_b) JOIN cs USING (run_a, run_b)") + " SELECT run_a, run_b, round(ari, 6) AS ari, N::BIGINT AS shared FROM ari",
    ),
    "align_labels": (lambda s, d: aligned(s, d), f"{_ALIGN} SELECT run, entity, label FROM al"),
    "consensus_vote": (lambda s, d: rounded(cluster.consensus(aligned(s, d))), f"{_ALIGN} SELECT entity, label, round(strength, 6) AS strength FROM cons"),
    "run_vs_consensus": (
        lambda s, d: rounded(cluster.agreement(aligned(s, d), cluster.consensus(aligned(s, d)).select("entity", "label"), ["run"])),
        f"{_ALIGN}, ct AS (SELECT a.run, a.label AS la, b.label AS lb, count(*) AS n FROM al a JOIN cons b USING (entity) GROUP BY ALL), " + _ARI.format(by="run,", keep="", join="JOIN rs USING (run) JOIN cs USING (run)") + " SELECT run, round(ari, 6) AS ari FROM ari",
    ),
    "strength_by_module": (
        lambda s, d: rounded(cluster.strength_by_module(cluster.consensus(aligned(s, d)))),
        f"{_ALIGN} SELECT label, count(*) AS entities, round(avg(strength), 6) AS mean, round(quantile_cont(strength, 0.5), 6) AS median, round(100.0 * avg((strength >= 0.8)::INT), 6) AS pct_core, round(100.0 * avg((strength < 0.5)::INT), 6) AS pct_ambiguous FROM cons GROUP BY label",
    ),
    "run_size_variance": (
        lambda s, d: rounded(cluster.size_variation(aligned(s, d))),
        f"{_ALIGN}, z AS (SELECT run, label, count(*) AS n FROM al GROUP BY ALL) SELECT label, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS sd, min(n) AS least, max(n) AS most, round(stddev_pop(n) / avg(n), 6) AS cv FROM z GROUP BY label",
    ),
    "overlap_matrix_jaccard": (
        lambda s, d: rounded(cluster.overlap_matrix(cluster.consensus(aligned(s, d)).select("entity", "label"), base_labels(s, d))),
        f"{_ALIGN}, ct AS (SELECT c.label AS la, l.module AS lb, count(*) AS n FROM cons c JOIN labels l USING (entity) GROUP BY ALL) SELECT la, lb, n, round(n / ((SELECT count(*) FROM cons WHERE label = la) + (SELECT count(*) FROM labels WHERE module = lb) - n)::DOUBLE, 6) AS jaccard FROM ct",
    ),
    "cross_resolution_sets": (
        lambda s, d: cluster.robust(runs(s, d).where("run = 1"), runs(s, d).where("run = 2"), ["entity", "label"]),
        f"{_RUNS}, a AS (SELECT entity, label FROM runs WHERE run = 1), b AS (SELECT entity, label FROM runs WHERE run = 2) SELECT *, 'both' AS found_in FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT *, 'first' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'second' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)",
    ),
    "nearest_centroid": (
        lambda s, d: rounded(cluster.nearest(vectors(s, d), cluster.centroids(vectors(s, d), "label")).select("id", "label", "distance")),
        f"WITH {_PTS}, n AS {_NEAR.format(c=_CENTRE.format(src='pts'))} SELECT id, label, round(dist, 6) AS distance FROM n",
    ),
    "kmeans_lloyd_steps": (
        lambda s, d: rounded(cluster.lloyd(vectors(s, d), 4, 2).select("id", "label", "distance")),
        f"WITH {_PTS}, c0 AS (SELECT (row_number() OVER (ORDER BY id) - 1)::INTEGER AS label, x AS centre FROM (SELECT id, x FROM pts ORDER BY id LIMIT 4)), n0 AS {_NEAR.format(c='c0')}, n1 AS {_NEAR.format(c=_CENTRE.format(src='n0'))}, n2 AS {_NEAR.format(c=_CENTRE.format(src='n1'))} SELECT id, label, round(dist, 6) AS distance FROM n2",
    ),
    "subspace_mixture": (mixture, None),
    "subspace_consensus": (mixture_consensus, None),
    "model_selection": (model_selection, None),
    "heterogeneous_dimensions": (heterogeneous, None),
    "bootstrap_stability": (bootstrap_stability, None),
    "condition_jackknife": (jackknife, None),
    "likelihood_permutation": (likelihood_permutation, None),
    "subsample_stability": (subsample_stability, None),
    "em_configurations": (em_configurations, None),
    "em_steps": (em_steps, _EM),
    "kmeans_baseline": (kmeans_baseline, None),
    "baseline_checks": (baseline_checks, None),
    "cross_strategy_ari": (cross_strategy, None),
    "pca_conditions": (pca_conditions, None),
}
