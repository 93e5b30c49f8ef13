"""Alignment, consensus, resampling and the subspace mixture on planted data."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kontra.operators import cluster, resample, subspace
from kontra.operators.subspace import Spec


def test_best_assignment_is_the_best():
    r = random.Random(0)
    for k in (1, 2, 5):
        w = [[r.randint(0, 5) for _ in range(k)] for _ in range(k)]
        score = lambda p: sum(w[i][p[i]] for i in range(k))
        perms = list(itertools.permutations(range(k)))
        top = max(map(score, perms))
        assert cluster.best_assignment(w) == list(min(p for p in perms if score(p) == top))


def test_consensus_ties_and_alignment(spark):
    rows = [(run, e, ((e % 3) + run) % 3) for run in range(4) for e in range(30)]
    runs = spark.createDataFrame(rows, "run int, entity bigint, label int")
    got = {r.entity: (r.label, r.strength) for r in cluster.consensus(cluster.aligned(runs, 3)).collect()}
    assert got == {e: (e % 3, 1.0) for e in range(30)}
    tie = spark.createDataFrame([(0, 1, 2), (1, 1, 0)], "run int, entity bigint, label int")
    r = cluster.consensus(tie).first()
    assert (r.label, r.strength) == (0, 0.5)
    with pytest.raises(ValueError):
        cluster.aligned(runs, 11)


def test_resampling_properties(spark):
    labels = spark.createDataFrame([(e, e % 4) for e in range(40)], "entity bigint, module int")
    reps = resample.repetitions(spark, 3)
    sh = resample.shuffled_labels(labels, reps)
    sizes = sh.groupBy("rep", "module").count().collect()
    assert len(sizes) == 12 and all(r["count"] == 10 for r in sizes)
    assert [r.c for r in resample.draws(labels, reps).groupBy("rep").agg(F.sum("copies").alias("c")).collect()] == [40] * 3
    sub = resample.subsamples(labels, reps, 0.8).groupBy("rep").count().collect()
    assert [r["count"] for r in sub] == [32] * 3
    with pytest.raises(ValueError):
        resample.subsamples(labels, reps, 0.2)
    runs = sh.select(F.col("rep").alias("run"), "entity", F.col("module").alias("label"))
    agreed = {(r.run_a, r.run_b): r.ari for r in resample.stability(runs).collect()}
    assert set(agreed) == {(0, 1), (0, 2), (1, 2)} and all(abs(a) < 0.3 for a in agreed.values())
    same = runs.where("run = 0").unionByName(runs.where("run = 0").withColumn("run", F.lit(1)))
    assert resample.stability(same).first().ari == 1.0
    m = spark.createDataFrame([(e, c, float(e)) for e in range(10) for c in "ab"], "entity bigint, condition string, v double")
    mixed = resample.shuffled_columns(m, reps, "v")
    assert mixed.count() == 60 and {r.s for r in mixed.groupBy("rep", "condition").agg(F.sum("v").alias("s")).collect()} == {45.0}


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    truth, rows = [], []
    for j in range(3):
        centre, axis = rng.normal(size=6) * 6, rng.normal(size=6)
        axis /= np.linalg.norm(axis)
        for _ in range(150):
            x = centre + axis * rng.normal() * 3 + rng.normal(size=6) * 0.2
            truth.append((len(rows), j))
            rows.append((len(rows), 0, [float(v) for v in x]))
    return spark.createDataFrame(rows, "id bigint, grp int, x array<double>"), spark.createDataFrame(truth, "entity bigint, label int")


def test_mixture_finds_planted_lines(spark, planted):
    rows, truth = planted
    models = subspace.fit(rows, [Spec("lines", (1, 1, 1), s) for s in range(4)] + [Spec("points", (0, 0, 0), s) for s in range(4)], 40, 1e-3)
    best = subspace.best(models)
    for m in models:
        assert all(b >= a - 1e-6 for a, b in zip(m.history, m.history[1:], strict=False))
    lines, points = best["lines"], best["points"]
    assert lines.parameters == 3 * 13 and points.parameters == 3 * 7
    assert lines.bic == pytest.approx(lines.parameters * np.log(450) - 2 * lines.log_likelihood)
    assert lines.bic < points.bic
    found = subspace.assign(rows, [lines]).select("entity", "label")
    assert cluster.agreement(found, truth).first().ari > 0.95
    boot = subspace.fit(rows, [Spec("b", (1, 1, 1), 1, resample=1)], 10)[0]
    assert abs(boot.rows - 450) < 90


def test_lloyd_reduces_distance(spark, planted):
    pts = planted[0].select("id", "x")
    d = [cluster.lloyd(pts, 3, n).agg(F.sum("distance")).first()[0] for n in (0, 1, 3)]
    assert d[0] >= d[1] >= d[2]


def test_passes_over_all_rows_reach_the_sample_fits_model(spark, planted):
    """With a sample below the rows, EM goes on in distributed passes and comes to the same models."""
    rows, truth = planted
    specs = [Spec("lines", (1, 1, 1), s) for s in range(4)]
    whole, passed = (subspace.best(subspace.fit(rows, specs, 60, 1e-4, sample_rows=n))["lines"] for n in (4000, 100))
    assert not passed.whole and whole.whole and len(passed.history) > 0
    assert passed.log_likelihood == pytest.approx(whole.log_likelihood, abs=0.05) and passed.rows == 450
    assert cluster.agreement(subspace.assign(rows, [passed]).select("entity", "label"), truth).first().ari > 0.95


def test_figures_belong_to_the_model_when_passes_run_out(spark, planted):
    rows, _ = planted
    for n in (100, 4000):
        m = subspace.fit(rows, [Spec("lines", (1, 1, 1), 2)], 2, 1e-9, sample_rows=n)[0]
        x = np.array([r.x for r in rows.collect()])
        lp = m.log_density(x)
        assert m.log_likelihood == pytest.approx(np.logaddexp.reduce(lp, axis=1).sum())


@pytest.mark.parametrize("sample_rows", [4000, 100])
def test_annealing(spark, planted, sample_rows):
    rows, truth = planted
    got = subspace.fit(rows, [Spec("a", (1, 1, 1), s, heat=subspace.ANNEALED) for s in range(3)], 60, 1e-3, sample_rows=sample_rows)
    m = subspace.best(got)["a"]
    assert all(x.beta == 1.0 for x in got)
    plain = subspace.best(subspace.fit(rows, [Spec("p", (1, 1, 1), s) for s in range(3)], 60, 1e-3))["p"]
    assert m.log_likelihood >= plain.log_likelihood - 1
    assert cluster.agreement(subspace.assign(rows, [m]).select("entity", "label"), truth).first().ari > 0.95
    with pytest.raises(ValueError):
        Spec("x", (1,), heat=(0.5,))


def test_softened_shares_are_powers_of_the_densities():
    lp = np.log(np.array([[0.6, 0.3, 0.1], [0.2, 0.2, 0.6]]))
    w = np.array([1.0, 2.0])
    r, ll, _, soft = subspace._shares(lp, w, 0.5)
    p = np.exp(lp) ** 0.5
    assert np.allclose(r, p / p.sum(1, keepdims=True) * w[:, None]) and ll == pytest.approx(0.0)
    assert soft == pytest.approx((w * np.log(p.sum(1)) / 0.5).sum())


def test_starts_that_meet_are_fitted_once(spark, planted, monkeypatch):
    rows, _ = planted
    sizes, real = [], subspace._pass
    monkeypatch.setattr(subspace, "_pass", lambda r, models, *a: sizes.append(len(models)) or real(r, models, *a))
    got = subspace.fit(rows, [Spec("lines", (1, 1, 1), 3) for _ in range(4)], 60, 1e-6, sample_rows=100)
    assert sizes[0] == 4 and sizes[1] == 1 and len({m.log_likelihood for m in got}) == 1 and len(got) == 4


@pytest.mark.parametrize("sample_rows", [4000, 100])
def test_kmeans_in_the_same_passes(spark, planted, sample_rows):
    rows, _ = planted
    specs = [Spec("means", (0, 0, 0), s, hard=True) for s in range(3)]
    m = subspace.best(subspace.fit(rows, specs, 60, 1e-9, sample_rows=sample_rows))["means"]
    x = np.array([r.x for r in rows.collect()])
    d = ((x[:, None] - m.mean) ** 2).sum(2)
    assert -2 * m.log_likelihood == pytest.approx(d.min(1).sum())
    for j in range(3):
        assert np.allclose(x[d.argmin(1) == j].mean(0), m.mean[j], atol=1e-6)
    label = {r.entity: r.label for r in subspace.assign(rows, [m]).collect()}
    assert [label[r.id] for r in rows.collect()] == d.argmin(1).tolist()


def test_bootstrap_protocol(spark, planted):
    rows, _ = planted
    asked = []

    def fit(resamples):
        asked.append(list(resamples))
        specs = [Spec(str(r), (1, 1, 1), s, resample=r) for r in resamples for s in range(3)]
        return {None if n == "None" else int(n): m for n, m in subspace.best(subspace.fit(rows, specs, 40)).items()}

    r = resample.bootstrap_ari(fit, lambda models: subspace.assign(rows, models), 3).first()
    assert asked == [[None, 0, 1, 2]] and r.n == 3 and r["mean"] > 0.9 and r.sd < 0.1


def test_two_passes_of_points(spark, planted):
    rows, _ = planted
    x = np.array([r.x for r in rows.collect()])
    none = np.zeros((6, 0))
    start = subspace.Model(Spec("p", (0, 0)), np.full(2, 0.5), x[:2].copy(), [none] * 2, [np.zeros(0)] * 2, np.ones(2))
    (a,), (b,) = subspace.steps(rows, [start], 1)
    lp = np.log(0.5) - 3 * np.log(2 * np.pi) - ((x[:, None] - x[:2]) ** 2).sum(2) / 2
    r = np.exp(lp - np.logaddexp.reduce(lp, axis=1)[:, None])
    mean = r.T @ x / r.sum(0)[:, None]
    assert a.log_likelihood == pytest.approx(np.logaddexp.reduce(lp, axis=1).sum()) and np.allclose(b.mean, mean) and np.allclose(b.weight, r.sum(0) / 450)
    noise = (r * ((x[:, None] - mean) ** 2).sum(2)).sum(0) / r.sum(0) / 6
    assert np.allclose(b.noise, noise) and b.log_likelihood > a.log_likelihood


def test_extrapolated_passes_reach_more_in_fewer(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 4)) + np.repeat([[0.0] * 4, [1.2] * 4], 300, 0)
    rows = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "id bigint, grp int, x array<double>")
    count, real = [], subspace._pass
    monkeypatch.setattr(subspace, "_pass", lambda *a: count.append(1) or real(*a))
    fitted = lambda: subspace.fit(rows, [Spec("points", (0, 0), 1)], 300, 1e-5, sample_rows=60)[0]
    fast, passes = fitted(), len(count)
    monkeypatch.setattr(subspace.Leap, "beyond", lambda *a: None)
    plain = fitted()
    assert passes < 0.75 * (len(count) - passes)
    assert fast.log_likelihood > plain.log_likelihood - 1e-3 and fast.history == sorted(fast.history)


def test_models_of_one_form_are_fitted_as_each_alone():
    rng = np.random.default_rng(6)
    x, ids = rng.standard_normal((1500, 5)) * [1, 2, 3, 1, 1], np.arange(1500)
    for more in ({}, {"dims": (0, 2, 3)}, {"hard": True}, {"heat": subspace.ANNEALED}):
        specs = [Spec("a", (1, 0, 2), s, resample=r, **more) for s in range(3) for r in (None, 1)]
        together = subspace.settled(specs, ids, x, False, 20, 1e-2)
        for spec, m in zip(specs, together, strict=True):
            (alone,) = subspace.settled([spec], ids, x, False, 20, 1e-2)
            assert m.spec == spec and np.allclose(m.history, alone.history, rtol=1e-9) and np.allclose(m.mean, alone.mean)


def test_consensus_of_labels_side_by_side(spark):
    """Labels of a row in one array give what runs, alignment, consensus and agreement give by joins."""
    r = random.Random(3)
    n, runs, k = 200, 4, 3
    labels = [[(e + g * r.randrange(2) + r.randrange(3) // 2 + run) % k for g in range(2) for run in range(runs)] for e in range(n)]
    wide = spark.createDataFrame(list(enumerate(labels)), "entity bigint, labels array<smallint>")
    got = {x.entity: x.labels for x in cluster.consensus_groups(wide, runs, k).collect()}
    each = []
    for g in range(2):
        long = spark.createDataFrame([(i, e, v[g * runs + i]) for e, v in enumerate(labels) for i in range(runs)], "run int, entity bigint, label int")
        each.append(cluster.consensus(cluster.aligned(long, k)).select("entity", "label"))
        assert {x.entity: x.label for x in each[g].collect()} == {e: v[g] for e, v in got.items()}
    cells = cluster.contingencies(cluster.consensus_groups(wide, runs, k), [0, 0]).where("run = 1")
    assert cluster.adjusted_rand(cells, [], "la", "lb").first().ari == pytest.approx(cluster.agreement(each[1], each[0]).first().ari)
    with pytest.raises(ValueError):
        cluster.consensus_groups(wide, runs, 11)


def test_labels_side_by_side_are_those_of_each_model(spark, planted):
    rows, _ = planted
    models = subspace.fit(rows, [Spec("a", (1, 1, 1), 0), Spec("b", (0, 1), 1, dims=(0, 2, 5)), Spec("c", (0, 0), 2, hard=True)], 20)
    long = {(x.run, x.entity): x.label for x in subspace.assign(rows, models).collect()}
    assert long == {(i, x.entity): v for x in subspace.assigned(rows, models).collect() for i, v in enumerate(x.labels)}


def test_passes_in_single_precision_keep_to_those_in_double():
    """Responsibilities of the passes are of single precision, sums over rows are not: far from the origin small variances stay right."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.standard_normal((3000, 4)) * 0.01 + c for c in ([100.0, 0, 0, 0], [100.1, 0, 0, 0])])
    c, phi = subspace._coefficients([subspace._start(Spec("a", (1, 0), 1), x)], 4), subspace.features(x)
    single, double = (subspace._expected(phi, c, 2, np.ones(len(x)), np.ones(1), False, entropy) for entropy in (False, True))
    assert np.allclose(single[0][:, [0, 1, 3]], double[0][:, [0, 1, 3]], rtol=1e-7) and single[1].dtype == np.float64
    covariance = [np.stack([(s[0, :, 0] / s[0, :, -1]) - (s[0, :, 10] / s[0, :, -1]) ** 2]) for _, s in (single, double)]
    assert np.allclose(*covariance, rtol=1e-3)


def test_passes_over_blocks_of_bytes(spark):
    """Rows as blocks give what numpy gives on all, in both precisions; k-means gets no second moments, and the M step's gain is no more than the likelihood's."""
    x = np.random.default_rng(9).normal(size=(700, 4))
    rows = subspace.packed(spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "id bigint, grp int, x array<double>"))
    specs = [Spec("a", (1, 0), 1), Spec("b", (1, 0), 2, group=1, resample=3), Spec("c", (0, 0), 3, hard=True)]
    models = [subspace._start(s, x) for s in specs]
    double, single = (list(subspace._sums(subspace._pass(rows, models, 4, False, 0, v), models, 4)) for v in (False, True))
    for m, (f, s), (f1, s1) in zip(models, double, single, strict=True):
        mine = np.arange(700)[m.spec.group :: 2]
        w = np.ones(350) if m.spec.resample is None else subspace._poisson(mine, 3)
        assert f[1] == w.sum() and np.allclose(f, f1, rtol=1e-5) and np.allclose(s, s1, rtol=1e-3, atol=1e-2)
        if m.spec.hard:
            d = ((x[mine][:, None] - m.mean) ** 2).sum(2)
            assert f[0] == pytest.approx(-d.min(1).sum() / 2) and not s[:, :10].any()
            assert np.allclose(s[:, 10:14], [x[mine][d.argmin(1) == j].sum(0) for j in range(2)])
        else:
            assert f[0] == pytest.approx((w * np.logaddexp.reduce(m.log_density(x[mine]), axis=1)).sum())
    sums = [s for _, s in double]
    moved = subspace._moved(models, sums, 4)
    after = [f[0] for f, _ in subspace._sums(subspace._pass(rows, moved, 4), moved, 4)]
    for gain, (f, _), g in zip(subspace._gains(models, moved, sums, 4), double, after, strict=True):
        assert 0 <= gain <= g - f[0] + 1e-9
