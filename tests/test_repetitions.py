"""The resampling and sweep queries run as many repetitions as the reference."""

import numpy as np

from kontra.operators import resample, subspace
from kontra.plans import clustering, registry


class Asked(Exception):
    pass


def asked(monkeypatch, query, spark):
    """(specs, most passes) of a query's first fit."""
    got = []

    def fit(rows, specs, max_iter=40, *a, **more):
        got.append((specs, max_iter))
        raise Asked

    monkeypatch.setattr(subspace, "fit", fit)
    try:
        registry.queries()[query](spark, "/root/testdata/sf0.001")
    except Asked:
        pass
    return got[0]


def test_likelihood_permutation(spark, monkeypatch):
    specs, passes = asked(monkeypatch, "likelihood_permutation", spark)
    assert passes == 100
    assert {g: sum(s.group == g for s in specs) for g in range(31)} == dict.fromkeys(range(31), 10) and len(specs) == 310


def test_full_counts_are_registered():
    sql = registry.oracle_sql()
    for name, n in (("empirical_p_pairs_full", 100), ("bootstrap_ci_full", 200), ("attr_permutation_full", 10_000)):
        assert f"range({n})" in sql[name]


def test_sweeps(spark, monkeypatch):
    specs, passes = asked(monkeypatch, "model_selection", spark)
    assert passes == 100 and {len(s.latent) for s in specs} == set(range(2, 26)) and len(specs) == 24 * 2 * 10
    specs, passes = asked(monkeypatch, "bootstrap_stability", spark)
    assert passes == 100 and {len(s.latent) for s in specs} == set(range(3, 16)) and len(specs) == 13 * (10 + 15 * 5)
    specs, passes = asked(monkeypatch, "subspace_consensus", spark)
    assert passes == 100 and len({s.name for s in specs}) == 30 and len(specs) == 30 * 20
    specs, passes = asked(monkeypatch, "condition_jackknife", spark)
    assert passes == 100 and len(specs) == 11 * 10 * 15


def test_comparisons(spark, monkeypatch):
    specs, passes = asked(monkeypatch, "em_configurations", spark)
    assert passes == 150 and len(specs) == 5 * (20 + 50 + 20) and sum(s.heat != (1.0,) for s in specs) == 100 and len({(s.name, s.seed) for s in specs}) == len(specs)
    specs, passes = asked(monkeypatch, "heterogeneous_dimensions", spark)
    assert passes == 150 and {(1,) * 6, (2, 1, 1, 1, 1, 1), (2, 1, 1, 1, 1)} < {s.latent for s in specs} and len(specs) == 6 * 15
    specs, passes = asked(monkeypatch, "kmeans_baseline", spark)
    assert all(s.hard for s in specs) and len(specs) == 16 * 10
    specs, passes = asked(monkeypatch, "cross_strategy_ari", spark)
    assert len(specs) == 3 * 30 * 20 and {s.group for s in specs} == {0, 1, 2}
    specs, passes = asked(monkeypatch, "subspace_mixture", spark)
    assert passes == 100 and {s.name for s in specs} == {"lines"}


def test_the_best_start_is_returned(spark, monkeypatch):
    kept, fit = [], subspace.fit
    monkeypatch.setattr(subspace, "fit", lambda *a: kept.extend(fit(*a)) or kept)
    given = []
    monkeypatch.setattr(subspace, "assign", lambda rows, models: given.extend(models) or rows.withColumnRenamed("id", "entity").withColumn("label", rows.grp))
    clustering.mixture(spark, "/root/testdata/sf0.001")
    assert len(kept) == clustering.RUNS and given == [max(kept, key=lambda m: m.log_likelihood)]


def test_subsamples_are_refitted(spark, monkeypatch):
    fit, sizes = subspace.fit, []

    def short(rows, specs, max_iter):
        sizes.extend(r["count"] for r in rows.groupBy("grp").count().collect())
        return fit(rows, [x for x in specs if x.group < 3 and x.seed == 0], 2)

    monkeypatch.setattr(subspace, "fit", short)
    got = registry.queries()["subsample_stability"](spark, "/root/testdata/sf0.001").collect()
    assert len(sizes) == clustering.RUNS and len(set(sizes)) == 1
    assert len(got) == 3 and all(-1 <= r.ari <= 1 and r.shared < sizes[0] for r in got)


def test_shuffled_vectors_are_permutations_of_each_column(spark, monkeypatch):
    """Every column of every repetition keeps its values and moves on its own, whole blocks and a rest; ids stay."""
    for n in (1, 2, 5, 1000, 1025):
        assert sorted(resample.permuted(np.arange(n), n, 7)) == list(range(n))
    monkeypatch.setattr(resample, "PLACES", 64)
    x = np.random.default_rng(4).normal(size=(300, 3))
    rows = spark.createDataFrame([(7 * i, v.tolist()) for i, v in enumerate(x)], "id bigint, x array<double>").repartition(3)
    got = resample.shuffled_vectors(rows, 2).collect()
    assert len(got) == 600
    for rep in (1, 2):
        mine = sorted((r for r in got if r.grp == rep), key=lambda r: r.id)
        assert [r.id for r in mine] == [7 * i for i in range(300)]
        y = np.array([r.x for r in mine])
        assert np.array_equal(np.sort(y, 0), np.sort(x, 0)) and all((y[:, d] == x[:, d]).mean() < 0.05 for d in range(3))
        assert abs(np.corrcoef(y.T)[np.triu_indices(3, 1)]).max() < 0.25
    assert [r.x for r in sorted(got, key=lambda r: (r.id, r.grp))][0] != [r.x for r in sorted(got, key=lambda r: (r.id, r.grp))][1]
    assert resample.shuffled_vectors(rows.limit(0), 2).count() == 0
