"""Conservation laws of the detection operators on inline rows, branches the driver tables lack included."""

import pytest
from pyspark.sql import functions as F

from kontra.operators import detect, integrity, matrix


@pytest.fixture(scope="module")
def contrast(spark):
    rows = []
    for e in range(60):
        for i in range(10):
            fdr = 0.01 if e < 5 or (e * 7 + i * 3) % 11 == 0 else 0.5
            if e == 59:
                fdr = 0.9
            rows.append((e, f"c{i}", i + 1, (-1.0) ** (e + i) * (e + 1) / 10, 1.0, 1.0, fdr, fdr))
    return spark.createDataFrame(rows, "entity bigint, condition string, ord int, effect double, mean_level double, stat double, p_value double, fdr double").cache()


NAMES = [f"c{i}" for i in range(10)]


def test_patterns_conserve_entities(contrast):
    hits = detect.detected(contrast)
    p = detect.exact_patterns(hits, NAMES).collect()
    assert sum(r.gene_count for r in p) == hits.select("entity").distinct().count()
    assert any(r.degree == 10 and r.intersection == " & ".join(NAMES) and r.gene_count == 5 for r in p)
    assert all(r.degree == len(r.intersection.split(" & ")) for r in p)


def test_unique_and_shared_are_all(contrast):
    hits = detect.detected(contrast)
    counts = {r.condition: r.detected for r in detect.deg_counts(contrast).collect()}
    for r in detect.unique_shared(hits).collect():
        assert r.exclusive + r.shared == r.total == counts[r.condition]


def test_sensitivity_and_classes(contrast):
    t = {r.threshold: r for r in detect.sensitivity(contrast, [0.005, 0.05, 1.0]).collect()}
    assert t[0.005].union_size == 0 and t[0.05].all_conditions == 5 and t[1.0].all_conditions == 60
    kinds = {r.category for r in detect.evidence(contrast).select("category").distinct().collect()}
    assert kinds >= {"none", "all"}
    for bad in (0, -1, 1.5):
        with pytest.raises(ValueError):
            detect.detected(contrast, bad)


def test_pairs_and_cells(contrast):
    hits = detect.detected(contrast)
    pairs = detect.pairwise_overlap(contrast, hits).collect()
    assert len(pairs) == 45 and all(0 <= r.q <= 1 and r.q >= r.p_raw - 1e-12 for r in pairs)
    labels = hits.select("entity").distinct().withColumn("module", (F.col("entity") % 5).cast("int")).withColumn("strength", F.lit(0.8))
    cells = detect.module_cells(hits, labels, contrast)
    t = detect.module_preference(cells).collect()
    assert len(t) == 50 and len({(r.condition, r.module) for r in t}) == 50
    for c in NAMES:
        assert sum(r.observed for r in t if r.condition == c) == pytest.approx(sum(r.expected for r in t if r.condition == c))
    con = detect.contributions(contrast, hits, labels).collect()
    assert len({(r.condition, r.module) for r in con}) == len(con) == 50
    assert all(r.core == r.module_entities and r.up + r.down == r.detected for r in con)


def test_contributions_are_of_the_whole_module(spark):
    rows = [(1, "a", 2.0, 0.01), (2, "a", -1.0, 0.9), (3, "a", 6.0, 0.5), (1, "b", 1.0, 0.5), (2, "b", 1.0, 0.01)]
    t = spark.createDataFrame(rows, "entity long, condition string, effect double, fdr double")
    labels = spark.createDataFrame([(1, 0, 0.9), (2, 0, 0.5), (3, 0, 0.8), (4, 0, 0.2)], "entity long, module int, strength double")
    got = {r.condition: r for r in detect.contributions(t, t.where("fdr < 0.05"), labels).collect()}
    a, b = got["a"], got["b"]
    assert (a.module_entities, a.detected, a.up, a.core, b.module_entities, b.detected) == (4, 1, 1, 2, 4, 1)
    assert (a.mean_effect, a.median_effect, a.mean_strength) == (pytest.approx(7 / 3), 2.0, pytest.approx(0.6))
    assert b.mean_effect == 1.0 and a.pct_module_detected == 25.0


def test_diagnostics_are_of_the_selected_entities(spark):
    rows = [(1, "a", 2.0, 0.01), (2, "a", 1.0, 0.02), (3, "a", 9.0, 0.5), (1, "b", 0.0, 0.5), (2, "b", 5.0, 0.5), (3, "b", 4.0, 0.01)]
    t = spark.createDataFrame(rows, "entity long, condition string, effect double, fdr double")
    got = {r.condition: (r.entities, r.forced_zero, r.nonzero_forced, r.zero_tie) for r in matrix.mask_diagnostics(t, 0.05, 1).collect()}
    assert got == {"a": (2, 0.5, 1, 1), "b": (2, 0.5, 0, 1)}


def test_undetected_entities_are_a_pattern(contrast):
    hits = detect.detected(contrast)
    every = {r.intersection: r.gene_count for r in detect.exact_patterns(hits, NAMES, contrast).collect()}
    some = {r.intersection: r.gene_count for r in detect.exact_patterns(hits, NAMES).collect()}
    assert sum(every.values()) == contrast.select("entity").distinct().count()
    assert {k: v for k, v in every.items() if k != "none"} == some


def test_integrity(spark, contrast):
    assert all(r.ok for r in integrity.report(contrast).collect())
    integrity.require_same_universe(contrast, 10)
    broken = contrast.where("not (entity = 3 and condition = 'c4')")
    with pytest.raises(ValueError):
        integrity.require_same_universe(broken, 10)
    assert {r.condition: r.incomplete for r in integrity.universe(broken, 10).collect()}["c1"] == 1
    bad = contrast.withColumn("effect", F.when(F.col("entity") == 1, float("nan")).otherwise(F.col("effect")))
    assert all(not r.ok and r.not_finite == 1 for r in integrity.report(bad).collect())
    with pytest.raises(ValueError):
        integrity.check_schema(contrast.drop("fdr"))
    with pytest.raises(ValueError):
        integrity.check_schema(contrast, strict=True)


def test_manifest_and_digest_gate(spark, tmp_path):
    import gzip
    import hashlib

    p = tmp_path / "a.txt.gz"
    p.write_bytes(gzip.compress(b"x\ny\n", mtime=0))
    sha = hashlib.sha256(p.read_bytes()).hexdigest()
    assert integrity.manifest(spark, str(p)).first().sha256 == sha
    assert integrity.require_digest(spark, str(p), sha).count() == 2
    with pytest.raises(ValueError):
        integrity.require_digest(spark, str(p), "0" * 64)
