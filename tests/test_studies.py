"""Studies, blocks, membership, request systems and record checks on inline rows."""

import pytest
from pyspark.sql import functions as F

from kontra.operators import cluster, enrich, requests, service

NAMES = ["1-URGENT", "BUILDING"]


def test_blocks_and_selection(spark):
    labels = spark.createDataFrame([(e, m) for e, m in enumerate([2, 0, 2, 0, 0, 5])], "entity int, module int")
    got = [tuple(r) for r in cluster.blocks(labels).orderBy("module").collect()]
    assert got == [(0, 0, 2, 1.5), (2, 3, 4, 4.0), (5, 5, 5, 5.5)]
    assert cluster.blocks(labels.limit(0)).count() == 0
    stability = spark.createDataFrame([(3, 0.5), (4, 0.6)], "k int, mean double")
    selection = spark.createDataFrame([(3, "lines", 1.0), (3, "points", 2.0), (4, "points", 3.0)], "k int, config string, bic double")
    assert sorted(map(tuple, cluster.with_selection(stability, selection, "lines").collect())) == [(3, 0.5, 1.0), (4, 0.6, None)]


def test_family_within_has_the_stratum_as_background(spark):
    full = spark.createDataFrame([("n", e, "t" if e % 4 else "u") for e in range(80)], "namespace string, entity int, term string")
    population = spark.createDataFrame([("M0" if e < 40 else "M1", e) for e in range(80)], "stratum string, entity int")
    studies = spark.createDataFrame([("c|M0", "M0", e) for e in range(12)] + [("c|M1", "M1", e) for e in range(40, 45)] + [("c|M0", "M0", 60)], "study string, stratum string, entity int")
    rows = {(r.study, r.term): r for r in enrich.family_within(studies, population, full).collect()}
    assert set(rows) == {("c|M0", "t"), ("c|M0", "u")}
    r = rows["c|M0", "t"]
    assert (r.study_n, r.study_count, r.pop_count, r.pop_n) == (12, 9, 30, 40)
    counts = enrich.study_counts(enrich.family_within(studies, population, full), studies).collect()
    assert sorted(map(tuple, counts)) == [("c", 0, 2), ("c", 1, 0)]


def test_membership_and_labels(spark):
    a = spark.createDataFrame([("Gene1", 0), ("Gene2", 1)], "id string, module int")
    s = spark.createDataFrame([("Gene1", 0.9)], "id string, strength double")
    assert sorted(map(tuple, service.membership(a, s, ["gENE1", "gene2", "gene3"]).collect())) == [("Gene1", 0, 0.9), ("Gene2", 1, None)]
    pairs = spark.createDataFrame([("1-URGENT-BUILDING",), ("A-B",), ("B-C",)], "pair string")
    assert service.labelled_pair(pairs, ["BUILDING", "1-URGENT"]).count() == 1
    assert service.labelled_pair(pairs, ["B", "A"]).count() == 1 and service.labelled_pair(pairs, ["A"]).count() == 0
    terms = spark.createDataFrame([("Glutathione transferase",), (None,), ("other",)], "term string")
    assert enrich.containing(terms, "term", "TRANSFERASE").count() == 1


def test_proposals(spark):
    asked = spark.createDataFrame([(0, "Summary of BUILDING detections"), (1, "short"), (2, "9-RUSH under BUILDING"), (3, "prove that BUILDING matters"), (4, "an unclear thing here"), (5, "module correlation of BUILDING")], "request_id int, question string")
    got = {r.request_id: r for r in requests.baseline(asked, NAMES).collect()}
    assert [got[i].status for i in range(6)] == ["accepted", "needs_clarification", "incompatible", "abstain", "needs_clarification", "abstain"]
    assert got[0].intent == service.SUMMARY and got[0].steps and not got[0].citations and got[1].intent == "unknown" and not got[1].steps
    want = spark.createDataFrame([(i, got[i].status, service.SUMMARY if i == 0 else None) for i in range(6)], "request_id int, expected_status string, expected_intent string")
    r = requests.evaluate(requests.baseline(asked, NAMES).withColumn("system", F.lit("rules")), want).first()
    assert (r.cases, r.status_rate, r.intent_rate, r.no_forbidden_claim, r.workflow_validity, r.groundedness) == (6, 1, 1, 1, 1, 0)
    claimed = requests.baseline(asked, NAMES).withColumn("system", F.lit("x")).withColumn("explanation", F.lit("It is the cause of all this"))
    assert requests.evaluate(claimed, want).first().no_forbidden_claim == 0


def test_record_checks(spark):
    good = spark.createDataFrame([("a", "one"), ("b", "two")], "label string, text string").withColumn("fingerprint", F.sha2(F.col("text"), 256))
    assert requests.require_valid(good, ["label", "text"]) is good
    bad = good.unionByName(good.withColumn("label", F.lit(None).cast("string"))).unionByName(good.limit(1).withColumn("text", F.lit("x")))
    assert {r.fault: r.n for r in requests.record_faults(bad, ["label"]).collect()} == {"missing value": 2, "wrong fingerprint": 1, "repeated fingerprint": 2}
    with pytest.raises(ValueError, match="fail their checks"):
        requests.require_valid(bad, ["label"])
    assert {r.n for r in requests.record_faults(good.limit(0), ["label"]).collect()} == {0}
    split = spark.createDataFrame([("g", "train"), ("g", "test"), ("h", "test")], "grp string, split string")
    with pytest.raises(ValueError, match="shared"):
        requests.require_separate(split, ["grp"])
    assert requests.require_separate(split.where("grp = 'h'"), ["grp"]).count() == 1
    with pytest.raises(ValueError, match="too few"):
        requests.require_groups(split, ["grp"])
