"""Closure, propagation and the enrichment family on a small ontology."""

import pytest

from kontra.operators import enrich
from kontra.sources import ontology


def edges(spark):
    return spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "root"), ("a", "c"), ("x", "root")], "child string, parent string")


def test_closure(spark):
    got = {(r.child, r.ancestor): r.depth for r in enrich.closure(edges(spark)).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 2, ("a", "root"): 3, ("b", "c"): 1, ("b", "root"): 2, ("c", "root"): 1, ("x", "root"): 1}
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string")
    with pytest.raises(ValueError):
        enrich.closure(loop, 6)


def test_family_and_skipped(spark):
    closed = enrich.closure(edges(spark))
    assoc = spark.createDataFrame([("n", e, "a" if e < 20 else "x") for e in range(100)], "namespace string, entity bigint, term string")
    full = enrich.propagated(assoc, closed)
    counts = {r.term: r["count"] for r in full.groupBy("term").count().collect()}
    assert counts == {"a": 20, "b": 20, "c": 20, "x": 80, "root": 100}
    studies = spark.createDataFrame([("s", e) for e in range(15)] + [("tiny", 1), ("tiny", 2)], "study string, entity bigint")
    people = spark.createDataFrame([(e,) for e in range(100)], "entity bigint")
    t = {r.term: r for r in enrich.family(studies, people, full).collect()}
    assert set(t) == {"a", "b", "c", "x", "root"} and all(r.study == "s" for r in t.values())
    assert t["a"].study_count == 15 and t["a"].enrichment == "e" and t["a"].q < 1e-6
    assert t["x"].study_count == 0 and t["x"].enrichment == "p" and t["root"].p_raw == pytest.approx(1)
    skip = enrich.skipped(studies, enrich.background(people, full)).collect()
    assert [(r.study, r.mapped) for r in skip] == [("tiny", 2)]
    top = enrich.top_terms(enrich.family(studies, people, full), ["study"], 3)
    near = {r.child: r.parent for r in enrich.nearest_ancestors(top, closed, enrich.depths(edges(spark), closed)).collect()}
    assert near == {"a": "b", "b": "c"}


def test_readers(spark, tmp_path):
    (tmp_path / "x.obo").write_text("format-version: 1.2\n\n[Term]\nid: T:1\nname: one\nnamespace: n\n\n[Term]\nid: T:2\nname: two\nnamespace: n\nis_a: T:1 ! one\n\n[Term]\nid: T:3\nname: gone\nnamespace: n\nis_obsolete: true\nis_a: T:1\n\n[Typedef]\nid: part_of\n")
    terms, up = ontology.read_obo(spark, str(tmp_path / "x.obo"))
    assert sorted((r.id, r.name) for r in terms.collect()) == [("T:1", "one"), ("T:2", "two")]
    assert [(r.child, r.parent) for r in up.collect()] == [("T:2", "T:1")]
    row = lambda e, q, t: "\t".join(["DB", e, "sym", q, t, "ref", "ev", "", "P", "", "", "", "", "", ""])
    (tmp_path / "y.gaf").write_text("!gaf-version: 2.2\n" + row("E1", "involved_in", "T:2") + "\n" + row("E2", "NOT|involved_in", "T:2") + "\n")
    assert [tuple(r) for r in ontology.read_gaf(spark, str(tmp_path / "y.gaf")).collect()] == [("E1", "T:2", "P")]
