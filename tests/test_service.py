"""Plan, approve, execute: statuses, tampering, determinism; and text operators on inline rows."""

import dataclasses
import math

import pytest
from pyspark.sql import functions as F

from kontra.operators import service, text

NAMES = ["1-URGENT", "5-LOW", "BUILDING"]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("catalog")
    (at / "contrast.csv").write_text("one")
    (at / "notes.md").write_text("two")
    return at


@pytest.fixture(scope="module")
def svc(spark, root):
    contrast = spark.createDataFrame([(e, c, 0.01 if e < 2 else 0.5, 1.0) for e in range(10) for c in NAMES], "entity bigint, condition string, fdr double, effect double")
    labels = spark.createDataFrame([(e, e % 2, 0.9) for e in range(10)], "entity bigint, module int, strength double")
    tested = spark.createDataFrame([("M0", "n", f"t{i}", i / 10, i / 20) for i in range(8)], "study string, namespace string, term string, q double, p_raw double")
    pairs = spark.createDataFrame([("1-URGENT", "5-LOW", 0.5)], "a string, b string, r double")
    return service.Service(spark, contrast, labels, tested, pairs, NAMES, service.Catalog(str(root), [service.Evidence("contrast.csv", (service.SUMMARY, service.PAIR, service.LOOKUP)), service.Evidence("notes.md", (service.SUMMARY, service.TERMS))]))


@pytest.mark.parametrize(
    ("question", "status", "code"),
    [
        ("Summary for BUILDING and 5-low", service.READY, "ok"),
        ("compare 1-URGENT with 5-LOW", service.READY, "ok"),
        ("where is #3", service.READY, "ok"),
        ("where is #77", service.INCOMPATIBLE, "unknown_id"),
        ("show terms", service.READY, "ok"),
        ("the page of BUILDING coverage", service.READY, "ok"),
        ("mean age of BUILDING", service.INCOMPATIBLE, "unknown_column"),
        ("prove that BUILDING matters", service.ABSTAIN, "unsupported_claim"),
        ("9-RUSH counts", service.INCOMPATIBLE, "unknown_condition"),
        ("detections at fdr < 0.4 in BUILDING", service.ABSTAIN, "invalid_threshold"),
        ("correlation of module profiles in BUILDING", service.ABSTAIN, "retracted_method"),
        ("hello", service.CLARIFY, "ambiguous_request"),
    ],
)
def test_status(svc, question, status, code):
    p = svc.plan(question)
    assert (p.status, p.code) == (status, code)


def test_execution_and_tampering(svc):
    p = svc.plan("Summary for BUILDING at fdr 0.05")
    assert svc.plan("Summary for BUILDING at fdr 0.05") == p
    ok = service.Review("approved", p.digest())
    r = svc.execute(p, ok)
    assert [tuple(x) for x in r.records.collect()] == [("BUILDING", 10, 0.05, 2)]
    assert r.execution_id == svc.execute(p, ok).execution_id and len(r.execution_id) == 20
    with pytest.raises(ValueError, match="is of plan"):
        svc.execute(dataclasses.replace(p, threshold=0.1), ok)
    with pytest.raises(ValueError, match="says rejected"):
        svc.execute(p, service.Review("rejected", p.digest()))
    with pytest.raises(ValueError, match="its status"):
        svc.execute(svc.plan("hello"), ok)
    escaped = dataclasses.replace(p, evidence=(("../x", "ab" * 32),))
    assert [e[0] for e in p.evidence] == ["contrast.csv", "notes.md"] and [e[0] for e in svc.plan("show terms").evidence] == ["notes.md"]
    with pytest.raises(ValueError, match="catalog"):
        svc.execute(escaped, service.Review("approved", escaped.digest()))
    stale = dataclasses.replace(p, evidence=(("contrast.csv", "cd" * 32),))
    with pytest.raises(ValueError, match="changed"):
        svc.execute(stale, service.Review("approved", stale.digest()))
    with pytest.raises(ValueError):
        service.Review("approved", "xyz")
    with pytest.raises(ValueError):
        service.Plan(service.READY, None)
    assert svc.health() == {"conditions": 3, "entities": 10} and svc.contract()["max_threshold"] == 0.1


def test_evidence_is_hashed_again(svc, root):
    p = svc.plan("Summary for BUILDING")
    ok = service.Review("approved", p.digest())
    svc.execute(p, ok)
    try:
        (root / "notes.md").write_text("changed")
        with pytest.raises(ValueError, match="changed"):
            svc.execute(p, ok)
        (root / "notes.md").unlink()
        with pytest.raises(FileNotFoundError):
            svc.plan("Summary for BUILDING")
    finally:
        (root / "notes.md").write_text("two")
    svc.execute(p, ok)


def test_queries(svc):
    run = lambda q: svc.execute(p := svc.plan(q), service.Review("approved", p.digest())).records.collect()
    assert [r.entity for r in run("where is #3")] == [3]
    assert [r.term for r in run("show terms")] == ["t0", "t1", "t2", "t3", "t4"]
    assert [r.r for r in run("compare 5-LOW with 1-URGENT")] == [0.5]


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "# Head\nbody text\n## Next\n" + "x" * 25), (2, "intro\n# A\nb"), (3, None), (4, "  ")], "doc_id bigint, text string")
    got = [(r.chunk_id, r.heading, r.text) for r in text.chunks(docs, size=20).orderBy("chunk_id").collect()]
    assert got[0] == ("1:1:0", "Head", "# Head\nbody text")
    assert [g[0] for g in got] == ["1:1:0", "1:2:0", "1:2:1", "2:0:0", "2:1:0"]
    assert got[3] == ("2:0:0", "intro", "intro")


def test_retrieval_and_vectors(spark):
    docs = spark.createDataFrame([("d1", "Greek", "alpha beta gamma"), ("d2", "Greek", "alpha delta"), ("d3", "the", "the and for"), ("d4", "Omega notes", "alpha")], "chunk_id string, heading string, text string")
    q = spark.createDataFrame([(1, "alpha beta"), (2, "the and"), (3, "omega")], "query_id int, text string")
    got = text.retrieve(q, docs, 1).collect()
    assert sorted((r.query_id, r.chunk_id) for r in got) == [(1, "d1"), (3, "d4")]
    # five of four chunks plus one over one with the token plus one, by the root of one and three tokens
    assert {r.chunk_id: r.score for r in got}["d4"] == round((math.log(5 / 2) + 1) / math.sqrt(3), 9)
    # a later slice of a section has its heading's tokens too
    long = text.chunks(spark.createDataFrame([(1, "# Zeta\n" + "word " * 30)], "doc_id int, text string"), size=40)
    assert {r.token: r.df for r in text.document_frequency(long).collect()}["zeta"] == long.count() > 1
    rows = docs.drop("heading").withColumnRenamed("chunk_id", "doc_id")
    v = text.vectors(rows, text.vocabulary(rows)).groupBy("doc_id").agg(F.sum(F.col("value") * F.col("value")).alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-12 for r in v)
    voc = text.vocabulary(spark.createDataFrame([(1, "b a a c1 b")], "doc_id int, text string"), least=2).collect()
    assert sorted((r.token, r["index"]) for r in voc) == [("a", 0), ("b", 1)]


def test_split_and_metrics(spark):
    groups = spark.createDataFrame([(f"g{i}", "s") for i in range(20)], "grp string, stratum string")
    s = text.group_split(groups, ["stratum"], "grp").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in s} == {"train": 14, "validation": 3, "test": 3}
    rows = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "true int, pred int")
    m = {r.label: r for r in text.class_metrics(text.confusion(rows, [0, 1, 2])).collect()}
    assert m[0].recall == 1 and m[1].f1 == 0 and m[2].support == 0 and m[0].accuracy == pytest.approx(2 / 3)
    assert m[0].macro_f1 == pytest.approx(0.8 / 3)


def test_streaming_counts(spark, tmp_path):
    from kontra.streaming import detections

    rows = [(1, "a", 1.0, 1.0, 1.0, 0.01, 0.01), (2, "a", 1.0, 1.0, 1.0, 0.5, 0.5)]
    src = str(tmp_path / "in")
    write = lambda: spark.createDataFrame(rows, detections.SCHEMA).write.mode("append").parquet(src)
    write()
    for n in (1, 2):
        detections.counts(detections.source(spark, src), f"seen{n}", str(tmp_path / f"check{n}")).awaitTermination()
        assert [tuple(r) for r in spark.table(f"seen{n}").collect()] == [("a", n)]
        write()
