"""The pipeline stage by stage against brute force on a planted corpus."""

import random
import re

import pytest
import test_decontaminate
import test_line_dedup
import test_ngram_join

import corpus_pipeline
from kontra.llm.quality import quality

NAMES = ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    vocab = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8))) for _ in range(500)]
    text = lambda n: "\n".join(" ".join(r.choice(vocab) for _ in range(r.randint(6, 30))) for _ in range(n))
    docs, labels, items = [], [], [(i, " ".join(r.choice(vocab) for _ in range(r.randint(14, 59)))) for i in range(10)]
    for i in range(300):
        t, good = text(r.randint(1, 8)), 1
        if i % 9 == 0:
            t, good = " ".join(w + "$$$" for w in t.split()), 0
        elif i % 9 == 1 and i > 9:
            w = re.split("( |\n)", docs[-3][1])
            w[0] = "changed"
            t = "".join(w) + "\n" + text(1)
        elif i % 9 == 2:
            t += "\n" + items[i % 10][1]
        elif i % 9 == 3 and i > 9:
            t = docs[i - 6][1]
        elif i % 9 == 4 and i > 9:
            t = " ".join(docs[i - 6][1].split())
        docs.append((i, t, "en", f"src{i % 3}", len(t)))
        labels.append((i, good, 0))
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), items


def test_stages(spark, folder):
    sf, items = folder
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows, sizes = docs.columns, {}, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        before = {r.doc_id: r.text for r in docs.collect()}
        if name == "source_mixing":
            taken = {r.doc_id: (r.size, r.taken) for r in out.collect()}
            assert set(taken) == set(before) and all(t in (0, n, 2 * n) for n, t in taken.values())
            break
        assert out.columns == columns
        out.write.parquet(f"{sf}/stage{k}")
        docs = spark.read.parquet(f"{sf}/stage{k}")
        rows = {r.doc_id: r.text for r in docs.collect()}
        assert docs.count() == len(rows)
        if name == "quality_classifier":
            want = {r.doc_id for r in quality(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.predicted}
            assert set(rows) == want and len(want) < len(before)
        elif name == "line_dedup":
            kept = {d: t for d, t in test_line_dedup.brute(sorted(before.items())) if t is not None and (t.strip() or not before[d].strip())}
            assert rows == kept
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        elif name == "ngram_jaccard_join":
            assert set(rows) == {c for _, c, _ in test_ngram_join.brute(sorted(before.items()))}
        else:
            bad = {d for d, *_ in test_decontaminate.brute(sorted(before.items()), items)}
            assert bad and set(rows) == set(before) - bad
        sizes.append(len(rows))
    assert all(b < a for a, b in zip(sizes, sizes[1:], strict=False))


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder[0])
    assert {"doc_id", "size", "source_size", "target", "taken"} <= set(got.columns) and got.count() > 0


@pytest.mark.parametrize("keep", [True, False])
def test_nulls_repeats_and_clashing_columns(spark, folder, tmp_path, keep):
    """Each stage by itself, on rows that the planted corpus lacks and on an empty table."""
    sf, items = folder
    long = "\n".join("line %d of a very long text with words" % k for k in range(5000))
    rows = [(None, None, None, None, None, 1), (None, "some words here", "en", None, 3, 2), (7, None, "en", "a", 0, 3), (8, "", "en", "a", 0, 4), (9, long, "en", "b", len(long), 5), (10, "one two three four five six", "en", "a", 27, 6), (10, "one two three four five six", "en", "a", 27, 6), (11, items[0][1], "en", "a", 9, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, units int")
    docs = docs.withColumnRenamed("units", "row_uid") if keep else docs.limit(0).withColumnRenamed("units", "c1")
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        got[name] = out.collect()
        if name != "source_mixing":
            assert out.columns == docs.columns
    if not keep:
        assert not any(got.values())
        return
    ids = lambda name: sorted((r.doc_id or 0, r.text or "") for r in got[name])
    every = sorted((r[0] or 0, r[1] or "") for r in rows)
    want = [(d, n) for d, n, p in ((r.doc_id, r.text, r.predicted) for r in quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()) if p]
    assert {x for x in ids("quality_classifier") if x[0]} == {(d, t or "") for d, t in want}
    # of the repeated row's lines one is left, so the second row, then empty, goes; blank and null texts stay
    assert ids("line_dedup") == sorted({*every})
    assert ids("ngram_jaccard_join") == sorted({*every})
    assert ids("benchmark_decontamination") == sorted(x for x in every if x[0] != 11)
    assert sorted((r.doc_id or 0, r.size) for r in got["source_mixing"]) == sorted((d, len(t.split())) for d, t in every)


def test_whole_texts_go_to_python_once_and_in_small_batches(spark, folder):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, 10000)
        docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
        out = corpus_pipeline.STAGES[0][1](spark, docs, str(folder[0]))
        assert int(spark.conf.get(key)) <= 2048
        sent = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Project" in x][-1]
        assert len(re.findall(r"text#\d+ AS", sent)) == 1
        spark.conf.set(key, 64)
        corpus_pipeline.STAGES[4][1](spark, docs, str(folder[0]))
        assert spark.conf.get(key) == "64"
    finally:
        spark.conf.set(key, before)
