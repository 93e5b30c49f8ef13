"""Both classifiers: held-out accuracy on planted labels, folds, and defined edge cases."""

import random
import zlib

import numpy as np
import pytest

from kontra.llm.learn import segment_sum
from kontra.llm.quality import Factors, Machine, accepted, quality
from kontra.llm.toxicity import Grams, toxicity


def corpus(n=900):
    r = random.Random(2)
    vocab = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randint(5, 200))]
        bad, toxic = r.random() < 0.2, r.random() < 0.2
        if bad:
            w = [x + r.choice(["***", "$$$"]) for x in w] if r.random() < 0.5 else [x.upper() + "!!" for x in w]
        if toxic:
            w[r.randrange(len(w))] = r.choice(["grumbus", "Zaxxid"])
        docs.append((i, " ".join(w), "en", len(w)))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(None, "abc", None, None), (n + 1, None, "xx", 3), (n + 2, "", None, None), (n + 3, "w " * 50000, None, None), (3, docs[3][1], "en", docs[3][3])]
    labels += [(None, 1, 1), (n + 1, None, None), (5, *labels[5][1:])]
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, "doc_id bigint, text string, lang string, n_chars bigint").repartition(3), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), docs, labels


@pytest.mark.parametrize(("run", "column", "parts", "held"), [(quality, 1, 5, 0), (toxicity, 2, 4, 2)])
def test_held_out(tables, run, column, parts, held):
    df, lab, docs, labels = tables
    got = run(df, lab).collect()
    assert len(got) == len(docs)
    truth = {x[0]: x[column] for x in labels if x[0] is not None}
    for x in got:
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % parts == held)
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3)
    scored = [x for x in got if x.held_out and truth.get(x.doc_id) is not None]
    assert np.mean([x.predicted == truth[x.doc_id] for x in scored]) > 0.95
    again = run(df.repartition(7), lab.repartition(2)).collect()
    key = lambda x: (x.doc_id is None, x.doc_id, x.score)
    assert np.allclose([x.score for x in sorted(got, key=key)], [x.score for x in sorted(again, key=key)])


@pytest.mark.parametrize("run", [quality, toxicity])
def test_empty(tables, run):
    df, lab, docs, _ = tables
    assert run(df.limit(0), lab).count() == 0
    assert {round(x.score, 6) for x in run(df, lab.limit(0)).collect()} == {0.5}


def test_rejected_documents_go(tables):
    df, lab, docs, labels = tables
    kept = accepted(df.withColumnRenamed("lang", "c0"), lab)
    assert kept.columns == ["doc_id", "text", "c0", "n_chars"]
    rejected = {(x.doc_id, round(x.score, 9)) for x in quality(df, lab).collect() if not x.predicted}
    assert len(kept.collect()) == len(docs) - sum(1 for x in quality(df, lab).collect() if not x.predicted) and rejected


def test_linear_time_identity():
    how = Machine(buckets=64, rank=4)
    m = Factors(how)
    rng = np.random.default_rng(0)
    m.w, m.v, m.w0 = rng.normal(size=m.w.shape), rng.normal(size=m.v.shape), 0.3
    index, value = np.array([3, 9, 60, 70]), rng.normal(size=4)
    pairs = sum(m.v[index[a]] @ m.v[index[b]] * value[a] * value[b] for a in range(4) for b in range(a))
    got = m.margin(index, value, np.array([0, 4, 4]))[0]
    assert np.isclose(got[0], 0.3 + m.w[index] @ value + pairs) and np.isclose(got[1], 0.3)
    assert segment_sum(np.ones(3), np.array([0, 0, 3, 3])).tolist() == [0, 3, 0]
    assert Grams().threshold == how.threshold == 0.3
