"""The language model: exact base scores, a proper distribution, true gradients, carried state, held-out gain."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from kontra.llm import language_model as language_model_module
from kontra.llm.language_model import Adam, Network, Recurrent, Vocabulary, language_model, vocabulary

SMALL = Recurrent(head=150, words=40, hidden=12, embed=8, rows=400, lanes=8, window=12, epochs=4)


def corpus():
    r = random.Random(6)
    groups = [["".join(r.choice(a) for _ in range(r.randint(2, 6))) for _ in range(120)] for a in ("abcde", "éèçkl", "mnopq")]
    rows = []
    for i in range(500):
        g = r.choice(groups)
        rows.append((i, "\n".join(r.choice(g[: r.randint(2, 120)]).title() + r.choice(["", "", ",", "."]) for _ in range(r.randint(0, 60)))))
    return rows + [(1000, None), (None, "abc abc"), (1001, ""), (1002, "never seen words 123 !!"), (1003, "aa " * 20000), (3, rows[3][1])]


def base(rows):
    words = [[*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), 0] for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows]
    c = Counter(w for ws, h, (d, _) in zip(words, held, rows, strict=True) if not h and d is not None for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted((str(d), h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for (d, _), ws, h in zip(rows, words, held, strict=True))


def test_base_scores_and_gain(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, text string, score double").repartition(3)
    got = language_model(df, how=SMALL).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == base(rows)
    held = [r for r in got if r.held_out and r.n_tokens < 1000]
    assert all(r.score < 0 for r in got)
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 0.97


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert language_model(df, how=SMALL).count() == 0
    only_held = spark.createDataFrame([(d, "a b") for d in range(40) if zlib.crc32(str(d).encode()) % 5 == 1], "doc_id bigint, text string")
    assert {round(r.base_score, 9) for r in language_model(only_held, how=SMALL).collect()} == {0.0}


def network():
    p = np.random.default_rng(0).dirichlet(np.ones(30))
    words = Vocabulary(np.zeros(1, np.uint64), np.zeros(1), np.zeros(1), p, np.zeros(7), 1, 1)
    return Network(words, SMALL)


def test_distribution_sums_to_one():
    net = network()
    h = np.random.default_rng(1).normal(size=(3, 12)).astype(np.float32)
    p = np.array([np.exp(net.log_p(h, np.full(3, y))) for y in range(30)])
    assert np.allclose(p.sum(0), 1, atol=1e-5)


def test_state_is_carried_and_batches_change_nothing():
    net, rng = network(), np.random.default_rng(2)
    docs = [np.append(rng.integers(1, 30, n), 0) for n in (0, 1, 7, 300, 65, 64, 63)]
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    whole = net.score(np.concatenate(docs), first, window=10**6)
    assert np.allclose(whole, net.score(np.concatenate(docs), first, window=5), rtol=1e-4)
    assert np.allclose(whole, [net.score(d, np.array([0, len(d)]))[0] for d in docs], rtol=1e-4)


def test_gradients():
    net, rng = network(), np.random.default_rng(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(0, 30, (4, 6)), rng.integers(0, 30, (4, 6))
    h = rng.normal(size=(4, 12))

    def loss():
        state, total, table = h.astype(np.float32), 0.0, net.p["e"] @ net.p["w"] + net.p["b"]
        for j in range(6):
            state = np.where((x[:, j] == 0)[:, None], 0, state)
            state = net.step(table[x[:, j]], state)[0]
            total -= net.log_p(state, y[:, j]).sum()
        return total / 24

    grad, _ = net.gradients(x, y, h)
    rows, values = grad["e"]
    grad["e"] = np.zeros_like(net.p["e"])
    grad["e"][rows] = values
    for name, value in net.p.items():
        flat = value.reshape(-1)
        for i in rng.integers(0, len(flat), 6):
            old = flat[i]
            flat[i] = old + 1e-4
            up = loss()
            flat[i] = old - 1e-4
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-4 - grad[name].reshape(-1)[i]) < 2e-4, name


def test_documents_beyond_the_sample_teach_the_network(spark):
    r, rows = random.Random(8), []
    for i in range(1200):
        ks = [r.randrange(12) for _ in range(40)]
        rows.append((i, " ".join(f"a{k} b{k}" for k in ks)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    how = replace(SMALL, rows=1, group_lanes=8, group_rate=0.02, group_tokens=40_000)
    got = {n: {x.doc_id: (x.held_out, x.score, x.base_score) for x in language_model(df.repartition(n), how=how).collect()} for n in (1, 5)}
    held = [v for v in got[1].values() if v[0]]
    # of a pair the second word follows from the first: all but half of the unigram's loss can be learnt, from no single document
    assert sum(v[1] for v in held) > 0.75 * sum(v[2] for v in held)
    assert all(abs(got[1][k][1] - got[5][k][1]) < 1e-3 for k in got[1])


def test_every_symbol_is_learnt_from_once():
    net, rng = network(), np.random.default_rng(4)
    seen = []
    whole = net.gradients
    net.gradients = lambda x, y, h: (seen.append((x, y)), whole(x, y, h))[1]
    pieces = [rng.integers(0, 30, n) for n in (1, 7, 12 * 8 + 5, 3001)]
    assert net.learn(iter(pieces), 100) == sum(map(len, pieces))
    got = np.sort(np.concatenate([y.ravel() for _, y in seen]))
    assert (got == np.sort(np.concatenate(pieces))).all()


def test_words_grow_with_the_types(spark):
    sizes = []
    for n in (400, 40_000):
        counts = spark.range(n).select((F.col("id") * 8).alias("h"), F.lit(3).cast("bigint").alias("c"))
        sizes.append(vocabulary(counts, replace(SMALL, head=50_000)).n_words - 1)
    assert sizes == [40, 400]


def test_only_words_of_the_window_go_through_the_input_weights():
    p = np.random.default_rng(5).dirichlet(np.ones(20_000))
    net, rng = Network(Vocabulary(np.zeros(1, np.uint64), np.zeros(1), np.zeros(1), p, np.zeros(7), 1, 1), SMALL), np.random.default_rng(6)
    x, y = rng.integers(0, 20_000, (4, 6)), rng.integers(0, 20_000, (4, 6))
    tracemalloc.start()
    try:
        net.gradients(x, y, np.zeros((4, 12), np.float32))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # the output weights' gradient has 12 floats a word; 36 a word would be 2.9 MB more
    assert peak < 3.5e6


def test_a_step_is_the_unit_by_its_formulas_in_blocks_that_lie_contiguous():
    net, rng = network(), np.random.default_rng(7)
    n, h, x = 12, rng.uniform(-1, 1, (5, 12)).astype(np.float32), rng.normal(size=(5, 36)).astype(np.float32)
    u = h @ net.p["u"]
    z, r = (1 / (1 + np.exp(-(x + u)[:, i : i + n])) for i in (0, n))
    c = np.tanh(x[:, 2 * n :] + r * u[:, 2 * n :])
    got = net.step(x, h)
    assert np.allclose(got[0], c + z * (h - c), atol=1e-5)
    # of a row's parts side by side each sum or product would take several times as long
    assert all(v.flags.c_contiguous for v in (got[0], *got[1], *got[2:]))
    assert all(net.p["o"][lo:hi].flags.c_contiguous for lo, hi in zip(net.first, net.first[1:], strict=False))


def test_adam_moves_every_number_by_its_formula_in_single_precision(monkeypatch):
    rng, rows = np.random.default_rng(8), np.array([1, 4])
    p = {"a": rng.normal(size=(130, 300)).astype(np.float32), "e": rng.normal(size=(6, 8)).astype(np.float32)}
    want, m, s = ({k: v.astype(float) * x for k, v in p.items()} for x in (1, 0, 0))
    seen, moved = [], language_model_module.moved
    monkeypatch.setattr(language_model_module, "moved", lambda *a: (seen.extend(type(x) for x in a[4:]), moved(*a)))
    adam = Adam(p)
    for t in range(1, 5):
        # the norm is over 1 at first, then below
        g = {"a": rng.normal(size=(130, 300)) * (0.1 if t < 3 else 0.001), "e": rng.normal(size=(2, 8)) * 0.01}
        scale = min(1, 1 / math.sqrt(sum((v * v).sum() for v in g.values())))
        for k, at in (("a", slice(None)), ("e", rows)):
            m[k][at] = 0.9 * m[k][at] + 0.1 * scale * g[k]
            s[k][at] = 0.99 * s[k][at] + 0.01 * (scale * g[k]) ** 2
            want[k][at] -= 0.01 / (1 - 0.9**t) * m[k][at] / (np.sqrt(s[k][at] / (1 - 0.99**t)) + 1e-6)
        adam.step({"a": g["a"].astype(np.float32), "e": (rows, g["e"].astype(np.float32))}, 0.01)
    assert all(np.allclose(p[k], want[k], atol=1e-5) for k in p)
    # numpy's doubles would take every array through double precision
    assert set(seen) == {float}
