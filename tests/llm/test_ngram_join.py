"""The n-gram join against brute force over all pairs, and its defined edge cases."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute

from kontra.llm.scratch import Scratch, if_small
from kontra.llm.fuzzy import shared, Join
from kontra.llm.ngram_join import ngram_join, one_per_group


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    words = [tuple(re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and (words[i] == words[j] or len(a & b) * 5 >= len(a | b) * 4):
                links[i] += 1
                links[j] += 1
                up[top(i)] = top(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(rows[i][0])
    return sorted((rows[i][0], min(groups[top(i)]), links[i]) for i in range(len(rows)))


def corpus(seed, n=60):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)]
    out = []
    for _ in range(n):
        base = [r.choice(vocab) for _ in range(r.randint(1, 120))]
        out.append(" ".join(base))
        for _ in range(r.randint(0, 3)):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(vocab)
            out.append((" " if r.random() < 0.7 else "\n").join(w).title() if r.random() < 0.2 else " ".join(w))
    hot = [r.choice(vocab) for _ in range(150)]
    for _ in range(80):
        w = list(hot)
        w[r.randrange(len(w))] = r.choice(vocab)
        out.append(" ".join(w))
    out += [" ".join(hot)] * 30 + ["", "   ", "same few words", "same few words"]
    r.shuffle(out)
    return [(i * 7 % 1009 if i % 11 else -i, t) for i, t in enumerate(out)]


def result(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    out, names = ngram_join(df, **more)
    return sorted((r["c0"], r["class_id"], r["n_links"]) for r in out.collect())


def test_same_as_brute_force(spark):
    rows = corpus(3)
    assert result(spark, rows) == brute(rows)


def test_slices_change_nothing(spark):
    rows = corpus(4)
    assert result(spark, rows, how=Join(unit="text", kind="words", k=5, bands=30, rows=5, slice_rows=7)) == brute(rows)


def test_edges(spark):
    long = " ".join("x%d" % (i % 9973) for i in range(60000))
    rows = [(1, None, "a", 1), (None, "one two three four five six", "a", 2), (3, "one two three four five six", None, 3), (3, "one two three four five six", None, 3), (5, long, "b", 4), (6, long + " end", "b", 5), (7, "", "", 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, units string, class_id int")
    kept = one_per_group(df)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], r["class_id"]) for r in kept.collect()), key=lambda r: r[1])
    assert [g for g in got if g[1] != 3] == [(1, 1), (5, 4), (7, 6)]
    assert [g for g in got if g[1] == 3] == [(3, 3)]
    assert one_per_group(df.limit(0)).count() == 0


def test_empty_slices_count_no_pair_again(spark):
    # two members of a long bucket make many slices, most of them empty
    rows = corpus(13, 12)
    assert result(spark, rows, how=Join(unit="text", kind="words", k=5, bands=30, rows=5, slice_values=60)) == brute(rows)


def test_fingerprints_with_equal_upper_bits_are_two_classes(spark, monkeypatch):
    from kontra.llm import fuzzy

    rows = [[(0, 5 << 20, 1, 1, [11, 22, 33]), (1, 9, 1, 1, [12, 25, 35]), (2, 9, 1, 1, [])], [(0, 77, 1, 1, []), (0, (5 << 20) + 1, 1, 1, [11, 24, 33])], [(0, 9, 1, 1, [12, 25, 35])], [], [(0, -(5 << 40), 1, 1, [-7, 24, -9])]]
    data = [([(*u[:4], bool(u[4])) for u in r], np.array([k for u in r for k in u[4]], np.int64).tobytes()) for r in rows]
    table = spark.createDataFrame(data, f"units {fuzzy.UNIT}, bands {fuzzy.BANDS}").repartition(3)
    how = Join(unit="text", kind="words", k=5, bands=3, rows=1)
    for keys in (1 << 20, 2):
        monkeypatch.setattr(fuzzy, "KEYS", keys)
        assert sorted(r.key for r in shared(table, how, Scratch(spark, "t")).collect()) == [11, 24, 33]
    assert shared(table.limit(0), how, Scratch(spark, "t")).count() == 0


def test_small_is_measured(spark):
    t = spark.createDataFrame([("x" * 1000, [1.0] * 100)] * 50, "a string, v array<double>")
    assert if_small(t, limit=50 * 1900)[1] and not if_small(t, limit=50 * 1700)[1]
    assert not if_small(t, 64, limit=100)[1]


def test_beyond_the_broadcast_limit(spark, monkeypatch):
    from kontra.llm import fuzzy, ngram_join as module

    never = lambda df, row_bytes=None, limit=0: (df, False)
    monkeypatch.setattr(fuzzy, "if_small", never)
    monkeypatch.setattr(module, "if_small", never)
    test_same_as_brute_force(spark)


def test_squeezed():
    import re

    from kontra.llm.fuzzy import squeezed

    r = random.Random(3)
    rows = ["".join(r.choice(" \t\n\rABcdé") for _ in range(r.randint(0, 9))) for _ in range(4000)]
    raw = [x.encode() for x in rows]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    data, at = squeezed(np.frombuffer(b"".join(raw), np.uint8), offsets)
    want = [re.sub(r"[ \t\n\r]+", " ", x).strip(" ").replace("A", "a").replace("B", "b") for x in rows]
    assert [data[lo:hi].tobytes().decode() for lo, hi in zip(at[:-1], at[1:], strict=True)] == want


def test_a_tile_holds_few_of_its_pairs_at_a_time():
    """Two full slices of near copies, and many small groups of long texts: arrays of pairs or of their values stay small beside the texts."""
    r = random.Random(5)
    vocab = ["w%d" % i for i in range(3000)]
    hot = [r.choice(vocab) for _ in range(60)]
    near = [" ".join(hot[:i] + ["x%d" % n] + hot[i + 1 :]) for n, i in ((n, n % 2 * 59) for n in range(1536))]
    peak, counts = tile_peak([near], ["same"])
    assert peak < 55e6 and all(c == 768 for c in counts)
    groups = [[" ".join(base[:-k]) for k in range(1, 9)] for base in ([r.choice(vocab) for _ in range(200)] for _ in range(180))]
    peak, counts = tile_peak(groups, list(range(len(groups))))
    assert peak < 30e6 and max(counts) == 7


def tile_peak(groups, keys):
    """(most bytes that Python and numpy held beyond the input in Tiles.some, links of each text); each group shares a band key; one group alone is a tile of two slices."""
    from kontra.llm.fuzzy import Tiles
    from kontra.llm.ngram_join import DEFAULT

    texts = [t for g in groups for t in g]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    tiles = Tiles(DEFAULT)
    tiles.hasher = DEFAULT.hasher()
    s, f, _ = DEFAULT.shingles(data, offsets)
    band = tiles.hasher.keys(tiles.hasher.values(s, f))
    cuts = np.concatenate([[0], np.cumsum([len(g) for g in groups])])
    cross = len(groups) == 1
    # the first band that all of a group share; in one tile any pair counts under the first band
    key = np.concatenate([np.full(len(g), next((k[0] for k in band[lo : lo + len(g)].T if (k == k[0]).all()), band[lo, 0])) for g, lo in zip(groups, cuts)])
    n = len(texts)
    columns = [key, np.zeros(n, np.int64), np.full(n, int(cross)), np.arange(n) % 2 == 1, np.arange(n), np.arange(n) + 7, np.ones(n, np.int64), texts]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list("abcdefgh"))
    tracemalloc.start()
    try:
        out = pa.Table.from_batches(list(tiles.some(batch, cuts)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    found = out.filter(pa.compute.is_null(out["b1"])).group_by("a1").aggregate([("texts", "sum")])
    return peak, [dict(zip(found["a1"].to_pylist(), found["texts_sum"].to_pylist())).get(i, 0) for i in range(n)]
