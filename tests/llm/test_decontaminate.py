"""Decontamination against every window of every document, and its defined edge cases."""

import random
import re
from collections import Counter

import numpy as np

from kontra.llm.decontaminate import BLOCKS, PER_ITEM, PER_WORD, Items, Windows, contaminated, decontaminated, fingerprints, near, passes


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    out = []
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            g = min(5, len(v))
            if not g or len(w) < g:
                continue
            bag = Counter(tuple(v[k : k + g]) for k in range(len(v) - g + 1))
            n, best = min(len(v), len(w)), None
            for s in range(len(w) - n + 1):
                a = Counter(tuple(w[k : k + g]) for k in range(s, s + n - g + 1))
                least, most = sum((a & bag).values()), sum((a | bag).values())
                if least * 5 >= most * 4 and (best is None or least / most > best[1]):
                    best = (s, least / most)
            if best:
                out.append((d, i, *best))
    return sorted(out)


def test_same_as_every_window(spark):
    r = random.Random(1)
    vocab = ["w%d" % i for i in range(200)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([3, 14, 30, 59, 59, 70])))) for i in range(30)] + [(99, ""), (98, None), (97, "one")]
    docs = []
    for d in range(160):
        w = [r.choice(vocab) for _ in range(r.randint(0, 200))]
        if d % 2:
            v = items[r.randrange(30)][1].split(" ")
            for _ in range(r.randint(0, 2)):
                v[r.randrange(len(v))] = r.choice(vocab).upper()
            v = v[r.randint(0, 2) :]
            w[r.randint(0, len(w)) :] = v + w[:20]
        docs.append((d, "\n".join(w)))
    docs += [(200, None), (201, ""), (202, "x one y"), (202, "x one y")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(docs, items)
    assert len(want) > 20
    for how in (Windows(), Windows(bytes_per_pass=25_000)):
        got = contaminated(df, bench, how=how).collect()
        assert sorted((x.doc_id, x.item_id, x.first_word, x.similarity) for x in got) == want
        kept = decontaminated(df.withColumnRenamed("doc_id", "c1"), bench, how=how)
        assert kept.columns == ["c1", "text"]
        assert sorted(x.c1 for x in kept.collect()) == sorted(d for d, _ in docs if d not in {x[0] for x in want})


def test_empty(spark):
    df, bench = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert contaminated(df, bench).count() == 0 and decontaminated(df, bench).count() == 1
    assert contaminated(df.limit(0), spark.createDataFrame([(1, "a b")], "item_id bigint, text string")).count() == 0


def planted(r, size):
    """An item and a document with the last words of a window replaced, as many as similarity 0.8 allows."""
    item = ["%x" % r.getrandbits(40) for _ in range(size)]
    m = max(x for x in range(size) if (size - 4 - x) * 5 >= (size - 4 + x) * 4)
    return " ".join(item), " ".join(item[: size - m] + ["%x" % r.getrandbits(40) for _ in range(m + 30)])


def test_windows_at_the_threshold_are_found(spark):
    r = random.Random(4)
    items, docs = zip(*[planted(r, size) for size in (13, 22, 40, 59, 59, 80) * 60], strict=True)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    for how in (Windows(), Windows(radius=128)):
        assert sorted((x.doc_id, x.item_id) for x in contaminated(df, bench, how=how).collect()) == [(i, i) for i in range(len(items))]


def test_nulls_repeats_and_long_texts(spark):
    passage = " ".join("p%d" % i for i in range(40))
    docs = [(None, passage, 1), (7, passage, 2), (7, passage, 2), (8, "w " * 30000 + passage.upper() + " w" * 30000, 3), (9, None, 4)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, item_id int")
    bench = spark.createDataFrame([(None, passage), (3, passage), (3, passage), (4, None)], "item_id bigint, text string")
    got = sorted((x.doc_id or 0, x.item_id or 0, x.first_word) for x in contaminated(df, bench).collect())
    assert got == sorted((d, i, 30000 if d == 8 else 0) for d in (0, 7, 7, 8) for i in (0, 3, 3))
    kept = decontaminated(df, bench)
    assert kept.columns == df.columns and [x.doc_id for x in kept.collect()] == [9]


def test_blocks_prune():
    """A block within half of the radius: all pairs within the radius have one, few of the others do."""
    r = np.random.default_rng(2)
    a, b = (r.integers(0, 2**63, (50_000, BLOCKS), dtype=np.int64).astype(np.uint64) * np.uint64(2) + r.integers(0, 2, (50_000, BLOCKS)).astype(np.uint64) for _ in range(2))
    how = Windows()
    apart = np.bitwise_count(a ^ b)
    assert (apart <= how.radius // BLOCKS).any(axis=1).mean() < 0.1
    for flips in (0, 1, 30, 47, 48):
        c = a[:2000].copy()
        for row in range(2000):
            for bit in r.choice(128, flips, replace=False):
                c[row, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        assert len(near(a[:2000], c, how.radius)) == (2000 if flips <= 47 else 0)
    assert len(near(a, b, 128)) == len(a)


def test_windows_at_the_threshold_are_within_the_radius():
    r = random.Random(9)
    words_of = lambda t: np.array([hash_of(w) for w in t.split()], dtype=np.uint64)
    hash_of = lambda w: int(w, 16) * 0x9E3779B97F4A7C15 % 2**64
    for size in (9, 13, 30, 59, 120, 200):
        worst = 0
        for _ in range(150):
            item, doc = planted(r, size)
            a, b = (fingerprints(words_of(t)[:size], size, np.zeros(1, np.int64)) for t in (item, doc))
            worst = max(worst, int(np.bitwise_count(a ^ b).sum()))
        assert worst <= Windows().radius


def test_an_index_is_no_larger_than_counted(spark):
    r = random.Random(3)
    for size, n in ((1, 4000), (4, 3000), (30, 800), (300, 60)):
        texts = [" ".join("%x" % r.getrandbits(40) for _ in range(size)) for _ in range(n)]
        counted = sum(len(t) + PER_ITEM + PER_WORD * size for t in texts)
        assert Items(texts, Windows()).nbytes <= counted + (1 << 20)


def test_a_large_benchmark_of_short_items(spark):
    """More items than one pass takes: every one is found, and each pass stays under its bound."""
    r = random.Random(8)
    items = [(i, " ".join("%x" % r.getrandbits(36) for _ in range(6))) for i in range(6000)]
    docs = [(d, " ".join("%x" % r.getrandbits(36) for _ in range(50)) + " " + items[d * 7][1]) for d in range(300)] + [(999, "nothing of it here at all")]
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    how = Windows(bytes_per_pass=1 << 20)
    built = [x.nbytes for x, _ in passes(bench, "item_id", "text", how)]
    assert len(built) > 2 and max(built) < 1.2 * how.bytes_per_pass
    assert sorted((x.doc_id, x.item_id) for x in contaminated(df, bench, how=how).collect()) == [(d, d * 7) for d in range(300)]


def test_items_that_share_a_common_phrase(spark):
    """Every document has a phrase that all items have; only one has an item."""
    r = random.Random(6)
    phrase = "the answer to this question is given below"
    items = [(i, phrase + " " + " ".join("%x" % r.getrandbits(36) for _ in range(12))) for i in range(400)]
    docs = [(d, " ".join("%x" % r.getrandbits(36) for _ in range(30)) + " " + phrase + " and more of it") for d in range(60)] + [(100, "x " + items[17][1])]
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert [(x.doc_id, x.item_id) for x in contaminated(df, bench).collect()] == [(100, 17)]
