"""Ids against the library, the plan against bins filled one at a time, and the packing as a whole."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from kontra.llm.packing import Encoder, bins, fullest, op13_query, pack, places, sequences
from kontra.llm.tokens import default_path

LIBRARY = Tokenizer.from_file(default_path())
HOSTILE = " \n\t\r'abcreltsvmdé1९<|>endoftext|日本   　\x85\x1c👍🏽ß,.!"


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_librarys():
    r, encoder = random.Random(3), Encoder()
    assert encoder.fast is not None
    texts = ["", "<|endoftext|>", "a <|endoftext|>  b", " " * 300_000 + "x", "ab" * 50_000, "\n" * 9000, "日本" * 3000]
    texts += ["".join(r.choice(HOSTILE) for _ in range(r.randrange(60))) for _ in range(1500)]
    texts += [t[:5] + "<|endoftext|>" + t[5:] for t in texts[7:200]]
    for t in texts:
        assert encoder(t).tolist() == ids_of(t)
    encoder.fast = None
    assert encoder(texts[2]).tolist() == ids_of(texts[2])


def test_fullest_against_all_combinations():
    r = random.Random(5)
    for _ in range(150):
        counts = {r.randrange(1, 20): r.randrange(1, 4) for _ in range(r.randrange(1, 6))}
        room = r.randrange(0, 40)
        got = fullest(counts, room)
        assert all(0 < n <= counts[k] for k, n in got)
        best = max(s for s in (sum(k * n for k, n in zip(counts, use, strict=True)) for use in itertools.product(*[range(n + 1) for n in counts.values()])) if s <= room)
        assert sum(k * n for k, n in got) == best


def test_plan_is_that_of_bins_filled_one_at_a_time():
    r = random.Random(6)
    for _ in range(60):
        counts = {r.randrange(1, 41): r.choice([1, 2, 3, 50]) for _ in range(r.randrange(1, 9))}
        left, want = Counter(counts), []
        while left:
            longest = max(left)
            left[longest] -= 1
            left += Counter()
            one = Counter(dict(fullest(left, 40 - longest)))
            left.subtract(one)
            left += Counter()
            one[longest] += 1
            want.append(sorted(one.items(), reverse=True))
        assert [k for n, k in bins(counts, 40) for _ in range(n)] == want
        spans = defaultdict(list)
        for length, lo, hi, *_ in places(bins(counts, 40)):
            spans[length].append((lo, hi))
        for length, s in spans.items():
            assert s[0][0] == 0 and s[-1][1] == counts[length] and all(a[1] == b[0] for a, b in itertools.pairwise(s))


def test_plan_does_not_grow_with_the_pieces():
    r = random.Random(7)
    counts = {n: r.randrange(1, 50) for n in range(1, 513)}
    small, large = bins(counts, 512), bins({k: n * 10**9 for k, n in counts.items()}, 512)
    assert len(large) < 3 * len(small)
    # two pieces over half a sequence never share one
    least = max(-(-sum(k * n * 10**9 for k, n in counts.items()) // 512), sum(n * 10**9 for k, n in counts.items() if k > 256))
    assert least <= sum(n for n, _ in large) < 1.01 * least


SCHEMA = "doc_id bigint, text string, length string, task int, offset string"


def some(seed=1):
    r = random.Random(seed)
    texts = [None, "", " ", "<|endoftext|>", "é" * 9, "x\n" * 400] + [" ".join(r.choice(["alpha", "be", "gam,", "日本", "1234"]) for _ in range(r.randrange(90))) for _ in range(150)]
    return [(i if i % 13 else None, t) for i, t in enumerate(texts)] + [(7, texts[6])] * 40


def check(rows, got, capacity):
    want = Counter()
    for i, t in rows:
        ids = [*ids_of(t), 0]
        over = len(ids) % capacity or capacity
        cuts = [0, *range(over, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity, parts", [(64, 5), (2048, 2)])
def test_packing(spark, capacity, parts):
    rows = some()
    df = spark.createDataFrame([(i, t, "x", 3, "y") for i, t in rows], SCHEMA).repartition(parts)
    packed = pack(df, capacity=capacity, ids=True)
    got = packed.collect()
    n = check(rows, got, capacity)
    assert n == sum(k for k, _ in bins(Counter(r.length for r in got), capacity))
    for s in sequences(packed).collect():
        assert len(s.ids) == sum(s.lengths) <= capacity and len(s.doc_ids) == len(s.lengths)
    assert Counter(x for s in sequences(packed).collect() for x in s.ids) == Counter(x for _, t in rows for x in [*ids_of(t), 0])


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark, tmp_path):
    rows = [(1, "a b c"), (2, "word " * 5000), (3, None), (4, "z" * 30_000)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert check(rows, op13_query(spark, str(tmp_path)).collect(), 2048) == -(-sum(len(ids_of(t)) + 1 for _, t in rows) // 2048)
