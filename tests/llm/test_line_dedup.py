"""Line deduplication against brute force, and its defined edge cases."""

import random
import re

from kontra.llm.fuzzy import Join
from kontra.llm.line_dedup import deduplicated, line_dedup
from kontra.llm.scratch import if_small


def normal(line):
    return re.sub(r"[ \t\n\v\f\r]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), line)).strip(" ")


def shingles(line):
    n = normal(line)
    return {n[i : i + 8] for i in range(max(1, len(n) - 7))} if n else set()


def brute(rows):
    lines = [(d, k, i) for d, (doc, text) in enumerate(rows) for k, i in enumerate((text or "").split("\n")) if shingles(i)]
    sets = [shingles(x[2]) for x in lines]
    up = list(range(len(lines)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            if len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4:
                up[top(i)] = top(j)
    first = {}
    for i, (d, k, _) in enumerate(lines):
        first[top(i)] = min(first.get(top(i), (1 << 60,)), (rows[d][0], d, k))
    gone = {(d, k) for i, (d, k, _) in enumerate(lines) if first[top(i)] != (rows[d][0], d, k)}
    return sorted((doc, None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (d, k) not in gone)) for d, (doc, text) in enumerate(rows))


def corpus(seed):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgéü") for _ in range(r.randint(2, 9))) for _ in range(300)]
    pool = [" ".join(r.choice(vocab) for _ in range(r.randint(1, 40))) for _ in range(60)]
    rows = []
    for i in range(50):
        lines = []
        for _ in range(r.randint(0, 8)):
            x = r.choice(pool)
            if r.random() < 0.5:
                w = x.split(" ")
                w[r.randrange(len(w))] = r.choice(vocab)
                x = " ".join(w)
            lines.append(r.choice(["", "  "]) + (x.upper() if r.random() < 0.1 else x) + r.choice(["", " ", "\r"]))
            if r.random() < 0.2:
                lines.append("")
        rows.append((i * 13 % 997, "\n".join(lines)))
    return rows + [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "ab"), (1004, "AB\nab\nabc")]


def test_same_as_brute_force(spark):
    for slices in (768, 5):
        rows = corpus(5)
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
        out, _ = line_dedup(df, how=Join(unit="line", kind="chars", k=8, bands=40, rows=4, slice_rows=slices))
        assert sorted((r["c0"], r["c1"]) for r in out.collect()) == brute(rows)


def test_columns_and_what_is_left(spark):
    long = "\n".join("line number %d of a very long text %d" % (i * i, i) for i in range(3000))
    rows = [(1, "Same line here.\nother line of one", 33, "x"), (2, "same  line here.", 16, None), (None, None, None, None), (3, long, 7, "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, units string")
    out = deduplicated(df)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == {1, None, 3}
    assert got[1].text == rows[0][1] and got[1].n_chars == 33
    assert deduplicated(df.limit(0)).count() == 0


def test_the_query_s_own_bands_equal_brute_force(spark):
    for seed in (5, 6):
        rows = corpus(seed)
        out, _ = line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
        assert sorted((r["c0"], r["c1"]) for r in out.collect()) == brute(rows)


def test_many_repeated_lines_long_ids_and_ties(spark):
    """One document of 200,000 equal lines, ids of 2,000 characters, and a repeated doc_id."""
    one = "z" * 2000
    rows = [("b" + one, "\n".join(["the same line again and again"] * 200_000)), ("a" + one, "The same line again  and again\nand another line of this document"), ("a" + one, "and another line of this document"), ("c", "y" * 300_000 + "\n" + "y" * 300_000)]
    out, _ = line_dedup(spark.createDataFrame(rows, "doc_id string, text string").repartition(3))
    got = sorted((r["c0"], r["c1"], r["n_lines"], r["n_removed"]) for r in out.collect())
    by = {r[0][0]: r for r in got if r[0][0] != "a"}
    assert by["b"][1:] == ("", 200_000, 200_000) and by["c"][1:] == ("y" * 300_000, 2, 1)
    ties = [r for r in got if r[0][0] == "a"]
    assert sorted(r[3] for r in ties) in ([0, 1], [0, 2]) and sum(r[2] - r[3] for r in ties) == 2


def test_broadcasts_are_measured(spark):
    many = spark.sql("select 1L as row_uid, sequence(1, 200000) as gone")
    assert not if_small(many, limit=1 << 20)[1] and if_small(many, limit=2 << 20)[1]
    long = spark.sql("select named_struct('root', 1L, 'first', named_struct('id', repeat('x', 100000), 'pos', 1)) as s")
    assert not if_small(long, limit=90_000)[1] and if_small(long, limit=110_000)[1]
