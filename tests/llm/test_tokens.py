"""Token counts at every prefix against the library, which encodes each prefix anew."""

import random

from tokenizers import Tokenizer

from kontra.llm.tokens import Prefixes, token_counts

TEXTS = ["", None, "a   b\n\n c  ", "it's we'rest 'r 've'll!'s '", "x<|endoftext|>y", "!<|endoftext|> <|endo", "日本語 é  ü\x1c\x85 z", "<|endoftext|>", "  <|endoftext|>  a", "👍🏽 ok १२", "  a \t\n", "end  ", "a \n b \n\n c\n "]


def some():
    r = random.Random(1)
    return TEXTS + ["".join(r.choice(" \n'abcreltsv!é1<|>") for _ in range(40)) for _ in range(80)]


def test_every_prefix():
    model, library = Prefixes(kept=50), Tokenizer.from_file(Prefixes().path)
    size = lambda s: len(library.encode(s, add_special_tokens=False).ids)
    for s in some():
        s = s or ""
        want = [size(s[:i]) for i in range(len(s) + 1)]
        assert model.every(s).tolist() == want
        assert model.count(s) == want[-1]
        for limit in (0, 1, 2, 5, 17):
            if want[-1] > limit:
                assert model.fits(s, limit) == max(i for i, c in enumerate(want) if c <= limit)


def test_query(spark):
    library = Tokenizer.from_file(Prefixes().path)
    texts = [*some(), "word " * 3000]
    df = spark.createDataFrame([(i if i % 7 else None, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens string")
    got = token_counts(df.repartition(3), limit=20, prefixes=True).collect()
    assert len(got) == len(texts)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, t in enumerate(texts):
        if i % 7:
            n, r = len(library.encode(t or "", add_special_tokens=False).ids), by_id[i]
            assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((t or "").encode()), n > 20)
            assert r.prefix_tokens[-1] == n and r.prefix_tokens[r.fit_chars] <= 20
    assert token_counts(df.limit(0)).count() == 0


def test_tables_are_bounded_by_characters():
    from kontra.llm.tokens import CHARACTERS, Prefixes

    model, r = Prefixes(kept=400), random.Random(5)
    longest = 6000
    for k in range(60):
        # a text without blanks, as of base64, then many short words
        piece = "".join(r.choice("abcdefghijklmnop") for _ in range(longest))
        text = piece + " " + " ".join("w%dx" % r.randrange(10**6) for _ in range(20))
        assert model.count(text) == len(model.library.encode(text, add_special_tokens=False).ids)
        for table, most in ((model.tables, model.kept), (model.after_blank, model.after_blank.most)):
            assert sum(map(len, table)) <= CHARACTERS * most + longest + 1
