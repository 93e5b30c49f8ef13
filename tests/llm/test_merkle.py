"""The manifest against a literal reading of its rule, tree by tree and proof by proof."""

import random
import zlib
from hashlib import sha256

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kontra.llm import merkle
from kontra.llm.merkle import climbed, depth, manifest, matrix, op12_query

H = lambda *x: sha256("".join(x).encode()).hexdigest()
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, root int"


def encode(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climb(nodes):
    """All levels, and each leaf's (place, run) of every level."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    paths = []
    for i in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            run = level[i // 3 * 3 : i // 3 * 3 + 3]
            path.append((i % 3, run))
            i //= 3
        paths.append(path)
    return levels[-1][0], paths


def brute(rows):
    """{(doc_id, leaf)...} in order: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    leaf = lambda r, text: H(*[encode(x) for x in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)])
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        own = sorted([(r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r) for r in rows if r["source"] == s], key=lambda x: x[:3])
        trees.append(([x[2] for x in own], [x[3] for x in own]))
    tops = [climb(leaves) for leaves, _ in trees]
    root, up = climb([t[0] for t in tops]) if tops else ("", [])
    out = []
    for (leaves, own), (subroot, paths), above in zip(trees, tops, up, strict=True):
        for l, r, path in zip(leaves, own, paths, strict=True):
            text = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            h = leaf(r, text)
            for at, run in path + above:
                h = H(*run[:at], h, *run[at + 1 :])
            siblings = [x for at, run in path + above for k, x in enumerate(run) if k != at]
            out.append((r["doc_id"], l, subroot, root, H(*siblings), h, h == root))
    return sorted(out, key=str)


def some(n, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        source = r.choice(["hot"] * 8 + ["src1", "ä", "z", "", None])
        rows.append({"doc_id": i if i % 41 else None, "text": r.choice([None, "", "one\ntwo", "plain", "\n", "ü日\r\n" * r.randrange(5)]), "lang": r.choice(["en", None, ""]), "source": source, "n_chars": r.choice([None, 3, -1])})
    return rows + rows[5:9] + [rows[7] | {"text": "same id, another text\n"}]


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in COLUMNS) + ("clash", 1) for r in rows], SCHEMA)


def run(spark, rows, parts=3, **how):
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = F.when(even, F.regexp_replace("text", "\n", "")).otherwise(F.col("text"))
    got = manifest(frame(spark, rows).repartition(parts), {"text": changed}, **how).collect()
    return got, sorted([tuple(r)[:7] for r in got], key=str)


@pytest.mark.parametrize("n, levels, parts", [(0, 1, 2), (1, 2, 1), (90, 1, 5), (131, 6, 4)])
def test_against_brute_force(spark, n, levels, parts):
    rows = some(n) if n > 2 else some(60)[:n]
    assert run(spark, rows, parts, levels=levels)[1] == brute(rows)


def test_one_source_of_identical_rows(spark):
    rows = [{"doc_id": 7, "text": "a\nb", "lang": None, "source": None, "n_chars": 3}] * 40
    got = run(spark, rows, levels=1)[1]
    assert got == brute(rows) and len({r[4] for r in got}) > 1


def test_siblings_lead_to_the_root(spark):
    rows = some(100)
    for r in run(spark, rows, levels=2, proofs=True)[0]:
        assert H(*r.siblings) == r.proof_sha256 and len(r.siblings) > 4


def test_very_long_text_and_a_foreign_order(spark):
    rows = some(20) + [{"doc_id": 999, "text": "x\n" * 300_000, "lang": "en", "source": "hot", "n_chars": 1}]
    assert run(spark, list(reversed(rows)), levels=1)[1] == brute(rows)


def test_every_fanout():
    for fanout in (2, 3, 5):
        nodes = [H(str(i)) for i in range(23)]
        want = nodes
        while len(want) > 1:
            want = [H(*want[i : i + fanout]) for i in range(0, len(want), fanout)]
        assert bytes(climbed(matrix(nodes), depth(23, 99, fanout), fanout)[-1][0]).decode() == want[0]


def test_query_and_sql(spark, tmp_path):
    rows = [r for r in some(70) if r["doc_id"] is not None]
    frame(spark, rows).select(*COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted([tuple(r) for r in op12_query(spark, str(tmp_path)).collect()], key=str)
    assert got == brute(rows)
    db = duckdb.connect()
    documents = pd.DataFrame(rows).astype({"doc_id": "Int64", "n_chars": "Int64"})  # noqa: F841
    db.register("documents", documents)
    assert sorted(db.execute(merkle.ORACLE).fetchall(), key=str) == got
