"""Nested scrubbing, order-free digests, both ways of retrieval, streamed digests, kept tables, disclosures."""

import hashlib
import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from kontra.operators import cluster, integrity, service, text
from kontra.sources import files, tables


def replaced(v, pairs):
    """Strings of a nested value, not its keys."""
    if isinstance(v, str):
        for a, b in pairs:
            v = v.replace(a, b)
        return v
    if isinstance(v, list):
        return [replaced(x, pairs) for x in v]
    return {k: replaced(x, pairs) for k, x in v.items()} if isinstance(v, dict) else v


def test_scrub_changes_string_values_only(spark):
    pairs = [("/home/me", "${ROOT}"), ("42", "n"), ('"', "'")]
    deep = {"/home/me": {"42": [{"x": ["/home/me/a", 42, 4.20e1, {"p": "a /home/me b 42", "q": None, "r": True}]}]}, "é": 'say "hi" \\ \n/home/me', "": ["", "\u2028"]}
    rows = [json.dumps(deep), json.dumps(deep, ensure_ascii=False, indent=2), json.dumps("/home/me"), "{}", "", None, '{"a" : 42.50, "b":[ 1 ,"42" ]}', 'no json "', json.dumps([{"a:": "b:", "k": "c"}])]
    got = [r.o for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, j string").select("i", text.scrub(F.col("j"), pairs).alias("o")).orderBy("i").collect()]
    for a, b in zip(rows, got, strict=True):
        if a and a[0] in '{["' and a != 'no json "':
            assert json.loads(b) == replaced(json.loads(a), pairs)
    assert got[5] is None and got[6] == '{"a" : 42.50, "b":[ 1 ,"n" ]}' and got[7] == rows[7] and got[4] == ""


def test_scrub_leaves_escapes_of_untouched_values(spark):
    raw = '{"a": "\\u00e9\\/x", "b": 1}'
    assert spark.createDataFrame([(raw,)], "j string").select(text.scrub(F.col("j"), [("zz", "y")]).alias("o")).first().o == raw


def test_digest_of_rows_without_order(spark):
    rows = [(i % 7, None if i % 5 == 0 else f"t{i}") for i in range(60)]
    digest = lambda r, n: text.multiset_digest(spark.createDataFrame(r, "a int, b string").repartition(n), ["a", "b"]).first()
    one = digest(rows, 1)
    random.Random(1).shuffle(rows)
    assert digest(rows, 5) == one and one.rows == 60
    assert digest(rows[1:] + [rows[1]], 3).digest != one.digest
    assert digest([*rows[:-1], (rows[-1][0], "other")], 3).digest != one.digest
    assert digest([(1, "a"), (2, "b")], 1).digest != digest([(1, "b"), (2, "a")], 1).digest
    sums = [sum(int(hashlib.sha256(b"1:7" + b"2:xy").hexdigest()[16 * i : 16 * i + 16], 16) for _ in range(3)) % 2**64 for i in range(4)]
    assert digest([(7, "xy")] * 3, 2).digest == hashlib.sha256(":".join(map(str, [3, *sums])).encode()).hexdigest()
    assert text.multiset_digest(spark.createDataFrame([], "a int, b string"), ["a"]).first().rows == 0


def brute(queries, chunks, k, least):
    toks = lambda t: set(text_tokens(t))
    d = {c: toks(f"{h} {t}") for c, h, t in chunks}
    df = {}
    for ts in d.values():
        for t in ts:
            df[t] = df.get(t, 0) + 1
    out = []
    for q, t in queries:
        qs = toks(t or "")
        s = [(-round(sum(math.log((len(d) + 1) / (df[x] + 1)) + 1 for x in qs & ts) / math.sqrt(max(len(qs), 1) * max(len(ts), 1)), 9), c) for c, ts in d.items() if qs & ts]
        out += [(q, c, r + 1) for r, (s_, c) in enumerate(sorted(x for x in s if -x[0] >= least)[:k])]
    return sorted(out)


def text_tokens(t):
    import re

    return [w for w in re.findall(text.TOKEN, t.lower()) if w not in text.STOP]


@pytest.mark.parametrize("limit", [1 << 25, 0])
def test_retrieval_by_either_way(spark, limit):
    r = random.Random(4)
    word = lambda: f"w{int(r.random() ** 2 * 40)}"
    chunks = [(f"c{i}", word(), " ".join(word() for _ in range(r.randrange(1, 30)))) for i in range(120)] + [("c200", "", "")]
    chunks += [(f"d{i}", "same", "w1 w2 w3") for i in range(9)]
    queries = [(i, " ".join(word() for _ in range(6))) for i in range(15)] + [(90, ""), (91, None), (92, "w1 w2 w3"), (93, "nothing-known")]
    c = spark.createDataFrame(chunks, "chunk_id string, heading string, text string").repartition(5)
    got = text.retrieve(spark.createDataFrame(queries, "query_id int, text string"), c, 4, 0.08, limit).collect()
    assert sorted((x.query_id, x.chunk_id, x["rank"]) for x in got) == brute(queries, chunks, 4, 0.08)
    none = spark.createDataFrame([], "query_id int, text string")
    assert text.retrieve(none, c, limit=limit).count() == 0
    assert text.retrieve(spark.createDataFrame(queries, "query_id int, text string"), c.limit(0), limit=limit).count() == 0


def test_streamed_manifest(spark, tmp_path):
    big = tmp_path / "big.bin"
    with big.open("wb") as f:
        f.write(b"head")
        f.truncate((2 << 30) + 5)
    spark.range(7).coalesce(1).write.parquet(str(tmp_path / "t"))
    (tmp_path / "empty.txt").write_text("")
    got = {r.file: r for r in integrity.manifest(spark, str(tmp_path)).collect()}
    h = hashlib.sha256(b"head")
    for _ in range(512):
        h.update(bytes(4 << 20))
    h.update(bytes(1))
    assert got["big.bin"].sha256 == h.hexdigest() and got["big.bin"].bytes == (2 << 30) + 5 and got["big.bin"].rows is None
    assert "empty.txt" not in got
    part = next(f for f in got if f.endswith(".parquet"))
    assert got[part].rows == 7 and got[part].bytes == os.path.getsize(tmp_path / "t" / part)
    assert integrity.manifest(spark, str(tmp_path), "*.parquet", digest=False).first().sha256 is None


def test_kept_tables_follow_their_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    made = []
    make = lambda: made.append(1) or spark.read.text(str(tmp_path / "a.txt"))
    assert tables.kept(spark, str(tmp_path), "x", make).first().value == "one"
    assert tables.kept(spark, str(tmp_path), "x", make).first().value == "one" and len(made) == 1
    (tmp_path / "a.txt").write_text("another")
    assert tables.kept(spark, str(tmp_path), "x", make).first().value == "another" and len(made) == 2
    held = tables.kept(spark, str(tmp_path), "x", make)
    tables.release(spark, str(tmp_path))
    assert not held.is_cached and (spark.sparkContext.applicationId, str(tmp_path), "x") not in tables._kept


def test_fan_out_by_two_columns(spark, tmp_path):
    df = spark.createDataFrame([("a", "up", 1), ("a", "down", 2), ("b", "up", 3)], "c string, d string, v int")
    files.write_csv(df, str(tmp_path / "o"), "c", "d")
    assert sorted(str(p.relative_to(tmp_path / "o").parent) for p in (tmp_path / "o").rglob("part-*.csv")) == ["c=a/d=down", "c=a/d=up", "c=b/d=up"]


def test_robust_pairs(spark):
    kind = "a string, b string, percentile_vs_null double, q double, pearson double"
    x = spark.createDataFrame([("a", "b", 99.0, 0.01, 0.9), ("a", "c", 50.0, 0.4, 0.1), ("a", "d", 98.0, 0.02, 0.8)], kind)
    y = spark.createDataFrame([("a", "b", 97.0, 0.03, 0.7), ("a", "c", 96.0, 0.04, 0.6), ("a", "d", 10.0, 0.9, 0.0), ("b", "c", 1.0, None, None)], kind)
    got = {(r.a, r.b): (r.found_in, r.first_q, r.second_q) for r in cluster.robust_pairs(x, y).collect()}
    assert got == {("a", "b"): ("both", 0.01, 0.03), ("a", "c"): ("second", 0.4, 0.04), ("a", "d"): ("first", 0.02, 0.9)}


def test_disclosure(spark, tmp_path):
    assert service.router_disclosure(spark)["candidate"] is None
    at = tmp_path / "m.json"
    at.write_text(json.dumps({"model_name": "m", "seed": 1, "max_steps": 8, "train_loss": 2.5, "test_loss": 2.7, "other": []}, indent=1))
    told = service.router_disclosure(spark, str(at))
    assert told["router"] == "rules" and told["candidate"]["test_loss"] == 2.7 and told["candidate"]["max_steps"] == 8
    at.write_text("{}")
    with pytest.raises(ValueError, match="model_name"):
        service.router_disclosure(spark, str(at))
