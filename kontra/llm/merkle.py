"""Operator 12: a Merkle manifest of a data set, with a proof for every document.

The leaves of a source, in order, are cut into aligned blocks of fanout ** levels.  In a
block the digests are one contiguous numpy matrix of 64 hex bytes a row: reshaped by the
fanout, its rows are hashed level by level, and every sibling of every leaf is found by
index arithmetic.  The blocks' roots are the nodes of the next tables of blocks, until
one is left for each source; the sources' roots are numbered and climb in the same way.
Paths then go back down, a block's path being its parent's, so that no task ever holds
more than a block and a path, however many leaves a source has.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kontra.llm.scratch import Scratch, if_small, same

HEX = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)
PATH = "array<struct<at:int,others:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(c: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in fields]), 256)


def matrix(digests: list[str]) -> np.ndarray:
    """Hex digests as the rows of one matrix of bytes."""
    return np.frombuffer("".join(digests).encode("ascii"), dtype=np.uint8).reshape(-1, 64)


def parents(nodes: np.ndarray, fanout: int) -> np.ndarray:
    """Each ``fanout`` consecutive rows, fewer at the end, hashed into one."""
    whole = len(nodes) // fanout
    rows = nodes[: whole * fanout].reshape(whole, 64 * fanout)
    raw = b"".join([sha256(r).digest() for r in rows])
    if len(nodes) % fanout:
        raw += sha256(nodes[whole * fanout :].tobytes()).digest()
    d = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 32)
    return HEX[np.stack([d >> 4, d & 15], axis=2).reshape(-1, 64)]


def depth(n: int, levels: int, fanout: int) -> int:
    """Levels hashed in a block of a table of ``n`` nodes: up to one node, ``levels`` at most."""
    d = 0
    while n > 1 and d < levels:
        n, d = -(-n // fanout), d + 1
    return d


def climbed(nodes: np.ndarray, steps: int, fanout: int) -> list[np.ndarray]:
    """The block's matrices of all levels, the last having one row."""
    out = [nodes]
    for _ in range(steps):
        out.append(parents(out[-1], fanout))
    return out


def siblings(tree: list[np.ndarray], fanout: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level: every leaf's place in its run, its siblings' digests in order, and how many there are."""
    i = np.arange(len(tree[0]))
    k = np.arange(fanout - 1)
    for nodes in tree[:-1]:
        at = i % fanout
        index = (i - at)[:, None] + k + (k >= at[:, None])
        there = (index < len(nodes)).sum(axis=1)
        yield at, nodes[np.minimum(index, len(nodes) - 1)], there
        i = i // fanout


def paths(tree: list[np.ndarray], fanout: int) -> list[list[tuple[int, bytes]]]:
    """(place in the run, siblings) of every level, for each leaf of a block."""
    out: list[list[tuple[int, bytes]]] = [[] for _ in range(len(tree[0]))]
    for at, digests, there in siblings(tree, fanout):
        raw, width = digests.tobytes(), 64 * (fanout - 1)
        for r, (a, n) in enumerate(zip(at.tolist(), there.tolist(), strict=True)):
            out[r].append((a, raw[r * width : r * width + 64 * n]))
    return out


def folded(digest: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for at, others in path:
        digest = sha256(others[: 64 * at] + digest + others[64 * at :]).hexdigest().encode("ascii")
    return digest


def positions(rows: DataFrame, group: str | None, order: list[Column], scratch: Scratch, tag: str) -> DataFrame:
    """Adds ``i``, the place from 0 within the group, and ``n``, the group's rows.

    ``order`` begins with the group.  Rows are dealt by ranges and sorted, so that a group
    may span any number of tasks; each task's share of each group is counted, and the sums
    of those counts give its first place.
    """
    kept = scratch.save(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), f"{tag}-ordered", release=True)
    key = F.col(group) if group else F.lit(0)
    shares = kept.groupBy(F.shiftright("at", 33).alias("task"), key.alias("g0")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c"))
    # one row for each task of a group
    before = Window.partitionBy("g0").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.withColumn("offset", F.coalesce(F.sum("c").over(before), F.lit(0))).withColumn("n", F.sum("c").over(Window.partitionBy("g0"))).drop("c")
    shares, _ = if_small(scratch.save(shares, f"{tag}-shares"))
    kept = kept.withColumn("task0", F.shiftright("at", 33))
    return kept.join(shares, (F.col("task0") == F.col("task")) & same(key, F.col("g0"))).withColumn("i", F.col("at") - F.col("first") + F.col("offset")).drop("task", "task0", "g0", "first", "offset", "at")


def climb(nodes: DataFrame, levels: int, fanout: int, scratch: Scratch, tag: str) -> tuple[list[DataFrame], DataFrame]:
    """Tables of blocks (g, b, n, members), lowest first, and (g, level, node): the root of each tree and the table that it ends in.

    ``nodes`` has g, i, n (nodes of the tree at this height), node; other columns stay with the members.
    """
    wide = fanout**levels

    def root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_pylist()
            out = [climbed(matrix(d), depth(k, levels, fanout), fanout)[-1].tobytes().decode("ascii") for d, k in zip(batch.column("nodes").to_pylist(), n, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("i"), pa.array([-(-k // wide) for k in n], pa.int64()), pa.array(out, pa.string())], names=["g", "i", "n", "node"])

    tables, tops = [], []
    while True:
        k = len(tables)
        member = F.struct("i", "node", *[c for c in nodes.columns if c not in ("g", "i", "n", "node")])
        blocks = nodes.groupBy("g", F.expr(f"i div {wide}").alias("b"), "n").agg(F.array_sort(F.collect_list(member)).alias("members"))
        blocks = scratch.save(blocks, f"{tag}-blocks{k}", release=k == 0)
        tables.append(blocks)
        up = blocks.select("g", F.col("b").alias("i"), "n", F.col("members.node").alias("nodes")).mapInArrow(root, "g bigint, i bigint, n bigint, node string")
        up = scratch.save(up, f"{tag}-roots{k}")
        tops.append(up.where("n = 1").select("g", F.lit(k).alias("level"), "node"))
        nodes = up.where("n > 1")
        if nodes.isEmpty():
            break
    found = tops[0]
    for t in tops[1:]:
        found = found.unionByName(t)
    return tables, found


def expand(table: DataFrame, above: DataFrame, levels: int, fanout: int) -> DataFrame:
    """(g, b, path, subroot, root) for every member of the blocks, b being its place: its path in the block, then the block's."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("at", pa.int32()), ("others", pa.string())])), pa.string(), pa.string()]
        for batch in batches:
            for x in batch.to_pylist():
                tree = climbed(matrix(x["nodes"]), depth(x["n"], levels, fanout), fanout)
                own = [[{"at": a, "others": o.decode("ascii")} for a, o in p] + x["path"] for p in paths(tree, fanout)]
                m = len(own)
                columns = [[x["g"]] * m, x["places"], own, [x["subroot"]] * m, [x["root"]] * m]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["g", "b", "path", "subroot", "root"])

    blocks = table.select("g", "b", "n", F.col("members.i").alias("places"), F.col("members.node").alias("nodes"))
    return blocks.join(above, ["g", "b"]).mapInArrow(spread, f"g bigint, b bigint, path {PATH}, subroot string, root string")


def descend(tables: list[DataFrame], start: DataFrame, levels: int, fanout: int, scratch: Scratch, tag: str) -> DataFrame:
    """(g, b, path, subroot, root) for the blocks of the lowest table; ``start`` has g, level, path, subroot, root of each tree's own root."""
    found = None
    for k in range(len(tables) - 1, -1, -1):
        here = start.where(F.col("level") == k).select("g", F.lit(0).cast("bigint").alias("b"), "path", "subroot", "root")
        found = scratch.save(here if found is None else here.unionByName(found), f"{tag}-paths{k}")
        if k:
            few, _ = if_small(found)
            found = expand(tables[k], few, levels, fanout)
    return found


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, doc_id: str = "doc_id", source: str = "source", fanout: int = 3, levels: int = 6, proofs: bool = False) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row, and ``siblings`` if asked for.

    A leaf is the sha256 of the fields, encoded.  The leaves of a source ascend by doc_id
    (null first; repeated ids by their leaves); each ``fanout`` consecutive nodes become the
    digest of their hex digests, fewer at the end, even one, until a single one is left: the
    subroot, a lone leaf being its own.  Subroots, by source (null first, then by UTF-8
    bytes), give the root in the same way.  ``siblings`` are the other digests of each run
    from the leaf up to the root; proof_sha256 is the digest of them together.
    ``tampered`` replaces fields by expressions over the row; folded_root is computed from
    the leaf of what results and the siblings, and verified if it is the root.  Rows equal
    in all fields are interchangeable.  Texts may be null or empty, further columns are not
    read, and an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    kind = docs.schema[doc_id].dataType
    plain = [F.col(f) for f in fields]
    other = F.lit(None).cast("string")
    if tampered:
        differs = F.lit(False)
        for f, c in tampered.items():
            differs = differs | ~same(F.col(f), c)
        other = F.when(differs, leaf([tampered.get(f, F.col(f)) for f in fields]))
    # written first, as dealing by ranges reads its input twice; equal rows are told apart by a number, so that they can be dealt to many tasks
    leaves = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), leaf(plain).alias("node"), other.alias("other")).withColumn("tie", F.monotonically_increasing_id())
    leaves = scratch.save(leaves, "leaves", release=True)

    names = positions(leaves.select("source").distinct(), None, [F.col("source").asc_nulls_first()], scratch, "sources")
    names = scratch.save(names.select("source", F.col("i").alias("g"), F.col("n").alias("sources")), "names")
    placed = positions(leaves, "source", [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("node"), F.col("tie")], scratch, "leaves")
    few, _ = if_small(names.select(F.col("source").alias("s"), "g"))
    placed = placed.join(few, same(F.col("source"), F.col("s"))).select("g", "i", "n", "node", "doc_id", "other")
    tables, subroots = climb(placed, levels, fanout, scratch, "docs")
    subroots = scratch.save(subroots, "subroots")

    tops = subroots.join(names.select("g", "sources"), "g").select(F.lit(0).cast("bigint").alias("g"), F.col("g").alias("i"), F.col("sources").alias("n"), "node")
    source_tables, root = climb(tops, levels, fanout, scratch, "roots")
    start = root.select("g", "level", F.array().cast(PATH).alias("path"), F.lit("").alias("subroot"), F.col("node").alias("root"))
    above = descend(source_tables, start, levels, fanout, scratch, "roots")
    # the lowest table of the sources' tree holds the subroots themselves
    paths_of = scratch.save(expand(source_tables[0], above, levels, fanout).select(F.col("b").alias("g"), "path", "root"), "above")
    start = subroots.join(paths_of, "g").select("g", "level", "path", F.col("node").alias("subroot"), "root")
    low = descend(tables, scratch.save(start, "start"), levels, fanout, scratch, "docs")

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            member = batch.column("members")
            n, path, subroot, top = (batch.column(c).to_pylist() for c in ("n", "path", "subroot", "root"))
            for r in range(batch.num_rows):
                own = member[r].values
                ids, leafs, others = (own.field(f) for f in ("doc_id", "node", "other"))
                nodes = leafs.to_pylist()
                up = [(p["at"], p["others"].encode("ascii")) for p in path[r]]
                tree = climbed(matrix(nodes), depth(n[r], levels, fanout), fanout)
                whole = [p + up for p in paths(tree, fanout)]
                fold = [folded((o or d).encode("ascii"), p).decode("ascii") for o, d, p in zip(others.to_pylist(), nodes, whole, strict=True)]
                joined = [b"".join([o for _, o in p]) for p in whole]
                m = len(nodes)
                columns = [ids, leafs, pa.array([subroot[r]] * m, pa.string()), pa.array([top[r]] * m, pa.string()), pa.array([sha256(j).hexdigest() for j in joined]), pa.array(fold), pa.array([f == top[r] for f in fold], pa.bool_())]
                if proofs:
                    columns.append(pa.array([[j[k : k + 64].decode("ascii") for k in range(0, len(j), 64)] for j in joined], pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays(columns, names=names_out)

    names_out = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] + ["siblings"] * proofs
    schema = f"doc_id {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", siblings array<string>" * proofs
    few, _ = if_small(low)
    return tables[0].join(few, ["g", "b"]).select("n", "members", "path", "subroot", "root").mapInArrow(prove, schema)


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id's crc32 is even are tampered with: their texts lose the line ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return manifest(docs, {"text": F.when(even, F.regexp_replace("text", "\n", "")).otherwise(F.col("text"))})


#: crc32 by its polynomial, a table of 256 remainders made by the rule; trees by levels, all sources at once, then the sources.
ORACLE = r"""
WITH RECURSIVE remainders AS (
  SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
), marked AS (
  SELECT d.*, xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda p: ascii(substr(doc_id::VARCHAR, p, 1))::BIGINT), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 2 AS odd
  FROM documents d, remainders
), leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(after)::VARCHAR || ':' || after, '-')) AS other
  FROM (SELECT doc_id, source, text, CASE WHEN odd = 0 THEN replace(text, chr(10), '') ELSE text END AS after,
    coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-') || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS head
    FROM marked)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM leaves
), trees(level, g, i, node, n) AS (
  SELECT 0, g, i, leaf, count(*) OVER (PARTITION BY g) FROM placed
  UNION ALL
  SELECT level + 1, g, i // 3, sha256(string_agg(node, '' ORDER BY i)), (n + 2) // 3 FROM trees WHERE n > 1 GROUP BY level, g, i // 3, n
), subroots AS (
  SELECT g, max(node) AS subroot FROM trees WHERE n = 1 GROUP BY g
), tops(level, i, node, n) AS (
  SELECT 0, g, subroot, count(*) OVER () FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(node, '' ORDER BY i)), (n + 2) // 3 FROM tops WHERE n > 1 GROUP BY level, i // 3, n
), steps AS (
  SELECT level, g, t.i AS i, coalesce(string_agg(o.node, '' ORDER BY o.i) FILTER (WHERE o.i < t.i), '') AS before, coalesce(string_agg(o.node, '' ORDER BY o.i) FILTER (WHERE o.i > t.i), '') AS behind
  FROM trees t JOIN trees o USING (level, g) WHERE t.n > 1 AND t.i // 3 = o.i // 3 GROUP BY level, g, t.i
), top_steps AS (
  SELECT level, t.i AS i, coalesce(string_agg(o.node, '' ORDER BY o.i) FILTER (WHERE o.i < t.i), '') AS before, coalesce(string_agg(o.node, '' ORDER BY o.i) FILTER (WHERE o.i > t.i), '') AS behind
  FROM tops t JOIN tops o USING (level) WHERE t.n > 1 AND t.i // 3 = o.i // 3 GROUP BY level, t.i
), whole AS (
  SELECT p.g, p.i AS leaf_i, s.level, s.before, s.behind FROM placed p JOIN steps s ON s.g = p.g AND s.i = p.i // (3 ** s.level)::BIGINT
  UNION ALL
  SELECT p.g, p.i, 1000 + s.level, s.before, s.behind FROM placed p JOIN top_steps s ON s.i = p.g // (3 ** s.level)::BIGINT
), proofs AS (
  SELECT g, leaf_i AS i, sha256(string_agg(before || behind, '' ORDER BY level)) AS proof_sha256, list([before, behind] ORDER BY level) AS path FROM whole GROUP BY g, leaf_i
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM (
  SELECT p.doc_id, p.leaf, subroot, (SELECT max(node) FROM tops WHERE n = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
    list_reduce([[p.other]] || coalesce(path, []), lambda h, s: [sha256(s[1] || h[1] || s[2])])[1] AS folded_root
  FROM placed p JOIN subroots USING (g) LEFT JOIN proofs q ON q.g = p.g AND q.i = p.i)
"""
