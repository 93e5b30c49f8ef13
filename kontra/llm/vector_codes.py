"""Operator 11: compression of vectors into codes, the codebooks fitted by Yinyang Lloyd.

A codebook's entries are cut into a few groups.  A vector's part keeps, from round to
round, its entry and one lower bound for each group: no other entry of the group is
nearer.  When entries move, a bound falls by the greatest move in its group; while it
stays above the distance to the own entry the group is skipped.  The others are scanned
in whole numbers, which decide ties, so that the codes are those of plain Lloyd.  A round
is one pass over a written table; each task leaves its sums beside its rows, and a row
for each component of the codebooks, whatever the number of vectors, reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontra.llm.learn import ragged
from kontra.llm.scratch import Scratch, if_small, same

UNIT = 4096
#: The bound of a group without other entries.
FREE = np.float32(3e38)
#: Whole numbers are added up in limbs of so many bits once they are large.
LIMB = 40
LONGEST = 2**63 - 1


def whole(x: np.ndarray) -> np.ndarray:
    """floor(4096 x): 64-bit numbers, or Python's if some are too large for squares of differences."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x.astype(np.float64) * UNIT)
    if not scaled.size or np.abs(scaled).max() < 2.0**25:
        return scaled.astype(np.int64)
    flat = [int(v) * UNIT if abs(v) > 2.0**60 else math.floor(v * UNIT) for v in x.astype(np.float64).ravel().tolist()]
    out = np.empty(len(flat), dtype=object)
    out[:] = flat
    return out.reshape(x.shape)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return (d * d).sum(axis=-1)


def root_down(d: np.ndarray) -> np.ndarray:
    """A 32-bit number not above the square root."""
    return np.nextafter((np.sqrt(d.astype(np.float64)) * (1 - 1e-12)).astype(np.float32), np.float32(-1))


@dataclass
class Codebooks:
    """``entries[part, entry, position]`` in whole numbers; ``group[part, entry]``; ``drift[part, group]`` since the last round."""

    entries: np.ndarray
    group: np.ndarray
    drift: np.ndarray

    @property
    def plain(self) -> bool:
        return self.entries.dtype != object

    def digest(self) -> str:
        return sha256(",".join(str(int(x)) for x in self.entries.ravel()).encode()).hexdigest()

    def moved(self, sums: np.ndarray) -> Codebooks:
        """Entries at the floored means of their parts (sums[..., -1] counts them); unused ones stay."""
        entries = self.entries.astype(object)
        for p, j in np.ndindex(*entries.shape[:2]):
            if n := int(sums[p, j, -1]):
                entries[p, j] = [int(s) // n for s in sums[p, j, :-1]]
        moves = squares(entries, self.entries.astype(object))
        drift = np.zeros(self.drift.shape)
        for p, g in np.ndindex(*drift.shape):
            far = max((moves[p, j] for j in np.flatnonzero(self.group[p] == g)), default=0)
            drift[p, g] = math.sqrt(far) * (1 + 1e-12) if far < 1 << 1000 else np.inf
        return Codebooks(narrowed(entries), self.group, drift)


def narrowed(entries: np.ndarray) -> np.ndarray:
    return entries.astype(np.int64) if max((abs(int(x)) for x in entries.ravel()), default=0) < 1 << 25 else entries


def grouped(entries: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """Entries of each part clustered into ``groups`` at most, by a few rounds of Lloyd."""
    out = np.zeros(entries.shape[:2], dtype=np.int64)
    for p, points in enumerate(entries.astype(np.float64)):
        points = np.clip(points, -1e100, 1e100)
        centres = points[:: max(1, -(-len(points) // groups))]
        for _ in range(rounds):
            out[p] = ((points[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
            centres = np.array([points[out[p] == g].mean(axis=0) if (out[p] == g).any() else centres[g] for g in range(len(centres))])
    return out


def assign(x: np.ndarray, code: np.ndarray, low: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(codes, squared distances, lower bounds, distances computed) of rows x[row, part, position] whose last codes and bounds are given."""
    n, parts, _ = x.shape
    plain = x.dtype != object and books.plain
    code, low, error, scanned = code.copy(), low.copy(), np.zeros((n, parts), dtype=np.int64 if plain else object), 0
    for p in range(parts):
        entries, own = books.entries[p], x[:, p]
        if not plain:
            entries, own = entries.astype(object), own.astype(object)
        old = code[:, p].astype(np.int64)
        held = squares(own, entries[old]) if n else np.zeros(0, dtype=np.int64)
        best, to = held.copy(), old.copy()
        scanned += n
        bound = low[:, p] - books.drift[p]
        if plain:
            above = np.sqrt(held.astype(np.float64)) * (1 + 1e-12)
            need = ~(bound > above[:, None])
        else:
            need = np.ones(bound.shape, dtype=bool)
        seen = []
        for g in range(bound.shape[1]):
            rows, js = np.flatnonzero(need[:, g]), np.flatnonzero(books.group[p] == g)
            if not len(rows) or not len(js):
                continue
            d = squares(own[rows, None, :], entries[js])
            scanned += d.size
            first = d.argmin(axis=1)
            at, least = js[first], d[np.arange(len(rows)), first]
            nearer = (least < best[rows]) | ((least == best[rows]) & (at < to[rows]))
            best[rows[nearer]], to[rows[nearer]] = least[nearer], at[nearer]
            seen.append((g, rows, js, d))
        if plain:
            bound = np.where(bound > 0, np.nextafter(bound.astype(np.float32), np.float32(-1)), np.float32(0))
            # the entry that was left is another one of its group now
            left = np.flatnonzero(to != old)
            g = books.group[p][old[left]]
            bound[left, g] = np.minimum(bound[left, g], root_down(held[left]))
            for g, rows, js, d in seen:
                others = np.where(js == to[rows, None], LONGEST, d).min(axis=1)
                bound[rows, g] = np.where(others == LONGEST, FREE, root_down(others))
            low[:, p] = bound
        else:
            low[:, p] = 0
        code[:, p], error[:, p] = to, best
    return code, error, low, scanned


def limbs(total: int) -> list[tuple[int, int]]:
    """(limb, share) with total = sum of share << (LIMB * limb)."""
    sign, total, out, k = (-1 if total < 0 else 1), abs(total), [], 0
    while total:
        out.append((k, sign * (total & ((1 << LIMB) - 1))))
        total, k = total >> LIMB, k + 1
    return out


SUMS = pa.list_(pa.struct([("key", pa.int64()), ("limb", pa.int32()), ("share", pa.int64())]))


def usable(vectors: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """Rows whose vector is whole, and its length: the most frequent one (of equals the longer)."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.withColumn("v", F.col(vector)).where(F.col("v").isNotNull() & finite)
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = most["d"] if most else 0
    return rows.where(F.size("v") == dim), dim


def fit(vectors: DataFrame, scratch: Scratch, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, groups: int = 4) -> tuple[DataFrame, Codebooks | None, list[int]]:
    """(rows with codes and errors, codebooks, distances computed in each pass).

    Rows: vec_id, label, code (a byte a part), error.
    """
    names = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    rows, dim = usable(names, "vector")
    rows = rows.select("vec_id", "label", "v")
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields]
    if not dim or dim % parts:
        return scratch.spark.createDataFrame([], f"{kinds[0]}, {kinds[1]}, code binary, error bigint"), None, []
    ids = [r[0] for r in rows.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()]
    known = [i for i in ids if i is not None]
    here = F.col("vec_id").isin(known) if known else F.lit(False)
    seeds = rows.where(here | F.col("vec_id").isNull() if len(known) < len(ids) else here).groupBy("vec_id").agg(F.min("v").alias("v"))
    first = np.array([r["v"] for r in seeds.orderBy(F.col("vec_id").asc_nulls_last()).collect()], dtype=np.float64)
    size = dim // parts
    start = whole(first).reshape(len(first), parts, size).transpose(1, 0, 2)
    group = grouped(start, groups)
    books = Codebooks(narrowed(start.astype(object)), group, np.zeros((parts, int(group.max()) + 1)))
    width, count = books.drift.shape[1], len(first)

    def step(books: Codebooks, final: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, scanned, read = np.zeros((parts, count, size + 1), dtype=object), 0, False
            for batch in batches:
                read = read or batch.num_rows > 0
                schema = batch.schema
                for lo in range(0, batch.num_rows, 8192):
                    some = batch.slice(lo, 8192)
                    n = some.num_rows
                    x = whole(ragged(some.column("v"))[0]).reshape(n, parts, size)
                    if "code" in schema.names:
                        code = np.frombuffer(b"".join(some.column("code").to_pylist()), dtype=np.uint8).reshape(n, parts)
                        low = np.frombuffer(b"".join(some.column("low").to_pylist()), dtype=np.float32).reshape(n, parts, width)
                    else:
                        code, low = np.zeros((n, parts), dtype=np.uint8), np.zeros((n, parts, width), dtype=np.float32)
                    code, error, low, did = assign(x, code, low, books)
                    scanned += did
                    binary = pa.array([r.tobytes() for r in code], pa.binary())
                    if final:
                        total = [min(int(e), LONGEST) for e in error.astype(object).sum(axis=1)]
                        yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("label"), binary, pa.array(total, pa.int64())], names=["vec_id", "label", "code", "error"])
                        continue
                    for p, j in np.ndindex(parts, count):
                        mine = x[code[:, p] == j, p]
                        if len(mine):
                            sums[p, j, :-1] += mine.sum(axis=0).astype(object)
                            sums[p, j, -1] += len(mine)
                    yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("label"), some.column("v"), binary, pa.array([r.tobytes() for r in low], pa.binary()), pa.nulls(n, SUMS)], names=["vec_id", "label", "v", "code", "low", "sums"])
            if read and not final:
                shares = [{"key": k, "limb": at, "share": s} for k, t in enumerate(sums.ravel().tolist()) for at, s in limbs(t)]
                shares.append({"key": -1, "limb": 0, "share": scanned})
                yield pa.RecordBatch.from_arrays([pa.nulls(1, schema.field("vec_id").type), pa.nulls(1, schema.field("label").type), pa.nulls(1, schema.field("v").type), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([shares], SUMS)], names=["vec_id", "label", "v", "code", "low", "sums"])

        return run

    work, state = [], rows
    for k in range(rounds):
        schema = ", ".join([*kinds, "code binary", "low binary", "sums array<struct<key:bigint,limb:int,share:bigint>>"])
        kept = scratch.save(state.mapInArrow(step(books, False), schema), f"round{k}", release=True)
        if k:
            scratch.drop(f"round{k - 1}")
        sums, scanned = np.zeros(parts * count * (size + 1), dtype=object), 0
        for r in kept.where("sums is not null").select(F.explode("sums").alias("s")).groupBy("s.key", "s.limb").agg(F.sum("s.share").alias("share")).collect():
            if r["key"] < 0:
                scanned = r["share"]
            else:
                sums[r["key"]] += r["share"] << (LIMB * r["limb"]) if r["share"] >= 0 else -(-r["share"] << (LIMB * r["limb"]))
        work.append(scanned)
        books = books.moved(sums.reshape(parts, count, size + 1))
        state = kept.where("sums is null").drop("sums")
    coded = scratch.save(state.mapInArrow(step(books, True), f"{kinds[0]}, {kinds[1]}, code binary, error bigint"), "coded", release=True)
    if rounds:
        scratch.drop(f"round{rounds - 1}")
    return coded, books, work


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, groups: int = 4) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable vector.

    A component x counts as floor(4096 x), at any size.  Vectors are cut into ``parts``
    equal parts; each part has a codebook, first that part of the ``entries`` smallest
    vec_ids' vectors (of rows with one id the least; a null id is the last), then moved
    by ``rounds`` of Lloyd: nearest entry, ties to the lower index; floored means; unused
    entries stay.  ``code`` has two hex digits a part, ``error`` the squared distances
    over all parts, ``label_error`` the errors of all rows with that label (nulls together);
    sums over 2^63 - 1 stay there.  Rows go whose vector is null, holds null, NaN or an
    infinite number, or has another length than most (all go if that is no multiple of
    ``parts``, 0 included).  Repeated rows are coded alike; an empty table gives an empty
    one; further columns are not read.
    """
    scratch = Scratch(vectors.sparkSession, "codes")
    coded, books, _ = fit(vectors, scratch, vec_id, vector, label, parts, entries, rounds, groups)
    per = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("bigint").alias("label_error"))
    per, _ = if_small(scratch.save(per, "labels").withColumnRenamed("label", "l"))
    out = coded.join(per, same(F.col("label"), F.col("l")))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest() if books else "").alias("codebooks_sha256"))


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Plain Lloyd: all distances of every round, one pair of tables a round."""
    nearest = "list_min(list_transform(range(0, {n}), lambda j: [list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[j + 1][i])::HUGEINT * (x[i] - c[j + 1][i]))), j]))"
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda v: floor(4096 * v::DOUBLE)::BIGINT) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)",
        f"pieces AS MATERIALIZED (SELECT vec_id, label, p, q[p * (len(q) // {parts}) + 1 : (p + 1) * (len(q) // {parts})] AS x FROM kept, range({parts}) r(p))",
        f"book0 AS MATERIALIZED (SELECT p, list(x ORDER BY vec_id) AS c FROM pieces WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}) GROUP BY p)",
    ]
    for k in range(rounds + 1):
        steps.append(f"near{k} AS MATERIALIZED (SELECT vec_id, label, p, x, {nearest.format(n='len(c)')} AS b FROM pieces JOIN book{k} USING (p))")
        if k < rounds:
            steps.append(f"mean{k} AS (SELECT p, j, list(m ORDER BY i) AS e FROM (SELECT p, b[2] AS j, i, (sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM near{k}, range(1, 1 + (SELECT max(len(x)) FROM pieces)) r(i) GROUP BY ALL) GROUP BY p, j)")
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT p, list(coalesce(e, c[j + 1]) ORDER BY j) AS c FROM (SELECT b.p, j, c, e FROM (SELECT p, c, unnest(range(0, len(c))) AS j FROM book{k}) b LEFT JOIN mean{k} m USING (p, j)) GROUP BY p)")
    return f"""WITH {", ".join(steps)},
coded AS (SELECT vec_id, label, string_agg(printf('%02x', b[2]::BIGINT), '' ORDER BY p) AS code, sum(b[1])::BIGINT AS error FROM near{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(flatten(c), ','), ',' ORDER BY p)) FROM book{rounds}) AS codebooks_sha256 FROM coded"""


ORACLE = _oracle()
