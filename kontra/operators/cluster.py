"""Labelings: agreement, alignment, consensus; centroids and Lloyd steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontra.functions.stats import adjusted_rand


def contingency(a: DataFrame, b: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, la, lb, n of two labelings (entity, label) on the entities that both have."""
    by = by or []
    return a.withColumnRenamed("label", "la").join(b.withColumnRenamed("label", "lb"), "entity").groupBy(*by, "la", "lb").agg(F.count(F.lit(1)).alias("n"))


def agreement(a: DataFrame, b: DataFrame, by: list[str] | None = None) -> DataFrame:
    return adjusted_rand(contingency(a, b, by), by or [], "la", "lb")


def pairwise_agreement(single: DataFrame, whole: DataFrame) -> DataFrame:
    """variant_a, variant_b, shared, ari_single, ari_consensus of every two variants (variant, entity, label) on the entities that both have."""

    def pairs(t: DataFrame) -> DataFrame:
        a = t.select("entity", F.col("variant").alias("variant_a"), F.col("label").alias("la"))
        b = t.select("entity", F.col("variant").alias("variant_b"), F.col("label").alias("lb"))
        return a.join(b, "entity").where("variant_a < variant_b").groupBy("variant_a", "variant_b", "la", "lb").agg(F.count(F.lit(1)).alias("n"))

    by, one, all_ = ["variant_a", "variant_b"], pairs(single), pairs(whole)
    shared = one.groupBy(*by).agg(F.sum("n").alias("shared"))
    a = adjusted_rand(one, by, "la", "lb").withColumnRenamed("ari", "ari_single")
    return shared.join(a, by).join(adjusted_rand(all_, by, "la", "lb").withColumnRenamed("ari", "ari_consensus"), by)


def _matrix(labels: pa.Array) -> np.ndarray:
    return np.asarray(labels.flatten()).reshape(len(labels), -1)


def contingencies(labels: DataFrame, base: list[int]) -> DataFrame:
    """run, la, lb, n: each place of ``labels`` (entity, labels, as many in every row) against the place that ``base`` names for it.

    Labels of a row stand side by side, so that nothing is joined; a task sends its counts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(base), 0, 0), np.int64)
        for batch in batches:
            own = _matrix(batch.column(0)).astype(np.int64)
            more = max(0, int(own.max(initial=-1)) + 1 - total.shape[1])
            total = np.pad(total, ((0, 0), (0, more), (0, more)))
            k = total.shape[1]
            for i, j in enumerate(base if len(own) else []):
                total[i] += np.bincount(own[:, i] * k + own[:, j], minlength=k * k).reshape(k, k)
        run, la, lb = (x.astype(np.int32) for x in np.nonzero(total))
        yield pa.RecordBatch.from_arrays([pa.array(run), pa.array(la), pa.array(lb), pa.array(total[run, la, lb])], names=["run", "la", "lb", "n"])

    return labels.select("labels").mapInArrow(count, "run int, la int, lb int, n bigint").groupBy("run", "la", "lb").agg(F.sum("n").alias("n"))


def consensus_groups(labels: DataFrame, runs: int, k: int) -> DataFrame:
    """entity, labels: the consensus of each ``runs`` consecutive labels of a row, first renamed to agree with the first of them.

    What ``aligned`` and ``consensus`` give for one group after the other, without a
    join: of ``labels`` (entity, labels) only the counts of runs x k x k reach the driver.
    """
    if k > 10:
        raise ValueError("at most ten labels can be aligned")
    row = labels.select(F.size("labels")).first()
    if row is None:
        return labels
    cells = contingencies(labels, [i - i % runs for i in range(row[0])]).collect()
    tables: list[list[list[int]]] = [[[0] * k for _ in range(k)] for _ in range(row[0])]
    for r in cells:
        tables[r["run"]][r["la"]][r["lb"]] = r["n"]
    names = np.array([best_assignment(t) for t in tables], np.int16)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _matrix(batch.column(1))
            same = names[np.arange(len(names)), own].reshape(len(own), -1, runs)
            # of equals the smallest label
            best = np.stack([(same == j).sum(2) for j in range(k)]).argmax(0).astype(np.int16)
            at = pa.array(np.arange(0, best.size + 1, best.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, pa.array(best.ravel()))], names=["entity", "labels"])

    return labels.select("entity", "labels").mapInArrow(vote, f"entity {labels.schema['entity'].dataType.simpleString()}, labels array<smallint>")


def best_assignment(weight: list[list[int]]) -> list[int]:
    """Column for each row of a small square table with the greatest sum; of equals the lexicographically least."""
    k = len(weight)
    best: dict[int, int] = {(1 << k) - 1: 0}
    for mask in range((1 << k) - 2, -1, -1):
        row = bin(mask).count("1")
        best[mask] = max(weight[row][c] + best[mask | 1 << c] for c in range(k) if not mask >> c & 1)
    out, mask = [], 0
    for row in range(k):
        c = next(c for c in range(k) if not mask >> c & 1 and weight[row][c] + best[mask | 1 << c] == best[mask])
        out.append(c)
        mask |= 1 << c
    return out


def aligned(runs: DataFrame, k: int) -> DataFrame:
    """Runs (run, entity, label) renamed to agree with run 0 as far as possible.

    Counting is distributed; only runs x k x k counts, k at most 10, reach the driver.
    """
    if k > 10:
        raise ValueError("at most ten labels can be aligned")
    base = runs.where("run = 0").select("entity", F.col("label").alias("ref"))
    rows = runs.join(base, "entity").groupBy("run", "label", "ref").agg(F.count(F.lit(1)).alias("n")).collect()
    tables: dict[int, list[list[int]]] = {}
    for r in rows:
        tables.setdefault(r["run"], [[0] * k for _ in range(k)])[r["label"]][r["ref"]] = r["n"]
    names = [(run, label, to) for run, t in tables.items() for label, to in enumerate(best_assignment(t))]
    spec = runs.sparkSession.createDataFrame(names, f"run {runs.schema['run'].dataType.simpleString()}, label int, to int")
    return runs.join(F.broadcast(spec), ["run", "label"]).select("run", "entity", F.col("to").alias("label"))


def consensus(runs: DataFrame) -> DataFrame:
    """entity, label (majority, ties to the smallest), strength (its share of the runs)."""
    votes = runs.groupBy("entity", "label").agg(F.count(F.lit(1)).alias("n"))
    g = votes.groupBy("entity").agg(F.max(F.struct(F.col("n"), (-F.col("label")).alias("m"))).alias("top"), F.sum("n").alias("all"))
    return g.select("entity", (-F.col("top.m")).alias("label"), (F.col("top.n") / F.col("all")).alias("strength"))


def strength_by_module(labels: DataFrame) -> DataFrame:
    s = F.col("strength")
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("entities"), F.avg(s).alias("mean"), F.percentile(s, 0.5).alias("median"), (100.0 * F.avg((s >= 0.8).cast("double"))).alias("pct_core"), (100.0 * F.avg((s < 0.5).cast("double"))).alias("pct_ambiguous"))


def size_variation(runs: DataFrame) -> DataFrame:
    sizes = runs.groupBy("run", "label").agg(F.count(F.lit(1)).alias("n"))
    t = sizes.groupBy("label").agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"), F.min("n").alias("least"), F.max("n").alias("most"))
    return t.withColumn("cv", F.try_divide(F.col("sd"), F.col("mean")))


def overlap_matrix(a: DataFrame, b: DataFrame) -> DataFrame:
    """la, lb, n and the Jaccard similarity of every two modules that share entities."""
    c = contingency(a, b)
    sa = a.groupBy(F.col("label").alias("la")).agg(F.count(F.lit(1)).alias("na"))
    sb = b.groupBy(F.col("label").alias("lb")).agg(F.count(F.lit(1)).alias("nb"))
    t = c.join(sa, "la").join(sb, "lb")
    return t.select("la", "lb", "n", (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("jaccard"))


def robust(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys in both, only in the first and only in the second table."""
    x, y = a.select(*keys), b.select(*keys)
    tag = lambda df, w: df.withColumn("found_in", F.lit(w))
    return tag(x.intersect(y), "both").unionByName(tag(x.subtract(y), "first")).unionByName(tag(y.subtract(x), "second"))


def robust_pairs(first: DataFrame, second: DataFrame, threshold: float = 0.05) -> DataFrame:
    """a, b, found_in, and percentile, q and correlation of both tables, for pairs (a, b, percentile_vs_null, q, pearson) with q below the threshold in one or both."""
    side = lambda t, n: t.select("a", "b", *[F.col(c).alias(f"{n}_{c}") for c in ("percentile_vs_null", "q", "pearson")])
    t = side(first, "first").join(side(second, "second"), ["a", "b"], "full")
    x, y = (F.coalesce(F.col(f"{n}_q") < threshold, F.lit(False)) for n in ("first", "second"))
    return t.where(x | y).withColumn("found_in", F.when(x & y, "both").when(x, "first").otherwise("second"))


def squared_distance(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def centroids(points: DataFrame, label: str) -> DataFrame:
    """label, centre: means by dimension; partial sums meet, never whole groups."""
    e = points.select(F.col(label).alias("label"), F.posexplode("x").alias("d", "v"))
    m = e.groupBy("label", "d").agg(F.avg("v").alias("v"))
    return m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda s: s.v).alias("centre"))


def nearest(points: DataFrame, centres: DataFrame) -> DataFrame:
    """id, label (nearest centre, ties to the smallest), distance; ``centres`` is a handful of rows."""
    table = centres.groupBy().agg(F.array_sort(F.collect_list(F.struct("label", "centre"))).alias("cs"))
    t = points.crossJoin(F.broadcast(table))
    best = F.array_min(F.transform("cs", lambda c: F.struct(squared_distance(F.col("x"), c.centre).alias("d"), c.label.alias("label"))))
    return t.select("id", "x", best.alias("b")).select("id", "x", F.col("b.label").alias("label"), F.col("b.d").alias("distance"))


def lloyd(points: DataFrame, k: int, steps: int) -> DataFrame:
    """k-means with the k points of least id as first centres and a fixed number of steps."""
    first = points.orderBy("id").limit(k).select((F.row_number().over(Window.orderBy("id")) - 1).alias("label"), F.col("x").alias("centre"))
    out = nearest(points, first)
    for _ in range(steps):
        out = nearest(points, centroids(out, "label"))
    return out


def blocks(labels: DataFrame) -> DataFrame:
    """module, first, last, middle: the rows each module takes once entities stand in module order; counts only, no sort of entities."""
    before = Window.orderBy("module").rowsBetween(Window.unboundedPreceding, -1)
    n = labels.groupBy("module").agg(F.count(F.lit(1)).alias("n"))
    t = n.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return t.select("module", "first", (F.col("first") + F.col("n") - 1).alias("last"), (F.col("first") + F.col("n") / 2).alias("middle"))


def with_selection(stability: DataFrame, selection: DataFrame, config: str) -> DataFrame:
    """Every k of the stability sweep with the BIC that model selection (k, config, bic) gives that configuration, null if none."""
    return stability.join(F.broadcast(selection.where(F.col("config") == config).select("k", "bic")), "k", "left")
