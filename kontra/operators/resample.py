"""Resampling with reproducible randomness: all repetitions run in one job, keyed by md5."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kontra.functions.ranks import numbered, numbered_by_key
from kontra.functions.stats import adjusted_rand, draw, keyed, pearson


#: Values this close are ties: sums in another order differ in their last digits.
TIE = 1e-9


def repetitions(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("rep"))


def shuffled_labels(labels: DataFrame, reps: DataFrame) -> DataFrame:
    """rep, entity, module: the labels dealt anew over the entities, sizes preserved.

    Entities in md5 order take the labels in entity order, so a repetition is a
    permutation; neither order is taken in one task.
    """
    dealt = labels.select("entity").crossJoin(F.broadcast(reps)).withColumn("_k", keyed(F.col("rep"), F.col("entity")))
    dealt = numbered_by_key(dealt, ["rep"], "_k", [F.col("entity")], "i").select("rep", "entity", "i")
    # the labels in entity order are the same in every repetition
    return dealt.join(numbered(labels.select("entity", "module"), [], [F.col("entity")], "i").select("i", "module"), "i").select("rep", "entity", "module")


def shuffled_columns(matrix: DataFrame, reps: DataFrame, value: str) -> DataFrame:
    """rep, entity, condition, value: each condition's values permuted over the entities on its own."""
    t = matrix.select("entity", "condition").crossJoin(F.broadcast(reps)).withColumn("_k", keyed(F.col("rep"), F.col("condition"), F.col("entity")))
    t = numbered_by_key(t, ["rep", "condition"], "_k", [F.col("entity")], "i").select("rep", "condition", "entity", "i")
    own = numbered(matrix.select("entity", "condition", value), ["condition"], [F.col("entity")], "i").select("condition", "i", value)
    return t.join(own, ["condition", "i"]).select("rep", "entity", "condition", value)


def permuted(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """Place of each number in [0, n) in a permutation of them that the key tells: rounds of a Feistel network, walked until the place is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low, size = np.uint64((1 << half) - 1), np.uint64(half)
    keys = np.random.Generator(np.random.PCG64(key)).integers(1, 1 << 63, 6, dtype=np.uint64)
    out, left = i.astype(np.uint64), np.arange(len(i))
    with np.errstate(over="ignore"):
        while len(left):
            a, b = out[left] >> size, out[left] & low
            for k in keys:
                h = (b + k) * np.uint64(0x9E3779B97F4A7C15)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                a, b = b, a ^ (h >> np.uint64(64 - half))
            out[left] = a << size | b
            left = left[out[left] >= np.uint64(n)]
    return out.astype(np.int64)


#: Places of a shuffled matrix that are put together in one block.
PLACES = 4096


def shuffled_vectors(rows: DataFrame, reps: int) -> DataFrame:
    """id, grp (from 1), x: in each repetition every dimension's values permuted over the rows (id, x) on its own.

    Rows are numbered once; a value's new place is a permutation of its row's number, so
    nothing is sorted.  Values go to blocks of places as bytes, a block to one task.
    """
    told = numbered(rows.select(F.col("id").cast("bigint"), "x"), [], [F.col("id")], "i").select("id", (F.col("i") - 1).cast("bigint").alias("i"), "x").persist()
    n = told.count()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, i = (np.asarray(batch.column(c)).astype(np.int64) for c in (0, 1))
            x = np.asarray(batch.column(2).flatten()).reshape(len(i), -1)
            for rep in range(reps):
                # the last column holds the ids, which stay in their places
                columns = [(d, permuted(i, n, rep * x.shape[1] + d), x[:, d]) for d in range(x.shape[1])] + [(x.shape[1], i, ids)]
                for d, place, value in columns:
                    order = np.argsort(place // PLACES, kind="stable")
                    place, value = place[order], value[order]
                    block, first = np.unique(place // PLACES, return_index=True)
                    last = [*first[1:], len(place)]
                    parts = [pa.array([v[lo:hi].tobytes() for lo, hi in zip(first, last, strict=True)], pa.binary()) for v in (place, value)]
                    yield pa.RecordBatch.from_arrays([pa.array([rep + 1] * len(block), pa.int32()), pa.array(block), pa.array([d] * len(block), pa.int32()), *parts], names=["grp", "block", "d", "place", "value"])

    def gather(key: tuple, parts: pa.Table) -> pa.Table:
        rep, block = key[0].as_py(), key[1].as_py()
        size, dim = min(PLACES, n - block * PLACES), pc.max(parts["d"]).as_py()
        x, ids = np.empty((size, dim)), np.empty(size, np.int64)
        for d, place, value in zip(*(parts[c].to_pylist() for c in ("d", "place", "value")), strict=True):
            at = np.frombuffer(place, np.int64) - block * PLACES
            if d == dim:
                ids[at] = np.frombuffer(value, np.int64)
            else:
                x[at, d] = np.frombuffer(value)
        at = pa.array(np.arange(0, x.size + 1, dim, dtype=np.int32))
        return pa.table({"id": ids, "grp": pa.array(np.full(size, rep, np.int32)), "x": pa.ListArray.from_arrays(at, pa.array(x.ravel()))})

    dealt = told.mapInArrow(deal, "grp int, block bigint, d int, place binary, value binary")
    return dealt.groupBy("grp", "block").applyInArrow(gather, "id bigint, grp int, x array<double>")


def null_cells(hits: DataFrame, shuffled: DataFrame, contrast: DataFrame) -> DataFrame:
    """Observed counts of rep x condition x module under shuffled labels, dense, with margins."""
    o = hits.select("entity", "condition").join(shuffled, "entity").groupBy("rep", "condition", "module").agg(F.count(F.lit(1)).alias("observed"))
    sizes = shuffled.groupBy("rep", "module").agg(F.count(F.lit(1)).alias("size"))
    grid = sizes.crossJoin(F.broadcast(contrast.select("condition").distinct()))
    t = grid.join(o, ["rep", "condition", "module"], "left").fillna(0, ["observed"])
    t = t.withColumn("detected", F.sum("observed").over(Window.partitionBy("rep", "condition")))
    return t.withColumn("universe", F.sum("size").over(Window.partitionBy("rep", "condition")))


def empirical(observed: DataFrame, null: DataFrame, on: list[str], value: str) -> DataFrame:
    """Plus-one p value, percentile and mean of each observed value against its null values."""
    n = null.select(*on, F.col(value).alias("_null"))
    t = observed.join(n, on).groupBy(*on, value)
    return t.agg(
        ((F.count_if(F.col("_null") >= F.col(value) - TIE) + 1) / (F.count(F.lit(1)) + 1)).alias("p_empirical"),
        (100.0 * F.count_if(F.col("_null") < F.col(value) - TIE) / F.count(F.lit(1))).alias("percentile_vs_null"),
        F.avg("_null").alias("null_mean"),
    )


def null_summary(null: DataFrame, value: str) -> DataFrame:
    q = F.percentile(value, [0.05, 0.5, 0.95])
    t = null.groupBy().agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), q.alias("q"))
    return t.select("mean", "sd", F.col("q")[0].alias("q05"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q95"))


def draws(entities: DataFrame, reps: DataFrame) -> DataFrame:
    """rep, entity, copies: as many entities as there are, drawn with replacement in each repetition."""
    e = numbered(entities.select("entity"), [], [F.col("entity")], "i").withColumn("i", F.col("i") - 1)
    n = entities.agg(F.count(F.lit(1)).alias("n"))
    taken = e.select("i").crossJoin(F.broadcast(n)).crossJoin(F.broadcast(reps)).select("rep", draw(F.col("n"), F.col("rep"), F.col("i")).alias("i")).groupBy("rep", "i").agg(F.count(F.lit(1)).alias("copies"))
    return taken.join(e, "i").select("rep", "entity", "copies")


def bootstrap_ci(per_rep: DataFrame, on: list[str], value: str) -> DataFrame:
    q = F.percentile(value, [0.025, 0.975])
    t = per_rep.groupBy(*on).agg(q.alias("q"), F.count(value).alias("reps"))
    return t.select(*on, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "reps").withColumn("excludes_zero", ~((F.col("low") < 0) & (F.col("high") > 0)))


def bootstrap_cells(hits: DataFrame, labels: DataFrame, drawn: DataFrame, contrast: DataFrame) -> DataFrame:
    """Weighted observed counts of rep x condition x module under resampled entities."""
    lab = drawn.join(labels.select("entity", "module"), "entity")
    o = hits.select("entity", "condition").join(lab, "entity").groupBy("rep", "condition", "module").agg(F.sum("copies").alias("observed"))
    sizes = lab.groupBy("rep", "module").agg(F.sum("copies").alias("size"))
    t = sizes.crossJoin(F.broadcast(contrast.select("condition").distinct())).join(o, ["rep", "condition", "module"], "left").fillna(0, ["observed"])
    t = t.withColumn("detected", F.sum("observed").over(Window.partitionBy("rep", "condition")))
    return t.withColumn("universe", F.sum("size").over(Window.partitionBy("rep", "condition")))


def attribute_permutation(pairs: DataFrame, attributes: DataFrame, value: str, reps: DataFrame) -> DataFrame:
    """Same-minus-different mean gap of a condition attribute, and its two-sided plus-one p over permuted attributes.

    pairs: a, b, value.  attributes: condition, attribute (one row for each condition).
    """
    # a row for each condition, so one array holds them all: a repetition is a row, whatever the number of repetitions
    held = attributes.groupBy().agg(F.array_sort(F.collect_list(F.struct("condition", "attribute"))).alias("own"))
    order = lambda r: F.array_sort(F.transform("own", lambda x: F.struct(keyed(r, x.condition).alias("k"), x.condition.alias("condition"))))
    deal = lambda r: F.map_from_arrays(F.transform(order(r), lambda x: x.condition), F.transform("own", lambda x: x.attribute))
    plain = F.map_from_arrays(F.transform("own", lambda x: x.condition), F.transform("own", lambda x: x.attribute))
    every = reps.select("rep").crossJoin(F.broadcast(held)).select("rep", deal(F.col("rep")).alias("of"))
    every = every.unionByName(held.select(F.lit(-1).alias("rep"), plain.alias("of")))
    j = every.crossJoin(F.broadcast(pairs.groupBy().agg(F.collect_list(F.struct("a", "b", F.col(value).alias("v"))).alias("ps"))))
    j = j.select("rep", F.inline(F.transform("ps", lambda p: F.struct(F.element_at("of", p.a).alias("ta"), F.element_at("of", p.b).alias("tb"), p.v.alias(value)))))
    v, same = F.col(value), F.col("ta") == F.col("tb")
    gap = j.groupBy("rep").agg((F.avg(F.when(same, v)) - F.avg(F.when(~same, v))).alias("gap")).where("gap is not null")
    seen = gap.where("rep = -1").select(F.col("gap").alias("observed"))
    null = gap.where("rep >= 0").crossJoin(F.broadcast(seen))
    return null.groupBy("observed").agg(((F.count_if(F.abs("gap") >= F.abs("observed") - TIE) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"), F.count(F.lit(1)).alias("valid"))


def subsamples(entities: DataFrame, reps: DataFrame, fraction: float) -> DataFrame:
    """rep, entity: int(n * fraction) entities without replacement in each repetition."""
    if not 0.5 <= fraction < 1:
        raise ValueError("the fraction lies in [0.5, 1)")
    n = entities.agg(F.count(F.lit(1)).alias("n"))
    t = entities.select("entity").crossJoin(F.broadcast(n)).crossJoin(F.broadcast(reps)).withColumn("_k", keyed(F.col("rep"), F.col("entity")))
    t = numbered_by_key(t, ["rep"], "_k", [F.col("entity")], "j")
    return t.where(F.col("j") <= F.floor(F.col("n") * fraction)).select("rep", "entity")


def stability(runs: DataFrame) -> DataFrame:
    """ARI of every two runs (run, entity, label) on the entities that both have."""
    a = runs.select("entity", F.col("run").alias("run_a"), F.col("label").alias("la"))
    b = runs.select("entity", F.col("run").alias("run_b"), F.col("label").alias("lb"))
    c = a.join(b, "entity").where("run_a < run_b").groupBy("run_a", "run_b", "la", "lb").agg(F.count(F.lit(1)).alias("n"))
    shared = c.groupBy("run_a", "run_b").agg(F.sum("n").alias("shared"))
    return adjusted_rand(c, ["run_a", "run_b"], "la", "lb").join(shared, ["run_a", "run_b"])


def bootstrap_ari(fit: Callable, assign: Callable, reps: int) -> DataFrame:
    """mean, sd, n: agreement of models of resampled rows with the model of all rows, on all rows.

    ``fit`` takes resamples (None: all rows) and gives a model for each, in the same
    passes where it can; ``assign`` takes models and gives run, entity, label.
    """
    found = fit([None, *range(reps)])
    boots = [found[r] for r in range(reps) if r in found]
    reference = assign([found[None]]).select("entity", "label")
    c = assign(boots).join(reference.withColumnRenamed("label", "lb"), "entity").groupBy("run", F.col("label").alias("la"), "lb").agg(F.count(F.lit(1)).alias("n"))
    return adjusted_rand(c, ["run"], "la", "lb").agg(F.avg("ari").alias("mean"), F.stddev_pop("ari").alias("sd"), F.count("ari").alias("n"))


def correlate(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*by).agg(pearson(F.col(x), F.col(y)).alias("r"))
