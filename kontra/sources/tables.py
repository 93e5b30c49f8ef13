"""Tables, and the contrast table that stands for one file of effect sizes per condition."""

from __future__ import annotations

import hashlib

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_kept: dict[tuple[str, str, str], tuple[str, DataFrame]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(spark: SparkSession, sf_dir: str) -> str:
    """Names, sizes and times of the files below a folder, hashed: another text once one of them is written anew."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    each = sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in store.listStatus(path)) if store.exists(path) else []
    return hashlib.md5("\n".join(each).encode()).hexdigest()


def kept(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A table that many queries of a session read; recomputed from its lineage if an executor is lost.

    It is made anew if the folder's files have changed, and let go by ``release``.
    """
    key, state = (spark.sparkContext.applicationId, sf_dir, name), written(spark, sf_dir)
    if key in _kept and _kept[key][0] != state:
        release(spark, sf_dir)
    if key not in _kept:
        _kept[key] = (state, make().persist(StorageLevel.MEMORY_AND_DISK))
    return _kept[key][1]


def release(spark: SparkSession, sf_dir: str | None = None) -> None:
    """Lets go of the kept tables of a folder, or of all, and of those of sessions that have ended."""
    own = spark.sparkContext.applicationId
    for app, at, name in list(_kept):
        if app != own or sf_dir in (None, at):
            _, df = _kept.pop((app, at, name))
            if app == own:
                df.unpersist()


def row_number_by_value(df: DataFrame, group: str, value: str, ties: list[Column], name: str, steps: float = 64.0) -> DataFrame:
    """Adds the row number within ``group`` by ``value`` descending, then ``ties``.

    A window over the group alone would sort a whole group in one task.  Here values
    fall into steps; a row's number is the count of rows in higher steps (a small
    aggregate) plus its number within its own step.
    """
    step = F.floor(F.col(value) * steps).cast("bigint")
    df = df.withColumn("_step", step)
    above = Window.partitionBy(group).orderBy(F.col("_step").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(group, "_step").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(group, "_step", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"))
    own = Window.partitionBy(group, "_step").orderBy(F.col(value).desc(), *ties)
    return df.join(offsets, [group, "_step"]).withColumn(name, F.row_number().over(own) + F.col("_above")).drop("_step", "_above")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, condition, n, effect, mean_level of every part and condition it occurs in.

    Conditions are order priorities and market segments; the effect is the log2 ratio
    of the mean price under the condition to the mean price under the others.  Sums are
    exact decimals, so that they don't depend on the order of addition.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("entity"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    joined = items.join(orders, items.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    small = joined.groupBy("entity", "o_orderpriority", "c_mktsegment").agg(F.sum("price").alias("s"), F.count(F.lit(1)).alias("n"))
    both = small.select("entity", "s", "n", F.explode(F.array("o_orderpriority", "c_mktsegment")).alias("condition"))
    cell = both.groupBy("entity", "condition").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    # a row counts under one priority and one segment, so the cells of an entity add up to twice its total
    whole = Window.partitionBy("entity")
    cell = cell.withColumn("all_s", F.sum("s").over(whole) / 2).withColumn("all_n", F.sum("n").over(whole) / 2)
    inside = F.col("s").cast("double") / F.col("n")
    outside = (F.col("all_s") - F.col("s")).cast("double") / (F.col("all_n") - F.col("n"))
    return cell.where("all_n > n").select("entity", "condition", "n", F.log2(inside / outside).alias("effect"), F.log2(inside).alias("mean_level"))


def all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "cells", lambda: cells(spark, sf_dir))


def ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """condition, ord: the declared (alphabetical) order of conditions; one row for each condition."""
    names = all_cells(spark, sf_dir).select("condition").distinct()
    return names.withColumn("ord", F.row_number().over(Window.orderBy("condition")))


def contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, condition, ord, effect, mean_level, stat, p_value, fdr for entities present under all conditions."""

    def make() -> DataFrame:
        # ten names: the declared order is a constant of the run
        names = [r["condition"] for r in all_cells(spark, sf_dir).select("condition").distinct().orderBy("condition").collect()]
        ord_ = F.element_at(F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(c), F.lit(i + 1))]), F.col("condition"))
        t = all_cells(spark, sf_dir).withColumn("present", F.count(F.lit(1)).over(Window.partitionBy("entity"))).where(F.col("present") == len(names))
        t = t.select("entity", "condition", ord_.alias("ord"), "effect", "mean_level", F.round(F.abs("effect") * F.sqrt("n"), 9).alias("stat"))
        t = row_number_by_value(t, "condition", "stat", [F.col("entity")], "rn")
        n = t.groupBy().agg(F.count_distinct("entity").alias("universe"))
        t = t.crossJoin(F.broadcast(n)).withColumn("p_value", F.col("rn").cast("double") / F.col("universe"))
        return t.select("entity", "condition", "ord", "effect", "mean_level", "stat", "p_value", F.least(F.lit(1.0), F.col("p_value") * (F.lit(0.5) + F.lit(0.25) * F.col("ord"))).alias("fdr"))

    return kept(spark, sf_dir, "contrasts", make)


def conditions(spark: SparkSession, sf_dir: str) -> list[str]:
    """The conditions in their declared order: a fixed list of ten names."""
    return [r["condition"] for r in contrasts(spark, sf_dir).select("condition").distinct().orderBy("condition").collect()]


#: DuckDB form of ``cells`` and ``contrasts``.
CELLS_SQL = """
base AS (SELECT l_partkey AS entity, o_orderpriority AS pr, c_mktsegment AS seg, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
both_ AS (SELECT entity, pr AS condition, s, n FROM base UNION ALL SELECT entity, seg, s, n FROM base),
cell AS (SELECT entity, condition, sum(s) AS s, sum(n)::BIGINT AS n FROM both_ GROUP BY ALL),
tot AS (SELECT entity, sum(s) AS s, sum(n)::BIGINT AS n FROM base GROUP BY entity),
cells AS (SELECT c.entity, c.condition, c.n, log2((c.s::DOUBLE / c.n) / ((t.s - c.s)::DOUBLE / (t.n - c.n))) AS effect, log2(c.s::DOUBLE / c.n) AS mean_level
  FROM cell c JOIN tot t USING (entity) WHERE t.n > c.n),
ords AS (SELECT condition, row_number() OVER (ORDER BY condition)::INTEGER AS ord FROM (SELECT DISTINCT condition FROM cells))
"""
CONTRAST_SQL = CELLS_SQL + """,
full_ AS (SELECT entity FROM cells GROUP BY entity HAVING count(*) = (SELECT count(*) FROM ords)),
st AS (SELECT entity, condition, ord, effect, mean_level, round(abs(effect) * sqrt(n), 9) AS stat FROM cells JOIN full_ USING (entity) JOIN ords USING (condition)),
pv AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY stat DESC, entity)::DOUBLE / count(*) OVER (PARTITION BY condition) AS p_value FROM st),
contrast AS (SELECT *, least(1.0::DOUBLE, p_value * (0.5::DOUBLE + 0.25::DOUBLE * ord)) AS fdr FROM pv)
"""
