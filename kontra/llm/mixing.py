"""Operator 7: mixing sources to target weights by pivotal dependent rounding.

Only DataFrame functions.  A document's copies are fractional at first: the rate of
its source, target / size.  The whole part is taken as it is.  The rest, a probability,
is rounded in a reduction tree: groups of about ``fan`` documents of a source fold into
one residual each (two documents at a time, words move from one to the other at random
until one of them has 0 or 1), the residuals of the groups fold again, and so on to a
single one for each source, which is rounded to the nearest.  Every fold keeps the sum
of size x probability of its group, and the chance of each document stays its rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontra.llm.scratch import Scratch, same

WORD = r"[^\x20\x09-\x0D]+"
UNIT = "struct<size:bigint,key:bigint,p:double,id:string,dup:bigint>"
STATE = f"struct<rest:{UNIT},done:array<struct<id:string,dup:bigint,size:bigint,up:int>>>"


def sizes(docs: DataFrame, text: str, doc_id: str, source: str) -> DataFrame:
    """doc_id, source, size (words; null counts as empty)."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("bigint").alias("size"))


def targets(per_source: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds ``sid`` (rank of the source, null last) and ``target`` to (source, source_size).

    Sources share ``share`` times all sizes by weight, none above ``most`` times its own:
    with those that stop there taken off in order of size / weight, the rest share what
    is left.  The windows run over one row for each source.
    """
    n = len(weights)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("sid") - 1) % n + 1).cast("int"))
    ranked = per_source.withColumn("sid", F.row_number().over(order).cast("bigint")).withColumn("w", w).withColumn("cap", most * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    whole = Window.partitionBy()
    up_to = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(up_to), F.lit(0.0))) / F.sum("w").over(rest)
    ranked = ranked.withColumn("level", level)
    ok = F.when(F.col("level") * F.col("w") <= F.col("cap") * (1 + 1e-12), F.struct(F.col("cap") / F.col("w"), "sid", "level"))
    first = F.min(ok).over(whole)["level"]
    return ranked.select("source", "source_size", "sid", F.coalesce(F.least(F.col("cap"), first * F.col("w")), F.col("cap")).alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on nothing but the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def fold(units: Column, seed: int) -> Column:
    """The units of a group folded into one residual and the decisions made on the way."""
    one = lambda u, up: F.array(F.struct(u.id.alias("id"), u.dup.alias("dup"), u.size.alias("size"), F.lit(up).alias("up")))

    def step(a: Column, y: Column) -> Column:
        x = a.rest
        x_words, y_words = x.size * x.p, y.size * y.p
        x_room, y_room = x.size * (1 - x.p), y.size * (1 - y.p)
        to_x, to_y = F.least(x_room, y_words), F.least(y_room, x_words)
        raise_x = _uniform(x.key, y.key, x.id, y.id, x.dup, y.dup, F.lit(seed)) * (to_x + to_y) < to_y
        set_p = lambda u, p: F.struct(u.size.alias("size"), u.key.alias("key"), p.alias("p"), u.id.alias("id"), u.dup.alias("dup"))
        state = lambda u, p, other, up: F.struct(set_p(u, F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))).alias("rest"), F.concat(a.done, one(other, up)).alias("done")).cast(STATE)
        return (
            F.when(a.rest.isNull(), F.struct(y.alias("rest"), a.done.alias("done")).cast(STATE))
            .when(raise_x & (x_room <= y_words), state(y, (y_words - to_x) / y.size, x, 1))
            .when(raise_x, state(x, (x_words + to_x) / x.size, y, 0))
            .when(y_room <= x_words, state(x, (x_words - to_y) / x.size, y, 1))
            .otherwise(state(y, (y_words + to_y) / y.size, x, 0))
        )

    begin = F.struct(F.lit(None).cast(UNIT).alias("rest"), F.array().cast("array<struct<id:string,dup:bigint,size:bigint,up:int>>").alias("done")).cast(STATE)
    return F.aggregate(units, begin, step)


def numbered(rows: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """Each row as many times as ``m`` says, numbered from 1 by ``dup``; a row that stands for many is dealt over tasks in chunks."""
    few = rows.where(F.col("m") <= chunk).withColumn("dup", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m"))))
    many = rows.where(F.col("m") > chunk).withColumn("c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("m") - 1) / chunk)))).repartition("doc_id", "c")
    many = many.withColumn("dup", F.explode(F.sequence(F.col("c") * chunk + 1, F.least("m", (F.col("c") + 1) * chunk)))).drop("c")
    return few.unionByName(many)


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, fan: int = 64, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every document.

    size is the number of runs outside ``[\\x20\\x09-\\x0D]`` (null text: 0).  Sources
    in code point order, null last, weigh 3, 1, 2 and so on, repeating; target is the
    source's share of 150 % of all sizes, at most twice its size.  taken = copies x size
    with copies 0, 1 or 2; a source's sum of taken differs from its target by at most
    half of one document's size.  The same rows give the same result in any order or
    partitioning; rows equal in id, source and size are interchangeable.  Documents of
    size 0 take nothing.  Null ids are allowed; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    kind = docs.schema[doc_id].dataType
    sized = sizes(docs, text, doc_id, source)
    # equal rows are counted together before the shuffle and numbered apart after it
    counted = scratch.save(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m")), "sized", release=True)
    per = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("m")).otherwise(0)).alias("n"))
    per = scratch.save(per, "per")
    goal = targets(per.select("source", "source_size"), weights, share, most)
    goal = scratch.save(goal.join(per.select(F.col("source").alias("s"), "n"), same(F.col("source"), F.col("s"))).drop("s"), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumn("whole", F.least(F.floor(rate), F.lit(int(most)))).withColumn("p", F.greatest(rate - F.col("whole"), F.lit(0.0)))
    units = counted.where("size > 0").join(goal.select(F.col("source").alias("s"), "sid", "p", F.ceil(F.col("n") / fan).alias("groups")).where("p > 0"), same(F.col("source"), F.col("s")))
    units = numbered(units)
    key = F.xxhash64(F.col("doc_id").cast("string"), "size", "dup", F.lit(seed))
    unit = F.struct("size", key.alias("key"), "p", F.col("doc_id").cast("string").alias("id"), "dup")
    level = units.select("sid", "groups", unit.alias("u"))
    most_units = goal.agg(F.max(F.when(F.col("p") > 0, F.col("n")).otherwise(0))).first()[0] or 0
    decided, k = [], 0
    while most_units > 0:
        most_units = -(-most_units // fan)
        g = level.groupBy("sid", F.pmod(F.xxhash64("u.key", F.lit(k)), "groups").alias("g"), "groups").agg(F.collect_list("u").alias("us"))
        # largest first, so that what is left over is small
        tidy = F.transform(F.array_sort(F.transform("us", lambda u: F.struct((-u.size).alias("o"), u.alias("u")))), lambda x: x.u)
        done = scratch.save(g.select("sid", "groups", fold(tidy, seed + k).alias("s")), f"level{k}", release=True)
        decided.append(done.select("sid", F.explode("s.done").alias("d")).select("sid", "d.id", "d.dup", "d.size", "d.up"))
        level = done.select("sid", F.ceil(F.col("groups") / fan).alias("groups"), F.col("s.rest").alias("u"))
        k += 1
        if most_units == 1:
            last = level.select("sid", "u.id", "u.dup", "u.size", (F.col("u.p") >= 0.5).cast("int").alias("up"))
            decided.append(last)
            break
    goal = goal.select("source", "source_size", "sid", "target", "whole", "p")
    # documents without a fraction to decide
    plain = counted.join(goal.withColumnRenamed("source", "s"), same(F.col("source"), F.col("s"))).where("size = 0 or p = 0")
    plain = numbered(plain)
    out = plain.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("whole")).cast("int").alias("copies"))
    for part in decided:
        part = part.join(goal, "sid").select(F.col("id").cast(kind).alias("doc_id"), "source", "size", "source_size", "target", (F.col("whole") + F.col("up")).cast("int").alias("copies"))
        out = out.unionByName(part)
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def op7_query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
