"""Operator 3: chat formatting by rotating the perspective through all participants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontra.llm.scratch import Scratch, if_small, same

SYSTEM, UNKNOWN, END = "system", "unknown", "<|end|>\n"


def header(speaker: Column, perspective: Column) -> Column:
    """How a turn begins, seen from a participant."""
    other = F.concat(F.lit("<|user name="), speaker, F.lit("|>\n"))
    return F.when(speaker == SYSTEM, F.lit("<|system|>\n")).when(speaker == perspective, F.lit("<|assistant|>\n")).otherwise(other)


def name(speaker: Column) -> Column:
    """A name that can't end its mark; different names stay different."""
    out = F.coalesce(F.nullif(speaker, F.lit("")), F.lit(UNKNOWN))
    for c, code in (("%", "%25"), ("|", "%7C"), ("\n", "%0A"), ("\r", "%0D")):
        out = F.replace(out, F.lit(c), F.lit(code))
    return out


def in_parts(t: DataFrame, part_turns: int) -> DataFrame:
    """(conv_id, part, turns): the turns of each dialogue in order, ``part_turns`` in a part.

    A dialogue of up to so many turns is one part, of one group.  Longer ones, counted
    first, are ordered by a range partitioning, which splits a dialogue of any length over
    tasks, and numbered by the turns that earlier partitions hold of it.
    """
    scratch = Scratch(t.sparkSession, "chat")
    long = scratch.save(t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part_turns).select(F.col("conv_id").alias("c")), "long")
    long, _ = if_small(long)
    order = [F.col("turn").asc_nulls_last(), F.col("speaker"), F.col("body")]
    one = t.join(long, same(F.col("conv_id"), F.col("c")), "left_anti").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNull().alias("none"), "turn", "speaker", "body"))).alias("turns"))
    one = one.select("conv_id", F.lit(0).cast("bigint").alias("part"), F.transform("turns", lambda x: F.struct(x.speaker, x.body)).alias("turns"))
    ranged = t.join(long, same(F.col("conv_id"), F.col("c")), "left_semi").repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order)
    ranged = scratch.save(ranged.select("conv_id", "speaker", "body", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at")), "ranged")
    # one row for each long dialogue and partition that holds a piece of it
    pieces = ranged.groupBy("conv_id", "p").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    pieces, _ = if_small(scratch.save(pieces.select(F.col("conv_id").alias("c"), F.col("p").alias("q"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift")), "pieces"))
    many = ranged.join(pieces, same(F.col("conv_id"), F.col("c")) & (F.col("p") == F.col("q")))
    many = many.withColumn("part", F.floor((F.col("at") + F.col("shift")) / part_turns)).groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("at", "speaker", "body"))).alias("turns"))
    return one.unionByName(many.select("conv_id", "part", F.transform("turns", lambda x: F.struct(x.speaker, x.body)).alias("turns")))


def rotations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", part_turns: int = 4096) -> DataFrame:
    """Each dialogue once from each participant's point of view.

    One row per conversation and perspective, with the whole dialogue: conv_id,
    perspective, part, rendered, mask, n_turns.  Only a dialogue of over ``part_turns``
    turns is dealt over rows, parts 0, 1, ... of so many turns, which put together are the
    dialogue; masks count from the start of a part.  In ``rendered`` the perspective's
    turns are the assistant's, those of other participants come from users named after
    them, and ``system`` is a voice that all hear but nobody takes.  ``mask`` has the
    character ranges [start, stop) that are trained on: the text and end mark of the
    perspective's own turns.

    Turns are ordered by number (null last), then speaker, then text.  A null or empty
    speaker is the participant ``unknown``; a null text is empty; a null conversation id
    is a conversation.  ``<|`` in texts becomes ``< |``; in names ``%``, ``|`` and line
    ends become ``%25``, ``%7C``, ``%0A`` and ``%0D``: neither can forge a mark.  Repeated
    rows are repeated turns.  A conversation in which only the system speaks has no rows,
    nor has an empty table.  Further columns are not read.
    """
    t = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).cast("bigint").alias("turn"),
        name(F.col(speaker)).alias("speaker"),
        F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("<|"), F.lit("< |")).alias("body"),
    )
    parts = in_parts(t, part_turns)
    people = t.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    seen = parts.join(people, same(F.col("conv_id"), F.col("c"))).drop("c")
    p = F.col("perspective")
    pieces = F.transform("turns", lambda x: F.struct((x.speaker == p).alias("own"), header(x.speaker, p).alias("head"), F.concat(x.body, F.lit(END)).alias("tail")))
    seen = seen.withColumn("pieces", pieces)
    kind = "struct<at:bigint,spans:array<struct<start:bigint,stop:bigint>>>"
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans")).cast(kind)

    def step(a: Column, x: Column) -> Column:
        start = a.at + F.length(x.head)
        stop = start + F.length(x.tail)
        span = F.array(F.struct(start.alias("start"), stop.alias("stop")))
        return F.struct(stop.alias("at"), F.when(x.own, F.concat(a.spans, span)).otherwise(a.spans).alias("spans")).cast(kind)

    return seen.select(
        "conv_id",
        "perspective",
        "part",
        F.array_join(F.transform("pieces", lambda x: F.concat(x.head, x.tail)), "").alias("rendered"),
        F.aggregate("pieces", begin, step, lambda a: a.spans).alias("mask"),
        F.size("pieces").cast("bigint").alias("n_turns"),
    )


def op3_query(spark, sf_dir: str) -> DataFrame:
    out = rotations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.select(
        "conv_id", "perspective", "part", "rendered", "n_turns",
        F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m.start.cast("string"), m.stop.cast("string"))), ",").alias("mask"),
        F.aggregate("mask", F.lit(0).cast("bigint"), lambda a, m: a + m.stop - m.start).alias("n_trained"),
    )


ORACLE = """
WITH t0 AS (SELECT conv_id, turn, replace(replace(replace(replace(coalesce(nullif(role, ''), 'unknown'), '%', '%25'), '|', '%7C'), chr(10), '%0A'), chr(13), '%0D') AS speaker,
           replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations),
t AS (SELECT *, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, speaker, body) - 1) // 4096)::BIGINT AS part FROM t0),
people AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM t WHERE speaker <> 'system'),
x AS (SELECT conv_id, perspective, part, turn, speaker, body, speaker = perspective AS own,
      CASE WHEN speaker = 'system' THEN '<|system|>' || chr(10) WHEN speaker = perspective THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || speaker || '|>' || chr(10) END AS head,
      body || '<|end|>' || chr(10) AS tail FROM t JOIN people ON t.conv_id IS NOT DISTINCT FROM people.c),
y AS (SELECT *, sum(length(head) + length(tail)) OVER w AS stop, row_number() OVER w AS rn FROM x
      WINDOW w AS (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS LAST, speaker, body ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, perspective, part, string_agg(head || tail, '' ORDER BY rn) AS rendered, count(*)::BIGINT AS n_turns,
       coalesce(string_agg(CASE WHEN own THEN (stop - length(tail))::BIGINT || '-' || stop::BIGINT END, ',' ORDER BY rn), '') AS mask,
       coalesce(sum(CASE WHEN own THEN length(tail) END), 0)::BIGINT AS n_trained
FROM y GROUP BY ALL
"""
