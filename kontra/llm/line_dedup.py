"""Operator 4: fuzzy line deduplication by MinHash, exact Jaccard and union-find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontra.llm.fuzzy import Join, annotate, near
from kontra.llm.scratch import Scratch, if_small

#: Miss rate at similarity 0.8 exactly: (1 - 0.8^4)^16 = 2e-4; at 0.85 it is 8e-6.
DEFAULT = Join(unit="line", kind="chars", k=8, bands=16, rows=4)


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", how: Join = DEFAULT) -> tuple[DataFrame, list[str]]:
    """Documents without the lines that repeat, exactly or nearly, an earlier one.

    Lines end at LF.  A line's normal form has A-Z lower-cased, runs of white space
    made one blank and none at the ends; its shingles are the distinct runs of eight
    characters (of all, if it has fewer).  Lines whose shingle sets have Jaccard
    similarity 0.8 or more are linked; of each component of links one line stays: that
    of the smallest doc_id (nulls last), the first in its document.  Blank lines have no
    shingles and always stay.  Null texts stay null.  Repeated rows count as documents
    of their own, so the lines of all but one go.

    Returns (table, names): columns of ``docs`` as c0, c1, ... in the order of ``names``,
    with the text rewritten, ``row_uid``, ``n_lines`` and ``n_removed`` (not blank).
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    names = docs.columns
    flat = annotate(docs, text, how, scratch, "units")
    body, ids = f"c{names.index(text)}", F.col(f"c{names.index(doc_id)}").alias("id")

    def bodies(t: DataFrame) -> DataFrame:
        # the outer explode keeps the split from being evaluated again for each line
        t = t.select("units", F.explode(F.array(_lines(body))).alias("lines"))
        t = t.select(F.explode(F.transform("units", lambda u: F.struct(u.fp1.alias("fp1"), u.fp2.alias("fp2"), F.get("lines", u.pos).alias("body")))).alias("u"))
        return t.select("u.*")

    linked = near(flat, bodies, how, scratch)
    lines = flat.select("row_uid", ids, F.explode("units").alias("u")).select("row_uid", "id", "u.pos", "u.fp1", "u.fp2")
    copies = lines.groupBy("fp1", "fp2").agg(F.count(F.lit(1)).alias("copies"))
    told = copies.join(linked.select("fp1", "fp2", "root"), ["fp1", "fp2"], "left").where("copies > 1 or root is not null")
    told = scratch.save(told.select("fp1", "fp2", F.coalesce("root", F.struct("fp1", "fp2")).alias("root")), "told", release=True)
    told, _ = if_small(told, 48)
    member = scratch.save(lines.join(told, ["fp1", "fp2"]).select("root", F.struct(F.col("id").isNull().alias("none"), "id", "row_uid", "pos").alias("at")), "members", release=True)
    first, _ = if_small(scratch.save(member.groupBy("root").agg(F.min("at").alias("first")), "first"))
    gone = member.join(first, "root").where("at != first").groupBy("at.row_uid").agg(F.collect_set("at.pos").alias("gone"))
    gone = scratch.save(gone, "gone", release=True)
    scratch.drop("told", "members", "linked")
    gone, _ = if_small(gone)
    out = flat.withColumn("n_lines", F.size("units")).drop("units", "bands").join(gone, "row_uid", "left")
    out = out.select("*", F.explode(F.array(F.when(F.col("gone").isNotNull(), _lines(body)))).alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    new = F.when(F.col("gone").isNull(), F.col(body)).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    return out.select("row_uid", *[new.alias(body) if c == text else F.col(f"c{i}") for i, c in enumerate(names)], "n_lines", F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("n_removed")), names


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", how: Join = DEFAULT) -> DataFrame:
    """``docs`` with repeated lines removed; documents of which nothing is left go, and ``n_chars`` follows the text."""
    out, names = line_dedup(docs, text, doc_id, how)
    body = F.col(f"c{names.index(text)}")
    out = out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    columns = [F.when(F.col("n_removed") > 0, F.length(body).cast(docs.schema[c].dataType)).otherwise(F.col(f"c{i}")).alias(f"c{i}") if c == "n_chars" else F.col(f"c{i}") for i, c in enumerate(names)]
    return out.select(*columns).toDF(*names)


def op4_query(spark, sf_dir: str) -> DataFrame:
    out, names = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    at = {c: F.col(f"c{i}") for i, c in enumerate(names)}
    return out.select(at["doc_id"].alias("doc_id"), "n_lines", (F.col("n_lines") - F.col("n_removed")).alias("n_kept"), F.length(at["text"]).alias("n_chars_left"), F.md5(at["text"].cast("binary")).alias("text_md5"))
