"""Operator 5: n-gram Jaccard join of documents with Bayesian candidate pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontra.llm.fuzzy import Join, annotate, near
from kontra.llm.scratch import Scratch, if_small

#: Miss rate at similarity 0.8 exactly: (1 - 0.8^5)^30 = 7e-6.
DEFAULT = Join(unit="text", kind="words", k=5, bands=30, rows=5)


def ngram_join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", how: Join = DEFAULT) -> tuple[DataFrame, list[str]]:
    """Documents with their class and links.

    Words are runs outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased; a document's
    shingles are the distinct runs of five words, or all its words if it has one to
    four.  Two documents are linked if their shingle sets have Jaccard similarity 0.8
    or more.  Null and empty texts have no shingles and link with nothing.  Documents
    with the same words in the same order (exact copies) are one text.

    Returns (table, names): the table has the columns of ``docs`` as c0, c1, ... (given
    in ``names`` order), ``row_uid``, ``class_id`` (smallest doc_id that links reach, its
    own included; null if all are null), ``n_links`` (other documents linked directly,
    copies counted), ``n_texts`` (other texts linked directly) and ``kept`` (one row in
    each class: smallest doc_id, nulls last, then the first row read).  Repeated rows
    count as copies.  Columns of any name may stand in ``docs``.
    """
    scratch = Scratch(docs.sparkSession, "ngram-join")
    names = docs.columns
    flat = annotate(docs, text, how, scratch, "units")
    body = F.col(f"c{names.index(text)}").alias("body")
    linked = near(flat, lambda t: t.where(F.size("units") > 0).select(F.element_at("units", 1).alias("u"), body).select("u.fp1", "u.fp2", "body"), how, scratch)
    ids = F.col(f"c{names.index(doc_id)}")
    # the class of every row: its text's component, or its text
    base = flat.where(F.size("units") > 0).select("row_uid", ids.alias("id"), F.element_at("units", 1).alias("u")).select("row_uid", "id", "u.fp1", "u.fp2")
    copies = base.groupBy("fp1", "fp2").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("row_uid"))).alias("best"))
    classes = copies.join(linked, ["fp1", "fp2"], "left").withColumn("root", F.coalesce("root", F.struct("fp1", "fp2")))
    # only classes of several rows matter from here: the rest are kept as they are
    classes = scratch.save(classes.where("copies > 1 or n_rows is not null"), "classes", release=True)
    top = classes.groupBy("root").agg(F.min("best").alias("top"))
    told = classes.join(top, "root").select("fp1", "fp2", F.col("top.id").alias("class_id"), F.col("top.row_uid").alias("top_uid"), (F.coalesce("n_rows", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"))
    told = scratch.save(told, "told")
    scratch.drop("classes", "linked")
    told, _ = if_small(told)
    marks = base.join(told, ["fp1", "fp2"]).select("row_uid", "class_id", "top_uid", "n_links", "n_texts")
    marks = scratch.save(marks, "marks", release=True)
    marks, _ = if_small(marks)
    out = flat.drop("units", "bands").join(marks, "row_uid", "left")
    return out.select(
        "row_uid",
        *[f"c{i}" for i in range(len(names))],
        F.when(F.col("top_uid").isNull(), ids).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("n_texts", F.lit(0)).cast("bigint").alias("n_texts"),
        (F.col("top_uid").isNull() | (F.col("top_uid") == F.col("row_uid"))).alias("kept"),
    ), names


def one_per_group(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", how: Join = DEFAULT) -> DataFrame:
    """``docs`` with one document of each group of linked documents; the columns stay."""
    out, names = ngram_join(docs, text, doc_id, how)
    return out.where("kept").select(*[F.col(f"c{i}") for i in range(len(names))]).toDF(*names)


def op5_query(spark, sf_dir: str) -> DataFrame:
    out, names = ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(F.col(f"c{names.index('doc_id')}").alias("doc_id"), "class_id", "n_links", "n_texts", "kept")


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, array_to_string(ws, ' ') AS body, ws FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) ELSE [body] END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c * 5 >= (x.n + y.n - c) * 4
          UNION SELECT x.doc_id, y.doc_id FROM t x JOIN t y ON x.body = y.body AND x.doc_id <> y.doc_id),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
counts AS (SELECT l.a, count(*) AS n, count(DISTINCT CASE WHEN x.body <> y.body THEN y.body END) AS m
           FROM links l JOIN t x ON x.doc_id = l.a JOIN t y ON y.doc_id = l.b GROUP BY l.a)
SELECT d.doc_id, least.c AS class_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(m, 0)::BIGINT AS n_texts, d.doc_id = least.c AS kept
FROM documents d JOIN least ON least.a = d.doc_id LEFT JOIN counts ON counts.a = d.doc_id
"""
