"""The ontology stand-in (part attributes in three namespaces) and readers for OBO and GAF text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontra.sources.tables import table


def associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """namespace, entity, term: the leaf terms of every part."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity"), "p_brand", "p_type", F.col("p_size").cast("string").alias("p_size"))
    each = [F.struct(F.lit(n).alias("namespace"), F.concat(F.lit(f"{n}:"), F.col(c)).alias("term")) for n, c in (("brand", "p_brand"), ("type", "p_type"), ("size", "p_size"))]
    return p.select("entity", F.explode(F.array(*each)).alias("a")).select("a.namespace", "entity", "a.term")


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """child, parent: leaf to bucket, bucket to the namespace's root."""
    leaf = associations(spark, sf_dir).select("namespace", "term").distinct()
    value = F.element_at(F.split("term", ":"), 2)
    bucket = F.when(F.col("namespace") == "brand", F.substring(value, 1, 7)).when(F.col("namespace") == "size", F.concat(F.lit("decade "), F.floor(value.try_cast("int") / 10).cast("string"))).otherwise(F.substring(value, 1, 1))
    t = leaf.select("namespace", "term", F.concat(F.col("namespace"), F.lit("|"), bucket).alias("bucket"))
    up = t.select(F.col("term").alias("child"), F.col("bucket").alias("parent"))
    return up.unionByName(t.select(F.col("bucket").alias("child"), F.concat(F.lit("root "), F.col("namespace")).alias("parent")).distinct())


def read_obo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(terms: id, name, namespace; edges: child, parent) of an OBO file's [Term] stanzas that are not obsolete."""
    stanza = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value").startswith("[Term]"))
    # multiline patterns; (?m) anchors at line starts
    pick = lambda key: F.regexp_extract("value", rf"(?m)^{key}: (.*)$", 1)
    t = stanza.where(~F.col("value").rlike(r"(?m)^is_obsolete: true")).select(pick("id").alias("id"), pick("name").alias("name"), pick("namespace").alias("namespace"), "value")
    up = t.select(F.col("id").alias("child"), F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^is_a: (\S+)"), 1)).alias("parent"))
    return t.drop("value"), up


def read_gaf(spark: SparkSession, path: str) -> DataFrame:
    """entity, term, aspect of a (gzipped) GAF file; comments and negated annotations are left out."""
    cell = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("!"))
    t = rows.select(cell[1].alias("entity"), cell[3].alias("qualifier"), cell[4].alias("term"), cell[8].alias("aspect"))
    return t.where(~F.col("qualifier").contains("NOT")).select("entity", "term", "aspect").distinct()


ONTOLOGY_SQL = """
assoc AS (SELECT 'brand' AS namespace, p_partkey AS entity, 'brand:' || p_brand AS term FROM part UNION ALL SELECT 'type', p_partkey, 'type:' || p_type FROM part UNION ALL SELECT 'size', p_partkey, 'size:' || p_size::VARCHAR FROM part),
leaf AS (SELECT DISTINCT namespace, term, split_part(term, ':', 2) AS v FROM assoc),
buck AS (SELECT namespace, term, namespace || '|' || CASE namespace WHEN 'brand' THEN substr(v, 1, 7) WHEN 'size' THEN 'decade ' || floor(TRY_CAST(v AS INTEGER) / 10)::INTEGER ELSE substr(v, 1, 1) END AS bucket FROM leaf),
edges AS (SELECT term AS child, bucket AS parent FROM buck UNION SELECT bucket, 'root ' || namespace FROM buck),
clo AS (SELECT child, parent AS ancestor, 1 AS depth FROM edges UNION SELECT e.child, f.parent, 2 FROM edges e JOIN edges f ON e.parent = f.child)
"""
