"""Round trips through the files that the engine reads and writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontra.operators import detect, text
from kontra.plans.detection import rounded
from kontra.sources import files
from kontra.sources.tables import CONTRAST_SQL, contrasts, table


def csv_roundtrip(s, d):
    at = files.folder(s, "contrast-csv")
    up = F.when(F.col("effect") > 0, "up").otherwise("down")
    files.write_csv(contrasts(s, d).drop("ord").withColumn("part", F.col("condition")).withColumn("direction", up), at, "part", "direction")
    return rounded(files.read_contrast(s, at, entity="bigint").select("entity", "condition", "effect", "fdr"))


def jsonl_roundtrip(s, d):
    at = files.folder(s, "counts-jsonl")
    files.write_jsonl(detect.deg_counts(contrasts(s, d)), at)
    lines = s.read.text(at)
    told = files.read_jsonl(s, at, "condition string, detected bigint")
    return told.join(lines.withColumn("condition", F.get_json_object("value", "$.condition")), "condition").select("condition", "detected", F.col("value").alias("line"))


#: Columns of whole numbers and texts, whose written forms are the same everywhere.
DIGESTED = {
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey"],
    "customer": ["c_custkey", "c_mktsegment", "c_nationkey"],
    "orders": ["o_orderkey", "o_custkey", "o_orderpriority"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "labels": ["doc_id", "quality", "toxic"],
    "benchmark": ["item_id", "text"],
    "conversations": ["conv_id", "turn", "role", "text"],
}


def table_manifest(s, d):
    """table, rows, digest: of each table a digest that no order or partitioning changes."""
    return reduce(DataFrame.unionByName, [text.multiset_digest(table(s, d, t), c).select(F.lit(t).alias("table"), "rows", "digest") for t, c in DIGESTED.items()])


def _table_sql(t, columns):
    told = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in columns)
    limbs = " || ':' || ".join(f"(coalesce(sum(('0x' || substr(h, {16 * i + 1}, 16))::UBIGINT::HUGEINT), 0) % 18446744073709551616::HUGEINT)" for i in range(4))
    return f"SELECT '{t}' AS \"table\", count(*) AS rows, sha256(count(*) || ':' || {limbs}) AS digest FROM (SELECT sha256({told}) AS h FROM {t})"


QUERIES = {
    "table_manifest": (table_manifest, " UNION ALL ".join(_table_sql(t, c) for t, c in DIGESTED.items())),
    "csv_roundtrip": (csv_roundtrip, f"WITH {CONTRAST_SQL} SELECT entity, condition, round(effect, 6) AS effect, round(fdr, 6) AS fdr FROM contrast"),
    "jsonl_roundtrip": (
        jsonl_roundtrip,
        f"""WITH {CONTRAST_SQL}, c AS (SELECT condition, count(*) FILTER (fdr < 0.05) AS detected FROM contrast GROUP BY condition) SELECT condition, detected, '{{"condition":"' || condition || '","detected":' || detected || '}}' AS line FROM c""",
    ),
}
