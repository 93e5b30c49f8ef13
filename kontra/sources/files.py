"""Contrast files in and result files out: one CSV folder for each condition, JSON lines with sorted keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontra.operators.integrity import REQUIRED, check_schema, report

#: What the columns of a contrast file are called here, by the names that differential expression tools give them.
NAMES = {"WB_id": "entity", "logFC": "effect", "AveExpr": "mean_level", "t": "stat", "P.Value": "p_value", "FDR": "fdr"}


def folder(spark: SparkSession, label: str) -> str:
    """A new folder under the one that the session shares; a local session without one gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="kontra-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def read_contrast(spark: SparkSession, path: str, condition: str | None = None, names: Mapping[str, str] = NAMES, rows: int | None = None, entity: str = "string") -> DataFrame:
    """The contrast columns of CSV files; ``condition`` names that of a file without such a column.

    Columns are found by their header and renamed by ``names`` (those already named as here
    stay), quotes around ids go.  A missing column, a value that is no number, an empty or
    repeated id, a value that is not finite, p or fdr outside 0 to 1, and another number of
    rows a condition than ``rows`` are errors.
    """
    header = spark.read.option("header", True).csv(path).columns
    kinds = {n: "string" if n in ("entity", "condition") else "double" for n in REQUIRED}
    schema = ", ".join(f"`{c}` {kinds.get(names.get(c, c), 'string')}" for c in header)
    t = spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).schema(schema).csv(path)
    t = t.toDF(*[names.get(c, c) for c in header])
    if condition is not None:
        t = t.withColumn("condition", F.lit(condition))
    t = check_schema(t).withColumn("entity", F.nullif(F.regexp_replace("entity", '^"|"$', ""), F.lit("")).cast(entity))
    wrong = F.lit(False) if rows is None else F.col("row_count") != rows
    bad = report(t).where(~F.coalesce("ok", F.lit(False)) | wrong).limit(3).collect()
    if bad:
        raise ValueError(f"contrast files fail their checks: {[r.asDict() for r in bad]}")
    return t


def write_csv(df: DataFrame, path: str, *by: str) -> None:
    """CSV with a header, a folder for each value of the columns ``by``, one within the other."""
    out = df.write.mode("errorifexists").option("header", True).option("escape", '"')
    (out.partitionBy(*by) if by else out).csv(path)


def json_lines(df: DataFrame) -> DataFrame:
    """value: each row as a JSON object with sorted keys; nulls are written."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str) -> None:
    json_lines(df).write.mode("errorifexists").text(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("mode", "FAILFAST").schema(schema).json(path)
