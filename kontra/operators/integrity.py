"""Checks of the contrast table: one aggregate, no row leaves the cluster."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ["entity", "condition", "effect", "mean_level", "stat", "p_value", "fdr"]


def check_schema(df: DataFrame, strict: bool = False) -> DataFrame:
    """The declared columns, in order; missing ones (and, if strict, others) are an error."""
    missing, extra = [c for c in REQUIRED if c not in df.columns], [c for c in df.columns if c not in REQUIRED]
    if missing or (strict and extra):
        raise ValueError(f"missing columns {missing}, unexpected columns {extra if strict else []}")
    return df.select(*REQUIRED)


def report(contrast: DataFrame) -> DataFrame:
    """Per condition: rows, distinct entities, null ids, values that are not finite, range of p and fdr, verdict."""
    odd = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    bad = sum(odd(c).cast("int") for c in ("effect", "mean_level", "stat", "p_value", "fdr"))
    t = contrast.groupBy("condition").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct("entity").alias("entities"),
        F.count_if(F.col("entity").isNull()).alias("null_ids"),
        F.sum(bad).alias("not_finite"),
        F.min(F.least("p_value", "fdr")).alias("least_p"),
        F.max(F.greatest("p_value", "fdr")).alias("greatest_p"),
    )
    return t.withColumn("ok", (F.col("row_count") == F.col("entities")) & (F.col("null_ids") == 0) & (F.col("not_finite") == 0) & F.col("least_p").between(0, 1) & F.col("greatest_p").between(0, 1))


def universe(cells: DataFrame, n_conditions: int) -> DataFrame:
    """Per condition: entities present, and entities of the table that lack some condition although present here."""
    m = cells.groupBy("entity").agg(F.count_distinct("condition").alias("m"))
    t = cells.join(m, "entity")
    return t.groupBy("condition").agg(F.count(F.lit(1)).alias("present"), F.count_if(F.col("m") < n_conditions).alias("incomplete"))


def require_same_universe(contrast: DataFrame, n_conditions: int) -> None:
    """Raise unless every entity occurs once under every condition."""
    off = contrast.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("condition").alias("m")).where((F.col("n") != n_conditions) | (F.col("m") != n_conditions))
    if not off.isEmpty():
        raise ValueError("the conditions do not cover the same entities once each")


#: Bytes of a file that are held at once.
READ = 1 << 20


def manifest(spark: SparkSession, path: str, glob: str = "*", digest: bool = True) -> DataFrame:
    """file, bytes, rows, sha256, place (its path below ``path``) of every file below a path, each read by one task in blocks of one MiB.

    ``rows`` comes from a Parquet file's footer and is null for other files.  Files are
    dealt by name over as many tasks as the session has partitions; none is ever whole in
    memory, so that its size does not matter.  The path is one that pyarrow can open (a
    local or shared folder, hdfs, s3, gs).  Hidden and empty files are left out, as in all of Spark's readers.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/") + "/"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs, parquet

        for batch in batches:
            for at, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(unquoted(at))
                sha = hashlib.sha256() if digest else None
                if sha is not None:
                    with store.open_input_stream(name, compression=None) as f:
                        while block := f.read(READ):
                            sha.update(block)
                rows = None
                if name.endswith(".parquet"):
                    with store.open_input_file(name) as f:
                        rows = parquet.ParquetFile(f).metadata.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[-1]]), pa.array([size], pa.int64()), pa.array([rows], pa.int64()), pa.array([sha and sha.hexdigest()], pa.string()), pa.array([at.removeprefix(root) if at.startswith(root) else at.rsplit("/", 1)[-1]])], names=["file", "bytes", "rows", "sha256", "place"])

    dealt = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return dealt.mapInArrow(run, "file string, bytes bigint, rows bigint, sha256 string, place string")


def rows_by_table(files: DataFrame) -> DataFrame:
    """file, rows of every table of a manifest: a file of its own, or all files of one folder below the root."""
    return files.groupBy(F.substring_index("place", "/", 1).alias("file")).agg(F.sum("rows").alias("rows"))


def unquoted(uri: str) -> str:
    """Spark writes a local path as file:/a/b; pyarrow wants file:///a/b."""
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def require_digest(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """Lines of a (possibly gzipped) text file, refused unless its digest is the expected one."""
    found = manifest(spark, path).first()
    if found is None or found["sha256"] != sha256:
        raise ValueError("checksum mismatch")
    return spark.read.text(path)


def coverage(rows: DataFrame, keys: list[str], path: str, lookup: DataFrame, on: str) -> DataFrame:
    """Legacy-coverage audit: each path once and no nulls, then rows per key group with the group's mapped note."""
    bad = rows.groupBy(path).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or " + f"{path} is null")
    if not bad.isEmpty():
        raise ValueError("paths are not unique")
    g = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(path).alias("first_path"))
    return g.join(lookup, on, "left")
