"""Tables between steps, in the folder that the cluster names in ``spark.checkpoint.dir``.

A written table cuts lineage and survives lost executors.  Where the setting is
absent a local session gets a folder of its own; a cluster must name one that all share.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType


class Scratch:
    """Written tables of one operator call; ``drop`` removes what is no longer read."""

    def __init__(self, spark: SparkSession, label: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="kontra-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.spark, self.root = spark, f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._fs.deleteOnExit(self._path(self.root))

    def save(self, df: DataFrame, name: str, release: bool = False) -> DataFrame:
        """Write ``df`` and read it back.  ``release``: let Spark clean the shuffle files of plans that ended."""
        at = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        if release:
            self.spark.sparkContext._jvm.System.gc()
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)


def if_small(df: DataFrame, row_bytes: int | None = None, limit: int = 32 << 20) -> tuple[DataFrame, bool]:
    """``df`` (a written table) marked for broadcast if its rows fit ``limit`` bytes, and whether they do.

    ``row_bytes`` is given for rows whose columns all have a fixed size; otherwise texts and arrays are measured, with 16 bytes a column.
    """
    if row_bytes is None:
        sizes = [F.coalesce(size(F.col(f"`{f.name}`"), f.dataType), F.lit(0)) for f in df.schema.fields]
        total = df.agg(F.sum(sum(sizes, F.lit(16 * len(sizes))).cast("bigint"))).first()[0] or 0
    else:
        total = df.count() * row_bytes
    small = total <= limit
    return (F.broadcast(df) if small else df), small


def size(c: Column, kind: DataType) -> Column:
    """Bytes that a value takes beyond its slot."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.octet_length(c)
    if isinstance(kind, ArrayType):
        return F.size(c) * 8 if not isinstance(kind.elementType, (StringType, BinaryType, ArrayType, StructType)) else F.aggregate(c, F.lit(0), lambda a, x: a + 16 + F.coalesce(size(x, kind.elementType), F.lit(0)))
    if isinstance(kind, StructType):
        return sum((F.coalesce(size(c[f.name], f.dataType), F.lit(0)) for f in kind.fields), F.lit(16 * len(kind.fields)))
    return F.lit(0)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
