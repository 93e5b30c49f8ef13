"""The corpus pipeline: quality, line dedup, n-gram join, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the
columns of documents, whatever else they are called.  An empty table gives an empty one,
a null text is an empty one that stays null, and a null doc_id is a document like others.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from kontra.llm.decontaminate import decontaminated
from kontra.llm.line_dedup import deduplicated
from kontra.llm.mixing import mix
from kontra.llm.ngram_join import one_per_group
from kontra.llm.quality import accepted
from kontra.llm.scratch import Scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.3) go; repeated rows fare alike, empty texts get a score too."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, exactly or nearly, go; so do documents of which nothing is left.

    Of repeated rows one keeps its lines; blank lines, and texts that were blank or null before, stay.
    """
    return deduplicated(docs)


def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest doc_id, nulls last; texts without words are in no group."""
    return one_per_group(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; items without words are in none."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document, and its words; a null source is one, the last, and empty texts take nothing."""
    return mix(docs)


#: Whole texts go to Python in batches; 10,000 rows of them, Spark's default, are tens of MB twice in the JVM and again in its workers.
BATCH_ROWS = 2048


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with Arrow batches of at most BATCH_ROWS rows, in the session's setting, as its result is written after it returns."""

    @wraps(stage)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        now = int(spark.conf.get(key))
        if now <= 0 or now > BATCH_ROWS:
            spark.conf.set(key, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return call


STAGES = [
    ("quality_classifier", in_small_batches(quality_stage)),
    ("line_dedup", in_small_batches(line_stage)),
    ("ngram_jaccard_join", in_small_batches(ngram_stage)),
    ("benchmark_decontamination", in_small_batches(benchmark_stage)),
    ("source_mixing", in_small_batches(mixing_stage)),
]

#: A trained model and hashed shingles decide, which SQL can't repeat; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}", release=True)
    return docs
