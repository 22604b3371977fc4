"""Reading tables and cutting lineage in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.session import shared_folder

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Fewer rows in an Arrow batch than Spark's 10,000: texts are long, and several
    batches stay in memory on both sides of a Python step."""
    if not 0 < int(spark.conf.get(BATCH)) <= BATCH_ROWS:
        spark.conf.set(BATCH, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df once as a table in the shared folder and read it back.

    Its shuffle files are given free when the write ends, so that the disk a query
    needs at once is that of its largest step, not the sum of all.
    """
    spark = df.sparkSession
    path = shared_folder(spark, f"llm-{name}")
    held = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, held)
    return spark.read.schema(df.schema).parquet(path)
