"""Written rounds in the shared folder, and settings of the array tasks."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailmine.session import scratch_path, ship_package

# Texts are long: few rows in an Arrow batch keep a worker's memory small.
ARROW_ROWS = "128"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Ship the package and bound the Arrow batches of this session."""

    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go when the job that made them has ended."""

    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def keep(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder; the table read back, and its path."""

    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def carrying(docs: DataFrame) -> DataFrame:
    """doc_id and text as ``documents`` has them, and the whole row as the struct ``carry``."""

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.struct("*").alias("carry"))


def carried(rows: DataFrame, ddl: str) -> T.StructType:
    """The fields of ``ddl`` and, if the rows have one, their ``carry`` column."""

    fields = T.StructType.fromDDL(ddl).fields
    return T.StructType([*fields, *(f for f in rows.schema.fields if f.name == "carry")])


def shards(n_values: int, per_shard: int) -> int:
    """Number of buckets so that each gets about ``per_shard`` values, whatever the size of the input."""

    return max(1, -(-int(n_values) // per_shard))


def documents(docs: DataFrame) -> DataFrame:
    """doc_id as bigint and text as string, and no other column."""

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
