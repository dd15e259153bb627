"""Checking delivered CSV files, and finding the data set of a run."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailmine.sources.mails import CSV_OPTIONS, DataValidationError, clean_rows, load_csv, normalize_columns, validate_columns

REPORT = "file string, rows long, columns array<string>, error string"
NOT_CSV = "not a .csv file"
EMPTY = "empty file"
HEADERS_AT_ONCE = 64


def canonical(path: str) -> str:
    """A path as every part of Spark writes it: listings and rows differ in the slashes of the root."""

    return re.sub(r"^(\w+):/+(?=[^/])", r"\1:///", path) if path.startswith("file:") else path


def first_lines(spark: SparkSession, files: list[str]) -> dict[str, str | None]:
    """The first line of each file, null for an empty one.

    Readers stop at the first line of a file, so what is read of a file is a buffer and not the file.
    """

    found: dict[str, str | None] = dict.fromkeys(files)
    for start in range(0, len(files), HEADERS_AT_ONCE):
        parts = [spark.read.text(f).limit(1).select(F.lit(f).alias("file"), "value") for f in files[start:start + HEADERS_AT_ONCE]]
        found.update({r["file"]: r["value"] for r in reduce(DataFrame.union, parts).collect()})
    return found


def delivered(spark: SparkSession, folder: str) -> list[str]:
    """Every file under ``folder``, from the listing alone; empty files have no row, but are listed."""

    return sorted(map(canonical, spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).inputFiles()))


def sorted_out(spark: SparkSession, files: list[str]) -> tuple[list[tuple[DataFrame, list[str]]], list[tuple[str, str]]]:
    """Readable files as cleaned tables with the files they hold, one table for each header; and refused files with the reason.

    The tables have a column ``__file``.
    """

    by_header: dict[str, list[str]] = {}
    refused = []
    for file, header in first_lines(spark, sorted(set(files))).items():
        if header is None:
            refused.append((file, EMPTY))
        elif file.lower().endswith(".csv"):
            by_header.setdefault(header, []).append(file)
        else:
            refused.append((file, NOT_CSV))
    tables = []
    for same in by_header.values():
        df = normalize_columns(spark.read.options(**CSV_OPTIONS).csv(same))
        try:
            validate_columns(df)
        except DataValidationError as error:
            refused += [(f, f"unreadable: {error}") for f in same]
            continue
        file = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+(?=[^/])", "file:///")
        tables.append((clean_rows(df.withColumn("__file", file)), same))
    return tables, refused


def landing_report(spark: SparkSession, folder: str) -> DataFrame:
    """One row per delivered file: clean rows, columns, or why it was refused.

    Files with the same header are read together; rows are counted per file by the
    executors. Only file names and headers reach the driver.
    """

    tables, refused = sorted_out(spark, delivered(spark, folder))
    parts = [spark.createDataFrame([(f, None, None, why) for f, why in refused], REPORT)]
    for cleaned, files in tables:
        columns = F.array(*[F.lit(c) for c in cleaned.columns if c != "__file"])
        counted = cleaned.groupBy("__file").agg(F.count("*").alias("rows"))
        listed = spark.createDataFrame([(f,) for f in files], "__file string").join(counted, "__file", "left")
        parts.append(listed.select(F.col("__file").alias("file"), F.coalesce("rows", F.lit(0)).alias("rows"),
                                   columns.alias("columns"), F.lit(None).cast("string").alias("error")))
    return reduce(lambda x, y: x.unionByName(y), parts)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
        return True
    except AnalysisException:
        return False


def resolve_dataset(spark: SparkSession, path: str | None = None, uploads: list[str] = (),
                    sample: str | None = None) -> DataFrame:
    """The data of a run: the given path, else the newest upload, else the sample; without any, an error."""

    if path is not None:
        return load_csv(spark, path)
    for candidate in [*reversed(list(uploads)), *([sample] if sample else [])]:
        if _exists(spark, candidate):
            return load_csv(spark, candidate)
    raise FileNotFoundError(f"no data: looked at {len(uploads)} uploads and the sample {sample!r}")
