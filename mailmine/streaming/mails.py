"""Structured Streaming forms of landing, matching and encoding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mailmine.functions import lexicon as lx
from mailmine.operators.encode import encode_incremental
from mailmine.operators.match import encode_templates, match
from mailmine.plans.runs import find_run, read_tables
from mailmine.session import cut_lineage
from mailmine.sources import landing
from mailmine.sources.mails import CSV_OPTIONS, clean_rows, normalize_columns, validate_columns


def landing_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Arriving mail files as cleaned rows. A file whose header differs from ``schema`` fails the stream."""

    raw = spark.readStream.options(**CSV_OPTIONS).schema(schema).csv(folder)
    df = normalize_columns(raw)
    validate_columns(df)
    return clean_rows(df)


def land_stream(spark: SparkSession, folder: str, out: str, refused: str, checkpoint: str, archive: str | None = None,
                files_at_once: int = 1000) -> StreamingQuery:
    """Arriving mail files of any header: cleaned rows to ``out``, files that can not be read to ``refused`` with the reason.

    The stream is one of file names; what it reads of a file to tell its header is one buffer. A
    bad file is set aside and does not stop the others. With ``archive`` every file is moved there
    when its batch is done. Batches replace their own folders, so a replay leaves no second copy. An empty
    file gives nothing to either table: Spark's file readers have no row for it.
    """

    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    reader = reader.option("maxFilesPerTrigger", files_at_once).option("recursiveFileLookup", True)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    columns = [*lx.REQUIRED_COLUMNS, *lx.OPTIONAL_COLUMNS]

    def land(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        tables, bad = landing.sorted_out(session, [landing.canonical(r["path"]) for r in batch.collect()])
        rows = [t.select(*columns, F.col("__file").alias("file")) for t, _ in tables]
        if rows:
            reduce(DataFrame.unionByName, rows).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch_id}")
        if bad:
            session.createDataFrame(bad, "file string, error string").write.mode("overwrite").parquet(f"{refused.rstrip('/')}/batch={batch_id}")

    names = reader.load(folder).select("path")
    return names.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet table until everything that has arrived is written."""

    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()


def match_stream(mails: DataFrame, templates: DataFrame | str, out: str, checkpoint: str, top_k: int = 1, encoder=None) -> StreamingQuery:
    """The closest templates of each arriving mail, written to ``out``.

    ``templates`` is a table, or the folder of stored runs: then every micro-batch matches against the
    latest finished run, and templates that are replaced between two batches are used from the next
    one on. A batch is an ordinary table, so any number of templates can be searched. Each batch
    replaces its own folder of ``out``: a batch that is replayed leaves no second copy.
    """

    latest: dict[str, DataFrame] = {}

    def vectors(spark: SparkSession) -> DataFrame:
        run_id = find_run(spark, templates) if isinstance(templates, str) else ""
        if run_id not in latest:
            found = templates if run_id == "" else read_tables(spark, templates, run_id)[1]["templates"]
            latest.clear()
            latest[run_id] = cut_lineage(encode_templates(found, encoder))
        return latest[run_id]

    def match_batch(batch: DataFrame, batch_id: int) -> None:
        found = match(batch, vectors(batch.sparkSession), top_k, encoder)
        found.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch_id}")

    writer = mails.writeStream.foreachBatch(match_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def encode_stream(mails: DataFrame, cache_path: str, checkpoint: str, encoder, text: str) -> StreamingQuery:
    """Encode arriving texts once per content. A batch that is replayed is known by its id, and adds nothing."""

    def encode_batch(batch: DataFrame, batch_id: int) -> None:
        encode_incremental(batch, cache_path, encoder, text, batch=f"{checkpoint}/{batch_id}")

    writer = mails.writeStream.foreachBatch(encode_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
