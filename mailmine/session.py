"""Session settings and the shared scratch folder.

Nothing here is tied to one machine: on a cluster the scratch folder is the
one named by ``spark.checkpoint.dir``; only a local session without that
setting gets a folder of its own.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every mailmine job relies on. Partition counts and memory belong to
# the cluster and are not set here.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # vectors are ~256 bytes a row: 4,096 rows keep an Arrow batch near 1 MB
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


_shipped_to: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application.

    The archive is made on the driver; Spark hands it to every executor.
    """

    context = spark.sparkContext
    if context.applicationId in _shipped_to:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="mailmine-code-"), "mailmine.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("mailmine", os.path.relpath(path, package)))
    context.addPyFile(archive)
    _shipped_to.add(context.applicationId)


def local_session(app: str = "mailmine", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""

    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **SESSION_CONF,
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "16g",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared scratch folder: ``spark.checkpoint.dir`` if the session names one."""

    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="mailmine-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared scratch folder."""

    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used between rounds of an iterative operator. The written table outlives
    lost executors, keeps its column statistics and gives the next round a
    plan of constant size.
    """

    path = scratch_path(df.sparkSession, "round")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
