"""A local session with the settings that the tests and the benchmark share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "sparsegrove") -> SparkSession:
    """For tests and benchmarks on one machine; on a cluster use the session that is given."""
    os.environ.setdefault("PYSPARK_PYTHON", "python")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARSEGROVE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the session's checkpoint folder. Where neither is set, a local session, whose driver
    and tasks are one process, gets a temporary one; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


@contextmanager
def settings(spark: SparkSession, **given: str) -> Iterator[None]:
    """Session settings for the jobs inside."""
    keys = {k.replace("__", "."): v for k, v in given.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Shuffle files of a job go when it has ended: its result is a table, and nothing reads them again.
SHUFFLES_GO = {"spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true"}


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder: what follows reads it, and neither computes nor recovers it anew."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with settings(df.sparkSession, **SHUFFLES_GO):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Parquet tables of one operator in the shared folder: lineage ends at each, so lost executors cost no recomputation, and a table goes
    when nothing needs it any more. What a lazy result still reads stays."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.count = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = f"{self.folder}/{name}-{self.count}"
        self.count += 1
        with settings(self.spark, **SHUFFLES_GO):
            df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for path in filter(None, (self.paths.pop(id(t), None) for t in tables)):
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
