"""Session settings that every entry point shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold at any size; cluster size and memory stay with the deployer.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build(app: str = "paperloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the shared defaults; keyword settings win over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows, at most, that a partition holds of a table whose rows are made many of.
ROWS = 1 << 17


def parts_of(df: DataFrame) -> int:
    """In how many partitions rows are dealt out by key: the session's number, or as many as keep a partition small, so that what a
    task holds and sorts doesn't grow with the table. df is a table as it was read; its files tell their rows."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a local session gets a temporary one, as in tests; a
    cluster is refused, since its executors would write to disks of their own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='paperloom-')}"
        spark.sparkContext.setCheckpointDir(at)
    return at


#: Tables that this driver wrote and hasn't deleted.
_written: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """The same rows read from a written table in the shared folder, so that lost executors and reruns don't repeat the work.
    Results read such tables, so they stay until `clear`."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/paperloom-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """df as the side of a join that is never sent whole to every executor by way of the driver. Sizes of files, by which Spark
    chooses, tell little of tables whose values repeat: they are packed on disk and whole in memory."""
    return df.hint("merge")


def clear(spark: SparkSession) -> None:
    """Deletes the tables that this driver's queries wrote, those of failed ones too. Call it when their results are stored."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
