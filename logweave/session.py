"""Spark session helpers.

The cluster names its shared checkpoint folder in ``spark.checkpoint.dir``;
we read it from the session.  Only a local master, whose executors are the
driver, gets a fresh scratch folder when it is unset; a cluster without the
setting is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # small but CPU-heavy shuffles (regex / array work per row) keep several tasks
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
    # broadcast joins happen only below this size; bigger sides shuffle
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "logweave") -> SparkSession:
    """Return the active session, or build a local one for tests/bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    b = SparkSession.builder.appName(app).master(master or f"local[{cpus}]")
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
    b = b.config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's setting, else (local master) a new scratch folder."""
    conf = spark.sparkContext.getConf()
    d = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="logweave-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str = "cut", release: bool = False) -> DataFrame:
    """``df`` as a Parquet table of its own in the shared folder.

    For tables of many rounds: unlike a checkpoint's, the plan starts from nothing but
    the files, with their sizes and without the constraints that earlier rounds inferred.
    ``release``: the shuffle files of what was written go at once; Spark drops them when the
    driver's objects that refer to them are collected, which may come after the query's end.
    """
    folder = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    if release:
        df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Bytes of a written table that one slice of it should hold, and the most slices (each is a pass over the table).
SLICE_BYTES, MOST_SLICES = 24 << 20, 4


def _folders(df: DataFrame) -> list:
    """(file system, path) of the folders of the shared folder that ``df`` reads."""
    sc = df.sparkSession.sparkContext
    paths = [sc._jvm.org.apache.hadoop.fs.Path(x) for x in sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()})]
    shared = sc._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(df.sparkSession)).toUri().getPath().rstrip("/")
    return [(p.getFileSystem(sc._jsc.hadoopConfiguration()), p) for p in paths if p.toUri().getPath().startswith(shared + "/")]


def slices_of(df: DataFrame) -> int:
    """Into how many slices the steps over a written table are parted: a step's shuffle files are those of one slice."""
    held = sum(fs.getContentSummary(p).getLength() for fs, p in _folders(df))
    return max(1, min(MOST_SLICES, -(-held // SLICE_BYTES)))


def drop_written(*tables: DataFrame) -> None:
    """Delete tables of ``written`` or ``Parts`` that are not read any more."""
    for t in tables:
        for fs, p in _folders(t):
            fs.delete(p, True)


class Parts:
    """A table in the shared folder, written slice by slice; the shuffle files of a slice go before the next."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.schema = spark, None
        self.folder = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def add(self, df: DataFrame) -> None:
        self.schema = df.schema
        df.write.option("compression", "zstd").mode("append").parquet(self.folder)
        self.spark.sparkContext._jvm.System.gc()

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.folder)
