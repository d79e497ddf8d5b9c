"""Helpers shared by the operators of this package."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.session import checkpoint_dir, cut_lineage

#: Runs of these characters part words: blank, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read by Spark alone (any store that its readers reach)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the cluster's shared folder."""
    return cut_lineage(df)


def cut_and_release(df: DataFrame) -> DataFrame:
    """A checkpoint, after which shuffle files that no table refers to any more may go.

    Spark's cleaner drops a shuffle's files once the driver has collected the objects that
    refer to it; in a chain of many small tables that would otherwise come late.
    """
    spark, out = df.sparkSession, cut(df)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the cluster's shared folder (nothing is created yet)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a table that was written to ``shared_folder`` and is not read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Functions of this package are pickled by reference, so workers must be able
    to import it even where only the driver has it on its path.
    """
    import tempfile
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="logweave-pkg-"), "logweave_pkg.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("logweave", os.path.relpath(full, root)))
    sc.addPyFile(path)  # the driver's own file service hands it to executors
    _shipped.add(sc.applicationId)


def free_name(taken: Iterable[str], base: str) -> str:
    """``base``, with underscores added until no column in ``taken`` has that name."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base += "_"
    return base


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def id_type(df: DataFrame, col: str) -> T.DataType:
    return df.schema[col].dataType


def n_shuffle(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def range_cuts(df: DataFrame, col: str, parts: int) -> list:
    """At most ``parts - 1`` ascending ids that part the rows in about equal runs.

    A quantile sketch over the id column alone (all rows); the list is as long as
    the number of partitions, whatever the size of the table.  Cuts are ids that
    occur, so the run that starts at a cut begins with that very id.
    """
    if parts < 2:
        return []
    row = df.agg(F.percentile_approx(col, [i / parts for i in range(1, parts)], 10_000).alias("q")).first()
    return sorted(set(row.q or []))


def run_of(col: Column, cuts: list) -> Column:
    """Index of the run (see range_cuts) that an id falls into; null ids: the first run."""
    if not cuts:
        return F.lit(0)
    cuts_lit = F.array(*[F.lit(c) for c in cuts])
    return F.when(col.isNull(), F.lit(0)).otherwise(F.size(F.filter(cuts_lit, lambda c: c <= col)))


def ranked(df: DataFrame, group: str, order: list[str], out: str, salts: int = 4096) -> DataFrame:
    """Adds ``out``: gapless ranks 0, 1, … within each value of ``group``.

    Two levels, so that a value holding a third of all rows is still spread: rows
    are numbered within (group, salt), salts of a hash of the order columns, and
    the counts of the lower salts of the group are added (at most ``salts`` rows
    per group).  Equal rows get different ranks.
    """
    from pyspark.sql import Window as W

    salt, base = free_name(df.columns, "_salt"), free_name(df.columns, "_base")
    d = df.withColumn(salt, F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = d.groupBy(group, salt).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(group, salt, (F.sum("_n").over(W.partitionBy(group).orderBy(salt)) - F.col("_n")).alias(base))
    d = d.withColumn(out, F.row_number().over(W.partitionBy(group, salt).orderBy(*order)) - 1)
    return d.join(counts, [group, salt]).select(*df.columns, (F.col(out) + F.col(base)).cast("long").alias(out))
