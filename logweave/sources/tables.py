"""Parquet table access and the derived log views used by the queries.

``log_lines``: log lines with known templates, built from ``events``.
``text_lines``: noisy free-text lines, one per line of ``documents.text``.
Both are pure projections/explodes of the given tables, so their size grows
with the tables; nothing is synthesised on the driver.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Format of the derived log view (one of the reference's header layouts).
LOG_LINES_FORMAT = "<Date> <Time> <Pid> <Level> <Component>: <Content>"

# Used verbatim by the Spark side and by the SQL oracle (see plans/oracle.py).
LOG_LINES_SQL = """SELECT event_id AS line_id,
  substr(CAST(ts AS STRING),1,19) || ' ' || CAST(100 + event_id % 900 AS STRING) || ' '
   || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || ' svc.' || event_type || ': '
   || CASE event_type
      WHEN 'signup'   THEN 'Registered user ' || CAST(user_id AS STRING) || ' from 10.0.' || CAST(user_id % 256 AS STRING) || '.' || CAST(event_id % 256 AS STRING) || ' plan ' || CASE event_id % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'team' ELSE 'gold' END
      WHEN 'error'    THEN 'Failed password for user ' || CAST(user_id AS STRING) || ' from 10.1.' || CAST(user_id % 256 AS STRING) || '.' || CAST(event_id % 256 AS STRING) || ' port ' || CAST(30000 + event_id % 20000 AS STRING) || ' ssh2'
      WHEN 'click'    THEN 'Served block blk_' || CAST(event_id * 7919 AS STRING) || ' of size ' || CAST(event_id % 4096 AS STRING) || ' KB to /10.2.' || CAST(user_id % 256 AS STRING) || '.7:50010'
      WHEN 'view'     THEN 'Fetched /var/www/html/p' || CAST(event_id % 50 AS STRING) || '.html in ' || CAST(event_id % 900 AS STRING) || ' ms'
      ELSE 'Order accepted id=' || CAST(event_id AS STRING) || ' user=' || CAST(user_id AS STRING) END AS value,
  CASE event_type
      WHEN 'signup'   THEN 'Registered user <*> from <*> plan <*>'
      WHEN 'error'    THEN 'Failed password for user <*> from <*> port <*> ssh2'
      WHEN 'click'    THEN 'Served block <*> of size <*> to <*>'
      WHEN 'view'     THEN 'Fetched <*> in <*>'
      ELSE 'Order accepted id=<*> user=<*>' END AS truth_template
FROM events"""

# An array of lines holds fewer than this many, so (doc_id, pos) packs into one ordered
# BIGINT line id without a global sort; ids of documents beyond 2^32 fail (ANSI overflow).
LINES_PER_DOC = 1 << 31


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


#: Rows of a table that one task should take (events become log lines, each worth a chain of regexes).
ROWS_PER_TASK = {"events": 100_000, "documents": 50_000}


def ensure_parallel(df: DataFrame, factor: int = 2, rows_per_task: int = 50_000) -> DataFrame:
    """Round-robin spread a scan whose rows lie in too few of its splits.

    A Parquet row group is read by one split, whatever the number of splits, so what counts
    is the rows that each of them yields (taken from the footers, no column is read): a
    scan is left alone unless its largest split holds more than twice an even share.
    """
    held = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
    rows = held.agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    want = max(df.sparkSession.sparkContext.defaultParallelism * factor, -(-(rows["all"] or 0) // rows_per_task))
    return df.repartition(want) if rows["all"] and rows["most"] * want > 2 * rows["all"] else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ensure_parallel(spark.read.parquet(table_path(sf_dir, name)), rows_per_task=ROWS_PER_TASK.get(name, 50_000))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id BIGINT, value STRING, truth_template STRING) from ``events``."""
    events = read_table(spark, sf_dir, "events")
    sql = LOG_LINES_SQL.replace("FROM events", "FROM {events}")
    return spark.sql(sql, events=events)


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, line_id, value): every line of every document, whole texts."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return (docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "value"))
            .withColumn("pos", F.col("pos").cast("long"))
            .withColumn("line_id", F.col("doc_id") * F.lit(LINES_PER_DOC) + F.col("pos")))
