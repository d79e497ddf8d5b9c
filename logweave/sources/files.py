"""File sources and sinks: structured/template/summary tables (S5, S6) and the
mining-trace JSON source (S8).  Parquet is the default sink; CSV keeps the
reference's column names and reads every column as a string."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.sources.logformat import numbered_lines

STRUCTURED_COLUMNS = {"line_id": "LineId", "content": "Content", "event_id": "EventId",
                      "event_template": "EventTemplate", "occurrences": "Occurrences"}


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: tuple[str, ...] = ()) -> None:
    """Write a structured / template / summary table (``mode='append'`` for summaries)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        out = df.select(*[F.col(c).cast("string").alias(STRUCTURED_COLUMNS.get(c, c)) for c in df.columns])
        w = out.write.mode(mode)
        if partition_by:
            w = w.partitionBy(*[STRUCTURED_COLUMNS.get(c, c) for c in partition_by])
        w.option("header", True).option("escape", '"').csv(path)
    else:
        w.parquet(path)


def read_csv_table(spark: SparkSession, path: str, quoting: bool = True, header_row: int = 1,
                   n_rows: int | None = None) -> DataFrame:
    """CSV with a header, all columns as strings (``dtype=str``), optional no-quoting
    and row limit.  ``header_row=2`` skips one leading line before the header; ``n_rows``
    keeps the first rows in order of file and line.  In both cases a row is one line."""
    quotes = {"escape": '"'} if quoting else {"quote": "\u0000"}
    if header_row == 1 and n_rows is None:
        df = spark.read.option("header", True).option("multiLine", quoting).options(**quotes).csv(path)
        return df.select(*[F.col(c).cast("string") for c in df.columns])
    # the first ``header_row`` physical lines of every file go, the last of them names the columns
    lines = numbered_lines(spark, path)
    head = lines.where((F.col("block") == 0) & (F.col("nth") == header_row - 1)).select("value").first()
    if head is None:
        return spark.createDataFrame([], "value string")
    names = next(csv.reader([head[0]], quoting=csv.QUOTE_MINIMAL if quoting else csv.QUOTE_NONE))
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    body = lines.where((F.col("block") > 0) | (F.col("nth") >= header_row))
    if n_rows is not None:
        body = body.orderBy("file", "block", "nth").limit(n_rows)
    return body.select(F.from_csv("value", F.lit(schema), quotes).alias("r")).select("r.*")


def read_trace(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Mining trace — JSON array of {iter, logs_to_query[], logs_to_query_regex[],
    llm_template, cluster_id, update_success, template}; one row per queried log."""
    schema = ("iter long, logs_to_query array<string>, logs_to_query_regex array<string>, llm_template string, "
              "cluster_id long, update_success boolean, template string")
    t = spark.read.schema(schema).option("multiLine", multiline).json(path)
    return t.select("iter", "cluster_id", "update_success", "template", "llm_template",
                    F.posexplode("logs_to_query").alias("k", "log"))
