"""Shared building blocks of the registered queries (Spark side)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.masks import mask_non_ascii, mask_types
from logweave.functions.tokens import tokenize
from logweave.sources.logformat import split_format
from logweave.sources.tables import LOG_LINES_FORMAT, log_lines, text_lines


def split_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log_lines → header split: (line_id, truth_template, Date, Time, Pid, Level, Component, Content)."""
    return split_format(log_lines(spark, sf_dir), LOG_LINES_FORMAT, keep=("line_id", "truth_template"))


def masked_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, truth_template, content, template): the masked-message parse."""
    s = split_log(spark, sf_dir)
    return s.select("line_id", "truth_template", F.col("Content").alias("content"),
                    F.array_join(tokenize(mask_types(F.col("Content"))), " ").alias("template"))


def ascii_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text_lines with non-ASCII runs tagged (so RE2 and Java agree on word bounds)."""
    return text_lines(spark, sf_dir).withColumn("value", mask_non_ascii(F.col("value")))


def masked_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, value, template): whole text lines through the mask chain."""
    t = ascii_text_lines(spark, sf_dir)
    return t.select("doc_id", "pos", "line_id", "value",
                    F.array_join(tokenize(mask_types(F.col("value"))), " ").alias("template"))
