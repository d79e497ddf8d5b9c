"""Event table (C10) and the masked-message baseline parser.

The event table is one hash aggregate keyed by template: partial aggregation
runs map-side, so only (template, partial count, partial min) crosses the
shuffle — a hot template costs one row per map task, not its line count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.masks import mask_types
from logweave.functions.tokens import event_id, tokenize


def masked_templates(df: DataFrame, content: str = "Content", out: str = "event_template",
                     types=None) -> DataFrame:
    """Baseline parse: mask chain → whitespace tokens → blank-joined template."""
    return df.withColumn(out, F.array_join(tokenize(mask_types(F.col(content), types)), " "))


def event_table(df: DataFrame, template: str = "event_template", order_col: str = "line_id") -> DataFrame:
    """(event_id, event_template, occurrences, first_line_id); first-seen order = first_line_id."""
    return (df.groupBy(F.col(template).alias("event_template"))
              .agg(F.count(F.lit(1)).alias("occurrences"), F.min(order_col).alias("first_line_id"))
              .select(event_id(F.col("event_template")).alias("event_id"), "event_template",
                      "occurrences", "first_line_id"))


def with_event_ids(df: DataFrame, template: str = "event_template") -> DataFrame:
    """Structured table: add ``event_id`` (md5 prefix) next to the template."""
    return df.withColumn("event_id", event_id(F.col(template)))
