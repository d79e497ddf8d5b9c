"""Ground-truth preparation pipeline (L1-L5) as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.correct import correct_truth
from logweave.functions.tokens import valid_value
from logweave.operators.matching import dense_index, literal_length, match_templates, restrict_lines, \
    wildcard_occurrences
from logweave.session import written


def label_templates(labels: DataFrame, label_col: str | None = None, correct=correct_truth) -> DataFrame:
    """L1: 4th column → non-empty stripped lines → distinct → ordered by literal length
    desc then wildcards → ids E1..En → corrected.  (event_id, event_template)."""
    col = label_col or labels.columns[3]
    lines = labels.where(F.col(col).isNotNull()).select(F.explode(F.split(col, "\n")).alias("t"))
    t = lines.select(F.regexp_replace("t", r"^\s+|\s+$", "").alias("t")).where(F.col("t") != "").distinct()
    # ties of (length, wildcards) are ordered by the template text (the reference's set order is arbitrary)
    idx = dense_index(t, [-literal_length(F.col("t")), wildcard_occurrences(F.col("t")), F.col("t")])
    return idx.select(F.concat(F.lit("E"), F.col("idx").cast("string")).alias("event_id"),
                      correct(F.col("t")).alias("event_template"), F.col("idx"))


def clean_structured(df: DataFrame, content: str = "content", event_id: str = "event_id",
                     template: str = "event_template") -> DataFrame:
    """L2: drop the parameter list; drop rows whose content/id/template is NULL or 'NONE'."""
    out = df.drop("parameters") if "parameters" in df.columns else df
    return out.where(valid_value(F.col(content)) & valid_value(F.col(event_id)) & valid_value(F.col(template)))


def clean_templates(df: DataFrame, event_id: str = "event_id", template: str = "event_template",
                    occurrences: str = "occurrences") -> DataFrame:
    """L3: drop NULL/'NONE' ids and templates and non-positive occurrences."""
    return df.where(valid_value(F.col(event_id)) & valid_value(F.col(template))
                    & F.col(occurrences).isNotNull() & (F.col(occurrences) > 0))


def template_occurrences(structured: DataFrame, event_id: str = "event_id",
                         template: str = "event_template") -> DataFrame:
    return structured.where(F.col(template).isNotNull()).groupBy(event_id, template) \
                     .agg(F.count(F.lit(1)).alias("occurrences"))


def rematch_clean_log(lines: DataFrame, templates: DataFrame, content: str = "content",
                      key: str = "line_id") -> tuple[DataFrame, DataFrame]:
    """L4: match → clean → keep the cleaned lines → match again with the cleaned
    templates → (key, content, event_id, event_template); also the final template table."""
    first = match_templates(lines, templates, content, key)
    structured = lines.select(key, content).join(first, key)
    # read by the templates and by the restriction, each read twice: the first match runs once
    cleaned = written(clean_structured(structured, content).select(key, "event_id", "event_template"))
    kept_templates = clean_templates(template_occurrences(cleaned))
    relog = restrict_lines(lines, cleaned, key)
    second = match_templates(relog, kept_templates, content, key)
    out = relog.select(key, content).join(second, key)
    return out.select(key, content, "event_id", "event_template"), template_occurrences(out)


def template_diff(original: DataFrame, final: DataFrame, template: str = "event_template") -> DataFrame:
    """Templates of the original list missing from the final one (set difference)."""
    return original.select(template).subtract(final.select(template))
