"""Registered queries: text/CSV/JSON sources and sinks (S1, S5-S8) and the
streaming operators (G1-G5).  File round trips write data that Spark derives
from the given tables into the session's checkpoint folder, then read it back."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from logweave.functions.masks import mask_user
from logweave.operators.events import event_table
from logweave.plans import sqlgen as S
from logweave.plans.common import masked_log, split_log
from logweave.plans.q_match import TPL, _match_ctes, log_templates, parsed_log
from logweave.plans.q_ngram import GRAMS, LOG_TOK, SCORE, _flags_ctes
from logweave.plans.q_sources import _estimate_sql
from logweave.plans.q_mine import TYPE_TOKS, _greedy_sql
from logweave.plans.registry import register
from logweave.session import checkpoint_dir, written
from logweave.sources.files import read_csv_table, read_trace, write_table
from logweave.sources.logformat import compile_format, read_text_log, split_format
from logweave.sources.registry import layout_frame, settings, split_by_layout
from logweave.sources.tables import LOG_LINES_FORMAT, log_lines
from logweave.streaming import stream as G

LOGM = (S.log_lines_cte(), S.split_cte(), S.masked_log_cte())


def _scratch(spark, name):
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


@register("text_log_scan", S.with_(S.log_lines_cte(), S.split_cte(),
          "numbered AS (SELECT line_id, row_number() OVER (ORDER BY line_id % 10 >= 3, line_id) - 1 AS raw_line_id FROM log_lines)") + """
SELECT raw_line_id, "Date" AS date, "Time" AS time, "Pid" AS pid, "Level" AS level, "Component" AS component,
       "Content" AS content FROM split JOIN numbered USING (line_id)""")
def q_text_scan(spark, sf):
    """The derived log written as two text files of unequal size (the larger one last by
    name), scanned back in file and line order, split by its format."""
    path = _scratch(spark, "textlog")
    lines = log_lines(spark, sf)
    for name, part in (("a", F.col("line_id") % 10 < 3), ("b", F.col("line_id") % 10 >= 3)):
        lines.where(part).repartitionByRange("line_id").sortWithinPartitions("line_id").select("value").write.text(f"{path}/{name}")
    s = split_format(read_text_log(spark, f"{path}/*"), LOG_LINES_FORMAT, keep=("raw_line_id",))
    return s.select("raw_line_id", *[F.col(h).alias(h.lower()) for h in ("Date", "Time", "Pid", "Level", "Component", "Content")])


@register("format_split_separator", S.log_lines_cte().join(("WITH ", """
SELECT line_id, 'B' || chr(1) || CAST(line_id AS VARCHAR) AS "Component", chr(1) || truth_template AS "Content" FROM log_lines""")))
def q_split_separator(spark, sf):
    """S2 on lines that hold the control character which joins groups inside the splitter."""
    d = log_lines(spark, sf).select("line_id", F.concat(F.lit("B\u0001"), F.col("line_id").cast("string"), F.lit(": \u0001"),
                                                        F.col("truth_template")).alias("value"))
    return split_format(d, "<Component>: <Content>", keep=("line_id",))


@register("csv_roundtrip", S.with_(*LOGM) + """
SELECT substr(md5(template), 1, 8) AS "EventId", template AS "EventTemplate",
       CAST(count(*) AS VARCHAR) AS "Occurrences" FROM masked GROUP BY template""")
def q_csv(spark, sf):
    """S6 → S5: template table written as CSV, read back with every column a string."""
    path = _scratch(spark, "templates-csv")
    t = event_table(masked_log(spark, sf).withColumnRenamed("template", "event_template"))
    write_table(t.select("event_id", "event_template", "occurrences"), path, fmt="csv")
    return read_csv_table(spark, path)


@register("csv_first_rows", S.with_(*LOGM) + """
SELECT CAST(line_id AS VARCHAR) AS "LineId", '"' || template AS "EventTemplate" FROM masked ORDER BY line_id LIMIT 2000""")
def q_csv_first(spark, sf):
    """A structured log in CSV parts by line range, read without quoting, the first 2,000 rows."""
    path = _scratch(spark, "structured-csv")
    m = masked_log(spark, sf).select("line_id", F.concat(F.col("line_id").cast("string"), F.lit(',"'), F.col("template")).alias("value"))
    parts = m.repartitionByRange("line_id").sortWithinPartitions("line_id").withColumn("part", F.format_string("%08d", F.spark_partition_id()))
    # parts are numbered once, in the table written: a second evaluation may be cut into other ranges
    parts = written(parts)
    head = parts.select("part").distinct().select("part", F.lit(-1).cast("long").alias("line_id"), F.lit("LineId,EventTemplate").alias("value"))
    rows = parts.unionByName(head)
    rows.repartition("part").sortWithinPartitions("part", "line_id").select("part", "value").write.partitionBy("part").text(path)
    return read_csv_table(spark, path, quoting=False, n_rows=2000).select("LineId", "EventTemplate")


@register("append_partitioned", S.with_(*LOGM) + """
, r AS (SELECT 'parsed' AS run, template AS t FROM masked UNION ALL SELECT 'truth', truth_template FROM masked)
SELECT run, t AS event_template, count(*) AS occurrences FROM r GROUP BY ALL""")
def q_append(spark, sf):
    """Two summaries appended to one table partitioned by run, read back."""
    path = _scratch(spark, "summaries")
    m = written(masked_log(spark, sf))
    for run, col in (("parsed", "template"), ("truth", "truth_template")):
        counts = m.groupBy(F.col(col).alias("event_template")).agg(F.count(F.lit(1)).alias("occurrences"))
        write_table(counts.withColumn("run", F.lit(run)), path, mode="append", partition_by=("run",))
    return spark.read.parquet(path).select("run", "event_template", "occurrences")


HDFS = settings("HDFS")


@register("registry_split", S.with_(S.log_lines_cte(), S.split_cte("split", "log_lines", HDFS.log_format)) + f"""
SELECT line_id, {S.rx_replace(S.rx_replace('"Content"', HDFS.masks[0], '<*>'), HDFS.masks[1], '<*>')} AS masked
FROM split""")
def q_registry(spark, sf):
    """Format and user masks taken from the dataset registry (HDFS layout)."""
    s = split_format(log_lines(spark, sf), HDFS.log_format, keep=("line_id",))
    return s.select("line_id", mask_user(F.col("Content"), HDFS.masks).alias("masked"))


# the log's lines written in seven layouts: SQL that runs on both sides, over the header columns
LAYOUTS = {
    "HDFS": """ "Date" || ' ' || "Time" || ' ' || "Pid" || ' ' || "Level" || ' ' || "Component" || ': ' || "Content" """,
    "Spark": """ "Date" || ' ' || "Time" || ' ' || "Level" || ' ' || "Component" || ': ' || "Content" """,
    "HPC": """ 'L' || "Pid" || ' node ' || "Component" || ' up ' || "Time" || ' 1 ' || "Content" """,
    "Apache": """ '[' || "Date" || ' ' || "Time" || '] [' || "Level" || '] ' || "Content" """,
    "Proxifier": """ '[' || "Time" || '] ' || "Component" || ' - ' || "Content" """,
    "Linux": """ 'Jan 12 ' || "Time" || ' ' || "Level" || ' ' || "Component" || CASE WHEN line_id % 2 = 0 THEN '[' || "Pid" || ']' ELSE '' END || ': ' || "Content" """,
    "HealthApp": """ "Time" || '|' || "Component" || '|' || "Pid" || '|' || "Content" """,
}


def _layouts_sql():
    ctes, picks = [S.log_lines_cte(), S.split_cte()], []
    for i, (name, text) in enumerate(LAYOUTS.items()):
        f = settings(name)
        optional = [h for h, o in zip(compile_format(f.log_format).headers, compile_format(f.log_format).optional, strict=True) if o]
        ctes += [f"v{i} AS (SELECT line_id, {text} AS value FROM split)", S.split_cte(f"s{i}", f"v{i}", f.log_format, keep=("line_id",))]
        masked = '"Content"'
        for m in f.masks:
            masked = S.rx_replace(masked, m, "<*>")
        extra = f'"{optional[0]}"' if optional else "CAST(NULL AS VARCHAR)"
        picks.append(f"SELECT '{name}' AS dataset, line_id, \"Content\" AS content, {extra} AS optional, {masked} AS masked, {f.st} AS st FROM s{i}")
    return S.with_(*ctes) + " UNION ALL ".join(picks)


@register("multi_format_split", _layouts_sql())
def q_multi_format(spark, sf):
    """Lines of seven layouts, one with an optional group, split and masked in one plan by the registry's columns."""
    s = split_log(spark, sf)
    forms = F.array(*[F.struct(F.lit(k).alias("dataset"), F.expr(v.replace('"', "`")).alias("value")) for k, v in LAYOUTS.items()])
    lines = s.select("line_id", F.explode(forms).alias("x")).select("line_id", "x.dataset", "x.value")
    return split_by_layout(lines, layout_frame(spark)).select("dataset", "line_id", "content", "optional", "masked", "st")


@register("trace_source", S.with_(*LOGM) + """
, firsts AS (SELECT template, min(line_id) AS first_line FROM masked GROUP BY template)
SELECT f.first_line AS iter, CAST(0 AS BIGINT) AS k, m.content AS log, f.template AS template
FROM firsts f JOIN masked m ON m.line_id = f.first_line""")
def q_trace(spark, sf):
    """A mining trace (one iteration per template, the first line queried) written as
    JSON and read back through the trace schema."""
    path = _scratch(spark, "trace")
    m = masked_log(spark, sf)
    firsts = m.groupBy("template").agg(F.min("line_id").alias("first_line"))
    tr = firsts.join(m, m["line_id"] == firsts["first_line"]).select(
        F.col("first_line").alias("iter"), F.array(F.col("content")).alias("logs_to_query"),
        F.array(F.col("content")).alias("logs_to_query_regex"), firsts["template"].alias("llm_template"),
        F.col("first_line").alias("cluster_id"), F.lit(True).alias("update_success"),
        firsts["template"].alias("template"))
    tr.write.json(path)
    t = read_trace(spark, path, multiline=False)
    return t.select("iter", F.col("k").cast("long").alias("k"), "log", "template")


# --- streaming -----------------------------------------------------------------
@register("stream_mask", S.with_(*LOGM) + "SELECT line_id, content, template FROM masked")
def q_stream_mask(spark, sf):
    return G.stream_mask(spark, sf).select("line_id", "content", "template")


@register("stream_match", S.with_(*LOGM, TPL, *_match_ctes("masked", "tpl", "m1")) + """
SELECT line_id, event_id, event_template FROM m1""")
def q_stream_match(spark, sf):
    return G.stream_match(spark, sf, log_templates(parsed_log(spark, sf))).select("line_id", "event_id", "event_template")


@register("stream_mine", _greedy_sql(TYPE_TOKS, "lt"))
def q_stream_mine(spark, sf):
    """Templates as of each batch (here one batch: those of the whole stream)."""
    return G.stream_mine(spark, sf)


@register("stream_ngram", S.with_(*LOG_TOK, *GRAMS, *SCORE, *_flags_ctes()) + """
SELECT line_id, event_template FROM tp""")
def q_stream_ngram(spark, sf):
    return G.stream_ngram(spark, sf).select("line_id", "event_template")


@register("stream_estimate", _estimate_sql((S.log_lines_cte(), S.split_cte()), "split", '"Content"'))
def q_stream_estimate(spark, sf):
    return G.stream_estimate_masks(spark, sf).select("line_id", "masked")
