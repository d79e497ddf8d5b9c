"""Registered queries: template matching (M3, M4, T5), semi/restriction joins
(J3, J4) and the ground-truth preparation pipeline (L1-L5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave.functions.correct import correct_truth
from logweave.functions.tokens import event_id, tokenize
from logweave.operators import matching as MT
from logweave.operators import truth as L
from logweave.plans import sqlgen as S
from logweave.plans.common import masked_log
from logweave.plans.q_correct import TRUTH_PROGRAM
from logweave.plans.q_tokens import _params_sql, sql_possim, sql_threshold
from logweave.plans.registry import register
from logweave.session import written
from logweave.sources.tables import read_table

LOGM = (S.log_lines_cte(), S.split_cte(), S.masked_log_cte())


def parsed_log(spark, sf):
    """The masked parse as a table: read by the lines and by the templates, so that the regex chains run once."""
    return written(masked_log(spark, sf))


def log_templates(m):
    """Template table derived from the data: truth templates ∪ masked-parse templates."""
    t = m.select(F.col("truth_template").alias("event_template")).unionByName(
        m.select(F.col("template").alias("event_template"))).distinct()
    return t.select(event_id(F.col("event_template")).alias("event_id"), "event_template")


def log_content(m):
    return m.select("line_id", "content")


TPL = ("tpl AS (SELECT DISTINCT substr(md5(t), 1, 8) AS event_id, t AS event_template FROM "
       "(SELECT truth_template AS t FROM masked UNION ALL SELECT template FROM masked))")


def _match_ctes(lines: str, tpl: str, name: str) -> tuple[str, ...]:
    lit = "length(replace(replace(event_template, '<*>', ''), ' ', ''))"
    wc = "(length(event_template) - length(replace(event_template, '<*>', ''))) / 3"
    return (
        f"{name}_p AS (SELECT event_id, event_template, {_params_sql('', 'event_template')} AS pat, "
        f"-{lit} AS pa, {wc} AS pb FROM {tpl})",
        f"{name}_c AS (SELECT l.line_id, p.event_id, p.event_template, row_number() OVER (PARTITION BY l.line_id "
        f"ORDER BY p.pa, p.pb, p.event_id) AS r FROM {lines} l JOIN {name}_p p ON regexp_matches(l.content, p.pat))",
        f"{name} AS (SELECT l.line_id, l.content, c.event_id, c.event_template FROM {lines} l "
        f"LEFT JOIN {name}_c c ON c.line_id = l.line_id AND c.r = 1)",
    )


@register("template_match", S.with_(*LOGM, TPL, *_match_ctes("masked", "tpl", "m1")) + """
SELECT line_id, event_id, event_template FROM m1""")
def q_template_match(spark, sf):
    m = parsed_log(spark, sf)
    return MT.match_templates(log_content(m), log_templates(m))


@register("template_match_dotall", S.with_(*LOGM, TPL) + """
, p AS (SELECT event_id, event_template, '(?s)\\Q' || replace(replace(event_template, '\\E', '\\E\\\\E\\Q'), '<*>',
        '\\E.*?\\Q') || '\\E' AS pat, -length(replace(replace(event_template, '<*>', ''), ' ', '')) AS pa,
        (length(event_template) - length(replace(event_template, '<*>', ''))) / 3 AS pb FROM tpl),
c AS (SELECT l.line_id, p.event_id, p.event_template, row_number() OVER (PARTITION BY l.line_id
      ORDER BY p.pa, p.pb, p.event_id) AS r FROM masked l JOIN p ON regexp_full_match(l.content, p.pat))
SELECT l.line_id, c.event_id, c.event_template FROM masked l LEFT JOIN c ON c.line_id = l.line_id AND c.r = 1""")
def q_template_match_dotall(spark, sf):
    """C3d-style matching: DOTALL full match of the escaped template, wildcard → ``.*?``."""
    m = parsed_log(spark, sf)
    return MT.match_templates(log_content(m), log_templates(m), kind="describe")


_FS, _FP = sql_possim("t.tt", "m.tokens", "fixed")
_DS, _DP = sql_possim("t.tt", "m.tokens", "dynamic")


def _best_sql(sim: str, par: str, thr: str) -> str:
    return S.with_(*LOGM,
                   f"msg AS (SELECT DISTINCT {S.tokens_sql('content')} AS tokens FROM masked)",
                   f"tt AS (SELECT row_number() OVER (ORDER BY truth_template) AS tid, "
                   f"{S.tokens_sql('truth_template')} AS tt FROM (SELECT DISTINCT truth_template FROM masked))",
                   f"pr AS (SELECT m.tokens, t.tid, {sim} AS sim, {par} AS par FROM msg m JOIN tt t "
                   f"ON len(m.tokens) = len(t.tt))",
                   "rk AS (SELECT *, row_number() OVER (PARTITION BY tokens ORDER BY sim DESC, par DESC, tid) AS r "
                   "FROM pr)") + f"""
SELECT array_to_string(tokens, ' ') AS message, CAST(CASE WHEN sim >= {thr} THEN tid ELSE -1 END AS BIGINT) AS cluster_id,
       round(sim, 6) AS similarity FROM rk WHERE r = 1"""


def _best(spark, sf, variant, threshold):
    m = masked_log(spark, sf)
    msgs = m.select(tokenize(F.col("content")).alias("tokens")).distinct() \
            .withColumn("message", F.array_join("tokens", " "))
    truth = m.select("truth_template").distinct()
    tt = MT.dense_index(truth, [F.col("truth_template")], out="cluster_id") \
           .select("cluster_id", tokenize(F.col("truth_template")).alias("template_tokens"))
    b = MT.best_template(msgs, tt, key="message", variant=variant, threshold=threshold)
    return b.select("message", "cluster_id", "similarity")


@register("best_template", _best_sql(_FS, _FP, "0.4"))
def q_best_fixed(spark, sf):
    return _best(spark, sf, "fixed", 0.4)


@register("best_template_dynamic", _best_sql(_DS, _DP, sql_threshold("len(m.tokens)").replace("m.tokens", "tokens")))
def q_best_dynamic(spark, sf):
    return _best(spark, sf, "dynamic", None)


@register("semi_filter", S.with_(*LOGM) + """
SELECT line_id FROM masked WHERE truth_template IN (SELECT template FROM masked)""")
def q_semi(spark, sf):
    m = masked_log(spark, sf)
    return m.join(m.select(F.col("template").alias("truth_template")).distinct(), "truth_template",
                  "left_semi").select("line_id")


# --- ground-truth preparation -------------------------------------------------
LT = ("lt AS (SELECT t, row_number() OVER (ORDER BY -length(replace(replace(t, '<*>', ''), ' ', '')), "
      "(length(t) - length(replace(t, '<*>', ''))) / 3, t) AS idx FROM (SELECT DISTINCT "
      "regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS t FROM (SELECT unnest(string_split(text, chr(10))) AS x "
      "FROM conversations WHERE text IS NOT NULL)) WHERE t <> '')")


@register("label_templates", "WITH RECURSIVE " + ",\n".join(
    (LT, S.fixpoint_program_sql("lt", "idx", "t", TRUTH_PROGRAM))) + """
SELECT 'E' || CAST(idx AS VARCHAR) AS event_id, t AS event_template FROM prog""")
def q_label_templates(spark, sf):
    labels = read_table(spark, sf, "conversations")
    return L.label_templates(labels, correct=correct_truth).select("event_id", "event_template")


def _structured(m):
    lines = log_content(m)
    return lines.join(MT.match_templates(lines, log_templates(m)), "line_id")


STRUCT = S.with_(*LOGM, TPL, *_match_ctes("masked", "tpl", "m1"))
CLEAN_WHERE = ("content IS NOT NULL AND content <> 'NONE' AND event_id IS NOT NULL AND event_id <> 'NONE' "
               "AND event_template IS NOT NULL AND event_template <> 'NONE'")


@register("clean_structured", STRUCT + f"SELECT line_id, content, event_id, event_template FROM m1 WHERE {CLEAN_WHERE}")
def q_clean_structured(spark, sf):
    return L.clean_structured(_structured(parsed_log(spark, sf))).select("line_id", "content", "event_id", "event_template")


@register("clean_templates", STRUCT + f"""
SELECT event_id, event_template, count(*) AS occurrences FROM m1 WHERE {CLEAN_WHERE} GROUP BY ALL""")
def q_clean_templates(spark, sf):
    c = L.clean_structured(_structured(parsed_log(spark, sf)))
    return L.clean_templates(L.template_occurrences(c))


REMATCH = S.with_(
    *LOGM, TPL, *_match_ctes("masked", "tpl", "m1"),
    f"cl AS (SELECT * FROM m1 WHERE {CLEAN_WHERE})",
    "ct AS (SELECT event_id, event_template FROM cl GROUP BY ALL HAVING count(*) > 0)",
    "relog AS (SELECT line_id, content FROM masked WHERE line_id IN (SELECT line_id FROM cl))",
    *_match_ctes("relog", "ct", "m2"))


@register("rematch_clean_log", REMATCH + "SELECT line_id, content, event_id, event_template FROM m2")
def q_rematch(spark, sf):
    m = parsed_log(spark, sf)
    out, _ = L.rematch_clean_log(log_content(m), log_templates(m))
    return out


@register("line_restrict", REMATCH + "SELECT line_id FROM relog")
def q_line_restrict(spark, sf):
    m = parsed_log(spark, sf)
    c = L.clean_structured(_structured(m))
    return MT.restrict_lines(log_content(m), c).select("line_id")


@register("template_diff", REMATCH + """
SELECT event_template FROM tpl EXCEPT SELECT event_template FROM m2 WHERE event_template IS NOT NULL""")
def q_template_diff(spark, sf):
    m = parsed_log(spark, sf)
    _, final = L.rematch_clean_log(log_content(m), log_templates(m))
    return L.template_diff(log_templates(m), final)


@register("parameters_matched", STRUCT + """
, pp AS (SELECT line_id, content, event_template, """ + _params_sql("content", "event_template") + """ AS pat,
         CAST((length(event_template) - length(replace(event_template, '<*>', ''))) / 3 AS BIGINT) AS n FROM m1)
SELECT line_id, CASE WHEN n > 0 AND regexp_matches(content, pat)
            THEN array_to_string([regexp_extract(content, pat, 1), regexp_extract(content, pat, 2),
                                  regexp_extract(content, pat, 3)][1:n], '|') ELSE '' END AS params
FROM pp WHERE event_template IS NOT NULL""")
def q_params_matched(spark, sf):
    """T5 on the structured output of the match join (the ``keep_para`` column)."""
    from logweave.functions.tokens import extract_parameters
    s = _structured(parsed_log(spark, sf)).where(F.col("event_template").isNotNull())
    return s.select("line_id", F.array_join(extract_parameters(F.col("content"), F.col("event_template")), "|")
                    .alias("params"))
