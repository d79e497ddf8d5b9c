"""Registered queries: sources, format split, masking, event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave.functions import masks as M
from logweave.functions.tokens import event_id, tokenize
from logweave.operators.events import event_table
from logweave.plans import sqlgen as S
from logweave.plans.common import ascii_text_lines, masked_log, split_log
from logweave.plans.registry import register
from logweave.sources.logformat import compile_format, content_tokens, load_rate, split_content, split_with_load_rate
from logweave.sources.tables import LOG_LINES_FORMAT, log_lines, text_lines

LL = S.log_lines_cte()
SPLIT = S.split_cte()
MASKED = S.masked_log_cte()
TL = S.text_lines_cte()
HEAD_RX = compile_format("<Head>. <Content>").pattern
TLA = ("text_ascii AS (SELECT doc_id, pos, line_id, "
       + S.rx_replace("value", M.NON_ASCII, M.NON_ASCII_TAG) + " AS value FROM text_lines)")


@register("event_table", S.with_(LL, SPLIT, MASKED) + """
SELECT substr(md5(template), 1, 8) AS event_id, template AS event_template,
       count(*) AS occurrences, min(line_id) AS first_line_id
FROM masked GROUP BY template""")
def q_event_table(spark, sf):
    return event_table(masked_log(spark, sf).withColumnRenamed("template", "event_template"))


@register("format_split", S.with_(LL, SPLIT) + """
SELECT line_id, "Date" AS date, "Time" AS time, "Pid" AS pid, "Level" AS level,
       "Component" AS component, "Content" AS content FROM split""")
def q_format_split(spark, sf):
    s = split_log(spark, sf)
    return s.select("line_id", *[F.col(h).alias(h.lower()) for h in
                                 ("Date", "Time", "Pid", "Level", "Component", "Content")])


@register("content_split", S.with_(TL, TLA, S.split_cte(
    "split", "text_ascii", "<Lead>, <Content>", keep=("line_id",), headers=("Content",))) + """
SELECT line_id, "Content" AS content FROM split""")
def q_content_split(spark, sf):
    t = ascii_text_lines(spark, sf)
    return split_content(t, "<Lead>, <Content>", keep=("line_id",)).withColumnRenamed("Content", "content")


@register("load_rate", S.with_(TL) + f"""
SELECT count(*) AS total_lines,
       CAST(count_if(regexp_matches({S.strip_sql('value')}, {S.q(HEAD_RX)})) AS BIGINT) AS matched_lines,
       round(count_if(regexp_matches({S.strip_sql('value')}, {S.q(HEAD_RX)})) / count(*), 6) AS load_rate
FROM text_lines WHERE {S.strip_sql('value')} <> ''""")
def q_load_rate(spark, sf):
    return load_rate(text_lines(spark, sf), "<Head>. <Content>")


@register("split_nonascii", S.with_(TL, S.split_cte(
    "split", "(SELECT line_id, " + S.rx_replace("value", M.NON_ASCII, M.NON_ASCII_TAG)
    + f" AS value FROM text_lines WHERE {S.strip_sql('value')} <> '')", "<Head>. <Content>",
    keep=("line_id",))) + """
SELECT line_id, "Head" AS head, "Content" AS content FROM split""")
def q_split_nonascii(spark, sf):
    df = split_with_load_rate(text_lines(spark, sf), "<Head>. <Content>", keep=("line_id",))
    return df.select("line_id", F.col("Head").alias("head"), F.col("Content").alias("content"))


def _mask_sql(typed: bool) -> str:
    return S.with_(TL, TLA) + f"""
SELECT line_id, {S.mask_chain_sql('value', typed=typed)} AS masked FROM text_ascii"""


@register("mask_types", _mask_sql(False))
def q_mask_types(spark, sf):
    t = ascii_text_lines(spark, sf)
    return t.select("line_id", M.mask_types(F.col("value")).alias("masked"))


@register("mask_typed_tags", _mask_sql(True))
def q_mask_typed(spark, sf):
    t = ascii_text_lines(spark, sf)
    return t.select("line_id", M.mask_types(F.col("value"), typed=True).alias("masked"))


def _detect_sql() -> str:
    steps = []
    for i, t in enumerate(M.MASK_ORDER):
        src = "value" if i == 0 else f"s{i - 1}"
        steps.append(f"st{i} AS (SELECT *, {S.rx_replace(src, M.MASK_PATTERNS[t], '<*>')} AS s{i} "
                     f"FROM {'text_ascii' if i == 0 else f'st{i - 1}'})")
    flags = []
    for i, t in enumerate(M.MASK_ORDER):
        before = "value" if i == 0 else f"s{i - 1}"
        flags.append(f"CASE WHEN s{i} <> {before} THEN '{t}' END")
    return S.with_(TL, TLA, *steps) + f"""
SELECT line_id, concat_ws(',', {', '.join(flags)}) AS matched_types FROM st{len(M.MASK_ORDER) - 1}"""


@register("mask_detect", _detect_sql())
def q_mask_detect(spark, sf):
    t = ascii_text_lines(spark, sf)
    d = M.detect_mask_types(t, "value")
    return d.select("line_id", F.array_join("matched_types", ",").alias("matched_types"))


def _estimate_sql(ctes=None, source: str = "text_ascii", col: str = "value") -> str:
    ctes = (TL, TLA) if ctes is None else ctes
    steps = []
    for i, t in enumerate(M.MASK_ORDER):
        src = "value" if i == 0 else f"s{i - 1}"
        steps.append(f"st{i} AS (SELECT *, {S.rx_replace(src, M.MASK_PATTERNS[t], '<*>')} AS s{i} "
                     f"FROM {'head' if i == 0 else f'st{i - 1}'})")
    seen = ", ".join(
        f"bool_or(s{i} <> {'value' if i == 0 else f's{i - 1}'}) AS has_{t}" for i, t in enumerate(M.MASK_ORDER))
    # pruned chain: step k applied only when type k was seen in the warm-up
    chain = []
    for i, t in enumerate(M.MASK_ORDER):
        src = "value" if i == 0 else f"p{i - 1}"
        chain.append(f"pc{i} AS (SELECT *, CASE WHEN has_{t} THEN {S.rx_replace(src, M.MASK_PATTERNS[t], '<*>')} "
                     f"ELSE {src} END AS p{i} FROM {'src_lines CROSS JOIN seen' if i == 0 else f'pc{i - 1}'})")
    pruned = S.rx_replace("p13", M.WILDCARD_RUN, "<*>")
    full = S.mask_chain_sql("value")
    return S.with_(*ctes, f"head AS (SELECT line_id, {col} AS value FROM {source} ORDER BY line_id LIMIT 2000)",
                   *steps, f"seen AS (SELECT {seen}, max(line_id) AS cut, count(*) AS n FROM st13)",
                   f"src_lines AS (SELECT line_id, {col} AS value FROM {source})", *chain) + f"""
SELECT line_id, CASE WHEN n < 2000 OR line_id <= cut THEN {full} ELSE {pruned} END AS masked
FROM pc13"""


@register("mask_estimate", _estimate_sql())
def q_mask_estimate(spark, sf):
    t = ascii_text_lines(spark, sf)
    return M.mask_estimated(t, "value").select("line_id", "masked")


USER_MASKS = [r"user=\w+", r"id=\d+"]
REMOVALS = [r"ssh2$"]


@register("user_mask", S.with_(LL, SPLIT) + f"""
SELECT line_id, {S.rx_replace(S.rx_replace(S.rx_replace('"Content"', REMOVALS[0], ''), USER_MASKS[0], '<*>'),
                              USER_MASKS[1], '<*>')} AS masked FROM split""")
def q_user_mask(spark, sf):
    s = split_log(spark, sf)
    c = M.mask_user(M.mask_user(F.col("Content"), REMOVALS, ""), USER_MASKS)
    return s.select("line_id", c.alias("masked"))


@register("general_mask", S.with_(TL, TLA) + f"SELECT line_id, {S.general_masks_sql('value')} AS masked FROM text_ascii")
def q_general_mask(spark, sf):
    """A blank before the line, then the host, address and number masks."""
    return ascii_text_lines(spark, sf).select("line_id", M.mask_general(F.col("value")).alias("masked"))


ERROR_FORMAT = "<Date> <Time> <Pid> ERROR <Component>: <Content>"


@register("content_tokens", S.with_(S.log_lines_cte(), S.split_cte("errors", "log_lines", ERROR_FORMAT)) + f"""
SELECT l.line_id, array_to_string({S.tokens_sql(S.general_masks_sql('e."Content"'))}, ' ') AS tokens
FROM log_lines l LEFT JOIN errors e USING (line_id)""")
def q_content_tokens(spark, sf):
    """Content, general masks, tokens of every line; NULL where the line is not of the format (here: no error)."""
    lines = log_lines(spark, sf).select("line_id", "value")
    return content_tokens(lines, ERROR_FORMAT).select("line_id", F.array_join("tokens", " ").alias("tokens"))


@register("collapse_wildcards", S.with_(TL, TLA) + f"""
SELECT line_id, {S.rx_replace(S.mask_chain_sql('value', collapse=False), M.WILDCARD_RUN, '<*>')} AS masked
FROM text_ascii""")
def q_collapse(spark, sf):
    t = ascii_text_lines(spark, sf)
    return t.select("line_id", M.collapse_wildcards(M.mask_types(F.col("value"), collapse=False)).alias("masked"))
