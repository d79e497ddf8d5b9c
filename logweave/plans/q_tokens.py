"""Registered queries: tokenising and scalar template functions.

Pairs are formed only by equi-keys that exist in the data — a line's parse vs
its truth template, or consecutive lines of one document — never a cross join.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave.functions import tokens as T
from logweave.functions.masks import mask_types
from logweave.plans import sqlgen as S
from logweave.plans.common import ascii_text_lines, masked_log, masked_text
from logweave.plans.registry import register
from logweave.session import written

LL, SPLIT, MASKED = S.log_lines_cte(), S.split_cte(), S.masked_log_cte()
TL = S.text_lines_cte()
TLA = ("text_ascii AS (SELECT doc_id, pos, line_id, "
       + S.rx_replace("value", r"[^\x00-\x7F]+", "<N/ASCII>") + " AS value FROM text_lines)")
MT = ("mt AS (SELECT doc_id, pos, line_id, value, "
      + S.join_tokens_sql(S.tokens_sql(S.mask_chain_sql("value"))) + " AS template FROM text_ascii)")
LOG = S.with_(LL, SPLIT, MASKED)
TEXT = S.with_(TL, TLA, MT)
TEXT_PAIRS = S.with_(TL, TLA, MT, "tp AS (SELECT a.line_id, a.template AS t1, b.template AS t2 FROM mt a "
                     "JOIN mt b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1)")


def text_pairs(spark, sf):
    """Consecutive lines of a document, as (line_id, t1, t2) — an equi-join on (doc_id, pos+1)."""
    # both sides of the join read it: the regex chain runs once
    m = written(masked_text(spark, sf).select("doc_id", "pos", "line_id", "template"), release=True)
    a = m.select("doc_id", "pos", "line_id", F.col("template").alias("t1"))
    b = m.select("doc_id", (F.col("pos") - 1).alias("pos"), F.col("template").alias("t2"))
    return a.join(b, ["doc_id", "pos"]).select("line_id", "t1", "t2")


# --- SQL renderings of the column functions --------------------------------
def sql_describes(t1: str, t2: str) -> str:
    body = f"replace(replace({t1}, '\\E', '\\E\\\\E\\Q'), '<*>', '\\E.*?\\Q')"
    return f"regexp_full_match({t2}, '(?s)\\Q' || {body} || '\\E')"


def sql_is_abstract(x: str, y: str) -> str:
    body = f"replace({x}, '\\E', '\\E\\\\E\\Q')"
    body = f"regexp_replace({body}, '\\s', '\\\\E\\\\s+\\\\Q', 'g')"
    body = f"replace({body}, '<*>', '\\E(\\S+?)\\Q')"
    return f"CASE WHEN {y} IS NULL THEN false ELSE coalesce(regexp_matches({y}, '^\\Q' || {body} || '\\E$'), false) END"


def sql_alnum_set(t: str) -> str:
    return f"list_distinct(list_filter({S.tokens_sql(t)}, lambda x: regexp_matches(x, '[A-Za-z0-9]')))"


def sql_jaccard(a: str, b: str) -> str:
    i = f"len(list_intersect({sql_alnum_set(a)}, {sql_alnum_set(b)}))"
    u = f"(len({sql_alnum_set(a)}) + len({sql_alnum_set(b)}) - {i})"
    return f"CASE WHEN {u} = 0 THEN 0.0 ELSE {i} / {u} END"


def sql_is_param(x: str, variant: str) -> str:
    if variant == "fixed":
        return f"({x} = '<*>')"
    return f"(contains({x}, '<*>') AND NOT regexp_matches({x}, '[A-Za-z0-9]'))"


def sql_possim(a: str, b: str, variant: str) -> tuple[str, str]:
    rng = f"range(1, len({a}) + 1)"
    eq = f"len(list_filter({rng}, lambda i: NOT {sql_is_param(f'{a}[i]', variant)} AND {a}[i] = {b}[i]))"
    par = f"len(list_filter({rng}, lambda i: {sql_is_param(f'{a}[i]', variant)}))"
    return f"{eq} / len({a})", par


def sql_threshold(n: str) -> str:
    whens = " ".join(f"WHEN {k} THEN CAST({v!r} AS DOUBLE)" for k, v in T.DYNAMIC_THRESHOLDS.items())
    return f"CASE {n} {whens} ELSE CAST({T.DYNAMIC_THRESHOLD_OTHERS!r} AS DOUBLE) END"


# --- queries ------------------------------------------------------------------
@register("tokenise", TEXT + f"""
SELECT line_id, CAST(len({S.tokens_sql('value')}) AS BIGINT) AS n_tokens,
       array_to_string({S.tokens_sql('value')}, '|') AS tokens FROM text_ascii""")
def q_tokenise(spark, sf):
    t = ascii_text_lines(spark, sf).withColumn("tk", T.tokenize(F.col("value")))
    return t.select("line_id", F.size("tk").cast("long").alias("n_tokens"),
                    F.array_join("tk", "|").alias("tokens"))


def _rot_sql(k: int, n_rot: int) -> str:
    tk = S.tokens_sql("template")
    padded = (f"CASE WHEN len({tk}) < {n_rot} THEN list_concat({tk}, list_transform(range({n_rot} - len({tk}) + 1), "
              f"lambda x: '_')) ELSE {tk} END")
    return padded


@register("rotate_tokens", LOG + f"""
, rot AS (SELECT line_id, {_rot_sql(2, 3)} AS p FROM masked)
SELECT line_id, array_to_string(r, ' ') AS rotated,
       array_to_string(r[-2:], ' ') || ' ' || array_to_string(r[1:len(r) - 2], ' ') AS restored
FROM (SELECT line_id, list_concat(p[3:], p[1:2]) AS r FROM rot)""")
def q_rotate(spark, sf):
    m = masked_log(spark, sf)
    p = T.pad_for_rotation(T.tokenize(F.col("template")), 3)
    r = F.array_join(T.rotate(p, 2), " ")
    return m.select("line_id", r.alias("rotated"), T.unrotate_template(r, 2).alias("restored"))


@register("event_id", TEXT + """
SELECT DISTINCT template, substr(md5(template), 1, 8) AS event_id FROM mt""")
def q_event_id(spark, sf):
    m = masked_text(spark, sf).select("template").distinct()
    return m.select("template", T.event_id(F.col("template")).alias("event_id"))


@register("short_event_id", TEXT + """
SELECT DISTINCT template, substr(CAST(CAST('0x' || md5(template) AS UHUGEINT) AS VARCHAR), 1, 4) AS short_id FROM mt""")
def q_short_event_id(spark, sf):
    """T4: first four digits of md5 as an integer."""
    m = masked_text(spark, sf).select("template").distinct()
    return m.select("template", T.short_event_id(F.col("template")).alias("short_id"))


def _params_sql(content: str, template: str) -> str:
    t = f"regexp_replace({template}, '<.{{1,5}}>', '<*>', 'g')"
    t = f"regexp_replace({t}, '([\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E ])', '\\\\\\1', 'g')"
    t = f"regexp_replace({t}, '\\\\ +', '\\\\s+', 'g')"
    t = f"'^' || replace({t}, '\\<\\*\\>', '(.*?)') || '$'"
    return t


@register("parameters", LOG + f"""
, pp AS (SELECT line_id, content, truth_template, {_params_sql('content', 'truth_template')} AS pat,
         CAST((length(regexp_replace(truth_template, '<.{{1,5}}>', '<*>', 'g'))
               - length(replace(regexp_replace(truth_template, '<.{{1,5}}>', '<*>', 'g'), '<*>', ''))) / 3 AS BIGINT) AS n
         FROM masked)
SELECT line_id, n AS n_params,
       CASE WHEN n > 0 AND regexp_matches(content, pat)
            THEN array_to_string([regexp_extract(content, pat, 1), regexp_extract(content, pat, 2),
                                  regexp_extract(content, pat, 3)][1:n], '|') ELSE '' END AS params
FROM pp""")
def q_parameters(spark, sf):
    m = masked_log(spark, sf)
    p = T.extract_parameters(F.col("content"), F.col("truth_template"))
    n = T.wildcard_count(F.regexp_replace("truth_template", r"<.{1,5}>", "<*>"))
    return m.select("line_id", n.cast("long").alias("n_params"), F.array_join(p, "|").alias("params"))


@register("template_features", TEXT + """
SELECT line_id, CAST((length(template) - length(replace(template, '<*>', ''))) / 3 AS BIGINT) AS n_wildcards,
       CAST(len(""" + S.tokens_sql("template") + """) AS BIGINT) AS n_tokens,
       CAST(length(regexp_replace(replace(template, '<*>', ''), '\\s', '', 'g')) AS BIGINT) AS literal_length,
       CAST(len(list_filter(""" + S.tokens_sql("template") + """, lambda x: regexp_matches(x, '\\d'))) AS BIGINT)
         AS digit_tokens,
       """ + f"list_filter({S.tokens_sql('template')}, lambda x: NOT contains(x, '<*>'))[1]" + """ AS first_constant
FROM mt""")
def q_template_features(spark, sf):
    m = masked_text(spark, sf).select("line_id", "template", T.tokenize(F.col("template")).alias("tokens"))  # read three times below
    tk = F.col("tokens")
    return m.select("line_id", T.wildcard_count(F.col("template")).cast("long").alias("n_wildcards"),
                    F.size(tk).cast("long").alias("n_tokens"),
                    T.template_length(F.col("template")).cast("long").alias("literal_length"),
                    F.size(F.filter(tk, T.has_digit)).cast("long").alias("digit_tokens"),
                    T.first_constant(tk).alias("first_constant"))


@register("describes_pairs", LOG + f"""
SELECT line_id, {sql_describes('template', 'truth_template')} AS parse_describes_truth,
       {sql_describes('truth_template', 'template')} AS truth_describes_parse,
       {sql_describes('truth_template', 'content')} AS truth_describes_content FROM masked""")
def q_describes(spark, sf):
    m = masked_log(spark, sf)
    return m.select("line_id", T.describes(F.col("template"), F.col("truth_template")).alias("parse_describes_truth"),
                    T.describes(F.col("truth_template"), F.col("template")).alias("truth_describes_parse"),
                    T.describes(F.col("truth_template"), F.col("content")).alias("truth_describes_content"))


@register("abstract_pairs", TEXT_PAIRS + f"""
SELECT line_id, {sql_is_abstract('t1', 't2')} AS first_more_general,
       {sql_is_abstract('t2', 't1')} AS second_more_general FROM tp""")
def q_abstract(spark, sf):
    p = text_pairs(spark, sf)
    return p.select("line_id", T.is_abstract(F.col("t1"), F.col("t2")).alias("first_more_general"),
                    T.is_abstract(F.col("t2"), F.col("t1")).alias("second_more_general"))


@register("abstract_truth", LOG + f"""
SELECT line_id, {sql_is_abstract('truth_template', 'content')} AS truth_covers_content,
       {sql_is_abstract('template', 'truth_template')} AS parse_covers_truth FROM masked""")
def q_abstract_truth(spark, sf):
    m = masked_log(spark, sf)
    return m.select("line_id", T.is_abstract(F.col("truth_template"), F.col("content")).alias("truth_covers_content"),
                    T.is_abstract(F.col("template"), F.col("truth_template")).alias("parse_covers_truth"))


@register("token_jaccard", TEXT_PAIRS + f"""
SELECT line_id, round({sql_jaccard('t1', 't2')}, 6) AS jaccard FROM tp""")
def q_jaccard(spark, sf):
    p = text_pairs(spark, sf)
    return p.select("line_id", F.round(T.token_jaccard(F.col("t1"), F.col("t2")), 6).alias("jaccard"))


def _same_len_pairs_sql() -> str:
    return TEXT_PAIRS + f""", {S.log_lines_cte()}, {S.split_cte()}, {S.masked_log_cte()},
tl AS (SELECT line_id, {S.tokens_sql('t1')} AS a, {S.tokens_sql('t2')} AS b FROM tp
  UNION ALL SELECT -1 - line_id, {S.tokens_sql('truth_template')}, {S.tokens_sql('content')} FROM masked),
sl AS (SELECT * FROM tl WHERE len(a) = len(b) AND len(a) > 0)
"""


def _same_len_pairs(spark, sf):
    """Neighbouring text templates, and every log line with its template (ids below 0), of equal token counts."""
    p = text_pairs(spark, sf).select("line_id", T.tokenize(F.col("t1")).alias("a"),
                                     T.tokenize(F.col("t2")).alias("b"))
    m = masked_log(spark, sf)
    p = p.unionByName(m.select((-1 - F.col("line_id")).alias("line_id"), T.tokenize(F.col("truth_template")).alias("a"),
                               T.tokenize(F.col("content")).alias("b")))
    return p.where((F.size("a") == F.size("b")) & (F.size("a") > 0))


_FS, _FP = sql_possim("a", "b", "fixed")
_DS, _DP = sql_possim("a", "b", "dynamic")


@register("positional_similarity", _same_len_pairs_sql() + f"""
SELECT line_id, round({_FS}, 6) AS sim_fixed, CAST({_FP} AS BIGINT) AS params_fixed,
       round({_DS}, 6) AS sim_dynamic, CAST({_DP} AS BIGINT) AS params_dynamic,
       round(len(list_filter(range(1, len(a) + 1), lambda i: a[i] = b[i] OR contains(a[i], '<*>'))) / len(a), 6)
         AS cover
FROM sl""")
def q_possim(spark, sf):
    p = _same_len_pairs(spark, sf)
    f = T.positional_similarity(F.col("a"), F.col("b"), "fixed")
    d = T.positional_similarity(F.col("a"), F.col("b"), "dynamic")
    return p.select("line_id", F.round(f["sim"], 6).alias("sim_fixed"), f["n_params"].cast("long").alias("params_fixed"),
                    F.round(d["sim"], 6).alias("sim_dynamic"), d["n_params"].cast("long").alias("params_dynamic"),
                    F.round(T.cover_similarity(F.col("a"), F.col("b")), 6).alias("cover"))


@register("generalise", _same_len_pairs_sql() + """
SELECT line_id, array_to_string(list_transform(range(1, len(a) + 1),
         lambda i: CASE WHEN a[i] = b[i] THEN a[i] ELSE '<*>' END), ' ') AS merged FROM sl""")
def q_generalise(spark, sf):
    p = _same_len_pairs(spark, sf)
    return p.select("line_id", F.array_join(T.generalise(F.col("a"), F.col("b")), " ").alias("merged"))


_RUN = "[ ,!;:=|\"''+.\\[\\](){}]*"
_HX, _HY = f"regexp_extract(a[i], '^{_RUN}')", f"regexp_extract(b[i], '^{_RUN}')"
_TX, _TY = f"reverse(regexp_extract(a[i], '{_RUN}$'))", f"reverse(regexp_extract(b[i], '{_RUN}$'))"


def _lcp(x: str, y: str) -> str:
    return f"list_max(list_filter(range(0, 1 + least(length({x}), length({y}))), lambda k: left({x}, k) = left({y}, k)))"


@register("merge_keep_delimiters", _same_len_pairs_sql() + f"""
SELECT line_id, array_to_string(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN a[i] = b[i] THEN a[i]
  ELSE left({_HX}, {_lcp(_HX, _HY)}) || '<*>' || reverse(left({_TX}, {_lcp(_TX, _TY)})) END), ' ') AS merged FROM sl""")
def q_merge_delims(spark, sf):
    """Unequal tokens become a wildcard between the delimiters that both begin and end with."""
    p = _same_len_pairs(spark, sf)
    merged = F.zip_with("a", "b", lambda x, y: T.merge_token_keep_delims(x, y))
    return p.select("line_id", F.array_join(merged, " ").alias("merged"))


@register("dynamic_threshold", _same_len_pairs_sql() + f"""
SELECT line_id, CAST(len(a) AS BIGINT) AS n_tokens, round({sql_threshold('len(a)')}, 6) AS threshold,
       {_DS} >= {sql_threshold('len(a)')} AS accepted FROM sl""")
def q_threshold(spark, sf):
    p = _same_len_pairs(spark, sf)
    st = T.dynamic_threshold(F.size("a"))
    d = T.positional_similarity(F.col("a"), F.col("b"), "dynamic")
    return p.select("line_id", F.size("a").cast("long").alias("n_tokens"), F.round(st, 6).alias("threshold"),
                    (d["sim"] >= st).alias("accepted"))


def _punct_sql(t: str) -> str:
    split_cls = "[\\s" + T._rx_class(T.PUNCTUATION)[1:]
    drop_cls = T._rx_class("".join(c for c in T.PUNCTUATION if c not in T.PUNCTUATION_KEPT) + " ")
    parts = f"string_split(regexp_replace({t}, {S.q('(' + split_cls + '+)')}, chr(1) || '\\1' || chr(1), 'g'), chr(1))"
    parts = f"list_filter({parts}, lambda x: x <> '')"
    parts = (f"list_transform({parts}, lambda x: CASE WHEN contains(x, '<*>') THEN '<*>' "
             f"ELSE regexp_replace(x, {S.q(drop_cls)}, '', 'g') END)")
    parts = f"list_filter(list_transform({parts}, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
    return parts


@register("punct_tokens", LOG + f"""
, pt AS (SELECT line_id, {_punct_sql('template')} AS a, {_punct_sql('truth_template')} AS b FROM masked),
dd AS (SELECT line_id, list_filter(a, lambda x, i: NOT (x = '<*>' AND i > 1 AND a[i - 1] = '<*>')) AS a,
              list_filter(b, lambda x, i: NOT (x = '<*>' AND i > 1 AND b[i - 1] = '<*>')) AS b FROM pt)
SELECT line_id, array_to_string(a, '|') AS parse_tokens, array_to_string(b, '|') AS truth_tokens,
       round(len(list_distinct(list_intersect(a, b))) / (len(a) + len(b) - len(list_distinct(list_intersect(a, b)))), 6)
         AS similarity
FROM dd""")
def q_punct(spark, sf):
    m = masked_log(spark, sf)
    return m.select("line_id", F.array_join(T.punct_tokens(F.col("template")), "|").alias("parse_tokens"),
                    F.array_join(T.punct_tokens(F.col("truth_template")), "|").alias("truth_tokens"),
                    F.round(T.punct_similarity(F.col("template"), F.col("truth_template")), 6).alias("similarity"))


@register("wildcard_equal", LOG + """
SELECT line_id, list_transform(string_split(truth_template, ' '),
         lambda x: CASE WHEN contains(x, '<*>') THEN '<*>' ELSE x END) = string_split(template, ' ') AS equal,
       truth_template = template AS exact FROM masked""")
def q_wildcard_equal(spark, sf):
    m = masked_log(spark, sf)
    return m.select("line_id", T.wildcard_equal(F.col("truth_template"), F.col("template")).alias("equal"),
                    (F.col("truth_template") == F.col("template")).alias("exact"))


@register("strip_quotes", TEXT + """
SELECT line_id, translate(template, ',''"', '') AS stripped FROM mt""")
def q_strip_quotes(spark, sf):
    m = masked_text(spark, sf)
    return m.select("line_id", T.strip_quotes(F.col("template")).alias("stripped"))
