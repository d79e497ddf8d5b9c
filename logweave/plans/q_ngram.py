"""Registered queries: n-gram dictionaries and n-gram template mining.

Most forms tokenise through the typed mask chain, one through the general masks
(in SQL their look-around is written as kept neighbours).

SQL oracle of the dynamic-flag recurrence: position i's function of flag[i-2]
is a constant, the identity or a negation, so flag[i] = (last constant in its
parity chain) XOR (parity of negations since) — window functions only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave.functions.masks import mask_types
from logweave.functions.tokens import event_id
from logweave.operators import ngram as N
from logweave.operators.events import event_table
from logweave.plans import sqlgen as S
from logweave.plans.common import ascii_text_lines, split_log
from logweave.plans.registry import register
from logweave.session import Parts, drop_written, slices_of, written

THR = N.DEFAULT_THRESHOLD
LL, SPLIT = S.log_lines_cte(), S.split_cte()
TL = S.text_lines_cte()
TLA = ("text_ascii AS (SELECT doc_id, pos, line_id, "
       + S.rx_replace("value", r"[^\x00-\x7F]+", "<N/ASCII>") + " AS value FROM text_lines)")


def _tok_cte(source: str, col: str) -> str:
    return f"tok AS (SELECT line_id, {S.tokens_sql(S.mask_chain_sql(col))} AS tokens FROM {source})"


LOG_TOK = (LL, SPLIT, _tok_cte("split", '"Content"'))
TEXT_TOK = (TL, TLA, _tok_cte("text_ascii", "value"))

GRAMS = (
    "ex AS (SELECT line_id, tokens, generate_subscripts(tokens, 1) - 1 AS pos, unnest(tokens) AS w3 FROM tok)",
    "ex2 AS (SELECT line_id, tokens, pos, w3, CASE WHEN pos >= 1 THEN tokens[pos] END AS w2, "
    "CASE WHEN pos >= 2 THEN tokens[pos - 1] END AS w1 FROM ex)",
    "uni AS (SELECT w3 AS w, count(*) AS c1 FROM ex2 GROUP BY w3)",
    "bi AS (SELECT w2 AS w1, w3 AS w2, count(*) AS c2 FROM ex2 WHERE pos >= 1 GROUP BY w2, w3)",
    "tri AS (SELECT w1, w2, w3, count(*) AS c3 FROM ex2 WHERE pos >= 2 GROUP BY w1, w2, w3)",
)

SCORE = (
    "sc AS (SELECT e.line_id, e.pos, coalesce(b.c2 / u.c1, 0.0) AS f_bi, coalesce(t.c3 / b2.c2, 0.0) AS f_tri "
    "FROM ex2 e LEFT JOIN bi b ON b.w1 = e.w2 AND b.w2 = e.w3 LEFT JOIN uni u ON u.w = e.w2 "
    "LEFT JOIN tri t ON t.w1 = e.w1 AND t.w2 = e.w2 AND t.w3 = e.w3 "
    "LEFT JOIN bi b2 ON b2.w1 = e.w1 AND b2.w2 = e.w2 WHERE e.pos >= 1)",
)


def _flags_ctes(thr: float = THR) -> tuple[str, ...]:
    return (
        f"g AS (SELECT line_id, pos, pos % 2 AS par, (pos = 1 OR (f_bi <= {thr}) = (f_tri <= {thr})) AS is_const, "
        f"f_bi <= {thr} AS cval, (pos > 1 AND f_bi > {thr} AND f_tri <= {thr}) AS is_not, f_bi, f_tri FROM sc "
        f"UNION ALL SELECT line_id, 0, 0, true, false, false, NULL, NULL FROM tok)",
        "w1 AS (SELECT *, sum(CASE WHEN is_not THEN 1 ELSE 0 END) OVER (PARTITION BY line_id, par ORDER BY pos "
        "ROWS UNBOUNDED PRECEDING) AS cum_not FROM g)",
        "w2 AS (SELECT *, last_value(CASE WHEN is_const THEN cval END IGNORE NULLS) OVER (PARTITION BY line_id, par "
        "ORDER BY pos ROWS UNBOUNDED PRECEDING) AS base, last_value(CASE WHEN is_const THEN cum_not END IGNORE NULLS) "
        "OVER (PARTITION BY line_id, par ORDER BY pos ROWS UNBOUNDED PRECEDING) AS base_not FROM w1)",
        "fl AS (SELECT line_id, pos, f_bi, f_tri, (base <> ((cum_not - base_not) % 2 = 1)) AS dyn FROM w2)",
        "tp AS (SELECT t.line_id, translate(string_agg(CASE WHEN fl.dyn THEN '<*>' ELSE t.w3 END, ' ' "
        "ORDER BY t.pos), ',''\"', '') AS event_template, CAST(count_if(fl.dyn) AS BIGINT) AS n_dynamic, "
        "CAST(count(*) AS BIGINT) AS n_tokens FROM ex2 t JOIN fl ON fl.line_id = t.line_id AND fl.pos = t.pos "
        "GROUP BY t.line_id)",
    )


def _log_parse(spark, sf):
    s = split_log(spark, sf)
    return N.ngram_parse(s, "Content", masker=lambda c: mask_types(c))


def _text_parse(spark, sf):
    t = ascii_text_lines(spark, sf)
    return N.ngram_parse(t, "value", masker=lambda c: mask_types(c))


def _text_grams(t):
    """(gram rows of the messages, number of slices to count them in)."""
    tok = N.ngram_tokens(t, "value", masker=lambda c: mask_types(c))
    msgs = N.numbered_messages(N.messages(tok))
    return N.exploded_grams(msgs, "msg_id"), slices_of(msgs)


@register("gram_counts", S.with_(*TEXT_TOK, *GRAMS) + """
SELECT 1 AS n, w AS w1, NULL AS w2, NULL AS w3, c1 AS c FROM uni
UNION ALL SELECT 2, w1, w2, NULL, c2 FROM bi
UNION ALL SELECT 3, w1, w2, w3, c3 FROM tri""")
def q_gram_counts(spark, sf):
    t = ascii_text_lines(spark, sf)
    uni, bi, tri = N.gram_counts(*_text_grams(t))
    null = F.lit(None).cast("string")
    return (uni.select(F.lit(1).alias("n"), F.col("w").alias("w1"), null.alias("w2"), null.alias("w3"),
                       F.col("c1").alias("c"))
            .unionByName(bi.select(F.lit(2).alias("n"), "w1", "w2", null.alias("w3"), F.col("c2").alias("c")))
            .unionByName(tri.select(F.lit(3).alias("n"), "w1", "w2", "w3", F.col("c3").alias("c"))))


@register("ngram_templates", S.with_(*LOG_TOK, *GRAMS, *SCORE, *_flags_ctes()) + """
SELECT line_id, event_template, n_dynamic, n_tokens - n_dynamic AS n_static FROM tp""")
def q_ngram_templates(spark, sf):
    lines, _ = _log_parse(spark, sf)
    return lines.select("line_id", "event_template", "n_dynamic", "n_static")


@register("ngram_text_templates", S.with_(*TEXT_TOK, *GRAMS, *SCORE, *_flags_ctes()) + """
SELECT line_id, event_template, n_dynamic, n_tokens - n_dynamic AS n_static FROM tp""")
def q_ngram_text(spark, sf):
    lines, _ = _text_parse(spark, sf)
    return lines.select("line_id", "event_template", "n_dynamic", "n_static")


@register("ngram_event_table", S.with_(*LOG_TOK, *GRAMS, *SCORE, *_flags_ctes()) + """
SELECT substr(md5(event_template), 1, 8) AS event_id, event_template, count(*) AS occurrences,
       min(line_id) AS first_line_id FROM tp GROUP BY event_template""")
def q_ngram_events(spark, sf):
    _, msgs = _log_parse(spark, sf)
    return N.event_table_from_messages(msgs)


@register("static_dynamic_counts", S.with_(*TEXT_TOK, *GRAMS, *SCORE, *_flags_ctes()) + """
SELECT n_dynamic, n_tokens - n_dynamic AS n_static, count(*) AS n_lines FROM tp GROUP BY ALL""")
def q_static_dynamic(spark, sf):
    _, msgs = _text_parse(spark, sf)
    return msgs.groupBy("n_dynamic", "n_static").agg(F.sum("mult").alias("n_lines"))


@register("entropy_hist", S.with_(*TEXT_TOK, *GRAMS, *SCORE, *_flags_ctes(),
                                  "fu AS (SELECT line_id, pos, CASE WHEN pos = 1 THEN f_bi WHEN lag(dyn) OVER "
                                  "(PARTITION BY line_id, pos % 2 ORDER BY pos) THEN f_bi ELSE f_tri END AS f "
                                  "FROM fl WHERE pos >= 1)") + """
SELECT round(f, 6) AS f, count(*) AS count FROM fu GROUP BY ALL""")
def q_entropy(spark, sf):
    msgs, scored = N.scored_messages(ascii_text_lines(spark, sf), "value", masker=lambda c: mask_types(c))
    return N.entropy_histogram(scored, msgs)


@register("dict_summary", S.with_(*TEXT_TOK, *GRAMS) + """
SELECT 'bi' AS dict, c2 AS gram_count, count(*) AS n_grams FROM bi GROUP BY c2
UNION ALL SELECT 'tri', c3, count(*) FROM tri GROUP BY c3""")
def q_dict_summary(spark, sf):
    t = ascii_text_lines(spark, sf)
    ex, n = _text_grams(t)
    summary = Parts(spark, "summary")
    for s in range(n):
        _, bi, tri = N.gram_counts(ex.where(N.slice_of(s, n, "w3")))
        summary.add(N.count_of_counts(bi, "c2").select(F.lit("bi").alias("dict"), "*")
                    .unionByName(N.count_of_counts(tri, "c3").select(F.lit("tri").alias("dict"), "*")))
        drop_written(tri)
    return summary.table().groupBy("dict", "gram_count").agg(F.sum("n_grams").alias("n_grams"))


ONLINE_GRAMS = (
    "ex AS (SELECT line_id, tokens, generate_subscripts(tokens, 1) - 1 AS pos, unnest(tokens) AS w3 FROM tok)",
    "ex2 AS (SELECT line_id, tokens, pos, w3, CASE WHEN pos >= 1 THEN tokens[pos] END AS w2, "
    "CASE WHEN pos >= 2 THEN tokens[pos - 1] END AS w1 FROM ex)",
    "u AS (SELECT DISTINCT line_id, w, c1 FROM (SELECT line_id, w3 AS w, count(*) OVER (PARTITION BY w3 ORDER BY "
    "line_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c1 FROM ex2))",
    "b AS (SELECT DISTINCT line_id, w1, w2, c2 FROM (SELECT line_id, w2 AS w1, w3 AS w2, count(*) OVER (PARTITION BY "
    "w2, w3 ORDER BY line_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c2 FROM ex2 WHERE pos >= 1))",
    "t AS (SELECT DISTINCT line_id, w1, w2, w3, c3 FROM (SELECT line_id, w1, w2, w3, count(*) OVER (PARTITION BY "
    "w1, w2, w3 ORDER BY line_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c3 FROM ex2 WHERE pos >= 2))",
    "sc AS (SELECT e.line_id, e.pos, coalesce(bb.c2 / uu.c1, 0.0) AS f_bi, coalesce(tt.c3 / b2.c2, 0.0) AS f_tri "
    "FROM ex2 e LEFT JOIN b bb ON bb.line_id = e.line_id AND bb.w1 = e.w2 AND bb.w2 = e.w3 "
    "LEFT JOIN u uu ON uu.line_id = e.line_id AND uu.w = e.w2 "
    "LEFT JOIN t tt ON tt.line_id = e.line_id AND tt.w1 = e.w1 AND tt.w2 = e.w2 AND tt.w3 = e.w3 "
    "LEFT JOIN b b2 ON b2.line_id = e.line_id AND b2.w1 = e.w1 AND b2.w2 = e.w2 WHERE e.pos >= 1)",
)


@register("ngram_online", S.with_(*LOG_TOK, *ONLINE_GRAMS, *_flags_ctes()) + """
SELECT line_id, event_template FROM tp""")
def q_ngram_online(spark, sf):
    s = split_log(spark, sf)
    return N.ngram_parse_online(s, "Content", masker=lambda c: mask_types(c))


@register("running_gram_counts", S.with_(*TEXT_TOK, *ONLINE_GRAMS[:3]) + """
SELECT line_id, w, c1 AS c FROM u""")
def q_running(spark, sf):
    t = ascii_text_lines(spark, sf)
    tok = written(N.ngram_tokens(t, "value", masker=lambda c: mask_types(c)).select("line_id", "tokens"), "tokens", release=True)
    return N.running_line_counts(tok.select("line_id", F.explode("tokens").alias("w")), ["w"], slices=slices_of(tok))


GENERAL_TOK = (LL, SPLIT, f"tok AS (SELECT line_id, {S.tokens_sql(S.general_masks_sql(chr(34) + 'Content' + chr(34)))} AS tokens FROM split)")


@register("ngram_general_masks", S.with_(*GENERAL_TOK, *GRAMS, *SCORE, *_flags_ctes()) + """
SELECT line_id, event_template, substr(md5(event_template), 1, 8) AS event_id FROM tp""")
def q_ngram_general(spark, sf):
    """C6 with the general masks."""
    s = split_log(spark, sf)
    lines, _ = N.ngram_parse(s, "Content")
    return lines.select("line_id", "event_template", event_id(F.col("event_template")).alias("event_id"))


RATIO = 0.5
RATIO_GRAMS = (
    GRAMS[0], GRAMS[1],
    "dl AS (SELECT line_id FROM (SELECT line_id, row_number() OVER (ORDER BY line_id) - 1 AS i FROM tok) "
    f"WHERE i <= floor((SELECT count(*) FROM tok) * {RATIO}))",
    "uni AS (SELECT w3 AS w, count(*) AS c1 FROM ex2 WHERE line_id IN (SELECT line_id FROM dl) GROUP BY w3)",
    "bi AS (SELECT w2 AS w1, w3 AS w2, count(*) AS c2 FROM ex2 WHERE pos >= 1 AND line_id IN (SELECT line_id FROM dl) "
    "GROUP BY w2, w3)",
    "tri AS (SELECT w1, w2, w3, count(*) AS c3 FROM ex2 WHERE pos >= 2 AND line_id IN (SELECT line_id FROM dl) "
    "GROUP BY w1, w2, w3)",
)


@register("ngram_ratio", S.with_(*TEXT_TOK, *RATIO_GRAMS, *SCORE, *_flags_ctes()) + """
SELECT line_id, event_template, n_dynamic FROM tp""")
def q_ngram_ratio(spark, sf):
    """C5 with the dictionaries built from the first half of the lines (in line order)."""
    t = ascii_text_lines(spark, sf)
    lines, _ = N.ngram_parse(t, "value", masker=lambda c: mask_types(c), ratio=RATIO)
    return lines.select("line_id", "event_template", "n_dynamic")
