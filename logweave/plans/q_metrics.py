"""Registered queries: parse-quality metrics (A1-A10) over two parses of the
derived log — the masked-message parse and the n-gram parse — evaluated
against the known templates in one ``groupBy(dataset)`` pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave.functions.masks import mask_types
from logweave.functions.tokens import tokenize
from logweave.operators import metrics as A
from logweave.operators import ngram as N
from logweave.plans import sqlgen as S
from logweave.plans.common import masked_log, split_log
from logweave.plans.q_ngram import GRAMS, LOG_TOK, SCORE, _flags_ctes
from logweave.plans.q_tokens import sql_is_abstract
from logweave.plans.registry import register
from logweave.session import cut_lineage

G = ["dataset"]


def split_tokens(spark, sf):
    """(line_id, truth_template, component, tokens): lines split and masked once (lineage cut)."""
    s = split_log(spark, sf)
    return cut_lineage(s.select("line_id", "truth_template", F.col("Component").alias("component"),
                                tokenize(mask_types(F.col("Content"))).alias("tokens")))


def parses(spark, sf, base=None):
    """(dataset, line_id, truth, parsed) for both parsers, which share the masked tokens (of ``base``, if given)."""
    base = split_tokens(spark, sf) if base is None else base
    a = base.select(F.lit("masked").alias("dataset"), "line_id", F.col("truth_template").alias("truth"),
                    F.array_join("tokens", " ").alias("parsed"))
    lines, _ = N.ngram_parse(base, tokens_col="tokens", keep=("truth_template",))
    b = lines.select(F.lit("ngram").alias("dataset"), "line_id", F.col("truth_template").alias("truth"),
                     F.coalesce(F.col("event_template"), F.lit("")).alias("parsed"))
    return a.unionByName(b)


def contingency(spark, sf):
    # small (distinct truth × parsed pairs) and read by every metric branch: computed once
    return cut_lineage(A.contingency(parses(spark, sf), G))


BASE = (*LOG_TOK, *GRAMS, *SCORE, *_flags_ctes(), S.masked_log_cte(),
        "pl AS (SELECT 'masked' AS dataset, line_id, truth_template AS truth, template AS parsed FROM masked "
        "UNION ALL SELECT 'ngram', tp.line_id, s.truth_template, coalesce(tp.event_template, '') "
        "FROM tp JOIN split s USING (line_id))",
        "cont AS (SELECT dataset, truth, parsed, count(*) AS n FROM pl GROUP BY ALL)",
        "valid AS (SELECT * FROM cont WHERE truth IS NOT NULL)",
        "c AS (SELECT *, sum(n) OVER (PARTITION BY dataset, truth) AS n_truth, "
        "sum(n) OVER (PARTITION BY dataset, parsed) AS n_parsed FROM valid)",
        "pp AS (SELECT dataset, parsed, count(*) AS k, max(truth) AS t FROM valid GROUP BY ALL)")


def _f1(p: str, r: str) -> str:
    return f"CASE WHEN ({p}) + ({r}) > 0 THEN 2 * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0.0 END"


def _quality_select(d: int = 6) -> str:
    pga, rga = "right_groups / gp", "right_groups / ground"
    pta, rta = "right_t / identified", "right_t / ground"
    return f"""SELECT dataset, CAST(identified AS BIGINT) AS identified_templates,
       CAST(ground AS BIGINT) AS ground_templates, round(coalesce(right_lines, 0) / lines, {d}) AS ga,
       round(coalesce(pa_right, 0) / pa_lines, {d}) AS pa, round({pga}, {d}) AS pga, round({rga}, {d}) AS rga,
       round({_f1(pga, rga)}, {d}) AS fga, round({pta}, {d}) AS pta, round({rta}, {d}) AS rta,
       round({_f1(pta, rta)}, {d}) AS fta
FROM g1 JOIN g2 USING (dataset) JOIN g3 USING (dataset)"""


QUALITY = S.with_(*BASE,
                  "g1 AS (SELECT dataset, sum(n) AS lines, sum(CASE WHEN n = n_truth AND n = n_parsed THEN n END) "
                  "AS right_lines, count_if(n = n_truth AND n = n_parsed) AS right_groups, "
                  "count(DISTINCT truth) AS ground, count(DISTINCT parsed) AS gp FROM c GROUP BY dataset)",
                  "g2 AS (SELECT dataset, count(*) AS identified, count_if(k = 1 AND t = parsed) AS right_t "
                  "FROM pp GROUP BY dataset)",
                  "g3 AS (SELECT dataset, sum(n) AS pa_lines, sum(CASE WHEN truth = parsed THEN n END) AS pa_right "
                  "FROM cont GROUP BY dataset)")


@register("grouping_accuracy", QUALITY + _quality_select())
def q_quality(spark, sf):
    return A.quality(contingency(spark, sf), G)


@register("evaluate_miners", QUALITY + ", q AS (" + _quality_select().strip() + """)
SELECT m.dataset, q.* EXCLUDE (dataset) FROM (SELECT unnest(['masked', 'ngram', 'silent', 'failed']) AS dataset) m LEFT JOIN q USING (dataset)""")
def q_evaluate_miners(spark, sf):
    """A10: four miners through one protocol, two of them without output."""
    lines = cut_lineage(split_log(spark, sf).select("line_id", "truth_template", "Content"))
    tokens = tokenize(mask_types(F.col("Content")))

    def masked(df):
        return df.select("line_id", F.array_join(tokens, " ").alias("event_template")), None

    def ngram(df):
        return N.ngram_parse(df, "Content", masker=lambda c: mask_types(c))

    return A.evaluate_miners(lines, {"masked": masked, "ngram": ngram, "silent": lambda df: (masked(df)[0].limit(0), None), "failed": lambda df: None})


@register("metric_summary", QUALITY + _quality_select(3))
def q_summary(spark, sf):
    q = A.quality(contingency(spark, sf), G)
    return q.select("dataset", "identified_templates", "ground_templates",
                    *[F.round(c, 3).alias(c) for c in ("ga", "pa", "pga", "rga", "fga", "pta", "rta", "fta")])


@register("grouping_variant", QUALITY + """
SELECT dataset, round(coalesce(right_lines, 0) / lines, 6) AS ga, round(right_groups / ground, 6) AS fga_recall
FROM g1""")
def q_variant(spark, sf):
    q = A.quality(contingency(spark, sf), G)
    return q.select("dataset", "ga", F.col("rga").alias("fga_recall"))


def _sliced_sql(slice_cte: str) -> str:
    return S.with_(
        *BASE, "tt AS (SELECT dataset, truth, sum(n) AS occurrences FROM valid GROUP BY ALL)", slice_cte,
        "cf AS (SELECT c.*, f.truth IS NOT NULL AS in_slice FROM c LEFT JOIN f USING (dataset, truth))",
        "touched AS (SELECT DISTINCT dataset, parsed FROM cf WHERE in_slice)",
        "g1 AS (SELECT dataset, sum(CASE WHEN in_slice THEN n END) AS lines, "
        "sum(CASE WHEN in_slice AND n = n_truth AND n = n_parsed THEN n END) AS right_lines, "
        "count_if(in_slice AND n = n_truth AND n = n_parsed) AS right_groups FROM cf GROUP BY dataset)",
        "gf AS (SELECT dataset, count(*) AS ground FROM f GROUP BY dataset)",
        "gtp AS (SELECT dataset, count(*) AS gp FROM touched GROUP BY dataset)",
        "g2 AS (SELECT pp.dataset, count(t2.parsed) AS identified, "
        "count_if(k = 1 AND t = pp.parsed AND f2.truth IS NOT NULL) AS right_t FROM pp "
        "LEFT JOIN touched t2 ON t2.dataset = pp.dataset AND t2.parsed = pp.parsed "
        "LEFT JOIN f f2 ON f2.dataset = pp.dataset AND f2.truth = pp.parsed GROUP BY pp.dataset)",
        "g3 AS (SELECT dataset, sum(n) AS pa_lines, sum(CASE WHEN truth = parsed THEN n END) AS pa_right "
        "FROM cont JOIN f USING (dataset, truth) GROUP BY dataset)",
        "g1x AS (SELECT * FROM g1 JOIN gf USING (dataset) JOIN gtp USING (dataset))")


def _sliced_select(extra: str) -> str:
    return _quality_select().replace("FROM g1 JOIN g2", "FROM g1x JOIN g2").replace(
        "SELECT dataset,", f"SELECT dataset, {extra}", 1)


COMPLEX_SQL = " UNION ALL ".join(
    f"SELECT * FROM ({_sliced_sql(f'f AS (SELECT dataset, truth FROM tt WHERE {cond})')}"
    f"{_sliced_select(f'{lvl} AS level,')})"
    for lvl, cond in ((1, "length(truth) - length(replace(truth, '>', '')) = 0"),
                      (2, "length(truth) - length(replace(truth, '>', '')) BETWEEN 1 AND 4"),
                      (3, "length(truth) - length(replace(truth, '>', '')) >= 5")))


@register("complexity_slice", COMPLEX_SQL)
def q_complexity(spark, sf):
    cont = contingency(spark, sf)
    tt = A.truth_template_table(cont, G)
    out = None
    for lvl in (1, 2, 3):
        q = A.quality(cont, G, A.complexity_slice(tt, lvl, G)).select(F.lit(lvl).alias("level"), "*")
        out = q if out is None else out.unionByName(q)
    return out


def _freq_cte(pct: int) -> str:
    rk = "row_number() OVER (PARTITION BY dataset ORDER BY occurrences, truth)"
    cnt = "count(*) OVER (PARTITION BY dataset)"
    keep = (f"rk <= floor(cnt / 100.0 * {pct})" if pct > 0 else f"rk > cnt - floor(cnt / 100.0 * {-pct})")
    return f"f AS (SELECT dataset, truth FROM (SELECT *, {rk} AS rk, {cnt} AS cnt FROM tt) WHERE {keep})"


FREQ_SQL = " UNION ALL ".join(
    f"SELECT * FROM ({_sliced_sql(_freq_cte(p))}{_sliced_select(f'{p} AS percent,')})" for p in (40, -40))


@register("frequency_slice", FREQ_SQL)
def q_frequency(spark, sf):
    cont = contingency(spark, sf)
    tt = A.truth_template_table(cont, G)
    out = None
    for p in (40, -40):
        q = A.quality(cont, G, A.frequency_slice(tt, p, G)).select(F.lit(p).alias("percent"), "*")
        out = q if out is None else out.unionByName(q)
    return out


def _weq(truth: str, parsed: str) -> str:
    return (f"(list_transform(string_split({truth}, ' '), lambda x: CASE WHEN contains(x, '<*>') THEN '<*>' "
            f"ELSE x END) = string_split({parsed}, ' '))")


@register("wildcard_accuracy", S.with_(
    *BASE,
    f"a AS (SELECT dataset, sum(n) AS lines, sum(CASE WHEN {_weq('truth', 'parsed')} THEN n END) AS ok "
    f"FROM cont GROUP BY dataset)",
    f"b AS (SELECT dataset, count(*) AS identified, count_if(k = 1 AND {_weq('parsed', 't')}) AS r FROM pp "
    f"GROUP BY dataset)",
    "gt AS (SELECT dataset, count(DISTINCT truth) AS ground FROM valid GROUP BY dataset)") + f"""
SELECT dataset, round(coalesce(ok, 0) / lines, 6) AS pa_wildcard, round(r / identified, 6) AS pta_wildcard,
       round(r / ground, 6) AS rta_wildcard, round({_f1('r / identified', 'r / ground')}, 6) AS fta_wildcard
FROM a JOIN b USING (dataset) JOIN gt USING (dataset)""")
def q_wildcard_acc(spark, sf):
    return A.wildcard_quality(contingency(spark, sf), G)


ERR_CTES = (
    f"pr AS (SELECT DISTINCT dataset, parsed, truth FROM valid)",
    f"pt AS (SELECT *, CASE WHEN {sql_is_abstract('parsed', 'truth')} THEN 'OG' "
    f"WHEN {sql_is_abstract('truth', 'parsed')} THEN 'UG' ELSE 'MX' END AS ptype FROM pr)",
    "et AS (SELECT dataset, parsed, CASE WHEN count(*) = 1 AND max(truth) = parsed THEN 'SM' "
    "WHEN count(DISTINCT ptype) = 1 THEN max(ptype) ELSE 'MX' END AS error_type FROM pt GROUP BY dataset, parsed)")


@register("error_types", S.with_(*BASE, *ERR_CTES) + "SELECT dataset, parsed, error_type FROM et")
def q_error_types(spark, sf):
    return A.error_types(contingency(spark, sf), G)


@register("error_type_ratios", S.with_(
    *BASE, *ERR_CTES,
    "gt AS (SELECT dataset, count(DISTINCT truth) AS ground FROM valid GROUP BY dataset)",
    "ag AS (SELECT dataset, count(*) AS total, count_if(error_type = 'SM') AS sm, count_if(error_type = 'OG') AS og, "
    "count_if(error_type = 'UG') AS ug, count_if(error_type = 'MX') AS mx FROM et GROUP BY dataset)") + f"""
SELECT dataset, round(sm / total, 6) AS pta, round(sm / ground, 6) AS rta,
       round({_f1('sm / total', 'sm / ground')}, 6) AS f1, round(og / total, 6) AS og_ratio,
       round(ug / total, 6) AS ug_ratio, round(mx / total, 6) AS mx_ratio
FROM ag JOIN gt USING (dataset)""")
def q_error_ratios(spark, sf):
    cont = contingency(spark, sf)
    return A.error_type_ratios(A.error_types(cont, G), cont, G)


@register("parse_alignment", S.with_(*BASE) + """
SELECT dataset, count(*) AS aligned_lines, count(DISTINCT line_id) AS distinct_lines FROM pl GROUP BY dataset""")
def q_alignment(spark, sf):
    """Parsed ⨝ truth on line id — aligned line counts per dataset."""
    p = parses(spark, sf)
    return p.groupBy("dataset").agg(F.count(F.lit(1)).alias("aligned_lines"),
                                    F.count_distinct("line_id").alias("distinct_lines"))
