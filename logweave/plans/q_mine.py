"""Registered queries: template miners (C1-C4), each with its SQL form.

Fixed-depth mining in line order is a recursive CTE that takes one line of every token
count per step; position splitting is one over the distinct messages.  The oracles state
masks, routing and thresholds anew.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave.functions.masks import mask_estimated, mask_types, mask_user
from logweave.functions.tokens import dynamic_threshold, event_id, tokenize
from logweave.operators import dynamic as D
from logweave.operators import fixed_depth as FD
from logweave.operators.greedy import mine_in_order
from logweave.operators.in_order import constants_in_order, paths_in_order, route_in_order
from logweave.operators.metrics import contingency, quality
from logweave.plans import sqlgen as S
from logweave.plans.common import masked_log, masked_text, split_log
from logweave.plans.q_sources import _estimate_sql
from logweave.plans.q_tokens import sql_describes, sql_jaccard
from logweave.plans.registry import register
from logweave.session import written

LOG_MASKS = [r"blk_-?\d+", r"(\d+\.){3}\d+(:\d+)?", r"(?<=[^A-Za-z0-9])(\-?\+?\d+)(?=[^A-Za-z0-9])|[0-9]+$"]


def _content(spark, sf):
    return split_log(spark, sf).select("line_id", "truth_template", F.col("Content").alias("content"))


def _user_tokens(spark, sf):
    # read by several miners: the format split and the user masks run once
    return written(_content(spark, sf).withColumn("tokens", tokenize(mask_user(F.col("content"), LOG_MASKS))))


LOG_TOKS = (S.log_lines_cte(), S.split_cte(),
            f"lt AS (SELECT line_id, {S.tokens_sql(S.number_masks_sql(chr(34) + 'Content' + chr(34)))} AS toks FROM split)")
TYPE_TOKS = (S.log_lines_cte(), S.split_cte(),
             f"lt AS (SELECT line_id, {S.tokens_sql(S.mask_chain_sql(chr(34) + 'Content' + chr(34)))} AS toks FROM split)")
TEXT_TOKS = (S.text_lines_cte(), "xt AS (SELECT line_id, " + S.tokens_sql(S.mask_chain_sql(
    "regexp_replace(value, '[^\\x00-\\x7F]+', '<N/ASCII>', 'g')")) + " AS toks FROM text_lines)")


def _mined_sql(ctes, lines, st=0.4, columns="l.line_id, m.template AS event_template"):
    return S.recursive(S.with_(*ctes, S.route_ctes(lines), S.split_ctes("routed", str(st)))
                       + f"SELECT {columns} FROM {lines} l JOIN mined m ON l.toks = m.toks")


def _greedy_sql(ctes, lines, st="0.4", columns="line_id, template AS event_template"):
    return S.recursive(S.with_(*ctes, S.greedy_ctes(lines, st)) + f"SELECT {columns} FROM mined")


@register("mine_fixed", _greedy_sql(LOG_TOKS, "lt", columns="line_id, substr(md5(template), 1, 8) AS event_id, template AS event_template"))
def q_mine_fixed(spark, sf):
    """C1 over the derived log with per-dataset user masks, as a pass in line order finds it."""
    m = mine_in_order(_content(spark, sf), tokenize(mask_user(F.col("content"), LOG_MASKS)))
    return m.select("line_id", event_id(F.col("event_template")).alias("event_id"), "event_template")


@register("mine_fixed_text", _greedy_sql(TEXT_TOKS, "xt"))
def q_mine_fixed_text(spark, sf):
    """C1 over every line of the text corpus in order; lines of one token are their own templates (C1q)."""
    t = masked_text(spark, sf)
    return mine_in_order(t, tokenize(mask_types(F.col("value")))).select("line_id", "event_template")


@register("mine_split", _mined_sql(LOG_TOKS, "lt"))
def q_mine_split(spark, sf):
    """Position splitting of the derived log: clusters that do not depend on line order."""
    return FD.mine_fixed(_content(spark, sf), "content", LOG_MASKS)


@register("mine_split_text", _mined_sql(TEXT_TOKS, "xt"))
def q_mine_split_text(spark, sf):
    """Position splitting of every line of the text corpus."""
    t = masked_text(spark, sf)
    return FD.mine_fixed(t, "value", (), tokens_col=tokenize(mask_types(F.col("value"))))


EST_TOKS = (S.log_lines_cte(), S.split_cte(), "lt AS (SELECT line_id, " + S.tokens_sql("masked") + " AS toks FROM ("
            + _estimate_sql(("nothing AS (SELECT 1)",), "split", '"Content"') + "))")


@register("mine_masked", _greedy_sql(EST_TOKS, "lt", "0.5"))
def q_mine_masked(spark, sf):
    """Estimated typed masks (first 2,000 lines), then fixed-depth clustering in line order."""
    c = mask_estimated(_content(spark, sf), "content", "masked")
    return mine_in_order(c, tokenize(F.col("masked")), st=0.5).select("line_id", "event_template")


def _rotated_sql():
    """Three independent minings of rotated, padded lists, un-rotated, cut and counted."""
    ctes, picks = [*LOG_TOKS], []
    padded = "list_concat(toks, list_transform(range(greatest(0, 3 - len(toks))), lambda i: '_'))"
    ctes.append(f"pad AS (SELECT line_id, greatest(len(toks), 1) AS n0, {padded} AS p FROM lt)")
    for k in range(3):
        ctes.append(f"rot{k} AS (SELECT line_id, n0, list_concat(p[{k} + 1:], p[1:{k}]) AS toks FROM pad)")
        ctes.append(S.route_ctes(f"rot{k}", name=f"ro{k}"))
        ctes.append(S.split_ctes(f"ro{k}", "0.4", f"mi{k}"))
        back = f"list_concat(t[len(t) - {k} + 1:], t[1:len(t) - {k}])" if k else "t"
        picks.append(f"SELECT line_id, {k} AS rotation, array_to_string(({back})[1:n0], ' ') AS event_template FROM "
                     f"(SELECT r.line_id, r.n0, string_split(m.template, ' ') AS t FROM rot{k} r JOIN mi{k} m ON r.toks = m.toks)")
    ctes.append("votes AS (" + " UNION ALL ".join(picks) + ")")
    return S.recursive(S.with_(*ctes)) + """,
counted AS (SELECT line_id, event_template, count(*) AS votes, min(rotation) AS first_rotation FROM votes GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY votes DESC,
           (length(event_template) - length(replace(event_template, '<*>', ''))) / 3 DESC, first_rotation) AS r FROM counted)
SELECT line_id, event_template FROM ranked WHERE r = 1"""


@register("mine_rotated", _rotated_sql())
def q_mine_rotated(spark, sf):
    """C4: three rotations, fixed-depth clustering each, majority vote."""
    return FD.mine_rotated(_content(spark, sf), "content", LOG_MASKS, rotations=(0, 1, 2))


def _batched_sql():
    """The pass over (rotation, batch, message) rows, one of every token count per step; a cluster holds its
    template as of the end of each rotation, a step changes those of its rotation and the later ones."""
    padded = "list_concat(toks, CASE WHEN len(toks) < 3 THEN list_transform(range(3 - len(toks) + 1), lambda i: '_') ELSE CAST([] AS VARCHAR[]) END)"
    rot = " UNION ALL ".join(f"SELECT line_id, {k} AS rot, batch, list_concat(p[{k} + 1:], p[1:{k}]) AS toks FROM pad" for k in range(3))
    known = "list_contains(list_transform(w.state, lambda c: c.leaf), l.toks[1])"
    now = "CASE l.rot WHEN 0 THEN c.t0 WHEN 1 THEN c.t1 ELSE c.t2 END"
    merge = lambda r: f"CASE WHEN rot <= {r} THEN list_transform(c.t{r}, lambda x, j: CASE WHEN x = toks[j] THEN x ELSE '<*>' END) ELSE c.t{r} END"
    return S.recursive(S.with_(*LOG_TOKS,
        f"pad AS (SELECT line_id, (row_number() OVER (ORDER BY line_id) - 1) // 2000 AS batch, {padded} AS p FROM lt)",
        f"rw AS ({rot})",
        "ms AS MATERIALIZED (SELECT rot, batch, toks, len(toks) AS n, row_number() OVER (PARTITION BY len(toks) ORDER BY rot, batch, md5(rot || ' ' || array_to_string(toks, ' '))) AS k "
        "FROM (SELECT DISTINCT rot, batch, toks FROM rw))",
        f"""bg(n, k, state, hits) USING KEY (n) AS (
  SELECT DISTINCT n, CAST(0 AS BIGINT), CAST([] AS STRUCT(leaf VARCHAR, t0 VARCHAR[], t1 VARCHAR[], t2 VARCHAR[])[]), CAST([] AS BIGINT[]) FROM ms
  UNION
  SELECT n, k, CASE WHEN hit = len(state) + 1 THEN list_append(state, {{'leaf': CASE WHEN known THEN toks[1]
        WHEN regexp_matches(toks[1], '[0-9]') OR toks[1] = '<*>' OR others >= 99 THEN '<*>' ELSE toks[1] END, 't0': toks, 't1': toks, 't2': toks}})
      ELSE list_transform(state, lambda c, i: CASE WHEN i = hit THEN {{'leaf': c.leaf, 't0': {merge(0)}, 't1': {merge(1)}, 't2': {merge(2)}}} ELSE c END) END,
    list_append(hits, hit)
  FROM (SELECT *, CASE WHEN best.eq / n >= 0.4 THEN best.i ELSE len(state) + 1 END AS hit
    FROM (SELECT w.n, l.k, l.rot, w.state, w.hits, l.toks, {known} AS known,
        len(list_filter(list_distinct(list_transform(w.state, lambda c: c.leaf)), lambda x: x <> '<*>')) AS others,
        list_max(list_filter(list_transform(w.state, lambda c, i: {{
          'eq': CASE WHEN c.leaf = CASE WHEN {known} THEN l.toks[1] ELSE '<*>' END THEN len(list_filter({now}, lambda x, j: x <> '<*>' AND x = l.toks[j])) ELSE -1 END,
          'par': len(list_filter({now}, lambda x: x = '<*>')), 'o': -i, 'i': i}}), lambda r: r.eq >= 0)) AS best
      FROM bg w JOIN ms l ON l.n = w.n AND l.k = w.k + 1)))""",
        "u AS (SELECT m.rot, m.batch, m.toks, x.n, x.hit FROM (SELECT n, unnest(hits) AS hit, generate_subscripts(hits, 1) AS k FROM bg) x JOIN ms m ON m.n = x.n AND m.k = x.k)",
        "pk AS (SELECT r.line_id, r.rot, u.n, max(u.hit) OVER (PARTITION BY r.line_id ORDER BY r.rot) AS hit FROM rw r JOIN u ON u.rot = r.rot AND u.batch = r.batch AND u.toks = r.toks)",
        "tp AS (SELECT line_id, rot, CASE rot WHEN 0 THEN c.t0 WHEN 1 THEN c.t1 ELSE c.t2 END AS t FROM (SELECT pk.*, bg.state[pk.hit] AS c FROM pk JOIN bg USING (n)))",
        "tt AS (SELECT line_id, rot, array_to_string(CASE WHEN rot = 0 THEN t ELSE list_concat(t[len(t) - rot + 1:], t[1:len(t) - rot]) END, ' ') AS t FROM tp)",
        "v AS (SELECT line_id, t, count(*) AS c, min(rot) AS r, row_number() OVER (PARTITION BY line_id ORDER BY count(*) DESC, min(rot)) AS o FROM tt GROUP BY line_id, t)",
        "w AS (SELECT *, max(c) OVER (PARTITION BY line_id) AS most FROM v WHERE o <= 2)")
        + "SELECT line_id, arg_max(t, {'w': length(t) - length(replace(t, '<*>', '')), 'o': -o}) AS event_template FROM w WHERE c = most GROUP BY line_id")


@register("mine_rotated_batches", _batched_sql())
def q_mine_rotated_batches(spark, sf):
    """C4 with batches of 2,000 lines, seeded order and clusters carried over all rotations."""
    return FD.mine_rotated_in_order(_content(spark, sf), "content", LOG_MASKS)


DYN = S.threshold_sql("n")
PASS1 = ("dm AS (SELECT toks, min(line_id) AS first_line, count(*) AS hits, CAST(len(toks) AS VARCHAR) AS grp FROM lt GROUP BY toks)",
         S.split_ctes("dm", DYN, "one"),
         """consts AS (SELECT constant, min(line_id) AS line_id FROM (
  SELECT list_filter(string_split(any_value(template), ' '), lambda x: NOT contains(x, '<*>'))[1] AS constant, min(first_line) AS line_id
  FROM one JOIN dm USING (toks) GROUP BY one.grp
  HAVING list_contains(string_split(any_value(template), ' '), '<*>') OR sum(hits) >= 385) WHERE constant IS NOT NULL GROUP BY constant)""")


def _type_tokens(spark, sf):
    # read by every pass over the lines that follows: the regex chain runs once
    lines = written(_content(spark, sf).select("line_id", tokenize(mask_types(F.col("content"))).alias("tokens")))
    return lines, D.messages(lines)


@register("split_constants", S.recursive(S.with_(*TYPE_TOKS, *PASS1) + "SELECT constant, line_id FROM consts"))
def q_split_constants(spark, sf):
    """Constants found by position splitting, independent of line order, and the first line of their clusters."""
    return D.discover_constants(_type_tokens(spark, sf)[1])


def _parameter(x):
    return f"contains({x}, '<*>') AND NOT regexp_matches({x}, '[\\p{{L}}\\p{{N}}]')"


# the pass over all lines, one per step: constants with their line, and the clusters of none with their lines so far
IN_ORDER = f"""cl AS MATERIALIZED (SELECT line_id, toks, len(toks) AS n, row_number() OVER (ORDER BY line_id) AS k FROM lt WHERE len(toks) > 0),
cg(one, k, known, none) USING KEY (one) AS (
  SELECT 1, CAST(0 AS BIGINT), CAST([] AS STRUCT(c VARCHAR, line BIGINT)[]), CAST([] AS STRUCT(t VARCHAR[], hits BIGINT)[])
  UNION
  SELECT one, k, CASE WHEN promoted IS NULL THEN known ELSE list_append(known, {{'c': promoted, 'line': line_id}}) END,
    CASE WHEN routed THEN none WHEN hit IS NULL THEN list_append(none, {{'t': toks, 'hits': CAST(1 AS BIGINT)}})
      ELSE list_filter(list_transform(none, lambda x, i: CASE WHEN i = hit THEN {{'t': new, 'hits': x.hits + 1}} ELSE x END),
                       lambda x: promoted IS NULL OR NOT list_contains(x.t, promoted)) END
  FROM (SELECT *, CASE WHEN NOT routed AND hit IS NOT NULL AND (new <> none[hit].t OR none[hit].hits = 384)
      THEN nullif(list_filter(new, lambda x: NOT contains(x, '<*>'))[1], 'None') END AS promoted
    FROM (SELECT *, CASE WHEN hit IS NOT NULL THEN list_transform(none[hit].t, lambda x, j: CASE WHEN x = toks[j] THEN x ELSE '<*>' END) END AS new
      FROM (SELECT *, CASE WHEN NOT routed AND (best.same OR best.eq / n >= {S.threshold_sql('n')}) THEN best.i END AS hit
        FROM (SELECT g.one, g.known, g.none, l.*, NOT list_contains(l.toks, 'None') AND list_has_any(l.toks, list_transform(g.known, lambda x: x.c)) AS routed,
            list_max(list_filter(list_transform(g.none, lambda x, i: {{'same': x.t = l.toks,
              'eq': CASE WHEN len(x.t) = l.n THEN len(list_filter(x.t, lambda y, j: y = l.toks[j] AND NOT ({_parameter('y')}))) ELSE -1 END,
              'par': len(list_filter(x.t, lambda y: {_parameter('y')})), 'o': -i, 'i': i}}), lambda r: r.eq >= 0)) AS best
          FROM cg g JOIN cl l ON l.k = g.k + 1))))),
consts AS (SELECT x.c AS constant, x.line AS line_id FROM (SELECT unnest(known) AS x FROM cg))"""
BUCKETED = """bucketed AS (SELECT d.toks, arg_min(c.constant, {'l': c.line_id, 'c': c.constant}) AS bucket
  FROM (SELECT toks, unnest(list_distinct(toks)) AS tok FROM (SELECT DISTINCT toks FROM lt)) d
  LEFT JOIN consts c ON d.tok = c.constant AND NOT list_contains(d.toks, 'None') GROUP BY d.toks)"""
CLUSTERED = (BUCKETED, "dr AS (SELECT toks, coalesce('=' || bucket, 'none') || chr(31) || len(toks) AS grp FROM bucketed)", S.split_ctes("dr", DYN, "two"))


def _at(lines):
    return lines.select(F.col("line_id").alias("at"), "tokens")


@register("constants", S.recursive(S.with_(*TYPE_TOKS, IN_ORDER) + "SELECT constant, line_id FROM consts"))
def q_constants(spark, sf):
    """Constants and the line of their discovery, as a pass in line order finds them."""
    return constants_in_order(_at(_type_tokens(spark, sf)[0]), dynamic_threshold)


@register("constant_route", S.recursive(S.with_(*TYPE_TOKS, IN_ORDER) + """SELECT line_id, bucket FROM (
  SELECT l.line_id, list_filter((SELECT list(c ORDER BY c.line_id) FROM consts c),
    lambda c: c.line_id < l.line_id AND list_contains(l.toks, c.constant) AND NOT list_contains(l.toks, 'None'))[1].constant AS bucket FROM lt l)"""))
def q_constant_route(spark, sf):
    """P5: every line's bucket, the first constant in it of those discovered before the line."""
    lines = _at(_type_tokens(spark, sf)[0])
    return route_in_order(lines, constants_in_order(lines, dynamic_threshold)).select(F.col("at").alias("line_id"), "bucket")


def _dynamic_members(spark, sf):
    lines, msgs = _type_tokens(spark, sf)
    routed = D.route(msgs, constants_in_order(_at(lines), dynamic_threshold))
    return lines, D.cluster_buckets(routed).join(msgs.select("msg_id", "first_line_id", "last_line_id"), "msg_id")


@register("dynamic_clusters", S.recursive(S.with_(*TYPE_TOKS, IN_ORDER, *CLUSTERED)
          + "SELECT l.line_id, t.template AS event_template FROM lt l JOIN two t ON l.toks = t.toks"))
def q_dynamic_clusters(spark, sf):
    """Every line's cluster template before branching, correction and merging."""
    lines, m = _dynamic_members(spark, sf)
    return lines.join(m.select("tokens", F.array_join("template", " ").alias("event_template")), "tokens").select("line_id", "event_template")


_RUN = "[ ,!;:=|\"''+.\\[\\](){}]*"


def _shared(a, b, end):
    """The common run of delimiters that two tokens begin (or end) with."""
    run = (lambda t: f"reverse(regexp_extract({t}, '{_RUN}$'))") if end else (lambda t: f"regexp_extract({t}, '^{_RUN}')")
    k = f"list_max(list_filter(range(0, 1 + least(length({run(a)}), length({run(b)}))), lambda z: left({run(a)}, z) = left({run(b)}, z)))"
    return f"reverse(left({run(a)}, {k}))" if end else f"left({run(a)}, {k})"


def _like(a, b):
    return f"len(list_filter({a}, lambda x, j: x = {b}[j] OR contains(x, '<*>')))"


PATHS = f"""pl AS MATERIALIZED (SELECT l.line_id, l.toks, min(l.line_id) OVER (PARTITION BY t.grp) AS cluster,
    row_number() OVER (PARTITION BY t.grp ORDER BY l.line_id) AS k FROM lt l JOIN two t ON l.toks = t.toks),
pg(cluster, k, paths) USING KEY (cluster) AS (
  SELECT cluster, k, [toks] FROM pl WHERE k = 1
  UNION
  SELECT cluster, k, CASE WHEN covered THEN paths WHEN len(paths) < 2 THEN list_sort(list_distinct(list_append(paths, toks)))
    ELSE list_sort(list_distinct(list_transform(paths, lambda p: list_transform(p, lambda x, i: CASE WHEN target[i] = toks[i] THEN x
      ELSE {_shared('target[i]', 'toks[i]', False)} || '<*>' || {_shared('target[i]', 'toks[i]', True)} END)))) END
  FROM (SELECT g.cluster, l.k, g.paths, l.toks,
      len(list_filter(g.paths, lambda p: len(list_filter(p, lambda x, j: x = l.toks[j] OR contains(g.paths[1][j], '<*>'))) = len(l.toks))) > 0 AS covered,
      CASE WHEN {_like('l.toks', 'g.paths[2]')} > CASE WHEN {_like('l.toks', 'g.paths[1]')} > 0 THEN {_like('g.paths[1]', 'l.toks')} ELSE 0 END
        THEN g.paths[2] ELSE g.paths[1] END AS target
    FROM pg g JOIN pl l ON l.cluster = g.cluster AND l.k = g.k + 1))"""


@register("cluster_paths", S.recursive(S.with_(*TYPE_TOKS, IN_ORDER, *CLUSTERED, PATHS)
          + "SELECT cluster, array_to_string(p, ' ') AS path FROM (SELECT cluster, unnest(paths) AS p FROM pg)"))
def q_cluster_paths(spark, sf):
    """The paths (at most two) that every cluster holds after its last line; a cluster is named by its first line."""
    lines, m = _dynamic_members(spark, sf)
    m = m.select("cluster", "tokens", F.col("first_line_id").alias("line"), F.col("last_line_id").alias("last"))
    first = m.groupBy("cluster").agg(F.min("line").alias("first"))
    paths = paths_in_order(m, _at(lines))
    return paths.join(first, "cluster").select(F.col("first").alias("cluster"), F.explode("paths").alias("p")) \
                .select("cluster", F.array_join("p", " ").alias("path"))


@register("merge_round", S.with_(S.log_lines_cte(), S.split_cte(), S.masked_log_cte(),
    "it AS (SELECT DISTINCT t FROM (SELECT template AS t FROM masked UNION ALL SELECT content FROM masked))",
    "g AS (SELECT t AS g FROM it WHERE contains(t, '<*>'))") + f"""
SELECT t AS template, arg_min(g, {{'m': len(string_split(g, ' ')), 'g': g}}) AS general FROM it JOIN g
  ON it.t <> g.g AND len(string_split(it.t, ' ')) >= len(string_split(g.g, ' ')) AND {sql_describes('g.g', 'it.t')} AND {sql_jaccard('it.t', 'g.g')} >= 0.6
GROUP BY t""")
def q_merge_round(spark, sf):
    """C3c, one round over the log's templates and raw contents as one bucket."""
    m = masked_log(spark, sf)
    t = m.select("template").union(m.select("content")).distinct()
    items = t.select(F.lit("b").alias("bucket"), F.col("template").alias("ck"), F.lit(0).alias("i"), F.col("template").alias("t"))
    return D.merge_round(items).select(F.col("ck").alias("template"), F.col("g").alias("general"))


@register("mine_dynamic")
def q_mine_dynamic(spark, sf):
    """Constants, branching paths, K1 templates, merge, raw-content assignment."""
    lines, _ = D.mine_dynamic(_content(spark, sf), "content")
    return lines


@register("mine_dynamic_templates")
def q_mine_dynamic_templates(spark, sf):
    _, tpl = D.mine_dynamic(_content(spark, sf), "content")
    return tpl.select("event_template").distinct()


@register("miner_quality")
def q_miner_quality(spark, sf):
    """GA/PA/FGA/FTA of every miner against the known templates (one groupBy pass)."""
    lines, tokens = _user_tokens(spark, sf), F.col("tokens")
    c = lines.select("line_id", F.col("truth_template").alias("truth"))
    runs = [("fixed", mine_in_order(lines, tokens)), ("split", FD.mine_fixed(lines, tokens_col=tokens)),
            ("dynamic", D.mine_dynamic(lines, "content")[0]), ("rotated", FD.mine_rotated(lines, tokens_col=tokens))]
    u = None
    for name, df in runs:
        p = df.select("line_id", F.coalesce("event_template", F.lit("")).alias("parsed")) \
              .withColumn("dataset", F.lit(name))
        u = p if u is None else u.unionByName(p)
    return quality(contingency(u.join(c, "line_id"), ["dataset"]), ["dataset"])


@register("split_agreement")
def q_split_agreement(spark, sf):
    """How far position splitting groups the log's lines as the pass in line order does."""
    lines, tokens = _user_tokens(spark, sf), F.col("tokens")
    g = mine_in_order(lines, tokens).select("line_id", F.col("event_template").alias("truth"))
    p = FD.mine_fixed(lines, tokens_col=tokens).select("line_id", F.col("event_template").alias("parsed"))
    both = g.join(p, "line_id").withColumn("dataset", F.lit("log"))
    return quality(contingency(both, ["dataset"]), ["dataset"])


VOTES = ("votes AS (SELECT line_id, k AS rotation, CASE WHEN k = 0 THEN template WHEN k = 1 THEN truth_template "
         "ELSE template END AS event_template FROM masked, (SELECT unnest([0, 1, 2]) AS k))")


@register("vote_rotations", S.with_(S.log_lines_cte(), S.split_cte(), S.masked_log_cte(), VOTES) + """
, counted AS (SELECT line_id, event_template, count(*) AS votes, min(rotation) AS first_rotation
              FROM votes GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY votes DESC,
           (length(event_template) - length(replace(event_template, '<*>', ''))) / 3 DESC, first_rotation) AS r
           FROM counted)
SELECT line_id, event_template FROM ranked WHERE r = 1""")
def q_vote(spark, sf):
    """Majority vote over per-rotation templates (votes here: parse, truth, parse)."""
    m = masked_log(spark, sf)
    votes = m.select("line_id", F.explode(F.array(
        F.struct(F.lit(0).alias("rotation"), F.col("template").alias("event_template")),
        F.struct(F.lit(1).alias("rotation"), F.col("truth_template").alias("event_template")),
        F.struct(F.lit(2).alias("rotation"), F.col("template").alias("event_template")))).alias("v")) \
        .select("line_id", "v.*")
    return FD.vote(votes)
