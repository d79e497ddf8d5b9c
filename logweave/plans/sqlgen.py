"""SQL text builders for the DuckDB oracle side of every registered query.

These render, in DuckDB's dialect (RE2 regex, ``lambda`` list functions), the
same semantics as the Column builders in ``logweave.functions`` — written
independently so the driver's comparison is a real cross-check.
"""

from __future__ import annotations

from logweave.functions.masks import MASK_ORDER, MASK_PATTERNS, MASK_TAGS, WILDCARD_RUN
from logweave.sources.logformat import compile_format
from logweave.sources.tables import LOG_LINES_FORMAT, LOG_LINES_SQL


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def rx_replace(expr: str, pattern: str, rep: str) -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(rep)}, 'g')"


def strip_sql(expr: str) -> str:
    return rx_replace(expr, r"^\s+|\s+$", "")


def mask_chain_sql(expr: str, types=None, typed: bool = False, collapse: bool = True) -> str:
    order = MASK_ORDER if types is None else [t for t in MASK_ORDER if t in set(types)]
    out = expr
    for t in order:
        out = rx_replace(out, MASK_PATTERNS[t], MASK_TAGS[t] if typed else "<*>")
    return rx_replace(out, WILDCARD_RUN, "<*>") if collapse else out


def tokens_sql(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '\\s+'), lambda x: x <> '')"


def join_tokens_sql(expr: str, sep: str = " ") -> str:
    return f"array_to_string({expr}, {q(sep)})"


def event_id_sql(expr: str) -> str:
    return f"substr(md5({expr}), 1, 8)"


def log_lines_cte() -> str:
    return f"log_lines AS ({LOG_LINES_SQL})"


def split_cte(name: str = "split", source: str = "log_lines", fmt: str = LOG_LINES_FORMAT,
              keep: tuple[str, ...] = ("line_id", "truth_template"), headers=None) -> str:
    f = compile_format(fmt)
    line = strip_sql("value")
    cols = list(keep)
    for h in (f.headers if headers is None else headers):
        g = f"regexp_extract({line}, {q(f.pattern)}, {f.group_of(h)})"
        if f.optional[f.headers.index(h)]:
            g = f"nullif({g}, '')"
        cols.append(f'{g} AS "{h}"')
    return (f"{name} AS (SELECT {', '.join(cols)} FROM {source} "
            f"WHERE regexp_matches({line}, {q(f.pattern)}))")


def text_lines_cte(name: str = "text_lines") -> str:
    return (f"{name} AS (SELECT doc_id, CAST(pos AS BIGINT) AS pos, doc_id * 2147483648 + pos AS line_id, value "
            f"FROM (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS value "
            f"FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))")


def masked_log_cte(name: str = "masked", source: str = "split") -> str:
    """Content → mask chain → whitespace tokens → template (blank-joined)."""
    m = mask_chain_sql('"Content"')
    return (f"{name} AS (SELECT line_id, truth_template, \"Content\" AS content, "
            f"{join_tokens_sql(tokens_sql(m))} AS template FROM {source})")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def fixpoint_program_sql(base: str, key: str, expr_col: str, steps: list[tuple]) -> str:
    """A recursive CTE running a rule program over ``(key, t)`` rows of ``base``.

    ``steps``: ("map", sql_of_t) applied once, or ("loop", a, b) meaning
    ``while a in t: t = t.replace(a, b)`` — the literal loop, iterated by the
    recursion until the pattern is gone.  Yields ``prog(key, t)``.
    """
    n = len(steps)
    t_cases, s_cases = [], []
    for i, st in enumerate(steps):
        if st[0] == "map":
            t_cases.append(f"WHEN {i} THEN {st[1]}")
            s_cases.append(f"WHEN {i} THEN {i + 1}")
        elif st[0] == "rxloop":  # while re.search(a, t): t = re.sub(a, b, t)
            _, a, b = st
            t_cases.append(f"WHEN {i} THEN regexp_replace(t, {q(a)}, {q(b)}, 'g')")
            s_cases.append(f"WHEN {i} THEN CASE WHEN regexp_matches(regexp_replace(t, {q(a)}, {q(b)}, 'g'), {q(a)}) "
                           f"THEN {i} ELSE {i + 1} END")
        else:
            _, a, b = st
            t_cases.append(f"WHEN {i} THEN replace(t, {q(a)}, {q(b)})")
            s_cases.append(f"WHEN {i} THEN CASE WHEN contains(replace(t, {q(a)}, {q(b)}), {q(a)}) "
                           f"THEN {i} ELSE {i + 1} END")
    return (f"prog_r({key}, t, step) AS (SELECT {key}, {expr_col}, 0 FROM {base} "
            f"UNION ALL SELECT {key}, CASE step {' '.join(t_cases)} END, "
            f"CASE step {' '.join(s_cases)} END FROM prog_r WHERE step < {n}),\n"
            f"prog AS (SELECT {key}, t FROM prog_r WHERE step = {n})")


def number_masks_sql(expr: str) -> str:
    """The three user masks of the log queries without look-around: block ids, addresses,
    then whole numbers between non-alphanumerics (twice, as neighbours share a boundary)
    and digits at the end."""
    out = rx_replace(expr, r"blk_-?\d+", "<*>")
    out = rx_replace(out, r"(\d+\.){3}\d+(:\d+)?", "<*>")
    return whole_numbers_sql(out)


def whole_numbers_sql(expr: str) -> str:
    """Whole numbers between non-alphanumerics (twice, as neighbours share one) and digits at the end, without
    look-around; a masked number stands as chr(2) until the end, for it counts as alphanumeric to its neighbours."""
    for _ in range(2):
        expr = rx_replace(expr, r"([^A-Za-z0-9\x02])-?\+?\d+([^A-Za-z0-9\x02])", "\\1\x02\\2")
    return f"replace({rx_replace(expr, '[0-9]+$', '<*>')}, chr(2), '<*>')"


def general_masks_sql(expr: str) -> str:
    """A blank before the message, then host:port, addresses and whole numbers."""
    out = rx_replace(f"' ' || {expr}", r"([\w-]+\.)+[\w-]+(:\d+)", "<*>")
    out = rx_replace(out, r"(/|)([0-9]+\.){3}[0-9]+(:[0-9]+|)(:|)", "<*>")
    return whole_numbers_sql(out)


def threshold_sql(n: str) -> str:
    """T13 by token count."""
    return (f"CASE {n} WHEN 1 THEN 1.0 WHEN 2 THEN 1/2 WHEN 3 THEN 2/3 WHEN 4 THEN 3/4 WHEN 5 THEN 3/5 WHEN 6 THEN 4/6 "
            f"WHEN 7 THEN 4/7 WHEN 8 THEN 5/8 WHEN 9 THEN 6/9 ELSE 0.5 END")


def route_ctes(lines: str, depth: int = 4, max_child: int = 100, name: str = "routed") -> str:
    """Distinct messages of ``lines(line_id, toks)`` with their routing key (depth 4: the leading token)."""
    assert depth == 4
    return f"""{name}_m AS (SELECT toks, min(line_id) AS first_line, len(toks) AS n,
  CASE WHEN regexp_matches(coalesce(toks[1], ''), '[0-9]') OR contains(coalesce(toks[1], ''), '<*>') THEN NULL ELSE coalesce(toks[1], '') END AS lead
  FROM {lines} GROUP BY toks),
{name}_c AS (SELECT n, lead FROM (SELECT n, lead, row_number() OVER (PARTITION BY n ORDER BY min(first_line), lead) AS r
  FROM {name}_m WHERE lead IS NOT NULL GROUP BY n, lead) WHERE r < {max_child}),
{name} AS (SELECT m.toks, m.first_line, CASE WHEN m.n < {depth - 2} THEN 'literal ' || m.n || coalesce(m.toks[1], '')
  ELSE m.n || ' ' || CASE WHEN c.lead IS NULL THEN '<*> any' ELSE c.lead END END AS grp
  FROM {name}_m m LEFT JOIN {name}_c c ON m.n = c.n AND m.lead = c.lead)"""


def split_ctes(source: str, threshold: str, name: str = "mined") -> str:
    """Position splitting of ``source(toks, grp)``: every message's cluster and template.

    ``threshold``: SQL over ``n``, the token count.
    """
    return f"""{name}_r(toks, grp, split, round) AS (
  SELECT toks, grp, CAST(0 AS BIGINT), 0 FROM {source}
  UNION ALL
  SELECT w.toks, CASE WHEN w.round = 0 THEN w.grp ELSE w.grp || chr(31) || w.split || chr(31) || w.toks[w.split] END,
    g.split, w.round + 1
  FROM {name}_r w LEFT JOIN (
    SELECT grp, CASE WHEN count(*) FILTER (k = 1 AND NOT contains(t, '<*>')) / count(*) >= max(th) THEN NULL
      ELSE arg_min(pos, k * 100000 + pos) FILTER (k > 1) END AS split
    FROM (SELECT grp, pos, count(DISTINCT t) AS k, min(t) AS t, max({threshold}) AS th
      FROM (SELECT CASE WHEN round = 0 THEN grp ELSE grp || chr(31) || split || chr(31) || toks[split] END AS grp,
              len(toks) AS n, unnest(toks) AS t, generate_subscripts(toks, 1) AS pos
            FROM {name}_r WHERE round = 0 OR split IS NOT NULL) GROUP BY grp, pos) GROUP BY grp) g
  ON g.grp = CASE WHEN w.round = 0 THEN w.grp ELSE w.grp || chr(31) || w.split || chr(31) || w.toks[w.split] END
  WHERE w.round = 0 OR w.split IS NOT NULL),
{name}_f AS (SELECT toks, grp FROM {name}_r WHERE round > 0 AND split IS NULL),
{name}_p AS (SELECT grp, pos, CASE WHEN count(DISTINCT t) = 1 THEN min(t) ELSE '<*>' END AS t
  FROM (SELECT grp, unnest(toks) AS t, generate_subscripts(toks, 1) AS pos FROM {name}_f) GROUP BY grp, pos),
{name} AS (SELECT f.toks, f.grp, coalesce(p.template, '') AS template FROM {name}_f f
  LEFT JOIN (SELECT grp, string_agg(t, ' ' ORDER BY pos) AS template FROM {name}_p GROUP BY grp) p USING (grp))"""


def greedy_ctes(lines: str, st: str, name: str = "mined") -> str:
    """The sequential pass over ``lines(line_id, toks)``, one line of every token count per step (depth 4, at most
    100 children): the clusters of a count so far are its state, in the order of their opening."""
    leaf_of = f"list_contains(list_transform(w.state, lambda c: c.leaf), l.toks[1])"
    return f"""{name}_l AS MATERIALIZED (SELECT line_id, toks, len(toks) AS n, row_number() OVER (PARTITION BY len(toks) ORDER BY line_id) AS k
  FROM {lines} WHERE len(toks) >= 2),
{name}_g(n, k, state, hits) USING KEY (n) AS (
  SELECT DISTINCT n, CAST(0 AS BIGINT), CAST([] AS STRUCT(leaf VARCHAR, tpl VARCHAR[])[]), CAST([] AS BIGINT[]) FROM {name}_l
  UNION
  SELECT n, k, CASE WHEN hit = len(state) + 1 THEN list_append(state, {{'leaf': CASE WHEN known THEN toks[1]
        WHEN regexp_matches(toks[1], '[0-9]') OR toks[1] = '<*>' OR others >= 99 THEN '<*>' ELSE toks[1] END, 'tpl': toks}})
      ELSE list_transform(state, lambda c, i: CASE WHEN i = hit THEN {{'leaf': c.leaf,
        'tpl': list_transform(c.tpl, lambda x, j: CASE WHEN x = toks[j] THEN x ELSE '<*>' END)}} ELSE c END) END, list_append(hits, hit)
  FROM (SELECT *, CASE WHEN best.eq / n >= {st} THEN best.i ELSE len(state) + 1 END AS hit
    FROM (SELECT *, list_max(list_filter(list_transform(state, lambda c, i: {{
        'eq': CASE WHEN c.leaf = leaf THEN len(list_filter(c.tpl, lambda x, j: x <> '<*>' AND x = toks[j])) ELSE -1 END,
        'par': len(list_filter(c.tpl, lambda x: x = '<*>')), 'o': -i, 'i': i}}), lambda r: r.eq >= 0)) AS best
      FROM (SELECT w.n, l.k, w.state, w.hits, l.toks, {leaf_of} AS known, CASE WHEN {leaf_of} THEN l.toks[1] ELSE '<*>' END AS leaf,
          len(list_filter(list_distinct(list_transform(w.state, lambda c: c.leaf)), lambda x: x <> '<*>')) AS others
        FROM {name}_g w JOIN {name}_l l ON l.n = w.n AND l.k = w.k + 1)))),
{name} AS (SELECT l.line_id, array_to_string(u.state[u.hit].tpl, ' ') AS template
  FROM (SELECT n, state, unnest(hits) AS hit, generate_subscripts(hits, 1) AS k FROM {name}_g) u JOIN {name}_l l ON l.n = u.n AND l.k = u.k
  UNION ALL SELECT line_id, coalesce(toks[1], '') FROM {lines} WHERE len(toks) < 2)"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)
