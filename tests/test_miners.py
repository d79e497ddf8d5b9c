"""Miners against folds written here from their definitions, on the given data."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from logweave.functions.masks import mask_types, mask_user
from logweave.functions.tokens import tokenize
from logweave.operators import dynamic as D
from logweave.operators import fixed_depth as FD
from logweave.operators import ngram as N
from logweave.plans.common import masked_text, split_log
from logweave.plans.q_mine import LOG_MASKS

W = "<*>"
THRESHOLDS = {1: 1, 2: 1 / 2, 3: 2 / 3, 4: 3 / 4, 5: 3 / 5, 6: 4 / 6, 7: 4 / 7, 8: 5 / 8, 9: 6 / 9}


def dynamic_threshold(n):
    return THRESHOLDS.get(n, 0.5)


def split_groups(groups, threshold):
    """groups: key → set of equal-length token tuples; returns message → (members, template)."""
    out, todo = {}, [frozenset(g) for g in groups.values()]
    while todo:
        group = todo.pop()
        n = len(next(iter(group)))
        kinds = [{m[p] for m in group} for p in range(n)]
        constant = sum(len(k) == 1 and W not in next(iter(k)) for k in kinds)
        open_positions = [(len(k), p) for p, k in enumerate(kinds) if len(k) > 1]
        if n == 0 or constant / n >= threshold(n) or not open_positions:
            template = tuple(next(iter(k)) if len(k) == 1 else W for k in kinds)
            out.update({m: (group, template) for m in group})
            continue
        _, p = min(open_positions)
        parts = defaultdict(set)
        for m in group:
            parts[m[p]].add(m)
        todo += map(frozenset, parts.values())
    return out


def fixed_groups(first_line, max_child=100, depth=4):
    """Routing key of every message (depth 4: the leading token)."""
    leads = defaultdict(dict)
    for m, line in first_line.items():
        lead = m[0] if m else ""
        if not re.search(r"\d", lead) and W not in lead:
            leads[len(m)][lead] = min(line, leads[len(m)].get(lead, line))
    own = {n: {t for t, _ in sorted(d.items(), key=lambda kv: (kv[1], kv[0]))[:max_child - 1]} for n, d in leads.items()}
    groups = defaultdict(set)
    for m in first_line:
        if len(m) < depth - 2:
            groups["literal", m].add(m)
        else:
            groups[len(m), m[0] if m[0] in own.get(len(m), ()) else None].add(m)
    return groups


def mined(rows, st=0.4, max_child=100):
    first = {}
    for line, toks in rows:
        first[tuple(toks)] = min(line, first.get(tuple(toks), line))
    found = split_groups(fixed_groups(first, max_child), lambda n: st)
    return {line: " ".join(found[tuple(toks)][1]) for line, toks in rows}


def log_tokens(spark):
    s = split_log(spark, SF_SMALL).select("line_id", F.col("Content").alias("content"))
    return s, [(r[0], list(r[1])) for r in s.select("line_id", tokenize(mask_user(F.col("content"), LOG_MASKS))).collect()]


def text_tokens(spark):
    t = masked_text(spark, SF_SMALL).select("line_id", tokenize(mask_types(F.col("value"))).alias("tokens"))
    return t, [(r[0], list(r[1])) for r in t.collect()]


def result(df):
    return {r["line_id"]: r["event_template"] for r in df.select("line_id", "event_template").collect()}


def test_fixed_depth_on_the_log(spark):
    s, rows = log_tokens(spark)
    assert result(FD.mine_fixed(s, "content", LOG_MASKS)) == mined(rows)


@pytest.mark.parametrize("st, max_child", [(0.4, 100), (0.7, 5)])
def test_fixed_depth_on_text(spark, st, max_child):
    t, rows = text_tokens(spark)
    assert result(FD.mine_fixed(t, tokens_col=F.col("tokens"), st=st, max_child=max_child)) == mined(rows, st, max_child)


def test_partitions_and_order_do_not_matter(spark):
    t, _ = text_tokens(spark)
    a = result(FD.mine_fixed(t.repartition(1), tokens_col=F.col("tokens")))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = result(FD.mine_fixed(t.repartition(13).orderBy(F.xxhash64("line_id")), tokens_col=F.col("tokens")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert a == b


def test_rotation_vote(spark):
    s, rows = log_tokens(spark)
    votes = defaultdict(list)
    for k in range(3):
        padded = [(line, (toks + ["_"] * 3)[:max(3, len(toks))]) for line, toks in rows]
        found = mined([(line, p[k:] + p[:k]) for line, p in padded])
        for line, toks in rows:
            t = found[line].split(" ")
            back = t[len(t) - k:] + t[:len(t) - k]
            votes[line].append(" ".join(back[:max(1, len(toks))]))
    exp = {}
    for line, v in votes.items():
        c = Counter(v)
        exp[line] = max(c, key=lambda t: (c[t], t.count(W), -v.index(t)))
    assert result(FD.mine_rotated(s, "content", LOG_MASKS, rotations=(0, 1, 2))) == exp


def test_dynamic_constants_routes_and_clusters(spark):
    _, rows = text_tokens(spark)
    rows = [(line, t) for line, t in rows if t]
    first, hits = {}, Counter()
    for line, t in rows:
        first[tuple(t)] = min(line, first.get(tuple(t), line))
        hits[tuple(t)] += 1
    by_length = defaultdict(set)
    for m in first:
        by_length[len(m)].add(m)
    found, constants = split_groups(by_length, dynamic_threshold), {}
    for group, template in set(found.values()):
        line = min(first[m] for m in group)
        plain = [t for t in template if W not in t]
        if (W in template or sum(hits[m] for m in group) >= 385) and plain:
            constants[plain[0]] = min(line, constants.get(plain[0], line))
    df = spark.createDataFrame(rows, "line_id long, tokens array<string>")
    msgs = D.messages(df)
    got = {r.constant: r.line_id for r in D.discover_constants(msgs).collect()}
    assert got == constants and constants
    bucket = {m: min(((constants[t], t) for t in m if t in constants), default=(0, None))[1] for m in first}
    routed = D.route(msgs, D.discover_constants(msgs))
    assert {tuple(r.tokens): r.bucket for r in routed.collect()} == bucket
    keyed = defaultdict(set)
    for m, b in bucket.items():
        keyed[b, len(m)].add(m)
    exp = {m: t for m, (_, t) in split_groups(keyed, dynamic_threshold).items()}
    assert {tuple(r.tokens): tuple(r.template) for r in D.cluster_buckets(routed).collect()} == exp


def test_described_templates_go(spark):
    def kept(ts):
        def rx(a, b):
            return re.fullmatch(".*?".join(map(re.escape, a.split(W))), b, re.DOTALL) is not None
        return [t for i, t in enumerate(ts) if not any(j != i and rx(o, t) and (not rx(t, o) or j < i) for j, o in enumerate(ts))]

    lists = [["a <*>", "a b"], ["a b", "a <*>"], ["<*>", "a", "b c"], ["a", "b"], ["<*> a", "<*> <*> a"], [], ["x"]]
    df = spark.createDataFrame([(t,) for t in lists], "ts array<string>")
    assert [r[0] for r in df.select(D.drop_described(F.col("ts"))).collect()] == [kept(t) for t in lists]


def test_merging_goes_to_the_fixpoint(spark):
    """A chain that needs more than three rounds: each template describes the one before alone."""
    ts = ["a b c d e f g h", "a b c d e f <*> h", "a b c d <*> f <*> h", "a b c <*> h"]
    df = spark.createDataFrame([("k", str(i), [t]) for i, t in enumerate(ts)], "bucket string, ck string, ts array<string>")
    got = {r.ck: r.ts for r in D.merge_templates(df).collect()}
    assert got["0"] == got["1"] == got["2"] and len(got["0"]) == 1
    repl = D.merge_round(spark.createDataFrame([(r.bucket, r.ck, 0, r.ts[0]) for r in D.merge_templates(df).collect()],
                                               "bucket string, ck string, i int, t string"))
    assert repl.count() == 0


def test_mine_dynamic_assigns_every_line(spark):
    s, _ = log_tokens(spark)
    lines, tpl = D.mine_dynamic(s, "content")
    got, known = result(lines), {r.event_template for r in tpl.collect()}
    assert len(got) == s.count() and {t for t in got.values() if t is not None} <= known
    assert sum(t is not None for t in got.values()) > 0.9 * len(got)


def _naive_ngram(token_lists, thr=0.2):
    c1, c2, c3 = defaultdict(int), defaultdict(int), defaultdict(int)
    for t in token_lists:
        for i, w in enumerate(t):
            c1[w] += 1
            if i >= 1:
                c2[(t[i - 1], w)] += 1
            if i >= 2:
                c3[(t[i - 2], t[i - 1], w)] += 1
    out = []
    for t in token_lists:
        dyn = [False] * len(t)
        for i in range(1, len(t)):
            if i == 1 or dyn[i - 2]:
                num, den = c2.get((t[i - 1], t[i]), 0), c1.get(t[i - 1], 0)
            else:
                num, den = c3.get((t[i - 2], t[i - 1], t[i]), 0), c2.get((t[i - 2], t[i - 1]), 0)
            f = num / den if num and den else 0
            dyn[i] = f <= thr
        tpl = " ".join("<*>" if d else w for w, d in zip(t, dyn))
        out.append(tpl.replace(",", "").replace("'", "").replace('"', ""))
    return out


def test_ngram_closed_form_equals_sequential(spark):
    s = split_log(spark, SF_SMALL)
    lines, _ = N.ngram_parse(s, "Content", masker=lambda c: mask_types(c))
    got = {r["line_id"]: r["event_template"] for r in lines.collect()}
    tok = s.select("line_id", tokenize(mask_types(F.col("Content"))).alias("t")).orderBy("line_id").collect()
    exp = _naive_ngram([list(r["t"]) for r in tok])
    for r, e in zip(tok, exp):
        assert got[r["line_id"]] == e


def test_token_lines_are_kept_for_all_passes(spark):
    """The masks run once: what the passes over the lines read is a table of tokens."""
    from conftest import SF_SMALL
    from logweave.plans.q_mine import _type_tokens
    lines, msgs = _type_tokens(spark, SF_SMALL)
    assert not any("events.parquet" in f for d in (lines, msgs) for f in d.inputFiles())


def test_ngram_steps_are_tables(spark):
    """No step of the n-gram miner keeps the shuffle files of the one before: messages come from a table of their own."""
    rows = [(i, t) for i, t in enumerate(["a b c", "a b d", "a b c", "x", "", "a b c d e f"] * 3)]
    lines, m = N.ngram_parse(spark.createDataFrame(rows, "line_id long, Content string"), "Content")
    assert m.inputFiles() and all("/parsed-" in f for f in m.inputFiles())
    assert lines.count() == len(rows) and m.agg({"mult": "sum"}).first()[0] == len(rows)


def test_running_line_counts(spark):
    """One row per line and word: the word's occurrences up to and with that line, over buckets of lines."""
    texts = {3: "a a b", 5: "b", 70_000: "a c a", 70_001: "a", 1 << 33: "c b b a"}
    occ = spark.createDataFrame([(i, w) for i, t in texts.items() for w in t.split()], "line_id long, w string")
    got = sorted(map(tuple, N.running_line_counts(occ, ["w"]).select("line_id", "w", "c").collect()))
    seen, want = {}, []
    for i, t in sorted(texts.items()):
        for w in t.split():
            seen[w] = seen.get(w, 0) + 1
        want += [(i, w, seen[w]) for w in set(t.split())]
    assert got == sorted(want)


def test_split_lines_are_kept_for_both_passes(spark):
    """The masks run once: lines and their messages come from one table of tokens."""
    df = spark.createDataFrame([(i, f"job {i} done" if i % 2 else "idle since noon") for i in range(20)], "line_id long, content string")
    got = FD.mine_fixed(df, "content", LOG_MASKS)
    assert got.inputFiles() and {r.event_template for r in got.collect()} == {"job <*> done", "idle since noon"}
