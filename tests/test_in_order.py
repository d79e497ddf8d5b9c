"""Constants, buckets and paths as of their line against a pass over the lines, written from the definition."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from logweave.functions.tokens import dynamic_threshold
from logweave.operators.in_order import constants_in_order, paths_in_order, route_in_order

W, DELIMITERS = "<*>", " ,!;:=|\"'+.[](){}"
SHARES = {1: 1, 2: 1 / 2, 3: 2 / 3, 4: 3 / 4, 5: 3 / 5, 6: 4 / 6, 7: 4 / 7, 8: 5 / 8, 9: 6 / 9}


def is_parameter(t):
    return W in t and not any(c.isalnum() for c in t)


def constants_by_pass(rows, population):
    """rows (line, tokens) in order → constant → line, and line → bucket."""
    known, none, bucket = {}, [], {}
    for line, toks in rows:
        bucket[line] = None if "None" in toks else next((c for c in known if c in toks), None)
        if bucket[line] is not None or not toks:
            continue
        same = [c for c in none if c[0] == toks]
        if same:
            c, share = same[0], 1
        else:
            c, share = None, (-1, -1)
            for x in none:
                if len(x[0]) == len(toks):
                    p = sum(map(is_parameter, x[0]))
                    e = sum(a == b and not is_parameter(a) for a, b in zip(x[0], toks, strict=True))
                    if (e, p) > share:
                        c, share = x, (e, p)
            share = share[0] / len(toks)
        if c is None or share < SHARES.get(len(toks), 0.5):
            none.append([toks, 1])
            continue
        new = tuple(a if a == b else W for a, b in zip(c[0], toks, strict=True))
        changed, c[0], c[1] = new != c[0], new, c[1] + 1
        if changed or c[1] == population:
            t = next((t for t in new if W not in t), "None")
            if t != "None":
                known[t] = line
                none = [x for x in none if t not in x[0]]
    return known, bucket


def merge_tokens(a, b):
    def run(x, y):
        k = 0
        while k < min(len(x), len(y)) and x[k] == y[k] and x[k] in DELIMITERS:
            k += 1
        return x[:k]

    return run(a, b) + W + run(a[::-1], b[::-1])[::-1]


def paths_by_pass(rows, limit):
    """rows (line, tokens) of one cluster in order → sorted paths."""
    paths = None
    for _, toks in rows:
        if paths is None:
            paths = [toks]
            continue
        if any(all(t == p[i] or W in paths[0][i] for i, t in enumerate(toks)) for p in paths):
            continue
        if len(paths) < limit:
            paths = paths + [toks]
        else:
            like = lambda x, y: sum(a == b or W in a for a, b in zip(x, y, strict=True))
            most, target = 0, paths[0]
            for p in paths:
                if like(toks, p) > most:
                    most, target = like(p, toks), p
            var = {i: merge_tokens(a, b) for i, (a, b) in enumerate(zip(target, toks, strict=True)) if a != b}
            paths = [tuple(var.get(i, t) for i, t in enumerate(p)) for p in paths]
        paths = sorted(set(paths))
    return paths


def log(seed, lines):
    """Lines of a few forms with values, and some others."""
    rng = random.Random(seed)
    forms = ["open file F by U", "close file F by U", "login U from A ok", "login U from A failed", "restart now", "None of U", "<*> <*> U", "tick"]
    out = []
    for line in range(lines):
        words = rng.choice(forms).split()
        out.append((2 * line + 1, tuple(w + str(rng.randrange(4)) if w in ("F", "U", "A") else w for w in words)))
    return out


def table(spark, rows):
    return spark.createDataFrame([(a, list(b)) for a, b in rows], "at long, tokens array<string>").repartition(3)


@pytest.mark.parametrize("seed, population", [(1, 385), (2, 4)])
def test_constants_and_buckets(spark, seed, population):
    rows = log(seed, 120)
    lines = table(spark, rows)
    constants = constants_in_order(lines, dynamic_threshold, population)
    exp, bucket = constants_by_pass(rows, population)
    assert {r.constant: r.line_id for r in constants.collect()} == exp and exp
    got = {r.at: r.bucket for r in route_in_order(lines, constants).collect()}
    assert got == bucket and None in bucket.values()


def test_no_lines(spark):
    lines = table(spark, [(1, ())])
    assert constants_in_order(lines.limit(0), dynamic_threshold).collect() == []
    assert constants_in_order(lines, dynamic_threshold).collect() == []


@pytest.mark.parametrize("limit", [1, 2, 4])
def test_paths(spark, limit):
    rng = random.Random(limit)
    words = ["a", "[k=1]", "[k=22]", "(x)", "(y)", W, "b.", "c."]
    rows = [(line, rng.choice("pqrs"), tuple(rng.choice(words) for _ in range(3))) for line in range(150)]
    by = defaultdict(list)
    for line, c, toks in rows:
        by[c].append((line, (c, *toks)))
    lines = table(spark, [x for v in by.values() for x in v])
    members = lines.groupBy("tokens").agg(F.min("at").alias("line"), F.max("at").alias("last")).withColumn("cluster", F.get("tokens", 0))
    got = {r.cluster: [tuple(p) for p in r.paths] for r in paths_in_order(members, lines, limit).collect()}
    assert got == {c: paths_by_pass(v, limit) for c, v in by.items()}
