"""Clustering in line order against a pass over the lines, written from its definition."""

import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from logweave.functions.masks import mask_types
from logweave.functions.tokens import tokenize
from logweave.operators import greedy
from logweave.operators.greedy import mine_batch, mine_in_order, needed
from logweave.plans.common import masked_text

W = "<*>"


def one_pass(rows, st=0.4, max_child=100, depth=4):
    """rows (line, tokens), in line order → line → template after the last line."""
    clusters, own, names = [], {}, {}  # clusters: [path, template]; names: node → literal branches

    def way(toks, opening):
        node = (len(toks),)
        for t in toks[:depth - 3]:
            if t not in names.get(node, ()):
                may = not re.search(r"\d", t) and t != W and len(names.get(node, ())) < max_child - 1
                if opening and may:
                    names.setdefault(node, []).append(t)
                else:
                    t = W
            node += (t,)
        return node

    for line, toks in rows:
        n = len(toks)
        if n < depth - 2:
            clusters.append([None, list(toks)])
            own[line] = clusters[-1]
            continue
        path, best = way(toks, False), None
        for c in clusters:
            if c[0] == path:
                same = sum(a == b != W for a, b in zip(c[1], toks, strict=True))
                score = (same / n, c[1].count(W))
                if best is None or score > best[0]:
                    best = (score, c)
        if best and best[0][0] >= st:
            c = best[1]
            c[1] = [a if a == b else W for a, b in zip(c[1], toks, strict=True)]
        else:
            c = [way(toks, True), list(toks)]
            clusters.append(c)
        own[line] = c
    return {line: " ".join(c[1]) for line, c in own.items()}


def table(spark, rows):
    return spark.createDataFrame([(a, list(b)) for a, b in rows], "line_id long, tokens array<string>")


def result(df):
    return {r.line_id: r.event_template for r in df.collect()}


def random_rows(seed, lines, kinds):
    """Short messages that often repeat, agree in part and change clusters between their lines."""
    rng = random.Random(seed)
    words = ["a", "b", "c", "d1", W, "e", "f", "9"][:kinds]
    return [(3 * line + 1, tuple(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 5])))) for line in range(lines)]


@pytest.mark.parametrize("seed, lines, kinds, st, max_child, depth", [(1, 150, 5, 0.4, 3, 4), (2, 120, 6, 0.5, 2, 5), (3, 150, 4, 0.7, 100, 4), (4, 80, 8, 0.3, 4, 3)])
def test_random_lines(spark, seed, lines, kinds, st, max_child, depth):
    rows = random_rows(seed, lines, kinds)
    got = result(mine_in_order(table(spark, rows).repartition(5), F.col("tokens"), st=st, max_child=max_child, depth=depth))
    assert got == one_pass(rows, st, max_child, depth)


def test_short_lists_of_heads(spark, monkeypatch):
    """Rows that wait because a list has many undecided rows before them are decided all the same."""
    monkeypatch.setattr(greedy, "HEADS", 2)
    rows = random_rows(8, 100, 6)
    assert result(mine_in_order(table(spark, rows), F.col("tokens"))) == one_pass(rows)


def test_text_lines(spark):
    t = masked_text(spark, SF_SMALL).select("line_id", tokenize(mask_types(F.col("value"))).alias("tokens"))
    rows = sorted((r[0], tuple(r[1])) for r in t.collect())
    assert result(mine_in_order(t.repartition(3), F.col("tokens"))) == one_pass(rows)


def test_a_message_may_change_its_cluster(spark):
    """The cluster of the first lines becomes general; a later line of the same message finds a better one."""
    rows = [(1, "x a b c d"), (2, "x a b q r"), (3, "x a b c z"), (4, "x u v c d"), (5, "x a b c d"), (6, "x a b c d")]
    rows = [(line, tuple(s.split())) for line, s in rows]
    assert result(mine_in_order(table(spark, rows), F.col("tokens"), st=0.6)) == one_pass(rows, 0.6)


def test_batches_carry_what_is_known(spark):
    """Three batches, the last with lower line numbers: as one pass in order of arrival."""
    rows = random_rows(5, 150, 6)
    parts = [rows[60:100], rows[100:], rows[:60]]
    known, seen = None, []
    for i, part in enumerate(parts):
        df, known = mine_batch(table(spark, part), F.col("tokens"), max_child=3, known=known, batch=i)
        seen += part
        exp = one_pass(seen, max_child=3)
        assert result(df) == {line: exp[line] for line, _ in part}


def test_edge_tables(spark):
    empty = table(spark, []).select("line_id", "tokens")
    assert mine_in_order(empty, F.col("tokens")).collect() == []
    rows = [(1, ()), (2, ("one",)), (3, ("one",)), (4, ())]
    assert result(mine_in_order(table(spark, rows), F.col("tokens"))) == {1: "", 2: "one", 3: "one", 4: ""}


def test_needed_counts(spark):
    for st in (0.1, 0.3, 0.4, 0.5, 2 / 3, 0.7, 0.9):
        got = spark.range(1, 400).select("id", needed(F.col("id"), F.lit(st)).alias("m")).collect()
        assert all(r.m / r.id >= st > (r.m - 1) / r.id for r in got)


def test_a_later_line_is_taken_up_where_it_stands(spark, monkeypatch):
    """A repeated line that changes a cluster leaves what comes before it, and other token counts, as they were."""
    rows = [(1, tuple("kabcd")), (2, tuple("kaxyz")), (3, tuple("kqbcr")), (4, tuple("kabcd")), (6, tuple("kqbcs")), (7, tuple("kaxyz"))]
    rows += [(10 + i, tuple(f"{w}{i}" for w in "abcdefghi")) for i in range(5)]
    runs, cluster, way = [], greedy.cluster_in_order, greedy.way

    def counted(*args, **kwargs):
        runs.append([])
        return cluster(*args, **kwargs)

    def seen(undecided, *args):
        runs[-1].append({(r.line, r.n) for r in undecided.select("line", "n").collect()})
        return way(undecided, *args)

    monkeypatch.setattr(greedy, "cluster_in_order", counted)
    monkeypatch.setattr(greedy, "way", seen)
    assert result(mine_in_order(table(spark, rows), F.col("tokens"))) == one_pass(rows)
    assert len(runs) > 1
    assert {n for _, n in runs[0][0]} == {5, 9}
    assert runs[1][0] == {(4, 5), (6, 5)}
