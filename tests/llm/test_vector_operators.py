"""Periodic runs, SimHash components and whitening against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from reference import all_runs, majority_bits, near_components, run_report

from conftest import SF_SMALL
from rows import edge_docs, edge_rows, no_docs, small_rows  # noqa: F401
from logweave.llm.periodic import Extensions, periodic_runs, word_runs
from logweave.llm.q_vectors import with_planted_periods
from logweave.llm.queries import LLM_QUERIES
from logweave.llm import simhash
from logweave.llm.simhash import cells, near_prints, segment_counts, simhash_components, simhashes, text_fingerprint
from logweave.llm.whitening import leading_components, polar_factor, whitened


# ---------------------------------------------------------------- 11

def random_words(rng):
    kinds, n = rng.choice([1, 2, 2, 3, 5]), rng.randrange(70)
    w = [b"%d" % rng.randrange(kinds) for _ in range(n)]
    if n and rng.random() < 0.5:
        a, p = rng.randrange(n), rng.randrange(1, 7)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


@pytest.mark.parametrize("length, exponent", [(6, 4), (3, 2), (5, 3)])
def test_runs_of_random_words(length, exponent):
    rng = random.Random(length)
    for _ in range(600):
        w = random_words(rng)
        assert [tuple(r) for r in word_runs(w, length, exponent).tolist()] == all_runs(w, length, exponent)


def test_longest_common_extensions():
    rng = random.Random(2)
    for n in (1, 2, 40, 700):
        s = np.array([rng.randrange(1, 3) for _ in range(n)])
        x = Extensions(s)
        places = [(i, j) for i in range(n) for j in range(n) if i != j]
        for i, j in rng.sample(places, min(len(places), 400)):
            k = 0
            while max(i, j) + k < n and s[i + k] == s[j + k]:
                k += 1
            assert x.common(np.array([i]), np.array([j]))[0] == k
        assert sorted(range(n), key=lambda i: s[i:].tolist()) == sorted(range(n), key=lambda i: x.leaf[i])


def test_runs_edge_rows(edge_docs, edge_rows, no_docs):
    got = periodic_runs(edge_docs).collect()
    words = {(r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs)) for r in got}
    for i, text, _ in edge_rows:
        w = (text or "").encode().split()
        assert (i, len(w), tuple(all_runs(w) if len(w) < 5000 else (tuple(x) for x in word_runs(w).tolist()))) in words
    assert len(got) == len(edge_rows) and periodic_runs(no_docs).collect() == []
    with pytest.raises(ValueError):
        periodic_runs(edge_docs, min_exponent=1)


def test_collapsed_text(spark):
    d = spark.createDataFrame([(1, "go " + "a b " * 5 + "stop"), (2, "x x x x x x"), (3, "x x x x x")], "doc_id long, text string")
    got = {r.doc_id: r.collapsed for r in periodic_runs(d).collect()}
    assert got == {1: "go a b stop", 2: "x", 3: "x x x x x"}


def test_op11_query(spark, small_rows, edge_docs):
    got = Counter(tuple(r) for r in LLM_QUERIES["op11_periodic_runs"](spark, SF_SMALL).collect())
    assert got == Counter(run_report(i, t) for i, t, _ in small_rows)
    assert with_planted_periods(edge_docs).count() == edge_docs.count()


# ---------------------------------------------------------------- 12

def test_fingerprints(edge_rows, edge_docs):
    got = Counter((r.id, r.f % (1 << 64)) for r in simhashes(edge_docs).collect())
    assert got == Counter((i, majority_bits(t)) for i, t, _ in edge_rows)
    assert text_fingerprint("A b C d", 3) == text_fingerprint(" a\tB c  D ", 3) and text_fingerprint(None, 3) == 0


def close_prints(seed, n):
    """Numbers of which many differ in one to three bits, in one and in several segments."""
    rng = random.Random(seed)
    out = [0, (1 << 64) - 1, 1, 3, 7]
    while len(out) < n:
        f = rng.choice(out) if rng.random() < 0.7 else rng.getrandbits(64)
        out.append(f ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 5]))))
    return out


def signed(f):
    return f - (1 << 64) if f >> 63 else f


def test_cells_hold_counts(spark):
    prints = sorted(set(close_prints(1, 60)))
    df = spark.createDataFrame([(signed(f),) for f in prints], "f long")
    for r in df.select("f", segment_counts(F.col("f")).alias("at")).collect():
        assert [r.at >> 4 * k & 15 for k in range(16)] == [(r.f % (1 << 64) >> 4 * k & 15).bit_count() for k in range(16)]
    near = Counter(r.f for r in cells(df).collect())
    assert max(near.values()) <= 33 and set(near) == {signed(f) for f in prints}


@pytest.mark.parametrize("rows", [1, 4, 64])
def test_links_with_and_without_full_cells(spark, monkeypatch, rows):
    """All cells by shared neighbours (1), both ways, or nearly all by the join: the same components."""
    monkeypatch.setattr(simhash, "CELL_ROWS", rows)
    prints = sorted(set(close_prints(7, 400)))
    df = spark.createDataFrame([(signed(f),) for f in prints], "f long").repartition(3)
    links = [(r.u % (1 << 64), r.v % (1 << 64)) for r in near_prints(df).collect()]
    assert all(0 < (u ^ v).bit_count() <= 2 for u, v in links)
    parent = {f: f for f in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        parent[root(u)] = root(v)
    groups = Counter((f, min(g for g in prints if root(g) == root(f))) for f in prints)
    exp = near_components([(f, f) for f in prints])
    assert groups == Counter((d, least) for d, _, least in exp)


def test_simhash_edge_rows(edge_docs, edge_rows, no_docs):
    got = Counter(tuple(r) for r in simhash_components(edge_docs).collect())
    assert got == near_components([(i, majority_bits(t)) for i, t, _ in edge_rows])
    assert simhash_components(no_docs).collect() == []


def test_op12_query(spark, small_rows):
    got = Counter(tuple(r) for r in LLM_QUERIES["op12_simhash"](spark, SF_SMALL).collect())
    assert got == near_components([(i, majority_bits(t)) for i, t, _ in small_rows])


# ---------------------------------------------------------------- 13

def test_polar_factor():
    rng = np.random.default_rng(4)
    for values in ([3.0, -1e-9, 5], [1e-3] * 4 + [-7.0] * 3, rng.standard_normal(40)):
        q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
        a = q * np.array(values) @ q.T
        u = polar_factor((a + a.T) / 2)
        assert np.abs(u - q * np.sign(values) @ q.T).max() < 1e-6
        assert np.abs(u @ u - np.eye(len(a))).max() < 1e-12


@pytest.mark.parametrize("values", [[4.0, 3, 2, 1], [5.0, 5, 5], [1e9, 1e3, 1, 1e-3, 0], list(np.geomspace(1, 1e-8, 30)), [7.0], [2.0, 2, 1, 1, 1]])
def test_leading_components(values):
    q, _ = np.linalg.qr(np.random.default_rng(9).standard_normal((len(values), len(values))))
    a = q * np.array(values) @ q.T
    a = (a + a.T) / 2
    for count in {1, (len(values) + 1) // 2, len(values)}:
        e, v = leading_components(a, count)
        assert len(e) == count and np.abs(e - sorted(values, reverse=True)[:count]).max() < 1e-13 * max(values) * len(values)
        assert np.abs(a @ v - v * e).max() < 1e-13 * max(values) * len(values)
        assert np.abs(v.T @ v - np.eye(count)).max() < 1e-13 * len(values)


def check_whitened(rows, vectors, count=32):
    """rows: result rows; vectors: (id, list) in any order."""
    ids = [i for i, _ in vectors]
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in vectors])
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s) / n
    cov = y.T @ y / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    k = min(count, int((e > len(e) * 2.3e-16 * e[0]).sum()))
    assert len(rows) == n * k
    w = {}
    for r in rows:
        w.setdefault(r.vec_id, {})[r.component] = r
    assert Counter(ids) == Counter({i: 1 for i in w})
    got = np.array([[w[i][c + 1].whitened for c in range(k)] for i in ids])
    exp = y @ v[:, :k] / np.sqrt(e[:k])
    sign = np.sign((got * exp).sum(axis=0))
    gaps = np.abs(np.diff(e[:k + 1])).min() / e[0] if k > 1 else 1
    assert np.abs(got - exp * sign).max() < max(1e-9, 1e-12 / gaps)
    for i, d in zip(ids, (n * x - s).astype(object), strict=True):
        r = w[i][1]
        assert (r.n, r.deviation) == (n, sum(a * a for a in d)) and r.identity_error < 1e-8
    for c in range(k):
        assert abs(w[ids[0]][c + 1].explained - e[c] / e.sum()) < 1e-9


def test_whitening_edge_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, (rng.standard_normal(6) * [9, 5, 3, 2, 1, 0.4]).astype("float32").tolist()) for i in range(80)]
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] + [0.0] * 5), (903, [float("-inf")] + [0.0] * 5),
           (904, []), (905, [1.0, 2.0])]
    schema = "vec_id long, embedding array<float>, label int, id int, v int, n int, component int"
    df = spark.createDataFrame([(i, v, 1, 2, 3, 4, 5) for i, v in good + bad], schema).repartition(5)
    check_whitened(whitened(df).collect(), good)
    check_whitened(whitened(df, count=2).collect(), good, 2)
    assert whitened(df.limit(0)).collect() == [] and whitened(df.where("vec_id >= 900")).collect() == []
    same = spark.createDataFrame([(1, [1.0, 2.0])] * 3, "vec_id long, embedding array<float>")
    assert whitened(same).collect() == []
    line = spark.createDataFrame([(None, [float(k), 2.0 * k]) for k in range(9)], "vec_id long, embedding array<double>")
    got = whitened(line).collect()
    assert {r.component for r in got} == {1} and len(got) == 9 and abs(got[0].explained - 1) < 1e-12
    far = spark.createDataFrame([(k, [3e38 * k, 1.0 * k]) for k in range(4)], "vec_id long, embedding array<float>")
    assert {r.deviation for r in whitened(far).collect()} == {None}


def test_op13_query(spark):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    check_whitened(LLM_QUERIES["op13_whitening"](spark, SF_SMALL).collect(), vectors)
