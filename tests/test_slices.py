"""Steps over large tables run slice by slice: the same rows, and what a slice needed goes before the next."""

import os
import random

import pytest
from pyspark.sql import functions as F

from logweave import session
from logweave.operators import ngram as N
from logweave.operators.position_split import cluster_groups
from test_miners import _naive_ngram


def _texts(n=120):
    r = random.Random(7)
    words = ["a", "b", "c", "d", "e f", "g,", "<*>"]
    return [" ".join(r.choice(words) for _ in range(r.randrange(1, 9))) for _ in range(n)] + ["x", "a a a a a", ""]


def _lines(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "line_id long, value string")


def _rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.mark.parametrize("slices", [1, 3])
def test_ngram_parse_in_slices(spark, slices):
    texts = _texts()
    lines, m = N.ngram_parse(_lines(spark, texts), "value", masker=lambda c: c, slices=slices)
    got = {r.line_id: r.event_template for r in lines.collect()}
    want = _naive_ngram([t.split() or [""] for t in texts])
    assert [got[i] for i in range(len(texts)) if texts[i]] == [w for w, t in zip(want, texts, strict=True) if t]
    assert m.agg({"mult": "sum"}).first()[0] == len(texts)


def test_ngram_parse_keeps_no_table_that_is_not_read(spark):
    N.ngram_parse(_lines(spark, _texts()), "value", masker=lambda c: c, slices=2)
    at = session.checkpoint_dir(spark).removeprefix("file:")
    kinds = ("grams-", "triples-", "ratios-", "scored-", "messages-")
    before = {x for x in os.listdir(at) if x.startswith(kinds)}
    N.ngram_parse(_lines(spark, _texts()), "value", masker=lambda c: c, slices=2)
    assert {x for x in os.listdir(at) if x.startswith(kinds)} == before


def test_first_lines_with_equal_and_null_ids(spark):
    df = spark.createDataFrame([(i,) for i in (5, 3, 3, 3, 9, None, 1)], "line_id long")
    for n, want in ((1, [None]), (2, [None, 1]), (5, [None, 1, 3, 3, 3]), (4, [None, 1, 3, 3]), (9, [None, 1, 3, 3, 3, 5, 9])):
        d, first = N.first_lines(df, "line_id", n)
        assert _rows(d.where(first), "line_id") == sorted(((x,) for x in want), key=repr)


def test_gram_counts_and_histogram_in_slices(spark):
    found = []
    for slices in (1, 3):
        msgs, scored = N.scored_messages(_lines(spark, _texts()), "value", masker=lambda c: c, slices=slices)
        uni, bi, tri = N.gram_counts(N.exploded_grams(msgs, "msg_id"), slices)
        found.append((_rows(uni, "w", "c1"), _rows(bi, "w1", "w2", "c2"), _rows(tri, "w1", "w2", "w3", "c3"),
                      _rows(N.entropy_histogram(scored, msgs, slices=slices), "f", "count")))
    assert found[0] == found[1]
    lists = [t.split() for t in _texts() if t]
    assert sum(c for _, c in found[0][0]) == sum(map(len, lists))
    assert sum(c for _, c in found[0][3]) == sum(len(t) - 1 for t in lists)


def test_running_counts_in_slices(spark):
    occ = _lines(spark, _texts()).select("line_id", F.explode(F.split("value", " ")).alias("w"))
    assert _rows(N.running_line_counts(occ, ["w"], slices=3), "line_id", "w", "c") == _rows(N.running_line_counts(occ, ["w"]), "line_id", "w", "c")


def test_position_split_in_slices(spark):
    lists = [t.split() for t in sorted(set(_texts()))] + [None]
    rows = [(str(i), t, f"{len(t or [])} {(t or [''])[:1]}") for i, t in enumerate(lists)]
    msgs = spark.createDataFrame(rows, "msg_id string, tokens array<string>, grp string")
    got = [_rows(cluster_groups(msgs, F.lit(0.7), slices), "msg_id", "cluster", "template") for slices in (1, 3)]
    assert got[0] == got[1] and len(got[0]) == len(rows)


def test_slices_follow_the_size_of_the_table(spark, monkeypatch):
    t = session.written(_lines(spark, _texts()))
    assert session.slices_of(t) == 1
    monkeypatch.setattr(session, "SLICE_BYTES", 1)
    assert session.slices_of(t) == session.MOST_SLICES


def test_only_own_tables_are_dropped(spark, tmp_path):
    at = str(tmp_path / "given")
    spark.range(3).write.parquet(at)
    session.drop_written(spark.read.parquet(at))
    assert spark.read.parquet(at).count() == 3
