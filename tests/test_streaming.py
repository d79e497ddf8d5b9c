"""Stream results equal batch results on the drained sink."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from logweave.functions.masks import mask_estimated, mask_types
from logweave.functions.tokens import tokenize
from logweave.plans.common import masked_log, split_log
from logweave.plans.q_ngram import q_ngram_templates
from logweave.streaming import stream as G
from test_greedy import one_pass
from test_miners import _naive_ngram


def test_stream_mask_equals_batch(spark):
    s = {(r[0], r[1]) for r in G.stream_mask(spark, SF_SMALL).select("line_id", "template").collect()}
    b = {(r[0], r[1]) for r in masked_log(spark, SF_SMALL).select("line_id", "template").collect()}
    assert s == b


def test_stream_ngram_single_batch_equals_batch(spark):
    s = {(r[0], r[1]) for r in G.stream_ngram(spark, SF_SMALL).select("line_id", "event_template").collect()}
    b = {(r[0], r[1]) for r in q_ngram_templates(spark, SF_SMALL).select("line_id", "event_template").collect()}
    assert s == b


def three_files(spark, folder):
    """The given events re-written as three files (three micro-batches)."""
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    for i in range(3):
        ev.where(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    return ev


def batches(spark, folder):
    """Line ids of each micro-batch: a file each, in order of arrival."""
    import glob
    import os

    files = sorted(glob.glob(f"{folder}/events.parquet/part-*"), key=os.path.getmtime)
    return [{r[0] for r in spark.read.parquet(f).select("event_id").collect()} for f in files]


def test_stream_mine_is_a_pass_over_all_batches_so_far(spark, tmp_path):
    d = str(tmp_path)
    three_files(spark, d)
    got = {r.line_id: r.event_template for r in G.stream_mine(spark, d).collect()}
    rows = {r.line_id: tuple(r.tokens) for r in split_log(spark, SF_SMALL).select(
        "line_id", tokenize(mask_types(F.col("Content"))).alias("tokens")).collect()}
    seen, exp = [], {}
    for ids in batches(spark, d):
        seen += [(i, rows[i]) for i in sorted(ids)]
        known = one_pass(seen)
        exp.update({i: known[i] for i in ids})
    assert got == exp


def test_stream_ngram_scores_against_all_batches_so_far(spark, tmp_path):
    d = str(tmp_path)
    three_files(spark, d)
    got = {r.line_id: r.event_template for r in G.stream_ngram(spark, d).collect()}
    rows = {r.line_id: list(r.tokens) for r in split_log(spark, SF_SMALL).select(
        "line_id", tokenize(mask_types(F.col("Content"))).alias("tokens")).collect()}
    seen, exp = [], {}
    for ids in batches(spark, d):
        seen += sorted(ids)
        exp.update({i: t for i, t in zip(seen, _naive_ngram([rows[i] for i in seen]), strict=True) if i in ids})
    assert got == exp


def test_warm_up_runs_over_several_batches(spark, tmp_path):
    d = str(tmp_path)
    three_files(spark, d)
    warmup = 500  # more than the first batch, less than two
    got = {r.line_id: r.masked for r in G.stream_estimate_masks(spark, d, warmup).collect()}
    order = [i for ids in batches(spark, d) for i in sorted(ids)]
    lines = split_log(spark, SF_SMALL).select("line_id", F.col("Content").alias("content"))
    at = spark.createDataFrame([(i, k) for k, i in enumerate(order)], "line_id long, place long")
    full = {r.line_id: r.m for r in lines.select("line_id", mask_types(F.col("content")).alias("m")).collect()}
    exp = {r.line_id: r.masked for r in mask_estimated(lines.join(at, "line_id"), "content", "masked", "place", warmup=warmup).collect()}
    assert got == exp and set(got) == set(full)
