"""Template matching by routed joins against every template tried on every line."""

import re

import pytest
from pyspark.sql import functions as F

from logweave.functions.tokens import event_id
from logweave.operators.matching import best_template, key_kinds, match_templates, prepare_templates

W = "<*>"
TEMPLATES = ["open <*>", "a<*>", "<*>/x<*>", "<*> <*>", "<*>", "<*> <*> <*>", "<*>: done", "id=<*>", "<*>bc<*> <*>q", "<*>.<*>", "x", "<*> to <*>",
             "<*><*>", "<num> of <*>", "<*>  <*>"]
LINES = ["open it", "abc", "p/xq", "one two", "one two three", "t: done", "id=5", "zbcz 1q", "a.b", "x", "", "go to it", "one\ttwo", "7 of 9", "two\nlines",
         " lead", "bc q", "a  b", "/x", "ä.ö", "open", "a b c d"]


def param_pattern(t):
    t = re.sub(r"<.{1,5}>", W, t)
    t = re.sub(r"([^A-Za-z0-9])", r"\\\1", t)
    t = t.replace("\\ ", r"\s+")  # each blank stands for a run of white space
    return t.replace(r"\<\*\>", "(.*?)") + r"\Z"


def describe_pattern(t):
    return "(?s)" + ".*?".join(map(re.escape, t.split(W))) + r"\Z"


@pytest.mark.parametrize("kind, pattern", [("param", param_pattern), ("describe", describe_pattern)])
def test_first_match_in_priority(spark, kind, pattern):
    import hashlib

    ids = {t: hashlib.md5(t.encode()).hexdigest()[:8] for t in TEMPLATES}
    order = sorted(TEMPLATES, key=lambda t: (-len(t.replace(W, "").replace(" ", "")), t.count(W), ids[t]))
    exp = {i: next((t for t in order if re.match(pattern(t), line)), None) for i, line in enumerate(LINES)}
    tp = spark.createDataFrame([(t,) for t in TEMPLATES], "event_template string").select(event_id(F.col("event_template")).alias("event_id"), "event_template")
    lines = spark.createDataFrame(list(enumerate(LINES)), "line_id long, content string").repartition(3)
    assert {r.line_id: r.event_template for r in match_templates(lines, tp, kind=kind).collect()} == exp
    assert key_kinds(prepare_templates(tp)) == ["first", "gaps", "gram", "head", "token"]
    assert {r.event_template for r in match_templates(lines, tp.limit(0), kind=kind).collect()} == {None}


def test_best_of_a_length(spark):
    messages = [("m1", ["a", "b", "c"]), ("m2", ["q", "r", "s"]), ("m3", ["a", "x", W]), ("m4", ["only"]), ("m5", ["a", "b"])]
    templates = [(1, ["a", W, "c"]), (2, ["a", "b", W]), (3, [W, W, "z"]), (4, [W, "y", W]), (5, ["a", "q"]), (6, ["a", W])]
    m = spark.createDataFrame(messages, "msg_key string, tokens array<string>")
    t = spark.createDataFrame(templates, "cluster_id long, template_tokens array<string>")
    got = {r.msg_key: (r.cluster_id, r.similarity) for r in best_template(m, t, threshold=0.4).collect()}
    exp = {}
    for k, toks in messages:
        scored = [(sum(x == y != W for x, y in zip(tt, toks, strict=True)) / len(toks), tt.count(W), -i) for i, tt in templates if len(tt) == len(toks)]
        if scored:
            sim, _, i = max(scored)
            exp[k] = (-i if sim >= 0.4 else -1, round(sim, 6))
    assert got == exp
