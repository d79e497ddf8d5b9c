"""Scalar template functions against small independent Python versions."""

import re

from pyspark.sql import functions as F

from conftest import SF_SMALL
from logweave.functions import tokens as T
from logweave.plans.common import masked_text


def merged(a, b):
    """Unequal tokens: the delimiters that both begin and end with, around a wildcard."""
    def run(x, y):
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n] and x[n] in " ,!;:=|\"'+.[](){}":
            n += 1
        return x[:n]

    return a if a == b else run(a, b) + "<*>" + run(a[::-1], b[::-1])[::-1]


def test_merge_keep_delimiters(spark):
    pairs = [("(a,", "(bb,"), ("x", "y"), ("[1]", "[22]"), ("..", "..."), ("'q'", "\"q\""), ("", "a"), ("a=", "b="), ("([x])", "([yy])")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(T.merge_token_keep_delims(F.col("a"), F.col("b"))).collect()]
    assert got == [merged(a, b) for a, b in pairs]


def test_describes_and_abstract_against_python(spark):
    m = masked_text(spark, SF_SMALL).select("template").distinct().limit(300).collect()
    ts = [r[0] for r in m]
    pairs = list(zip(ts, ts[1:] + ts[:1]))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select(T.describes(F.col("a"), F.col("b")).alias("d"), T.is_abstract(F.col("a"), F.col("b")).alias("x"),
                    T.describes(F.col("a"), F.col("a")).alias("self")).collect()
    for (a, b), r in zip(pairs, got):
        rx = ".*?".join(re.escape(p) for p in a.split("<*>"))
        assert r["d"] == bool(re.fullmatch(rx, b, re.DOTALL))
        assert r["self"]
        esc = re.sub(r"\\\s+", r"\\s+", re.escape(a)).replace(r"<\*>", r"(\S+?)")
        assert r["x"] == bool(re.match("^" + esc + "$", b))


def test_short_event_id(spark):
    import hashlib
    ts = ["a <*> b", "x", "", *[f"t{i}" for i in range(500)]]
    df = spark.createDataFrame([(t,) for t in ts], "t string")
    got = [r[0] for r in df.select(T.short_event_id(F.col("t"))).collect()]
    assert got == [str(int(hashlib.md5(t.encode()).hexdigest(), 16))[:4] for t in ts]


def test_parameters_extraction(spark):
    df = spark.createDataFrame([("Failed password for user 7 from 10.1.7.9 port 31 ssh2",
                                 "Failed password for user <*> from <*> port <*> ssh2")], "c string, t string")
    assert df.select(T.extract_parameters(F.col("c"), F.col("t"))).first()[0] == ["7", "10.1.7.9", "31"]
