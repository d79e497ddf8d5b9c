"""Masking and format split against Python's ``re`` on the given tables."""

import re

from pyspark.sql import functions as F

from conftest import SF_SMALL
from logweave.functions import masks as M
from logweave.plans.common import ascii_text_lines, split_log
from logweave.sources.logformat import compile_format


def py_chain(s, types=None, typed=False):
    for t in (types or M.MASK_ORDER):
        s = re.sub(M.MASK_PATTERNS[t], M.MASK_TAGS[t] if typed else "<*>", s)
    return re.sub(M.WILDCARD_RUN, "<*>", s)


def test_mask_chain_equals_python_re(spark):
    rows = ascii_text_lines(spark, SF_SMALL).select(
        "value", M.mask_types(F.col("value")).alias("m"), M.mask_types(F.col("value"), typed=True).alias("t")
    ).collect()
    assert rows
    for r in rows:
        assert r["m"] == py_chain(r["value"])
        assert r["t"] == py_chain(r["value"], typed=True)


HELD = {
    "url": ["http://a.bc", "see https://www.x-y.org:8/z?q ."],
    "IPv4_port": ["1.2.3.4", "/10.0.0.1:5 x", "1.2.3"],
    "host_port": ["a.b:1", "-._:9", "a.b: 1"],
    "package_host": ["a.b.c", "x-.-.y$z$q@w", "a.b. c", "End. a.b.c"],
    "IPv6": ["::", "::1", "a::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:", "f:e::d:c", "1:2:3"],
    "Mac_address": ["0A:1b:2c:3D:4e:5f", "0A-1b-2c-3D-4e-5f"],
    "time": ["12:34", "12:34:56", "12:34,7", "1:2"],
    "path": ["a/b", "/a", "<*>/<*>", "a/", "/"],
    "block": ["blk_1", "blk_-22", "blk-1"],
    "date": ["2020-01-02", "2020/01/02", "2020-1"],
    "duration": ["5ms", "5 sec", "5\ts", "<5s", "5 m"],
    "size": ["5K", "5.", "5. B", "5.1 kb", "5\nG", "12 TB", "5 x"],
    "numerical": ["-5", "0xff", "0X", "dead", "a1b2", "face", "fac", "+1.5.", "cafebabe"],
    "weekday_months": ["Mon", "Sunday", "May", "Sept", "Sep", "December", "Maybe", "on Wed, Tue"],
}


def test_a_mask_finds_its_matches_in_every_line_that_is_searched(spark):
    """Lines are searched by a mask only where they hold what it needs: none that matches may be left out."""
    lines = [x for xs in HELD.values() for x in xs]
    lines += [a + sep + b for a in lines for b in lines[::5] for sep in (" ", "", "\n")] + ["", "<*> <*>", "<*><*> <*>", "<*>\n<*>", "plain words"]
    for t, needs in M.MASK_NEEDS.items():
        for s in lines:
            assert re.search(needs, s) or not re.search(M.MASK_PATTERNS[t], s), (t, s)
    assert set(M.MASK_ORDER) - set(M.MASK_NEEDS) == {"Mac_address"}
    df = spark.createDataFrame([(x,) for x in [*lines, None]], "s string")
    one = {t: M.mask_types(F.col("s"), [t], collapse=False) for t in M.MASK_ORDER}
    for t in M.MASK_ORDER:
        want = F.regexp_replace("s", M.MASK_PATTERNS[t], "<*>")
        assert df.where(~one[t].eqNullSafe(want)).count() == 0, t
    assert df.where(~M.collapse_wildcards(F.col("s")).eqNullSafe(F.regexp_replace("s", M.WILDCARD_RUN, "<*>"))).count() == 0
    plain = typed = F.col("s")
    for t in M.MASK_ORDER:
        plain, typed = F.regexp_replace(plain, M.MASK_PATTERNS[t], "<*>"), F.regexp_replace(typed, M.MASK_PATTERNS[t], M.MASK_TAGS[t])
    plain, typed = (F.regexp_replace(c, M.WILDCARD_RUN, "<*>") for c in (plain, typed))
    assert df.where(~M.mask_types(F.col("s")).eqNullSafe(plain)).count() == 0
    assert df.where(~M.mask_types(F.col("s"), typed=True).eqNullSafe(typed)).count() == 0


def test_general_masks_with_lookbehind(spark):
    """The n-gram parser's number mask needs look-behind (no SQL oracle): Java vs Python."""
    rows = split_log(spark, SF_SMALL).select("Content", M.mask_general(F.col("Content")).alias("m")).collect()
    for r in rows:
        s = " " + r["Content"]
        for rx in M.GENERAL_MASKS:
            s = re.sub(rx, "<*>", s)
        assert r["m"] == s


def test_format_split_groups_and_optional_headers():
    f = compile_format(r"<Month> <Date> <Time> <Level> <Component>(\[<PID>\])?: <Content>")
    assert f.headers == ("Month", "Date", "Time", "Level", "Component", "PID", "Content")
    assert f.group_of("PID") == 7 and f.group_of("Content") == 8  # group 6 is the format's own (...)? group
    assert f.optional[f.headers.index("PID")] and not f.optional[f.headers.index("Content")]


def test_format_split_optional_group_is_null(spark):
    from logweave.sources.logformat import split_format
    fmt = r"<Component>(\[<PID>\])?: <Content>"
    df = spark.createDataFrame([("sshd[42]: hello there",), ("cron: tick",), ("no colon here",)], "value string")
    out = {r["Content"]: r["PID"] for r in split_format(df, fmt).collect()}
    assert out == {"hello there": "42", "tick": None}
