"""Text log sources and the header-format split.

A log format such as ``<Date> <Time> <Level> <Component>: <Content>`` becomes an
anchored regex: each ``<Header>`` is a lazy capture group, runs of blanks in the
literal parts become ``\\s+`` and the literal parts are otherwise used as regex
(so a format may carry its own groups, e.g. ``(\\[<PID>\\])?``).  The split is a
single regex rewrite per line into the header groups; non-matching lines are
dropped — all JVM-side, column-pruned, codegen'd.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.functions.masks import mask_general, mask_non_ascii
from logweave.functions.tokens import tokenize

_HEADER = re.compile(r"(<[^<>]+>)")


@dataclass(frozen=True)
class LogFormat:
    """Compiled log format: the regex, header names, and each header's group index."""

    pattern: str
    headers: tuple[str, ...]
    groups: tuple[int, ...]
    optional: tuple[bool, ...]

    def group_of(self, header: str) -> int:
        return self.groups[self.headers.index(header)]


def _capture_groups(rx: str) -> list[tuple[int, int]]:
    """(start offset, depth of enclosing optional groups) for each capturing '(' of ``rx``."""
    out, i, in_class = [], 0, False
    while i < len(rx):
        ch = rx[i]
        if ch == "\\":
            i += 2
            continue
        if in_class:
            if ch == "]":
                in_class = False
        elif ch == "[":
            in_class = True
        elif ch == "(":
            if not rx.startswith("(?", i) or rx.startswith("(?<", i) and not rx.startswith("(?<=", i) \
                    and not rx.startswith("(?<!", i):
                out.append(i)
        i += 1
    return out


def _closing(rx: str, start: int) -> int:
    depth, i, in_class = 0, start, False
    while i < len(rx):
        ch = rx[i]
        if ch == "\\":
            i += 2
            continue
        if in_class:
            if ch == "]":
                in_class = False
        elif ch == "[":
            in_class = True
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
            if depth == 0:
                return i
        i += 1
    raise ValueError(f"unbalanced group in {rx!r}")


def compile_format(log_format: str) -> LogFormat:
    """Build the anchored split regex and the capture-group index of every header."""
    parts = _HEADER.split(log_format)
    rx, headers, header_at = "", [], []
    for k, part in enumerate(parts):
        if k % 2 == 0:
            rx += re.sub(" +", r"\\s+", part)
        else:
            headers.append(part.strip("<").strip(">"))
            header_at.append(len(rx))
            rx += "(.*?)"
    rx = "^" + rx + "$"
    starts = _capture_groups(rx)
    groups, optional = [], []
    for at in header_at:
        idx = starts.index(at + 1)  # +1 for the leading '^'
        groups.append(idx + 1)
        # a header inside a group followed by '?' or '*' is optional → NULL when absent
        opt = False
        for s in starts[:idx]:
            end = _closing(rx, s)
            if end > at + 1 and end + 1 < len(rx) and rx[end + 1] in "?*":
                opt = True
        optional.append(opt)
    return LogFormat(rx, tuple(headers), tuple(groups), tuple(optional))


def py_strip(c: Column) -> Column:
    """Python ``str.strip()`` for ASCII whitespace (``trim`` only strips blanks)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, nth, value): text lines with their place, ``nth`` from 0 in a split.

    A split's lines get consecutive monotonic ids, whichever partition reads it; what
    counts is their distance to the split's first one.
    """
    df = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("__at"), "value")
    first = df.groupBy("file", "block").agg(F.min("__at").alias("__first"))  # a row per split
    return df.join(first, ["file", "block"]).withColumn("nth", F.col("__at") - F.col("__first")).drop("__at", "__first")


def read_text_log(spark: SparkSession, path: str, with_file: bool = False) -> DataFrame:
    """Text file(s) → (raw_line_id, value[, file]); ids from 0 in order of file path and line.

    The id is the line's place in its split plus the lines of all splits before, a
    prefix sum over one row per split.
    """
    df = numbered_lines(spark, path)
    sizes = df.groupBy("file", "block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("file", "block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    out = df.join(base, ["file", "block"])
    return out.select((F.col("__base") + F.col("nth")).cast("long").alias("raw_line_id"), py_strip(F.col("value")).alias("value"),
                      *(["file"] if with_file else []))


_SEP = "\u0001"


def _spread_side(cond: Column) -> Column:
    """Keep a costly predicate where it is written.  Catalyst pushes deterministic
    filters below a repartition, which would run the format regex inside the scan
    of a single-split file; a partition-id guard (always true) pins it above."""
    return F.when(F.spark_partition_id() >= 0, cond)


def split_format(df: DataFrame, log_format: str, col: str = "value", keep: tuple[str, ...] = (),
                 headers: tuple[str, ...] | None = None) -> DataFrame:
    """Keep matching lines, one string column per header (all or ``headers``).

    One regex evaluation per line: the anchored pattern rewrites a matching line
    into its header groups joined by ``\\x01``; non-matching lines stay NULL.  Lines
    that hold that character themselves are taken group by group.
    """
    fmt = compile_format(log_format)
    line = py_strip(F.col(col))
    wanted = fmt.headers if headers is None else headers
    groups = [fmt.group_of(h) for h in wanted]
    rep = _SEP.join(f"${g}" for g in groups) + _SEP  # trailing separator marks a match
    rewritten = F.regexp_replace(line, fmt.pattern, rep)
    # a rewritten line ends with the separator; only a line that already did needs a real test
    matched = F.endswith(rewritten, F.lit(_SEP)) & F.when(F.endswith(line, F.lit(_SEP)), line.rlike(fmt.pattern)) \
        .otherwise(F.lit(True))
    by_group = F.when(line.rlike(fmt.pattern), F.array(*[F.regexp_extract(line, fmt.pattern, g) for g in groups]))
    parts = F.when(line.contains(_SEP), by_group).when(matched, F.split(rewritten, _SEP))
    staged = df.select(*keep, parts.alias("__parts")).where(_spread_side(F.col("__parts").isNotNull()))
    cols = [F.col(k) for k in keep]
    for i, h in enumerate(wanted):
        g = F.get("__parts", i)
        if fmt.optional[fmt.headers.index(h)]:
            g = F.when(g == "", F.lit(None).cast("string")).otherwise(g)
        cols.append(g.alias(h))
    return staged.select(*cols)


def split_with_load_rate(df: DataFrame, log_format: str, col: str = "value",
                         keep: tuple[str, ...] = ()) -> DataFrame:
    """S3: skip empty lines, non-ASCII runs → ``<N/ASCII>``, then S2 (original ids kept)."""
    clean = df.where(py_strip(F.col(col)) != "").withColumn(col, mask_non_ascii(F.col(col)))
    return split_format(clean, log_format, col, keep)


def load_rate(df: DataFrame, log_format: str, col: str = "value") -> DataFrame:
    """Matched lines over non-empty lines, in one aggregate."""
    fmt = compile_format(log_format)
    line = py_strip(F.col(col))
    nonempty = df.where(line != "")
    return nonempty.agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.count_if(line.rlike(fmt.pattern)).alias("matched_lines"),
    ).withColumn("load_rate", F.round(F.col("matched_lines") / F.col("total_lines"), 6))


def split_content(df: DataFrame, log_format: str, col: str = "value",
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """Only the ``Content`` header (column pruning of S2)."""
    return split_format(df, log_format, col, keep, headers=("Content",))


def content_tokens(df: DataFrame, log_format: str, col: str = "value", user_masks: tuple[str, ...] = ()) -> DataFrame:
    """S4 whole: adds ``tokens`` of the masked content of every line; NULL where the line does not match."""
    fmt = compile_format(log_format)
    found = F.when(py_strip(F.col(col)).rlike(fmt.pattern), F.regexp_extract(py_strip(F.col(col)), fmt.pattern, fmt.group_of("Content")))
    return df.withColumn("tokens", tokenize(mask_general(found, user_masks)))
