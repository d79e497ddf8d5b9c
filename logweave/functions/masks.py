"""Masking: replace variable parts of a log message (addresses, paths, numbers...).

Every mask is a fold of ``regexp_replace`` over a Column, so the whole chain is
one projection; nothing leaves the JVM.  A mask of the typed chain searches only
the lines that hold what each of its matches needs (``MASK_NEEDS``).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WILDCARD = "<*>"

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reference for identical masking results):
# the 14 mask patterns, the order they are applied in, their typed tags,
# the day/month word list and the general masks of the n-gram parser.
# ---------------------------------------------------------------------------
WEEKDAY_ABBR = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTH_ABBR = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August",
          "September", "October", "November", "December"]

MASK_PATTERNS = {
    "IPv4_port": r"(/|)(\d+\.){3}\d+(:\d+)?",
    "host_port": r"([\w-]+\.)+[\w-]+\:\d+",
    "package_host": r"([\w-]+\.){2,}[\w-]+(\$[\w-]+)*(\@[\w-]+)?",
    "Mac_address": r"^([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})$",
    "IPv6": r"(([0-9a-fA-F]{1,4}:){7}([0-9a-fA-F]{1,4}|:)|(([0-9a-fA-F]{1,4}:){1,7}|:):((:[0-9a-fA-F]{1,4}){1,7}|:))",
    "path": r"(/|)(([\w.-]+|\<\*\>)/)+([\w.-]+|\<\*\>)",
    "size": r"\b\d+\.?\d*\s?([KGTMkgtm]?(B|b)|([KGTMkgtm]))\b",
    "duration": r"\b\<?\d+\s?(sec|s|ms)\b",
    "block": r"blk\_\-?\d+",
    "numerical": r"\b(\-?\+?\d+\.?\d*)\b|\b0[Xx][a-fA-F\d]+\b|\b[a-fA-F\d]{4,}\b",
    "time": r"\b\d{2}:\d{2}(:\d{2}|:\d{2},\d+)?\b",
    "date": r"\b(\d{4}-\d{2}-\d{2})|\d{4}/\d{2}/\d{2}\b",
    "url": r"\bhttps?:\/\/(www\.)?[a-zA-Z0-9-]+(\.[a-zA-Z]{2,})+(:[0-9]{1,5})?(\/[^\s]*)?\b",
    "weekday_months": r"\b(%s)\b" % "|".join(WEEKDAY_ABBR + WEEKDAYS + MONTH_ABBR + MONTHS),
}

MASK_TAGS = {
    "path": "PATH_TAG",
    "url": "URL_TAG",
    "IPv4_port": "IPv4_TAG",
    "package_host": "PACKAGE_HOST_TAG",
    "Mac_address": "MAC_TAG",
    "host_port": "HOST_TAG",
    "IPv6": "IPv6_TAG",
    "size": "SIZE_TAG",
    "numerical": "NUM_TAG",
    "duration": "DUR_TAG",
    "block": "BLK_TAG",
    "time": "TIME_TAG",
    "date": "DATE_TAG",
    "weekday_months": "WM_TAG",
}

MASK_ORDER = ["url", "IPv4_port", "host_port", "package_host", "IPv6", "Mac_address", "time",
              "path", "block", "date", "duration", "size", "numerical", "weekday_months"]

# What every match of a mask holds: a line without it is not searched by the mask itself.
MASK_NEEDS = {
    "IPv4_port": r"\d\.\d",
    "host_port": r":\d",
    "package_host": r"\.[\w-]+\.[\w-]",
    "IPv6": r"::|:[0-9a-fA-F]{1,4}:",
    "path": r"/",
    "size": r"\d\.?\s?[KGTMkgtmBb]",
    "duration": r"\d\s?[sm]",
    "block": r"blk_",
    "numerical": r"\d|[a-fA-F]{4}",
    "time": r"\d:\d",
    "date": r"\d[-/]\d",
    "url": r"://",
    "weekday_months": r"[ADFJMNOSTW](?:on|ue|ed|hu|ri|at|un|an|eb|ar|pr|ay|ul|ug|ep|ct|ov|ec)",
}

# wildcard runs "<*> <*>" / "<*><*>" collapse into one
WILDCARD_RUN = r"(\<\*\>\s?)+\<\*\>"
RUN_NEEDS = r"\*\>\s?\<\*"

# general masks of the n-gram parser (applied after the user masks, on ' ' + message)
GENERAL_MASKS = [
    r"([\w-]+\.)+[\w-]+(:\d+)",
    r"(/|)([0-9]+\.){3}[0-9]+(:[0-9]+|)(:|)",
    r"(?<=[^A-Za-z0-9])(\-?\+?\d+)(?=[^A-Za-z0-9])|[0-9]+$",
]
# ---------------------------------------------------------------------------

NON_ASCII = r"[^\x00-\x7F]+"
NON_ASCII_TAG = "<N/ASCII>"


def _ordered(types: Iterable[str] | None) -> list[str]:
    if types is None:
        return list(MASK_ORDER)
    wanted = set(types)
    unknown = wanted - set(MASK_ORDER)
    if unknown:
        raise ValueError(f"unknown mask types: {sorted(unknown)}")
    return [t for t in MASK_ORDER if t in wanted]


def replaced(c: Column, pattern: str, by: str, needs: str | None) -> Column:
    """``regexp_replace`` of the lines that hold what every match needs; ``c`` is computed once per row."""
    if needs is None:
        return F.regexp_replace(c, pattern, by)
    return F.transform(F.array(c), lambda x: F.when(x.rlike(needs), F.regexp_replace(x, pattern, by)).otherwise(x))[0]


def collapse_wildcards(c: Column) -> Column:
    """``<*> <*>`` runs → ``<*>``."""
    return replaced(c, WILDCARD_RUN, WILDCARD, RUN_NEEDS)


def mask_types(c: Column, types: Iterable[str] | None = None, typed: bool = False,
               collapse: bool = True) -> Column:
    """Apply the typed mask chain in the fixed order.

    ``typed=True`` writes the per-type tag (``NUM_TAG`` ...) instead of ``<*>``.
    """
    out = c
    for t in _ordered(types):
        out = replaced(out, MASK_PATTERNS[t], MASK_TAGS[t] if typed else WILDCARD, MASK_NEEDS.get(t))
    return collapse_wildcards(out) if collapse else out


def mask_steps(c: Column, types: Iterable[str] | None = None) -> list[tuple[str, Column]]:
    """The intermediate columns of the chain: [(type, value after that step)]."""
    steps, out = [], c
    for t in _ordered(types):
        out = F.regexp_replace(out, MASK_PATTERNS[t], WILDCARD)
        steps.append((t, out))
    return steps


def detect_mask_types(df: DataFrame, col: str, out: str = "matched_types",
                      types: Iterable[str] | None = None) -> DataFrame:
    """M1d: which mask types changed each line, in chain order (array<string>).

    Step columns are materialised once each so the chain is not re-evaluated per
    comparison.
    """
    names = _ordered(types)
    prev = F.col(col)
    tmp = []
    for i, t in enumerate(names):
        name = f"__step{i}"
        df = df.withColumn(name, F.regexp_replace(prev, MASK_PATTERNS[t], WILDCARD))
        tmp.append((t, F.col(name), prev))
        prev = F.col(name)
    flags = [F.when(cur != before, F.lit(t)) for t, cur, before in tmp]
    df = df.withColumn(out, F.array_compact(F.array(*flags)))
    return df.drop(*[f"__step{i}" for i in range(len(names))])


def estimate_mask_types(df: DataFrame, col: str, order_col: str = "line_id",
                        warmup: int = 2000) -> tuple[list[str], object]:
    """M1e, plan-time part: mask types seen in the first ``warmup`` lines.

    Returns (types in chain order, last order value of the warm-up) — both tiny;
    the warm-up is a bounded top-k (``warmup`` rows), never the whole table.
    """
    head = df.select(order_col, col).orderBy(order_col).limit(warmup)
    det = detect_mask_types(head, col)
    row = det.agg(F.array_distinct(F.flatten(F.collect_list("matched_types"))).alias("t"),
                  F.max(order_col).alias("cut"), F.count(F.lit(1)).alias("n")).first()
    seen = set(row["t"] or [])
    return [t for t in MASK_ORDER if t in seen], (row["cut"] if row["n"] >= warmup else None)


def mask_estimated(df: DataFrame, col: str, out: str = "masked", order_col: str = "line_id",
                   warmup: int = 2000) -> DataFrame:
    """M1e: full chain for the warm-up lines, the chain pruned to the seen types after."""
    seen, cut = estimate_mask_types(df, col, order_col, warmup)
    full = mask_types(F.col(col))
    if cut is None:  # fewer lines than the warm-up: every line is a warm-up line
        return df.withColumn(out, full)
    pruned = mask_types(F.col(col), seen)
    return df.withColumn(out, F.when(F.col(order_col) <= F.lit(cut), full).otherwise(pruned))


def mask_user(c: Column, patterns: Sequence[str], replacement: str = WILDCARD) -> Column:
    """User regex list (per dataset), each → ``replacement`` (``''`` removes)."""
    out = c
    for p in patterns:
        out = F.regexp_replace(out, p, replacement)
    return out


def mask_general(c: Column, user: Sequence[str] = ()) -> Column:
    """N-gram parser masks: prefix a blank, user masks, then url/IP/number masks."""
    out = F.concat(F.lit(" "), c)
    out = mask_user(out, user)
    return mask_user(out, GENERAL_MASKS)


def mask_non_ascii(c: Column) -> Column:
    """S3: runs of non-ASCII characters → ``<N/ASCII>``."""
    return F.regexp_replace(c, NON_ASCII, NON_ASCII_TAG)
