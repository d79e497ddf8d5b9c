"""Tokenising and scalar template functions (T1-T16) and predicates.

All are Column expressions (built-in functions and higher-order functions on
arrays); no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WILDCARD = "<*>"
WILDCARD_RX = r"<\*>"

# ---------------------------------------------------------------------------
# FIXED VALUES: similarity threshold by token count of the dynamic parser
# (1 → 1, 2 → 1/2, 3 → 2/3, 4 → 3/4, 5 → 3/5, 6 → 4/6, 7 → 4/7, 8 → 5/8,
#  9 → 6/9, any other length → 0.5), and the delimiter characters kept
# around a merged variable by the branching merge.
# ---------------------------------------------------------------------------
DYNAMIC_THRESHOLDS = {1: 1 / 1, 2: 1 / 2, 3: 2 / 3, 4: 3 / 4, 5: 3 / 5, 6: 4 / 6, 7: 4 / 7,
                      8: 5 / 8, 9: 6 / 9}
DYNAMIC_THRESHOLD_OTHERS = 0.5
MERGE_DELIMITERS = " ,!;:=|\"'+.[](){}"
# punctuation of the parsing-accuracy tokeniser; '=', '|', '(' and ')' are kept
PUNCTUATION = "!\"#$%&'()+,-/:;=?@.[\\]^_`{|}~"
PUNCTUATION_KEPT = "=|()"
# ---------------------------------------------------------------------------

_SEP = "\u0001"


def _rx_class(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "\\[]^-" else c for c in chars) + "]"


# T1 ------------------------------------------------------------------------
def tokenize(c: Column) -> Column:
    """Whitespace split like Python ``str.split()``: no empty tokens."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def tokenize_unicode(c: Column) -> Column:
    """T1 for non-ASCII text (Python's split() knows Unicode blanks)."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


# T2 ------------------------------------------------------------------------
def pad_for_rotation(tokens: Column, n_rotations: int) -> Column:
    """Messages shorter than the rotation list get ``_`` tokens: n - len + 1 of them."""
    n = F.size(tokens)
    pad = F.array_repeat(F.lit("_"), F.greatest(F.lit(n_rotations) - n + 1, F.lit(0)))
    return F.when(n < n_rotations, F.concat(tokens, pad)).otherwise(tokens)


def rotate(tokens: Column, k: int) -> Column:
    """Left rotation by ``k``: tokens[k:] + tokens[:k]."""
    if k == 0:
        return tokens
    n = F.size(tokens)
    tail = F.slice(tokens, k + 1, F.greatest(n - k, F.lit(0)))
    head = F.slice(tokens, 1, F.least(F.lit(k), n))
    return F.concat(tail, head)


def unrotate_template(template: Column, k: int) -> Column:
    """Inverse rotation on a space-joined template: last k tokens first."""
    if k == 0:
        return template
    toks = F.split(template, " ")
    n = F.size(toks)
    last = F.slice(toks, F.greatest(n - k + 1, F.lit(1)), F.least(F.lit(k), n))
    first = F.slice(toks, 1, F.greatest(n - k, F.lit(0)))
    return F.concat_ws(" ", F.array_join(last, " "), F.array_join(first, " "))


# T3 / T4 ------------------------------------------------------------------
def event_id(template: Column) -> Column:
    """First 8 hex digits of md5(template)."""
    return F.substring(F.md5(template), 1, 8)


def short_event_id(template: Column) -> Column:
    """T4: the first four decimal digits of md5 read as a 128-bit integer.

    In decimal parts, as 128 bits exceed 38 digits: with the halves h and l and
    2**64 = a * 10**10 + b, the integer over 10**10 is h * a + floor((h * b + l) / 10**10).
    """
    a, b = divmod(1 << 64, 10 ** 10)
    half = lambda at: F.conv(F.substring(F.md5(template), at, 16), 16, 10).cast("decimal(20,0)")
    low = half(1) * F.lit(b).cast("decimal(10,0)") + half(17)
    high = half(1) * F.lit(a).cast("decimal(10,0)") + F.floor(low / F.lit(10 ** 10).cast("decimal(11,0)"))
    return F.substring(high.cast("decimal(38,0)").cast("string"), 1, 4)


# T5 ------------------------------------------------------------------------
def template_regex(template: Column) -> Column:
    """Parameter regex of a template: ``<.{1,5}>`` → wildcard, punctuation escaped,
    blanks → ``\\s+``, wildcard → lazy group, anchored."""
    t = F.regexp_replace(template, r"<.{1,5}>", "<*>")
    t = F.regexp_replace(t, r"([\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E ])", r"\\$1")
    t = F.regexp_replace(t, r"\\ +", r"\\s+")
    t = F.replace(t, F.lit(r"\<\*\>"), F.lit("(.*?)"))
    return F.concat(F.lit("^"), t, F.lit("$"))


def wildcard_count(template: Column) -> Column:
    """Number of ``<*>`` in a template."""
    return F.size(F.split(template, WILDCARD_RX)) - 1


def extract_parameters(content: Column, template: Column) -> Column:
    """T5: values captured by the template's wildcards (``[]`` if none or no match)."""
    norm = F.regexp_replace(template, r"<.{1,5}>", "<*>")
    n = wildcard_count(norm)
    pat = template_regex(template)
    cap = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.call_function("regexp_extract", content, pat, i))
    empty = F.array().cast("array<string>")
    return F.when((n > 0) & F.regexp_like(content, pat), cap).otherwise(empty)


# T6 ------------------------------------------------------------------------
def template_length(template: Column) -> Column:
    """Length of a template without its wildcards and blanks."""
    return F.length(F.regexp_replace(F.replace(template, F.lit(WILDCARD), F.lit("")), r"\s", ""))


# T7 / T8 --------------------------------------------------------------------
def _quote(c: Column) -> Column:
    """Literal regex text inside \\Q...\\E (an embedded \\E is split out)."""
    return F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q"))


def describes(t1: Column, t2: Column) -> Column:
    """t1 split at wildcards, joined by ``.*?``, fully matches t2 (DOTALL)."""
    body = F.replace(_quote(t1), F.lit(WILDCARD), F.lit(r"\E.*?\Q"))
    pat = F.concat(F.lit(r"(?s)^\Q"), body, F.lit(r"\E\z"))
    return F.regexp_like(t2, pat)


def is_abstract(x: Column, y: Column) -> Column:
    """X is at least as general as y: blanks flexible, wildcard → ``(\\S+?)``; null y → false."""
    body = F.regexp_replace(_quote(x), r"\s", r"\\E\\s+\\Q")
    body = F.replace(body, F.lit(WILDCARD), F.lit(r"\E(\S+?)\Q"))
    pat = F.concat(F.lit(r"^\Q"), body, F.lit(r"\E$"))
    return F.when(y.isNull(), F.lit(False)).otherwise(F.coalesce(F.regexp_like(y, pat), F.lit(False)))


# T9 ------------------------------------------------------------------------
def alnum_token_set(template: Column) -> Column:
    return F.array_distinct(F.filter(tokenize(template), lambda x: x.rlike(r"[\p{L}\p{N}]")))


def token_jaccard(t1: Column, t2: Column) -> Column:
    """Jaccard of alphanumeric whitespace tokens, 0 on an empty union."""
    a, b = alnum_token_set(t1), alnum_token_set(t2)
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / u)


# T10 -----------------------------------------------------------------------
def is_param(tok: Column, variant: str) -> Column:
    if variant == "fixed":
        return tok == WILDCARD
    # dynamic parser: a token holding the wildcard and no letter/digit
    return tok.contains(WILDCARD) & ~tok.rlike(r"[\p{L}\p{N}]")


def positional_similarity(template: Column, seq: Column, variant: str = "fixed") -> Column:
    """struct(sim DOUBLE, n_params INT) of two equal-length token arrays.

    ``variant='fixed'``: a bare wildcard is a parameter; ``'dynamic'``: any
    wildcard token without letters/digits.  Parameters never count as equal.
    """
    pairs = F.arrays_zip(template.alias("a"), seq.alias("b"))
    init = F.struct(F.lit(0).alias("eq"), F.lit(0).alias("par"))

    def step(acc, p):
        par = is_param(p["a"], variant)
        return F.struct(
            (acc["eq"] + F.when(~par & (p["a"] == p["b"]), 1).otherwise(0)).alias("eq"),
            (acc["par"] + F.when(par, 1).otherwise(0)).alias("par"))

    agg = F.aggregate(pairs, init, step)
    n = F.size(template)
    return F.struct(F.when(n > 0, agg["eq"] / n).alias("sim"), agg["par"].alias("n_params"))


def cover_similarity(template: Column, seq: Column) -> Column:
    """Branch similarity: equal or wildcard-holding template tokens over length."""
    pairs = F.arrays_zip(template.alias("a"), seq.alias("b"))
    hits = F.aggregate(pairs, F.lit(0),
                       lambda acc, p: acc + F.when((p["a"] == p["b"]) | p["a"].contains(WILDCARD), 1)
                       .otherwise(0))
    return hits / F.size(template)


# T11 -----------------------------------------------------------------------
def generalise(a: Column, b: Column) -> Column:
    """Equal tokens kept, the rest become wildcards."""
    return F.zip_with(a, b, lambda x, y: F.when(x == y, x).otherwise(F.lit(WILDCARD)))


# T12 -----------------------------------------------------------------------
def merge_token_keep_delims(t1: Column, t2: Column) -> Column:
    """Branch merge of two unequal tokens: shared leading/trailing delimiter runs
    (characters of t2 that are delimiters and equal in t1) kept around ``<*>``."""
    delims = F.lit(MERGE_DELIMITERS)
    m = F.least(F.length(t1), F.length(t2))
    idx = F.sequence(F.lit(1), F.greatest(m, F.lit(1)))

    def run(from_end: bool) -> Column:
        def ch(s, i):
            return F.substring(s, -i, 1) if from_end else F.substring(s, i, 1)

        init = F.struct(F.lit(0).alias("n"), F.lit(True).alias("ok"))
        return F.aggregate(
            idx, init,
            lambda acc, i: F.when(
                acc["ok"] & (i <= m) & (F.instr(delims, ch(t2, i)) > 0) & (ch(t1, i) == ch(t2, i)),
                F.struct((acc["n"] + 1).alias("n"), F.lit(True).alias("ok")))
            .otherwise(F.struct(acc["n"].alias("n"), F.lit(False).alias("ok"))),
            lambda acc: acc["n"])

    h, t = run(False), run(True)
    head = F.substring(t2, 1, h)
    tail = F.when(t > 0, F.substring(t2, -t, t)).otherwise(F.lit(""))
    return F.when(t1 == t2, t1).otherwise(F.concat(head, F.lit(WILDCARD), tail))


# T13 -----------------------------------------------------------------------
def dynamic_threshold(n_tokens: Column, constant: float | None = None) -> Column:
    """Similarity threshold by token count (or a constant)."""
    if constant is not None:
        return F.lit(float(constant))
    expr = F.lit(DYNAMIC_THRESHOLD_OTHERS)
    for n in sorted(DYNAMIC_THRESHOLDS, reverse=True):
        expr = F.when(n_tokens == n, F.lit(DYNAMIC_THRESHOLDS[n])).otherwise(expr)
    return expr


# T14 -----------------------------------------------------------------------
def punct_tokens(template: Column) -> Column:
    """Split on blank/punctuation runs (kept), wildcard tokens → ``<*>``, other
    tokens lose punctuation except ``= | ( )``, blanks dropped, wildcard runs collapsed."""
    split_cls = _rx_class(PUNCTUATION).replace("[", r"[\s", 1)
    drop_cls = _rx_class("".join(ch for ch in PUNCTUATION if ch not in PUNCTUATION_KEPT) + " ")
    parts = F.split(F.regexp_replace(template, f"({split_cls}+)", f"{_SEP}$1{_SEP}"), _SEP)
    parts = F.filter(parts, lambda x: x != "")
    parts = F.transform(parts, lambda x: F.when(x.contains(WILDCARD), F.lit(WILDCARD))
                        .otherwise(F.regexp_replace(x, drop_cls, "")))
    parts = F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")),
                     lambda x: x != "")
    return F.filter(parts, lambda x, i: ~((x == WILDCARD) & (i > 0) &
                                          (F.coalesce(F.get(parts, i - 1), F.lit("")) == WILDCARD)))


def punct_similarity(t1: Column, t2: Column) -> Column:
    """|set ∩ set| / (len1 + len2 - |set ∩ set|) over T14 tokens."""
    a, b = punct_tokens(t1), punct_tokens(t2)
    inter = F.size(F.array_intersect(a, b))
    return inter / (F.size(a) + F.size(b) - inter)


# T15 / T16 ------------------------------------------------------------------
def wildcard_equal(truth: Column, parsed: Column) -> Column:
    """Truth tokens holding a wildcard become ``<*>``; then token lists equal."""
    t = F.transform(F.split(truth, " "), lambda x: F.when(x.contains(WILDCARD), F.lit(WILDCARD)).otherwise(x))
    return t == F.split(parsed, " ")


def strip_quotes(template: Column) -> Column:
    """Remove commas, single and double quotes."""
    return F.translate(template, ",'\"", "")


# P1-P8 ----------------------------------------------------------------------
def has_digit(c: Column) -> Column:
    return c.rlike(r"\d")


def has_alnum(c: Column) -> Column:
    return c.rlike(r"[\p{L}\p{N}]")


def valid_value(c: Column) -> Column:
    return c.isNotNull() & (c != "NONE")


def first_constant(tokens: Column) -> Column:
    """First token without a wildcard (NULL if none)."""
    return F.get(F.filter(tokens, lambda x: ~x.contains(WILDCARD)), 0)
