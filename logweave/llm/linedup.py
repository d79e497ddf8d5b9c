"""Site-relative line frequency (operator 9), as DataFrame expressions.

Rows are grouped by host.  A line's frequency is the number of the host's distinct
pages that contain it over the number of the host's distinct pages (exact copies
are one page); lines at or above ``RATIO``, on at least ``MIN_PAGES`` pages, are
boilerplate of that host and are dropped from all its pages.  Lines count once per
page, without white space around them; lines of white space alone are never dropped.

The count moves two 64-bit hashes per line, summed before and between two shuffles
(by line and page, then by line), so a line or host with a third of all rows is one
row per task.  A host has at most (lines per page) / RATIO boilerplate lines; their
hashes are written as a table and joined to the pages by host: broadcast if the
table is within the session's byte limit, otherwise a shuffle whose hot hosts
adaptive execution splits.

Defined cases: a null host is a host of its own; a null text stays null and has no
lines; a page may become empty but is kept; repeated rows are cleaned alike; an
empty table gives an empty result; all columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import free_name, shared_folder
from logweave.llm.quality import with_text

RATIO = 0.1
MIN_PAGES = 5


def url_host(url: Column) -> Column:
    """Host of a URL in lower case (null where there is none)."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def key(line: Column) -> Column:
    """128 bits that stand for a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def frequent_lines(df: DataFrame, host: Column, text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line key, pages, host_pages) of the boilerplate lines."""
    d = df.select(host.alias("host"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    page = key(F.col("text"))
    totals = d.select("host", page.alias("page")).groupBy("host").agg(F.count_distinct("page").alias("host_pages"))
    lines = F.array_distinct(F.filter(F.transform(F.split("text", "\n", -1), trimmed), lambda s: s != ""))
    rows = d.select("host", page.alias("page"), F.explode(F.transform(lines, key)).alias("line"))
    pages = rows.groupBy("host", "line").agg(F.count_distinct("page").alias("pages")).where(F.col("pages") >= min_pages)
    return (pages.alias("p").join(totals.alias("t"), F.expr("p.host <=> t.host"))
            .select("p.host", "line", "pages", "host_pages").where(F.col("pages") >= F.col("host_pages") * ratio))


def lines_of_hosts(df: DataFrame, host: Column, text_col: str, ratio: float, min_pages: int) -> DataFrame:
    """(host, lines): the keys of each host's boilerplate lines, as a written table of known size."""
    spark = df.sparkSession
    folder = shared_folder(spark, "frequent-lines")
    found = frequent_lines(df, host, text_col, ratio, min_pages)
    found.groupBy("host").agg(F.collect_list("line").alias("lines")).write.parquet(folder)
    return spark.read.parquet(folder)


def marked(df: DataFrame, host: Column, text_col: str, ratio: float, min_pages: int) -> tuple[DataFrame, str]:
    """``df`` with a struct column (its name follows): cleaned text, lines, dropped lines."""
    h, out = free_name(df.columns, "_host"), free_name(df.columns, "_lines")
    bad = lines_of_hosts(df, host, text_col, ratio, min_pages).select(F.col("host").alias(h), F.col("lines").alias(out))
    d = df.join(bad, host.eqNullSafe(bad[h]), "left").drop(h)
    text = F.col(text_col).cast("string")
    lines = F.split(text, "\n", -1)
    left = F.filter(lines, lambda s: ~F.array_contains(F.col(out), key(trimmed(s))))
    # one pass over the lines of pages whose host has boilerplate, none over the others
    kept = F.when(F.col(out).isNotNull() & text.isNotNull(), left).otherwise(lines)
    made = F.transform(F.array(kept), lambda k: F.struct(
        F.array_join(k, "\n").alias("text"), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(lines) - F.size(k), F.lit(0)).cast("long").alias("n_dropped")))[0]
    return d.withColumn(out, made), out


def line_shares(df: DataFrame, host: Column, id_col: str = "doc_id", text_col: str = "text", ratio: float = RATIO,
                min_pages: int = MIN_PAGES) -> DataFrame:
    """(id, text, n_lines, n_dropped): every page without its host's boilerplate lines."""
    site = free_name([id_col, text_col], "_site")
    d, m = marked(df.select(F.col(id_col), F.col(text_col), host.alias(site)), F.col(site), text_col, ratio, min_pages)
    return d.select(id_col, F.col(m)["text"].alias("text"), F.col(m)["n_lines"].alias("n_lines"), F.col(m)["n_dropped"].alias("n_dropped"))


def drop_frequent_lines(df: DataFrame, host: Column, text_col: str = "text", length_col: str | None = "n_chars",
                        ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """All rows and columns of ``df``, boilerplate lines dropped from the text."""
    d, m = marked(df, host, text_col, ratio, min_pages)
    return with_text(d, df.columns, text_col, F.col(m)["text"], length_col)
