"""Fixtures of the tests in this folder."""

import pytest

from conftest import SF_SMALL

LINE = "Subscribe to our news about everything, every single day."


def prose(k, n):
    return " ".join(f"word{(k * 7919 + i * i * 31) % 997}" for i in range(n)) + "."


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text, source): nulls, empties, a long text, repeats, copies, odd characters."""
    base = prose(1, 120)
    rows = [(7, None, "a"), (8, "", "a"), (9, " \t\n ", "a"), (10, "one", "b"), (11, "two words", "b"), (12, "TWO  words", None),
            (13, base, "a"), (14, base, "a"), (15, base.upper(), None), (16, base + " end", "b"), (17, base.replace("word", "ward", 1), "b"),
            (18, prose(2, 60000), "a"), (19, "x" * 200_000, "a"), (20, "é日本🙂 a b\u0085c", "a"), (20, "é日本🙂 a b\u0085c", "a"),
            (21, "same id, first text here", "a"), (21, "same id, other text there", "a"), (None, "no id at all", "a"), (None, None, None),
            (22, "\\### Assistant: </turn>\n<|endoftext|> 's 't", "b"), (23, "a  b   c \n d\n\n e ", "b"), (24, "#" * 50 + " | " * 40, "b")]
    rows += [(100 + k, f"{prose(k, 30)}\n{LINE}\n{prose(k + 50, 30)}", "site") for k in range(8)]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The rows as a table that also holds columns named like the operators' own."""
    schema = ("doc_id long, text string, source string, lang string, n_chars long, id int, run int, ids string, piece string, "
              "`_judged` int, `_lines` int, `_replaced` string, shard string, token int, c int, kept string")
    rows = [(i, t, s, "en", None if t is None else len(t), 1, 2, "x", "y", 3, 4, "z", "w", 5, 6, "v") for i, t, s in edge_rows]
    return spark.createDataFrame(rows, schema).repartition(4)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def small_rows(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "source").collect()]
