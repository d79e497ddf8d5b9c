"""The pipeline's stages against brute force, stage by stage, and the SQL oracles."""

from collections import Counter

import duckdb
import pytest
from reference import base_counts, check_packing, components, luhn, pieces, without_frequent_lines
from test_token_operators import BYTE, ENCODE

import corpus_pipeline
from conftest import SF_SMALL
from rows import edge_docs, edge_rows, no_docs, small_rows  # noqa: F401
from logweave.llm.queries import LLM_ORACLES, LLM_QUERIES
from test_queries import _rows


def test_stages(spark, edge_docs, no_docs, tmp_path):
    for name, docs in (("small", spark.read.parquet(f"{SF_SMALL}/documents.parquet")), ("edge", edge_docs), ("none", no_docs)):
        for k, (stage, step) in enumerate(corpus_pipeline.STAGES):
            before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
            out = step(spark, docs, SF_SMALL)
            if k < 4:
                assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / f"{name}-{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}-{k}"))
            after = docs.collect()
            if stage == "quality_rules":
                passed = Counter(i for i, t, _ in before if not base_counts(t)[5])
                assert not Counter(r.doc_id for r in after) - passed
            elif stage == "line_dedup":
                exp = without_frequent_lines([(i, s, t) for i, t, s in before], 0.1, 5)
                assert Counter((r.doc_id, r.text) for r in after) == Counter({k: n for k, n in _texts(exp).items()})
            elif stage == "ngram_jaccard_join":
                least = components([b[:2] for b in before], 5, 80)
                assert {r.doc_id for r in after if r.doc_id is not None} == {c for _, _, c in least if c is not None}
            elif stage == "pii_pseudonyms":
                assert [r.doc_id for r in sorted(after, key=str)] is not None and len(after) == len(before)
            else:
                assert Counter(tuple(r)[:5] for r in after) == pieces([b[:2] for b in before], ENCODE[BYTE], 2048)
                check_packing([(r.length, r.sequence_id, r.offset) for r in after], 2048)


def _texts(rows):
    out = Counter()
    for (i, text, _, _), n in rows.items():
        out[i, text] += n
    return out


def test_run_is_the_stages_one_after_another(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, SF_SMALL).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    got = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(tuple(r)[:5] for r in docs.collect())
    check_packing([(r.length, r.sequence_id, r.offset) for r in got], 2048)
    assert luhn("4111111111111111")


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    assert _rows(LLM_QUERIES[name](spark, SF_SMALL).toPandas()) == _rows(con.execute(LLM_ORACLES[name]).fetchdf())
