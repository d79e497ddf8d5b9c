"""Queries that match the log with its own templates parse it once."""

import pytest

from conftest import SF_SMALL
from logweave.plans import all_queries, common


@pytest.mark.parametrize("name", ["template_diff", "line_restrict", "parameters_matched"])
def test_events_are_read_once(spark, name):
    """What is left to run reads the parsed log, not the events again."""
    files = all_queries()[0][name](spark, SF_SMALL).inputFiles()
    assert files and not any(f.rstrip("/").endswith("events.parquet") for f in files)


@pytest.mark.parametrize("name", ["token_jaccard", "abstract_pairs", "unify_ids"])
def test_documents_are_masked_once(spark, name):
    files = all_queries()[0][name](spark, SF_SMALL).inputFiles()
    assert files and not any(f.rstrip("/").endswith("documents.parquet") for f in files)


@pytest.mark.parametrize("name", ["metric_minmax", "split_agreement"])
def test_log_is_split_once(spark, monkeypatch, name):
    """Parsers and miners that are compared share the split lines."""
    calls, split = [], common.split_format
    monkeypatch.setattr(common, "split_format", lambda *a, **k: calls.append(1) or split(*a, **k))
    assert all_queries()[0][name](spark, SF_SMALL).count() > 0
    assert len(calls) == 1
