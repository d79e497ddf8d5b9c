"""Metrics: hand-derived expected values on the derived log, and a Python fold."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from logweave.operators.metrics import contingency, quality
from logweave.plans.common import masked_log


def _pairs(spark, sf):
    m = masked_log(spark, sf)
    return m.select("line_id", F.col("truth_template").alias("truth"), F.col("template").alias("parsed"))


def test_expected_values_on_derived_log(spark):
    q = quality(contingency(_pairs(spark, SF_MID))).first()
    assert q["ga"] == 0.7983 and q["pa"] == 0.7983
    assert q["pga"] == round(4 / 7, 6) and q["rga"] == 0.8 and q["fga"] == round(2 / 3, 6)
    assert q["pta"] == round(4 / 7, 6) and q["rta"] == 0.8 and q["fta"] == round(2 / 3, 6)
    assert q["identified_templates"] == 7 and q["ground_templates"] == 5


def test_ga_against_python_fold(spark):
    rows = _pairs(spark, SF_SMALL).collect()
    nt, npar, pair = Counter(), Counter(), Counter()
    for r in rows:
        nt[r["truth"]] += 1
        npar[r["parsed"]] += 1
        pair[(r["truth"], r["parsed"])] += 1
    by_truth = defaultdict(list)
    for (t, p), n in pair.items():
        by_truth[t].append((p, n))
    right = sum(n for t, ps in by_truth.items() if len(ps) == 1 for p, n in ps if n == npar[p])
    q = quality(contingency(_pairs(spark, SF_SMALL))).first()
    assert q["ga"] == round(right / len(rows), 6)
