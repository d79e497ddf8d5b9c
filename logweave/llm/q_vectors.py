"""Queries of the operators on periodic runs, SimHash near-duplicates and embeddings (11, 12, 13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import WORD, table
from logweave.llm.periodic import periodic_runs
from logweave.llm.registry import register
from logweave.llm.simhash import simhash_components
from logweave.llm.whitening import whitened


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by the hash of their id, get a periodic end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD), F.lit(0))
    d = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words"))
    n = F.size("words")
    d = d.withColumn("a", F.when(n > 0, (F.col("g") % n).cast("int")))
    d = d.withColumn("p", F.when(n > 0, (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int")))
    head, root = F.slice("words", 1, F.col("a")), F.slice("words", F.col("a") + 1, F.col("p"))
    # the root as often as fits, and its start
    times, rest = F.floor((n - F.col("a")) / F.col("p")).cast("int"), ((n - F.col("a")) % F.col("p")).cast("int")
    edited = F.concat(head, F.flatten(F.array_repeat(root, times)), F.slice(root, 1, rest))
    return d.select("doc_id", F.when(n > 0, F.array_join(edited, " ")).otherwise(F.col("text")).alias("text"))


@register("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least four periods and six words of all documents, with and without planted periods."""
    found = periodic_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    # the greatest exact exponent: compare by cross products
    best = F.aggregate("runs", F.get("runs", 0), lambda x, y: F.when(y["length"] * x["period"] > x["length"] * y["period"], y).otherwise(x))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                       F.sha2(F.array_join(listed, "").cast("binary"), 256).alias("runs_sha256"),
                       F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                      F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@register("op12_simhash")
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose fingerprints of 3-word shingles differ in at most two bits."""
    return simhash_components(table(spark, sf_dir, "documents"), n=3)


@register("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the 32 leading components of their covariance, scaled to unit variance."""
    return whitened(table(spark, sf_dir, "embeddings"), count=32)
