"""Structured Streaming forms of the online operators.

* G1 stream split + mask: stateless projection on the file stream.
* G2 stream mining: clustering in line order within a batch, batches in order of arrival;
  clusters and branches as of each batch are a table of their own version, read by the
  next.  Emits (line_id, template as of the batch); work follows the batch and the clusters,
  not the lines seen.
* G3 online n-gram: ``foreachBatch`` adds the batch's gram counts to the counts as of the
  batch before, written as a new version, and scores the batch against it.
* G4 warm-up masks: seen mask types and the number of lines so far are carried from
  batch to batch until the warm-up is full; later lines run the pruned chain.
* G5 stream–static template match: ``foreachBatch`` runs the M3 match join of
  the batch against the static template table.

Every sink write is keyed by batch id (overwrite of that batch's folder), so a
replayed batch after a failure rewrites, never duplicates.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.masks import MASK_ORDER, detect_mask_types, mask_types
from logweave.functions.tokens import tokenize
from logweave.operators import ngram as N
from logweave.operators.greedy import mine_batch
from logweave.operators.matching import key_kinds, match_prepared, prepare_templates
from logweave.session import checkpoint_dir
from logweave.sources.logformat import split_format
from logweave.sources.tables import LOG_LINES_FORMAT, LOG_LINES_SQL


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one streaming run inside the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"stream-{name}-{uuid.uuid4().hex[:12]}")


def _is_dir(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def event_stream(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """File stream over one given table (schema taken from the table itself), one
    file per micro-batch; a table written as a folder of part files streams them."""
    path = os.path.join(sf_dir, f"{table}.parquet")
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    if _is_dir(spark, path):
        return r.parquet(path)
    return r.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def stream_log_lines(events: DataFrame) -> DataFrame:
    """The derived log view over a stream (a stateless projection)."""
    return events.sparkSession.sql(LOG_LINES_SQL.replace("FROM events", "FROM {events}"), events=events)


def _drain(query, out: str, spark: SparkSession) -> DataFrame:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return spark.read.parquet(out)


def stream_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: split + mask chain + tokens on the stream; returns the drained sink."""
    base = run_dir(spark, "mask")
    lines = split_format(stream_log_lines(event_stream(spark, sf_dir)), LOG_LINES_FORMAT,
                         keep=("line_id", "truth_template"))
    out = lines.select("line_id", F.col("Content").alias("content"),
                       F.array_join(tokenize(mask_types(F.col("Content"))), " ").alias("template"))
    q = (out.writeStream.format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    return _drain(q, f"{base}/out", spark)


def _batch_writer(base: str, fn):
    def write(batch: DataFrame, batch_id: int) -> None:
        fn(batch, batch_id).write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")
    return write


def stream_match(spark: SparkSession, sf_dir: str, templates: DataFrame) -> DataFrame:
    """stream–static template match per micro-batch; the templates are prepared once."""
    base = run_dir(spark, "match")
    lines = split_format(stream_log_lines(event_stream(spark, sf_dir)), LOG_LINES_FORMAT, keep=("line_id",))
    lines = lines.select("line_id", F.col("Content").alias("content"))
    prepared = prepare_templates(templates)
    kinds = key_kinds(prepared)
    q = (lines.writeStream.foreachBatch(_batch_writer(base, lambda b, _i: match_prepared(b, prepared, kinds)))
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    return _drain(q, f"{base}/out", spark).drop("batch")


def stream_mine(spark: SparkSession, sf_dir: str, depth: int = 4, st: float = 0.4, max_child: int = 100) -> DataFrame:
    """Streaming fixed-depth mining; clusters and branches as of the last batch are carried on."""
    base = run_dir(spark, "mine")
    lines = split_format(stream_log_lines(event_stream(spark, sf_dir)), LOG_LINES_FORMAT, keep=("line_id",))
    toks = lines.select("line_id", tokenize(mask_types(F.col("Content"))).alias("tokens"))

    def process(batch: DataFrame, batch_id: int) -> DataFrame:
        s = batch.sparkSession
        state = lambda name, i: f"{base}/{name}/v{i}"
        known = {k: s.read.parquet(state(k, batch_id - 1)) for k in ("templates", "branches")} if batch_id else None
        mined, after = mine_batch(batch, F.col("tokens"), "line_id", depth, st, max_child, known, batch_id)
        for k in ("templates", "branches"):
            after[k].write.mode("overwrite").parquet(state(k, batch_id))
        return mined.select("line_id", "event_template")

    q = (toks.writeStream.foreachBatch(_batch_writer(base, process))
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    return _drain(q, f"{base}/out", spark).drop("batch")


def stream_ngram(spark: SparkSession, sf_dir: str, threshold: float = N.DEFAULT_THRESHOLD) -> DataFrame:
    """Online n-gram — the batch's counts are added to the table of all grams so far (one row a
    gram), and the batch is scored against it."""
    base = run_dir(spark, "ngram")
    lines = split_format(stream_log_lines(event_stream(spark, sf_dir)), LOG_LINES_FORMAT, keep=("line_id",))
    keys = {"uni": (["w"], "c1"), "bi": (["w1", "w2"], "c2"), "tri": (["w1", "w2", "w3"], "c3")}

    def process(batch: DataFrame, batch_id: int) -> DataFrame:
        s = batch.sparkSession
        tok = N.ngram_tokens(batch, "Content", masker=lambda c: mask_types(c))
        msgs = N.messages(tok)
        ex = N.exploded_grams(msgs)
        sums = []
        for (name, (cols, count)), d in zip(keys.items(), N.gram_counts(ex), strict=True):
            if batch_id:
                before = s.read.parquet(f"{base}/counts/{name}/v{batch_id - 1}")
                d = before.unionByName(d.select(*before.columns)).groupBy(*cols).agg(F.sum(count).alias(count))
            d.write.mode("overwrite").parquet(f"{base}/counts/{name}/v{batch_id}")
            sums.append(s.read.parquet(f"{base}/counts/{name}/v{batch_id}"))
        fbi, ftri = N.gram_ratios(*sums)
        flags = N.fold_dynamic(N.score_positions(ex, fbi, ftri), threshold)
        m = msgs.join(flags, "msg_key", "left").select(
            "tokens", N.apply_flags(F.col("tokens"), F.col("dyn")).alias("event_template"))
        return tok.select("line_id", "tokens").join(m, "tokens").select("line_id", "event_template")

    q = (lines.writeStream.foreachBatch(_batch_writer(base, process))
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    return _drain(q, f"{base}/out", spark).drop("batch")


def stream_estimate_masks(spark: SparkSession, sf_dir: str, warmup: int = 2000) -> DataFrame:
    """Mask types seen in the first ``warmup`` lines (in arrival order, over as many
    batches as these take); warm-up lines run the full chain, later ones the pruned chain."""
    base = run_dir(spark, "estimate")
    lines = split_format(stream_log_lines(event_stream(spark, sf_dir)), LOG_LINES_FORMAT, keep=("line_id",))
    lines = lines.select("line_id", F.col("Content").alias("content"))

    def process(batch: DataFrame, batch_id: int) -> DataFrame:
        s = batch.sparkSession
        seen, n = set(), 0
        if batch_id:
            before = s.read.parquet(f"{base}/types/v{batch_id - 1}").first()
            seen, n = set(before["types"]), before["n"]
        cut = None
        if n < warmup:
            det = detect_mask_types(batch.orderBy("line_id").limit(warmup - n), "content")
            row = det.agg(F.array_distinct(F.flatten(F.collect_list("matched_types"))).alias("t"),
                          F.max("line_id").alias("cut"), F.count(F.lit(1)).alias("n")).first()
            seen, n, cut = seen | set(row["t"] or []), n + row["n"], row["cut"]
        types = [t for t in MASK_ORDER if t in seen]
        s.createDataFrame([(types, n)], "types array<string>, n long").write.mode("overwrite").parquet(f"{base}/types/v{batch_id}")
        full, pruned = mask_types(F.col("content")), mask_types(F.col("content"), types)
        masked = pruned if cut is None else full if n < warmup else F.when(F.col("line_id") <= cut, full).otherwise(pruned)
        return batch.select("line_id", masked.alias("masked"))

    q = (lines.writeStream.foreachBatch(_batch_writer(base, process))
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    return _drain(q, f"{base}/out", spark).drop("batch")
