"""Quartile bucket digests of documents (operator 1).

Every byte triplet of a text is hashed into one of ``BUCKETS`` counters.  The digest
holds, in hexadecimal: the length on a scale of ten-percent steps, two ratios of the
counts' quartiles, and for each bucket whether its count lies in the first, second,
third or last quarter of the counts (two bits).  Digests of equal texts are equal.
Two digests are compared by a difference score: steps between quarters (opposite
quarters count double), plus steps of length and ratios, bounded by the score that
independent digests would have; likeness = 1 - score / bound, from 0 to 1.

Defined cases: a null text is an empty one; texts under three bytes have no triplets
(all buckets in the first quarter); null ids come first in document order; rows of
equal ids follow each other ordered by text; a single document is its own next one;
an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.llm.common import id_type, n_shuffle, range_cuts, run_of, ship_package

BUCKETS = 512
BLOCK = 1 << 18  # triplets hashed at once: memory does not grow with the text
STEP = math.log(1.1)
#: Score of a bucket at each distance between quarters.
DISTANCE = np.array([0, 1, 2, 6])
#: Mean bucket score of independent digests: distances 1, 2 and 3 have 6, 4 and 2 of 16 chances.
UNRELATED = (6 * 1 + 4 * 2 + 2 * 6) / 16
RATIO_STEPS = 16


def triplet_counts(data: bytes, buckets: int = BUCKETS) -> np.ndarray:
    a, counts = np.frombuffer(data, np.uint8), np.zeros(buckets, np.int64)
    shift = np.uint32(33 - buckets.bit_length())
    for at in range(0, max(0, len(a) - 2), BLOCK):
        x = a[at:at + BLOCK + 2].astype(np.uint32)
        h = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA6B) + x[2:] * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        counts += np.bincount(h >> shift, minlength=buckets)
    return counts


def digest(text: str | None, buckets: int = BUCKETS) -> str:
    """Hexadecimal digest: length step (2 bytes), two ratios (1 byte), quarters (2 bits a bucket)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    counts = triplet_counts(data, buckets)
    marks = [buckets // 4 - 1, buckets // 2 - 1, 3 * buckets // 4 - 1]
    q1, q2, q3 = np.partition(counts, marks)[marks]
    quarter = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    length = min(0xFFFF, round(math.log1p(len(data)) / STEP))
    ratios = (min(RATIO_STEPS - 1, int(q1 * RATIO_STEPS // max(q3, 1))) << 4) | min(RATIO_STEPS - 1, int(q2 * RATIO_STEPS // max(q3, 1)))
    pairs = quarter.reshape(-1, 4)
    body = pairs[:, 0] << 6 | pairs[:, 1] << 4 | pairs[:, 2] << 2 | pairs[:, 3]
    return length.to_bytes(2, "big").hex() + bytes([ratios]).hex() + body.astype(np.uint8).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """1 for equal digests down to 0 for digests as different as independent ones."""
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    if len(x) != len(y):
        raise ValueError("digests of different bucket counts")
    p, q = np.frombuffer(x, np.uint8, offset=3), np.frombuffer(y, np.uint8, offset=3)
    buckets = 4 * len(p)
    score = 0
    for shift in (0, 2, 4, 6):
        far = np.abs((p >> shift & 3).astype(np.int8) - (q >> shift & 3).astype(np.int8))
        score += int(DISTANCE[far].sum())
    steps = (abs(int.from_bytes(x[:2], "big") - int.from_bytes(y[:2], "big"))
             + abs((x[2] >> 4) - (y[2] >> 4)) + abs((x[2] & 15) - (y[2] & 15)))
    bound = UNRELATED * buckets
    return 1.0 - min(score + steps * buckets / 256, bound) / bound


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(id, fingerprint) of every whole text."""
    ship_package(df.sparkSession)
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", id_type(df, id_col)), T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([digest(t.as_py(), buckets) for t in b.column(1)], pa.string())],
                                             ["id", "fingerprint"])

    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def fingerprint_likeness(df: DataFrame, a_col: str, b_col: str, out: str = "likeness") -> DataFrame:
    """Adds the likeness of two digest columns (null where either is null)."""
    ship_package(df.sparkSession)

    @F.pandas_udf(T.DoubleType())
    def like(a, b):
        import pandas as pd

        return pd.Series([None if x is None or y is None else likeness(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return df.withColumn(out, like(F.col(a_col), F.col(b_col)))


def with_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Each document against an edited copy of itself and against the next document.

    The edited text has its last half replaced by as many leading characters of the
    next document in ascending id order (after the last: the first).  Whole texts
    move once, into runs of the id range; the first id of a run is also sent to the
    end of the run before, so no run needs another.  Runs stream through Python one
    row ahead.
    """
    spark = df.sparkSession
    ship_package(spark)
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    cuts = range_cuts(src, "id", n_shuffle(spark))
    first = src.agg(F.min("id").alias("low"), F.max(F.col("id").isNull()).alias("nulls")).first()
    runs = len(cuts) + 1
    run, is_first = run_of(F.col("id"), cuts), F.col("id").isNull() if first.nulls else F.col("id") == F.lit(first.low)
    copy = lambda r, ahead: F.struct(r.cast("int").alias("run"), F.lit(ahead).alias("ahead"))
    copies = F.array(copy(run, 0), F.when(F.col("id").isin(cuts), copy(run - 1, 1)), F.when(is_first, copy(F.lit(runs - 1), 1)))
    placed = src.select(F.explode(F.filter(copies, lambda c: c.isNotNull())).alias("at"), "id", "text").select("at.run", "at.ahead", "id", "text")
    placed = placed.repartitionById(runs, F.col("run")).sortWithinPartitions("run", "ahead", F.col("id").asc_nulls_first(), "text")
    schema = T.StructType([T.StructField("id", id_type(df, id_col)), T.StructField("n_chars", T.LongType())]
                          + [T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
                          + [T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_arrow, held, out = None, None, []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], schema.names)

        for b in batches:
            id_arrow = b.schema.field(2).type
            types = [id_arrow, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            for at, ahead, doc, text in zip(*b.columns, strict=True):
                text = text.as_py() or ""
                mark = digest(text, buckets)
                if held and held[0] == at.as_py():
                    _, before, old, old_mark = held
                    half = len(old) // 2
                    edited = old[:len(old) - half] + text[:half]
                    edited_mark = digest(edited, buckets)
                    out.append((before, len(old), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), old_mark,
                                edited_mark, likeness(old_mark, edited_mark), likeness(old_mark, mark)))
                    if len(out) == 2000:
                        yield flush()
                        out.clear()
                held = None if ahead.as_py() else (at.as_py(), doc.as_py(), text, mark)
        if out:
            yield flush()

    return placed.mapInArrow(stream, schema).withColumnRenamed("id", id_col)
