"""SimHash near-duplicates by a join of segment popcounts (operator 12).

A fingerprint bit is 1 where more than half of a text's shingle hashes have it.  Two
documents link at ``bits`` or fewer differing bits; components of links are exact.

* Embedding.  A fingerprint is mapped to the bit counts of its 16 segments of four bits.
  One differing bit moves one count by one, so the Manhattan distance of two such points
  is a lower bound of the number of differing bits.
* Grid range join.  Points at a distance of at most 2 have a point between them at a
  distance of at most 1 from both.  Each distinct fingerprint is therefore listed in the
  unit cells within distance 1 of its point, at most 33, and partners meet in a shared cell.
* Verification.  In cells of up to ``CELL_ROWS`` fingerprints partners meet in a join whose
  condition counts the differing bits, so that links come out of it, not pairs.  In fuller
  cells each member is listed by the fingerprints that its step into the cell can stand
  for (itself, or one bit of the changed segment turned): members of such a list differ in
  at most two bits from each other, so all are linked to the least of them.  This is as
  exact and linear in the rows; a group of copies is never expanded into pairs.
* Components follow from minimum labels with shortcuts over distinct fingerprints.

Defined cases: null and empty texts and texts without words have fingerprint zero, which
links like any other; texts of fewer words than a shingle are one shingle; a component's
id is its least document id (a null id is never the least unless all are null); repeated
rows and ids share their fingerprint's component; other columns are not read; an empty
table gives an empty result.  One document's shingle hashes must fit in a task's batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.llm.common import cut, id_type, ship_package
from logweave.llm.ngramjoin import components

SEED = 42
SEGMENTS = 16
#: Cells with more fingerprints are verified by shared neighbours instead of a join.
CELL_ROWS = 64
#: Shingles whose hashes are counted at a time.
HASH_BLOCK = 1 << 14


def text_fingerprint(text: str | None, n: int) -> int:
    """Majority bits of the XXH64 hashes of all n-word shingles (ASCII letters lower-cased)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    plain = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(n, len(words))
    spans = list(zip(starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist(), strict=True))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(spans), HASH_BLOCK):
        h = np.array([xxhash.xxh64_intdigest(plain[a:b], SEED) for a, b in spans[k:k + HASH_BLOCK]], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(spans), bitorder="little").view("<u8")[0])


def simhashes(df: DataFrame, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, f): the fingerprint of every row as a signed 64-bit number."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([text_fingerprint(t.as_py(), n) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f)], ["id", "f"])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, T.StructType([T.StructField("id", id_type(src, "id")), T.StructField("f", T.LongType())]))


def segment_counts(f: Column) -> Column:
    """The bit counts of the 16 segments, each in four bits of one number."""
    fives, threes = F.lit(0x5555555555555555), F.lit(0x3333333333333333)
    low, high = f.bitwiseAND(fives), F.shiftrightunsigned(f, 1).bitwiseAND(fives)
    twos = low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))  # without a carry into the sign
    return twos.bitwiseAND(threes) + F.shiftrightunsigned(twos, 2).bitwiseAND(threes)


def cells(prints: DataFrame) -> DataFrame:
    """(cell, f, step): unit cells within Manhattan distance 1 of each fingerprint's point.

    ``step`` is 0 at home, else the number from 1 of the segment whose count the cell
    changes, negative where the cell has one less.
    """
    at = F.col("at")

    def moved(k: int, sign: int) -> Column:
        count = F.shiftrightunsigned(at, 4 * k).bitwiseAND(F.lit(15))
        cell = F.struct((at + F.lit(sign << 4 * k).cast("long")).alias("cell"), F.lit(sign * (k + 1)).alias("step"))
        return F.when(count < 4 if sign > 0 else count > 0, cell)

    near = [F.struct(at.alias("cell"), F.lit(0).alias("step")), *[moved(k, sign) for k in range(SEGMENTS) for sign in (1, -1)]]
    spread = prints.select("f", segment_counts(F.col("f")).alias("at")).select("f", F.explode(F.array(*near)).alias("x"))
    return spread.where("x IS NOT NULL").select("x.cell", "f", "x.step")


def shared_neighbours(rows: DataFrame) -> DataFrame:
    """Links (u, v) among cell rows (f, step) by the fingerprints that a step can stand for."""
    def turned(b: int) -> Column:
        mask = F.expr(f"shiftleft(1L, 4 * (abs(step) - 1) + {b})")
        zero = F.col("f").bitwiseAND(mask) == 0
        return F.when(zero == (F.col("step") > 0), F.col("f").bitwiseXOR(mask))

    points = F.when(F.col("step") == 0, F.array("f")).otherwise(F.array(*[turned(b) for b in range(4)]))
    listed = rows.select("f", F.explode(points).alias("point")).where("point IS NOT NULL")
    hubs = listed.groupBy("point").agg(F.min("f").alias("hub"), F.max("f").alias("top")).where("hub < top").select("point", "hub")
    return listed.join(hubs, "point").where("f > hub").select(F.col("hub").alias("u"), F.col("f").alias("v"))


def near_prints(prints: DataFrame) -> DataFrame:
    """Links (u, v) of distinct fingerprints ``f``, enough to connect all that differ in at most 2 bits."""
    listed = cells(prints)
    counts = listed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    met = cut(listed.join(counts, "cell"))
    few = met.where(F.col("rows") <= CELL_ROWS)
    pairs = few.select("cell", F.col("f").alias("u")).join(few.select("cell", F.col("f").alias("v")), "cell")
    pairs = pairs.where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2)).select("u", "v")
    return cut(pairs.union(shared_neighbours(met.where(F.col("rows") > CELL_ROWS))).distinct())


def simhash_components(df: DataFrame, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id): components of documents whose fingerprints differ in at most 2 bits."""
    base = cut(simhashes(df, n, id_col, text_col))
    lowest = cut(base.groupBy("f").agg(F.min("id").alias("low")))
    labels = components(near_prints(lowest.select("f")))
    part = lowest.join(labels, F.col("f") == F.col("node"), "left").select("f", "low", F.coalesce("label", "f").alias("label"))
    least = part.groupBy("label").agg(F.min("low").alias("component_id"))
    out = base.join(part.join(least, "label").select("f", "component_id"), "f")
    shown = F.lower(F.lpad(F.hex("f"), 16, "0"))
    return out.select(F.col("id").alias(id_col), shown.alias("fingerprint"), "component_id")
