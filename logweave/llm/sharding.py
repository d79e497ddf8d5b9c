"""Hilbert-curve ordering and equal runs (operator 4), as DataFrame expressions.

Several metadata columns are quantised to cells of about equal row counts (numbers
by a quantile sketch over all rows, texts by counts of whole values), the cell
coordinates give the index on a Hilbert curve, and the rows in curve order are cut
into runs of equal row counts, at most one apart.  Rows near in all dimensions land
in the same shard, so files written by shard carry narrow value ranges and readers
prune on any of the dimensions.

The exact rank of a row is its rank within its cell (salted two-level ranks, so a
cell with a third of all rows is spread) plus the counts of the cells before, at
most 2 ** (dimensions x bits) numbers.

Defined cases: nulls take the lowest cell; rows of equal ids and equal rows get
different ranks; fewer rows than shards leave shards empty; an empty table gives an
empty result; other columns are neither read nor kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.llm.common import cut, let, ranked
from logweave.operators.matching import running_total

BITS = 4


def curve_steps(dims: int) -> tuple[list[int], list[int]]:
    """By state and corner: the corner's place along the curve, and the state within it.

    A state is the entry corner and the direction of the curve in a cell; corners are
    numbered by the Gray code, and each sub-cell turns entry and direction.
    """
    size = 1 << dims

    def turn(v: int, k: int) -> int:  # rotate left within ``dims`` bits
        k %= dims
        return (v << k | v >> (dims - k)) & (size - 1)

    gray = [i ^ i >> 1 for i in range(size)]
    place = {g: i for i, g in enumerate(gray)}
    entry = [0] + [gray[2 * ((i - 1) // 2)] for i in range(1, size)]
    low_ones = lambda i: ((i ^ (i + 1)).bit_length() - 1) % dims  # noqa: E731  trailing set bits
    direction = [0] + [low_ones(i if i % 2 else i - 1) for i in range(1, size)]
    places, states = [], []
    for state in range(size * dims):
        e, d = divmod(state, dims)
        for corner in range(size):
            w = place[turn(corner ^ e, -(d + 1))]
            places.append(w)
            states.append((e ^ turn(entry[w], d + 1)) * dims + (d + direction[w] + 1) % dims)
    return places, states


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Index on the curve of integer coordinates of ``bits`` bits each (bits x dims up to 50)."""
    dims, size = len(cells), 1 << len(cells)
    places, states = curve_steps(dims)
    room = size * dims  # state of a cell, kept below the index
    steps = F.lit([p * room + s for p, s in zip(places, states, strict=True)])

    def step(level: int):
        corner = sum((F.shiftright(c, level).bitwiseAND(1) * (1 << k) for k, c in enumerate(cells)), F.lit(0))
        return lambda a: F.floor(a / room) * (size * room) + F.get(steps, (a % room * size + corner).cast("int"))

    at = F.lit(0).cast("long")
    for level in range(bits - 1, -1, -1):
        at = let(at, step(level)).cast("long")
    return F.floor(at / room).cast("long")


def value_marks(df: DataFrame, col: str, cells: int) -> list[tuple[str, int]]:
    """(least value, cell) of a text column's cells, of about equal row counts, ascending.

    Whole values in string order: a value's cell follows from the rows of all lesser
    values, a running total over the counts of distinct values.  At most ``cells`` values
    reach the driver; a frequent value leaves cells empty.
    """
    counts = cut(df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n").alias("t")).first().t
    if not total:
        return []
    upto = running_total(counts, [F.col("v")], F.col("n"), "upto")
    cell = F.floor((F.col("upto") - F.col("n")) * cells / total).cast("int")
    rows = upto.groupBy(cell.alias("cell")).agg(F.min("v").alias("v")).orderBy("cell").collect()
    return [(r.v, r.cell) for r in rows]


def quantised(df: DataFrame, dims: list[str], bits: int) -> list[Column]:
    """Cell numbers 0 to 2 ** bits - 1 of each dimension, of about equal row counts."""
    share = [i / (1 << bits) for i in range(1, 1 << bits)]
    numeric = [c for c in dims if isinstance(df.schema[c].dataType, T.NumericType)]
    found = df.agg(*[F.percentile_approx(F.col(c).cast("double"), share, 10_000).alias(f"q{k}") for k, c in enumerate(numeric)]).first() if numeric else ()

    def below(col: str, quantiles: list | None) -> Column:
        marks = F.lit([float(q) for q in quantiles or []]).cast("array<double>")
        return let(F.col(col).cast("double"), lambda v: F.size(F.filter(marks, lambda q: q < v)))

    def within(col: str) -> Column:
        marks = value_marks(df, col, 1 << bits)
        if not marks:
            return F.lit(0)
        known = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(c).alias("c")) for v, c in marks])
        return let(F.col(col).cast("string"), lambda v: F.array_max(F.transform(F.filter(known, lambda m: m["v"] <= v), lambda m: m["c"])))

    cells = [below(c, found[numeric.index(c)]) if c in numeric else within(c) for c in dims]
    return [F.when(F.col(c).isNull(), F.lit(0)).otherwise(at) for c, at in zip(dims, cells, strict=True)]


def curve_shards(df: DataFrame, dims: list[str], shards: int, order: list[str], bits: int = BITS) -> DataFrame:
    """Adds ``curve``, ``shard`` and ``slot``: runs of equal row counts along the curve.

    ``order`` settles the rank within a cell (after a hash of these columns); the
    result holds the columns of ``order`` only, and the three.
    """
    cells = F.struct(*[c.alias(f"c{k}") for k, c in enumerate(quantised(df, dims, bits))])
    curve = let(cells, lambda c: hilbert_index([c[f"c{k}"] for k in range(len(dims))], bits))
    d = df.select(*order, curve.alias("curve"))
    cells = d.groupBy("curve").agg(F.count(F.lit(1)).alias("_in"))  # at most 2 ** (dims x bits) rows
    along = W.orderBy("curve").rowsBetween(W.unboundedPreceding, W.currentRow)
    cells = cells.select("curve", (F.sum("_in").over(along) - F.col("_in")).alias("_before"))
    total = df.count()
    rank = F.col("_rank") + F.col("_before")
    d = ranked(d, "curve", order, "_rank").join(cells, "curve")
    d = d.withColumn("shard", F.expr(f"(_rank + _before) * {shards} div {max(total, 1)}").cast("int"))
    start = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")  # first rank of the shard
    return d.withColumn("slot", (rank - start).cast("long")).drop("_rank", "_before")


def write_shards(df: DataFrame, path: str, dims: list[str], shards: int, id_col: str, bits: int = BITS) -> None:
    """Writes all columns of ``df``, a folder per shard, rows in curve order (ids must be unique)."""
    placed = curve_shards(df, dims, shards, [id_col], bits)
    (df.join(placed, id_col).repartition(F.col("shard")).sortWithinPartitions("shard", "slot").drop("curve", "slot")
     .write.partitionBy("shard").parquet(path))
