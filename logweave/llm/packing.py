"""Best-fit packing of token pieces by linear grouping (operator 2).

1. Every document becomes its token ids and one end id; documents longer than the
   capacity are cut into full pieces, of which the first may be shorter.
2. Only the histogram of piece lengths reaches the driver: at most ``capacity``
   numbers, whatever the size of the corpus.
3. Large lengths are parted into groups of equal cardinality and rounded up to the
   largest of their group.  For these few sizes the cheapest set of configurations
   (how many of each size a sequence takes) is found by column generation.
4. Configurations are filled with actual pieces, which frees what rounding cost;
   remaining large pieces and all small ones go, longest first, to the sequence
   whose room they fit best.  Equal lengths move in runs, so this too is work on
   the histogram, not on pieces.
5. Pieces are numbered within their length by a salted two-level rank, and look up
   their run: sequence and offset follow by arithmetic.

Defined cases: a null text is an empty one (its end id alone is one piece); null
ids, equal ids and equal rows are packed as separate pieces; an empty table gives
an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.llm.common import cut, id_type, ranked, ship_package
from logweave.llm.tokens import library_encoder

#: (groups, from which share of the capacity a length is large): each is planned on the
#: histogram, and the plan of the fewest sequences is kept.
SHAPES = ((64, 1 / 16), (12, 1 / 3), (64, 1 / 3), (64, 0.45), (160, 0.45))


def token_pieces(df: DataFrame, vocab_path: str, capacity: int, end_id: int = 0,
                 id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids, cut to ``capacity``."""
    ship_package(df.sparkSession)
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    end = int(end_id).to_bytes(4, "little")

    def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(vocab_path, added_tokens)
        for b in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(b.column(1)):
                ids = encode(text.as_py()) + end
                total = len(ids) // 4
                n = -(-total // capacity)
                first = total - (n - 1) * capacity
                at = 0
                for k in range(n):
                    size = capacity if k else first
                    rows.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at:4 * (at + size)]))
                    at += size
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["id", "piece", "start", "length", "ids_crc32"])

    schema = T.StructType([T.StructField("id", id_type(df, id_col)), T.StructField("piece", T.IntegerType()),
                           T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                           T.StructField("ids_crc32", T.LongType())])
    return src.mapInArrow(cut_batches, schema).withColumnRenamed("id", id_col)


# ---------------------------------------------------------------- the plan, on the histogram

class Pool:
    """Pieces of several lengths as runs (length, first rank, count), taken in order."""

    def __init__(self, runs: list[tuple[int, int, int]]):
        self.runs = list(reversed(runs))
        self.size = sum(r[2] for r in runs)

    def take(self, n: int) -> list[tuple[int, int, int]]:
        out = []
        self.size -= n
        while n:
            length, rank, count = self.runs.pop()
            used = min(n, count)
            out.append((length, rank, used))
            if used < count:
                self.runs.append((length, rank + used, count - used))
            n -= used
        return out


class Batch:
    """``count`` sequences alike: slots (length, first rank, pieces a sequence, offset)."""

    __slots__ = ("count", "used", "slots")

    def __init__(self, count: int, used: int = 0, slots: tuple = ()):
        self.count, self.used, self.slots = count, used, slots

    def split(self, n: int) -> "Batch":
        """Keep the first ``n`` sequences; return the rest."""
        rest = Batch(self.count - n, self.used, tuple((s, r + n * j, j, o) for s, r, j, o in self.slots))
        self.count = n
        return rest

    def put(self, length: int, rank: int, each: int) -> None:
        self.slots += ((length, rank, each, self.used),)
        self.used += length * each


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within ``capacity`` of the highest total value."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        fits = np.flatnonzero(sizes <= c)
        gain = best[c - sizes[fits]] + values[fits]
        k = int(gain.argmax())
        if gain[k] > best[c - 1] + 1e-12:
            best[c], choice[c] = gain[k], fits[k]
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[choice[c]] += 1
            c -= sizes[choice[c]]
    return float(best[capacity]), counts


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[int, list[int]]]:
    """(sequences, how many of each size): few configurations that use the fewest sequences.

    Column generation for the fractional optimum, rounded down; what is left over is
    less than one sequence per size and is packed with the small pieces.
    """
    s, d = np.array(sizes), np.array(demand, float)
    basis = np.diag(np.floor(capacity / s)).astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        value, pattern = best_pattern(np.maximum(inverse.sum(axis=0), 0), s, capacity)
        if value <= 1 + 1e-7:
            break
        x, w = inverse @ d, inverse @ pattern
        ratio = np.where(w > 1e-9, np.maximum(x, 0) / np.where(w > 1e-9, w, 1), np.inf)
        basis[:, int(ratio.argmin())] = pattern
    x = np.linalg.solve(basis, d)
    out, left = [], list(demand)
    for k in range(len(sizes)):
        counts = [int(round(v)) for v in basis[:, k]]
        n = min([int(np.floor(max(x[k], 0) + 1e-6))] + [left[i] // c for i, c in enumerate(counts) if c])
        if n:
            out.append((n, counts))
            left = [v - n * c for v, c in zip(left, counts, strict=True)]
    return out


def packing_plan(hist: dict[int, int], capacity: int, shapes=SHAPES) -> list[tuple]:
    """Runs (length, first rank, pieces, pieces a sequence, first sequence, offset)."""
    return min((grouped_plan(hist, capacity, *s) for s in shapes), key=lambda p: p[0])[1]


def grouped_plan(hist: dict[int, int], capacity: int, groups: int, large_from: float) -> tuple[int, list[tuple]]:
    """(number of sequences, runs) of one choice of groups and of what counts as large."""
    large = sorted((n for n in hist if n > large_from * capacity), reverse=True)
    room: list[list[Batch]] = [[] for _ in range(capacity + 1)]
    loose: dict[int, list[tuple[int, int]]] = {n: [(0, hist[n])] for n in hist if n not in set(large)}
    total = sum(hist[n] for n in large)
    if total:
        # linear grouping: equal cardinality, every length rounded up to the group's largest
        each, at, rounded = -(-total // groups), 0, {}
        size = large[0]
        for n in large:
            done = 0
            while done < hist[n]:
                if at % each == 0:
                    size = n
                used = min(hist[n] - done, each - at % each)
                rounded.setdefault(size, []).append((n, done, used))
                done, at = done + used, at + used
        sizes = sorted(rounded, reverse=True)
        pools = {n: Pool(rounded[n]) for n in sizes}
        for count, counts in configurations(sizes, [pools[n].size for n in sizes], capacity):
            # actual pieces take the places of the rounded sizes
            batches = [Batch(count)]
            for n, copies in zip(sizes, counts, strict=True):
                for _ in range(copies):
                    runs, filled = pools[n].take(count), []
                    for length, rank, many in runs:
                        while many:
                            b = batches.pop(0)
                            if b.count > many:
                                batches.insert(0, b.split(many))
                            b.put(length, rank, 1)
                            filled.append(b)
                            rank, many = rank + b.count, many - b.count
                    batches = filled
            for b in batches:
                room[capacity - b.used].append(b)
        for p in pools.values():
            for length, rank, many in p.runs:
                loose.setdefault(length, []).append((rank, many))
    open_rooms = sorted(r for r in range(capacity + 1) if room[r])

    def keep(b: Batch) -> None:
        r = capacity - b.used
        if not room[r]:
            open_rooms.insert(bisect_left(open_rooms, r), r)
        room[r].append(b)

    for length in sorted(loose, reverse=True):
        for rank, many in loose[length]:
            while many:
                at = bisect_left(open_rooms, length)
                if at < len(open_rooms):
                    r = open_rooms[at]
                    b = room[r].pop()
                    if not room[r]:
                        open_rooms.pop(at)
                else:
                    r, b = capacity, Batch(many)
                each = min(r // length, many)  # the fuller a sequence, the better the fit: fill it up
                n = min(b.count, many // each)
                if n < b.count:
                    rest = b.split(n)
                    if r < capacity or rest.used:
                        keep(rest)
                b.put(length, rank, each)
                keep(b)
                rank, many = rank + n * each, many - n * each
    runs, sequence = [], 0
    for bs in room:
        for b in bs:
            runs += [(s, r, b.count * j, j, sequence, o) for s, r, j, o in b.slots]
            sequence += b.count
    return sequence, runs


def pack(pieces: DataFrame, capacity: int, length_col: str = "length", order: list[str] | None = None,
         shapes=SHAPES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` (long) to pieces of 1 to ``capacity`` tokens.

    ``pieces`` is read twice: pass a table or a checkpoint.
    """
    spark = pieces.sparkSession
    ship_package(spark)
    hist = {r[0]: r[1] for r in pieces.groupBy(length_col).count().collect()}  # at most ``capacity`` rows
    if any(n is None or not 1 <= n <= capacity for n in hist):
        raise ValueError("lengths must lie between 1 and the capacity")
    runs = sorted(packing_plan(hist, capacity, shapes))
    runs_b = spark.sparkContext.broadcast(np.array(runs or np.zeros((0, 6)), np.int64))  # runs follow lengths, not pieces
    keyed = ranked(pieces, length_col, order or [c for c in pieces.columns if c != length_col], "_rank")
    schema = T.StructType([f for f in keyed.schema.fields if f.name != "_rank"]
                          + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = runs_b.value
        keys = table[:, 0] * (1 << 48) + table[:, 1]
        for f in frames:
            n, rank = f[length_col].to_numpy(np.int64), f.pop("_rank").to_numpy(np.int64)
            _, first, _, each, sequence, offset = table[np.searchsorted(keys, n * (1 << 48) + rank, "right") - 1].T
            yield f.assign(sequence_id=sequence + (rank - first) // each, offset=offset + (rank - first) % each * n)

    return keyed.mapInPandas(place, schema)


def pack_documents(df: DataFrame, vocab_path: str, capacity: int, end_id: int = 0,
                   id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of all documents."""
    pieces = cut(token_pieces(df, vocab_path, capacity, end_id, id_col, text_col, added_tokens))
    return pack(pieces, capacity, "length", [id_col, "piece", "start", "ids_crc32"])
