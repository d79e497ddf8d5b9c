"""Periodic runs of words by constant-time extension queries on suffix trees (operator 11).

A run is a stretch of consecutive words with smallest period q that no neighbouring
word extends keeping it.  Runs of at least ``min_exponent`` periods and ``min_length``
words are found, all of a document's runs, each once:

* Trees.  Ukkonen's algorithm builds the suffix tree of the document's word numbers, and
  that of their reversal.  An Euler tour notes the string depth at every step, so the
  longest common extension of two places is the least depth between their leaves, found
  in constant time (least depths of blocks, of block starts and ends).
* Candidates.  The tour gives the order of suffixes.  The longest Lyndon word at a place
  reaches to the next lesser suffix, or in the opposite order of words to the next
  greater one; every run has such a word as a root of its period.
* Extension.  Each candidate root is extended in both directions by the two trees; long
  enough extensions are the runs.

Words that cannot lie in a run cost no tree: three neighbouring words of a run occur in it
at least ``min_exponent - 1`` times.  Stretches without such triples are put into the trees
as one word that occurs nowhere else, over which no run and no extension can go.

Defined cases: a null text has no words, like an empty one, and no runs; a null id stays
null; rows are judged one by one, so repeated rows and ids give repeated results; other
columns are not read; an empty table gives an empty result.  A document's words and trees
must fit in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.llm.common import id_type, ship_package

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
BLOCK = 16


class RangeMin:
    """Least values of ranges of an array, in constant time for each range."""

    def __init__(self, values: np.ndarray):
        size = -(-len(values) // BLOCK) * BLOCK
        self.values = np.full(size, np.iinfo(np.int32).max, np.int32)
        self.values[:len(values)] = values
        rows = self.values.reshape(-1, BLOCK)
        self.before = np.minimum.accumulate(rows, axis=1).ravel()
        self.after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [rows.min(axis=1)]
        while 2 << len(self.levels) - 1 <= len(rows):
            last, step = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least value of each range low..high, both ends included."""
        out = np.minimum(self.after[low], self.before[high])
        first, last = low // BLOCK, high // BLOCK
        near = np.flatnonzero(first == last)
        if len(near):
            at = np.minimum(low[near, None] + np.arange(BLOCK), high[near, None])
            out[near] = self.values[at].min(axis=1)
        far = np.flatnonzero(last - first > 1)
        if len(far):
            a, b = first[far] + 1, last[far]
            level = np.log2(b - a).astype(np.int64)
            inner = np.empty(len(far), np.int32)
            for k in np.unique(level):
                some = level == k
                inner[some] = np.minimum(self.levels[k][a[some]], self.levels[k][b[some] - (1 << int(k))])
            out[far] = np.minimum(out[far], inner)
        return out


def ukkonen(s: list[int], kinds: int) -> tuple[dict[int, int], list[int], list[int]]:
    """The suffix tree of ``s``: child by ``node * kinds + first symbol``, and each node's edge (start, end).

    The last symbol occurs once, so that every suffix is a leaf; node 0 is the root.
    """
    n = len(s)
    child: dict[int, int] = {}
    start, end, link = [0], [0], [0]
    node = edge = length = waiting = 0
    for i in range(n):
        symbol = s[i]
        waiting += 1
        made = 0  # the inner node of this phase that still has no link
        while waiting:
            if not length:
                edge = i
            key = node * kinds + s[edge]
            to = child.get(key)
            if to is None:
                child[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                if made:
                    link[made] = node
                    made = 0
            else:
                span = end[to] - start[to]
                if length >= span:
                    edge += span
                    length -= span
                    node = to
                    continue
                begin = start[to]
                if s[begin + length] == symbol:
                    length += 1
                    if made:
                        link[made] = node
                    break
                split = len(start)
                child[key] = split
                start += (begin, i)
                end += (begin + length, n)
                link += (0, 0)
                child[split * kinds + symbol] = split + 1
                child[split * kinds + s[begin + length]] = to
                start[to] = begin + length
                if made:
                    link[made] = split
                made = split
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - waiting + 1
    return child, start, end


class Extensions:
    """Longest common extensions of places of a word list, and the order of its suffixes."""

    def __init__(self, symbols: np.ndarray):
        """``symbols``: numbers from 1."""
        n, kinds = len(symbols), int(symbols.max(initial=0)) + 1
        child, start, end = ukkonen([*symbols.tolist(), 0], kinds)
        nodes = len(start)
        keys = np.fromiter(child.keys(), np.int64, len(child))
        order = np.argsort(keys)
        kids = np.fromiter(child.values(), np.int64, len(child))[order].tolist()
        upto = np.searchsorted(keys[order], np.arange(1, nodes + 1) * kinds).tolist()
        del child, keys
        at = [0, *upto[:-1]]
        depth, tour, leaf = [0] * nodes, [], [0] * (n + 1)
        path = [0]
        while path:
            v = path[-1]
            k = at[v]
            tour.append(depth[v])
            if k < upto[v]:
                at[v] = k + 1
                c = kids[k]
                d = depth[c] = depth[v] + end[c] - start[c]
                if at[c] == upto[c]:  # a leaf: the suffix of this length
                    leaf[n + 1 - d] = len(tour)
                    tour.append(d)
                else:
                    path.append(c)
            else:
                path.pop()
        self.leaf = np.array(leaf, np.int64)  # by place; a lesser suffix comes first in the tour
        self.depths = RangeMin(np.array(tour, np.int32))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common start of the suffixes at i and j (i <> j)."""
        a, b = self.leaf[i], self.leaf[j]
        return self.depths.least(np.minimum(a, b), np.maximum(a, b)).astype(np.int64)


def next_lesser(values: list[int]) -> np.ndarray:
    """For each place the next place of a lesser value (the length, if there is none)."""
    out, open_ = [len(values)] * len(values), []
    for i, v in enumerate(values):
        while open_ and values[open_[-1]] > v:
            out[open_.pop()] = i
        open_.append(i)
    return np.array(out, np.int64)


def distinct_runs(symbols: np.ndarray, min_length: int, min_exponent: int) -> np.ndarray:
    """Rows (start, length, period) of the runs, by start, then period."""
    n = len(symbols)
    ahead, back = Extensions(symbols), Extensions(symbols[::-1])
    rank = ahead.leaf[:n]
    at = np.arange(n)
    found = []
    for order in (rank, -rank):
        period = next_lesser(order.tolist()) - at
        some = np.flatnonzero(at + period < n)  # a run's first root is followed by another
        i, p = some, period[some]
        right = ahead.common(i, i + p)
        left = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > 0)
        left[inner] = back.common(n - i[inner], n - i[inner] - p[inner])
        length = left + p + right
        keep = (length >= min_exponent * p) & (length >= min_length)
        found.append(np.stack([(i - left)[keep], length[keep], p[keep]], axis=1))
    runs = np.unique(np.concatenate(found), axis=0)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def may_lie_in_runs(ids: np.ndarray, min_length: int, min_exponent: int) -> np.ndarray:
    """Whether each word is in a triple of words that occurs as often as those of a run do."""
    # a run of period 1 has min_length - 2 triples or more, one of period q > 1 at least q * (min_exponent - 1)
    least = max(1, min(min_exponent - 1, max(min_length, min_exponent) - 2))
    x = ids.astype(np.uint64)
    odd = [np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    triple = x[:-2] * odd[0] ^ x[1:-1] * odd[1] + (x[2:] * odd[2] >> np.uint64(7)) ^ x[2:] * odd[2]  # equal triples: equal numbers
    _, place, times = np.unique(triple, return_inverse=True, return_counts=True)
    often = times[place] >= least
    out = np.zeros(len(ids), bool)
    for k in range(3):
        out[k:len(ids) - 2 + k] |= often
    return out


def word_runs(words: list[bytes], min_length: int = 6, min_exponent: int = 4) -> np.ndarray:
    """Rows (start, length, period) of the runs of a word list, by start, then period."""
    none = np.zeros((0, 3), np.int64)
    if len(words) < min_length:
        return none
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    kept = may_lie_in_runs(ids, min_length, min_exponent)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], kept.view(np.int8), [0]])))
    stretches = edges.reshape(-1, 2)
    stretches = stretches[stretches[:, 1] - stretches[:, 0] >= min_length]
    if not len(stretches):
        return none
    # the kept stretches one after another, each with a word of its own behind it
    sizes = stretches[:, 1] - stretches[:, 0]
    ends = np.cumsum(sizes + 1)
    shift = np.repeat(stretches[:, 0] - (ends - sizes - 1), sizes + 1)
    place = np.arange(ends[-1]) + shift
    symbols = ids[np.minimum(place, len(ids) - 1)]
    symbols[ends - 1] = len(number) + np.arange(len(ends))
    _, symbols = np.unique(symbols, return_inverse=True)
    runs = distinct_runs(symbols + 1, min_length, min_exponent)
    runs[:, 0] = place[runs[:, 0]]
    return runs


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6,
                  min_exponent: int = 4) -> DataFrame:
    """(id, n_words, runs, collapsed): runs by start and period, and the words that no run
    holds after its first period, joined by a blank.

    ``min_length`` is at least 3 and ``min_exponent`` at least 2.
    """
    if min_length < 3 or min_exponent < 2:
        raise ValueError("runs need at least three words and two periods")
    ship_package(df.sparkSession)
    item = pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, lists, texts = [], [], []
            for text in b.column(1):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                runs = word_runs(words, min_length, min_exponent)
                counts.append(len(words))
                lists.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()])
                if len(runs):  # +1 where a run's repeats begin, -1 behind it
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
                    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
                    inside = np.cumsum(change[:-1])
                    words = [w for w, k in zip(words, inside.tolist(), strict=True) if not k]
                texts.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(lists, pa.list_(item)), pa.array(texts, pa.string())],
                                             ["id", "n_words", "runs", "collapsed"])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", id_type(src, "id")), T.StructField("n_words", T.LongType()),
                           T.StructField("runs", T.DataType.fromDDL(RUNS)), T.StructField("collapsed", T.StringType())])
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)
