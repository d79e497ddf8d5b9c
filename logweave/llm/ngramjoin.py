"""N-gram Jaccard self-join by prefix filters under several token orders (operator 5).

Documents are sets of word shingles, held as 64-bit hashes; two link when
``100 * intersection >= percent * union``.  Equal sets are one class.

* Orders.  A count sketch of all shingles of all documents (slots in proportion to the text, up to 2^26)
  gives every token a level of frequency.  An order takes tokens from rare to frequent
  levels, within a level by its own hash.  Any order gives right results, rare-first
  ones give short lists.
* Prefixes.  Linked sets share a token among the first ``n - ceil(t n) + 1`` of each
  order.  Prefix tokens of the first order meet in a shuffle; candidates must share
  prefix tokens in all other orders too, and only then are whole sets compared.
* Lists.  A token's classes are listed by bands of set size (a link needs like sizes),
  and a pair is a candidate only if the token's places leave room for a link.
* No group is expanded into pairs.  First every class is compared with the least
  class, the hub, of each of its lists (a star, linear in the lists).  Then members
  of a hub that are still in different components meet in a join whose condition
  holds the remaining filters and the exact test: links come out, not pairs, and
  groups of linked copies are not joined at all.  Classes that share a listed token
  share its hub, hence components are exact.
* Components follow from minimum labels with shortcuts, in rounds cut by checkpoints.

Prefixes of further orders are made only for classes on lists, whole sets only for
candidates; both are found again in the texts by bit filters of fixed size (false
positives only cost time), so that texts and sets of other documents never move.

Defined cases: null and empty texts, and texts without words, have the empty set and
are their own component; texts with fewer words than a shingle are one shingle; rows
of equal id count as documents of that id; a component's id is its least document
id (a null id is never the least unless all are null); an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.llm.common import cut_and_release as cut
from logweave.llm.common import delete_folder, id_type, shared_folder, ship_package

#: Bytes of text per slot of the sketch, and the least and most bits of a slot number (at most 64 MB of levels).
SLOT_BYTES, LEAST_BITS, MOST_BITS = 24, 20, 26
ORDERS = 3
FILTER_BITS = 1 << 26
BLOCK = 1 << 14
TEXT_BLOCK = 1 << 20
GAPS = np.zeros(256, bool)
GAPS[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of words and shingles; tables are made once per worker."""

    def __init__(self):
        rng = np.random.default_rng(20240607)
        odd = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.byte, base, self.weights = odd(256), int(odd(1)[0]), odd(64)
        powers = np.full(TEXT_BLOCK, base, np.uint64)
        powers[0] = 1
        self.powers = np.multiply.accumulate(powers)
        inverse = np.full(TEXT_BLOCK, pow(base, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse)

    def words(self, data: bytes) -> np.ndarray:
        """A hash per word; long texts block by block, a word longer than a block in its parts' sum."""
        out, at = [], 0
        while at < len(data):
            end = min(len(data), at + TEXT_BLOCK)
            if end < len(data):
                gaps = np.flatnonzero(GAPS[np.frombuffer(data, np.uint8, end - at, at)])
                if not len(gaps):  # one word without end: its blocks' bytes stand for it
                    while end < len(data) and not GAPS[data[end]]:
                        end += 1
                    word = hashlib.blake2b(data[at:end], digest_size=8).digest()
                    out.append(np.frombuffer(word, np.uint64))
                    at = end
                    continue
                end = at + int(gaps[-1]) + 1
            out.append(self.block(np.frombuffer(data, np.uint8, end - at, at)))
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def block(self, a: np.ndarray) -> np.ndarray:
        word = np.concatenate([[False], ~GAPS[a], [False]])
        edges = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.byte[a] * self.powers[:len(a)])])
        return mix((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def shingles(self, text: str | None, n: int) -> np.ndarray:
        """The distinct shingle hashes of a text, ascending (ASCII letters lower-cased)."""
        w = self.words((text or "").encode("utf-8", "surrogatepass").lower())
        if not len(w):
            return w
        size = min(n, len(w))
        rows = len(w) - size + 1
        h = np.full(rows, size, np.uint64)
        for k in range(size):
            h = h + w[k:k + rows] * self.weights[k % 64]
            if k % 64 == 63:
                h = mix(h)
        return np.unique(mix(h))


_hasher: list[Hasher] = []


def hasher() -> Hasher:
    if not _hasher:
        _hasher.append(Hasher())
    return _hasher[0]


def order_hash(tokens: np.ndarray, order: int) -> np.ndarray:
    return mix(tokens + np.uint64(0x9E3779B97F4A7C15 * (order + 2) & (1 << 64) - 1))


def slots(tokens: np.ndarray, size: int) -> np.ndarray:
    """Slot of each token among ``size``, a power of two."""
    return (order_hash(tokens, -1) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def prefix(tokens: np.ndarray, levels: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The tokens that a set must share with any linked one, under an order."""
    n = len(tokens)
    rank = np.argsort(levels[slots(tokens, len(levels))].astype(np.uint64) << np.uint64(56) | order_hash(tokens, order) >> np.uint64(8), kind="stable")
    return tokens[rank[:n - -(-percent * n // 100) + 1]]


def signature(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


# ---------------------------------------------------------------- arrays of fixed size over all rows

def folded(df: DataFrame, fill, rows: int, size: int, level=None) -> np.ndarray:
    """Arrays of fixed size that ``fill(batch, array)`` makes in each task, put together.

    With ``level``: sums of 16-bit counts, then one byte each by ``level(sums)``;
    without: the union of bits.  Tasks emit their non-empty blocks; blocks meet by
    number, each combined as a stream; only the fixed-size total reaches the driver.
    """
    spark = df.sparkSession
    ship_package(spark)
    per, bits = size // BLOCK, level is None

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, size), np.uint8 if bits else np.uint16)
        for b in batches:
            fill(b, total)
        blocks = total.reshape(rows * per, BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        for some in np.array_split(used, max(1, len(used) // 64)):
            data = [zlib.compress(np.packbits(blocks[i]).tobytes() if bits else narrow(blocks[i]), 1) for i in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(data, pa.binary())], ["block", "data"])

    def narrow(a: np.ndarray) -> bytes:
        return a.astype("u1" if a.max() < 256 else "<u2").tobytes()

    def unpack(data: bytes) -> np.ndarray:
        raw = zlib.decompress(data)
        return np.frombuffer(raw, np.uint8) if bits else np.frombuffer(raw, "u1" if len(raw) == BLOCK else "<u2").astype(np.int64)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                a = unpack(data.as_py())
                held[i] = a if i not in held else held[i] | a if bits else held[i] + a
        keys = sorted(held)
        data = [zlib.compress((held[i] if bits else level(held[i])).tobytes(), 1) for i in keys]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(data, pa.binary())], ["block", "data"])

    out = np.zeros((rows * per, BLOCK // 8 if bits else BLOCK), np.uint8)
    merged = df.mapInArrow(partial, "block int, data binary").repartition(F.col("block")).mapInArrow(merge, "block int, data binary")
    for i, data in merged.collect():  # one job; compressed, at most ``rows * size`` bytes whatever the input
        out[i] = np.frombuffer(zlib.decompress(bytes(data)), np.uint8)
    return out.reshape(rows, -1)


def token_levels(texts: DataFrame, n: int) -> np.ndarray:
    """Level of every slot: how often documents hold its tokens, one byte each.

    The number of slots follows the bytes of text up to a fixed most, so that slots of
    rare tokens stay nearly empty.  A task's count of a slot stops at 65,535, which can
    only blur the order among tokens that frequent.
    """
    volume = texts.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 1
    size = 1 << min(MOST_BITS, max(LEAST_BITS, round(math.log2(max(volume / SLOT_BYTES, 1)))))
    # steps of an eighth of the deviation that chance gives (whole counts where these are few), beyond 128 logarithmic
    mean = volume / 6 / size
    step, low = max(1.0, mean ** 0.5 / 8), max(0.0, mean - 6 * mean ** 0.5 - 8)

    def fill(b: pa.RecordBatch, total: np.ndarray) -> None:
        held, count = [], 0
        for text in b.column(0):
            held.append(slots(hasher().shingles(text.as_py(), n), size))
            count += len(held[-1])
            if count > 1 << 19:
                add(total, held)
                held, count = [], 0
        if held:
            add(total, held)

    def add(total: np.ndarray, held: list) -> None:
        at, times = np.unique(np.concatenate(held), return_counts=True)
        total[0][at] = np.minimum(total[0][at] + times, 0xFFFF)

    def level(counts: np.ndarray) -> np.ndarray:
        x = np.maximum(counts - low, 0) / step
        return np.minimum(np.where(x < 128, x, 128 + 8 * np.log2(np.maximum(x, 128) / 128)), 255).astype(np.uint8)

    return folded(texts, fill, 1, size, level)[0]


# ---------------------------------------------------------------- the join

def prefixes(src: DataFrame, n: int, percent: int, levels) -> DataFrame:
    """(id, n, cls, c, prefix): set size, 128- and 64-bit class keys, first order's prefix.

    The prefix is null for sets too small to link with another, and for a class that
    the task has already met.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            size, cls, heads = [], [], []
            for text in b.column(1):
                s = hasher().shingles(text.as_py(), n)
                key = signature(s)
                size.append(len(s))
                cls.append(key)
                if key in seen or 100 * len(s) < percent * (len(s) + 1):
                    heads.append(None)
                else:
                    seen.add(key)
                    heads.append(prefix(s, levels.value, 0, percent).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(cls, pa.binary()),
                 pa.array([int.from_bytes(k[:8], "little", signed=True) for k in cls], pa.int64()), pa.array(heads, pa.list_(pa.int64()))],
                ["id", "n", "cls", "c", "prefix"])

    schema = T.StructType([T.StructField("id", id_type(src, "id")), T.StructField("n", T.LongType()), T.StructField("cls", T.BinaryType()),
                           T.StructField("c", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType()))])
    return src.mapInArrow(run, schema)


def hashed(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each value: of integers by themselves, of others by their text; nulls alike."""
    if not pa.types.is_integer(values.type):
        return np.array([int.from_bytes(hashlib.blake2b(repr(v).encode(), digest_size=8).digest(), "little") for v in values.to_pylist()], np.uint64)
    h = mix(values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
    h[values.is_null().to_numpy(zero_copy_only=False)] = np.uint64(0x6E756C6C)
    return h


def places(h: np.ndarray) -> np.ndarray:
    """Two places in the bit filter for each hash."""
    return np.stack([(h >> np.uint64(10)) % np.uint64(FILTER_BITS), mix(h + np.uint64(1)) % np.uint64(FILTER_BITS)]).astype(np.int64)


def bit_filter(values: DataFrame):
    """Broadcast bits of fixed size for the values of a one-column table."""
    def fill(b: pa.RecordBatch, total: np.ndarray) -> None:
        total[0][places(hashed(b.column(0))).ravel()] = 1

    return values.sparkSession.sparkContext.broadcast(folded(values, fill, 1, FILTER_BITS)[0])


def held(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each hash (false positives only)."""
    p = places(h)
    return (bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1).all(axis=0)


def posted(base: DataFrame, wanted) -> DataFrame:
    """(token, c, n, pos): prefix tokens of ``base`` that the bit filter ``wanted`` may hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            flat, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(lists)), sizes)
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            hit = np.flatnonzero(held(wanted.value, mix(flat.view(np.uint64))))
            yield pa.RecordBatch.from_arrays([pa.array(flat[hit]), b.column(0).take(pa.array(row[hit])), b.column(1).take(pa.array(row[hit])),
                                              pa.array(pos[hit].astype(np.int32))], ["token", "c", "n", "pos"])

    return base.where("prefix IS NOT NULL").select("c", "n", "prefix").mapInArrow(run, "token long, c long, n long, pos int")


def features(src: DataFrame, base: DataFrame, classes: DataFrame, n: int, percent: int, levels, whole: bool) -> tuple[DataFrame, str]:
    """Of one document per class in ``classes`` (column cls), as a written table and its folder: (c, cls, head),
    the second order's prefix; or (cls, head2, …, tokens), further orders' prefixes and the whole set.
    """
    spark = src.sparkSession
    wanted = bit_filter(base.join(classes, "cls", "left_semi").groupBy("cls").agg(F.min("id").alias("id")).select("id"))
    orders = range(2, ORDERS) if whole else [1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in np.flatnonzero(held(wanted.value, hashed(b.column(0)))):
                s = hasher().shingles(b.column(1)[int(i)].as_py(), n)
                key = signature(s)
                heads = [prefix(s, levels.value, k, percent).view(np.int64) for k in orders]
                rows.append((key, *heads, s.view(np.int64)) if whole else (int.from_bytes(key[:8], "little", signed=True), key, *heads))
                if len(rows) == 500:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    def batch(rows: list) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(list(c), arrow[k]) for k, c in zip(kinds, columns, strict=True)], names)

    arrow = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    names = ["cls", *[f"head{k}" for k in orders], "tokens"] if whole else ["c", "cls", "head"]
    kinds = ["binary", *["array<long>"] * (len(orders) + 1)] if whole else ["long", "binary", "array<long>"]
    folder = shared_folder(spark, "shingle-sets")
    src.mapInArrow(run, ", ".join(map(" ".join, zip(names, kinds, strict=True)))).write.parquet(folder)
    wanted.destroy()
    return spark.read.parquet(folder), folder


def near(inter: Column, a: Column, b: Column, percent: int) -> Column:
    return inter * 100 >= (a + b - inter) * percent


def candidates(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """Class keys (u, v) of pairs (a, b) that also share a prefix token of the second order."""
    side = lambda s: heads.select(*[F.col(c).alias(f"{s}_{c}") for c in heads.columns])
    p = pairs.join(side("a"), F.col("a") == F.col("a_c")).join(side("b"), F.col("b") == F.col("b_c"))
    p = p.where((F.col("a_cls") != F.col("b_cls")) & F.arrays_overlap("a_head", "b_head"))
    return cut(p.select(F.col("a_cls").alias("u"), F.col("b_cls").alias("v")).distinct())


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among candidates (u, v): the remaining orders' filters, then whole sets."""
    side = lambda s: sets.select(*[F.col(c).alias(f"{s}_{c}") for c in sets.columns])
    q = pairs.join(side("u"), F.col("u") == F.col("u_cls")).join(side("v"), F.col("v") == F.col("v_cls"))
    for k in range(2, ORDERS):
        q = q.where(F.arrays_overlap(f"u_head{k}", f"v_head{k}"))
    inter = F.size(F.array_intersect("u_tokens", "v_tokens"))
    q = q.select("u", "v", inter.alias("i"), F.size("u_tokens").alias("x"), F.size("v_tokens").alias("y"))
    return cut(q.where(near(F.col("i"), F.col("x"), F.col("y"), percent)).select("u", "v").distinct())


def verified_apart(members: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links among members (hub, band, c, cls) that are in different components so far.

    Members of a hub meet in a join whose condition holds all filters and the exact
    test, so that links come out of it, not pairs.
    """
    m = members.join(labels, F.col("cls") == F.col("node"), "left").withColumn("part", F.coalesce("label", "cls")).drop("node", "label")
    split = m.groupBy("hub", "band").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("hub", "band")
    m = cut(m.join(split, ["hub", "band"], "left_semi"))
    m = m.join(sets, "cls").withColumn("n", F.size("tokens")).withColumn("own", bands(F.col("n"), percent)[0])
    cols = [c for c in m.columns if c not in ("hub", "band")]
    left, right = (m.select("hub", "band", *[F.col(x).alias(f"{s}_{x}") for x in cols]) for s in "lr")
    test = (F.col("l_cls") < F.col("r_cls")) & (F.col("l_part") != F.col("r_part")) & (F.col("band") == F.greatest("l_own", "r_own")) \
        & near(F.least("l_n", "r_n"), F.col("l_n"), F.col("r_n"), percent)
    for k in range(2, ORDERS):
        test = test & F.arrays_overlap(f"l_head{k}", f"r_head{k}")
    test = test & near(F.size(F.array_intersect("l_tokens", "r_tokens")), F.col("l_n"), F.col("r_n"), percent)
    links = left.join(right, ["hub", "band"]).where(test)
    return cut(links.select(F.col("l_cls").alias("u"), F.col("r_cls").alias("v")).distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node of each component, for all nodes of links (u, v)."""
    both = cut(links.select("u", "v").union(links.select("v", "u")).distinct())
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        at = labels.select(F.col("node").alias("v"), F.col("label").alias("lv"))
        own = labels.select(F.col("node").alias("u"), F.col("label").alias("lu"))
        seen = both.join(at, "v").join(own, "u").where("lv < lu")
        told = seen.select(F.explode(F.array("u", "lu")).alias("node"), "lv").groupBy("node").agg(F.min("lv").alias("m"))
        new = labels.join(told, "node", "left").select("node", F.least("label", F.coalesce("m", "label")).alias("next"), "label")
        jump = new.select(F.col("node").alias("next"), F.col("next").alias("after"))
        new = cut(new.join(jump, "next", "left").select("node", F.coalesce("after", "next").alias("label"), F.col("label").alias("old")))
        labels = new.select("node", "label")
        if new.where("label <> old").limit(1).count() == 0:
            return labels


def least_of(rows: DataFrame, key: list[str], out: str = "hub") -> DataFrame:
    """The lists (by ``key``) of two classes or more, with their least class as ``out``."""
    return rows.groupBy(*key).agg(F.min("c").alias(out), F.max("c").alias("_top")).where(F.col(out) < F.col("_top")).drop("_top")


def bands(size: Column, percent: int) -> Column:
    """Two bands of set sizes; sizes whose ratio allows a link always share one."""
    width = math.log(100 / percent) * 1.000001  # a little wide, against rounding
    band = F.floor(F.log(size.cast("double")) / width).cast("int")
    return F.array(band, band + 1)


def admits(a: str, b: str, percent: int) -> Column:
    """Whether sizes and places of a shared prefix token leave room for a link."""
    n, i, m, j = (F.col(f"{s}{x}") for s in (a, b) for x in ("n", "pos"))
    most = F.least(i, j) + 1 + F.least(n - i - 1, m - j - 1)  # tokens before, this one, tokens after
    return near(most, n, m, percent)


def token_lists(base: DataFrame, percent: int) -> DataFrame:
    """(token, band, c, n, pos, hub): the lists of two classes or more and their least class."""
    hubs = cut(least_of(base.where("prefix IS NOT NULL").select(F.explode("prefix").alias("token"), "c"), ["token"]))
    wanted = bit_filter(hubs.select("token"))
    shared = posted(base, wanted).join(hubs.select("token"), "token", "left_semi")
    banded = cut(shared.withColumn("band", F.explode(bands(F.col("n"), percent))))
    wanted.destroy()
    return cut(banded.join(least_of(banded, ["token", "band"]), ["token", "band"]))


def star_and_members(src: DataFrame, base: DataFrame, n: int, percent: int, levels) -> tuple[DataFrame, DataFrame]:
    """Candidates (u, v) of hubs with the other members of their lists, and the members (hub, band, c, cls)
    that may link with one another.  Lists and prefixes are let go with this step."""
    lists = token_lists(base, percent)
    listed = base.join(lists.select("c").distinct(), "c", "left_semi").select("cls").distinct()
    heads, folder = features(src, base, listed, n, percent, levels, whole=False)
    # the least class of each list against its other members
    ends = lists.where("c = hub").select("token", "band", *[F.col(x).alias(f"h_{x}") for x in ("n", "pos")]).distinct()
    star = lists.where("c <> hub").join(ends, ["token", "band"]).where(admits("", "h_", percent))
    pairs = candidates(star.select(F.col("hub").alias("a"), F.col("c").alias("b")).distinct(), heads)
    # the other members against each other, by hub: only those that share a token of the second order there too
    members = lists.where("c <> hub").select("hub", "band", "c").distinct().join(heads.select("c", "cls", "head"), "c")
    listed = members.select("hub", "band", "c", F.explode("head").alias("token"))
    listed = listed.join(least_of(listed, ["hub", "band", "token"], "least"), ["hub", "band", "token"], "left_semi")
    members = cut(members.drop("head").join(listed.select("hub", "band", "c").distinct(), ["hub", "band", "c"], "left_semi"))
    delete_folder(src.sparkSession, folder)
    return pairs, members


def jaccard_components(df: DataFrame, n: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): components of documents linked at ``percent``."""
    spark = df.sparkSession
    ship_package(spark)
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    levels = spark.sparkContext.broadcast(token_levels(src.select("text"), n))
    base = cut(prefixes(src, n, percent, levels))
    pairs, members = star_and_members(src, base, n, percent, levels)
    base = cut(base.select("id", "n", "cls"))  # the prefixes are let go
    needed = pairs.select(F.explode(F.array("u", "v")).alias("cls")).union(members.select("cls")).distinct()
    sets, folder = features(src, base, needed, n, percent, levels, whole=True)
    levels.destroy()
    links = verified(pairs, sets, percent)
    first = components(links)
    more = verified_apart(members, sets, first, percent)
    delete_folder(spark, folder)
    final = components(links.union(more)) if more.limit(1).count() else first
    lowest = base.groupBy("cls").agg(F.min("id").alias("low"))
    part = lowest.join(final, lowest["cls"] == final["node"], "left").select("cls", "low", F.coalesce("label", "cls").alias("label"))
    least = part.groupBy("label").agg(F.min("low").alias("least"))
    part = part.join(least, "label").select("cls", "least")
    out = base.select("id", "n", "cls").join(part, "cls")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(df: DataFrame, n: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose id is the least of their component; columns as in ``df``.

    The ids to drop are a written table, so its size decides between a broadcast and
    a shuffle.  Rows of a null id stay.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, "near-copies")
    found = jaccard_components(df, n, percent, id_col, text_col)
    found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_drop")).distinct().write.parquet(folder)
    drop = spark.read.parquet(folder)
    return df.join(drop, df[id_col] == drop["_drop"], "left_anti")
