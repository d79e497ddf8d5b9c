"""Token files with directly addressable codes (operator 8).

An id is split into chunks of the widths in ``WIDTHS``, lowest bits first, and only
as many chunks as it needs are kept, one per level.  Each level but the last has a
continuation bitmap (bit i: entry i goes on in the next level) and a rank directory
(set bits before every 512 bits, and within them before every 64).  Entry i goes on
at entry rank(i) of the next level, so any token is read from a few words, without
decoding a block.

File (little-endian), as Spark writes it into a folder, one record per file:
  magic ``DACT``, version u32, levels u32, documents u32, run u64, part u64, tokens u64;
  level widths u8 each, padded to 8; document ids i64; null flags u8, padded to 8;
  token starts u64, one more than documents; per level: entries u64, chunks packed
  at the level's width and padded to 8, then (not the last level) bitmap words u64,
  super directory u32 and word directory u16, each padded to 8; a line feed ends it.
Files of run 0, part 0, 1, …, then of run 1, … hold the documents in ascending id order.

Defined cases: null and empty texts have their end id alone; null ids come first;
rows of equal ids are kept, ordered by their tokens; an empty table gives no files
with tokens and an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.llm.common import cut, n_shuffle, range_cuts, run_of, ship_package
from logweave.llm.tokens import library_encoder

MAGIC, VERSION = b"DACT", 1
HEADER = "<4sIIIQQQ"
HEADER_BYTES = struct.calcsize(HEADER)
WIDTHS = (8, 8, 16)
FILE_TOKENS = 1 << 21


def padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 8)


def pack_bits(values: np.ndarray, width: int) -> bytes:
    bits = (values[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def pack_chunks(values: np.ndarray, width: int) -> bytes:
    """Chunks at their width; whole bytes as they are, others in blocks that keep the bit matrix small."""
    if width in (8, 16, 32):
        return values.astype(f"<u{width // 8}").tobytes()
    step = 1 << 16  # a multiple of 8, so blocks end at whole bytes
    return b"".join(pack_bits(values[i:i + step], width) for i in range(0, len(values), step))


def directory(words: np.ndarray) -> tuple[bytes, bytes]:
    """Set bits before each 512 bits, and from there before each word of 64."""
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))[:-1]]) if len(words) else np.zeros(0, np.int64)
    top = before[::8]
    return top.astype("<u4").tobytes(), (before - np.repeat(top, 8)[:len(before)]).astype("<u2").tobytes()


def write_file(run: int, part: int, docs: list[tuple[int | None, np.ndarray]], widths=WIDTHS) -> bytes:
    """One file of documents (id, token ids)."""
    ids = np.concatenate([t for _, t in docs]).astype(np.uint32) if docs else np.zeros(0, np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(t) for _, t in docs])]).astype("<u8")
    out = [struct.pack(HEADER, MAGIC, VERSION, len(widths), len(docs), run, part, len(ids)), padded(bytes(widths)),
           np.array([0 if d is None else d for d, _ in docs], "<i8").tobytes(),
           padded(bytes(d is None for d, _ in docs)), starts.tobytes()]
    for k, w in enumerate(widths):
        out += [struct.pack("<Q", len(ids)), padded(pack_chunks(ids & np.uint32((1 << w) - 1), w))]
        ids = ids >> np.uint32(w)
        if k + 1 < len(widths):
            more = ids > 0
            words = np.frombuffer(padded(np.packbits(more, bitorder="little").tobytes()), "<u8")
            out += [words.tobytes(), *map(padded, directory(words))]
            ids = ids[more]
    if ids.any():
        raise ValueError("ids do not fit the level widths")
    return b"".join(out) + b"\n"


class TokenFile:
    """Read access to one file's bytes."""

    def __init__(self, data: bytes):
        magic, version, levels, n_docs, self.run, self.part, self.n_tokens = struct.unpack_from(HEADER, data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file")
        at = HEADER_BYTES

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            a = np.frombuffer(data, dtype, n, at)
            at += a.nbytes + -a.nbytes % 8
            return a

        self.widths = take("u1", levels).tolist()
        ids, null = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, null, strict=True)]
        self.starts = take("<u8", n_docs + 1).astype(np.int64)
        self.levels = []
        for k, w in enumerate(self.widths):
            n = int(take("<u8", 1)[0])
            chunks = np.concatenate([take("u1", -(-n * w // 8)), np.zeros(4, np.uint8)])
            words = take("<u8", -(-n // 64)) if k + 1 < levels else None
            top = take("<u4", -(-len(words) // 8)) if words is not None else None
            low = take("<u2", len(words)) if words is not None else None
            self.levels.append((n, w, chunks, words, top, low))

    @staticmethod
    def chunk(chunks: np.ndarray, w: int, i: np.ndarray) -> np.ndarray:
        if w in (8, 16, 32):
            return chunks[:len(chunks) // (w // 8) * (w // 8)].view(f"<u{w // 8}")[i].astype(np.uint32)
        bit = i * w
        at, shift = bit >> 3, (bit & 7).astype(np.uint32)
        v = chunks[at].astype(np.uint32)
        for b in range(1, (w + 7 + 7) // 8):
            v |= chunks[at + b].astype(np.uint32) << np.uint32(8 * b)
        return (v >> shift) & np.uint32((1 << w) - 1)

    def tokens(self, i: np.ndarray) -> np.ndarray:
        """The tokens at places ``i`` (any order), each read directly."""
        i = np.asarray(i, np.int64)
        out, where, done = np.zeros(len(i), np.uint32), np.arange(len(i)), 0
        for _, w, chunks, words, top, low in self.levels:
            if not len(i):
                break
            out[where] |= self.chunk(chunks, w, i) << np.uint32(done)
            if words is None:
                break
            word, bit = words[i >> 6], (i & 63).astype(np.uint64)
            more = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            i = (top[i >> 9].astype(np.int64) + low[i >> 6] + below)[more]
            where, done = where[more], done + w
        return out

    def all_tokens(self) -> np.ndarray:
        """Every token in order, level by level."""
        out, where, done = np.zeros(self.n_tokens, np.uint32), None, 0
        for n, w, chunks, words, _, _ in self.levels:
            if not n:
                break
            for s in range(0, n, 1 << 18):
                i = np.arange(s, min(n, s + (1 << 18)), dtype=np.int64)
                part = self.chunk(chunks, w, i) << np.uint32(done)
                if done:
                    out[where[i]] |= part
                else:
                    out[s:s + len(i)] = part
            if words is None:
                break
            more = np.unpackbits(words.view(np.uint8), count=n, bitorder="little").view(bool)
            where = np.flatnonzero(more) if not done else where[more]
            done += w
        return out


def write_token_files(df: DataFrame, folder: str, vocab_path: str, end_id: int | None = 1, id_col: str = "doc_id",
                      text_col: str = "text", file_tokens: int = FILE_TOKENS, widths=WIDTHS, added_tokens: bool = False) -> None:
    """Encode whole texts and write them to ``folder`` in ascending id order (integer ids).

    One shuffle, of the compact ids, into runs of the id range; a file closes at
    the first document end beyond ``file_tokens`` tokens.  Spark's own writer commits
    the files, so lost tasks are repeated without leaving parts.
    """
    spark = df.sparkSession
    ship_package(spark)
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    runs = n_shuffle(spark)
    src = src.withColumn("run", run_of(F.col("id"), range_cuts(src, "id", runs)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = library_encoder(vocab_path, added_tokens)
        for b in batches:
            out = []
            for text in b.column(1):
                ids = np.frombuffer(to_ids(text.as_py()) + end, "<u4")
                small = not len(ids) or int(ids.max()) < 1 << 16
                out.append(ids.astype("<u2" if small else "<u4").tobytes() + (b"\2" if small else b"\4"))
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), pa.array(out, pa.binary())], ["run", "id", "ids"])

    ids = src.mapInArrow(encode, "run int, id long, ids binary")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, held, run, part = [], 0, None, 0
        for b in batches:
            for r, doc, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if docs and (r != run or held >= file_tokens):
                    yield pa.RecordBatch.from_arrays([pa.array([write_file(run, part, docs, widths)], pa.binary())], ["file"])
                    docs, held, part = [], 0, part + 1
                if r != run:
                    run, part = r, 0
                tokens = np.frombuffer(data[:-1], "<u2" if data[-1:] == b"\2" else "<u4")
                docs.append((doc, tokens))
                held += len(tokens)
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array([write_file(run, part, docs, widths)], pa.binary())], ["file"])

    files = (ids.repartitionById(runs, F.col("run")).sortWithinPartitions("run", F.col("id").asc_nulls_first(), "ids")
             .mapInArrow(build, "file binary"))
    files.select(F.col("file").cast("string")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(folder)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, run, part): every document, from the files alone."""
    ship_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).where("length > 1")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                f = TokenFile(data.as_py())
                raw, n = f.all_tokens().astype("<u4").tobytes(), len(f.doc_ids)
                crc = [zlib.crc32(raw[4 * s:4 * e]) for s, e in zip(f.starts[:-1].tolist(), f.starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f.doc_ids, pa.int64()), pa.array(f.starts[:-1]), pa.array(np.diff(f.starts)), pa.array(crc, pa.int64()),
                     pa.array(np.full(n, f.run, np.int64)), pa.array(np.full(n, f.part, np.int64))],
                    ["doc_id", "inner", "n_tokens", "ids_crc32", "run", "part"])

    docs = cut(files.select("content").mapInArrow(documents, "doc_id long, inner long, n_tokens long, ids_crc32 long, run long, part long"))
    # a row per file, a few bytes each, then one per run: there are as many runs as the writer had partitions
    parts = docs.groupBy("run", "part").agg(F.sum("n_tokens").alias("n"))
    runs = parts.groupBy("run").agg(F.sum("n").alias("n"))
    runs = runs.select("run", (F.sum("n").over(W.orderBy("run")) - F.col("n")).alias("before"))
    inner = parts.withColumn("inner", F.sum("n").over(W.partitionBy("run").orderBy("part")) - F.col("n"))
    base = inner.join(runs, "run").select("run", "part", (F.col("before") + F.col("inner")).alias("base"))
    return docs.join(base, ["run", "part"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens",
                                                   "ids_crc32", "run", "part")
