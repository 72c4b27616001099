"""Token ids in files of interleaved range asymmetric numeral system (rANS) blocks.

A file row is a segment of whole documents, at most about `segment` ids (a longer document makes a
longer segment of its own). A segment has one static frequency table; its blocks share the table and
decode independently. Each block starts with a checkpoint (the lane states) and carries a checksum.

Null and empty texts are documents of one end id; repeated rows are kept each on their own; null
doc_ids come first; equal doc_ids are ordered by the hash of their text; an empty table gives an
empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import release, rows, shared_dir
from .tokens import encoder, vocabulary, with_ends

SCALE = 16  # bits of the frequency table
LOW = np.uint64(1 << 32)  # a lane's state lies in [2**32, 2**48) and moves 16 bits at a time
WORD = np.uint64(16)
BLOCK, LANES = 1 << 19, 2048
MAGIC = b"RSG1"
SEGMENT = "part int, seg int, n_tokens long, doc_ids array<long>, doc_tokens array<int>, payload binary"


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and their frequencies, at least 1 each, 2**SCALE in sum."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols]
    freq = np.maximum(1, counts * (1 << SCALE) // counts.sum())
    short = (1 << SCALE) - int(freq.sum())
    for i in np.argsort(-freq, kind="stable"):
        if short >= 0:
            freq[i] += short
            break
        less = min(-short, int(freq[i]) - 1)
        freq[i] -= less
        short += less
    return symbols, freq


def encode_block(code: np.ndarray, freq: np.ndarray, cum: np.ndarray) -> bytes:
    """code: indices into the table. Steps run backwards, so that decoding runs forwards."""
    lanes = max(1, min(LANES, len(code) // 256))
    x, out = np.full(lanes, LOW), []
    for t in range((len(code) - 1) // lanes, -1, -1):
        s = code[t * lanes : (t + 1) * lanes]
        f, head = freq[s], x[: len(s)]
        full = head >= f << np.uint64(32)
        out.append(head[full].astype("<u2"))
        head = np.where(full, head >> WORD, head)
        q = (head / f.astype(np.float64)).astype(np.uint64)  # exact: below 2**32, and apart from the next whole number by 2**-16 or more
        x[: len(s)] = (q << np.uint64(SCALE)) + (head - q * f) + cum[s]
    body = np.concatenate(out[::-1]).tobytes() if out else b""
    data = struct.pack("<II", len(code), lanes) + x.astype("<u8").tobytes() + body
    return struct.pack("<II", len(data), zlib.crc32(data)) + data


def decode_block(data: bytes, freq: np.ndarray, cum: np.ndarray, slots: np.ndarray) -> np.ndarray:
    n, lanes = struct.unpack_from("<II", data)
    x = np.frombuffer(data, "<u8", lanes, 8).astype(np.uint64)
    words = np.frombuffer(data, "<u2", offset=8 + 8 * lanes).astype(np.uint64)
    code, at, mask = np.empty(n, slots.dtype), 0, np.uint64((1 << SCALE) - 1)
    for t in range(0, n, lanes):
        head = x[: min(lanes, n - t)]
        slot = head & mask
        s = slots[slot]
        code[t : t + len(head)] = s
        head = freq[s] * (head >> np.uint64(SCALE)) + slot - cum[s]
        low = np.flatnonzero(head < LOW)
        head[low] = (head[low] << WORD) | words[at : at + len(low)]
        at += len(low)
        x[: len(head)] = head
    return code


def pack_segment(ids: np.ndarray) -> bytes:
    symbols, freq = frequencies(ids)
    index = np.zeros(int(symbols[-1]) + 1, np.int64)
    index[symbols] = np.arange(len(symbols))
    f = freq.astype(np.uint64)
    cum = np.cumsum(f) - f
    code = index[ids]
    head = zlib.compress(np.diff(symbols.astype("<u4"), prepend=0).astype("<u4").tobytes() + (freq - 1).astype("<u2").tobytes(), 6)
    blocks = [encode_block(code[i : i + BLOCK], f, cum) for i in range(0, len(code), BLOCK)]
    return MAGIC + struct.pack("<III", len(symbols), len(head), len(blocks)) + head + b"".join(blocks)


def unpack_segment(payload: bytes) -> np.ndarray:
    if payload[:4] != MAGIC:
        raise ValueError("not a segment")
    n, size, blocks = struct.unpack_from("<III", payload, 4)
    head = zlib.decompress(payload[16 : 16 + size])
    symbols = np.cumsum(np.frombuffer(head, "<u4", n)).astype(np.uint32)
    f = np.frombuffer(head, "<u2", n, 4 * n).astype(np.uint64) + np.uint64(1)
    cum, slots = np.cumsum(f) - f, np.repeat(np.arange(n), f.astype(np.int64))
    at, out = 16 + size, []
    for _ in range(blocks):
        length, crc = struct.unpack_from("<II", payload, at)
        data = payload[at + 8 : at + 8 + length]
        if zlib.crc32(data) != crc:
            raise ValueError("a block's checksum differs")
        out.append(symbols[decode_block(data, f, cum, slots)])
        at += 8 + length
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def write_tokens(docs: DataFrame, to: str, path: str | None = None, end_id: int = 2, segment: int = 1 << 20) -> None:
    """Encode doc_id, text and write segments below the folder `to` in ascending doc_id order."""
    path = path or vocabulary()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, part, seg = encoder(path), TaskContext.get().partitionId(), 0
        schema = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int32())), ("payload", pa.binary())])
        held, names, n = [], [], 0

        def flush():
            nonlocal held, names, n, seg
            row = [part, seg, n, names, [len(x) for x in held], pack_segment(np.concatenate(held))]
            held, names, n, seg = [], [], 0, seg + 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types, strict=True)], schema=schema)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for i, ids, sizes in enc.column(batch.column(1)):
                whole, ends = with_ends(ids, sizes, end_id)
                for k, (a, b) in enumerate(zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True)):
                    if held and n + b - a > segment:
                        yield flush()
                    held.append(whole[a:b])
                    names.append(doc_ids[i + k])
                    n += b - a
            release()
        if held:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(run, SEGMENT).write.parquet(to)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """part, seg, nth, doc_id, start, ids for each document; start counts the ids of all documents before it."""
    files = spark.read.schema(SEGMENT).parquet(path)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, seg, _, doc_ids, doc_tokens, payload in rows(batch):
                ids = unpack_segment(payload)
                ends = np.cumsum(doc_tokens)
                crc = [zlib.crc32(ids[e - n : e].astype("<u4").tobytes()) for e, n in zip(ends, doc_tokens, strict=True)]
                k = len(doc_ids)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, part, np.int32)), pa.array(np.full(k, seg, np.int32)), pa.array(doc_ids, pa.int64()), pa.array(ends - doc_tokens), pa.array(np.array(doc_tokens, np.int64)), pa.array(np.array(crc, np.int64))], names=["part", "seg", "doc_id", "inside", "n_tokens", "ids_crc32"])

    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each file
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("part_start"))
    segs = files.select("part", "seg", F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("part").orderBy("seg"))), F.lit(0)).alias("seg_start"))
    base = segs.join(parts, "part").select("part", "seg", (F.col("seg_start") + F.col("part_start")).alias("base"))
    docs = files.mapInArrow(run, "part int, seg int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return docs.join(base, ["part", "seg"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write docs in the file format, read the files back: doc_id, start, n_tokens, ids_crc32."""
    to = shared_dir(docs.sparkSession)
    write_tokens(docs, to, path)
    return read_tokens(docs.sparkSession, to)
