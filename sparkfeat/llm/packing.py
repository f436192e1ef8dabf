"""Operator 1: packing in the order of a space-filling curve.

``pack`` tokenizes every whole text, projects its hashed token vector to a few dimensions,
gives it a Hilbert key, and lays all documents one after another along the curve: a document's
place is the number of ids before it, so pieces, sequences and offsets follow by division and
only the very last sequence can need padding.

Steps: (1) one map over the documents writes key and ids to the shared scratch folder;
(2) cut points along the curve come from quantiles of the keys, and one aggregate gives the
ids in each range (one number per range goes through the driver); (3) one shuffle brings each
range together, sorted, and each task cuts its documents from its range's first place.
Equal keys (copies) are spread by a hash of the document's row, so no key is hot.

Defined results: a null or empty text is the end id alone; repeated rows and null ids are
packed like others; an empty table gives no pieces; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfeat.llm import bpe
from sparkfeat.llm.common import id_text, mix64, partitions, range_parts, release_memory, small_batches, stored, texts_of
from sparkfeat.llm.words import blocks

HASHED, DIMS, BITS, SALT_BITS = 8, 3, 15, 17
#: Ids that are summed, and characters that are encoded, at a time.
BLOCK, CHARS = 1 << 18, 1 << 20
TOKENIZED = "doc_id long, place long, n long, ids binary"
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


def hilbert_key(axes: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of rows of unsigned coordinates below 2**bits.

    Works from the highest bit down: each level's orthant is undone by exchanging or
    reflecting the lower bits of the axes, then the levels are Gray-decoded."""
    x = axes.astype(np.int64).T.copy()
    d = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(d):
            hit = (x[i] >> level) & 1 == 1
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(hit, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def document_points(ids: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Signed hashed token sums in HASHED dimensions, scaled to length 1, of which the first
    DIMS become coordinates of BITS bits."""
    sign = mix64(np.arange(size), 7)
    hashed, ends = np.zeros((len(counts), HASHED)), np.cumsum(counts)
    for i in range(0, len(ids), BLOCK):                              # a long text spans several blocks
        part = ids[i:i + BLOCK]
        owner = np.searchsorted(ends, np.arange(i, i + len(part)), side="right")
        first = owner[0]
        for k in range(HASHED):
            own = (((sign >> np.uint64(k)) & np.uint64(1)).astype(np.float32) * 2 - 1)[part]
            hashed[first:owner[-1] + 1, k] += np.bincount(owner - first, own)
    norm = np.sqrt((hashed ** 2).sum(1))
    unit = hashed[:, :DIMS] / np.where(norm > 0, norm, 1)[:, None]
    return np.clip(((unit + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)


def tokenized(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    def work(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        ids, counts = bpe.encode(path, texts)
        points = document_points(ids, counts, bpe.machine(path).size)
        salt = mix64(batch.column("row").to_numpy(), 3) >> np.uint64(64 - SALT_BITS)
        key = (hilbert_key(points, BITS) << SALT_BITS) | salt.astype(np.int64)
        n = counts + 1
        at = np.cumsum(n)
        whole = np.empty(int(at[-1]), np.uint16 if bpe.machine(path).size <= 1 << 16 else np.uint32)
        ends = at - 1
        inner = np.ones(len(whole), bool)
        inner[ends] = False
        whole[inner], whole[ends] = ids, end_id
        cuts = np.concatenate([[0], at]) * whole.itemsize
        raw = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(whole)])
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "place": pa.array(key), "n": pa.array(n), "ids": raw.cast(pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in blocks(texts_of(b), CHARS):          # a batch is larger than its blocks
                yield work(b.slice(first, len(texts)), texts)
        release_memory()

    own = id_text(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    return own.mapInArrow(run, TOKENIZED)


def pack(docs: DataFrame, path: str, seq_len: int = 1024, end_id: int = 0, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start (the document's ids before it), length, ids_crc32,
    doc_tokens, sequence_id, offset; with ``with_ids`` also ids: the piece's ids as
    little-endian unsigned 32-bit numbers."""
    spark = docs.sparkSession
    small_batches(spark, mb=4)
    table = stored(tokenized(docs, path, end_id, id_col, text_col), "pack-ids")
    part_of, n_parts = range_parts(table, "place", partitions(spark))

    sums = np.zeros(n_parts, np.int64)
    for r in table.select(part_of("place").alias("part"), "n").groupBy("part").agg(F.sum("n").alias("n")).collect():
        sums[r["part"]] = r["n"]                     # one row per range
    first = np.cumsum(sums) - sums
    kind = np.uint16 if bpe.machine(path).size <= 1 << 16 else np.uint32

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = -1, 0
        for b in batches:
            rows, pieces = zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "n"))), []
            for (p, doc, n), blob in zip(rows, b.column("ids")):
                if p != part:
                    part, at = p, int(first[p])
                ids = np.frombuffer(blob.as_buffer(), kind).astype("<u4").data
                done = 0
                while done < n:
                    size = min(n - done, seq_len - at % seq_len)
                    own = ids[done:done + size]
                    pieces.append((doc, done, size, zlib.crc32(own), n, at // seq_len, at % seq_len,
                                   *([own.tobytes()] if with_ids else [])))
                    done, at = done + size, at + size
            if pieces:
                names = [f.split()[0] for f in PIECES.split(", ")] + ["ids"] * with_ids
                kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*pieces), kinds)], names)
        release_memory()

    ranged = (table.withColumn("part", part_of("place")).repartitionById(n_parts, F.col("part"))
              .sortWithinPartitions("part", "place", "doc_id").select("part", "doc_id", "n", "ids"))
    return ranged.mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))
