"""Operator 5: document fingerprints by locally consistent parsing.

``sketches`` parses every text level by level. On each level runs of one symbol become one
symbol; deterministic coin tossing (each symbol against the one before it: the lowest bit in
which they differ, and its value, three times over) turns the symbols into labels below 8
whose local minima start phrases; a phrase's name is a hash of its symbols and is a symbol of
the next level. Where a phrase starts depends on a few symbols around it only, so equal
substrings get equal names inside, wherever they stand. The fingerprint is a MinHash sketch of
the names of the upper levels (about ten characters and up) and of the root.

``compare_with_next`` puts the documents in the order of their ids to compare each with its
successor and with an edited text. The order comes from one range shuffle: cut points are
quantiles of the ids, and the first document of each range is also sent, as a sentinel, to the
range before it (one id per range goes through the driver). Tasks stream their sorted range.

Defined results: a null text counts as empty; empty texts share one fingerprint and are
alike to 1, unlike any other text to 0; a null id comes before all others, rows of equal ids are
ordered by text; a single document is its own successor; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfeat.llm import words
from sparkfeat.llm.common import id_text, mix64, partitions, range_parts, small_batches

WIDTH, LOWEST, TOSSES = 64, 2, 3
SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
NO_ID = -(1 << 63)


def _next_level(symbols: np.ndarray, owner: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of one level: their names and texts."""
    first = np.concatenate([[True], owner[1:] != owner[:-1]])
    # runs of one symbol become one symbol
    at = np.flatnonzero(first | np.concatenate([[True], symbols[1:] != symbols[:-1]]))
    run = np.diff(np.append(at, len(symbols))).astype(np.uint64)
    s, owner, first = symbols[at], owner[at], first[at]
    s = np.where(run > 1, mix64(s ^ (run * np.uint64(words.BASE)), 90), s)
    label = s
    for _ in range(TOSSES):
        differ = label ^ np.concatenate([label[:1], label[:-1]])
        differ[first] = 1
        low = differ & (~differ + np.uint64(1))
        place = np.bitwise_count(low - np.uint64(1)).astype(np.uint64)
        label = place * np.uint64(2) + ((label >> place) & np.uint64(1))
    last = np.concatenate([first[1:], [True]])
    before, after = np.concatenate([label[:1], label[:-1]]), np.concatenate([label[1:], label[-1:]])
    starts = np.flatnonzero(first | ((label < before) & (label < after) & ~last))
    names = words.span_hashes(s, starts, np.append(starts[1:], len(s)))
    return mix64(names, 100 + level), owner[starts]


def phrase_names(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases from level LOWEST up, the root always among them, and their texts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols, owner = mix64(cps, 80), np.repeat(np.arange(len(texts)), sizes)
    names, owners, level = [], [], 0
    while len(symbols):
        level += 1
        symbols, owner = _next_level(symbols, owner, level)
        count = np.bincount(owner, minlength=len(texts))[owner]
        use = (count == 1) | (level >= LOWEST)
        names.append(symbols[use])
        owners.append(owner[use])
        more = count > 1
        symbols, owner = symbols[more], owner[more]
    if not names:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(names)[order], owner[order]


def sketches(texts: list[str]) -> np.ndarray:
    """One row of WIDTH 16-bit values per text; all zero for an empty text."""
    out = np.zeros((len(texts), WIDTH), np.uint16)
    for first, part in words.blocks(texts):
        names, owner = phrase_names(part)
        if not len(names):
            continue
        at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        factors = mix64(np.arange(WIDTH), 70) | np.uint64(1)
        for k in range(WIDTH):
            least = np.minimum.reduceat(mix32(names * factors[k]), at)
            out[first + owner[at], k] = (mix64(least, k) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
    return out


def mix32(x: np.ndarray) -> np.ndarray:
    """A cheap order for MinHash: the high half of a product, folded."""
    return (x ^ (x >> np.uint64(31))) * np.uint64(words.BASE) >> np.uint64(16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(1)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: see the module text and SCHEMA. The edited text has its last
    floor(n_chars / 2) code points replaced by the first as many of the next document."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = id_text(docs, id_col, text_col).withColumn("place", F.coalesce("doc_id", F.lit(NO_ID)))
    part_of, n_parts = range_parts(rows, "place", partitions(spark))
    firsts = rows.select("place", part_of("place").alias("part")).groupBy("part").agg(F.min("place").alias("place")).sort("part").collect()
    before = [(r.place, firsts[i - 1].part) for i, r in enumerate(firsts)]          # one row per range
    sentinel = spark.createDataFrame(before, "place long, before int")
    dealt = rows.join(F.broadcast(sentinel), "place", "left").withColumn("part", part_of("place"))
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("late"))
    also = F.struct(F.col("before").alias("part"), F.lit(1).alias("late"))
    dealt = dealt.withColumn("to", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, also))))
    ranged = (dealt.select("to.part", "to.late", "place", "doc_id", "text").repartitionById(n_parts, F.col("part"))
              .sortWithinPartitions("part", "late", "place", "text").select("late", "doc_id", "text"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_id, held_text, held_sketch = [], [], np.zeros((0, WIDTH), np.uint16)
        ended = False
        for b in batches:
            late = b.column("late").to_pylist()
            if ended or not late:
                continue
            n = late.index(1) if 1 in late else len(late)       # of the late rows the first one counts
            ended = n < len(late)
            n = min(n + 1, len(late))
            texts, ids = b.column("text").slice(0, n).to_pylist(), b.column("doc_id").slice(0, n).to_pylist()
            ids, all_texts = held_id + ids, held_text + texts
            sketch = np.concatenate([held_sketch, sketches(texts)])
            if len(ids) > 1:
                yield _rows(ids[:-1], all_texts, sketch)
            held_id, held_text, held_sketch = ids[-1:], all_texts[-1:], sketch[-1:]

    return ranged.mapInArrow(compare, SCHEMA)


def _rows(ids: list, texts: list[str], sketch: np.ndarray) -> pa.RecordBatch:
    """Rows of all but the last text, which is a successor only."""
    edited = [t[:len(t) - len(t) // 2] + u[:len(t) // 2] for t, u in zip(texts, texts[1:])]
    other = sketches(edited)
    text = lambda rows: pa.array([r.astype(">u2").tobytes().hex() for r in rows], pa.string())
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(ids, pa.int64()), "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
        "fingerprint": text(sketch[:-1]), "edited_fingerprint": text(other),
        "near_edited": pa.array(likeness(sketch[:-1], other)), "near_next": pa.array(likeness(sketch[:-1], sketch[1:]))})
