"""Hard negatives by exact integer products of anchor and candidate tiles.

Scores are inner products of integer vectors. Anchors and candidates are dealt into groups and slices
of bounded size; one task multiplies one group with one slice, tile by tile, by Strassen's recursion,
and keeps fixed-size heaps per anchor: first the best rows of the anchor's label (positives), then, with
their scores known, the best rows of other labels within each positive's window. Heaps of the slices
merge in Spark by a ranked window, which trims before it shuffles. Anchors against all rows is the query
itself; nothing is pruned.

Defined results: rows take no part if their id or label is null, or their vector is null, has a null,
non-finite or too large component or another length than most (``vectors.integer_vectors``). Rows
of equal score go by id, then by a hash of label and vector; rows that repeat are rows of their own, and an
anchor is never its own positive. Anchors without positives and positives without negatives in their
window give no rows; an empty table gives an empty result. Further columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkfeat.llm.common import partitions, stored
from sparkfeat.llm.vectors import integer_vectors, matrix

LEAF = 32
LOWEST = np.iinfo(np.int64).min


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact product of int64 matrices; through doubles where every partial sum is below 2^53."""
    if int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64 matrices with seven products of halves a level, down to ``leaf`` in the smallest
    dimension; odd dimensions are padded with a zero. All additions are of int64, exact modulo 2^64, so the
    result is exact wherever it fits."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return _leaf(a, b)
    if m % 2 or k % 2 or n % 2:
        a, b = np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2)))
        return strassen(a, b, leaf)[:m, :n]
    h, i, j = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((m, n), np.int64)
    out[:h, :j] = p1 + p4 - p5 + p7
    out[:h, j:] = p3 + p5
    out[h:, :j] = p2 + p4
    out[h:, j:] = p1 - p2 + p3 + p6
    return out


class Heaps:
    """The best ``k`` (score, place) of each of ``n`` rows: higher scores first, then smaller places. Absent
    entries have place -1. Two heaps of the same rows merge; places must grow from tile to tile."""

    def __init__(self, n: int, k: int):
        self.score, self.place = np.full((n, k), LOWEST), np.full((n, k), -1)

    def merge(self, score: np.ndarray, place: np.ndarray) -> None:
        """Takes in entries (rows x any number), absent ones with place -1."""
        k = self.score.shape[1]
        score, place = np.concatenate([self.score, score], 1), np.concatenate([self.place, place], 1)
        order = np.lexsort((place, ~score, place < 0))[:, :k]         # ~score falls as score rises
        self.score[:], self.place[:] = np.take_along_axis(score, order, 1), np.take_along_axis(place, order, 1)

    def of(self, rows: slice) -> Heaps:
        """The heaps of some rows; what they take in stays here."""
        part = Heaps(0, self.score.shape[1])
        part.score, part.place = self.score[rows], self.place[rows]
        return part

    def offer(self, scores: np.ndarray, allowed: np.ndarray, first: int) -> None:
        """A tile's scores; column j is place ``first`` + j."""
        k = min(self.score.shape[1], scores.shape[1])
        # nothing below an anchor's last entry can enter: the tile's rest is settled by one comparison
        allowed = allowed & ((scores > self.score[:, -1:]) | (self.place[:, -1:] < 0))
        rows = np.flatnonzero(allowed.any(1))
        if not len(rows):
            return
        s = np.where(allowed[rows], scores[rows], LOWEST)
        # the k-th best score of a row; of the scores equal to it, the first places fill up
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
        above, equal = s > kth, (s == kth) & allowed[rows]
        keep = above | (equal & (np.cumsum(equal, 1) <= k - above.sum(1, keepdims=True)))
        score, place = np.full((len(self.score), k), LOWEST), np.full((len(self.score), k), -1)
        r, c = np.nonzero(keep)
        at = (np.cumsum(keep, 1) - 1)[r, c]
        score[rows[r], at], place[rows[r], at] = s[r, c], c + first
        self.merge(score, place)


#: Fewer candidates are not worth a slice: each slice sends its own heaps of every anchor.
LEAST_SLICE = 512


def _dealt(rows: DataFrame, anchors: DataFrame, group_rows: int, slice_rows: int) -> tuple[DataFrame, DataFrame]:
    """Candidates with ``slice`` in every group, anchors with ``group`` in every slice."""
    n, a = rows.count(), anchors.count()
    slices = max(math.ceil(n / slice_rows), min(partitions(rows.sparkSession), math.ceil(n / LEAST_SLICE)), 1)
    groups = max(math.ceil(a / group_rows), 1)
    rows = (rows.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int"))
            .withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))))
    anchors = (anchors.withColumn("group", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(groups)).cast("int"))
               .withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))))
    return rows, anchors


def _tiles(candidates: pa.Table, anchors: pa.Table, dims: int, tile: tuple[int, int]):
    """(candidates in their order of ties, tiles): (anchors' slice, first candidate, scores, candidates'
    labels) of each tile."""
    candidates = candidates.sort_by([("vec_id", "ascending"), ("tie", "ascending"), ("row", "ascending")])
    x, y = matrix(candidates.column("x"), dims), matrix(anchors.column("x"), dims)

    def tiles() -> Iterator[tuple[slice, int, np.ndarray]]:
        for i in range(0, len(y), tile[0]):
            for j in range(0, len(x), tile[1]):
                yield slice(i, min(i + tile[0], len(y))), j, strassen(y[i:i + tile[0]], x[j:j + tile[1]].T)
    return candidates, tiles()


def _entries(heaps: Heaps, candidates: pa.Table) -> tuple[np.ndarray, dict]:
    """(the anchor of each entry, the entries' columns)."""
    r, c = np.nonzero(heaps.place >= 0)
    at = pa.array(heaps.place[r, c])
    return r, {"score": heaps.score[r, c], "other_id": candidates.column("vec_id").take(at),
               "other_tie": candidates.column("tie").take(at), "other": candidates.column("row").take(at)}


def _ranked(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k per key of the slices' entries."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "other_id", "other_tie", "other")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(df: DataFrame, anchor: Column, *, label: Column | None = None, positives: int = 5, negatives: int = 10,
         low: int = 30, high: int = 90, scale: float = 256, id_col: str = "vec_id", vec_col: str = "embedding",
         label_col: str = "label", group_rows: int = 4096, slice_rows: int = 65_536,
         tile: tuple[int, int] = (512, 4096)) -> DataFrame:
    """For every row where ``anchor`` (a condition on the input) holds and each of its first ``positives`` rows of
    the same label, the first ``negatives`` rows of other labels whose score is between ``low`` and
    ``high`` hundredths of the positive's: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score. ``label`` replaces the label column."""
    # 100 * score must fit 64 bits whatever the vectors: at most 4096 dimensions of 2^21
    given = label if label is not None else F.col(label_col)
    rows, dims = integer_vectors(df, id_col=id_col, vec_col=vec_col, scale=scale, limit=2**21,
                                 label=given.cast("long"), anchor=F.coalesce(anchor, F.lit(False)))
    rows = rows.where("label is not null and vec_id is not null")
    rows = stored(rows.withColumn("tie", F.xxhash64("label", "x")).withColumn("row", F.monotonically_increasing_id()), "candidates")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not dims:
        return df.sparkSession.createDataFrame([], schema)

    def best_positives(group: pa.Table, others: pa.Table) -> pa.Table:
        found, tiles = _tiles(others, group, dims, tile)
        labels, own = found.column("label").to_numpy(), group.column("label").to_numpy()
        ids, own_ids = found.column("row").to_numpy(), group.column("row").to_numpy()
        heaps = Heaps(len(own), positives)
        for part, j, scores in tiles:
            cols = slice(j, j + scores.shape[1])
            heaps.of(part).offer(scores, (labels[cols] == own[part, None]) & (ids[cols] != own_ids[part, None]), j)
        r, entries = _entries(heaps, found)
        return pa.table({"row": own_ids[r], **entries})

    anchors = rows.where("anchor").select("row", "vec_id", "label", "x")
    by_slice, by_group = _dealt(rows.select("row", "vec_id", "tie", "label", "x"), anchors, group_rows, slice_rows)
    found = (by_group.groupBy("group", "slice").cogroup(by_slice.groupBy("group", "slice"))
             .applyInArrow(best_positives, "row long, score long, other_id long, other_tie long, other long"))
    pairs = _ranked(found, ["row"], positives).select("row", F.struct("rank", "other_id", "score").alias("positive"))
    # at most ``positives`` entries an anchor
    chosen = stored(anchors.join(pairs.groupBy("row").agg(F.sort_array(F.collect_list("positive")).alias("positives")), "row"), "positives")

    def best_negatives(group: pa.Table, others: pa.Table) -> pa.Table:
        found, tiles = _tiles(others, group, dims, tile)
        labels, own = found.column("label").to_numpy(), group.column("label").to_numpy()
        ids = group.column("row").to_numpy()
        pos = np.full((len(own), positives), LOWEST)
        for i, ps in enumerate(group.column("positives").to_pylist()):
            pos[i, :len(ps)] = [p["score"] for p in ps]
        known = pos != LOWEST
        heaps = [Heaps(len(own), negatives) for _ in range(positives)]
        for part, j, scores in tiles:
            differs, hundred = labels[j:j + scores.shape[1]] != own[part, None], 100 * scores
            for q, h in enumerate(heaps):
                p = np.where(known[part, q], pos[part, q], 0)[:, None]
                allowed = differs & (low * p <= hundred) & (hundred <= high * p) & known[part, q, None]
                h.of(part).offer(scores, allowed, j)
        out = []
        for q, h in enumerate(heaps):
            r, entries = _entries(h, found)
            out.append(pa.table({"row": ids[r], "place": np.full(len(r), q, np.int32), **entries}))
        return pa.concat_tables(out)

    by_slice, by_group = _dealt(rows.select("row", "vec_id", "tie", "label", "x"), chosen, group_rows, slice_rows)
    found = (by_group.groupBy("group", "slice").cogroup(by_slice.groupBy("group", "slice"))
             .applyInArrow(best_negatives, "row long, place int, score long, other_id long, other_tie long, other long"))
    best = _ranked(found, ["row", "place"], negatives)
    who = chosen.select("row", F.col("vec_id").alias("anchor_id"), F.posexplode("positives").alias("place", "positive"))
    return (best.join(who, ["row", "place"])
            .select("anchor_id", F.col("positive.other_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                    F.col("other_id").alias("negative_id"), F.col("positive.score").alias("positive_score"),
                    F.col("score").alias("negative_score")))


#: The query of operator 12 in DuckDB.
MINE_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other,
         CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (
  SELECT p.anchor_id, p.positive_id, s.other AS negative_id, p.positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
   AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
