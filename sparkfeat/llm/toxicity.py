"""Operator 7: toxicity severity by cumulative-link ordinal regression.

Features are the hashed words of a text (presence). One weight vector is shared by ordered
thresholds: P(grade > k) = sigmoid(w·x − threshold_k). ``fit`` learns on a bounded sample of
labelled rows (``max_rows``, by a hash of the id): words whose share differs between the grades' two sides
are kept (a two-sample z test), then proximal gradient steps in numpy fit the weights (an L1 term
leaves them on the telling words only, which are refitted without it); ``predict`` scores every whole
text in bounded batches and gives the expected severity Σ P(grade > k).

The labels say only toxic or not. A toxic text's grade is the evidence against it from others: two
halves of the sample each learn toxic or not and score the other half, and the scores of the toxic texts are
cut at their terciles. So grade 0 is not toxic, 1 to 3 say how clearly a text reads as toxic to a model
that has not seen it; no word list or count enters. Rows with a null label or id teach nothing.

Defined results: null, empty and wordless texts get the severity of no words; very long texts are read
whole (presence of words, so length alone adds nothing); equal texts get equal results; without toxic
examples, or without others, severity is 0; of documents with one id the one of least text hash teaches, of
labels of one id the highest; repeated rows give repeated results; an empty table gives an empty
table; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfeat.llm import words
from sparkfeat.llm.common import id_text, map_batches, small_batches, texts_of

BUCKETS = 1 << 18
GRADES = 3                          # of toxic texts
MINORITY = 2.0                      # what a text of the rarer side counts
SCREEN_Z, SCREEN_TEXTS = 3.0, 3     # a word is looked at if its shares differ by so many deviations and so many texts have it
SCHEMA = "doc_id long, severity double, grade int, p_toxic double, toxic boolean"


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray


def sparse_rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct word buckets of each text one text after another, texts' first places)."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, counts = words.word_hashes(texts)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), counts)
    keys = np.unique(owner * BUCKETS + (h & np.uint64(BUCKETS - 1)).astype(np.int64))
    return keys % BUCKETS, np.searchsorted(keys, np.arange(len(texts)) * BUCKETS)


def _row_sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[np.append(firsts[1:], len(values))] - sums[firsts]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def screened(index: np.ndarray, owner: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Buckets whose share of texts differs between the two sides (0/1 per text)."""
    n1, n0 = side.sum(), (1 - side).sum()
    t, c = np.bincount(index, side[owner], BUCKETS), np.bincount(index, 1 - side[owner], BUCKETS)
    rate = (t + c) / (n1 + n0)
    spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / n1 + 1 / n0))
    return np.flatnonzero((np.abs(t / n1 - c / n0) > SCREEN_Z * spread) & (t + c >= SCREEN_TEXTS))


def _restricted(index: np.ndarray, firsts: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers within ``used`` of the entries that are in it, their rows, rows' first places)."""
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    owner = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(index))))
    keep = place[index] >= 0
    owner = owner[keep]
    return place[index[keep]], owner, np.searchsorted(owner, np.arange(len(firsts)))


def train_grades(index: np.ndarray, firsts: np.ndarray, grade: np.ndarray, steps: int = 300, l1: float = 1e-4) -> OrdinalModel:
    """Weights and thresholds from sparse rows (see ``sparse_rows``) of graded texts, both sides present. A text of the rarer
    side counts MINORITY times."""
    n, k = len(grade), max(1, int(grade.max()))
    over = (grade[:, None] > np.arange(k)).astype(np.float64)              # rows x thresholds
    owner = np.repeat(np.arange(n), np.diff(np.append(firsts, len(index))))
    used = screened(index, owner, over[:, 0])
    local, owner, begin = _restricted(index, firsts, used)
    rare = over[:, 0] == (over[:, 0].mean() < 0.5)
    weight = np.where(rare, MINORITY, 1.0)
    weight /= weight.sum()
    rate = np.clip(weight @ over, 1e-3, 1 - 1e-3)
    w, cut = np.zeros(len(used)), -np.log(rate / (1 - rate))
    w_sq, cut_sq = np.full(len(used), 1e-8), np.full(k, 1e-8)
    for i in range(2 * steps):                                              # Adagrad with an L1 proximal step;
        if i == steps:                                                      # then without it, on the words it left
            chosen, l1 = w != 0, 0.0
        g = gradient(w, cut, local, owner, begin, over, weight)
        w_sq += g[0] ** 2
        cut_sq += g[1] ** 2
        step = 0.3 / np.sqrt(w_sq)
        w = w - step * g[0]
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0) if l1 else np.where(chosen, w, 0)
        cut = np.maximum.accumulate(cut - 0.3 / np.sqrt(cut_sq) * g[1])      # thresholds stay ordered
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w
    return OrdinalModel(weights, cut)


def gradient(w: np.ndarray, cut: np.ndarray, local: np.ndarray, owner: np.ndarray, begin: np.ndarray, over: np.ndarray,
             weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the loss Σ_k log(1 + exp(∓(w·x − threshold_k))), averaged by the texts' weights, for weights and thresholds."""
    z = _row_sums(w[local], begin)[:, None] - cut
    g = (_sigmoid(z) - over) * weight[:, None]
    return np.bincount(local, g.sum(1)[owner], len(w)), -g.sum(0)


def evidence(index: np.ndarray, firsts: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Each text's score by a model of the other half (even against odd rows)."""
    n, out = len(toxic), np.zeros(len(toxic))
    ends = np.append(firsts[1:], len(index))
    for half in (0, 1):
        rows, others = np.arange(half, n, 2), np.arange(1 - half, n, 2)
        if not 0 < toxic[others].sum() < len(others):
            continue                                                         # nothing to learn from: no evidence
        size = ends[others] - firsts[others]
        own = np.concatenate([index[firsts[r]:ends[r]] for r in others]) if len(others) else index[:0]
        model = train_grades(own, np.cumsum(size) - size, toxic[others].astype(int))
        out[rows] = (_row_sums(model.weights[index], firsts) - model.thresholds[0])[rows]
    return out


def make_grades(scores: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """0 for texts that are not toxic, else 1 to GRADES by the terciles of the toxic texts' scores."""
    cuts = np.quantile(scores[toxic > 0], np.arange(1, GRADES) / GRADES)
    return np.where(toxic > 0, 1 + np.searchsorted(cuts, scores, side="left"), 0)


def train(index: np.ndarray, firsts: np.ndarray, toxic: np.ndarray) -> OrdinalModel | None:
    """Fits sparse rows (see ``sparse_rows``) with 0/1 labels; None if one label is missing."""
    toxic = np.asarray(toxic, np.float64)
    if not 0 < toxic.sum() < len(toxic):
        return None
    return train_grades(index, firsts, make_grades(evidence(index, firsts, toxic), toxic))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> OrdinalModel | None:
    """Learns from about ``max_rows`` labelled documents picked by a hash of the id."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where(
        "doc_id is not null and toxic is not null")
    n = known.count()
    draw = (F.xxhash64("doc_id", F.lit("toxicity")).bitwiseAND((1 << 30) - 1)) / float(1 << 30)
    few = known.where(draw < max_rows / max(n, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # the sampled ids have a proven bound, so they go to the documents instead of the other way
    rows = id_text(docs, id_col, text_col).join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic").agg(
        F.min_by("text", F.xxhash64("text")).alias("text"))                  # one text an id: the bound holds

    def features(batch: pa.RecordBatch) -> dict:
        index, firsts = sparse_rows(texts_of(batch))
        cut = np.append(firsts, len(index))
        return {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"),
                "index": pa.array([index[i:j].astype(np.int32).tobytes() for i, j in zip(cut, cut[1:])], pa.binary())}

    # half the rows learn the other half's grades: neighbours in a hash's order, so that ids make no halves
    got = map_batches(rows, features, "doc_id long, toxic int, index binary").sort(F.xxhash64("doc_id", F.lit("halves")), "doc_id").collect()
    if not got:
        return None
    parts = [np.frombuffer(r["index"], np.int32) for r in got]
    return train(np.concatenate(parts).astype(np.int64), np.cumsum([0] + [len(p) for p in parts])[:-1], np.array([r["toxic"] for r in got]))


def predict(docs: DataFrame, model: OrdinalModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, severity (expected grade), grade (the median one: over k if that has a
    probability of 0.5 or more), p_toxic (probability of a grade over 0), toxic (p_toxic of 0.5 or more)."""
    small_batches(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> dict:
        severity, grade, p = [], [], []
        for _, part in words.blocks(texts_of(batch)):
            over = np.zeros((len(part), 1))
            if model is not None:
                index, firsts = sparse_rows(part)
                over = _sigmoid(_row_sums(model.weights[index], firsts)[:, None] - model.thresholds)
            severity.append(over.sum(1))
            grade.append((over >= 0.5).sum(1).astype(np.int32))
            p.append(over[:, 0])
        p = np.concatenate(p)
        return {"doc_id": batch.column("doc_id"), "severity": pa.array(np.concatenate(severity)),
                "grade": pa.array(np.concatenate(grade)), "p_toxic": pa.array(p), "toxic": pa.array(p >= 0.5)}

    return map_batches(id_text(docs, id_col, text_col), work, SCHEMA)
