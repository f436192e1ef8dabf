"""Operator 4: language identification by averaged hashed subword embeddings.

``train`` fits, on a bounded sample of labelled documents, hashed embeddings of character
n-grams whose average feeds a linear softmax; numpy stochastic gradient descent on the driver.
A part of the sample is kept back: on it a temperature is fitted (so that scores are
probabilities) and a rejection threshold: the score under which no more than ``reject_rate`` of
the kept-back documents fall. ``predict`` folds embeddings and softmax into one table of logits per n-gram
bucket and averages it over every whole text, in bounded batches; no shuffle.

The sample: about ``per_lang`` labelled documents a language, picked by a hash of the id, and
of each a window of at most ``window`` characters. It bounds only what is learned from.

Defined results: a null text or one without a letter is ``und`` with score 0 and rejected;
without any labelled document every text is ``und``; documents with null ids are predicted, not
learned from; repeated rows give repeated results; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfeat.llm import words
from sparkfeat.llm.common import id_text, map_batches, small_batches, texts_of

BUCKETS, DIM, ORDERS = 1 << 15, 16, (2, 3, 4)
UND = "und"
MAX_LANGS = 200                  # learned at most: rows of rarer values of a dirty column teach nothing
SCHEMA = "doc_id long, lang_pred string, score double, rejected boolean"


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray            # logits per n-gram bucket, temperature applied
    bias: np.ndarray
    threshold: float


def gram_buckets(cps: np.ndarray) -> np.ndarray:
    """Bucket of the n-gram that starts at each character, one row per order; n-grams that
    run over the array's end wrap (texts end in a separator)."""
    out = np.empty((len(ORDERS), len(cps)), np.int32)
    h = np.zeros(len(cps), np.uint32)
    k = 0
    for n in range(max(ORDERS)):
        h = h * np.uint32(0x01000193) + np.roll(cps, -n)
        if n + 1 in ORDERS:
            x = h * np.uint32(0x85EBCA6B + 2 * n)
            out[k] = (x ^ (x >> np.uint32(15))) & np.uint32(BUCKETS - 1)
            k += 1
    return out


def _features(texts: list[str]) -> list[np.ndarray]:
    out = []
    for t in texts:
        cps, _, _ = words.code_points([t.lower()])
        out.append(gram_buckets(cps).ravel())
    return out


def train(texts: list[str], langs: list[str], window: int = 500, epochs: int = 4, rate: float = 0.5,
          reject_rate: float = 0.0005, seed: int = 7) -> LanguageModel:
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    size = np.minimum(window, rng.choice([60, 200, window], len(texts)))
    cut = [t[(a := int(rng.integers(0, max(1, len(t) - n + 1)))):a + n] for t, n in zip(texts, size)]
    grams = _features(cut)
    fold = rng.random(len(texts)) < 0.2
    fit = np.flatnonzero(~fold) if (~fold).any() else np.arange(len(texts))
    emb = (rng.standard_normal((BUCKETS, DIM)) / DIM).astype(np.float32)
    out, bias = np.zeros((DIM, len(names)), np.float32), np.zeros(len(names), np.float32)
    share = np.bincount(y[fit], minlength=len(names))
    weight = share.mean() / np.maximum(share, 1)
    for e in range(epochs):
        step = rate * (1 - e / epochs)
        for i in rng.permutation(fit):
            g = grams[i]
            h = emb[g].mean(0)
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= step * weight[y[i]]
            back = (out @ p) * (len(ORDERS) * 20 / len(g))
            out -= np.outer(h, p).astype(np.float32)
            bias -= p.astype(np.float32)
            emb[g] -= back.astype(np.float32)
    table = (emb @ out).astype(np.float64)
    held = np.flatnonzero(fold) if fold.any() else fit
    logits = np.stack([table[grams[i]].mean(0) + bias for i in held])
    temps = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(held)), y[held]], 1e-12)).mean() for t in temps]
    t = temps[int(np.argmin(loss))]
    top = _softmax(logits / t).max(1)
    return LanguageModel(names, (table / t).astype(np.float32), (bias / t).astype(np.float32),
                         float(min(np.quantile(top, reject_rate), 0.5)))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def labelled_sample(docs: DataFrame, learn_from: Column | bool, per_lang: int, chars: int, id_col: str,
                    text_col: str, lang_col: str) -> list:
    """About ``per_lang`` rows of each of the MAX_LANGS most frequent languages, by a hash of the id; of a text, at most
    ``chars`` characters from a hashed place."""
    rows = docs.where(F.lit(True) if learn_from is True else learn_from).where(
        F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    count = {r[0]: r[1] for r in rows.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(MAX_LANGS).collect()}
    if not count:
        return []
    draw = (F.xxhash64(F.col(id_col).cast("string"), F.lit("language")).bitwiseAND((1 << 30) - 1)) / float(1 << 30)
    # a language that is not learned has no share
    keep = F.create_map(*(F.lit(x) for k, n in count.items() for x in (k, min(1.0, per_lang / n))))
    at = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("place")), F.greatest(F.length(text_col) - chars, F.lit(0)) + 1).cast("int") + 1
    return rows.where(draw < keep[F.col(lang_col)]).select(
        F.col(id_col).alias("i"), F.substring(F.col(text_col), at, F.lit(chars)).alias("t"), F.col(lang_col).alias("l")
    ).sort("i", "t").collect()                                                     # about per_lang x languages rows


def fit(docs: DataFrame, learn_from: Column | bool = True, per_lang: int = 1500, window: int = 500,
        id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    rows = labelled_sample(docs, learn_from, per_lang, 2 * window, id_col, text_col, lang_col)
    rows = [r for r in rows if words.letter_table()[words.code_points([r.t])[0]].any()]
    return train([r.t for r in rows], [r.l for r in rows], window) if rows else None


def predict_batch(model: LanguageModel | None, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    names, scores = [], []
    for _, part in words.blocks(texts):
        cps, firsts, ends = words.code_points([t.lower() for t in part])
        known = np.maximum.reduceat(words.letter_table()[cps].view(np.uint8), firsts).astype(bool)
        if model is None:
            known[:] = False
            p = np.zeros((len(part), 1))
        else:
            total = sum(np.add.reduceat(model.table[g], firsts, axis=0, dtype=np.float64) for g in gram_buckets(cps))
            p = _softmax(total / ((ends - firsts + 1) * len(ORDERS))[:, None] + model.bias)
        top = p.argmax(1)
        names += [model.langs[k] if ok else UND for k, ok in zip(top, known)]
        scores.append(np.where(known, p.max(1), 0.0))
    score = np.concatenate(scores) if scores else np.zeros(0)
    limit = model.threshold if model else 1.0
    return names, score, (score < limit) | np.array([n == UND for n in names], bool)


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score (calibrated probability), rejected."""
    small_batches(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> dict:
        names, score, rejected = predict_batch(model, texts_of(batch))
        return {"doc_id": batch.column("doc_id"), "lang_pred": pa.array(names, pa.string()),
                "score": pa.array(score, pa.float64()), "rejected": pa.array(rejected, pa.bool_())}

    return map_batches(id_text(docs, id_col, text_col), work, SCHEMA)


def drop_rejected(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the model does not reject, with all their columns."""
    small_batches(docs.sparkSession)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = [t or "" for t in batch.column(text_col).to_pylist()]
        return batch.filter(pa.array(~predict_batch(model, text)[2]))

    return map_batches(docs, keep, docs.schema)


def in_fold(id_col: str, folds: int, which: int) -> Column:
    """Whether the crc32 of the id as text leaves the remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == which, F.lit(False))
