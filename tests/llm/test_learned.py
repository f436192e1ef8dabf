"""Language ID, toxicity and language-model scores: held-out quality and edge cases."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfeat.llm import attention, language_id, lm_score, toxicity
from .conftest import EDGE

SF = "/root/testdata/sf0.01"
LARGER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def many(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_of_held_out_documents(many):
    held = language_id.in_fold("doc_id", 4, 2)
    model = language_id.fit(many, ~held, per_lang=150)
    rows = language_id.predict(many, model).join(many.where(held).select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert np.mean([r.rejected for r in rows]) < 0.01 and all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(edge, none, many):
    model = language_id.fit(many, per_lang=40)
    rows = {(r.doc_id, r.lang_pred == "und", r.rejected and r.lang_pred == "und") for r in language_id.predict(edge, model).collect()}
    assert {i for i, und, _ in rows if und} == {1, 2, 5, 7}
    assert all(gone for _, und, gone in rows if und)
    assert language_id.predict(none, model).count() == 0
    assert language_id.fit(none) is None
    assert {r.lang_pred for r in language_id.predict(edge, None).collect()} == {"und"}
    kept = language_id.drop_rejected(edge, model)
    assert kept.columns == edge.columns and {r.doc_id for r in kept.collect()}.isdisjoint({1, 2, 5, 7})


def test_toxicity_on_rows_it_has_not_seen(spark):
    many, labels = spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")
    fold = F.col("doc_id") % 7 == 0
    model = toxicity.fit(many, labels.where(~fold))
    rows = toxicity.predict(many, model).join(labels.where(fold).withColumnRenamed("toxic", "truth"), "doc_id").collect()
    toxic, clean = [r for r in rows if r.truth == 1], [r for r in rows if r.truth == 0]
    assert np.mean([r.toxic for r in toxic]) > 0.75 and np.mean([r.toxic for r in clean]) < 0.01
    assert np.mean([r.severity for r in toxic]) > 1 > 0.3 > np.mean([r.severity for r in clean])
    assert (np.diff(model.thresholds) >= 0).all()


def test_toxicity_edge_cases(spark, edge, none, many):
    labels = spark.createDataFrame([(0, 1), (6, 0), (None, 1), (4, None), (99, 0), (0, 1)], "doc_id long, toxic int")
    rows = toxicity.predict(edge, toxicity.fit(edge, labels)).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.severity <= 3 and math.isfinite(r.severity) for r in rows)
    assert toxicity.fit(edge, labels.where("toxic = 0")) is None
    assert {r.severity for r in toxicity.predict(edge, None).collect()} == {0.0}
    assert toxicity.predict(none, None).count() == 0 and toxicity.fit(none, labels.limit(0)) is None


def base_by_hand(rows):
    lower = str.maketrans({c: c + 32 for c in range(65, 91)})
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) + ["\0"] for _, t, _ in rows]
    seen = Counter(w for (_, _, learn), ws in zip(rows, tokens) if learn for w in ws)
    n, v = sum(seen.values()), len(seen)
    return n, sorted((len(ws), sum(seen[w] > 0 for w in ws), round(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in ws), 6)) for ws in tokens)


def test_base_scores_against_brute_force(edge, none, many, path):
    few = many.limit(80)
    for df, rows in ((edge, EDGE), (few, [(r.doc_id, r.text, r.lang) for r in few.collect()])):
        marked = [(i, t, i is not None and zlib.crc32(str(i).encode()) % 7 != 2) for i, t, _ in rows]
        learn = F.col("doc_id").isNotNull() & ~language_id.in_fold("doc_id", 7, 2)
        got = lm_score.score_texts(df, path, learn).collect()
        n, want = base_by_hand(marked)
        assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
        assert {r.train_tokens for r in got} == {n} and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm_score.score_texts(none, path, F.lit(True)).count() == 0


def small_model(seed=0):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, 300, 400)
    ids[-1] = 7
    v = attention.Vocabulary(np.bincount(ids, minlength=400), 7)
    pairs = np.concatenate([[v.end], v.of[ids[:-1]]]).astype(np.int64) * 400 + ids
    v.set_pairs(*np.unique(pairs, return_counts=True))
    p = attention.start_parameters(v.after)
    return ids, v, {k: (x + rng.standard_normal(x.shape) * 0.05 * (k != "bigram")).astype(np.float32) for k, x in p.items()}


def test_next_id_probabilities_sum_to_one():
    ids, v, p = small_model()
    scorer = attention.Scorer(p, v)
    for length in (0, 5, 40):
        texts = np.concatenate([np.append(ids[:length], x) for x in range(400)])
        whole = scorer.score(texts, np.full(400, length + 1))
        before = scorer.score(np.append(ids[:length], 0), np.array([length])) if length else np.zeros(1)
        assert abs((10 ** (whole - before)).sum() - 1) < 1e-3


def test_scorer_equals_training_forward_pass_and_gradients():
    ids, v, p = small_model(1)
    c = np.concatenate([[v.end], v.of[ids]])
    loss, _ = attention.gradients(p, c[None, :16], c[None, 1:17])
    want = -loss * 16 / np.log(10) + v.member(c[:16], ids[:16]).sum()
    assert abs(attention.Scorer(p, v).score(ids[:16], np.array([16]))[0] - want) < 1e-3
    rng = np.random.default_rng(2)
    p64 = {k: x.astype(np.float64) for k, x in p.items()}
    a, b = rng.integers(0, 256, (3, 32)), rng.integers(0, 256, (3, 32))
    _, grads = attention.gradients(p64, a, b)
    for k, g in grads.items():
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        shifted = []
        for e in (1e-5, -1e-5):
            q = dict(p64) | {k: p64[k].copy()}
            q[k][i] += e
            shifted.append(attention.gradients(q, a, b)[0])
        assert abs((shifted[0] - shifted[1]) / 2e-5 - g[i]) < 1e-4 * max(1, abs(g[i])) + 1e-6


def test_training_lowers_the_loss():
    rng = np.random.default_rng(4)
    stream = np.tile(rng.integers(0, 50, 37), 6000).astype(np.int32)
    v = attention.Vocabulary(np.bincount(stream, minlength=60), 3)
    stream = v.of[stream]
    p = attention.start_parameters(np.ones((attention.CLASSES, attention.CLASSES)))
    windows = stream[:320].reshape(10, 32), stream[1:321].reshape(10, 32)
    assert attention.gradients(attention.train(p, stream), *windows)[0] < 0.5 * attention.gradients(p, *windows)[0]


def test_weights_are_trained_on_all_documents_to_learn_from(many, path, monkeypatch):
    kept = []

    class Counting(attention.Trainer):
        def feed(self, stream):
            self.p = self.p | {"bias": self.p["bias"] + len(stream)}
    monkeypatch.setattr(lm_score, "Trainer", Counting)
    monkeypatch.setattr(lm_score, "Scorer", lambda p, v: kept.append(p) or attention.Scorer(p, v))
    few = many.limit(120).coalesce(1)                               # one trainer
    lm_score.score_texts(few, path, F.lit(True)).count()
    end = 0
    ids, _ = lm_score.subwords(path, [r.text or "" for r in few.collect()], end)
    assert kept[0]["bias"].tolist() == [len(ids)] * attention.CLASSES


def test_scores_depend_on_the_corpus_alone(spark, many, path, monkeypatch):
    """Not on partitions, nor on the order of rows (but for the last digits of sums); copies are dealt over trainers."""
    monkeypatch.setattr(lm_score, "TRAINER_IDS", 6000)
    few = many.limit(60).union(many.limit(1)).union(many.limit(1))
    few = spark.createDataFrame(few.collect(), few.schema)
    got = []
    for parts in (3, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        rows = lm_score.score_texts(few.repartition(parts), path, F.col("doc_id") % 5 != 0).collect()
        got.append(sorted((r.doc_id, round(r.score, 3), round(r.base_score, 3)) for r in rows))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got[0] == got[1] and len(got[0]) == 62


def test_subword_ids_are_stored_once_a_text_and_learned_from_with_all_copies(spark, path, monkeypatch):
    """No further table of ids is written for the trainers."""
    rows = [(i, t) for i, t in enumerate(["one text here", "one text here", "Another text", None, "", "one text here"])] + [(None, "last one"), (1, "one text here")]
    df, tables, counts = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), {}, []

    def stored(df, name, real=lm_score.stored):
        tables[name] = real(df, name)
        return tables[name]
    monkeypatch.setattr(lm_score, "stored", stored)
    monkeypatch.setattr(lm_score, "Vocabulary", lambda c, end: counts.append(c) or attention.Vocabulary(c, end))
    got = lm_score.score_texts(df, path, F.coalesce(F.col("doc_id") < 5, F.lit(False))).collect()
    assert len(got) == len(rows) and {r.score for r in got if r.doc_id in (0, 1, 5)} == {got[[r.doc_id for r in got].index(0)].score}
    assert {r.doc_id for r in got if r.held_out} == {5, None}
    kept = [t for t in tables.values() if "ids" in t.columns]
    assert [t.count() for t in kept] == [4]                            # of 8 rows; null and empty are one text
    end = max(lm_score.bpe.machine(path).special.values())
    ids, _ = lm_score.subwords(path, [t or "" for i, t in rows if i is not None and i < 5], end)
    assert counts[0].tolist() == np.bincount(ids, minlength=len(counts[0])).tolist()


def test_a_word_takes_twelve_bytes_in_a_message():
    import pyarrow as pa
    keys = np.zeros(3, lm_score.WORD)
    keys["one"], keys["two"] = [5, 5, 6], [1, 2, 1]
    assert keys.itemsize == 12
    sent = pa.RecordBatch.from_pydict({"block": ["x", "y"], "bucket": pa.array([0, 0], pa.int32()), "a": [keys.tobytes(), keys[1:].tobytes()],
                                       "b": [np.array(n, "<u4").tobytes() for n in ([1, 2, 0], [3, 0])]})
    x, y = lm_score._answer(iter([sent]))
    assert np.frombuffer(x["counts"][0].as_py(), "<u8").tolist() == [1, 5, 0] and np.frombuffer(y["counts"][0].as_py(), "<u8").tolist() == [5, 0]
    assert x["total"][0].as_py() == 6 and x["distinct_words"][0].as_py() == 2


def test_a_trainer_reads_every_id_however_its_stream_is_cut(monkeypatch):
    rng = np.random.default_rng(8)
    stream = rng.integers(0, 200, 1000)
    p = attention.start_parameters(np.ones((attention.CLASSES, attention.CLASSES)))
    seen = []
    monkeypatch.setattr(attention.Trainer, "_move", lambda self, a, b: seen.append((a, b)))
    for cuts in ([1000], [10, 500, 31, 459], [33] * 30 + [10]):
        seen.clear()
        trainer = attention.Trainer(p, 1000)
        for part in np.split(stream, np.cumsum(cuts)[:-1]):
            trainer.feed(part)
        trainer.finish()
        pairs = {(int(x), int(y)) for a, b in seen for x, y in zip(a.ravel(), b.ravel())}
        assert pairs == set(zip(stream[:-1].tolist(), stream[1:].tolist()))
        assert sum(a.size for a, _ in seen) == 1024                       # the last window begins a little earlier
    short = attention.Trainer(p, 5)
    short.feed(stream[:5])
    assert short.finish()["bias"].tolist() == p["bias"].tolist()


def test_rare_ids_of_one_class_are_told_apart():
    """Two rare ids of one class, each followed by a word of its own."""
    rng = np.random.default_rng(6)
    counts = np.append(np.arange(1000, 700, -1), [3, 3]).astype(np.int64)
    v = attention.Vocabulary(counts, 0)
    assert v.of[300] == v.of[301] >= attention.HEAD
    first = rng.integers(0, 2, 20_000)
    stream = np.stack([300 + first, 50 + first, rng.integers(1, 40, 20_000)], 1).ravel()
    v.set_pairs(*np.unique(v.of[np.append(0, stream[:-1])] * np.int64(302) + stream, return_counts=True))
    p = attention.train(attention.start_parameters(v.after, n_ids=302), stream, v.of, rate=2e-2)
    right = attention.Scorer(p, v).score(np.array([300, 50, 301, 51]), np.array([2, 2]))
    wrong = attention.Scorer(p, v).score(np.array([300, 51, 301, 50]), np.array([2, 2]))
    assert (right > wrong + 0.5).all()


def test_scorer_equals_training_with_own_vectors_and_their_gradients():
    ids, v, p = small_model(3)
    rng = np.random.default_rng(5)
    p["own"] = (rng.standard_normal((400, attention.DIM)) * 0.3).astype(np.float32)
    read = np.append(v.end_id, ids)[:16]
    loss, _ = attention.gradients(p, v.of[read][None], v.of[ids[:16]][None], read[None])
    want = -loss * 16 / np.log(10) + v.member(v.of[read], ids[:16]).sum()
    assert abs(attention.Scorer(p, v).score(ids[:16], np.array([16]))[0] - want) < 1e-3
    p64 = {k: x.astype(np.float64) for k, x in p.items()}
    a, b = rng.integers(0, 400, (3, 32)), rng.integers(0, 256, (3, 32))
    rows, g = attention.gradients(p64, v.of[a], b, a)[1]["own"]
    r, i = np.unravel_index(np.abs(g).argmax(), g.shape)
    shifted = []
    for e in (1e-5, -1e-5):
        q = dict(p64) | {"own": p64["own"].copy()}
        q["own"][rows[r], i] += e
        shifted.append(attention.gradients(q, v.of[a], b, a)[0])
    assert abs((shifted[0] - shifted[1]) / 2e-5 - g[r, i]) < 1e-5
