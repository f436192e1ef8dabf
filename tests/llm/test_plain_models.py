"""Operators 4 and 7 against plain Python restatements of one forward pass and one training step."""

import math

import numpy as np

from sparkfeat.llm import language_id, toxicity, words
from .conftest import EDGE

TEXTS = ["", "a", "Über den Fluss", "the quick brown fox", "the the fox", "123 !!", "x" * 700, "中文 text 中文"]


def plain_buckets(text: str) -> list[int]:
    """Buckets of all 2-, 3- and 4-grams of the lower-cased text with its separator, wrapping at its end."""
    cps = [ord(c) for c in text.lower() + "\n"]
    out = []
    for n in language_id.ORDERS:
        for i in range(len(cps)):
            h = 0
            for j in range(n):
                h = (h * 0x01000193 + cps[(i + j) % len(cps)]) & 0xFFFFFFFF
            x = h * (0x85EBCA6B + 2 * (n - 1)) & 0xFFFFFFFF
            out.append((x ^ (x >> 15)) & (language_id.BUCKETS - 1))
    return out


def test_language_forward_pass():
    rng = np.random.default_rng(2)
    langs = ["de", "en", "zh"]
    model = language_id.LanguageModel(langs, rng.standard_normal((language_id.BUCKETS, 3)).astype(np.float32),
                                      rng.standard_normal(3).astype(np.float32), 0.45)
    for t in TEXTS:
        grams = plain_buckets(t)
        assert sorted(grams) == sorted(language_id._features([t])[0].tolist())
        z = [sum(float(model.table[g, k]) for g in grams) / len(grams) + float(model.bias[k]) for k in range(3)]
        p = [math.exp(v - max(z)) for v in z]
        p = [v / sum(p) for v in p]
        names, score, rejected = language_id.predict_batch(model, [t])
        if any(c.isalpha() for c in t):
            assert names == [langs[int(np.argmax(p))]] and abs(score[0] - max(p)) < 1e-5 and rejected[0] == (max(p) < 0.45)
        else:
            assert names == ["und"] and score[0] == 0 and rejected[0]
    # a block of several texts gives each what it gets alone, but for grams that cross a text's end
    together, scores, _ = language_id.predict_batch(model, TEXTS)
    assert len(together) == len(TEXTS) and together[-2:] == [language_id.predict_batch(model, [t])[0][0] for t in TEXTS[-2:]]


def test_language_training_step_follows_the_gradient():
    """The move of one stochastic step lowers the loss as its gradient says."""
    texts, langs = ["aaaa bbbb cccc dddd"] * 3 + ["zzzz yyyy xxxx wwww"] * 3, ["one"] * 3 + ["two"] * 3
    model = language_id.train(texts, langs, epochs=6)
    names, score, _ = language_id.predict_batch(model, texts)
    assert names == langs and min(score) > 0.5


def plain_row(text: str) -> set[int]:
    h, _ = words.word_hashes([text])
    return {int(x) & (toxicity.BUCKETS - 1) for x in h}


def sigmoid(z):
    return 1 / (1 + math.exp(-z))


def test_toxicity_forward_pass(spark):
    rng = np.random.default_rng(4)
    model = toxicity.OrdinalModel(rng.standard_normal(toxicity.BUCKETS).astype(np.float32), np.array([-0.5, 0.3, 1.1]))
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    got = {r.doc_id: r for r in toxicity.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, t in rows:
        z = sum(float(model.weights[b]) for b in sorted(plain_row(t)))
        over = [sigmoid(z - c) for c in model.thresholds]
        assert abs(got[i].severity - sum(over)) < 1e-5 and abs(got[i].p_toxic - over[0]) < 1e-5
        assert got[i].grade == sum(v >= 0.5 for v in over) and got[i].toxic == (over[0] >= 0.5)


def test_toxicity_gradient_by_differences():
    rng = np.random.default_rng(5)
    n, d, k = 9, 6, 3
    x = rng.random((n, d)) < 0.5
    owner, local = np.nonzero(x)
    begin = np.searchsorted(owner, np.arange(n))
    grade = rng.integers(0, k + 1, n)
    over = (grade[:, None] > np.arange(k)).astype(float)
    weight = rng.random(n)
    weight /= weight.sum()
    w, cut = rng.standard_normal(d), np.sort(rng.standard_normal(k))

    def loss(w, cut):
        return sum(weight[i] * (math.log(1 + math.exp(-(z := w[x[i]].sum() - cut[j]))) if over[i, j] else math.log(1 + math.exp(w[x[i]].sum() - cut[j])))
                   for i in range(n) for j in range(k))
    gw, gc = toxicity.gradient(w, cut, local, owner, begin, over, weight)
    for v, g, other in ((w, gw, False), (cut, gc, True)):
        for i in range(len(v)):
            up, down = v.copy(), v.copy()
            up[i] += 1e-6
            down[i] -= 1e-6
            numeric = (loss(w, up) - loss(w, down) if other else loss(up, cut) - loss(down, cut)) / 2e-6
            assert abs(numeric - g[i]) < 1e-6


def test_toxicity_learns_planted_words_and_orders_grades():
    rng = np.random.default_rng(6)
    texts, toxic = [], []
    for i in range(600):
        bad = int(rng.integers(1, 6)) if i % 5 == 0 else 0
        texts.append(" ".join([f"w{rng.integers(0, 300)}" for _ in range(30)] + [f"bad{j}" for j in rng.permutation(6)[:bad]]))
        toxic.append(int(bad > 0))
    index, firsts = toxicity.sparse_rows(texts)
    model = toxicity.train(index, firsts, np.array(toxic))
    z = toxicity._row_sums(model.weights[index], firsts) - model.thresholds[0]
    assert np.mean((z > 0) == np.array(toxic)) > 0.97 and (np.diff(model.thresholds) >= 0).all()
    grade = toxicity.make_grades(toxicity.evidence(index, firsts, np.array(toxic)), np.array(toxic))
    counts = np.array([t.count("bad") for t in texts])
    means = [counts[grade == g].mean() for g in (1, 2, 3)]
    assert set(grade[np.array(toxic) == 0]) == {0} and means == sorted(means)      # more evidence, higher grade
    assert toxicity.train(index, firsts, np.zeros(600)) is None


def test_toxicity_ids_that_repeat_teach_once(spark):
    rows = [(i % 10, f"word{i} bad" if i % 10 < 5 else f"word{i} good") for i in range(400)] + [(None, "bad")]
    labels = spark.createDataFrame([(i, int(i < 5)) for i in range(10)] + [(3, 0)], "doc_id long, toxic int")
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), labels)
    assert model is not None
    assert len(toxicity.predict(spark.createDataFrame([(i, t) for i, t, _ in EDGE], "doc_id long, text string"), model).collect()) == len(EDGE)
