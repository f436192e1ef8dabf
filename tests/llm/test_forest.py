"""Operator 10's forest: prefixes level by level, probes against brute force, shortening."""

import random

import numpy as np

from sparkfeat.llm import near_join as N


def some_texts(seed, n=40):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        base = [f"w{rng.randrange(30)}" for _ in range(60)] if i % 4 == 0 else list(base)
        for _ in range(rng.choice([0, 1, 1, 2])):
            base[rng.randrange(len(base))] = f"e{rng.randrange(1000)}"
        out.append(" ".join(base))
    return out


def test_prefixes_are_the_labels_of_every_depth():
    sets = N.shingle_sets(some_texts(1), 5)
    whole = N.prefixes(sets, 6, 8)
    for d in range(1, 9):
        assert (whole[:, :, d - 1] == N.labels(sets, 6, d)).all()
    deep = N.common_depths(whole, whole, np.arange(39), np.arange(1, 40), block=7)
    for i in range(39):
        a, b = whole[i], whole[i + 1]
        assert deep[i] == max(next((d for d in range(8) if a[t, d] != b[t, d]), 8) for t in range(6))


def test_probes_find_all_their_true_pairs(spark):
    texts = some_texts(2, 80)
    sets = N.shingle_sets(texts, 5)
    probes = N.Probes.of(sets[::8])
    i, j, alike = probes.true_pairs(sets, 0.8)
    got = dict(zip(zip(i.tolist(), j.tolist()), alike.tolist()))
    share = lambda a, b: len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    want = {(a, b): s for a in range(80) for b in range(10) if 0.8 <= (s := share(sets[a], sets[8 * b])) < 1}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and len(want) > 8
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    counts = N.measured_depths(rows, probes, 0.8, 5, 24, 8)
    every = N.prefixes(sets, 24, 8)
    deep = N.common_depths(every, every[::8], i, j)
    assert counts.sum(0).tolist() == np.bincount(deep, minlength=9).tolist()
    assert counts[0].sum() == sum(s <= 0.85 for s in want.values())


def test_the_prefix_is_shortened_until_the_measured_recall_is_reached():
    flat = np.zeros((2, 9), np.int64)
    assert N.shortened(flat, 0.8, 24, 8, 0.9999) == N.prefix_depth(0.8, 24, 8, 0.9999) == 5
    seen = flat.copy()
    seen[0, 3:6] = [1, 2, 997]
    assert N.shortened(seen, 0.8, 24, 8, 0.9) == 5 < N.prefix_depth(0.8, 24, 8, 0.9)   # as measured, whatever was expected
    assert N.shortened(seen, 0.8, 24, 8, 0.9999) == 3                       # one pair of a thousand met at 3 only
    seen[1, 1] = 5                                                          # pairs far above the threshold do not count beside those
    assert N.shortened(seen, 0.8, 24, 8, 0.9999) == 3
    seen[0] = 0
    assert N.shortened(seen, 0.8, 24, 8, 0.9999) == 1


def test_samples_are_different_sets_of_bounded_size(spark, monkeypatch):
    from pyspark.sql import functions as F
    texts = some_texts(3, 30) + ["", None, "one two"] + ["the very same text of six words"] * 50
    rows = spark.createDataFrame([(t or "",) for t in texts], "text string").withColumn("tid", F.md5("text"))
    sets = N.sampled_sets(rows, 10_000, 5)
    assert len({s.tobytes() for s in sets}) == len(sets) == len({s.tobytes() for s in N.shingle_sets([t or "" for t in texts], 5) if len(s)})
    monkeypatch.setattr(N, "PROBE_SHINGLES", 100)
    assert 0 < sum(map(len, N.sampled_sets(rows, 10_000, 5))) <= 100
    assert N.sampled_sets(rows.where("1 = 0"), 10, 5) == []
