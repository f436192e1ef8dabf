"""Operators 11 and 12 against plain numpy on whole small tables, and their edge cases."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkfeat.llm import hard_negatives, whitening
from sparkfeat.llm.hard_negatives import Heaps, strassen

SCHEMA = "vec_id long, embedding array<float>, label int, x string, w string, row string, slice int, rank int, z double, tie int"


@pytest.fixture(scope="module")
def vectors(spark):
    """Random vectors of 6 dimensions; one of them a third of all rows; every kind of unusable row."""
    rng = np.random.default_rng(3)
    m = rng.normal(0, 0.3, (300, 6)).astype(np.float32)
    m[rng.choice(300, 100, replace=False)] = m[7]
    rows = [(i, v.tolist(), int(rng.integers(0, 4))) for i, v in enumerate(m)]
    rows += [(300, None, 1), (301, [], 1), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (303, [float("nan")] * 6, 1),
             (304, [float("inf")] + [0.0] * 5, 1), (305, [1.0] * 5, 2), (306, [1e30] * 6, 2), (8, rows[8][1], rows[8][2]),
             (307, m[9].tolist(), None), (None, m[10].tolist(), 3)]
    return spark.createDataFrame([(*r, "a", "b", "c", 1, 2, 0.5, 3) for r in rows], SCHEMA).repartition(5)


def usable(df):
    rows = [(r.vec_id, np.array(r.embedding, np.float64), r.label) for r in df.collect()
            if r.embedding and len(r.embedding) == 6 and all(v is not None and np.isfinite(v) and abs(v) < 1e6 for v in r.embedding)]
    return rows


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_whitening_equals_numpy(vectors, weights):
    rows = usable(vectors)
    x = np.floor(np.array([v for _, v, _ in rows]) * 1024).astype(np.int64) + 100_000
    listed = x if weights == "counts" else np.unique(x, axis=0)
    n, s = len(listed), listed.sum(0)
    cov = np.cov(listed.T, bias=True)
    values, vectors_ = np.linalg.eigh(cov)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    got = whitening.whiten_embeddings(vectors, weights=weights, components=4).toPandas()
    assert len(got) == len(rows) * 4
    assert set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    z = (x - s / n) @ vectors_ / np.sqrt(values)
    expected = {}
    for (i, _, _), row, zs in zip(rows, x, z):
        dev = sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s))
        expected.setdefault((i, dev), []).append(zs)
    by = got.sort_values("component").groupby([got.vec_id.astype("Int64").fillna(-1), got.deviation.astype(object)])
    for (i, dev), part in by:
        for c in range(4):
            own = part[part.component == c + 1]
            assert len(own) == len(expected[(None if i == -1 else int(i), int(dev))])
            want = abs(expected[(None if i == -1 else int(i), int(dev))][0][c])
            assert np.allclose(own.whitened.abs(), want, atol=1e-9)
            assert np.allclose(own.explained, values[c] / np.trace(cov), rtol=1e-12)
    # one sign for all rows of a component
    z_by_id = {i: zs for (i, _, _), zs in zip(rows, z)}
    for c in range(4):
        own = got[(got.component == c + 1) & got.vec_id.notna()]
        signs = {np.sign(r.whitened * z_by_id[int(r.vec_id)][c]) for r in own.itertuples() if abs(r.whitened) > 1e-6}
        assert len(signs) == 1


def test_whitening_without_variance_or_rows(spark, vectors):
    assert whitening.whiten_embeddings(vectors.where("1 = 0")).count() == 0
    assert whitening.whiten_embeddings(vectors.where("embedding is null")).count() == 0
    one = whitening.whiten_embeddings(vectors.where("vec_id = 8"), components=8).toPandas()
    assert len(one) == 12 and one.whitened.isna().all() and set(one.deviation) == {0} and set(one.identity_error) == {0.0}
    flat = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [0.0, 4.0])], "vec_id long, embedding array<double>")
    out = whitening.whiten_embeddings(flat).toPandas()
    assert out[out.component == 2].whitened.isna().all() and out[out.component == 1].whitened.notna().all()
    assert np.allclose(out[out.component == 1].explained, 1)


def test_deviations_are_exact_beyond_64_bits():
    x = np.array([[2**30, 5], [3, 2**30]])
    model = whitening.Whitening(2**40, np.array([2**50, 7]), np.eye(2), np.ones(2), 2.0)
    assert model.deviations(x)[0] == (2**70 - 2**50) ** 2 + (5 * 2**40 - 7) ** 2


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(1, 9), st.integers(0, 2**31), st.sampled_from([3, 2**20, 2**30]))
def test_strassen_equals_the_product(m, k, n, seed, top):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-top, top, (m, k)), rng.integers(-top, top, (k, n))
    assert (strassen(a, b, leaf=1) == a @ b).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.lists(st.integers(1, 6), min_size=1, max_size=4), st.integers(0, 2**31))
def test_heaps_keep_the_first(k, widths, seed):
    rng = np.random.default_rng(seed)
    scores, allowed = rng.integers(-3, 3, (5, sum(widths))), rng.random((5, sum(widths))) < 0.6
    heaps, at = Heaps(5, k), 0
    for w in widths:
        heaps.of(slice(0, 3)).offer(scores[:3, at:at + w], allowed[:3, at:at + w], at)
        heaps.of(slice(3, 5)).offer(scores[3:, at:at + w], allowed[3:, at:at + w], at)
        at += w
    for i in range(5):
        want = sorted((-s, j) for j, s in enumerate(scores[i]) if allowed[i, j])[:k]
        assert [(-s, j) for s, j in zip(heaps.score[i], heaps.place[i]) if j >= 0] == want


def brute(rows, low=30, high=90):
    rows = [(i, np.floor(v * 256).astype(np.int64), lab) for i, v, lab in rows if i is not None and lab is not None]
    out = []
    for a in range(len(rows)):
        if rows[a][0] % 10:
            continue
        scored = sorted((-int(rows[a][1] @ x), i, lab, j) for j, (i, x, lab) in enumerate(rows) if j != a)
        for p, i, lab, _ in [s for s in scored if s[2] == rows[a][2]][:5]:
            inside = [s for s in scored if s[2] != rows[a][2] and low * -p <= -100 * s[0] <= high * -p][:10]
            out += [(rows[a][0], i, r + 1, s[1], -p, -s[0]) for r, s in enumerate(inside)]
    return sorted(out)


def test_negatives_equal_brute_force(vectors):
    # small groups, slices and tiles: every merge is taken
    got = hard_negatives.mine(vectors, F.col("vec_id") % 10 == 0, group_rows=7, slice_rows=40, tile=(3, 5))
    want = brute(usable(vectors))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 300
    whole = hard_negatives.mine(vectors, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, whole.collect())) == want


def test_negatives_of_nothing(vectors):
    for df in (vectors.where("1 = 0"), vectors.where("embedding is null"), vectors.where("label is null"), vectors.where("vec_id = 3")):
        assert hard_negatives.mine(df, F.lit(True)).count() == 0
    assert hard_negatives.mine(vectors, F.lit(None).cast("boolean")).count() == 0
