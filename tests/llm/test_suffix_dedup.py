import hashlib
import random
import tempfile
from collections import Counter

import numpy as np
import pytest

from sparkfeat.llm import suffix_dedup as S


def brute(texts, k):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i:i + k] for x in raw for i in range(len(x) - k + 1))
    out = []
    for x in raw:
        edge = np.zeros(len(x) + 1, int)
        for i in range(len(x) - k + 1):
            if seen[x[i:i + k]] > 1:
                edge[i] += 1
                edge[i + k] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        kept = bytes(np.frombuffer(x, np.uint8)[~gone])
        out.append((len(x), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_column_bwt_against_brute_force(seed):
    rng = random.Random(seed)
    k = rng.choice([2, 3, 5])
    pieces = list({bytes(rng.choices(b"ab" if seed % 2 else b"abcd", k=rng.randint(k, 14))) for _ in range(rng.randint(1, 9))})
    with tempfile.TemporaryDirectory() as folder, S.SequentialFiles(folder) as files:
        got = S.column_bwt(pieces, k, files)
    seen = Counter(p[i:i + k] for p in pieces for i in range(len(p) - k + 1))
    for p, flags in zip(pieces, got):
        assert flags.tolist() == [seen[p[i:i + k]] > 1 for i in range(len(p) - k + 1)]


@pytest.mark.parametrize("seed", range(20))
def test_words_of_several_bytes(seed):
    rng = random.Random(100 + seed)
    k = rng.choice([4, 8, 12, 16])
    base = bytes(rng.choices(b"abc", k=60))
    pieces = list({base[(a := rng.randint(0, 30)):a + rng.randint(k, 30)] for _ in range(10)} | {bytes(rng.choices(range(256), k=rng.randint(k, 40))) for _ in range(3)})
    with tempfile.TemporaryDirectory() as folder, S.SequentialFiles(folder) as files:
        got = S.column_bwt(pieces, k, files)
    seen = Counter(p[i:i + k] for p in pieces for i in range(len(p) - k + 1))
    for p, flags in zip(pieces, got):
        assert flags.tolist() == [seen[p[i:i + k]] > 1 for i in range(len(p) - k + 1)]


def test_range_minima():
    rng = np.random.default_rng(1)
    for _ in range(50):
        v = rng.integers(0, 60, rng.integers(1, 700)).astype(np.uint8)
        a = rng.integers(0, len(v), 40)
        b = np.array([rng.integers(x + 1, len(v) + 1) for x in a])
        assert S.range_minima(v, a, b, block=8).tolist() == [v[i:j].min() for i, j in zip(a, b)]


def rows_of(df):
    return sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_edge_cases(edge, none):
    from .conftest import EDGE
    assert rows_of(S.remove_repeats(edge, length=20, bitmap_bits=12)) == sorted(brute([t for _, t, _ in EDGE], 20))
    assert S.remove_repeats(none, bitmap_bits=12).count() == 0


def test_documents_and_the_way_round_for_hot_minimizers(docs):
    few = docs.limit(60).cache()
    want = sorted(brute([r.text for r in few.collect()], 50))
    assert rows_of(S.remove_repeats(few, length=50, bitmap_bits=14)) == want
    assert rows_of(S.remove_repeats(few, length=50, bitmap_bits=14, hot_pieces=1)) == want


def test_a_long_text_is_read_in_stretches(monkeypatch):
    monkeypatch.setattr(S, "PLACE_BITS", 10)
    data = bytes(random.Random(1).choices(b"abcdefgh", k=5000))
    start, windows, _ = S.cut_pieces(data, np.array([0]), np.array([5000]), 100)
    covered = np.concatenate([np.arange(a, a + w) for a, w in zip(start, windows)])
    assert sorted(covered.tolist()) == list(range(4901))
