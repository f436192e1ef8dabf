import hashlib

import numpy as np

from sparkfeat.llm import fingerprint
from .conftest import EDGE


def test_order_edits_and_likeness(docs):
    rows = sorted(fingerprint.compare_with_next(docs).collect(), key=lambda r: r.doc_id)
    texts = [r.text for r in docs.sort("doc_id").collect()]
    assert len(rows) == len(texts)
    for i, r in enumerate(rows):
        t, u = texts[i], texts[(i + 1) % len(texts)]
        h = len(t) // 2
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256((t[:len(t) - h] + u[:h]).encode()).hexdigest()
    by_text = {}
    for t, r in zip(texts, rows):
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
    assert np.mean([r.near_edited for r in rows]) > 0.2 > 0.05 > np.mean([r.near_next for r in rows])


def test_shared_substrings_share_names_at_any_offset():
    rng = np.random.default_rng(0)
    body = "".join(chr(97 + x) for x in rng.integers(0, 26, 3000))
    a, b, c = fingerprint.sketches([body, "some other start " + body + " other end", body[::-1]])
    assert (a == b).mean() > 0.85 and (a == c).mean() < 0.1


def test_repeats_and_short_texts_end():
    texts = ["", "a", "aa", "ab", "aba", "a" * 10_000, "ab" * 5_000, "abc" * 3_000]
    got = fingerprint.sketches(texts)
    assert (got[0] == 0).all() and (got[1:] > 0).all()
    assert len({g.tobytes() for g in got}) == len(texts)
    assert np.array_equal(got, fingerprint.sketches(texts))


def test_edge_cases(spark, edge, none):
    rows = fingerprint.compare_with_next(edge).collect()
    assert len(rows) == len(EDGE)
    order = sorted(((i is not None, i or 0, t or "") for i, t, _ in EDGE))
    texts = [t for _, _, t in order]
    want = [t[:len(t) - len(t) // 2] + u[:len(t) // 2] for t, u in zip(texts, texts[1:] + texts[:1])]
    assert sorted(r.edited_sha256 for r in rows) == sorted(hashlib.sha256(w.encode()).hexdigest() for w in want)
    assert {r.near_next for r in rows if r.doc_id == 1} == {1.0}              # empty next to empty
    assert fingerprint.compare_with_next(none).count() == 0
    one = fingerprint.compare_with_next(edge.where("doc_id = 0")).first()
    assert one.near_next == 1.0
