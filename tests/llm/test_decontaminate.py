import random

import numpy as np

from sparkfeat.llm import decontaminate as D
from .conftest import EDGE

VOCABULARY = [f"w{i}" for i in range(400)]


def distance(item, doc):
    """Least word edits between the item and any stretch of the document."""
    prev = [0] * (len(doc) + 1)
    for i, x in enumerate(item, 1):
        cur = [i]
        for j, y in enumerate(doc, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return min(prev)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        words[at:at + 1] = [["new"], ["new", words[at]], []][kind]
    return words


def test_against_brute_force(spark):
    rng = random.Random(5)
    items = [rng.choices(VOCABULARY, k=rng.randint(12, 50)) for _ in range(12)]
    docs, far = [], 0
    for i in range(60):
        words = rng.choices(VOCABULARY, k=rng.randint(0, 120))
        if i % 2:
            item = rng.choice(items)
            at = rng.randint(0, len(words))
            words[at:at] = edited(rng, item, rng.randint(0, int(0.3 * len(item))))
        docs.append(words)
    df = spark.createDataFrame([(i, " ".join(w).title()) for i, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, ", ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in D.leaks(df, bench).collect()}
    want = {(d, i): n for d, w in enumerate(docs) for i, item in enumerate(items) if (n := distance(item, w)) <= int(0.2 * len(item))}
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(got) >= 0.95 * len(want) and {k for k, n in want.items() if n <= 2} <= set(got)
    blocks = D.leaks(df, bench, block_chars=500)                  # many blocks of items, same leaks
    assert {(r.doc_id, r.item_id): r.distance for r in blocks.collect()}.keys() == got.keys()
    kept = {r.doc_id for r in D.drop_leaking(df, bench).collect()}
    assert kept == set(range(60)) - {d for d, _ in got}


def test_recall_of_each_length():
    """Leaks at the largest distance with words before and behind, found length by length."""
    rng = random.Random(7)
    for n in (5, 6, 7, 8, 9, 10, 11, 12, 14, 17, 25):
        items = [rng.choices(VOCABULARY, k=n) for _ in range(150)]
        far = [rng.choices(VOCABULARY, k=60) for _ in range(150)]              # long items must not hide short ones
        index = D.build_index(list(range(300)), [" ".join(w) for w in items + far], 0.2, 5, 0.97, 2)
        docs = [rng.choices(VOCABULARY, k=rng.randint(5, 30)) + edited(rng, w, int(0.2 * n)) + rng.choices(VOCABULARY, k=20) for w in items]
        doc, item, dist = D.find_leaks(index, [" ".join(w) for w in docs], 2)
        got = {(d, i): x for d, i, x in zip(doc.tolist(), item.tolist(), dist.tolist())}
        hit = sum((i, i) in got for i in range(150))
        assert hit >= (150 if n < D.SHORT else 0.95 * 150), (n, hit)
        assert all(got[k] == distance((items + far)[k[1]], docs[k[0]]) for k in got)


def test_seeds_lose_nothing():
    rng = random.Random(8)
    few = VOCABULARY[:6]                                                       # words that occur everywhere
    items = [rng.choices(few, k=rng.randint(1, 20)) for _ in range(40)]
    docs = [rng.choices(few, k=rng.randint(0, 40)) for _ in range(40)]
    index = D.build_index(list(range(40)), [" ".join(w) for w in items], 0.2, 1, 1.0, 2)
    doc, item, dist = D.find_leaks(index, [" ".join(w) for w in docs], 2)
    want = {(d, i): n for d, w in enumerate(docs) for i, x in enumerate(items) if (n := distance(x, w)) <= int(0.2 * len(x))}
    assert dict(zip(zip(doc.tolist(), item.tolist()), dist.tolist())) == want


def test_edit_distances():
    rng = random.Random(6)
    pairs = [(rng.choices(range(2, 9), k=rng.randint(1, 9)), rng.choices(range(2, 9), k=rng.randint(0, 20))) for _ in range(200)]
    got = D.edit_distances([np.array(a, np.uint64) for a, _ in pairs], [np.array(b, np.uint64) for _, b in pairs])
    assert got.tolist() == [distance(a, b) for a, b in pairs]


def test_edge_cases(spark, edge, none):
    bench = spark.createDataFrame([(1, "quick brown FOX jumps over the lazy dog"), (None, None), (2, ""), (3, "too short"), (4, None),
                                   (5, "quick brown fox jumps over the lazy dog")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in D.leaks(edge, bench).collect())
    assert got == [(0, 1), (0, 5), (6, 1), (6, 1), (6, 5), (6, 5)]
    kept = D.drop_leaking(edge, bench)
    assert kept.columns == edge.columns and kept.count() == len(EDGE) - 3
    assert D.leaks(none, bench).count() == 0 and D.leaks(edge, bench.limit(0)).count() == 0
    assert D.drop_leaking(edge, bench.limit(0)).count() == len(EDGE)


def test_index_is_small_beside_its_worker():
    """Every Python worker of an executor holds the whole index: its filters are shared by the keys of a walk."""
    import pickle
    import random

    from sparkfeat.llm import decontaminate as D

    rnd = random.Random(4)
    texts = [" ".join(f"w{rnd.randrange(5000)}" for _ in range(n)) for n in (13, 18, 28, 40, 55, 70) for _ in range(40)]
    index = D.build_index(list(range(len(texts))), texts, 0.2, 5, 0.99, 8)
    tables = [t for own in index.tables.values() for t in own]
    assert len(pickle.dumps(index)) < len(tables) * (1 << D.FILTER_BITS) / 4
    for t in tables[:16]:
        at, entry = t.find(t.keys)
        assert set(at.tolist()) == set(range(len(t.keys))) and set(entry.tolist()) == set(t.entries.tolist())
