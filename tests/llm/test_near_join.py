import random
import re

from sparkfeat.llm import graph, near_join
from .conftest import EDGE


def brute(rows):
    """(id, class, links, set size) of every row by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x09-\x0D\x20]+", (t or "").lower()) if x]
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    linked = [[j for j, b in enumerate(sets) if j != i and a and b and len(a & b) >= 0.8 * len(a | b)] for i, a in enumerate(sets)]
    out = []
    for i, (doc, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((doc, min(ids) if ids and sets[i] else doc, len(linked[i]), len(sets[i])))
    return sorted(out, key=repr)


def got(df, **kw):
    return sorted(((r.doc_id, r.class_id, r.n_links, r.set_size) for r in near_join.near_join(df, **kw).collect()), key=repr)


def test_against_brute_force_with_a_hot_group(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(50)}" for _ in range(120)]
    rows = []
    for i in range(90):
        w = list(base) if i < 60 else [f"v{rng.randrange(1000)}" for _ in range(60)]
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    rows += rows[:25]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    assert got(df) == want
    assert got(df, block=7) == want                               # groups cut into many blocks


def test_edge_cases(edge, none):
    assert got(edge) == brute([(i, t) for i, t, _ in EDGE])
    assert near_join.near_join(none).count() == 0
    kept = near_join.keep_representatives(edge)
    assert kept.columns == edge.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([0, 1, 2, None, 3, 4, 5, 7, 8], key=repr)


def test_prefix_depth_reaches_recall():
    d = near_join.prefix_depth(0.8, 24, 8, 0.9999)
    assert 1 - (1 - 0.8 ** d) ** 24 >= 0.9999 > 1 - (1 - 0.8 ** (d + 1)) ** 24


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(5, 5), (200, 201), (201, 200)]
    rows = graph.components(spark.createDataFrame(edges, "a long, b long"), "test").collect()
    assert {(r.node, r.root) for r in rows} == {(i, 1) for i in range(2, 41)} | {(i, 100) for i in range(101, 130)} | {(201, 200)}


def test_pairs_of_a_group_that_met_in_no_tree_are_linked(monkeypatch, spark):
    from pyspark.sql import functions as F
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[:56]), " ".join(words[:55]), " ".join(words[1:56])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    star = lambda sets, trees, depth: near_join.np.array(
        [[1, 2] if len(s) == 52 else [1, i + 10] if i == 1 else [i + 20, 2] for i, s in enumerate(sets)], near_join.np.uint64)
    monkeypatch.setattr(near_join, "labels", star)
    got = near_join.near_join(df.coalesce(1).sort(F.col("doc_id")), trees=2).collect()
    assert {r.n_links for r in got} == {2} and {r.class_id for r in got} == {0}


def test_one_id_on_two_texts_and_several_without(spark):
    """A class keeps one document whatever ids its texts have elsewhere."""
    a, b, c = (" ".join(f"{w}{i}" for i in range(30)) for w in "abc")
    rows = [(1, a), (2, a), (2, b), (None, a), (None, c), (None, c + " more"), (None, ""), (3, None), (3, "")]
    kept = near_join.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = sorted(map(repr, map(tuple, kept.collect())))
    assert len([r for r in got if "a1 " in r]) == 1 and repr((1, a)) in got          # least id
    assert repr((2, b)) in got
    assert len([r for r in got if "c1 " in r]) == 1                                   # one of two without an id
    assert repr((None, "")) in got
