import zlib

import numpy as np
from tokenizers import Tokenizer

from sparkfeat.llm import packing, token_count
from .conftest import EDGE


def test_counts_of_edge_cases(edge, none, path):
    library = Tokenizer.from_file(path)
    rows = token_count.count_tokens(edge, path).collect()
    want = sorted((i is None, i or 0, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in EDGE)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in rows)
    assert token_count.count_tokens(none, path).count() == 0


def check_pieces(rows, docs, library):
    at = 0
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * 1024 + r.offset == at            # gapless, one sequence after another
        at += r.length
    for doc, text in docs:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        own = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert sum(r.length for r in own) == len(ids) and all(r.doc_tokens == len(ids) for r in own)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())


def test_packing_places_every_id_once(docs, path):
    rows = packing.pack(docs, path).collect()
    check_pieces(rows, [(r.doc_id, r.text) for r in docs.collect()], Tokenizer.from_file(path))


def test_packing_of_edge_cases(edge, none, path):
    rows = packing.pack(edge, path, with_ids=True).collect()
    library = Tokenizer.from_file(path)
    single = [(i, t) for i, t, _ in EDGE if [x for x, _, _ in EDGE].count(i) == 1 and i is not None]
    check_pieces(rows, [], library)
    for doc, text in single:
        own = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start)
        assert np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids + [0]
    assert sum(r.length for r in rows) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in EDGE)
    assert packing.pack(none, path).count() == 0


def test_hilbert_key_visits_neighbours():
    cube = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert_key(cube, 3)
    assert sorted(key) == list(range(512))
    walk = cube[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()
