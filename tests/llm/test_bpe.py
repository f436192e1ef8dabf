import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkfeat.llm import bpe
from sparkfeat.llm.common import tokenizer_path

PARTS = ["'", "s", "t", "re", "ve", "ll", "d", "m", "r", "v", "l", " ", "  ", "\n", "\t", "a", "B", "é", "1", "²", "!", "?", "中", "　",
         "😀", "<|endoftext|>", "'s", "\x85", "​", "\x1c", "́", "the", " the", "ing"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), min_size=1, max_size=8))
def test_ids_equal_the_library(texts):
    library = Tokenizer.from_file(tokenizer_path()) if not hasattr(test_ids_equal_the_library, "lib") else test_ids_equal_the_library.lib
    test_ids_equal_the_library.lib = library
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    ids, counts = bpe.encode(tokenizer_path(), texts)
    assert ids.tolist() == sum(want, []) and counts.tolist() == list(map(len, want))
    assert bpe.count_tokens(tokenizer_path(), texts).tolist() == list(map(len, want))


def test_every_code_point_class(library):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(chars), 100_000):
        text = "".join("a" + c + "1" + c + " " for c in chars[k:k + 100_000:37])
        assert bpe.encode(tokenizer_path(), [text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_words_runs_and_chunk_edges(library):
    for n in (bpe.CHUNK - 1, bpe.CHUNK, bpe.CHUNK + 1, 3 * bpe.CHUNK):
        texts = ["a" * n, " " * n + "x", "ab'" * n, "x" * (n - 1) + "'re " + "y" * n, "\n" * n]
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert bpe.encode(tokenizer_path(), texts)[0].tolist() == sum(want, [])


def test_a_full_state_table_starts_anew(library):
    m = bpe.BpeMachine(tokenizer_path(), max_states=50)
    words = [w.encode() for w in ("internationalization", "xylophone", "reproducibility")]
    for _ in range(3):
        for w in words:
            counts, _ = m.run(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]), False)
            assert counts.tolist() == [len(library.encode(w.decode(), add_special_tokens=False).ids)]


def test_very_long_text_is_cut_at_pretokens(library, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_CHARS", 50)
    text = "some words, more words  and 'll others " * 30
    assert bpe.encode(tokenizer_path(), [text, "", text])[0].tolist() == 2 * library.encode(text, add_special_tokens=False).ids


def test_tables_of_a_machine_are_small():
    """Every worker holds them: 50,000 tokens in less than 60 MB (before: 75 or more)."""
    import tracemalloc
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        kept = bpe.BpeMachine(tokenizer_path())
        used = (tracemalloc.get_traced_memory()[0] - before) / 1e6
    finally:
        tracemalloc.stop()
    assert kept.size > 50_000 and used < 60, used
