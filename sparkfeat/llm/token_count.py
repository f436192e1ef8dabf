"""Operator 3: token counts by finite-state tokenizer compilation.

``count_tokens`` counts the tokens that a byte-level BPE tokenizer file gives every whole
text. The tokenizer is compiled to deterministic transducers (``bpe.py``): one marks where
pretokens start, chunk by chunk, and a prefix scan composes the chunks' state maps; one reads
the pretokens' bytes in lock step and its transitions carry the number of tokens that they
add. Each task works on batches of bounded size; there is no shuffle.

Defined results: a null or empty text has 0 bytes and 0 tokens; special strings inside a text
count one token each (the library's default); rows are kept one to one, repeated rows and null
ids included; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from sparkfeat.llm import bpe
from sparkfeat.llm.common import id_text, map_batches, small_batches, texts_of

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    small_batches(docs.sparkSession)

    def count(batch: pa.RecordBatch) -> dict:
        texts = texts_of(batch)
        n = bpe.count_tokens(path, texts)
        return {"doc_id": batch.column("doc_id"), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)}

    return map_batches(id_text(docs, id_col, text_col), count, SCHEMA)
