"""Operator 9: language-model scoring with a causal self-attention model over subword ids.

``score_texts`` learns from the documents of ``learn`` and scores all. A text is its words
(runs of characters other than ASCII white space, A-Z in lower case), joined by single spaces
for the subword tokenizer, and one end. Two scores, both log10 probabilities of whole texts:

* ``score``: the attention model of ``attention.py``. Subword and class-bigram counts
  come from all documents to learn from; the weights are trained on all of them too, dealt over
  ``rounds`` rounds by a hash: every trainer reads its own part, batch by batch, from common weights, the
  weights are averaged by an aggregate after each round. A trainer's part is about TRAINER_IDS ids, whatever
  the corpus and the cluster: more data means more trainers, and the scores of a corpus do not depend on partitions
  or on the order of rows. ``share`` > 1 takes only 1/share of the documents.
* ``base_score``: add-one word unigrams with exact counts over all documents to learn from.
  Blocks of documents ask for the counts of their distinct words, one message per block and
  bucket of the hash space; a bucket's task adds up and answers; answers meet the block's
  postings again. A word is asked for once a block however frequent it is.

The result is the same for equal texts and is joined to the documents by the text's digest: subword ids are
kept, counted with their copies, and scored once for each different text.

Defined results: a null text counts as empty, an empty text is the end alone; documents with
null ids are scored (and learned from only if the caller's condition says so); repeated rows are
kept; with nothing to learn from, all counts are 0 and the weights stay at their start; an empty
table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfeat.llm import bpe, words
from sparkfeat.llm.attention import Scorer, Trainer, Vocabulary, flat, start_parameters, unflat
from sparkfeat.llm.common import map_batches, mix64, partitions, release_memory, small_batches, stored, texts_of

#: ASCII white space parts words
IN_WORD = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
OTHER_CODE = mix64(np.arange(256), 9) >> np.uint64(1)
END_WORD = (np.uint64(1), np.uint64(1))
#: A word in a message: 96 bits of its two hashes.
WORD = np.dtype([("one", "<u8"), ("two", "<u4")])
BLOCK_CHARS = 4_000_000
ASKED = "kind int, block string, bucket int, a binary, b binary, c binary, d binary, e binary"
RESULT = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def lowered(text: str) -> bytes:
    """UTF-8 with A-Z in lower case; bytes split and lower by ASCII rules alone."""
    return text.encode("utf-8", "surrogatepass").lower()


def word_pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every word of all texts, and words per text."""
    raw = [lowered(t) for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    firsts = np.cumsum(sizes + 1) - sizes - 1
    a, b = words.spans(IN_WORD[data])
    counts = np.diff(np.append(np.searchsorted(a, firsts), len(a)))
    return words.span_hashes(data, a, b), words.span_hashes(OTHER_CODE[data], a, b), counts


def plain(text: str) -> str:
    """Words in lower case, one space between them."""
    return b" ".join(lowered(text).split()).decode("utf-8", "surrogatepass")


def subwords(path: str, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of every text, each with the end id behind it."""
    ids, counts = bpe.encode(path, [plain(t) for t in texts])
    at = np.cumsum(counts + 1)
    out = np.full(int(at[-1]) if len(at) else 0, end_id, np.int32)
    inner = np.ones(len(out), bool)
    inner[at - 1] = False
    out[inner] = ids
    return out, counts + 1


def _ask(n_buckets: int):
    """Per block: a message to each bucket (kind 0) and the block's postings (1)."""
    def block_rows(name: str, texts: list[str], tids: list[bytes], learn: np.ndarray) -> Iterator[tuple]:
        n = len(texts)
        h1, h2, counts = word_pairs(texts)
        owner = np.concatenate([np.repeat(np.arange(n), counts), np.arange(n)])
        h1 = np.concatenate([h1, np.full(n, END_WORD[0])])
        h2 = np.concatenate([h2, np.full(n, END_WORD[1])])
        # one stable sort puts equal words together, by bucket, and their documents in order
        bucket = h1 % np.uint64(n_buckets)
        by_word = np.argsort(h1 // np.uint64(n_buckets), kind="stable")
        by_word = by_word[np.argsort(bucket[by_word].astype(np.uint16 if n_buckets <= 1 << 16 else np.uint64), kind="stable")]
        h1, h2, owner, bucket = h1[by_word], h2[by_word], owner[by_word], bucket[by_word].astype(np.int64)
        new = np.concatenate([[True], h1[1:] != h1[:-1]])
        at = np.flatnonzero(new | np.concatenate([[True], owner[1:] != owner[:-1]]))
        word, doc, times = (np.cumsum(new) - 1)[at], owner[at], np.diff(np.append(at, len(owner)))
        h1, h2, bucket = h1[new], h2[new], bucket[new]
        learned = np.bincount(word, times * learn[doc], len(h1)).astype("<u4")
        cut = np.searchsorted(bucket, np.arange(n_buckets + 1))
        both = np.empty(len(h1), WORD)
        both["one"], both["two"] = h1, h2.astype(np.uint32)
        for k in range(n_buckets):
            i, j = cut[k], cut[k + 1]
            if i < j:
                yield 0, name, k, both[i:j].tobytes(), learned[i:j].tobytes(), b"", b"", b""
        yield (1, name, -1, doc.astype("<u4").tobytes(), times.astype("<u4").tobytes(),
               np.bincount(word, minlength=len(h1)).astype("<u4").tobytes(), b"".join(tids), (counts + 1).astype("<i8").tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task, number = TaskContext.get().partitionId(), 0
        texts, tids, learn, size = [], [], [], 0

        def flush():
            nonlocal number, texts, tids, learn, size
            for row in block_rows(f"{task}-{number}", texts, tids, np.array(learn, bool)):
                yield pa.RecordBatch.from_pydict({f.split()[0]: [v] for f, v in zip(ASKED.split(", "), row)}, pa.schema(
                    [("kind", pa.int32()), ("block", pa.string()), ("bucket", pa.int32()), *((x, pa.binary()) for x in "abcde")]))
            number, texts, tids, learn, size = number + 1, [], [], [], 0
        for b in batches:
            for t, x in zip(texts_of(b), b.column("learn").to_pylist()):
                texts.append(t)
                tids.append(hashlib.md5(t.encode("utf-8", "surrogatepass")).digest())
                learn.append(x)
                size += len(t) + 1
                if size >= BLOCK_CHARS:
                    yield from flush()
        if texts:
            yield from flush()
    return run


ANSWERED = "block string, bucket int, counts binary, total long, distinct_words long"


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: adds up the counts of its words and answers every block."""
    names, keys, learned, bucket = [], [], [], None
    for b in batches:
        names += b.column("block").to_pylist()
        keys += [np.frombuffer(x, WORD) for x in b.column("a").to_pylist()]
        learned += [np.frombuffer(x, "<u4") for x in b.column("b").to_pylist()]
        bucket = b.column("bucket")[0].as_py() if b.num_rows else bucket
    if not names:
        return
    sizes = [len(k) for k in keys]
    keys, learned = np.concatenate(keys), np.concatenate(learned).astype(np.float64)
    order = np.lexsort((keys["two"], keys["one"]))
    one, two = keys["one"][order], keys["two"][order]
    new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
    group = np.empty(len(keys), np.int64)
    group[order] = np.cumsum(new) - 1
    total = np.bincount(group, learned)
    answer, at = total[group].astype("<u8"), 0
    for i, (name, size) in enumerate(zip(names, sizes)):
        yield pa.RecordBatch.from_pydict({
            "block": [name], "bucket": pa.array([bucket], pa.int32()), "counts": pa.array([answer[at:at + size].tobytes()], pa.binary()),
            "total": [int(total.sum()) if i == 0 else 0], "distinct_words": [int((total > 0).sum()) if i == 0 else 0]})
        at += size


def _block_scores(pdf, norm: float):
    """The base scores of one block: postings first, then the answers of all buckets in order."""
    import pandas as pd
    pdf = pdf.sort_values("bucket")
    own = pdf.iloc[0]
    doc, times = np.frombuffer(own["a"], "<u4"), np.frombuffer(own["b"], "<u4")
    n_tokens = np.frombuffer(own["e"], "<i8")
    counts = np.concatenate([np.frombuffer(x, "<u8") for x in pdf["counts"].iloc[1:]])
    c = np.repeat(counts, np.frombuffer(own["c"], "<u4"))
    n = len(n_tokens)
    return pd.DataFrame({"tid": [own["d"][16 * i:16 * i + 16].hex() for i in range(n)], "n_tokens": n_tokens,
                         "n_known": np.bincount(doc, times * (c > 0), n).astype(np.int64),
                         "base_score": np.bincount(doc, times * np.log10(c + 1.0), n) - n_tokens * norm})


def base_scores(asked: DataFrame, n_buckets: int) -> tuple[DataFrame, int]:
    """(one row per text digest: n_tokens, n_known, base_score; tokens learned from)."""
    answered = stored(asked.where("kind = 0").select("block", "bucket", "a", "b").repartitionById(n_buckets, F.col("bucket"))
                      .mapInArrow(_answer, ANSWERED), "lm-answers")
    total, distinct = answered.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct_words"), F.lit(0))).first()
    norm = float(np.log10(total + distinct + 1.0))
    none = F.lit(None).cast("binary")
    rows = asked.where("kind = 1").select("block", "bucket", "a", "b", "c", "d", "e", none.alias("counts")).union(
        answered.select("block", "bucket", *[none.alias(x) for x in "abcde"], "counts"))
    each = rows.groupBy("block").applyInPandas(lambda pdf: _block_scores(pdf, norm), "tid string, n_tokens long, n_known long, base_score double")
    return each.groupBy("tid").agg(*[F.first(x).alias(x) for x in ("n_tokens", "n_known", "base_score")]), int(total)


IDS = "tid string, ids binary, learn boolean"


def subword_table(rows: DataFrame, path: str, end_id: int) -> DataFrame:
    """The subword ids of every different text with ``n``, how many documents to learn from have it; written once and
    read by all later passes."""
    kind = id_type(path)

    def work(batch: pa.RecordBatch) -> dict:
        texts = texts_of(batch)
        ids, counts = subwords(path, texts, end_id)
        cuts = np.concatenate([[0], np.cumsum(counts)])
        ids = ids.astype(kind)
        return {"tid": [hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts],
                "ids": pa.array([ids[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()), "learn": batch.column("learn")}
    each = map_batches(rows, work, IDS).groupBy("tid").agg(F.first("ids").alias("ids"), F.count_if("learn").alias("n"))
    return stored(each, "lm-ids")


def id_type(path: str):
    return np.uint16 if bpe.machine(path).size <= 1 << 16 else np.uint32


def ids_of(batch: pa.RecordBatch, kind) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(x, kind) for x in batch.column("ids").to_pylist()]
    return np.concatenate(parts).astype(np.int32), np.array([len(p) for p in parts])


def counted(learn: DataFrame, kind, keys_of) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, counts) of what ``keys_of`` makes of the ids of each batch. Counts are
    combined per task and by an aggregate; the number of different keys is bounded by the caller."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            if b.num_rows:
                ids, sizes = ids_of(b, kind)
                new, n = np.unique(keys_of(ids), return_counts=True)
                copies = b.column("n").to_numpy() - 1
                if copies.any():                                 # a text counts once for each of its documents
                    again = np.repeat(copies, sizes)
                    np.add.at(n, np.searchsorted(new, keys_of(ids)[again > 0]), again[again > 0])
                keys, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
                times = np.bincount(where, np.concatenate([times, n]), len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "n": pa.array(times, pa.int64())})
    got = learn.select("ids", "n").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).sort("key").toArrow()
    return got.column("key").to_numpy(), got.column("n").to_numpy()


def class_pairs(vocabulary: Vocabulary):
    """Class before x vocabulary + id, for every id; every text follows an end."""
    def keys(ids: np.ndarray) -> np.ndarray:
        before = np.concatenate([[vocabulary.end], vocabulary.of[ids[:-1]]])
        return before.astype(np.int64) * len(vocabulary.of) + ids
    return keys


OWN_ROWS = 256                       # ids whose own vectors travel together
WEIGHTS = "chunk int, times binary, value binary"


def _added(pdf):
    """The sums of one chunk over all trainers."""
    import pandas as pd
    times = np.sum([np.frombuffer(x, np.float32) for x in pdf["times"]], 0, np.float64)
    value = np.sum([np.frombuffer(x, np.float32) for x in pdf["value"]], 0, np.float64)
    return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "times": [times.astype("<f8").tobytes()], "value": [value.astype("<f8").tobytes()]})


#: What one trainer reads in a round.
TRAINER_IDS = 1 << 21


def trained(learn: DataFrame, kind, vocabulary: Vocabulary, parameters: dict, share: int, rounds: int, n_ids: int) -> dict:
    """Averaged weights after ``rounds`` rounds of local training, each on another 1/(share x
    rounds) of the texts (``n_ids`` ids in all), read from ``learn`` in each round. Copies of a text are dealt like different texts. An id's own
    vector is moved by the mean of its trainers' moves, by how often each has read it."""
    of = vocabulary.of.astype(np.int16)
    trainers = max(1, -(-n_ids // (share * rounds * TRAINER_IDS)))
    expected = n_ids // (share * rounds * trainers)
    trainer_of = F.pmod(F.xxhash64("tid", "copy", F.lit("trainer")), F.lit(trainers))
    for r in range(rounds):
        def run(batches: Iterator[pa.RecordBatch], p=parameters) -> Iterator[pa.RecordBatch]:
            trainer, times = None, np.zeros(len(of), np.float32)
            for b in batches:
                if b.num_rows:
                    trainer = trainer or Trainer(p, expected, of)
                    ids = ids_of(b, kind)[0]
                    times += np.bincount(ids, minlength=len(of))
                    trainer.feed(ids)
            if trainer:
                got = trainer.finish()
                weights = flat(got).astype(np.float32)
                out = [(-1, np.ones(1, np.float32), weights)]
                moves = (got["own"] - p["own"]) * times[:, None]
                out += [(i, times[i:i + OWN_ROWS], moves[i:i + OWN_ROWS]) for i in range(0, len(of), OWN_ROWS) if times[i:i + OWN_ROWS].any()]
                chunk, n, value = zip(*out)
                yield pa.RecordBatch.from_pydict({"chunk": pa.array(chunk, pa.int32()), "times": pa.array([x.tobytes() for x in n], pa.binary()),
                                                  "value": pa.array([x.tobytes() for x in value], pa.binary())})
            release_memory()
        own_copies = F.filter(F.sequence(F.lit(1).cast("long"), "n"), lambda c: F.pmod(F.xxhash64("tid", c, F.lit("share")), F.lit(share * rounds)) == F.lit(r))
        mine = (learn.select("tid", "ids", F.explode(own_copies).alias("copy"))
                .repartitionById(trainers, trainer_of.cast("int"))
                .sortWithinPartitions(F.xxhash64("tid", "copy", F.lit("order")), "tid", "copy").select("ids"))
        got = mine.mapInArrow(run, WEIGHTS).groupBy("chunk").applyInPandas(_added, WEIGHTS).sort("chunk").toArrow().to_pylist()   # one row per chunk of ids
        own = parameters["own"].copy()
        for row in got:
            i, times, value = row["chunk"], np.frombuffer(row["times"], "<f8"), np.frombuffer(row["value"], "<f8")
            if i < 0:
                parameters = unflat(parameters, value / times[0])
            else:
                own[i:i + len(times)] += (value.reshape(len(times), -1) / np.maximum(times, 1)[:, None]).astype(np.float32)
        parameters = parameters | {"own": own}
    return parameters


def score_texts(docs: DataFrame, path: str, learn: Column, share: int = 1, rounds: int = 4, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out (not learned from), n_tokens, n_known,
    train_tokens, base_score, score."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       F.coalesce(learn, F.lit(False)).alias("learn"))
    m, kind = bpe.machine(path), id_type(path)
    end_id, n_buckets = max(m.special.values(), default=m.size - 1), partitions(spark)
    asked = stored(rows.mapInArrow(_ask(n_buckets), ASKED), "lm-asked")
    base, total = base_scores(asked, n_buckets)
    table = subword_table(rows, path, end_id)
    teach = table.where("n > 0")
    ids, times = counted(teach, kind, lambda x: x)                               # at most one row per id
    counts = np.zeros(m.size)
    counts[ids] = times
    vocabulary = Vocabulary(counts, end_id)
    vocabulary.set_pairs(*counted(teach, kind, class_pairs(vocabulary)))         # at most classes x ids rows
    scorer = Scorer(trained(teach, kind, vocabulary, start_parameters(vocabulary.after, n_ids=m.size), share, rounds,
                            int(times.sum())), vocabulary)

    def score(batch: pa.RecordBatch) -> dict:
        return {"tid": batch.column("tid"), "score": pa.array(scorer.score(*ids_of(batch, kind)))}

    scored = map_batches(table.select("tid", "ids"), score, "tid string, score double").join(base, "tid")
    return rows.select("doc_id", "learn", F.md5("text").alias("tid")).join(scored, "tid").select(
        "doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
