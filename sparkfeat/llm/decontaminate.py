"""Operator 8: benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts are sequences of words (runs of letters and digits, lower case); distances are edits of
words. A document leaks an item if some part of it is at most ``max_edits`` x the item's words
away from the whole item. A CGK random walk reads a window and repeats or advances by a
random bit of the symbol read: strings a few edits apart fall into step again, so that
edits become few differing outputs. Keys are samples of the outputs; several walks and samples
make several keys a window.

Windows are as long as the items of a class of lengths (``CLASSES``: 12 to 15 words, 16 to 23, and so on,
without an end): one walk reads on as far as the longest class asks, and each class samples outputs from the part
of it that reads an item's words. Windows start at every ``stride``-th word of every document; items are
indexed at their first words, so that some window starts in step with them. The number of walks is raised until
simulated leaks at the largest distance, with other words around them, reach ``recall`` in each class. Items
of fewer than ``SHORT`` words, and classes that ``max_walks`` walks do not bring to it, are found by exact
seeds instead: cut in one piece more than the edits allowed, one piece is unedited, so none is lost.
Candidates are verified exactly (edit distance of the whole item against the document around the place).

The items are the stated query set: they go to all documents in blocks of bounded size
(``block_chars``), found by a hash, however large the benchmark is. There is no shuffle.

Defined results: null and empty texts leak nothing; items of fewer than ``min_words`` words
are not looked for; equal items each count; repeated rows and null ids are kept; an
empty benchmark or table gives no leaks; other columns are not looked at.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfeat.llm import words
from sparkfeat.llm.common import id_text, map_batches, mix64, small_batches, texts_of

SAMPLE, KEYS, FILTER_BITS = 3, 8, 18           # outputs in a key, keys of a walk and class
SHORT = 12                                     # items of fewer words go by exact seeds
PACE = 1.4                                     # steps of a walk per word of its window: it stays half the time
SLACK = 3                                      # words that edits may shift a window's start by
END = np.uint64(0)
SCHEMA = "doc_id long, item_id long, distance long, item_words long"


def length_class(n: int) -> int:
    """Least length of an item's class: 12, 16, 24, 32, 48, 64, 96, ... words."""
    c = 1
    while 2 * c <= n:
        c *= 2
    return max(SHORT, c + c // 2 if n >= c + c // 2 else c)


def steps_of(cls: int, stride: int) -> int:
    """Steps of a walk that read the words of a window of the class, wherever in a stride it starts."""
    return max(SAMPLE, int(PACE * (cls - stride / 2)))


def walk_keys(symbols: np.ndarray, starts: np.ndarray, walk: int, classes: list[int], stride: int) -> dict[int, np.ndarray]:
    """KEYS keys per class for each start; END stops the walk (it is never stepped over)."""
    steps = {c: steps_of(c, stride) for c in classes}
    longest = max(steps.values(), default=0)
    taken: dict[int, list[tuple[int, int]]] = {}             # step → (class, key) that sample it
    for c, n in steps.items():
        rng = np.random.default_rng([walk, c])
        for k in range(KEYS):                                 # one output from each third of the class's steps
            for part in range(SAMPLE):
                lo, hi = n * part // SAMPLE, n * (part + 1) // SAMPLE
                taken.setdefault(int(rng.integers(lo, hi)), []).append((c, k))
    bits = mix64(np.arange(longest), 50 + walk) | np.uint64(1)
    pos, out = starts.copy(), {c: np.zeros((KEYS, len(starts)), np.uint64) for c in classes}
    for t in range(longest):
        s = symbols[pos]
        for c, k in taken.get(t, ()):
            own = out[c][k]
            np.multiply(np.bitwise_xor(own, s, out=own), np.uint64(words.BASE), out=own)
        pos += np.right_shift(np.multiply(s, bits[t], out=s), np.uint64(63), out=s).view(np.int64)      # END, 0, stays
    return out


@dataclass
class KeyTable:
    """Entries (item number << 32 | word number) by key."""
    keys: np.ndarray                # sorted
    entries: np.ndarray
    filter: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, entries: np.ndarray, shared: np.ndarray | None = None) -> KeyTable:
        """With ``shared``, a filter that other tables are entered in too: every worker holds all tables of an index, and
        the filters are most of it."""
        order = np.argsort(keys, kind="stable")
        table = np.zeros(1 << FILTER_BITS, bool) if shared is None else shared
        table[keys >> np.uint64(64 - FILTER_BITS)] = True
        return cls(keys[order], entries[order], table)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the keys asked for, entry) of all that meet."""
        hit = np.flatnonzero(self.filter[(keys >> np.uint64(64 - FILTER_BITS)).view(np.int64)])
        if not len(hit):
            return hit, hit
        low = np.searchsorted(self.keys, keys[hit], side="left")
        times = np.searchsorted(self.keys, keys[hit], side="right") - low
        return np.repeat(hit, times), self.entries[np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())]


@dataclass
class ItemIndex:
    ids: np.ndarray                 # item id per item
    items: list[np.ndarray]         # word hashes
    tables: dict[int, list[KeyTable]]    # by class, per walk and key
    seeds: dict[int, KeyTable]      # per length of a piece
    walks: int
    max_edits: float


def _symbols(item_words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All sequences with an END after each, and their first places."""
    sizes = np.fromiter(map(len, item_words), np.int64, len(item_words))
    firsts = np.cumsum(sizes + 1) - sizes - 1
    out = np.full(int((sizes + 1).sum()), END)
    for f, w in zip(firsts, item_words):
        out[f:f + len(w)] = w
    return out, firsts


def _keys_of(items: list[np.ndarray], numbers: np.ndarray, walk: int, cls: int, stride: int):
    """Keys of the items of one class at each of their first words, and (item, word) of each."""
    symbols, firsts = _symbols(items)
    n = [min(stride + SLACK, len(w)) for w in items]
    at = np.concatenate([np.arange(f, f + k) for f, k in zip(firsts, n)])
    entry = np.concatenate([(np.int64(i) << 32) | np.arange(k) for i, k in zip(numbers, n)])
    return walk_keys(symbols, at, walk, [cls], stride)[cls], entry


def run_keys(symbols: np.ndarray, size: int) -> np.ndarray:
    """A key of each run of ``size`` symbols, by its first place; runs over the end hold END."""
    padded, out = np.concatenate([symbols, np.full(size, END)]), np.zeros(len(symbols), np.uint64)
    for j in range(size):
        out = (out ^ padded[j:j + len(symbols)]) * np.uint64(words.BASE)
    return mix64(out, 77)


def _seeds_of(items: list[np.ndarray], numbers: np.ndarray, max_edits: float) -> dict[int, KeyTable]:
    """Each item in one piece more than its edits: the pieces' keys, by length."""
    found: dict[int, tuple[list, list]] = {}
    for i in numbers.tolist():
        w = items[i]
        cuts = np.linspace(0, len(w), min(int(max_edits * len(w)) + 1, len(w)) + 1).astype(np.int64).tolist()
        for a, b in zip(cuts, cuts[1:]):
            keys, entries = found.setdefault(b - a, ([], []))
            keys.append(run_keys(w[a:b], b - a)[0])
            entries.append((i << 32) | a)
    return {size: KeyTable.of(np.array(k, np.uint64), np.array(e, np.int64)) for size, (k, e) in sorted(found.items())}


def build_index(ids: list[int], texts: list[str], max_edits: float, min_words: int, recall: float, stride: int,
                max_walks: int = 8) -> ItemIndex | None:
    h, counts = words.word_hashes(texts) if texts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    h = np.maximum(h, np.uint64(2))                              # 0 and 1 have a meaning of their own
    cut = np.concatenate([[0], np.cumsum(counts)])
    some = [i for i in range(len(texts)) if counts[i] >= max(min_words, 1)]
    if not some:
        return None
    items = [h[cut[i]:cut[i + 1]] for i in some]
    index = ItemIndex(np.array([ids[i] for i in some]), items, {}, {}, 0, max_edits)
    classes = np.array([length_class(len(w)) for w in items])
    exact = np.array([len(w) < SHORT for w in items])
    walked = {c: np.flatnonzero(~exact & (classes == c)) for c in np.unique(classes[~exact]).tolist()}
    leaked = {c: simulated_leaks(index, numbers, stride) for c, numbers in walked.items()}
    index.tables = {c: [] for c in walked}
    short = set(walked)                                          # classes still under the recall
    while short and index.walks < max_walks:
        for c in short:                                          # a class that has reached it reads no further walk
            keys, entry = _keys_of([items[i] for i in walked[c]], walked[c], index.walks, c, stride)
            shared = np.zeros(1 << FILTER_BITS, bool)                # of the walk's keys: a row of any is looked up in each
            index.tables[c] += [KeyTable.of(keys[k], entry, shared) for k in range(KEYS)]
        index.walks += 1
        short = {c for c in short if not reaches(index, leaked[c], stride, recall)}
    for c in short:
        exact[walked[c]], index.tables[c] = True, []
    index.walks = max((len(t) // KEYS for t in index.tables.values()), default=0)
    index.seeds = _seeds_of(items, np.flatnonzero(exact), max_edits)
    return index


def simulated_leaks(index: ItemIndex, numbers: np.ndarray, stride: int, trials: int = 400) -> tuple[list[np.ndarray], list[int]]:
    """Documents that hold items, edited as often as is allowed at random places, among other words."""
    rng = np.random.default_rng(99)
    other = lambda n: rng.integers(2, 1 << 62, n).astype(np.uint64)
    docs, truth = [], []
    for _ in range(trials):
        i = int(rng.choice(numbers))
        w = list(index.items[i])
        for _ in range(int(index.max_edits * len(w))):
            at, kind = int(rng.integers(len(w))), int(rng.integers(3))
            fresh = other(1)[0]
            w[at:at + 1] = ([fresh], [fresh, w[at]], [])[kind] if len(w) > 1 else [fresh]
        docs.append(np.concatenate([other(int(rng.integers(0, stride))), np.array(w, np.uint64), other(len(w))]))
        truth.append(i)
    return docs, truth


def simulated_recall(index: ItemIndex, leaked: tuple[list[np.ndarray], list[int]], stride: int) -> float:
    """Share of the simulated leaks that meet a window."""
    docs, truth = leaked
    symbols, firsts = _symbols(docs)
    doc, item, _ = candidates(index, symbols, firsts, np.array([len(d) for d in docs]), stride)
    return len(set(zip(doc.tolist(), item.tolist())) & set(enumerate(truth))) / len(docs)


def reaches(index: ItemIndex, leaked: tuple[list[np.ndarray], list[int]], stride: int, recall: float) -> bool:
    """Whether the recall is reached, with a standard error to spare."""
    return simulated_recall(index, leaked, stride) >= recall + (recall * (1 - recall) / len(leaked[0])) ** 0.5 and recall < 1


def candidates(index: ItemIndex, symbols: np.ndarray, firsts: np.ndarray, counts: np.ndarray, stride: int):
    """(document, item, supposed place of the item's first word) of all windows and seeds that meet."""
    n = (counts + stride - 1) // stride
    owner = np.repeat(np.arange(len(counts)), n)
    starts = firsts[owner] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * stride
    found = [(np.zeros(0, np.int64),) * 3]
    for walk in range(index.walks):
        reading = [c for c, tables in index.tables.items() if len(tables) > walk * KEYS]
        for c, keys in walk_keys(symbols, starts, walk, reading, stride).items():
            for table, own in zip(index.tables[c][walk * KEYS:], keys):
                who, entry = table.find(own)
                if len(who):
                    found.append((owner[who], entry >> 32, starts[who] - (entry & 0xFFFFFFFF)))
    for size, table in index.seeds.items():
        at, entry = table.find(run_keys(symbols, size))
        found.append((np.searchsorted(firsts, at, side="right") - 1, entry >> 32, at - (entry & 0xFFFFFFFF)))
    doc, item, place = (np.concatenate(x) for x in zip(*found))
    if not len(doc):
        return doc, item, place
    # candidates of one document and item at one place are one
    order = np.lexsort((place, item, doc))
    doc, item, place = doc[order], item[order], place[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (place[1:] - place[:-1] > 0)])
    return doc[new], item[new], place[new]


def edit_distances(items: list[np.ndarray], parts: list[np.ndarray], most: np.ndarray | None = None) -> np.ndarray:
    """Least word edits between each whole item and any stretch of its part, in lock step; of those over ``most`` only
    that they are."""
    most = np.full(len(items), np.iinfo(np.int32).max, np.int64) if most is None else most
    rows, cols = max(map(len, items)), max(map(len, parts))
    a = np.zeros((len(items), rows), np.uint64)
    b = np.full((len(items), cols), np.uint64(1))
    for i, (x, y) in enumerate(zip(items, parts)):
        a[i, :len(x)], b[i, :len(y)] = x, y
    size = np.array([len(x) for x in items])
    step = np.arange(cols + 1)
    prev, best = np.zeros((len(items), cols + 1), np.int32), np.zeros(len(items), np.int64)
    # an edit changes one word at most: an item with more words that are nowhere in its part is too far away
    near = (a[:, :, None] == b[:, None, :]).any(2).sum(1) >= size - most
    best[~near] = most[~near] + 1
    if not near.any():
        return best
    if not near.all():
        best[near] = edit_distances([x for x, n in zip(items, near) if n], [x for x, n in zip(parts, near) if n], most[near])
        return best
    for r in range(rows):
        cur = prev + 1
        cur[:, 1:] = np.minimum(cur[:, 1:], prev[:, :-1] + (b != a[:, r:r + 1]))
        cur = np.minimum.accumulate(cur - step, axis=1) + step
        done = size == r + 1
        best[done] = cur[done].min(1)
        prev = cur
    return best


def find_leaks(index: ItemIndex, texts: list[str], stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, item number, distance): the least distance found of each pair."""
    out: dict[tuple[int, int], int] = {}
    for first, part in words.blocks(texts):
        h, counts = words.word_hashes(part)
        h = np.maximum(h, np.uint64(2))                          # 0 and 1 have a meaning of their own
        symbols, firsts = _symbols(np.split(h, np.cumsum(counts)[:-1]))
        doc, item, place = candidates(index, symbols, firsts, counts, stride)
        lengths = np.array([len(w) for w in index.items])[item] if len(doc) else np.zeros(0, np.int64)
        order = np.argsort(lengths, kind="stable")
        for c in range(0, len(order), 512):
            pick = order[c:c + 512]
            items, parts, pairs = [], [], []
            for i in pick:
                d, it = int(doc[i]), int(item[i])
                slack = int(index.max_edits * lengths[i]) + 1
                a, b = max(firsts[d], place[i] - slack), min(firsts[d] + counts[d], place[i] + lengths[i] + slack)
                items.append(index.items[it])
                parts.append(symbols[a:max(a, b)])
                pairs.append((first + d, it))
            most = (index.max_edits * lengths[pick]).astype(np.int64)
            for pair, dist, w in zip(pairs, edit_distances(items, parts, most).tolist(), items):
                if dist <= int(index.max_edits * len(w)):
                    out[pair] = min(dist, out.get(pair, dist))
    keys = np.array(sorted(out), np.int64).reshape(-1, 2)
    return keys[:, 0], keys[:, 1], np.array([out[k] for k in sorted(out)], np.int64)


def item_blocks(items: DataFrame, block_chars: int, item_id: str, item_text: str):
    """The items in blocks of about block_chars characters, each collected when its turn comes."""
    own = items.select(F.col(item_id).cast("long").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    total = own.agg(F.sum(F.length("t") + 1)).first()[0] or 0
    n = max(1, -(-total // block_chars))
    for k in range(n if total else 0):
        rows = own.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).sort("i", "t").collect()
        yield [r.i for r in rows], [r.t for r in rows]


def indexes(items: DataFrame, max_edits: float, min_words: int, recall: float, stride: int, block_chars: int,
            item_id: str, item_text: str):
    for ids, texts in item_blocks(items, block_chars, item_id, item_text):
        index = build_index(ids, texts, max_edits, min_words, recall, stride)
        if index is not None:
            yield index


def leaks(docs: DataFrame, items: DataFrame, max_edits: float = 0.2, min_words: int = 5, recall: float = 0.99, stride: int = 8,
          block_chars: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
          item_text: str = "text") -> DataFrame:
    """One row per document and item that it leaks: doc_id, item_id, distance (word edits),
    item_words."""
    small_batches(docs.sparkSession, mb=4)
    rows, found = id_text(docs, id_col, text_col), []
    for index in indexes(items, max_edits, min_words, recall, stride, block_chars, item_id, item_text):
        def work(batch: pa.RecordBatch, index=index) -> dict:
            doc, item, distance = find_leaks(index, texts_of(batch), stride)
            return {"doc_id": batch.column("doc_id").take(pa.array(doc)),
                    "item_id": pa.array([index.ids[i] for i in item], pa.int64()), "distance": pa.array(distance),
                    "item_words": pa.array([len(index.items[i]) for i in item], pa.int64())}
        found.append(map_batches(rows, work, SCHEMA))
    return functools.reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], SCHEMA)


def drop_leaking(docs: DataFrame, items: DataFrame, max_edits: float = 0.2, min_words: int = 5, recall: float = 0.99,
                 stride: int = 8, block_chars: int = 2_000_000, text_col: str = "text", item_id: str = "item_id",
                 item_text: str = "text") -> DataFrame:
    """The documents that leak no item, with all their columns."""
    small_batches(docs.sparkSession, mb=4)
    for index in indexes(items, max_edits, min_words, recall, stride, block_chars, item_id, item_text):
        def keep(batch: pa.RecordBatch, index=index) -> pa.RecordBatch:
            doc, _, _ = find_leaks(index, [t or "" for t in batch.column(text_col).to_pylist()], stride)
            mask = np.ones(batch.num_rows, bool)
            mask[doc] = False
            return batch.filter(pa.array(mask))
        docs = map_batches(docs, keep, docs.schema)
    return docs
