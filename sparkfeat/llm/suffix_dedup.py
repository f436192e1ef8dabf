"""Operator 2: removal of repeated byte strings by a collection BWT built column by column.

A window is ``length`` bytes. ``remove_repeats`` removes every byte covered by a window whose
content starts anywhere else too, in whatever document. Equal windows have equal minimizers
(the least hashed gram in them), so windows are dealt by minimizer: a piece is the run of
windows around one minimizer, at most length + windows bytes, and two equal windows always are in
two pieces of one minimizer.

Steps. (1) One map counts minimizers; those that occur once cannot hold a repeat. The others
are marked in a bitmap of fixed size (2^``bitmap_bits``; chance marks cost work, not
results). (2) One map writes the marked pieces; equal pieces are combined by an aggregate: a
piece that occurs twice is repeated all over. (3) Buckets of different pieces: each task builds
the Burrows-Wheeler transform and the common-prefix lengths of its pieces by
inserting, in each round, one symbol of every piece (``column_bwt``; a symbol is a word of up to
8 bytes, and a piece is read from each of as many starts); transform and prefixes
live in sequential files that a round reads and writes anew. Windows with a common prefix of
``length`` with a neighbour are repeated. (4) Flags return to the documents by their text's
digest, so copies of a text are worked on once.

Buckets hold about ``bucket_pieces`` pieces. A minimizer with more than ``hot_pieces`` different
pieces takes an exact way round: its windows are counted by their digests in an aggregate.

Defined results: a null text counts as empty; texts shorter than a window are left whole;
repeated rows remove each other's bytes like any copies; null ids are kept; an empty table
gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfeat.llm import words
from sparkfeat.llm.common import id_text, map_batches, mix64, partitions, release_memory, small_batches, stored, texts_of

GRAM = 48
PLACE_BITS = 24
PIECES = "m long, sid binary, tid binary, n long, pos int, windows int, content binary"
FLAGS = "sid binary, flags binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, by running minima of blocks from both sides."""
    n = len(x) - width + 1
    padded = np.concatenate([x, np.full(-len(x) % width, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def find_pieces(data: np.ndarray, firsts: np.ndarray, ends: np.ndarray, length: int):
    """(first window, number of windows, minimizer) of every piece of texts laid end to end."""
    gram = min(GRAM, length)
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty
    up, down = words.powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    n = len(data) - gram + 1
    low = np.uint64(PLACE_BITS)
    value = mix64((sums[gram:] - sums[:-gram]) * down[:n]) >> low
    least = sliding_min((value << low) | np.arange(n, dtype=np.uint64), length - gram + 1)   # leftmost of equals
    whole = np.zeros(len(least) + 1, np.int32)
    some = ends - firsts >= length
    np.add.at(whole, firsts[some], 1)
    np.add.at(whole, ends[some] - length + 1, -1)
    whole = np.cumsum(whole[:-1]) > 0                                       # windows inside one text
    change = np.concatenate([[True], (least[1:] != least[:-1])])
    change[firsts[some]] = True
    starts = np.flatnonzero(whole & (change | np.concatenate([[True], ~whole[:-1]])))
    last = whole & np.concatenate([change[1:] | ~whole[1:], [True]])
    return starts, np.flatnonzero(last) + 1 - starts, (least[starts] >> low).astype(np.int64)


def byte_blocks(texts: list[str], limit: int = 1_000_000):
    """(texts as one byte array, first places, ends) in blocks; place numbers of a block must
    fit PLACE_BITS, so longer texts are cut with an overlap by ``cut_texts``."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    i = 0
    while i < len(raw):
        j, size = i, 0
        while j < len(raw) and (j == i or size + len(raw[j]) <= limit):
            size += len(raw[j])
            j += 1
        sizes = np.array([len(x) for x in raw[i:j]])
        ends = np.cumsum(sizes)
        yield i, b"".join(raw[i:j]), ends - sizes, ends
        i = j


def cut_pieces(data: bytes, firsts: np.ndarray, ends: np.ndarray, length: int):
    """find_pieces over a block; one very long text is read in overlapping stretches."""
    array, reach = np.frombuffer(data, np.uint8), (1 << PLACE_BITS) - 2 * length
    if len(array) <= reach:
        return find_pieces(array, firsts, ends, length)
    parts = []                                                               # a single text
    for a in range(0, len(array) - length + 1, reach):
        b = min(len(array), a + reach + length - 1)
        s, w, m = find_pieces(array[a:b], np.array([0]), np.array([b - a]), length)
        parts.append((s + a, w, m))
    return tuple(np.concatenate(x) for x in zip(*parts))


class SequentialFiles:
    """Symbols and prefix lengths of one bucket on disk, in two pairs of files used by turns:
    each round reads the last pair from start to end and writes over the other one. The files stay
    open and only grow, so no round waits for the disk."""

    def __init__(self, folder: str):
        self.files = [[open(os.path.join(folder, f"{name}-{k}"), "w+b", buffering=0) for name in ("symbols", "prefixes")] for k in range(2)]
        self.round, self.size = 0, 0

    def write(self, symbols: np.ndarray, prefixes: np.ndarray):
        self.round, self.size, self.kinds = self.round + 1, len(symbols), (symbols.dtype, prefixes.dtype)
        for f, values in zip(self.files[self.round % 2], (symbols, prefixes)):
            f.seek(0)
            f.write(memoryview(values))

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for f, kind in zip(self.files[self.round % 2], self.kinds):
            values = np.empty(self.size, kind)
            f.seek(0)
            f.readinto(memoryview(values))
            out.append(values)
        return out[0], out[1]

    def __enter__(self) -> SequentialFiles:
        return self

    def __exit__(self, *_):
        for f in (*self.files[0], *self.files[1]):
            f.close()


def range_minima(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 64) -> np.ndarray:
    """Least value of each non-empty range [start, end): running minima inside blocks, doubling
    steps over whole blocks."""
    grid = np.concatenate([values, np.full(-len(values) % block, 255, np.uint8)]).reshape(-1, block)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    first, last = starts // block, (ends - 1) // block
    out = np.minimum(back[starts], ahead[ends - 1])
    inside = np.flatnonzero(first == last)
    if len(inside):
        inside = inside[np.argsort(-starts[inside], kind="stable")]    # falling starts: nothing between is read
        pairs = np.stack([starts[inside], ends[inside]], 1).ravel()
        out[inside] = np.minimum.reduceat(np.append(values, 0), pairs)[::2]
    far = np.flatnonzero(last - first > 1)
    if len(far):
        span = last[far] - first[far] - 1
        level = np.frexp(span.astype(np.float64))[1] - 1
        table = ahead[block - 1::block]
        for k in range(int(level.max()) + 1):
            own = far[level == k]
            out[own] = np.minimum(out[own], np.minimum(table[first[own] + 1], table[last[own] - (1 << k)]))
            table = np.append(np.minimum(table[:-(1 << k)], table[1 << k:]), table[len(table) - (1 << k):])
    return out


def column_bwt(pieces: list[bytes], length: int, files: SequentialFiles) -> list[np.ndarray]:
    """Per piece, for each window in it: does its content start at another place of the bucket?

    A symbol is a word of ``step`` bytes, and a piece is read once from each of its first
    ``step`` bytes on, so that every window starts a suffix of one of these strings.

    The transform lists, in the order of all suffixes inserted so far, the symbol before each
    one. The empty suffixes come first. A round puts the next symbol (from the right) of every
    string before its latest suffix; sorting the transform's symbols, equal ones in order, gives
    the order of the suffixes one longer, and so the places of the new ones. The prefix that a
    new suffix shares with its neighbour is one more than the least prefix between their tails' places."""
    joined = np.frombuffer(b"".join(pieces) + bytes(7), np.uint8)
    for step in (k for k in (8, 4, 2, 1) if length % k == 0):        # the longest words that 16 bits can number
        word = sum(joined[k:len(joined) - step + 1 + k].astype(np.uint64) << np.uint64(8 * k) for k in range(step))
        used, code = np.unique(word, return_inverse=True)
        if len(used) < 1 << 16:
            break
    code = (code + 1).astype(np.uint16 if len(used) < 1 << 16 else np.uint32)      # 0: nothing before it (yet)
    cap = length // step
    sizes = np.repeat([len(p) for p in pieces], step) - np.tile(np.arange(step), len(pieces))
    count = sizes // step                                            # symbols of each string
    ends = np.repeat(np.cumsum([len(p) for p in pieces]), step)
    order = np.argsort(-count, kind="stable")                        # long strings first: the active ones lead
    count, final = count[order], (ends - sizes + (count - 1) * step)[order]      # place of the last symbol
    n = len(count)
    places = np.arange(n)                                            # of every string's latest suffix
    files.write(np.zeros(n, code.dtype), np.zeros(n, np.uint8))
    for r in range(int(count[0])):
        symbols, prefixes = files.read()
        active = int(np.searchsorted(-count, -r, side="left"))       # strings longer than r
        before_it = code[final[:active] - r * step]
        symbols[places[:active]] = before_it
        by_symbol = np.argsort(symbols, kind="stable")[len(symbols) - np.count_nonzero(symbols):]
        latest = np.zeros(len(symbols), bool)
        latest[places[:active]] = True
        fresh = latest[by_symbol]
        new = np.flatnonzero(fresh)                                  # their ranks, by symbol and place
        moved = np.lexsort((places[:active], before_it))
        places[moved] = n + new
        behind = fresh.copy()                                        # new suffixes and those behind them
        behind[1:] |= fresh[:-1]
        touched = np.flatnonzero(behind)
        here, before = by_symbol[touched], by_symbol[touched - 1]
        same = np.flatnonzero((touched > 0) & (symbols[here] == symbols[before]))
        value = np.zeros(len(touched), np.uint8)
        if len(same):
            least = range_minima(prefixes, before[same] + 1, here[same] + 1)
            value[same] = np.minimum(least.astype(np.int32) + 1, cap)
        grown = np.zeros(n + len(by_symbol), code.dtype)
        shared = np.zeros(n + len(by_symbol), np.uint8)
        grown[:n] = symbols[:n]
        old = ~fresh
        grown[n:][old], shared[n:][old] = symbols[n:], prefixes[n:]
        shared[n + touched] = value
        files.write(grown, shared)
    symbols, prefixes = files.read()
    by_symbol = np.argsort(symbols, kind="stable")[len(symbols) - np.count_nonzero(symbols):]
    longer = np.zeros(len(symbols), np.int64)                        # from a suffix to the one a symbol longer
    longer[by_symbol] = n + np.arange(len(by_symbol))
    repeated = prefixes >= cap
    repeated[:-1] |= repeated[1:]
    out = [np.zeros(len(p) - length + 1, bool) for p in pieces]
    flat, first = np.zeros(sum(map(len, out)), bool), np.cumsum([0] + [len(o) for o in out])
    base, phase = first[order // step], order % step
    at = np.arange(n)
    for r in range(1, int(count[0]) + 1):
        active = int(np.searchsorted(-count, -r, side="right"))
        at[:active] = longer[at[:active]]
        if r >= cap:
            flat[base[:active] + phase[:active] + (count[:active] - r) * step] = repeated[at[:active]]
    return [flat[a:b] for a, b in zip(first, first[1:])]


def _bucket_flags(length: int):
    def run(pdf):
        import pandas as pd
        many = pdf["m"].map(pdf["m"].value_counts()) > 1
        alone = pdf.groupby("m")["n"].transform("min") == 1
        need = pdf[many & alone]
        flags = dict(zip(pdf["sid"][pdf["n"] > 1], (b"\xff" * -(-w // 8) for w in pdf["windows"][pdf["n"] > 1])))
        if len(need):
            with tempfile.TemporaryDirectory() as folder, SequentialFiles(folder) as files:
                found = column_bwt(need["content"].tolist(), length, files)
            for sid, count, hit in zip(need["sid"], need["n"], found):
                if count == 1 and hit.any():
                    flags[sid] = np.packbits(hit).tobytes()
        return pd.DataFrame({"sid": list(flags), "flags": list(flags.values())})
    return run


def _piece_rows(bits: np.ndarray, bitmap_bits: int, length: int):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, cols = texts_of(batch), [[] for _ in range(7)]
        times: dict[str, int] = {}
        for t in texts:
            times[t] = times.get(t, 0) + 1
        texts, shown = list(times), set()
        for first, data, firsts, ends in byte_blocks(texts):
            start, windows, m = cut_pieces(data, firsts, ends, length)
            slot = mix64(m, 1) & np.uint64((1 << bitmap_bits) - 1)
            keep = np.flatnonzero((bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)
            text = np.searchsorted(firsts, start[keep], side="right") - 1
            tids: dict[int, bytes] = {}
            for k, i in zip(keep.tolist(), text.tolist()):
                if i not in tids:
                    tids[i] = hashlib.md5(data[firsts[i]:ends[i]]).digest()
                a = int(start[k])
                content = data[a:a + int(windows[k]) + length - 1]
                sid = hashlib.md5(content).digest()
                row = (int(m[k]), sid, tids[i], times[texts[first + i]], a - int(firsts[i]), int(windows[k]), None if sid in shown else content)
                shown.add(sid)
                for c, v in zip(cols, row):
                    c.append(v)
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [f.split()[0] for f in PIECES.split(", ")])
    return work


def repeated_minimizers(rows: DataFrame, length: int, bitmap_bits: int) -> np.ndarray:
    """Bitmap of the minimizers that occur more than once; its size is fixed."""
    def count(batch: pa.RecordBatch) -> dict:
        found = [cut_pieces(data, firsts, ends, length)[2] for _, data, firsts, ends in byte_blocks(texts_of(batch))]
        m, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        return {"m": pa.array(m), "n": pa.array(n, pa.int64())}

    def places(batch: pa.RecordBatch) -> dict:
        slot = (mix64(batch.column("m").to_numpy(), 1) & np.uint64((1 << bitmap_bits) - 1)).astype(np.int64)
        at, where = np.unique(slot >> 6, return_inverse=True)
        word = np.zeros(len(at), np.uint64)
        np.bitwise_or.at(word, where, np.uint64(1) << (slot & 63).astype(np.uint64))
        return {"at": pa.array(at), "word": pa.array(word.view(np.int64))}

    often = map_batches(rows.select("text"), count, "m long, n long").groupBy("m").agg(F.sum("n").alias("n")).where("n > 1").select("m")
    got = map_batches(often, places, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    bits = np.zeros(1 << (bitmap_bits - 6), np.int64)
    bits[got.column("at").to_numpy()] = got.column("word").to_numpy()
    return bits.view(np.uint8)


def _window_flags(pieces: DataFrame, length: int) -> DataFrame:
    """The exact way for minimizers of very many pieces: windows counted by digest."""
    def windows(batch: pa.RecordBatch) -> dict:
        sid, at, digest, n = [], [], [], []
        for s, content, times in zip(*(batch.column(c).to_pylist() for c in ("sid", "content", "n"))):
            for i in range(len(content) - length + 1):
                sid.append(s)
                at.append(i)
                digest.append(hashlib.md5(content[i:i + length]).digest())
                n.append(times)
        return {"sid": pa.array(sid, pa.binary()), "at": pa.array(at, pa.int32()), "digest": pa.array(digest, pa.binary()), "n": pa.array(n, pa.int64())}

    each = map_batches(pieces.select("sid", "content", "n"), windows, "sid binary, at int, digest binary, n long")
    again = each.groupBy("digest").agg(F.sum("n").alias("total")).where("total > 1").select("digest")

    def pack(pdf):
        import pandas as pd
        hit = np.zeros(int(pdf["at"].max()) + 1, bool)
        hit[pdf["at"]] = True
        return pd.DataFrame({"sid": [pdf["sid"].iloc[0]], "flags": [np.packbits(hit).tobytes()]})
    return each.join(again, "digest").groupBy("sid").applyInPandas(pack, FLAGS)       # a piece's windows are few


def remove_repeats(docs: DataFrame, length: int = 200, bitmap_bits: int = 26, bucket_pieces: int = 700, hot_pieces: int = 30_000,
                   id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256; with ``with_text`` also kept, the remaining bytes."""
    if not 2 <= length <= 255:
        raise ValueError("length: 2 to 255 bytes")
    spark = docs.sparkSession
    small_batches(spark)
    rows = id_text(docs, id_col, text_col)
    bits = repeated_minimizers(rows, length, bitmap_bits)
    found = stored(map_batches(rows.select("text"), _piece_rows(bits, bitmap_bits, length), PIECES), "suffix-pieces")

    pieces = stored(found.groupBy("m", "sid").agg(F.sum("n").alias("n"), F.first("windows").alias("windows"),
                                                  F.first("content", ignorenulls=True).alias("content")), "suffix-distinct")
    hot = pieces.groupBy("m").count().where(F.col("count") > hot_pieces).select("m")
    n_buckets, some_hot = max(1, -(-pieces.count() // bucket_pieces)), hot.count() > 0
    # the pieces' bytes are not shuffled for a join that takes nothing out
    dealt = (pieces.join(hot, "m", "left_anti") if some_hot else pieces).withColumn("bucket", F.pmod(F.xxhash64("m"), F.lit(n_buckets)))
    flags = dealt.groupBy("bucket").applyInPandas(_bucket_flags(length), FLAGS)
    if some_hot:
        flags = flags.union(_window_flags(pieces.join(hot, "m", "left_semi"), length))
    flags = stored(flags, "suffix-flags")

    # a mark: its place and windows in MARK_HEAD bytes, then a bit per window
    mark = F.concat(F.unhex(F.lpad(F.hex("pos"), 8, "0")), F.unhex(F.lpad(F.hex("windows"), 4, "0")), "flags")
    marks = found.select("tid", "sid", "pos", "windows").join(flags, "sid").select("tid", mark.alias("mark")).groupBy("tid").agg(
        F.collect_set("mark").alias("marks"))                                         # a document's own pieces
    joined = rows.withColumn("tid", F.unhex(F.md5("text"))).join(marks.hint("merge"), "tid", "left").select("doc_id", "text", "marks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in words.blocks(texts_of(batch), 1 << 20):                # a batch is larger than its blocks
                part = batch.slice(first, len(texts))
                raw = [t.encode("utf-8", "surrogatepass") for t in texts]
                gone, begin = repeated_bytes(part.column("marks"), np.array([len(r) for r in raw]), length)
                out: list[list] = [[] for _ in range(5)]
                starts = np.flatnonzero(np.diff(gone.view(np.int8), prepend=0) == 1)   # a text's runs end before the next text
                spans = np.diff(np.searchsorted(starts, np.append(begin, len(gone))))
                removed = np.add.reduceat(np.append(gone, False), begin).tolist()
                for i, own in enumerate(raw):
                    kept = own
                    if removed[i]:
                        kept = np.frombuffer(own, np.uint8)[~gone[begin[i]:begin[i] + len(own)]].tobytes()
                    for c, v in zip(out, (len(own), removed[i], int(spans[i]), hashlib.sha256(kept).hexdigest(), kept)):
                        c.append(v)
                got = {"doc_id": part.column("doc_id"), **{k: pa.array(v, pa.int64()) for k, v in zip(("n_bytes", "n_removed", "n_spans"), out)},
                       "kept_sha256": pa.array(out[3], pa.string())}
                yield pa.RecordBatch.from_pydict(got | ({"kept": pa.array(out[4], pa.binary())} if with_text else {}))
        release_memory()

    return joined.mapInArrow(cut, RESULT + (", kept binary" if with_text else ""))


MARK_HEAD = 6


def repeated_bytes(marks: pa.Array, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(which bytes of the texts, laid end to end with one place after each, a marked window covers;
    where each text begins). ``marks`` has a list of marks per text, all read at once."""
    begin = np.cumsum(sizes + 1) - sizes - 1
    edge = np.zeros(int(begin[-1] + sizes[-1]) + 2, np.int32)
    each = marks.flatten()
    if len(each):
        cuts = np.frombuffer(each.buffers()[1], np.int32)[each.offset:each.offset + len(each) + 1].astype(np.int64)
        data = np.frombuffer(each.buffers()[2], np.uint8)[cuts[0]:cuts[-1]].copy()
        at = cuts[:-1] - cuts[0]
        head = data[at[:, None] + np.arange(MARK_HEAD)].astype(np.int64)
        place = head[:, :4] @ (1 << np.array([24, 16, 8, 0]))
        windows = head[:, 4:] @ np.array([256, 1])
        data[(at[:, None] + np.arange(MARK_HEAD)).ravel()] = 0
        lists = np.array([0 if n is None else n for n in pc.list_value_length(marks).to_pylist()])
        text = np.repeat(np.arange(len(lists)), lists)
        for i in range(0, len(at), 1 << 14):                                           # bits take eight times their bytes
            lo, hi = at[i], at[i + (1 << 14)] if i + (1 << 14) < len(at) else len(data)
            hit = np.flatnonzero(np.unpackbits(data[lo:hi])) + 8 * lo
            own = np.searchsorted(at, hit // 8, side="right") - 1
            window = hit - 8 * (at[own] + MARK_HEAD)
            inside = window < windows[own]                                             # the last byte's rest says nothing
            start = begin[text[own[inside]]] + place[own[inside]] + window[inside]
            edge += np.bincount(start, minlength=len(edge)).astype(np.int32)
            edge -= np.bincount(start + length, minlength=len(edge)).astype(np.int32)
    return np.cumsum(edge[:-1]) > 0, begin
