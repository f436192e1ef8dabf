"""Byte-level BPE as finite-state transducers, compiled lazily and run over whole batches.

Two deterministic machines reproduce the ids of a byte-level BPE vocabulary:

* ``PRETOKEN``: a transducer over character classes that marks where pretokens start. Its
  state space is small, so the map "entry state → exit state" of any chunk of text is a short
  vector and maps of neighbouring chunks compose; a parallel prefix scan over the chunk maps
  gives every chunk its true entry state (``pretoken_starts``).
* ``BpeMachine``: a transducer over the bytes of one pretoken. A state holds every position of
  the prefix read so far from which a vocabulary token may still grow, with the last token of
  the encoding up to that position. A transition carries the number of tokens that it adds
  to the encoding (it can be negative: a merge takes tokens back). States and transitions are
  made when first met and kept in numpy tables, so a batch of pretokens runs in lock step
  with two gathers a byte. The tables are bounded: past ``max_states`` they start anew.

The encoding of a prefix is its last token after the encoding of what stands before it, where
that token and the one before it are a pair that BPE leaves alone; this makes the last token
unique (a property of BPE vocabularies whose tokens are all reachable by merges).
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata

import numpy as np

CHUNK = 512                 # characters a chunk of the prefix scan
BATCH_CHARS = 1_000_000     # characters worked on at once in a task
FEW = 24                    # so many tokens below a trie node are listed in a state

# character classes of the pretokenizer: letters that end a contraction have their own
(LET, STMD, LR, LV, LL, LE, NUM, OTHER, APOS, SPACE, WHITE) = range(11)
# states: what was read last
(START, IN_L, IN_N, IN_O, IN_SP, IN_WS, Q, QR, QV, QL, DONE) = range(11)
LETTERS = (LET, STMD, LR, LV, LL, LE)
K = 11


def _pretoken_table():
    """(next state, flags): flag 1 = a pretoken starts at this character, flag 2 = one
    starts at the character before it (decided one character late)."""
    nxt, out = np.zeros((K, K), np.uint8), np.zeros((K, K), np.uint8)
    run = {**{c: IN_L for c in LETTERS}, NUM: IN_N, OTHER: IN_O, APOS: IN_O, SPACE: IN_SP, WHITE: IN_WS}
    for s in range(K):
        for c in range(K):
            to, starts = run[c], 1
            if s in (IN_SP, IN_WS):
                if c in (SPACE, WHITE):
                    starts = 0
                else:                                 # the run's last character splits off
                    starts = 2 if s == IN_SP else 3
                    if c == APOS and s == IN_WS:
                        to = Q
            elif s in (IN_L, IN_N, IN_O):
                starts = int(to != s)
                if c == APOS and s != IN_O:
                    to = Q
            elif s in (START, DONE):
                if c == APOS:
                    to = Q
            elif s == Q:
                if c == STMD:
                    to, starts = DONE, 0
                elif c in (LR, LV, LL):
                    to, starts = {LR: QR, LV: QV, LL: QL}[c], 0
                elif c in (OTHER, APOS):
                    starts = 0
            else:                                     # apostrophe and r, v or l
                if (s, c) in ((QR, LE), (QV, LE), (QL, LL)):
                    to, starts = DONE, 0
                else:                                 # no contraction: a letter run began before
                    starts = 2 | int(to != IN_L)
                    if c == APOS:
                        to = Q
            nxt[s, c], out[s, c] = to, starts
    return nxt.ravel(), out.ravel()


PRE_NEXT, PRE_OUT = _pretoken_table()
WHITE_SPACE = "\t\n\x0b\x0c\r\x20\x85\xa0                　"


@functools.cache
def char_classes() -> np.ndarray:
    kind = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        g = unicodedata.category(chr(c))[0]
        if g == "L":
            kind[c] = LET
        elif g == "N":
            kind[c] = NUM
    for c in WHITE_SPACE:
        kind[ord(c)] = WHITE
    for chars, v in (("stmd", STMD), ("r", LR), ("v", LV), ("l", LL), ("e", LE), ("'", APOS), (" ", SPACE)):
        for c in chars:
            kind[ord(c)] = v
    return kind


def _read(states: np.ndarray, begin: np.ndarray, alive: np.ndarray, classes: np.ndarray, first: int, last: int):
    """Moves rows of states over characters first..last of all chunks, in place."""
    for j in range(first, last):
        m = alive[j]
        states[:, :m] = PRE_NEXT[states[:, :m].astype(np.intp) * K + classes[begin[:m] + j]]


def pretoken_starts(classes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Boolean per character: a pretoken starts here. ``firsts``: where texts start (sorted,
    no empty texts); no pretoken crosses them.

    Characters are cut into chunks that never cross a text. Every chunk's map over all
    entry states is computed in lock step; a doubling scan composes the maps; a second
    lock-step run from the true entry states emits the marks."""
    n = len(classes)
    ends = np.append(firsts[1:], n)
    per = (ends - firsts + CHUNK - 1) // CHUNK
    first_chunk = np.cumsum(per) - per
    begin = np.repeat(firsts - first_chunk * CHUNK, per) + np.arange(per.sum()) * CHUNK
    size = np.minimum(begin + CHUNK, np.repeat(ends, per)) - begin
    order = np.argsort(-size.astype(np.int16), kind="stable")   # long chunks first: the active ones lead
    b, alive = begin[order], np.searchsorted(-size[order], -np.arange(CHUNK), side="left")
    steps = int(size.max())
    maps = np.repeat(np.arange(K, dtype=np.uint8)[:, None], len(b), 1)
    meet = min(16, steps)
    _read(maps, b, alive, classes, 0, meet)
    one = (maps == maps[0]).all(0)                  # most chunks forget their entry state at once
    for pick, rows in ((np.flatnonzero(one), 1), (np.flatnonzero(~one), K)):
        own = np.ascontiguousarray(maps[:rows, pick])
        _read(own, b[pick], np.searchsorted(pick, alive, side="left"), classes, meet, steps)
        maps[:, pick] = own
    scan = np.empty_like(maps)
    scan[:, order] = maps
    scan[:, first_chunk] = scan[START, first_chunk]             # a text starts in START: a constant map
    entry = np.full(len(b), START, np.uint8)
    d = 1
    while d < per.max():
        scan[:, d:] = np.take_along_axis(scan[:, d:], scan[:, :-d].astype(np.intp), 0)
        d *= 2
    entry[1:] = scan[START, :-1]
    entry[first_chunk] = START
    state, marks = entry[order], np.zeros(n + 1, np.uint8)
    for j in range(steps):
        m = alive[j]
        at = b[:m] + j
        key = state[:m].astype(np.intp) * K + classes[at]
        marks[at] |= PRE_OUT[key] & 1
        late = at[PRE_OUT[key] > 1]
        marks[late - 1] = 1
        state[:m] = PRE_NEXT[key]
    return marks[:n].view(bool)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BpeMachine:
    """See the module text. ``special`` maps special strings to their ids."""

    def __init__(self, path: str, max_states: int = 120_000):
        data = json.load(open(path, encoding="utf-8"))
        to_byte = byte_alphabet()
        raw = lambda s: bytes(to_byte[c] for c in s)
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.id_of = {raw(s): i for s, i in data["model"]["vocab"].items() if s not in self.special}
        merges = (m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"])
        ids = lambda m: tuple(self.id_of[raw(x)] for x in m)
        self.rank = {ids(m): i for i, m in enumerate(merges)}
        self.bytes_of = {i: b for b, i in self.id_of.items()}
        self.size = max(max(self.bytes_of), *self.special.values(), 0) + 1
        self.length = np.zeros(self.size, np.int32)
        for i, b in self.bytes_of.items():
            self.length[i] = len(b)
        self.trie: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for b, i in self.id_of.items():
            node = 0
            for x in b:
                if x not in self.trie[node]:
                    self.trie[node][x] = len(self.trie)
                    self.trie.append({})
                    self.token.append(-1)
                node = self.trie[node][x]
            self.token[node] = i
        self._spines()
        self._subtrees()
        self.max_states = max_states
        self._clear()

    def _clear(self):
        self.column, self.n_columns = np.full(256, -1, np.int32), 0
        self.next = np.full((1024, 32), -1, np.int32)
        self.adds = np.zeros((1024, 32), np.int8)
        self.last = np.full(1024, -1, np.int32)
        self.parts: list[tuple] = []
        self.allow: dict[tuple, int | tuple] = {}
        self.number: dict[tuple, int] = {}
        self._state(((0, -1, 0),), -1)

    def _state(self, key: tuple, last: int) -> int:
        at = self.number.get(key)
        if at is None:
            at = self.number[key] = len(self.parts)
            self.parts.append(key)
            if at >= len(self.last):
                grow = lambda a, fill: np.concatenate([a, np.full_like(a, fill)])
                self.next, self.adds, self.last = grow(self.next, -1), grow(self.adds, 0), grow(self.last, -1)
            self.last[at] = last
        return at

    def _spines(self):
        """Per token its two parts, -1 if no merge made it, and the rank of that merge: what a merge tree's right
        and left ends are read from."""
        self.part_1, self.part_2, self.made = [-1] * self.size, [-1] * self.size, [sys.maxsize] * self.size
        for (a, b), r in self.rank.items():
            t = self.id_of[self.bytes_of[a] + self.bytes_of[b]]
            self.part_1[t], self.part_2[t], self.made[t] = a, b, r

    def _subtrees(self):
        """Per trie node the tokens at or below it, where they are few. Nodes with the same share one list, leaves
        one empty table."""
        self.below: list[list[int] | None] = [[] for _ in self.trie]
        for node in range(len(self.trie) - 1, -1, -1):     # children have higher numbers
            own = [self.token[node]] if self.token[node] >= 0 else []
            children = self.trie[node].values()
            if not own and len(children) == 1:
                self.below[node] = self.below[next(iter(children))]
                continue
            for child in children:
                own = None if own is None or self.below[child] is None else own + self.below[child]
            self.below[node] = own if own is not None and len(own) <= FEW else None
        leaf: dict[int, int] = {}
        self.trie = [children or leaf for children in self.trie]

    def stays(self, a: int, b: int) -> bool:
        """Whether BPE leaves token a followed by token b as they are: no part at a's right
        end and part at b's left end merge before one of them is consumed. Of merges of equal
        rank the left one comes first."""
        x, until_x = a, sys.maxsize
        while x >= 0:
            y, until_y = b, sys.maxsize
            while y >= 0:
                r = self.rank.get((x, y))
                if r is not None and r < until_x and r <= until_y:
                    return False
                y, until_y = self.part_1[y], self.made[y]
            x, until_x = self.part_2[x], self.made[x]
        return True

    def _allowed(self, node: int, last: int):
        """The tokens below a trie node that may follow the token ``last``: as a tuple where
        few are below, so that left neighbours that allow the same become one."""
        if (known := self.allow.get((node, last))) is None:
            few = self.below[node]
            if last < 0:
                known = -1
            elif few is None:
                known = last
            else:
                known = tuple(t for t in few if self.stays(last, t))
            self.allow[node, last] = known
        return known

    def _step(self, state: int, byte: int):
        """Makes the transition of one state on one byte. A part of a state is the trie node
        of the bytes since a position, what may follow there (a token before it, or the tokens
        allowed), and the tokens before it relative to now."""
        grown, found = [], None
        for node, before, count in self.parts[state]:
            child = self.trie[node].get(byte)
            if child is None:
                continue
            t = self.token[child]
            if type(before) is int:
                if t >= 0 and found is None and (before < 0 or self.stays(before, t)):
                    found = (t, count + 1)
                before = self._allowed(child, before)
                if before == ():
                    continue
            else:
                if t in before and found is None:
                    found = (t, count + 1)
                if len(before) > 1 or before[0] == t:
                    below = self.below[child]
                    before = tuple(x for x in before if x in below)
                    if not before or before == (t,):
                        continue
                elif before[0] not in self.below[child]:
                    continue
            grown.append((child, before, count))
        t, count = found
        key = tuple((n, a, c - count) for n, a, c in grown) + ((0, t, 0),)
        to = self._state(key, t)
        col = self.column[byte]
        self.next[state, col], self.adds[state, col] = to, count

    def _columns(self, data: np.ndarray):
        for b in np.flatnonzero(np.bincount(data, minlength=256)):
            if self.column[b] < 0:
                if self.n_columns == self.next.shape[1]:
                    wide = lambda a, fill: np.concatenate([a, np.full((len(a), 32), fill, a.dtype)], 1)
                    self.next, self.adds = wide(self.next, -1), wide(self.adds, 0)
                self.column[b], self.n_columns = self.n_columns, self.n_columns + 1

    def run(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, want_last: bool):
        """Runs all pretokens ``data[starts:starts+sizes]`` (sizes > 0) in lock step, longest
        first. Returns tokens per pretoken and, if asked for, the last token at each byte."""
        if len(self.parts) > self.max_states:
            self._clear()
        self._columns(data)
        cols = self.column[data]
        order = np.argsort(-np.minimum(sizes, 32767).astype(np.int16), kind="stable")
        if sizes.max(initial=0) > 32766:
            order = np.argsort(-sizes, kind="stable")
        at, counts = starts[order], np.zeros(len(starts), np.int32)
        steps = int(sizes.max(initial=0))
        alive = np.bincount(np.minimum(sizes, steps), minlength=steps + 1)[::-1].cumsum()[::-1]
        state = np.zeros(len(starts), np.int32)
        last = np.empty(len(data), np.int32) if want_last else None
        for j in range(steps):
            m = alive[j + 1]
            s, c = state[:m], cols[at[:m] + j]
            to = self.next[s, c]
            while len(new := np.flatnonzero(to < 0)):
                for key in np.unique(s[new].astype(np.int64) * 256 + data[at[new] + j]).tolist():
                    self._step(key >> 8, key & 255)
                to[new] = self.next[s[new], c[new]]
            counts[:m] += self.adds[s, c]
            state[:m] = to
            if want_last:
                last[at[:m] + j] = self.last[to]
        out = np.empty_like(counts)
        out[order] = counts
        return out, last

    def ids(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        """(ids of all pretokens in order, tokens per pretoken)."""
        counts, last = self.run(data, starts, sizes, True)
        to = np.cumsum(counts, dtype=np.int64)
        ids = np.empty(int(to[-1]) if len(to) else 0, np.int32)
        pos, slot, begin = starts + sizes - 1, to - 1, starts
        while len(pos):
            t = last[pos]
            ids[slot] = t
            pos = pos - self.length[t]
            keep = np.flatnonzero(pos >= begin)
            pos, slot, begin = pos[keep], slot[keep] - 1, begin[keep]
        return ids, counts


@functools.cache
def machine(path: str) -> BpeMachine:
    return BpeMachine(path)


def _pieces(m: BpeMachine, texts):
    """(text number, piece or special id): texts cut at special strings, and very long
    texts cut before a lone space, where a pretoken starts in any case."""
    marks = re.compile("(" + "|".join(map(re.escape, sorted(m.special, key=len, reverse=True))) + ")") if m.special else None
    for i, text in enumerate(texts):
        parts = marks.split(text) if marks and any(s in text for s in m.special) else (text,)
        for p in parts:
            if p in m.special:
                yield i, m.special[p]
                continue
            while len(p) > 2 * BATCH_CHARS and (cut := re.compile(r"(?<=\S) (?=\S)").search(p, BATCH_CHARS)):
                yield i, p[:cut.start()]
                p = p[cut.start():]
            if p:
                yield i, p


def _blocks(m: BpeMachine, texts):
    block, size = [], 0
    for i, p in _pieces(m, texts):
        block.append((i, p))
        size += len(p) if isinstance(p, str) else 1
        if size >= BATCH_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def split_block(parts: list[str]):
    """Pretokens of non-empty strings: (bytes, start byte, size, number of the string)."""
    joined = "".join(parts)
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    firsts = np.cumsum(lengths) - lengths
    begin = np.flatnonzero(pretoken_starts(char_classes()[cps], firsts))
    if joined.isascii():
        data, offset = np.frombuffer(joined.encode(), np.uint8), begin
    else:
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        width = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
        offset = (np.cumsum(width) - width)[begin]
    sizes = np.diff(np.append(offset, len(data)))
    owner = np.searchsorted(firsts, begin, side="right") - 1
    return data, offset, sizes, owner


def count_tokens(path: str, texts: list[str]) -> np.ndarray:
    """Number of tokens of every text; special strings count one."""
    m, total = machine(path), np.zeros(len(texts), np.int64)
    for block in _blocks(m, texts):
        strings = [(i, p) for i, p in block if isinstance(p, str)]
        for i, p in block:
            total[i] += not isinstance(p, str)
        if strings:
            data, at, sizes, owner = split_block([p for _, p in strings])
            counts, _ = m.run(data, at, sizes, False)
            text = np.fromiter((i for i, _ in strings), np.int64, len(strings))
            total += np.bincount(text[owner], counts, len(texts)).astype(np.int64)
    return total


def encode(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in order, tokens per text)."""
    m, ids, total = machine(path), [], np.zeros(len(texts), np.int64)
    for block in _blocks(m, texts):
        strings = [p for _, p in block if isinstance(p, str)]
        if strings:
            data, at, sizes, owner = split_block(strings)
            got, counts = m.ids(data, at, sizes)
            per = np.bincount(owner, counts, len(strings)).astype(np.int64)
        if len(strings) == len(block):
            ids.append(got)
            total += np.bincount([i for i, _ in block], per, len(texts)).astype(np.int64)
            continue
        cuts, k = np.concatenate([[0], np.cumsum(per)]) if strings else [0], 0
        for i, p in block:
            if isinstance(p, str):
                ids.append(got[cuts[k]:cuts[k + 1]])
                total[i] += per[k]
                k += 1
            else:
                ids.append(np.array([p], np.int32))
                total[i] += 1
    return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), total
