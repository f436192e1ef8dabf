"""A small causal self-attention language model in numpy.

A position reads the subword ids of the last positions, each embedded as its class plus a vector
of its own, by one attention layer with a learned bias per distance, then a hidden layer. The
output is factored: the most frequent ids have a class each, the rest share some
classes of about equal mass, within which an id has its share after the class before it, backed off to its unigram share. The model's output y reweighs the smoothed class bigram by (1 + y/8)^8, which is close
to exp(y), never negative, and much cheaper.
"""

from __future__ import annotations

import numpy as np

REACH, STRIDE = 32, 16            # positions a window holds, targets it scores
HEAD, TAIL, DIM, HIDDEN = 240, 16, 24, 32
CLASSES = HEAD + TAIL
POWER = 8                         # a class weighs its bigram share times (1 + y / POWER) ** POWER
BACK = 4.0                        # weight of the unigram share within a class


class Vocabulary:
    """Classes of ids and the log10 share of each id in its class."""

    def __init__(self, counts: np.ndarray, end_id: int):
        counts = counts.astype(np.float64).copy()
        ranked = np.argsort(-counts, kind="stable")
        ranked = np.concatenate([[end_id], ranked[ranked != end_id]])
        self.end, self.end_id = 0, end_id
        self.of = np.zeros(len(counts), np.int64)
        self.of[ranked[:HEAD]] = np.arange(min(HEAD, len(counts)))
        rest = ranked[HEAD:]
        mass = np.cumsum(counts[rest] + 1)
        if len(rest):
            self.of[rest] = HEAD + np.minimum((mass - 1) * TAIL / mass[-1], TAIL - 1).astype(np.int64)
        size, total = np.bincount(self.of, minlength=CLASSES), np.bincount(self.of, counts, CLASSES)
        self.share = np.where(size[self.of] == 1, 1.0, (counts + 1) / (total + size)[self.of])
        self.pairs, self.times, self.after = np.zeros(1, np.int64), np.zeros(1), np.zeros((CLASSES, CLASSES))

    def set_pairs(self, pairs: np.ndarray, times: np.ndarray):
        """Counts of (class, next id): key = class x vocabulary + id, sorted."""
        n = len(self.of)
        self.after = np.bincount(pairs // n * CLASSES + self.of[pairs % n], times, CLASSES * CLASSES).reshape(CLASSES, CLASSES)
        rare = self.of[pairs % n] >= HEAD                       # a head class has one id: nothing to choose
        self.pairs = np.append(pairs[rare], np.iinfo(np.int64).max)
        self.times = np.append(times[rare], 0).astype(np.float64)

    def member(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """log10 probability of each id within its class after the class before it."""
        out = np.zeros(len(ids))
        tail = np.flatnonzero(self.of[ids] >= HEAD)
        key = before[tail].astype(np.int64) * len(self.of) + ids[tail]
        at = np.searchsorted(self.pairs, key)
        seen = np.where(self.pairs[at] == key, self.times[at], 0.0)
        out[tail] = np.log10((seen + BACK * self.share[ids[tail]]) / (self.after[before[tail], self.of[ids[tail]]] + BACK))
        return out


def start_parameters(bigrams: np.ndarray, seed: int = 5, n_ids: int = 0) -> dict[str, np.ndarray]:
    """With ``n_ids``, each id has a vector of its own beside that of its class."""
    rng = np.random.default_rng(seed)
    mat = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    unigram = bigrams.sum(0) + 1.0
    smooth = (bigrams + 20 * unigram / unigram.sum()) / (bigrams.sum(1, keepdims=True) + 20)
    own = {"own": np.zeros((n_ids, DIM), np.float32)} if n_ids else {}
    return own | {"emb": (rng.standard_normal((CLASSES, DIM)) * 0.5).astype(np.float32), "wq": mat(DIM, DIM), "wk": mat(DIM, DIM),
            "wv": mat(DIM, DIM), "wo": mat(DIM, DIM) * np.float32(0.5), "dist": np.zeros(REACH, np.float32), "w1": mat(DIM, HIDDEN),
            "b1": np.zeros(HIDDEN, np.float32), "w2": mat(HIDDEN, DIM) * np.float32(0.5), "out": mat(DIM, CLASSES) * np.float32(0.05),
            "bias": np.zeros(CLASSES, np.float32), "bigram": smooth.astype(np.float32)}


FIXED = ("bigram", "own")           # not among the weights that are averaged one by one


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p) if k not in FIXED])


def unflat(like: dict[str, np.ndarray], values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = dict(like), 0
    for k in sorted(like):
        if k not in FIXED:
            out[k] = values[at:at + like[k].size].reshape(like[k].shape).astype(np.float32)
            at += like[k].size
    return out


def gradients(p: dict[str, np.ndarray], c: np.ndarray, t: np.ndarray, ids: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss of predicting classes t (windows x positions) after the ids of classes c, and
    gradients; that of ``own`` is (ids in order, their rows)."""
    n, w = c.shape
    x = p["emb"][c] if ids is None else p["emb"][c] + p["own"][ids]
    q, k, v = x @ p["wq"], x @ p["wk"], x @ p["wv"]
    gap = np.arange(w)[:, None] - np.arange(w)[None, :]
    seen = gap >= 0
    s = np.where(seen, q @ k.transpose(0, 2, 1) / np.float32(np.sqrt(DIM)) + p["dist"][np.maximum(gap, 0)], np.float32(-1e9))
    a = np.exp(s - s.max(-1, keepdims=True))
    a /= a.sum(-1, keepdims=True)
    z = a @ v
    h = x + z @ p["wo"]
    f = np.maximum(h @ p["w1"] + p["b1"], 0)
    g = h + f @ p["w2"]
    u = g.reshape(-1, DIM) @ (p["out"] / np.float32(POWER))             # positions x classes: every pass counts
    u += p["bias"] / np.float32(POWER) + np.float32(1)
    e = u * u
    for _ in range(POWER.bit_length() - 2):
        e *= e
    e *= p["bigram"][c.ravel()]
    e *= 1 / e.sum(-1, keepdims=True)
    at, target = np.arange(n * w), t.ravel()
    loss = -np.log(np.maximum(e[at, target], 1e-12)).mean()
    e[at, target] -= 1
    if np.abs(u, out=(size := np.empty_like(u))).min() < 0.05:
        u[size < 0.05] = 0.05
    e /= u
    e *= np.float32(1 / (n * w))
    dy = e.reshape(n, w, -1)
    flat2 = lambda m: m.reshape(-1, m.shape[-1])
    d = {"out": flat2(g).T @ flat2(dy), "bias": flat2(dy).sum(0)}
    dg = dy @ p["out"].T
    d["w2"] = flat2(f).T @ flat2(dg)
    df = (dg @ p["w2"].T) * (f > 0)
    d["w1"], d["b1"] = flat2(h).T @ flat2(df), flat2(df).sum(0)
    dh = dg + df @ p["w1"].T
    d["wo"] = flat2(z).T @ flat2(dh)
    dz = dh @ p["wo"].T
    da = dz @ v.transpose(0, 2, 1)
    dv = a.transpose(0, 2, 1) @ dz
    ds = a * (da - (da * a).sum(-1, keepdims=True))
    d["dist"] = np.bincount(np.maximum(gap, 0).ravel(), np.where(seen, ds.sum(0), 0).ravel(), REACH).astype(np.float32)
    ds /= np.float32(np.sqrt(DIM))
    dq, dk = ds @ k, ds.transpose(0, 2, 1) @ q
    dx = dh + dq @ p["wq"].T + dk @ p["wk"].T + dv @ p["wv"].T
    for name, grad in (("wq", dq), ("wk", dk), ("wv", dv)):
        d[name] = flat2(x).T @ flat2(grad)
    d["emb"] = np.zeros((CLASSES, DIM), np.float32)
    if ids is None:
        rows, sums = _summed(c.ravel(), flat2(dx))
        d["emb"][rows] = sums
    else:
        rows, sums = _summed(ids.ravel(), flat2(dx))
        d["own"] = rows, sums
        first = np.empty(rows[-1] + 1, c.dtype)                         # the class of each id that was read
        first[ids.ravel()] = c.ravel()
        classes, sums = _summed(first[rows], sums)
        d["emb"][classes] = sums
    return float(loss), d


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different keys in order, sums of their rows)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(values[order], at, axis=0)


class Trainer:
    """Adam over a stream that comes in parts: ids with their classes ``of`` (or classes alone), texts one after another,
    each with its end. Holds the weights, their moments and less than a window of the stream; every id is learned
    from. ``expected`` ids set the fall of the learning rate. A row of ``own`` moves when its id is read."""

    def __init__(self, p: dict[str, np.ndarray], expected: int, of: np.ndarray | None = None, rate: float = 3e-3, batch: int = 64):
        self.p, self.of, self.rate, self.batch = dict(p), of, rate, batch
        self.m, self.s, self.step, self.rest = {}, {}, 0, np.zeros(0, np.int64)
        self.steps = max(1, -(-expected // (REACH * batch)))
        if of is not None:
            self.p["own"] = p["own"].copy()
            self.moved, self.squares = np.zeros_like(p["own"]), np.zeros_like(p["own"])
            self.turns = np.zeros((len(p["own"]), 1), np.float32)

    def feed(self, stream: np.ndarray) -> None:
        stream = np.concatenate([self.rest, stream])
        n = (len(stream) - 1) // REACH
        self._windows(stream, np.arange(max(n, 0)) * REACH)
        self.rest = stream[max(n, 0) * REACH:]
        self.tail = stream[-REACH - 1:] if len(stream) > REACH else None

    def finish(self) -> dict[str, np.ndarray]:
        """The weights, after a last window that ends with the stream; some of its ids are then read twice."""
        if len(self.rest) > 1 and getattr(self, "tail", None) is not None:
            self._windows(self.tail, np.zeros(1, np.int64))
        return self.p

    def _windows(self, stream: np.ndarray, begin: np.ndarray) -> None:
        order = begin[np.random.default_rng(3).permutation(len(begin))]
        for i in range(0, len(order), self.batch):
            at = order[i:i + self.batch, None] + np.arange(REACH)
            self._move(stream[at], stream[at + 1])

    def _move(self, a: np.ndarray, b: np.ndarray) -> None:
        p, of = self.p, self.of
        _, d = gradients(p, a, b) if of is None else gradients(p, of[a], of[b], a)
        i = self.step
        self.step += 1
        step = self.rate * min(1.0, (i + 1) / 20) * max(0.1, 1 - 0.9 * i / self.steps)
        if of is not None:
            rows, g = d.pop("own")
            self.turns[rows] += 1
            self.moved[rows] = moved = 0.9 * self.moved[rows] + 0.1 * g
            self.squares[rows] = squares = 0.98 * self.squares[rows] + 0.02 * g * g
            k = self.turns[rows]
            p["own"][rows] -= np.float32(step) * (moved / (1 - 0.9 ** k)) / (np.sqrt(squares / (1 - 0.98 ** k)) + 1e-8)
        for k, g in d.items():
            self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            self.s[k] = 0.98 * self.s.get(k, 0) + 0.02 * g * g
            p[k] = (p[k] - np.float32(step) * (self.m[k] / (1 - 0.9 ** (i + 1))) / (np.sqrt(self.s[k] / (1 - 0.98 ** (i + 1))) + 1e-8)).astype(np.float32)


def train(p: dict[str, np.ndarray], stream: np.ndarray, of: np.ndarray | None = None, rate: float = 3e-3, batch: int = 64) -> dict[str, np.ndarray]:
    """One pass over a whole stream (see ``Trainer``)."""
    trainer = Trainer(p, len(stream), of, rate, batch)
    trainer.feed(stream)
    return trainer.finish()


class Scorer:
    """Scores with everything that depends on one input id (without ``own``, on its class) tabulated."""

    def __init__(self, p: dict[str, np.ndarray], vocabulary: Vocabulary):
        self.p, self.v = p, vocabulary
        self.tables = None
        self.base, self.bias = p["bigram"], (p["bias"] / POWER + 1).astype(np.float32)
        self.out = (p["out"] / POWER).astype(np.float32)
        self.ones = np.ones(CLASSES, np.float32)
        gap = np.arange(STRIDE)[:, None] + REACH - STRIDE - np.arange(REACH)[None, :]
        self.dist = np.where(gap >= 0, np.exp(np.clip(p["dist"], -40, 40))[np.maximum(gap, 0)], 0).astype(np.float32)

    def tabulated(self) -> tuple[np.ndarray, ...]:
        """Embedding, query, key and value of each input; made where they are used, not shipped."""
        if self.tables is None:
            p = self.p
            x = p["emb"][self.v.of] + p["own"] if "own" in p else p["emb"]
            self.tables = tuple(a.astype(np.float32) for a in (
                x, x @ p["wq"] / np.float32(np.sqrt(DIM)), x @ p["wk"], x @ p["wv"] @ p["wo"]))
        return self.tables

    def score(self, ids: np.ndarray, counts: np.ndarray, windows: int = 64) -> np.ndarray:
        """log10 probability of each text: its ids, which end with the end id. A window scores
        STRIDE targets, its keys reach back over the window before it; each target is scored
        once. A text's first target follows the end class."""
        targets = self.v.of[ids]
        firsts = np.cumsum(counts) - counts
        inputs = np.empty_like(targets)
        inputs[1:] = targets[:-1]
        inputs[firsts[counts > 0]] = self.v.end
        emb, query, key, val = self.tabulated()
        read = inputs
        if "own" in self.p:
            read = np.empty_like(targets)
            read[1:] = ids[:-1]
            read[firsts[counts > 0]] = self.v.end_id
        per = (counts + STRIDE - 1) // STRIDE
        text = np.repeat(np.arange(len(counts)), per)
        begin = firsts[text] + (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)) * STRIDE
        low, high = firsts[text], (firsts + counts)[text]
        gained = self.v.member(inputs, ids)
        for w in range(0, len(begin), windows):
            b, lo, hi = begin[w:w + windows, None], low[w:w + windows, None], high[w:w + windows, None]
            keys = b + np.arange(STRIDE - REACH, STRIDE)
            known = (keys >= lo) & (keys < hi)
            kc = read[np.clip(keys, 0, len(inputs) - 1)]
            at = b + np.arange(STRIDE)
            used = at < hi
            inner = np.minimum(at, len(inputs) - 1)
            qc, qr = inputs[inner], read[inner]
            s = np.matmul(query[qr], key[kc].transpose(0, 2, 1))
            np.exp(np.clip(s, -40, 40, out=s), out=s)
            s *= self.dist
            if not known.all():
                s *= known[:, None, :]
            s /= np.maximum(s.sum(-1, keepdims=True), np.float32(1e-30))
            z = np.matmul(s, val[kc])
            if used.all():
                qc, qr, at, z = qc.ravel(), qr.ravel(), at.ravel(), z.reshape(-1, DIM)
            else:
                qc, qr, at, z = qc[used], qr[used], at[used], z[used]
            h = emb[qr] + z
            h += np.maximum(h @ self.p["w1"] + self.p["b1"], 0) @ self.p["w2"]
            y = h @ self.out
            y += self.bias
            for _ in range(POWER.bit_length() - 1):
                y *= y
            y *= self.base[qc]
            hit = y[np.arange(len(at)), targets[at]].astype(np.float64)
            gained[at] += np.log10(np.maximum(hit, 1e-30) / (y @ self.ones))
        sums = np.concatenate([[0.0], np.cumsum(gained)])
        return sums[firsts + counts] - sums[firsts]
