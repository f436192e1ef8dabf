"""Operator 10: n-gram Jaccard join with a MinHash LSH forest.

Documents are sets of word shingles (runs of characters other than ASCII white space, in lower
case, ``shingle`` words each; a shorter text is one shingle of all its words). Links are pairs
of documents with a Jaccard similarity of ``threshold`` or more.

Steps. (1) One map gives every document the hash of its shingle set and its labels: ``trees``
lists of MinHash values. Equal sets become one class at once, so copies cost one row.
(2) The forest: in each tree the labels' prefixes of one depth meet. The depth is shortened level by level
from ``max_depth`` until the share of pairs that meet in some tree reaches ``recall`` both as expected at the
threshold and as measured: a sample of sets (``probes``, by a hash of the text) is compared exactly with every
document, and its true pairs up to ``BAND`` above the threshold (all true pairs if none are there) tell how
deep their best common prefix is. Members of a prefix are tied to its least member only (no pairs are made),
and connected components of these ties are the candidate groups. (3) Candidate groups are cut
into blocks by a hash, so that no task gets more than two blocks of about ``block`` sets; for
each pair of blocks a task compares all pairs, exactly, with matrix
products over the shingles, and returns per set the weight of its links and one root, never
the pairs. (4) Roots are joined to connected components.

A group of near copies is compared all against all, in blocks: its cost is the square of the
number of its different sets, which the definition of links asks for; copies do not count.

Defined results: texts without a word (null and empty too) are linked to nothing and are their
own class; repeated rows and null ids are documents like others (a null id can only name a
class that has no other id); an empty table gives an empty table; other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkfeat.llm import words
from sparkfeat.llm.common import fresh_name, id_text, map_batches, mix64, small_batches, stored, texts_of
from sparkfeat.llm.graph import components

WORD_GAP = np.array([9, 10, 11, 12, 13, 32], np.uint32)
SIGNED = "doc_id long, tid string, sid binary, n_shingles int, labels binary"
SETS = "sid binary, shingles binary"
VERIFIED = "sid binary, links long, root binary"
BAND = 0.05                          # above the threshold: the true pairs that are hardest to meet
PROBE_SHINGLES = 1 << 20
MOST_LEVELS = 64


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for _, part in words.blocks(texts):
        cps, firsts, _ = words.code_points([t.lower() for t in part])
        a, b = words.spans((cps > 32) | ~np.isin(cps, WORD_GAP))
        h = words.span_hashes(cps, a, b)
        cut = np.append(np.searchsorted(a, firsts), len(a))
        mixed = sum(np.roll(h, -j) * factor for j, factor in enumerate(mix64(np.arange(size), 5) | np.uint64(1))) if len(h) else h
        mixed = mix64(mixed, 11)
        for i, j in zip(cut, cut[1:]):
            if j - i >= size:
                out.append(np.unique(mixed[i:j - size + 1]))
            else:
                own = hashlib.blake2b(h[i:j].tobytes(), digest_size=8).digest()
                out.append(np.frombuffer(own, np.uint64) if j > i else np.zeros(0, np.uint64))
    return out


def prefix_depth(threshold: float, trees: int, max_depth: int, recall: float) -> int:
    """Longest prefix at which a pair at the threshold meets in some tree with that recall."""
    depth = max_depth
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < recall:
        depth -= 1
    return depth


def _levels(sets: list[np.ndarray], trees: int, depth: int):
    """(tree, hashes of the sets' prefixes in it) one level after another, depth levels a tree. A tree's levels
    do not depend on how deep it is read."""
    values = np.concatenate(sets)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    firsts = np.cumsum(sizes) - sizes
    for t in range(trees):
        prefix = np.zeros(len(sets), np.uint64)
        for d in range(depth):
            k = t * MOST_LEVELS + d
            one, two = mix64(np.array([2 * k, 2 * k + 1]), 23)
            least = np.minimum.reduceat((values ^ one) * (two | np.uint64(1)) >> np.uint64(8), firsts)
            prefix = mix64(prefix ^ least, k)
            yield t, prefix


def labels(sets: list[np.ndarray], trees: int, depth: int) -> np.ndarray:
    """Hash of each set's prefix in each tree, sets x trees; no set may be empty."""
    out = np.zeros((len(sets), trees), np.uint64)
    for t, prefix in _levels(sets, trees, depth):
        out[:, t] = prefix
    return out


def prefixes(sets: list[np.ndarray], trees: int, depth: int) -> np.ndarray:
    """Hashes of all the sets' prefixes: sets x trees x levels."""
    out = np.zeros((len(sets), trees, depth), np.uint64)
    for n, (t, prefix) in enumerate(_levels(sets, trees, depth)):
        out[:, t, n % depth] = prefix
    return out


def common_depths(one: np.ndarray, two: np.ndarray, i: np.ndarray, j: np.ndarray, block: int = 4096) -> np.ndarray:
    """Length of the longest common prefix, of all trees, of each pair of rows of ``prefixes``. Equal
    prefixes have equal shorter ones, so their number is their length."""
    return np.concatenate([np.zeros(0, np.int64), *((one[i[k:k + block]] == two[j[k:k + block]]).sum(2).max(1) for k in range(0, len(i), block))])


@dataclass
class Probes:
    """Sampled sets by shingle: every probe that has it."""
    sets: list[np.ndarray]
    shingles: np.ndarray             # sorted, a shingle once per probe
    owner: np.ndarray

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> Probes:
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner, order = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.argsort(every, kind="stable")
        return cls(sets, every[order], owner[order])

    def true_pairs(self, sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(set, probe, similarity) of all pairs of different sets at the threshold or above."""
        values, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
        low = np.searchsorted(self.shingles, values, side="left")
        times = np.searchsorted(self.shingles, values, side="right") - low
        at = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())
        pair = np.repeat(np.repeat(np.arange(len(sets)), sizes), times) * len(self.sets) + self.owner[at]
        pair, common = np.unique(pair, return_counts=True)
        i, j = pair // len(self.sets), pair % len(self.sets)
        own = np.array([len(s) for s in self.sets])
        alike = common / (sizes[i] + own[j] - common)
        keep = (alike >= threshold - 1e-9) & (alike < 1)
        return i[keep], j[keep], alike[keep]


def measured_depths(rows: DataFrame, probes: Probes, threshold: float, shingle: int, trees: int, max_depth: int) -> np.ndarray:
    """Counts of the probes' true pairs over all documents, by whether they are within BAND of the threshold (row 0) or
    above (row 1) and by the length of their longest common prefix."""
    own: list[np.ndarray] = []                                               # the probes' prefixes, made once a task

    def work(batch: pa.RecordBatch) -> dict:
        counts = np.zeros((2, max_depth + 1), np.int64)
        for _, texts in words.blocks(texts_of(batch)):
            sets = [s for s in shingle_sets(texts, shingle) if len(s)]
            if sets:
                i, j, alike = probes.true_pairs(sets, threshold)
                if len(i):
                    if not own:
                        own.append(prefixes(probes.sets, trees, max_depth))
                    met, place = np.unique(i, return_inverse=True)
                    deep = common_depths(prefixes([sets[k] for k in met], trees, max_depth), own[0], place, j)
                    np.add.at(counts, ((alike > threshold + BAND).astype(int), deep), 1)
        above, deep = np.nonzero(counts)
        return {"above": pa.array(above, pa.int32()), "deep": pa.array(deep, pa.int32()), "n": pa.array(counts[above, deep], pa.int64())}
    out = np.zeros((2, max_depth + 1), np.int64)
    for r in map_batches(rows.select("text"), work, "above int, deep int, n long").groupBy("above", "deep").agg(F.sum("n").alias("n")).collect():
        out[r["above"], r["deep"]] = r["n"]                                   # at most two rows a level
    return out


def sampled_sets(rows: DataFrame, probes: int, shingle: int) -> list[np.ndarray]:
    """The different sets of about ``probes`` documents by a hash of their text, PROBE_SHINGLES in all at most."""
    n = rows.count()
    draw = (F.xxhash64("text", F.lit("probe")).bitwiseAND((1 << 30) - 1)) / float(1 << 30)
    few = rows.where(draw < probes / max(n, 1)).select("text", "tid").groupBy("tid").agg(F.first("text").alias("text"))

    def sets_of(batch: pa.RecordBatch) -> dict:
        return {"shingles": pa.array([s.tobytes() for s in shingle_sets(texts_of(batch), shingle)], pa.binary())}
    found = map_batches(few, sets_of, "shingles binary").where(F.length("shingles") > 0).distinct()
    taken = found.withColumn("so_far", F.sum(F.length("shingles")).over(Window.orderBy(F.xxhash64("shingles")))).where(
        F.col("so_far") <= 8 * PROBE_SHINGLES)                                 # a sample of about ``probes`` rows
    return [np.frombuffer(r["shingles"], np.uint64) for r in taken.sort("so_far").collect()]


def shortened(counts: np.ndarray, threshold: float, trees: int, max_depth: int, recall: float) -> int:
    """Longest prefix that reaches the recall as expected at the threshold and as measured."""
    depth = prefix_depth(threshold, trees, max_depth, recall)
    seen = counts[0] if counts[0].sum() else counts.sum(0)
    while depth > 1 and seen.sum() and seen[depth:].sum() < recall * seen.sum():
        depth -= 1
    return depth


def _verify(pdf, threshold: float):
    """One pair of blocks: exact similarities of all pairs, whether they met in a tree or not."""
    import pandas as pd
    pdf = pdf.drop_duplicates("sid")
    n = len(pdf)
    sets = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
    size, weight = np.array([len(s) for s in sets]), pdf["weight"].to_numpy()
    one, two = int(pdf["low"].iloc[0]), int(pdf["high"].iloc[0])
    side = pdf["block"].to_numpy()
    left, right = np.flatnonzero(side == one), np.flatnonzero(side == two)
    shingles, where, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    shared = df[where] > 1
    column = (np.cumsum(df > 1) - 1)[where[shared]]
    owner, common, wide = owner[shared], np.zeros((len(left), len(right)), np.float32), 4096
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        i, j = np.searchsorted(column, [c, c + wide])
        dense = np.zeros((n, wide), np.float32)
        dense[owner[i:j], column[i:j] - c] = 1
        common += dense[left] @ dense[right].T
    both = size[left][:, None] + size[right][None, :] - common
    linked = common >= threshold * both - 1e-9
    if one == two:
        linked = np.triu(linked, 1)
    links = np.zeros(n, np.int64)
    np.add.at(links, left, (linked * weight[right][None, :]).sum(1))
    np.add.at(links, right, (linked * weight[left][:, None]).sum(0))
    root = np.arange(n)
    while True:                                           # least label over links, until it rests
        new = root.copy()
        i, j = np.nonzero(linked)
        np.minimum.at(new, left[i], root[right[j]])
        np.minimum.at(new, right[j], root[left[i]])
        new = new[new]
        if (new == root).all():
            break
        root = new
    sid = pdf["sid"].to_numpy()
    keep = np.flatnonzero((links > 0))
    return pd.DataFrame({"sid": sid[keep], "links": links[keep], "root": sid[root[keep]]})


def near_classes(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, trees: int = 24, max_depth: int = 8,
                 recall: float = 0.9999, block: int = 192, probes: int = 200, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, tid (a digest of the text), sid (of its set, null without a word), n_shingles;
    sets: sid, class_id, n_links, head: the class's first document by id, null ids last, and tid)."""
    small_batches(docs.sparkSession, mb=4)
    rows = id_text(docs, id_col, text_col).withColumn("tid", F.md5("text"))
    counts = np.zeros((2, max_depth + 1), np.int64)
    if sample := sampled_sets(rows, probes, shingle):
        counts = measured_depths(rows, Probes.of(sample), threshold, shingle, trees, max_depth)
    depth = shortened(counts, threshold, trees, max_depth, recall)

    def sign(batch: pa.RecordBatch) -> dict:
        sets = shingle_sets(texts_of(batch), shingle)
        full = [s for s in sets if len(s)]
        label = iter(labels(full, trees, depth)) if full else iter(())
        return {"doc_id": batch.column("doc_id"), "tid": batch.column("tid"),
                "sid": pa.array([hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], pa.binary()),
                "n_shingles": pa.array([len(s) for s in sets], pa.int32()),
                "labels": pa.array([next(label).tobytes() if len(s) else None for s in sets], pa.binary())}

    signed = stored(map_batches(rows, sign, SIGNED), "near-signed")
    classes = stored(signed.where("sid is not null").groupBy("sid").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tid")).alias("rep"), F.min("doc_id").alias("least"), F.count("*").alias("weight"),
        F.min("labels").alias("labels")), "near-classes")

    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    places = classes.select("sid", "labels", tree.alias("tree")).select(
        "sid", "tree", F.expr("substring(labels, tree * 8 + 1, 8)").alias("prefix"))
    hubs = places.groupBy("tree", "prefix").agg(F.min("sid").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    ties = places.join(hubs, ["tree", "prefix"]).where("sid <> hub").select(F.col("sid").alias("a"), F.col("hub").alias("b"))
    group = components(ties, "near-candidates")
    group = group.union(group.select(F.col("root").alias("node"), "root").distinct())
    blocks = group.groupBy("root").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("n_blocks"))
    members = group.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")).join(
        classes.withColumnRenamed("sid", "node"), "node").select(
        F.col("node").alias("sid"), "root", "n_blocks", "block", "labels", "weight", F.col("rep.doc_id").alias("rep_id"), F.col("rep.tid").alias("tid"))
    members = stored(members, "near-members")

    def sets_of(batch: pa.RecordBatch) -> dict:
        sets = shingle_sets(texts_of(batch), shingle)
        return {"sid": pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary()),
                "shingles": pa.array([s.tobytes() for s in sets], pa.binary())}

    wanted = members.select("rep_id", F.col("tid").alias("rep_tid"))
    # the same plan at every size: no broadcast of a list that grows
    texts = rows.join(wanted.hint("merge"), rows.doc_id.eqNullSafe(wanted.rep_id) & (rows.tid == wanted.rep_tid)).select("text")
    units = map_batches(texts, sets_of, SETS).join(members.select("sid", "root", "n_blocks", "block", "labels", "weight"), "sid")
    units = units.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select(
        "root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "sid", "labels", "weight", "shingles")
    found = stored(units.groupBy("root", "low", "high").applyInPandas(
        lambda pdf: _verify(pdf, threshold), VERIFIED), "near-verified")

    linked = found.groupBy("sid").agg(F.sum("links").alias("links"))
    top = components(found.select(F.col("sid").alias("a"), F.col("root").alias("b")), "near-classes-joined")
    own = classes.join(linked, "sid", "left").join(top.withColumnRenamed("node", "sid"), "sid", "left").select(
        "sid", "least", "rep", F.coalesce("root", "sid").alias("top"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    least = own.groupBy("top").agg(F.min("least").alias("class_id"), F.min("rep").alias("head"))
    return signed, own.join(least, "top").select("sid", "class_id", "n_links", "head")


def near_join(docs: DataFrame, **parameters) -> DataFrame:
    """One row per document: doc_id, class_id (least id that its links reach), n_links (other
    documents linked to it, copies included), set_size (its distinct shingles). Parameters: ``near_classes``."""
    signed, sets = near_classes(docs, **parameters)
    return signed.join(sets, "sid", "left").select(
        "doc_id", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("n_shingles").cast("long").alias("set_size"))


#: The same links by comparing all pairs that share a shingle.
LINKS_SQL = r"""WITH RECURSIVE
words AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w FROM documents),
grams AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE
  list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS g FROM words),
sets AS (SELECT doc_id, len(g) AS n, md5(array_to_string(list_sort(g), chr(10))) AS sid, g FROM grams),
classes AS (SELECT sid, min(doc_id) AS least, count(*) AS weight, any_value(n) AS n, any_value(g) AS g FROM sets WHERE n > 0 GROUP BY sid),
flat AS (SELECT least AS id, n, weight, unnest(g) AS s FROM classes),
pairs AS (SELECT a.id AS a, b.id AS b, any_value(b.weight) AS weight FROM flat a JOIN flat b ON a.s = b.s AND a.id <> b.id
  GROUP BY a.id, b.id HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*))),
reach(a, b) AS (SELECT least, least FROM classes UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
top AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
links AS (SELECT a, sum(weight) AS links FROM pairs GROUP BY a)
SELECT s.doc_id, CASE WHEN s.n = 0 THEN s.doc_id ELSE t.class_id END AS class_id,
  CASE WHEN s.n = 0 THEN 0 ELSE CAST(coalesce(l.links, 0) + c.weight - 1 AS BIGINT) END AS n_links, CAST(s.n AS BIGINT) AS set_size
FROM sets s LEFT JOIN classes c ON c.sid = s.sid AND s.n > 0 LEFT JOIN top t ON t.a = c.least LEFT JOIN links l ON l.a = c.least"""


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """One document of each class, with all its columns: the one of least id (null ids last), of equal
    ids the one whose text has the least digest. A text without a word is a class of its own. Rows that
    repeat one id and text count as one."""
    signed, sets = near_classes(docs, id_col=id_col, text_col=text_col, **parameters)
    heads = sets.select("head.doc_id", "head.tid").union(signed.where("sid is null").select("doc_id", "tid"))
    named = {c: fresh_name(docs, c) for c in ("chosen", "digest", "rows")}
    times = signed.groupBy("doc_id", "tid").agg(F.count("*").alias("rows"))
    heads = times.join(heads.distinct().withColumnsRenamed({"doc_id": "h", "tid": "t"}),
                       F.col("doc_id").eqNullSafe(F.col("h")) & (F.col("tid") == F.col("t")), "left_semi").select(
        F.col("doc_id").alias(named["chosen"]), F.col("tid").alias(named["digest"]), F.col("rows").alias(named["rows"])).hint("merge")
    own = F.md5(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    joined = docs.join(heads, docs[id_col].cast("long").eqNullSafe(heads[named["chosen"]]) & (own == heads[named["digest"]]))
    once = joined.where(F.col(named["rows"]) == 1).drop(*named.values())
    # only rows that repeat are shuffled again
    more = joined.where(F.col(named["rows"]) > 1).drop(*named.values()).dropDuplicates([id_col, text_col])
    return once.unionByName(more)
