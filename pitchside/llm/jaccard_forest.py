"""Operator 7: n-gram Jaccard join with a MinHash LSH forest.

Documents are sets of shingles: ``n`` consecutive words (lower case A-Z, cut
at ASCII white space); a text of one to ``n - 1`` words is one shingle. Two
texts are linked if the Jaccard similarity of their sets reaches ``threshold``.

1. Texts with equal words are one *text* (a class of copies), however many
   rows have it; all that follows works on one representative.
2. Each text has a label in each of ``trees`` prefix tries: ``depth`` MinHash
   values. A node is a prefix; texts that share a prefix of ``d`` values in a
   tree share its node at depth ``d``. The least depth looked at is the longest
   with which a pair at the threshold shares a node in some tree with the target
   recall: 1 - (1 - s^d)^trees >= recall (4 for 16 trees and 0.999). Only texts
   that share a node there with another are kept; this prunes the tries.
3. The search goes up all tries at once, from whole labels to shorter prefixes.
   At depth ``d`` a node with one child only is skipped: it joins nothing new.
   In the others, new pairs are those that share no longer prefix in any tree
   and no prefix of ``d`` in an earlier tree, so each pair is looked at once.
4. A node is cut into blocks (rows and shingles of a block are bounded), and
   its pairs of blocks are dealt as groups of their own: no group is unbounded,
   no pair is dropped. A first pass over labels alone keeps the members that have
   a new pair; their texts follow, and a task verifies the exact similarity of
   all new pairs of its two blocks by products of incidence matrices. It returns,
   per text, the number of its links and the least text it is connected with -
   never the pairs themselves.
5. After each depth the recall is measured from the links found, in the weakest
   band of similarity alone (``threshold`` to ``threshold + BAND``): a link of
   similarity s was found with probability p(s) at this depth, so (1 - p) / p
   links like it are expected to be missing. One supposed link at the threshold
   is counted with them, so no evidence means no early end. Prefixes are
   shortened further until the measured recall reaches the target, at most to
   the least depth. Stronger links have a higher recall than the weakest.
6. Classes are the connected components, found by contraction: every text moves
   to the neighbour (or itself) with the least hash, a new hash each round, which
   leaves three quarters of the texts at most on average, whatever the graph.

Defined results: a text without words (null, empty, white space) has no links
and is a class of its own row; equal rows are copies of one text; a null id is
never the name of a class unless all its rows lack one; an empty table gives
an empty result; other columns are not looked at. MinHash can miss a link, with
a share of 1 - ``recall`` of the links of the weakest band; no link is wrong,
since each is verified.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchside.llm.common import KEY, doc_key, salted_left_join, ship, written
from pitchside.llm.hashing import BASE_1, BASE_2, rolling, word_hashes

ship(__name__)

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 16, 6, 0.999
#: Width of the weakest band of similarity, by which the recall is measured.
BAND = 0.05
#: Words hashed together in a task; rows and shingles of a block.
CHUNK_WORDS, BLOCK_ROWS, BLOCK_SHINGLES = 200_000, 512, 500_000
#: Pairs are few if they are fewer than this part of a group's square.
FEW = 64
#: Rows that leave a task together.
OUT_ROWS = 4096
MIX = 0xBF58476D1CE4E5B9
ID, GROUP = ["ra", "rb"], ["tree", "key", "i", "j"]


def shares_node(similarity, trees: int, depth: int):
    """Probability that a pair shares a node at ``depth`` in some tree."""
    return 1 - (1 - similarity ** depth) ** trees


def prefix_length(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix that finds a pair at the threshold with ``recall``."""
    return next((d for d in range(depth, 1, -1) if shares_node(threshold, trees, d) >= recall), 1)


def measured_recall(links: float, missing: float, threshold: float, trees: int, depth: int) -> float:
    """Recall in the weakest band, from its ``links`` found and those expected
    to be ``missing``; a supposed link at the threshold is counted with both."""
    p = shares_node(threshold, trees, depth)
    return (links + 1) / (links + 1 + missing + (1 - p) / p)


def shingle_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the shingles of a text with words, in order."""
    if len(w) == 0:
        return w
    with np.errstate(over="ignore"):
        h = rolling(w, min(n, len(w)), BASE_1) + np.uint64(min(n, len(w)))
        h = (h ^ (h >> np.uint64(31))) * np.uint64(MIX)
        return h ^ (h >> np.uint64(29))


def _signatures(n: int, trees: int, depth: int):
    """Labels of a text (``depth`` MinHash values a tree), identity of its words."""
    random = np.random.default_rng(20_240_607)
    xor = random.integers(0, 2 ** 63, trees * depth).astype("u8")
    odd = random.integers(0, 2 ** 63, trees * depth).astype("u8") * np.uint64(2) + np.uint64(1)

    def flush(d, t, ws):
        sh = [shingle_hashes(w, n) for w in ws]
        flat = np.concatenate(sh)
        starts = np.cumsum([0, *map(len, sh[:-1])])
        label = np.empty((len(ws), trees * depth), "u4")
        with np.errstate(over="ignore"):
            for j in range(trees * depth):
                label[:, j] = np.minimum.reduceat((flat ^ xor[j]) * odd[j], starts) >> np.uint64(32)
            ids = [[int((rolling(w, len(w), b)[0] + np.uint64(len(w))).view("i8")) for w in ws] for b in (BASE_1, BASE_2)]
        return pa.RecordBatch.from_arrays(
            [pa.array(d, pa.int64()), pa.array(t, pa.int64()), *(pa.array(x, pa.int64()) for x in ids),
             pa.array([len(x) for x in sh], pa.int64()),
             pa.ListArray.from_arrays(pa.array(np.arange(0, label.size + 1, trees * depth), pa.int32()),
                                      pa.array(label.ravel().view("i4")))],
            names=[*KEY, *ID, "size", "label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, t, ws, have = [], [], [], 0
        for batch in batches:
            for x, y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                w = word_hashes((text.as_py() or b"").lower())
                if len(w):
                    d.append(x), t.append(y), ws.append(w)
                    have += len(w)
                if have >= CHUNK_WORDS:
                    yield flush(d, t, ws)
                    d, t, ws, have = [], [], [], 0
        if ws:
            yield flush(d, t, ws)
    return run


def intersections(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the pairwise intersections, from incidence matrices over the
    shingles that two sets or more have, some columns at a time."""
    m = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, term, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[term] > 1
    owner, term = owner[shared], (np.cumsum(count > 1) - 1)[term[shared]]
    order = np.argsort(term, kind="stable")
    owner, term = owner[order], term[order]
    out = np.zeros((m, m), "f4")
    # the last edge lies beyond the last shared term, also where that starts a new run of columns
    cut = np.searchsorted(term, np.arange(0, (term[-1] if len(term) else -1) + 1 + columns, columns))
    for a, b in zip(cut[:-1], cut[1:]):
        rows, local = np.unique(owner[a:b], return_inverse=True)
        part = np.zeros((len(rows), columns), "f4")
        part[local, term[a:b] % columns] = 1
        out[np.ix_(rows, rows)] += part @ part.T
    return out


def overlaps(sets: list[np.ndarray], asked: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs ``asked`` for (a symmetric matrix):
    pair by pair where they are few, and all at once by products otherwise."""
    a, b = np.nonzero(np.triu(asked))
    if len(a) > max(8, len(sets) ** 2 // FEW):
        return intersections(sets)
    out = np.zeros(asked.shape, "f4")
    for x, y in zip(a, b):
        out[x, y] = out[y, x] = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
    return out


def _components(linked: np.ndarray) -> np.ndarray:
    """Least connected index of each row of a symmetric matrix."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The groups (columns ``GROUP``) of sorted rows, one at a time."""
    last, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        by = np.stack([batch.column(c).to_numpy().astype("i8") for c in GROUP])
        edges = [0, *(np.flatnonzero((by[:, 1:] != by[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            group = tuple(by[:, a])
            if group != last and parts:
                yield pa.Table.from_batches(parts)
                parts = []
            last = group
            parts.append(batch.slice(a, b - a))
    if parts:
        yield pa.Table.from_batches(parts)


def _joined(tables: Iterator[pa.Table], rows: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of at least ``rows`` rows, but for the last: groups are small."""
    parts, have = [], 0
    for table in tables:
        if table.num_rows:
            parts.append(table)
            have += table.num_rows
        if have >= rows:
            yield from pa.concat_tables(parts).combine_chunks().to_batches()
            parts, have = [], 0
    if parts:
        yield from pa.concat_tables(parts).combine_chunks().to_batches()


def _new_pairs(group: pa.Table) -> np.ndarray:
    """Which pairs of a group no longer prefix and no earlier tree has."""
    m = group.num_rows
    new = ~np.eye(m, dtype=bool)
    for name in ("earlier", "longer"):
        column = group[name].combine_chunks()
        for keys in column.flatten().to_numpy().reshape(m, -1).T:
            new &= keys[:, None] != keys[None, :]
    if group["i"][0].as_py() != group["j"][0].as_py():
        block = group["block"].to_numpy()
        new &= block[:, None] != block[None, :]
    return new


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each group that are in a new pair."""
    yield from _joined(group.filter(pa.array(_new_pairs(group).any(axis=1))) for group in _groups(batches))


def _verify(n: int, threshold: float, trees: int, levels: list[int]):
    """Links of the new pairs of each group; ``weak`` counts those of the weakest
    band, ``missing`` the links like them that are expected to be missing at each of
    ``levels``."""
    def solve(group: pa.Table):
        new = _new_pairs(group)
        texts = group["text"].cast(pa.binary()).to_pylist()
        sets = [np.unique(shingle_hashes(word_hashes(t.lower()), n)) for t in texts]
        size = np.array([len(s) for s in sets], "f8")
        both = overlaps(sets, new).astype("f8")
        either = size[:, None] + size[None, :] - both
        linked = new & (both >= threshold * either - 1e-9)
        degree = linked.sum(axis=1)
        at = np.flatnonzero(degree)
        similarity = np.minimum(both / either, 1)
        weak = linked & (similarity < threshold + BAND)
        p = [shares_node(similarity[weak], trees, d) for d in levels]
        missing = np.zeros((len(texts), len(levels)))
        for k, x in enumerate(p):
            np.add.at(missing[:, k], np.nonzero(weak)[0], (1 - x) / x)
        ra, rb = group["ra"].to_numpy(), group["rb"].to_numpy()
        order = np.lexsort((rb, ra))                                             # least id first
        root = np.empty(len(texts), "i8")
        root[order] = order[_components(linked[np.ix_(order, order)])]
        return pa.Table.from_arrays(
            [pa.array(x) for x in (ra[at], rb[at], degree[at].astype("i8"), ra[root[at]], rb[root[at]], weak.sum(axis=1)[at].astype("i8"))]
            + [pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * len(levels) + 1, len(levels)), pa.int32()),
                                        pa.array(missing[at].ravel()))],
            names=["ra", "rb", "links", "to_a", "to_b", "weak", "missing"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _joined(map(solve, _groups(batches)))
    return run


def components(edges: DataFrame) -> DataFrame:
    """``ra, rb`` to ``to_a, to_b``, one text of its component, for all texts in
    ``edges`` (columns ``ra, rb, to_a, to_b``). The order of the texts is drawn
    anew in each round, so that no chain of names can hold the contraction up."""
    edges = edges.filter((F.col("ra") != F.col("to_a")) | (F.col("rb") != F.col("to_b"))).select(
        F.struct(F.col("ra").alias("a"), F.col("rb").alias("b")).alias("u"),
        F.struct(F.col("to_a").alias("a"), F.col("to_b").alias("b")).alias("v"))
    edges = written(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "op7-edges")
    roots = written(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct(), "op7-roots")
    drawn = lambda c, i: F.struct(F.xxhash64(F.col(c), F.lit(i)).alias("h"), F.col(c).alias("node"))
    for i in itertools.count():
        if not edges.limit(1).count():
            break
        least = F.least(drawn("u", i), F.min(drawn("v", i)))["node"]
        to = written(edges.groupBy("u").agg(least.alias("p")), "op7-to")
        step = to.select(F.col("u").alias("root"), "p")
        roots = written(roots.join(step, "root", "left").select("node", F.coalesce("p", "root").alias("root")), "op7-roots")
        at = lambda c: to.select(F.col("u").alias(c), F.col("p").alias(f"{c}p"))
        edges = edges.join(at("u"), "u").join(at("v"), "v").filter(F.col("up") != F.col("vp"))
        edges = written(edges.select(F.col("up").alias("u"), F.col("vp").alias("v")).distinct(), "op7-edges")
    return roots.select(F.col("node.a").alias("ra"), F.col("node.b").alias("rb"),
                        F.col("root.a").alias("to_a"), F.col("root.b").alias("to_b"))


def _keys(depth: int, d: int, trees: int):
    """Names of a label's nodes at depth ``d``, one a tree."""
    return F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64(F.slice("label", t * depth + 1, F.lit(d)), t))


def climb(found: DataFrame, texts: DataFrame, d: int, verify, trees: int, depth: int,
          block_rows: int, block_shingles: int) -> DataFrame:
    """Verified links of the pairs that are new at depth ``d``. ``found`` has the
    texts with a label and the trees they are ``alive`` in, ``texts`` their words."""
    at = found.select(*ID, "size", "alive", _keys(depth, d, trees).alias("here"),
                      (_keys(depth, d + 1, trees) if d < depth else F.array().cast("array<long>")).alias("longer"))
    placed = at.select(*ID, "size", "here", "longer", F.explode("alive").alias("tree"))
    placed = placed.withColumn("key", F.get("here", F.col("tree")))
    child = F.get("longer", F.col("tree"))
    branches = F.lit(True) if d == depth else F.min(child) != F.max(child)
    node = placed.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"), branches.alias("branches"))
    node = node.filter((F.col("n") > 1) & F.col("branches"))
    blocks = F.greatest(F.ceil(F.col("n") / block_rows), F.ceil(F.col("shingles") / block_shingles)).cast("int")
    node = written(node.select("tree", "key", blocks.alias("blocks")), "op7-open")
    # members of blocks, for each pair of blocks
    member = placed.join(node, ["tree", "key"]).withColumn("block", F.pmod(F.xxhash64(*ID), F.col("blocks")).cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    member = member.select(*ID, "tree", "key", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                           F.slice("here", F.lit(1), F.col("tree")).alias("earlier"), "longer")
    dealt = member.repartition(*GROUP).sortWithinPartitions(*GROUP)
    new = written(dealt.mapInArrow(_members, member.schema), "op7-new")
    groups = new.join(texts, ID).repartition(*GROUP).sortWithinPartitions(*GROUP)
    return written(groups.mapInArrow(verify, "ra long, rb long, links long, to_a long, to_b long, weak long, missing array<double>"),
                   "op7-verified")


def search(keyed: DataFrame, reps: DataFrame, n: int, threshold: float, trees: int, depth: int, recall: float,
           block_rows: int, block_shingles: int) -> DataFrame:
    """Verified links of all depths that the measured recall asks for."""
    floor = prefix_length(threshold, trees, depth, recall)
    levels = list(range(depth, floor - 1, -1))
    # the tries' nodes with two texts or more at the least depth, and the texts below them
    nodes = reps.select(*ID, F.posexplode(_keys(depth, floor, trees)).alias("tree", "key"))
    full = written(nodes.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("tree", "key"), "op7-nodes")
    alive = nodes.join(full, ["tree", "key"]).groupBy(*ID).agg(F.collect_list("tree").alias("alive"))
    found = written(reps.join(alive, ID), "op7-found")
    texts = keyed.select(*KEY, "text").join(found.select(*ID, F.col("rep._d").alias("_d"), F.col("rep._t").alias("_t")), KEY)
    texts = written(texts.select(*ID, "text").dropDuplicates(ID), "op7-texts")
    verify = _verify(n, threshold, trees, levels)
    verified = None
    for k, d in enumerate(levels):
        step = climb(found, texts, d, verify, trees, depth, block_rows, block_shingles)
        verified = step if verified is None else verified.unionByName(step)
        weak, missing = verified.agg(F.sum("weak"), F.sum(F.get("missing", F.lit(k)))).first()      # both ends of a link
        if measured_recall((weak or 0) / 2, (missing or 0) / 2, threshold, trees, d) >= recall:
            break
    return verified


def link(docs: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH,
         recall: float = RECALL, block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per document row: ``doc_id``, ``_d``, ``_t``, ``class_id`` (the least
    document id of its component), ``root`` (the identity of the component; null for a
    text without words), ``n_copies`` (rows with equal words, itself
    included) and ``n_links`` (other texts that are linked with its text)."""
    key = doc_key(F.col("doc_id"), F.col("text"))
    keyed = docs.select(*key, "doc_id", "text")
    signed = written(keyed.select(*KEY, "text").mapInArrow(
        _signatures(n, trees, depth), "_d long, _t long, ra long, rb long, size long, label array<int>"), "op7-signed")
    reps = written(signed.groupBy(*ID).agg(F.min(F.struct(*KEY)).alias("rep"), F.count(F.lit(1)).alias("n_copies"),
                                           F.any_value("size").alias("size"), F.any_value("label").alias("label")), "op7-reps")
    verified = search(keyed, reps, n, threshold, trees, depth, recall, block_rows, block_shingles)
    links = verified.groupBy(*ID).agg(F.sum("links").alias("n_links"))
    # classes, and their names
    roots = components(verified.select(*ID, "to_a", "to_b"))
    named = reps.select(*ID, F.col("rep._d").alias("least"), "n_copies").join(roots, ID, "left").join(links, ID, "left")
    named = named.select(*ID, "least", "n_copies", "n_links", F.coalesce("to_a", "ra").alias("to_a"),
                         F.coalesce("to_b", "rb").alias("to_b"))
    named = written(named, "op7-named")
    classes = named.groupBy("to_a", "to_b").agg(F.min("least").alias("class_id"))
    root = F.struct("to_a", "to_b").alias("root")
    named = written(salted_left_join(named, classes, ["to_a", "to_b"], ID).select(*ID, "class_id", root, "n_copies", "n_links"),
                    "op7-classes")
    rows = salted_left_join(signed.select(*KEY, *ID).distinct(), named, ID, KEY).drop(*ID)
    out = keyed.select(*KEY, "doc_id").join(rows, KEY, "left")
    none = F.lit(2 ** 63 - 1)
    return out.select("doc_id", *KEY, "root", F.when(F.col("class_id").isNull(), F.col("doc_id"))
                      .otherwise(F.nullif("class_id", none)).alias("class_id"),
                      F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def classes(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    return link(docs).select("doc_id", "class_id", "n_copies", "n_links")
