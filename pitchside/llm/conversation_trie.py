"""Operator 11: the prefix trie of rebuilt conversations, by van Emde Boas
recursion over the depth.

A conversation is its turns (role, text) ordered by turn number, null first.
``rebuilt`` first gives it the head of another one, as the contract says. A node
of the trie is a distinct sequence of the first d turns; the conversations that
start with it are its members.

Every turn is a 128-bit digest from the start. The recursion halves the depth:

1. Cut. The turns of a conversation lie in base blocks of ``BLOCK`` turns, two
   neighbours make a block of twice the length, and so on up to the longest
   conversation. A full block is named by the digest of its halves' names, level
   by level, half as many rows each time (``halved``).
2. Name the cut prefixes, from the top down: the upper half of a block keeps the
   context that the block is in; the lower half's context is the digest of this
   context and the upper half's name. Equal prefixes have equal contexts and no
   others do, so at every level all upper tries and all forests of lower tries
   are made at once, whatever conversation they come from (``handed_down``).
3. Base tries. A node is named within its block by its context and its turns; one
   aggregate with a map-side step by name gives its members, its smallest member
   (which stands for it), and the counts that its own turn is worth.
4. Graft upwards. What a node adds to its ancestors goes along the path of its
   smallest member: sums within the block, and the totals of lower blocks are
   added to the cut that they hang from, by the same halving as in 1 and 2. An
   aggregate by name then sums what reaches each node.

No group is ever collected: a conversation is numbered in slices of ``TURNS``
turn numbers whose counts alone meet, its blocks are rows, and hot nodes are
pre-aggregated. A node's list of ending conversations is made of pieces of at
most 1024 ids, and its digest runs over the pieces as a stream.

Defined results: null role or text is empty; of rows with one turn number that
of the smaller digest (role, then text) comes first, and a repeated row is a
turn as often as it comes; a row without a conv_id is no conversation's and is
left out; an empty table has no conversation and so no node, not even a root; no
text is too long, as only its digest and its number of words are kept; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchside.llm.common import ship, written

ship(__name__)

#: Turns of a base block; turn numbers of a slice; ids of a piece (a power of two).
BLOCK, TURNS, PIECE_BITS = 8, 256, 10
#: Turns of the head that the contract takes from another conversation, at most.
HEAD = 3
WORD = r"[^\x20\x09-\x0D]+"
CONV = ["conv_id"]


def digest(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*[p.cast("binary") for p in parts])))


ROOT = hashlib.md5(b"").digest()


def numbered(conversations: DataFrame) -> DataFrame:
    """Slices of conversations: ``turns`` (digest, words) in order, and the
    number of turns ``before`` them."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(-2 ** 62)).cast("long").alias("slice"),
        F.struct(F.col("turn").cast("long").alias("turn"),
                 digest(F.concat(F.octet_length(role).cast("string"), F.lit(":")), role, text).alias("token"),
                 F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).alias("t"))
    slices = rows.groupBy(*CONV, "slice").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    slices = written(slices.withColumn("n", F.size("turns").cast("long")), "op11-slices")
    earlier = Window.partitionBy(*CONV).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = slices.select(*CONV, "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return slices.join(before, [*CONV, "slice"])


def _turns(slices: DataFrame) -> DataFrame:
    """A row per turn with its place ``at`` in the conversation, from 0."""
    return slices.select(*CONV, "before", F.posexplode("turns").alias("i", "t")).select(
        *CONV, (F.col("before") + F.col("i")).alias("at"), "t.token", "t.words")


def own(slices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: (conv_id, length) and their turns."""
    return slices.groupBy(*CONV).agg(F.sum("n").alias("length")), _turns(slices)


def rebuilt(slices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract's conversations: c has the first h turns of c - c % 20 and
    then its own turns after its first h, h = crc32(c) % 4."""
    base = F.col("conv_id") - F.col("conv_id") % 20
    convs = slices.groupBy(*CONV).agg(F.sum("n").alias("n")).withColumns({
        "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4, "base": base})
    heads = slices.filter((F.col("conv_id") % 20 == 0) & (F.col("before") < HEAD)).withColumn(
        "turns", F.slice("turns", 1, HEAD))
    heads = (_turns(heads).filter(F.col("at") < HEAD).groupBy(F.col("conv_id").alias("base"))
             .agg(F.sort_array(F.collect_list(F.struct("at", "token", "words"))).alias("head")))
    convs = convs.join(heads, "base", "left").withColumn(
        "head", F.filter("head", lambda t: t["at"] < F.col("h"))).withColumn("m", F.coalesce(F.size("head"), F.lit(0)).cast("long"))
    convs = convs.withColumn("m", F.when(F.col("head").isNull(), 0).otherwise(F.col("m"))).withColumn(
        "length", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = written(convs.select(*CONV, "h", "m", "head", "length"), "op11-conversations")
    kept = (slices.join(convs.select(*CONV, "h", "m"), CONV)
            .select(*CONV, "h", "m", "before", F.posexplode("turns").alias("i", "t"))
            .withColumn("at", F.col("before") + F.col("i") - F.col("h")).filter(F.col("at") >= 0)
            .select(*CONV, (F.col("at") + F.col("m")).alias("at"), "t.token", "t.words"))
    head = convs.select(*CONV, F.inline("head")).select(*CONV, "at", "token", "words")
    return convs.select(*CONV, "length"), kept.unionByName(head)


def halved(level: DataFrame, joined: Callable[[Column, Column], Column]) -> DataFrame:
    """From blocks (conv_id, s, v) to blocks of twice the length: the values of
    the halves ``l`` and ``r`` (null: there is none) and that of both, ``v``."""
    side = lambda i: F.max(F.when(F.col("s") % 2 == i, F.col("v")))
    both = level.groupBy(*CONV, F.shiftright("s", 1).alias("s")).agg(side(0).alias("l"), side(1).alias("r"))
    return both.withColumn("v", joined(F.col("l"), F.col("r")))


def handed_down(base: DataFrame, levels: int, joined: Callable[[Column, Column], Column], top: Column,
                upper: Callable[[Column, Column], Column], lower: Callable[[Column, Column], Column], label: str) -> DataFrame:
    """The recursion: blocks (conv_id, s, v) are joined level by level up to one
    block a conversation, which gets ``top``; then each block's value ``c`` is
    handed to its halves, ``upper(c, r)`` and ``lower(c, l)``, down to the base."""
    ups = [base]
    for j in range(levels):
        ups.append(written(halved(ups[-1], joined), f"op11-{label}-{j}"))
    down = ups[-1].select(*CONV, "s", top.alias("c"))
    for up in reversed(ups[1:]):
        c, l, r = F.col("c"), F.col("l"), F.col("r")
        halves = F.array(F.struct((2 * F.col("s")).alias("s"), upper(c, r).alias("c")),
                         F.struct((2 * F.col("s") + 1).alias("s"), lower(c, l).alias("c")))
        down = down.join(up.select(*CONV, "s", "l", "r"), [*CONV, "s"]).select(
            *CONV, F.inline(F.slice(halves, 1, F.when(r.isNull(), 1).otherwise(2))))
    return written(down, f"op11-{label}")


def paths(lengths: DataFrame, turns: DataFrame, block: int = BLOCK) -> tuple[DataFrame, int]:
    """One row per conversation and base block: the names of its nodes, the words
    of their turns, and the parent of the first; and the number of levels."""
    rows = turns.join(lengths, CONV).withColumn("s", F.floor(F.col("at") / block))
    blocks = rows.groupBy(*CONV, "s").agg(
        F.sort_array(F.collect_list(F.struct("at", "token", "words"))).alias("t"), F.any_value("length").alias("length"))
    blocks = written(blocks.select(*CONV, "s", "length", F.col("t.token").alias("tokens"), F.col("t.words").alias("words")),
                     "op11-blocks")
    longest = blocks.agg(F.max("length")).first()[0] or 0
    levels = max(-(-longest // block) - 1, 0).bit_length()
    step = lambda acc, t: F.array_append(acc, digest(F.element_at(acc, -1), t))
    names = F.slice(F.aggregate("tokens", F.array(F.col("context")), step), 2, block)
    short = blocks.filter(F.col("length") <= block).withColumn("context", F.lit(ROOT))
    short = short.select("*", names.alias("names"), F.lit(ROOT).alias("parent"))
    if not levels:
        return short.drop("tokens", "context"), 0
    # of full blocks alone; others have none after them
    long = blocks.filter(F.col("length") > block)
    whole = F.when(F.size("tokens") == block, F.aggregate("tokens", F.lit(b""), lambda a, t: F.concat(a, t)))
    both = lambda l, r: F.struct(digest(l["name"], r["name"]).alias("name"))
    context = handed_down(long.select(*CONV, "s", F.struct(digest(whole).alias("name")).alias("v")), levels, both, F.lit(ROOT),
                          lambda c, r: c, lambda c, l: digest(c, l["name"]), "names")
    long = written(long.join(context.withColumnRenamed("c", "context"), [*CONV, "s"]).select("*", names.alias("names")), "op11-long")
    above = long.select(*CONV, (F.col("s") + 1).alias("s"), F.element_at("names", -1).alias("parent"))
    long = long.join(above, [*CONV, "s"], "left").withColumn("parent", F.coalesce("parent", F.lit(ROOT)))
    return short.unionByName(long).drop("tokens", "context"), levels


def ends_digest(ends: DataFrame) -> DataFrame:
    """``ends_sha256`` per name from (name, conv_id): the ids ascending, joined by commas."""
    pieces = ends.groupBy("name", F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            names, shas = [], []
            for x, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if x != name:
                    if state:
                        names.append(name)
                        shas.append(state.hexdigest())
                    name, state = x, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.binary()), "ends_sha256": pa.array(shas, pa.string())})
        if state:
            yield pa.RecordBatch.from_pydict({"name": pa.array([name], pa.binary()), "ends_sha256": pa.array([state.hexdigest()])})

    return (pieces.repartition("name").sortWithinPartitions("name", "piece").select("name", "ids")
            .mapInArrow(run, "name binary, ends_sha256 string"))


def trie(lengths: DataFrame, turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per node: ``name``, ``parent``, ``conv_id`` (smallest member),
    ``depth``, ``n_convs``, ``n_ends``, ``n_children``, ``n_leaves``, ``saved_tokens``,
    ``parent_conv_id``, ``ends_sha256``."""
    found, levels = paths(lengths, turns, block)
    path = written(found, "op11-paths")
    rows = path.select(*CONV, "s", "length", F.posexplode(F.arrays_zip(
        "names", "words", F.concat(F.array("parent"), F.slice("names", 1, F.size("names") - 1)).alias("parents"))).alias("i", "x"))
    rows = rows.select(*CONV, "length", F.col("x.names").alias("name"), F.col("x.parents").alias("parent"), F.col("x.words").alias("words"),
                       (F.col("s") * block + F.col("i") + 1).alias("depth"))
    nodes = rows.groupBy("name").agg(
        F.any_value("parent").alias("parent"), F.any_value("depth").alias("depth"), F.any_value("words").alias("words"),
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.count_if(F.col("depth") == F.col("length")).alias("n_ends"))
    root = lengths.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"),
                       F.count_if(F.col("length") == 0).alias("n_ends")).filter(F.col("n_convs") > 0).select(
        F.lit(ROOT).alias("name"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"),
        F.lit(0).cast("long").alias("words"), "n_convs", "conv_id", "n_ends")
    nodes = written(nodes.unionByName(root), "op11-nodes")
    children = nodes.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("name")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "op11-counted")

    # what each node adds, at its place in the path of its smallest member
    place = F.col("depth") - 1
    adds = nodes.filter(F.col("depth") > 0).select(
        *CONV, F.floor(place / block).alias("s"), F.struct((place % block).alias("i"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
                                                           (F.col("n_children") == 0).cast("long").alias("leaves")).alias("a"))
    adds = written(adds.filter((F.col("a.saved") > 0) | (F.col("a.leaves") > 0)).groupBy(*CONV, "s").agg(
        F.collect_list("a").alias("adds"), F.sum("a.saved").alias("saved"), F.sum("a.leaves").alias("leaves")), "op11-adds")
    none = F.struct(F.lit(0).cast("long").alias("saved"), F.lit(0).cast("long").alias("leaves"))
    hung = path.select(*CONV, "s", "length", "names").join(adds, [*CONV, "s"], "left")
    if levels:
        long = written(hung.filter(F.col("length") > block), "op11-hung")
        total = F.struct(*[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("saved", "leaves")])
        plus = lambda a, b: F.struct(*[(a[c] + F.coalesce(b[c], F.lit(0))).alias(c) for c in ("saved", "leaves")])
        below = handed_down(long.select(*CONV, "s", total.alias("v")), levels, plus, none, plus, lambda c, l: c, "graft")
        hung = hung.filter(F.col("length") <= block).withColumn("c", none).unionByName(
            long.join(below, [*CONV, "s"]))
    else:
        hung = hung.withColumn("c", none)
    hung = hung.filter(F.col("adds").isNotNull() | (F.col("c.saved") > 0) | (F.col("c.leaves") > 0))
    from_here = lambda c: lambda _, i: F.aggregate(
        F.filter(F.coalesce("adds", F.expr("array()").cast("array<struct<i:bigint,saved:bigint,leaves:bigint>>")), lambda a: a["i"] >= i),
        F.col(f"c.{c}"), lambda acc, a: acc + a[c])
    sums = hung.select(F.explode(F.arrays_zip("names", F.transform("names", from_here("saved")).alias("saved"),
                                              F.transform("names", from_here("leaves")).alias("leaves"))).alias("x"))
    sums = sums.select(F.col("x.names").alias("name"), F.col("x.saved").alias("saved"), F.col("x.leaves").alias("leaves"))
    sums = sums.unionByName(adds.select(F.lit(ROOT).alias("name"), "saved", "leaves"))      # the root is above them all
    totals = sums.groupBy("name").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    ends = rows.filter(F.col("depth") == F.col("length")).select("name", "conv_id").unionByName(
        lengths.filter(F.col("length") == 0).select(F.lit(ROOT).alias("name"), "conv_id"))
    out = nodes.join(totals, "name", "left").join(ends_digest(ends), "name", "left")
    above = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = written(out.select(*nodes.columns, F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
                             F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
                             F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")), "op11-totals")
    # two written tables: Spark can split a parent with very many children
    return out.join(above, "parent", "left")


def nodes(conversations: DataFrame) -> DataFrame:
    """The contract's columns, over the rebuilt conversations."""
    lengths, turns = rebuilt(numbered(conversations))
    return trie(lengths, turns).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                                       "ends_sha256", "n_ends")
