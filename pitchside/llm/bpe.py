"""Operator 3: byte-level BPE encoding and decoding with a rank queue.

A text is cut into pre-tokens by the tokenizer's pattern; each pre-token is
merged on its own. The parts of a pre-token form a doubly linked list over
byte positions. Every adjacent pair whose bytes are a vocabulary entry waits
in the bucket of that entry's rank, as the position of its left part. Which
buckets are filled is kept in a hierarchical bitmap (leaf words of 256 bits
under a top word that grows with the vocabulary), so the lowest rank is found
with two find-first-set steps however long the pre-token is. A bucket gives
its leftmost position first. An entry whose pair has changed since it was
filed is stale and skipped. The cost is O(n log n) for a pre-token of n
bytes; a scan for the minimum would be O(n^2).

Spark deals the rows; each Arrow batch is encoded on its own, without a
shuffle, and a lost executor repeats single tasks. Equal pre-tokens are merged
once per worker and kept in a dictionary of bounded size.

Defined results: a null text encodes as an empty one; an empty text has no
ids; rows, repeated ones included, stay as many as they were; an empty table
gives an empty result; texts of any length are encoded whole. ``ids`` holds
unsigned 32-bit integers, little endian, so a long text costs four bytes a
token and no boxed integers. An unknown id raises an error in ``decode``.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchside.llm.common import free_name, ship, task_state

ship(__name__)

#: Pre-tokens in each of two generations of a worker's dictionary, and the longest one kept (bytes).
KEPT_PIECES, KEPT_BYTES = 300_000, 48

# Letters and numbers that the ``regex`` module counts as such
# and the Unicode tables of the tiktoken library do not.
NEWER_LETTERS = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF "
    "10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 "
    "187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 "
    "1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED "
    "1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F")
NEWER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"


def _ranges(text: str) -> str:
    """Code points in hexadecimal, single or as first-last, as a character class."""
    return "".join("-".join(chr(int(x, 16)) for x in part.split("-")) for part in text.split())


#: Code points below it take the spelt-out pattern (Latin letters and marks).
PLAIN = 0x250
#: The bits of a leaf word.
BIT = [1 << i for i in range(256)]


class Splitter:
    """Cuts a text into pre-tokens as the tokenizer's pattern asks."""

    def __init__(self, pattern: str) -> None:
        letters, numbers = _ranges(NEWER_LETTERS), _ranges(NEWER_NUMBERS)
        self.plain = regex.compile(pattern)
        self.newer = regex.compile(f"[{letters}{numbers}]")
        strict = pattern.replace(r"[^\s\p{L}\p{N}]", f"(?:@|[{letters}{numbers}])")
        strict = strict.replace(r"\p{L}", rf"[\p{{L}}--[{letters}]]").replace(r"\p{N}", rf"[\p{{N}}--[{numbers}]]")
        self.strict = regex.compile("(?V1)" + strict.replace("@", r"[^\s\p{L}\p{N}]"))
        # The same pattern with its classes written out, for texts of code
        # points below PLAIN: the standard ``re`` module takes a third of the time.
        below = [chr(c) for c in range(PLAIN)]
        sets = {p: re.escape("".join(c for c in below if regex.match(p, c))) for p in (r"\s", r"\p{L}", r"\p{N}")}
        spelt = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{''.join(sets.values())}]").replace(r"\S", f"[^{sets[r'\s']}]")
        for p, members in sets.items():
            spelt = spelt.replace(p + "+", f"[{members}]+")
        plain = not re.search(r"\\[pPsSdDwWX]", spelt) and "(?i" not in spelt
        self.spelt = re.compile(spelt) if plain else None
        self.beyond = re.compile(f"[^{chr(0)}-{chr(PLAIN - 1)}]")

    def __call__(self, text: str) -> list[str]:
        if self.spelt and (text.isascii() or not self.beyond.search(text)):
            return self.spelt.findall(text)
        if not self.newer.search(text):
            return self.plain.findall(text)
        return self.strict.findall(text)


class RankQueue:
    """Positions by rank: buckets, and a hierarchical bitmap over them. A leaf
    word has a bit for each of 256 ranks, the top word one for each leaf.

    A bucket is one position (the usual case) or a heap of several.
    """

    def __init__(self, ranks: int) -> None:
        self.buckets: dict[int, int | list[int]] = {}
        self.leaf = [0] * ((ranks >> 8) + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        buckets = self.buckets
        if rank in buckets:
            bucket = buckets[rank]
            if bucket.__class__ is int:
                buckets[rank] = [bucket, position] if bucket < position else [position, bucket]
            else:
                heapq.heappush(bucket, position)
            return
        buckets[rank] = position
        m = rank >> 8
        word = self.leaf[m]
        if not word:
            self.top |= 1 << m
        self.leaf[m] = word | BIT[rank & 255]

    def pop(self) -> tuple[int, int]:
        """The lowest rank and its leftmost position."""
        top = self.top
        m = (top & -top).bit_length() - 1
        word = self.leaf[m]
        low = word & -word
        rank = (m << 8) + low.bit_length() - 1
        bucket = self.buckets[rank]
        if bucket.__class__ is int:
            position = bucket
        else:
            position = heapq.heappop(bucket)
            if bucket:
                return rank, position
        del self.buckets[rank]
        self.leaf[m] = word = word ^ low
        if not word:
            self.top = top ^ (1 << m)
        return rank, position


class Tokenizer:
    """Ranks, pattern and the merge loop. Made once per task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.split = Splitter(pattern)
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.known = set(ranks.values())
        self.pieces = _Pieces(self)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks, queue = self.ranks, self.queue
        find, push, pop = ranks.get, queue.push, queue.pop
        whole = find(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        if n < 2:
            return [ranks[piece]] if n else []
        after = list(range(1, n + 1))          # start of the next part
        before = list(range(-1, n - 1))        # start of the part before
        waits = [find(piece[i:i + 2], -1) for i in range(n)]   # rank of the pair that starts here
        waits[n - 1] = -1
        for i, r in enumerate(waits):
            if r >= 0:
                push(r, i)
        while queue.top:
            rank, i = pop()
            if waits[i] != rank:
                continue                       # stale
            j = after[i]
            after[i] = k = after[j]
            waits[j] = waits[i] = -1           # the right part is gone
            if k < n:
                before[k] = i
                waits[i] = r = find(piece[i:after[k]], -1)
                if r >= 0:
                    push(r, i)
            h = before[i]
            if h >= 0:
                waits[h] = r = find(piece[h:k], -1)
                if r >= 0:
                    push(r, h)
        out, i = [], 0
        while i < n:
            j = after[i]
            out.append(ranks[piece[i:j]])
            i = j
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as unsigned 32-bit integers, little endian."""
        if not text:
            return b""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        try:
            out = b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        except IndexError as e:
            raise ValueError("an id is not in the vocabulary") from e
        if len(self.known) < len(tokens) and not self.known.issuperset(np.frombuffer(ids, "<u4").tolist()):
            raise ValueError("an id is not in the vocabulary")
        return out


class _Pieces(dict):
    """Pre-token to its encoded ids, merged on first sight. When it is full it
    becomes the old generation; what is used again moves to the new one."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        super().__init__()
        self.tokenizer, self.old = tokenizer, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            raw = piece.encode("utf-8")
            out = self.tokenizer.merge(raw)
            ids = pack(f"<{len(out)}I", *out)
            if len(raw) > KEPT_BYTES:
                return ids
        if len(self) >= KEPT_PIECES:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


def vocabulary_key(path: str, pattern: str) -> str:
    """Names a rank file's contents with a pattern: workers hold one tokenizer
    for it, however many queries use it."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + pattern.encode("utf-8")).hexdigest()


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: per line a token in base64 and its rank. Read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _tokenizer(name: str, ranks, pattern: str) -> Tokenizer:
    """The worker's tokenizer; its dictionary serves all tasks of the worker."""
    state = task_state()
    if name not in state:
        state[name] = Tokenizer(ranks.value, pattern)
    return state[name]


class ByteBPE:
    """Encode and decode columns of a DataFrame with one rank file.

    The vocabulary (a fixed file of about a megabyte) is broadcast once.
    """

    def __init__(self, spark, rank_file: str, pattern: str) -> None:
        self.ranks = spark.sparkContext.broadcast(read_ranks(rank_file))
        self.name, self.pattern = f"bpe {vocabulary_key(rank_file, pattern)}", pattern

    def encode(self, docs: DataFrame, text: str = "text", ids: str = "ids") -> DataFrame:
        """``docs`` with a binary column ``ids``."""
        return docs.withColumn(ids, self._udf(lambda tok, x: tok.encode(x), T.BinaryType(), pa.binary())(F.col(text)))

    def decode(self, encoded: DataFrame, ids: str = "ids", out: str = "decoded") -> DataFrame:
        """``encoded`` with a binary column ``out``: the bytes of the ids (null: null)."""
        back = self._udf(lambda tok, x: None if x is None else tok.decode(x), T.BinaryType(), pa.binary())
        return encoded.withColumn(out, back(F.col(ids)))

    def round_trip(self, docs: DataFrame, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
        """``decode(encode(docs))`` in one pass through the Python workers."""
        def both(tok: Tokenizer, x: str | None) -> tuple[bytes, bytes]:
            encoded = tok.encode(x)
            return encoded, tok.decode(encoded)

        kind = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
        pair = self._udf(both, kind, None)
        both_at = free_name(docs, "_pair")
        made = docs.withColumn(both_at, pair(F.col(text)))
        return made.withColumns({ids: F.col(f"{both_at}.ids"), out: F.col(f"{both_at}.decoded")}).drop(both_at)

    def _udf(self, each, kind: T.DataType, arrow: pa.DataType | None):
        name, ranks, pattern = self.name, self.ranks, self.pattern

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            tok = _tokenizer(name, ranks, pattern)
            for rows in batches:
                made = [each(tok, x.as_py()) for x in rows]
                if arrow is None:
                    a, b = zip(*made) if made else ((), ())
                    yield pa.StructArray.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())],
                                                     names=["ids", "decoded"])
                else:
                    yield pa.array(made, arrow)

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, kind)


def digests(encoded: DataFrame) -> DataFrame:
    """Token count and digests of ids and decoded bytes, in the JVM."""
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
