"""Hashes of words and of word runs, inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

from pitchside.llm.common import ship, task_state

ship(__name__)

BASE_1, BASE_2 = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
#: Words kept in a worker's dictionary.
KEPT_HASHES = 300_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_HASHES:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def word_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hashes of the words; ``bytes.split`` cuts at ASCII white space."""
    words = (text or b"").split()
    table = task_state().setdefault("word hashes", _WordHashes())
    return np.fromiter(map(table.__getitem__, words), "u8", len(words))


def rolling(w: np.ndarray, n: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes of all ``n``-word windows of ``w``, by doubling."""
    if len(w) < n:
        return np.empty(0, "u8")
    with np.errstate(over="ignore"):
        have, size, out, done = w, 1, None, 0
        while True:
            if n & size:
                if out is None:
                    out, done = have, size
                else:                           # the part so far, then ``size`` words more
                    m = len(w) - done - size + 1
                    out = out[:m] * np.uint64(pow(base, size, 1 << 64)) + have[done:done + m]
                    done += size
            if done == n:
                return out[:len(w) - n + 1]
            have = have[:-size] * np.uint64(pow(base, size, 1 << 64)) + have[size:]
            size *= 2
