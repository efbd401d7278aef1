"""Shingle hashes of a text, for fingerprints and near-dedup.

Letters A-Z are lowered; words are maximal runs of anything but ASCII white space; a shingle is
``WORDS`` neighbouring words.  A text with fewer words has their whole sequence as its one
shingle; a text without words has none.
"""

from __future__ import annotations

import numpy as np
import xxhash

from quillon.llm.common import remembers

WORDS = 5
#: Distinct words whose hashes a worker keeps.
MEMO_WORDS = 400_000

_U = np.uint64
_STEP = [pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WORDS)]


class _Memo(dict):
    """Hash of each word seen."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_memo = _Memo()
remembers("shingles", _memo.clear)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words whose bits all depend on all bits of its input."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def shingle_hashes(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the text's shingles, ascending.  ``text`` is UTF-8."""
    parts = (text or b"").lower().split()
    n = len(parts)
    if not n:
        return np.empty(0, _U)
    if n < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(parts), seed=n)], _U)
    h = np.fromiter(map(_memo.__getitem__, parts), _U, n)
    total = h[: n - words + 1].copy()
    for k in range(1, words):
        total += h[k : n - words + 1 + k] * _U(_STEP[k])
    return np.unique(mix(total))
