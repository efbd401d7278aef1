"""Suffix arrays of byte strings by induced sorting, and permuted common prefixes, in numpy.

``suffix_array`` classifies suffixes as smaller or larger than their right neighbour, sorts the
leftmost smaller (LMS) substrings by induction, names them, sorts the string of names by the same
method, level by level until all names differ, and induces the array from the sorted LMS suffixes.
Over bytes, induction goes bucket by bucket: inside a bucket, all suffixes whose order is known
induce their left neighbours at once, so a bucket takes as many array operations as its character's
longest run.  Over names, of which there may be as many as positions, one scan in each direction
places suffixes one by one.  Either way the work is linear in the text.

``common_prefixes`` gives, for each position in text order, the length it has in common with the
suffix before it in the array.  Only positions whose left character differs from that of their
neighbour need comparing; elsewhere the length is one less than at the position to the left.
"""

from __future__ import annotations

import numpy as np

#: Alphabet up to which induction goes by buckets; beyond, by single suffixes, with the same result.
BYTE_ALPHABET = 258


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour; the last character is the least."""
    n = len(s)
    smaller = np.zeros(n, bool)
    differs = np.flatnonzero(s[:-1] != s[1:])
    if len(differs):
        # a run takes the type of its last position
        nxt = differs[np.minimum(np.searchsorted(differs, np.arange(n - 1)), len(differs) - 1)]
        smaller[:-1] = s[nxt] < s[nxt + 1]
    smaller[-1] = True
    return smaller


def _lms(smaller: np.ndarray) -> np.ndarray:
    return np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1


def _induced(s: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, alphabet: int) -> np.ndarray:
    """The array induced from LMS positions in the order given, each bucket's in its own order."""
    counts = np.bincount(s, minlength=alphabet)
    seed_chars = s[seeds]
    order = np.argsort(seed_chars, kind="stable")
    seeds = seeds[order]
    seed_at = np.searchsorted(seed_chars[order], np.arange(alphabet + 1))
    used = np.flatnonzero(counts)

    def spread(found: np.ndarray, to: dict[int, list], own: int) -> np.ndarray:
        """Deals ``found`` out to the buckets' lists; returns those of bucket ``own``."""
        chars = s[found]
        mine = chars == own
        rest, rest_chars = found[~mine], chars[~mine]
        if len(rest):
            by = np.argsort(rest_chars, kind="stable")
            rest, rest_chars = rest[by], rest_chars[by]
            cuts = (np.flatnonzero(rest_chars[1:] != rest_chars[:-1]) + 1).tolist()
            for x, y in zip([0, *cuts], [*cuts, len(rest)], strict=True):
                to.setdefault(int(rest_chars[x]), []).append(rest[x:y])
        return found[mine]

    larger: dict[int, list] = {}
    for c in used:
        c = int(c)
        got = larger[c] = [np.concatenate(larger[c])] if c in larger else []
        at = 0
        while at < len(got):  # grows while runs of c go on
            prev = got[at] - 1
            at += 1
            prev = prev[prev >= 0]
            prev = prev[~smaller[prev]]
            if len(prev) and len(mine := spread(prev, larger, c)):
                got.append(mine)
        mine = seeds[seed_at[c] : seed_at[c + 1]]
        prev = mine[mine > 0] - 1
        prev = prev[~smaller[prev]]
        if len(prev):
            spread(prev, larger, -1)
    less: dict[int, list] = {}  # from each bucket's end to its begin
    for c in used[::-1]:
        c = int(c)
        got = less[c] = [np.concatenate(less[c])] if c in less else []
        at = 0
        while at < len(got):
            prev = got[at] - 1
            at += 1
            prev = prev[prev >= 0]
            prev = prev[smaller[prev]]
            if len(prev) and len(mine := spread(prev, less, c)):
                got.append(mine)
        if c in larger and larger[c]:
            prev = np.concatenate(larger[c])[::-1] - 1
            prev = prev[prev >= 0]
            prev = prev[smaller[prev]]
            if len(prev):
                spread(prev, less, -1)
    out = []
    for c in used:
        out += larger.get(int(c), [])
        if c == 0:
            out.append(seeds[seed_at[0] : seed_at[1]])  # the end mark alone
        out += [part[::-1] for part in reversed(less.get(int(c), []))]
    return np.concatenate(out)


def _scanned(s: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, alphabet: int) -> np.ndarray:
    """As :func:`_induced`, by one scan for the larger suffixes and one back for the smaller ones."""
    counts = np.bincount(s, minlength=alphabet)
    ends = np.cumsum(counts)
    text, is_less = s.tolist(), smaller.tolist()
    array = [-1] * len(text)
    tail = ends.tolist()
    for p in seeds[::-1].tolist():
        c = text[p]
        tail[c] -= 1
        array[tail[c]] = p
    head = (ends - counts).tolist()
    for p in array:  # grows ahead of the scan
        if p > 0 and not is_less[p - 1]:
            c = text[p - 1]
            array[head[c]] = p - 1
            head[c] += 1
    tail = ends.tolist()
    for i in range(len(array) - 1, -1, -1):
        p = array[i]
        if p > 0 and is_less[p - 1]:
            c = text[p - 1]
            tail[c] -= 1
            array[tail[c]] = p - 1
    return np.array(array, np.int64)


def _sorted(s: np.ndarray, alphabet: int) -> np.ndarray:
    """Suffix array of ``s``, which ends with its only 0."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    smaller = _types(s)
    lms = _lms(smaller)
    induced = _induced if alphabet <= BYTE_ALPHABET else _scanned
    first = induced(s, smaller, lms, alphabet)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = first[is_lms[first]]
    # neighbours with equal characters up to their next LMS position get the same name
    length = np.zeros(n, np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        differ = s[a[live] + k] != s[b[live] + k]
        same[live[differ]] = False
        live = live[~differ]
        k += 1
        live = live[length[a[live]] > k]
    names = np.zeros(n, np.int64)
    names[ordered] = np.concatenate([[0], np.cumsum(~same)])
    text = names[lms]
    top = int(text.max()) + 1
    seeds = ordered if top == len(lms) else lms[_sorted(text, top)]
    return induced(s, smaller, seeds, alphabet)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of a byte array in ascending order."""
    if not len(text):
        return np.zeros(0, np.int64)
    s = np.empty(len(text) + 1, np.int16)  # 16-bit keys are sorted by radix
    s[:-1] = text
    s[:-1] += 1
    s[-1] = 0
    return _sorted(s, 257)[1:]


def common_prefixes(text: np.ndarray, array: np.ndarray, limit: int) -> np.ndarray:
    """Length, up to ``limit``, that each position has in common with the one before it in ``array``.

    In text order: the permuted array.  Beyond ``limit`` lengths aren't told apart.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    at = np.arange(n)
    left = np.full(n, -1, np.int64)
    left[1:] = text[:-1]
    has = before >= 0
    left_of_before = np.where(before > 0, left[np.maximum(before, 0)], -2)
    compare = np.flatnonzero(has & ((left != left_of_before) | (at == 0)))
    padded = np.zeros(n + limit + 8, np.uint8)
    padded[:n] = text
    word = np.zeros(n + limit, np.uint64)
    for k in range(8):
        word |= padded[k : k + n + limit].astype(np.uint64) << np.uint64(8 * k)
    # whole lengths count here: a cut one would make those to its right too short
    lengths = np.zeros(n, np.int64)
    live, done = compare, 0
    while len(live):
        i, j = live + done, before[live] + done
        inside = (i < n) & (j < n)
        x = np.where(inside, word[np.minimum(i, n)] ^ word[np.minimum(j, n)], np.uint64(1))
        full = x == 0
        part = live[~full]
        if len(part):
            low = x[~full]
            low = low & (~low + np.uint64(1))
            equal_bytes = np.log2(low.astype(np.float64)).astype(np.int64) >> 3
            lengths[part] = done + equal_bytes
        live = live[full]
        done += 8
    lengths[compare] = np.minimum(lengths[compare], n - np.maximum(compare, before[compare]))
    # elsewhere: one less than to the left
    known = np.zeros(n, np.int64)
    known[compare] = compare
    known[~has] = at[~has]
    source = np.maximum.accumulate(known)
    lengths = np.where(has, lengths[source] - (at - source), 0)
    return np.minimum(np.maximum(lengths, 0), limit)
