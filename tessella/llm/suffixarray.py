"""Suffix arrays by induced sorting, and longest common prefixes in text order.

Suffixes are classified as larger (L) or smaller (S) than their right neighbour. Leftmost-S substrings are sorted by
inducing from their first letters, named, and their sequence of names is sorted recursively; the sorted leftmost-S suffixes then
induce the whole array. With a small alphabet a whole bucket is induced at once: its entries, then the entries they put into the
same bucket, until none are left. Names form large alphabets, whose buckets are short; these are induced entry by entry.
"""

from __future__ import annotations

from array import array

import numpy as np

#: Alphabets of up to so many letters are induced bucket by bucket.
BY_BUCKET = 1024
CHUNK = 1 << 16


def _types(s: np.ndarray) -> np.ndarray:
    """True for S. The last suffix, of the sentinel, is S."""
    n = len(s)
    step = np.sign(s[1:].astype(np.int32) - s[:-1]).astype(np.int8)
    # an equal neighbour passes on its own type: look for the next change
    at = np.where(step != 0, np.arange(n - 1, dtype=np.int32), np.int32(n - 1))
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(n, np.bool_)
    known = nearest < n - 1
    out[:-1][known] = step[nearest[known]] > 0
    return out


def _place(sa: np.ndarray, s: np.ndarray, order: np.ndarray, ends: np.ndarray) -> None:
    """Puts the suffixes, in order, at the ends of their buckets."""
    letters = s[order]
    by = np.argsort(letters, kind="stable")
    grouped = letters[by]
    counts = np.bincount(grouped, minlength=len(ends))
    first = np.cumsum(counts) - counts
    sa[ends[grouped] - counts[grouped] + np.arange(len(by)) - first[grouped]] = order[by]


def _append(sa, heads, letters, values, up: bool) -> None:
    if len(letters) < 40:
        for c, v in zip(letters.tolist(), values.tolist()):
            if up:
                sa[heads[c]] = v
                heads[c] += 1
            else:
                heads[c] -= 1
                sa[heads[c]] = v
        return
    by = np.argsort(letters, kind="stable")
    grouped = letters[by]
    counts = np.bincount(grouped, minlength=len(heads))
    rank = np.arange(len(by)) - (np.cumsum(counts) - counts)[grouped]
    if up:
        sa[heads[grouped] + rank] = values[by]
        heads += counts
    else:
        sa[heads[grouped] - 1 - rank] = values[by]
        heads -= counts


def _induce_buckets(s: np.ndarray, small: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: np.ndarray) -> np.ndarray:
    n, letters = len(s), np.flatnonzero(ends > starts)
    sa = np.full(n, -1, np.int32)
    _place(sa, s, order, ends)
    placed = np.bincount(s[order], minlength=len(ends))

    heads = starts.copy()
    for c in letters.tolist():
        low = int(starts[c])
        while low < heads[c]:
            high = int(heads[c])
            j = sa[low:high] - 1
            j = j[j >= 0]
            j = j[~small[j]]
            _append(sa, heads, s[j], j, True)
            low = high
        if placed[c]:
            j = sa[ends[c] - placed[c] : ends[c]] - 1
            j = j[j >= 0]
            j = j[~small[j]]
            _append(sa, heads, s[j], j, True)
    tails = ends.copy()
    for c in letters[::-1].tolist():
        high = int(ends[c])
        while tails[c] < high:
            low = int(tails[c])
            j = sa[low:high][::-1] - 1
            j = j[j >= 0]
            j = j[small[j]]
            _append(sa, tails, s[j], j, False)
            high = low
        if heads[c] > starts[c]:
            j = sa[starts[c] : heads[c]][::-1] - 1
            j = j[j >= 0]
            j = j[small[j]]
            _append(sa, tails, s[j], j, False)
    sa[0] = n - 1
    return sa


def _induce_entries(s: np.ndarray, small: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: np.ndarray) -> np.ndarray:
    n = len(s)
    first = np.full(n, -1, np.int32)
    _place(first, s, order, ends)
    sa, text, is_s = first.tolist(), s.tolist(), small.tolist()
    heads = starts.tolist()
    for i in range(n):
        j = sa[i] - 1
        if j >= 0 and not is_s[j]:
            c = text[j]
            sa[heads[c]] = j
            heads[c] += 1
    tails = ends.tolist()
    for i in range(n - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and is_s[j]:
            c = text[j]
            tails[c] -= 1
            sa[tails[c]] = j
    sa[0] = n - 1
    return np.array(sa, np.int32)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Of integers whose last is a 0 that occurs nowhere else."""
    n = len(s)
    if n < 3:
        return np.arange(n, dtype=np.int32)[::-1].copy()
    small = _types(s)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    counts = np.bincount(s)
    ends = np.cumsum(counts)
    starts = ends - counts
    induce = _induce_buckets if len(counts) <= BY_BUCKET else _induce_entries
    sa = induce(s, small, starts, ends, lms)
    is_lms = np.zeros(n, np.bool_)
    is_lms[lms] = True
    found = sa[is_lms[sa]]
    # names: equal leftmost-S substrings, both ends included, have equal names
    width = np.dtype("<u4") if len(counts) > 65_535 else np.dtype("<u2")
    raw = s.astype(width).tobytes()
    following = np.full(n, n - 1, np.int32)
    following[lms[:-1]] = lms[1:]
    w = width.itemsize
    fresh, last = np.zeros(len(found), np.bool_), b""
    for lo in range(0, len(found), CHUNK):  # in chunks, as slices are large objects
        some = found[lo : lo + CHUNK]
        for k, (x, y) in enumerate(zip((some.astype(np.int64) * w).tolist(), ((following[some].astype(np.int64) + 1) * w).tolist()), lo):
            piece = raw[x:y]
            if piece != last:
                fresh[k] = True
                last = piece
    rank = np.cumsum(fresh) - 1
    del raw, following
    name = np.empty(n, np.int32)
    name[found] = rank
    if rank[-1] + 1 == len(lms):
        return induce(s, small, starts, ends, found)
    # the sentinel is a leftmost-S suffix and has the name 0 alone
    return induce(s, small, starts, ends, lms[suffix_array(name[lms])])


def permuted_lcp(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each suffix in text order, the letters it shares with the suffix before it in the array. Letters are below 65,536."""
    n = len(s)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    raw = s.astype("<u2").tobytes()
    text, out, h = memoryview(raw).cast("H"), array("i", bytes(4 * n)), 0
    for lo in range(0, n, CHUNK):
        for i, j in enumerate(before[lo : lo + CHUNK].tolist(), lo):
            if j < 0:
                h = 0
                continue
            if text[i + h] == text[j + h]:
                # strides while whole chunks are equal, then letter by letter
                far = n - 64 - max(i, j)
                while h < far and raw[2 * (i + h) : 2 * (i + h + 64)] == raw[2 * (j + h) : 2 * (j + h + 64)]:
                    h += 64
                while text[i + h] == text[j + h]:
                    h += 1
            out[i] = h
            if h:
                h -= 1
    return np.frombuffer(out, np.int32)
