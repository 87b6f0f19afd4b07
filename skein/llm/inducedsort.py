"""Suffix arrays by induced sorting, in numpy.

Suffixes are classified as larger (L) or smaller (S) than the next one; the substrings between
leftmost-smaller suffixes are sorted by one round of inducing and named; the string of names is
sorted recursively; its order induces the array of all suffixes, L from the left, S from the right.
Each round walks the buckets of first characters.  Few buckets are walked as wholes, their entries
moved together; a string of names has about as many buckets as characters and is walked one by one.
A level has at most half the characters of the one before, so the work is linear.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are walked by the bucket.
WALKED = 258


def _put(sa: np.ndarray, at: np.ndarray, chars: np.ndarray, items: np.ndarray, step: int) -> None:
    """Append items, in order, to the buckets of their characters; ``at`` is where each bucket goes on."""
    order = np.argsort(chars, kind="stable")
    c = chars[order]
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    size = np.diff(np.append(first, len(c)))
    rank = np.arange(len(c)) - np.repeat(first, size)
    sa[at[c] + step * rank] = items[order]
    at[c[first]] += step * size


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The array that the ordered leftmost-smaller suffixes ``lms`` induce."""
    n, k = len(t), len(top) - 1
    sa = np.full(n, -1, np.int64)
    head, tail = top[:-1].copy(), top[1:] - 1
    by = t[lms]
    lo, hi = np.searchsorted(by, np.arange(k)), np.searchsorted(by, np.arange(k), "right")
    sa[0] = n - 1  # the end mark
    for c in range(k):
        front = sa[top[c] : head[c]]
        while len(front):
            before = front[front > 0] - 1
            before = before[~small[before]]
            start = head[c]
            if len(before):
                _put(sa, head, t[before], before, 1)
            front = sa[start : head[c]]
        own = lms[lo[c] : hi[c]]
        before = own[own > 0] - 1
        before = before[~small[before]]
        if len(before):
            _put(sa, head, t[before], before, 1)
    for c in range(k - 1, 0, -1):
        done = top[c + 1]
        while True:  # S suffixes of the bucket, from its end, as far as they have come
            start = tail[c] + 1
            front = sa[start:done][::-1]
            if not len(front):
                break
            before = front[front > 0] - 1
            before = before[small[before]]
            if len(before):
                _put(sa, tail, t[before], before, -1)
            done = start
        front = sa[top[c] : head[c]][::-1]
        before = front[front > 0] - 1
        before = before[small[before]]
        if len(before):
            _put(sa, tail, t[before], before, -1)
    return sa


def _induce_each(t: np.ndarray, small: np.ndarray, lms: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The same array, one suffix after the other."""
    n = len(t)
    # the character before each suffix if that makes a larger or a smaller one, else -1; the last entry stands for empty places
    before = np.append(-1, np.append(t[:-1], -1))
    of = np.append(False, np.append(small[:-1], False))
    larger, smaller = np.where(of, -1, before).tolist(), np.where(of, before, -1).tolist()
    sa, tail, chars = [-1] * n, top[1:].tolist(), t[lms].tolist()
    for i, c in zip(reversed(lms.tolist()), reversed(chars), strict=True):
        tail[c] = p = tail[c] - 1
        sa[p] = i
    head = top[:-1].tolist()
    for i in sa:  # places ahead are filled while the walk goes on
        c = larger[i]
        if c >= 0:
            p = head[c]
            sa[p] = i - 1
            head[c] = p + 1
    tail = top[1:].tolist()
    for i in reversed(sa):
        c = smaller[i]
        if c >= 0:
            tail[c] = p = tail[c] - 1
            sa[p] = i - 1
    sa[0] = n - 1
    return np.array(sa, np.int64)


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """``t``: integers below ``k`` that end with the only 0."""
    n = len(t)
    if n < 3:
        return np.arange(n)[::-1].copy()
    induce = _induce if k <= WALKED else _induce_each
    # a suffix is smaller than the next if its first change of character is upward
    change = np.flatnonzero(t[1:] != t[:-1])
    up = t[change + 1] > t[change]
    nxt = np.searchsorted(change, np.arange(n - 1))
    small = np.ones(n, bool)
    small[:-1] = up[np.minimum(nxt, len(change) - 1)]
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    top = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=k))])
    # one round of inducing sorts the substrings between leftmost-smaller suffixes
    sa = induce(t, small, lms[np.argsort(t[lms], kind="stable")], top)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    # equal neighbours get one name: same length, characters and types
    length = np.zeros(n, np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    size = length[a]
    live, j = np.flatnonzero(same), 0
    while len(live):
        x, y = a[live] + j, b[live] + j
        ok = (t[x] == t[y]) & (small[x] == small[y])
        same[live[~ok]] = False
        live = live[ok]
        j += 1
        live = live[size[live] > j]
    name = np.zeros(n, np.int64)
    name[order] = np.concatenate([[0], np.cumsum(~same)])
    names = name[lms]
    if names.max() + 1 < len(lms):
        sub = suffix_array(names, int(names.max()) + 1)
    else:
        sub = np.empty(len(lms), np.int64)
        sub[names] = np.arange(len(lms))
    return induce(t, small, lms[sub], top)


def common_prefixes(data: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes: of each position with the suffix before it in ``sa``, up to ``most`` bytes."""
    n = len(sa)
    padded = np.concatenate([data, np.zeros(most + 8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (n + most, 8), (1, 1)).copy().view(">u8")[:, 0].astype(np.uint64)
    phi = np.empty(n, np.int64)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = -1
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(phi >= 0)
    for at in range(0, most, 8):
        diff = words[live + at] ^ words[phi[live] + at]
        equal = diff == 0
        part = diff[~equal]
        out[live[~equal]] = at + (np.frexp(part.astype(np.float64))[1] * -1 + 64) // 8 if len(part) else 0
        live = live[equal]
    out[live] = most
    return np.minimum(out, most)
