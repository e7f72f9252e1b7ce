"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classified as smaller (S) or larger (L) than the next one. The leftmost S suffixes cut the text into
substrings; these are sorted by induction, named, and the text of their names is sorted recursively where names
repeat. From the sorted leftmost S suffixes two linear scans induce the order of all others. The common prefixes of
neighbours come from the permuted array: in text order each is at least the last one less one (Phi algorithm).
"""

from __future__ import annotations

import numpy as np


def classify(s: np.ndarray) -> np.ndarray:
    """True for suffixes that are smaller than the next one. The last symbol is the smallest and stands once."""
    n = len(s)
    up = np.zeros(n, bool)
    up[-1] = True
    differs = np.flatnonzero(s[1:] != s[:-1])  # a run of equal symbols has the type of its last one
    if len(differs):
        rises = s[differs + 1] > s[differs]
        at = np.searchsorted(differs, np.arange(n - 1))
        up[:-1] = rises[np.minimum(at, len(differs) - 1)]
    return up


def suffix_array(text: np.ndarray) -> list[int]:
    """Starts of the suffixes in ascending order. text: non-negative numbers; the last is 0 and no other is."""
    n = len(text)
    if n == 1:
        return [0]
    up = classify(text)
    first = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    sizes = np.bincount(text)
    ends = np.cumsum(sizes)
    heads, tails = (ends - sizes).tolist(), ends.tolist()
    s, small = text.tolist(), up.tolist()

    def induce(order: list[int]) -> list[int]:
        sa, at = [0] * n, tails[:]
        filled = [False] * n
        for i in reversed(order):
            at[s[i]] -= 1
            sa[at[s[i]]] = i
            filled[at[s[i]]] = True
        at = heads[:]
        for k in range(n):
            if filled[k] and (j := sa[k] - 1) >= 0 and not small[j]:
                c = s[j]
                sa[at[c]] = j
                filled[at[c]] = True
                at[c] += 1
        at = tails[:]
        for k in range(n - 1, -1, -1):
            if filled[k] and (j := sa[k] - 1) >= 0 and small[j]:
                c = s[j]
                at[c] -= 1
                sa[at[c]] = j
                filled[at[c]] = True
        return sa

    starts = first.tolist()
    sa = induce(starts)
    if len(starts) == 1:
        return sa
    stop = dict(zip(starts, [*[b + 1 for b in starts[1:]], n], strict=True))
    name, last, names = 0, None, {}
    for i in sa:
        if i in stop:
            now = s[i : stop[i]]
            if last is not None and now != last:
                name += 1
            names[i], last = name, now
    reduced = [names[i] for i in starts]
    if name + 1 < len(starts):
        order = suffix_array(np.array(reduced))
    else:
        order = [0] * len(starts)
        for k, v in enumerate(reduced):
            order[v] = k
    return induce([starts[k] for k in order])


def common_prefixes(s: list[int] | bytes, sa: list[int], most: int) -> np.ndarray:
    """Length of the prefix that each suffix shares with the one before it in sa, up to `most`; 0 for the first."""
    n = len(sa)
    before = [-1] * n
    for a, b in zip(sa, sa[1:], strict=False):
        before[b] = a
    shared, k = [0] * n, 0
    for i in range(n):
        j = before[i]
        if j < 0:
            k = 0
            continue
        top = min(most, n - max(i, j))
        while k < top and s[i + k] == s[j + k]:
            k += 1
        shared[i] = k
        if k:
            k -= 1
    return np.array(shared)[np.array(sa)]
