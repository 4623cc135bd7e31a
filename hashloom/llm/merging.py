"""The pair occurrence index: BPE merges of many words at once.

All words of a batch lie in one array of symbols, linked left and right.  An index maps
each rank to the positions whose pair has that rank.  The lowest active rank is taken,
its occurrences that are still current are merged, and the pairs on either side of each
are looked up again and put in the index.  As words don't touch, this is what the greedy
rule (lowest rank first, leftmost among equals) does in each of them, provided that a
merge brings no pair of the same or a lower rank before the word's next occurrence; a
word where it would is merged one occurrence at a time.
"""

from __future__ import annotations

import heapq

import numpy as np

NONE = np.int32(2**31 - 1)


class Pairs:
    """(left id, right id) -> (rank, new id); equal ranks are taken from the left."""

    def __init__(self, left, right, rank, new):
        key = (np.asarray(left, np.int64) << 32) | np.asarray(right, np.int64)
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.rank = np.asarray(rank, np.int32)[order]
        self.new = np.asarray(new, np.int32)[order]
        # Pairs of single-byte-like small ids are looked up directly.
        self.small = 1 << 9
        self.direct = np.full(self.small * self.small, -1, np.int32)
        low = ((self.key >> 32) < self.small) & ((self.key & 0xFFFFFFFF) < self.small)
        self.direct[(self.key[low] >> 32) * self.small + (self.key[low] & 0xFFFFFFFF)] = np.flatnonzero(low)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Row of each pair, -1 where there is none."""
        out = np.full(len(left), -1, np.int32)
        low = (left < self.small) & (right < self.small) & (left >= 0) & (right >= 0)
        if low.any():
            out[low] = self.direct[left[low].astype(np.int64) * self.small + right[low]]
        high = np.flatnonzero(~low)
        if high.size and len(self.key):
            key = (left[high].astype(np.int64) << 32) | right[high].astype(np.int64)
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            out[high] = np.where(self.key[at] == key, at, -1)
        return out

    def ranks(self, left, right) -> tuple[np.ndarray, np.ndarray]:
        at = self.find(left, right)
        hit = at >= 0
        return np.where(hit, self.rank[at], NONE), np.where(hit, self.new[at], -1)


def merge_one(sym: list[int], table: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The greedy rule on one word by a heap; for words too long for the index to gain."""
    n = len(sym)
    sym, nxt, prv = list(sym), [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(*table[p], i, *p) for i, p in enumerate(zip(sym, sym[1:], strict=False)) if p in table]
    heapq.heapify(heap)
    # Entries are (rank, new, position, left, right); order by rank, then position.
    heap = [(r, i, new, a, b) for r, new, i, a, b in heap]
    heapq.heapify(heap)
    while heap:
        _, i, new, a, b = heapq.heappop(heap)
        j = nxt[i]
        if sym[i] != a or j < 0 or sym[j] != b:
            continue
        sym[i], sym[j], nxt[i] = new, -1, nxt[j]
        if nxt[j] >= 0:
            prv[nxt[j]] = i
        for x, y in ((prv[i], i), (i, nxt[i])):
            if x >= 0 and y >= 0 and (got := table.get((sym[x], sym[y]))):
                heapq.heappush(heap, (got[0], x, got[1], sym[x], sym[y]))
    return [s for s in sym if s >= 0]


def merge_words(sym: np.ndarray, lengths: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all words one after the other -> the merged symbols and their number in
    each word.  ``lengths`` may hold zeros."""
    n = len(sym)
    ends = np.cumsum(lengths)
    word = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    sym = sym.astype(np.int32).copy()
    nxt = np.arange(1, n + 1, dtype=np.int32)
    prv = np.arange(-1, n - 1, dtype=np.int32)
    full = lengths > 0
    nxt[ends[full] - 1] = -1
    prv[(ends - lengths)[full]] = -1
    rank = np.full(n, NONE, np.int32)
    new = np.full(n, -1, np.int32)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def put(at: np.ndarray) -> None:
        """Looks up the pairs that begin at ``at`` and puts them in the index."""
        right = nxt[at]
        rank[at], new[at] = pairs.ranks(sym[at], np.where(right >= 0, sym[right], -1))
        r = rank[at]
        live = r != NONE
        if not live.all():
            at, r = at[live], r[live]
        if not at.size:
            return
        order = np.argsort(r, kind="stable")
        at, r = at[order], r[order]
        cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
        begins = [0, *cuts.tolist()]
        for lo, hi, k in zip(begins, [*begins[1:], len(at)], r[begins].tolist(), strict=True):
            if k in index:
                index[k].append(at[lo:hi])
            else:
                index[k] = [at[lo:hi]]
                heapq.heappush(heap, k)

    put(np.flatnonzero(nxt >= 0).astype(np.int32))
    while heap:
        r = heapq.heappop(heap)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        at = at[(rank[at] == r) & (sym[at] >= 0)]
        if not at.size:
            continue
        if len(at) > 1:
            every = at
            near = nxt[at[:-1]] == at[1:]  # the next occurrence shares a symbol
            if near.any():
                run = np.arange(len(at))
                run[1:][near] = 0
                run = np.maximum.accumulate(run)
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            same = word[at[:-1]] == word[at[1:]]
            if same.any():  # words with several occurrences: is any of them cut short?
                several = np.zeros(len(at), bool)
                several[1:] |= same
                several[:-1] |= same
                x = at[several]
                a, made = prv[x], new[x]
                t = nxt[nxt[x]]
                low = np.minimum(
                    np.minimum(pairs.ranks(np.where(a >= 0, sym[a], -1), made)[0], pairs.ranks(made, np.where(t >= 0, sym[t], -1))[0]),
                    pairs.ranks(made, made)[0],
                )
                # Neighbours that merge at this step too are covered for by equal products only.
                other = np.zeros(len(x), bool)
                other[1:] |= (t[:-1] == x[1:]) & (made[:-1] != made[1:])
                cut = word[x[(low <= r) | other]]
                if cut.size:
                    # All other places of these words wait, also those that shared a symbol with
                    # one taken: after one merge another of them may come first.
                    slow = np.zeros(len(lengths), bool)
                    slow[cut] = True
                    first = np.r_[True, ~same]
                    at = at[first | ~slow[word[at]]]
                    waits = every[slow[word[every]]]
                    index[r] = [np.setdiff1d(waits, at, assume_unique=True)]
                    heapq.heappush(heap, r)
        q = nxt[at]
        t = nxt[q]
        sym[at] = new[at]
        sym[q] = -1
        rank[q] = NONE
        nxt[at] = t
        has = t >= 0
        prv[t[has]] = at[has]
        rank[at] = NONE
        left = prv[at]
        touched = np.concatenate((left[left >= 0], at[has]))
        if touched.size:
            put(np.unique(touched) if len(touched) > 1 else touched)
    kept = sym >= 0
    counts = np.bincount(word[kept], minlength=len(lengths)) if n else np.zeros(len(lengths), np.int64)
    return sym[kept], counts
