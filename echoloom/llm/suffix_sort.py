"""Suffix sorting by induced sorting with disk-backed queues, common-prefix values carried along.

A text of small integers is sorted in three steps. Its leftmost-S substrings are named in sorted
order; if names repeat, the string of names is sorted by recursion. From the order of the leftmost-S
suffixes all L-type suffixes are induced in ascending and then all S-type suffixes in descending
order: whoever is taken out of the queue in rank order puts its predecessor in.

The queue is a priority queue over (first character, rank of the successor). Ranks only grow while
suffixes are taken out, so inside a character the queue is first in, first out; tuples (position,
rank of successor) are kept in memory up to a budget and then appended to a temporary file. All
tuples of a character (or of a range of characters, where the alphabet is large) are taken out at
once and handled as arrays.

For byte texts each induced suffix gets its common prefix with its neighbour: one more than the
smallest common prefix between the two successors. Values are capped at ``CAP``.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

CAP = 254
#: tuples that a queue keeps in memory before it writes them out
IN_MEMORY = 4 << 20
#: tuples handled together where the alphabet is large
BATCH = 1 << 16


class DiskQueue:
    """Tuples by bucket, first in, first out; spilled to one temporary file beyond ``IN_MEMORY`` tuples."""

    def __init__(self, buckets: int, width: int, limit: int | None = None):
        self.held: list[list[np.ndarray]] = [[] for _ in range(buckets)]
        self.spilled: list[list[tuple[int, int]]] = [[] for _ in range(buckets)]
        self.width, self.size, self.limit, self.file = width, 0, limit or IN_MEMORY, None

    def push(self, bucket: np.ndarray, rows: np.ndarray) -> None:
        """``rows`` (n, width) in rank order, each into its bucket."""
        if not len(bucket):
            return
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        cut = np.flatnonzero(np.diff(b)) + 1
        for part, at in zip(np.split(rows[order], cut), np.concatenate([[0], cut]), strict=True):
            self.held[b[at]].append(part)
        self.size += len(b)
        if self.size > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, os.SEEK_END)
        for k, parts in enumerate(self.held):
            if parts:
                a = np.ascontiguousarray(np.concatenate(parts), np.int64)
                self.spilled[k].append((self.file.tell(), len(a)))
                self.file.write(a.tobytes())
                self.held[k] = []
        self.size = 0

    def pop(self, bucket: int) -> np.ndarray:
        """All tuples of a bucket, oldest first."""
        parts = []
        for at, n in self.spilled[bucket]:
            self.file.seek(at)
            parts.append(np.frombuffer(self.file.read(n * self.width * 8), np.int64).reshape(n, self.width))
        own = self.held[bucket]
        self.size -= sum(map(len, own))
        self.spilled[bucket], self.held[bucket] = [], []
        parts += own
        return np.concatenate(parts) if parts else np.zeros((0, self.width), np.int64)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def s_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last one counts as smaller."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int64)))
    where = np.where(step != 0, np.arange(n - 1), n - 1)
    ahead = np.minimum.accumulate(where[::-1])[::-1] if n > 1 else where
    known = np.append(step, 1)
    return np.append(known[ahead] > 0, True) if n > 1 else np.ones(1, bool)


def leftmost_s(is_s: np.ndarray) -> np.ndarray:
    return np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1


def name_substrings(text: np.ndarray, is_s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Order-keeping dense names of the substrings from each leftmost-S position to the next one, both included.

    Characters count with their type, L before S, so that none is a proper prefix of another.
    """
    n = len(text)
    stop = np.append(starts[1:], n - 1)
    coded = (text.astype(np.int64) * 2 + is_s + 1)
    bits = int(coded.max()).bit_length()
    per = max(1, 62 // bits)
    name, active, offset = np.zeros(len(starts), np.int64), np.arange(len(starts)), 0
    while len(active):
        word = np.zeros(len(active), np.int64)
        for k in range(per):
            at = starts[active] + offset + k
            word = (word << bits) | np.where(at <= stop[active], coded[np.minimum(at, n - 1)], 0)
        order = np.lexsort((word, name[active]))
        a, w = name[active][order], word[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1])
        # groups are kept apart by their first member's place in the sorted order of all
        place = np.flatnonzero(new)[np.cumsum(new) - 1]
        first = np.ones(len(a), bool)
        first[1:] = a[1:] != a[:-1]
        base = np.flatnonzero(first)[np.cumsum(first) - 1]
        name[active[order]] = a + (place - base)        # a is the place where its old group begins: still unique and in order
        offset += per
        active = active[starts[active] + offset <= stop[active]]
    return np.unique(name, return_inverse=True)[1].astype(np.int64)


def sort_leftmost_s(text: np.ndarray, is_s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Leftmost-S positions in the order of their suffixes."""
    name = name_substrings(text, is_s, starts)
    if len(name) and int(name.max()) + 1 == len(name):
        return starts[np.argsort(name)]
    return starts[sort_names(name)]


def sort_names(text: np.ndarray) -> np.ndarray:
    """Suffix order of a string over a large alphabet; its last character is the unique smallest."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    is_s = s_types(text)
    starts = leftmost_s(is_s)
    seeds = sort_leftmost_s(text, is_s, starts)
    sigma = int(text.max()) + 1
    # ranges of characters with about BATCH positions each
    ends = np.cumsum(np.bincount(text, minlength=sigma))
    ranged = (ends - 1) // BATCH
    zone = np.unique(np.maximum.accumulate(ranged), return_inverse=True)[1]
    low = np.searchsorted(zone, np.arange(zone[-1] + 2))
    l_parts = _induce_ranges(text, zone, low, None, seeds, True)
    s_parts = _induce_ranges(text, zone, low, l_parts, seeds, False)
    return np.concatenate([*(np.concatenate([p[1] for p in s_parts[::-1]]),)])


def _induce_ranges(text, zone, low, l_parts, seeds, up: bool):
    """One induction pass over ranges of characters.

    Upwards it gives the L-type suffixes of each range; downwards, from those, all suffixes of each
    range, ascending. Suffixes of a range whose successors lie in the same range wait for each other:
    they are ordered again until nothing changes, once more than the longest chain of such waits.
    """
    zones, n = len(low) - 1, len(text)
    queue, rank, out = DiskQueue(zones, 2), 0, []
    sign = 1 if up else -1
    seed_zone = zone[text[seeds]] if up else None
    for z in range(zones) if up else range(zones - 1, -1, -1):
        got = queue.pop(z)
        given = seeds[np.searchsorted(seed_zone, z):np.searchsorted(seed_zone, z, "right")] if up else l_parts[z][1][::-1]
        given_at = np.arange(len(given))
        pos, wait, key = [got[:, 0], given], [np.full(len(got), -1), np.full(len(given), -1)], [got[:, 1], given_at]
        fresh, base = np.concatenate([got[:, 0], given]), 0
        own = np.concatenate([np.ones(len(got), bool), np.zeros(len(given), bool)])
        owned = [own]
        while len(fresh):
            prev = fresh - 1
            ok = prev >= 0
            c, p = text[fresh], text[np.maximum(prev, 0)]
            # same type as the pass: after an induced suffix equality goes on, after a given one it must be strict
            ok &= np.where(own, sign * p >= sign * c, sign * p > sign * c) & (zone[p] == z)
            here = np.flatnonzero(ok)
            pos.append(prev[here])
            wait.append(base + here)
            key.append(np.zeros(len(here), np.int64))
            owned.append(np.ones(len(here), bool))
            base += len(fresh)
            fresh, own = prev[here], owned[-1]
        pos, wait, key, owned = map(np.concatenate, (pos, wait, key, owned))
        if not len(pos):
            out.append((z, pos[:0].astype(np.int64)))
            continue
        head = sign * text[pos].astype(np.int64) * 2 + ~owned          # in the order of the pass, induced before given
        waits = wait >= 0
        key = key.astype(np.int64)
        big = int(key.max()) + 1
        est = None
        while True:
            k = key if est is None else np.where(waits, big + est[np.maximum(wait, 0)], key)
            if est is None:
                k = np.where(waits, big, key)
            order = np.lexsort((k, head))
            h, kk = head[order], k[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (kk[1:] != kk[:-1])
            now = np.empty(len(h), np.int64)
            now[order] = np.cumsum(new) - 1
            if est is not None and (now == est).all():
                break
            est = now
        pos, owned = pos[order], owned[order]
        ranks = rank + np.arange(len(pos))
        rank += len(pos)
        prev = pos - 1
        c, p = text[pos], text[np.maximum(prev, 0)]
        go = (prev >= 0) & np.where(owned, sign * p >= sign * c, sign * p > sign * c) & (zone[p] != z)
        queue.push(zone[p[go]], np.stack([prev[go], ranks[go]], axis=1))
        if up:
            out.append((z, pos[owned]))
        else:
            out.append((z, pos[::-1]))
    queue.close()
    if not up:                      # the last position has no successor, so no pass induces it
        z, p = out[-1]
        if n - 1 not in p[:1]:
            out[-1] = (z, np.concatenate([[n - 1], p]))
    return out


def _common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefix lengths of pairs of suffixes, compared directly, up to CAP."""
    n, out, live = len(text), np.zeros(len(a), np.int64), np.arange(len(a))
    for k in range(CAP):
        if not len(live):
            break
        i, j = a[live] + k, b[live] + k
        same = (i < n) & (j < n)
        same &= text[np.minimum(i, n - 1)] == text[np.minimum(j, n - 1)]
        live = live[same]
        out[live] += 1
    return out


def descending(text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes of a byte text in descending order, in arrays (positions, common prefix with the one before).

    The last character must be 0 and occur nowhere else.
    """
    n, sigma = len(text), int(text.max()) + 1
    is_s = s_types(text)
    starts = leftmost_s(is_s)
    seeds = sort_leftmost_s(text, is_s, starts) if len(starts) else np.array([n - 1])
    seed_lcp = np.zeros(len(seeds), np.int64)
    seed_lcp[1:] = _common_prefix(text, seeds[:-1], seeds[1:])
    bounds = np.searchsorted(text[seeds], np.arange(sigma + 1))

    queue, settled, rank = DiskQueue(sigma, 2), np.zeros(n + 1, np.uint8), 0
    l_part: list[tuple[np.ndarray, np.ndarray]] = []

    def induced(rows, before):
        """Common prefixes of a bucket's next suffixes; ``before`` is the successor rank of the last one, or -1."""
        r = rows[:, 1]
        if before < 0:
            least = np.minimum.reduceat(settled[:r[-1] + 1], np.append(r[0], r[:-1] + 1)) if len(r) > 1 else np.zeros(1, np.uint8)
            out = np.minimum(least.astype(np.int64) + 1, CAP)
            out[0] = 0
            return out
        return np.minimum(np.minimum.reduceat(settled[:r[-1] + 1], np.append(before + 1, r[:-1] + 1)).astype(np.int64) + 1, CAP)

    def take(pos, lcp):
        nonlocal rank
        ranks = np.arange(rank, rank + len(pos))
        settled[rank:rank + len(pos)] = lcp
        rank += len(pos)
        return ranks

    for c in range(sigma):
        positions, lcps, before = [], [], -1
        while len(rows := queue.pop(c)):
            pos, lcp = rows[:, 0], induced(rows, before)
            before = int(rows[-1, 1])
            ranks = take(pos, lcp)
            positions.append(pos)
            lcps.append(lcp)
            prev = text[np.maximum(pos - 1, 0)]
            go = (pos > 0) & (prev >= c)
            queue.push(prev[go].astype(np.int64), np.stack([pos[go] - 1, ranks[go]], axis=1))
        own = np.concatenate(positions) if positions else np.zeros(0, np.int64)
        l_part.append((own, np.concatenate(lcps) if lcps else own))
        s = seeds[bounds[c]:bounds[c + 1]]
        if len(s):
            lcp = seed_lcp[bounds[c]:bounds[c + 1]].copy()
            lcp[0] = _common_prefix(text, own[-1:], s[:1])[0] if len(own) else 0
            ranks = take(s, lcp)
            go = s > 0
            prev = text[np.maximum(s - 1, 0)]
            go &= prev > c
            queue.push(prev[go].astype(np.int64), np.stack([s[go] - 1, ranks[go]], axis=1))
    queue.close()

    queue, rank = DiskQueue(sigma, 2), 0
    for c in range(sigma - 1, -1, -1):
        before, last = -1, None
        while len(rows := queue.pop(c)):
            pos, lcp = rows[:, 0], induced(rows, before)
            before, last = int(rows[-1, 1]), int(pos[-1])
            ranks = take(pos, lcp)
            yield pos, lcp
            prev = text[np.maximum(pos - 1, 0)]
            go = (pos > 0) & (prev <= c)
            queue.push(prev[go].astype(np.int64), np.stack([pos[go] - 1, ranks[go]], axis=1))
        own, up = l_part[c]
        l_part[c] = (own[:0], up[:0])
        if len(own):
            pos = own[::-1]
            lcp = np.append(0 if last is None else _common_prefix(text, np.array([last]), pos[:1])[0], up[:0:-1])
            ranks = take(pos, lcp)
            yield pos, lcp
            prev = text[np.maximum(pos - 1, 0)]
            go = (pos > 0) & (prev < c)
            queue.push(prev[go].astype(np.int64), np.stack([pos[go] - 1, ranks[go]], axis=1))
    yield np.array([n - 1]), np.array([0])
    queue.close()
