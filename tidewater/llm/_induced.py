"""External induced suffix sorting with common-prefix values (after eSAIS, Bingmann, Fischer and Osipov 2013).

Suffixes are sorted to a depth of ``cap`` characters; what is equal so far stays in any order, and common-prefix
values stop at ``cap``. One level of the recursion:

1. Every position is S (its suffix is smaller than the next one) or L. Leftmost S positions are S*.
2. Inducing from S* positions in any order within their first character sorts S* substrings, which get names.
3. The string of names is sorted. Recursion would do the same to it; its alphabet is too large for queues
   by character, so its order is made by doubling: ranks of 1, 2, 4, ... names in a row until they tell all apart or cover ``cap`` characters.
4. Inducing from sorted S* positions sorts all L, then all S suffixes, in scans over the characters. Each
   suffix is taken from a queue as a tuple (position, common prefix with the one before it); its predecessor in the text goes to the
   queue of its own first character, with one more than the least common prefix since that queue's last entry.

The queues are priority queues by first character, which stay in the order of insertion inside a character: inducing inserts in
sorted order, so nothing within a character needs sorting. They keep at most ``memory`` bytes and append the rest to an unnamed
temporary file, which is gone when the task ends.
"""

from __future__ import annotations

import tempfile

import numpy as np

SENTINEL, SEPARATOR, FIRST = 0, 1, 2
SIGMA = 256 + FIRST
NONE = (np.zeros(0, np.int64), np.zeros(0, np.int16))
#: What a queue keeps in memory: a shard of ordinary size has several times as much, which goes to disk.
QUEUE_BYTES = 2 << 20


class Queue:
    """Tuples (position, common prefix) by first character, on disk beyond ``memory`` bytes."""

    def __init__(self, memory: int = QUEUE_BYTES):
        self.chunks: list[list] = [[] for _ in range(SIGMA)]
        self.held, self.memory, self.file = 0, memory, None

    def push(self, c: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.chunks[c].append((pos, lcp))
        self.held += pos.nbytes + lcp.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for held in self.chunks:
            for i, chunk in enumerate(held):
                if len(chunk) == 2:
                    at = self.file.tell()
                    self.file.write(chunk[0].tobytes())
                    self.file.write(chunk[1].tobytes())
                    held[i] = (at, len(chunk[0]), None)
        self.held = 0

    def pop(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        out, self.chunks[c] = self.chunks[c], []
        got = []
        for chunk in out:
            if len(chunk) == 2:
                self.held -= chunk[0].nbytes + chunk[1].nbytes
                got.append(chunk)
            else:
                self.file.seek(chunk[0])
                pos = np.frombuffer(self.file.read(8 * chunk[1]), np.int64)
                got.append((pos, np.frombuffer(self.file.read(2 * chunk[1]), np.int16)))
        if not got:
            return NONE
        return got[0] if len(got) == 1 else (np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))


def s_types(t: np.ndarray) -> np.ndarray:
    """Whether each position is S; the last one, which holds the only sentinel, is."""
    n = len(t)
    change = np.flatnonzero(t[:-1] != t[1:])
    rises = t[change] < t[change + 1]
    nxt = np.searchsorted(change, np.arange(n - 1))
    out = np.ones(n, bool)
    out[:-1] = rises[np.minimum(nxt, len(change) - 1)] if len(change) else False
    return out


def range_minima(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(v[lo:hi + 1]) for each pair, by a table of minima over powers of two."""
    out = np.empty(len(lo), v.dtype)
    level = np.log2(hi - lo + 1 + 0.5).astype(np.int64)
    row, top = v, int(level.max()) if len(level) else 0
    for k in range(top + 1):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << k) + 1])
        if k < top:
            row = np.minimum(row[: -(1 << k)], row[1 << k :])
    return out


class _Scan:
    """Takes suffixes in order and gives their predecessors of the wanted type to the queue."""

    def __init__(self, t: np.ndarray, wanted: np.ndarray, queue: Queue, cap: int, lcps: bool):
        self.t, self.wanted, self.queue, self.cap, self.lcps = t, wanted, queue, cap, lcps
        self.least = np.full(SIGMA, cap, np.int16)  # least common prefix since the character's last entry
        self.begun = np.zeros(SIGMA, bool)

    def __call__(self, pos: np.ndarray, lcp: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
        """What goes to ``c`` itself comes back, the rest goes to the queue."""
        before = pos - 1
        k = np.flatnonzero(pos > 0)
        k = k[self.wanted[before[k]]]
        ch = self.t[before[k]]
        o = np.argsort(ch, kind="stable")
        k, ch = k[o], ch[o]
        first = np.flatnonzero(np.r_[True, ch[1:] != ch[:-1]][: len(ch)])
        if self.lcps:
            lo = np.r_[0, k[:-1] + 1][: len(k)]
            lo[first] = 0
            low = range_minima(lcp, lo, k)
            if len(first):
                own = ch[first]
                low[first] = np.where(self.begun[own], np.minimum(low[first], self.least[own]), -1)
            low = np.minimum(low + 1, self.cap).astype(np.int16)
            self.least = np.minimum(self.least, lcp.min()) if len(lcp) else self.least
            last = np.r_[first[1:], len(k)] - 1
            if len(first):
                self.begun[own] = True
                # After its last entry only what is scanned later counts.
                tail = np.full(len(own), self.cap, np.int16)
                rest = k[last] + 1 < len(lcp)
                if rest.any():
                    suffix = np.minimum.accumulate(lcp[::-1])[::-1]
                    tail[rest] = suffix[k[last][rest] + 1]
                self.least[own] = tail
        else:
            low = np.zeros(len(k), np.int16)
        same = NONE
        ends = np.r_[first[1:], len(k)]
        for a, b in zip(first.tolist(), ends.tolist()):
            x = int(ch[a])
            if x == c:
                same = (before[k[a:b]], low[a:b])
            else:
                self.queue.push(x, before[k[a:b]], low[a:b])
        return same


def common_prefix(t: np.ndarray, p: np.ndarray, q: np.ndarray, begin: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of the suffixes at p and q, which agree in ``begin`` characters; ``cap`` at most. ``t`` has room behind."""
    out = np.minimum(begin, cap).astype(np.int64)
    live = np.flatnonzero(out < cap)
    while len(live):
        same = t[p[live] + out[live]] == t[q[live] + out[live]]
        live = live[same]
        out[live] += 1
        live = live[out[live] < cap]
    return out


def induce(t: np.ndarray, is_s: np.ndarray, star: np.ndarray, star_lcp: np.ndarray | None, cap: int, room: np.ndarray, memory: int):
    """Scans from S* positions (by first character; sorted if ``star_lcp`` is given).

    With ``star_lcp``: the positions that share ``cap`` characters with a neighbour. Without: S* positions by substring.
    """
    lcps = star_lcp is not None
    bounds = np.searchsorted(t[star], np.arange(SIGMA + 1))
    lists: list = [NONE] * SIGMA
    scan = _Scan(t, ~is_s, Queue(memory), cap, lcps)
    zero = np.zeros(1, np.int64)

    def seam(p, q) -> int:
        return int(common_prefix(room, np.array([p]), np.array([q]), zero, cap)[0]) if lcps else 0

    for c in range(SIGMA):
        cur, done = scan.queue.pop(c), []
        while len(cur[0]):
            done.append(cur)
            cur = scan(*cur, c)
        if done:
            lists[c] = (np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done]))
        a, b = bounds[c], bounds[c + 1]
        if b > a:
            lcp = star_lcp[a:b].copy() if lcps else np.zeros(b - a, np.int16)
            lcp[0] = seam(lists[c][0][-1], star[a]) if len(lists[c][0]) else 0
            scan(star[a:b], lcp, c)
    scan = _Scan(t, is_s, Queue(memory), cap, lcps)
    marked, by_substring = [], []
    is_star = np.zeros(len(t), bool)
    is_star[star] = True
    for c in range(SIGMA - 1, -1, -1):
        cur, last = scan.queue.pop(c), None
        prior = np.zeros(0, np.int64)
        while len(cur[0]):
            pos, lcp = cur
            if lcps:
                hit = np.flatnonzero(lcp >= cap)
                marked += [pos[hit], np.r_[prior, pos][hit - 1 + len(prior)] if len(prior) else pos[hit[hit > 0] - 1]]
            else:
                by_substring.append(pos[is_star[pos]])
            prior = last = pos[-1:]
            cur = scan(pos, lcp, c)
        pos, up = lists[c]
        if len(pos):
            down = np.r_[up[1:], np.int16(seam(pos[-1], last[0]) if last is not None else 0)].astype(np.int16)[::-1]
            if lcps:
                hit = np.flatnonzero(up >= cap)
                marked += [pos[hit], pos[hit[hit > 0] - 1]]
                if last is not None and down[0] >= cap:
                    marked += [pos[-1:], last]
            scan(pos[::-1], down, c)
    if lcps:
        return np.concatenate(marked) if marked else np.zeros(0, np.int64)
    by_substring.append(np.array([len(t) - 1]))  # the sentinel
    return np.concatenate(by_substring)[::-1]


def _names(t: np.ndarray, star: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Names of S* substrings (each with the next one's first character), in the order of the text."""
    from tidewater.llm import _bytes as B

    U = np.uint64
    n = len(t)
    pow_ = B.powers(n + 1)
    inv = B.powers(n + 1, pow(B.BASE, -1, 2**64))
    table = np.concatenate((B.BYTE_1, B.BYTE_2[:FIRST]))
    c = np.concatenate((np.zeros(1, U), np.cumsum(table[t] * pow_[:n])))
    end = np.minimum(np.r_[star[1:], n - 1] + 1, n)
    h = (c[end] - c[star]) * inv[star]
    place = np.empty(n, np.int64)
    place[star] = np.arange(len(star))
    o = place[ordered]
    size = (end - star)[o]
    h = h[o]
    new = np.r_[True, (h[1:] != h[:-1]) | (size[1:] != size[:-1])]
    out = np.empty(len(star), np.int64)
    out[o] = np.cumsum(new) - 1
    return out


def repeated(text: list[np.ndarray], length: int, memory: int = QUEUE_BYTES) -> np.ndarray:
    """Positions, in the texts laid end to end with one place between, of strings of ``length`` bytes that start at another position too."""
    parts = []
    for x in text:
        parts += [x.astype(np.uint16) + FIRST, np.array([SEPARATOR], np.uint16)]
    parts.append(np.array([SENTINEL], np.uint16))
    t = np.concatenate(parts)
    room = np.concatenate((t, np.zeros(length + 8, np.uint16)))
    is_s = s_types(t)
    star = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    loose = star[np.argsort(t[star], kind="stable")]
    r = _names(t, star, induce(t, is_s, loose, None, length, room, memory))
    # Ranks of 1, 2, 4, ... names in a row; S* positions are at least two characters apart.
    levels, step, m = [r], 1, len(r)
    while r.max() + 1 < m and 2 * step < length + 2:
        nxt = np.full(m, -1, np.int64)
        nxt[: m - step] = r[step:]
        key = r * (m + 1) + nxt + 1
        _, r = np.unique(key, return_inverse=True)
        levels.append(r)
        step *= 2
    order = np.argsort(r, kind="stable")
    # Names that neighbours share, from the longest runs down; then the characters of the first name that differs.
    i, j = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        fit = np.flatnonzero((i < m) & (j < m))
        same = fit[levels[k][i[fit]] == levels[k][j[fit]]]
        i[same] += 1 << k
        j[same] += 1 << k
    shared = np.r_[star, len(t)][np.minimum(i, m)] - star[order[:-1]]
    lcp = np.zeros(m, np.int16)
    lcp[1:] = common_prefix(room, star[order[1:]], star[order[:-1]], shared, length)
    got = np.unique(induce(t, is_s, star[order], lcp, length, room, memory))
    # A string that would run past its text's end is none.
    ends = np.cumsum([len(x) + 1 for x in text]) - 1
    return got[got + length <= ends[np.minimum(np.searchsorted(ends, got), len(ends) - 1)]] if len(got) else got
