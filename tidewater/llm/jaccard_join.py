"""Exact n-gram Jaccard join by T-occurrence search (DivideSkip), and its connected components.

Link: two documents whose sets of word shingles have 100 * intersection >= percent * union.

1. A worker turns whole texts into sets of 64-bit shingle hashes (``k`` words each; a text with fewer words is one shingle of all
   its words; A-Z count as a-z). Documents with equal sets form a class; a class is a node, named by a 64-bit hash of its set.
2. Which classes can link at all? Linked sets x, y differ in at most d = (|x| + |y|)(100 - p) / (100 + p) shingles. If
   shingles are dealt into m > d parts by their hash, at least m - d parts are equal in both. A class emits a hash of
   each part, for the size group of its own and, near the group's upper end, of the next ones, so no linked pair is
   missed. Rows (part hash, class) are sorted by part hash and streamed; classes that are alone drop out, and groups with the same
   members, which near copies have by the dozen, leave once. Beyond ``PART_BYTES`` parts come in several goes, of which only one is on disk;
   a group whose members the first, small go has joined needn't be looked at, so most of a family's groups fall away.
3. Only then do the members of a group get their bitmaps, of one to two bits a shingle (4 KB at most), each the parity of the shingles that hash to
   it. Two sets differ in no fewer shingles than their bitmaps in bits, and that number of bits is a metric: of classes ordered by
   their distance from one of them, those before a gap of more than d bits can't link with those behind it. A group is split at such gaps, and pieces of up to
   ``GROUP`` classes by comparing bitmaps; each part leaves as a star, so edges grow with rows. Components of the stars are blocks: links
   never leave a block.
4. T-occurrence search inside a block, an inverted index from shingle to sets: a set needs partners that occur in at least T of its
   lists. DivideSkip sets the longest lists aside, merges the short ones with a heap, keeps sets that occur often enough there and probes the long lists
   for these by binary search. The index holds only leaders: a set that links with a leader follows it and isn't indexed, so a family of n
   mutual near copies costs n searches in short lists. Jaccard distance is a metric: a link between x and a follower y of L, which is no link between x and L, shows in a
   distance of x to L of at most y's plus 1 - p; T is set for that, and only such followers of another component are compared.
5. A block of more than ``BLOCK`` shingles is dealt into sub-blocks, each searched alone. Their leaders, with the distance of their farthest follower, then meet: leaders
   that link join their components; pairs of components that only followers could still join are searched once more, cluster against cluster.
6. Components of the links; a document's component is the smallest doc_id in it.

No set, block or component reaches the driver. Hash collisions (64 bits) could join unequal shingles with probability
about 1e-19 a pair.

Null or empty text: no shingles, no links. Rows that repeat a doc_id give a row each. A null doc_id is never a component's
name unless all of its members are null. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import _bytes as B
from tidewater.llm._frames import _sieved, docs, few_key, forget, let_go, meet_few, small, stored
from tidewater.llm._graph import Forest, components

U = np.uint64
#: Shingles of a unit of search; a larger block is dealt into sub-blocks.
BLOCK = 500_000
#: Shingles of the leaders that meet in one task.
MEET = 2_000_000
#: Bytes of part hashes, or of the sets of blocks, that are shuffled at once; more come in goes.
PART_BYTES, SET_BYTES = 32 << 20, 256 << 20
#: Lots of parts (of ``LOTS``) in each go.
LOTS = 16
GOES = [range(0, 1), range(1, 6), range(6, 11), range(11, 16)]
#: Goes over blocks whose sets are more than ``SET_BYTES``.
SET_GOES = 4
RATIO = 1.3
#: Up to so many classes of one group are compared bitmap by bitmap.
GROUP = 64
#: A larger group is split around so many classes; what is left then stays together.
CENTRES = 64
#: A group of more rows leaves before all of it was seen, without being compared to others.
LARGE = 100_000
BITS = 1 << 15
EPS = 1e-9
_SALT = [U(x) for x in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first position of each document's set and one past the last; distinct hashes, sorted within each document)."""
    n = len(offs) - 1
    low = B.LOWER[data]
    starts, ends, doc = B.words(low, offs)
    h = B.span_hash(low, starts, ends)
    count = np.bincount(doc, minlength=n)
    whole = []
    for r in range(1, k + 1):
        m = len(h) - r + 1
        if m <= 0:
            continue
        if r == k:
            at = np.flatnonzero(doc[:m] == doc[r - 1 :])
        else:
            first = np.concatenate(([0], np.cumsum(count)))[:-1]
            at = first[count == r]
        s = np.full(len(at), _SALT[0] + U(r))
        for j in range(r):
            s = B.mix(s * _SALT[1] + h[at + j])
        whole.append((doc[at], s))
    who = np.concatenate([w for w, _ in whole]) if whole else np.zeros(0, np.int64)
    val = np.concatenate([s for _, s in whole]) if whole else np.zeros(0, U)
    order = np.argsort(who, kind="stable")
    who, val = who[order], val[order]
    cut = np.concatenate(([0], np.cumsum(np.bincount(who, minlength=n)))).astype(np.int64)
    for a, b in zip(cut[:-1], cut[1:]):
        if b - a > 1:
            val[a:b].sort()
    new = np.ones(len(val), bool)
    new[1:] = (val[1:] != val[:-1]) | (who[1:] != who[:-1])
    return np.concatenate(([0], np.cumsum(np.bincount(who[new], minlength=n)))).astype(np.int64), val[new]


def set_names(first: np.ndarray, val: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set: a sum of mixed hashes, so it doesn't depend on an order; 0 for the empty set."""
    n = len(first) - 1
    out = np.zeros(n, U)
    some = first[1:] > first[:-1]
    if some.any():
        out[some] = B.mix(np.add.reduceat(B.mix(val ^ _SALT[2]), first[:-1][some]) + np.diff(first)[some].astype(U) * _SALT[3])
    return out


class Parts:
    """The size groups and numbers of parts for one threshold."""

    def __init__(self, percent: int):
        if not 0 < percent <= 100:
            raise ValueError("percent is over 0, 100 at most")
        self.p = percent
        self.bounds = [1]

    def grow(self, size: int) -> None:
        while self.bounds[-1] <= size:
            self.bounds.append(max(self.bounds[-1] + 1, int(self.bounds[-1] * RATIO)))

    def differ(self, group: int) -> int:
        """The most shingles in which a pair can differ whose larger set is in ``group``."""
        hi = self.bounds[group + 1] - 1
        return 2 * hi * (100 - self.p) // (100 + self.p)

    def number(self, group: int) -> int:
        d = self.differ(group)
        return d + 1 + d // 4

    def groups(self, size: int) -> list[int]:
        """Its own group and those of larger partners."""
        most = size * 100 // self.p
        self.grow(most + 1)
        own = int(np.searchsorted(self.bounds, size, "right")) - 1
        out = [own]
        while self.bounds[out[-1] + 1] <= most:
            out.append(out[-1] + 1)
        return out


def part_hashes(first: np.ndarray, val: np.ndarray, parts: Parts, lots: range = range(LOTS)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, part hash) rows, of the parts in these ``lots``.

    A pair has m - d equal parts or more. So a set with fewer than m - d parts of at most one shingle needn't emit those: some equal part is
    larger, and the other set emits it too. Else, with fewer than m - d empty parts, it needn't emit the empty ones. One shingle alone
    is shared by many documents that aren't alike.
    """
    sizes = np.diff(first)
    jobs: dict[int, list[int]] = {}
    for i in np.flatnonzero(sizes):
        for g in parts.groups(int(sizes[i])):
            jobs.setdefault(g, []).append(i)
    dealt, body = B.mix(val + _SALT[3]), B.mix(val ^ _SALT[4])
    for g, who in jobs.items():
        d, m = parts.differ(g), parts.number(g)
        if d == 0:
            continue  # only equal sets, which are one class
        who = np.array(who)
        n = sizes[who]
        f = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat(first[who] - f[:-1], n) + np.arange(f[-1])
        slot = np.repeat(np.arange(len(who)), n) * m + (dealt[at] % U(m)).astype(np.int64)
        held = np.bincount(slot, minlength=len(who) * m)
        # A part's lot depends on its number and its size group only, so equal parts have one lot.
        asked = np.isin((B.mix(np.arange(m).astype(U) + U(g * int(_SALT[1]) % 2**64)) % U(LOTS)).astype(np.int64), lots)
        own = np.tile(asked, len(who))
        total = np.zeros(len(who) * m, U)
        np.add.at(total, slot[own[slot]], body[at[own[slot]]])
        few = held.reshape(-1, m)
        least = np.where((few <= 1).sum(1) < m - d, 2, np.where((few == 0).sum(1) < m - d, 1, 0))
        out = np.flatnonzero(own & (held >= np.repeat(least, m)))
        sig = B.mix(total[out] + (out % m).astype(U) * _SALT[0] + held[out].astype(U) * _SALT[1] + U(g * int(_SALT[2]) % 2**64))
        yield who[out // m], sig


def unit_bits(bodies: list[np.ndarray]) -> np.ndarray:
    """A parity bitmap of each set, in a row of 64-bit words; all have the same length, about four bits a shingle of the largest."""
    words = 1 << int(np.clip(max(map(len, bodies), default=1) // 16, 1, 64) - 1).bit_length()
    out = np.empty((len(bodies), words), U)
    for i, x in enumerate(bodies):
        odd = np.bincount((x >> U(20) & U(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
        out[i] = np.packbits(odd.astype(np.uint8), bitorder="little").view(U)
    return out


def shared_only(bodies: list[np.ndarray]) -> list[list[int]]:
    """Each set's shingles that another one has too, as small numbers: no other can tell of anything in common."""
    ends = np.cumsum([0, *map(len, bodies)])
    _, own, times = np.unique(np.concatenate(bodies) if bodies else np.zeros(0, U), return_inverse=True, return_counts=True)
    keep = times[own] > 1
    return [own[a:b][keep[a:b]].tolist() for a, b in zip(ends, ends[1:])]


class Search:
    """T-occurrence search over the sets added so far."""

    #: Merging fewer entries than this is cheaper than looking at bitmaps.
    EASY = 2000

    def __init__(self, n: int, words: int):
        self.lists: dict[int, list[int]] = {}
        self.sizes = np.empty(n, np.int64)
        self.bits = np.empty((n, words), U)
        self.radius = np.zeros(n)
        self.n = 0

    def add(self, body: list[int], size: int, bits: np.ndarray, radius: float = 0.0) -> int:
        own, self.n = self.n, self.n + 1
        self.sizes[own], self.bits[own], self.radius[own] = size, bits, radius
        for s in body:
            self.lists.setdefault(s, []).append(own)
        return own

    def find(self, body: list[int], size: int, t: int, bits: np.ndarray, reach: float) -> list[tuple[int, int]]:
        """(set, shingles in common) by DivideSkip, for a set of ``size`` of which ``body`` may be in others: at least every set with ``t`` or more of it whose distance is ``reach`` and its radius at most."""
        lists = [found for s in body if (found := self.lists.get(s))]
        if len(lists) < t:
            return []
        lists.sort(key=len)
        aside = min(t - 1, int(t / (0.01 * np.log2(len(lists[-1])) + 1)))
        short, long_ = lists[: len(lists) - aside], lists[len(lists) - aside :]
        work = sum(map(len, short))
        left = None
        if work > self.EASY:
            # Bitmaps tell which sets can be near enough; if they are few, no list is short beside probing for these.
            far = np.minimum(reach + self.radius[: self.n], 1)
            most = (self.sizes[: self.n] + size) * far / (2 - far) + EPS
            left = np.flatnonzero(np.bitwise_count(self.bits[: self.n] ^ bits).sum(1) <= most)
            if len(left) * len(lists) < 2 * work:
                short, long_, aside = [], lists, t
        out = []
        if short:
            allowed = None if left is None else set(left.tolist())
            counted = ((own, sum(1 for _ in times)) for own, times in groupby(heapq.merge(*short)) if allowed is None or own in allowed)
        else:
            counted = ((own, 0) for own in left.tolist())
        for own, common in counted:
            if common < t - aside:
                continue
            for x in long_:
                at = bisect_left(x, own)
                common += at < len(x) and x[at] == own
            if common >= t:
                out.append((own, common))
        return out


def _far(common: int, a: int, b: int) -> float:
    return 1 - common / (a + b - common)


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum())


def _union() -> tuple:
    up: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x], x = root, p
        return root

    def join(x: int, y: int) -> bool:
        x, y = find(x), find(y)
        if x != y:
            up[max(x, y)] = min(x, y)
        return x != y

    return find, join


def limits(percent: int) -> tuple[float, float]:
    """The largest distance of a link, and how far from its leader a follower may be: so near that two links and two radii
    together stay below 1, where every pair in question shares a shingle."""
    tau = 1 - percent / 100
    return tau, min(tau, 0.45 * (1 - tau))


def cluster(bodies: list[np.ndarray], percent: int) -> tuple[list[tuple[int, int]], list[int], list[float]]:
    """(links that span the components of all links; each set's leader; its distance from it) for distinct sorted sets."""
    tau, rho = limits(percent)
    n, every, parts = len(bodies), unit_bits(bodies), shared_only(bodies)
    index, find, join = Search(n, every.shape[1]), *_union()
    links, lead, dist = [], [0] * n, [0.0] * n
    leaders: list[int] = []
    followers: list[list[int]] = []
    for i in sorted(range(n), key=lambda i: len(bodies[i])):
        body, a = parts[i], len(bodies[i])
        near, best = [], None
        for own, common in index.find(body, a, max(1, ceil((1 - tau - rho) * a - EPS)), every[i], tau):
            b = int(index.sizes[own])
            far = _far(common, a, b)
            if 100 * common >= percent * (a + b - common):
                if join(i, leaders[own]):
                    links.append((i, leaders[own]))
                if far <= rho + EPS and (best is None or far < best[0]):
                    best = (far, own)
            elif far <= tau + index.radius[own] + EPS:
                near.append((far, own))
        for far, own in sorted(near):
            if find(leaders[own]) == find(i):
                continue
            ring = [y for y in followers[own] if dist[y] >= far - tau - EPS]
            apart = np.bitwise_count(every[ring] ^ every[i]).sum(1) if ring else ()
            for y, bits in zip(ring, apart):
                if bits * (100 + percent) <= (a + len(bodies[y])) * (100 - percent):
                    common = _common(bodies[y], bodies[i])
                    if 100 * common >= percent * (a + len(bodies[y]) - common):
                        join(i, y)
                        links.append((i, y))
                        break
        if best:
            dist[i], own = best
            lead[i] = leaders[own]
            followers[own].append(i)
            index.radius[own] = max(index.radius[own], dist[i])
        else:
            lead[i] = i
            index.add(body, a, every[i])
            leaders.append(i)
            followers.append([])
    return links, lead, dist


def meet(bodies: list[np.ndarray], radius: list[float], group: list[int], part: list[int], percent: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Links between leaders of different parts (sub-blocks), and pairs whose followers alone could still join two components.

    ``group`` is each leader's component within its part. Pairs within a part are settled already.
    """
    tau, rho = limits(percent)
    n, every, parts = len(bodies), unit_bits(bodies), shared_only(bodies)
    index, find, join = Search(n, every.shape[1]), *_union()
    first: dict[int, int] = {}
    for i, g in enumerate(group):
        join(i, first.setdefault(g, i))
    links, open_, own_of = [], [], []
    for i in sorted(range(n), key=lambda i: len(bodies[i])):
        body, a = parts[i], len(bodies[i])
        for own, common in index.find(body, a, max(1, ceil((1 - tau - 2 * rho) * a - EPS)), every[i], tau + radius[i]):
            j, b = own_of[own], int(index.sizes[own])
            if part[i] == part[j]:
                continue
            if 100 * common >= percent * (a + b - common):
                if join(i, j):
                    links.append((i, j))
            elif _far(common, a, b) <= tau + radius[i] + radius[j] + EPS:
                open_.append((i, j))
        index.add(body, a, every[i], radius[i])
        own_of.append(i)
    return links, [(i, j) for i, j in open_ if find(i) != find(j)]


def first_link(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> tuple[int, int] | None:
    """A link between a set of ``left`` and one of ``right``, if there is one."""
    every, parts = unit_bits([*left, *right]), shared_only([*left, *right])
    index = Search(len(left), every.shape[1])
    for x, body, bits in zip(left, parts, every):
        index.add(body, len(x), bits)
    for j, y in enumerate(right):
        a = len(y)
        for own, common in index.find(parts[len(left) + j], a, max(1, ceil(percent * a / 100)), every[len(left) + j], 1 - percent / 100):
            if 100 * common >= percent * (a + int(index.sizes[own]) - common):
                return own, j
    return None


def link_block(first: np.ndarray, val: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) between sets that span the components of all links."""
    return cluster([np.sort(val[a:b]) for a, b in zip(first[:-1], first[1:])], percent)[0]


def _sets(batches, k: int):
    """(ids of rows, first, val) for runs of rows."""
    for batch in batches:
        for a, b, data, offs in B.text_pieces(batch):
            yield (batch, a, b, *shingle_sets(data, offs, k))


def bitmaps(first: np.ndarray, val: np.ndarray) -> list[bytes]:
    """The parity bitmap of each set: 2**k bits, 64 to ``BITS`` and if possible one a shingle; empty for the empty set."""
    h = B.mix(val ^ _SALT[0])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if a == b:
            out.append(b"")
            continue
        bits = min(BITS, max(64, 1 << int(b - a - 1).bit_length()))
        odd = np.bincount((h[a:b] & U(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
    return out


def folded(bits: list[bytes]) -> list[int]:
    """Bitmaps as integers of the shortest one's length: the halves of a longer one are laid over each other."""
    least = 8 * min(map(len, bits))
    out = []
    for x in bits:
        v, n = int.from_bytes(x, "little"), 8 * len(x)
        while n > least:
            n //= 2
            v = (v >> n) ^ (v & ((1 << n) - 1))
        out.append(v)
    return out


def split_group(sizes: list[int], bits: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Stars (i, j) that hold all together that might link, by bitmaps."""
    v = folded(bits)
    most = 2 * max(sizes) * (100 - percent) // (100 + percent)
    out: list[tuple[int, int]] = []

    def compare(own: list[int]) -> None:
        find, join = _union()
        for x in range(1, len(own)):
            for y in range(x):
                i, j = own[x], own[y]
                if (v[i] ^ v[j]).bit_count() * (100 + percent) <= (sizes[i] + sizes[j]) * (100 - percent):
                    join(x, y)
        out.extend((own[x], own[r]) for x in range(1, len(own)) if (r := find(x)) != x)

    todo, centres = [list(range(len(v)))], 0
    while todo:
        own = todo.pop()
        if len(own) <= GROUP:
            compare(own)
            continue
        if centres == CENTRES:
            out.extend((x, own[0]) for x in own[1:])
            continue
        centres += 1
        far = sorted(((v[x] ^ v[own[0]]).bit_count(), x) for x in own)
        cuts = [0, *(x for x in range(1, len(far)) if far[x][0] - far[x - 1][0] > most), len(far)]
        pieces = [[x for _, x in far[a:b]] for a, b in zip(cuts, cuts[1:])]
        if len(pieces[0]) > GROUP:  # around this centre nothing more can be told apart
            head = pieces.pop(0)
            out.extend((x, head[0]) for x in head[1:])
        todo.extend(pieces)
    return out


def shingled(df: DataFrame, k: int) -> DataFrame:
    """doc_id, th, n_shingles, node (null for the empty set), bits of every row of ``df`` (doc_id, text, th)."""

    def run(batches):
        for batch, a, b, first, val in _sets(batches, k):
            n = np.diff(first)
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(2)[a:b], pa.array(n, pa.int64()), pa.array(set_names(first, val).view(np.int64), pa.int64(), mask=n == 0), pa.array(bitmaps(first, val), pa.binary())], ["doc_id", "th", "n_shingles", "node", "bits"])

    return df.select("doc_id", "text", "th").mapInArrow(B.trimmed(run), "doc_id long, th long, n_shingles long, node long, bits binary")


def _shared(batches):
    """From (sig, node) rows sorted by both: (grp, node) of groups of several nodes; groups of equal nodes have one name and leave once a task."""
    out = pa.schema([("grp", pa.int64()), ("node", pa.int64())])
    seen: set[int] = set()
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    open_ = None  # a group that has begun to leave

    def name(sig):
        return int(B.mix(np.array([sig], np.int64).view(U) ^ _SALT[2]).view(np.int64)[0])

    def batch_of(grp, node):
        return pa.RecordBatch.from_arrays([pa.array(grp), pa.array(node)], schema=out)

    def whole(sig, node):
        start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        size = np.diff(np.r_[start, len(sig)])
        big = size > 1
        if not big.any():
            return None
        keep = np.repeat(big, size)
        node, size = node[keep], size[big]
        start = np.r_[0, np.cumsum(size)[:-1]]
        grp = B.mix(np.add.reduceat(B.mix(node.view(U)), start) + size.astype(U))
        fresh = np.array([not (g in seen or seen.add(g)) for g in grp.tolist()], bool)
        if len(seen) > 300_000:
            seen.clear()
        if not fresh.any():
            return None
        return batch_of(np.repeat(grp, size)[np.repeat(fresh, size)].view(np.int64), node[np.repeat(fresh, size)])

    for batch in batches:
        sig, node = (np.concatenate((h, np.asarray(batch.column(i)))) for i, h in enumerate(held))
        if not len(sig):
            continue
        new = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]
        sig, node = sig[new], node[new]
        if open_ is not None:
            end = int(np.searchsorted(sig, open_, "right"))
            if end:
                yield batch_of(np.full(end, name(open_)), node[:end])
            if end == len(sig):
                held = (sig[:0], node[:0])
                continue
            sig, node, open_ = sig[end:], node[end:], None
        cut = int(np.searchsorted(sig, sig[-1]))
        if cut and (got := whole(sig[:cut], node[:cut])) is not None:
            yield got
        sig, node = sig[cut:], node[cut:]
        if len(sig) > LARGE:
            open_ = int(sig[0])
            yield batch_of(np.full(len(sig), name(open_)), node)
            sig, node = sig[:0], node[:0]
        held = (sig, node)
    if len(held[0]) and (got := whole(*held)) is not None:
        yield got


def _split(percent: int):
    """From (grp, n, node, bits) rows sorted by grp: stars over what might link, merged within the task. A group of more than ``LARGE`` rows
    stays together."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        forest = Forest()
        rows, last, head = [], None, None

        def close():
            if len(rows) > 1:
                for i, j in split_group([r[1] for r in rows], [r[3] for r in rows], percent):
                    forest.union(rows[i][2], rows[j][2])
            if rows and head is not None:
                for r in rows:
                    forest.union(r[2], head)

        def leave():
            e = forest.stars()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in e], pa.int64()), pa.array([y for _, y in e], pa.int64())], schema=schema)

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if r[0] != last:
                    close()
                    rows, last, head = [], r[0], None
                rows.append(r)
                if len(rows) > LARGE:
                    head = rows[0][2] if head is None else head
                    for x in rows:
                        forest.union(x[2], head)
                    rows = []
                    if forest.full():
                        yield leave()
            if forest.full():
                yield leave()
        close()
        yield leave()

    return run


def blocks(df: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """node, root: the classes that might link with another, and their block; ``classes`` has node, n_shingles, bits."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Some 0.6 rows a shingle at 80 percent, fewer above.
    total = classes.agg(F.sum("n_shingles")).first()[0] or 0
    known, stars = None, []
    for lots in GOES if 10 * total > PART_BYTES else [range(LOTS)]:

        def emit(batches, lots=lots):
            parts, seen = Parts(percent), set()
            for _, _, _, first, val in _sets(batches, k):
                names = set_names(first, val)
                # A class is emitted once a task: a group of copies is thinned out before the shuffle.
                fresh = np.array([not (x in seen or seen.add(x)) for x in names.tolist()], bool)
                if len(seen) > 500_000:
                    seen.clear()
                keep = np.repeat(fresh, np.diff(first))
                f = np.concatenate(([0], np.cumsum(np.where(fresh, np.diff(first), 0))))
                for who, sig in part_hashes(f, val[keep], parts, lots):
                    yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(names[who].view(np.int64))], ["sig", "node"])

        rows = df.select("doc_id", "text").mapInArrow(B.trimmed(emit), "sig long, node long").repartition(n, "sig").sortWithinPartitions("sig", "node")
        shared = stored(rows.mapInArrow(B.trimmed(_shared), "grp long, node long"))
        let_go(spark)
        groups = shared.distinct() if known is None else _open_groups(shared.distinct(), known)
        sides = groups.join(classes.select("node", F.col("n_shingles").alias("n"), "bits"), "node").select("grp", "n", "node", "bits")
        stars.append(stored(sides.repartition(n, "grp").sortWithinPartitions("grp", "n", "node").mapInArrow(B.trimmed(_split(percent)), "a long, b long")))
        forget(shared)
        let_go(spark)
        if known is None:
            known = components(stars[0])
    if len(stars) == 1:
        return known
    return components(reduce(DataFrame.unionByName, stars))


def _open_groups(groups: DataFrame, known: DataFrame) -> DataFrame:
    """Those of ``groups`` (grp, node) whose members aren't all of one component yet, by ``known`` (node, root)."""
    rooted = groups.join(known, "node", "left").select("grp", F.coalesce("root", "node").alias("root"))
    still = rooted.groupBy("grp").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least != most").select("grp")
    return groups.join(still, "grp", "left_semi")


def bodies(df: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """The set (sorted 64-bit hashes) of each row of ``placed`` (node, rep_id, rep_th, other longs), from the text of its document; once for each node and task."""
    extra = [c for c in placed.columns if c not in ("node", "rep_id", "rep_th")]
    few = stored(placed.select(F.col("rep_id").alias("b_id"), F.col("rep_th").alias("b_th"), F.col("node").alias("own"), *[F.col(c).cast("long").alias(c) for c in extra]))
    text = meet_few(df.select("doc_id", "text", "th"), few, "inner").select("doc_id", "text", "own", *extra)

    def run(batches):
        seen = set()
        for batch, a, b, first, val in _sets(batches, k):
            raw = val.tobytes()
            body = pa.array([raw[8 * x : 8 * y] for x, y in zip(first[:-1].tolist(), first[1:].tolist())], pa.binary())
            own = batch.column(2)[a:b]
            fresh = pa.array([not (x in seen or seen.add(x)) for x in own.to_pylist()], pa.bool_())
            if len(seen) > 500_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([own, *(batch.column(i)[a:b] for i in range(3, batch.num_columns)), body], ["node", *extra, "body"]).filter(fresh)

    return text.mapInArrow(B.trimmed(run), ", ".join(["node long", *(f"{c} long" for c in extra), "body binary"]))


_FOUND = pa.schema([("kind", pa.int32()), ("root", pa.int64()), ("sub", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("dist", pa.float64()), ("body", pa.binary())])
_FOUND_DDL = "kind int, root long, sub long, a long, b long, dist double, body binary"


def _found(rows):
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _FOUND)], schema=_FOUND)


def _units(n_key: int, solve):
    """Runs ``solve`` over the rows of each unit: batches sorted by their first ``n_key`` columns."""

    def run(batches):
        rows, last = [], None
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if r[:n_key] != last:
                    if rows:
                        yield from solve(rows)
                    rows, last = [], r[:n_key]
                rows.append(r)
        if rows:
            yield from solve(rows)

    return run


def links(df: DataFrame, classes: DataFrame, block: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: links between classes, enough to span the components of all links; ``classes`` has node, rep_id, rep_th, n_shingles."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # One document stands for each class in a block; it carries its block and its sub-block.
    named = stored(block.join(classes, "node"))
    goes = SET_GOES if 8 * (named.agg(F.sum("n_shingles")).first()[0] or 0) > SET_BYTES else 1
    size = named.groupBy("root").agg(F.ceil(F.sum("n_shingles") / BLOCK).alias("subs"))
    placed = named.join(size, "root").select("node", "rep_id", "rep_th", "root", F.pmod(F.xxhash64("node"), "subs").alias("sub"), "subs")
    def search(rows):
        nodes: dict[int, bytes] = {}
        for r in rows:
            nodes.setdefault(r[3], r[4])
        names = list(nodes)
        found, lead, dist = cluster([np.frombuffer(x, U) for x in nodes.values()], percent)
        root, sub, subs = rows[0][:3]
        out = [(0, root, sub, names[i], names[j], 0.0, None) for i, j in found]
        if subs > 1:
            find, join = _union()
            for i, j in found:
                join(i, j)
            radius = [0.0] * len(names)
            for i, x in enumerate(lead):
                radius[x] = max(radius[x], dist[i])
                out.append((2, root, sub, names[i], names[x], dist[i], None))
            out += [(1, root, sub, names[i], names[find(i)], radius[i], nodes[names[i]]) for i, x in enumerate(lead) if x == i]
        if out:
            yield _found(out)

    got = None
    for go in range(goes):
        sets = bodies(df, placed.filter(F.pmod(F.xxhash64("root", "sub"), F.lit(goes)) == go), k).select("root", "sub", "subs", "node", "body")
        some = stored(sets.repartition(n, "root", "sub").sortWithinPartitions("root", "sub", "node").mapInArrow(B.trimmed(_units(2, search)), _FOUND_DDL))
        got = some if got is None else got.unionByName(some)
        let_go(df.sparkSession)
    sure = got.filter("kind = 0").select("a", "b")
    leaders = got.filter("kind = 1")
    if leaders.isEmpty():
        return sure

    # Leaders of one block meet in one task; more than MEET shingles of leaders are dealt again, and each pair of deals meets.
    deals = leaders.groupBy("root").agg(F.ceil(F.sum(F.length("body") / 8) / MEET).cast("int").alias("deals")).withColumnRenamed("root", "d_root")
    dealt = leaders.join(small(stored(deals)), F.col("root") == F.col("d_root")).withColumn("deal", F.pmod(F.xxhash64("a"), "deals").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).select("root", F.least("deal", "other").alias("s1"), F.greatest("deal", "other").alias("s2"), "sub", "a", "b", "dist", "body")

    def across(rows):
        found, open_ = meet([np.frombuffer(r[7], U) for r in rows], [r[6] for r in rows], [r[5] for r in rows], [r[3] for r in rows], percent)
        out = [(0, rows[0][0], 0, rows[i][4], rows[j][4], 0.0, None) for i, j in found] + [(3, rows[0][0], 0, rows[i][4], rows[j][4], 0.0, None) for i, j in open_]
        if out:
            yield _found(out)

    met = stored(dealt.repartition(n, "root", "s1", "s2").sortWithinPartitions("root", "s1", "s2", "a").mapInArrow(B.trimmed(_units(3, across)), _FOUND_DDL))
    sure = sure.unionByName(met.filter("kind = 0").select("a", "b"))
    open_ = met.filter("kind = 3").select(F.col("a").alias("x"), F.col("b").alias("y")).distinct()
    if open_.isEmpty():
        return sure

    # Cluster against cluster: each of the two leaders' sets and followers.
    pairs = open_.withColumn("pair", F.xxhash64("x", "y"))
    ends = pairs.select("pair", F.col("x").alias("lead"), F.lit(0).alias("side")).unionByName(pairs.select("pair", F.col("y").alias("lead"), F.lit(1).alias("side")))
    members = got.filter("kind = 2").select(F.col("a").alias("node"), F.col("b").alias("lead"))
    wanted = members.join(ends.select("lead").distinct(), "lead", "left_semi")
    body = bodies(df, placed.join(wanted, "node", "left_semi").select("node", "rep_id", "rep_th"), k)
    both = ends.join(members.join(body, "node"), "lead").select("pair", "side", "node", "body")

    def decide(rows):
        side = [{r[2]: r[3] for r in rows if r[1] == s} for s in (0, 1)]
        hit = first_link(*([np.frombuffer(x, U) for x in s.values()] for s in side), percent)
        if hit:
            yield _found([(0, 0, 0, list(side[0])[hit[0]], list(side[1])[hit[1]], 0.0, None)])

    late = both.repartition(n, "pair").sortWithinPartitions("pair", "side", "node").mapInArrow(B.trimmed(_units(1, decide)), _FOUND_DDL)
    return sure.unionByName(late.select("a", "b"))


def _fewer(df: DataFrame, own: DataFrame, classes: DataFrame) -> DataFrame:
    """``df`` without most of the rows that only repeat a class, where these are many: its parts needn't be shuffled once for each copy. A representative always stays."""
    if classes.count() > 0.75 * own.filter("node is not null").count():
        return df
    keys = classes.select(few_key("rep_id", "rep_th").alias("b_key"))
    return _sieved(df.withColumn("s_key", few_key("doc_id", "th")), "s_key", keys, "b_key")[0].drop("s_key")


def near_components(df: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, th (xxhash64 of the text), n_shingles, node, root (the component's name; node and root are null without shingles), component_id for every
    row of ``df`` (doc_id, text)."""
    d = docs(df).withColumn("th", F.xxhash64("text"))
    own = stored(shingled(d, k))
    rep = F.min(F.struct("doc_id", "th"))
    classes = own.filter("node is not null").groupBy("node").agg(rep.alias("rep"), F.min("doc_id").alias("least_id"), F.max("n_shingles").alias("n_shingles"), F.min("bits").alias("bits"))
    classes = stored(classes.select("node", F.col("rep.doc_id").alias("rep_id"), F.col("rep.th").alias("rep_th"), "least_id", "n_shingles", "bits"))
    block = blocks(_fewer(d, own, classes), classes, k, percent)
    found = components(links(d, classes.drop("bits", "least_id"), block, k, percent))
    named = found.withColumnRenamed("node", "member")
    grouped = classes.join(named, F.col("node") == F.col("member"), "left").select("node", F.coalesce("root", "node").alias("root"), "least_id")
    least = grouped.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_node = stored(grouped.join(least, "root").select("node", "root", "component_id"))
    return own.join(by_node, "node", "left").select("doc_id", "th", "n_shingles", "node", "root", F.coalesce("component_id", "doc_id").alias("component_id"))
