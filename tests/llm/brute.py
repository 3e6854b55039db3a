"""Plain versions of the operators, from their definitions; for small tables."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return WORD.findall(low(t))


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def shingles(t, k):
    w = words(t)
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def near(rows, k, percent):
    """Per row: (doc_id, n_shingles, component). Null ids never name a component."""
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    inv = defaultdict(list)
    for i in sorted(range(len(rows)), key=lambda i: len(sets[i])):
        c = Counter(j for s in sets[i] for j in inv[s])
        for j, n in c.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                up[find(i)] = find(j)
        for s in sets[i]:
            inv[s].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return [(d, len(sets[i]), least.get(find(i), d) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def repeats(rows, length):
    """Per row: (doc_id, n_bytes, n_removed, n_spans, sha of what is left)."""
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, raw):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone) if not g))))
    return out


def unigrams(rows, held):
    """Per row: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score)."""
    toks = [words(t) + [None] for _, t in rows]
    c = Counter(w for (d, _), ws in zip(rows, toks) if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(d, held(d), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for (d, _), ws in zip(rows, toks)]


def fold(d, k):
    return None if d is None else zlib.crc32(str(d).encode()) % k


def measures(t):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = t or ""
    w = WORD.findall(t)
    g = Counter(zip(w, w[1:], w[2:]))
    covered = {p for i in range(len(w) - 2) if g[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(covered)


def leaks(docs, items, window=20, percent=80):
    """{(doc_id, item_id): best similarity}"""
    out = {}
    its = [(i, words(t)) for i, t in items]
    for d, t in docs:
        w = words(t)
        for i, x in its:
            if not x:
                continue
            k = min(window, len(x))
            for diag in range(1 - len(x), len(w)):
                same = [0 <= diag + j < len(w) and w[diag + j] == x[j] for j in range(len(x))]
                best = max(sum(same[s : s + k]) for s in range(len(x) - k + 1))
                if 100 * best >= percent * k:
                    out[(d, i)] = max(out.get((d, i), 0), best / k)
    return out


def line_key(line):
    return low(line.strip(" \t\n\x0b\x0c\r"))


def drop_lines(rows, min_docs=10):
    """Per row: (doc_id, n_lines, n_dropped, kept text). Rows that agree in id and text are one document."""
    docs = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            docs[line_key(x)].add((d, t or ""))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (line_key(x) and len(docs[line_key(x)]) >= min_docs)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
