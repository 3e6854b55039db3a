"""Token counts under a unigram vocabulary, by dynamic programming shared in a trie.

Distinct pre-tokens form a trie whose nodes stand for prefixes. A node keeps the best score of any
segmentation of its prefix and that segmentation's number of tokens, both computed once from its
ancestors, however many pre-tokens share the prefix. Inserting the pre-tokens in sorted order visits
the trie depth first, so only the path to the current node is held. The count at a pre-token's last node
is stored under the pre-token and looked up from then on.

Vocabulary: the pieces of a sentencepiece model with their rank in it. A file of
merges has no probabilities, so a piece of rank r scores log(1 / (r + 1)) less the log of the
sum of all (Zipf's law). Pre-tokens are runs of characters other than ASCII white space, with the
word-begin mark U+2581 before each. A character that no piece has counts as its UTF-8 bytes,
each a token with the score ``BYTE_SCORE``. Of equal scores the segmentation with fewer tokens wins.

A worker stores terminal counts of recent pre-tokens only (``STORED`` at most, in two generations); this changes the time,
never the counts. No shuffle: a task needs nothing from other tasks.

Null or empty text: no pre-tokens, no tokens. Repeated rows are counted each.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tidewater.llm import _bytes as B
from tidewater.llm._frames import docs
from tidewater.llm.byte_bpe import texts

STORED = 250_000
BYTE_SCORE = -25.0
MARK = "▁"
find_words = re.compile(r"[^ \t\n\r\x0b\x0c]+").findall


def scores(model_path: str) -> dict[str, float]:
    """Score of each ordinary piece, by rank."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(pieces)))) if pieces else 0.0
    return {p: -math.log(r + 1) - total for r, p in enumerate(pieces)}


class Trie:
    """Token counts of pre-tokens; ``path`` holds the nodes from the root to the one inserted last."""

    def __init__(self, score: dict[str, float], stored: int = STORED):
        self.score, self.most = score, stored
        lens: dict[str, set[int]] = {}
        for p in score:
            lens.setdefault(p[-1], set()).add(len(p))
        #: Lengths of the pieces that end in a character.
        self.lens = {c: sorted(n) for c, n in lens.items()}
        self.word = ""
        self.best, self.count = [0.0], [0]
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.nodes = 0

    def counts(self, words: set[str]) -> dict[str, int]:
        """At least the given pre-tokens' counts."""
        if len(self.new) + len(words) > self.most:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        missing = []
        for w in words:
            if w not in new:
                if w in old:
                    new[w] = old[w]
                else:
                    missing.append(w)
        for w in sorted(missing):
            new[w] = self.insert(w)
        return new

    def insert(self, word: str) -> int:
        """Number of tokens of the best segmentation of the mark and ``word``."""
        s, last = MARK + word, self.word
        best, count, score, lens = self.best, self.count, self.score, self.lens
        end = 0
        for a, b in zip(s, last):
            if a != b:
                break
            end += 1
        del best[end + 1 :], count[end + 1 :]
        self.nodes += len(s) - end
        for end in range(end + 1, len(s) + 1):
            c = s[end - 1]
            top, n = -math.inf, 0
            for size in lens.get(c, ()):
                if size > end:
                    break
                x = score.get(s[end - size : end])
                if x is not None:
                    v, k = best[end - size] + x, count[end - size] + 1
                    if v > top or v == top and k < n:
                        top, n = v, k
            raw = 1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))
            v = best[end - 1] + raw * BYTE_SCORE
            if v > top:
                top, n = v, count[end - 1] + raw
            best.append(top)
            count.append(n)
        self.word = s
        return count[-1]


@lru_cache(maxsize=2)
def trie_of(model_path: str) -> Trie:
    return Trie(scores(model_path))


def token_counts(df: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pretokens, n_distinct, n_tokens of every whole text."""

    def run(batches):
        trie = trie_of(model_path)
        for batch in batches:
            for ids, run_ in texts(batch):
                found = [find_words(t) for t in run_]
                known = trie.counts(set().union(*found))
                rows = [(len(ws), len(set(ws)), sum(map(known.__getitem__, ws))) for ws in found]
                cols = [pa.array(c, pa.int64()) for c in (ids, *zip(*rows))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_pretokens", "n_distinct", "n_tokens"])

    return docs(df).mapInArrow(B.trimmed(run), "doc_id long, n_pretokens long, n_distinct long, n_tokens long")
