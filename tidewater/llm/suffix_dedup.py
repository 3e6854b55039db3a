"""Removal of every byte that a repeated string of ``length`` bytes covers, by suffix sorting of shards.

A string is repeated if it starts at two or more positions of the input, in the same document or another. What is removed is
judged on the input. Matches never cross documents.

1. Each window of ``length`` bytes has an anchor: the leftmost of its inner strings of ``GRAM`` bytes with the least hash. Equal windows
   have equal anchors, so only windows with one anchor hash need comparing. Consecutive windows with the same anchor form a piece.
   A worker emits for each piece its anchor hash and a 128-bit hash of its bytes, never the bytes; pieces that repeat within
   its run of texts (periodic texts have very many) leave once, with spans for what they cover.
2. Rows sorted by (anchor, piece hash) are streamed in constant memory. A piece that occurs twice is removed whole. An anchor with one piece
   is unique. Only anchors with several different pieces (at the edges of copies) go on: one text for each different piece.
3. These texts are sent to shards by anchor. A shard's suffixes are sorted by external induced sorting with common-prefix
   values (``_induced``); windows that share ``length`` bytes with a neighbour are repeated.
4. Spans are joined to the documents and cut out.

Steps 1 and 2 keep the suffix sort, which costs tens of bytes for each byte it sorts, to the small part of the text that needs it;
anchors make shards independent, so their number grows with the input and none needs another's suffixes.

A document is a (doc_id, text). Rows that repeat both are two positions for each string, so both lose it. Null text is empty. A
document shorter than ``length`` loses nothing. The result has a row for each input row, none for an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import _bytes as B
from tidewater.llm._frames import docs, meet_few, stored
from tidewater.llm._induced import repeated

U = np.uint64
GRAM = 64
SHARD_BYTES = 900_000
STARTS = 500_000
_INV = pow(B.BASE, -1, 2**64)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of data[i:i + gram] for each i, by doubling."""
    total, size, h, done = None, 0, B.BYTE_1[data], 1
    rest = gram
    while rest:
        if rest & 1:
            if total is None:
                total, size = h, done
            else:
                n = len(h) - size
                total = total[:n] * U(pow(B.BASE, done, 2**64)) + h[size:]
                size += done
        rest >>= 1
        if rest:
            h = h[:-done] * U(pow(B.BASE, done, 2**64)) + h[done:] if len(h) > done else h[:0]
            done *= 2
    return B.mix(total)


def sliding_least(key: np.ndarray, w: int) -> np.ndarray:
    """min(key[i:i + w]) for each i."""
    n = len(key)
    if n < w:
        return key[:0]
    pad = -n % w
    rows = np.concatenate((key, np.full(pad, np.iinfo(U).max, U))).reshape(-1, w)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - w + 1], head[w - 1 : n])


def pieces(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, anchor hash, two piece hashes, first start, last start) of every piece; starts count from the document's first byte."""
    gram = min(GRAM, max(1, length // 4))
    n = len(data)
    size = np.diff(offs)
    if n < length or not (size >= length).any():
        z = np.zeros(0, np.int64)
        return z, z.view(U), z.view(U), z.view(U), z, z
    h = gram_hashes(data, gram)
    low = U((1 << max(1, int(len(h) - 1).bit_length())) - 1)
    at = (sliding_least((h & ~low) | np.arange(len(h), dtype=U), length - gram + 1) & low).astype(np.int64)
    end = np.repeat(offs[1:], size)[: len(at)]
    starts = np.flatnonzero(np.arange(len(at)) + length <= end)
    who, end = at[starts], end[starts]
    new = np.r_[True, (who[1:] != who[:-1]) | (end[1:] != end[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(starts)] - 1
    a, b = starts[first], starts[last]
    inv = B.powers(n + 1, _INV)[a]
    hashes = []
    for table in (B.BYTE_1, B.BYTE_2):
        c = np.concatenate((np.zeros(1, U), np.cumsum(table[data] * B.powers(n))))
        hashes.append(B.mix((c[b + length] - c[a]) * inv))
    doc = np.searchsorted(offs, a, "right") - 1
    return doc, h[who[first]], hashes[0], hashes[1], a - offs[doc], b - offs[doc]


def _long_pieces(data: np.ndarray, offs: np.ndarray, length: int):
    """``pieces``, a long single document in parts of ``STARTS`` starts; a piece cut in two is two pieces with one anchor."""
    if len(offs) > 2 or len(data) <= STARTS + length:
        yield pieces(data, offs, length)
        return
    for x in range(0, len(data) - length + 1, STARTS):
        part = data[x : x + STARTS + length - 1]
        doc, anchor, v1, v2, a, b = pieces(part, np.array([0, len(part)]), length)
        yield doc, anchor, v1, v2, a + x, b + x


def _thinned(doc, anchor, v1, v2, a, b):
    """Pieces with what repeats inside this run of texts pre-aggregated: one row for each such piece, marked sure, and
    one row without hashes for each stretch of them in a document."""
    if not len(doc):
        return doc, anchor, v1, v2, a, b, np.zeros(0, bool)
    _, first, inverse, count = np.unique(v1 ^ B.mix(v2), return_index=True, return_inverse=True, return_counts=True)
    many = count[inverse] > 1
    one = np.zeros(len(doc), bool)
    one[first] = True
    # Pieces are in order of document and place; a stretch goes on where the next piece starts right behind.
    at = np.flatnonzero(many)
    new = np.r_[True, (doc[at[1:]] != doc[at[:-1]]) | (a[at[1:]] > b[at[:-1]] + 1)][: len(at)]
    begin = np.flatnonzero(new)
    end = np.r_[begin[1:], len(at)][: len(begin)] - 1
    z = np.zeros(len(begin), U)
    keep = np.flatnonzero(~many | one)
    return tuple(np.concatenate(x) for x in ((doc[keep], doc[at[begin]]), (anchor[keep], z), (v1[keep], z), (v2[keep], z), (a[keep], a[at[begin]]), (b[keep], b[at[end]]), (many[keep], np.ones(len(begin), bool))))


_PIECE = pa.schema([("anchor", pa.int64()), ("v1", pa.int64()), ("v2", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("sure", pa.bool_())])
_SPAN = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("sure", pa.bool_()), ("compare", pa.bool_())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _emit(length: int):
    def run(batches):
        met: dict[int, int] = {}
        for batch in batches:
            ids, ths = batch.column(0), batch.column(2)
            for x, y, data, offs in B.text_pieces(batch):
                own_id, own_th = ids[x:y], np.asarray(ths[x:y])
                spread = B.mix(own_th.view(U) ^ B.mix(np.asarray(own_id.fill_null(0)).view(U))).view(np.int64)
                size = np.diff(offs)
                # Of copies inside one task two are cut into pieces; further ones are removed whole, as they surely repeat.
                keep, sure = [], []
                for i, t in enumerate(own_th.tolist()):
                    k = met.get(t, 0)
                    met[t] = k + 1
                    (keep if k < 2 or size[i] < length else sure).append(i)
                if len(met) > 500_000:
                    met.clear()
                if sure:
                    s = np.array(sure)
                    z = pa.array(np.zeros(len(s), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(spread[s]), z, z, own_id.take(pa.array(s)), pa.array(own_th[s]), pa.array(np.zeros(len(s), np.int32)), pa.array((size[s] - length).astype(np.int32)), pa.array(np.ones(len(s), bool))], schema=_PIECE)
                    mask = np.ones(len(size), bool)
                    mask[s] = False
                    data = data[np.repeat(mask, size)]
                    offs = np.concatenate(([0], np.cumsum(size[mask])))
                k = np.array(keep, np.int64)
                for found in _long_pieces(data, offs, length):
                    doc, anchor, v1, v2, a, b, sure_ = _thinned(*found)
                    d = k[doc]
                    # Spans without a piece of their own only say what goes; they are spread by document.
                    key = np.where(v1 | v2, anchor.view(np.int64), spread[d])
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(v1.view(np.int64)), pa.array(v2.view(np.int64)), own_id.take(pa.array(d)), pa.array(own_th[d]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(sure_)], schema=_PIECE)

    return run


def _judge(batches):
    """From pieces sorted by (anchor, v1, v2): those that repeat whole (compare false), and one of each different piece of an
    anchor that has several (compare true, sure if it repeats). Holds one row back, and the first piece of the present anchor."""
    held, same_before, is_first, pending = None, False, True, None

    def step(t: pa.Table, final: bool):
        nonlocal held, same_before, is_first, pending
        n = t.num_rows
        anchor, v1, v2 = (np.asarray(t.column(i)) for i in range(3))
        sure = np.asarray(t.column("sure"))
        new_anchor = anchor[1:] != anchor[:-1]
        differs = new_anchor | (v1[1:] != v1[:-1]) | (v2[1:] != v2[:-1])
        same = np.r_[same_before, ~differs]
        first = np.r_[is_first, new_anchor]
        again = sure | same | np.r_[~differs, False]
        starts = np.flatnonzero(~same)  # first rows of different pieces
        decided = n if final else n - 1
        out_rows, out_sure = [], []
        if pending is not None and len(starts):
            if not first[starts[0]]:
                yield pending
            pending = None
        follows = np.r_[~first[starts[1:]], False] if len(starts) else np.zeros(0, bool)
        wanted = starts[(~first[starts] | follows)]
        wanted = wanted[wanted < decided]
        if len(starts):
            s = starts[-1]
            if s < decided and first[s]:
                pending = _row(t, np.array([s]), again[[s]], True)
        for rows, flag, compare in ((np.flatnonzero(again[:decided]), None, False), (wanted, again[wanted], True)):
            if len(rows):
                yield _row(t, rows, np.ones(len(rows), bool) if flag is None else flag, compare)
        if not final:
            held = t.slice(n - 1, 1)
            same_before, is_first = bool(same[-1]), bool(first[-1])

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch], schema=_PIECE) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch], schema=_PIECE)])
        yield from step(t.combine_chunks(), False)
    if held is not None:
        yield from step(held.combine_chunks(), True)


def _row(t: pa.Table, rows: np.ndarray, sure: np.ndarray, compare: bool) -> pa.RecordBatch:
    x = t.select(["anchor", "doc_id", "th", "a", "b"]).take(pa.array(rows)).combine_chunks().to_batches()[0]
    return pa.RecordBatch.from_arrays([*x.columns, pa.array(sure), pa.array(np.full(len(rows), compare))], schema=_SPAN)


def _shards(length: int):
    """From piece texts sorted by anchor to the spans of windows that repeat in pieces that don't repeat whole."""
    out = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])

    def solve(rows):
        texts = [np.frombuffer(r[5], np.uint8) for r in rows]
        got = repeated(texts, length)
        base = np.concatenate(([0], np.cumsum([len(x) + 1 for x in texts])))
        doc = np.searchsorted(base, got, "right") - 1
        single = np.array([not r[4] for r in rows], bool)
        got, doc = got[single[doc]], doc[single[doc]]
        cut = np.r_[True, (got[1:] != got[:-1] + 1) | (doc[1:] != doc[:-1])][: len(got)]
        first = np.flatnonzero(cut)
        last = np.r_[first[1:], len(got)][: len(first)] - 1
        own = [rows[i] for i in doc[first].tolist()]
        start = np.array([r[3] for r in own], np.int64) - base[doc[first]] if len(first) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array([r[1] for r in own], pa.int64()), pa.array([r[2] for r in own], pa.int64()), pa.array((got[first] + start).astype(np.int32)), pa.array((got[last] + start).astype(np.int32))], schema=out)

    def run(batches):
        rows, size, last = [], 0, None
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if r[0] != last and size >= SHARD_BYTES:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[5])
                last = r[0]
        if rows:
            yield solve(rows)

    return run


def repeated_spans(df: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, th, spans (array of struct<a, b>: first and last byte + 1, apart and in order) of the documents that lose bytes; ``df`` has doc_id, text (string or binary) and th, its hash."""
    found = df.select("doc_id", "text", "th").mapInArrow(B.trimmed(_emit(length)), _ddl(_PIECE))
    judged = stored(found.repartition("anchor").sortWithinPartitions("anchor", "v1", "v2").mapInArrow(B.trimmed(_judge), _ddl(_SPAN)))
    # Rows that repeat id and text have equal spans: sets, which are merged inside tasks first, hold no more than one document has.
    compare = stored(judged.filter("compare").groupBy("doc_id", "th").agg(F.collect_set(F.struct("anchor", "a", "b", "sure")).alias("cuts")))
    text = _with(df, compare, "inner")

    def cut(batches):
        for batch in batches:
            for doc_id, th, text_, cuts in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text_ if isinstance(text_, bytes) else text_.encode()
                yield pa.RecordBatch.from_arrays([
                    pa.array([c["anchor"] for c in cuts], pa.int64()), pa.array([doc_id] * len(cuts), pa.int64()), pa.array([th] * len(cuts), pa.int64()), pa.array([c["a"] for c in cuts], pa.int32()),
                    pa.array([c["sure"] for c in cuts], pa.bool_()), pa.array([raw[c["a"] : c["b"] + length] for c in cuts], pa.binary()),
                ], ["anchor", "doc_id", "th", "a", "sure", "body"])

    bodies = text.select("doc_id", "th", "text", "cuts").mapInArrow(B.trimmed(cut), "anchor long, doc_id long, th long, a int, sure boolean, body binary")
    shards = bodies.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(B.trimmed(_shards(length)), "doc_id long, th long, a int, b int")
    whole = judged.filter("not compare").select("doc_id", "th", "a", "b")
    every = whole.unionByName(shards).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("a", (F.col("b") + length).alias("b")))).alias("raw"))
    return stored(every.select("doc_id", "th", merge_spans("raw").alias("spans")))


def merge_spans(raw):
    """Apart spans from sorted ones, in one Arrow pass."""
    from pyspark.sql.functions import arrow_udf

    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    @arrow_udf("array<struct<a:int,b:int>>")
    def run(v: pa.Array) -> pa.Array:
        out = []
        for spans in v.to_pylist():
            own: list[dict] = []
            for s in spans:
                if own and s["a"] <= own[-1]["b"]:
                    own[-1]["b"] = max(own[-1]["b"], s["b"])
                else:
                    own.append(dict(s))
            out.append(own)
        return pa.array(out, kind)

    return run(raw)


def _with(df: DataFrame, other: DataFrame, how: str) -> DataFrame:
    return meet_few(df, other.withColumnsRenamed({"doc_id": "b_id", "th": "b_th"}), how)


def keep(raw: bytes, spans: list[dict] | None) -> bytes:
    """What is left of the bytes."""
    if not spans:
        return raw
    out, at = [], 0
    for s in spans:
        out.append(raw[at : s["a"]])
        at = s["b"]
    return b"".join([*out, raw[at:]])


def _stretches(batches):
    """From (doc_id, text, th, wide: spans) to each span's bytes, as a text of its own that starts at ``at``."""
    for batch in batches:
        ids, ths, ats, bodies = [], [], [], []
        for doc_id, text, th, wide in zip(*(c.to_pylist() for c in batch.columns)):
            raw = text.encode()
            for s in wide:
                ids.append(doc_id)
                ths.append(th)
                ats.append(s["a"])
                bodies.append(raw[s["a"] : s["b"]])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), pa.array(ats, pa.int32()), pa.array(bodies, pa.binary())], ["doc_id", "d_th", "at", "text"])


def _in_stretches(d: DataFrame, wide: DataFrame, length: int) -> DataFrame:
    """doc_id, th, spans of what repeated strings of ``length`` bytes cover in ``d`` (doc_id, text, th), where ``wide`` (doc_id, th, wide: spans) has all stretches that can hold one.

    A stretch is what strings of fewer bytes that repeat cover. Each part of a repeated string repeats, so that every occurrence of it lies in one stretch: the stretches as
    texts of their own have the same repeated strings. Copies end where their stretches do, so that most are found by hash, without a sort.
    Stretches that are equal bytes of one document lose the same, so content and document name them, as for whole texts.
    """
    few = stored(wide.withColumnsRenamed({"doc_id": "b_id", "th": "b_th"}))
    cut = meet_few(d, few, "inner").select("doc_id", "text", "th", "wide").mapInArrow(B.trimmed(_stretches), "doc_id long, d_th long, at int, text binary")
    own = stored(cut.withColumn("th", F.xxhash64("text")))
    found = repeated_spans(own.select("doc_id", "text", "th"), length).withColumnsRenamed({"doc_id": "o_id", "th": "o_th"})
    places = own.select("doc_id", "d_th", "at", "th").distinct()
    met = places.join(found, F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("th") == F.col("o_th")))
    moved = F.transform("spans", lambda s: F.struct((s["a"] + F.col("at")).alias("a"), (s["b"] + F.col("at")).alias("b")))
    return met.groupBy("doc_id", F.col("d_th").alias("th")).agg(F.sort_array(F.flatten(F.collect_list(moved))).alias("spans"))


def dedup_spans(df: DataFrame, length: int = 400, digest: bool = False, passage: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans of every row of ``df`` (doc_id, text), and what is left: kept (binary) or, with ``digest``, kept_sha256.

    With ``passage``, a shorter length, also n_passage: the bytes that repeated strings of that many bytes cover, which stay. Strings of ``length`` bytes can
    only repeat inside such stretches of as many bytes, all their occurrences, so these are then sought in the stretches alone (see ``_in_stretches``).
    """
    d = docs(df).withColumn("th", F.xxhash64("text"))
    if passage is None:
        spans = repeated_spans(d, length).withColumn("loose", F.lit(0).cast("long"))
    else:
        if not 0 < passage < length:
            raise ValueError("passage is shorter than length")
        short = repeated_spans(d, passage)
        covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["b"] - s["a"]))
        wide = F.filter("spans", lambda s: s["b"] - s["a"] >= length)
        some = stored(short.select("doc_id", "th", covered.alias("loose"), wide.alias("wide")))
        found = _in_stretches(d, some.filter(F.size("wide") > 0).select("doc_id", "th", "wide"), length).withColumnsRenamed({"doc_id": "f_id", "th": "f_th"})
        spans = stored(some.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th")), "left").select("doc_id", "th", "spans", "loose"))
    joined = _with(d, spans, "left").select("doc_id", "text", "spans", F.coalesce("loose", F.lit(0)).alias("loose"))
    last = ("kept_sha256", "string", pa.string()) if digest else ("kept", "binary", pa.binary())
    more = ["n_passage"] if passage is not None else []

    def run(batches):
        for batch in batches:
            raws = [t.encode() for t in batch.column(1).to_pylist()]
            own = batch.column(2).to_pylist()
            lost = [sum(s["b"] - s["a"] for s in x or ()) for x in own]
            kept = [keep(r, s) for r, s in zip(raws, own)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(r) for r in raws], pa.int64()), pa.array(lost, pa.int64()), pa.array([len(x or ()) for x in own], pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept] if digest else kept, last[2]), *([batch.column(3)] if more else []),
            ], ["doc_id", "n_bytes", "n_removed", "n_spans", last[0], *more])

    return joined.mapInArrow(B.trimmed(run), f"doc_id long, n_bytes long, n_removed long, n_spans long, {last[0]} {last[1]}" + "".join(f", {x} long" for x in more))
