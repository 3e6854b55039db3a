"""Conversation structure repair: the cheapest edits that make the turns of a conversation alternate, by a DP over retained subsequences.

Rows of a conversation stand in order of turn (nulls first; rows that share a turn by role, then by the hash of their text). A row's first fault counts:
blank, duplicate (role and text seen earlier), truncated (last character that isn't white space is none of ``.!?``). Edits and costs: Keep 0, Rerole to user or
assistant 2, Delete 3 (required for blank and duplicate rows), Insert an empty user or assistant turn 2; a truncated row that stays adds 1.
Role initials must become ``(s?(ua)+)?``. Of the cheapest edits the audit (their initials in order) that is least in ASCII decides.

The DP chooses retained rows, kept or reroled. The price of a gap between two of them is a difference of prefix deletion sums and the inserts that their pair
of roles needs (at most one); so a running minimum for each role of the last retained row, less the deletion sum there, is all that is held. Equal costs are decided by audits:
two audits of equal cost that lead from one state to another never are a prefix of one another, so the lesser one stays the lesser whatever follows. Deletions
stand before inserts in a gap, for D < I.

How it runs. Rows without their texts (a 256-bit hash stands for each) are counted, so rows that repeat are one; they are range partitioned by conversation and order, so a
conversation with a third of all rows is spread over many tasks. A task folds its part of a conversation into the costs and audits between each two states; such tables compose like
matrices, and a conversation's tables are few. They are sorted before the conversation's texts in a second exchange, where one stream applies the audit and hashes the repaired turns
in order. That stream holds a batch and an audit; that one task reads all texts of one conversation is inherent in the hash of them.

Nulls: role and text become one space; a null turn sorts first; a null conv_id is a conversation like others. An empty role has no initial and can't be kept. Empty tables give empty
results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm._frames import pick, small, small_batches, stored

SPACES = " \t\n\x0b\x0c\r"
DELETE, REROLE, INSERT, CUT = 3, 2, 2, 1
#: Inserts between the last retained role and the next one; "" is the beginning.
INSERTS = {("", "s"): 0, ("", "u"): 0, ("", "a"): 1, ("s", "u"): 0, ("s", "a"): 1, ("u", "a"): 0, ("u", "u"): 1, ("a", "u"): 0, ("a", "a"): 1}
#: Inserts that complete a conversation after its last retained role.
ENDS = {"": 0, "s": 2, "u": 1, "a": 0}
#: Rows whose audits are built at once; longer parts are composed from such pieces.
PIECE = 128
NAMES = {"u": "user", "a": "assistant"}

Table = dict[tuple[str, str], tuple[int, str]]


def turns(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies (1) without nulls in role and text."""
    d = small_batches(pick(df, "conv_id", "turn", "role", "text"))
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return d.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), plain("role"), plain("text"), F.lit(1).alias("copies"))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` of ``turns`` damaged by the checksum of conversation and turn modulo 20: 0 drops, 1 empties, 2 removes ends of sentences, 3 repeats, 4 makes it a user's."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.encode(F.concat(part("conv_id"), F.lit(":"), part("turn")), "utf-8")) % 20
    d = rows.withColumn("code", code).filter("code <> 0")
    return d.select(
        "conv_id", "turn",
        F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("code") == 3, F.col("copies") * 2).otherwise(F.col("copies")).alias("copies"),
    )


def _light(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, h, initial, fault (0 none, 1 blank, 2 duplicate, 3 truncated), m (copies, of which all but the first are duplicates)."""
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    kind = F.when(bare == "", 1).when(F.substring(bare, -1, 1).isin(".", "!", "?"), 0).otherwise(3)
    keyed = rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("h"), kind.alias("kind"), "copies")
    once = stored(keyed.groupBy("conv_id", "turn", "role", "h", "kind").agg(F.sum("copies").cast("long").alias("m")))
    # The first turn of what a conversation has in several turns; minima of structs take nulls first.
    first = once.groupBy(F.col("conv_id").alias("f_conv"), F.col("role").alias("f_role"), F.col("h").alias("f_h")).agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    first = stored(first)
    met = once.join(small(first), F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("role") == F.col("f_role")) & (F.col("h") == F.col("f_h")), "left")
    later = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    fault = F.when(F.col("kind") == 1, 1).when(later, 2).otherwise(F.col("kind"))
    return stored(met.select("conv_id", "turn", "role", "h", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "m"))


def between(rows: list[tuple[str, int, int]], starts: Iterable[str]) -> Table:
    """(state before, state after) -> (least cost, least audit of that cost) over rows of (initial, fault, m). A state is the last retained role."""
    out: Table = {}
    for start in starts:
        # state -> (cost less the deletion sum there, audit up to the last retained row, rows up to it)
        best = {start: (0, "", 0)}
        deleted = seen = 0
        for initial, fault, m in rows:
            new = {}
            if fault in (0, 3):
                roles = [(r, 0 if r == initial else REROLE, "K" if r == initial else "R") for r in "ua"] + ([("s", 0, "K")] if initial == "s" else [])
                for role, price, letter in roles:
                    options = []
                    for state, (cost, audit, at) in best.items():
                        if (k := INSERTS.get((state, role))) is not None:
                            options.append((cost + deleted + k * INSERT + price + (CUT if fault == 3 else 0), audit + "D" * (seen - at) + "I" * k + letter))
                    if options:
                        new[role] = min(options)
            seen += 1
            deleted += DELETE
            for role, (cost, audit) in new.items():
                cost -= deleted
                if role in best:
                    c, a, at = best[role]
                    if (c, a + "D" * (seen - at)) <= (cost, audit):
                        continue
                best[role] = (cost, audit, seen)
            seen += m - 1
            deleted += DELETE * (m - 1)
        for state, (cost, audit, at) in best.items():
            out[start, state] = (cost + deleted, audit + "D" * (seen - at))
    return out


def compose(a: Table, b: Table) -> Table:
    out: Table = {}
    for (s, m), (c, x) in a.items():
        for (n, t), (d, y) in b.items():
            if m == n and ((s, t) not in out or (c + d, x + y) < out[s, t]):
                out[s, t] = (c + d, x + y)
    return out


def balanced(tables: list[Table]) -> Table:
    """Neighbours first, so that an audit is copied as often as the depth of a tree."""
    while len(tables) > 1:
        tables = [compose(*tables[i : i + 2]) if i + 1 < len(tables) else tables[i] for i in range(0, len(tables), 2)]
    return tables[0] if tables else {("", ""): (0, "")}


class _Part:
    """A task's rows of one conversation."""

    def __init__(self, conv: int | None, starts: str):
        self.conv, self.starts = conv, [s.strip() for s in starts]
        self.counts = {"rows": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0}
        self.first = self.last = self.low = self.high = None
        self.rows: list[tuple[str, int, int]] = []
        self.tables: list[Table] = []

    def add(self, turn: int | None, initial: str, fault: int, m: int) -> None:
        c = self.counts
        c["rows"] += m
        c["blank"] += m if fault == 1 else 0
        c["duplicate"] += 0 if fault == 1 else m if fault == 2 else m - 1
        c["truncated"] += fault == 3
        c["illegal"] += m - 1 + (self.last is not None and self.last + initial not in ("su", "ua", "au"))
        if turn is not None and turn != self.high:
            c["turns"] += 1
        if turn is not None:
            self.low, self.high = turn if self.low is None else self.low, turn
        self.first, self.last = initial if self.first is None else self.first, initial
        self.rows.append((initial, fault, m))
        if len(self.rows) >= PIECE:
            self.cut()

    def cut(self) -> None:
        if self.rows:
            self.tables.append(between(self.rows, self.starts if not self.tables else ["", "s", "u", "a"]))
            self.rows = []

    def head(self) -> str:
        self.cut()
        t = balanced(self.tables)
        return json.dumps({"counts": self.counts, "first": self.first, "last": self.last, "low": self.low, "high": self.high, "table": [[s, e, c, a] for (s, e), (c, a) in t.items()]})


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, kind = TaskContext.get().partitionId(), pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("head", pa.string())])
    # Only a task's first conversation may have begun elsewhere.
    now, out, size = None, [], 0
    for b in batches:
        for conv, turn, initial, fault, m in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if now is None or conv != now.conv:
                if now is not None:
                    out.append((now.conv, part, now.head()))
                    size += len(out[-1][2])
                now = _Part(conv, " sua" if now is None else " ")
            now.add(turn, initial, fault, m)
        if size > 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)
            out, size = [], 0
    if now is not None:
        out.append((now.conv, part, now.head()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)


class _Repair:
    """One conversation in the last stream: its heads come first, then its rows."""

    def __init__(self, conv: int | None):
        self.conv, self.heads, self.audit = conv, [], None
        self.hash, self.n, self.at, self.state = hashlib.sha256(), 0, 0, ""

    def settle(self) -> None:
        """Audit, cost and counts from the heads."""
        heads = self.heads
        table = balanced([{(s, e): (c, a) for s, e, c, a in h["table"]} for h in heads])
        self.cost, self.audit = min((c + ENDS[e] * INSERT, a + "I" * ENDS[e]) for (s, e), (c, a) in table.items() if s == "")
        self.counts = {k: sum(h["counts"][k] for h in heads) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
        last = high = None
        for h in heads:
            if last is not None and last + h["first"] not in ("su", "ua", "au"):
                self.counts["illegal"] += 1
            # A turn that a cut divides was counted twice.
            if high is not None and high == h["low"]:
                self.counts["turns"] -= 1
            last, high = h["last"], h["high"] if h["high"] is not None else high
        lows = [h["low"] for h in heads if h["low"] is not None]
        self.counts["gaps"] = high - lows[0] + 1 - self.counts["turns"] if lows else 0

    def _put(self, role: str, text: str, edit: str, out: list | None) -> None:
        if self.n:
            self.hash.update(b"\n")
        self.hash.update(f"{role}:{text}".encode())
        if out is not None:
            out.append((self.conv, self.n, role, text, edit))
        self.n += 1
        self.state = role[:1]

    def _next(self) -> str:
        return "a" if self.state == "u" else "u"

    def _inserted(self, out: list | None) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._put(NAMES[self._next()], "", "I", out)
            self.at += 1

    def row(self, role: str, text: str, copies: int, out: list | None) -> None:
        if self.audit is None:
            self.settle()
        self._inserted(out)
        edit = self.audit[self.at]
        self.at += copies
        if edit != "D":
            self._put(role if edit == "K" else NAMES[self._next()], text, edit, out)

    def done(self, out: list | None) -> tuple:
        if self.audit is None:
            self.settle()
        self._inserted(out)
        c = self.counts
        return (self.conv, c["gaps"], c["blank"], c["duplicate"], c["truncated"], c["illegal"], self.cost, self.audit, self.hash.hexdigest())


DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, role string, text string, edit string"
_KINDS = {
    True: pa.schema([("conv_id", pa.int64()), *((k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())]),
    False: pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]),
}


def _repaired(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    kind = _KINDS[digest]
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)
    now = None
    for b in batches:
        ready: list = []
        got = None if digest else ready
        for conv, head, role, text, copies in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if now is None or conv != now.conv:
                if now is not None:
                    end = now.done(got)
                    if digest:
                        ready.append(end)
                now = _Repair(conv)
            if role is not None:
                now.row(role, text, copies, got)
            elif head is not None:
                now.heads.append(json.loads(head))
        if ready:
            yield pack(ready)
    if now is not None:
        ready = []
        end = now.done(None if digest else ready)
        if digest:
            ready.append(end)
        if ready:
            yield pack(ready)


def repair(rows: DataFrame, ids: DataFrame, digest: bool = False) -> DataFrame:
    """The repaired turns (conv_id, place, role, text, edit: K, R or I) of ``rows`` (see ``turns``); with ``digest`` one row for each conversation of ``ids`` or ``rows``:
    gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "h"]
    light = _light(rows).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    heads = stored(light.select("conv_id", "turn", "initial", "fault", "m").mapInArrow(_heads, "conv_id long, part int, head string"))
    names = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("part", F.lit(-1))
    texts = rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("h"), "text", "copies").withColumn("part", F.lit(2**31 - 1))
    every = names.unionByName(heads, allowMissingColumns=True).unionByName(texts, allowMissingColumns=True)
    placed = every.repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "h")
    return placed.select("conv_id", "head", "role", "text", "copies").mapInArrow(functools.partial(_repaired, digest=digest), DIGEST if digest else TURNS)
