"""Repair of conversations: the cheapest edits that make the turns alternate, by Knuth's lightest derivation.

A conversation is a sequence of rows by turn; after repair its role initials
read ``(s?(ua)+)?``. That grammar has four states: nothing yet, after the
system row, after a user, after an assistant. Deduction items are [i, state]:
the first i rows are dealt with. The hyperedges join an item with an edit of
row i (an axiom: keep, rerole, delete), or insert an empty turn:

    [i, p]  row i: K, R or D      ->  [i + 1, q]
    [i, p]  I                     ->  [i, q]

Weights are pairs (cost, audit) and a head's weight is the sum of the costs and
the audits in order, which is never less than its tail's: a monotone superior
function. So the agenda pops items by (cost, audit), each popped item is final,
and the work ends when a goal item (all rows, nothing or an assistant last) is.

Conversations of any length. Rows that are the same in all columns become one
with a number (its further copies are forced deletions: the run is one edit),
the others are dealt by range over (conversation, turn, role, digest), so a
conversation that holds a third of all rows is spread over many tasks. A task
reads its rows as a stream, in chunks of at most ``CHUNK_ROWS`` rows and
``CHUNK_CHARS`` characters. A conversation that lies inside one chunk is done
there. Of the others every chunk is derived once from each state, which gives
hyperedges [k, p] chunk k -> [k + 1, q] with the same kind of weight; a second
stream per conversation derives over its chunks and feeds the digest (one
SHA-256 is sequential), with a chunk, four digests and four audits in memory.

Defined results: a null role or text is one space. Null turns come first; rows
of one turn are ordered by role, then by the SHA-256 of the text. Rows with a
null conversation key are one conversation. Roles are kept as they are, and
their first character counts as it is. A conversation without rows (all
dropped) has zeros, an empty audit and the digest of no bytes. An empty table
gives an empty result; columns besides those named are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonepulse.llm.common import SPACES, stored
from zonepulse.session import ship_package

CHUNK_ROWS = 256
CHUNK_CHARS = 4_000_000

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

#: States: 0 nothing yet, 1 after the system row, 2 after a user, 3 after an assistant.
START, GOALS = 0, (0, 3)
KEEP_MOVES = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
NEXT_TURN = {0: 2, 1: 2, 2: 3, 3: 2}
ROLE_OF = {2: "user", 3: "assistant"}
LEGAL_PAIRS = ("su", "ua", "au")

WHITE = " \t\n\x0b\x0c\r"

Weight = tuple[int, str]


class Row:
    """One row as the repair sees it: its fault, and how many more copies of it follow."""

    __slots__ = ("role", "text", "extra", "fault")

    def __init__(self, role: str, text: str, copies: int, first: bool):
        self.role, self.text, self.extra = role, text, copies - 1
        bare = text.strip(WHITE)
        self.fault = "blank" if not bare else "duplicate" if not first else "truncated" if bare[-1] not in ".!?" else None

    def edits(self) -> Iterator[tuple[int, str, dict[int, int]]]:
        """Axioms of this row: (cost, audit, moves of the state); its further copies are deleted in any case."""
        rest, more = "D" * self.extra, DELETE * self.extra
        yield DELETE + more, "D" + rest, {q: q for q in range(4)}
        if self.fault in (None, "truncated"):
            added = more + (TRUNCATED if self.fault else 0)
            yield added, "K" + rest, KEEP_MOVES.get(self.role[:1], {})
            yield REROLE + added, "R" + rest, NEXT_TURN


def lightest(steps: list[list[tuple[int, str, dict[int, int]]]], start: int, goals: Iterable[int], most: int = 4) -> dict[int, Weight]:
    """Knuth's algorithm: the lightest weights of the items [len(steps), goal], in the order they are popped.

    ``steps[i]`` has the axioms that lead from [i, p] to [i + 1, moves[p]]; the
    derivations begin with [0, start]. An agenda item is final when popped, and
    the agenda is left when ``most`` goal items are.
    """
    agenda: list[tuple[Weight, int, int]] = [((0, ""), 0, start)]
    final: set[tuple[int, int]] = set()
    found: dict[int, Weight] = {}
    wanted = set(goals)
    while agenda and wanted:
        (cost, audit), i, p = heappop(agenda)
        if (i, p) in final:
            continue
        final.add((i, p))
        if i == len(steps) and p in wanted:
            found[p] = (cost, audit)
            wanted.discard(p)
            if len(found) == most:
                break
        if (i, NEXT_TURN[p]) not in final:
            heappush(agenda, ((cost + INSERT, audit + "I"), i, NEXT_TURN[p]))
        if i < len(steps):
            for more, letters, moves in steps[i]:
                q = moves.get(p)
                if q is not None and (i + 1, q) not in final:
                    heappush(agenda, ((cost + more, audit + letters), i + 1, q))
    return found


def replay(rows: list[Row], audit: str, state: int) -> Iterator[str]:
    """The repaired lines of ``rows`` by an audit that begins in ``state``."""
    at = 0

    def inserted() -> Iterator[str]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = NEXT_TURN[state]
            at += 1
            yield f"{ROLE_OF[state]}:"

    for row in rows:
        yield from inserted()
        letter = audit[at]
        at += 1 + row.extra
        if letter == "K":
            state = KEEP_MOVES[row.role[:1]][state]
            yield f"{row.role}:{row.text}"
        elif letter == "R":
            state = NEXT_TURN[state]
            yield f"{ROLE_OF[state]}:{row.text}"
    yield from inserted()


class Digest:
    """SHA-256 of lines joined by a newline, fed line by line."""

    def __init__(self) -> None:
        self.sha, self.any = hashlib.sha256(), False

    def fed(self, lines: Iterable[str]) -> Digest:
        out = Digest()
        out.sha, out.any = self.sha.copy(), self.any
        for line in lines:
            out.sha.update((("\n" if out.any else "") + line).encode())
            out.any = True
        return out


class Tally:
    """Counts of a conversation that add up over its chunks in order."""

    FIELDS = ("turns", "least", "most", "head", "tail", "blank", "duplicate", "truncated", "illegal")

    def __init__(self) -> None:
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.least = self.most = self.head = self.tail = None

    def row(self, turn: int | None, row: Row) -> None:
        if turn is not None and turn != self.most:
            self.turns, self.most = self.turns + 1, turn
            self.least = turn if self.least is None else self.least
        if row.fault == "blank":
            self.blank += 1 + row.extra
        else:
            self.duplicate += row.extra + (row.fault == "duplicate")
            self.truncated += row.fault == "truncated"
        initial = row.role[:1]
        self.pair(self.tail, initial)
        self.illegal += row.extra  # a copy beside its like
        self.head, self.tail = initial if self.head is None else self.head, initial

    def pair(self, left: str | None, right: str | None) -> None:
        self.illegal += left is not None and right is not None and left + right not in LEGAL_PAIRS

    def then(self, other: Tally) -> None:
        """Add the counts of the following chunk."""
        self.pair(self.tail, other.head)
        self.turns += other.turns - (self.most is not None and self.most == other.least)
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        if other.least is not None:
            self.least, self.most = other.least if self.least is None else self.least, other.most
        if other.tail is not None:
            self.head, self.tail = other.head if self.head is None else self.head, other.tail

    def values(self) -> dict:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}


RESULT = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
RESULT_DDL = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TALLY = pa.struct([("turns", pa.int64()), ("least", pa.int64()), ("most", pa.int64()), ("head", pa.string()), ("tail", pa.string()), *((x, pa.int64()) for x in ("blank", "duplicate", "truncated", "illegal"))])
TALLY_DDL = "struct<turns:long,least:long,most:long,head:string,tail:string,blank:long,duplicate:long,truncated:long,illegal:long>"
EDGES = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
LINES = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("copies", pa.int64()), ("first", pa.bool_())]))
CHUNK = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), *RESULT, ("tally", TALLY), ("edges", EDGES), ("rows", LINES)])
CHUNK_DDL = (
    f"conv_id long, at long, {RESULT_DDL}, tally {TALLY_DDL}, "
    "edges array<struct<p:int,q:int,cost:long,audit:string>>, rows array<struct<role:string,text:string,copies:long,first:boolean>>"
)
DONE = pa.schema([("conv_id", pa.int64()), *RESULT])

Given = tuple[int | None, int | None, str, str, int, bool]


def _chunks(given: Iterator[Given]) -> Iterator[tuple[int | None, bool, list[Given]]]:
    """(conversation, whether it lies inside this stream's only chunk of it, rows), for rows in order."""
    held: list[Given] = []
    chars, first, opened = 0, True, True  # opened: the held rows begin a conversation that this stream may share with another
    for row in given:
        new = bool(held) and row[0] != held[0][0]
        full = bool(held) and (len(held) >= CHUNK_ROWS or chars + len(row[3]) > CHUNK_CHARS)
        if new or full:
            yield held[0][0], new and not opened, held
            opened = not new
            held, chars = [], 0
        held.append(row)
        chars += len(row[3])
    if held:
        yield held[0][0], False, held


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[Given]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "first")), strict=True)


def _batched(records: Iterator[dict], schema: pa.Schema, weight) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    chars = 0
    for record in records:
        held.append(record)
        chars += weight(record)
        if len(held) >= 2000 or chars >= CHUNK_CHARS:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _derive_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order -> a finished conversation, or a chunk with the lightest derivation from each state to each."""

    def records() -> Iterator[dict]:
        for n, (conv, whole, given) in enumerate(_chunks(_stream(batches))):
            tally, rows, kept = Tally(), [], []
            for _, turn, role, text, copies, first in given:
                if copies:  # else the mark of a dropped row
                    row = Row(role, text, copies, first)
                    rows.append(row)
                    kept.append({"role": role, "text": text, "copies": copies, "first": first})
                    tally.row(turn, row)
            steps = [list(row.edits()) for row in rows]
            out: dict = {"conv_id": conv, "at": n}
            if whole:
                ((cost, audit),) = lightest(steps, START, GOALS, most=1).values()
                out |= {**tally.values(), "cost": cost, "audit": audit, "repaired_sha256": Digest().fed(replay(rows, audit, START)).sha.hexdigest()}
            else:
                edges = [(p, q, w) for p in range(4) for q, w in lightest(steps, p, range(4)).items()]
                out |= {
                    "tally": {x: getattr(tally, x) for x in Tally.FIELDS},
                    "edges": [{"p": p, "q": q, "cost": w[0], "audit": w[1]} for p, q, w in edges],
                    "rows": kept,
                }
            yield out

    yield from _batched(records(), CHUNK, lambda r: sum(len(x["text"]) for x in r.get("rows") or ()))


def _derive_conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks by conversation and place -> one finished row a conversation."""

    def finished(conv: int | None, settled: list[str], states: dict, tally: Tally) -> dict:
        (cost, audit), digest = min((states[q] for q in GOALS if q in states), key=lambda x: x[0])  # the goal item popped first
        return {"conv_id": conv, **tally.values(), "cost": cost, "audit": "".join(settled) + audit, "repaired_sha256": digest.sha.hexdigest()}

    def records() -> Iterator[dict]:
        conv, states, settled, tally = object(), {}, [], Tally()
        for batch in batches:
            for chunk in batch.to_pylist():
                if chunk["conv_id"] != conv:
                    if states:
                        yield finished(conv, settled, states, tally)
                    conv, states, settled, tally = chunk["conv_id"], {START: ((0, ""), Digest())}, [], Tally()
                own = Tally()
                for name in Tally.FIELDS:
                    setattr(own, name, chunk["tally"][name])
                tally.then(own)
                rows = [Row(x["role"], x["text"], x["copies"], x["first"]) for x in chunk["rows"]]
                best: dict[int, tuple[Weight, int, str]] = {}
                for edge in chunk["edges"]:
                    if edge["p"] in states:
                        cost, audit = states[edge["p"]][0]
                        weight = (cost + edge["cost"], audit + edge["audit"])
                        if edge["q"] not in best or weight < best[edge["q"]][0]:
                            best[edge["q"]] = (weight, edge["p"], edge["audit"])
                states = {q: (w, states[p][1].fed(replay(rows, letters, p))) for q, (w, p, letters) in best.items()}
                common = os.path.commonprefix([w[1] for w, _ in states.values()])
                if common:  # the same beginning in all: it decides nothing any more
                    settled.append(common)
                    states = {q: ((w[0], w[1][len(common) :]), d) for q, (w, d) in states.items()}
        if states:
            yield finished(conv, settled, states, tally)

    yield from _batched(records(), DONE, lambda r: len(r["audit"]))


def damaged(convs: DataFrame) -> DataFrame:
    """The rows after damage by the CRC-32 of ``conv_id:turn`` modulo 20, with ``copies`` (0: dropped, 2: repeated)."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(own("conv_id"), F.lit(":"), own("turn")).cast("binary")) % 20
    return convs.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(hit == 4, "user").otherwise(own("role")).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.regexp_replace(own("text"), "[.!?]", "")).otherwise(own("text")).alias("text"),
        F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _distinct_rows(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their number, and whether no earlier turn has the same role and text."""
    dropped = F.col("copies") == 0
    text = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    rows = rows.select(
        text(F.col("conv_id")).alias("conv_key"),
        text(F.when(~dropped, F.col("turn"))).alias("turn_key"),
        F.when(dropped, "").otherwise(text(F.col("role"))).alias("role"),
        F.when(dropped, "").otherwise(text(F.col("text"))).alias("text"),
        "copies",
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))
    blank = F.length(F.regexp_replace("text", SPACES, "")) == 0
    turn: Column = F.expr("try_cast(turn_key AS BIGINT)")
    firsts = (
        rows.where(~blank)
        .groupBy("conv_key", "role", "digest")
        .agg(F.min(F.struct(turn.isNotNull().alias("known"), turn.alias("turn"))).alias("least"))
        .select("conv_key", text(F.col("least.turn")).alias("turn_key"), "role", "digest", F.lit(True).alias("first"))
    )
    keys = ["conv_key", "turn_key", "role", "digest"]
    alike = rows.groupBy(*keys).agg(F.sum("copies").alias("copies"), F.first("text").alias("text"))
    return alike.join(firsts, keys, "left").select(
        F.expr("try_cast(conv_key AS BIGINT)").alias("conv_id"), turn.alias("turn"), "role", "text", "digest", "copies", F.coalesce("first", F.lit(False)).alias("first")
    )


def repair(convs: DataFrame, copies_col: str | None = None) -> DataFrame:
    """One row per conversation: what is wrong with it, and the cheapest repair (see the module's docstring).

    Takes conv_id, turn, role and text; ``copies_col`` names a column that says
    how often a row stands (0: the row is gone, its conversation is kept).
    """
    ship_package(convs.sparkSession)
    copies = F.col(copies_col) if copies_col else F.lit(1)
    convs = convs.select("conv_id", "turn", "role", "text", copies.cast("long").alias("copies"))
    order = ["conv_id", "turn", "role", "digest"]
    rows = _distinct_rows(convs).repartitionByRange(*order).sortWithinPartitions(*order)
    derived = rows.select("conv_id", "turn", "role", "text", "copies", "first").mapInArrow(_derive_chunks, CHUNK_DDL)
    derived = stored(derived.withColumn("at", F.spark_partition_id() * F.lit(1 << 40) + F.col("at")), "chunks")
    parts = derived.where("edges IS NOT NULL").select("conv_id", "at", "tally", "edges", "rows")
    long = parts.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_derive_conversations, f"conv_id long, {RESULT_DDL}")
    return derived.where("edges IS NULL").select("conv_id", *(name for name, _ in RESULT)).unionByName(long)
