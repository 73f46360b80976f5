"""Conversation structure repair: square-root checkpointed dynamic programme over segments of conversations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from math import isqrt

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.session import stage
from tidemark.shipping import ship_package

#: Rows and bytes of text of a segment at most; a longer conversation is repaired segment by segment.
SEGMENT_ROWS, SEGMENT_BYTES = 1 << 15, 4 << 20
#: Characters of a text that decide between partitions for rows of one turn and role.
RANGE_CHARS = 64

#: Fixed costs of the edits. An undeleted truncated row costs one more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

# What the repaired rows so far amount to: nothing, a system row, ending in a user row, ending in an assistant row.
_EMPTY, _SYSTEM, _USER, _ASSISTANT = range(4)
_STATES = range(4)
_FAR = 1 << 60
#: Next state after a role that begins with the letter; only these may follow.
_AFTER = {"s": {_EMPTY: _SYSTEM}, "u": {_EMPTY: _USER, _SYSTEM: _USER, _ASSISTANT: _USER}, "a": {_USER: _ASSISTANT}}
#: State after a row of the one role, user or assistant, that may follow.
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
#: Costs of ending here: of a repaired conversation that is empty or ends in an assistant row.
END = (0, _FAR, _FAR, 0)
_LEGAL = {"su", "ua", "au"}

# A row as one byte: to be deleted, or the class of its role's initial and whether it is truncated.
_CLASS = {"s": 0, "u": 1, "a": 2}
_GONE = 8


def code(initial: str, truncated: bool) -> int:
    return 2 * _CLASS.get(initial, 3) + truncated


def _keep(row: int, state: int) -> int | None:
    """State after keeping a row, if that is legal."""
    initial = row >> 1
    return _AFTER["sua"[initial]].get(state) if initial < 3 else None


def _open(cost: list[int]) -> tuple[int, ...]:
    """Costs when rows may be inserted first: a user row, or after one an assistant row, twice at most."""
    user = min(cost[_USER], INSERT + cost[_ASSISTANT])
    assistant = min(cost[_ASSISTANT], INSERT + user)
    return min(cost[_EMPTY], INSERT + user), min(cost[_SYSTEM], INSERT + user), user, assistant


_STEPS = [[(_keep(row, state), row & 1) for state in _STATES] for row in range(_GONE)]


def before(row: int, rest: tuple[int, ...]) -> tuple[int, ...]:
    """Cheapest costs from each state before a row, given those after it."""
    if row == _GONE:
        return _open([DELETE + rest[q] for q in _STATES])
    out = []
    for q, (kept, late) in zip(_STATES, _STEPS[row]):
        best = min(DELETE + rest[q], REROLE + late * TRUNCATED + rest[_NEXT[q]])
        out.append(best if kept is None else min(best, KEEP + late * TRUNCATED + rest[kept]))
    return _open(out)


def costs(rows: bytes, rest: tuple[int, ...]) -> tuple[int, ...]:
    for row in reversed(rows):
        rest = before(row, rest)
    return rest


def transfer(rows: bytes) -> list[int]:
    """Cheapest cost from each state before the rows to each state after them, row by row of a 4 x 4 matrix."""
    columns = [costs(rows, tuple(0 if q == end else _FAR for q in _STATES)) for end in _STATES]
    return [min(columns[end][q], _FAR) for q in _STATES for end in _STATES]


def walk(rows: bytes, rest: tuple[int, ...], state: int, last: bool) -> tuple[str, int]:
    """Initials of the ASCII-least cheapest edits from ``state``, and the state they lead to.

    ``rest`` holds the costs after the rows. Going backward, cost vectors are stored at every square root of the rows only;
    going forward, those of one block at a time are computed again. Without ``last`` the walk ends with the last row: what
    is inserted there belongs to the segment that follows. From a state, edits of one initial lead to one
    state, so the least initial at each place gives the least string.
    """
    step = max(1, isqrt(len(rows)))
    marks = list(range(0, len(rows), step))
    stored, now = {len(rows): rest}, rest
    for at in reversed(marks):
        now = stored[at] = costs(rows[at : at + step], now)
    out = []
    for at in marks:
        block = rows[at : at + step]
        ahead = [stored[at + len(block)]]
        for row in reversed(block):
            ahead.append(before(row, ahead[-1]))
        ahead.reverse()
        for i, row in enumerate(block):
            while True:
                left, after = ahead[i][state], ahead[i + 1]
                if left == DELETE + after[state]:
                    out.append("D")
                    break
                if left == INSERT + ahead[i][_NEXT[state]]:
                    out.append("I")
                    state = _NEXT[state]
                    continue
                kept, late = _STEPS[row][state]
                if kept is not None and left == KEEP + late * TRUNCATED + after[kept]:
                    out.append("K")
                    state = kept
                else:
                    out.append("R")
                    state = _NEXT[state]
                break
    while last and END[state] > 0:
        out.append("I")
        state = _NEXT[state]
    return "".join(out), state


@lru_cache(1 << 14)
def repair(rows: bytes) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    end = _open(list(END))
    return costs(rows, end)[_EMPTY], walk(rows, end, _EMPTY, True)[0]


def repaired(audit: str, rows: list[tuple[str, str]], state: int = _EMPTY) -> list[str]:
    """``role:text`` of the rows that edits leave, from ``state``."""
    out, at = [], iter(rows)
    for edit in audit:
        if edit == "D":
            next(at)
            continue
        own = "assistant" if state == _USER else "user"
        if edit == "I":
            out.append(f"{own}:")
        else:
            role, text = next(at)
            out.append(f"{role if edit == 'K' else own}:{text}")
        state = _AFTER[role[:1]][state] if edit == "K" else _NEXT[state]
    return out


class Segment:
    """Consecutive rows of a conversation: (turn, role, text, blank, truncated), after damage and by turn."""

    def __init__(self, rows: list[tuple]):
        self.rows = rows
        seen: set[tuple[str, str]] = set()
        self.fault = []  # first fault of each row
        for _, role, text, blank, cut in rows:
            self.fault.append("b" if blank else "d" if (role, text) in seen else "t" if cut else ".")
            if not blank:
                seen.add((role, text))
        self.initials = [r[1][:1] for r in rows]
        turns = [r[0] for r in rows if r[0] is not None]
        self.turns = (turns[0], turns[-1], len(set(turns))) if turns else None
        self.illegal = sum(a + b not in _LEGAL for a, b in zip(self.initials, self.initials[1:]))

    def digests(self) -> list[bytes | None]:
        """What role and text of a row that is not blank are told apart by across segments."""
        return [None if f == "b" else hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:20]
                for f, (_, role, text, *_) in zip(self.fault, self.rows)]

    def codes(self) -> bytes:
        return bytes(_GONE if f in "bd" else code(i, f == "t") for f, i in zip(self.fault, self.initials))


_RESULT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
_RESULT_NAMES = [x.split()[0] for x in _RESULT.split(", ")]
_SEGMENT = ("at long, initials string, faults string, digests array<binary>, low long, high long, distinct long, inside long, packed binary")
_SEGMENT_NAMES = [x.split()[0] for x in _SEGMENT.split(", ")]
_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()),
          "array<long>": pa.list_(pa.int64()), "int": pa.int32(), "short": pa.int16(), "byte": pa.int8(), "bigint": pa.int64(),
          "smallint": pa.int16(), "tinyint": pa.int8()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), _TYPES[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def _batches(rows: Iterator[tuple], schema: str, size: int = 2048, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(held) == size or weight > limit:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _whole(rows: list[tuple]) -> tuple:
    """Result of a conversation that is one segment."""
    s = Segment(rows)
    cost, audit = repair(s.codes()) if len(rows) <= 64 else repair.__wrapped__(s.codes())
    text = "\n".join(repaired(audit, [(r[1], r[2]) for r in rows]))
    gaps = s.turns[1] - s.turns[0] + 1 - s.turns[2] if s.turns else 0
    return (gaps, *(s.fault.count(f) for f in "bdt"), s.illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def repair_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                         copies: str | None = None) -> DataFrame:
    """One row per conversation: faults, the cheapest edits that make its roles ``(s?(ua)+)?``, and a digest of the result.

    Rows of a conversation are taken by turn (missing ones first), then role and text; ``copies`` names a column with the number of times that a
    row counts (0: not at all; by default once). A missing role or text is one space. A row's first fault is blank
    (no character but white space), duplicate (role and text earlier in the conversation) or truncated (not ending in ``.``,
    ``!`` or ``?``). Rows without conversation are one conversation. A conversation without rows that count has zeros,
    no edits and the digest of an empty text. Other columns are ignored; an empty table gives an empty result.

    Rows are dealt by ranges of (conversation, turn, role, text), so a conversation with many rows spans several tasks.
    Conversations inside one task are repaired there. The others are segments: each gives a cost matrix
    between the states at its ends, the matrices give the cost vectors at those checkpoints, and the segments are walked
    from their checkpoints. Only the last step reads a conversation's result in order: its digest is that of one text.
    """
    spark = rows.sparkSession
    ship_package(spark)
    kind = {"bigint": "long"}.get(rows.schema[conv].dataType.simpleString(), rows.schema[conv].dataType.simpleString())
    bare = F.btrim(F.col("text"), F.lit("\t\n\x0b\x0c\r "))
    source = rows.select(rows[conv].alias("conv"), rows[turn].cast("long").alias("turn"), F.coalesce(rows[role], F.lit(" ")).alias("role"),
                         F.coalesce(rows[text], F.lit(" ")).alias("text"),
                         (F.coalesce(rows[copies], F.lit(0)) if copies else F.lit(1)).cast("int").alias("copies"))
    source = source.select("*", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    dealt = (source.repartitionByRange("conv", "turn", "role", F.substring("text", 1, RANGE_CHARS))
             .sortWithinPartitions("conv", "turn", "role", "text"))
    pieces_of = f"conv {kind}, {_RESULT}, {_SEGMENT}"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        nothing, no_segment = (None,) * len(_RESULT_NAMES), (None,) * len(_SEGMENT_NAMES)

        def segment(number: int, name, held: list[tuple]) -> tuple:
            s = Segment(held)
            body = "".join(f"{len(r[1])} {len(r[2])} {r[1]}{r[2]}" for r in held).encode()
            return (name, *nothing, part + number, "".join(i or "-" for i in s.initials), "".join(s.fault), s.digests(), *(s.turns or (None, None, 0)),
                    s.illegal, zstandard.ZstdCompressor(level=1).compress(body))

        def pieces() -> Iterator[tuple]:
            name, held, size, number, split, first = None, [], 0, 0, False, True
            for batch in batches:
                for c, t, r, x, n, blank, late in zip(*(col.to_pylist() for col in batch.columns)):
                    if first:
                        name, split, first = c, True, False  # the first conversation may have begun in another task
                    elif c != name:
                        yield segment(number, name, held) if split else (name, *_whole(held), *no_segment)
                        name, held, size, split, number = c, [], 0, False, number + 1
                    for _ in range(n):
                        if len(held) == SEGMENT_ROWS or held and size + len(x) > SEGMENT_BYTES:
                            yield segment(number, name, held)
                            held, size, split, number = [], 0, True, number + 1
                        held.append((t, r, x, blank, late))
                        size += len(x)
            if not first:
                yield segment(number, name, held)  # the last one may go on in another task

        yield from _batches(pieces(), pieces_of)

    pieces = stage(dealt.mapInArrow(cut, pieces_of), "conversation-pieces")
    done = pieces.where("at is null").select("conv", *_RESULT_NAMES)
    return done.unionAll(_joined(pieces.where("at is not null"), kind)).withColumnRenamed("conv", conv)


def _by_conversation(rows: DataFrame, run, schema: str) -> DataFrame:
    """``run`` on the rows of each conversation in order of ``at``, as a stream of tuples; conv stands first in both."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(run(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))), schema)

    return rows.repartition("conv").sortWithinPartitions("conv", "at").mapInArrow(stream, schema)


def _joined(segments: DataFrame, kind: str) -> DataFrame:
    """Results of conversations that span segments."""
    # Rows whose role and text stand in an earlier segment already.
    held = segments.select("conv", "at", F.explode(F.array_distinct(F.filter("digests", lambda d: d.isNotNull()))).alias("digest"))
    first = held.groupBy("conv", "digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("conv", "digest", "first")
    again = _with(held, first, ("conv", "digest")).where("at > first").groupBy("conv", "at").agg(F.collect_list("digest").alias("again"))
    known = _with(segments.select("conv", "at", "initials", "faults", "digests", "low", "high", "distinct", "inside"), again, how="left")
    coded_of = (f"conv {kind}, at long, codes binary, matrix array<long>, blank long, duplicate long, truncated long, inside long, "
                "low long, high long, distinct long, head string, tail string")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run() -> Iterator[tuple]:
            for batch in batches:
                for name, at, initials, faults, digests, low, high, distinct, inside, again in zip(*(c.to_pylist() for c in batch.columns)):
                    earlier = set(again or ())
                    faults = ["d" if d in earlier else f for f, d in zip(faults, digests)]
                    codes = bytes(_GONE if f in "bd" else code(i, f == "t") for f, i in zip(faults, initials))
                    yield (name, at, codes, transfer(codes), *(faults.count(f) for f in "bdt"), inside, low, high, distinct, initials[:1], initials[-1:])

        yield from _batches(run(), coded_of)

    coded = stage(known.mapInArrow(encode, coded_of), "conversation-codes")

    # Costs at the checkpoints: from the last segment of a conversation backward.
    def backward(rows: Iterator[tuple]) -> Iterator[tuple]:
        def vectors(name, held: Iterator[tuple]) -> Iterator[tuple]:
            rest, last = _open(list(END)), True
            for at, matrix in reversed(list(held)):
                yield name, at, list(rest), int(last)
                rest = tuple(min(min(matrix[4 * q + e] + rest[e] for e in _STATES), _FAR) for q in _STATES)
                last = False
            yield name, -1, list(rest), 0

        yield from _groups(rows, vectors)

    checkpoints = stage(_by_conversation(coded.select("conv", "at", "matrix"), backward, f"conv {kind}, at long, rest array<long>, last int"), "checkpoints")

    # Where each segment's walk leads from each state, and from these the state in which it begins.
    leads_of = f"conv {kind}, at long, leads array<long>"

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(((name, at, [walk(codes, tuple(rest), q, False)[1] for q in _STATES]) for batch in batches
                             for name, at, codes, rest in zip(*(c.to_pylist() for c in batch.columns))), leads_of)

    def forward(rows: Iterator[tuple]) -> Iterator[tuple]:
        def states(name, held: Iterator[tuple]) -> Iterator[tuple]:
            state = _EMPTY
            for at, leads in held:
                yield name, at, state
                state = leads[state]

        yield from _groups(rows, states)

    marked = _with(coded.select("conv", "at", "codes"), checkpoints)
    leads = marked.select("conv", "at", "codes", "rest").mapInArrow(lead, leads_of)
    starts = stage(_by_conversation(leads, forward, f"conv {kind}, at long, start long"), "starts")

    walked_of = f"conv {kind}, at long, audit string, left binary"

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run() -> Iterator[tuple]:
            for batch in batches:
                for name, at, codes, rest, last, start, packed in zip(*(c.to_pylist() for c in batch.columns)):
                    audit = walk(codes, tuple(rest), start, bool(last))[0]
                    body = "\n".join(repaired(audit, _unpacked(packed), start))
                    yield name, at, audit, zstandard.ZstdCompressor(level=1).compress((body + "\n").encode()) if audit.strip("D") else None

        yield from _batches(run(), walked_of)

    begun = _with(_with(marked, starts), segments.select("conv", "at", "packed"))
    walked = begun.select("conv", "at", "codes", "rest", "last", "start", "packed").mapInArrow(edit, walked_of)
    least = checkpoints.where("at = -1").select("conv", F.element_at("rest", 1).alias("cost"))
    facts = coded.select("conv", "at", "blank", "duplicate", "truncated", "inside", "low", "high", "distinct", "head", "tail")
    facts = _with(_with(facts, walked), least, ("conv",))

    def finish(rows: Iterator[tuple]) -> Iterator[tuple]:
        def one(name, held: Iterator[tuple]) -> Iterator[tuple]:
            total, illegal, low, high, distinct, tail, audit, cost = [0, 0, 0], 0, None, None, 0, "", [], 0
            digest, un, begun = hashlib.sha256(), zstandard.ZstdDecompressor(), False
            for _, *faults, inside, low_, high_, distinct_, head, tail_, audit_, left, cost in held:
                total = [a + b for a, b in zip(total, faults)]
                illegal += inside + (bool(tail and head) and tail + head not in _LEGAL)
                if low_ is not None:
                    distinct += distinct_ - (high == low_)
                    low, high = low_ if low is None else low, high_
                tail = tail_ or tail
                audit.append(audit_)
                if left is not None:
                    body = un.decompress(left, max_output_size=0)
                    digest.update((b"\n" if begun else b"") + body[:-1])
                    begun = True
            yield (name, 0 if low is None else high - low + 1 - distinct, *total, illegal, cost, "".join(audit), digest.hexdigest())

        yield from _groups(rows, one)

    return _by_conversation(facts, finish, f"conv {kind}, {_RESULT}")


def _with(left: DataFrame, right: DataFrame, on: tuple[str, ...] = ("conv", "at"), how: str = "inner") -> DataFrame:
    """``left`` and the further columns of ``right``; a missing conversation equals a missing one."""
    other = right.withColumnsRenamed({c: f"__{c}" for c in on})
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return left.join(other, condition, how).drop(*[f"__{c}" for c in on])


def _groups(rows: Iterator[tuple], run) -> Iterator[tuple]:
    """``run`` with the name of each conversation and its further columns, as they come."""
    for name, group in groupby(rows, key=lambda r: r[0]):
        yield from run(name, (r[1:] for r in group))


def _unpacked(packed: bytes) -> list[tuple[str, str]]:
    body = zstandard.ZstdDecompressor().decompress(packed, max_output_size=0).decode()
    rows, at = [], 0
    while at < len(body):
        a = body.index(" ", at)
        b = body.index(" ", a + 1)
        role, text = int(body[at:a]), int(body[a + 1 : b])
        rows.append((body[b + 1 : b + 1 + role], body[b + 1 + role : b + 1 + role + text]))
        at = b + 1 + role + text
    return rows


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with one fault in four of them, by a checksum of conversation and turn; ``copies`` counts a row 0, 1 or 2 times."""
    space = F.lit(" ")
    where = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fate = F.crc32(where.cast("binary")) % 20
    text: Column = F.coalesce("text", space)
    return conversations.select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return repair_conversations(rows, copies="copies")
