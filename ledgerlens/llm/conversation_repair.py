"""Repair of conversation structure by the method of the four Russians.

A repaired conversation has the role initials ``(s?(ua)+)?``.  The rows of a conversation are a string of symbols (must go;
else class of its role and whether it is truncated) and the cheapest edits are a shortest path through the states below.  A
cost vector holds the cost from each state to the end.  Less its least entry there are only a few dozen of them, so for
every block of ``BLOCK`` symbols and every such vector the vector before the block and the cost are tabulated once.  Costs
run from the last block to the first by lookup; the trace then goes forward and expands one block at a time: the vectors
inside it, backward from its end, tell which edits are cheapest, and of those the least letter is taken.

Conversations are not gathered.  Rows are range-partitioned by conversation and order, so one conversation may fill many
partitions.  The part of it in one partition is a function on the tabulated vectors, composed by the same lookups; two such
functions a partition meet on the driver, which hands back the vector at each border and then the state at each border.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, cut

BLOCK = 3
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Role that must follow a state, as the state after it.
FOLLOWS = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Symbols: 0 must go, 1 + 2 * class + truncated, and one that stands for no row and fills the last block.
CLASSES = ("s", "u", "a", "")
MUST_GO, NO_ROW = 0, 9
SYMBOLS = 10
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
FAULTS = (None, "blank", "duplicate", "truncated")
#: Rows one output batch holds, and characters of a text piece.
BATCH, PIECE = 2048, 1 << 20


def _moves(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state after it) of the edits that take a row, in the order of their letters."""
    moves = [("D", DELETE, state)]
    if symbol != MUST_GO:
        kind, truncated = divmod(symbol - 1, 2)
        fits = (kind == 1 and FOLLOWS[state] == USER) or (kind == 2 and FOLLOWS[state] == ASSISTANT)
        if fits:
            moves.append(("K", truncated * TRUNCATED, FOLLOWS[state]))
        elif kind == 0 and state == START:
            moves.append(("K", truncated * TRUNCATED, SYSTEM))
        moves.append(("R", REROLE + truncated * TRUNCATED, FOLLOWS[state]))
    return moves


def _with_inserts(vector: list[int]) -> tuple[int, ...]:
    """Costs if turns may be inserted first; a second one is the most that can pay."""
    for _ in range(2):
        vector = [min(c, INSERT + vector[FOLLOWS[q]]) for q, c in enumerate(vector)]
    return tuple(vector)


#: Costs at the end of a conversation: it may stop in START and ASSISTANT.
END = _with_inserts([0, 99, 99, 0])


def before(symbol: int, vector: tuple[int, ...]) -> tuple[int, ...]:
    """The cost vector in front of a row from the one behind it."""
    if symbol == NO_ROW:
        return vector
    return _with_inserts([min(cost + vector[after] for _, cost, after in _moves(symbol, q)) for q in range(4)])


class Tables:
    """All cost vectors that occur, and for each symbol and each block of symbols what it makes of them."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.vectors, self.number = [], {}
        self._add(END)
        one, at = [], 0
        while at < len(self.vectors):
            row = []
            for s in range(SYMBOLS):
                v = before(s, self.vectors[at])
                row.append((self._add(v), min(v)))
            one.append(row)
            at += 1
        step = np.array(one, np.int64)  # vector, symbol, (vector before, cost)
        self.end = self.number[END]
        after, cost = np.arange(at)[:, None], np.zeros((at, 1), np.int64)
        for _ in range(block):  # a symbol more in front: block number = symbols as digits, the first one highest
            after, cost = (np.moveaxis(x, 2, 1).reshape(at, -1) for x in (step[after, :, 0], cost[..., None] + step[after, :, 1]))
        self.after, self.cost = after.tolist(), cost.tolist()

    def _add(self, vector: tuple[int, ...]) -> int:
        low = min(vector)
        key = tuple(c - low for c in vector)
        if key not in self.number:
            self.number[key] = len(self.vectors)
            self.vectors.append(key)
        return self.number[key]

    def blocks(self, symbols: bytes) -> list[int]:
        """Numbers of the blocks of a string of symbols, the last one filled."""
        padded = np.frombuffer(symbols + bytes([NO_ROW]) * (-len(symbols) % self.block), np.uint8).reshape(-1, self.block)
        return (padded @ (SYMBOLS ** np.arange(self.block - 1, -1, -1))).tolist() if len(padded) else []

    def through(self, symbols: bytes) -> list[int]:
        """For each vector behind a string of symbols the vector in front of it."""
        found = list(range(len(self.vectors)))
        for b in reversed(self.blocks(symbols)):
            found = [self.after[v][b] for v in found]
        return found

    def costs(self, symbols: bytes, end: int) -> tuple[list[int], int]:
        """Vectors behind each block, given the one behind all, and the cost taken off the one in front."""
        numbers, total = self.blocks(symbols), 0
        behind = [end] * len(numbers)
        v = end
        for k in range(len(numbers) - 1, -1, -1):
            behind[k] = v
            total += self.cost[v][numbers[k]]
            v = self.after[v][numbers[k]]
        return behind, total

    def trace(self, symbols: bytes, end: int, state: int, closes: bool) -> Iterator[tuple[str, int, int, int]]:
        """(letter, row or -1, state after, cost) of the cheapest edits from ``state`` on, ties by the least letter.

        ``closes``: the conversation ends here.  Else what is inserted behind the last row belongs to the next part.
        """
        behind, _ = self.costs(symbols, end)
        for k, v in enumerate(behind):
            part = symbols[k * self.block : (k + 1) * self.block]
            vectors = [self.vectors[v]]
            for s in reversed(part):
                vectors.append(before(s, vectors[-1]))
            vectors.reverse()
            for j, s in enumerate(part):
                row = k * self.block + j
                while True:
                    best, moves = vectors[j][state], _moves(s, state)
                    if moves[0][1] + vectors[j + 1][state] != best and INSERT + vectors[j][FOLLOWS[state]] == best:
                        state = FOLLOWS[state]
                        yield "I", -1, state, INSERT
                        continue
                    letter, cost, state = next(m for m in moves if m[1] + vectors[j + 1][m[2]] == best)
                    yield letter, row, state, cost
                    break
        while closes and END[state]:
            state = FOLLOWS[state]
            yield "I", -1, state, INSERT


def described(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with ``key`` (of conversation, role and text), ``fault`` and ``symbol`` but for duplicates; nulls of role and text are one space."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit(" ")), F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    named = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    kind = sum((F.when(F.left("role", F.lit(1)) == c, k - 3).otherwise(0) for k, c in enumerate(CLASSES[:3])), F.lit(3))
    cut_off = ~last.isin(".", "!", "?")
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    return named.select(
        "*",
        F.md5(F.concat_ws(":", F.length(conv), F.length("role"), conv, F.col("role"), F.col("text")).cast("binary")).alias("key"),
        F.when(last == "", 1).when(cut_off, 3).otherwise(0).alias("fault"),
        F.when(last == "", MUST_GO).otherwise(1 + 2 * kind + cut_off.cast("int")).alias("symbol"),
    )


def _order() -> list[Column]:
    # a common prefix of long texts is enough to split by; equal rows may lie in any order, so they may be split anywhere
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.left("text", F.lit(64)), F.col("_spread")]


def ordered(rows: DataFrame) -> DataFrame:
    """Described rows in their order, range-partitioned, with later copies of a role and text marked.

    A copy at the same turn as the first one is equal to it in all columns and lies beside it: ``parts`` marks those.
    """
    turn = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)))
    copies = rows.groupBy("key").agg(F.min(turn).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    later = (F.col("_first").isNotNull() & (turn > F.col("_first"))) & (F.col("fault") != 1)
    marked = rows.join(copies, "key", "left").withColumns({
        "fault": F.when(later, 2).otherwise(F.col("fault")).cast("int"), "symbol": F.when(later, MUST_GO).otherwise(F.col("symbol")).cast("int"),
        "_spread": F.monotonically_increasing_id(),
    })
    within = [*_order()[:3], F.col("text")]
    return cut(marked.drop("_first").repartitionByRange(*_order()).drop("_spread").sortWithinPartitions(*within), clear=True)


COLUMNS = ("conv_id", "turn", "role", "text", "key", "fault", "symbol")


def _runs(batches: Iterator[pa.RecordBatch], light: bool, carried: tuple | None) -> Iterator[tuple[object, list]]:
    """The rows of each conversation in a partition, [turn, role, text, fault, symbol, is it a copy of the row before].

    ``carried``: conversation, turn and key of the row before the partition.  ``light``: without texts.
    """
    conv, rows, last = None, None, carried
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in COLUMNS if not (light and c == "text")]
        if light:
            columns.insert(3, [None] * batch.num_rows)
        for c, turn, role, text, key, fault, symbol in zip(*columns):
            if rows is None or c != conv:
                if rows is not None:
                    yield conv, rows
                conv, rows = c, []
            copy = last == (c, turn, key)
            last = (c, turn, key)
            if copy and fault != 1:
                fault, symbol = 2, MUST_GO
            rows.append([turn, role, text, fault, symbol])
    if rows is not None:
        yield conv, rows


def _borders(dealt: DataFrame) -> list:
    """First and last conversation of every partition with rows, in order, and what the next one must know of its last row."""
    kind = dealt.schema["conv_id"].dataType
    schema = T.StructType([
        T.StructField("part", T.LongType()), T.StructField("first", kind), T.StructField("last", kind),
        T.StructField("turn", T.LongType()), T.StructField("key", T.StringType()), T.StructField("role", T.StringType()),
    ])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            if batch.num_rows:
                first = batch.slice(0, 1) if first is None else first
                last = batch.slice(batch.num_rows - 1)
        if first is not None:
            part = pa.array([TaskContext.get().partitionId()], pa.int64())
            columns = [part, first.column("conv_id"), *(last.column(c) for c in ("conv_id", "turn", "key", "role"))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "first", "last", "turn", "key", "role"])

    return sorted(dealt.mapInArrow(ends, schema).collect(), key=lambda r: r.part)


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Cheapest edits of every conversation, one row each, in order within its partitions: ``conv_id``, ``part``, ``edit``
    (K, R, D, I), ``cost``, ``turn``, ``role`` and ``new_role`` (null: none), ``text``, ``fault``, ``illegal`` (does its
    role not follow that of the row before), ``new_turn`` (first row of its turn), ``whole`` (is the conversation all in this
    partition).

    Rows are taken by turn, nulls first, then role and text.  Null roles and texts are one space.  The first fault of a row
    counts: ``blank``, ``duplicate`` (role and text seen before), ``truncated``.  Repeated rows are duplicates, an empty table
    gives an empty one, rows with a null conversation are one conversation, columns besides the four are left out.
    """
    dealt = ordered(described(rows, conv_col, turn_col, role_col, text_col))
    borders = _borders(dealt)
    before_of = {b.part: a for a, b in zip(borders, borders[1:])}
    # parts whose first conversation began earlier, and whose last one goes on
    joined = {b.part for a, b in zip(borders, borders[1:]) if a.last == b.first}
    goes_on = {a.part for a, b in zip(borders, borders[1:]) if a.last == b.first}
    carried = {p: (a.last, a.turn, a.key) for p, a in before_of.items()}
    tables = Tables()

    def open_runs(batches, part):
        """Symbols of the first run if it began earlier and of the last if it goes on; both may be the same."""
        held = None
        for k, (_, run) in enumerate(_runs(batches, True, carried.get(part))):
            if held is not None and held[0] == 0 and part in joined:
                yield True, False, held[1]
            held = (k, bytes(r[4] for r in run))
        if held is not None and (part in goes_on or held[0] == 0 and part in joined):
            yield held[0] == 0 and part in joined, part in goes_on, held[1]

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        if part in joined or part in goes_on:
            for began, more, symbols in open_runs(batches, part):
                yield pa.RecordBatch.from_pylist([{"part": part, "began": began, "more": more, "through": tables.through(symbols)}])

    light = dealt.drop("text")
    found = {(r.part, r.more): (r.began, r.through) for r in light.mapInArrow(functions, "part long, began boolean, more boolean, through array<long>").collect()} if joined else {}
    end_of, v = {}, tables.end  # (part, does it go on): vector behind the part of a conversation
    for part, more in sorted(found, reverse=True):
        v = v if more else tables.end
        end_of[part, more] = v
        v = found[part, more][1][v]

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        if part in goes_on:
            for began, more, symbols in open_runs(batches, part):
                if more:
                    last = []
                    for state in range(4) if began else [START]:
                        for _, _, state, _ in tables.trace(symbols, end_of[part, True], state, False):
                            pass
                        last.append(state)
                    yield pa.RecordBatch.from_pylist([{"part": part, "began": began, "last": last}])

    state_of, q = {}, START  # state behind the part of a conversation that goes on
    for r in sorted(light.mapInArrow(exits, "part long, began boolean, last array<long>").collect(), key=lambda r: r.part) if joined else []:
        q = r.last[q] if r.began else r.last[0]
        state_of[r.part] = q
    nexts = [p.part for p in borders]
    enters = {b: state_of[a] for a, b in zip(nexts, nexts[1:]) if b in joined}
    role_before = {p: a.role for p, a in before_of.items()}

    kind = dealt.schema["conv_id"].dataType
    names = "part edit cost turn role new_role text fault illegal new_turn whole".split()
    kinds = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), *[T.StringType()] * 4, T.BooleanType(), T.BooleanType(), T.BooleanType()]
    schema = T.StructType([T.StructField("conv_id", kind), *map(T.StructField, names, kinds)])

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, conv_type = TaskContext.get().partitionId(), [], None

        def flush():
            columns = list(zip(*out))
            types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.bool_(), pa.bool_(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["conv_id", *names])

        def watched():
            nonlocal conv_type
            for batch in batches:
                conv_type = batch.schema.field("conv_id").type
                yield batch

        runs = _runs(watched(), False, carried.get(part))
        run = next(runs, None)
        first = True
        while run is not None:
            following = next(runs, None)
            conv, rows = run
            began, more = first and part in joined, following is None and part in goes_on
            symbols = bytes(r[4] for r in rows)
            end = end_of[part, True] if more else tables.end
            turn_before, role, whole = (carried[part][1], role_before[part], False) if began else (None, None, not more)
            known = began
            for letter, row, state, cost in tables.trace(symbols, end, enters[part] if began else START, not more):
                if row < 0:
                    out.append((conv, part, "I", cost, None, None, ROLE[state], "", None, False, False, whole))
                else:
                    turn, was, text, fault, _ = rows[row]
                    illegal = known and (role or "")[:1] + was[:1] not in ("su", "ua", "au")
                    fresh = turn is not None and not (known and turn == turn_before)
                    new = None if letter == "D" else ROLE[state] if letter == "R" else was
                    out.append((conv, part, letter, cost, turn, was, new, text, FAULTS[fault], illegal, fresh, whole))
                    turn_before, role, known = turn, was, True
                    rows[row] = None  # texts go as soon as they are written
                if len(out) >= BATCH:
                    yield flush()
                    out = []
            first, run = False, following
        if out:
            yield flush()

    return dealt.mapInArrow(edit, schema)


COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost", "turns")
PIECES = [("part", T.LongType()), ("chunk", T.LongType()), ("low", T.LongType()), ("high", T.LongType()), *((c, T.LongType()) for c in COUNTS),
          ("audit", T.StringType()), ("text", T.StringType()), ("sha", T.StringType())]


def summaries(edits: DataFrame, rows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation of ``rows``: ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``
    (edits in order) and ``repaired_sha256`` (``role:text`` of the repaired turns, joined by newlines).

    A conversation inside one partition is summed up there.  Of others pieces of bounded length go to one task, which streams
    them: a digest reads its input in order.  Conversations without edits have zeros and empty results.
    """
    kind = edits.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), *(T.StructField(n, t) for n, t in PIECES)])
    names = schema.fieldNames()
    types = [pa.int64()] * (4 + len(COUNTS)) + [pa.string()] * 3

    def batch_of(rows: list, conv_type: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [conv_type, *types])], names=names)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out, chunk, conv_type, size = None, [], 0, None, 0
        low = high = None
        sums, audit, texts, digest, begun = [0] * len(COUNTS), [], [], None, False

        def close(last: bool):
            nonlocal low, high, sums, audit, texts, chunk, size
            conv, part, whole = key
            joined, sha = "".join(texts), None
            if whole:
                digest.update(joined.encode())
                joined, sha = None, digest.hexdigest() if last else None
            out.append((conv, part, chunk, low, high, *sums, "".join(audit), joined, sha))
            low, high, sums, audit, texts, size = None, None, [0] * len(COUNTS), [], [], 0
            chunk += 1

        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "part", "whole", "edit", "cost", "turn", "new_role", "text", "fault", "illegal", "new_turn")]
            for conv, part, whole, letter, cost, turn, role, text, fault, illegal, fresh in zip(*columns):
                if key != (conv, part, whole):
                    if key is not None:
                        close(True)
                    key, chunk, digest, begun = (conv, part, whole), 0, hashlib.sha256(), False
                for k, add in enumerate((fault == "blank", fault == "duplicate", fault == "truncated", illegal, cost, fresh)):
                    sums[k] += int(add)
                if turn is not None:
                    low, high = turn if low is None else low, turn
                audit.append(letter)
                if role is not None:
                    # parts of an open conversation are joined later: every turn of theirs ends with a newline, the last one goes then
                    line = f"{role}:{text}"
                    texts.append(f"\n{line}" if whole and begun else line if whole else f"{line}\n")
                    begun, size = True, size + len(line)
                if size > PIECE:
                    close(False)
            if len(out) >= BATCH:
                yield batch_of(out, conv_type)
                out = []
        if key is not None:
            close(True)
            yield batch_of(out, conv_type)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, out = None, None, []

        def close():
            low, high, sums, audit, digest, held, sha = state
            gaps = 0 if low is None else high - low + 1 - sums[5]
            out.append((conv, gaps, *sums[:5], "".join(audit), sha or digest.hexdigest()))

        def batch_out():
            kinds = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["conv_id", "gaps", *COUNTS[:5], "audit", "repaired_sha256"])

        conv_type = None
        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for row in zip(*(batch.column(n).to_pylist() for n in names)):
                c, _, _, low, high, *sums, audit, text, sha = row
                if state is None or c != conv:
                    if state is not None:
                        close()
                    conv, state = c, [None, None, [0] * len(COUNTS), [], hashlib.sha256(), "", None]
                if low is not None:
                    state[0] = low if state[0] is None else min(state[0], low)
                    state[1] = high if state[1] is None else max(state[1], high)
                state[2] = [a + b for a, b in zip(state[2], sums)]
                state[3].append(audit)
                state[6] = sha or state[6]
                if text:
                    # the newline behind a turn waits until another turn follows
                    state[4].update((state[5] + text[:-1]).encode() if text.endswith("\n") else (state[5] + text).encode())
                    state[5] = "\n" if text.endswith("\n") else ""
            if len(out) >= BATCH:
                yield batch_out()
                out = []
        if state is not None:
            close()
            yield batch_out()

    all_convs = rows.select(F.col(conv_col).alias("conv_id")).distinct()
    zero = {n: F.lit(0 if n in COUNTS else -1 if n in ("part", "chunk") else "" if n == "audit" else None).cast(t) for n, t in PIECES}
    found = edits.mapInArrow(pieces, schema).unionByName(all_convs.select("conv_id", *[c.alias(n) for n, c in zero.items()]))
    parts = int(edits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    result = T.StructType([T.StructField("conv_id", kind), *(T.StructField(n, T.LongType()) for n in ("gaps", *COUNTS[:5])), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    return found.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part", "chunk").mapInArrow(joined, result)


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` with known damage, dealt by the crc32 of ``conv_id:turn`` modulo 20 (nulls: one space): 0 drops the
    row, 1 empties its text, 2 removes its full stops, 3 repeats it, 4 makes it a user's."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(text["conv_id"], F.lit(":"), text["turn"]).cast("binary")) % 20
    hit = rows.select("conv_id", "turn", text["role"].alias("role"), text["text"].alias("text"), kind.alias("_kind")).where("_kind <> 0")
    changed = hit.select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("_kind") == 3, 2).otherwise(1).alias("_copies"),
    )
    return changed.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).drop("_copy")
