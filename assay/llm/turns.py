"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate.

The initials of a repaired conversation's roles match `(s?(ua)+)?`, that is, they lead through four states:
0 nothing yet (may end), 1 after `s`, 2 after `u`, 3 after `a` (may end). In order of rows, a row is kept (K),
given another role (R) or deleted (D), and rows without text are inserted (I) anywhere. From a state, each of
these leads to one state only, so the letters alone tell what was done.

Hirschberg's divide and conquer finds the letters in memory of a few numbers a level: the costs of reaching
each state mid-conversation (forward) and of finishing from it (backward) meet there; the states whose sum is
least are the optimal crossings. The first half is then solved with those crossings' backward costs, which
settles on the one whose letters come first in ASCII order, and the second half from there.

A long conversation is cut into blocks by its turns (1,024 numbers each), and costs pass between them
as 4 x 4 tables and vectors: every block is solved in a task of its own from each state it may be entered in,
and the last pass only follows the chain of states, while it hashes the texts in order. That pass streams:
no task holds a conversation, except for what its result row holds, the letters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.frames import sliced, written

# Blocks are of 2 ** BLOCK_BITS turn numbers.
BLOCK_BITS = 10
HEAD = 48
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
ENDS = ".!?"
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
NEVER = 1 << 60
STATES = range(4)
# The state that an inserted or a re-roled row leads to: `u` from 0, 1 and 3, `a` from 2.
NEXT = (2, 2, 3, 2)
# The state that a kept row of role s, u, a or another leads to, by the state before it.
KEEP = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
# Costs and letters of finishing after the last row.
FINISH = (0, 2 * INSERT, INSERT, 0)
TAIL = ("", "II", "I", "")
# A row's code: its role's initial in two bits, then whether it must go and whether it is cut short.
MUST_GO, IS_CUT = 4, 8


def _back_row(code: int, after: tuple) -> list[int]:
    """Costs of a row and all that follows it, without insertions before the row."""
    out = [DELETE + after[s] for s in STATES]
    if not code & MUST_GO:
        extra = CUT if code & IS_CUT else 0
        keep = KEEP[code & 3]
        for s in STATES:
            out[s] = min(out[s], REROLE + extra + after[NEXT[s]], extra + after[keep[s]] if s in keep else NEVER)
    return out


def _inserting(row: list[int]) -> tuple:
    """Costs from each state where rows may be inserted first. Two at most are of use."""
    return tuple(
        min(row[s], INSERT + row[NEXT[s]], 2 * INSERT + row[NEXT[NEXT[s]]]) for s in STATES
    )


def backward(codes: bytes, low: int, high: int, after: tuple) -> tuple:
    """Least costs from each state before row `low`, given those before row `high`."""
    for n in range(high - 1, low - 1, -1):
        after = _inserting(_back_row(codes[n], after))
    return after


def forward(codes: bytes, low: int, high: int, state: int) -> list[int]:
    """Least costs of each state right after row `high - 1`, from `state` before row `low`."""
    costs = [NEVER] * 4
    costs[state] = 0
    for n in range(low, high):
        a, b, c, d = costs
        opened = (a, b, min(c, INSERT + a, INSERT + b, INSERT + d), min(d, INSERT + c, 2 * INSERT + a, 2 * INSERT + b))
        code = codes[n]
        costs = [DELETE + x for x in opened]
        if not code & MUST_GO:
            extra = CUT if code & IS_CUT else 0
            keep = KEEP[code & 3]
            for s in STATES:
                costs[NEXT[s]] = min(costs[NEXT[s]], REROLE + extra + opened[s])
                if s in keep:
                    costs[keep[s]] = min(costs[keep[s]], extra + opened[s])
    return costs


def _one(code: int, state: int, after: tuple) -> tuple[str, int]:
    """Letters of one row with the insertions before it, and the state after it."""
    row, letters = _back_row(code, after), ""
    left = _inserting(row)[state]
    while True:
        if DELETE + after[state] == left:
            return letters + "D", state
        if INSERT + _inserting(row)[NEXT[state]] == left:
            letters, state, left = letters + "I", NEXT[state], left - INSERT
            continue
        keep = KEEP[code & 3].get(state)
        extra = CUT if code & IS_CUT else 0
        if keep is not None and extra + after[keep] == left:
            return letters + "K", keep
        return letters + "R", NEXT[state]


def solve(codes: bytes, low: int, high: int, state: int, after: tuple, out: list[str]) -> int:
    """Append the letters of rows `low` to `high - 1` to `out`; returns the state after them.

    `after` holds the cost of finishing from each state before row `high`. Of the cheapest letters those
    first in ASCII order are taken.
    """
    if high - low == 1:
        letters, state = _one(codes[low], state, after)
        out.append(letters)
        return state
    if high == low:
        return state
    middle = (low + high) // 2
    reach, finish = forward(codes, low, middle, state), backward(codes, middle, high, after)
    least = min(r + f for r, f in zip(reach, finish))
    crossings = tuple(f if r + f == least else NEVER for r, f in zip(reach, finish))
    crossed = solve(codes, low, middle, state, crossings, out)
    return solve(codes, middle, high, crossed, after, out)


@lru_cache(1 << 16)
def block_costs(codes: bytes) -> list[int]:
    """Least cost between the states before and after a block, row by row of the 4 x 4 table."""
    ends = [tuple(0 if s == end else NEVER for s in STATES) for end in STATES]
    columns = [backward(codes, 0, len(codes), end) for end in ends]
    return [min(columns[end][start], NEVER) for start in STATES for end in STATES]


def before_block(costs: list[int], after: tuple) -> tuple:
    return tuple(min(costs[4 * s + e] + after[e] for e in STATES) for s in STATES)


@lru_cache(1 << 16)
def block_letters(codes: bytes, after: tuple) -> tuple[list[str], list[int]]:
    """Letters of a block and the state after it, for each state that it may be entered in."""
    letters, ends = [], []
    for state in STATES:
        found: list[str] = []
        ends.append(solve(codes, 0, len(codes), state, after, found))
        letters.append("".join(found))
    return letters, ends


def damaged(
    conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    kinds: int = 20,
) -> DataFrame:
    """Conversations with planted faults, by the checksum of `key:turn` modulo `kinds`.

    0 drops the row, 1 empties its text, 2 takes its `.!?` out, 3 repeats it, 4 sets the role user. A null
    stands for one space in the checksum, the role and the text. Columns: `conv`, `turn`, `role`, `text`
    and `there`: a dropped row stays with `there` false, so that its conversation is not lost.
    """
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col(key).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))
    rows = conversations.select(
        F.col(key).alias("conv"), F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"),
        (F.crc32(name.cast("binary")) % kinds).alias("kind"),
    )
    kind = F.col("kind")
    times = F.when(kind == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(kind != 0))
    return rows.select(
        "conv", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text"),
        F.explode(times).alias("there"),
    )


def _block(bits: int) -> Column:
    """A block's number by its turns; rows without a turn come first."""
    return F.coalesce(F.shiftright("turn", bits), F.lit(-(2**63)))


def _marked(rows: DataFrame) -> DataFrame:
    """Rows without their texts: order within a turn (`head`, `mark`), initial and first fault."""
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    whole = F.right(bare, F.lit(1)).isin(*ENDS)
    narrow = rows.select(
        "conv", "turn", "role", F.substring("text", 1, HEAD).alias("head"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("mark"),
        (bare == "").alias("is_blank"), (~whole).alias("open"), "there",
    )
    earlier = Window.partitionBy("conv", "role", "mark").orderBy(F.col("there").desc(), F.col("turn").asc_nulls_first())
    repeat = F.row_number().over(earlier) > 1
    fault = (
        F.when(~F.col("there"), "absent").when(F.col("is_blank"), "blank").when(repeat, "duplicate")
        .when(F.col("open"), "truncated").otherwise("")
    )
    return narrow.withColumn("fault", fault).drop("is_blank", "open", "there")


COUNTS = ("n_rows", "n_turns", "blank", "duplicate", "truncated", "illegal")
LEGAL = ("su", "ua", "au")


class _Block:
    """What a block's rows add up to, taken in order."""

    def __init__(self, conv, block):
        self.conv, self.block, self.codes = conv, block, bytearray()
        self.counts = dict.fromkeys(COUNTS, 0)
        self.low = self.high = None
        self.first = self.last = None

    def add(self, turn, initial: str, fault: str) -> None:
        if fault == "absent":
            return
        self.counts["n_rows"] += 1
        if fault:
            self.counts[fault] += 1
        if turn is not None:
            self.counts["n_turns"] += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.last is None:
            self.first = initial
        else:
            self.counts["illegal"] += self.last + initial not in LEGAL
        self.last = initial
        code = "sua".find(initial) if initial else 3
        self.codes.append((code if code >= 0 else 3) | (MUST_GO if fault in ("blank", "duplicate") else 0) | (IS_CUT if fault == "truncated" else 0))


BLOCK_FIELDS = "block bigint, codes binary, costs array<bigint>, low bigint, high bigint, first string, last string, " + ", ".join(
    f"{c} bigint" for c in COUNTS
)


def _blocks(marked: DataFrame, bits: int) -> DataFrame:
    """One row per conversation and block: its rows' codes, table of costs, and counts."""
    conv_type = marked.schema["conv"].dataType.simpleString()

    def out(blocks: list[_Block], kind: pa.DataType) -> pa.RecordBatch:
        columns = [
            pa.array([b.conv for b in blocks], kind), pa.array([b.block for b in blocks], pa.int64()),
            pa.array([bytes(b.codes) for b in blocks], pa.binary()),
            pa.array([block_costs(bytes(b.codes)) for b in blocks], pa.list_(pa.int64())),
            *[pa.array([getattr(b, c) for b in blocks], pa.int64()) for c in ("low", "high")],
            *[pa.array([getattr(b, c) for b in blocks], pa.string()) for c in ("first", "last")],
            *[pa.array([b.counts[c] for b in blocks], pa.int64()) for c in COUNTS],
        ]
        return pa.RecordBatch.from_arrays(columns, names=["conv", "block", "codes", "costs", "low", "high", "first", "last", *COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done, kind = None, [], None
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, block, turn, initial, fault in zip(*[c.to_pylist() for c in batch.columns]):
                if held is None or (held.conv, held.block) != (conv, block):
                    if held:
                        done.append(held)
                    held = _Block(conv, block)
                held.add(turn, initial, fault)
            if len(done) >= 4096:
                yield out(done, kind)
                done = []
        if held:
            yield out([*done, held], kind)

    order = ["conv", "block", F.col("turn").asc_nulls_first(), "role", "head", "mark"]
    sorted_rows = marked.withColumn("block", _block(bits)).repartition("conv", "block").sortWithinPartitions(*order)
    narrow = sorted_rows.select("conv", "block", "turn", F.substring("role", 1, 1), "fault")
    return narrow.mapInArrow(run, f"conv {conv_type}, {BLOCK_FIELDS}")


def _solved(blocks: DataFrame) -> DataFrame:
    """Blocks with `ahead`, the cost of finishing after them, then with letters and ends for each entry state."""
    names = blocks.columns

    def costs_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Blocks of a conversation come last first.
        conv, ahead, any_yet = None, FINISH, False
        for batch in batches:
            found = []
            for of, costs in zip(batch.column(0).to_pylist(), batch.column(names.index("costs")).to_pylist()):
                if not any_yet or of != conv:
                    conv, ahead, any_yet = of, FINISH, True
                found.append(list(ahead))
                ahead = before_block(costs, ahead)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], names=[*names, "ahead"])

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, ahead = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("codes", "ahead"))
            found = [block_letters(c, tuple(a)) for c, a in zip(codes, ahead)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.list_(pa.string())), pa.array([f[1] for f in found], pa.list_(pa.int64()))],
                names=[*names, "ahead", "letters", "ends"],
            )

    last_first = blocks.repartition("conv").sortWithinPartitions("conv", F.col("block").desc())
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema)
    ahead = last_first.mapInArrow(costs_back, f"{ddl}, ahead array<bigint>")
    return ahead.repartition("conv", "block").mapInArrow(letters, f"{ddl}, ahead array<bigint>, letters array<string>, ends array<bigint>")


class _Conversation:
    """Follows a conversation through its blocks and rows."""

    def __init__(self, conv):
        self.conv, self.state, self.letters, self.left = conv, 0, [], iter("")
        self.counts = dict.fromkeys(COUNTS, 0)
        self.low = self.high = self.last = self.cost = None
        self.sha, self.any_line = hashlib.sha256(), False

    def block(self, row: dict) -> None:
        self.rest()
        for c in COUNTS:
            self.counts[c] += row[c]
        if row["low"] is not None:
            self.low, self.high = row["low"] if self.low is None else self.low, row["high"]
        if row["n_rows"]:
            if self.last is not None:
                self.counts["illegal"] += self.last + row["first"] not in LEGAL
            self.last = row["last"]
        if self.cost is None:
            self.cost = before_block(row["costs"], tuple(row["ahead"]))[0]
        letters = row["letters"][self.state]
        self.letters.append(letters)
        self.left, self.at, self.state = iter(letters), self.state, row["ends"][self.state]

    def line(self, role: str, text: str) -> None:
        self.sha.update((f"\n{role}:{text}" if self.any_line else f"{role}:{text}").encode())
        self.any_line = True

    def _new_row(self, text: str = "") -> None:
        self.line("assistant" if self.at == 2 else "user", text)
        self.at = NEXT[self.at]

    def row(self, role: str, text: str) -> None:
        for letter in self.left:
            if letter == "I":
                self._new_row()
                continue
            if letter == "K":
                self.line(role, text)
                self.at = KEEP["sua".index(role[:1])][self.at]
            elif letter == "R":
                self._new_row(text)
            return

    def rest(self) -> None:
        """Insertions after the last row of a block."""
        for _ in self.left:
            self._new_row()

    def result(self) -> dict:
        self.rest()
        self.at = self.state
        for _ in TAIL[self.state]:
            self._new_row()
        n = self.counts
        gaps = 0 if self.low is None else self.high - self.low + 1 - n["n_turns"]
        return {
            "gaps": gaps, **{c: n[c] for c in ("blank", "duplicate", "truncated", "illegal")}, "cost": self.cost or 0,
            "audit": "".join([*self.letters, TAIL[self.state]]), "repaired_sha256": self.sha.hexdigest(),
        }


RESULT = {
    "gaps": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(),
    "cost": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string(),
}


def repair(rows: DataFrame, key: str = "conv_id", bits: int = BLOCK_BITS) -> DataFrame:
    """One row per conversation of `rows` (columns of `damaged`): faults, cheapest edits, digest of the repair.

    `key`, `gaps` in the turns, rows that are `blank`, `duplicate` (of an earlier role and text) or `truncated`
    by their first fault, `illegal` neighbours, the `cost`, `audit` (letters of the edits) and
    `repaired_sha256` of the repaired `role:text` lines. Blank and duplicate rows are deleted.

    Rows are taken by turn (null first), then by role, the text's first HEAD characters and its md5. Rows
    alike in all that are repeats. All null keys are one conversation. A conversation without rows that are
    `there` has zeros, no letters and the digest of nothing. An empty table gives an empty one. Columns of
    other names are not read.
    """
    conv_type = rows.schema["conv"].dataType.simpleString()
    solved = written(_solved(written(_blocks(_marked(rows), bits), "turn-blocks")), "turn-letters")
    block_columns = ["letters", "ends", "ahead", "costs", "low", "high", "first", "last", *COUNTS]
    heads = solved.select("conv", "block", F.struct(*block_columns).alias("b"))
    texts = rows.where("there").select(
        "conv", _block(bits).alias("block"), "turn", "role", "text", F.substring("text", 1, HEAD).alias("head"),
        F.unhex(F.md5(F.col("text").cast("binary"))).alias("mark"),
    )
    # A block's own row has no role and comes before its rows.
    order = ["conv", "block", F.col("b").isNull(), F.col("turn").asc_nulls_first(), "role", "head", "mark"]
    stream = heads.unionByName(texts, allowMissingColumns=True).repartition("conv").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done, kind = None, [], None

        def out() -> pa.RecordBatch:
            found = [(c.conv, c.result()) for c in done]
            done.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in found], kind), *[pa.array([r[n] for _, r in found], t) for n, t in RESULT.items()]],
                names=["conv", *RESULT],
            )

        for batch in sliced(batches, "text"):
            kind = batch.schema.field(0).type
            for conv, block, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if held is None or held.conv != conv:
                    if held:
                        done.append(held)
                    if len(done) >= 1024:
                        yield out()
                    held = _Conversation(conv)
                if block is not None:
                    held.block(block)
                else:
                    held.row(role, text)
        if held:
            done.append(held)
            yield out()

    kinds = {pa.int64(): "bigint", pa.string(): "string"}
    ddl = ", ".join(f"{n} {kinds[t]}" for n, t in RESULT.items())
    found = stream.select("conv", "b", "role", "text").mapInArrow(run, f"conv {conv_type}, {ddl}")
    return found.withColumnRenamed("conv", key)
