"""Cheapest repair of conversations to turns of user and assistant, by Four-Russians block tables.

A conversation is fit if its roles are an optional system turn and then pairs of user and assistant, or if it is empty.
A row becomes one of nine symbols: must go, or its role's initial (s, u, a, another) and whether its text breaks off.
The cost of repairing the rest, from each of four states (nothing yet, after s, after u, after a), is a vector; less its
least entry it is one of a few vectors. So for each vector and each block of BLOCK symbols a table holds the vector in front
of the block and what it adds. Conversations are walked from behind, a block a lookup; then a block is expanded from its
end, step by step, to trace the edits forwards: in each state the first letter among the cheapest edits, which gives the least
string of all cheapest ones.

Rows are put in order by range over (conversation, turn, ...) and cut into chunks of bounded bytes, so a long conversation
lies in many tasks. What meets for one conversation is its symbols, a byte a row, no more than its audit string, which
the result holds in one value. Repaired texts stay in chunks; a digest reads them as a stream.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from millrace.session import checkpointed, partitions_for

# Cost of the edits, and of a kept text that breaks off.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
BLANK = " \t\n\x0b\f\r"
USER, ASSISTANT = "user", "assistant"

BLOCK = 4
# Bytes of text and rows of a chunk.
CHUNK_BYTES, CHUNK_ROWS = 1 << 14, 1024

_GONE = 0  # then 1 + 2 * (place of the initial in CLASSES) + (breaks off)
CLASSES = "sua"
_SYMBOLS = 9
_START, _S, _U, _A = range(4)
# The state behind a turn that is put in or given a new role.
_NEXT = (_U, _U, _A, _U)
# The state behind a kept turn, by the initial's place in CLASSES.
_KEPT = ({_START: _S}, {_START: _U, _S: _U, _A: _U}, {_U: _A}, {})
_END = (0, 2 * INSERT, INSERT, 0)


def _moves(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state behind) of the edits that use up a row."""
    out = [("D", DELETE, state)]
    if symbol != _GONE:
        kind, cut = divmod(symbol - 1, 2)
        if state in _KEPT[kind]:
            out.append(("K", cut * TRUNCATED, _KEPT[kind][state]))
        out.append(("R", cut * TRUNCATED + REROLE, _NEXT[state]))
    return out


def _before(vector: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Costs in front of a row, from those behind it."""
    costs = [min(cost + vector[to] for _, cost, to in _moves(symbol, s)) for s in range(4)]
    for _ in range(3):
        costs = [min(costs[s], INSERT + costs[_NEXT[s]]) for s in range(4)]
    return tuple(costs)


class Tables:
    """Normalised vectors; for each and a symbol, or a block of them, the vector in front and the cost taken off."""

    def __init__(self, block: int = BLOCK):
        self.block, self.vectors = block, [_END]
        known, self.step = {_END: 0}, []
        for vector in self.vectors:
            row = []
            for symbol in range(_SYMBOLS):
                raw = _before(vector, symbol)
                least = min(raw)
                flat = tuple(c - least for c in raw)
                if flat not in known:
                    known[flat] = len(self.vectors)
                    self.vectors.append(flat)
                row.append((known[flat], least))
            self.step.append(row)
        to, cost = (np.array([[x[k] for x in row] for row in self.step]) for k in (0, 1))
        blocks = np.arange(_SYMBOLS**block)
        at, total = np.repeat(np.arange(len(self.vectors))[:, None], len(blocks), 1), np.zeros((len(self.vectors), len(blocks)), dtype=np.int64)
        for k in range(block):  # the last symbol first
            symbol = blocks // _SYMBOLS**k % _SYMBOLS
            at, total = to[at, symbol], total + cost[at, symbol]
        self.blocks = [list(zip(a, t)) for a, t in zip(at.tolist(), total.tolist())]
        self.traces: dict[tuple[int, str, int], tuple[str, int]] = {}

    def row(self, behind: int, symbol: int, state: int) -> tuple[str, int]:
        """(letters, state behind): the first of the cheapest edits in front of and at one row."""
        front, least = self.step[behind][symbol]
        letters = ""
        while True:
            # In the vector behind the row, and that in front with what was taken off, costs are comparable.
            left = self.vectors[front][state] + least
            options = [(letter, to) for letter, cost, to in _moves(symbol, state) if cost + self.vectors[behind][to] == left]
            if INSERT + self.vectors[front][_NEXT[state]] + least == left:
                options.append(("I", _NEXT[state]))
            letter, state = min(options)
            letters += letter
            if letter != "I":
                return letters, state

    def trace(self, behind: int, symbols: str, state: int) -> tuple[str, int]:
        """(letters, state behind) of a block: its vectors are made again from its end, then it is walked."""
        key = (behind, symbols, state)
        if key not in self.traces:
            inner = [behind]
            for c in reversed(symbols):
                inner.append(self.step[inner[-1]][int(c)][0])
            letters = ""
            for k, c in enumerate(symbols):
                more, state = self.row(inner[len(symbols) - 1 - k], int(c), state)
                letters += more
            self.traces[key] = letters, state
        return self.traces[key]

    def solve(self, chunks: list[str]) -> tuple[int, list[str], list[int]]:
        """(cost, letters of each chunk, state in front of each) for the symbols of one conversation, as digits."""
        at, cost, walks = 0, 0, []
        for symbols in reversed(chunks):
            whole = len(symbols) // self.block * self.block
            ends = []
            for k in reversed(range(whole, len(symbols))):
                ends.append((at, symbols[k]))
                at, more = self.step[at][int(symbols[k])]
                cost += more
            for k in range(whole - self.block, -1, -self.block):
                part = symbols[k : k + self.block]
                ends.append((at, part))
                at, more = self.blocks[at][int(part, _SYMBOLS)]
                cost += more
            walks.append(ends[::-1])
        cost += self.vectors[at][_START]
        state, letters, states = _START, [], []
        for ends in reversed(walks):
            states.append(state)
            said = []
            for behind, part in ends:
                more, state = self.trace(behind, part, state)
                said.append(more)
            letters.append("".join(said))
        if letters:
            letters[-1] += "I" * (_END[state] // INSERT)
        return cost, letters, states


def _ordered(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, role, text, copies, first, in order: equal rows as one, and whether role and text are new there."""
    said = lambda c: F.coalesce(F.col(c), F.lit(" "))
    same = ["conv", "turn", "role", "text"]
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), said(role).alias("role"), said(text).alias("text")).groupBy(*same).agg(F.count("*").alias("copies"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = rows.groupBy("conv", "role", "text").agg(F.min(place).alias("place")).select("conv", F.col("place.turn").alias("turn"), "role", "text", F.lit(0).cast("long").alias("copies"), F.lit(True).alias("first"))
    both = rows.withColumn("first", F.lit(False)).unionByName(firsts).groupBy(*same).agg(F.sum("copies").alias("copies"), F.max("first").alias("first"))
    order = ["conv", F.asc_nulls_first("turn"), "role", "text"]
    return both.repartitionByRange(partitions_for(both), *order).sortWithinPartitions(*order)


def chunks(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows of each conversation in order, in chunks: conv, part, seq (the order), symbols, counts of faults, what
    adjacent chunks must compare, and the roles, texts and copies. Stored."""
    rows = _ordered(turns, conv, turn, role, text)
    bare = F.rtrim("text", F.lit(BLANK))
    initial = F.left("role", F.lit(1))
    kind = F.when(initial != "", F.locate(CLASSES[0], initial) + 2 * F.locate(CLASSES[1], initial) + 3 * F.locate(CLASSES[2], initial)).otherwise(0)
    blank, cut = bare == "", ~F.right(bare, F.lit(1)).isin(".", "!", "?")
    # kind is 0 for another initial, which takes the last pair of symbols.
    symbol = F.when(blank | ~F.col("first"), _GONE).otherwise(1 + 2 * F.when(kind == 0, 3).otherwise(kind - 1) + cut.cast("int"))
    facts = rows.select("conv", "turn", "role", "text", "copies", symbol.cast("int").alias("symbol"), blank.alias("blank"), initial.alias("initial"), F.spark_partition_id().alias("part"))
    turn_type, conv_type = facts.schema["turn"].dataType, facts.schema["conv"].dataType
    long = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    schema = T.StructType([
        T.StructField("conv", conv_type), T.StructField("part", T.IntegerType()), *long("seq"), T.StructField("symbols", T.StringType()),
        *long("blank", "duplicate", "truncated", "illegal", "turns"), T.StructField("first_turn", turn_type), T.StructField("last_turn", turn_type),
        T.StructField("first_initial", T.StringType()), T.StructField("last_initial", T.StringType()),
        T.StructField("roles", T.ArrayType(T.StringType())), T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("copies", T.ArrayType(T.LongType()))])
    legal = {"su", "ua", "au"}

    def run(batches):
        seq = 0
        for batch in batches:
            convs, kinds, turns_, copies = (batch.column(k).to_pylist() for k in (0, 5, 1, 4))
            blanks, initials, parts = (batch.column(k).to_pylist() for k in (6, 7, 8))
            sizes = np.asarray(pc.binary_length(batch.column(3))).tolist()
            out, begin = [], 0
            while begin < batch.num_rows:
                end, held = begin, 0
                while end < batch.num_rows and convs[end] == convs[begin] and (end == begin or (held + sizes[end] <= CHUNK_BYTES and end - begin < CHUNK_ROWS)):
                    held += sizes[end]
                    end += 1
                span = range(begin, end)
                known = [turns_[k] for k in span if turns_[k] is not None]
                symbols = "".join(str(kinds[k]) + str(_GONE) * (copies[k] - 1) for k in span)
                n_blank = sum(copies[k] for k in span if blanks[k])
                gone = symbols.count(str(_GONE))
                illegal = sum(copies[k] - 1 for k in span) + sum(initials[k] + initials[k + 1] not in legal for k in range(begin, end - 1))
                out.append((convs[begin], parts[begin], seq, symbols, n_blank, gone - n_blank, sum(kinds[k] > 0 and kinds[k] % 2 == 0 for k in span), illegal,
                            len(set(known)), known[0] if known else None, known[-1] if known else None, initials[begin], initials[end - 1],
                            end))
                seq, begin = seq + 1, end
            offsets = pa.array([0, *(r[-1] for r in out)], pa.int32())
            columns = [pa.array([r[k] for r in out], to_arrow_type(f.dataType)) for k, f in enumerate(schema.fields[:13])]
            lists = [pa.ListArray.from_arrays(offsets, batch.column(k)) for k in (2, 3)]
            yield pa.RecordBatch.from_arrays([*columns, *lists, pa.ListArray.from_arrays(offsets, batch.column(4))], names=schema.names)

    return checkpointed(facts.mapInArrow(run, schema))


def audits(cut: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit, pieces, one row per conversation of `chunks`.

    pieces: part, seq, letters and state in front of each chunk. Only symbols and edges of chunks meet here."""
    slim = ["part", "seq", "symbols", "turns", "first_turn", "last_turn", "first_initial", "last_initial", "illegal"]
    lists = cut.groupBy("conv").agg(F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated"),
                                    F.sort_array(F.collect_list(F.struct(*slim))).alias("chunks"))
    piece = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("letters", T.StringType()), T.StructField("state", T.IntegerType())])
    long = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = T.StructType([cut.schema["conv"], *(T.StructField(n, T.LongType()) for n in long), T.StructField("audit", T.StringType()), T.StructField("pieces", T.ArrayType(piece))])
    legal = {"su", "ua", "au"}

    def run(batches):
        solver = Tables()
        for batch in batches:
            rows = []
            for blank, duplicate, truncated, parts in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
                cost, letters, states = solver.solve([p["symbols"] for p in parts])
                known = [p for p in parts if p["turns"]]
                turns = sum(p["turns"] for p in known) - sum(p["last_turn"] == q["first_turn"] for p, q in zip(known, known[1:]))
                gaps = known[-1]["last_turn"] - known[0]["first_turn"] + 1 - turns if known else 0
                illegal = sum(p["illegal"] for p in parts) + sum(p["last_initial"] + q["first_initial"] not in legal for p, q in zip(parts, parts[1:]))
                pieces = [{"part": p["part"], "seq": p["seq"], "letters": x, "state": s} for p, x, s in zip(parts, letters, states)]
                rows.append((gaps, blank, duplicate, truncated, illegal, cost, "".join(letters), pieces))
            made = [pa.array([r[k] for r in rows], to_arrow_type(f.dataType)) for k, f in enumerate(schema.fields[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=schema.names)

    return checkpointed(lists.mapInArrow(run, schema))


def repaired(cut: DataFrame, audit: DataFrame) -> DataFrame:
    """conv, part, seq, turns: the turns left in each chunk, as (role, text, edit)."""
    pieces = audit.select(F.inline("pieces"))
    joined = cut.select("conv", "part", "seq", "roles", "texts", "copies").join(pieces, ["part", "seq"]).select("conv", "part", "seq", "roles", "texts", "copies", "letters", "state")
    turn = T.StructType([T.StructField(n, T.StringType()) for n in ("role", "text", "edit")])
    schema = T.StructType([*joined.schema.fields[:3], T.StructField("turns", T.ArrayType(turn))])

    def walk(roles, texts, copies, letters, state):
        rows = ((role, text) for role, text, n in zip(roles, texts, copies) for _ in range(n))
        out = []
        for letter in letters:
            role, text = next(rows) if letter != "I" else (None, "")
            if letter == "D":
                continue
            state = _KEPT[CLASSES.index(role[0])][state] if letter == "K" else _NEXT[state]
            out.append({"role": role if letter == "K" else USER if state == _U else ASSISTANT, "text": text, "edit": letter})
        return out

    def run(batches):
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(3, 8)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array([walk(*row) for row in zip(*columns)], to_arrow_type(schema["turns"].dataType))], names=schema.names)

    return joined.mapInArrow(run, schema)


def digests(left: DataFrame) -> DataFrame:
    """conv, sha256 of a conversation's repaired turns as lines of `role:text`, read in order as a stream."""
    schema = T.StructType([left.schema["conv"], T.StructField("sha256", T.StringType())])

    def run(batches):
        now, any_turn, state = None, False, None
        for batch in batches:
            done = []
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if state is None or conv != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, any_turn, state = conv, False, hashlib.sha256()
                for t in turns:
                    state.update(("\n" * any_turn + t["role"] + ":" + t["text"]).encode())
                    any_turn = True
            yield rows(done)
        if state is not None:
            yield rows([(now, state.hexdigest())])

    rows = lambda found: pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], to_arrow_type(schema[k].dataType)) for k in (0, 1)], names=schema.names)
    return left.repartition("conv").sortWithinPartitions("conv", "part", "seq").select("conv", "turns").mapInArrow(run, schema)


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(one row per conversation, its repaired turns in chunks): what `audits` and `repaired` give.

    Rows are taken by turn, nulls first, then by role and text; a null role or text is one space. A row's first fault
    counts: blank, duplicate (role and text seen earlier in the conversation; also a repeated row), truncated (its last character that is
    no white space isn't one of .!?). Blank and duplicate rows must go. Among the cheapest edits the audit of least letters is
    taken (D deleted, I put in, K kept, R given another role). A null conversation is one of its own. Other columns
    aren't read; an empty table gives no rows.
    """
    cut = chunks(turns, conv, turn, role, text)
    audit = audits(cut)
    return audit, repaired(cut, audit)
