"""Token counts of a byte-pair model through a deterministic transducer that annotates transitions with counts.

The vocabulary is compiled, as texts ask for it, into a transducer over characters. Let e(x) be the model's
encoding of a prefix x. Its last token t is the one suffix of x in the vocabulary for which e of what comes
before ends in a token p that stays apart from t (the model encodes p + t as p, t). No token that is still to
come can begin before the longest suffix s of x that begins some token. So what counts for the future is s and,
for each place in s, the last token and the number of tokens up to there, relative to x: finitely many states.
Reading a character moves to the next state and emits the change in the number of tokens.

Long texts are cut into pieces. A piece maps the state at its start to the state at its end and a count; the map is
tabulated at the states that are reached. All pieces are read in parallel from the state that the characters
before them lead to: nearly always the right one, for a blank after a non-blank or a character outside the vocabulary leads
to one state from all states, and tokens soon forget where they began. Then each piece is read again, in parallel, from every
state that its predecessor ends in and its table lacks, until none is missing. So nothing is guessed in the result. The tables are
composed by a parallel scan: neighbours first, then neighbours of those.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.errors import InvalidInput
from millrace.llm.neardup import node_of
from millrace.llm.words import fresh, per_text
from millrace.session import stored

BLANK = "▁"
# Characters of a piece of a long text.
PIECE = 32_768
# Pieces that are cut out of one stretch of a long text, and neighbours that are composed at once.
STRETCH, FAN = 32, 64
# Characters before a piece that its first reading begins with.
WARM = 128
# What a task remembers; beyond, it forgets and goes on, with the same results.
WORDS_KEPT, STATES_KEPT = 300_000, 300_000

_SEGMENT = re.compile(f"{BLANK}+[^{BLANK}]*|^[^{BLANK}]+")
_BORDER = re.compile(f"(?<=[^{BLANK}]){BLANK}")


class Vocabulary:
    """Pieces and their merge scores, read from a sentencepiece file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model

        proto = model.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        kinds = proto.SentencePiece.DESCRIPTOR.enum_types_by_name["Type"].values_by_name if hasattr(proto, "SentencePiece") else None
        normal = kinds["NORMAL"].number if kinds else 1
        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = proto.normalizer_spec
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == normal}
        bytes_ = sum(processor.is_byte(i) for i in range(processor.get_piece_size()))
        if proto.trainer_spec.model_type != 2 or bytes_ != 256 or plain.precompiled_charsmap or plain.remove_extra_whitespaces \
                or not plain.add_dummy_prefix or any(_BORDER.search(p) for p in self.scores) or any(p.type not in (1, 2, 3, 6) for p in proto.pieces):
            raise InvalidInput("only byte-pair models with byte fallback, without normalisation or pieces across blanks, are compiled")


class Transducer:
    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.begins = {p[:i] for p in scores for i in range(1, len(p) + 1)}
        self.apart: dict[tuple[str | None, str], bool] = {}
        self._reset()

    def _reset(self) -> None:
        # A state: (s, last token up to each place of s, number of tokens up to each place relative to the end).
        start = ("", (None,), (0,))
        self.number, self.states, self.moves = {start: 0}, [start], [{}]

    def _encode(self, text: str) -> list[str]:
        """The model's merges on a short text: always the best-scored adjacent pair, the leftmost of equals."""
        symbols = list(text)
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                score = self.scores.get(symbols[i] + symbols[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _stays(self, before: str | None, token: str) -> bool:
        known = self.apart.get((before, token))
        if known is None:
            known = self._encode((before or "") + token) == ([before, token] if before else [token])
            if len(self.apart) > 2_000_000:
                self.apart.clear()
            self.apart[before, token] = known
        return known

    def _extend(self, state: int, c: str) -> tuple[int, int]:
        s, last, upto = self.states[state]
        if c not in self.scores:
            made = (0, len(c.encode()))
        else:
            whole = s + c
            n = len(whole)
            token = place = None
            for at in range(n):
                t = whole[at:]
                if t in self.scores and self._stays(last[at], t):
                    token, place = t, at
                    break
            count = upto[place] + 1  # relative to the state before
            cut = next(at for at in range(n) if whole[at:] in self.begins)
            new = (whole[cut:], (*last[cut:], token), tuple(u - count for u in (*upto[cut:], count)))
            if new not in self.number:
                self.number[new] = len(self.states)
                self.states.append(new)
                self.moves.append({})
            made = (self.number[new], count)
        self.moves[state][c] = made
        return made

    def read(self, entry: str, text: str) -> tuple[str, int]:
        """The state that `text` leads to from the state `entry`, and the tokens emitted. States are named by their content,
        which is the same in all tasks."""
        if len(self.states) > STATES_KEPT:
            self._reset()
        state, n, moves = self._numbered(entry), 0, self.moves
        for c in text:
            move = moves[state].get(c) or self._extend(state, c)
            state = move[0]
            n += move[1]
        return json.dumps(self.states[state], ensure_ascii=False), n

    def _numbered(self, entry: str) -> int:
        s, last, upto = json.loads(entry)
        known = (s, tuple(last), tuple(upto))
        if known not in self.number:
            self.number[known] = len(self.states)
            self.states.append(known)
            self.moves.append({})
        return self.number[known]

    def count(self, segment: str) -> int:
        """Tokens of a text in which no blank follows a non-blank."""
        if len(self.states) > STATES_KEPT:
            self._reset()
        state, n, moves = 0, 0, self.moves
        for c in segment:
            move = moves[state].get(c) or self._extend(state, c)
            state = move[0]
            n += move[1]
        return n


# The state before any text.
START = json.dumps(["", [None], [0]])


class Counter(dict):
    """Counts of blank-led words, remembered while there is room."""

    def __init__(self, scores: dict[str, float]):
        super().__init__()
        self.transducer = Transducer(scores)

    def __missing__(self, word: str) -> int:
        n = self.transducer.count(BLANK + word)
        if len(self) > WORDS_KEPT:
            self.clear()
        self[word] = n
        return n

    def inside(self, text: str) -> int:
        """Tokens of a text that begins at a border; blanks are BLANK already."""
        if text.startswith(BLANK) and BLANK * 2 not in text:
            return sum(map(self.__getitem__, text.split(BLANK)[1:]))
        return sum(self[m[1:]] if m[0] == BLANK and m[1:2] != BLANK else self.transducer.count(m) for m in _SEGMENT.findall(text))

    def text(self, text: str) -> int:
        return self.inside(BLANK + text.replace(" ", BLANK)) if text else 0

    def read(self, entry: str, piece: str) -> tuple[str, int]:
        """Transducer.read, by whole words between the first border of the piece and the last."""
        first = _BORDER.search(piece)
        if not first:
            return self.transducer.read(entry, piece)
        last = piece.rindex(BLANK)
        while last > first.start() and piece[last - 1] == BLANK:
            last = piece.rindex(BLANK, 0, last)
        n = self.transducer.read(entry, piece[: first.start()])[1] + self.inside(piece[first.start() : last])
        end, more = self.transducer.read(START, piece[last:])
        return end, n + more


def _counter(held) -> Counter:
    """What a Python worker has compiled so far; it serves all its tasks."""
    if "counter" not in held.value:
        held.value["counter"] = Counter(held.value["scores"])
    return held.value["counter"]


class _Count:
    def __init__(self, scores):
        self.scores = scores

    def __call__(self, column):
        counter = _counter(self.scores)
        return [pa.array([counter.text(x or "") for x in column.to_pylist()], pa.int64())]


def count_tokens(docs: DataFrame, name: str, model_path: str, text: str = "text", keep: list[str] | None = None, piece: int = PIECE) -> DataFrame:
    """`docs` with a struct column `name`: n_bytes and n_tokens, as the library counts them without begin, end or
    added special tokens (their strings are ordinary text).

    Null and empty texts have 0 of both. Texts longer than `piece` characters are read in pieces; equal long
    texts are read once. Only the vocabulary, of fixed size, is sent to the executors.
    """
    kept = docs.columns if keep is None else keep
    held = docs.sparkSession.sparkContext.broadcast({"scores": Vocabulary(model_path).scores})
    value = F.coalesce(F.col(text), F.lit(""))
    size = fresh(docs, "n_bytes")
    source = docs.withColumn(size, F.octet_length(value).cast("long"))
    long_ = F.length(value) > piece
    count = fresh(source, "counted")
    short = per_text(source.filter(~long_), text, _Count(held), [T.StructField("n_tokens", T.LongType())], count, keep=[*kept, size])
    short = short.select(*kept, F.struct(F.col(size).alias("n_bytes"), F.col(f"{count}.n_tokens").alias("n_tokens")).alias(name))

    node = fresh(source, "node")
    whole = source.filter(long_).withColumn(node, node_of(F.col(text)))
    totals = _long_counts(whole.select(F.col(node).alias("node"), F.concat(F.lit(BLANK), F.translate(value, " ", BLANK)).alias("text")), held, piece)
    of, found = fresh(whole, "of_node"), fresh(whole, "found_tokens")
    joined = whole.select(*dict.fromkeys([*kept, size, node])).join(totals.withColumnsRenamed({"node": of, "n_tokens": found}), F.col(node) == F.col(of))
    return short.unionByName(joined.select(*kept, F.struct(F.col(size).alias("n_bytes"), F.col(found).alias("n_tokens")).alias(name)))


def _cut(texts: DataFrame, piece: int) -> DataFrame:
    """node, no, piece, lead (the characters before it, none for piece 0) of the distinct texts, in two steps, as a place in a
    text is found by walking to it."""
    warm = min(WARM, piece)

    def parts(of: str, size: int, skip: Column) -> Column:
        # `of` begins with `skip` characters that belong to the part before.
        last = F.greatest(F.ceil((F.length(of) - skip) / size).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
            i.alias("i"), F.substr(F.col(of), F.greatest(skip + i * size + 1 - warm, F.lit(1)), size + F.least(skip + i * size, F.lit(warm))).alias("part")))

    stretches = texts.select("node", F.explode(parts("text", piece * STRETCH, F.lit(0))).alias("s")).select("node", F.col("s.i").alias("s"), F.col("s.part").alias("part"))
    skip = F.when(F.col("s") > 0, warm).otherwise(0)
    pieces = stretches.select("node", "s", skip.alias("skip"), F.explode(parts("part", piece, skip)).alias("p"))
    lead = F.least(F.col("skip") + F.col("p.i") * piece, F.lit(warm))
    return pieces.select("node", (F.col("s").cast("long") * STRETCH + F.col("p.i")).alias("no"), F.substr("p.part", lead + 1).alias("piece"),
                         F.substr("p.part", F.lit(1), lead).alias("lead")).dropDuplicates(["node", "no"])


def _long_counts(texts: DataFrame, held, piece: int) -> DataFrame:
    """node, n_tokens of the distinct texts, whose blanks are BLANK already."""
    pieces, at = _cut(texts, piece), ["node", "no"]

    def table_of(entries: DataFrame, column: str) -> DataFrame:
        """A row of the pieces' tables for each row: read from `entry`, or from where `lead` takes the start."""
        source = entries.select(*at, F.struct(column, F.col("piece").alias("text")).alias("reading"))
        return per_text(source, "reading", _Read(held, column), _MAP, "map", keep=at).select(*at, "map.*")

    tables, _ = stored(table_of(pieces, "lead"))
    while True:
        reached = tables.select("node", (F.col("no") + 1).alias("no"), F.col("exit").alias("entry")).distinct()
        missing, n = stored(reached.join(tables.select(*at).distinct(), at, "left_semi").join(tables, [*at, "entry"], "left_anti"))
        if not n:
            break
        tables, _ = stored(tables.unionByName(table_of(pieces.join(missing, at), "entry")))

    def compose(table: pa.Table) -> pa.Table:
        steps: dict[int, dict[str, tuple[str, int]]] = {}
        for r in table.to_pylist():
            steps.setdefault(r["no"], {})[r["entry"]] = r["exit"], r["n"]
        first, *others = (steps[k] for k in sorted(steps))
        made = []
        for entry, (end, n) in first.items():
            for step in others:
                end, more = step[end]
                n += more
            made.append({"node": table["node"][0].as_py(), "no": min(steps) // FAN, "entry": entry, "exit": end, "n": n})
        return pa.Table.from_pylist(made, schema=pa.schema([("node", pa.binary()), ("no", pa.int64()), ("entry", pa.string()), ("exit", pa.string()), ("n", pa.int64())]))

    last = tables.agg(F.max("no")).first()[0] or 0
    while last:
        tables, last = tables.groupBy("node", F.floor(F.col("no") / FAN)).applyInArrow(compose, tables.schema), last // FAN
    return tables.filter(F.col("entry") == START).select("node", F.col("n").alias("n_tokens"))


_MAP = [T.StructField("entry", T.StringType()), T.StructField("exit", T.StringType()), T.StructField("n", T.LongType())]


class _Read:
    def __init__(self, scores, column: str):
        self.scores, self.column = scores, column

    def __call__(self, readings):
        counter, entries, ends = _counter(self.scores), [], []
        for r in readings.to_pylist():
            entry = r["entry"] if self.column == "entry" else counter.read(START, r["lead"])[0]
            entries.append(entry)
            ends.append(counter.read(entry, r["text"]))
        return [pa.array(entries, pa.string()), pa.array([e for e, _ in ends], pa.string()), pa.array([n for _, n in ends], pa.int64())]
