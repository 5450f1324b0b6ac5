"""A smoothed n-gram model in a trie of Elias-Fano levels, trained and applied on whole tables.

Level 1 holds the words, as 64-bit hashes in order, and their counts; a word's place is its number. Level k
holds, for each context of k - 1 words, the words that follow it: pointers mark where a context's successors
begin, and successors are numbers raised by the context's place, so that the whole level is one increasing
sequence in which a successor is searched relative to its context. A successor's place is the number of its
n-gram, by which it is a context of the next level. Each successor has a quantised discounted probability, each
context a quantised back-off weight. Files of all levels are split by hash into shards of bounded size and
mapped into memory by the tasks that count the next level and that score.

p(w | h) = max(c(hw) - D, 0) / c(h) + b(h) p(w | h'), h' being h without its first word, with a level's discounts
D for single, double and more frequent n-grams from its counts of counts, each below the count itself, so that
all are held; p(w) = (c + 0.5) / (N + 0.5 (V + 1)). The weights sum to one, unknown words included. Contexts with
at least one in HOT of all tokens have their successors spread over all shards, so that no shard gathers them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from millrace.llm import eliasfano as ef
from millrace.llm.words import NOT_SPACE, Words, mix, per_text, slices, text_arrays
from millrace.session import scratch_path

# Words of the longest n-grams.
ORDER = 3
HOT = 256
# Tokens of text per shard; distinct entries are fewer.
SHARD_TOKENS = 3_000_000
# Bytes of text whose distinct words and n-grams are looked up together.
SLICE = 5 << 20
# Log probabilities and weights are held in steps of RANGE / 65535.
RANGE = 16.0

_END = np.uint64(0xE4D0F7E870000001)
_COMPACT = 1_500_000


def _planes(sorted_keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences, byte planes apart, so that the high bytes compress to nothing."""
    gaps = np.diff(sorted_keys, prepend=np.uint64(0))
    return gaps.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplaned(blob: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(blob, dtype=np.uint8).reshape(8, -1).T).reshape(-1).view(np.uint64), dtype=np.uint64)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n


def _dealt(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes in the order of their shards, and where each shard begins. Small numbers are sorted by digits."""
    order = np.argsort(shard.astype(np.uint16 if shards <= 1 << 16 else np.int64), kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=shards))])


def _counted(docs: DataFrame, text: str, shards: int, find, shard_of) -> DataFrame:
    """shard, keys, counts: the distinct keys that `find(words)` gives, and how often, in parts by task and shard."""

    def parts(k, c):
        order, cut = _dealt(shard_of(k, shards), shards)
        for s in range(shards):
            mine = order[cut[s] : cut[s + 1]]
            if len(mine):
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([_planes(k[mine])], pa.binary()), pa.array([c[mine].tobytes()], pa.binary())], names=["shard", "keys", "counts"])

    def run(batches):
        keys, n, held = [], [], 0
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                k, c = np.unique(find(Words(*text_arrays(part.column(0)), NOT_SPACE, lower=True)), return_counts=True)
                keys.append(k)
                n.append(c.astype(np.int64))
                held += len(k)
                if held > _COMPACT:
                    k, c = _summed(np.concatenate(keys), np.concatenate(n))
                    keys, n, held = [k], [c], len(k) // 2
                    if len(k) > _COMPACT:  # few repeat, so holding on to them only takes memory
                        yield from parts(k, c)
                        keys, n, held = [], [], 0
        if keys:
            yield from parts(*_summed(np.concatenate(keys), np.concatenate(n)))

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "shard int, keys binary, counts binary")


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return _summed(np.concatenate([_unplaned(b) for b in table.column("keys").to_pylist()]),
                   np.concatenate([np.frombuffer(b, dtype=np.int64) for b in table.column("counts").to_pylist()]))


def _by_top(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards of word hashes in the order of the hashes."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _coded(values: np.ndarray) -> dict[str, np.ndarray]:
    """Values as codes into the list of the distinct ones."""
    distinct, code = np.unique(values, return_inverse=True)
    return {"distinct": distinct, "code": code.astype(np.uint8 if len(distinct) <= 1 << 8 else np.uint16 if len(distinct) <= 1 << 16 else np.uint32)}


def quantise(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * (65535 / RANGE)), 0, 65535).astype(np.uint16)


def unquantise(q: np.ndarray) -> np.ndarray:
    return q.astype(np.float64) * (-RANGE / 65535)


# What each quantised log10 stands for.
_POWERS = 10 ** unquantise(np.arange(65536))


class Level1:
    """Words: number and count of each hash."""

    def __init__(self, path: str, sizes: list[int], tokens: int):
        self.path, self.tokens, self.shards = path, tokens, len(sizes)
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.words = int(self.base[-1])
        self.open_: dict[int, tuple] = {}

    def __getstate__(self):
        return {**self.__dict__, "open_": {}}

    def _file(self, s: int) -> tuple:
        if s not in self.open_:
            a = ef.load(f"{self.path}/words-{s}")
            self.open_[s] = ef.Sequence(_part(a, "hash")), a["distinct"], a["code"]
        return self.open_[s]

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, count) of sorted hashes."""
        number, count = np.full(len(hashes), -1, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        cut = np.searchsorted(_by_top(hashes, self.shards), np.arange(self.shards + 1))
        for s in range(self.shards):
            a, b = int(cut[s]), int(cut[s + 1])
            if a < b and self.base[s] < self.base[s + 1]:
                sequence, distinct, code = self._file(s)
                at = sequence.find(hashes[a:b])
                known = at >= 0
                number[a:b][known] = at[known] + self.base[s]
                count[a:b][known] = distinct[code[at[known]]]
        return number, count

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), dtype=np.int64)
        shard = np.searchsorted(self.base, numbers, side="right") - 1
        for s in np.unique(shard).tolist():
            _, distinct, code = self._file(s)
            mine = shard == s
            out[mine] = distinct[code[numbers[mine] - self.base[s]]]
        return out

    def log10(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.words + 1)))


def _part(arrays: dict[str, np.ndarray], name: str) -> dict[str, np.ndarray]:
    return {k[len(name) + 1 :]: a for k, a in arrays.items() if k.startswith(f"{name}.")}


def _named(name: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": a for k, a in arrays.items()}


class _Tokens:
    """Numbers of the words of texts, each text between a start and an end."""

    def __init__(self, words: Words, level: Level1):
        hashes, inverse = np.unique(np.concatenate([words.hash, [_END]]), return_inverse=True)
        number, count = level.numbers(hashes)
        n = words.count + 1
        self.first = np.cumsum(n) - n
        total = int(n.sum())
        end = self.first + words.count
        inner = np.ones(total, dtype=bool)
        inner[end] = False
        where = np.full(total, inverse[-1])
        where[inner] = inverse[:-1]
        self.number, self.count = number[where], count[where]
        self.before = np.concatenate([[level.words], self.number[:-1]]) if total else self.number
        self.before[self.first] = level.words  # the start is a context with a number of its own


class _ByContext:
    """Shards of n-grams: by context, or by the whole n-gram where the context is hot."""

    def __init__(self, hot: list[int], shift: int):
        self.hot, self.shift = np.array(sorted(hot), dtype=np.int64), np.uint64(shift)

    def is_hot(self, context: np.ndarray) -> np.ndarray:
        return np.isin(context, self.hot)

    def __call__(self, keys: np.ndarray, shards: int) -> np.ndarray:
        context = keys >> self.shift
        return (mix(np.where(self.is_hot(context.astype(np.int64)), keys, context)) % np.uint64(shards)).astype(np.int64)


class Grams:
    """A level above the words. Keys are a context's number, `shift` bits up, and a word's number."""

    def __init__(self, path: str, words: int, sizes: list[int], route: _ByContext):
        self.path, self.words, self.shards, self.route, self.shift = path, words, len(sizes), route, route.shift
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.hot_backoff = np.zeros(len(route.hot))
        self.open_: dict[tuple, tuple] = {}

    def __getstate__(self):
        return {**self.__dict__, "open_": {}}

    def _places(self, s: int) -> tuple:
        if ("grams", s) not in self.open_:
            a = ef.load(f"{self.path}-{s}")
            self.open_["grams", s] = tuple(ef.Sequence(_part(a, k)) for k in ("context", "pointer", "successor"))
        return self.open_["grams", s]

    def _values(self, s: int) -> tuple:
        if ("values", s) not in self.open_:
            a = ef.load(f"{self.path}-values-{s}")
            self.open_["values", s] = a["probability"], a["backoff"]
        return self.open_["values", s]

    def key(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Keys of known contexts; all bits of an unknown word's number are set."""
        unknown = np.uint64((1 << int(self.shift)) - 1)
        return context.astype(np.uint64) << self.shift | np.where(word >= 0, word.astype(np.uint64), unknown)

    def _found(self, keys: np.ndarray):
        """Per shard: (shard, indexes of keys whose context it holds, the contexts' places, which n-grams it holds, their places)."""
        context, word = (keys >> self.shift).astype(np.int64), (keys & np.uint64((1 << int(self.shift)) - 1)).astype(np.int64)
        order, cut = _dealt(self.route(keys, self.shards), self.shards)
        for s in range(self.shards):
            mine = order[cut[s] : cut[s + 1]]
            if not len(mine) or self.base[s] == self.base[s + 1]:
                continue
            contexts, pointers, successors = self._places(s)
            # The keys are in order, so those of a context stand together.
            first = np.flatnonzero(np.concatenate([[True], context[mine[1:]] != context[mine[:-1]]]))
            place = contexts.find(context[mine[first]])
            many, some = np.diff(np.append(first, len(mine))), place >= 0
            begin, end = (np.repeat(x.astype(np.int64), many[some]) for x in pointers.pairs(place[some]))
            mine, k = mine[np.repeat(some, many)], np.repeat(place[some], many[some])
            at = np.where(word[mine] < self.words, successors.find(k * self.words + word[mine], begin, end), -1)
            yield s, mine, k, at >= 0, at[at >= 0]

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Number (or -1) of n-grams, whose keys are distinct and in order."""
        out = np.full(len(keys), -1, dtype=np.int64)
        for s, mine, _, held, at in self._found(keys):
            out[mine[held]] = at + self.base[s]
        return out

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number or -1, discounted probability or 0, back-off weight of the context) of distinct keys in order."""
        number, p, b = np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys)), np.ones(len(keys))
        for s, mine, k, held, at in self._found(keys):
            probability, backoff = self._values(s)
            number[mine[held]] = at + self.base[s]
            p[mine[held]] = _POWERS[probability[at]]
            b[mine] = _POWERS[backoff[k]]
        context = (keys >> self.shift).astype(np.int64)
        hot = self.route.is_hot(context)
        if hot.any():
            b[hot] = 10 ** self.hot_backoff[np.searchsorted(self.route.hot, context[hot])]
        return number, p, b


class Model:
    """The words, and a level for each order from 2 on."""

    def __init__(self, level: Level1, grams: list[Grams]):
        self.level, self.grams = level, grams

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 p or NaN, log10 back-off weight of the context) of distinct pairs in order."""
        number, p, b = self.grams[0].look_up(keys)
        out, some = np.full(len(keys), np.nan), number >= 0
        word = (keys[some] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        out[some] = np.log10(p[some] + b[some] * 10 ** self.level.log10(self.level.counts(word)))
        return out, np.log10(b)

    def _shifted(self, t: _Tokens, number: np.ndarray) -> np.ndarray:
        """Number of the n-gram that ends before each token; none before the first of a text."""
        before = np.concatenate([[-1], number[:-1]]) if len(number) else number
        before[t.first] = -1
        return before

    def keys(self, words: Words) -> np.ndarray:
        """Keys of all n-grams of the level above the last one, for counting."""
        t = _Tokens(words, self.level)
        before = t.before
        for level in self.grams[:-1]:
            some = np.flatnonzero((before >= 0) & (t.number >= 0))
            keys, inverse = np.unique(level.key(before[some], t.number[some]), return_inverse=True)
            number = np.full(len(before), -1, dtype=np.int64)
            number[some] = level.numbers(keys)[inverse]
            before = self._shifted(t, number)
        some = (before >= 0) & (t.number >= 0)
        return self.grams[-1].key(before[some], t.number[some])

    def scores(self, words: Words) -> tuple[np.ndarray, ...]:
        """Per text: tokens, known tokens, base score, score."""
        t = _Tokens(words, self.level)
        base = self.level.log10(t.count)
        p, before = 10**base, t.before
        for level in self.grams:
            # Behind a known context an unknown word is reached by backing off as well.
            some = np.flatnonzero(before >= 0)
            keys, inverse = np.unique(level.key(before[some], t.number[some]), return_inverse=True)
            found, own, weight = level.look_up(keys)
            p[some] = own[inverse] + weight[inverse] * p[some]
            number = np.full(len(before), -1, dtype=np.int64)
            number[some] = found[inverse]
            before = self._shifted(t, number)
        total = lambda x: np.add.reduceat(x, t.first) if len(t.first) else np.zeros(0)
        return words.count + 1, total((t.count > 0).astype(np.int64)), total(base), total(np.log10(p))


def _kinds(n: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per context, whose n-grams begin at `first`: their total, and how many occur once, twice, and more often."""
    return np.stack([np.add.reduceat(x, first) for x in (n, (n == 1) * 1, (n == 2) * 1, (n >= 3) * 1)]).astype(np.int64)


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts of n-grams seen once, twice and more often, by the counts of counts; kept between sense and the count itself."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    one = min(max(y, 0.05), 0.95)
    two = min(max(2 - 3 * y * n3 / n2 if n2 else 1.0, 0.5), 1.9)
    return one, two, min(max(3 - 4 * y * n4 / n3 if n3 else 1.5, two), 2.9)


def _weight(kinds, discounts) -> np.ndarray:
    total, *often = kinds
    return np.log10(np.minimum(sum(d * k for d, k in zip(discounts, often)) / np.maximum(total, 1), 1.0))


def train(docs: DataFrame, text: str = "text", shard_tokens: int = SHARD_TOKENS, order: int = ORDER) -> Model:
    """A model of all texts of `docs`, of n-grams up to `order`: words between white space, A-Z lower-cased, and an
    end after each text.

    Null and empty texts are an end alone; repeated rows count each. Counts cover all rows. The driver hears of
    shards: their sizes, counts of counts, and contexts that hold one in HOT of all tokens.
    """
    spark: SparkSession = docs.sparkSession
    path = scratch_path(spark, "trie")
    source = docs.select(F.col(text).alias("text"))
    about = docs.agg(F.sum(F.octet_length(text)).alias("b"), F.count("*").alias("n")).first()
    shards = max(1, ((about["b"] or 0) // 5 + about["n"]) // shard_tokens)

    def words_of(words: Words) -> np.ndarray:
        return np.concatenate([words.hash, np.full(words.docs, _END)])

    def build_words(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        keys, n = _merged(table)
        ef.save(f"{path}/words-{s}", {**_named("hash", ef.encode(keys, 1 << 64)), **_coded(n)})
        top = np.argsort(-n, kind="stable")[:HOT]
        return pa.table({"shard": pa.array([s], pa.int32()), "size": pa.array([len(keys)], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64()),
                         "at": pa.array([top.tolist()], pa.list_(pa.int64())), "n": pa.array([n[top].tolist()], pa.list_(pa.int64()))})

    made = _counted(source, "text", shards, words_of, _by_top).groupBy("shard").applyInArrow(build_words, "shard int, size long, tokens long, at array<long>, n array<long>").collect()
    sizes = [0] * shards
    for r in made:
        sizes[r["shard"]] = r["size"]
    level = Level1(path, sizes, sum(r["tokens"] for r in made))
    hot = [int(level.base[r["shard"]]) + at for r in made for at, n in zip(r["at"], r["n"]) if n * HOT >= level.tokens]
    grams, finish = [], []
    for n_words in range(2, order + 1):
        route = _ByContext([*hot, level.words], 32) if n_words == 2 else _ByContext(hot, (level.words + 1).bit_length())
        if grams and int(grams[-1].base[-1]) >> (64 - int(route.shift)):
            raise ValueError(f"too many different n-grams of {n_words - 1} words for contexts")
        name = f"{path}/grams{n_words}"
        grams.append(Grams(name, level.words, [0] * shards, route))
        made = _count_level(source, Model(level, grams), level.tokens)
        sizes, hot, sums = [0] * shards, [], {}
        for r in made:
            sizes[r["shard"]] = r["size"]
            for c, *kinds in zip(r["context"], *(r[f"k{i}"] for i in range(4))):
                sums[c] = sums.get(c, 0) + np.array(kinds)
        grams[-1] = Grams(name, level.words, sizes, route)
        hot = [int(grams[-1].base[r["shard"]]) + at for r in made for at in r["at"]]
        discounts = _discounts(*(sum(r["of"][k] for r in made) for k in range(4)))
        grams[-1].hot_backoff = np.array([float(_weight(sums[h], discounts)) if h in sums else 0.0 for h in route.hot.tolist()])
        finish += [(name, r["shard"], len(grams) - 1, discounts) for r in made]
        grams[-1].hot_total = np.array([int(sums[h][0]) if h in sums else 0 for h in route.hot.tolist()])
    if finish:
        _finish(spark, finish, grams)
    return Model(level, grams)


def _count_level(source: DataFrame, model: Model, tokens: int) -> list:
    """Write the n-grams of the model's last level, with their counts. Per shard: size, counts of counts, places of
    n-grams that hold one in HOT of all tokens, and the kinds of the hot contexts."""
    held = source.sparkSession.sparkContext.broadcast(model)
    level = model.grams[-1]
    name, words, shift, hot = level.path, level.words, level.shift, level.route.hot
    universe = int(model.grams[-2].base[-1]) if len(model.grams) > 1 else words + 1

    def merge(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        keys, n = _merged(table)
        context = (keys >> shift).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        contexts, at = context[first], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
        word = (keys & np.uint64((1 << int(shift)) - 1)).astype(np.int64)
        ef.save(f"{name}-{s}", {
            **_named("context", ef.encode(contexts, universe)), **_named("pointer", ef.encode(np.append(first, len(keys)), len(keys) + 1)),
            **_named("successor", ef.encode(at * words + word, max(1, len(contexts) * words)))})
        ef.save(f"{name}-counts-{s}", _coded(n))
        here = np.flatnonzero(np.isin(contexts, hot))
        kinds = _kinds(n, first)[:, here]
        lists = {"of": [int((n == k).sum()) for k in (1, 2, 3, 4)], "at": np.flatnonzero(n * HOT >= tokens).tolist(),
                 "context": contexts[here].tolist(), **{f"k{i}": kinds[i].tolist() for i in range(4)}}
        return pa.table({"shard": pa.array([s], pa.int32()), "size": pa.array([len(keys)], pa.int64()), **{k: pa.array([v], pa.list_(pa.int64())) for k, v in lists.items()}})

    schema = "shard int, size long, " + ", ".join(f"{k} array<long>" for k in ("of", "at", "context", "k0", "k1", "k2", "k3"))
    counted = _counted(source, "text", level.shards, lambda words: held.value.keys(words), level.route)
    return counted.groupBy("shard").applyInArrow(merge, schema).collect()


def _finish(spark: SparkSession, todo: list[tuple], grams: list[Grams]) -> None:
    """Write discounted probabilities and back-off weights from the counts, which then go."""
    held = spark.sparkContext.broadcast((todo, grams))

    def run(batches):
        todo, grams = held.value
        for batch in batches:
            for i in batch.column(0).to_pylist():
                name, s, which, discounts = todo[i]
                level, counted = grams[which], ef.load(f"{name}-counts-{s}")
                n = counted["distinct"][counted["code"]]
                contexts, pointers, _ = level._places(s)
                first = pointers.get(np.arange(contexts.n + 1)).astype(np.int64)
                kinds = _kinds(n, first[:-1])
                weights, total, route = _weight(kinds, discounts), kinds[0], level.route
                context = contexts.get(np.arange(contexts.n)).astype(np.int64)
                is_hot = np.flatnonzero(route.is_hot(context))
                total[is_hot] = level.hot_total[np.searchsorted(route.hot, context[is_hot])]
                p = (n - np.array(discounts)[np.minimum(n, 3) - 1]) / np.repeat(total, np.diff(first))
                size = ef.save(f"{name}-values-{s}", {"probability": quantise(np.log10(p)), "backoff": quantise(weights)})
                yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64())], names=["bytes"])

    spark.range(0, len(todo), 1, len(todo)).mapInArrow(run, "bytes long").collect()
    for name, s, *_ in todo:
        ef.drop(f"{name}-counts-{s}")


FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
          T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]


class _Score:
    def __init__(self, model):
        self.model = model

    def __call__(self, column):
        n, known, base, score = self.model.value.scores(Words(*text_arrays(column), NOT_SPACE, lower=True))
        return [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())]


def score(docs: DataFrame, model: Model, name: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` with a struct column `name`: n_tokens (the end included), n_known, base_score (of single words) and
    score, log10 probabilities of the whole text. Null and empty texts are an end alone. Only the places of the
    model's files travel with the tasks."""
    return per_text(docs, text, _Score(docs.sparkSession.sparkContext.broadcast(model)), FIELDS, name, keep=keep, limit=SLICE)
