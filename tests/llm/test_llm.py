"""Each operation against brute force or an exact round trip, on small tables with nulls, empty and long texts,
repeated rows, clashing column names, and no rows at all."""

import collections
import datetime as dt
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from compare import differences, duck
from millrace.llm.words import text_arrays
from millrace.llm import decontaminate, eliasfano, languages, mixing, neardup, ngrams, permute, pseudonyms, quality, queries, revisits, substrings, tokencount

WORD = re.compile(r"[^\x20\x09-\x0D]+")
R = random.Random(5)
VOCABULARY = ["".join(R.choice("abcdefgh") for _ in range(R.randint(2, 7))) for _ in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_words long, `_source_no` string"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = [prose(120, i) for i in range(12)]
    near = base[0].split(" ")
    near[60] = "changed"
    texts = [*base, base[0], " ".join(near), base[1] + " " + base[2], prose(3000, 99), "", None, "a b", "Ünïcode 字 text", base[3][:400] + "\n" + base[3][:400]]
    made = [(i, t, ["en", "fr", None][i % 3], ["a", None, "b"][i % 3], 7, "x") for i, t in enumerate(texts)]
    return [*made, made[4], (None, base[5], None, "a", 7, "x"), (None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def test_decontaminate(spark, docs, rows, none):
    items = [(1, rows[0][1][:300]), (2, rows[5][1]), (2, rows[5][1]), (3, "a b"), (4, ""), (None, prose(20, 7)), (5, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    alnum = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: alnum.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
    windows = collections.defaultdict(set)
    for item, text in items:
        w = lower(text)
        for i in range(max(len(w) - 12, 1) if w else 0):
            windows[tuple(w[i : i + 13])].add("" if item is None else str(item))
    for rounds in (decontaminate.ROUND_BYTES, 600):
        found = decontaminate.find_items(docs, bench, "found", keep=["doc_id", "text"], round_bytes=rounds)
        for r in found.select("text", *decontaminate.verdict("found")).collect():
            w, hit, names = lower(r.text), set(), set()
            for n in {len(x) for x in windows}:
                for i in range(len(w) - n + 1):
                    if tuple(w[i : i + n]) in windows:
                        hit |= set(range(i, i + n))
                        names |= windows[tuple(w[i : i + n])]
            assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(names))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
            assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
    assert decontaminate.find_items(none, bench, "found").count() == 0
    assert decontaminate.find_items(docs, bench.limit(0), "found").filter("size(found.items) > 0").count() == 0


def test_quality_base(docs, rows, none):
    got = quality.judge(docs, "q", keep=["text"]).select("text", "q.*").collect()
    assert len(got) == len(rows)
    for r in got:
        text, w = r.text or "", words(r.text)
        at = collections.defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        repeated = {p for x in at.values() if len(x) > 1 for i in x for p in range(i, i + 8)}
        lines = [x for x in text.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(w) < 20 or 100 * len(repeated) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert quality.judge(none, "q").count() == 0


def test_quality_distance():
    same = quality.js_distance(np.array([[5, 5, 0]]), np.array([1, 1, 0]))
    far = quality.js_distance(np.array([[0, 0, 9]]), np.array([1, 1, 0]))
    assert same[0] < 1e-6 and abs(far[0] - 1) < 1e-9


def test_quality_references(spark):
    odd_text = lambda n: " ".join(f"{i}#{i * 7}$%" for i in range(n))
    junk = odd_text(100)
    plain = [(i, prose(150, 500 + i), "en") for i in range(12)]
    rare = [(200 + i, prose(150, 700 + i), "fi") for i in range(quality.REFERENCE_TEXTS - 2)]
    # Texts and words enough, but all from one text.
    thin = [(300 + i, "a b c", "nl") for i in range(quality.REFERENCE_TEXTS)]
    odd = [(100, junk, "xx"), (101, junk, None), (102, junk, "en"), (103, junk, ""), (104, junk, "fi"), (105, odd_text(700), "nl")]
    table = spark.createDataFrame([*plain, *rare, *thin, *odd], "doc_id long, text string, lang string")
    judged = {r.doc_id: r for r in quality.judge(table, "q", keep=["doc_id"]).select("doc_id", "q.*").collect()}
    assert {i for i, r in judged.items() if r.kept} == {i for i, _, _ in plain + rare}
    assert judged[100].word_distance is None and judged[200].word_distance is None and judged[0].word_distance is not None
    for i in (100, 101, 102, 103, 104, 105):
        assert judged[i].char_distance > 0.5 and not judged[i].base_failed
    # A language is measured without the text that is held to it.
    chars = lambda rows: quality.char_histogram(*(text_arrays(pa.array([t for _, t, _ in rows])))).astype(float)
    rest = chars([*plain[1:], odd[2]]).sum(axis=0)
    assert abs(judged[0].char_distance - quality.js_distance(chars(plain[:1]), rest)[0]) < 1e-12
    # Without any reference the base decides.
    few = spark.createDataFrame([(1, junk, "en"), (2, prose(60, 1), None)], "doc_id long, text string, lang string")
    assert [(r.q.kept, r.q.char_distance) for r in quality.judge(few.filter("doc_id = 2"), "q").collect()] == [(True, None)]


def test_mixing(docs, rows, none):
    mix = mixing.plan(docs, keep=["doc_id"])
    got = mixing.taken(mix, ["doc_id"]).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r["size"] for r in got)
    assert collections.Counter(r["size"] for r in got) == collections.Counter(len(words(r[1])) for r in rows)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.taken(mixing.plan(docs, keep=["doc_id"]), ["doc_id"]).collect()), key=repr)
    sizes = collections.defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    assert mix.names == ["a", "b", None] and mix.sizes == [sizes[n] for n in mix.names]
    assert abs(sum(mix.goal) - 1.5 * sum(mix.sizes)) < 1e-6 and all(g <= 2 * s for g, s in zip(mix.goal, mix.sizes))
    pieces = mixing.mixed(mixing.plan(docs, keep=["doc_id", "text"]), "text").collect()
    by_id = {r[0]: words(r[1]) for r in rows if r[0] is not None}
    assert all(p.words.split(" ") == by_id[p.doc_id][p.from_word : p.from_word + p.n_words] for p in pieces if p.doc_id is not None)
    assert mixing.taken(mixing.plan(none, keep=["doc_id"]), ["doc_id"]).count() == 0
    assert mixing.targets([100, 10, 10], [5, 2, 1], 1.5, 2) == [140.0, 20.0, 20.0]


def test_shards_add_up():
    dealt = [1000, 37, 5000, 0]
    parts = [mixing.shard_counts(dealt, k, 3, 256) for k in range(-(-sum(dealt) // 256))]
    assert np.sum([c for _, c in parts], axis=0).tolist() == dealt
    for (b, c), (b2, _) in zip(parts, parts[1:]):
        assert (b + c).tolist() == b2.tolist() and c.sum() == 256


def test_permutations():
    for n in (1, 2, 3, 100, 1009):
        assert sorted(permute.permute(x, n, b"key") for x in range(n)) == list(range(n))
        assert sorted(permute.permute_all(np.arange(n), n, 4).tolist()) == list(range(n))


def test_pseudonyms(spark, docs, rows):
    p = pseudonyms.Pseudonyms("k")
    card = "4539 1488 0343 6467"
    out, found = p.replace(f"Pay {card} or 4539148803436467, born 1990-02-28 or 28/02/1990, mail a.b@mail.example.org, NL91 ABNA 0417 1643 00, +1 (212) 555-0147, 10.1.2.3")
    assert found == {"card": 2, "date": 2, "email": 1, "iban": 1, "phone": 1, "ip": 1}
    cards = re.findall(r"(?:[0-9] ?){16}", out)
    assert cards[0].replace(" ", "").strip() == cards[1].strip() != card.replace(" ", "") and pseudonyms.luhn_digit(cards[1].strip()[:-1]) == cards[1].strip()[-1]
    iso = re.search(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", out)[0]
    assert dt.date.fromisoformat(iso).strftime("%d/%m/%Y") in out
    iban = re.search(r"NL[0-9 A-Z]{20,}", out)[0].replace(" ", "")[:18]
    assert pseudonyms.iban_checks(iban[:2], iban[4:]) == iban[2:4]
    for clean in ("4539148803436468", "999.1.2.3", "2023-02-30", "78305", "NL91ABNA0417164301", "", "version 3.11"):
        assert p.replace(clean) == (clean, {})
    assert pseudonyms.Pseudonyms("other").replace(card)[0] != p.replace(card)[0]
    got = pseudonyms.pseudonymise(docs, "q", "k", keep=["doc_id", "text"]).collect()
    assert len(got) == len(rows) and all(r.q.text == r.text and r.q.n_replaced == 0 for r in got)


def test_dates_of_two_centuries():
    p = pseudonyms.Pseudonyms("k")
    first, last = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
    written = {}
    for n in range(first, last + 1):
        d = dt.date.fromordinal(n)
        day_first = p._date(d.strftime("%d/%m/%Y"))
        new = dt.datetime.strptime(day_first, "%d/%m/%Y").date()
        assert written.setdefault(day_first, d) == d
        if d.day > 12:
            month_first = p._date(d.strftime("%m/%d/%Y"))
            assert month_first == new.strftime("%m/%d/%Y") and new.day > 12
            assert written.setdefault(month_first, d) == d
        if d.day == 1:
            assert p._date(d.isoformat()) == new.isoformat()
    assert len(written) > last - first + 1
    short = p._date("1/2/2000")
    assert re.fullmatch("([1-9][0-9]?/){2}[0-9]{4}", short) and [int(x) for x in short.split("/")] == [int(x) for x in p._date("01/02/2000").split("/")]


def test_pseudonyms_beside_numbers():
    values = {"card": ["4539 1488 0343 6467", "4539-1488-0343-6467", "4539148803436467", "3782 822463 10005", "45 39 14 88 03 43 64 67"], "date": ["1990-02-28", "28/02/1990", "28 Feb 1990"],
              "iban": ["NL91 ABNA 0417 1643 00", "AT61 1904 3002 3457 3201", "AT611904300234573201"], "email": ["a.b@mail.example.org"],
              "ip": ["10.1.2.3"], "phone": ["212 555 0147", "(212) 555-0147"], "ssn": ["123-45-6789"], "secret": ["token = abcdefgh12345678"]}
    p = pseudonyms.Pseudonyms("k")
    for kind, spelled in values.items():
        for value in spelled:
            new, found = p.replace(value)
            assert found == {kind: 1} and new != value
            for beside in ("2", "12", "124", "7 8", "2024", "12 boxes", "room 2", "AB12", "ID12", "2023-02-30", "999.1.2.3", "4539 1488 0343 6468", "NL91ABNA0417164301"):
                # Groups of two digits beside others may be read in several ways: all must hide the value.
                for text, want in ((f"{beside} {value}", f"{beside} {new}"), (f"{value} {beside}", f"{new} {beside}"), (f"{beside} {value} {beside}", f"{beside} {new} {beside}")):
                    out, found = p.replace(text)
                    assert value not in out
                    if value[:3] != "45 " and not (kind == "phone" and beside[-1].isdigit()):
                        assert (out, found) == (want, {kind: 1}), text
    for a, b in (("+31612345678", "4539 1488 0343 6467"), ("+31612345678", "1990-02-28"), ("+31612345678", "10.1.2.3"), ("1990-02-28", "4539 1488 0343 6467"), ("212 555 0147", "4539 1488 0343 6467"),
                 ("4539148803436467", "12 March 1990"), ("123-45-6789", "4539148803436467"), ("AT611904300234573201", "4539 1488 0343 6467"), ("password=", "john-smith-from-here@mail.example.org")):
        for x, y in ((a, b), (b, a))[: 1 if a == "password=" else 2]:
            blank = "" if a == "password=" else " "
            assert p.replace(x + blank + y)[0] == p.replace(x)[0] + blank + p.replace(y)[0]
    assert p.replace("qty 12-4539148803436467-12")[0] == f"qty 12-{p.replace('4539148803436467')[0]}-12"
    assert p.replace("ID12 4539 1488 0343 6467 4539148803436467.50")[1] == {"card": 1}


def test_near_duplicates(docs, rows, none):
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: r.class_id for r in got if r.doc_id is not None}
    assert of[0] == of[12] == of[13] == 0 and of[16] == of[17] == 16 and len({of[i] for i in range(12)}) == 12
    assert sorted(r.class_id is None for r in got if r.doc_id is None) == [False, False]
    left = neardup.survivors(docs, neardup.near_duplicates(docs))
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(of.values()))
    assert neardup.near_duplicates(none).count() == 0


def test_consistent_samples():
    r = np.random.default_rng(3)
    h = np.unique(r.integers(1, 1 << 63, 900, dtype=np.uint64))
    a, b = h[:800], h[100:]
    wa, wb = np.ones(len(a), dtype=np.float32), np.full(len(b), 1.5, dtype=np.float32)
    exact = 700 / (100 + 1.5 * 800)
    same = (neardup.samples(a, wa, neardup._SKETCH_KEYS) == neardup.samples(b, wb, neardup._SKETCH_KEYS)).mean()
    assert abs(same - exact) < 0.05


def test_token_counts(docs, rows, none):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for piece in (50, 32_768):
        got = tokencount.count_tokens(docs, "c", path, keep=["text"], piece=piece).collect()
        assert len(got) == len(rows)
        assert all((r.c.n_tokens, r.c.n_bytes) == (len(library.encode(r.text or "")), len((r.text or "").encode())) for r in got)
    assert tokencount.count_tokens(none, "c", path).count() == 0
    counter = tokencount.Counter(tokencount.Vocabulary(path).scores)
    r = random.Random(2)
    for _ in range(2000):
        text = "".join(r.choice(["a", "th", "er", " ", "  ", "▁", "\n", "é", "字", "😀", "tion", "<s>", "0"]) for _ in range(r.randint(0, 30)))
        assert counter.text(text) == len(library.encode(text))


def test_languages(spark, none):
    r = random.Random(1)
    kinds = {"x": "abcde ", "y": "defgh ", "z": "mnopé "}
    rows = [(i, "".join(r.choice(kinds["xyz"[i % 3]]) for _ in range(80)), "xyz"[i % 3]) for i in range(90)] + [(900, None, "x"), (901, "12 34", None), (902, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = languages.train(df.filter("doc_id < 45"))
    got = {x.doc_id: x.p for x in languages.predict(df, trees, "p", keep=["doc_id"]).collect()}
    assert all(got[i].lang_pred == "xyz"[i % 3] and got[i].score > 0.5 for i in range(90))
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert {x.p.lang_pred for x in languages.predict(df, languages.train(none), "p").collect()} == {"und"}


def test_languages_of_one_script(spark):
    """Languages that differ in the rarer letters of one script, beside others that take the commonest bytes."""
    r = random.Random(2)
    common, rare = "оаеинтсрвл", {"ru": "ыэъё", "uk": "іїєґ", "bg": "ѝщжч", "zh": "的一是不了人我在", "ja": "のにはをたがでて", "hi": "कखगघङचछज", "mr": "टठडढणतथद"}
    letters = {k: (common if k in ("ru", "uk", "bg") else "") + v * 2 for k, v in rare.items()}
    latin = "abcdefghijklmnopqrstuvwxyz0123456789.,;:!?()-'\"/&%$#@*+=<>[]{}~^_|"
    names = [*letters, "en"]
    line = lambda k, n: "".join(r.choice(letters[k] if k in letters else latin) + " " * (r.random() < 0.2) for _ in range(n))
    rows = [(i, line(names[i % 8], 2000 if i % 8 == 7 else 60), names[i % 8]) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = languages.train(df.filter("doc_id < 120"))
    got = {x.doc_id: x.p.lang_pred for x in languages.predict(df, trees, "p", keep=["doc_id"]).collect()}
    assert all(got[i] == names[i % 8] for i in range(240))
    # Every byte has a code: the chances of all 256 after any context add up to one or less (escapes exclude nothing).
    codes = lambda context: np.array([(sum((c + 1) << (9 * (k + 1)) for k, c in enumerate(reversed(context)))) | (b + 1) for b in range(256)])
    for levels in trees.lists():
        for context in (b" th", "ые".encode()[1:], "的一".encode()[2:5]):
            assert 0.2 < np.exp2(-trees._lengths(levels, codes(context))).sum() <= 1 + 1e-9


def test_languages_of_few_rows(spark):
    """Every language with text has a tree, however few and long its rows; a sample ends with the row that fills it."""
    r = random.Random(3)
    line = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    few = [(i, line("abcde ", 20_000 if i < 12 else 0), f"l{i % 20}") for i in range(40)]
    many = [(1000 + i, line("uvwxyz", 50), "many") for i in range(4000)]
    df = spark.createDataFrame([*few, *many, (9000, "only", "one"), (9001, None, "none"), (9002, "text", None)], "doc_id long, text string, lang string")
    trees = languages.train(df, train_bytes=2_000)
    assert trees.names == sorted([*(f"l{i}" for i in range(12)), "many", "one"])
    size = {n: int(c[1].sum()) for n, c in zip(trees.names, trees.counts)}
    assert size == {**{f"l{i}": 20_000 for i in range(12)}, "many": 2_000, "one": 4}
    whole = languages.train(df, train_bytes=10**9)
    assert {n: int(c[1].sum()) for n, c in zip(whole.names, whole.counts)}["many"] == 200_000


def test_elias_fano(tmp_path):
    r = np.random.default_rng(1)
    for n, universe in ((0, 10), (1, 1), (500, 501), (1000, 1 << 40), (300, 1 << 64)):
        values = np.sort(r.integers(0, universe - 1, n, dtype=np.uint64, endpoint=True)) if universe > 1 else np.zeros(n, dtype=np.uint64)
        values = np.unique(values)
        eliasfano.save(f"{tmp_path}/s", eliasfano.encode(values, universe))
        held = eliasfano.Sequence(eliasfano.load(f"{tmp_path}/s"))
        assert held.get(np.arange(len(values))).tolist() == values.tolist()
        assert held.find(values).tolist() == list(range(len(values)))
        other = np.setdiff1d(r.integers(0, universe - 1, 50, dtype=np.uint64, endpoint=True) if universe > 1 else values, values)
        assert (held.find(other) == -1).all()


def test_elias_fano_reads_lone_values_once(tmp_path, monkeypatch):
    """Where no other value has the same high bits, a value is compared and not searched for."""
    read, lows = [], eliasfano.Sequence._lows
    monkeypatch.setattr(eliasfano.Sequence, "_lows", lambda self, i: read.append(len(i)) or lows(self, i))
    eliasfano.save(f"{tmp_path}/s", eliasfano.encode(np.arange(1000) << 10, 1000 << 10))
    held = eliasfano.Sequence(eliasfano.load(f"{tmp_path}/s"))
    assert held.find(np.arange(1000) << 10).tolist() == list(range(1000)) and sum(read) == 1000


def test_word_hashes_in_parts(monkeypatch):
    """A hash comes from the word's bytes alone, wherever the word stands and parts end."""
    from millrace.llm import words as w

    texts = ["abc  \u00e9t\u00e9 a", "", None, " abc", "a" * 50 + "\tabc a\n"]
    of = lambda: w.Words(*w.text_arrays(pa.array(texts)), w.NOT_SPACE)
    step = lambda b: int(w.mix(np.array([(sum(int(w._BYTE_KEYS[c]) * pow(int(w._STEP), i, 1 << 64) for i, c in enumerate(b)) + len(b)) % (1 << 64)], dtype=np.uint64))[0])
    for part in (1, 2, 3, 1 << 14):
        monkeypatch.setattr(w, "_PART", part)
        found = of()
        assert found.hash.tolist() == [step(found.bytes(i)) for i in range(7)] and len(found) == 7
    assert len(w.Words(*w.text_arrays(pa.array([" ", None])), w.NOT_SPACE).hash) == 0


def test_ngram_scores(docs, rows, none):
    import math

    model = ngrams.train(docs)
    lower = lambda t: words((t or "").translate({i: i + 32 for i in range(65, 91)}))
    one, two, context = collections.Counter(), collections.Counter(), collections.Counter()
    for r in rows:
        before = "start"
        for w in [*lower(r[1]), None]:
            one[w] += 1
            two[before, w] += 1
            context[before] += 1
            before = w
    total, kinds = sum(one.values()), len(one)
    assert (model.level.tokens, model.level.words) == (total, kinds)
    for r in ngrams.score(docs, model, "s", keep=["text"]).collect():
        base = sum(math.log10((one[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in [*lower(r.text), None])
        assert r.s.n_tokens == len(lower(r.text)) + 1 == r.s.n_known and abs(r.s.base_score - base) < 1e-6 * r.s.n_tokens
    # From any context, all known words and the unknown one have probabilities that add up to one.
    for before in ("start", rows[0][1].split(" ")[0]):
        number = kinds if before == "start" else int(model.level.numbers(np.sort(decontaminate.Words(*decontaminate.text_arrays(pa.array([before])), ngrams.NOT_SPACE).hash))[0][0])
        keys = np.append(np.uint64(number) << np.uint64(32) | np.arange(kinds, dtype=np.uint64), np.uint64(number) << np.uint64(32) | np.uint64(0xFFFFFFFF))
        p, b = model.look_up(keys)
        single = np.append(model.level.log10(model.level.counts(np.arange(kinds))), model.level.log10(np.array([0])))
        assert abs((10 ** np.where(np.isnan(p), b + single, p)).sum() - 1) < 2e-3
    assert ngrams.score(docs, ngrams.train(none), "s").count() == len(rows)


def test_ngram_orders(docs, rows):
    """Whole scores by brute force: every n-gram is held, those seen once too, in a level for each order."""
    import math

    lower = lambda t: tuple(words((t or "").translate({i: i + 32 for i in range(65, 91)})))
    texts = [("start", *lower(r[1]), None) for r in rows]
    for order in (1, 2, 3, 4):
        counts = [collections.Counter(t[i : i + k] for t in texts for i in range(len(t) - k + 1)) for k in range(1, order + 1)]
        counts[0].pop(("start",))
        follow = [collections.defaultdict(collections.Counter) for _ in counts]
        for k, c in enumerate(counts):
            for g, n in c.items():
                follow[k][g[:-1]][g[-1]] = n
        discounts = [ngrams._discounts(*(sum(n == m for n in c.values()) for m in (1, 2, 3, 4))) for c in counts]
        total, kinds = sum(counts[0].values()), len(counts[0])
        assert order == 1 or 0 < discounts[1][0] < 1

        def p(context, w):
            if not context:
                return (counts[0][w,] + 0.5) / (total + 0.5 * (kinds + 1))
            lower_p, seen = p(context[1:], w), follow[len(context)].get(context)
            if not seen:
                return lower_p
            less = lambda n: discounts[len(context)][min(n, 3) - 1]
            n = seen.get(w, 0)
            return (max(n - less(n), 0) if n else 0) / seen.total() + min(sum(map(less, seen.values())) / seen.total(), 1) * lower_p

        more = docs.unionByName(docs.selectExpr("doc_id", "reverse(text) AS text", "lang", "source", "n_words", "_source_no")).limit(len(rows) + 12)
        model = ngrams.train(docs, order=order, shard_tokens=2_000)
        assert len(model.grams) == order - 1 and all(int(g.base[-1]) == len(c) for g, c in zip(model.grams, counts[1:]))
        for r in ngrams.score(more, model, "s", keep=["text"]).collect():
            t = ("start", *lower(r.text), None)
            want = sum(math.log10(p(t[max(0, i - order + 1) : i], t[i])) for i in range(1, len(t)))
            assert abs(r.s.score - want) < 5e-4 * len(t)


def test_substrings(docs, rows, none):
    window = 50
    starts = {}
    order = lambda i: float("inf") if i is None else i
    for r in rows:
        w = words(r[1])
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            starts[key] = min(starts.get(key, float("inf")), order(r[0]))
    want = []
    for r in rows:
        w = words(r[1])
        gone = {p for i in range(len(w) - window + 1) if starts[tuple(w[i : i + window])] < order(r[0]) for p in range(i, i + window)}
        want.append((order(r[0]), len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    for hot in (20_000, 1):
        got = substrings.remove_repeats(docs, "s", keep=["doc_id"], hot=hot).collect()
        assert sorted((order(r.doc_id), r.s.n_words, r.s.n_removed, r.s.kept) for r in got) == sorted(want)
    assert substrings.remove_repeats(none, "s").count() == 0


def test_revisits(spark):
    schema = "record_id long, kind string, url string, at long, status int, headers map<string,string>"
    rows = [(1, "response", "http://WWW.a.org/x/?b=2&a=1#f", 10, 200, {"ETag": '"q"', "Content-Type": "t", "Age": "1"}), (2, "response", "https://a.org/x?a=1&b=2", 20, 503, {}),
            (3, "revisit", "https://a.org:443/x?b=2&a=1&utm_source=z", 30, 304, {"etag": 'W/"q"', "content-type": "no", "age": "2"}), (4, "revisit", "https://a.org/x?a=1&b=2", 10, 304, None),
            (5, "revisit", "https://a.org/x?a=1&b=2", 40, 304, {"etag": '"r"'}), (6, "revisit", None, 40, 304, None), (7, "revisit", "ftp://a.org/x", 40, 304, None),
            (8, "revisit", "https://a.org/x?a=1&b=2", None, 304, None), (9, "revisit", "https://a.org/x?a=1&b=2", 50, 304, {})]
    got = {r.record_id: r for r in revisits.resolve(spark.createDataFrame(rows, schema)).collect()}
    assert {i: (r.ref_id, r.verdict) for i, r in got.items()} == {3: (1, "resolved"), 4: (None, "orphan"), 5: (1, "changed"), 6: (None, "orphan"), 7: (None, "orphan"), 8: (None, "orphan"), 9: (1, "unverified")}
    assert got[3].headers == {"etag": 'W/"q"', "content-type": "t", "age": "2"} and got[3].canonical == "a.org/x?a=1&b=2"
    assert revisits.resolve(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("name", list(queries.suite.queries))
def test_query(spark, sf, name):
    df = queries.suite.queries[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name in queries.suite.oracles:
        assert not differences(df, duck(sf), queries.suite.oracles[name])
    else:
        assert df.count() > 0


def test_stages_keep_columns(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("judged", F.lit(1)).limit(120)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns and after.count() <= docs.count()
