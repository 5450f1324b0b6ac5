"""Phrases, repaired conversations and license notices against brute force, with nulls, empty and long texts, repeated
rows, clashing column names and no rows."""

import collections
import hashlib
import heapq
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace import session
from millrace.errors import InvalidInput
from millrace.llm import collocations, conversations, licenses, mixing, quality, substrings, tokencount

FOLD = {i: i + 32 for i in range(65, 91)}


def phrases_by_hand(rows, max_words, least, top, percent):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    kept = collections.defaultdict(list)
    for (lang, p), a in candidates.items():
        score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        inside = any(m == lang and len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (m, q), b in candidates.items())
        if not inside:
            kept[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, r, p.decode(), -a, l, rr, n[lang], -s) for lang, x in kept.items() for r, (s, a, p, l, rr) in enumerate(sorted(x)[:top], 1)}


@pytest.fixture(scope="module")
def texts():
    r = random.Random(8)
    words = ["the", "New", "york", "city", "of", "é字", "x\x00y", "hall", "a"]
    made = [(" ".join(r.choice(words[: 3 + i % 7]) + r.choice(["", "", "", ",", ".\n", "  \t"]) for _ in range(150)), ["en", None, "fr"][i % 3]) for i in range(30)]
    return [*made, made[0], made[0], (None, "en"), ("", None), (" . \x0b\x0c", "xx"), ("new york " * 4000, "en"), ("one two", "und")]


@pytest.mark.parametrize("max_words, least, top, percent", [(3, 10, 2000, 50), (2, 3, 5, 50), (4, 4, 40, 70)])
def test_phrases(spark, texts, max_words, least, top, percent):
    docs = spark.createDataFrame([(*t, "z", 1) for t in texts], "text string, lang string, begin string, n int").repartition(4)
    got = collocations.collocations(docs, max_words=max_words, least=least, top=top, inside_percent=percent)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(phrases_by_hand(texts, max_words, least, top, percent))
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_phrases_counted_in_parts(spark, texts):
    docs = spark.createDataFrame(texts, "text string, lang string").repartition(2)
    total = lambda flush: sorted(map(tuple, collocations.windows(docs, "text", "lang", 3, flush).select("lang", "begin", F.split("tail", "\n")[2].cast("long").alias("n")).groupBy("lang", "begin").sum("n").collect()))
    assert total(100) == total(10**6)


def test_windows_of_rare_beginnings_stay_whole(spark, texts):
    counts = collocations.phrase_counts(spark.createDataFrame(texts, "text string, lang string"))
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    apart, summed = plan[plan.index("Generate explode"):], plan[plan.index("Expand"):]
    # Windows meet the frequent beginnings before they are taken apart, and prefixes are summed before ROLLUP copies them.
    assert "Join Inner" in apart[: apart.index("MapInArrow")]
    assert "Aggregate" in summed[: summed.index("MapInArrow")]
    # The text is read and dealt once for all three.
    run = counts._jdf.queryExecution().executedPlan()
    counts.collect()
    final = run.toString().split("== Initial Plan ==")[0]
    assert final.count("MapInArrow") == 1 and "ShuffledHashJoin" in final


def test_windows_are_counted_in_little_memory():
    r = np.random.default_rng(5)
    code, n = r.zipf(1.3, 200_000) % 5000, 200_000
    piece, group = np.cumsum(r.random(n) < 0.1), np.sort(r.integers(0, 3, n)).astype(np.int32)
    piece += group  # a piece has one group
    words = pa.array([f"w{c}" for c in range(5000)], pa.large_string()).take(pa.array(code)).dictionary_encode()
    tracemalloc.start()
    held = pa.total_allocated_bytes()
    most = max(b.nbytes + t.nbytes for _, b, t in collocations.count_windows(words, piece, group, 3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 * n and most < 100 * collocations.ROWS and pa.total_allocated_bytes() <= held + most

    expected, text = collections.Counter(), [f"w{c}" for c in code]
    for i in range(n):
        w = [text[j] for j in range(i, min(i + 3, n)) if piece[j] == piece[i]]
        expected[group[i], " ".join(w[:2]), w[2] if len(w) == 3 else ""] += 1
    for rows in (999, 10**6):
        got = collections.Counter()
        for of, begin, tail in collocations.count_windows(words, piece, group, 3, rows):
            assert len(of) == len(begin) == len(tail) <= rows
            for g, b, t in zip(of, begin.to_pylist(), tail.to_pylist()):
                lasts, counts, total = (x.split(" ") for x in t.split("\n"))
                counts = [1] * len(lasts) if counts == [""] else list(map(int, counts))
                assert sum(counts) == int(total[0])
                got.update({(g, b, x): c for x, c in zip(lasts, counts, strict=True)})
        assert got == expected


def test_texts_reach_tasks_in_small_batches(spark, texts, monkeypatch):
    key, met = "spark.sql.execution.arrow.maxBytesPerBatch", []
    docs = spark.createDataFrame(texts, "text string, lang string")
    monkeypatch.setattr(collocations, "checkpointed", lambda df: (met.append(spark.conf.get(key)), df)[1])
    collocations.collocations(docs)
    spark.conf.set(key, "1m")
    try:
        collocations.collocations(docs)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)
    assert met == [str(collocations.BATCH_BYTES), "1m"] and spark.conf.get(key, None) is None

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    long = spark.range(0, 64, 1, 1).select(F.repeat(F.lit("x"), 1 << 18).alias("text"))
    with session.arrow_batches(spark, 1 << 20):
        assert max(r.n for r in long.mapInArrow(sizes, "n long").collect()) < 3 << 19
    with pytest.raises(ZeroDivisionError), session.arrow_batches(spark, 1 << 20):
        1 / 0
    assert spark.conf.get(key, None) is None


def test_scores_past_64_bits(spark):
    counts = spark.createDataFrame([("en", "", 0, 10**13), ("en", "a", 1, 4 * 10**12), ("en", "b", 1, 3 * 10**12 + 1), ("en", "a b", 2, 3 * 10**12)], "lang string, phrase string, words int, n long")
    row = collocations._scored(counts, 3).first()
    assert row.score == 10**6 * 9 * 10**24 // (4 * 10**12 * (3 * 10**12 + 1))


def test_phrases_need_two_words(spark):
    with pytest.raises(InvalidInput):
        collocations.collocations(spark.createDataFrame([("a", "b")], "text string, lang string"), max_words=1)


def repaired_by_hand(rows):
    """(facts, cost, audit, turns) of the ordered (turn, role, text) rows, by a search over all edit scripts."""
    seen, marks, facts = set(), [], collections.Counter()
    space = " \t\n\x0b\f\r"
    for _, role, text in rows:
        fault = "blank" if not text.strip(space) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(space)[-1] not in ".!?" else None
        seen.add((role, text))
        facts[fault] += 1
        marks.append(fault)
    initials = [r[1][:1] for r in rows]
    facts["illegal"] = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    facts["gaps"] = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    fits = lambda x: re.fullmatch("(s?(ua)+)?", x) or any(re.fullmatch("s?(ua)*u?", x) for _ in [0])
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, said, out = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", said):
            return facts, cost, audit, list(out)
        state = (i, said[-1:], said == "")
        if state in done or not fits(said):
            continue
        done.add(state)
        for x in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, audit + "I", i, said + x[0], (*out, (x, ""))))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, said, out))
            if marks[i] not in ("blank", "duplicate"):
                more = 3 * (marks[i] == "truncated")
                if role[:1] in ("s", "u", "a"):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, said + role[0], (*out, (role, text))))
                for x in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, said + x[0], (*out, (x, text))))


def convs(seed, count, longest):
    r = random.Random(seed)
    said = ["Yes.", "No", "Why?", " ", "", "A long one, é字!", "x\n", "yes.  \n", None, "It ends. ", "so\x0b"]
    out = []
    for c in range(count):
        for t in range(r.randrange(1, longest)):
            out.append((c if c else None, r.choice([t, t, t, None, t + 3]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "sys"]), r.choice(said) if r.random() < 0.5 else f"{t} {c}{r.choice('.!?x')}"))
    return [*out, out[0], out[0], out[5]]


@pytest.mark.parametrize("seed, count, longest, rows_a_chunk", [(1, 60, 9, None), (2, 5, 40, 3)])
def test_conversations(spark, monkeypatch, seed, count, longest, rows_a_chunk):
    if rows_a_chunk:
        monkeypatch.setattr(conversations, "CHUNK_ROWS", rows_a_chunk)
    rows = convs(seed, count, longest)
    turns = spark.createDataFrame([(*x, 1, "p") for x in rows], "conv_id long, turn long, role string, text string, seq int, part string").repartition(3)
    audit, left = conversations.repair(turns)
    hashes = {r.conv: r.sha256 for r in conversations.digests(left).collect()}
    found = {r.conv: r for r in audit.collect()}
    said = collections.defaultdict(list)
    for r in sorted(left.collect(), key=lambda r: (r.part, r.seq)):
        said[r.conv] += [(t.role, t.text) for t in r.turns]
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, " " if role is None else role, " " if text is None else text))
    assert set(found) == set(by) == set(hashes)
    for c, mine in by.items():
        mine.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        facts, cost, letters, out = repaired_by_hand(mine)
        r = found[c]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal) == tuple(facts[x] for x in ("gaps", "blank", "duplicate", "truncated", "illegal"))
        assert (r.cost, r.audit, said[c]) == (cost, letters, out)
        assert hashes[c] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()


def test_no_conversations(spark):
    audit, left = conversations.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert audit.count() == 0 and conversations.digests(left).count() == 0


@pytest.mark.parametrize("block", [1, 2, 3, 5])
def test_blocks_of_any_length_agree(block):
    r, a, b = random.Random(block), conversations.Tables(4), conversations.Tables(block) if block < 5 else conversations.Tables(3)
    for _ in range(300):
        chunks = ["".join(str(r.randrange(9)) for _ in range(r.randrange(1, 14))) for _ in range(r.randrange(1, 4))]
        assert a.solve(chunks) == b.solve(chunks)


@pytest.fixture(scope="module")
def notices():
    r = random.Random(4)
    filler = lambda n: " ".join(r.choice(["some", "file", "of", "the", "license", "under", "Ünï", "字", "9"]) for _ in range(n))
    gpl = dict(licenses.NOTICES)["gpl-3"]
    long = next(t for _, t in licenses.NOTICES if t.startswith("permission is hereby granted free"))
    broken = long.split()
    broken[10:10] = ["really"]
    cut = " ".join(long.split()[:12])
    return ["Released UNDER the M-I-T license", "under the MIT License. under the mit-license", "Apache License, Version 2.0", "CC BY-NC cc by/nc CC BY", gpl, f"{filler(30)} {long.title()} {filler(10)}",
            f"{filler(9)} {' '.join(broken)} {filler(4)}", f"{filler(9)} {cut}", filler(3000), f"{'cc by nc ' * 2000}", "", None, "a b", "cc", "cc by nc", "Licensed under the GNU General Public License, version 3.", "Licensed under CC BY 4.0", "under the MIT License. under the mit-license"]


def test_licenses(spark, notices):
    docs = spark.createDataFrame([(i if i else None, t, "p", 1, "r") for i, t in enumerate(notices)], "doc_id long, text string, id string, row int, t_id string").repartition(3)
    got = licenses.scan(docs, "found")
    assert got.columns == ["doc_id", "text", "id", "row", "t_id", "found"]
    rows = {(r.doc_id, r.text): r.found for r in got.collect()}
    assert len(rows) == got.count() == len(notices)
    for (_, text), f in rows.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
        places = [(i, label) for label, p in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        assert (f.n_words, f.n_base, f.first_word, f.last_word) == (len(w), len(places), min(starts, default=None), max(starts, default=None))
        assert f.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, f.base_labels.split(","))) <= set(f.labels.split(","))
        assert f.labels == ",".join(sorted(set(f.labels.split(",")))) and 0 <= f.score <= 1
        for s in f.spans:
            assert s.share >= licenses.SHARE and s.label in f.labels.split(",") and 0 <= s.first_word <= s.last_word < len(w)
    found = {r.text: (r.found.labels, r.found.spans) for r in got.collect()}
    assert found[notices[4]][0] == "gpl-3" and found[notices[15]][0] == "gpl-3" and found[notices[16]][0] == "cc-by"
    assert found[notices[5]][0] == "mit" and [(s.first_word, s.share) for s in found[notices[5]][1]] == [(30, 1.0)]
    # A word put in: the votes lie on two diagonals, which only together are enough.
    assert found[notices[6]][0] == "mit" and licenses.scan(docs.filter(F.col("text") == notices[6]), "found", near=0).first().found.labels == ""
    assert found[notices[7]][0] == "" and found[notices[8]][0] == ""


def test_licenses_without_rows_or_words(spark, notices):
    docs = spark.createDataFrame([(1, notices[1])], "doc_id long, text string")
    assert licenses.scan(docs.limit(0), "found").count() == 0
    with pytest.raises(InvalidInput):
        licenses.scan(docs, "TEXT")
    with pytest.raises(InvalidInput):
        licenses.scan(docs, "found", phrases=[("x", "two words")])


CLASHES = ["block", "_i", "_m", "_n", "_t", "_size", "_offset", "_source_no", "_cut", "_words", "n", "no", "name", "size", "words", "mark", "node", "shard", "taken", "Slot"]


@pytest.fixture(scope="module")
def clashing(spark):
    r = random.Random(6)
    prose = lambda n: " ".join(r.choice(["ab", "cd", "efg", "h", "ij"]) for _ in range(n))
    shared = prose(60)
    rows = [(i, [prose(70), shared + " " + prose(9), "", None, prose(3000) * 12][i % 5], "ab"[i % 2]) for i in range(12)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2).cache()
    return plain, plain.select("*", *((F.col("doc_id") * (k + 3) % 4).alias(c) for k, c in enumerate(CLASHES)))


def test_texts_of_a_mix_are_stored_once(clashing, monkeypatch):
    stored, write = [], mixing.checkpointed
    monkeypatch.setattr(mixing, "checkpointed", lambda df: stored.append(df.columns) or write(df))
    mixing.mixed(mixing.plan(clashing[0], keep=["doc_id", "text"]), "text").collect()
    assert sum("text" in columns for columns in stored) == 1


def test_clashing_names_change_no_mix(clashing):
    plain, wide = clashing
    key = lambda df: sorted(map(tuple, df.collect()))
    few, all_ = mixing.plan(plain, keep=["doc_id", "text"]), mixing.plan(wide)
    assert key(mixing.taken(few, ["doc_id"])) == key(mixing.taken(all_, ["doc_id"]))
    columns = ["shard", "slot", "epoch", "block", "doc_id", "from_word", "n_words", "words"]
    whole = mixing.mixed(all_, "text")
    assert key(mixing.mixed(few, "text").select(columns)) == key(whole.select(columns))
    assert "block_" in whole.columns and whole.filter(F.col("block_") != F.col("doc_id") * 3 % 4).count() == 0


def test_clashing_names_change_no_counts(clashing):
    import public_tokenizers

    plain, wide = clashing
    path = public_tokenizers.path("piece_bpe_32k.model")
    key = lambda df, *c: sorted(map(tuple, df.select("doc_id", *c).collect()))
    assert key(tokencount.count_tokens(plain, "k", path), "k.n_tokens") == key(tokencount.count_tokens(wide, "k", path), "k.n_tokens")
    assert key(substrings.remove_repeats(plain, "k"), "k.n_removed", "k.kept") == key(substrings.remove_repeats(wide, "k"), "k.n_removed", "k.kept")
    assert substrings.remove_repeats(wide, "k").columns == [*wide.columns, "k"]
    with pytest.raises(InvalidInput):
        quality.judge(wide.withColumn("lang", F.lit("en")), "NAME")


def test_long_texts_without_blanks(spark):
    """Pieces of any size give the library's counts, where tokens never meet a blank and where they never forget their beginning."""
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(8)
    made = ["a" * 5000, "ab" * 2500, "=" * 4001, " " * 3000, "\n" * 999, "".join(r.choice("ABCDEFabcdef0123456789+/") for _ in range(6000)),
            "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(3000)), "the" * 700 + " " + "the" * 700, "_-" * 800 + "字" + "er" * 900, "x " * 2000, "h" * 64]
    docs = spark.createDataFrame([(t,) for t in [*made, made[0]]], "text string")
    for piece in (1, 37, 1000):
        few = docs if piece > 1 else docs.filter("length(text) < 100")
        got = tokencount.count_tokens(few, "c", path, piece=piece).collect()
        assert len(got) == few.count() and all(g.c.n_tokens == len(library.encode(g.text)) for g in got), piece
