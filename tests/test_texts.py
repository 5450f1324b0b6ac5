import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from millrace.errors import InvalidInput, StepAborted
from millrace.operators import answers, governance, pii, prompts, search
from millrace.operators.answers import AnswerFailed

FOUND = {
    "bsn": ["111222333", "123456782", "999999990", "1234.56.782", "123 456 782", "123-456-782", "10000008"],
    "iban": ["NL91ABNA0417164300", "NL91 ABNA 0417 1643 00", "DE89370400440532013000"],
    "email": ["jan@example.nl", "j.de.vries+werk@uwv.example.com", "a_b@x.co", "é@x.nl"],
    "phone": ["0612345678", "06-12345678", "+31612345678", "+31 6 12345678", "0201234567"],
}
NOT_FOUND = {
    "bsn": ["123456789", "111111111", "000000000", "123456780", "1112223334444", "01-02-2026", "2026-08-01", "12.34.56.78"],
    "iban": ["NL91ABNA0417164301", "NL00ABNA0417164300", "XX91ABNA0417164300", "NL91"],
    "email": ["not-an-email", "@example.nl", "a@b"],
    "phone": ["12345"],
}


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(kind, v, True) for kind, vs in FOUND.items() for v in vs] + [(kind, v, False) for kind, vs in NOT_FOUND.items() for v in vs]
    return spark.createDataFrame(rows, "kind string, value string, expected boolean")


def test_detector_vectors(vectors):
    out = vectors.withColumn("text", F.concat(F.lit("zie "), "value", F.lit(" hier"))).select(
        "kind", "value", "expected", F.transform(pii.find(F.col("text")), lambda s: s["kind"]).alias("kinds")).collect()
    wrong = [(r["kind"], r["value"], r["kinds"]) for r in out if (r["kind"] in r["kinds"]) != r["expected"]]
    assert not wrong


def test_overlaps_and_offsets(spark):
    texts = ["mail 0612345678@example.nl nu", "nummer 111222333", "é😀 jan@example.nl", "geen", None, "1112223334"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [[(s["kind"], s["start"], s["stop"]) for s in r[0]] for r in df.select(pii.find(F.col("text"))).collect()]
    assert got == [[("email", 5, 26)], [("bsn", 7, 16)], [("email", 3, 17)], [], [], [("bsn", 0, 9)]]


def test_redact_counts_and_null(spark):
    df = spark.createDataFrame([("a@b.nl en c@d.nl en 111222333",), (None,), ("niets",)], "text string")
    rows = pii.redact(df, "text").withColumn("counts", pii.kind_counts(F.col("pii_kinds"))).collect()
    assert rows[0]["redacted"] == "<EMAIL> en <EMAIL> en <BSN>" and rows[0]["counts"] == {"bsn": 1, "email": 2}
    assert rows[1]["redacted"] is None and rows[2]["redacted"] == "niets" and rows[2]["counts"] == {}
    assert {tuple(r) for r in pii.totals(pii.redact(df, "text")).collect()} == {("email", 2, 1), ("bsn", 1, 1)}


def slow_redact(text):
    """Brute force: try every place of every pattern, one match at a time, and cut out the winners."""
    hits = []
    for rank, (kind, pattern) in enumerate(pii.PATTERNS.items()):
        at = 0
        compiled = re.compile(pattern)
        while (m := compiled.search(text, at)):
            at = m.end() if m.end() > m.start() else m.start() + 1
            digits = re.sub(r"\D", "", m.group(1))
            if kind == "bsn":
                padded = digits.zfill(9)
                if padded == "0" * 9 or (sum(int(d) * w for d, w in zip(padded, range(9, 1, -1))) - int(padded[8])) % 11:
                    continue
            if kind == "iban":
                code = m.group(1).replace(" ", "")
                if not 15 <= len(code) <= 34 or int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 != 1:
                    continue
            hits.append((m.start(1), -m.end(1), rank, kind))
    out, edge = "", 0
    kept, stop = [], 0
    for start, end, _, kind in sorted(hits):
        if start >= stop:
            kept.append((start, -end, kind))
            stop = -end
    for start, end, kind in kept:
        out += text[edge:start] + f"<{kind.upper()}>"
        edge = end
    return out + text[edge:]


def test_redact_documents_like_brute_force(spark, sf):
    extra = "tel 0612345678, nl 123456782 en NL91 ABNA 0417 1643 00; " * 3
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("text", F.concat(F.lit(extra), "text"))
    for row in pii.redact(docs, "text").select("text", "redacted").collect():
        assert row["redacted"] == slow_redact(row["text"])


def test_pre_stage_checks_raw_length(spark):
    long = "jan@example.nl " * 4
    df = spark.createDataFrame([(long,), ("jan@example.nl",), ("ok",), (None,)], "text string")
    rows = pii.pre_stage(df, "text", max_chars=40).collect()
    assert [(r["action"], r["rule"]) for r in rows] == [("block", "input.max_chars"), ("redact", "pii.regex"), ("allow", None), ("allow", None)]
    assert rows[0]["redacted"] == long and rows[1]["redacted"] == "<EMAIL>"


def test_residency(spark):
    cases = [("none", "external", True), ("persoonsgegevens", "eu", True), ("persoonsgegevens", "external", False), ("bijzonder", "eu", False),
             ("bsn", "local", True), (None, "eu", False), (None, "local", True), ("weird", "external", False), ("none", None, False)]
    df = spark.createDataFrame(cases, "c string, r string, expected boolean")
    out = governance.residency_gate(df, "c", "r").collect()
    assert all(r["allowed"] == r["expected"] and r["action"] == ("allow" if r["expected"] else "block") for r in out)
    assert {r["declared"] for r in out if r["c"] in (None, "weird")} == {"bijzonder"}


SCHEMA = {"type": "object", "required": ["n"], "properties": {
    "n": {"type": "integer", "minimum": 1, "maximum": 5}, "s": {"type": "string", "minLength": 2, "maxLength": 3},
    "l": {"type": "array", "items": {"enum": ["a", "b"]}}, "x": {"type": "number"}, "z": {"type": "null"}}}


@pytest.mark.parametrize("text, found", [
    ('{"n": 1}', []), ('```json\n{"n": 2}\n```', []), ("```\n{\"n\": 2}", []), ('{"n": 0}', ["$.n: below minimum 1"]),
    ('{"n": 9}', ["$.n: above maximum 5"]), ("{}", ["$: missing required property 'n'"]), ('{"n": true}', ["$.n: expected integer, got boolean"]),
    ('{"n": 1.5}', ["$.n: expected integer, got float"]), ('{"n": 1, "s": "x"}', ["$.s: shorter than minLength 2"]),
    ('{"n": 1, "s": "xxxx"}', ["$.s: longer than maxLength 3"]), ('{"n": 1, "l": ["a", "c"]}', ["$.l[1]: 'c' is not one of ['a', 'b']"]),
    ('{"n": 1, "x": false}', ["$.x: expected number, got boolean"]), ('{"n": 1, "z": 0}', ["$.z: expected null, got int"]),
    ("[1]", ["$: expected object, got list"]), ("nope", ["$: response is not valid JSON (Expecting value)"])])
def test_json_shapes(text, found):
    try:
        got = governance.problems(json.loads(governance.strip_fence(text)), SCHEMA)
    except json.JSONDecodeError as error:
        got = [f"$: response is not valid JSON ({error.msg})"]
    assert got == found


def test_post_stage(spark):
    df = spark.createDataFrame([('{"n": 1, "s": "a@b.nl"}',), ("nope",), ('{"n": 3}',)], "text string")
    loose = {"type": "object", "required": ["n"]}
    rows = governance.post_stage(df, "text", loose).collect()
    assert [r["action"] for r in rows] == ["redact", "block", "allow"] and "<EMAIL>" in rows[0]["redacted"] and rows[1]["redacted"] == "nope"
    assert [r["action"] for r in governance.post_stage(df, "text").collect()] == ["redact", "allow", "allow"]


def test_unsupported_keywords():
    schema = {"type": "object", "$ref": "x", "properties": {"pattern": {"type": "string", "pattern": "a"}}, "items": {"oneOf": []}}
    assert governance.unsupported_keywords(schema) == {"$ref", "pattern", "oneOf"}


def python_block(content, label):
    suffix = hashlib.sha256(f"{label}\x00{content}".encode()).hexdigest()[:8]
    safe = re.sub(r"</?untrusted[^>]*>", lambda m: m.group(0).replace("<", "‹").replace(">", "›"), content, flags=re.I)
    return f"{governance.DATA_NOTICE}\n<untrusted label={label} id={suffix}>\n{safe}\n</untrusted id={suffix}>"


HOSTILE = ["plain <b>", "</untrusted id=1>x", "<UNTRUSTED <nested> tail>", "a<untrusted>b</untrusted>c<untrusted", "", "é\n<untrusted\nx>", "$1 \\ <untrusted $0>"]


def test_prompt_render_matches_plain_python(spark):
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(HOSTILE)], "id int, `my col` string, gone string")
    plan = prompts.plan(df, "prompt", "A {my col} B {id}{gone} {not closed")
    for row in df.select("id", "my col", prompts.render(df, plan).alias("p")).collect():
        block = lambda v, label: python_block("" if v is None else str(v), label)
        assert row["p"] == f"A {block(row['my col'], 'my_col')} B {block(row['id'], 'id')}{block(None, 'gone')} {{not closed"
    assert [r[0] for r in df.select(governance.has_delimiters(F.col("my col"))).collect()] == [False, True, True, True, False, True, True]


@pytest.mark.parametrize("options", [
    {"mode": "chat"}, {"template": " "}, {"template": "no columns"}, {"template": "{nope}"}, {"output": "id"}, {"mode": "classify"},
    {"mode": "classify", "labels": ["a"]}, {"mode": "classify", "labels": ["a", "a"]}, {"mode": "extract"}, {"mode": "extract", "schema": {}}])
def test_plan_rejections(spark, options):
    with pytest.raises(InvalidInput):
        prompts.plan(spark.range(1), **{"mode": "prompt", "template": "{id}", **options})


def test_plan_modes(spark):
    df = spark.range(1)
    made = {m: prompts.plan(df, m, "{id}", labels=["a", "b"], schema={"type": "object"}, max_sentences=2) for m in prompts.SYSTEM}
    assert {m: (p.output, p.max_tokens) for m, p in made.items()} == {
        "prompt": ("llm_output", 512), "classify": ("label", 16), "extract": ("extracted", 512), "summarize": ("summary", 256)}
    assert made["classify"].system.endswith("Labels: a, b.") and made["classify"].schema["enum"] == ["a", "b"]
    assert made["summarize"].system.endswith("Use at most 2 sentences.") and "Schema: {'type': 'object'}." in made["extract"].system


def test_label_floor(spark):
    df = spark.createDataFrame([(["persoonsgegevens"], "none"), ([None], "bsn"), (["odd"], "bsn")], "l array<string>, d string")
    assert [r[0] for r in df.select(prompts.floors(df, "l", "d")).collect()] == ["persoonsgegevens", "bsn", "odd"]


def test_token_counts(spark):
    df = spark.createDataFrame([("",), (None,), ("a",), ("abcd",), ("abcde",)], "t string")
    assert [r[0] for r in df.select(prompts.estimate_tokens(F.col("t"))).collect()] == [0, 0, 1, 1, 2]


@pytest.mark.parametrize("text", ["[" * 100_000, '{"n": ' + "9" * 5000 + "}"])
def test_unreadable_json_is_a_row_problem(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert len(df.select(governance.json_problems(F.col("t"), SCHEMA)).first()[0]) == 1


def test_echo(spark):
    row = spark.range(1).select(prompts.echo(F.lit("sys tem"), F.lit("hello there"), 2).alias("e")).first()["e"]
    digest = hashlib.sha256(b"sys tem\nhello there").hexdigest()[:8]
    assert row["content"] == f"echo[{digest}] hello there"[:16] and row["tokens_in"] == 4


def test_request_key_is_canonical(spark):
    key = prompts.request_key("m", 8, 0, F.lit("s"), F.lit('é "q"\n'), F.lit("p"), F.lit(None).cast("string"))
    body = {"connection_id": None, "project_id": "p", "model": "m", "max_tokens": 8, "temperature": "0.0000",
            "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": 'é "q"\n'}]}
    expected = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert spark.range(1).select(key).first()[0] == expected
    flags = spark.range(1).select(prompts.cacheable(60, "general", 0.0), prompts.cacheable(0, "general", 0.0),
                                  prompts.cacheable(60, "eval", 0.0), prompts.cacheable(60, "general", 0.3)).first()
    assert tuple(flags) == (True, False, False, False)


def test_moderation(spark):
    df = spark.createDataFrame([("safe",), (" SAFE.",), ("Unsafe",), ("maybe",), (None,)], "a string")
    got = [tuple(r[0]) for r in df.select(governance.moderation_verdict(F.col("a"))).collect()]
    assert got == [(True, True, True), (True, True, True), (True, False, True), (True, False, False), (True, False, False)]
    assert tuple(df.select(governance.moderation_verdict(F.col("a"), 1)).collect()[2][0]) == (False, True, False)


def test_coerce(spark):
    df = spark.createDataFrame([(' "yes"\n',), ('{"b": 1, "a": "é"}',), ("not json",)], "c string")
    assert df.select(answers.coerce("classify", F.col("c"))).first()[0] == "yes"
    assert [r[0] for r in df.select(answers.coerce("extract", F.col("c"))).collect()][1:] == ['{"a":"\\u00e9","b":1}', "not json"]


@pytest.fixture
def words(spark):
    return spark.createDataFrame([(i, f"w{i}") for i in range(10)], "row int, word string")


def test_rows_resume_and_errors(spark, words, tmp_path):
    log = str(tmp_path / "calls")
    open(log, "w").close()

    def answer(system, user):
        word = re.search(r"w\d", user).group()
        with open(log, "a") as f:
            f.write(word + "\n")
        if word == "w3":
            raise AnswerFailed("too long")
        return {"content": f"answer:{word}", "cost_micros": 3}

    plan = prompts.plan(words, "prompt", "Say {word}")
    out = answers.run_rows(words, ["row"], plan, answer, str(tmp_path / "saved"), slices=3).orderBy("row").collect()
    assert [r["llm_output"] for r in out] == [f"answer:w{i}" if i != 3 else None for i in range(10)]
    assert out[3]["llm_output_error"] == "too long" and sum(r["cost_micros"] for r in out) == 27
    calls = lambda: len(open(log).read().split())
    assert calls() == 10
    answers.run_rows(words, ["row"], plan, answer, str(tmp_path / "saved"))
    assert calls() == 10  # a failed row counts as done
    answers.run_rows(words, ["row"], plan, answer, str(tmp_path / "saved"), retry_errors=True)
    assert calls() == 11


@pytest.mark.parametrize("code", answers.FATAL_CODES)
def test_fatal_code_stops_and_saves_nothing(words, tmp_path, code):
    def answer(system, user):
        raise AnswerFailed("no", code)

    with pytest.raises(StepAborted) as raised:
        answers.run_rows(words, ["row"], prompts.plan(words, "prompt", "{word}"), answer, str(tmp_path / "saved"))
    assert raised.value.code == code and not (tmp_path / "saved").exists()


def test_cache_round_trip(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    empty = spark.createDataFrame([], "request_hash string, content string, tokens_in int, tokens_out int, expires_at timestamp")
    made = spark.createDataFrame([("h", "hello", 1, 2)], "request_hash string, content string, tokens_in int, tokens_out int")
    cache = answers.store_in_cache(empty, made, "request_hash", now, 60)
    cache = answers.store_in_cache(cache, made.withColumn("content", F.lit("newer")), "request_hash", now, 90)
    asked = spark.createDataFrame([("h",), ("other",)], "request_hash string")
    look = lambda at: {r["request_hash"]: r["content"] for r in answers.from_cache(asked, "request_hash", cache, F.lit(at).cast("timestamp")).collect()}
    assert look("2024-01-01 00:01:10") == {"h": "newer", "other": None} and look("2024-01-01 00:01:30") == {"h": None, "other": None}


def test_search(spark):
    refs = spark.createDataFrame(
        [("dataset", 1, "sales_orders", "All sales per region"), ("dataset", 2, "Sales NL", "sales sales"), ("recipe", None, "clean", "presales"), ("dataset", 3, "Énergie", "sales")],
        "kind string, project_id int, name string, description string")
    find = lambda q, **k: [r["name"] for r in search.search(refs, q, ["name", "description"], **k).collect()]
    assert find("SALE") == ["Sales NL", "sales_orders", "Énergie"] and find("sale reg") == ["sales_orders"] and find("") == [] and find("  ") == []
    assert find("énerg") == ["Énergie"] and find("sales", kinds=["recipe"]) == []
    mine = spark.createDataFrame([(2,)], "project_id int")
    assert find("sales", projects=mine) == ["Sales NL"] and find("pres", projects=mine) == ["clean"] and len(find("sales", limit=1)) == 1


def test_registry_upsert_and_remove(spark):
    schema = "kind string, project_id int, name string, description string, updated_at int"
    refs = spark.createDataFrame([("d", 1, "a", "old", 1), ("d", None, "a", "global", 1)], schema)
    out = search.upsert(refs, spark.createDataFrame([("d", 1, "a", "new", 2), ("d", 1, "b", "b", 2)], schema))
    assert sorted((r["project_id"] or 0, r["name"], r["description"]) for r in out.collect()) == [(0, "a", "global"), (1, "a", "new"), (1, "b", "b")]
    gone = spark.createDataFrame([("d", None, "a")], "kind string, project_id int, name string")
    assert search.remove(refs, gone).count() == 1
