"""One registered query per operation, with production parameters, on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.llm import collocations, conversations, decontaminate, languages, licenses, mixing, neardup, ngrams, pseudonyms, quality, revisits, substrings, tokencount
from millrace.suite import Suite, table

suite = Suite()

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key_of(spark) -> str:
    """The secret that pseudonyms hang on, from the session; a fixed one where none is set, as in tests."""
    return spark.conf.get("spark.millrace.pseudonym.key", "not a secret: set spark.millrace.pseudonym.key")


@suite.add()
def op1_mixing(spark, sf):
    return mixing.taken(mixing.plan(table(spark, sf, "documents"), keep=["doc_id"]), ["doc_id"])


@suite.add()
def op2_pseudonyms(spark, sf):
    return pseudonyms.pseudonymise(table(spark, sf, "documents"), "found", key_of(spark), keep=["doc_id"]).select("doc_id", "found.*")


@suite.add()
def op3_languages(spark, sf):
    docs = table(spark, sf, "documents")
    out = languages.held_out(F.col("doc_id"), 3)
    trees = languages.train(docs.filter(~out))
    found = languages.predict(docs.select("doc_id", "text"), trees, "found", keep=["doc_id"])
    return found.select("doc_id", out.alias("held_out"), "found.*")


@suite.add()
def op4_lm_scores(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = languages.held_out(F.col("doc_id"), 5)
    model = ngrams.train(docs.filter(~out))
    scored = ngrams.score(docs, model, "scored", keep=["doc_id"])
    return scored.select("doc_id", out.alias("held_out"), F.col("scored.n_tokens").alias("n_tokens"), F.col("scored.n_known").alias("n_known"),
                         F.lit(model.level.tokens).cast("long").alias("train_tokens"), "scored.base_score", "scored.score")


@suite.add(rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    items AS (SELECT item, least(13, len(w)) AS n, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
    windows AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM items),
    starts AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
    hits AS (SELECT doc_id, item, i, s.n FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS x FROM starts) s JOIN windows USING (n, x)),
    words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
    found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)""")
def op5_decontaminate(spark, sf):
    found = decontaminate.find_items(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "found", keep=["doc_id"])
    return found.select("doc_id", *decontaminate.verdict("found"))


def captures(pages):
    """Archive records of every page: a full response, for some another one later or a failed one, and a revisit."""
    html, p = F.coalesce("html", F.lit("")), F.col("page_id")
    tag, day = F.md5(html), F.concat(F.lit("day "), (p % 5).cast("string"))
    entry = lambda name, value: F.struct(F.lit(name).alias("key"), value.cast("string").alias("value"))
    record = lambda n, kind, status, url, at, *headers: F.struct(
        (p * 4 + n).alias("record_id"), F.lit(kind).alias("kind"), F.lit(status).alias("status"), url.alias("url"), at.alias("at"),
        F.map_from_entries(F.filter(F.array(*headers), lambda e: e["value"].isNotNull())).alias("headers"))
    url, length = F.col("url"), F.octet_length(html)
    first = record(0, "response", 200, url, p * 10, entry("ETag", F.when(p % 7 != 0, tag)), entry("Last-Modified", day), entry("Content-Length", length), entry("Cache-Control", p % 3))
    second = record(1, "response", 200, F.concat(url, F.lit("#again")), p * 10 + 1000, entry("etag", F.concat(tag, F.lit("b"))), entry("Content-Length", length + 1), entry("X-Crawl", F.lit("2")))
    failed = record(2, "response", 503, url, p * 10 + 1500, entry("Retry-After", F.lit("9")))
    asked = record(3, "revisit", 304, F.when(p % 11 != 0, url), p * 10 + F.when(p % 13 == 0, -5).otherwise(F.when(p % 2 == 0, 500).otherwise(2000)),
                   entry("ETag", F.when(p % 17 != 0, F.concat(F.when(p % 4 == 3, F.lit("W/")).otherwise(F.lit("")), tag, F.when((p % 3 == 0) & (p % 2 == 1), F.lit("b")).otherwise(F.lit(""))))),
                   entry("Last-Modified", F.when(p % 19 != 0, day)), entry("Content-Length", F.lit("0")), entry("Cache-Control", p % 4))
    some = F.filter(F.array(first, F.when(p % 3 == 0, second), F.when(p % 5 == 0, failed), asked), lambda r: r.isNotNull())
    return pages.select(F.explode(some).alias("r")).select("r.*")


@suite.add(r"""
    WITH made AS (SELECT page_id AS p, url, coalesce(html, '') AS html FROM pages),
    facts AS (SELECT p, url, md5(html) AS tag, 'day ' || (p % 5) AS day, strlen(html) AS n FROM made),
    r AS (SELECT p * 4 AS id, url, p * 10 AS at, CASE WHEN p % 7 <> 0 THEN tag END AS etag, day AS modified, CAST(n AS VARCHAR) AS length, CAST(p % 3 AS VARCHAR) AS cache, NULL AS crawl FROM facts
          UNION ALL SELECT p * 4 + 1, url, p * 10 + 1000, tag || 'b', NULL, CAST(n + 1 AS VARCHAR), NULL, '2' FROM facts WHERE p % 3 = 0),
    v AS (SELECT p * 4 + 3 AS id, CASE WHEN p % 11 <> 0 THEN url END AS url, p * 10 + CASE WHEN p % 13 = 0 THEN -5 WHEN p % 2 = 0 THEN 500 ELSE 2000 END AS at,
                 CASE WHEN p % 17 <> 0 THEN (CASE WHEN p % 4 = 3 THEN 'W/' ELSE '' END) || tag || (CASE WHEN p % 3 = 0 AND p % 2 = 1 THEN 'b' ELSE '' END) END AS etag,
                 CASE WHEN p % 19 <> 0 THEN day END AS modified, CAST(p % 4 AS VARCHAR) AS cache FROM facts),
    urls AS (SELECT DISTINCT url, regexp_replace(trim(url), '#.*$', '') AS u FROM (SELECT url FROM r UNION SELECT url FROM v)),
    parts AS (SELECT url, u, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, '^[A-Za-z]+://([^/?]*)', 1)), '^.*@', ''), ':(80|443)$', ''), '^www\.', '') AS host,
                     regexp_replace(regexp_extract(u, '^[A-Za-z]+://[^/?]*([^?]*)', 1), '/+$', '') AS path,
                     array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '^[^?]*\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|fbclid|gclid)(=|$)'))), '&') AS query FROM urls),
    names AS (SELECT url, CASE WHEN regexp_matches(u, '^(?i:https?)://[^/?]') THEN host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS site FROM parts),
    rs AS (SELECT r.*, site FROM r JOIN names USING (url) WHERE site IS NOT NULL),
    vs AS (SELECT v.*, site FROM v LEFT JOIN names USING (url)),
    latest AS (SELECT vs.id AS vid, max(struct_pack(a := rs.at, i := rs.id)) AS ref FROM vs JOIN rs ON vs.site = rs.site AND rs.at < vs.at GROUP BY vs.id),
    paired AS (SELECT vs.id AS record_id, vs.site AS canonical, vs.at AS at, rs.id AS ref_id, regexp_replace(vs.etag, '^W/', '') AS a, regexp_replace(rs.etag, '^W/', '') AS b,
                    vs.modified AS c, rs.modified AS d, vs.etag AS ve, vs.cache AS vc, rs.etag AS re, rs.length AS rl, rs.cache AS rc, rs.crawl AS rx
             FROM vs LEFT JOIN latest ON vs.id = vid LEFT JOIN rs ON rs.id = ref.i),
    judged AS (SELECT *, CASE WHEN ref_id IS NULL THEN 'orphan' WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN a = b THEN 'resolved' ELSE 'changed' END
                              WHEN c IS NOT NULL AND d IS NOT NULL THEN CASE WHEN c = d THEN 'resolved' ELSE 'changed' END ELSE 'unverified' END AS verdict FROM paired)
    SELECT record_id, canonical, "at", ref_id, verdict, CASE WHEN verdict = 'resolved'
        THEN concat_ws(chr(10), 'cache-control: ' || coalesce(vc, rc), 'content-length: ' || rl, 'etag: ' || coalesce(ve, re), 'last-modified: ' || coalesce(c, d), 'x-crawl: ' || rx)
        ELSE concat_ws(chr(10), 'cache-control: ' || vc, 'content-length: 0', 'etag: ' || ve, 'last-modified: ' || c) END AS headers
    FROM judged""")
def op6_revisits(spark, sf):
    return revisits.resolve(captures(table(spark, sf, "pages"))).withColumn("headers", revisits.header_text(F.col("headers")))


@suite.add()
def op7_token_counts(spark, sf):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    counted = tokencount.count_tokens(table(spark, sf, "documents").select("doc_id", "text"), "counted", path, keep=["doc_id"])
    return counted.select("doc_id", "counted.*", (F.col("counted.n_tokens") > 4096).alias("over_limit"))


@suite.add()
def op8_quality(spark, sf):
    judged = quality.judge(table(spark, sf, "documents"), "judged", keep=["doc_id"])
    return judged.select("doc_id", "judged.*")


@suite.add()
def op9_neardup(spark, sf):
    return neardup.near_duplicates(table(spark, sf, "documents")).drop("node")


@suite.add(r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    starts AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
    earliest AS (SELECT x, min(doc_id) AS first FROM starts GROUP BY x HAVING count(*) > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM starts JOIN earliest USING (x) WHERE first < doc_id),
    lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
           sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE [w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(ps, i)] END, ' ')) AS kept_sha256
    FROM d LEFT JOIN lists USING (doc_id)""")
def op10_substrings(spark, sf):
    left = substrings.remove_repeats(table(spark, sf, "documents"), "left", keep=["doc_id"])
    return left.select("doc_id", "left.n_words", "left.n_removed", "left.kept_sha256")


@suite.add(rf"""
    WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
    words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
    grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 4) AS t(k) WHERE len(w) >= k)),
    f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL),
    total AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang),
    c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 10),
    cuts AS MATERIALIZED (SELECT *, array_to_string(w[1:cut], ' ') AS x1, array_to_string(w[cut + 1:], ' ') AS x2 FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
    sides AS (SELECT cuts.*, x.n AS l, y.n AS r, CAST(a AS HUGEINT) * a * 1000000 // (CAST(x.n AS HUGEINT) * y.n) AS score
              FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = x1 JOIN f y ON y.lang = cuts.lang AND y.phrase = x2),
    best AS (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    inside AS (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3),
    kept AS (SELECT * FROM best WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = best.lang AND i.phrase = best.phrase AND 100 * i.a >= 50 * best.a)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT p.lang, rank, phrase, a, l, r, CAST(total.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM placed p JOIN total ON total.lang = p.lang WHERE rank <= 2000""")
def op11_collocations(spark, sf):
    return collocations.collocations(table(spark, sf, "documents"))


def damage(turns):
    """Rows dropped, emptied, cut, repeated or given to the user by a check sum of conversation and turn."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", said("conv_id"), said("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    role = F.when(kind == 4, conversations.USER).otherwise(said("role"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("times"))
    return rows.select("*", F.explode(F.array_repeat(F.lit(1), F.col("times")))).drop("times", "col")


def repair_sql() -> str:
    """The repair in SQL: a recursion over the rows of each conversation, which holds the cheapest (cost, audit, turns)
    that end in each of four states."""
    add = lambda x, cost, letter, turn: f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 'o': list_append({x}.o, {turn})}}" if turn else f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 'o': {x}.o}}"
    least = lambda *xs: f"least({', '.join(xs)})"
    put = lambda x, role: add(x, 3, "I", f"'{role}:'")
    kept = lambda x, kind: f"CASE WHEN kind = '{kind}' AND NOT gone THEN {add(x, 'cut', 'K', 'role || chr(58) || text')} END"
    new = lambda x, role: f"CASE WHEN NOT gone THEN {add(x, '3 + cut', 'R', f'{chr(39)}{role}:{chr(39)} || text')} END"
    none = "{'c': 1000000000::BIGINT, 'a': '', 'o': CAST([] AS VARCHAR[])}"
    start = "{'c': 0::BIGINT, 'a': '', 'o': CAST([] AS VARCHAR[])}"
    n = [add(f"s{k}", 4, "D", "") for k in range(4)]
    n1 = least(n[1], kept("s0", "s"))
    n2 = least(n[2], *(f(x, k) for x in ("s0", "s1", "s3") for f, k in ((kept, "u"), (new, "user"))))
    n3 = least(n[3], kept("s2", "a"), new("s2", "assistant"))
    return rf"""
    WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM range(256) t(i))),
    given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
    summed AS (SELECT g.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda x, b: xor(x >> 8, tab[(xor(x, b) & 255) + 1])), 4294967295) % 20 AS d FROM given g, crc),
    damaged AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                       unnest(range(CASE WHEN d = 0 THEN 0 WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM summed),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, regexp_replace(text, '[ 	-]+$', '') AS bare FROM damaged),
    judged AS (SELECT *, bare = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, right(bare, 1) NOT IN ('.', '!', '?') AS broken,
                      left(role, 1) AS kind, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS next FROM placed),
    coded AS (SELECT conv_id, i, role, text, kind, blank OR again AS gone, CASE WHEN broken THEN 3 ELSE 0 END AS cut FROM judged),
    walk(conv_id, i, s0, s1, s2, s3) AS (
        SELECT conv_id, 0::BIGINT, {start}, {none}, {put(start, "user")}, {put(put(start, "user"), "assistant")} FROM (SELECT DISTINCT conv_id FROM coded)
        UNION ALL
        SELECT conv_id, i, s0, s1, t2, least(s3, {put("t2", "assistant")}) FROM (
            SELECT conv_id, i, s0, s1, {least("s2", put("s0", "user"), put("s1", "user"), put("s3", "user"))} AS t2, s3 FROM (
                SELECT w.conv_id, c.i, {n[0]} AS s0, {n1} AS s1, {n2} AS s2, {n3} AS s3 FROM walk w JOIN coded c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.i = w.i + 1))),
    ended AS (SELECT conv_id, least(s0, s3) AS r FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
    facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
                     count(*) FILTER (broken AND NOT blank AND NOT again) AS truncated, count(*) FILTER (next IS NOT NULL AND kind || next NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
           coalesce(r.c, 0) AS cost, coalesce(r.a, '') AS audit, sha256(coalesce(array_to_string(r.o, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id"""


@suite.add(repair_sql())
def op12_conversations(spark, sf):
    turns = table(spark, sf, "conversations")
    audit, left = conversations.repair(damage(turns))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    hashes = conversations.digests(left)
    found = audit.join(hashes, audit["conv"].eqNullSafe(hashes["conv"])).select(audit["conv"], *counts, "audit", "sha256")
    known = turns.select("conv_id").distinct()
    nothing = {**{c: F.lit(0).cast("long") for c in counts}, "audit": F.lit(""), "sha256": F.sha2(F.lit(""), 256)}
    whole = known.join(found, known["conv_id"].eqNullSafe(found["conv"]), "left")
    return whole.select("conv_id", *(F.coalesce(c, v).alias("repaired_sha256" if c == "sha256" else c) for c, v in nothing.items()))


def license_sql() -> str:
    """The scan in SQL: its templates as values, votes on diagonals, spans of near diagonals."""
    texts = [*((*p, "true") for p in licenses.PHRASES), *((*n, "false") for n in licenses.NOTICES)]
    values = ", ".join(f"({i}, '{label}', string_split('{text}', ' '), {base})" for i, (label, text, base) in enumerate(texts))
    return rf"""
    WITH t AS (SELECT * FROM (VALUES {values}) AS v(t, label, w, base)),
    t_runs AS (SELECT t, label, base, len(w) AS size, len(w) - 2 AS runs, p - 1 AS place, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS run FROM (SELECT *, unnest(range(1, len(w) - 1)) AS p FROM t)),
    d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    d_runs AS (SELECT row, p - 1 AS p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS run FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) > 2)),
    hits AS (SELECT row, t, label, base, size, runs, place, p, p - place AS diagonal FROM d_runs JOIN t_runs USING (run)),
    near AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY row, t ORDER BY diagonal, place) <= 4 THEN 0 ELSE 1 END AS starts FROM hits),
    spanned AS (SELECT *, sum(starts) OVER (PARTITION BY row, t ORDER BY diagonal, place) AS span FROM near),
    spans AS (SELECT row, label, (max(p) + 2 - min(p) + 1) AS words, any_value(size) AS size, count(DISTINCT place) / any_value(runs) AS part FROM spanned GROUP BY row, t, label, span),
    exact AS (SELECT row, label, diagonal FROM hits WHERE base GROUP BY row, t, label, diagonal HAVING count(*) = any_value(runs)),
    b AS (SELECT row, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM exact GROUP BY row),
    named AS (SELECT row, label FROM exact UNION SELECT row, label FROM spans WHERE part >= 0.85 AND words <= size * 1.25 + 4),
    l AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM named GROUP BY row),
    s AS (SELECT row, max(part) AS score FROM spans GROUP BY row)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
    FROM d LEFT JOIN b USING (row) LEFT JOIN l USING (row) LEFT JOIN s USING (row)"""


@suite.add(license_sql())
def op13_licenses(spark, sf):
    found = licenses.scan(table(spark, sf, "documents").select("doc_id", "text"), "found", keep=["doc_id"])
    return found.select("doc_id", *(f"found.{c}" for c in licenses.FIELDS if c != "spans"))


@suite.add()
def pipeline(spark, sf):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)
