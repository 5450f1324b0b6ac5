"""Not-modified revisits of a web archive: which stored response a revisit stands for, and its merged headers.

A revisit is joined, by canonical URL, to the latest full response captured before it. Its validators must agree
with that response's; then the stored headers are updated with those that a 304 is permitted to change.

All captures are ranged by (URL, time) and written, so a URL with any share of the rows is cut into chunks. The
latest response flows on inside a chunk by a window, and from chunk to chunk by one carry row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millrace.operators.ordered import CHUNK, chunked, with_carry

# Headers about the message or its body, which a not-modified answer doesn't update.
NOT_UPDATED = ["connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive",
               "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"]
TRACKING = "^(utm_[^=]*|fbclid|gclid)(=|$)"


def canonical(url: Column) -> Column:
    """host[:port]path[?query]: no scheme, user, `www.`, default port, fragment, last slash or tracking
    parameters; host in lower case, parameters in order. Null for what isn't an http(s) URL."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(plain, "^[A-Za-z]+://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"^[A-Za-z]+://[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(plain, r"^[^?]*\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    whole = F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))
    return F.when(plain.rlike("^(?i:https?)://[^/?]"), whole)


def lower_names(headers: Column) -> Column:
    """Headers with names in lower case; of equal names the last stays. Null becomes empty."""
    entries = F.coalesce(F.map_entries(headers), F.expr("cast(array() as array<struct<key:string,value:string>>)"))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"]))


def merged(stored: Column, new: Column) -> Column:
    """Stored headers updated with the permitted ones of a not-modified answer; both with lower-case names."""
    put = F.filter(F.map_entries(new), lambda e: ~e["key"].isin(NOT_UPDATED))
    names = F.transform(put, lambda e: e["key"])
    return F.map_from_entries(F.concat(F.filter(F.map_entries(stored), lambda e: ~F.array_contains(names, e["key"])), put))


def resolve(records: DataFrame, record_id: str = "record_id", kind: str = "kind", url: str = "url", at: str = "at", status: str = "status", headers: str = "headers") -> DataFrame:
    """One row per revisit row: record_id, canonical, at, ref_id, verdict, headers.

    verdict: `resolved` (ETags agree weakly, or, where one lacks, Last-Modified dates do), `changed` (they
    differ), `unverified` (no validator in common), `orphan` (no earlier full response; ref_id is null).
    `headers`: the merged ones where resolved, else the revisit's own. Full responses are of kind `response` with
    status 200. A response of the same time is not earlier; of responses of one time the greater id counts. A
    null or foreign URL, or no time, makes an orphan. Repeated revisits are answered each.
    """
    slim = records.select(F.col(record_id).alias("id"), canonical(F.col(url)).alias("site"), F.col(at).alias("at"), (F.col(kind) == "revisit").alias("asks"),
                          ((F.col(kind) == "response") & (F.col(status) == 200)).alias("gives"), lower_names(F.col(headers)).alias("headers"))
    slim = slim.filter("asks OR gives")
    seen = F.struct("at", "id", "headers")
    # At one time, revisits stand before responses.
    placed = chunked(slim.filter("site IS NOT NULL AND at IS NOT NULL").withColumn("gave", F.when(F.col("gives"), seen)), ["site"], ["at", "gives", "id"])
    inside = W.partitionBy("site", CHUNK).orderBy("at", "gives", "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy("site").orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    last = placed.groupBy("site", CHUNK).agg(F.max_by(F.col("gave"), F.when(F.col("gives"), F.struct("at", "id"))).alias("out"))
    carry = last.select("site", CHUNK, F.last("out", ignorenulls=True).over(before).alias("carried")).filter("carried IS NOT NULL")
    local = placed.withColumn("found", F.last("gave", ignorenulls=True).over(inside)).filter("asks")
    found = with_carry(local, carry, ["site"]).select("id", "site", "at", "headers", F.coalesce("found", "carried").alias("ref"))
    lost = slim.filter("asks AND (site IS NULL OR at IS NULL)").select("id", "site", "at", "headers", F.lit(None).cast(found.schema["ref"].dataType).alias("ref"))
    every = found.unionByName(lost)
    tag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    mine, theirs = tag(F.col("headers")), tag(F.col("ref.headers"))
    day, their_day = F.col("headers")["last-modified"], F.col("ref.headers")["last-modified"]
    verdict = F.when(F.col("ref").isNull(), "orphan").when(mine.isNotNull() & theirs.isNotNull(), F.when(mine == theirs, "resolved").otherwise("changed")) \
        .when(day.isNotNull() & their_day.isNotNull(), F.when(day == their_day, "resolved").otherwise("changed")).otherwise("unverified")
    return every.select(F.col("id").alias("record_id"), F.col("site").alias("canonical"), "at", F.col("ref.id").alias("ref_id"), verdict.alias("verdict"),
                        F.when(verdict == "resolved", merged(F.col("ref.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"))


def header_text(headers: Column) -> Column:
    """`name: value` lines in the order of the names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
