"""Not-modified revisits: the latest earlier full response of the same canonical URL.

Records are response (full) or revisit (not modified). An as-of join finds for
each revisit the latest full response of its URL before it; the validators that
the revisit names must be those of that response; the headers that a
not-modified answer may update are merged into it.

One URL may hold any share of the records, so the as-of join is not a window
over a URL. Narrow rows are range-partitioned by URL and time; each partition
looks back within itself, and a URL that spans partitions carries its last full
response over, with one row per URL and partition. Headers are joined afterwards,
to the records that need them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxweave.llm.common import quoted
from rxweave.session import cut_lineage

#: Query parameters that name a visit, not a resource.
VISIT_PARAMETERS = r"^(utm_[a-z]+|phpsessid|jsessionid|sessionid|sid)(=|$)"

#: Headers that a not-modified answer may not change: they belong to the stored body or to one connection.
FIXED_HEADERS = ["content-encoding", "content-length", "content-range", "content-type", "connection", "keep-alive", "proxy-authenticate",
                 "proxy-authentication-info", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade"]

COLUMNS = ["record_id", "url", "captured_at", "kind", "headers", "payload_digest"]


def canonical_url(url: Column) -> Column:
    """Host and path in lower-case host, without scheme, www, default port, fragment, visit parameters and closing slash; parameters sorted."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":(80|443)$", ""), r"^www\d*\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?]*([^?]*)", 1), "/+$", "")
    parameters = F.filter(F.array_sort(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")), lambda p: (p != "") & ~F.lower(p).rlike(VISIT_PARAMETERS))
    query = F.array_join(parameters, "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def latest_earlier(records: DataFrame) -> DataFrame:
    """``record_id`` of each revisit and ``original_id`` of the latest full response of its URL with an earlier time, or null.

    Of responses at one time the one with the largest id counts as the latest.
    """
    spark = records.sparkSession
    full = F.col("kind") == "response"
    # at equal times revisits come first: a response must be earlier
    rows = records.select("canonical_url", "captured_at", full.alias("full"), "record_id").where("canonical_url IS NOT NULL AND captured_at IS NOT NULL AND record_id IS NOT NULL")
    placed = cut_lineage(spark, rows.repartitionByRange("canonical_url", "captured_at", "full", "record_id").withColumn("part", F.spark_partition_id()), "records")
    own = F.when(F.col("full"), F.col("record_id"))
    order = Window.partitionBy("canonical_url", "part").orderBy("captured_at", "full", "record_id")
    within = placed.withColumn("original_id", F.last(own, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))).where("NOT full")
    last = F.max_by(F.when(F.col("full"), F.col("record_id")), F.when(F.col("full"), F.struct("captured_at", "record_id")))
    ends = placed.groupBy("canonical_url", "part").agg(last.alias("last"))
    over = Window.partitionBy("canonical_url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per URL and partition
    carried = ends.withColumn("carried", F.last("last", ignorenulls=True).over(over)).where("carried IS NOT NULL").select("canonical_url", "part", "carried")
    return within.join(carried, ["canonical_url", "part"], "left").select("record_id", F.coalesce("original_id", "carried").alias("original_id"))


def merged_headers(stored: Column, update: Column) -> Column:
    """Stored headers with those of the update that may change; names in lower case."""
    allowed = F.map_filter(update, lambda k, v: ~k.isin(FIXED_HEADERS))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(allowed, k)), allowed)


def _lower_names(headers: Column) -> Column:
    """Header names in lower case; of names equal then, the last in order of the name as written."""
    entries = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["key"].alias("written"), e["value"].alias("v"))))
    last = F.filter(entries, lambda e, i: F.coalesce(F.try_element_at(entries, i + 2)["k"] != e["k"], F.lit(True)))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, canonical_url, original_id, ``verdict``, ``headers`` and ``payload_digest``.

    ``records``: record_id, url, captured_at, kind (response or revisit), headers
    (map of strings), payload_digest; others are ignored. Verdicts: ``resolved``;
    ``no_original``; ``mismatch``, where an entity tag (compared weakly), else a
    modification time, or a payload digest differs from the original's; a
    revisit that names none of them is ``unvalidated``. Headers and digest are
    null unless resolved or unvalidated. Revisits without URL, time or id have
    no original; rows repeated in full give one row each.
    """
    rows = records.select(*[F.col(quoted(c)) for c in COLUMNS]).withColumn("canonical_url", canonical_url(F.col("url"))).withColumn(
        "headers", _lower_names(F.coalesce("headers", F.create_map().cast("map<string,string>"))))
    rows = rows.select("record_id", "canonical_url", "captured_at", "kind", "headers", "payload_digest")
    found = latest_earlier(rows).dropDuplicates(["record_id"])
    stored = rows.where("kind = 'response'").select(F.col("record_id").alias("original_id"), F.col("headers").alias("stored"), F.col("payload_digest").alias("stored_digest")).dropDuplicates(["original_id"])
    joined = rows.where("kind = 'revisit'").join(found, "record_id", "left").join(stored, "original_id", "left")
    tag, changed = F.col("headers")["etag"], F.col("headers")["last-modified"]
    wrong = F.when(tag.isNotNull(), ~_weak(tag).eqNullSafe(_weak(F.col("stored")["etag"]))).when(changed.isNotNull(), ~changed.eqNullSafe(F.col("stored")["last-modified"])).otherwise(False)
    wrong = wrong | (F.col("payload_digest").isNotNull() & ~F.col("payload_digest").eqNullSafe(F.col("stored_digest")))
    verdict = F.when(F.col("original_id").isNull(), "no_original").when(wrong, "mismatch").when(F.coalesce(tag, changed, F.col("payload_digest")).isNull(), "unvalidated").otherwise("resolved")
    good = F.col("verdict").isin("resolved", "unvalidated")
    return joined.withColumn("verdict", verdict).select(
        "record_id", "canonical_url", "original_id", "verdict", F.when(good, merged_headers(F.col("stored"), F.col("headers"))).alias("headers"), F.when(good, F.col("stored_digest")).alias("payload_digest"))


def page_records(pages: DataFrame) -> DataFrame:
    """Two records per row of ``pages`` (page_id, url, html): its full response, and a later or earlier not-modified answer under another spelling of the URL."""
    page = F.col("page_id")
    tag = F.concat(F.lit('"'), F.substring(F.sha2(F.coalesce("html", F.lit("")), 256), 1, 16), F.lit('"'))
    when = F.concat(F.lit("day "), (page % 1000).cast("string"))
    full = pages.select(
        (page * 2).alias("record_id"), "url", page.alias("captured_at"), F.lit("response").alias("kind"),
        F.create_map(F.lit("ETag"), tag, F.lit("Last-Modified"), when, F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length("html").cast("string"), F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"),
        F.sha2("html", 256).alias("payload_digest"))
    named = F.when(page % 7 == 0, F.lit('"other"')).when(page % 3 == 0, F.concat(F.lit("W/"), tag)).when(page % 3 == 1, tag)
    answer = F.map_filter(F.create_map(F.lit("Etag"), named, F.lit("last-modified"), F.when(page % 2 == 0, when), F.lit("Cache-Control"), F.lit("max-age=600"), F.lit("Content-Length"), F.lit("0"), F.lit("Date"), when), lambda k, v: v.isNotNull())
    spelled = F.concat(F.regexp_replace(F.regexp_replace("url", "#.*$", ""), r"^https?://(www\d*\.)?", "HTTP://www."), F.lit("#again"))
    again = pages.select((page * 2 + 1).alias("record_id"), spelled.alias("url"), (page + F.when(page % 11 == 0, -1).otherwise(1 + page % 5)).alias("captured_at"), F.lit("revisit").alias("kind"), answer.alias("headers"), F.lit(None).cast("string").alias("payload_digest"))
    return full.unionByName(again)
