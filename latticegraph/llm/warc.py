"""Resolution of not-modified revisits in a table of WARC records.

A record has an id, a url, a capture time, a type (response or revisit), an ETag and a Last-Modified validator, headers
and a payload. A revisit has no payload of its own; it refers to the latest earlier full response (a response with
status 200) of the same canonical URL. The reference holds if a validator that both records carry agrees (ETags are
compared weakly, Last-Modified literally) and none that both carry differs. A revisit that resolves gets the payload of
the full response and its headers, with those that a 304 answer may update taken from the revisit.

The as-of join is done on (URL, time, id) alone, in blocks of rank: distinct ones are dealt out by ranges, so a block holds
its share of rows even where one URL or one time holds most of them. The latest full response inside a block comes from
a window over (URL, block), the one before it from a map-side combined maximum per (URL, block) that is carried over the
blocks of a URL, of which there are no more than shuffle partitions. Payloads are joined last, for referenced responses
only.

Defined results: a null URL never resolves; records with one time are ordered by id; a null time is earliest, and of one
time a null id; a response is no source for a revisit of its own time and id; if full responses share URL, time and id,
the one with the smallest payload is the source; ids may repeat across URLs and times; every record of the input appears
once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch

#: Header fields that a 304 answer carries on behalf of the stored response (RFC 9110, 15.4.5), lower-cased.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified")


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, path without trailing slash, query sorted and without
    tracking parameters; scheme and fragment go."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    before = F.regexp_extract(bare, r"^([^?]*)", 1)
    host = F.lower(F.regexp_extract(before, r"^([^/]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(before, r"^[^/]*(.*)$", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|fbclid|gclid|sessionid)=")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _same(a: Column, b: Column) -> Column:
    """Null if either is missing, else whether they agree; ETags compare without the weak mark."""
    strip = lambda c: F.regexp_replace(c, r"^W/", "")
    return strip(a) == strip(b)


def latest_full(records: DataFrame, blocks: int | None = None) -> DataFrame:
    """canonical, at and id of revisits that have an earlier full response, each once, with its source_at and source_id;
    written.

    records has canonical, at (long), id and is_full; blocks is the number of shuffle partitions unless given. A response
    is earlier if its (at, id) is smaller; nulls are smallest.
    """
    n = blocks or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with scratch() as keep:
        # records that agree in all of these have one answer
        rows = records.filter("canonical is not null").select("canonical", "at", "id", "is_full").distinct()
        dealt = rows.repartitionByRange(n, "canonical", F.col("at").asc_nulls_first(), F.col("id").asc_nulls_first())
        # written with the block's number, which a task that runs again could otherwise change
        rows = materialize(dealt.withColumn("block", F.spark_partition_id()), "ranked-records")
        full = F.when(F.col("is_full"), F.struct("at", "id"))
        ends = rows.groupBy("canonical", "block").agg(F.max(full).alias("end"))
        earlier = Window.partitionBy("canonical").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select("canonical", "block", F.max("end").over(earlier).alias("carried"))
        # a revisit before a response of the same time and id
        inside = Window.partitionBy("canonical", "block").orderBy(F.col("at").asc_nulls_first(), F.col("id").asc_nulls_first(), "is_full").rowsBetween(Window.unboundedPreceding, -1)
        found = rows.withColumn("inside", F.max(full).over(inside)).filter(~F.col("is_full")).join(carried, ["canonical", "block"])
        found = found.withColumn("source", F.coalesce("inside", "carried")).filter("source is not null")
        return keep(materialize(found.select("canonical", "at", "id", F.col("source.at").alias("source_at"), F.col("source.id").alias("source_id")), "latest-full"))


def _joined(left: DataFrame, right: DataFrame, names: dict[str, str], how: str) -> DataFrame:
    """left joined where its columns equal, or are null like, those of right, which go."""
    own = {name: f"_{k}" for k, name in enumerate(names.values())}
    right = right.withColumnsRenamed(own)
    on = [F.col(a).eqNullSafe(F.col(own[b])) for a, b in names.items()]
    out = left.join(right, on, how)
    return out if how == "left_semi" else out.drop(*own.values())


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Every record with its canonical URL, outcome, source_id, merged headers and payload.

    records has id (long), url, at (long), type, status (int), etag, last_modified, headers (map of lower-cased names)
    and payload. Outcomes: full, other (neither full nor revisit), resolved, changed (a validator differs), unchecked
    (no validator in common), missing (no earlier full response).
    """
    r = records.select("id", "url", "at", "type", "status", "etag", "last_modified", "headers", "payload").withColumn("canonical_url", canonical_url(F.col("url")))
    is_full = F.coalesce((F.col("type") == "response") & (F.col("status") == 200), F.lit(False))
    is_revisit = F.coalesce(F.col("type") == "revisit", F.lit(False))
    slim = r.filter(is_full | is_revisit).select(F.col("canonical_url").alias("canonical"), "at", "id", is_full.alias("is_full"))
    refs = latest_full(slim)
    # a source is named by URL, time and id, so one of another URL or time never stands in for it
    wanted = refs.select("canonical", "source_at", "source_id").distinct()
    order = F.struct("payload", "etag", "last_modified", F.to_json("headers").alias("h"))
    named = {"canonical_url": "canonical", "at": "source_at", "id": "source_id"}
    sources = _joined(r.filter(is_full), wanted, named, "left_semi").groupBy(F.col("canonical_url").alias("canonical"), F.col("at").alias("source_at"), F.col("id").alias("source_id"))
    sources = sources.agg(F.min_by(F.struct("etag", "last_modified", "headers", "payload"), order).alias("s"))
    found = _joined(refs, sources, {"canonical": "canonical", "source_at": "source_at", "source_id": "source_id"}, "inner").withColumnRenamed("at", "revisit_at").withColumnRenamed("id", "revisit_id")
    revisits = _joined(r.filter(is_revisit).drop("payload"), found.drop("source_at"), {"canonical_url": "canonical", "at": "revisit_at", "id": "revisit_id"}, "left")
    etag, modified = _same(F.col("etag"), F.col("s.etag")), F.col("last_modified") == F.col("s.last_modified")
    agrees = F.coalesce(etag, F.lit(True)) & F.coalesce(modified, F.lit(True))
    outcome = F.when(F.col("s").isNull(), "missing").when(~agrees, "changed").when(etag.isNull() & modified.isNull(), "unchecked").otherwise("resolved")
    empty = F.create_map().cast("map<string,string>")
    updates = F.map_filter(F.coalesce("headers", empty), lambda k, v: k.isin(*PERMITTED))
    stored = F.map_filter(F.coalesce("s.headers", empty), lambda k, v: ~F.map_contains_key(updates, k))
    done = revisits.withColumn("outcome", outcome)
    ok = F.col("outcome") == "resolved"
    done = done.select("id", "url", "canonical_url", "at", "type", "outcome", F.when(ok, F.col("source_id")).alias("source_id"), F.when(ok, F.map_concat(stored, updates)).otherwise(F.col("headers")).alias("headers"), F.when(ok, F.col("s.payload")).alias("payload"))
    rest = r.filter(~is_revisit).select("id", "url", "canonical_url", "at", "type", F.when(is_full, "full").otherwise("other").alias("outcome"), F.lit(None).cast("long").alias("source_id"), "headers", "payload")
    return rest.union(done)


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Pages as a capture log: page_id is id and time.

    A page fetched by a fragment or feed link is a conditional request, recorded as a revisit without payload; every other
    page is a full response. The ETag is a digest of the page's main resource, its title line, as the server saw it at
    the time, weak for a revisit and missing where there is no title; so a revisit may find the stored page changed, or
    have no validator to check.
    """
    revisit = F.coalesce(F.col("url").rlike(r"#|[?&]utm_"), F.lit(False))
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.when(title != "", title).cast("binary")), 1, 16), F.lit('"'))
    etag = F.when(revisit, F.concat(F.lit("W/"), tag)).otherwise(tag)
    date = F.concat(F.lit("t"), F.col("page_id").cast("string"))
    headers = F.map_from_arrays(F.array(F.lit("date"), F.lit("server"), F.when(revisit, "x-cache").otherwise("content-type")), F.array(date, F.lit("nginx"), F.when(revisit, "hit").otherwise("text/html")))
    return pages.select(F.col("page_id").alias("id"), "url", F.col("page_id").alias("at"), F.when(revisit, "revisit").otherwise("response").alias("type"), F.when(revisit, 304).otherwise(200).alias("status"), etag.alias("etag"), F.lit(None).cast("string").alias("last_modified"), headers.alias("headers"), F.when(~revisit, F.col("html")).alias("payload"))
