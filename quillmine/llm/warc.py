"""Operator 1: resolution of not-modified revisit records against earlier full responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmine.llm.common import cut

#: Header fields that a not-modified answer may renew in the stored response (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def canonical_url(url: Column) -> Column:
    """Host in lower case without a default port, path (``/`` at least) and query; scheme and fragment go. Null without ``://``."""
    host = F.lower(F.regexp_extract(url, r"(?s)^[^:/?#]*://([^/?#]*)", 1))
    rest = F.regexp_extract(url, r"(?s)^[^:/?#]*://[^/?#]*([^#]*)", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(host != "", F.concat(F.regexp_replace(host, r":(80|443)$", ""), rest))


def lower_names(headers: Column) -> Column:
    """A header map with lower-case names; of names that differ in case alone the one that sorts last stays. Null becomes empty."""
    entries = F.map_entries(headers)
    kept = F.filter(entries, lambda e: ~F.exists(entries, lambda x: (F.lower(x["key"]) == F.lower(e["key"])) & (x["key"] > e["key"])))
    return F.coalesce(F.map_from_entries(F.transform(kept, lambda e: F.struct(F.lower(e["key"]), e["value"]))), F.create_map().cast("map<string,string>"))


def resolve(records: DataFrame) -> DataFrame:
    """Resolve every ``revisit`` of a capture table to the latest earlier ``response`` of its canonical url.

    Needs ``record_id``, ``kind`` ("response" or "revisit"), ``url``, ``ts``, ``headers`` (map of strings) and
    ``digest``. Earlier is strictly before; of responses at one time the largest record_id counts. The revisit's
    ETag is checked if both have one (weak comparison), else Last-Modified if both have it. Returns for each
    revisit ``record_id``, ``canonical``, ``ts``, ``outcome``, ``response_id``, ``response_ts``, ``digest`` and
    ``headers``. The outcome is resolved, mismatch (a validator differs), unvalidated (no validator in common) or
    no_response. Only a resolved revisit gets the digest and headers of the response, PERMITTED fields renewed.

    Defined cases: a revisit with null url, time or no ``://`` is no_response; responses with these are never
    found; null headers are empty; repeated revisits are resolved each; an empty table gives an empty result;
    other kinds and columns are ignored.

    Scale: rows are range partitioned by url, time and id, so one url may fill many partitions. The latest
    response inside a partition is a window over (partition, url); what a partition needs from earlier ones
    concerns its first url alone, a table of one row a partition, the only side that is broadcast.
    """
    h = lower_names(F.col("headers"))
    rows = records.where("kind in ('response', 'revisit')").select(
        "record_id", "kind", canonical_url(F.col("url")).alias("canonical"), "ts", h.alias("headers"), "digest", (F.col("kind") == "response").cast("int").alias("late")
    )
    lost = rows.where("kind = 'revisit' and (canonical is null or ts is null)")
    rows = rows.where("canonical is not null and ts is not null").repartitionByRange("canonical", "ts", "late", "record_id")
    rows = cut(rows.withColumn("part", F.spark_partition_id()))
    found = F.when(F.col("late") == 1, F.struct("ts", "record_id", "headers", "digest"))
    order = [F.col("ts"), F.col("late"), F.col("record_id")]
    before = Window.partitionBy("part", "canonical").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.last(found, ignorenulls=True).over(before)).where("late = 0")
    firsts = rows.groupBy("part").agg(F.min("canonical").alias("canonical"))
    ends = rows.where("late = 1").join(F.broadcast(firsts.select("canonical").distinct()), "canonical", "left_semi")
    ends = ends.groupBy("canonical", "part").agg(F.max_by(F.struct("ts", "record_id", "headers", "digest"), F.struct("ts", "record_id")).alias("end"))
    over = Window.partitionBy("canonical").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = firsts.join(ends, ["canonical", "part"], "full").withColumn("far", F.last("end", ignorenulls=True).over(over)).where("far is not null").select("canonical", "part", "far")
    got = near.join(F.broadcast(carried), ["canonical", "part"], "left").withColumn("hit", F.coalesce("near", "far")).drop("near", "far", "part", "late")
    got = got.unionByName(lost.drop("late").withColumn("hit", F.lit(None).cast(got.schema["hit"].dataType)))
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    mine, stored = F.col("headers"), F.col("hit.headers")
    tag, old_tag, time, old_time = mine["etag"], stored["etag"], mine["last-modified"], stored["last-modified"]
    got = got.withColumn(
        "outcome",
        F.when(F.col("hit").isNull(), "no_response")
        .when(tag.isNotNull() & old_tag.isNotNull(), F.when(weak(tag) == weak(old_tag), "resolved").otherwise("mismatch"))
        .when(time.isNotNull() & old_time.isNotNull(), F.when(time == old_time, "resolved").otherwise("mismatch"))
        .otherwise("unvalidated"),
    )
    renewed = F.map_filter(mine, lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(stored, lambda k, _: ~F.map_contains_key(renewed, k)), renewed)
    done = F.col("outcome") == "resolved"
    return got.select(
        "record_id", "canonical", "ts", "outcome", F.col("hit.record_id").alias("response_id"), F.col("hit.ts").alias("response_ts"),
        F.when(done, F.col("hit.digest")).alias("digest"), F.when(done, merged).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """A capture log for a page table, which has none of its own: a response and a revisit of every page.

    Times, validators and gaps follow from page_id by fixed arithmetic, so that all outcomes occur.
    """
    p, t = F.col("page_id"), (F.lit(1704067200) + F.col("page_id") * 7919 % 2592000)
    tag = F.concat(F.lit('"'), F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary")), F.lit('"'))
    changed = F.concat(F.lit("t"), (t - 3600).cast("string"))
    again = t + 86400 * (p % 5 - 1)
    text = lambda **kw: F.map_filter(F.create_map(*[x for k, v in kw.items() for x in (F.lit(k.replace("_", "-")), v)]), lambda _, v: v.isNotNull())
    full = F.struct(
        (p * 2).alias("record_id"), F.lit("response").alias("kind"), F.col("url"), t.alias("ts"),
        text(ETag=tag, Last_Modified=changed, Content_Type=F.lit("text/html"), Cache_Control=F.lit("max-age=3600"), Date=t.cast("string")).alias("headers"),
        F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("digest"),
    )
    their_tag = F.when(p % 11 == 0, F.lit('"stale"')).when((p % 7 != 0) & (p % 13 != 0), F.concat(F.lit("W/"), tag))
    revisit = F.struct(
        (p * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), F.col("url"), again.alias("ts"),
        text(etag=their_tag, last_modified=F.when(p % 13 != 0, changed), cache_control=F.lit("max-age=60"), date=again.cast("string"), set_cookie=F.lit("a=b")).alias("headers"),
        F.lit(None).cast("string").alias("digest"),
    )
    return pages.select(F.explode(F.array(full, revisit)).alias("r")).select("r.*")
