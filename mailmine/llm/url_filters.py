"""URL filters by a dated list: a temporal join in DataFrame functions alone.

List changes (an entry, a date, listed or cleared) become validity intervals; a capture is
evaluated against the entries that were active when it was fetched. A capture looks up its
host, every parent domain of two labels or more, every directory prefix of its path and the page
itself (host and path without query), so the as-of join is an equi-join on the looked-up key with the fetch time inside the interval:
nothing is compared with everything. A host may own a third of all captures: captures are dealt
over ``salts`` per key and the list side is repeated for each salt.

Defined results: a null url, or one without a host, matches nothing and is allowed; a null fetch
time matches nothing; changes without entry or date are ignored; of several changes of an entry
at one time listing wins; a repeated listing changes nothing; repeated captures are each
evaluated; an empty list allows all. Hosts are
compared in lower case without port and user; a trailing dot and percent signs stay as they are. The most specific active entry decides (longest; then by text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SALTS = 16
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)"


def host_of(url: Column) -> Column:
    """The host in lower case, '' if there is none."""

    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def lookup_keys(host: Column, url: Column) -> Column:
    """host, its parent domains of two labels or more, host/dir/ for each directory of the path, and the page."""

    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
                          lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, n), ".")))
    path = F.regexp_extract(url, PATH, 1)
    parts = F.split(path, "/")
    depth = F.size(parts)
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(depth - 1, F.lit(1))),
                           lambda i: F.concat(F.lit("p:"), host, F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    page = F.array(F.concat(F.lit("u:"), host, F.when(path == "", F.lit("/")).otherwise(path)))
    return F.array_distinct(F.concat(domains, prefixes, page))


def intervals(changes: DataFrame) -> DataFrame:
    """(entry, valid_from, valid_to): the times an entry was listed; valid_to is null while it still is.

    ``changes``: entry string, at timestamp, listed boolean."""

    known = changes.where("entry is not null and at is not null")
    moments = known.groupBy("entry", "at").agg(F.max(F.coalesce("listed", F.lit(False))).alias("listed"))
    order = Window.partitionBy("entry").orderBy("at")
    moments = moments.withColumn("before", F.lag("listed").over(order))
    moments = moments.where(F.col("listed") != F.coalesce("before", F.lit(False)))
    return moments.withColumn("valid_to", F.lead("at").over(order)).where("listed").select(
        "entry", F.col("at").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, changes: DataFrame, salts: int = SALTS) -> DataFrame:
    """(page_id, host, fetched_at, n_active, decided_by, listed_at, blocked): one row per capture.

    ``captures``: page_id, url, fetched_at."""

    captures = captures.select("page_id", "url", "fetched_at")
    rows = captures.withColumn("host", host_of(F.col("url"))).withColumn("row", F.monotonically_increasing_id())
    salt = F.pmod(F.xxhash64("row"), F.lit(salts))
    keys = F.when(F.col("host") != "", lookup_keys(F.col("host"), F.col("url")))
    asked = rows.select("row", "page_id", "host", "fetched_at", salt.alias("salt"), F.explode_outer(keys).alias("entry"))
    spans = intervals(changes).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    active = (F.col("c.entry") == F.col("l.entry")) & (F.col("c.salt") == F.col("l.salt"))
    active = active & (F.col("c.fetched_at") >= F.col("l.valid_from")) & (F.col("l.valid_to").isNull() | (F.col("c.fetched_at") < F.col("l.valid_to")))
    met = asked.alias("c").join(spans.alias("l"), active, "left")
    decides = F.when(F.col("l.entry").isNotNull(), F.struct(F.length("l.entry").alias("size"), F.col("l.entry").alias("entry"), F.col("l.valid_from").alias("since")))
    judged = met.groupBy("c.row").agg(
        F.first("c.page_id").alias("page_id"), F.first("c.host").alias("host"), F.first("c.fetched_at").alias("fetched_at"),
        F.count("l.entry").alias("n_active"), F.max(decides).alias("top"))
    return judged.select("page_id", "host", "fetched_at", "n_active", F.col("top.entry").alias("decided_by"),
                         F.col("top.since").alias("listed_at"), (F.col("n_active") > 0).alias("blocked"))
