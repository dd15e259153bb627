"""Main text of web pages: containers are scored page by page, and the pages of a host agree on paths.

1. Each page's containers are scored by the text they hold, against links, menus and other furniture.
   A page gives points to the paths (tags and classes, without digits) of its best containers.
2. Points are added up per host and path in Spark. Paths that are the best of at least a tenth of
   a host's pages win, at most ten a host, in the order of their points.
3. Each page is read again with the winning paths of its host: the first one that holds text on
   the page is extracted; a page without any of them gives its own best container.

The table of winners is written, so the planner knows its size: small ones are broadcast, beyond the
session's threshold pages and winners meet by host, where adaptive execution splits hot hosts.

Defined results: a null or empty page, and one without text, has an empty text and no path; a page
without a host (null or odd url) is judged by itself; repeated rows each give points and a row; ties of
points go to the path that was best more often, then to the smaller one; ``br`` is white space, table cells
are blocks; lists and boxes of nothing but three or more links are menus; further columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailmine.llm.page_tree import Page
from mailmine.llm.tables import keep, prepare
from mailmine.llm.url_filters import host_of

LEAST_SHARE = 10    # a path wins if it is the best of at least one page in so many of its host


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(host, *vote) for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True)
               for vote in Page(page.as_py() or "").votes()]
        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "path", "points", "best"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [Page(page.as_py() or "").text(paths or []) for paths, page in zip(batch.column("paths").to_pylist(), batch.column("html"), strict=True)]
        yield pa.RecordBatch.from_arrays([
            batch.column("page_id"), batch.column("url"), pa.array([t for t, _ in out], pa.string()),
            pa.array([len(t) for t, _ in out], pa.int64()), pa.array([p for _, p in out], pa.string())],
            names=["page_id", "url", "text", "n_chars", "path"])


def _with_host(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    host = host_of(F.col("url"))
    return rows.withColumn("host", F.when(host != "", host))


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, paths): the agreed paths of each host of ``pages(url, html)``, best first."""

    votes = _with_host(pages).where("host is not null").select("host", "html").mapInArrow(_votes, "host string, path string, points bigint, best bigint")
    summed, _ = keep(votes.groupBy("host", "path").agg(F.sum("points").alias("points"), F.sum("best").alias("best")), "path-votes")
    hosts = summed.groupBy("host").agg(F.sum("best").alias("pages"))
    won = summed.join(hosts, "host").where(F.col("best") * LEAST_SHARE >= F.col("pages"))
    order = F.struct((-F.col("points")).alias("points"), (-F.col("best")).alias("best"), "path")
    return won.groupBy("host").agg(F.sort_array(F.collect_list(order)).getField("path").alias("paths"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, path) for each row of ``pages(page_id, url, html)``."""

    prepare(pages.sparkSession)
    winners, _ = keep(winning_paths(pages), "winning-paths")
    return _with_host(pages).join(winners, "host", "left").select("page_id", "url", "html", "paths").mapInArrow(
        _texts, "page_id bigint, url string, text string, n_chars bigint, path string")
