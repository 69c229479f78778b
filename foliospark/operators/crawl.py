"""Breadth-first crawl over a table of fetched pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions.urls import CrawlPolicy, canonical_url, in_scope
from foliospark.session import materialize


def _heads(queue: DataFrame, taken: DataFrame | None, cap: int) -> DataFrame:
    """Of each base's queue the first entries, as many as it may still take; at most ``cap`` are ranked."""
    order = W.partitionBy("base").orderBy("path", "url")
    head = queue.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= cap)
    if taken is not None:
        head = head.join(taken, "base", "left").where(F.col("__n") <= cap - F.coalesce("taken", F.lit(0))).drop("taken")
    return head.drop("__n")


def crawl(pages: DataFrame, seeds: DataFrame, policy: CrawlPolicy) -> DataFrame:
    """Accepted pages (base, url, depth, place): the depth and place at which the crawl of a base takes them.

    ``pages`` has canonical_url, links and accepted; ``seeds`` has url, n (their order) and base.
    A round for each depth: the queue is read in slices of what a base may still take, so no page is read beyond the
    page cap; links of accepted pages are filtered by scope, and known URLs are left out by an anti-join.  Queue order is a
    page's path of places, one number for each depth, and only a slice of the cap's size is ranked.
    """
    pages = pages.select("canonical_url", "links", "accepted")
    seeds = seeds.select(canonical_url(F.col("base")).alias("base"), canonical_url(F.col("url")).alias("url"), F.col("n").cast("long"))
    queue = materialize(seeds.groupBy("base", "url").agg(F.array(F.min("n")).alias("path")), "queue")
    seen, found, taken = queue.select("base", "url"), None, None
    for depth in range(policy.max_depth + 1):
        here = None
        while True:
            head = materialize(_heads(queue, taken, policy.max_pages), "head")
            if head.isEmpty():
                break
            read = head.join(pages, F.col("url") == F.col("canonical_url")).where("accepted")
            read = materialize(read.select("base", "url", F.lit(depth).alias("depth"), "path", "links"), "crawl")
            here = read if here is None else here.union(read)
            found = read if found is None else found.union(read)
            taken = materialize(found.groupBy("base").agg(F.count(F.lit(1)).alias("taken")), "taken")
            queue = materialize(queue.join(head.select("base", "url"), ["base", "url"], "left_anti"), "queue")
        if depth == policy.max_depth or here is None:
            break
        # a page's links follow those of pages before it: order by (page, place in page)
        step = here.select("base", "path", F.posexplode("links").alias("pos", "url"))
        step = step.where(in_scope(F.col("url"), F.col("base"), policy))
        path = F.concat("path", F.array(F.col("pos").cast("long")))
        first = step.groupBy("base", "url").agg(F.min(path).alias("path"))
        queue = materialize(first.join(seen, ["base", "url"], "left_anti"), "queue")
        seen = seen.union(queue.select("base", "url"))
    if found is None:
        return seen.limit(0).select("base", "url", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("place"))
    order = W.partitionBy("base").orderBy("depth", "path", "url")
    # at most the cap's pages of each base
    return found.select("base", "url", "depth", F.row_number().over(order).cast("long").alias("place"))
