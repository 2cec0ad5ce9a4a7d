"""Breadth-first search over links, wave by wave; crawls from a queue with a budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import url as U
from .store import kept, new_path


def edges(pages: DataFrame) -> DataFrame:
    """src, dst: keys of pages(url) and of their links(url), each pair once."""
    e = pages.select(U.crawl_key(F.col("url")).alias("src"), F.explode("links").alias("link"))
    return e.select("src", U.crawl_key(F.col("link.url")).alias("dst")).where(F.col("src") != F.col("dst")).distinct()


def bfs(links: DataFrame, starts: DataFrame, max_depth: int = 3, max_nodes: int | None = 50) -> DataFrame:
    """node, depth: what is reached from starts(node) over links(src, dst), nearest first.

    Each wave joins the frontier with the links and drops what has been seen;
    stops at max_depth, or when a wave finds nothing.  With max_nodes, the
    first ones by (depth, node).
    """
    seen = kept(starts.select("node", F.lit(0).alias("depth")).dropDuplicates(["node"]))
    wave = seen
    for depth in range(1, max_depth + 1):
        new = links.join(wave.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        wave = kept(new.join(seen, "node", "left_anti").select("node", F.lit(depth).alias("depth")))
        if not wave.limit(1).count():
            break
        seen = seen.unionByName(wave)
    return seen if max_nodes is None else seen.orderBy("depth", "node").limit(max_nodes)


def shared_links(links: DataFrame, starts: DataFrame, max_depth: int = 3) -> DataFrame:
    """node, depth: pages reached from starts(node) by links(page_id, href) that pages share.

    A wave goes from pages to their links and from those to all pages that have
    them; a link is followed once, so one that n pages have costs n rows and
    not their pairs.
    """
    links = kept(links.select("page_id", "href").distinct())
    seen = wave = kept(starts.select("node", F.lit(0).alias("depth")).dropDuplicates(["node"]))
    used = None
    for depth in range(1, max_depth + 1):
        new = links.join(wave.select(F.col("node").alias("page_id")), "page_id", "left_semi").select("href").distinct()
        new = kept(new if used is None else new.join(used, "href", "left_anti"))
        used = new if used is None else used.unionByName(new)
        pages = links.join(new, "href", "left_semi").select(F.col("page_id").alias("node")).distinct()
        wave = kept(pages.join(seen, "node", "left_anti").select("node", F.lit(depth).alias("depth")))
        if not wave.limit(1).count():
            break
        seen = seen.unionByName(wave)
    return seen


def summary(crawled: DataFrame) -> DataFrame:
    """crawled(url, depth, success) in one row."""
    ok = F.col("success")
    return crawled.agg(
        F.count_if(ok).alias("crawled"),
        F.count_if(~ok).alias("failed"),
        F.max("depth").alias("max_depth"),
        F.sort_array(F.collect_set(F.when(ok, U.domain(F.col("url"))))).alias("domains"),
        F.sort_array(F.collect_list(F.when(ok, F.col("url")))).alias("sitemap"),
    )


class Frontier:
    """A crawl's queue as a table: nodes with depth and place, in the order in which they were found.

    A wave takes the next `min(budget left, wave)` nodes of the queue; what they
    link to is marked when it is found and goes to the queue's end, in the order
    of the pages that link and of the links on them.  As the queue is first in,
    first out, nodes behind the budget are never reached: none is kept, so the
    table holds `budget` rows at most, and nothing is expanded once it is full.
    Each wave is a folder of its own; a crawl of the same path goes on after
    the last one that is whole.
    """

    SCHEMA = "node string, depth int, place long"

    def __init__(self, spark: SparkSession, path: str, budget: int = 50, wave: int = 10, max_depth: int = 3):
        self.spark, self.path, self.budget, self.wave, self.max_depth = spark, path, budget, wave, max_depth

    def found(self) -> DataFrame:
        return self.spark.read.schema(f"{self.SCHEMA}, wave int").option("basePath", self.path).parquet(f"{self.path}/wave=*")

    def _whole(self) -> list[int]:
        """Nodes that each whole wave found."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        k = 0
        while fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/wave={k}/_SUCCESS")):
            k += 1
        sizes = {r["wave"]: r["n"] for r in self.found().groupBy("wave").agg(F.count("*").alias("n")).collect()} if k else {}
        return [sizes.get(i, 0) for i in range(k)]

    def _keep(self, rows: DataFrame, k: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/wave={k}")

    def run(self, starts: DataFrame, expand: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """node, depth, place of what is crawled from starts(node); expand gives (place, at, dst) of a wave(node, place), `at` the link's order on its page."""
        sizes = self._whole()
        if not sizes:
            first = starts.select("node").distinct().orderBy("node").limit(self.budget)
            self._keep(first.select("node", F.lit(0).alias("depth"), F.row_number().over(Window.orderBy("node")).cast("long").alias("place")), 0)
            sizes = self._whole()
        done = sum([min(self.wave, self.budget)] * (len(sizes) - 1))
        while done < sum(sizes) < self.budget:
            upto = min(done + self.wave, sum(sizes))
            next_ = self.found().where((F.col("place") > done) & (F.col("place") <= upto) & (F.col("depth") < self.max_depth))
            links = expand(next_.select("node", "place")).where(F.col("dst").isNotNull())
            new = links.join(self.found().select(F.col("node").alias("dst")), "dst", "left_anti").groupBy("dst").agg(F.min(F.struct("place", "at")).alias("by"))
            some = new.orderBy("by", "dst").limit(self.budget - sum(sizes))  # at most what the budget has left
            depth = next_.select(F.col("place").alias("_p"), F.col("depth").alias("_d"))
            own = some.join(F.broadcast(depth), F.col("by.place") == F.col("_p"))
            place = F.row_number().over(Window.orderBy("by", "dst")) + sum(sizes)
            self._keep(own.select(F.col("dst").alias("node"), (F.col("_d") + 1).alias("depth"), place.cast("long").alias("place")), len(sizes))
            done = upto
            sizes = self._whole()
        return self.found().select("node", "depth", "place")


def crawl(spark: SparkSession, pages: DataFrame, start: str, max_depth: int = 3, max_pages: int = 50, same_domain: bool = True, exclude: list[str] = (), include: list[str] = (), concurrent: int = 5, path: str | None = None) -> DataFrame:
    """url, depth, success of a crawl from one URL over pages(url, links); links to pages that aren't there fail.

    pages(page_id, url, html) are read as they are reached: only those of a
    wave are parsed.  With a path the crawl can be gone on with.
    """
    base = U.host(F.lit(start))
    keyed = pages.withColumn("_key", U.crawl_key(F.col("url")))

    def expand(wave: DataFrame) -> DataFrame:
        wave = F.broadcast(wave.withColumnRenamed("node", "_node"))  # a wave's rows are a parameter
        here = keyed.join(wave, F.col("_key") == F.col("_node"))
        if "links" not in pages.columns:
            from ..sources import pages as P

            read = P.parsed(here.select("page_id", "url", "html"), ["links"]).withColumn("_key", U.crawl_key(F.col("url")))
            here = read.join(wave, F.col("_key") == F.col("_node"))
        each = here.select("place", "url", F.posexplode("links").alias("pos", "link")).where(U.should_crawl(F.col("link.url"), base, same_domain, exclude=exclude, include=include))
        return each.select("place", F.struct("url", "pos").alias("at"), U.crawl_key(F.col("link.url")).alias("dst"))

    frontier = Frontier(spark, path or new_path(spark, "crawl"), max_pages, 2 * concurrent, max_depth)
    reached = frontier.run(spark.range(1).select(U.crawl_key(F.lit(start)).alias("node")), expand)
    have = keyed.select(F.col("_key").alias("node")).join(reached.select("node"), "node", "left_semi").distinct().withColumn("have", F.lit(True))
    return reached.join(have, "node", "left").select(F.col("node").alias("url"), "depth", F.coalesce("have", F.lit(False)).alias("success"))
