"""Connected components of a link table, without bringing links to one task or the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.sources.workspace import pin


def components(links: DataFrame) -> DataFrame:
    """Smallest node reachable from each linked node: columns node, root (long).

    ``links`` has columns a and b (long, not NULL); order, repeats and loops do not matter. Each
    round hangs the neighbours of every node on the smallest of them, first the larger ones, then
    the smaller ones, until every tree is a star; the number of rounds grows with the logarithm of
    the longest path. What a round makes is written to the shared folder. Minima are combined
    before the shuffle, and the joins that bring them back leave Spark free to split a hot node.
    """
    pairs = links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    stars = pin(pairs.distinct(), "links")
    before = None
    while True:
        stars = _hang_smaller(_hang_larger(stars))
        now = stars.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))
        ).first()
        if now == before:
            break
        before = now
    roots = stars.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return pin(stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots), "roots")


def _hang_larger(links: DataFrame) -> DataFrame:
    """Links (a > b): each node's larger neighbours go to its smallest neighbour or itself."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = pin(least.select("u", F.least("u", "m").alias("m")), "least")
    hung = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return pin(hung.filter("a != b"), "links")


def _hang_smaller(links: DataFrame) -> DataFrame:
    """Links (a > b): each node and its smaller neighbours go to the smallest of these."""
    least = pin(links.groupBy("a").agg(F.min("b").alias("m")), "least")
    hung = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    hung = hung.union(least.select("a", F.col("m").alias("b")))
    return pin(hung.filter("a != b").distinct(), "links")
