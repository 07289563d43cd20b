"""Connected components of links between numbered nodes, by alternating stars.

Each round hangs the larger neighbours of a node, and then the smaller ones, on its smallest neighbour; after a few rounds (of the
order of the logarithm of the nodes) every node hangs on the smallest of its component. A round is two aggregations and two joins
on rows of two numbers. Rounds are written to the shared folder, so lineage stays short and a lost executor costs one round.

Nodes are numbers. Links that are null, repeated or of a node with itself say nothing; no links give no rows. The smallest node of a
component is its root, so there are no ties. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molweave.sources.scratch import stored


# Parts of all links of which a hub has more than one, and links that a node may have at any size.
HUB = 1000
HUB_LEAST = 1000


def _to_least(links: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """(a, b, m): links with the smallest neighbour of ``a``; and (a, m) of every node."""
    least = links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    many = F.col("n") > max(HUB_LEAST, total // HUB)
    # At most 2 * HUB rows, since a link stands at two nodes.
    hubs = F.broadcast(least.filter(many).select("a", "m"))
    met = links.join(hubs, "a")
    rest = links.join(hubs.select("a"), "a", "left_anti").join(least.filter(~many).select("a", "m"), "a")
    return met.unionByName(rest), least.select("a", "m")


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Neighbours (large: only larger ones; small: only smaller ones, and the node itself) hang on the smallest neighbour."""
    total = links.count()
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        met, _ = _to_least(both, total)
        moved = met.filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
    else:
        met, least = _to_least(links, total)
        moved = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def _is_star(links: DataFrame) -> bool:
    """True if every node hangs on one other that itself hangs on none."""
    twice = links.groupBy("a").count().filter("count > 1").limit(1)
    chained = links.select("a").distinct().join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1)
    return not twice.count() and not chained.count()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link but is not the smallest of its component. ``links``: (a, b), b < a."""
    links = stored(links.select("a", "b").filter("b < a").distinct(), "links")
    while not _is_star(links):
        links = stored(_star(links, large=True), "links")
        links = stored(_star(links, large=False), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
