"""Connected components of links held in a table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """links: columns a, b of any ordered type. Returns node, root: the least node of its component, for each linked node.

    In each step every node ties its neighbours to the least of them and itself, until all links are stars: a logarithm
    of the longest path in steps, with three shuffles of as many rows as there are links. What a node has around it is
    only ever aggregated, so a hub is no single task's.
    """
    now = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "stars")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        around = written(both.groupBy("u").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.sum((F.col("v") < F.col("u")).cast("long")).alias("lesser")), "around")
        # in a star the centre has no lesser neighbour, and the others have the centre alone
        if not around.filter("least < u and (most > u or lesser > 1)").head(1):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        tied = both.join(around.select("u", F.least("u", "least").alias("m")), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        now = written(tied.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")


def joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """roots (node, root: of all linked so far) with further links. Only the roots that these link are looked at; finished
    components are carried over."""
    if roots is None:
        return written(components(links), "roots")
    at = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    between = links.select("a", "b").join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    now = written(components(between.filter("a <> b").distinct()), "joined").withColumnsRenamed({"node": "old", "root": "new"})
    moved = roots.join(now, roots["root"] == now["old"], "left").select("node", F.coalesce("new", "root").alias("root"))
    fresh = now.join(roots.select("node"), now["old"] == roots["node"], "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
    return written(moved.unionByName(fresh), "roots")
