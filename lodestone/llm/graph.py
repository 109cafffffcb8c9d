"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(links: DataFrame) -> DataFrame:
    """``links(a long, b long)`` -> ``(node, component)`` for every node with a link to another one.

    ``component`` is the smallest node reachable. Null ends and self-links are ignored; repeated and
    reversed links are harmless; an empty table gives an empty result. Each round's edges are written
    to the shared folder, so a lost executor costs one round; the driver sees two numbers per round.
    The joins are sort-merge joins on the node, which adaptive execution splits when a node is a hub.
    """
    edges = shared.save(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc"
    )
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(low, F.col("a") == F.col("n")).select(
            F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        )
        new = shared.save(small.select("e.a", "e.b").where("a <> b").distinct(), "cc")
        shared.drop(edges)
        edges, after = new, _state(new)
        if after == before:
            break
        before = after
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
