"""Connected components over a table of links, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of ``links(a, b)``; component is the smallest node reachable.

    Alternates two star contractions: each node first hands its larger
    neighbours, then its smaller ones, to the smallest it knows, until every
    tree is a star. The number of rounds grows with the logarithm of the
    longest path. Each minimum is a partial aggregate; the join of a node's links
    with its minimum is a sort-merge join, of which Spark's adaptive execution
    splits a node with very many links. Each round is written to the shared
    folder. Self-links and repeated links are harmless; no links give no rows.
    """
    stars = scratch.save(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0"
    )
    seen, turn = None, 0
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(floor, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        turn += 1
        fresh = scratch.save(floor.select("u", F.col("m").alias("v")).union(down).distinct(), f"{name}-{turn}")
        state = fresh.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}-{turn - 1}")
        stars = fresh
        if tuple(state) == seen:
            break
        seen = tuple(state)
    leaf = stars.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    root = stars.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return leaf.union(root)


def extended_components(reached: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``reached(node, component)`` after more ``links(a, b)``: only the components that these join are looked at again."""
    own = lambda end: reached.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    joined = links.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    roots = scratch.save(connected_components(joined, scratch, name), f"{name}-roots")
    moved = reached.join(roots.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left")
    fresh = roots.join(reached.select("node"), "node", "left_anti").select("node", "component")
    return moved.select("node", F.coalesce("root", "component").alias("component")).union(fresh)
