"""Connected components of a graph given by links, by contraction on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docguard.llm.common import Handoff


def connected_components(links: DataFrame, out: Handoff, step: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of links (a, b): the smallest node that is reachable; written as a step of `out`.

    In each round every node points to the smallest node next to it, pointers are followed twice, and the links are
    drawn anew between what the nodes point to. At least half of the nodes that still have links go in a round, so the
    rounds grow with the logarithm of the number of nodes. All steps are grouped minima and joins that Spark can
    split; nothing but the number of links left comes to the driver. Nulls and links of a node to itself are dropped.
    """
    hand = Handoff(links.sparkSession, f"{out.name}-{step}")
    current = hand.write(links.filter("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "links0")
    maps = []
    for k in range(most_rounds):
        if current.isEmpty():
            break
        both = current.unionByName(current.selectExpr("b AS a", "a AS b"))
        to = hand.write(both.groupBy("a").agg(F.min("b").alias("b")).selectExpr("a AS node", "least(a, b) AS up"), f"up{k}")
        for hop in range(2):
            above = to.selectExpr("node AS up", "up AS over")
            to = hand.write(to.join(above, "up").selectExpr("node", "over AS up"), f"hop{k}-{hop}")
            hand.drop(f"up{k}" if hop == 0 else f"hop{k}-0")
        maps.append(to)
        ends = to.selectExpr("node AS a", "up AS x")
        moved = current.join(ends, "a").join(to.selectExpr("node AS b", "up AS y"), "b")
        current = hand.write(moved.filter("x <> y").selectExpr("greatest(x, y) AS a", "least(x, y) AS b").distinct(), f"links{k + 1}")
        hand.drop(f"links{k}")
    else:
        raise RuntimeError("links are left after the last round")
    result = maps[0].selectExpr("node", "up AS component") if maps else current.selectExpr("a AS node", "b AS component")
    for to in maps[1:]:
        result = result.join(to.selectExpr("node AS component", "up"), "component", "left").selectExpr(
            "node", "coalesce(up, component) AS component")
    written = out.write(result, step)
    hand.drop()
    return written


def roots(n: int, a, b):
    """Smallest reachable number of each of n items linked pairwise (arrays of item numbers), within one task."""
    import numpy as np

    parent = np.arange(n)
    while True:
        x, y = parent[a], parent[b]
        if (x == y).all():
            return parent
        low = np.minimum(x, y)
        np.minimum.at(parent, x, low)
        np.minimum.at(parent, y, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
