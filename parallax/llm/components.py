"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al., 2014).

Every round is joins and grouped minima, so no group is gathered in one task and nothing reaches the driver but one
count and one checksum a round. Minima are sent to every task where they are few. Else those of hubs are, of which there
are at most the number of edges over ``HUB``, and only the rest is shuffled, so no hub's edges meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


#: Edges up to which minima are sent to every task; neighbours from which a node is a hub.
FEW, HUB = 1_000_000, 20_000


def _with_least(edges: DataFrame, least: DataFrame, few: bool) -> DataFrame:
    """Edges (u, v) with m of ``least`` (u, m, n), which has every u once, with its number of neighbours."""
    if few:
        return edges.join(F.broadcast(least.drop("n")), "u")
    hubs = F.broadcast(least.where(F.col("n") >= HUB).drop("n"))
    return edges.join(hubs, "u").select("u", "v", "m").union(edges.join(hubs, "u", "left_anti").join(least.drop("n"), "u").select("u", "v", "m"))


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(u, v) edges in any direction, repeats and self loops allowed -> (node, root), root the least reachable node.

    Nodes without an edge to another node do not appear. An edge with a null end is ignored; no edges give no rows.
    """
    now = scratch.save(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    seen = _sum(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        few = seen[0] <= FEW
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _with_least(both.where("v > u"), least, few).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        parent = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = (
            _with_least(large, parent, few)
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(parent.select("u", F.col("m").alias("v")))
            .distinct()
        )
        nxt = scratch.save(small)
        scratch.drop(now)
        now, before = nxt, seen
        seen = _sum(now)
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _sum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]
