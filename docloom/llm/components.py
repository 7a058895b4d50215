"""Connected components of an undirected graph, by DataFrame joins only.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).
Every step is an aggregation with map-side combine and a join that hands each node's smallest neighbour to its edges; no
adjacency list is gathered anywhere. Nodes with many edges, of which there are at most MOST_HUBS, get it by broadcast, so
the edges of a hub stay where they are; the others' edges meet by shuffle. The number of steps grows with the logarithm of
the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.tables import drop, written

#: A node with more edges is a hub; where that would make more than MOST_HUBS of them (2 MB), the limit rises.
HUB_EDGES, MOST_HUBS = 256, 100_000


def _star(edges: DataFrame, small: bool, hub: int) -> DataFrame:
    """edges (u, v), u > v. small: each node and its smaller neighbours go to the smallest of them; else: its larger ones go to the smallest of all its neighbours and itself."""
    both = edges if small else edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select("u", F.least("u", "m").alias("m"), "c")
    hubs = least.filter(F.col("c") > hub).select("u", F.col("m").alias("hub_m"))
    known = both.join(F.broadcast(hubs), "u", "left")
    others = least.filter(F.col("c") <= hub).select("u", "m")
    met = known.filter("hub_m is not null").select("u", "v", F.col("hub_m").alias("m")).union(known.filter("hub_m is null").select("u", "v").join(others, "u"))
    if small:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node that has an edge to another; component is its smallest reachable node.

    Null ends and loops are ignored; repeated edges count once. An empty table gives an empty table.
    """
    now = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct(),
        "edges",
    )
    state = None
    while True:
        # A forest of stars has as many edges as nodes that are not roots, and a step no longer changes it.
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == state or found[0] == 0:
            break
        state = tuple(found)
        hub = max(HUB_EDGES, 2 * found[0] // MOST_HUBS)
        following = written(_star(_star(now, False, hub), True, hub), "edges")
        drop(now)
        now = following
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
