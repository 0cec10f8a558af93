"""One group identifier for all records linked directly or indirectly.

Alternating large-star and small-star rewrites of the edges.  Large-star links every
larger neighbour of a node to the smallest of its neighbourhood, small-star links
every smaller-or-equal neighbour, and the node, to the smallest; both keep the
connected components.  When a round changes nothing the edges are stars whose centre
is the smallest identifier of the component.

Scale: a rewrite is an aggregation (combined before the shuffle) for the smallest
neighbour and a join that brings it back to the edges.  A node may have a third of
all edges.  Nodes with at least a ``1 / HUBS`` of them, of which there are at most
``HUBS``, have their minimum broadcast, so their edges stay where they are; no other
node brings more than a ``1 / HUBS`` of the edges to one task.  No neighbourhood is ever
collected.  Every round's edges are written to the shared folder, so the plan of a
round stays short and lost executors lose nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpair.sources.shared import drop_table, stage_table

#: Most nodes whose smallest neighbour is broadcast.
HUBS = 20_000


def _with_smallest(edges: DataFrame, most: int) -> DataFrame:
    """``edges (u, v)`` with ``m``, the smallest v of each u; nodes of ``most`` edges or more are hubs."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hubs = F.broadcast(smallest.filter(F.col("n") >= most).select("u", F.col("m").alias("hub")))
    known = edges.join(hubs, "u", "left")
    others = known.filter("hub IS NULL").select("u", "v").join(smallest.filter(F.col("n") < most).select("u", "m"), "u")
    return others.unionByName(known.filter("hub IS NOT NULL").select("u", "v", F.col("hub").alias("m")))


def large_star(edges: DataFrame, most: int) -> DataFrame:
    """Edges ``(v, m)`` for all neighbours v > u, with m the smallest of u and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_smallest(both, most).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def small_star(edges: DataFrame, most: int) -> DataFrame:
    """Edges ``(v, m)`` for all neighbours v < u, and ``(u, m)``; ``edges`` has u > v."""
    found = _with_smallest(edges, most)
    moved = found.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(found.select("u", F.col("m").alias("v"))).distinct()


def _print_of(edges: DataFrame) -> tuple:
    """Number of edges and an order-free fingerprint of them."""
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(h), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def connected_components(pairs: DataFrame, a: str, b: str, hubs: int = HUBS) -> DataFrame:
    """``(node, component)`` for each node linked to a smaller one; component is its smallest identifier.

    Rows with a null end and self-links link nothing.  Repeated and reversed pairs
    count once.  Nodes that are the smallest of their component have no row; an empty
    table gives no rows.  Identifiers are integers.
    """
    ends = pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    edges = stage_table(ends.filter("_a IS NOT NULL AND _b IS NOT NULL AND u > v").select("u", "v").distinct(), "edges")
    seen = _print_of(edges)
    while True:
        most = max(2, -(-2 * seen[0] // hubs))  # both rewrites see at most twice the edges
        wide = stage_table(large_star(edges, most), "large-star")
        narrow = stage_table(small_star(wide, most), "small-star")
        now = _print_of(narrow)
        drop_table(wide)
        drop_table(edges)
        edges = narrow
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now
