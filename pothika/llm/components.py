"""Problem 5: one group for all records that pairs link directly or indirectly.

Deterministic Boruvka hooking. With edges ordered by (smaller end, larger end), the smallest edge out of a
component leads to its smallest neighbour, so hooking gives trees whose only cycles are pairs that chose each
other; the smaller of such a pair becomes the root. Trees collapse by pointer doubling, edges are relabelled
with the roots and deduplicated, and the next round starts on them until no edge is left. At least half of the
components that have an edge vanish per round, so the rounds are logarithmic in the length of the chains.

Nodes are not rewritten per round: each round keeps one table (component, parent root), and the tables are
composed from the last round to the first. All joins look up a unique key, salted, as one group can hold a
large part of all nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, cut_counting, released, salted_lookup


def _smallest_edges(edges: DataFrame) -> DataFrame:
    """(node, parent): each node's smallest neighbour; of two that chose each other the smaller is a root.

    Two chose each other where both ends of an edge are chosen, so the choices are grouped by edge, which no hub makes hot.
    """
    chosen = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent"))
    by_edge = chosen.groupBy(F.least("node", "parent").alias("lo"), F.greatest("node", "parent").alias("hi")).agg(F.count("*").alias("n"), F.min("node").alias("node"))
    one = F.array(F.struct("node", F.when(F.col("node") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("parent")))
    both = F.array(F.struct(F.col("lo").alias("node"), F.col("lo").alias("parent")), F.struct(F.col("hi").alias("node"), F.col("lo").alias("parent")))
    return by_edge.select(F.inline(F.when(F.col("n") == 2, both).otherwise(one)))


def _roots(pointers: DataFrame) -> DataFrame:
    """Pointer doubling: (node, parent) becomes (node, root)."""
    while True:
        up = pointers.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        moved = F.col("above") != F.col("parent")
        doubled, n = cut_counting(salted_lookup(pointers, up, "parent"), moved)
        released(pointers)
        pointers = doubled.select("node", F.col("above").alias("parent"))
        if not n:
            return pointers


def connected_groups(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(group_no, node) of every node that a pair links to another; group_no is the smallest node of its group.

    Pairs with a null side and pairs of a node with itself link nothing; repeated and turned pairs count once.
    An empty table gives an empty result. Other columns are ignored.
    """
    links = pairs.select(F.col(left).cast("bigint").alias("a"), F.col(right).cast("bigint").alias("b")).filter("a is not null and b is not null and a <> b")
    one_way = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = cut(one_way.union(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        roots = _roots(cut(_smallest_edges(edges)))
        levels.append(roots)
        at = roots.select(F.col("node").alias("a"), F.col("parent").alias("ra"))
        bt = roots.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        half = cut(salted_lookup(edges, at, "a").select("ra", "b"))
        again = cut(salted_lookup(half, bt, "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
        released(edges, half)
        edges = again
    if not levels:
        return one_way.select(F.col("a").alias("group_no"), F.col("b").alias("node"))
    final = levels.pop()
    while levels:
        # a root without an edge in the next round is missing there and keeps itself
        above = final.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        below = levels.pop()
        composed = cut(salted_lookup(below, above, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent")))
        released(final, below)
        final = composed
    smallest = final.groupBy("parent").agg(F.min("node").alias("group_no"))
    return salted_lookup(final, smallest, "parent").select("group_no", "node")
