"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved

#: Rounds after which something must be wrong: each one halves the nodes, or nearly.
MOST_ROUNDS = 60


def _best(col):
    """Nodes in a random order, so that long paths shorten by a share each round."""
    return F.struct(F.xxhash64(col).alias("rank"), col.alias("node"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); two nodes have the same root
    when a path joins them. Each round points every node to its first neighbour in
    a random order, and contracts; each round is written to the shared folder, and those before it are removed.
    Edges from a node to itself only name the node; nulls are left out; no edges
    give no rows."""
    edges = saved(edges.select("a", "b").dropna().distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("root"))
    nodes = saved(nodes, "roots")
    rest, written = edges.filter("a <> b"), edges
    for _ in range(MOST_ROUNDS):
        if rest.isEmpty():
            discard(written)
            return nodes
        both = rest.select("a", "b").union(rest.select("b", "a"))
        to = both.groupBy("a").agg(F.least(_best(F.col("a")), F.min(_best(F.col("b")))).alias("to")).select("a", F.col("to.node").alias("to"))
        to = saved(to, "hooks")
        old, nodes = nodes, saved(nodes.join(to, nodes["root"] == to["a"], "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        left = rest.join(to.withColumnRenamed("to", "x"), "a").select("x", "b")
        new = left.join(to.select(F.col("a").alias("b"), F.col("to").alias("y")), "b").filter("x <> y")
        rest = saved(new.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(old, to, written)
        written = rest
    raise RuntimeError("the components did not settle")
