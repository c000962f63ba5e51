"""Reachability and clusters over edge tables, by joins until nothing changes.

Each round is a written table in the shared folder, so the lineage stays short and
a lost executor costs one round. The driver sees only counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calyx import runtime


def closure(seeds: DataFrame, edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``node, level`` of all nodes reachable from the seeds over ``edges(src, dst)``; cycles are fine.

    Semi-naive: each round follows only the nodes that are new and appends them to
    what was visited, which is never written again. A graph that is deeper than
    ``max_rounds`` raises an error.
    """
    links = runtime.Stage(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), "links")
    visited = [runtime.Stage(seeds.where("node is not null").select("node", F.lit(0).alias("level")).distinct(), "visited")]
    for level in range(1, max_rounds + 1):
        known = _joined(visited)
        step = visited[-1].df.join(links.df, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        new = runtime.Stage(step.join(known.select("node"), "node", "left_anti").withColumn("level", F.lit(level)), "visited")
        visited.append(new)
        if new.df.limit(1).count() == 0:
            break
    else:
        raise RuntimeError(f"the closure did not end in {max_rounds} rounds")
    links.drop()
    return _joined(visited)


def _joined(stages: list[runtime.Stage]) -> DataFrame:
    """All of the stages as one scan."""
    first = stages[0]
    return first.spark.read.schema(first.df.schema).parquet(*[s.path for s in stages])


def clusters(nodes: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``node, cluster, label``: clusters numbered from 0 by ``label``, their smallest node.

    Contraction: every round each vertex joins the neighbour (or itself) of least
    rank, ranks being drawn anew by hashing, and edges are rewritten between what is
    left. About half of the vertices go each round whatever the shape of the graph,
    so rounds are few and each is cheaper than the one before. The rounds' maps are
    then applied one after the other. Nodes without an edge are their own cluster.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    left = runtime.Stage(both.where("src is not null and dst is not null and src <> dst").distinct(), "edges")
    maps = []
    for number in range(max_rounds):
        if left.df.limit(1).count() == 0:
            break
        rank = lambda c, n=number: F.xxhash64(F.lit(n), F.col(c))
        best = F.min(F.struct(rank("dst").alias("rank"), F.col("dst").alias("id"))).alias("best")
        joins = left.df.groupBy("src").agg(best).select("src", F.when(F.col("best.rank") < rank("src"), F.col("best.id")).otherwise(F.col("src")).alias("to"))
        step = runtime.Stage(joins, "joins")
        maps.append(step.df)
        ends = left.df.join(step.df.withColumnRenamed("to", "_a"), "src").join(step.df.select(F.col("src").alias("dst"), F.col("to").alias("_b")), "dst")
        after = runtime.Stage(ends.where("_a <> _b").select(F.col("_a").alias("src"), F.col("_b").alias("dst")).distinct(), "edges")
        left.drop()
        left = after
    else:
        raise RuntimeError(f"clusters did not settle in {max_rounds} rounds")
    found = nodes.where("node is not null").select("node").distinct().withColumn("rep", F.col("node"))
    for step in maps:
        found = found.join(step.withColumnRenamed("src", "rep"), "rep", "left").select("node", F.coalesce("to", "rep").alias("rep"))
    found = runtime.cut(found, "clusters")
    labels = found.groupBy("rep").agg(F.min("node").alias("label"))
    numbers = runtime.numbered(labels.select("label"), "label", "cluster")
    return found.join(labels, "rep").join(numbers, "label").select("node", "cluster", "label")
