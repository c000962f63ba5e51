"""Connected components of match pairs by alternating large-star and small-star.

Edges are rewritten by distributed joins until a round changes nothing. After a
large-star every vertex hands its larger neighbours to its smallest neighbour;
after a small-star every vertex hands its smaller neighbours, and itself, to the
smallest of them. At the fixpoint each vertex points at its component's minimum.
Rounds grow with the logarithm of the component size, not with its diameter.

Per round only integer pairs are shuffled; the minimum of a vertex is combined
map-side, and reaches the edges of a hot vertex by a broadcast whose size is
bounded (``runtime.attach_group``). Each round is a written table in the shared
folder. The driver sees one count and one checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calyx import runtime


def match_edges(pairs: DataFrame, a: str, b: str, score: str, threshold: float) -> DataFrame:
    """Distinct pairs ``u > v`` of two different non-null ids whose score counts.

    A null or NaN score, a null id and a record matched with itself are no edge;
    either order and repeated comparisons give one edge.
    """
    linked = (
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
        & F.col(score).isNotNull() & ~F.isnan(score) & (F.col(score) >= threshold)
    )
    return pairs.where(linked).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()


def _large_star(edges: DataFrame, hot_rows: int, held: list[runtime.Stage]) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = runtime.attach_group(both, ["u"], [F.min("v").alias("m")], hot_rows, held)
    return near.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(edges: DataFrame, hot_rows: int, held: list[runtime.Stage]) -> DataFrame:
    near = runtime.attach_group(edges, ["u"], [F.min("v").alias("m")], hot_rows, held)
    handed = near.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return handed.unionByName(near.select("u", F.col("m").alias("v"))).distinct()


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return int(row[0]), int(row[1] or 0)


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(id, component)`` for every id of ``edges(u, v)`` with ``u > v``.

    ``component`` is the smallest id linked directly or indirectly. An empty
    input gives an empty result. A star left by the last round is read from the
    shared folder, so the result does not recompute the rounds.
    """
    stage = runtime.Stage(edges, "components")
    state = _fingerprint(stage.df)
    for _ in range(max_rounds):
        hot_rows = runtime.hot_threshold(2 * state[0])
        held: list[runtime.Stage] = []
        starred = runtime.Stage(_large_star(stage.df, hot_rows, held), "large-star")
        after = runtime.Stage(_small_star(starred.df, hot_rows, held), "small-star")
        now = _fingerprint(after.df)
        for done in (stage, starred, *held):
            done.drop()
        stage = after
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    points = stage.df.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = stage.df.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return points.unionByName(roots)


def cluster_records(records: DataFrame, pairs: DataFrame, key: str, a: str, b: str, score: str, threshold: float) -> DataFrame:
    """Every distinct non-null ``key`` of ``records`` with its ``cluster_id``.

    A record without a link is its own cluster. Ids in ``pairs`` only are kept out.
    """
    linked = connected_components(match_edges(pairs, a, b, score, threshold))
    ids = records.where(F.col(key).isNotNull()).select(key).distinct()
    return ids.join(linked.withColumnRenamed("id", key), key, "left").select(
        key, F.coalesce("component", key).alias("cluster_id")
    )
