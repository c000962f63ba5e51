"""A mix of sources with given shares of the total size.

Weights come from temperature mixing. Source token shares p are exponentiated and
the exponent is bisected: ``temperature_weights`` flattens or sharpens p itself to
a target entropy; ``tilted_weights`` moves from p to the target shares t along
``p^(1-x) t^x`` and takes the largest x in [0, 1] whose budget no source must
exceed its repetition limit for. With the largest feasible budget, x is 1 and the
weights are the target shares themselves.

Weights become texts by budgeted block permutations. Each source is used in whole
rounds, as often as its budget covers it, and one partial round. In a round the
texts are permuted by a seeded hash, in blocks of bounded size; all blocks before
the one in which the budget ends are taken whole, and only inside that block are
texts ordered and added up. No source is gathered in one task.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from calyx import runtime

#: Texts per block, about: what one task orders at the end of a budget.
BLOCK_ROWS = 20_000


def entropy(shares: Mapping[str, float]) -> float:
    return -sum(p * math.log(p) for p in shares.values() if p > 0)


def _normalised(weights: Mapping[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()} if total > 0 else {}


def temperature_weights(sizes: Mapping[str, float], target_entropy: float, steps: int = 80) -> tuple[float, dict[str, float]]:
    """The exponent x, and weights ``p^x`` normalised, whose entropy is the target.

    x = 0 gives equal weights, the largest entropy; a target beyond what 0 to 64
    can reach gives the nearest end. Sources of no size get no weight.
    """
    shares = _normalised({k: v for k, v in sizes.items() if v > 0})
    low, high = 0.0, 64.0
    for _ in range(steps):
        x = (low + high) / 2
        if entropy(_normalised({k: p**x for k, p in shares.items()})) > target_entropy:
            low = x
        else:
            high = x
    return high, _normalised({k: p**high for k, p in shares.items()})


def _fits(weights: Mapping[str, float], budget: float, room: Mapping[str, float]) -> bool:
    return all(budget * w <= room[k] * (1 + 1e-12) for k, w in weights.items())


def tilted_weights(
    sizes: Mapping[str, float], target: Mapping[str, float], limits: Mapping[str, int], budget: float | None = None, steps: int = 60
) -> tuple[float, float, dict[str, float]]:
    """Budget, exponent and weights of the sources that have both a target and a size.

    Without a budget the largest is taken that the exact target shares allow under
    the repetition limits. A larger budget is met by the largest exponent that fits,
    and cut to what the natural shares allow if none does.
    """
    room = {k: float(sizes[k]) * limits[k] for k in sizes if sizes[k] > 0 and target.get(k, 0) > 0 and limits.get(k, 0) > 0}
    if not room:
        return 0.0, 1.0, {}
    p, t = _normalised({k: sizes[k] for k in room}), _normalised({k: target[k] for k in room})
    tilt = lambda x: _normalised({k: p[k] ** (1 - x) * t[k] ** x for k in room})
    if budget is None:
        return min(room[k] / t[k] for k in room), 1.0, t
    if _fits(t, budget, room):
        return budget, 1.0, t
    most = [min(room[k] / w for k, w in tilt(x).items()) for x in (0.0, 1.0)]
    if most[1] >= most[0]:
        return min(budget, most[1]), 1.0, t
    low, high = 0.0, 1.0
    budget = min(budget, most[0])
    for _ in range(steps):
        x = (low + high) / 2
        low, high = (x, high) if _fits(tilt(x), budget, room) else (low, x)
    return budget, low, tilt(low)


def mix_texts(documents: DataFrame, key: str, source: str, text: str, target: DataFrame, size: Column) -> DataFrame:
    """The texts a mix may draw: ``key, source, tokens``, one row per different text.

    A text under several ids, or in several sources, is one text: it goes with its
    smallest id and is never used more often than that source allows. Sources not
    in ``target``, null keys, and texts that are null or of no tokens are left out.
    """
    wanted = runtime.small(target.select(source).where(F.col(source).isNotNull()).distinct())
    rows = documents.where(F.col(text).isNotNull() & F.col(key).isNotNull() & (F.col(text) != "")).join(wanted, source)
    sized = rows.select(
        F.col(key).alias("key"), F.col(source).alias("source"), F.sha2(F.col(text), 256).alias("_text"), size.alias("tokens")
    )  # sized before the shuffle, so that no text is shuffled
    first = sized.groupBy("_text").agg(F.min(F.struct("key", "source", "tokens")).alias("first"))
    return first.select("first.*").where("tokens > 0")


def source_sizes(texts: DataFrame) -> list:
    """``source, texts, tokens`` of every source: at most as many rows as the target has."""
    return texts.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum("tokens").alias("tokens")).collect()


def target_rows(target: DataFrame, source: str, share: str, repeats: str) -> dict[str, tuple[float, int]]:
    """The target is a table of parameters, held on the driver: a share and a limit per source."""
    found = target.where(F.col(source).isNotNull()).groupBy(source).agg(
        F.sum(F.coalesce(share, F.lit(0.0))), F.min(F.coalesce(repeats, F.lit(0)))
    ).collect()
    return {r[0]: (float(r[1]), int(r[2])) for r in found}


def _plan(spark: SparkSession, sizes: list, weights: Mapping[str, float], budget: float, limits: Mapping[str, int]) -> DataFrame:
    rows = []
    for r in sizes:
        wanted = budget * weights.get(r["source"], 0.0)
        rounds, rest = divmod(int(wanted + 1e-6), r["tokens"])
        if rounds >= limits.get(r["source"], 0):
            rounds, rest = limits.get(r["source"], 0), 0
        rows.append((r["source"], int(rounds), int(rest), max(1, math.ceil(r["texts"] / BLOCK_ROWS))))
    return spark.createDataFrame(rows, "source string, rounds int, rest long, blocks int")


def draw(texts: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """``key, source, tokens, uses`` for every text used at least once.

    The partial round takes texts in permuted order while they fit wholly before
    its budget ends, so a source misses its budget by less than one text.
    """
    placed = texts.join(runtime.small(plan), "source").where("rounds > 0 or rest > 0").withColumn(
        "_order", F.xxhash64(F.lit(seed), F.col("source"), F.col("key"))
    )
    placed = placed.withColumn("_block", F.pmod(F.shiftrightunsigned("_order", 17), F.col("blocks")).cast("int"))
    blocks = placed.groupBy("source", "_block").agg(F.sum("tokens").alias("_size"))  # sources times blocks: small
    ahead = F.sum("_size").over(W.partitionBy("source").orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    starts = blocks.select("source", "_block", "_size", F.coalesce(ahead, F.lit(0)).alias("_start"))
    based = placed.join(runtime.small(starts), ["source", "_block"])
    whole = F.col("_start") + F.col("_size") <= F.col("rest")
    split = ~whole & (F.col("_start") < F.col("rest"))
    run = F.sum("tokens").over(W.partitionBy("source", "_block").orderBy("_order", "key"))
    inside = based.where(split).withColumn("_used", (F.col("_start") + run <= F.col("rest")).cast("int"))
    outside = based.where(~split).withColumn("_used", whole.cast("int"))
    used = inside.unionByName(outside).withColumn("uses", F.col("rounds") + F.col("_used"))
    return used.where("uses > 0").select("key", "source", "tokens", "uses")


def mix(
    texts: DataFrame, target: dict[str, tuple[float, int]], budget: float | None = None, seed: int = 7, target_entropy: float | None = None
) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    The weights lie between the natural and the target shares (``tilted_weights``)
    or, with ``target_entropy``, are the natural shares at the temperature of that
    entropy, in as large a mix as the repetition limits allow. Mix: ``key, source,
    tokens, uses``. Report: per source of the target ``target_share, max_repeats,
    texts, available_tokens, exponent, weight, drawn_tokens, actual_share,
    most_uses``; a source without texts reports zeros, and what it was to have is
    shared among the others in proportion.
    """
    spark = texts.sparkSession
    texts = runtime.cut(texts, "mix-texts")
    sizes = source_sizes(texts)
    limits = {k: v[1] for k, v in target.items()}
    size_of = {r["source"]: float(r["tokens"]) for r in sizes}
    if target_entropy is None:
        total, exponent, weights = tilted_weights(size_of, {k: v[0] for k, v in target.items()}, limits, budget)
    else:
        exponent, weights = temperature_weights({k: n for k, n in size_of.items() if limits.get(k, 0) > 0}, target_entropy)
        most = min((size_of[k] * limits[k] / w for k, w in weights.items() if w > 0), default=0.0)
        total = most if budget is None else min(budget, most)
    drawn = draw(texts, _plan(spark, sizes, weights, total, limits), seed)
    found = {r["source"]: r for r in sizes}
    wanted = spark.createDataFrame(
        [
            (k, s, n, int(found[k]["texts"]) if k in found else 0, int(found[k]["tokens"]) if k in found else 0, float(exponent), float(weights.get(k, 0.0)))
            for k, (s, n) in target.items()
        ],
        "source string, target_share double, max_repeats int, texts long, available_tokens long, exponent double, weight double",
    )
    got = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("drawn_tokens"), F.max("uses").alias("most_uses"))
    report = wanted.join(F.broadcast(got), "source", "left").na.fill(0, ["drawn_tokens", "most_uses"])  # one row per source of the target
    all_tokens = F.sum("drawn_tokens").over(W.partitionBy())
    report = report.withColumn("actual_share", F.when(all_tokens > 0, F.col("drawn_tokens") / all_tokens).otherwise(0.0))
    return drawn, report
