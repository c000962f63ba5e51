"""One surviving record per group of records that disagree or have gaps.

Two ways to judge, which answer different questions:

* ``latent_truth`` is the two-sided quality model. Every source has, per field, a
  sensitivity (it states a value that is true) and a specificity (it leaves out a
  value that is false). Both, and the probability that each stated value is true,
  are inferred by expectation-maximisation. A multi-valued field keeps every value
  judged true. The data enter as patterns - which sources state a value, and which
  report the field without it - with their counts, so an iteration costs as much
  as there are different patterns, not as there are records.
* ``preferred_rows`` follows a declared order of trust. Where the sources' order
  is given from outside and must decide, no inferred quality may overrule it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calyx import runtime

#: The decisions a report can carry, without separators.
DECISIONS = {"keepunique": "keep_unique", "keeppartialoverlap": "keep_partial_overlap", "dropconflict": "drop_conflict"}
#: The fit ends once no sensitivity or specificity moves by more than this, and fails after so many passes.
TOLERANCE, PASSES = 1e-3, 2_000
#: Prior counts of the beta distributions: of truth, and of right and wrong answers.
PRIOR_TRUE, PRIOR_FALSE = 2.0, 2.0
PRIOR_SENSITIVITY, PRIOR_SPECIFICITY = (2.0, 2.0), (4.0, 1.0)
#: Log odds stay within this.
FAR_ODDS = 14.0
WORDED = r"[\p{L}\p{Nd}]"


def decision_value(decision: Column) -> Column:
    """The decision meant, ignoring case, white space, hyphens and underscores; else null."""
    bare = F.lower(F.regexp_replace(decision, r"(?U)[\s_\-‐-―−－]+", ""))
    names = F.create_map(*[F.lit(x) for pair in DECISIONS.items() for x in pair])
    return F.when(bare.isin(list(DECISIONS)), names[bare])


def shape_value(shape_count: Column) -> Column:
    return F.when(shape_count > 0, shape_count)


def flag_values(flags: Column) -> Column:
    """The distinct flags that hold a letter or digit, trimmed; null if none does."""
    worded = F.array_distinct(F.transform(F.filter(flags, lambda f: f.rlike(WORDED)), lambda f: F.trim(f)))
    return F.when(F.size(worded) > 0, worded)


def preferred_rows(
    records: DataFrame, entity: str, row_id: str, usable: dict[str, Column],
    source: str, trust: DataFrame, trust_source: str, trust_rank: str, recorded: str,
) -> DataFrame:
    """``entity, field, row_id``: the row each field of the survivor comes from.

    Per entity and field, among rows whose ``usable[field]`` is not null: the most
    trusted source (smallest rank; a source null or without a rank comes last), then
    the latest time (null last), then the largest row id. Only entities with at
    least two different row ids; rows with a null entity or row id are left out.
    A source named twice in ``trust`` counts with its smallest rank. The best row
    is found by aggregation that combines map-side, so a hot entity is no window.
    """
    ranks = trust.where(F.col(trust_source).isNotNull()).groupBy(F.col(trust_source).alias(source)).agg(
        F.min(trust_rank).alias("_rank")
    )
    rows = records.where(F.col(entity).isNotNull() & F.col(row_id).isNotNull()).select(
        F.col(entity).alias("_entity"), F.col(row_id).alias("_id"), F.col(source).alias(source), F.col(recorded).alias("_at"),
        *[value.isNotNull().alias(f"_has_{name}") for name, value in usable.items()],
    ).join(runtime.small(ranks), source, "left")
    order = F.struct(
        F.col("_rank").isNotNull().alias("known"), (-F.col("_rank")).alias("rank"),
        F.col("_at").isNotNull().alias("dated"), F.col("_at").alias("at"), F.col("_id").alias("id"),
    )
    best = rows.groupBy("_entity").agg(
        F.min("_id").alias("_low"), F.max("_id").alias("_high"),
        *[F.max(F.when(F.col(f"_has_{name}"), order)).alias(f"_best_{name}") for name in usable],
    ).where("_low < _high")
    picks = F.array(*[F.struct(F.lit(name).alias("field"), F.col(f"_best_{name}.id").alias(row_id)) for name in usable])
    return best.select(F.col("_entity").alias(entity), F.explode(picks).alias("_p")).select(entity, "_p.*").where(F.col(row_id).isNotNull())


def claims_of(records: DataFrame, entity: str, source: str, fields: dict[str, Column]) -> DataFrame:
    """Long form ``entity, source, field, value``; an array field gives one row per value."""
    named = F.array(*[
        F.struct(F.lit(name).alias("field"), values.cast("array<string>").alias("values")) for name, values in fields.items()
    ])
    long = records.where(F.col(entity).isNotNull()).select(
        F.col(entity).alias("entity"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.explode(named).alias("_f")
    )
    return long.select("entity", "source", "_f.field", F.explode("_f.values").alias("value"))


@dataclass
class Truth:
    """What the model inferred: per value and per source."""

    values: DataFrame  # entity, field, value, votes, probability
    sources: DataFrame  # field, source, sensitivity, specificity


def _observed(claims: DataFrame) -> DataFrame:
    """Per stated value the sources that state it, and those that report the field without it."""
    reporting = claims.groupBy("entity", "field").agg(F.collect_set("source").alias("reporting"))
    stated = claims.groupBy("entity", "field", "value").agg(F.collect_set("source").alias("stating"))
    both = stated.join(reporting, ["entity", "field"])
    return both.select(
        "entity", "field", "value", F.sort_array("stating").alias("stating"),
        F.sort_array(F.array_except("reporting", "stating")).alias("silent"),
    )


#: Log odds by field, kind of parameter and source.
Quality = dict[tuple[str, str, str | None], float]


def _probability() -> Column:
    """Posterior of a pattern with its field's parameters: log odds of the prior and of every observation."""
    log_odds = F.aggregate("stating", F.col("base"), lambda acc, s: acc + F.col("stated")[s])
    return 1 / (1 + F.exp(-F.aggregate("silent", log_odds, lambda acc, s: acc + F.col("unsaid")[s])))


def _parameters(spark: SparkSession, odds: Quality) -> DataFrame:
    """One row per field: the log odds of its prior and, by source, of a statement and of silence.

    A join brings them to the patterns, so that plans do not grow with the sources.
    """
    rows: dict[str, tuple[dict, dict]] = {}
    sure = lambda x: 1 / (1 + math.exp(-x))
    for (field, kind, source), x in odds.items():
        stated, unsaid = rows.setdefault(field, ({}, {}))
        if kind == "sensitivity":
            a, d = sure(x), sure(odds[field, "specificity", source])
            stated[source], unsaid[source] = math.log(a / (1 - d)), math.log((1 - a) / d)
    found = [(f, float(odds[f, "prior", None]), stated, unsaid) for f, (stated, unsaid) in rows.items()]
    return spark.createDataFrame(found, "field string, base double, stated map<string,double>, unsaid map<string,double>")


def _pass(judged: DataFrame, trusted: dict[tuple[str, str], tuple[float, float]]) -> Quality:
    """The parameters, as log odds, that the patterns with their probabilities ``p`` give.

    The driver gets one row per field and source.
    """
    seen = judged.select("field", "n", "p", F.explode(F.concat(
        F.transform("stating", lambda s: F.struct(s.alias("source"), F.lit(1.0).alias("said"))),
        F.transform("silent", lambda s: F.struct(s.alias("source"), F.lit(0.0).alias("said"))),
        F.array(F.struct(F.lit(None).cast("string").alias("source"), F.lit(1.0).alias("said"))),
    )).alias("o"))
    true, false = F.col("n") * F.col("p"), F.col("n") * (1 - F.col("p"))
    counts = seen.groupBy("field", "o.source").agg(
        F.sum(true * F.col("o.said")), F.sum(true), F.sum(false * (1 - F.col("o.said"))), F.sum(false)
    ).collect()
    odds: Quality = {}
    (a, b), (c, d) = PRIOR_SENSITIVITY, PRIOR_SPECIFICITY
    for field, source, hit, positive, rejected, negative in counts:
        if source is None:
            odds[field, "prior", None] = math.log((positive + PRIOR_TRUE) / (negative + PRIOR_FALSE))
            continue
        right, wrong = trusted.get((field, source), (0.0, 0.0))
        odds[field, "sensitivity", source] = math.log((hit + a + right) / (positive - hit + b + wrong))
        odds[field, "specificity", source] = math.log((rejected + c + right) / (negative - rejected + d + wrong))
    return {k: max(-FAR_ODDS, min(FAR_ODDS, x)) for k, x in odds.items()}


def _moved(x: Quality, y: Quality) -> float:
    sure = lambda v: 1 / (1 + math.exp(-v))
    return max((abs(sure(x[k]) - sure(y[k])) for k in x), default=0.0)


def latent_truth(
    claims: DataFrame, tolerance: float = TOLERANCE, passes: int = PASSES, trusted: dict[tuple[str, str], tuple[float, float]] | None = None
) -> Truth:
    """Fit the model to ``claims(entity, source, field, value)``.

    Repeated claims count once. An entity with one claim is judged by its source's
    quality alone. An empty input gives empty results. The fit starts from the share
    of reporting sources that state a value. ``trusted`` gives, of a field and source,
    right and wrong answers known beforehand, as a prior. Expectation-maximisation
    runs until no parameter moves by more than ``tolerance``, every third pass from
    a point ahead on the line of the last two (squared extrapolation); a fit that
    has not settled after ``passes`` raises an error.
    """
    stages = [runtime.Stage(_observed(claims), "claims")]
    observed = stages[0].df
    stages.append(runtime.Stage(observed.groupBy("field", "stating", "silent").agg(F.count(F.lit(1)).alias("n")), "patterns"))
    patterns = stages[1].df
    spark, trusted = claims.sparkSession, trusted or {}
    share = F.size("stating") / (F.size("stating") + F.size("silent"))
    fit = lambda odds: _pass(patterns.join(runtime.small(_parameters(spark, odds)), "field").withColumn("p", _probability()), trusted)
    now = _pass(patterns.withColumn("p", F.least(F.greatest(share, F.lit(0.05)), F.lit(0.95))), trusted)
    made, step = 1, 2.0
    while now:
        first = fit(now)
        if _moved(first, now) < tolerance:
            now = first
            break
        second = fit(first)
        if _moved(second, first) < tolerance:
            now = second
            break
        r = {k: first[k] - now[k] for k in now}
        v = {k: second[k] - first[k] - r[k] for k in now}
        length = math.sqrt(sum(x * x for x in r.values()) / max(1e-12, sum(x * x for x in v.values())))
        length = max(1.0, min(length, step))
        ahead = {k: max(-FAR_ODDS, min(FAR_ODDS, now[k] + 2 * length * r[k] + length**2 * v[k])) for k in now}
        landed = fit(ahead)
        made += 3
        if _moved(landed, ahead) <= 2 * _moved(second, first):
            now, step = landed, step * 2 if length == step else step
        else:  # too far ahead
            now, step = second, max(2.0, step / 2)
        if made > passes:
            raise RuntimeError(f"the quality model did not settle in {passes} passes")
    judged = observed.join(runtime.small(_parameters(spark, now)), "field").withColumn("probability", _probability())
    values = runtime.cut(judged.select("entity", "field", "value", F.size("stating").alias("votes"), F.col("probability").cast("double").alias("probability")), "judged")
    for stage in stages:
        stage.drop()
    sure = lambda x: 1 / (1 + math.exp(-x))
    rows = [(f, s, sure(x), sure(now[f, "specificity", s])) for (f, kind, s), x in sorted(now.items(), key=str) if kind == "sensitivity"]
    return Truth(values, spark.createDataFrame(rows, "field string, source string, sensitivity double, specificity double"))


def merged_records(truth: Truth, single: Sequence[str], multiple: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """One row per entity: the likeliest value of each single field, and for each
    multi-valued field all values judged true (if none is, the likeliest one).

    Ties go to the value with more votes, then the larger one.
    """
    order = F.struct("probability", "votes", "value")
    best = truth.values.groupBy("entity", "field").agg(
        F.max(order).alias("best"),
        F.sort_array(F.collect_set(F.when(F.col("probability") >= threshold, F.col("value")))).alias("true"),
    )
    picks = [F.max(F.when(F.col("field") == f, F.col("best.value"))).alias(f) for f in single]
    picks += [F.max(F.when(F.col("field") == f, F.col("best.probability"))).alias(f"{f}_probability") for f in single]
    for f in multiple:
        kept = F.when(F.size("true") > 0, F.col("true")).otherwise(F.array("best.value"))
        picks.append(F.max(F.when(F.col("field") == f, kept)).alias(f))
    return best.groupBy("entity").agg(*picks)
