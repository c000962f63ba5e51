import random

import pytest
from pyspark.sql import functions as F

from calyx.llm import components, survivors


def _brute(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def _edges(spark, rows):
    df = spark.createDataFrame(rows, "a int, b int, s double, u string, m int")
    return components.match_edges(df, "a", "b", "s", 0.6)


def test_components_against_brute_force(spark):
    rnd = random.Random(1)
    pairs = [(rnd.randint(0, 80), rnd.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 340)]
    rows = [(a, b, 0.9, "x", 1) for a, b in pairs] + [(b, a, 0.7, "x", 1) for a, b in pairs[:9]] + [(1, 2, 0.1, "x", 1), (None, 3, 0.9, "x", 1), (4, 4, 0.9, "x", 1), (0, 400, float("nan"), "x", 1), (0, 401, None, "x", 1)]
    got = {r.id: r.component for r in components.connected_components(_edges(spark, rows)).collect()}
    assert got == _brute([p for p in pairs if p[0] != p[1]])


def test_hot_vertex_uses_the_broadcast_way(spark, monkeypatch):
    from calyx import runtime

    monkeypatch.setattr(runtime, "HOT_ROWS", 5)
    monkeypatch.setattr(runtime, "HOT_KEYS", 10**9)
    rows = [(50, i, 0.9, "", 0) for i in range(40)] + [(60, 61, 0.9, "", 0)]
    got = {r.id: r.component for r in components.connected_components(_edges(spark, rows)).collect()}
    assert {got[i] for i in [*range(40), 50]} == {0} and got[61] == 60


def test_no_pairs_and_single_records(spark):
    assert components.connected_components(_edges(spark, [])).count() == 0
    records = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, "b")], "gid int, component string")
    pairs = spark.createDataFrame([(1, 7, 0.9)], "a int, b int, s double")
    got = sorted(tuple(r) for r in components.cluster_records(records, pairs, "gid", "a", "b", "s", 0.6).collect())
    assert got == [(1, 1), (2, 2)]


REPORT = "gid int, rid long, tool string, at timestamp, decision string, shapes int, flags array<string>, _rank int, _low string"


def _pick(spark, rows, tools):
    df = spark.createDataFrame(rows, REPORT)
    trust = spark.createDataFrame(tools, "tool string, trust int")
    usable = {"decision": survivors.decision_value(F.col("decision")), "shapes": survivors.shape_value(F.col("shapes")), "flags": survivors.flag_values(F.col("flags"))}
    got = survivors.preferred_rows(df, "gid", "rid", usable, "tool", trust, "tool", "trust", "at")
    return {(r.gid, r.field): r.rid for r in got.collect()}


def test_precedence_with_ties_and_gaps(spark):
    from datetime import datetime

    t = datetime(2024, 1, 1)
    rows = [
        (1, 10, "b", t, "Keep-Unique ", 0, [None, "?"], 0, ""), (1, 11, "a", None, "undecided", 4, ["x"], 0, ""), (1, 12, "a", t, None, 5, [], 0, ""), (1, 12, "a", t, None, 5, [], 0, ""),
        (2, 20, None, t, "drop_conflict", 1, None, 0, ""), (2, 21, "zz", None, "DROP CONFLICT", None, ["…", "字"], 0, ""),
        (3, 30, "a", t, "keep_unique", 1, ["y"], 0, ""), (None, 40, "a", t, "keep_unique", 1, ["y"], 0, ""), (None, 41, "a", t, "keep_unique", 1, ["y"], 0, ""),
    ]
    got = _pick(spark, rows, [("a", 1), ("a", 9), ("b", 1), (None, 0)])
    assert got == {(1, "decision"): 10, (1, "shapes"): 12, (1, "flags"): 11, (2, "decision"): 20, (2, "shapes"): 20, (2, "flags"): 21}
    assert _pick(spark, [], []) == {}


def test_truth_finds_the_careless_source(spark):
    rnd = random.Random(2)
    rows = []
    for e in range(400):
        true = {"a", "b"} if e % 2 else {"a"}
        for source, miss, wrong in (("good", 0.05, 0.02), ("fair", 0.2, 0.05), ("bad", 0.5, 0.5)):
            said = [v for v in sorted(true) if rnd.random() > miss] + (["x"] if rnd.random() < wrong else [])
            rows += [(e, source, "flags", v) for v in said]
    claims = spark.createDataFrame(rows, "entity int, source string, field string, value string")
    truth = survivors.latent_truth(claims)
    quality = {r.source: (r.sensitivity, r.specificity) for r in truth.sources.collect()}
    assert quality["good"][0] > quality["fair"][0] > quality["bad"][0] and quality["good"][1] > quality["bad"][1]
    merged = {r.entity: r.flags for r in survivors.merged_records(truth, [], ["flags"]).collect()}
    right = sum(merged.get(e) == (["a", "b"] if e % 2 else ["a"]) for e in range(400))
    assert right > 320


def _planted(seed, entities, quality, flags=("a", "b", "c", "d", "e")):
    """Flags of which each entity truly has about half, stated by sources of known sensitivity and specificity."""
    rnd = random.Random(seed)
    true = {e: {f for f in flags if rnd.random() < 0.5} for e in range(entities)}
    rows = []
    for e in range(entities):
        for source, (sensitivity, specificity) in quality.items():
            rows += [(e, source, "flags", f) for f in flags if rnd.random() < (sensitivity if f in true[e] else 1 - specificity)]
    return true, rows


def test_planted_sources_are_recovered(spark):
    quality = {"s1": (0.95, 0.95), "s2": (0.85, 0.9), "s3": (0.7, 0.97), "s4": (0.9, 0.7), "s5": (0.6, 0.6)}
    true, rows = _planted(11, 1500, quality)
    claims = spark.createDataFrame(rows, "entity int, source string, field string, value string")
    truth = survivors.latent_truth(claims)
    said = {(e, s, v) for e, s, _, v in rows}
    reporting = {(e, s) for e, s, _, _ in rows}
    facts = {(e, v) for e, _, v in said}  # the model sees what at least one source states
    for r in truth.sources.collect():
        own = [(e, f) for e, f in facts if (e, r.source) in reporting]
        hits = [(e, r.source, f) in said for e, f in own if f in true[e]]
        wrong = [(e, r.source, f) in said for e, f in own if f not in true[e]]
        assert abs(r.sensitivity - sum(hits) / len(hits)) < 0.04 and abs(1 - r.specificity - sum(wrong) / len(wrong)) < 0.06, r
    merged = {r.entity: set(r.flags) for r in survivors.merged_records(truth, [], ["flags"]).collect()}
    stated = {(e, v) for e, _, _, v in rows}
    kept = {(e, f) for e, found in merged.items() for f in found}
    wanted = {(e, f) for e, found in true.items() for f in found} & stated
    assert len(kept & wanted) > 0.93 * len(kept) and len(kept & wanted) > 0.95 * len(wanted)


def test_trust_given_beforehand_decides_between_two(spark):
    rows = [(e, s, "d", v) for e in range(40) for s, v in (("x", "left"), ("y", "right"))]
    claims = spark.createDataFrame(rows, "entity int, source string, field string, value string")
    for best, value in (("x", "left"), ("y", "right")):
        truth = survivors.latent_truth(claims, trusted={("d", best): (500.0, 1.0)})
        assert {r.d for r in survivors.merged_records(truth, ["d"], []).collect()} == {value}


def test_a_fit_that_does_not_settle_is_an_error(spark):
    _, rows = _planted(3, 60, {"a": (0.9, 0.8), "b": (0.6, 0.7), "c": (0.7, 0.6)})
    claims = spark.createDataFrame(rows, "entity int, source string, field string, value string")
    with pytest.raises(RuntimeError):
        survivors.latent_truth(claims, tolerance=0.0, passes=4)


def test_truth_of_nothing(spark):
    claims = spark.createDataFrame([], "entity int, source string, field string, value string")
    truth = survivors.latent_truth(claims)
    assert truth.values.count() == 0 and truth.sources.count() == 0
