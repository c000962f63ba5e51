"""Order-dependent operators against plain Python, on random small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from calyx import runtime
from calyx.operators import graph, joins, keyed, sequences, windows


def _graded_oracle(rows):
    """Graded rows as a loop over one document: (term, level) -> position."""
    kinds = [k for _, k, _ in rows]

    def opens(i):
        above = next((k for k in reversed(kinds[:i]) if k in ("term", "class", "total", "number")), None)
        return rows[i][2] == "1级" and above != "class"

    def ahead(i, label):
        while i < len(rows) and kinds[i] != "term" and rows[i][2] != label and not opens(i):
            i += 1
        return i if i < len(rows) and rows[i][2] == label else None

    term, out = None, {}
    for i, (at, kind, label) in enumerate(rows):
        if kind == "term":
            term = label
            out[term, "Total"] = at
        elif term is not None and opens(i):
            out[term, "1级"] = at
            if (second := ahead(i + 1, "2级")) is not None:
                out[term, "2级"] = rows[second][0]
                if (third := ahead(second + 1, "3级")) is not None:
                    out[term, "3级"] = rows[third][0]
    return out


def test_graded_rows(spark):
    labels = {"发热": "term", "头痛": "term", "1级": "grade", "2级": "grade", "3级": "grade", "4级": "grade", "胃肠系统疾病": "class", "首选术语": "header", "": "header", "Total": "total"}
    rnd = random.Random(3)
    data, want = [], set()
    for doc in range(25):
        rows = [(i, rnd.choice(list(labels))) for i in range(rnd.randint(0, 30))]
        data += [(doc, i, [x] + ["3 ( 30.00)", "4"] * 5) for i, x in rows]
        found = _graded_oracle([(i, labels[x], x) for i, x in rows])
        want |= {(doc, t, level, at) for (t, level), at in found.items()}
    df = spark.createDataFrame(data, "doc int, ord int, cells array<string>")
    got = {(r.doc, r.term, r.level, r.ord) for r in sequences.graded_rows(df, "doc", "ord", "cells").collect()}
    assert got == want


def test_greedy_removal(spark):
    rnd = random.Random(5)
    items = [(i // 8, i, i, rnd.randint(0, 3)) for i in range(40)]
    pairs = [(a // 8, a, b, rnd.random()) for a in range(40) for b in range(a + 1, 40) if a // 8 == b // 8]
    gone = set()
    sim = {(a, b): s for _, a, b, s in pairs}
    for i in range(40):
        if i in gone:
            continue
        for j in range(i + 1, 40):
            if j in gone or sim.get((i, j), 0) < 0.7:
                continue
            if items[i][3] >= items[j][3]:
                gone.add(j)
            else:
                gone.add(i)
                break
    a = spark.createDataFrame(items, "component int, id int, ord int, score int")
    b = spark.createDataFrame(pairs, "component int, a int, b int, similarity double")
    got = {r.id for r in sequences.kept_greedily(a, b, "component", 0.7).where("not kept").collect()}
    assert got == gone


def test_boxes_merge(spark):
    df = spark.createDataFrame([("d", 1, 0.0, 0.0, 10.0, 10.0), ("d", 1, 9.0, 9.0, 20.0, 20.0), ("d", 1, 50.0, 50.0, 60.0, 60.0), ("d", 2, 0.0, 0.0, 1.0, 1.0)], "doc string, page int, x0 double, top double, x1 double, bottom double")
    got = sorted(tuple(r) for r in sequences.merged_boxes(df, ["doc", "page"], 1.0).collect())
    assert got == [("d", 1, -1.0, -1.0, 21.0, 21.0), ("d", 1, 49.0, 49.0, 61.0, 61.0), ("d", 2, -1.0, -1.0, 2.0, 2.0)]


def test_alignment(spark):
    table = [["", "n", "x"], ["mild", "1", "a"], ["skip", "", ""], ["severe", "2", "b"]]
    rows = [("t", r, c, v) for r, line in enumerate(table) for c, v in enumerate(line)]
    df = spark.createDataFrame(rows + [("u", 0, 0, "mild")], "k string, row int, col int, value string")
    got = sequences.aligned_columns(df, "k", ["mild", "severe"], ["n"]).collect()
    assert [(r.k, r.cat_col, r.val_col, r.rows) for r in got] == [("t", 0, 1, [1, 3])]


def test_alignment_of_many_tables_and_of_a_long_one(spark):
    """Many small tables are looked through in one batch, and a table that spans batches is one table."""
    small = spark.range(30_000).selectExpr("nullif(id, 7) AS k", "explode(sequence(0, 2)) AS row").selectExpr(
        "k", "row", "posexplode(array(CASE WHEN row = coalesce(k, 7) % 3 THEN 'mild' WHEN row = 2 THEN 'severe' END, cast(row as string))) AS (col, value)"
    )
    long = spark.range(120_000).selectExpr("-1L AS k", "cast(id as int) AS row", "posexplode(array(CASE id WHEN 5 THEN 'mild' WHEN 119999 THEN 'severe' END, 'x', CASE WHEN id > 119000 THEN '1' END)) AS (col, value)")
    found = sequences.aligned_columns(small.union(long).coalesce(1), "k", ["mild", "severe"], ["0"])
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    got = {r.k: (r.cat_col, r.val_col, list(r.rows)) for r in found.collect()}
    assert got.pop(-1) == (0, 2, [5, 119_999])
    assert got == {None if k == 7 else k: (0, 1, [k % 3, 2]) for k in range(30_000) if k % 3 < 2}


def test_groups_are_numbered_across_ranges(spark):
    rows = [(i, None if i % 5 == 0 else "hot" if i % 3 else f"k{i % 7}") for i in range(500)]
    df = spark.createDataFrame(rows, "i int, k string").repartition(7)
    got = {r.i: r.n for r in runtime.numbered_within(df, ["k"], ["i"], "n").collect()}
    seen: dict = {}
    want = {}
    for i, k in rows:
        want[i] = seen[k] = seen.get(k, 0) + 1
    assert got == want
    assert {r.i: r.n for r in runtime.numbered_within(df, [], ["i"], "n").collect()} == {i: i + 1 for i in range(500)}
    assert runtime.numbered_within(df.limit(0), ["k"], ["i"], "n").count() == 0


def test_hot_groups_get_their_aggregates(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, "hot" if i % 3 else str(i % 4)) for i in range(300)] + [(1000, None)], "i int, k string")
    for hot in (None, 50):
        got = {r.i: r.first for r in runtime.attach_group(df, ["k"], [F.min("i").alias("first")], hot).collect()}
        assert len(got) == 300 and got[5] == 1 and got[3] == 3 and got[15] == 3


def test_a_closure_that_is_too_deep_is_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "src int, dst int")
    seeds = spark.createDataFrame([(0,)], "node int")
    assert graph.closure(seeds, edges, 12).count() == 10
    with pytest.raises(RuntimeError):
        graph.closure(seeds, edges, 4)


def test_closure_with_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (3, None)], "src int, dst int")
    seeds = spark.createDataFrame([(1,), (None,)], "node int")
    assert sorted(r.node for r in graph.closure(seeds, edges).collect()) == [1, 2, 3]


def test_clusters_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "src int, dst int")
    nodes = spark.createDataFrame([(i,) for i in [*range(61), 100, 101, 200]], "node int")
    got = {r.node: r.cluster for r in graph.clusters(nodes, edges).collect()}
    assert {got[i] for i in range(61)} == {0} and got[100] == got[101] == 1 and got[200] == 2


def test_repaired_pages_and_names(spark):
    df = spark.createDataFrame([("d", 1, -1), ("d", 2, 3), ("d", 3, 0), ("d", 4, 99)], "doc string, ord int, page int")
    pages = df.select("ord", windows.repaired_pages(F.col("page"), F.lit(9), ["doc"], ["ord"]).alias("p")).orderBy("ord")
    assert [r.p for r in pages.collect()] == [1, 3, 3, 9]
    names = spark.createDataFrame([(1, "X"), (2, "X"), (3, "X"), (4, "Y")], "i int, n string")
    assert [r.n for r in windows.numbered_names(names, "n", ["i"]).orderBy("i").collect()] == ["X", "X_1", "X_2", "Y"]


def test_complete_match_and_backfill(spark):
    a = spark.createDataFrame([("k", 1, 1.0), ("k", 2, 2.0), ("m", 1, None)], "key string, ord int, v double")
    b = spark.createDataFrame([("k", 1, 9.0), ("m", 1, 8.0)], "key string, ord int, v double")
    assert [tuple(r) for r in joins.complete_match(a, b, ["key"], ["v"]).collect()] == [("k", 2.0, 9.0)]
    rows = spark.createDataFrame([("a", "", None), ("b", "x", "")], "s string, value string, note string")
    ref = spark.createDataFrame([("a", "1", "n"), ("b", "2", "m")], "s string, value string, note string")
    got = sorted(tuple(r) for r in joins.backfill(rows, ref, ["s"], ["value", "note"]).select("s", "value", "note", "filled").collect())
    assert got == [("a", "1", "n", True), ("b", "x", "", False)]


def test_hot_keys_reach_every_row(spark, monkeypatch):
    from calyx import runtime

    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 99), (None, 5)], "k int, v int")
    got = runtime.attach_group(rows, ["k"], [F.min("v").alias("low")], hot_rows=10).collect()
    assert len(got) == 51 and {(r.k, r.low) for r in got} == {(1, 0), (2, 99)}


def test_counts_with_zeros(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("z",)], "v string")
    levels = spark.createDataFrame([("a",), ("b",)], "level string")
    assert sorted(tuple(r) for r in keyed.counts_with_zeros(rows, "v", levels, "level").collect()) == [("a", 2), ("b", 0)]


def test_numbers_over_all_ranges(spark):
    from calyx import runtime

    rows = spark.createDataFrame([(x * 7 % 1009, "x") for x in range(1009)], "v int, note string").repartition(5)
    got = {r.v: r.n for r in runtime.numbered(rows, "v", "n").collect()}
    assert got == {v: v for v in range(1009)}
    assert runtime.numbered(rows.limit(0), "v", "n").count() == 0


def test_duplicate_members_and_clashing_names(spark):
    from calyx.operators.duplicates import duplicate_members

    rows = spark.createDataFrame([(1, "a", 0), (2, "a", 0), (3, "b", 0), (4, None, 0), (5, None, 0)], "id int, t string, copies int")
    assert sorted(tuple(r) for r in duplicate_members(rows, "id", F.col("t")).collect()) == [(1, 1, 2), (2, 1, 2)]


def test_folder_totals(spark):
    rows = spark.createDataFrame([("a/b/f", 1, 5), ("a/g", 2, 9), ("h", 4, 1)], "path string, size int, at int")
    got = {r.folder: (r.total_size, r.files, r.latest) for r in keyed.prefix_totals(rows, "path", "size", "at").collect()}
    assert got == {"a": (3, 2, 9), "a/b": (1, 1, 5)}


def test_crowded_pages_keep_all_boxes(spark):
    df = spark.createDataFrame([("d", 1, 10.0 * i, 0.0, 10.0 * i + 1, 1.0) for i in range(250)], "doc string, page int, x0 double, top double, x1 double, bottom double")
    assert sequences.merged_boxes(df, ["doc", "page"]).count() == 250
    assert sequences.merged_boxes(df, ["doc", "page"], most=200).count() == 200
