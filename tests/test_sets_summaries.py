"""Sets, listings, trees and summaries on small tables with nulls, ties, repeats and empty input."""

from pyspark.sql import functions as F

from calyx.operators import sets, summaries


def rows_of(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_groups_and_totals(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "k int, g string")
    assert rows_of(summaries.duplicate_groups(df, "g", "k")) == [("a", 2, 1)]
    assert summaries.duplicate_groups(df.limit(0), "g", "k").count() == 0
    part = spark.createDataFrame([("x", 1, 5), ("x", 2, None), ("x", 1, 5), (None, 3, 1)], "g string, k int, v int")
    assert rows_of(summaries.complete_per_group(part, "g", "k", ["v"])) == [("x", 1)]
    orders = spark.createDataFrame([("p", "F", 1.25), ("p", "O", 2.0), ("p", None, None), ("q", "O", None)], "g string, s string, v double")
    assert rows_of(summaries.status_totals(orders, "g", "s", {"done": "F", "open": "O"}, "v")) == [("p", 1, 1, 3.25), ("q", 0, 1, None)]


def test_best_of_equals_is_the_smaller_key(spark):
    df = spark.createDataFrame([("n", 2, 9.0), ("n", 1, 9.0), ("n", 3, None), ("m", 5, 1.0), ("m", 6, 10.0)], "g string, k int, v double")
    got = {r.g: (r.best_id, r.best, r.verdict) for r in summaries.best_and_mean(df, "g", "k", "v").collect()}
    assert got == {"n": (1, 9.0, "even"), "m": (6, 10.0, "mixed")}


def test_pages_and_rules(spark):
    df = spark.createDataFrame([(1, 1, True), (1, 4, True), (2, 1, False), (2, 4, True), (3, 5, True)], "doc int, page int, hit boolean")
    assert rows_of(summaries.routed_by_hits(df, "doc", "page", F.col("hit"), 3)) == [(1, "vector"), (2, "scan")]
    assert rows_of(summaries.anomaly_totals(df, "doc", "page", F.col("hit"))) == [(1, 2, 2, "1,4"), (2, 2, 1, "4"), (3, 1, 1, "5")]
    assert rows_of(summaries.rule_hits(df, {"late": F.col("page") > 3, "hit": F.col("hit"), "never": F.col("page") > 9})) == [("hit", 4), ("late", 3)]
    assert rows_of(summaries.part_statistics(df, "doc", "page", F.col("hit"))) == [(1, 5, 2), (2, 5, 1), (3, 5, 1)]
    pairs = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.7)], "a int, b int, similarity double")
    assert rows_of(summaries.best_match_per_key(df, "doc", pairs)) == [(1, 0.7), (2, 0.7), (3, 0.0)]
    assert rows_of(summaries.reasons_per_group(df, "doc", "hit", ["page"])) == [(1, "true", 2), (2, "false,true", 2), (3, "true", 1)]


def test_reduction_and_readable(spark):
    df = spark.createDataFrame([("f", 1, None, "abc"), ("f", 1, None, None), ("f", 2, "bad", "zz"), ("g", 3, None, "")], "folder string, k int, error string, t string")
    assert rows_of(summaries.reduction(df, "folder", "k")) == [("f", 3, 2, 33.3333), ("g", 1, 1, 0.0)]
    assert rows_of(summaries.readable_files(df, "folder", "error", "t")) == [("f", 2, 1, 3), ("g", 1, 0, 0)]
    assert rows_of(summaries.channel_median(df, "folder", "k")) == [("f", 1.0), ("g", 3.0)]
    assert rows_of(summaries.distinct_series(df, ["folder", "k"], F.col("k") < 3)) == [("f", 1), ("f", 2)]


def test_selection_prefers_the_wanted_row(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, True), ("a", 3, True), ("b", 5, False), ("b", 4, None)], "k string, n int, s boolean")
    assert rows_of(summaries.selected_first(df, "k", F.col("s"), ["n"], ["n"])) == [("a", 2), ("b", 4)]
    assert rows_of(summaries.table_near_keyword(df, "k", F.col("s"), ["n"], ["n"])) == [("a", 2), ("b", 4)]
    docs = spark.createDataFrame([(1, None), (2, "x booster"), (3, "booster")], "doc int, t string")
    rules = spark.createDataFrame([(1, "A1"), (2, "B1")], "ord int, cell string")
    assert rows_of(summaries.rule_engine(docs, "doc", "t", rules, [(1, "booster"), (2, "none")]), "ord", "doc", "status") == [(1, 2, "ok"), (2, None, "not found")]


def test_sets(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,), (None,)], "id int"), spark.createDataFrame([(2,), (3,)], "id int")
    assert rows_of(sets.union_of([a, b])) == [(1,), (2,), (3,), (None,)]
    assert rows_of(sets.compared(a, b)) == [(1, "left"), (2, "both"), (3, "right"), (None, "left")]
    assert rows_of(sets.undeclared(b, "id", a)) == [(3,)]
    assert rows_of(sets.usage(a, b)) == [(1, "unused"), (2, "used"), (None, "unused")]
    assert rows_of(sets.concatenated({"a": a, "b": b})) == [("a", 1), ("a", 1), ("a", 2), ("a", None), ("b", 2), ("b", 3)]
    assert rows_of(sets.kept_and_removed(a, b, "id")) == [(1, "removed"), (1, "removed"), (2, "kept"), (None, "removed")]
    assert rows_of(sets.not_registered(a, b, "id", F.col("id") == 1)) == [(None,)]
    assert rows_of(sets.marked_as_in(a, b, "id", "there")) == [(1, "no"), (2, "yes"), (None, "no")]
    assert rows_of(sets.requested(a, b, "id")) == [(2, "selected"), (3, "missing")]
    assert rows_of(sets.subsets(b, {"odd": F.col("id") % 2 == 1, "all": F.lit(True)})) == [(2, "all"), (3, "all"), (3, "odd")]
    assert sets.reordered(spark.createDataFrame([(1, 2)], "x int, y int"), ["y", "z"]).columns == ["y", "x"]


def test_links_outputs_and_names(spark):
    df = spark.createDataFrame([(1, 2, "a"), (2, None, "b"), (3, 9, "c")], "k int, link int, v string")
    assert rows_of(sets.inherited(df, "k", "link", "v"), "k", "v") == [(1, "b"), (2, "b"), (3, "c")]
    src = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "k int, at int")
    out = spark.createDataFrame([(1, 9), (1, 4), (2, 6)], "k int, made int")
    assert rows_of(sets.stale_outputs(src, out, "k", "at", "made"), "k") == [(1,), (3,)]
    files = spark.createDataFrame([(1, "A.PDF"), (2, "~$b.pdf"), (3, "c.txt")], "k int, name string")
    assert rows_of(sets.listing(files, "name", ["pdf"])) == [(1, "A.PDF", "a.pdf")]
    plan = spark.createDataFrame([(1, "a.pdf"), (2, "A.PDF")], "k int, target string")
    assert rows_of(sets.rename_plan(plan, "target", files, "name"), "k") == [(1,)]
    assert rows_of(sets.json_rows(df, ["k", "link"]), "json") == [('{"k":1,"link":2}',), ('{"k":2}',), ('{"k":3,"link":9}',)]
    assert rows_of(sets.sheets({"s": plan, "t": plan.limit(0)}, ["a", "b"])) == [("s", "1", "a.pdf"), ("s", "2", "A.PDF")]


def test_trees_and_outlines(spark):
    paths = spark.createDataFrame([("b/x",), ("a/Y/z",), ("a/q",), ("a/q",)], "path string")
    got = [r.path for r in sets.tree(paths, "path").orderBy("position").collect()]
    assert got == ["a", "b", "a/Y", "a/q", "a/Y/z", "b/x"]
    assert rows_of(sets.folder_tree(paths, "path")) == [("a", 1, 3), ("a/Y", 2, 1), ("b", 1, 1)]
    lines = spark.createDataFrame([(1, p, p < 4) for p in range(1, 6)] + [(2, 1, True), (2, 2, False)], "doc int, page int, big boolean")
    assert rows_of(sets.auto_outline(lines, "doc", "page", F.col("big"))) == [(1, 1, "heading"), (1, 2, "heading"), (1, 3, "heading"), (2, 1, "page"), (2, 2, "page")]
    ranked = sets.ranked_by_mapped_keys(lines, {"o": F.when(F.col("big"), 0).otherwise(1), "doc": F.col("doc"), "page": F.col("page")})
    assert [r.page for r in ranked.orderBy("position").collect()] == [1, 2, 3, 1, 4, 5, 2]


def test_pages(spark):
    df = spark.createDataFrame([(1, "p", 0.95, None), (2, "p", 0.95, None), (2, "t", 0.1, "x"), (3, "p", 0.5, None)], "page int, kind string, share double, t string")
    found = sets.covering_pictures(df.where("kind = 'p'"), df, ["page"], F.col("share"), F.coalesce(F.col("t"), F.lit("")) != "")
    assert rows_of(found, "page") == [(1,)]
    assert rows_of(sets.without_strip(df, F.col("kind") == "t", F.col("share"), 0.0, 0.05), "page") == [(1,), (2,), (3,)]
    assert [r[0] for r in df.select(sets.first_filled_of(F.col("t"), F.col("kind"))).collect()] == ["p", "p", "x", "p"]
