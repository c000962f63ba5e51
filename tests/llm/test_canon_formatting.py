import pytest

from calyx.llm import canon, formatting

ENTRIES = (
    (1, "note", "Negative", ("阴性", "Neg")), (2, "note", "Positive", ("阳性", "Pos")), (6, "note", "Weakly positive", ("弱阳性",)),
    (9, "note", "Haemolysed sample", ("溶血样本", "Hemolyzed")), (32, "note", "Lost to follow-up", ("失访", "LTFU")), (39, "note", "Not applicable", ("不适用", "NA")),
    (40, "metric", "GMC", ("几何平均浓度",)), (41, "metric", "GMI", ("几何平均增长倍数",)), (58, "metric", "Half-life of decay", ("衰减半衰期",)),
)


@pytest.mark.parametrize(
    "field, value, entry",
    [
        ("note", "Negatiev", 1), ("note", "ＥＧＡＴＩＶＥ", 1), ("note", "阴 性·！", 1), ("note", "N.e.g.", 1), ("note", "positive, Wekaly", 6), ("note", "弱·了阳性！", 6),
        ("note", "WEAK. POSITIVE / am", 6), ("note", "sample Haemolysed [v2]", 9), ("note", "Lost to follo", 32), ("note", "LFTU p.3", 32), ("note", "NAA", 39), ("note", "courier ok", 0),
        ("note", "824-M4-b", 0), ("note", "二楼走廊16", 0), ("note", "12.95", 0), ("note", "阳样性", 2), ("note", "Neg (see log)", 1), ("note", "Negative - " + "x y " * 50_000, 1),
        ("note", "é" * 100_000, 0), ("note", "(" * 20_000, 0), ("metric", "g.m.c.", 40), ("metric", "GM", 0), ("metric", "of decay Half.", 58), ("metric", "G.M.I. (95% CI)", 41), ("other", "GMC", 0),
    ],
)
def test_values(field, value, entry):
    assert canon.Mapper(ENTRIES).entry(field, value) == entry


def test_automaton_against_plain_distance():
    import random

    def distance(a, b):  # optimal string alignment
        rows = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                rows[i][j] = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    rows[i][j] = min(rows[i][j], rows[i - 2][j - 2] + 1)
        return rows[-1][-1]

    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(5, 12))) for _ in range(30)]
    trie = canon.ReferenceTrie(True)
    for i, w in enumerate(words):
        trie.add(w, i, True)
    for _ in range(300):
        value = "".join(rnd.choice("abcd") for _ in range(rnd.randint(3, 13)))
        want = {i: d for i, w in enumerate(words) if (d := distance(value, w)) <= canon.allowed_errors(w)}
        assert {i: r[0] for i, r in trie.within(value).items()} == want


def _reference(spark, entries=ENTRIES):
    rows = spark.createDataFrame([(e, f, a, list(b)) for e, f, a, b in entries], "entry int, field string, label string, aliases array<string>")
    return canon.reference_rows(rows, "entry", "field", "label", "aliases")


def test_rows(spark):
    rows = spark.createDataFrame([("note", 1, "neg"), ("note", 1, "neg"), ("note", 2, None), ("note", 3, "　"), ("note", 4, "Negative"), ("note", 5, "GMC")], "field string, row_id long, value string")
    got = sorted((r.row_id, r.canon_id) for r in canon.map_values(rows, "field", "row_id", "value", _reference(spark)).collect())
    assert got == [(1, 1), (1, 1), (5, 0)]
    assert canon.map_values(rows.limit(0), "field", "row_id", "value", _reference(spark)).count() == 0
    assert {r.canon_id for r in canon.map_values(rows, "field", "row_id", "value", _reference(spark, ())).collect()} == {0}


def test_long_labels_may_have_any_words_cut():
    label = "Quantitative determination of haemagglutination inhibition antibodies against seasonal influenza viruses"
    mapper = canon.Mapper(((1, "note", label, ()), (2, "note", "Quantitative determination of something else entirely", ())))
    for value in ("Quant determ of haemag inhib antib again season influe virus", "against seasonal influenza viruses quantit determination of haemagg inhibition antibodies"):
        assert mapper.entry("note", value) == 1
    assert mapper.entry("note", "Quant determ of haemag inhib antib") == 0


def test_a_list_in_parts_gives_the_same(spark, monkeypatch):
    from calyx import runtime

    monkeypatch.setattr(runtime, "HOT_ROWS", 4)
    monkeypatch.setattr(runtime, "HOT_KEYS", 10**9)
    values = ["Negatiev", "neg", "WEAK. POSITIVE / am", "Lost to follo", "courier ok", "NAA", "阳样性", "negative", None, "Negative"]
    rows = spark.createDataFrame([("note", i, values[i % len(values)]) for i in range(60)] + [("note", 100 + i, "neg") for i in range(9)], "field string, row_id long, value string")
    whole = canon.map_values(rows, "field", "row_id", "value", _reference(spark))
    parted = canon.map_values(rows, "field", "row_id", "value", _reference(spark), most=2)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parted.collect())) and whole.where("canon_id > 0").count() > 40


def test_all_entries_within_reach(spark):
    entries = ((1, "note", "Sample clear", ()), (2, "note", "Sample clean", ()), (3, "note", "Other", ()))
    rows = spark.createDataFrame([("note", 1, "sample cleax"), ("note", 2, "sample cleax"), ("note", 3, "nothing")], "field string, row_id long, value string")
    got = sorted((r.value, r.canon_id, r.errors) for r in canon.entries_within(rows, "field", "value", _reference(spark, entries)).collect())
    assert got == [("sample cleax", 1, 1), ("sample cleax", 2, 1)]
    assert canon.Mapper(entries).entry("note", "sample cleax") == 0  # a tie


TEXT = "Document No: D-12\nProtocol: X-1\n\nThe first line. And more"
SAME = ["DOCUMENT NO： d 12；Protocol： x/1\n---\nThe FIRST line And more .", "* Protocol = X1 ;\nDocument​ No. = D_12\r\n\r\nThe first line; and more"]
OTHER = ["Document No: X-1\nProtocol: D-12\n\nThe first line. And more", "Document No: D-12\nProtocol: X-1\n\nAnd more. The first line", "Document No: D-13\nProtocol: X-1\nThe first line. And more"]


def _files(spark, rows):
    return spark.createDataFrame(rows, "fid long, name string, page string, raw string, canon string")


def test_formatting_copies(spark):
    rows = [(5, "A_b.pdf", TEXT, "", ""), (9, "a b.PDF", SAME[0], "", ""), (7, "(A)-B.pdf", SAME[1], "", ""), (7, "(A)-B.pdf", SAME[1], "", ""), (8, "A_b.pdf", TEXT, "", "")]
    rows += [(20 + i, "A_b.pdf", t, "", "") for i, t in enumerate(OTHER)] + [(30, "A_b.pdf", None, "", ""), (31, "A_b.pdf", " ​\n", "", ""), (None, "A_b.pdf", TEXT, "", ""), (32, None, TEXT, "", ""), (33, "", TEXT, "", "")]
    got = sorted(tuple(r) for r in formatting.formatting_copies(_files(spark, rows), "fid", "name", "page").collect())
    assert got == [(5, 7), (5, 8), (5, 9), (32, 33)]
    counted = {r.first_id: (r.spellings, r.copies, r.copied_rows) for r in formatting.collapse_formatting(_files(spark, rows), "fid", "name", "page").collect()}
    assert counted[5] == (3, 4, 5) and counted[32] == (1, 2, 2)
    assert formatting.formatting_copies(_files(spark, []), "fid", "name", "page").count() == 0


def test_labels_that_are_not_listed(spark):
    one = "Batch Size: 40\nStorage Room: B 7\nPrüfer: M. Weiß\nThe run took long. It ended late"
    other = "PRÜFER： m weiß; storage-room = b7; batch size:40\n***\nThe run took long. It ended late."
    rows = [(1, "n", one, "", ""), (2, "n", other, "", ""), (3, "n", one.replace("Batch Size: 40", "Batch Size: B 7").replace("Room: B 7", "Room: 40"), "", "")]
    got = sorted(tuple(r) for r in formatting.formatting_copies(_files(spark, rows), "fid", "name", "page").collect())
    assert got == [(1, 2)]


def test_hot_copies(spark, monkeypatch):
    from calyx import runtime

    monkeypatch.setattr(runtime, "HOT_ROWS", 3)
    monkeypatch.setattr(runtime, "HOT_KEYS", 10**9)
    rows = [(i, "n", TEXT if i % 2 else SAME[0], "", "") for i in range(30)] + [(100, "n", "z" * 200_000, "", ""), (101, "N", "Z" * 200_000, "", "")]
    got = sorted(tuple(r) for r in formatting.formatting_copies(_files(spark, rows), "fid", "name", "page").collect())
    assert got == [(0, i) for i in range(1, 30)] + [(100, 101)]
