"""Literal cases of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from calyx.functions import geometry, identifiers, numbers, rules, texts, titles


def one(spark, make, *values, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[1] for r in df.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


def test_sample_ids(spark):
    got = one(spark, identifiers.sample_id, "001-D0-a", "1-D0-a", "725-M1-a", "", None, "001—D0—a", "12345-m1-B", "O7-dO-X")
    assert got == ["001-D0-a", "001-D0-a", "725-M1-a", "", "", "001-D0-a", "12345-M1-b", "007-D0-x"]


def test_scanned_ids_do_not_pad(spark):
    assert one(spark, identifiers.scanned_sample_id, "1 - MI - a", "725—Ml2_a", "ab") == ["1-M1-a", "725-M12-a", "ab"]


def test_cell_addresses(spark):
    got = one(spark, identifiers.cell_address, "B3", "A1", "AA10", "", "3B", None)
    assert [tuple(g) if g else None for g in got] == [(3, 2), (1, 1), (10, 27), None, None, None]


@pytest.mark.parametrize("number, letters", [(1, "A"), (26, "Z"), (27, "AA"), (702, "ZZ"), (703, "AAA"), (16384, "XFD")])
def test_column_letters(spark, number, letters):
    assert one(spark, identifiers.column_letters, number, kind="int") == [letters]


def test_triples(spark):
    got = one(spark, numbers.triple, "1103.5（905.2，1345.2）mIU/mL", "100.00%（94.73%，100.00%）", "0", "none", None)
    assert [tuple(g) if g else None for g in got] == [(905.2, 1103.5, 1345.2), (94.73, 100.0, 100.0), (0.0, 0.0, 0.0), None, None]


def test_estimates(spark):
    got = one(spark, numbers.estimate, "768.17(507.87, 1161.89)", "12.5", "1.2.3(4, 5)", "")
    assert [tuple(g) if g else None for g in got] == [(768.17, 1161.89, 507.87), (12.5, None, None), None, None]


def test_rates_intervals_counts(spark):
    assert one(spark, numbers.rate_percent, "24 (75.00)", "3.5", "x") == [75.0, 3.5, None]
    assert [tuple(g) if g else None for g in one(spark, numbers.interval, "56.60, 88.54", "5")] == [(56.6, 88.54), None]
    assert [tuple(g) if g else None for g in one(spark, numbers.count_and_share, "3 ( 30.00)", "-")] == [(3, 0.3), None]
    assert one(spark, numbers.event_count, "-", " ", "3.9", "x", None) == [0, 0, 3, None, None]
    assert one(spark, numbers.tidy, 3.0, 3.14159, 2.5, kind="double") == ["3", "3.1416", "2.5"]


def test_rules_replace(spark):
    rules_ = texts.Rules([("foo", "bar")])
    assert one(spark, rules_.count, "foo foo") == [2]
    assert one(spark, rules_.apply, "foo baz") == ["bar baz"]
    digits = texts.Rules(regexes=[(r"\d+", "X")])
    assert one(spark, digits.apply, "a12b34") == ["aXbX"] and one(spark, digits.replaced, "a12b34") == [2]


def test_titles(spark):
    name = "optimal approaches for cpg and mrna vaccines in phase IIa trials"
    assert one(spark, titles.file_name, name) == ["Optimal_Approaches_for_CpG_and_mRNA_Vaccines_in_Phase_IIa_Trials"]
    assert one(spark, titles.before_colon, "Vaccine Development: An Overview of the Last Century", "A: a randomized trial") == ["Vaccine Development", "A: a randomized trial"]
    assert one(spark, titles.file_name, "Vaccine Development: An Overview of the Last Century", "疫苗 研究：进展", "") == ["Vaccine_Development", "疫苗研究", "Untitled_Document"]
    assert one(spark, titles.joined_numerals, "phase I/IIa trial") == ["phase I_IIa trial"]


def test_line_kinds(spark):
    got = one(spark, titles.line_kind, "Vaccine", "PLOS ONE", "ARTICLE IN PRESS", "Academic Editor", "Vaccine 31 (2013) 1870-1876", "Optimal approaches to data collection and analysis", "")
    assert got == ["masthead", "masthead", "status", "metadata", "volume", None, "blank"]


def test_noise_is_no_title(spark):
    no = (
        "Please cite this article in press as: Smith", "31 (2013) 1870–1876", "Klinman Scheiermann", "We need to verify that you are not a robot", "Smith, Jones, Miller",
        "Expert Review Vaccines", "Emerging Microbes & Infections", "Research Article", "author's accepted manuscript", "Institutional Review Board", "a r t i c l e i n f o", "",
    )
    yes = ("Optimal approaches to data collection and analysis", "Clinical Evaluation Study", "Safety of a vaccine in 31 adults (2013)")
    assert one(spark, titles.is_no_title, *no[:-2], no[-1]) == [True] * (len(no) - 1) and one(spark, titles.is_no_title, *yes) == [False] * len(yes)
    assert one(spark, titles.line_kind, no[1], no[2], no[10], "www.nature.com/x", "JVAC 13456 1-9", "Nature") == ["volume", "authors", "kind", "boilerplate", "boilerplate", "masthead"]
    assert one(spark, titles.file_name, no[0], "English head of things: 中文尾巴", "Academic Editor") == ["Untitled_Document", "English_Head_of_Things", "Academic_Editor"]


def test_noise_before_and_after_a_title(spark):
    noisy = ("Smith, J. in press. Clinical evaluation of vaccines", "Please cite this article: what it is", "Trial of a vaccine in adults - PMC | PubMed", "A press of grapes")
    assert one(spark, titles.without_noise, *noisy) == ["Clinical evaluation of vaccines", "what it is", "Trial of a vaccine in adults", "A press of grapes"]


def test_year(spark):
    df = spark.createDataFrame([("Vaccine 31 (2013) 1870-1876", "", ""), ("", "FDA-2019-D-1", ""), ("", "", "D:2015"), ("", "", "")], "a string, b string, c string")
    assert [r[0] for r in df.select(titles.publication_year(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["2013", "2019", "2015", "XXXX"]


def test_snippets_keep_the_text_before_the_first_hit(spark):
    assert one(spark, lambda c: texts.snippets(c, "dose", 4), "abc dose def dose xyz")[0] == ["abc dose def", "def dose xyz"]
    assert one(spark, lambda c: texts.snippets(c, "dose", 4, True), "abc dose def dose xyz")[0] == ["def dose", "xyzdose"]


def test_keyword_windows_merge(spark):
    text = "x" * 50 + "KEY" + "y" * 10 + "key" + "z" * 100
    cut = one(spark, lambda c: texts.keyword_windows(c, ["key"], 20, 10, 1000), text)[0]
    assert cut == "x" * 20 + "KEY" + "y" * 10 + "key" + "z" * 20
    assert one(spark, lambda c: texts.keyword_windows(c, ["none"], 20, 10, 1000), "short", "l" * 50) == ["short", "l" * 10]


def test_scanned_lines(spark):
    got = one(spark, texts.scanned_line, "725 - M1 - a <2.00 mIU/ml 阴性 12.5 陽", "no id", "725-M1-a", None)
    assert got[0].sample == "725-M1-a" and [tuple(p) for p in got[0].pairs] == [("<2.00", "阴性"), ("12.5", "阳性")]
    assert got[1:] == [None, None, None]


def test_json_in_answers(spark):
    assert one(spark, texts.json_text, '```json\n{"a": 1}\n```', 'so: {"a": {"b": 2}} end', "none", None) == ['{"a": 1}', '{"a": {"b": 2}}', None, None]


def test_written_back(spark):
    df = spark.createDataFrame([(["ab", "cde"], "12345"), (["ab", "cde"], "1234"), ([], "")], "r array<string>, t string")
    assert [r[0] for r in df.select(texts.written_back(F.col("r"), F.col("t"))).collect()] == [["12", "345"], ["1234", ""], []]


def test_labels_match(spark):
    df = spark.createDataFrame([("Anti HBs titre", "titre anti"), ("", "x"), ("abc", ""), (None, "x")], "a string, b string")
    strict = [r[0] for r in df.select(rules.labels_match(F.col("a"), F.col("b"))).collect()]
    older = [r[0] for r in df.select(rules.labels_match(F.col("a"), F.col("b"), True)).collect()]
    assert strict == [True, False, False, False] and older == [True, True, False, True]


def test_rotation_there_and_back(spark):
    df = spark.range(1).select(geometry.box(F.lit(1), F.lit(2), F.lit(5), F.lit(9)).alias("b"))
    for angle, w, h in ((90, 60.0, 80.0), (180, 60.0, 80.0), (270, 60.0, 80.0)):
        turned = df.select(geometry.rotated(F.col("b"), F.lit(angle), F.lit(0), F.lit(w), F.lit(h)).alias("t"))
        size = (h, w) if angle != 180 else (w, h)
        back = turned.select(geometry.rotated(F.col("t"), F.lit(0), F.lit(angle), F.lit(size[0]), F.lit(size[1])).alias("b")).first().b
        assert tuple(back) == (1.0, 2.0, 5.0, 9.0)


def test_boxes_of_boxes_stay_small(spark):
    df = spark.createDataFrame([(10.0, 20.0, 50.0, 90.0, 270), (10.0, -5.0, 50.0, 40.0, 90), (70.0, 2.0, 75.0, 9.0, 0), (5.0, 5.0, 9.0, 9.0, None)], "x0 double, top double, x1 double, bottom double, turn int")
    turned = geometry.rotated(geometry.box(F.col("x0"), F.col("top"), F.col("x1"), F.col("bottom")), F.col("turn"), F.lit(180), F.lit(60.0), F.lit(80.0))
    shown = geometry.clamped(turned, F.lit(60.0), F.lit(60.0))
    grown = geometry.union(shown, turned)
    found = df.select(turned.alias("turned"), geometry.area(shown).alias("area"), geometry.overlaps(grown, shown).alias("meets"))
    assert len(found._jdf.queryExecution().analyzed().toString()) < 50_000
    assert [(tuple(r.turned), r.area, r.meets) for r in found.collect()] == [
        ((20.0, 10.0, 90.0, 50.0), 1600.0, True), ((40.0, 10.0, 85.0, 50.0), 800.0, True), ((-15.0, 71.0, -10.0, 78.0), 0.0, None), ((51.0, 71.0, 55.0, 75.0), 0.0, None),
    ]


def test_colours_do_not_change(spark):
    assert one(spark, lambda c: geometry.luma_hex(F.length(c), 1.0, 0.5), "", "x" * 120, "x" * 240) == ["FF0000", "00FF00", "0000FF"]


def test_arbitrated_titles(spark):
    good, other = "Optimal approaches to data collection and analysis", "Clinical evaluation of a randomized vaccine trial"
    rows = [(good, None, ""), (None, other, "Microsoft Word - x.docx"), ("ARTICLE IN PRESS", other, ""), ("Vaccine", None, "Untitled"), (good, other, other)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, meta string")
    out = titles.arbitrated_title([(F.col("a"), 10.0), (F.col("b"), 8.0)], F.col("meta"))
    assert [r.t for r in df.select("i", out.alias("t")).orderBy("i").collect()] == [good, other, other, "", other]


def test_titles_from_lines(spark):
    from calyx.operators import sequences

    lines = ["PLOS ONE", "Research Article", "Optimal approaches to data collection", "and analysis of vaccines", "Smith, Jones, Miller", "Body text that follows"]
    sizes = [30.0, 9.0, 18.04, 17.96, 10.0, 9.0]
    rows = [("d", i, t, s) for i, (t, s) in enumerate(zip(lines, sizes))] + [("e", 0, "short", 9.0), ("f", 0, "", 9.0)]
    df = spark.createDataFrame(rows, "doc string, at int, line string, size double")
    title = "Optimal approaches to data collection and analysis of vaccines"
    assert [tuple(r) for r in sequences.hierarchy_title(df, "doc", "at", "line", "size").collect()] == [("d", title)]
    assert [tuple(r) for r in sequences.plain_title(df, "doc", "at", "line").collect()] == [("d", title)]


def test_block_titles(spark):
    from calyx.operators import sequences

    rows = [("d", 0, "ARTICLE IN PRESS", 10.0), ("d", 2, "Optimal approaches to\n data collection", 50.0), ("d", 1, "Nature", 20.0), ("d", 3, "Another title of some kind", 60.0), ("e", 0, "A title that stands too low on its page", 90.0)]
    df = spark.createDataFrame([(*r, 100.0) for r in rows], "doc string, at int, t string, top double, h double")
    assert [tuple(r) for r in sequences.block_title(df, "doc", "at", "t", "top", "h").collect()] == [("d", "Optimal approaches to data collection")]
