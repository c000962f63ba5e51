import os
import random

import pytest
from pyspark.sql import functions as F

from calyx.llm import bpe, mixing, residue

needs_vocabulary = pytest.mark.skipif(not os.path.exists(bpe.vocabulary_path()), reason="no vocabulary file")


@pytest.fixture(scope="module")
def coder():
    return bpe.load(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def reference(coder):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


@needs_vocabulary
def test_encoding_matches_the_library_at_any_chunk_size(coder, reference):
    rnd = random.Random(1)
    for n in range(400):
        text = "".join(rnd.choice("ab'st  \n\tre1２中文é🌡️xyz<|endoftext|>") for _ in range(rnd.randint(0, 300)))
        assert coder.encode(text, chunk=rnd.choice([1, 2, 3, 7, 50, 10_000])) == reference.encode_ordinary(text)


@needs_vocabulary
def test_long_runs_and_round_trip(coder, reference):
    rnd = random.Random(2)
    for text in ("a" * 50_000, "".join(rnd.choice("etaoinshrdlu") for _ in range(60_000)), "  " * 20_000, "报告" * 10_000, "😀" * 3_000):
        ids = coder.encode(text)
        assert ids == reference.encode_ordinary(text) and coder.decode(ids) == text
    assert coder.encode(None) == coder.encode("") == [] and coder.lookahead_bound > coder.longest


@needs_vocabulary
def test_runs_are_handed_on_in_bounded_memory(coder, reference, monkeypatch):
    monkeypatch.setattr(bpe, "OPEN_AT", 4)  # nearly every run that reaches the end of a chunk is open
    rnd = random.Random(5)
    parts = ["a", "th", "ing", "é", "\u0301", " ", "  ", "\n", "\t", "'s", "'", "1", "23", "!", "...", "报", "\u3000", "😀", "\r\n"]
    for _ in range(600):
        text = "".join(rnd.choice(parts) * rnd.choice([1, 1, 2, 5, 30]) for _ in range(rnd.randint(1, 40)))
        assert coder.encode(text, chunk=rnd.choice([5, 7, 16, 64])) == reference.encode_ordinary(text)
    assert 0 < coder.lookahead < coder.lookahead_bound
    letters = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40_000)).encode()
    path, ids, held = bpe._Path(coder), [], 0
    for at in range(0, len(letters), 100):
        ids += path.feed(letters[at : at + 100])
        held = max(held, len(path.ends))
    assert ids + path.rest() == reference.encode_ordinary(letters.decode()) and held < 2 * (coder.lookahead + coder.longest)


@needs_vocabulary
def test_a_chain_of_merges_gives_the_lookahead():
    ranks = {bytes([b]): b - 97 for b in range(97, 103)} | {b"ef": 6, b"de": 7, b"cd": 8, b"bc": 9, b"ab": 10}
    small = bpe.Transducer(ranks)
    # ab waits for c, which cd may take, which e may take d from, which f may take e from
    assert small.lookahead == 5 and list(small.encode("abcde")) == [0, 9, 7] and list(small.encode("abcdef")) == [10, 8, 6]


@needs_vocabulary
def test_columns(spark, coder):
    df = spark.createDataFrame([(1, "hello"), (2, None), (3, ""), (1, "hello")], "doc long, ids string")
    got = sorted((r.doc, r.ids) for r in bpe.encode_corpus(df, "doc", "ids").collect())
    assert got == [(1, coder.encode("hello"))] * 2 + [(2, []), (3, [])]
    back = df.select("doc", bpe.decode_column(bpe.encode_column(F.col("ids"))).alias("t"), bpe.count_column(F.col("ids")).alias("n"))
    assert sorted((r.doc, r.t, r.n) for r in back.collect())[-1] == (3, "", 0)


def test_weights():
    sizes = {"a": 900.0, "b": 90.0, "c": 10.0, "none": 0.0}
    _, flat = mixing.temperature_weights(sizes, 5.0)
    assert all(abs(w - 1 / 3) < 1e-6 for w in flat.values())
    for target in (0.3, 0.7, 1.0):
        _, w = mixing.temperature_weights(sizes, target)
        assert abs(mixing.entropy(w) - target) < 1e-6
    budget, x, w = mixing.tilted_weights(sizes, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2})
    assert x == 1.0 and abs(budget - 360) < 1e-9 and w == {"a": 0.5, "b": 0.5}
    budget, x, w = mixing.tilted_weights(sizes, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}, budget=600)
    assert budget == 600 and 0 < x < 1 and 600 * w["b"] <= 180.001


def _mix(spark, rows, target):
    docs = spark.createDataFrame(rows, "doc long, source string, text string, tokens string, key int, _block int")
    goal = spark.createDataFrame(target, "source string, share double, repeats int")
    texts = mixing.mix_texts(docs, "doc", "source", "text", goal, F.length("text").cast("long"))
    return mixing.mix(texts, mixing.target_rows(goal, "source", "share", "repeats"))


def test_mix_reaches_its_shares(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 50)
    rnd = random.Random(3)
    rows = [(i, "abc"[min(2, i % 10 // 4)], f"{i}-" + "x" * rnd.randint(1, 60), "", 0, 0) for i in range(1500)]
    rows += [(2000 + i, "c", rows[i][2], "", 0, 0) for i in range(100)] + [(3000, None, "zz", "", 0, 0), (3001, "a", None, "", 0, 0), (3002, "a", "", "", 0, 0), (3003, "other", "q", "", 0, 0)]
    drawn, report = _mix(spark, rows, [("a", 0.2, 1), ("b", 0.3, 2), ("c", 0.4, 3), ("gone", 0.1, 5), (None, 0.0, 1)])
    found = {r.source: r for r in report.collect()}
    for source, share in (("a", 0.2), ("b", 0.3), ("c", 0.4)):
        assert abs(found[source].actual_share - share / 0.9) < 0.005 and found[source].most_uses <= found[source].max_repeats
    assert found["gone"].drawn_tokens == 0 and set(found) == {"a", "b", "c", "gone"}
    picked = drawn.collect()
    texts = [dict((r[0], r[2]) for r in rows)[r.key] for r in picked]
    assert len(texts) == len(set(texts))


def test_a_bisected_exponent_decides_what_is_drawn(spark):
    rnd = random.Random(4)
    rows = [(i, "abc"[min(2, i % 10 // 4)], f"{i}-" + "x" * rnd.randint(1, 60), "", 0, 0) for i in range(1500)]
    goal = spark.createDataFrame([("a", 0.2, 3), ("b", 0.3, 3), ("c", 0.5, 3)], "source string, share double, repeats int")
    docs = spark.createDataFrame(rows, "doc long, source string, text string, tokens string, key int, _block int")
    texts = mixing.mix_texts(docs, "doc", "source", "text", goal, F.length("text").cast("long"))
    target = mixing.target_rows(goal, "source", "share", "repeats")
    exact = {r.source: r for r in mixing.mix(texts, target)[1].collect()}
    budget = 1.2 * sum(r.drawn_tokens for r in exact.values())
    for asked in ({"budget": budget}, {"target_entropy": 1.08}):
        drawn, report = mixing.mix(texts, target, **asked)
        found = {r.source: r for r in report.collect()}
        assert all(exact[s].exponent == 1 and 0 < r.exponent < 1 for s, r in found.items()), found
        assert max(abs(r.actual_share - exact[s].actual_share) for s, r in found.items()) > 0.02
        total = sum(r.drawn_tokens for r in found.values())
        assert all(abs(r.drawn_tokens - r.weight * total) <= 3 * 65 and r.most_uses <= r.max_repeats for r in found.values())
        assert sum(r.tokens * r.uses for r in drawn.collect()) == total


def test_mix_of_nothing(spark):
    drawn, report = _mix(spark, [], [("a", 1.0, 1)])
    assert drawn.count() == 0 and [(r.drawn_tokens, r.actual_share) for r in report.collect()] == [(0, 0.0)]


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("Title: {{ country }}. Done.", ["slot"]), ("Prepared for [insert Sponsor name] today", ["slot"]), ("共入组【请填写样本量】名", ["slot"]), ("研究于××××年××月××日启动", ["slot"]),
        ("Contact: [●], floor", ["slot"]), ("(country: ______)", ["slot"]), ("under <STUDY_TITLE> and", ["slot"]), ("by %visit_date% or", ["slot"]), ("TBD[product]", ["slot"]), ("〔审核人〕待定", ["slot"]),
        ("Beginn: [Ort einfügen].", ["slot"]), ("[lugar por completar]", ["slot"]), ("??", []), ("values [9], <9.5 and %CV below 9% here", []), ("code <LLOQ> is defined in the manual", []),
        ("The macro fills ${name} style fields on export.", []), ('Configuration: {"visit": 9, "arm": "B"}.', []), ("```\nx = {{ name }}\n```", []), ("[redacted] [sic] 【A】 «A» #9 {9, 9}", []),
        ("Lorem ipsum dolor sit amet", ["filler"]), ("示例文字 示例文字。", ["filler"]), ("第九章的示例文字已删除。", []), ("test test test test test", ["filler"]), ("Not done, not done, not done, done", []),
        ("fed ad libitum in situ", []), ("404 Page not found", ["error"]), ("portal returned error 404 twice and it was fixed", []), ("错误 403：您没有权限查看此文档。", ["error"]),
        ("Your session has expired. Sign in again to continue.", ["error"]), ("JavaScript is disabled in your browser", ["script"]), ("Sites were told that JavaScript must be enabled in the portal.", []),
        ('Shown in code:\n```\nraise Exception("Internal server error")\n```\nThat was all.', []), ("The message 'Page not found' is written as plain text and the syntax is defined in section 4.", []),
        ("The word lorem ipsum is used as an example of syntax.", []), ("The phrase JavaScript is disabled is shown as a tag and is defined in the glossary.", []),
        ('a = 1\nb = load("x")\nz = "{{ name }}"\nprint(z)', []), ('a = load(1)\nraise Exception("Internal server error")', []),
        ("The message is short. 404 Page not found", ["error"]), ("Fehler 503\nBitte versuchen Sie es erneut.", ["error"]), ("Errore 500. Riprova più tardi.", ["error"]),
        ("ページが見つかりません。", ["error"]), ("Pagina niet gevonden.", ["error"]), ("Schakel JavaScript in om verder te gaan.", ["script"]), ("Error 404 was seen twice in the log of visit 3.", []),
        ("Sed ut enim veniam quis nostrud", ["filler"]),
        ("请启用浏览器脚本后重试。", ["script"]), ("已告知各中心日记卡门户需要启用脚本", []), ("", []), (None, []), ("x" * 300_000, []), ("word " * 3 + "a. " * 60_000, []), ("[" * 50_000, []),
    ],
)
def test_residue(spark, text, kinds):
    df = spark.createDataFrame([(1, text)], "doc int, text string")
    assert df.select(residue.residue_kinds(F.col("text")).alias("k")).first().k == kinds


def test_residue_rows(spark):
    df = spark.createDataFrame([(1, "{{ name }}", "a"), (1, "{{ name }}", "a"), (2, "fine", "b"), (3, None, "c")], "doc int, text string, residue_kinds string")
    assert [tuple(r) for r in residue.with_residue(df, "doc", "text").collect()] == [(1, ["slot"])]
    assert sorted(r.residue_kinds for r in residue.without_residue(df, "doc", "text").collect()) == ["b", "c"]
    assert residue.with_residue(df.limit(0), "doc", "text").count() == 0


def test_tutorials_are_discounted_by_place_and_density(spark):
    plain = "The visit took place as planned. " * 40
    far = f"Letters use Jinja, not Mustache, and that syntax is fixed.\n{plain}\nDear [Insert name], welcome."
    cases = {
        far: True,  # two names far away from the slot
        "A Jinja page shows {{ user_name }}. Mustache does so too.": False,
        f"{plain}\nA template engine such as Jinja fills it in.\nIt may be {{{{ user_name }}}} there.\n{plain}": False,
        "Run it:\n```\nx = {{ user_name }}\n\nDear [Insert name], welcome.": True,  # a fence left open
        "Run it:\n```\nx = 1\n\ny = {{ user_name }}\n```\nThat is all.": False,
        "import page\nfor x in rows:\nreturn page\n<b>{{ user_name }}</b>": False,  # code on most lines
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "doc_id int, text string")
    found = {r.doc_id for r in residue.with_residue(rows, "doc_id", "text").collect()}
    assert found == {i for i, case in enumerate(cases.values()) if case}
