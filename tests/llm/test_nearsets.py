import random

import numpy as np
import pandas as pd
import pytest

from calyx.llm import nearsets, queries


def _brute(rows, threshold=0.7):
    norm = {i: "".join(c for c in t.lower() if c.isalnum()) for i, t in rows if t is not None and i is not None}
    sets = {i: {t[k : k + 5] for k in range(len(t) - 4)} for i, t in norm.items() if len(t) >= 40}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def _texts(seed, n=60):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8))) for _ in range(60)]
    rows = []
    for i in range(n):
        base = [rnd.choice(words) for _ in range(rnd.choice([8, 12, 30, 60, 150]))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(rnd.randint(0, 3)):
            edited = [rnd.choice(words) if rnd.random() < rnd.choice([0.03, 0.08, 0.12]) else w for w in base]
            rows.append((len(rows), " ".join(edited[: len(edited) - rnd.randint(0, len(edited) // 5)]).title()))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs_are_found(spark, seed):
    rows = _texts(seed)
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "gid int, text string, rep string, n int").repartition(3)
    got = {(r.id_a, r.id_b) for r in nearsets.similar_pairs(df, "gid", "text").collect()}
    assert got == _brute(rows) and got


def test_copies_nulls_and_short_texts(spark):
    long = "The quick brown fox jumps over the lazy dog and then runs away again"
    rows = [(1, long), (1, long), (2, long.upper() + "!"), (3, None), (4, ""), (5, "short"), (None, long), (6, long + " x"), (7, "报" * 39), (8, "报" * 40), (9, "报" * 41)]
    df = spark.createDataFrame(rows, "gid int, text string")
    got = {(r.id_a, r.id_b) for r in nearsets.similar_pairs(df, "gid", "text").collect()}
    assert got == {(1, 2), (1, 6), (2, 6), (8, 9)}
    assert nearsets.similar_pairs(df.limit(0), "gid", "text").count() == 0
    groups = {r.id: (r.cluster_id, r.n_links, round(r.max_similarity, 2)) for r in nearsets.similarity_groups(df, "gid", "text").collect()}
    assert groups[1][0] == groups[2][0] == groups[6][0] == 1 and groups[1][2] == 1.0 and groups[6][1] == 1 and groups[9] == (8, 1, 1.0)


def _reps(spark, rows):
    norm = [(i, "".join(c for c in t.lower() if c.isalnum())) for i, t in rows]
    return spark.createDataFrame(list({t: (i, t) for i, t in reversed(norm) if len(t) >= 40}.values()), "rep long, text string")


def test_texts_without_enough_segments(spark):
    rows = _texts(3, 25)
    reps = _reps(spark, rows)
    met = {(r.a, r.b) for r in nearsets._lone_pairs(reps, reps.select("rep"), 0.7).collect()}  # all go through single runs
    ids = {r.rep for r in reps.collect()}
    wanted = {p for p in _brute(rows) if set(p) <= ids}
    assert wanted and wanted <= met


def test_hot_signatures_are_split_without_losing_a_pair(spark):
    rows = _texts(4, 40)
    reps = _reps(spark, rows)
    got = {(r.a, r.b) for r in nearsets.similar_representatives(reps, most=2).df.collect()}
    ids = {r.rep for r in reps.collect()}
    assert got == {p for p in _brute(rows) if set(p) <= ids} and got


def test_copies_of_one_text_meet_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearsets, "MEMBER_BLOCK", 3)
    text = "one text that many keys hold, long enough to be compared with others"
    df = spark.createDataFrame([(i, text) for i in range(20)], "gid int, text string")
    got = {(r.id_a, r.id_b) for r in nearsets.similar_pairs(df, "gid", "text").collect()}
    assert got == {(a, b) for a in range(20) for b in range(a + 1, 20)}


@pytest.mark.parametrize("letters", ["ab", "abcdefghij报告中𝒳", "".join(map(chr, range(0x4E00, 0x4E00 + 9_000)))])
def test_verified_similarities_are_exact(monkeypatch, letters):
    monkeypatch.setattr(nearsets, "BATCH_CHARS", 12_000)
    rnd = random.Random(5)
    base = ["".join(rnd.choice(letters) for _ in range(rnd.randint(5, 3_000))) for _ in range(12)]
    texts = base + [t[: len(t) // 2] + rnd.choice(letters) + t[len(t) // 2 :] for t in base]
    pairs = [(i, j) for i in range(24) for j in range(i + 1, 24)]
    runs = [{t[k : k + 5] for k in range(len(t) - 4)} for t in texts]
    assert [len(s) for s in nearsets._exact_runs(texts, 5)] == [len(s) for s in runs]
    pdf = pd.DataFrame({"a": [p[0] for p in pairs], "b": [p[1] for p in pairs], "text_a": [texts[p[0]] for p in pairs], "text_b": [texts[p[1]] for p in pairs]})
    got = pd.concat(nearsets._verify(0.7, 5)(iter([pdf, pdf.iloc[:0]])))
    want = [(i, j, len(runs[i] & runs[j]) / len(runs[i] | runs[j])) for i, j in pairs]
    assert [tuple(r) for r in got.itertuples(index=False)] == [p for p in want if p[2] >= 0.7 - 1e-12]
    assert np.isin(got["b"] - got["a"], 12).any()


def test_very_long_texts(spark):
    rnd = random.Random(9)
    base = [rnd.choice("abcdefghijklmnop") for _ in range(300_000)]
    other = base[:]
    for at in range(0, len(other), 100):
        other[at] = "z"
    df = spark.createDataFrame([(1, "".join(base)), (2, "".join(other)), (3, "".join(reversed(base)))], "gid int, text string")
    assert {(r.id_a, r.id_b) for r in nearsets.similar_pairs(df, "gid", "text").collect()} == {(1, 2)}


def test_every_slide_has_a_group(spark, tmp_path):
    long = "The quick brown fox jumps over the lazy dog and then runs away again"
    other = "Nothing here is like that text about animals, so it has no partner at all"
    rows = [(1, long), (1, long), (2, long.upper() + "!"), (3, None), (4, ""), (5, "short"), (6, "short"), (7, other)]
    spark.createDataFrame(rows, "global_id int, text_content string").write.parquet(f"{tmp_path}/slide_info.parquet")
    got = sorted(tuple(r) for r in queries.queries()["p5_groups"](spark, str(tmp_path)).collect())
    assert got == [(1, 1, 0, 1.0), (2, 1, 0, 1.0), *[(i, i, None, None) for i in (3, 4, 5, 6)], (7, 7, 0, None)]


@pytest.mark.parametrize("mapped", [True, False])
def test_all_pairs_are_found_in_many_groups_and_passes(spark, monkeypatch, mapped):
    monkeypatch.setattr(nearsets, "GROUP_SIGNATURES", 1_000)
    monkeypatch.setattr(nearsets, "PASS_LEAST", 12_000 if mapped else 50_000)
    monkeypatch.setattr(nearsets, "PASS_SHARE", 0)
    if not mapped:
        monkeypatch.setattr(nearsets.runtime.Folder, "mapped", lambda self: None)
    made, passes = nearsets._passes, []
    monkeypatch.setattr(nearsets, "_passes", lambda *args: passes.append(made(*args)) or passes[-1])
    rows = _texts(6, 40)
    reps = _reps(spark, rows)
    got = {(r.a, r.b) for r in nearsets.similar_representatives(reps.repartition(3)).df.collect()}
    ids = {r.rep for r in reps.collect()}
    assert got == {p for p in _brute(rows) if set(p) <= ids} and got
    assert max(len(of_band) for of_band in passes) > 1 and max(now.number for of_band in passes for now in of_band) > 1


def test_what_a_pass_shuffles_does_not_grow_with_the_groups(spark, monkeypatch, tmp_path):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghijklm") for _ in range(6)) for _ in range(400)]
    reps = spark.createDataFrame([(i, "".join(rnd.choice(words) for _ in range(70))) for i in range(600)], "rep long, text string").repartition(1)
    counted = nearsets.runtime.Stage(reps.mapInPandas(nearsets._count_signatures(0.7, 16), nearsets.COUNTED), "counts")
    table, made, order = nearsets._cost_table(counted.df, 16)
    assert set(order.numbers(counted.df.where("kind = 'text'").toPandas())) == set(range(600))
    costs, ordered = spark.sparkContext.broadcast(table), spark.sparkContext.broadcast(order)
    texts = counted.df.where("kind = 'text'").select("number", "size", "task", "place", "text")

    def sent(signatures, room):
        monkeypatch.setattr(nearsets, "GROUP_SIGNATURES", signatures)
        passes = nearsets._passes(512, 0, order.total, made[512], room, nearsets.runtime.Folder(spark, "sketches"))
        blobs = [texts.mapInPandas(nearsets._emit_signatures(0.7, costs, 16, ordered, now, 20_000), "grp int, data binary") for now in passes]
        return sum(now.number for now in passes), [b.selectExpr("sum(length(data))").first()[0] for b in blobs]

    one, (whole,) = sent(1 << 40, 1 << 40)
    many, parts = sent(2_000, 400_000)
    assert one == 1 and many > 50 and len(parts) > 1
    assert max(parts) < 440_000 and sum(parts) < 3 * whole
