"""TF-IDF pairs of a whole table against brute force."""

import math
import random
import re
from collections import Counter

import __spark_entry__
from calyx.operators import similar


def _brute(texts, threshold, max_terms=5000):
    """All pairs of ids at or above the threshold, with their cosines, after the reference's vectoriser."""
    grams = {}
    for key, text in texts.items():
        w = re.findall(r"\b\w\w+\b", (text or "").lower())
        grams[key] = Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])
    total, df = Counter(), Counter()
    for c in grams.values():
        total.update(c)
        df.update(c.keys())
    kept = set(sorted(total, key=lambda t: (-total[t], t))[:max_terms])
    unit = {}
    for key, c in grams.items():
        w = {t: k * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, k in c.items() if t in kept}
        norm = math.sqrt(sum(x * x for x in w.values()))
        unit[key] = {t: x / norm for t, x in w.items()}
    pairs = {(a, b): sum(x * unit[b].get(t, 0) for t, x in unit[a].items()) for a in unit for b in unit if a < b}
    return {p: s for p, s in pairs.items() if s >= threshold}


def _all_pairs(rows):
    """Pairs of classes and rows of copies as pairs of slides."""
    found = {(r.a, r.b): r.similarity for r in rows}
    first = {b: a for (a, b), s in found.items() if s == 1.0}
    members = {}
    for x in {x for p in found for x in p}:
        members.setdefault(first.get(x, x), []).append(x)
    out = {(a, b): 1.0 for m in members.values() for a in m for b in m if a < b}
    for (a, b), s in found.items():
        if first.get(b) != a:
            out |= {(min(x, y), max(x, y)): s for x in members[a] for y in members[b]}
    return out


def _texts(n, seed):
    """Texts of common and rare words in two scripts, near copies, copies in other signs, and texts without words."""
    rnd = random.Random(seed)
    common, rare = [f"c{i}" for i in range(8)], [f"r{i}" for i in range(400)] + ["置信区间", "缩略语见附录", "ÉTUDE", "x_1"]
    texts = {}
    for i in range(n):
        kind = rnd.random()
        if i > 5 and kind < 0.3:
            w = (texts[rnd.randrange(i)] or "").split()
            texts[i] = " ".join(rnd.choice(rare) if rnd.random() < 0.15 else x for x in w)
        elif i > 5 and kind < 0.4:
            texts[i] = (texts[rnd.randrange(i)] or "").upper().replace(" ", ", ") + "."
        elif kind < 0.47:
            texts[i] = rnd.choice([None, "", " \n", "a 1 -"])
        else:
            texts[i] = " ".join(rnd.choices(common, k=rnd.randint(0, 12)) + rnd.choices(rare, k=rnd.randint(1, 12)))
    return texts


def test_tfidf_above_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK_CLASSES", 40)
    monkeypatch.setattr(similar, "ROWS_AT_ONCE", 7)
    texts = _texts(300, 5)
    rows = spark.createDataFrame([(i, t) for i, t in texts.items()] + [(3, texts[3])], "id int, text string")
    for max_terms in (5000, 60):
        want = _brute(texts, 0.6, max_terms)
        got = similar.tfidf_above(rows, "id", "text", 0.6, max_terms=max_terms).collect()
        assert len(got) == len({(r.a, r.b) for r in got})
        pairs = _all_pairs(got)
        assert len(want) > 50 and pairs.keys() == want.keys()
        assert all(abs(pairs[p] - want[p]) < 1e-9 for p in want)


def test_tfidf_above_without_words(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "-")], "id int, text string")
    assert similar.tfidf_above(rows, "id", "text", 0.6).collect() == []


def test_slides_are_compared_by_text(spark, tmp_path):
    spark.createDataFrame([(1, "one adjusted dose"), (2, "One adjusted dose!"), (3, "other words here"), (4, "one adjusted dose here")], "global_id int, text_content string").write.parquet(f"{tmp_path}/slide_info.parquet")
    found = {(r.a, r.b) for r in __spark_entry__.queries()["j7_slides"](spark, str(tmp_path)).collect()}
    assert found == {(1, 2), (1, 4)}
