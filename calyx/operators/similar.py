"""TF-IDF similarity of all texts of a table, at or above a threshold.

Texts whose counts of vocabulary terms are equal, up to a factor, form a class:
they are similar by 1, so only one of them is compared. Classes are compared by norms. The vocabulary is
dealt into buckets, and a vector is folded to the norms of its parts in each
bucket. By Cauchy-Schwarz the product of two folded vectors is no less than that
of the vectors, so a pair below the threshold there is passed over, whatever
common terms it shares; no row is formed for a shared term. What is left is
computed on the vectors themselves.

The folded vectors of blocks of classes are multiplied block by block: the pairs
looked at are quadratic in the classes, at 256 multiplications each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calyx import runtime
from calyx.operators.joins import duplicates_by

#: Buckets of a folded vector.
BUCKETS = 256
#: Classes in a block; a task holds two blocks, and at least MIN_BLOCKS blocks are made.
BLOCK_CLASSES, MIN_BLOCKS = 50_000, 4
#: Rows of one block multiplied at once.
ROWS_AT_ONCE = 512
#: Folded products are single precision; they may err by less than this.
SLACK = 1e-3


def tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id, words``: one row a key, its lower-case words of two or more letters or digits joined by spaces."""
    words = F.regexp_extract_all(F.lower(F.col("text")), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    one = docs.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(text).alias("text"))
    return one.select("id", F.coalesce(F.array_join(words, " "), F.lit("")).alias("words"))


def vocabulary(words: DataFrame, max_terms: int, ngrams: int) -> list[str]:
    """The one- to n-grams with most occurrences, ties by term."""
    split = words.where("words != ''").select(F.split("words", " ").alias("w"))
    grams = [F.col("w")]
    for n in range(2, ngrams + 1):  # the last ones lack a word and are null
        grams.append(F.zip_with(grams[-1], F.slice("w", n, F.size("w")), lambda a, b: F.concat(a, F.lit(" "), b)))
    counts = split.select(F.explode(F.concat(*grams)).alias("term")).where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("total"))
    return [r.term for r in counts.orderBy(F.desc("total"), "term").limit(max_terms).select("term").collect()]


def _unpacked(vector: bytes, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Terms and counts of one vector."""
    width = _term_type(n_terms).itemsize
    at = len(vector) // (width + 4) * width
    return np.frombuffer(vector[:at], _term_type(n_terms)), np.frombuffer(vector[at:], "<u4")


def _term_type(n_terms: int) -> np.dtype:
    return np.dtype("<u2" if n_terms <= 1 << 16 else "<u4")


def _vectors(words: DataFrame, terms: list[str], ngrams: int) -> DataFrame:
    """``words`` as ``id, vector``: the numbers of its terms in order, then their counts in lowest terms."""
    number = {t: i for i, t in enumerate(terms)}

    def packed(text: str) -> bytes:
        w = text.split(" ")
        found = Counter(number[g] for n in range(1, ngrams + 1) for at in range(len(w) - n + 1) if (g := " ".join(w[at : at + n])) in number)
        at = sorted(found)
        counts = np.array([found[t] for t in at], "<u4")
        return np.array(at, _term_type(len(terms))).tobytes() + (counts // max(1, np.gcd.reduce(counts, initial=0))).astype("<u4").tobytes()

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            yield pd.DataFrame({"id": b["id"], "vector": b["words"].map(packed)})

    return words.mapInPandas(batches, f"id {words.schema['id'].dataType.simpleString()}, vector binary")


def _frequencies(classes: DataFrame, n_terms: int) -> np.ndarray:
    """Texts that hold each term."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(n_terms, dtype=np.int64)
        for b in it:
            for vector, copies in zip(b["vector"], b["copies"], strict=True):
                df[_unpacked(vector, n_terms)[0]] += copies
        yield pd.DataFrame({"term": np.arange(n_terms), "df": df})

    out = np.zeros(n_terms, dtype=np.int64)
    for r in classes.select("vector", "copies").mapInPandas(batches, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


class _Block:
    """Unit vectors of a block: by entries, and folded."""

    def __init__(self, rows: pd.DataFrame, idf: np.ndarray):
        self.id = rows["id"].to_numpy()
        terms, counts = zip(*[_unpacked(v, len(idf)) for v in rows["vector"]], strict=True)
        self.size = np.array([len(x) for x in terms])
        self.term = np.concatenate(terms).astype(np.int64)
        self.row = np.repeat(np.arange(len(self.id)), self.size)
        self.first = np.cumsum(self.size) - self.size
        w = np.concatenate(counts) * idf[self.term]
        self.w = w / np.sqrt(np.bincount(self.row, w * w, len(self.id)))[self.row]
        squares = np.bincount(self.row * BUCKETS + self.term % BUCKETS, self.w**2, len(self.id) * BUCKETS)
        self.folded = np.sqrt(squares).astype(np.float32).reshape(-1, BUCKETS)


def _above(a: _Block, b: _Block, threshold: float, n_terms: int) -> Iterator[pd.DataFrame]:
    """Pairs of two blocks, or of one with itself, at or above the threshold."""
    for start in range(0, len(a.id), ROWS_AT_ONCE):
        stop = min(start + ROWS_AT_ONCE, len(a.id))
        x, y = np.nonzero(a.folded[start:stop] @ b.folded.T >= threshold - SLACK)
        if a is b:
            x, y = x[y > x + start], y[y > x + start]
        part = slice(a.first[start], a.first[stop - 1] + a.size[stop - 1])
        dense = np.zeros((stop - start, n_terms))
        dense[a.row[part] - start, a.term[part]] = a.w[part]
        for at in range(0, len(x), 50_000):
            i, j = x[at : at + 50_000], y[at : at + 50_000]
            pair = np.repeat(np.arange(len(j)), b.size[j])
            entry = np.arange(len(pair)) - np.repeat(np.cumsum(b.size[j]) - b.size[j], b.size[j]) + b.first[j][pair]
            similarity = np.bincount(pair, b.w[entry] * dense[i[pair], b.term[entry]], len(j))
            kept = similarity >= threshold
            p, q = a.id[start + i[kept]], b.id[j[kept]]
            yield pd.DataFrame({"a": np.minimum(p, q), "b": np.maximum(p, q), "similarity": similarity[kept]})


def tfidf_above(docs: DataFrame, key: str, text: str, threshold: float, max_terms: int = 5000, ngrams: int = 2) -> DataFrame:
    """``a, b, similarity`` of the texts whose TF-IDF cosine is at least ``threshold`` (above 0), ``a < b``.

    Every key is a document, also one without words, which is similar to none.
    Weights as in ``joins.tfidf_pairs``. Of the texts of a class the smallest key
    stands in the pairs; the others get one row each with it, of similarity 1, and
    share its pairs. Keys are numbers.
    """
    stage = runtime.Stage(tokens(docs, key, text), "words")
    words = stage.df
    terms = vocabulary(words, max_terms, ngrams)
    kind = words.schema["id"].dataType.simpleString()
    vectors = runtime.cut(_vectors(words.where("words != ''"), terms, ngrams).where("length(vector) > 0").withColumn("class", F.sha2("vector", 256)), "vectors")
    classes = runtime.cut(vectors.groupBy("class").agg(F.min("id").alias("id"), F.min("vector").alias("vector"), F.count(F.lit(1)).alias("copies")), "classes")
    n, n_terms = words.count(), len(terms)
    stage.drop()
    if not terms:
        return words.sparkSession.createDataFrame([], f"a {kind}, b {kind}, similarity double")
    idf = np.log((1 + n) / (1 + _frequencies(classes, n_terms))) + 1

    blocks = max(MIN_BLOCKS, -(-classes.count() // BLOCK_CLASSES))
    mine = F.pmod(F.xxhash64("class"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    spread = classes.select("id", "vector", mine.alias("block"), other.alias("other"))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    placed = spread.select("id", "vector", (F.col("block") == lo).alias("left"), (F.col("block") == hi).alias("right"), (hi * (hi + 1) / 2 + lo).cast("int").alias("pair"))

    def compared(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(it)
        for _, rows in pd.concat(held).groupby("pair") if held else ():
            if rows["left"].any() and rows["right"].any():
                a = _Block(rows[rows["left"]], idf)
                b = a if rows["left"].equals(rows["right"]) else _Block(rows[rows["right"]], idf)
                yield from _above(a, b, threshold, n_terms)

    pairs = placed.repartitionById(blocks * (blocks + 1) // 2, F.col("pair")).mapInPandas(compared, f"a {kind}, b {kind}, similarity double")
    copies = duplicates_by(vectors, "id", F.col("class"), "copy").select(F.col("first").alias("a"), F.col("other").alias("b"), F.lit(1.0).alias("similarity"))
    return pairs.unionByName(copies)
