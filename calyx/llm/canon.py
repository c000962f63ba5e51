"""Freely typed values mapped to the entries of a reference list.

All spellings of an entry - label and aliases, each with its words in order or
with the first ones moved to the end, and with words cut short - are paths of one
trie of words: the first word of a spelling lies in a trie that all share, and each
of its ends, whole or cut, leads to one node from which the words that remain go
on, so that cut words cost no further paths. A typed value becomes a Levenshtein automaton (with transpositions) whose
states are bit masks, one per number of errors; walking the trie and the automaton
together gives every entry within the distance that the path's length allows, in
one pass and without comparing the value with each entry.

Remarks added to a value ("[v2]", "- lab 2", "(see log)") are set aside step by
step: the whole value is tried first, then the value without closing brackets,
without what follows a dash, slash, comma or semicolon, and without closing words
that hold digits or stand alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calyx import runtime

#: Entries a worker holds at once; a longer list is cut into parts, and the best entry of all parts counts.
PART_ENTRIES = 20_000
#: Different values that meet one part of a long list in one task, about.
PART_VALUES = 50_000
#: Letters that a word cut short keeps.
CUTS = (4, 5, 6)
#: Values remembered by a worker.
MEMO_SIZE = 500_000

_HAN = re.compile(r"[㐀-鿿豈-﫿]")
_WORDS = re.compile(r"[^\W_]+")
_OPENERS, _CLOSERS = "[(（【〔{", "])）】〕}"
_BREAK = re.compile(r"(?<=\s)[-–—/|#]+\s|[,;，；]|(?<=\s)[-–—/|#]+(?=\w)")
_NUMBERED = re.compile(r"\d")


def allowed_errors(path: str) -> int:
    """Errors a path of the trie may differ by."""
    return errors_for(len(path), bool(_HAN.search(path)))


def errors_for(n: int, han: bool) -> int:
    """Errors a path of ``n`` characters may differ by.

    Han characters carry more than letters, so they allow errors sooner; there a
    substitution counts twice (``ReferenceTrie``), so that two words which share
    half of their characters stay apart.
    """
    if han:
        return 2 if n <= 5 else 3
    return 0 if n <= 2 else 1 if n <= 6 else 2 if n <= 9 else 3 if n <= 16 else 4


def missing_for(n: int, han: bool) -> int:
    """Characters of a path of ``n`` that a value may lack."""
    if han:
        return 0 if n <= 2 else 1 if n <= 4 else 2
    return n


def words_of(value: str) -> list[str]:
    """The words, folded: compatibility forms, case and invisible marks are gone."""
    plain = unicodedata.normalize("NFKC", value).casefold()
    plain = "".join(c for c in plain if unicodedata.category(c) not in ("Cf", "Mn"))
    return _WORDS.findall(plain)


def compact(value: str) -> str:
    return "".join(words_of(value))


class Node:
    __slots__ = ("entries", "goes_on", "next")

    def __init__(self) -> None:
        self.next: dict[str, Node] = {}
        self.goes_on: list[Node] = []  # where the next word may begin
        self.entries: dict[int, bool] = {}


class ReferenceTrie:
    """The spellings of one field's entries, with their Levenshtein automaton.

    ``substitute``: whether exchanging a character is one error; otherwise it is two.
    ``han``: whether lengths count as those of Han characters. Spellings that are no
    plain label or alias need ``shortest`` characters.
    """

    def __init__(self, substitute: bool, han: bool = False, shortest: int = 4):
        self.root = Node()
        self.most = self.longest = 0
        self.substitute, self.han, self.shortest = substitute, han, shortest
        self._rest: dict[tuple[int, tuple[str, ...]], Node] = {}

    def _reach(self, size: int) -> None:
        self.longest = max(self.longest, size)
        self.most = max(self.most, max(errors_for(n, self.han) for n in {min(n, size) for n in (2, 6, 9, 16, size)}))

    def add(self, path: str, entry: int, plain: bool) -> None:
        node = self.root
        for c in path:
            node = node.next.setdefault(c, Node())
        node.entries[entry] = node.entries.get(entry, False) or plain
        self._reach(len(path))

    def add_words(self, words: Sequence[str], entry: int) -> None:
        """The words in order or with the first ones at the end, each whole or cut short."""
        for turn in range(len(words)):
            self._word(self.root, (*words[turn:], *words[:turn]), entry)
        self._reach(sum(map(len, words)))

    def _word(self, node: Node, words: tuple[str, ...], entry: int) -> None:
        waiting = [(node, words)]
        while waiting:
            node, words = waiting.pop()
            word, rest = words[0], words[1:]
            then = self._rest.get((entry, rest))
            if rest and then is None:
                then = self._rest[entry, rest] = Node()
                waiting.append((then, rest))
            ends = {len(word)} if _HAN.search(word) else {len(word), *(n for n in CUTS if n + 1 < len(word))}
            for at, c in enumerate(word, 1):
                node = node.next.setdefault(c, Node())
                if at not in ends:
                    continue
                if not rest:
                    node.entries.setdefault(entry, False)
                elif then not in node.goes_on:
                    node.goes_on.append(then)

    def _rank(self, depth: int, rows: list[int], goal: int, size: int) -> int | None:
        """Errors at the end of the value, if a path of this length allows them."""
        for errors in range(errors_for(depth, self.han) + 1):
            if rows[errors] & goal:
                if not self.substitute and (errors - (size - depth)) // 2 > missing_for(depth, self.han):
                    return None
                return errors
        return None

    def within(self, value: str) -> dict[int, tuple[int, int, int]]:
        """Entries whose paths lie within the allowed distance of the compact ``value``.

        The rank of an entry is (errors, not a plain spelling, minus path length).
        """
        found: dict[int, tuple[int, int, int]] = {}
        n, k = len(value), self.most
        if not n or n > self.longest + k:
            return found
        masks: dict[str, int] = {}
        for i, c in enumerate(value):
            masks[c] = masks.get(c, 0) | 1 << i
        goal, full = 1 << n, (1 << (n + 1)) - 1
        start = [(1 << (j + 1)) - 1 & full for j in range(k + 1)]
        stack = [(self.root, start, None, "", 0)]
        while stack:
            node, rows, above, last, depth = stack.pop()
            if node.entries and (errors := self._rank(depth, rows, goal, n)) is not None:
                for entry, plain in node.entries.items():
                    rank = (errors, int(not plain), -depth)
                    if (plain or depth >= self.shortest) and (entry not in found or rank < found[entry]):
                        found[entry] = rank
            for then in node.goes_on:
                stack.append((then, rows, above, last, depth))
            swapped = masks.get(last, 0)
            for c, child in node.next.items():
                mask = masks.get(c, 0)
                row = (rows[0] & mask) << 1
                new = [row]
                for j in range(1, k + 1):
                    low = rows[j - 1]
                    row = ((rows[j] & mask) << 1) | low | (row << 1)
                    if self.substitute:
                        row |= low << 1
                    if above is not None:
                        row |= (((above[j - 1] & mask) << 1) & swapped) << 1
                    row &= full
                    new.append(row)
                if row:
                    stack.append((child, new, rows, c, depth + 1))
        return found


def _letters(text: str, limit: int) -> int:
    """Letters and digits of a text, counted up to one more than the limit."""
    n = 0
    for c in text:
        if c.isalnum():
            n += 1
            if n > limit:
                break
    return n


def _without_closing(text: str) -> str:
    """The text without a bracketed part at its end; unchanged if there is none."""
    end = len(text)
    while end and not text[end - 1].isalnum() and text[end - 1] not in _CLOSERS:
        end -= 1
    if not end or text[end - 1] not in _CLOSERS:
        return text
    start = max(text.rfind(c, 0, end - 1) for c in _OPENERS)
    if start < 0 or any(text.find(c, start + 1, end - 1) >= 0 for c in _CLOSERS):
        return text
    return text[:start].rstrip()


def readings(value: str, limit: int = 1_000) -> Iterator[str]:
    """Compact forms of ``value``: whole, then with remarks set aside step by step.

    Forms of more than ``limit`` letters are longer than every path and not made, so
    a very long value costs time in proportion to its length.
    """
    seen = set()

    def fresh(form: str) -> Iterator[str]:
        if _letters(form, limit) <= limit and (done := compact(form)) and done not in seen:
            seen.add(done)
            yield done

    plain = unicodedata.normalize("NFKC", value).strip()
    yield from fresh(plain)
    rest = plain
    while (shorter := _without_closing(rest)) != rest and shorter:
        rest = shorter
        yield from fresh(rest)
    for base in dict.fromkeys((plain, rest)):
        cuts, letters, at = [], 0, 0
        for m in _BREAK.finditer(base):
            letters += _letters(base[at : m.start()], limit)
            at = m.start()
            if letters > limit:
                break
            if at:
                cuts.append(at)
        for at in reversed(cuts):
            yield from fresh(base[:at])
    words = re.split(r"[\s_]+", rest)
    while len(words) > 1 and (_NUMBERED.search(words[-1]) or not compact(words[-1])):
        words.pop()
        if len(words) <= limit:
            yield from fresh(" ".join(words))


class Mapper:
    """Values of a field to ids of its entries; 0 where none fits."""

    def __init__(self, entries: Sequence[tuple[int, str, str, Sequence[str]]]):
        fields: dict[str, list] = {}
        for entry, field, label, aliases in entries:
            fields.setdefault(field, []).append((entry, label, aliases))
        self.tries = {f: self._build(e) for f, e in fields.items()}
        self._memo: dict[tuple[str, str], int] = {}

    @staticmethod
    def _build(entries: list) -> tuple[ReferenceTrie, ...]:
        """By kind of path: short letters, letters, Han."""
        short, letters, han = ReferenceTrie(False, shortest=0), ReferenceTrie(True), ReferenceTrie(False, han=True)
        for entry, label, aliases in entries:
            for value in (label, *(aliases or ())):
                words = [w for w in map(compact, re.split(r"[\s_]+", value or "")) if w]
                path = "".join(words)
                if not path:
                    continue
                kind = han if _HAN.search(path) else short if len(path) <= 3 else letters
                kind.add(path, entry, True)
                if kind is not short:
                    kind.add_words(words, entry)
                elif len(words) == 1 and len(path) == 2:  # too short for errors: a letter typed twice is all
                    short.add(path[0] + path, entry, False)
                    short.add(path + path[1], entry, False)
        return short, letters, han

    def candidates(self, field: str, value: str) -> dict[int, tuple[int, int, int, int]]:
        """All entries within reach, ranked by errors, then by how little was set aside.

        Setting something aside counts as two errors, so that a slip in the whole
        value is preferred to dropping one of its words.
        """
        found: dict[int, tuple[int, int, int, int]] = {}
        longest = max((t.longest + t.most for t in self.tries.get(field, ())), default=0)
        for aside, reading in enumerate(readings(value, longest)):
            for trie in self.tries.get(field, ()):
                for entry, (errors, cut, depth) in trie.within(reading).items():
                    rank = (errors + (2 if aside else 0), aside, cut, depth)
                    if entry not in found or rank < found[entry]:
                        found[entry] = rank
            if found and min(found.values())[0] <= (2 if aside else 0):
                break
        return found

    def best(self, field: str, value: str) -> tuple[tuple[int, int, int, int], int] | None:
        """Rank and id of the best entry, 0 if a value that is not exact fits two equally well; None if none fits."""
        found = self.candidates(field, value)
        if not found:
            return None
        best = sorted((rank, e) for e, rank in found.items())
        tied = len(best) > 1 and best[0][0] == best[1][0] and best[0][0][0] > 0  # exact twice: the smaller id
        return best[0][0], 0 if tied else best[0][1]

    def entry(self, field: str, value: str) -> int:
        """The best entry; 0 if none, or if a value that is not exact fits two equally well."""
        key = (field, value)
        known = self._memo.get(key)
        if known is None:
            best = self.best(field, value)
            known = best[1] if best else 0
            if len(self._memo) >= MEMO_SIZE:
                self._memo.clear()
            self._memo[key] = known
        return known


_MAPPERS: dict[tuple, Mapper] = {}


def _mapper(entries: tuple) -> Mapper:
    if entries not in _MAPPERS:
        _MAPPERS.clear()
        _MAPPERS[entries] = Mapper(entries)
    return _MAPPERS[entries]


def reference_rows(reference: DataFrame, entry: str, field: str, label: str, aliases: str) -> DataFrame:
    """``entry, field, label, aliases`` of the reference list; rows with a null id or field are left out."""
    rows = reference.where(F.col(entry).isNotNull() & F.col(field).isNotNull())
    some = F.array_sort(F.filter(F.coalesce(F.col(aliases), F.array().cast("array<string>")), lambda a: F.coalesce(a, F.lit("")) != ""))
    return rows.select(
        F.col(entry).cast("int").alias("entry"), F.col(field).alias("field"), F.coalesce(F.col(label), F.lit("")).alias("label"), some.alias("aliases")
    ).distinct()


def _entries(rows) -> tuple:
    return tuple(sorted((int(r[0]), r[1], r[2], tuple(r[3])) for r in rows))


def typed_values(rows: DataFrame, reference: DataFrame, field: str, row_id: str, value: str) -> DataFrame:
    """``field, row_id, value`` of the rows whose value is neither null, nor blank, nor a label of the field."""
    typed = rows.where(F.col(value).isNotNull() & F.col(value).rlike(r"(?U)\S"))
    source = typed.select(F.col(field).alias("field"), F.col(row_id).alias("row_id"), F.col(value).alias("value"))
    labels = reference.select("field", F.col("label").alias("value")).distinct()
    return source.join(runtime.small(labels), ["field", "value"], "left_anti").select("field", "row_id", "value")


def map_values(rows: DataFrame, field: str, row_id: str, value: str, reference: DataFrame, most: int = PART_ENTRIES) -> DataFrame:
    """``field, row_id, value, canon_id`` for every row with a value to map.

    ``reference``: of ``reference_rows``. Null and blank values, and values equal to
    a label of the field, are left out. A repeated value is resolved once per worker
    and remembered, so a value that fills a third of the rows costs one lookup and
    is never shuffled. Repeated rows stay repeated. A list of more than ``most``
    entries is cut into parts (``_by_parts``), with the same result.
    """
    source = typed_values(rows, reference, field, row_id, value)
    held = reference.limit(most + 1).collect()  # bounded: at most what a worker holds
    if len(held) > most:
        return _by_parts(source, reference, most)
    entries = _entries(held)
    schema = T.StructType([*source.schema.fields, T.StructField("canon_id", T.IntegerType())])

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mapper = _mapper(entries)
        for batch in batches:
            ids = [mapper.entry(f, v) for f, v in zip(batch["field"], batch["value"])]
            yield batch.assign(canon_id=pd.Series(ids, index=batch.index, dtype="int32"))

    return source.mapInPandas(resolve, schema)


def _by_parts(source: DataFrame, reference: DataFrame, most: int) -> DataFrame:
    """Each different value against each part of the list; the best of the parts' best entries counts.

    A value that many rows hold gets its entry by broadcast; all others by a join.
    """
    parts = -(-reference.count() // most)
    counted = runtime.Stage(source.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")), "typed-values").df
    total, salts = counted.agg(F.sum("n"), F.count(F.lit(1))).first()
    salts = max(1, -(-salts // PART_VALUES))
    left = counted.select("field", "value", F.pmod(F.xxhash64("field", "value"), F.lit(salts)).alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    right = reference.withColumn("part", F.pmod(F.xxhash64("entry", "label"), F.lit(parts)).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))

    def resolve(values: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        mapper = Mapper(_entries(entries[["entry", "field", "label", "aliases"]].itertuples(index=False, name=None)))
        found = [(f, v, *best) for f, v in zip(values["field"], values["value"]) if (best := mapper.best(f, v))]
        return pd.DataFrame([(f, v, *rank, entry) for f, v, rank, entry in found], columns=["field", "value", "r0", "r1", "r2", "r3", "entry"])

    schema = "field string, value string, r0 int, r1 int, r2 int, r3 int, entry int"
    best = left.groupBy("part", "salt").cogroup(right.groupBy("part", "salt")).applyInPandas(resolve, schema).withColumn("rank", F.array("r0", "r1", "r2", "r3"))
    first = best.groupBy("field", "value").agg(F.array_sort(F.collect_list(F.struct("rank", "entry"))).alias("all"))  # one per part
    top = F.filter("all", lambda x: x["rank"] == F.col("all")[0]["rank"])
    tied = (F.col("all")[0]["rank"][0] > 0) & (F.size(F.array_distinct(F.transform(top, lambda x: x["entry"]))) > 1)
    decided = first.select("field", "value", F.when(tied, 0).otherwise(F.col("all")[0]["entry"]).alias("canon_id"))
    mapped = runtime.Stage(counted.join(decided, ["field", "value"], "left").select("field", "value", "n", F.coalesce("canon_id", F.lit(0)).alias("canon_id")), "mapped-values").df
    hot_rows = runtime.hot_threshold(int(total or 0))
    hot = F.broadcast(mapped.where(F.col("n") > hot_rows).drop("n"))  # at most total / hot_rows values
    cool = source.join(hot, ["field", "value"], "left_anti").join(mapped.where(F.col("n") <= hot_rows).drop("n"), ["field", "value"])
    return source.join(hot, ["field", "value"]).unionByName(cool).select("field", "row_id", "value", "canon_id")


def entries_within(rows: DataFrame, field: str, value: str, reference: DataFrame) -> DataFrame:
    """``field, value, canon_id, errors, aside`` of all entries within reach of each different value.

    ``errors`` are those of the entry's closest path, two more if a part of the value
    was set aside as a remark; ``aside`` is how many readings were tried before.
    """
    source = typed_values(rows, reference, field, value, value).select("field", "value").distinct()
    parts = max(1, -(-reference.count() // PART_ENTRIES))
    placed = reference.withColumn("part", F.pmod(F.xxhash64("entry", "label"), F.lit(parts)).cast("int"))
    salts = max(1, -(-source.count() // PART_VALUES))
    left = source.withColumn("salt", F.pmod(F.xxhash64("field", "value"), F.lit(salts))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = placed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))

    def all_within(values: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        mapper = Mapper(_entries(entries[["entry", "field", "label", "aliases"]].itertuples(index=False, name=None)))
        found = [(f, v, e, r[0], r[1]) for f, v in zip(values["field"], values["value"]) for e, r in mapper.candidates(f, v).items()]
        return pd.DataFrame(found, columns=["field", "value", "canon_id", "errors", "aside"])

    return left.groupBy("part", "salt").cogroup(right.groupBy("part", "salt")).applyInPandas(all_within, "field string, value string, canon_id int, errors int, aside int")
