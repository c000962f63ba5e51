"""Operators whose result depends on order so that no window expresses them.

They run as grouped pandas functions over one document, page or component at a
time, or over the rows in the order of such groups; a group is bounded by what one
document or component holds, and each takes an explicit order column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from calyx.functions import rules, titles

#: Cells of tables that a worker looks through at once, about.
BATCH_CELLS = 100_000


def graded_rows(rows: DataFrame, doc: str, order: str, cells: str) -> DataFrame:
    """The Total and the grades 1 to 3 of every term of a graded table, by windows.

    The term in force is the last row with data that names a term. A grade-1 row
    opens a block unless the nearest label before it is a class of organs. From
    there the first grade-2 row before the next term with data belongs to the block,
    and after it the first grade-3 row; a further grade-1 row begins the block anew.
    Of a term that repeats the later block wins, field by field. Gives ``doc, term, level, ord`` and the row's group values.
    """
    first = rules.first_filled(F.col(cells))
    base = rows.select(doc, order, cells, first.alias("_first")).withColumn("_kind", rules.row_kind(F.col("_first")))
    has_data = F.exists(rules.group_values(F.col(cells)), lambda g: g["events"].isNotNull())  # looked for in terms only
    w = W.partitionBy(doc).orderBy(order)
    upto, before = w.rowsBetween(W.unboundedPreceding, W.currentRow), w.rowsBetween(W.unboundedPreceding, -1)
    starts = (F.col("_kind") == "term") & has_data
    label = F.when(F.col("_kind").isin("term", "class", "total", "number"), F.col("_kind"))
    marked = base.withColumn("_starts", starts).withColumn("_term", F.last(F.when(starts, F.col("_first")), True).over(upto))
    marked = marked.withColumn("_above", F.last(label, True).over(before)).withColumn("_block", F.sum(F.when(starts, 1).otherwise(0)).over(upto))
    opens = (F.col("_first") == "1级") & F.col("_term").isNotNull() & ~F.col("_above").eqNullSafe(F.lit("class"))
    in_block = W.partitionBy(doc, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = marked.withColumn("_open", F.max(F.when(opens, F.col(order))).over(in_block))
    second = F.min(F.when((F.col("_first") == "2级") & F.col("_open").isNotNull(), F.col(order))).over(W.partitionBy(doc, "_block", "_open"))
    marked = marked.withColumn("_second", second)
    third_from = F.coalesce("_second", "_open")
    third = F.min(F.when((F.col("_first") == "3级") & F.col("_second").isNotNull() & (F.col(order) > third_from), F.col(order))).over(W.partitionBy(doc, "_block", "_open"))
    marked = marked.withColumn("_third", third)
    level = (
        F.when(F.col("_starts"), "Total").when(F.col("_open") == F.col(order), "1级").when(F.col("_second") == F.col(order), "2级").when(F.col("_third") == F.col(order), "3级")
    )
    taken = marked.withColumn("level", level).where("level is not null").select(F.col(doc).alias("doc"), F.col("_term").alias("term"), "level", F.col(order).alias("ord"), F.col(cells).alias("_cells"))
    last = taken.groupBy("doc", "term", "level").agg(F.max_by(F.struct("ord", "_cells"), F.col("ord")).alias("_r"))
    return last.select("doc", "term", "level", "_r.ord", rules.group_values(F.col("_r._cells")).alias("groups"))


def _merge(boxes: list[tuple], pad: float, most: int | None) -> list[tuple]:
    meets = lambda a, b: a[2] >= b[0] and a[0] <= b[2] and a[3] >= b[1] and a[1] <= b[3]
    join = lambda a, b: (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
    waiting = sorted(((x0 - pad, t - pad, x1 + pad, b + pad) for x0, t, x1, b in boxes), key=lambda r: (r[1], r[0]))
    grown: list[tuple] = []
    for box in waiting:
        while (hit := next((g for g in grown if meets(box, g)), None)) is not None:
            grown.remove(hit)
            box = join(box, hit)
        grown.append(box)
        if most is not None and len(grown) >= most:
            break
    out: list[tuple] = []
    for box in grown:
        at = next((i for i, g in enumerate(out) if meets(box, g)), None)
        if at is None:
            out.append(box)
        else:
            out[at] = join(box, out[at])
    return out


def merged_boxes(boxes: DataFrame, place: Sequence[str], pad: float = 2.0, most: int | None = None) -> DataFrame:
    """Padded boxes of a page grown together while they meet.

    With ``most`` the rest of a page is dropped once so many are separate; the reference's default is 200.
    """
    keys = list(place)
    schema = ", ".join([f"{k} {boxes.schema[k].dataType.simpleString()}" for k in keys] + ["x0 double", "top double", "x1 double", "bottom double"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _merge(list(pdf[["x0", "top", "x1", "bottom"]].itertuples(index=False, name=None)), pad, most)
        out = pd.DataFrame(rows, columns=["x0", "top", "x1", "bottom"])
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return boxes.groupBy(*keys).applyInPandas(merge, schema)


def kept_greedily(items: DataFrame, pairs: DataFrame, component: str, threshold: float) -> DataFrame:
    """Greedy removal of near-duplicates inside each component, in the order of ``ord``.

    ``items(component, id, ord, score)``, ``pairs(component, a, b, similarity)``.
    Of a close pair the one with the lower score goes (the later one if equal); a
    removed item removes nothing. Gives ``id, kept``. Items of different components
    never meet, so each component is one group.
    """
    def remove(_key, own: pd.DataFrame, close: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("ord")
        score, place = dict(zip(own["id"], own["score"])), {i: n for n, i in enumerate(own["id"])}
        near: dict = {}
        for a, b, s in zip(close["a"], close["b"], close["similarity"]):
            if s >= threshold and a in place and b in place and a != b:
                x, y = sorted((a, b), key=place.get)
                near.setdefault(x, set()).add(y)
        gone: set = set()
        for i in own["id"]:
            if i in gone:
                continue
            for j in sorted(near.get(i, ()), key=place.get):
                if j in gone:
                    continue
                if score[i] >= score[j]:
                    gone.add(j)
                else:
                    gone.add(i)
                    break
        return pd.DataFrame({"id": own["id"], "kept": [i not in gone for i in own["id"]]})

    pairs = pairs.select(*[F.col(c).alias(c) for c in pairs.columns])  # new attributes: both sides may share a lineage
    left = items.groupBy(component)
    return left.cogroup(pairs.groupBy(component)).applyInPandas(remove, f"id {items.schema['id'].dataType.simpleString()}, kept boolean")


def aligned_columns(cells: DataFrame, table_key: str, labels: Sequence[str], headers: Sequence[str], match: Callable[[str, str], bool] | None = None) -> DataFrame:
    """Where a table holds the labels in order in one column, and which column holds their values.

    ``cells(table_key, row, col, value)``. The first column, and in it the first
    start row, whose later rows match all labels in strictly increasing order is
    taken; the value column has most of the headers, then most numbers, then comes
    first. Gives ``table_key, cat_col, val_col, rows``; tables without a fit give none.
    """
    labels, headers = list(labels), list(headers)
    kind = cells.schema[table_key].dataType.simpleString()
    placed = cells.select(F.col(table_key), F.col("row").cast("long"), F.col("col").cast("long"), F.col("value")).repartition(table_key).sortWithinPartitions(table_key)
    return placed.mapInArrow(_align_all(table_key, labels, headers, match or _labels_match), f"{table_key} {kind}, cat_col int, val_col int, rows array<int>")


def _align_all(table_key: str, labels: list[str], headers: list[str], match: Callable[[str, str], bool]):
    """Tables one after another, from rows in the order of their keys: many in one batch, none of them a call of its own."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match_once, number_once = lru_cache(100_000)(match), lru_cache(100_000)(_is_number)
        anywhere = any(match_once("", label) for label in labels)  # labels that an absent cell would match

        def fits(part: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
            codes = part["value"].combine_chunks().dictionary_encode(null_encoding="encode")
            words = [(v or "").strip() for v in codes.dictionary.to_pylist()]
            value, row, col = codes.indices.to_numpy(zero_copy_only=False), part["row"].to_numpy(), part["col"].to_numpy()
            ends = np.append(starts[1:], len(value))
            some = np.ones(len(starts), dtype=bool)
            if not anywhere:
                table = np.repeat(np.arange(len(starts)), ends - starts)
                for label in labels:  # a table without a cell for each label is passed over
                    held = np.array([match_once(w, label) for w in words], dtype=bool)
                    some &= np.bincount(table[held[value]], minlength=len(starts)) > 0
            found: tuple[list, list, list, list] = [], [], [], []
            for at in np.flatnonzero(some):
                here = slice(starts[at], ends[at])
                places = zip(row[here].tolist(), col[here].tolist(), value[here].tolist())
                hit = _aligned({(r, c): words[v] for r, c, v in places}, labels, headers, match_once, number_once)
                if hit:
                    for out, x in zip(found, (starts[at], *hit)):
                        out.append(x)
            keys = part[table_key].combine_chunks().take(pa.array(found[0], pa.int64()))
            rest = [pa.array(x, t) for x, t in zip(found[1:], (pa.int32(), pa.int32(), pa.list_(pa.int32())))]
            return pa.RecordBatch.from_arrays([keys, *rest], names=[table_key, "cat_col", "val_col", "rows"])

        held: list[pa.RecordBatch] = []
        most = count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count <= max(most, BATCH_CELLS):
                continue
            part = pa.Table.from_batches(held)
            starts = _starts(part[table_key])
            if len(starts) > 1:  # the last table may go on
                yield fits(part.slice(0, starts[-1]), starts[:-1])
                held = part.slice(starts[-1]).combine_chunks().to_batches()
            count = part.num_rows - starts[-1]
            most = 2 * count  # a table of many batches is looked through a few times only
        if count:
            part = pa.Table.from_batches(held)
            yield fits(part, _starts(part[table_key]))

    return align


def _starts(keys: pa.ChunkedArray) -> np.ndarray:
    """Where each run of equal keys begins; nulls are equal."""
    code = keys.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.r_[True, code[1:] != code[:-1]])


def _aligned(grid: dict[tuple[int, int], str], labels: list[str], headers: list[str], match: Callable[[str, str], bool], is_number: Callable[[str], bool]) -> tuple[int, int, list[int]] | None:
    n_rows, n_cols = max(r for r, _ in grid) + 1, max(c for _, c in grid) + 1
    for col in range(n_cols):
        for start in range(n_rows):
            rows, at = [], start
            for label in labels:
                while at < n_rows and not match(grid.get((at, col), ""), label):
                    if not rows:
                        at = n_rows
                        break
                    at += 1
                if at >= n_rows:
                    break
                rows.append(at)
                at += 1
            if len(rows) < len(labels):
                if rows:  # a later start would find its labels no earlier
                    break
                continue
            best = None
            for other in range(n_cols):
                numbers = sum(is_number(grid.get((r, other), "")) for r in rows)
                if not numbers:
                    continue
                texts = {grid.get((r, other), "") for r in range(n_rows)}
                score = (sum(h in texts for h in headers), numbers)
                if best is None or score > best[0]:
                    best = (score, other)
            if best:
                return col, best[1], rows
    return None


def _is_number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def _labels_match(cell: str, target: str) -> bool:
    a, b = " ".join(cell.lower().split()), " ".join(target.lower().split())
    return bool(a) and bool(b) and (a == b or a in b or b in a)


def plain_title(lines: DataFrame, doc: str, order: str, line: str, limit: int = 520) -> DataFrame:
    """The title of a first page as text: leading noise is passed over, then lines are joined until a blank, an author
    line, an address, a numbered line, or the limit. Titles under 20 characters are none."""
    w = W.partitionBy(doc).orderBy(order)
    upto, before = w.rowsBetween(W.unboundedPreceding, W.currentRow), w.rowsBetween(W.unboundedPreceding, -1)
    body = lines.withColumn("_line", titles.stripped(line)).withColumn("_kind", titles.line_kind(F.col("_line")))
    marked = body.withColumn("_good", F.col("_kind").isNull()).withColumn("_seen", F.max(F.col("_good").cast("int")).over(upto))
    marked = marked.withColumn("_begun", F.coalesce(F.max(F.col("_good").cast("int")).over(before), F.lit(0)) == 1)
    names = (F.length("_line") < 220) & F.col("_line").rlike(r"^[^,]*,[^,]*,") & F.col("_line").rlike(r",\s*[A-Z][a-z]")
    ends = F.coalesce(F.col("_kind").isin("blank", "authors"), F.lit(False)) | names | F.col("_line").rlike(r"(?i)@|https?://|^doi[: ]|^citation:")
    skipped = F.col("_kind").isNotNull() & ~F.coalesce(F.col("_kind").isin("blank", "authors"), F.lit(False))
    stop = (F.col("_seen") == 1) & ~skipped & (ends | (F.col("_begun") & F.col("_line").rlike(r"^\d+\s+")))
    marked = marked.withColumn("_stop", F.max(stop.cast("int")).over(upto)).where("_seen = 1 and _stop = 0 and _good")
    marked = marked.withColumn("_line", titles.stripped(F.regexp_replace("_line", r"(?i)^Q\d+\b\s*", ""))).where("_line <> ''")
    marked = marked.withColumn("_size", F.sum(F.length("_line") + 1).over(upto)).where(F.coalesce(F.col("_size") - F.length("_line") - 1, F.lit(0)) <= limit)
    joined = marked.groupBy(doc).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "_line"))), lambda s: s["_line"]), " ").alias("title"))
    return joined.withColumn("title", F.regexp_replace("title", r"(?U)\s+", " ")).where(F.length("title") >= 20)


def hierarchy_title(lines: DataFrame, doc: str, order: str, line: str, size: str) -> DataFrame:
    """Lines of one type size make a candidate; of those of eight characters that may be a title the largest size wins."""
    own = lines.where(titles.stripped(line) != "")
    grouped = own.groupBy(doc, F.round(size, 1).alias("_size")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, line))), lambda s: titles.stripped(s[line])), " ").alias("_raw"))
    usable = lambda t: (F.length(t) >= 8) & ~titles.is_no_title(F.col(t))
    fine = grouped.where(usable("_raw") & ~titles.is_frame(F.col("_raw"))).withColumn("title", titles.without_noise(F.col("_raw"))).where(usable("title"))
    return fine.groupBy(doc).agg(F.max_by("title", "_size").alias("title"))


def block_title(blocks: DataFrame, doc: str, order: str, text: str, top: str, height: str) -> DataFrame:
    """The first block in the upper 55 % of a page, of 12 to 400 characters, that may be a title."""
    t = titles.stripped(F.regexp_replace(text, r"(?U)\s+", " "))
    near = blocks.where(F.col(top) <= F.col(height) * 0.55).withColumn("_raw", t).where(F.length("_raw").between(12, 400))
    fine = near.where(~titles.is_no_title(F.col("_raw")) & ~titles.is_frame(F.col("_raw"))).withColumn("title", titles.without_noise(F.col("_raw")))
    fine = fine.where((F.length("title") >= 12) & ~titles.is_no_title(F.col("title")))
    return fine.groupBy(doc).agg(F.min_by("title", order).alias("title"))
