"""Exact similarity self-join of texts as sets of character runs.

Universe-partition pigeonhole. The universe of runs is hashed into segments, as
many as the size band needs. Two sets of Jaccard similarity d or more and sizes
a <= b differ in at most H = (1-d)/(1+d) (a+b) runs. If segments with allowances
v (0: equal content, 1: one run more or less) add up to sum(v+1) > H, at least one
of them is met. Equal content is found by the hash of a segment's content, one run
more or less by the hashes of its one-deletion neighbourhood.

The allocation is by cost. A sketch of fixed size counts all signatures of all
texts; the cost of a signature is its count, with its hash to break ties, so it is
the same for every text. Each text takes the lowest cost threshold at which its own
segments add up to more than H: a segment counts 1 once its content hash lies below
the threshold, and 2 once its whole neighbourhood does. It emits all its signatures
below its threshold. Of a similar pair, the text with the lower threshold has a
segment that is met; its signature costs no more than either threshold, so both
emit it. Empty segments and popular contents, being dear, are passed over first.

A band holds the pairs whose smaller set has between ``lo`` and ``hi`` runs. A text
takes part in the band of its own size and in lower ones that its smaller partners
may belong to, so every pair meets in the band of its smaller set.

Signatures are gathered by hash. Within a group the partners of fitting size are
enumerated in blocks and compared by odd sketches (one parity bit per hash bucket
of runs): bits that differ never exceed runs that differ, so a pair is dropped only
if it cannot be similar. What is left is made distinct and verified on the texts.

A text whose segments cannot add up to H (its runs fall into too few of them) is
compared through single runs instead (``_lone_pairs``); such texts are rare.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from calyx import runtime
from calyx.llm import components

RUN = 5
MIN_CHARS = 40
THRESHOLD = 0.7
#: Counters of the cost sketch for each text, up to 2^24 counters, and the blocks they are sent in.
SKETCH_PER_TEXT, SKETCH_MOST_BITS, SKETCH_BLOCKS = 8, 24, 32
#: Signatures one task gathers, about.
GROUP_SIGNATURES = 12_000_000
#: What a pass over a band may shuffle: this share of what the texts take on disk, or these bytes if they are more.
PASS_SHARE, PASS_LEAST = 1.5, 256 << 20
#: A signature with more holders than this is split over several groups, by pairs of blocks of holders.
HOT_PARTNERS = 20_000
#: Signatures whose partners are looked up at once.
JOB_SIGNATURES = 1_000_000
#: Pairs found that a worker holds before it hands them on.
FOUND_PAIRS = 2_000_000
#: Shuffle files go when their job ends, and workers get few large rows at a time.
FRUGAL = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
#: Case by Java's own tables, which are much faster on texts that are not ASCII.
PLAIN_CASE = {"spark.sql.icu.caseMappings.enabled": "false"}
#: Keys of one text that meet in one task.
MEMBER_BLOCK = 2_000
#: Pairs compared at once within a task: few enough for the processor's cache.
BLOCK_PAIRS = 12_000
#: Characters of texts a worker handles at once; a longer text is handled by itself.
BATCH_CHARS = 400_000
#: Upper edges of the size bands: they double, and from 512 on grow by the root of two, as the runs of
#: a segment, of which there is one for four runs of the edge, would else be too few at the lower end.
EDGES = [32 << k for k in range(5)] + [int(512 * 2 ** (k / 2)) for k in range(1, 48)]
_U = np.uint64


def normalised(text: Column) -> Column:
    """Lower case, letters and numbers of any script only."""
    return F.regexp_replace(F.lower(text), r"[^a-z0-9\p{L}\p{N}]+", "")  # the commonest first: they need no look at Unicode's tables


def _segments(hi: int) -> int:
    """Segments of a band: smaller sets hold rarer runs, so theirs are smaller."""
    return max(4, hi // (1 if hi <= 128 else 2 if hi <= 256 else 4))


def _words(hi: int) -> int:
    """64-bit words of a band's odd sketch: about two bits per run, so that it does not fill up; whole multiples of 16 for long texts."""
    return max(2, hi // 32) if hi < 512 else 16 * (hi // 512)


def _in_band(size, hi: int, threshold: float):
    """Whether a set of this size has a similar partner, or is one, whose smaller set is of band ``hi``."""
    at = EDGES.index(hi)
    return (size >= (EDGES[at - 1] if at else 0)) & (size * threshold < hi + 1e-9)


def _mix(x: np.ndarray) -> np.ndarray:
    y = x >> _U(31)
    y ^= x
    y *= _U(0x7FB5D329728EA185)
    y ^= y >> _U(27)
    y *= _U(0x81DADEF4BC2DD44D)
    y ^= y >> _U(33)
    return y


def run_sets(texts: list[str], run: int = RUN, among: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of up to 65,536 texts: 48-bit hashes, ordered by text and hash,
    the number of the text of each, and the size of each text's set.

    ``among``: only runs whose hash lies from the first number up to below the second.
    """
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    count = max(0, len(codes) - run + 1)
    h = np.zeros(count, dtype=np.uint64)
    for k in range(run):
        h *= _U(0x100000001B3)
        h += codes[k : k + count]
        h += _U(1)
    h = _mix(h)
    h >>= _U(16)
    h |= np.repeat(np.arange(len(texts), dtype=np.uint64) << _U(48), lengths)[:count]
    inside = np.ones(len(codes), dtype=bool)  # a run that would reach into the next text is none
    ends = np.cumsum(lengths)
    for k in range(1, run):
        inside[np.maximum(ends - k, 0)[ends > 0]] = False
    inside = inside[:count]
    if among:
        own = h & _U((1 << 48) - 1)
        inside &= (own >= _U(among[0])) & (own < _U(among[1]))
    key = np.sort(h[inside])
    if len(key):
        key = key[np.r_[True, key[1:] != key[:-1]]]
    docs = (key >> _U(48)).astype(np.int64)
    return key & _U((1 << 48) - 1), docs, np.bincount(docs, minlength=len(texts))


class _Band:
    """The signatures of the texts of a batch that take part in one band.

    ``full``: one per segment that holds runs; ``less``: one per run of the segments
    that hold several, each the content without that run.
    """

    def __init__(self, runs: np.ndarray, docs: np.ndarray, member: np.ndarray, hi: int, neighbours: bool):
        chosen = member[docs]
        self.runs, self.doc = runs[chosen], docs[chosen]
        m = _segments(hi)
        segment = ((self.runs >> _U(16)) * _U(m)) >> _U(32)  # order of hashes is order of segments
        start = np.empty(len(segment), dtype=bool)
        start[:1] = True
        start[1:] = (segment[1:] != segment[:-1]) | (self.doc[1:] != self.doc[:-1])
        self.first = np.flatnonzero(start)
        self.count = np.diff(np.r_[self.first, len(segment)])
        value = self.runs * _U(0x9E6C63D0676A9A99)  # a run's hash is mixed already; sums of such words are, too
        value ^= value >> _U(29)
        whole = np.add.reduceat(value, self.first) if len(segment) else value
        whole += (segment[self.first] + _U(1)) * _U(0x9E3779B97F4A7C15) + _U(hi)
        self.full = whole
        self.full_doc = self.doc[self.first]
        self.segment = segment[self.first]
        self.several = self.count > 1
        if neighbours:
            many = np.repeat(self.several, self.count)
            sizes = self.count[self.several]
            self.less = np.repeat(whole[self.several], sizes) - value[many]
            self.less_doc = self.doc[many]
            self.less_first = np.cumsum(sizes) - sizes


def _need(sizes: np.ndarray, hi: int, threshold: float) -> np.ndarray:
    """One more than the runs by which a text and a similar partner in the band differ."""
    partner = np.where(sizes < hi, np.floor(sizes / threshold + 1e-9), hi - 1)
    return np.floor((1 - threshold) / (1 + threshold) * (sizes + partner) + 1e-9).astype(np.int64) + 1


def _parts(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """``pdf`` in parts of bounded size."""
    start = total = 0
    for i, n in enumerate(pdf["text"].str.len()):
        total += n
        if total > BATCH_CHARS or i - start >= 20_000:
            yield pdf.iloc[start : i + 1]
            start, total = i + 1, 0
    if start < len(pdf):
        yield pdf.iloc[start:]


COUNTED = "kind string, number long, size int, task int, place int, data binary, text string"


def _row(kind: str, number: int, data: bytes) -> pd.DataFrame:
    return pd.DataFrame({"kind": [kind], "number": [number], "size": [0], "task": [0], "place": [0], "data": [data], "text": [None]})


def _places(sizes: np.ndarray, before: dict[int, int]) -> np.ndarray:
    """The number of each among those of its size, counted on from ``before``."""
    order = np.argsort(sizes, kind="stable")
    values, first, counts = np.unique(sizes[order], return_index=True, return_counts=True)
    start = np.array([before.get(v, 0) for v in values.tolist()], dtype=np.int64)
    place = np.empty(len(sizes), dtype=np.int64)
    place[order] = np.arange(len(sizes)) + np.repeat(start - first, counts)
    before.update(zip(values.tolist(), (start + counts).tolist()))
    return place


def _count_signatures(threshold: float, bits: int):
    """Every text with the size of its set and its place among those of its task of
    this size, the number of texts of each size, and the cost sketch: how many
    segments have a content of each hash, whoever holds them."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(1 << bits, dtype=np.uint32)
        made: dict[int, int] = {}
        of_size: dict[int, int] = {}
        task = TaskContext.get().partitionId()
        shift = _U(64 - bits)
        for pdf in batches:
            for part in _parts(pdf):
                runs, docs, sizes = run_sets(list(part["text"]))
                lone = np.zeros(len(part), dtype=bool)
                for hi in EDGES:
                    member = _in_band(sizes, hi, threshold)
                    if member.any():
                        band = _Band(runs, docs, member, hi, False)
                        np.add.at(table, (band.full >> shift).view(np.int64), np.uint32(1))
                        made[hi] = made.get(hi, 0) + len(band.full) + int(band.count[band.several].sum())
                        weight = np.bincount(band.full_doc, minlength=len(sizes)) + np.bincount(band.full_doc[band.several], minlength=len(sizes))
                        lone |= member & (weight < _need(sizes, hi, threshold))
                    elif hi > sizes.max(initial=0):
                        break
                yield pd.DataFrame({
                    "kind": np.where(lone, "lone", "text"), "number": part["rep"].to_numpy(), "size": sizes.astype("int32"),
                    "task": np.int32(task), "place": _places(sizes, of_size).astype("int32"), "data": None, "text": part["text"].to_numpy(),
                })
        for hi, n in made.items():
            yield _row("made", hi, struct.pack("<q", n))
        if of_size:
            yield _row("sizes", task, np.array(sorted(of_size.items()), dtype=np.int64).tobytes())
        block = len(table) // SKETCH_BLOCKS
        for i in range(SKETCH_BLOCKS):
            part = table[i * block : (i + 1) * block]
            if part.any():
                yield _row("block", i, _packed(part))

    return count


def _packed(counts: np.ndarray) -> bytes:
    """Counts in the narrowest of three widths, whose number of bytes is the first one."""
    width = next(w for w in (1, 2, 4) if w == 4 or counts.max(initial=0) < 1 << 8 * w)
    return bytes([width]) + zlib.compress(np.minimum(counts, 0xFFFFFFFF).astype(f"<u{width}").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), dtype=f"<u{data[0]}").astype(np.int64)


def _add_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[tuple[str, int], np.ndarray | int] = {}
    for pdf in batches:
        for kind, number, data in zip(pdf["kind"], pdf["number"], pdf["data"]):
            new = _unpacked(data) if kind == "block" else struct.unpack("<q", data)[0]
            sums[kind, number] = sums.get((kind, number), 0) + new
    for (kind, number), total in sums.items():
        data = _packed(total) if kind == "block" else struct.pack("<q", total)
        yield pd.DataFrame({"kind": [kind], "number": [number], "data": [data]})


class _Order:
    """Texts numbered by the size of their sets, without a shuffle: those of a size by their task and their place in it.

    ``of``: of each task the sizes of its texts, and the number of the first of each size;
    ``sizes``, ``starts``: all sizes, and the number of the first text of each.
    """

    def __init__(self, counted: dict[int, np.ndarray]):
        size, n = (np.concatenate([rows[:, i] for rows in counted.values()]) for i in (0, 1))
        task = np.repeat(list(counted), [len(rows) for rows in counted.values()])
        order = np.lexsort((task, size))
        start = np.empty(len(size), dtype=np.int64)
        start[order] = np.cumsum(n[order]) - n[order]
        self.of = {t: (size[task == t], start[task == t]) for t in counted}
        self.sizes, first = np.unique(size[order], return_index=True)
        self.starts = start[order][first]
        self.total = int(n.sum())

    def numbers(self, pdf: pd.DataFrame) -> np.ndarray:
        size, task, number = pdf["size"].to_numpy(), pdf["task"].to_numpy(), pdf["place"].to_numpy().astype(np.int64)
        for t in np.unique(task):
            own = task == t
            sizes, starts = self.of[int(t)]
            number[own] += starts[np.searchsorted(sizes, size[own])]
        return number


class _Held:
    """What a band's passes need of each text, by its number, in files that workers
    map into memory, so that no text is sent to a group with its signatures.

    ``size``: of its set; ``text``: its id and its limit; ``sketch``: the folded one and the first half of the whole one.
    """

    def __init__(self, path: str, width: int):
        self.path = path
        self.kinds = {"size": ("<i4", 1), "text": ("<u8", 1), "sketch": ("<u8", width // 2)}

    def put(self, number: np.ndarray, **rows: Sequence[np.ndarray]) -> None:
        os.makedirs(self.path, exist_ok=True)
        for name, parts in rows.items():
            values = np.column_stack([np.asarray(part).astype(self.kinds[name][0]) for part in parts])
            out = os.open(f"{self.path}/{name}", os.O_WRONLY | os.O_CREAT, 0o644)
            try:
                data, size = memoryview(values.tobytes()), values.itemsize * values.shape[1]
                for i, at in enumerate(number.tolist()):  # a repeated task writes the same
                    os.pwrite(out, data[i * size : (i + 1) * size], at * size)
            finally:
                os.close(out)

    def get(self, name: str) -> np.ndarray:
        """All rows; of ``text`` and ``sketch`` two for each number."""
        kind, width = self.kinds[name]
        found = np.memmap(f"{self.path}/{name}", dtype=kind, mode="r").view(np.ndarray)
        return found.reshape(-1, width) if width > 1 or name == "sketch" else found


@dataclass(frozen=True)
class _Pass:
    """One of the passes over band ``hi``: that over a range of its segments, into ``number`` groups.

    ``start``: the number of the band's first text; ``high``: bits of a signature that are
    coded by place (0 or 8); ``held``: None where no files can be mapped: sketches then go
    with the signatures, and what the first pass found is found again.
    """

    hi: int
    at: int
    passes: int
    number: int
    start: int
    high: int
    held: _Held | None

    def segments(self) -> tuple[int, int]:
        m = _segments(self.hi)
        return m * self.at // self.passes, m * (self.at + 1) // self.passes

    def runs(self) -> tuple[int, int]:
        """The hashes of the runs that fall into these segments."""
        m = _segments(self.hi)
        low, up = ((-(-(s << 32) // m)) << 16 for s in self.segments())
        return low, up


def _sketches(runs: np.ndarray, doc: np.ndarray, texts: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the odd sketch of half as many bits, and the first half of the whole one."""
    bit = (runs >> _U(3)) % _U(64 * width)
    flat = doc * (64 * width) + bit.view(np.int64)
    odd = np.zeros(texts * width * 64, dtype=np.uint8)
    np.add.at(odd, flat, np.uint8(1))
    odd &= np.uint8(1)
    sketch = np.packbits(odd, bitorder="little").view(np.uint64).reshape(texts, width)
    first = sketch[:, : width // 2]
    return first ^ sketch[:, width // 2 :], first


def _emit_signatures(threshold: float, table, bits: int, order, now: _Pass, most: int):
    """Blobs of the signatures of a pass, by its groups."""
    hi, held = now.hi, now.held

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        costs = table.value
        shift, low, far = _U(64 - bits), _U(0xFFFF), _U((1 << 44) - 1)
        whole = now.at == 0 or held is None
        limits = None if whole else held.get("text")

        def cost(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            count = costs[(s >> shift).view(np.int64)]
            price = count.astype(np.uint64)
            price <<= _U(16)
            price |= (s >> _U(8)) & low
            return np.minimum(price, far, out=price), count

        for pdf in batches:
            for part in _parts(pdf):
                ids, sizes = part["number"].to_numpy(), part["size"].to_numpy().astype(np.int64)
                number = order.value.numbers(part) - now.start
                runs, docs, _ = run_sets(list(part["text"]), among=None if whole else now.runs())
                band = _Band(runs, docs, np.ones(len(part), dtype=bool), hi, True)
                (full_cost, full_count), (less_cost, less_count) = cost(band.full), cost(band.less)
                several, inline = band.several, None
                if whole:
                    both = np.maximum(np.maximum.reduceat(less_cost, band.less_first), full_cost[several]) if several.any() else full_cost[:0]
                    by = band.full_doc.astype(np.uint64) << _U(44)
                    steps = np.sort(np.r_[by | full_cost, by[several] | both])
                    begin = np.searchsorted(steps, np.arange(len(sizes), dtype=np.uint64) << _U(44))
                    last = np.r_[begin[1:], len(steps)] - 1
                    at = np.minimum(begin + _need(sizes, hi, threshold) - 1, last)
                    limit = steps[np.clip(at, 0, len(steps) - 1)] & far
                    fold, rest = _sketches(band.runs, band.doc, len(sizes), _words(hi))
                    if held is None:
                        inline = ids, sizes, fold, rest
                    else:
                        held.put(number, size=[sizes], text=[ids, limit], sketch=[fold, rest])
                else:
                    limit = limits[2 * number + 1]
                from_, to = now.segments()
                here = (band.segment >= from_) & (band.segment < to)
                less_here = np.repeat(here[several], band.count[several])
                keys = []
                for kind, signature, doc, price, count, there in (
                    (0, band.full, band.full_doc, full_cost, full_count, here), (1, band.less, band.less_doc, less_cost, less_count, less_here),
                ):
                    kept = (price <= limit[doc]) & there
                    keys += _placed(signature[kept], kind, doc[kept], count[kept], ids, now.number, most)
                yield from _blobs(number, np.sort(np.concatenate(keys)), now, inline)

    return emit


def _placed(signature: np.ndarray, kind: int, doc: np.ndarray, count: np.ndarray, ids: np.ndarray, number: int, most: int) -> list[np.ndarray]:
    """Group, text, low 24 bits and kind of each signature, in one word.

    A group has few more signatures than 24 bits have values, and chance partners
    are dropped with all others that are not similar. A signature with more than
    ``most`` holders is not left to one group: its holders are cut into blocks by
    id, and each goes to the groups of the pairs of blocks that hold its own.
    """
    key = (signature >> _U(32)) % _U(number)
    key <<= _U(20)
    key |= doc.view(np.uint64)
    key <<= _U(25)
    key |= (signature & _U(0xFFFFFF)) << _U(1)
    key |= _U(kind)
    hot = np.flatnonzero(count > most)
    if not len(hot):
        return [key]
    out = [np.delete(key, hot)]
    parts = -(-count[hot].astype(np.int64) // most)
    for blocks in np.unique(parts):
        of = hot[parts == blocks]
        own = _mix(ids[doc[of]].astype(np.uint64)) % _U(blocks)
        for other in range(int(blocks)):
            low, high = np.minimum(own, _U(other)), np.maximum(own, _U(other))
            place = _mix(signature[of] + low * _U(0x9E3779B97F4A7C15) + high * _U(0xC2B2AE3D27D4EB4F)) % _U(number)
            out.append((place << _U(45)) | (key[of] & _U((1 << 45) - 1)))
    return out


def _blobs(number: np.ndarray, keys: np.ndarray, now: _Pass, inline) -> Iterator[pd.DataFrame]:
    """Of each group the numbers of the texts, with ids, sizes and sketches where these aren't
    held, and their signatures: the low bits as they are, the text and the high bits,
    which rise, by one bit for each signature in a row of bits (Elias-Fano)."""
    low = _U(24 - now.high)
    edges = np.searchsorted(keys, np.arange(now.number + 1, dtype=np.uint64) << _U(45))
    for g in range(now.number):
        part = keys[edges[g] : edges[g + 1]]
        if not len(part):
            continue
        doc = ((part >> _U(25)) & _U(0xFFFFF)).view(np.int64)
        new = np.r_[True, doc[1:] != doc[:-1]]
        present = doc[new]
        sig = (part >> _U(1)) & _U(0xFFFFFF)
        row = np.zeros((len(present) << now.high) + len(part), dtype=np.uint8)
        row[((np.cumsum(new) - 1) << now.high) + (sig >> low).view(np.int64) + np.arange(len(part))] = 1
        words = (sig & _U(0xFFFF)).astype("<u2") if now.high else sig.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
        texts = b"" if inline is None else b"".join(np.ascontiguousarray(x[present]).astype(k).tobytes() for x, k in zip(inline, ("<i8", "<i4", "<u8", "<u8")))
        data = b"".join((
            struct.pack("<qq", len(present), len(part)), number[present].astype("<u4").tobytes(), texts,
            words.tobytes(), np.packbits((part & _U(1)).astype(np.uint8)).tobytes(), np.packbits(row).tobytes(),
        ))
        yield pd.DataFrame({"grp": [g], "data": [data]})


def _read_blobs(blobs: list[bytes], now: _Pass):
    """Of all signatures the 24 bits, the number of the holder and the kind; and of the holders
    sizes, ids and sketches, as ``_Held`` has them, where those came with them.

    Each blob is let go once it is read; the arrays are made once, at their full length.
    """
    heads = [struct.unpack_from("<qq", blob) for blob in blobs]
    texts, total, half = sum(h[0] for h in heads), sum(h[1] for h in heads), _words(now.hi) // 2
    sig, doc, less = np.empty(total, dtype=np.uint32), np.empty(total, dtype=np.uint32), np.empty(total, dtype=bool)
    came = None
    if now.held is None:
        came = [np.empty(texts, dtype=k) for k in (np.uint32, np.int64, np.int32)] + [np.empty((texts, half), dtype=np.uint64) for _ in range(2)]
    base = done = 0
    while blobs:
        blob = blobs.pop()
        n, count = struct.unpack_from("<qq", blob)
        at = 16

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(blob, dtype=kind, count=count, offset=at)
            at += out.nbytes
            return out

        number = take("<u4", n)
        if came is not None:
            rows = number, take("<i8", n), take("<i4", n), take("<u8", n * half).reshape(n, half), take("<u8", n * half).reshape(n, half)
            for all_, own in zip(came, rows):
                all_[base : base + n] = own
        here = slice(done, done + count)
        if now.high:
            sig[here] = take("<u2", count)
        else:
            words = np.zeros((count, 4), dtype=np.uint8)
            words[:, :3] = take(np.uint8, count * 3).reshape(count, 3)
            sig[here] = words.view("<u4")[:, 0]
        less[here] = np.unpackbits(take(np.uint8, -(-count // 8)), count=count)
        bits = (n << now.high) + count
        row = np.flatnonzero(np.unpackbits(take(np.uint8, -(-bits // 8)), count=bits))
        row -= np.arange(count)
        sig[here] |= ((row & ((1 << now.high) - 1)) << (24 - now.high)).astype(np.uint32)
        row >>= now.high
        doc[here] = number[row] if came is None else row + base
        base, done = base + n, done + count
    if came is None:
        return [sig, doc, less], None
    order = np.argsort(came[0], kind="stable")
    place = np.empty(len(order), dtype=np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    for part in range(0, total, 1 << 20):
        doc[part : part + (1 << 20)] = place[doc[part : part + (1 << 20)]]
    _, ids, sizes, fold, rest = (x[order] for x in came)
    return [sig, doc, less], (sizes, np.column_stack((ids, ids)).reshape(-1), np.stack((fold, rest), axis=1).reshape(-1, half))


def _met(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The signatures that have a partner, each with its holder, ordered: those held in full, and the others.

    Takes the arrays out of ``held``, so that they are let go.
    """
    sig, doc, less = held
    held.clear()
    full = np.arange(len(sig), dtype=np.uint32)[~less]
    own = sig[full]
    last = np.zeros(1 << 24, dtype=np.uint32)
    last[own] = full
    twice = np.zeros(1 << 24, dtype=bool)
    twice[own[last[own] != full]] = True
    there = np.zeros(1 << 24, dtype=bool)
    there[own] = True
    del last
    other = np.arange(len(sig), dtype=np.uint32)[less & there[sig]]
    del there
    twice[sig[other]] = True
    own = full[twice[own]]
    del full, twice
    keyed = []
    for at in (own, other):
        key = sig[at].astype(np.uint64)
        key <<= _U(32)
        key |= doc[at]
        key.sort()
        keyed.append(key)
    return keyed[0], keyed[1]


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits set in each row of words."""
    counts = np.bitwise_count(x)
    if counts.shape[1] % 8:
        return counts.sum(axis=1, dtype=np.int64)
    lanes = counts.view(np.uint64)  # eight counts of up to 64 in a word: added in lanes of 16 bits
    total = (lanes & _U(0x00FF00FF00FF00FF)) + ((lanes >> _U(8)) & _U(0x00FF00FF00FF00FF))
    total = (total * _U(0x0001000100010001)) >> _U(48)
    return (total[:, 0] if total.shape[1] == 1 else total.sum(axis=1)).astype(np.int64)


def _ranges(left: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (left[i], j) with lo[i] <= j < hi[i], in blocks of bounded size."""
    counts = hi - lo
    some = counts > 0
    left, lo, counts = left[some], lo[some], counts[some]
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + BLOCK_PAIRS, side="right")))
        c = counts[at:to]
        if len(c) == 1 and c[0] > BLOCK_PAIRS:
            for s in range(0, int(c[0]), BLOCK_PAIRS):
                j = np.arange(lo[at] + s, lo[at] + min(s + BLOCK_PAIRS, int(c[0])))
                yield np.full(len(j), left[at]), j
        else:
            inner = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
            yield np.repeat(left[at:to], c), np.repeat(lo[at:to], c) + inner
        at = to


def _fitting(sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different ones of rising sizes - or all from the first to the last, if these aren't too
    many - and of each the places from and up to which the sizes that a similar set may have lie."""
    if len(sizes) and sizes[-1] - sizes[0] < 1 << 20:
        value = np.arange(sizes[0], sizes[-1] + 1, dtype=np.int32)
    else:
        value = np.unique(sizes)
    edges = np.append(np.searchsorted(sizes, value), len(sizes))
    least = edges[np.searchsorted(value, np.ceil(value * threshold - 1e-9))]
    most = edges[np.searchsorted(value, np.floor(value / threshold + 1e-9), side="right")]
    return value, least.astype(np.uint64), most


def _match_groups(threshold: float, now: _Pass):
    ratio = (1 - threshold) / (1 + threshold)

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups: dict[int, list[bytes]] = {}
        for pdf in batches:
            for g, data in zip(pdf["grp"], pdf["data"]):
                groups.setdefault(g, []).append(data)
        while groups:
            _, blobs = groups.popitem()
            held, came = _read_blobs(blobs, now)
            full, less = _met(held)
            sizes, ids, sketch = came or (now.held.get(name) for name in ("size", "text", "sketch"))
            mask = _U((1 << 32) - 1)
            inside = np.searchsorted(sizes, np.int32(min(now.hi, (1 << 31) - 1)))  # two sets beyond the band meet in their own
            value, least, most = _fitting(sizes, threshold)
            most = np.where(value < now.hi, most, inside).astype(np.uint64)
            close = len(value) and value[-1] - value[0] + 1 == len(value)

            def jobs(full=full, less=less, sizes=sizes, value=value, close=close, least=least, most=most, inside=inside):
                """Holders, and where in ``full`` their partners of fitting size lie."""

                def place(left):
                    return sizes[left] - value[0] if close else np.searchsorted(value, sizes[left])

                for at in range(0, len(full), JOB_SIGNATURES):
                    part = full[at : at + JOB_SIGNATURES]
                    left = (part & mask).view(np.int64)
                    upto = np.searchsorted(full, (part & ~mask) | most[place(left)])
                    yield left, np.arange(at + 1, at + len(part) + 1), np.where(left < inside, upto, 0)
                for at in range(0, len(less), JOB_SIGNATURES):
                    part = less[at : at + JOB_SIGNATURES]
                    left = (part & mask).view(np.int64)
                    part, size = part & ~mask, place(left)
                    yield left, np.searchsorted(full, part | least[size]), np.searchsorted(full, part | most[size])

            found, waiting = [], 0
            for left, lo, hi in jobs():
                for a, j in _ranges(left, lo, hi):
                    b = (full[j] & mask).view(np.int64)
                    apart = sketch.take(2 * a, axis=0)
                    apart ^= sketch.take(2 * b, axis=0)
                    most_apart = ratio * (sizes[a] + sizes[b]) + 1e-9
                    near = np.flatnonzero((_bits(apart) <= most_apart) & (a != b))
                    x, y, apart = a[near], b[near], apart[near]
                    first = sketch.take(2 * x + 1, axis=0) ^ sketch.take(2 * y + 1, axis=0)
                    near = _bits(first) + _bits(first ^ apart) <= most_apart[near]
                    x, y = x[near], y[near]
                    if len(x):
                        found.append((np.minimum(x, y).view(np.uint64) << _U(32)) | np.maximum(x, y).view(np.uint64))
                        waiting += len(x)
                    if waiting > FOUND_PAIRS:
                        yield _pairs(found, ids)
                        found, waiting = [], 0
            if found:
                yield _pairs(found, ids)

    return match


def _pairs(found: list[np.ndarray], ids: np.ndarray) -> pd.DataFrame:
    pairs = np.unique(np.concatenate(found))
    x, y = (ids[2 * number.view(np.int64)].astype(np.int64) for number in (pairs >> _U(32), pairs & _U((1 << 32) - 1)))
    return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})


def _exact_runs(texts: list[str], run: int) -> list[np.ndarray] | list[frozenset]:
    """The set of runs of each text: as ordered words that hold a run's characters, numbered over all texts, whole;
    as strings where there are too many different characters for that."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    there = np.zeros(int(codes.max(initial=0)) + 1, dtype=bool)
    there[codes] = True
    letters = int(there.sum())
    if letters**run >= 1 << 64:
        return [frozenset(text[i : i + run] for i in range(len(text) - run + 1)) for text in texts]
    number = (np.cumsum(there) - 1).astype(np.uint64)[codes]
    word = np.zeros(max(0, len(codes) - run + 1), dtype=np.uint64)
    for k in range(run):
        word *= _U(letters)
        word += number[k : k + len(word)]
    sets, at = [], 0
    for text in texts:
        own = np.sort(word[at : at + max(0, len(text) - run + 1)])
        new = np.ones(len(own), dtype=bool)
        new[1:] = own[1:] != own[:-1]
        sets.append(own[new])
        at += len(text)
    return sets


def _in_common(x, y) -> int:
    if isinstance(x, frozenset):
        return len(x & y)
    both = np.concatenate((x, y))
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _together(left: Iterable[str], right: Iterable[str]) -> Iterator[tuple[list[tuple[int, int]], list[str]]]:
    """Pairs by the places of their texts among the different ones, in parts of bounded size: the pairs of a text come together."""
    place: dict[str, int] = {}
    pairs: list[tuple[int, int]] = []
    total = 0
    for two in zip(left, right):
        total += sum(len(text) for text in two if text not in place)
        pairs.append(tuple(place.setdefault(text, len(place)) for text in two))
        if total > BATCH_CHARS:
            yield pairs, list(place)
            place, pairs, total = {}, [], 0
    if pairs:
        yield pairs, list(place)


def _verify(threshold: float, run: int):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            similar: list[float] = []
            for pairs, texts in _together(pdf["text_a"], pdf["text_b"]):
                sets = _exact_runs(texts, run)
                for a, b in pairs:
                    common = _in_common(sets[a], sets[b])
                    similar.append(common / (len(sets[a]) + len(sets[b]) - common))
            similar = np.array(similar)
            kept = pdf[["a", "b"]].assign(similarity=similar)
            yield kept[similar >= threshold - 1e-12]

    return verify


def _explode_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), 2_000):
            part = pdf.iloc[at : at + 2_000]
            runs, docs, sizes = run_sets(list(part["text"]))
            yield pd.DataFrame({"rep": part["rep"].to_numpy()[docs], "size": sizes[docs].astype("int64"), "run": runs.astype("int64")})


def _lone_pairs(reps: DataFrame, lone: DataFrame, threshold: float) -> DataFrame:
    """Candidates of the few texts their segments cannot cover, through single runs.

    Of a runs, a similar text has all but a - ceil(d a): one of the first
    a - ceil(d a) + 1 by hash is common to both.
    """
    runs = reps.mapInPandas(_explode_runs, "rep long, size long, run long")
    own = runs.join(lone, "rep", "left_semi")
    rank = F.row_number().over(W.partitionBy("rep").orderBy("run"))  # one text: bounded by its length
    prefix = own.withColumn("_rank", rank).where(F.col("_rank") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1)
    other = runs.withColumnsRenamed({"rep": "other", "size": "other_size"})
    fits = (F.col("rep") != F.col("other")) & (F.col("size") * threshold <= F.col("other_size") + 1e-9) & (F.col("other_size") * threshold <= F.col("size") + 1e-9)
    met = prefix.join(other, "run").where(fits)
    return met.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b"))


def text_classes(records: DataFrame, key: str, text: str, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame, list[runtime.Stage]]:
    """Texts of at least ``min_chars`` normalised characters.

    Representatives ``rep, text``, one per different normalised text (the smallest
    key); members ``id, rep`` of the keys of texts that several rows hold; and the
    stages both are read from. Rows with a null key or text are left out, repeated
    rows count once.
    """
    found = records.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).cast("long").alias("id"), normalised(F.col(text)).alias("text")
    ).where(F.char_length("text") >= min_chars).withColumn("hash", F.unhex(F.md5("text")))
    with runtime.session_settings(records.sparkSession, PLAIN_CASE):
        stage = runtime.Stage(found, "texts")
    rows = stage.df
    reps = rows.groupBy("hash").agg(F.min("id").alias("rep"), F.first("text").alias("text")).select("rep", "text")
    copied = rows.groupBy("hash").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    held = runtime.Stage(copied, "copied")
    hot_rows = runtime.hot_threshold(rows.count())
    own = rows.select("id", "hash")
    members = own.join(held.df.where(F.col("n") <= hot_rows), "hash")
    if held.df.where(F.col("n") > hot_rows).limit(1).count():  # copies of a hot text reach it by a broadcast of bounded size
        hot = F.broadcast(held.df.where(F.col("n") > hot_rows))
        cool = own.join(hot, "hash", "left_anti").join(held.df.where(F.col("n") <= hot_rows), "hash")
        members = own.join(hot, "hash").unionByName(cool)
    return reps, members.select("id", "rep").distinct(), [stage, held]


def _cost_table(counted: DataFrame, bits: int) -> tuple[np.ndarray, dict[int, int], _Order | None]:
    """The cost sketch, of every band the signatures that could be made, and the texts in the order of sizes.

    The driver gets 32 blocks of a sketch of bounded size, one number per band, and one per task and size of sets.
    """
    sums = counted.where("kind in ('block', 'made')").select("kind", "number", "data")
    sums = sums.repartition(SKETCH_BLOCKS, "kind", "number").mapInPandas(_add_blocks, "kind string, number long, data binary")
    table = np.zeros(1 << bits, dtype=np.uint32)
    made: dict[int, int] = {}
    block = len(table) // SKETCH_BLOCKS
    for kind, number, data in sums.collect():
        if kind == "block":
            table[number * block : (number + 1) * block] = _unpacked(bytes(data))
        else:
            made[number] = made.get(number, 0) + struct.unpack("<q", bytes(data))[0]
    sizes = {number: np.frombuffer(bytes(data), dtype=np.int64).reshape(-1, 2) for number, data in counted.where("kind = 'sizes'").select("number", "data").collect()}
    return table, made, _Order(sizes) if sizes else None


def _passes(hi: int, start: int, texts: int, made: int, room: float, folder: runtime.Folder) -> list[_Pass]:
    """The passes over a band of so many texts and signatures, so that none shuffles more than ``room`` bytes, by estimate."""
    kept = made * 3 // 4
    groups = max(1, -(-kept // GROUP_SIGNATURES))
    each = max(1.0, kept / max(1, texts) / groups)  # signatures that a group gets of a text
    path = folder.mapped()
    beside = 4 + (0 if path else 12 + 8 * _words(hi))
    high, size = min(((8, 2.2 + (beside + 32) / each), (0, 3.2 + beside / each)), key=lambda x: x[1])
    passes = int(min(_segments(hi), max(1, -(-kept * size // room))))
    held = _Held(path, _words(hi)) if path else None
    return [_Pass(hi, at, passes, -(-groups // passes), start, high, held) for at in range(passes)]


def similar_representatives(reps: DataFrame, threshold: float = THRESHOLD, run: int = RUN, used: Sequence[runtime.Stage] = (), most: int = HOT_PARTNERS) -> runtime.Stage:
    """``a, b, similarity`` of all pairs of representatives at or above the threshold.

    Bands are worked through one after another, each in passes over its segments,
    and what a pass shuffles is removed once its candidates are written, so that the
    disk in use is that of one pass, which is bounded by what the texts take.
    ``used``: stages that ``reps`` is read from, dropped once they aren't needed.
    ``most``: holders of a signature beyond which it is split over groups.
    """
    if run != RUN:
        raise ValueError(f"runs have {RUN} characters")
    spark = reps.sparkSession
    bits = min(SKETCH_MOST_BITS, max(16, (SKETCH_PER_TEXT * reps.count()).bit_length()))
    with runtime.session_settings(spark, FRUGAL):
        seen = runtime.Stage(reps.mapInPandas(_count_signatures(threshold, bits), COUNTED), "signature-counts", ["kind"])
        for stage in used:
            stage.drop()
        table, made, order = _cost_table(seen.df, bits)
        for kind in ("block", "made", "sizes"):
            seen.drop(f"kind={kind}")
        room = max(PASS_LEAST, PASS_SHARE * seen.size())
        texts = seen.df.where("kind in ('text', 'lone')")
        held, ordered = spark.sparkContext.broadcast(table), spark.sparkContext.broadcast(order)
        met = []
        for hi, n in sorted(made.items()):
            member = np.flatnonzero(_in_band(order.sizes, hi, threshold))
            start, end = (int(order.starts[at]) if at < len(order.starts) else order.total for at in (member[0], member[-1] + 1))
            if end - start >= 1 << 32:
                raise ValueError(f"{end - start} texts in a band: their numbers have 32 bits")
            folder = runtime.Folder(spark, "sketches")
            inside = texts.where(_in_band(F.col("size"), hi, threshold)).select("number", "size", "task", "place", "text")
            for now in _passes(hi, start, end - start, n, room, folder):
                blobs = inside.mapInPandas(_emit_signatures(threshold, held, bits, ordered, now, most), "grp int, data binary")
                placed = blobs.repartitionById(now.number, F.col("grp"))
                pairs = placed.mapInPandas(_match_groups(threshold, now), "a long, b long").distinct()
                met.append(runtime.Stage(pairs, "candidates"))
            folder.drop()
        lone = texts.where("kind = 'lone'").select(F.col("number").alias("rep"))
        if lone.limit(1).count():
            met.append(runtime.Stage(_lone_pairs(texts.select(F.col("number").alias("rep"), "text"), lone, threshold).distinct(), "candidates"))
        both = spark.createDataFrame([], "a long, b long")
        for stage in met:
            both = both.unionByName(stage.df)
        both = both.distinct()  # a pair may be met in several passes
        for side in "ab":
            both = both.join(texts.select(F.col("number").alias(side), F.col("text").alias(f"text_{side}")), side)
        verified = both.select("a", "b", "text_a", "text_b").mapInPandas(_verify(threshold, run), "a long, b long, similarity double")
        linked = runtime.Stage(verified.distinct(), "links")
        for stage in (seen, *met):
            stage.drop()
        held.destroy()
        ordered.destroy()
    return linked


def similar_pairs(records: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """``id_a, id_b`` of all pairs of different keys whose texts are similar, copies included.

    Copies of one text meet by blocks of members, so that a text held by many keys
    is spread over many tasks.
    """
    reps, members, stages = text_classes(records, key, text)
    members = runtime.Stage(members, "members")
    linked = similar_representatives(reps, threshold, used=stages).df.select("a", "b")
    x = members.df.select(F.col("rep").alias("a"), F.col("id").alias("x"))
    y = members.df.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    across = linked.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    sizes = runtime.cut(members.df.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / MEMBER_BLOCK).cast("int").alias("blocks")), "member-blocks")
    placed = members.df.join(sizes, "rep").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    every = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = every.select("rep", F.col("id").alias("x"), "block", "other")
    right = every.select("rep", F.col("id").alias("y"), F.col("other").alias("block"), F.col("block").alias("other"))
    twins = left.join(right, ["rep", "block", "other"]).where("x < y").select("x", "y")
    found = across.unionByName(twins).where("x != y")
    return found.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def similarity_groups(records: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """One row per key: ``id, cluster_id, n_links, max_similarity``.

    ``cluster_id`` is the smallest key of the texts linked directly or indirectly;
    ``n_links`` counts the other different texts that are similar, ``max_similarity``
    is the highest similarity to another key's text (1 for copies, else that of the
    pairs found; 0 without any). Keys with too short a text are left out.
    """
    reps, members, stages = text_classes(records, key, text)
    members = runtime.cut(members, "members")
    every = runtime.cut(reps.select("rep"), "representatives")
    linked = similar_representatives(reps, threshold, used=stages).df
    each = linked.select(F.col("a").alias("rep"), "similarity").unionByName(linked.select(F.col("b").alias("rep"), "similarity"))
    links = each.groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"), F.max("similarity").alias("best"))
    clusters = components.connected_components(linked.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    of_rep = every.join(links, "rep", "left").join(clusters.withColumnRenamed("id", "rep"), "rep", "left").select(
        "rep", F.coalesce("component", "rep").alias("cluster_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("best", F.lit(0.0)).alias("best")
    )
    several = members.groupBy("rep").agg(F.count(F.lit(1)).alias("ids")).where("ids > 1")
    alone = of_rep.join(several, "rep", "left_anti").select(F.col("rep").alias("id"), "cluster_id", "n_links", F.col("best").alias("max_similarity"))
    copies = members.join(several.join(of_rep, "rep"), "rep").select("id", "cluster_id", "n_links", F.lit(1.0).alias("max_similarity"))
    return alone.unionByName(copies)


def groups_of_all(records: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """``similarity_groups`` with one row for every key that is not null.

    ``max_similarity`` is null where it is only known to lie below the threshold.
    Keys without a text of ``MIN_CHARS`` characters are compared with none: each is
    its own cluster, and ``n_links`` is null too.
    """
    found = similarity_groups(records, key, text, threshold).withColumn("max_similarity", F.when(F.col("max_similarity") > 0, F.col("max_similarity")))
    every = records.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id")).distinct()
    return every.join(found, "id", "left").withColumn("cluster_id", F.coalesce("cluster_id", "id"))
