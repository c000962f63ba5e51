"""Byte-level BPE as a streaming transducer with bounded lookahead.

A text is read in chunks. The pre-tokenising pattern cuts it into pieces; a run of
one kind of character that reaches the end of a chunk goes on in the next one, and
its characters are handed to the transducer as they come. Inside a piece the
encoder keeps, for each of the last few byte positions, the one token that ends
there in the encoding of the prefix (a token may follow another exactly if the pair
encodes to itself). Those tokens form back-pointer paths. The merge list gives the
lookahead: how far to the right a byte can lie that still changes a merge, over
chains of merges each of which an earlier one to its right prevents or allows.
Each time so many further bytes were read the paths are walked back; where all that
can still be extended run through one boundary, no later byte can change what lies
before it: the tokens up to there are emitted and forgotten. Memory is bounded by
the lookahead and the longest token, not by the length of the text or piece, and
the work is linear in it.

Decoding is an incremental state machine: bytes of tokens go through a UTF-8
decoder that carries an unfinished character from one token to the next.
"""

from __future__ import annotations

import base64
import codecs
import os
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: Fixed value: the vocabulary's pre-tokenising pattern.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a text that are looked at in one go.
CHUNK = 1 << 16
#: Bytes within which a match of the pattern may still depend on what follows.
TAIL = 3
#: Pieces up to this many bytes are remembered, and so many of them.
MEMO_BYTES, MEMO_SIZE = 64, 200_000
#: A run of so many characters that reaches the end of a chunk is handed on before it ends.
OPEN_AT = 1 << 10


class Transducer:
    """Encoder and decoder of one vocabulary of merge ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.pattern = regex.compile(pattern)
        self.ranks = ranks
        self.token_bytes = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._split = self._merges()
        self._pairs: dict[tuple[int, int], int] = {(a, b): t for t, (a, b) in self._split.items() if a != t}
        self._follows: dict[tuple[int, int], bool] = {}
        self._memo: dict[str, tuple[int, ...]] = {}
        self._trie = self._suffix_trie()
        self.lookahead = self._lookahead()
        #: What a run goes on with, by the kind of its last character.
        self._more = [(regex.compile(c), regex.compile(c + "*")) for c in (r"\p{L}", r"\p{N}", r"\s", r"[^\s\p{L}\p{N}]")]

    def _merges(self) -> dict[int, tuple[int, int]]:
        """The two tokens each token was merged from; a single byte stands for itself.

        The parts are the encoding of the token by the merges of lower rank.
        """
        split = {}
        for token, rank in self.ranks.items():
            if len(token) == 1:
                split[rank] = (rank, rank)
                continue
            parts = [bytes([b]) for b in token]
            while len(parts) > 2:
                best, at = min(
                    (self.ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1)
                )
                if best >= rank:
                    raise ValueError(f"token {token!r} is no merge of two others")
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            split[rank] = (self.ranks[parts[0]], self.ranks[parts[1]])
        return split

    def _suffix_trie(self) -> dict:
        """The tokens by their bytes in reverse; at None a node has its token."""
        root: dict = {}
        for token, rank in self.ranks.items():
            node = root
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[None] = rank
        return root

    def _lookahead(self) -> int:
        """Bytes to the right of a merge that can decide whether it is made.

        A merge (a, b) depends on an earlier merge (s, c) to its right if s is b, or
        a part at the right end of b, and (s, c) would take s before it is merged
        into what becomes b. The later merge can in turn depend on what prevents the
        earlier one, so the lookahead is the longest such chain, in bytes of the
        c's. Ranks fall along a chain; merges are worked through by rising rank.
        """
        size = {t: len(b) for t, b in self.token_bytes.items()}
        ranks: dict[int, list[int]] = {}  # by left part: the merges it takes part in, and the most bytes up to each
        reach: dict[int, list[int]] = {}
        most = 0
        for merge in sorted(self._split):
            a, b = self._split[merge]
            if a == merge:
                continue
            need, before, part = 0, merge, b
            while True:
                at = bisect_left(ranks.get(part, ()), before)
                if at:
                    need = max(need, reach[part][at - 1])
                left, right = self._split[part]
                if left == part:
                    break
                before, part = part, right
            own = size[b] + need
            ranks.setdefault(a, []).append(merge)
            reach.setdefault(a, []).append(max(own, reach[a][-1] if reach.get(a) else 0))
            most = max(most, own)
        return most

    @property
    def lookahead_bound(self) -> int:
        """Bytes that suffice whatever the merges: their number times the longest token."""
        return len(self._pairs) * self.longest

    def follows(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, encode to themselves.

        They do unless, undoing merges latest first, a pair meets at the seam that
        a merge of lower rank than those undone would have joined.
        """
        key = (left, right)
        known = self._follows.get(key)
        if known is None:
            known = self._follows[key] = self._seam_holds(left, right)
        return known

    def _seam_holds(self, a: int, b: int) -> bool:
        limit = 1 << 60  # merges from this rank on have been undone, or come too late at the seam
        while True:
            joined = self._pairs.get((a, b))
            if joined is not None and joined < limit:
                return False
            # of the two, the later merge is undone; at a tie the left one was made first
            if a > b:
                if self._split[a][0] != a:
                    limit, a = a, self._split[a][1]
                    continue
                if self._split[b][0] == b:
                    return True
                limit, b = b + 1, self._split[b][0]
            else:
                if self._split[b][0] != b:
                    limit, b = b + 1, self._split[b][0]
                    continue
                if self._split[a][0] == a:
                    return True
                limit, a = a, self._split[a][1]

    def encode_piece(self, data: bytes) -> Iterator[int]:
        """Tokens of one piece, each as soon as it is stable."""
        whole = self.ranks.get(data)
        if whole is not None:
            yield whole
            return
        path = _Path(self)
        yield from path.feed(data)
        yield from path.rest()

    def pieces(self, chunks: Iterable[str]) -> Iterator[tuple[str, bool]]:
        """The pattern's matches over the joined chunks, each in one or more parts;
        true with the last part of a match."""
        held, more = "", None
        for chunk in chunks:
            held += chunk
            done = 0
            if more is not None:  # a run under way: no look back at what was handed on
                kind, rest = more
                done = rest.match(held).end()
                spaces = kind is self._more[2][0]
                if done == len(held):
                    yield held[: done - spaces], False
                    held = held[done - spaces :]
                    continue
                done -= spaces  # the last blank before a word belongs to the word
                yield held[:done], True
                more = None
            for match in self.pattern.finditer(held, done):
                if match.end() > len(held) - TAIL:
                    start, end = match.span()
                    if end == len(held) and end - start >= OPEN_AT:
                        more = next(m for m in self._more if m[0].match(held, end - 1))
                        done = end - (more[0] is self._more[2][0])
                        yield held[start:done], False
                    break
                yield match.group(), True
                done = match.end()
            held = held[done:]
        if more is not None:
            yield held, True
        else:
            for match in self.pattern.finditer(held):
                yield match.group(), True

    def encode_stream(self, chunks: Iterable[str]) -> Iterator[int]:
        """Ids of the joined chunks as ordinary text, each as soon as it is stable."""
        memo, path = self._memo, None
        for piece, last in self.pieces(chunks):
            if path is None and last:
                yield from memo.get(piece) or self._remembered(piece)
                continue
            path = path or _Path(self)
            yield from path.feed(piece.encode("utf-8", "surrogatepass"))
            if last:
                yield from path.rest()
                path = None

    def _remembered(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "surrogatepass")
        ids = tuple(self.encode_piece(data))
        if len(data) <= MEMO_BYTES:
            if len(self._memo) >= MEMO_SIZE:
                self._memo.clear()
            self._memo[piece] = ids
        return ids

    def encode(self, text: str | None, chunk: int = CHUNK) -> list[int]:
        """Ids of ``text`` as ordinary text; an empty list for null and empty."""
        if not text:
            return []
        if len(text) > chunk:
            return list(self.encode_stream(text[i : i + chunk] for i in range(0, len(text), chunk)))
        memo, out = self._memo, []
        for piece in self.pattern.findall(text):
            out.extend(memo.get(piece) or self._remembered(piece))
        return out

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of ``ids``, character by character as soon as each is complete."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if part := machine.decode(self.token_bytes[i]):
                yield part
        if part := machine.decode(b"", True):
            yield part

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))


class _Path:
    """The open end of the encoding of a piece whose bytes come bit by bit."""

    def __init__(self, coder: Transducer):
        self.coder = coder
        self.first = True  # nothing was emitted yet
        self.data = bytearray()  # the bytes from the last emitted boundary on
        self.ends, self.lengths = [-1], [0]  # by position: the token that ends there, and its bytes
        self.every = coder.lookahead + coder.longest

    def feed(self, data: bytes) -> Iterator[int]:
        trie, follows = self.coder._trie, self.coder.follows
        for at in range(0, len(data), self.every):
            begin = len(self.data)
            self.data += data[at : at + self.every]
            held, ends, lengths, first = self.data, self.ends, self.lengths, self.first
            for here in range(begin, len(held)):
                node, back, chosen, size = trie, here, -1, 0
                while back >= 0:
                    node = node.get(held[back])
                    if node is None:
                        break
                    token = node.get(None)
                    if token is not None:
                        before = ends[back]
                        if (back == 0 and first) or (before >= 0 and follows(before, token)):
                            chosen, size = token, here + 1 - back
                            break
                    back -= 1
                ends.append(chosen)
                lengths.append(size)
            stable = self._stable()
            if stable > 0:
                yield from self._walk(stable)
                self.data, self.ends, self.lengths = held[stable:], ends[stable:], lengths[stable:]
                self.first = False

    def rest(self) -> list[int]:
        return self._walk(len(self.ends) - 1)

    def _walk(self, upto: int) -> list[int]:
        out = []
        while upto > 0:
            out.append(self.ends[upto])
            upto -= self.lengths[upto]
        return out[::-1]

    def _stable(self) -> int:
        """The last boundary through which the paths of all open positions run.

        The next token may begin at any of the last ``longest`` positions. The
        paths are walked back, the furthest first, until one boundary is left.
        """
        lengths = self.lengths
        last = len(lengths) - 1
        heads = {p for p in range(max(0, last - self.coder.longest + 1), last + 1) if lengths[p] or p == 0}
        while len(heads) > 1:
            far = max(heads)
            heads.discard(far)
            heads.add(far - lengths[far])
        return heads.pop()


@lru_cache(maxsize=4)
def load(path: str) -> Transducer:
    """The transducer of a ranks file: a token in base 64 and its rank in each line."""
    with open(path, "rb") as lines:
        return Transducer({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


def vocabulary_path(name: str = VOCABULARY, folder: str = TOKENIZER_DIR) -> str:
    return os.path.join(folder, f"{name}.tiktoken")


def _runs(path: str, kind: T.DataType, make) -> Column:
    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        coder, made = load(path), {}
        out = []
        for t in texts:  # a text that a batch repeats is coded once
            known = made.get(t) if isinstance(t, str) else None
            if known is None:
                known = make(coder, t)
                if isinstance(t, str):
                    made[t] = known
            out.append(known)
        return pd.Series(out, dtype=object if isinstance(kind, T.ArrayType) else None)

    return run


def encode_column(text: Column, path: str | None = None) -> Column:
    """The ids of a text column. Null and empty give an empty list."""
    return _runs(path or vocabulary_path(), T.ArrayType(T.IntegerType()), lambda c, t: c.encode(t))(text)


def count_column(text: Column, path: str | None = None) -> Column:
    """The number of ids of a text column; only the number leaves the worker."""
    return _runs(path or vocabulary_path(), T.LongType(), lambda c, t: len(c.encode(t)))(text)


def decode_column(ids: Column, path: str | None = None) -> Column:
    """The text of a column of ids. Null and empty give an empty text."""
    return _runs(path or vocabulary_path(), T.StringType(), lambda c, i: c.decode(i) if i is not None else "")(ids)


def encode_corpus(documents: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``key`` and ``ids`` of every row; a map-only job without a shuffle.

    Repeated rows are encoded as often as they occur; equal keys are not merged.
    """
    return documents.select(F.col(key), encode_column(F.col(text), path).alias("ids"))
