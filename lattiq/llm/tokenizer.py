"""Encoding of a whole corpus with a public byte-level BPE vocabulary (problem 7).

Method: prefix dynamic programming.  A sequence of tokens is what BPE gives for its bytes exactly if every
neighbouring pair is (BPE of the pair's bytes gives the pair back).  So each byte prefix has one valid last
token: the token that ends the prefix and forms a valid pair with the last token of the shorter prefix.
Storing that token per prefix makes appends exact and lets an edit re-encode only from where it starts.

Text is first split into pieces by the vocabulary's pattern, and merges never cross a piece.  Pieces repeat
a great deal, so the ids of each distinct piece are kept per Python worker, in a store of bounded size.

Defined results: null and empty texts have an empty list; the string of a special token is ordinary text;
lone surrogates cannot occur in Spark strings.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
from array import array
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The pattern that splits text before the merges of this vocabulary, and the same for ASCII texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
KEPT_PIECES = 400_000
LONG_TEXT = 2_000_000
"""Characters beyond which the pieces of a text are streamed instead of listed."""


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to id, from a rank file (base64 and number on each line)."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class PrefixTable:
    """The last token of every byte prefix of one piece; grows by exact appends."""

    __slots__ = ("_bpe", "data", "last")

    def __init__(self, bpe: PrefixBpe, data: bytes = b""):
        self._bpe, self.data, self.last = bpe, b"", [-1]
        if data:
            self.append(data)

    def append(self, more: bytes) -> None:
        start, self.data = len(self.data), self.data + more
        data, last, bpe = self.data, self.last, self._bpe
        ids, valid = bpe.ids, bpe.valid_pair
        for end in range(start + 1, len(data) + 1):
            found = -1
            for n in bpe.lengths_of(data, end):
                begin = end - n
                if begin < 0:
                    continue
                token = ids.get(data[begin:end])
                if token is not None and (begin == 0 or valid(last[begin], token)):
                    found = token
                    break
            last.append(found)

    def truncate(self, n: int) -> None:
        """Forget everything from byte ``n`` on, as before an edit there."""
        self.data = self.data[:n]
        del self.last[n + 1 :]

    def tokens(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            token = self.last[at]
            out.append(token)
            at -= len(self._bpe.token_bytes[token])
        return out[::-1]


class PrefixBpe:
    """Encoder over one rank file; ids equal those of plain merging by rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        self.token_bytes = {i: b for b, i in ranks.items()}
        by_tail: dict[bytes, set[int]] = {}
        for b in ranks:
            by_tail.setdefault(b[-2:], set()).add(len(b))
        self._single = (1,)
        self._lengths = {k: tuple(sorted(v | {1}, reverse=True)) for k, v in by_tail.items() if len(k) == 2}
        self._pairs: dict[int, bool] = {}
        self._split = regex.compile(PATTERN)
        self._split_ascii = re.compile(ASCII_PATTERN, re.ASCII)
        self.pieces = _Pieces(self)

    def lengths_of(self, data: bytes, end: int) -> tuple[int, ...]:
        """Lengths, longest first, of tokens that may end at ``end``."""
        return self._lengths.get(data[end - 2 : end], self._single) if end > 1 else self._single

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE: join the neighbouring pair of lowest rank, leftmost first, until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min((self.ids.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best[0] == 1 << 60:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ids[p] for p in parts]

    def valid_pair(self, a: int, b: int) -> bool:
        """Whether BPE over the bytes of both tokens gives exactly these two."""
        key = a << 32 | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > 2_000_000:
                self._pairs.clear()
            known = self._pairs[key] = self.merge(self.token_bytes[a] + self.token_bytes[b]) == [a, b]
        return known

    def split(self, text: str):
        rx = self._split_ascii if text.isascii() else self._split
        return rx.findall(text) if len(text) <= LONG_TEXT else (m.group() for m in rx.finditer(text))

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8")
        whole = self.ids.get(data)
        return (whole,) if whole is not None else tuple(PrefixTable(self, data).tokens())

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.pieces.__getitem__, self.split(text)))) if text else 0

    def decode(self, ids) -> str:
        return b"".join(self.token_bytes[i] for i in ids).decode("utf-8")


class _Pieces(dict):
    """Ids by piece, filled on first use; emptied when it holds KEPT_PIECES."""

    def __init__(self, bpe: PrefixBpe):
        super().__init__()
        self._bpe = bpe

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self._bpe.encode_piece(piece)
        if len(piece) <= 64:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class IncrementalText:
    """A text whose ids stay exact under appends and edits.

    Appending re-splits only from the start of the last piece but one and keeps the prefix table of the
    last piece, so a piece that merely grows is extended byte by byte.  ``replace`` keeps all pieces that
    end well before the edit and continues as an append.
    """

    def __init__(self, bpe: PrefixBpe, text: str = ""):
        self.bpe, self.pieces, self._ids, self._table = bpe, [], [], None
        self.append(text)

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    def ids(self) -> list[int]:
        return list(chain.from_iterable(self._ids))

    def append(self, more: str) -> None:
        tail = self.pieces[-2:]  # white space before the last piece may regroup
        self.pieces[-2:], self._ids[-2:] = [], []
        for piece in self.bpe.split("".join(tail) + more):
            data = piece.encode("utf-8")
            if self._table is not None and self._table.data and data.startswith(self._table.data):
                self._table.append(data[len(self._table.data) :])
            else:
                self._table = PrefixTable(self.bpe, data)
            self.pieces.append(piece)
            self._ids.append(tuple(self._table.tokens()))

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in place of characters ``start`` to ``end``."""
        text = self.text
        at = kept = 0
        while kept < len(self.pieces) and at + len(self.pieces[kept]) < start:
            at += len(self.pieces[kept])
            kept += 1
        kept = max(0, kept - 2)
        at = sum(map(len, self.pieces[:kept]))
        del self.pieces[kept:], self._ids[kept:]
        self._table = None
        self.append(text[at:start] + new + text[end:])


_loaded: dict[int, PrefixBpe] = {}


def encoder(data: bytes) -> PrefixBpe:
    """One encoder per Python worker and vocabulary."""
    key = hash(data)
    if key not in _loaded:
        _loaded[key] = PrefixBpe(parse_ranks(data))
    return _loaded[key]


def _vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # one file of fixed size, under 1 MB


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, ids)``: one row per input row, no shuffle; repeated rows stay repeated."""
    ranks = _vocabulary(docs, vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = encoder(ranks.value)
        get, split = bpe.pieces.__getitem__, bpe.split
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                flat, ends = array("i"), array("q", [0])
                for text in part.column(1).to_pylist():
                    if text:
                        flat.extend(chain.from_iterable(map(get, split(text))))
                    ends.append(len(flat))
                offsets = pa.array(memoryview(ends), pa.int64()) if len(flat) >= 1 << 31 else pa.array(memoryview(ends)).cast(pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)]))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def count_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, n_ids)``: the number of ids only; null and empty texts have 0."""
    ranks = _vocabulary(docs, vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = encoder(ranks.value)
        for batch in batches:
            counts = pa.array([bpe.count(t) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts], ["doc_id", "n_ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_ids bigint")
