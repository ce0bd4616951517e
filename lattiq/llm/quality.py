"""Per-document text quality statistics and a verdict on natural prose (problem 9).

Method: huge documents are split into chunks, which are spread over tasks; every chunk yields associative partial counts together with the
state at its two edges (the open line and the open word); partials are merged through a tree (blocks of
chunks, then documents) with the edges corrected, so a document's figures do not depend on where it was cut;
ratios and the rule outcome are derived last.

Counting works on the UTF-8 bytes of a whole Arrow batch at once (no per-word Python).  Definitions:

* word: longest run of letters, that is ASCII letters and all characters above U+007F but spaces;
* symbol: a visible ASCII character that is neither letter nor digit;
* line: text between line feeds (a carriage return alone also ends one); blank lines are not counted;
* closed line: its last visible character is one of ``. ! ? : ;`` or a closing quote or bracket after one;
* common word: a word of the given list; both are folded, every character to its lower case if that is one character
  of as many bytes;
* prose line: no list marker before a short item, few code symbols, and either seven words or more of which
  a fifth are common, or a shorter rest of a sentence that ends in a full stop, question or exclamation mark.

A document is prose if its prose lines hold more than half of its characters.  Null and blank texts have
zero counts and are no prose.  Extra columns are ignored; of rows repeating a doc_id one is counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.functions.scratch import Scratch

CHUNK = 32_768
"""Bytes of a chunk, about."""
SPREAD = 1 << 20
"""Characters of a text beyond which its chunks are measured by several tasks."""
BLOCK = 64
"""Chunks merged in one node of the first tree level."""
_GROUP = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)

_LETTER, _DIGIT, _SPACE, _SYMBOL, _CODE = 1, 2, 4, 8, 16


def _classes() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[33:127] = _SYMBOL
    for c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
        t[c] = _LETTER
    t[128:] = _LETTER
    for c in b"0123456789":
        t[c] = _DIGIT
    for c in b" \t\r\n\x0b\x0c":
        t[c] = _SPACE
    for c in b"(){}[]<>=+*/\\|&^%$#@~`_":
        t[c] |= _CODE
    return t


_CLASS = _classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TERMINAL = np.zeros(256, bool)
_TERMINAL[list(b".!?")] = True
_CLOSING = _TERMINAL.copy()
_CLOSING[list(b":;")] = True

_pow: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _pow or len(_pow[0]) < n:
        size = max(n, _GROUP + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _pow[:] = [
                np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64)
                for b in (_BASE, inverse)
            ]
    return _pow[0], _pow[1]


def word_hash(word: bytes) -> int:
    """Polynomial hash of a folded word; ``hash(ab) = hash(a) + hash(b) * BASE**len(a)``."""
    h, p, b = 0, 1, int(_BASE)
    for c in word:
        h = (h + (c + 1) * p) & (1 << 64) - 1
        p = p * b & (1 << 64) - 1
    return h


def _lower_table(first: int, end: int) -> np.ndarray:
    """Lower case by code point, for characters whose lower case is one character of the same UTF-8 length."""
    table = np.arange(end, dtype=np.int32)
    for c in range(first, end):
        low = chr(c).lower()
        if len(low) == 1 and first <= ord(low) < end:
            table[c] = ord(low)
    return table


_LOWER2, _LOWER3 = _lower_table(0x80, 0x800), _lower_table(0x800, 0x10000)


def folded(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with every character folded in place."""
    low, size = _LOWER[data], len(data)
    two = np.flatnonzero((data[: size - 1] >= 0xC3) & (data[: size - 1] < 0xE0)) if size > 1 else np.zeros(0, np.int64)
    if len(two):
        code = ((data[two].astype(np.int32) & 31) << 6) | (data[two + 1] & 63)
        to = _LOWER2[code]
        at, to = two[to != code], to[to != code]
        low[at], low[at + 1] = 0xC0 | (to >> 6), 0x80 | (to & 63)
    three = np.flatnonzero((data[: size - 2] & 0xF0) == 0xE0) if size > 2 else np.zeros(0, np.int64)
    if len(three):
        code = ((data[three].astype(np.int32) & 15) << 12) | ((data[three + 1].astype(np.int32) & 63) << 6) | (data[three + 2] & 63)
        to = _LOWER3[code]
        at, to = three[to != code], to[to != code]
        low[at], low[at + 1], low[at + 2] = 0xE0 | (to >> 12), 0x80 | ((to >> 6) & 63), 0x80 | (to & 63)
    return low


def fold(word: str) -> bytes:
    return folded(np.frombuffer(word.encode(), np.uint8)).tobytes()


LINE = ("l_chars", "l_seen", "l_letters", "l_words", "l_common", "l_code", "l_mark", "l_last")
SUMS = ("n_chars", "n_visible", "n_words", "n_letters", "n_common", "n_symbols", "n_lines", "n_closed", "n_prose")
EDGE = ("len", "chars", "hash", "common")


def _is_prose(chars, seen, letters, words, common, code, mark, last):
    """Rule for lines, on arrays or numbers."""
    plain = (code * 25 <= seen) & (letters * 10 >= seen * 7)
    long = (words >= 7) & (common * 5 >= words) & ~((mark > 0) & (words < 9))
    rest = (words >= 1) & (words < 7) & (last == 2) & (mark == 0)
    return plain & (long | rest)


def measure(data: np.ndarray, starts: np.ndarray, common: np.ndarray) -> dict[str, np.ndarray]:
    """Partial counts and edges for texts laid end to end in ``data``; ``starts`` has one offset more than texts.

    ``common`` holds the sorted hashes of the common words.
    """
    n_docs = len(starts) - 1
    zero = np.zeros(n_docs, np.int64)
    out = {k: zero.copy() for k in SUMS}
    for side in ("h_", "t_"):
        out |= {side + k: zero.copy() for k in LINE}
    for side in ("a_", "z_"):
        out |= {side + k: (np.zeros(n_docs, np.uint64) if k == "hash" else zero.copy()) for k in EDGE}
    out["one_line"], out["one_word"], out["ended"] = np.ones(n_docs, bool), np.zeros(n_docs, bool), np.zeros(n_docs, bool)
    if not len(data):
        return out
    size = len(data)
    lead = (data & 0xC0) != 0x80  # first byte of a character
    data = data.copy()
    for head, tails in ((0xC2, (b"\xa0", b"\x85")), (0xE2, (b"\x80", b"\x81")), (0xE3, (b"\x80\x80",)), (0xEF, (b"\xbb\xbf",))):
        at = np.flatnonzero(data == head)
        if not len(at):
            continue
        second, third = data[np.minimum(at + 1, size - 1)], data[np.minimum(at + 2, size - 1)]
        if head == 0xC2:
            hit, n = (second == 0xA0) | (second == 0x85), 2
        elif head == 0xE2:
            hit, n = ((second == 0x80) & ((third <= 0x8D) | ((third >= 0xA8) & (third <= 0xAF)))) | ((second == 0x81) & (third == 0x9F)), 3
        elif head == 0xE3:
            hit, n = (second == 0x80) & (third == 0x80), 3
        else:
            hit, n = (second == 0xBB) & (third == 0xBF), 3
        for k in range(n):
            data[np.minimum(at[hit] + k, size - 1)] = 32
    lower = folded(data)
    kind = _CLASS[data]
    first = np.zeros(size + 1, bool)
    first[starts[:-1][starts[:-1] < size]] = True  # a text begins here

    # lines: a new one begins after a line feed, after a lone carriage return, and with each text
    begin = first[:-1].copy()
    feed = data == 10
    lone = (data == 13) & ~np.concatenate([feed[1:], [False]])
    begin[1:] |= (feed | lone)[:-1]
    line_at = np.flatnonzero(begin)
    letter = (kind & _LETTER) > 0
    prev = np.concatenate([[False], letter[:-1]]) & ~first[:-1]
    word_at = np.flatnonzero(letter & ~prev)
    nxt = np.concatenate([letter[1:], [False]]) & ~first[1:]
    word_end = np.flatnonzero(letter & ~nxt) + 1
    with np.errstate(over="ignore"):
        power, inverse = _powers(size + 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * power[:size], dtype=np.uint64)])
        hashes = (total[word_end] - total[word_at]) * inverse[word_at]
    spot = np.minimum(np.searchsorted(common, hashes), max(0, len(common) - 1))
    known = (common[spot] == hashes) if len(common) else np.zeros(len(hashes), bool)

    chars_to = np.concatenate([[0], np.cumsum(lead)])
    letters_to = np.concatenate([[0], np.cumsum(letter & lead)])
    visible = (kind & _SPACE == 0) & lead & (data > 32)
    seen_to = np.concatenate([[0], np.cumsum(visible)])
    line_to = np.append(line_at[1:], size)
    span = lambda cum: cum[line_to] - cum[line_at]
    words_before = np.searchsorted(word_at, np.append(line_at, size))
    common_to = np.concatenate([[0], np.cumsum(known)])
    code_at = np.flatnonzero(kind & _CODE)
    vis_at = np.flatnonzero(visible)
    v0, v1 = np.searchsorted(vis_at, line_at), np.searchsorted(vis_at, line_to)
    some = v1 > v0
    safe = lambda i: vis_at[np.clip(i, 0, max(0, len(vis_at) - 1))] if len(vis_at) else np.zeros(len(i), np.int64)
    last_byte = data[safe(v1 - 1)]
    fourth, fifth = data[safe(v1 - 4)], data[safe(v1 - 5)]
    end_tag = (last_byte == 62) & (fourth == 60) & (v1 - v0 > 7)  # as </p>
    last_byte = np.where(end_tag, fifth, last_byte)
    closer = np.isin(last_byte, list(b"\"')]")) & (v1 - v0 > 1) & ~end_tag
    last_byte = np.where(closer, data[safe(v1 - 2)], last_byte)
    # markup around a line (comment marks, paragraph tags) counts as neither code nor list mark
    head, second, third = data[safe(v0)], data[safe(v0 + 1)], data[safe(v0 + 2)]
    star = head == 42
    comment = (head == 35) | ((head == 47) & np.isin(second, [47, 42])) | ((head == 45) & (second == 45)) | star | ((head == 59) & (second == 59))
    start_tag = (head == 60) & (third == 62)  # as <p>
    digit_mark = (head >= 48) & (head <= 57) & (np.isin(second, list(b".)")) | ((second >= 48) & (second <= 57) & np.isin(third, list(b".)"))))
    bullet = (np.isin(head, list(b"-+")) & (second != head)) | star | (head == 91) | digit_mark
    marks = np.where(comment, np.where(star | (head == 35), 1, 2), 0)
    code = np.searchsorted(code_at, line_to) - np.searchsorted(code_at, line_at)
    code = np.maximum(0, code - np.where(comment, np.where(head == 45, 0, marks), 0) - 2 * start_tag - 3 * end_tag)
    last = np.where(some & _TERMINAL[last_byte], 2, np.where(some & _CLOSING[last_byte], 1, 0))
    lines = {
        "l_chars": span(chars_to), "l_seen": np.maximum(0, span(seen_to) - marks - 3 * start_tag - 4 * end_tag), "l_letters": span(letters_to),
        "l_words": words_before[1:] - words_before[:-1], "l_common": common_to[words_before[1:]] - common_to[words_before[:-1]],
        "l_code": code, "l_mark": (some & bullet).astype(np.int64), "l_last": last,
    }
    lines["l_seen"] = np.where(some, np.maximum(lines["l_seen"], 1), 0)
    # the document of each line, and sums over the lines that are closed on both sides inside the text
    has = np.flatnonzero(starts[1:] > starts[:-1])
    doc_line = np.searchsorted(line_at, starts[:-1][has])
    doc_to = np.append(doc_line[1:], len(line_at))
    inner = np.ones(len(line_at), bool)
    inner[doc_line] = inner[doc_to - 1] = False
    prose = _is_prose(*[lines[k] for k in LINE]) & inner
    add = lambda values: np.add.reduceat(np.asarray(values, np.int64), doc_line)
    byte_add = lambda cum: cum[starts[1:][has]] - cum[starts[:-1][has]]
    out["n_chars"][has], out["n_letters"][has], out["n_visible"][has] = byte_add(chars_to), byte_add(letters_to), byte_add(seen_to)
    sym_to = np.concatenate([[0], np.cumsum((kind & _SYMBOL) > 0)])
    out["n_symbols"][has] = byte_add(sym_to)
    out["n_words"][has], out["n_common"][has] = add(lines["l_words"]), add(lines["l_common"])
    out["n_lines"][has], out["n_closed"][has] = add(some & inner), add(some & inner & (last > 0))
    out["n_prose"][has] = add(np.where(prose, lines["l_chars"], 0))
    out["one_line"][has] = doc_to - doc_line == 1
    out["ended"][has] = (data[starts[1:][has] - 1] == 10) | (data[starts[1:][has] - 1] == 13)
    for k in LINE:
        out["h_" + k][has], out["t_" + k][has] = lines[k][doc_line], lines[k][doc_to - 1]
    # open words at the edges
    w0, w1 = np.searchsorted(word_at, starts[:-1]), np.searchsorted(word_at, starts[1:])
    for side, pick, open_ in (("a_", w0, lambda i, d: word_at[i] == starts[:-1][d]), ("z_", w1 - 1, lambda i, d: word_end[i] == starts[1:][d])):
        d = np.flatnonzero(w1 > w0)
        d = d[open_(pick[d], d)]
        i = pick[d]
        out[side + "len"][d], out[side + "chars"][d] = word_end[i] - word_at[i], letters_to[word_end[i]] - letters_to[word_at[i]]
        out[side + "hash"][d], out[side + "common"][d] = hashes[i], known[i]
    out["one_word"] = (out["a_len"] > 0) & (out["a_len"] == starts[1:] - starts[:-1])
    return out


def join(a: dict, b: dict, common: set[int]) -> dict:
    """The state of two neighbouring pieces of a text taken together; associative."""
    if not a["n_chars"]:
        return b
    if not b["n_chars"]:
        return a
    r = {k: a[k] + b[k] for k in SUMS}
    fix = 0
    left, right = {k: a["z_" + k] for k in EDGE}, {k: b["a_" + k] for k in EDGE}
    joined = None
    if left["len"] and right["len"]:
        h = (int(left["hash"]) + int(right["hash"]) * pow(int(_BASE), int(left["len"]), 1 << 64)) & (1 << 64) - 1
        joined = {"len": left["len"] + right["len"], "chars": left["chars"] + right["chars"], "hash": h, "common": int(h in common)}
        fix = joined["common"] - left["common"] - right["common"]
        r["n_words"] -= 1
        r["n_common"] += fix
    for k in EDGE:
        r["a_" + k] = joined[k] if joined and a["one_word"] else a["a_" + k]
        r["z_" + k] = joined[k] if joined and b["one_word"] else b["z_" + k]
    r["one_word"] = bool(a["one_word"] and b["one_word"])
    r["ended"] = b["ended"]
    if a["ended"]:  # a line ends at the seam: both lines beside it are whole there
        for p, side in (("t_", a), ("h_", b)):
            if not side["one_line"]:
                _close(r, {k: side[p + k] for k in LINE})
        r["one_line"] = False
        return r | {p + k: side[p + k] for p, side in (("h_", a), ("t_", b)) for k in LINE}
    # the line that runs over the seam
    seam = {k: a["t_" + k] + b["h_" + k] for k in LINE}
    seam["l_mark"] = a["t_l_mark"] if a["t_l_seen"] else b["h_l_mark"]
    seam["l_last"] = b["h_l_last"] if b["h_l_seen"] else a["t_l_last"]
    if joined:
        seam["l_words"] -= 1
        seam["l_common"] += fix
    r["one_line"] = bool(a["one_line"] and b["one_line"])
    for k in LINE:
        r["h_" + k] = seam[k] if a["one_line"] else a["h_" + k]
        r["t_" + k] = seam[k] if b["one_line"] else b["t_" + k]
    if not a["one_line"] and not b["one_line"]:
        _close(r, seam)
    return r


def _close(r: dict, line: dict) -> None:
    seen = line["l_seen"] > 0
    r["n_lines"] += int(seen)
    r["n_closed"] += int(seen and line["l_last"] > 0)
    r["n_prose"] += int(line["l_chars"] if _is_prose(*[np.int64(line[k]) for k in LINE]) else 0)


def _schema(id_kind: str) -> str:
    cols = [f"doc_id {id_kind}, block bigint, chunk bigint, chunks bigint, one_line boolean, one_word boolean, ended boolean"]
    cols += [f"{k} bigint" for k in (*SUMS, *("h_" + k for k in LINE), *("t_" + k for k in LINE), *(s + k for s in ("a_", "z_") for k in EDGE))]
    return ", ".join(cols)


MOST_WORDS = 100_000
"""Distinct common words, at most; a longer list is refused."""


def _hashes(words: DataFrame) -> tuple[np.ndarray, set[int]]:
    """Hashes of the common words: one fixed list of a few hundred rows."""
    listed = words.select("word").where("word is not null").distinct().limit(MOST_WORDS + 1).collect()
    if len(listed) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} common words")
    found = {word_hash(fold(r[0])) for r in listed}
    return np.array(sorted(found), np.uint64), found


def _cut(raw: np.ndarray, begin: int, end: int, size: int) -> list[int]:
    """Ends of the chunks of a text: multiples of ``size`` bytes, moved back to the beginning of a character."""
    cuts = []
    while end - begin > size:
        at = begin + size
        while at > begin + 1 and raw[at] & 0xC0 == 0x80:
            at -= 1
        cuts.append(at)
        begin = at
    return [*cuts, end]


def chunk_states(docs: DataFrame, words: DataFrame, chunk: int = CHUNK, table: np.ndarray | None = None, spread: int = SPREAD) -> DataFrame:
    """One row of partial counts for every chunk of every document.

    Chunks are cut inside the kernel, in one pass over a text.  Texts of up to ``spread`` characters are cut and
    measured where they are read; the chunks of longer ones are spread over tasks before they are measured.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    table = _hashes(words)[0] if table is None else table
    names = [c.strip().split()[0] for c in _schema(kind).split(",")]
    cut_schema = f"doc_id {kind}, chunk bigint, chunks bigint, text string"

    def cut(batches):
        for batch in batches:
            raw, ends = _text(batch.column(1))
            owner, no, total, edges = [], [], [], [ends[:1]]
            long = np.flatnonzero(np.diff(ends) > chunk)
            at = 0
            for i in [*long.tolist(), batch.num_rows]:  # texts of one chunk go in runs
                owner.append(np.arange(at, i))
                no.append(np.zeros(i - at, np.int64))
                total.append(np.ones(i - at, np.int64))
                edges.append(ends[at + 1 : i + 1])
                if i < batch.num_rows:
                    parts = _cut(raw, int(ends[i]), int(ends[i + 1]), chunk)
                    owner.append(np.full(len(parts), i))
                    no.append(np.arange(len(parts)))
                    total.append(np.full(len(parts), len(parts)))
                    edges.append(np.array(parts, np.int64))
                at = i + 1
            owner, no, total, edges = (np.concatenate(v) for v in (owner, no, total, edges))
            step = 1 << 10
            for lo in range(0, len(owner), step):
                hi = min(lo + step, len(owner))
                part = edges[lo : hi + 1]
                text = pa.Array.from_buffers(pa.string(), hi - lo, [None, pa.py_buffer((part - part[0]).astype(np.int32)), pa.py_buffer(raw[part[0] : part[-1]])])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[lo:hi])), pa.array(no[lo:hi]), pa.array(total[lo:hi]), text], ["doc_id", "chunk", "chunks", "text"])

    def count(batches):
        for batch in batches:
            raw, ends = _text(batch.column(3))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + _GROUP, "right")) - 1)
                got = measure(raw[ends[at] : ends[to]], ends[at : to + 1] - ends[at], table)
                part = batch.slice(at, to - at)
                chunk_no = part.column(1)
                got |= {"doc_id": part.column(0), "chunk": chunk_no, "block": np.asarray(chunk_no) // BLOCK, "chunks": part.column(2)}
                cols = [got[n] if isinstance(got[n], pa.Array) else pa.array(got[n].view(np.int64) if got[n].dtype == np.uint64 else got[n]) for n in names]
                yield pa.RecordBatch.from_arrays(cols, names)
                at = to

    texts = docs.selectExpr("doc_id", "coalesce(text, '') as text")
    here = texts.where(f"length(text) <= {spread}").mapInArrow(lambda batches: count(cut(batches)), _schema(kind))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    apart = texts.where(f"length(text) > {spread}").mapInArrow(cut, cut_schema).repartition(parts, "doc_id", "chunk").mapInArrow(count, _schema(kind))
    return here.unionByName(apart)


def _text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls and the ends of its values, the start of the first before them."""
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + column.offset + 1)[column.offset :].astype(np.int64)
    return (np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)), ends


def merged(states: DataFrame, keys: list[str], common: set[int]) -> DataFrame:
    """One tree level: the chunk states of each group of ``keys`` joined in order, in a stream over sorted rows."""
    names = states.columns
    hashes = ("a_hash", "z_hash")

    def run(batches):
        key, acc = None, None
        for b in batches:
            done = []
            for row in b.to_pylist():
                for h in hashes:
                    row[h] &= (1 << 64) - 1
                mine = tuple(row[k] for k in keys)
                if mine != key:
                    if acc is not None:
                        done.append(acc)
                    key, acc, last = mine, row, row["chunk"]
                elif row["chunk"] != last:  # a repeated row counts once
                    acc, last = join(acc, row, common) | {k: acc[k] for k in ("doc_id", "block", "chunk", "chunks")}, row["chunk"]
            if done:
                yield _batch(done, b.schema)
        if acc is not None:
            yield _batch([acc], b.schema)

    def _batch(rows, schema):
        for r in rows:
            for h in hashes:
                r[h] = int(r[h]) - (1 << 64) if int(r[h]) >> 63 else int(r[h])
        return pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], schema)

    parts = int(states.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return states.repartition(parts, *keys).sortWithinPartitions(*keys, "chunk").mapInArrow(run, states.schema)


def document_states(docs: DataFrame, words: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One state per document: single chunks pass through, others are merged by block and then by document."""
    table, common = _hashes(words)
    states = Scratch(docs.sparkSession, "quality").write(chunk_states(docs, words, chunk, table), "states")
    tree = merged(merged(states.where("chunks > 1"), ["doc_id", "block"], common), ["doc_id"], common)
    return states.where("chunks = 1").unionByName(tree)


def _line_rule(p: str) -> str:
    c = {k: f"{p}{k}" for k in LINE}
    return (
        f"({c['l_code']} * 25 <= {c['l_seen']} and {c['l_letters']} * 10 >= {c['l_seen']} * 7 and "
        f"(({c['l_words']} >= 7 and {c['l_common']} * 5 >= {c['l_words']} and not ({c['l_mark']} > 0 and {c['l_words']} < 9)) or "
        f"({c['l_words']} between 1 and 6 and {c['l_last']} = 2 and {c['l_mark']} = 0)))"
    )


def statistics(docs: DataFrame, words: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Counts, ratios and the verdict for every document."""
    edge = lambda what: f"({what.format(p='h_')} + case when one_line then 0 else {what.format(p='t_')} end)"
    lines = f"(n_lines + {edge('cast({p}l_seen > 0 as int)')})"
    closed = f"(n_closed + {edge('cast({p}l_seen > 0 and {p}l_last > 0 as int)')})"
    prose = f"(n_prose + case when {_line_rule('h_')} then h_l_chars else 0 end + case when not one_line and {_line_rule('t_')} then t_l_chars else 0 end)"
    return (
        document_states(docs, words, chunk)
        .selectExpr("doc_id", "n_chars", "n_words", "n_letters", "n_symbols", "n_visible", "n_common", f"{lines} as n_lines", f"{closed} as n_closed", f"{prose} as prose_chars")
        .selectExpr(
            "doc_id", "n_chars", "n_words", "n_lines",
            "case when n_words > 0 then n_letters / n_words else 0D end as mean_word_length",
            "case when n_visible > 0 then n_symbols / n_visible else 0D end as symbol_share",
            "case when n_lines > 0 then n_closed / n_lines else 0D end as closed_line_share",
            "case when n_words > 0 then n_common / n_words else 0D end as common_word_share",
            "case when n_chars > 0 then prose_chars / n_chars else 0D end as prose_share",
            "prose_chars * 2 > n_chars as is_prose",
        )
    )
