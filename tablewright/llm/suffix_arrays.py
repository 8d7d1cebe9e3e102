"""Removal of repeated byte strings, found by suffix arrays of shards.

Every byte that is covered by a string of ``width`` bytes which also starts in a document with a
smaller doc_id goes. Matches never cross documents; strings are judged on the input.

Only text that may repeat enters a suffix array: windows whose phrase recurs in the corpus
(:mod:`tablewright.llm.passages`). In each shard that text is sorted in blocks of ``BLOCK_BYTES``:

* **Suffix array** by Larsson-Sadakane refinement in numpy: suffixes are ranked by their first eight
  bytes, then ranks at distance 8, 16, 32, ... refine the groups that still hold several suffixes,
  until ``width`` bytes are compared. Sorted suffixes are not touched again.
* **Common prefixes** of neighbours in that order, eight bytes at a time and many neighbours together; as
  no more than the sorted bytes are compared, this takes a bounded number of steps.

Windows that share ``width`` bytes are neighbours in the suffix array, so all but the first of them
are known repeats within the block. No suffix array crosses a block: what is first in its
block is resolved across blocks and shards by fingerprints, contexts and windows dealt out by hash and
compared by their hashes (steps 3 and 4 of :mod:`tablewright.llm.passages`). Sorted suffixes are not
merged by key ranges.

A document may repeat itself: a string that starts earlier in the same document only does not count,
so windows whose earlier copies all lie in the same document stay.

Defined results: a null or empty text has 0 bytes; texts shorter than ``width`` stay whole; of rows
with one doc_id the one with the smaller text hash is the earlier document; an empty table gives no
rows. Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablewright.llm.passages import (
    REPEAT,
    Piece,
    Shape,
    context_rows,
    covered,
    find_repeats,
    pieces,
    rows_of,
    spans_by_row,
)
from tablewright.llm.text_arrays import byte_codes

PHRASE = 16
BLOCK_BYTES = 1 << 20
# From these numbers on, one byte more is not zero.
BYTE_STEPS = np.array([1 << 8 * i for i in range(1, 8)], np.uint64)


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number; zeros stand after the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for i in range(8):
        out |= padded[i : i + len(data)] << np.uint64(56 - 8 * i)
    return out


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` bytes or more; ``words`` from :func:`eight_bytes`."""
    n = len(words)
    order = np.argsort(words).astype(np.int32)
    sorted_words = words[order]
    new = np.ones(n, bool)
    new[1:] = sorted_words[1:] != sorted_words[:-1]
    del sorted_words
    slots = np.arange(n, dtype=np.int32)
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, slots, 0))
    bits = n.bit_length() + 1
    reach = 8
    while reach < depth:
        alone = new & np.append(new[1:], True)
        open_slots = np.flatnonzero(~alone)
        if not len(open_slots):
            break
        at = order[open_slots]
        further = rank[np.minimum(at + reach, n)] + 1
        if 3 * bits <= 63:
            # Both ranks and the place in one number are sorted faster than by their order.
            key = np.sort(((rank[at].astype(np.int64) << bits) + further << bits) + at)
            at, key = (key & ((1 << bits) - 1)).astype(np.int32), key >> bits
        else:
            key = (rank[at].astype(np.int64) << 32) + further
            refined = np.argsort(key)
            at, key = at[refined], key[refined]
        order[open_slots] = at
        starts = np.ones(len(at), bool)
        starts[1:] = key[1:] != key[:-1]
        new[open_slots] = starts
        rank[at] = np.maximum.accumulate(np.where(starts, open_slots, 0))
        reach *= 2
    return order


def common_prefixes(words: np.ndarray, order: np.ndarray, most: int, lanes: int = 1 << 16) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in ``order``, up to ``most``; ``lanes`` suffixes at
    a time."""
    n = len(words)
    shared = np.zeros(n, np.int32)
    for begin in range(1, n, lanes):
        i, j = order[begin : begin + lanes], order[begin - 1 : min(begin + lanes, n) - 1]
        limit = np.minimum(most, n - np.maximum(i, j)).astype(np.int32)
        out, live, reach = limit.copy(), np.arange(len(i)), 0
        while len(live):
            differ = words[i + reach] ^ words[j + reach]
            alike = differ == 0
            ended = np.flatnonzero(~alike)
            equal = reach + 7 - np.searchsorted(BYTE_STEPS, differ[ended], side="right")
            out[live[ended]] = np.minimum(equal, limit[ended])
            reach += 8
            going = np.flatnonzero(alike & (limit > reach))
            live, i, j, limit = live[going], i[going], j[going], limit[going]
        shared[begin : begin + lanes] = out
    return shared


def equal_windows(data: np.ndarray, width: int) -> np.ndarray:
    """A class number for each place: places with the same next ``width`` bytes have the same one."""
    words = eight_bytes(data)
    depth = max(8, 1 << (width - 1).bit_length())
    order = suffix_array(words, depth)
    classes = np.empty(len(data), np.int32)
    classes[order] = np.cumsum(common_prefixes(words, order, width) < width, dtype=np.int32)
    return classes


def read_bytes(texts: list[bytes], shape: Shape) -> Piece:
    piece_data = np.frombuffer(b"".join(texts), np.uint8)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    piece = Piece(byte_codes(piece_data), first, shape)
    piece.data = piece_data
    return piece


class Block:
    """Text of a shard that may repeat, as much as one suffix array takes."""

    def __init__(self, width: int):
        self.width, self.size = width, 0
        self.data: list[np.ndarray] = []
        self.place: list[np.ndarray] = []
        self.row: list[np.ndarray] = []
        self.pos: list[np.ndarray] = []
        self.runs: list[np.ndarray] = []
        self.contexts: list[pa.Table] = []

    def add(self, piece: Piece, rows: np.ndarray, chosen: np.ndarray, contexts: pa.Table) -> None:
        begin, n = piece.run_first[chosen], piece.run_last[chosen] - piece.run_first[chosen] + 1
        change = np.zeros(len(piece.data) + 1, np.int32)
        np.add.at(change, begin, 1)
        np.add.at(change, begin + n - 1 + self.width, -1)
        inside = np.cumsum(change[:-1]) > 0
        rank = np.cumsum(inside, dtype=np.int32) - 1
        ends = np.cumsum(n)
        window = np.arange(int(ends[-1])) - np.repeat(ends - n, n) + np.repeat(begin, n)
        text = np.repeat(piece.run_text[chosen], n)
        self.data.append(piece.data[inside])
        self.place.append((rank[window] + self.size).astype(np.int32))
        self.row.append(rows[text])
        self.pos.append((window - piece.first[text]).astype(np.int32))
        self.runs.append(n)
        self.contexts.append(contexts)
        self.size += int(inside.sum())

    def results(self) -> list[pa.Table]:
        """Repeats within the block, and the contexts that hold anything else."""
        if not self.size:
            return []
        classes = equal_windows(np.concatenate(self.data), self.width)[np.concatenate(self.place)]
        row, pos, n = np.concatenate(self.row), np.concatenate(self.pos), np.concatenate(self.runs)
        # Rows ascend, so the first window of a class stands in its smallest row.
        first = np.empty(int(classes.max()) + 1, np.int64)
        first[classes[::-1]] = np.arange(len(classes))[::-1]
        repeat = row > row[first[classes]]
        at = np.flatnonzero(repeat)
        begin = np.ones(len(at), bool)
        begin[1:] = (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]]) | (pos[at[1:]] != pos[at[:-1]] + 1)
        starts = np.flatnonzero(begin)
        marks = rows_of(
            k=row[at[starts]],
            row=row[at[starts]],
            pos=pos[at[starts]],
            n=np.diff(np.append(starts, len(at))),
            kind=np.full(len(starts), REPEAT),
        )
        known = np.add.reduceat(repeat.astype(np.int64), np.cumsum(n) - n)
        return [marks, pa.concat_tables(self.contexts).filter(pa.array(known < n))]


def remove_repeated_bytes(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_bytes: each document with what is left of it.

    ``n_spans`` counts the maximal runs of removed bytes.
    """
    if width < PHRASE:
        raise ValueError(f"a window needs {PHRASE} bytes or more")
    shape = Shape(width, PHRASE, within=False, piece_bytes=1 << 17, bits=60, bytes=True)

    def locate(docs: pa.Table, phrases: np.ndarray, hot: np.ndarray, shape: Shape) -> pa.Table:
        out, block = [rows_of(k=np.zeros(0, np.int64))], Block(width)
        for texts, rows in pieces(docs, shape.piece_bytes) if len(phrases) else ():
            piece = read_bytes(texts, shape)
            if not len(piece.run_anchor):
                continue
            named = piece.phrases()
            at = np.minimum(np.searchsorted(phrases, named), len(phrases) - 1)
            chosen = np.flatnonzero(phrases[at] == named)
            if not len(chosen):
                continue
            keys = rows.column("_row").to_numpy()
            block.add(piece, keys, chosen, context_rows(piece, keys, chosen, hot))
            if block.size >= BLOCK_BYTES:
                out += block.results()
                block = Block(width)
        return pa.concat_tables(out + block.results())

    def finish(docs: pa.Table, marks: pa.Table) -> pa.Table:
        spans = spans_by_row(marks)
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for text, row in zip(docs.column("text").cast(pa.binary()).to_pylist(), docs.column("_row").to_pylist()):
            text = text or b""
            n_bytes.append(len(text))
            if row not in spans:
                n_removed.append(0)
                n_spans.append(0)
                kept.append(text)
                continue
            goes = covered(spans[row], len(text), width)
            n_removed.append(int(goes.sum()))
            n_spans.append(int(goes[0]) + int((goes[1:] & ~goes[:-1]).sum()))
            kept.append(np.frombuffer(text, np.uint8)[~goes].tobytes())
        names = {"n_bytes": n_bytes, "n_removed": n_removed, "n_spans": n_spans}
        return pa.table(
            {"doc_id": docs.column("doc_id"), **{k: pa.array(v, pa.int64()) for k, v in names.items()}, "kept_bytes": pa.array(kept, pa.binary())}
        )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_bytes binary"
    return find_repeats(docs, read_bytes, shape, locate, finish, schema)
