"""Removal of repeated passages of words, located by sharded Aho-Corasick automata.

A window is ``width`` consecutive words of one document. Every word that is covered by a window whose
words also start earlier goes: earlier is a smaller doc_id, or an earlier place in the same document.
Windows are judged on the input, not on what is left.

Recurring phrases are confirmed by counting (:mod:`tablewright.llm.passages`). A word is written as
one character, the top byte of its hash, and a phrase of eight words as eight characters, which are
also its 64-bit key. Each shard of documents compiles one automaton with pyahocorasick, from the
phrases that some document of the shard holds, and streams its documents through it: that finds every
occurrence of every phrase. A shard is bounded by its text, so automata are too, and no document is
streamed through an automaton that holds none of its phrases. What an automaton finds are places to
look at; contexts and windows there are then compared by hashes of whole words.

Defined results: a null or empty text has no words and nothing is removed; documents with fewer words
than a window stay whole; of rows with one doc_id the one with the smaller text hash is the earlier
document (see :func:`tablewright.llm.passages.numbered`); an empty table gives no rows. Columns other
than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablewright.llm.passages import Piece, Shape, context_rows, covered, find_repeats, pieces, rows_of, spans_by_row
from tablewright.llm.text_arrays import Words

PHRASE = 8


def read_words(texts: list[bytes], shape: Shape) -> Piece:
    words = Words(texts)
    hashes = words.hashes()
    grams = None
    if len(hashes) >= PHRASE:
        letters = hashes >> np.uint64(56)
        grams = np.zeros(len(hashes) - PHRASE + 1, np.uint64)
        for i in range(PHRASE):
            grams |= letters[i : len(letters) - PHRASE + 1 + i] << np.uint64(8 * i)
    piece = Piece(hashes, words.first, shape, grams)
    piece.words = words
    return piece


def phrase_places(automaton, hashes: np.ndarray) -> np.ndarray:
    """Word index at which a phrase of the automaton begins, for every occurrence."""
    stream = (hashes >> np.uint64(56)).astype(np.uint8).tobytes().decode("latin-1")
    return np.fromiter((end for end, _ in automaton.iter(stream)), np.int64) - (PHRASE - 1)


def compile_automaton(phrases: np.ndarray):
    """One automaton over 64-bit phrase keys."""
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    raw = phrases.astype("<i8").tobytes().decode("latin-1")
    for i in range(0, len(raw), PHRASE):
        automaton.add_word(raw[i : i + PHRASE])
    automaton.make_automaton()
    return automaton


def remove_repeats(docs: DataFrame, width: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: each document with what is left of it."""
    if width < PHRASE:
        raise ValueError(f"a window needs {PHRASE} words or more")
    shape = Shape(width, PHRASE)

    def locate(docs: pa.Table, phrases: np.ndarray, hot: np.ndarray, shape: Shape) -> pa.Table:
        out = [rows_of(k=np.zeros(0, np.int64))]
        if len(phrases):
            automaton = compile_automaton(phrases)
            for texts, rows in pieces(docs, shape.piece_bytes):
                piece = read_words(texts, shape)
                if not len(piece.run_anchor):
                    continue
                found = np.zeros(len(piece.code), bool)
                found[phrase_places(automaton, piece.code)] = True
                out.append(context_rows(piece, rows.column("_row").to_numpy(), np.flatnonzero(found[piece.run_anchor]), hot))
        return pa.concat_tables(out)

    def finish(docs: pa.Table, marks: pa.Table) -> pa.Table:
        spans = spans_by_row(marks)
        n_words, n_removed, kept = [], [], []
        for texts, rows in pieces(docs, shape.piece_bytes):
            words = Words(texts)
            raw = words.data.tobytes()
            for t, row in enumerate(rows.column("_row").to_pylist()):
                a, b = int(words.first[t]), int(words.first[t + 1])
                stays = ~covered(spans.get(row), b - a, width)
                starts, ends = words.start[a:b][stays].tolist(), words.end[a:b][stays].tolist()
                n_words.append(b - a)
                n_removed.append(b - a - len(starts))
                kept.append(b" ".join([raw[s:e] for s, e in zip(starts, ends)]))
        return pa.table(
            {"doc_id": docs.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())}
        )

    kind = dict(docs.dtypes)["doc_id"]
    return find_repeats(docs, read_words, shape, locate, finish, f"doc_id {kind}, n_words long, n_removed long, kept_text string")
