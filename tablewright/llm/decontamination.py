"""Benchmark decontamination by a prefix-filtered set join.

The join is between item windows and the places of documents. A *window* is ``width`` consecutive
words of a benchmark item; an item of fewer words, but not none, is one window. A window is the set
of its (word, place) shingles. A document place is a match if it holds all shingles of the window, so
containment is 1 and the *necessary prefix* of a window, with its shingles ordered by rarity, is its
rarest shingle alone: a place that lacks it cannot match.

* **Rarity** is the number of occurrences of a word in all documents (counted in one pass, benchmark
  words only), ties by hash.
* **Prefix join**: the word stream of the documents meets the windows on the hash of the rarest word.
  Windows that share a rarest word at the same place in the window are told apart by the hash of the
  whole window.
* **Length bound**: at least as many words as the window.
* **Positional bound**: the rarest word stands at place p of the window, so the match must begin p
  words earlier, within the same document.
* **Verification**: the words of the place and of the window are compared byte by byte.

Words are maximal runs of 0-9, a-z and non-ASCII characters after A-Z are lower-cased. Documents are
scanned where they lie and never shuffled. Windows are handed to the tasks in blocks of about
``block_windows`` windows, one pass over the documents for each block, so that what a task holds does
not grow with the benchmark; the hits of a document travel with it from pass to pass.

Defined results: a null or empty text has no words and is not contaminated; a null or empty item has
no windows; items that repeat are found under each of their ids; an empty benchmark leaves all
documents clean. Columns other than the named ones are carried along untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.graph import small_batches
from tablewright.llm.text_arrays import NON_ALNUM, Words, in_pieces, texts_of
from tablewright.session import scratch_path


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """item_id, words array<binary>: each window of each item, once per item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for item, text in zip(batch.column("item_id").to_pylist(), texts_of(batch.column("text"))):
                words = words_of(text)
                spans = range(max(1, len(words) - width + 1)) if words else ()
                seen = {tuple(words[i : i + width]) for i in spans}
                ids += [item] * len(seen)
                rows += [list(w) for w in seen]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(rows, pa.list_(pa.binary()))], ["item_id", "words"])

    named = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return named.mapInArrow(run, "item_id string, words array<binary>")


def words_of(text: bytes) -> list[bytes]:
    words = Words([text], NON_ALNUM, lower=True)
    raw = words.data.tobytes()
    return [raw[s:e] for s, e in zip(words.start.tolist(), words.end.tolist())]


class WindowBlock:
    """Some windows, ready to be met with words: the rarest word of each is its prefix."""

    def __init__(self, windows: list[tuple[tuple[bytes, ...], tuple[str, ...]]], counts: dict[bytes, int]):
        self.windows = [w for w, _ in windows]
        self.items = [i for _, i in windows]
        vocabulary = sorted({word for w in self.windows for word in w})
        hashes = dict(zip(vocabulary, Words([b" ".join(vocabulary)], NON_ALNUM).hashes().tolist()))
        places = [min(range(len(w)), key=lambda i: (counts.get(w[i], 0), hashes[w[i]], i)) for w in self.windows]
        prefix = np.array([hashes[w[p]] for w, p in zip(self.windows, places)], np.uint64)
        order = np.argsort(prefix, kind="stable")
        self.windows = [self.windows[i] for i in order]
        self.items = [self.items[i] for i in order]
        self.place = np.array(places, np.int64)[order]
        self.length = np.array([len(w) for w in self.windows], np.int64)
        self.prefix, self.first, self.count = np.unique(prefix[order], return_index=True, return_counts=True)
        self.whole = np.array([_sequence_hash(np.array([hashes[x] for x in w], np.uint64)) for w in self.windows], np.uint64)

    def matches(self, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word index at which a window begins, and the window, for every match in the texts."""
        if not len(self.windows) or not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.prefix, hashes), len(self.prefix) - 1)
        found = np.flatnonzero(self.prefix[at] == hashes)
        group = at[found]
        times = self.count[group]
        token = np.repeat(found, times)
        ends = np.cumsum(times)
        window = np.repeat(self.first[group] - (ends - times), times) + np.arange(int(ends[-1]) if len(ends) else 0)
        text = np.searchsorted(words.first, token, "right") - 1
        begin = token - self.place[window]
        fits = (begin >= words.first[text]) & (begin + self.length[window] <= words.first[text + 1])
        begin, window = begin[fits], window[fits]
        starts, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for length in np.unique(self.length[window]):
            of = self.length[window] == length
            b, w = begin[of], window[of]
            same = np.ones(len(b), bool)
            value = np.zeros(len(b), np.uint64)
            for i in range(length):
                value = _step(value, hashes[b + i])
            same = value == self.whole[w]
            starts.append(b[same])
            windows.append(w[same])
        begin, window = np.concatenate(starts), np.concatenate(windows)
        raw = words.data
        exact = [
            all(
                raw[words.start[b + i] : words.end[b + i]].tobytes() == x
                for i, x in enumerate(self.windows[w])
            )
            for b, w in zip(begin.tolist(), window.tolist())
        ]
        return begin[exact] if len(exact) else begin, window[exact] if len(exact) else window


def _step(value: np.ndarray, word: np.ndarray) -> np.ndarray:
    value = (value ^ word) * np.uint64(0x9E3779B97F4A7C15)
    return value ^ (value >> np.uint64(29))


def _sequence_hash(words: np.ndarray) -> np.uint64:
    value = np.zeros(1, np.uint64)
    for word in words:
        value = _step(value, np.array([word], np.uint64))
    return value[0]


def word_counts(docs: DataFrame, vocabulary: list[bytes]) -> dict[bytes, int]:
    """Occurrences in all documents of the words of ``vocabulary``."""
    if not vocabulary:
        return {}
    ordered = sorted(set(vocabulary))
    wanted = Words([b" ".join(ordered)], NON_ALNUM).hashes()
    order = np.argsort(wanted)
    shared = docs.sparkSession.sparkContext.broadcast(wanted[order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        total = np.zeros(len(keys), np.int64)
        for piece in in_pieces(batches):
            found = Words(texts_of(piece.column("text")), NON_ALNUM, lower=True).hashes()
            at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            total += np.bincount(at[keys[at] == found], minlength=len(keys))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {ordered[order[r["word"]]]: r["n"] for r in rows}


STATE = "_n_words long, _spans binary, _items array<string>"


def _fields(df: DataFrame) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]


def _scan(docs: DataFrame, block: WindowBlock) -> DataFrame:
    """Documents with the word spans that the block's windows hit and the items, added to earlier ones."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for piece in in_pieces(batches):
            words = Words(texts_of(piece.column("text")), NON_ALNUM, lower=True)
            begin, window = block.matches(words, words.hashes())
            text = np.searchsorted(words.first, begin, "right") - 1
            spans, items = piece.column("_spans").to_pylist(), piece.column("_items").to_pylist()
            for t in np.unique(text):
                of = text == t
                start = begin[of] - words.first[t]
                pairs = np.unique(np.stack([start, start + block.length[window[of]]], axis=1), axis=0)
                spans[t] += pairs.astype("<i8").tobytes()
                items[t] = sorted({*items[t], *(i for w in np.unique(window[of]).tolist() for i in block.items[w])})
            made = {
                "_n_words": pa.array(np.diff(words.first), pa.int64()),
                "_spans": pa.array(spans, pa.binary()),
                "_items": pa.array(items, pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_arrays([made.get(n, piece.column(n)) for n in names], names)

    return docs.mapInArrow(run, ", ".join(_fields(docs)))


def _judge(hits: DataFrame, min_share: tuple[int, int]) -> DataFrame:
    """State columns to n_words, n_hit, n_items, items_sha256, contaminated; the text goes."""
    names = [n for n in hits.columns if n not in ("text", "_spans", "_items", "_n_words")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit, digests = [], []
            all_items = batch.column("_items").to_pylist()
            for spans, items in zip(batch.column("_spans").to_pylist(), all_items):
                pairs = np.frombuffer(spans, "<i8").reshape(-1, 2)
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                reach = np.concatenate([[0], np.maximum.accumulate(pairs[:, 1])[:-1]]) if len(pairs) else pairs[:, 1]
                n_hit.append(int(np.maximum(pairs[:, 1] - np.maximum(pairs[:, 0], reach), 0).sum()))
                digests.append(hashlib.sha256(",".join(items).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n) for n in names),
                    batch.column("_n_words"),
                    pa.array(n_hit, pa.int64()),
                    pa.array(list(map(len, all_items)), pa.int64()),
                    pa.array(digests, pa.string()),
                ],
                [*names, "n_words", "n_hit", "n_items", "items_sha256"],
            )

    made = "n_words long, n_hit long, n_items long, items_sha256 string"
    judged = hits.drop("text").mapInArrow(run, ", ".join([*_fields(hits.select(*names)), made]))
    return judged.withColumn("contaminated", _verdict(F.col("n_hit"), F.col("n_words"), min_share))


def _verdict(n_hit: Column, n_words: Column, min_share: tuple[int, int]) -> Column:
    part, whole = min_share
    return (n_hit > 0) & (whole * n_hit >= part * n_words)


def _hits(docs: DataFrame, benchmark: DataFrame, width: int, block_windows: int) -> DataFrame:
    small_batches(docs.sparkSession)
    marked = docs.withColumns(
        {"_n_words": F.lit(0).cast("long"), "_spans": F.lit(b""), "_items": F.array().cast("array<string>")}
    )
    for block in window_blocks(docs, benchmark, width, block_windows):
        marked = _scan(marked, block)
    return marked


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 13,
    min_share: tuple[int, int] = (1, 20),
    block_windows: int = 200_000,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in an occurrence of a window. A document is contaminated if it has hit
    words and they are at least ``min_share`` (a fraction) of its words. ``items_sha256`` is taken of
    the ids of the items that occur, sorted as strings and joined by commas.
    """
    return _judge(_hits(docs.select("doc_id", "text"), benchmark, width, block_windows), min_share)


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 13,
    min_share: tuple[int, int] = (1, 20),
    block_windows: int = 200_000,
) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    names = docs.columns
    safe = docs.select(*(F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)), "text")
    judged = _judge(_hits(safe, benchmark, width, block_windows), min_share)
    return judged.where("NOT contaminated").select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))


def window_blocks(docs: DataFrame, benchmark: DataFrame, width: int, block_windows: int) -> Iterator[WindowBlock]:
    """All distinct windows with their items, in blocks; at least one block, which may be empty."""
    windows = (
        item_windows(benchmark, width)
        .groupBy("words")
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"))
        .withColumn("key", F.xxhash64("words"))
    )
    path = scratch_path(docs.sparkSession, "windows")
    windows.write.parquet(path)
    stored = docs.sparkSession.read.schema(windows.schema).parquet(path)
    n = max(1, -(-stored.count() // block_windows))
    for i in range(n):
        rows = stored.where(F.pmod("key", F.lit(n)) == i).select("words", "items").toLocalIterator()
        held = [(tuple(bytes(x) for x in r["words"]), tuple(r["items"])) for r in rows]
        counts = word_counts(docs, [x for w, _ in held for x in w])
        yield WindowBlock(held, counts)
