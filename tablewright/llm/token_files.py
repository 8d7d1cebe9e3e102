"""Token ids in fixed-width bit-packed files.

An id takes the fewest bits that the vocabulary needs. A *segment* holds the ids of some consecutive
documents, cut into blocks of :data:`BLOCK_IDS` ids. A block starts on a byte (4,096 ids of any width
fill whole bytes) and its byte offset is stored, so numpy unpacks a block without touching the ones
before it, and any span of ids needs only the blocks that it meets.

On disk a segment is one row of a Parquet table, so that any store that Spark can write will do:

===============  ==============================================================
column           holds
===============  ==============================================================
shard, segment   place in the order: shards by range of doc_id, segments within
bits, n_ids      width of an id, ids in the segment
doc_ids          doc_id of each document (null kept), in file order
n_tokens         ids of each document, end id included
block_offsets    byte offset of each block in ``payload``, little-endian uint64
payload          the packed ids, least significant bit first
===============  ==============================================================

Rows are in ascending doc_id order (null first, rows with one doc_id by the hash of their text).
A null text is an empty text; an empty text has the end id alone. An empty table gives an empty file.
Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm.graph import small_batches
from tablewright.llm.text_arrays import Words, in_pieces, texts_of

BLOCK_IDS = 4096
PIECE_BYTES = 4 << 20
MARK = "\x02"

SEGMENT = (
    "shard int, segment int, bits int, n_ids bigint, doc_ids array<bigint>, n_tokens array<bigint>, "
    "block_offsets binary, payload binary"
)


def bits_for(vocabulary: int) -> int:
    """Bits that hold the ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> tuple[np.ndarray, bytes]:
    """Block offsets and payload of ``ids``."""
    offsets = np.arange(0, len(ids), BLOCK_IDS, dtype=np.uint64) * np.uint64(bits) // np.uint64(8)
    if bits in (8, 16, 32):
        return offsets, ids.astype(f"<u{bits // 8}").tobytes()
    parts = []
    for i in range(0, len(ids), BLOCK_IDS):
        block = ids[i : i + BLOCK_IDS].astype("<u4")
        columns = np.unpackbits(block.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
        parts.append(np.packbits(columns.reshape(-1), bitorder="little").tobytes())
    return offsets, b"".join(parts)


def unpack_block(payload, offset: int, count: int, bits: int) -> np.ndarray:
    """The ``count`` ids of the block at byte ``offset``."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", count, offset).astype(np.uint32)
    raw = np.frombuffer(payload, np.uint8, (count * bits + 7) // 8, offset)
    columns = np.unpackbits(raw, bitorder="little")[: count * bits].reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = columns
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1).astype(np.uint32)


def unpack(payload, offsets: np.ndarray, n_ids: int, bits: int, start: int = 0, end: int | None = None) -> np.ndarray:
    """Ids ``start:end`` of a segment, from the blocks they lie in only."""
    end = n_ids if end is None else min(end, n_ids)
    if start >= end:
        return np.zeros(0, np.uint32)
    first, last = start // BLOCK_IDS, (end - 1) // BLOCK_IDS
    blocks = [
        unpack_block(payload, int(offsets[b]), min(BLOCK_IDS, n_ids - b * BLOCK_IDS), bits)
        for b in range(first, last + 1)
    ]
    found = np.concatenate(blocks) if len(blocks) > 1 else blocks[0]
    return found[start - first * BLOCK_IDS : end - first * BLOCK_IDS]


class TextEncoder:
    """Whole texts to ids with a file of the ``tokenizers`` library.

    ``separable`` tells that the vocabulary's pre-tokenizer drops blanks and cuts between letters and
    marks. Then each distinct word is encoded once and its ids are gathered, which gives the ids of
    the whole text; a final full stop or comma after an ASCII letter counts as a word of its own.
    New words go to the tokenizer by the hundred, with a mark between them that is a token of its own.
    At most ``kept_words`` words are remembered; a full memory is emptied.
    """

    def __init__(self, path: str, separable: bool = True, kept_words: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.separable, self.kept_words = Tokenizer.from_file(path), separable, kept_words
        self.vocabulary = self.tokenizer.get_vocab_size()
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if separable and len(mark) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.chunks: list[np.ndarray] = []
        self.lengths = np.zeros(0, np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(lengths.sum())), lengths

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, as many at a time as make the calls cheap."""
        texts = [w.decode("utf-8", "replace") for w in words]
        if self.mark is None or any(MARK in t for t in texts):
            return self._encode(texts)
        joined = [f" {MARK} ".join(texts[i : i + 200]) + f" {MARK}" for i in range(0, len(texts), 200)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        marks = np.flatnonzero(ids == self.mark)
        if len(marks) != len(texts):  # the mark's id is also part of a word
            return self._encode(texts)
        return np.delete(ids, marks), np.diff(marks, prepend=-1) - 1

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the number of ids of each text."""
        if not self.separable:
            return self._encode([t.decode("utf-8", "replace") for t in texts])
        words = Words(texts)
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        data, start, end = words.data, words.start, words.end
        last, before = data[end - 1], data[np.maximum(end - 2, 0)] | 0x20
        marked = (end - start > 1) & ((last == 0x2E) | (last == 0x2C)) & (before >= 0x61) & (before <= 0x7A)
        times = 1 + marked.astype(np.int64)
        at = np.cumsum(times)
        cut_start, cut_end = np.repeat(start, times), np.repeat(end, times)
        tail = at[marked] - 1
        cut_start[tail] = cut_end[tail] - 1
        cut_end[tail - 1] -= 1
        words.start, words.end = cut_start, cut_end
        first = np.concatenate([[0], at])[words.first]
        _, sample, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        raw = data.tobytes()
        distinct = [raw[s:e] for s, e in zip(cut_start[sample].tolist(), cut_end[sample].tolist())]
        if len(self.place) > self.kept_words:
            self._forget()
        place = self.place
        new = [w for w in distinct if w not in place]
        if new:
            ids, lengths = self._encode_words(new)
            place.update(zip(new, range(len(place), len(place) + len(new))))
            self.chunks.append(ids)
            self.lengths = np.concatenate([self.lengths, lengths])
        if len(self.chunks) > 1:
            self.chunks = [np.concatenate(self.chunks)]
        pool, ends = self.chunks[0], np.cumsum(self.lengths)
        row = np.fromiter(map(place.__getitem__, distinct), np.int64, len(distinct))[which]
        lengths = self.lengths[row]
        stop = np.cumsum(lengths)
        source = np.repeat(ends[row] - lengths - (stop - lengths), lengths) + np.arange(int(stop[-1]))
        total = np.concatenate([[0], stop])[first]
        return pool[source], np.diff(total)


_encoders: dict[tuple, TextEncoder] = {}


def encoder(path: str, separable: bool = True) -> TextEncoder:
    """One encoder per Python worker."""
    key = (path, separable)
    if key not in _encoders:
        _encoders[key] = TextEncoder(path, separable)
    return _encoders[key]


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's ids followed by ``end_id``."""
    stops = np.cumsum(lengths)
    return np.insert(ids, stops, end_id), lengths + 1


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, separable: bool = True, shards: int | None = None
) -> None:
    """Encode ``docs`` (doc_id, text) and write segments in ascending doc_id order under ``path``.

    Documents are dealt to shards by range of (doc_id, text hash) and sorted within; a shard is read
    and written in pieces of about 4 MB of text, whatever its size.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    small_batches(docs.sparkSession)
    order = ["doc_id", "tie"]
    dealt = keyed.repartitionByRange(shards, *order) if shards else keyed.repartitionByRange(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(tokenizer, separable)
        bits = bits_for(max(encode.vocabulary, end_id + 1))
        shard = TaskContext.get().partitionId()
        for segment, piece in enumerate(in_pieces(batches, limit=PIECE_BYTES)):
            ids, lengths = with_end(*encode(texts_of(piece.column("text"))), end_id)
            offsets, payload = pack(ids, bits)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([segment], pa.int32()),
                    pa.array([bits], pa.int32()),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([piece.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([offsets.astype("<u8").tobytes()], pa.binary()),
                    pa.array([payload], pa.binary()),
                ],
                ["shard", "segment", "bits", "n_ids", "doc_ids", "n_tokens", "block_offsets", "payload"],
            )

    segments = dealt.sortWithinPartitions(*order).mapInArrow(run, SEGMENT)
    segments.write.mode("errorifexists").option("compression", "uncompressed").parquet(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32, shard, segment.

    ``start`` counts the ids of all documents before it. ``ids_crc32`` is taken from the unpacked
    ids as little-endian unsigned 32-bit integers. Bases come from two sums: over the segments of a
    shard, and over one row per shard.
    """
    files = spark.read.schema(SEGMENT).parquet(path)
    within = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = files.select("shard", "segment", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    base = shards.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("shard_base"))
    bases = (
        sizes.withColumn("segment_base", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
        .join(base, "shard")
        .select("shard", "segment", (F.col("shard_base") + F.col("segment_base")).alias("base"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                lengths = np.array(row["n_tokens"].as_py(), np.int64)
                n_ids, bits = row["n_ids"].as_py(), row["bits"].as_py()
                offsets = np.frombuffer(row["block_offsets"].as_py(), "<u8")
                raw = unpack(row["payload"].as_buffer(), offsets, n_ids, bits).astype("<u4").tobytes()
                stops = np.cumsum(lengths)
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(stops.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        row["doc_ids"].values,
                        pa.array(stops - lengths, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(crcs, pa.int64()),
                        pa.array([row["shard"].as_py()] * len(lengths), pa.int32()),
                        pa.array([row["segment"].as_py()] * len(lengths), pa.int32()),
                    ],
                    ["doc_id", "local", "n_tokens", "ids_crc32", "shard", "segment"],
                )

    rows = files.mapInArrow(
        run, "doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint, shard int, segment int"
    )
    return rows.join(bases, ["shard", "segment"]).select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "shard", "segment"
    )


def read_documents(spark: SparkSession, path: str, doc_ids: DataFrame) -> DataFrame:
    """The ids of some documents, from the blocks that hold them: doc_id, ids array<int>."""
    files = spark.read.schema(SEGMENT).parquet(path)
    wanted = (
        files.select("shard", "segment", F.posexplode("doc_ids").alias("place", "doc_id"))
        .join(doc_ids.select("doc_id").distinct(), "doc_id")
        .groupBy("shard", "segment")
        .agg(F.collect_list("place").alias("places"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                stops = np.cumsum(np.array(row["n_tokens"], np.int64))
                offsets = np.frombuffer(row["block_offsets"], "<u8")
                found = [
                    unpack(row["payload"], offsets, row["n_ids"], row["bits"], int(stops[p]) - row["n_tokens"][p], int(stops[p]))
                    for p in row["places"]
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["doc_ids"][p] for p in row["places"]], pa.int64()),
                        pa.array([f.astype(np.int32) for f in found], pa.list_(pa.int32())),
                    ],
                    ["doc_id", "ids"],
                )

    return files.join(wanted, ["shard", "segment"]).mapInArrow(run, "doc_id bigint, ids array<int>")
