"""Recurring passages of whole corpora, found and resolved without listing pairs.

Symbols are words or bytes. A *window* is ``width`` consecutive symbols of one document; windows are
compared by their symbols. The result wanted is: every window whose symbols also start earlier (in a
document with a smaller key, or earlier in the same one). The steps, each one shuffle:

1. **Anchors.** Every window names its *anchor*, the phrase of ``phrase`` symbols in it with the
   smallest hash (the last one of equals). Equal windows name equal phrases, and neighbouring windows
   mostly share an anchor, so there are few: about two for every ``width - phrase + 2`` symbols.
   Phrases named twice or more are recurring.
2. **Locating.** Recurring phrases go to the shards of documents that hold them, and each shard looks
   for them in its texts (this is what differs between methods). The windows that name one anchor are
   a *context*: one row for several windows.
3. **Contexts.** A context that occurred earlier is a repeat, whole. Equal windows hold their phrase at
   the same place, so the windows of a first context come in :data:`PARTS` parts by that place. A part
   is compared window by window, but only if another context of the phrase agrees with it in all that the
   windows of the part have in common.
4. **Windows.** Those windows are grouped by hash, and all but the first are repeats (the first, and
   with ``within`` off all others in its document). Where symbols are bytes (``beside``), a part travels as
   one row instead: the hash of what its windows have in common and the bytes on either side of that,
   from which each window is compared with those of the same place. Parts of hot phrases and of contexts
   that are not all in sight are still dealt out window by window.

Documents are shuffled to their shards once, compressed; Spark uses that exchange again for each step that
needs the texts. Anchors whose hash fits into one long travel sorted, as differences. Phrases that a bounded sample finds in many documents are *hot*: they are recurring by
that, and their rows are salted in steps 1, 3 and 4, so no key gathers a large part of the rows in
one task. The sample decides on salting only, never on a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.graph import small_batches, stored
from tablewright.llm.text_arrays import give_back, gram_hash, keep_freed, mix, prefix_hash, span_hash, texts_of

SHARD_BYTES = 16 << 20
SALTS = 256
SAMPLE_ROWS, HOT_SHARE = 4000, 100
MOST_HELD = 500_000
# A CONTEXT row packs its number of windows, the place of its phrase and a hash of each part into one long.
SIDES, PARTS = 1 << 10, 4

HELD_KEYS, HELD_ROWS = 1 << 20, 100_000

# kind of a row: windows to be compared, windows known to be repeats, contexts to be compared, windows of a part.
WINDOW, REPEAT, CONTEXT, PART = 0, 1, 2, 3
ROW = "k long, salt int, row long, pos int, n long, kind int, c long"
ROW_NAMES = [x.split()[0] for x in ROW.split(", ")]
# A PART row has the bytes beside what its windows share; n packs the number of its windows, the number of the
# first among those that the part can hold, and how many bytes more than the shared ones they span.
SIDE_ROW = ROW + ", before long, after long"
MOST_BESIDE = 8


@dataclass(frozen=True)
class Shape:
    """Symbols of a window and of a phrase; whether an earlier place in the same document counts; the
    bytes of text worked on at a time; the bits that are kept of a phrase's hash; and whether symbols are
    bytes that may travel beside what windows share."""

    width: int
    phrase: int
    within: bool = True
    piece_bytes: int = 2 << 20
    bits: int = 64
    bytes: bool = False

    @property
    def beside(self) -> bool:
        return self.bytes and not self.within and all(high - low <= MOST_BESIDE for low, high in self.parts())

    def parts(self) -> list[tuple[int, int]]:
        """The places a phrase can have in a window, as ranges (first, last)."""
        places = self.width - self.phrase + 1
        cuts = [places * i // PARTS for i in range(PARTS + 1)]
        return [(a, b - 1) for a, b in zip(cuts, cuts[1:])]


class Piece:
    """Texts as symbols: ``code`` has a hash per symbol, ``first`` where each text's symbols begin."""

    def __init__(self, code: np.ndarray, first: np.ndarray, shape: Shape, grams: np.ndarray | None = None):
        self.code, self.first, self.shape = code, first, shape
        self.prefix = prefix_hash(code)
        n_windows = np.maximum(np.diff(first) - shape.width + 1, 0)
        ends = np.cumsum(n_windows)
        self.text = np.repeat(np.arange(len(first) - 1), n_windows)
        self.window = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n_windows, n_windows) + first[:-1][self.text]
        self.run_anchor = self.run_first = self.run_last = np.zeros(0, np.int64)
        self.grams = np.zeros(0, np.uint64)
        if len(self.window):
            self.grams = gram_hash(self.prefix, shape.phrase) if grams is None else grams
            # The hash of symbols is mixed already; its high bits say which phrase is the smallest.
            order = self.grams if grams is None else mix(grams)
            if shape.bits < 64:
                self.grams = self.grams & np.uint64((1 << shape.bits) - 1)
            self._runs(order)

    def _runs(self, order: np.ndarray) -> None:
        n, reach = len(self.grams), self.shape.width - self.shape.phrase + 1
        bits = np.uint64(max(1, n.bit_length()))
        low = (np.uint64(1) << bits) - np.uint64(1)
        order = (order & ~low) | (low - np.arange(n, dtype=np.uint64))
        span = 1
        while 2 * span <= reach:
            order = np.minimum(order[:-span], order[span:])
            span *= 2
        if span < reach:
            order = np.minimum(order[: len(order) - (reach - span)], order[reach - span :])
        anchor = (low - (order[self.window] & low)).astype(np.int64)
        new = np.ones(len(anchor), bool)
        new[1:] = anchor[1:] != anchor[:-1]
        begin = np.flatnonzero(new)
        self.run_anchor, self.run_first = anchor[begin], self.window[begin]
        self.run_last = self.window[np.append(begin[1:], len(anchor)) - 1]
        self.run_text = self.text[begin]

    def phrases(self) -> np.ndarray:
        """The phrase of each run."""
        return self.grams[self.run_anchor].view(np.int64)

    def contexts(self) -> np.ndarray:
        return span_hash(self.prefix, self.run_first, self.run_last + self.shape.width).view(np.int64)

    def part_hashes(self, runs: np.ndarray) -> list[np.ndarray]:
        """For each part ten bits of the hash of what the run's windows of that part have in common, 0 if it
        has no such window.

        Windows that hold the phrase at the places from ``low`` to ``high`` share ``low`` symbols before it
        and what follows it in the last of them.
        """
        at, shape = self.run_anchor[runs], self.shape
        near, far = at - self.run_last[runs], at - self.run_first[runs]
        out = []
        for low, high in shape.parts():
            held = (near <= high) & (far >= low) & (low <= high)
            begin, end = np.where(held, at - low, at), np.where(held, at + shape.width - high, at)
            out.append(np.where(held, 1 + span_hash(self.prefix, begin, end) % np.uint64(SIDES - 1), 0).astype(np.int64))
        return out

    def window_hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for each window, as two independent hashes."""
        return self.two_hashes(at, at + self.shape.width)

    def two_hashes(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        other = prefix_hash(mix(self.code ^ np.uint64(0x5851F42D4C957F2D)))
        return span_hash(self.prefix, begin, end).view(np.int64), span_hash(other, begin, end).view(np.int64)

    def sides(self, at: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        """k, n, c, before and after of PART rows for ``n`` windows from ``at`` on, which are of one part each."""
        shape = self.shape
        anchor = self.run_anchor[np.searchsorted(self.run_first, at, side="right") - 1]
        far, near = anchor - at, anchor - at - n + 1
        lows, highs = np.array([p for p in shape.parts() if p[0] <= p[1]]).T
        part = np.searchsorted(lows, far, side="right") - 1
        low, high = lows[part], highs[part]
        begin, end = anchor - low, anchor + shape.width - high
        k, c = self.two_hashes(begin, end)
        padded = np.concatenate([np.zeros(8, np.uint8), self.data, np.zeros(16, np.uint8)])
        words = np.lib.stride_tricks.sliding_window_view(padded, 8)
        before, after = (np.ascontiguousarray(words[x]).view(">u8").ravel().astype(np.uint64) for x in (begin, end + 8))
        return {
            "k": (k.view(np.uint64) ^ mix(low.astype(np.uint64))).view(np.int64),
            "n": n | (high - far) << 8 | (high - low) << 16,
            # 96 bits for what is shared; the rest is compared byte by byte.
            "c": c >> 32,
            "before": (before & LAST_BYTES[far - low]).view(np.int64),
            "after": (after & FIRST_BYTES[high - near]).view(np.int64),
        }


# Masks of the last and of the first 0 to 8 bytes of a big-endian number.
LAST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
FIRST_BYTES = ~LAST_BYTES[::-1]

Reader = Callable[[list[bytes], Shape], Piece]


def rows_of(**columns) -> pa.Table:
    """A table of :data:`ROW` from some columns; the others are 0, ``salt`` is -1."""
    n = len(next(iter(columns.values())))
    kinds = {"k": pa.int64(), "salt": pa.int32(), "row": pa.int64(), "pos": pa.int32(), "n": pa.int64(), "kind": pa.int32(), "c": pa.int64()}
    rest = {"salt": -1}
    kinds |= {name: pa.int64() for name in ("before", "after") if name in columns}
    return pa.table({name: pa.array(columns.get(name, np.full(n, rest.get(name, 0))), kind) for name, kind in kinds.items()})


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``_row``, a key of each row in the order of doc_id.

    Unique ids are their own keys. If ids repeat or are null, rows are numbered in the order of
    (doc_id, null first, hash of the text), and a later row counts as a later document.
    """
    named = docs.select("doc_id", "text")
    whole = dict(docs.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint")
    if whole:
        odd = named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL")
        if odd.isEmpty():
            return named.withColumn("_row", F.col("doc_id").cast("long"))
    order = ["doc_id", "_tie"]
    ranged = named.withColumn("_tie", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(ranged.withColumn("_row", F.monotonically_increasing_id()).drop("_tie"), "numbered")


def sharded(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """Numbered documents with their shard, the number of shards and of bytes; a shard has about
    SHARD_BYTES of text."""
    rows = numbered(docs)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    return rows.withColumn("shard", F.pmod(F.xxhash64("_row"), F.lit(shards)).cast("int")), shards, total


def pieces(table: pa.Table | pa.RecordBatch, limit: int) -> Iterator[tuple[list[bytes], pa.Table]]:
    """Texts and rows of a table, a few megabytes at a time and in their order."""
    sizes = pc.fill_null(pc.binary_length(table.column("text")), 0).to_numpy(zero_copy_only=False) if table.num_rows else []

    def part(begin: int, end: int) -> tuple[list[bytes], pa.Table]:
        rows = table.slice(begin, end - begin)
        return texts_of(rows.column("text")), rows

    begin, held = 0, 0
    for i, size in enumerate(map(int, sizes)):
        if i > begin and held + size > limit:
            yield part(begin, i)
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield part(begin, len(sizes))


def runs_of(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def squeezed(docs: DataFrame) -> DataFrame:
    """_row, doc_id, shard, size and text: each text compressed, with its number of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            less = [None if t is None else codec.compress(t, asbytes=True) for t in texts.to_pylist()]
            columns = [batch.column(n) for n in ("_row", "doc_id", "shard")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pc.binary_length(texts).cast(pa.int32()), pa.array(less, pa.binary())],
                ["_row", "doc_id", "shard", "size", "text"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("_row", "doc_id", "shard", "text").mapInArrow(run, f"_row long, doc_id {kind}, shard int, size int, text binary")


def unsqueezed(docs: pa.Table) -> pa.Table:
    """Rows of :func:`squeezed` in the order of ``_row``, with their texts as bytes."""
    docs, codec = docs.sort_by("_row"), pa.Codec("zstd")
    sizes, texts = docs.column("size").to_pylist(), docs.column("text").to_pylist()
    whole = [t if t is None else codec.decompress(t, decompressed_size=n, asbytes=True) for t, n in zip(texts, sizes)]
    place = docs.schema.get_field_index("text")
    return docs.set_column(place, "text", pa.array(whole, pa.large_binary())).drop_columns(["size"])


def squeezed_keys(keys: np.ndarray) -> bytes:
    """Ascending numbers as compressed differences, byte by byte of all."""
    steps = np.diff(keys, prepend=keys.dtype.type(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.int64(len(keys)).tobytes() + pa.compress(steps.T.tobytes(), codec="zstd", asbytes=True)


def unsqueezed_keys(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob[:8], np.int64)[0])
    raw = pa.decompress(blob[8:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.cumsum(np.frombuffer(raw, np.uint8).reshape(8, n).T.copy().view("<u8").ravel(), dtype=np.uint64).view(np.int64)


def keys_in(blobs: pa.ChunkedArray) -> np.ndarray:
    """All numbers of a column of :func:`squeezed_keys`, sorted."""
    return np.sort(np.concatenate([np.zeros(0, np.int64), *map(unsqueezed_keys, blobs.to_pylist())]))


def larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of small batches by about HELD_ROWS."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= HELD_ROWS:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None = None) -> Iterator[tuple[dict[str, np.ndarray], bool, bool]]:
    """Sorted batches regrouped so that no run of equal keys is cut, as (columns, open before, open after).

    A run of more than ``most`` rows (MOST_HELD) is given out in parts, which are marked as open.
    """
    most = most or MOST_HELD
    held: dict[str, np.ndarray] | None = None
    opened = False
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        if held is not None:
            now = {n: np.concatenate([held[n], now[n]]) for n in now}
        begin = int(runs_of(*(now[k] for k in keys))[-1])
        if begin:
            yield {n: x[:begin] for n, x in now.items()}, opened, False
            opened = False
            held = {n: x[begin:] for n, x in now.items()}
        elif len(now[keys[0]]) > most:
            yield now, opened, True
            held, opened = {n: x[-1:] for n, x in now.items()}, True
        else:
            held = now
    if held is not None and len(held[keys[0]]):
        yield held, opened, False


def anchors(docs: DataFrame, read: Reader, shape: Shape, hot: np.ndarray) -> DataFrame:
    """k (phrase), salt, shard: one row per anchor; hot phrases are salted by shard."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, rows in pieces(batch, shape.piece_bytes):
                piece = read(texts, shape)
                if not len(piece.run_anchor):
                    continue
                k = piece.phrases()
                shard = rows.column("shard").to_numpy(zero_copy_only=False)[piece.run_text]
                salt = np.where(np.isin(k, shared.value), shard, -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k), pa.array(salt, pa.int32()), pa.array(shard, pa.int32())], ["k", "salt", "shard"]
                )

    return docs.select("shard", "text").mapInArrow(run, "k long, salt int, shard int")


def hot_phrases(docs: DataFrame, read: Reader, shape: Shape) -> np.ndarray:
    """Phrases that stand in one of HOT_SHARE documents of a bounded sample, or more."""
    sample = docs.orderBy(F.xxhash64(F.lit(5), "_row")).select("_row").limit(SAMPLE_ROWS)
    drawn = docs.join(F.broadcast(sample), "_row", "left_semi")
    found = anchors(drawn, read, shape, np.zeros(0, np.int64)).groupBy("k").agg(F.count("*").alias("n"))
    rows = found.where(F.col("n") >= max(20, SAMPLE_ROWS // HOT_SHARE)).select("k").collect()
    return np.array(sorted(r["k"] for r in rows), np.int64)


def recurring(docs: DataFrame, read: Reader, shape: Shape, hot: np.ndarray, shards: int) -> DataFrame:
    """shard, k or keys: the phrases named more than once, once for each shard that holds them.

    Where phrase, shard and the mark of a hot phrase fit into one long, they are shuffled as one, sorted and
    compressed (``keys``).
    """
    low = max(1, (shards - 1).bit_length()) + 1
    if shape.bits + low <= 62:
        return _recurring_keys(docs, read, shape, hot, shards, low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now, before, after in _whole_runs(batches, ["k", "salt"]):
            keep = _named_twice(now["k"], now["salt"], now["shard"])
            yield pa.RecordBatch.from_arrays([pa.array(now["shard"][keep], pa.int32()), pa.array(now["k"][keep])], ["shard", "k"])

    rows = anchors(docs, read, shape, hot)
    ordered = rows.repartition("k", "salt").sortWithinPartitions("k", "salt", "shard")
    return ordered.mapInArrow(run, "shard int, k long")


def _named_twice(k: np.ndarray, salt: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Of sorted anchors, the first in its shard of each phrase that is hot or named twice."""
    begin = runs_of(k, salt)
    size = np.diff(np.append(begin, len(k)))
    keep = np.repeat(size > 1, size) | (salt >= 0)
    new = np.zeros(len(k), bool)
    new[runs_of(k, salt, shard)] = True
    return keep & new


def _recurring_keys(docs: DataFrame, read: Reader, shape: Shape, hot: np.ndarray, shards: int, low: int) -> DataFrame:
    """shard, keys: phrases are dealt out by ranges of their hash, hot ones by hash and shard."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    buckets = 2 * shards
    edges = np.array([(i << shape.bits) // buckets << low for i in range(buckets + 1)], np.int64)

    def dealt(keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key = np.sort(np.concatenate(keys))
        # Of equal anchors, two say as much as more.
        key = key[np.append(np.ones(min(2, len(key)), bool), key[2:] != key[:-2])]
        is_hot = key & 1 == 1
        common, key = key[is_hot], key[~is_hot]
        cuts = np.searchsorted(key, edges)
        made = [(i, key[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        to = (mix(common.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        made += [(i, common[to == i]) for i in np.unique(to).tolist()]
        blobs = [squeezed_keys(x) for _, x in made]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in made], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "keys"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        keep_freed()
        for batch in batches:
            for texts, rows in pieces(batch, shape.piece_bytes):
                piece = read(texts, shape)
                if not len(piece.run_anchor):
                    continue
                k = piece.phrases()
                shard = rows.column("shard").to_numpy(zero_copy_only=False)[piece.run_text].astype(np.int64)
                held.append((k << low) + shard * 2 + np.isin(k, shared.value))
                if sum(map(len, held)) >= HELD_KEYS:
                    yield from dealt(held)
                    held = []
        if held:
            yield from dealt(held)
        give_back()

    def find(rows: pa.Table) -> pa.Table:
        key = keys_in(rows.column("keys"))
        k, shard = key >> low, (key >> 1) & ((1 << (low - 1)) - 1)
        keep = _named_twice(k, np.where(key & 1, shard, -1), shard)
        order = np.lexsort((k[keep], shard[keep]))
        k, shard = k[keep][order], shard[keep][order]
        begin = runs_of(shard)
        blobs = [squeezed_keys(part) for part in np.split(k, begin[1:])] if len(k) else []
        return pa.table({"shard": pa.array(shard[begin], pa.int32()), "keys": pa.array(blobs, pa.binary())})

    packs = docs.select("shard", "text").mapInArrow(deal, "bucket int, keys binary")
    return packs.groupBy("bucket").applyInArrow(find, "shard int, keys binary")


def resolve_contexts(rows: DataFrame, shards: int, shape: Shape) -> DataFrame:
    """shard, row, pos, n, kind: contexts that are repeats, and windows of contexts that must be compared, as
    PART where they may be (not all of a context's group is in sight if it is salted or long).

    Rows of kind REPEAT pass through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now, before, after in _whole_runs(larger(batches), ["k", "salt"]):
            begin = runs_of(now["k"], now["salt"])
            run_of = np.zeros(len(now["k"]), np.int64)
            run_of[begin[1:]] = 1
            run_of = np.cumsum(run_of)
            order = np.lexsort((np.arange(len(run_of)), now["c"], run_of))
            lead = runs_of(run_of[order], now["c"][order])
            first = order[lead]
            # The class of each row, and the first row of its class.
            which = np.empty(len(run_of), np.int64)
            which[order] = np.repeat(np.arange(len(lead)), np.diff(np.append(lead, len(order))))
            leader = first[which]
            same = now["row"] == now["row"][leader]
            if shape.within:
                same &= now["pos"] == now["pos"][leader]
            passed = now["kind"] == REPEAT
            packed, pos = now["n"], now["pos"].astype(np.int64)
            n, place = packed % SIDES, pos + packed // SIDES % SIDES
            # Not all of these runs is in sight.
            open_run = (now["salt"][first] >= 0) | ((run_of[first] == 0) & before) | ((run_of[first] == run_of[-1]) & after)
            whole = np.flatnonzero(passed | ~same)
            made = [(whole, pos[whole], np.where(passed, packed, n)[whole], REPEAT)]
            for i, (low, high) in enumerate(shape.parts()):
                value = packed[first] // SIDES ** (2 + i) % SIDES
                meets = (open_run | _shared(run_of[first], value)) & (value > 0)
                at = np.flatnonzero(same & ~passed & meets[which])
                begin_at = np.maximum(pos[at], place[at] - high)
                many = np.minimum(pos[at] + n[at] - 1, place[at] - low) - begin_at + 1
                if not shape.beside:
                    made.append((at, begin_at, many, WINDOW))
                    continue
                for chosen, kind in ((open_run[which[at]], WINDOW), (~open_run[which[at]], PART)):
                    made.append((at[chosen], begin_at[chosen], many[chosen], kind))
            at = np.concatenate([m[0] for m in made])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(now["row"][at]),
                    pa.array(np.concatenate([m[1] for m in made]).astype(np.int32)),
                    pa.array(np.concatenate([m[2] for m in made]).astype(np.int32)),
                    pa.array(np.repeat([m[3] for m in made], [len(m[0]) for m in made]), pa.int32()),
                    pa.array(now["salt"][at]),
                ],
                ["row", "pos", "n", "kind", "salt"],
            )

    ordered = rows.repartition("k", "salt").sortWithinPartitions("k", "salt", "row", "pos")
    found = ordered.mapInArrow(run, "row long, pos int, n int, kind int, salt int")
    return found.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))


def _shared(run: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether another entry of the run has the same value."""
    order = np.lexsort((value, run))
    begin = runs_of(run[order], value[order])
    size = np.diff(np.append(begin, len(order)))
    out = np.empty(len(order), bool)
    out[order] = np.repeat(size > 1, size)
    return out


def resolve_windows(rows: DataFrame, last: bool, within: bool) -> DataFrame:
    """Rows of kind WINDOW to rows of kind REPEAT, but for the first of each hash, which go.

    Firsts of salted groups stay WINDOW rows for a second turn without salts, the ``last`` one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead_row = lead_pos = None
        # A group of PART rows is no larger than one of contexts that was whole.
        for now, before, after in _whole_runs(larger(batches), ["k", "c", "salt", "kind"], 2 * MOST_HELD + HELD_ROWS):
            if "before" in now:
                chosen = now["kind"] == PART
                yield _compared({n: x[chosen] for n, x in now.items()})
                if chosen.all():
                    continue
                # What is cut here is a group of other rows, which stand at the ends.
                now = {n: x[~chosen] for n, x in now.items()}
            begin = runs_of(now["k"], now["c"], now["salt"], now["kind"])
            size = np.diff(np.append(begin, len(now["k"])))
            row, pos = now["row"][begin].copy(), now["pos"][begin].copy()
            if before and lead_row is not None:
                row[0], pos[0] = lead_row, lead_pos
            lead_row, lead_pos = row[-1], pos[-1]
            same = now["row"] == np.repeat(row, size)
            if within:
                same &= now["pos"] == np.repeat(pos, size)
            # A repeat found in the first turn needs no second one.
            kind = np.where((now["kind"] == WINDOW) & same, WINDOW, REPEAT).astype(np.int32)
            keep = (kind == REPEAT) | ((now["salt"] >= 0) & (not last))
            out = {**now, "kind": kind, "salt": np.full(len(kind), -1, np.int32), "k": np.where(kind == REPEAT, now["row"], now["k"])}
            yield pa.RecordBatch.from_arrays([pa.array(out[n][keep]) for n in ROW_NAMES], ROW_NAMES)

    ordered = rows.repartition("k", "salt").sortWithinPartitions("k", "c", "salt", "kind", "row", "pos")
    return ordered.mapInArrow(run, ROW)


def _compared(now: dict[str, np.ndarray]) -> pa.RecordBatch:
    """The repeats among the windows of PART rows, neighbours in one row."""
    begin = runs_of(now["k"], now["c"]) if len(now["k"]) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(now["k"])))
    chosen = np.repeat(size > 1, size)
    group, row, pos = np.repeat(np.arange(len(size)), size)[chosen], now["row"][chosen], now["pos"][chosen]
    packed = now["n"][chosen]
    n, first, span = packed & 255, packed >> 8 & 255, packed >> 16
    before, after = (now[x][chosen].view(np.uint64) for x in ("before", "after"))
    # One more, so that no run of repeats goes on into the next row.
    repeat = np.zeros((len(row), MOST_BESIDE + 2), bool)
    for j in range(MOST_BESIDE + 1):
        at = np.flatnonzero((first <= j) & (first + n > j))
        if not len(at):
            continue
        left, right = before[at] & LAST_BYTES[span[at] - j], after[at] & FIRST_BYTES[j]
        # Rows ascend within a group, so the first of equals stands in the smallest row.
        order = np.lexsort((right, left, group[at]))
        lead = runs_of(group[at][order], left[order], right[order])
        leader = np.repeat(at[order][lead], np.diff(np.append(lead, len(order))))
        repeat[at[order], j] = row[at[order]] != row[leader]
    edge = np.diff(np.concatenate([[False], repeat.ravel()]).astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    of, j = np.divmod(start, MOST_BESIDE + 2)
    made = rows_of(k=row[of], row=row[of], pos=pos[of] + j - first[of], n=stop - start, kind=np.full(len(of), REPEAT))
    return made.combine_chunks().to_batches()[0] if made.num_rows else pa.RecordBatch.from_pylist([], made.schema)


def find_repeats(
    docs: DataFrame,
    read: Reader,
    shape: Shape,
    locate: Callable[[pa.Table, np.ndarray, np.ndarray, Shape], pa.Table],
    finish: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
) -> DataFrame:
    """Run the steps. ``locate`` (documents of a shard, its recurring phrases, hot phrases, the shape) gives rows
    of kind CONTEXT or REPEAT; ``finish`` (documents of a shard, its repeats: row, pos, n) gives rows
    of ``schema``."""
    if shape.width - shape.phrase + 1 >= SIDES:
        raise ValueError(f"a window is at most {SIDES - 2} symbols longer than a phrase")
    small_batches(docs.sparkSession)
    placed, shards, total = sharded(docs)
    # Bits that keep chance meetings of phrases below one in a hundred; they would cost work only.
    shape = replace(shape, bits=min(shape.bits, total.bit_length() + 6)) if shape.bits < 64 else shape
    hot = hot_phrases(placed, read, shape)
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    texts = squeezed(placed).groupBy("shard")

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        if shape.bytes:
            keep_freed()
        named = keys_in(right.column("keys")) if "keys" in right.column_names else right.column("k").to_numpy()
        made = locate(unsqueezed(left), np.unique(named), shared.value, shape)
        give_back()
        return made

    def open_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        if shape.bytes:
            keep_freed()
        made = _open_windows(unsqueezed(left), right, read, shape)
        give_back()
        return made

    phrases = recurring(placed, read, shape, hot, shards)
    contexts = texts.cogroup(phrases.groupBy("shard")).applyInArrow(find, ROW)
    known = resolve_contexts(contexts, shards, shape)
    rows = texts.cogroup(known.groupBy("shard")).applyInArrow(open_windows, SIDE_ROW if shape.beside else ROW)
    repeats = resolve_windows(rows, False, shape.within)
    # Without hot phrases nothing is salted, and the first turn is the last.
    if len(hot):
        repeats = resolve_windows(repeats, True, shape.within)
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard")
    marks = repeats.select(shard, "row", "pos", "n")
    return texts.cogroup(marks.groupBy("shard")).applyInArrow(lambda left, right: finish(unsqueezed(left), right), schema)


def _merged(known: pa.Table) -> pa.Table:
    """REPEAT rows of a shard with the runs of windows that touch put together."""
    row, pos, n = (known.column(c).to_numpy().astype(np.int64) for c in ("row", "pos", "n"))
    order = np.lexsort((pos, row))
    row, pos, end = row[order], pos[order], (pos + n)[order]
    new = np.ones(len(row), bool)
    # Spans that overlap an earlier one than their neighbour stay apart, which does no harm.
    new[1:] = (row[1:] != row[:-1]) | (pos[1:] > end[:-1])
    begin = np.flatnonzero(new)
    stop = np.maximum.reduceat(end, begin) if len(begin) else end
    return rows_of(k=row[begin], row=row[begin], pos=pos[begin], n=stop - pos[begin], kind=np.full(len(begin), REPEAT))


def spans_by_row(marks: pa.Table) -> dict[int, np.ndarray]:
    """(pos, n) of each row of a table of marks."""
    row = marks.column("row").to_numpy()
    order = np.argsort(row, kind="stable")
    pairs = np.stack([marks.column("pos").to_numpy(), marks.column("n").to_numpy()], axis=1).astype(np.int64)[order]
    row = row[order]
    begin = runs_of(row) if len(row) else np.zeros(0, np.int64)
    return {int(row[b]): part for b, part in zip(begin, np.split(pairs, begin[1:]))} if len(row) else {}


def _open_windows(docs: pa.Table, known: pa.Table, read: Reader, shape: Shape) -> pa.Table:
    """Repeats, put together, and one row per window of the contexts to be opened, or per part of them."""
    kind = known.column("kind").to_numpy()
    out = [_merged(known.filter(pa.array(kind == REPEAT)))]
    opened = known.filter(pa.array(kind != REPEAT))
    if opened.num_rows:
        opened = opened.sort_by([("row", "ascending"), ("pos", "ascending")])
        at, begin_at, many, salt, kind = (opened.column(c).to_numpy() for c in ("row", "pos", "n", "salt", "kind"))
        chosen = docs.filter(pa.array(np.isin(docs.column("_row").to_numpy(), at)))
        for texts, rows in pieces(chosen, shape.piece_bytes):
            piece = read(texts, shape)
            keys = rows.column("_row").to_numpy()
            # Rows of a document stand together, and documents ascend on both sides.
            low, high = np.searchsorted(at, keys), np.searchsorted(at, keys, side="right")
            text = np.repeat(np.arange(len(keys)), high - low)
            which = np.arange(len(text)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[text]
            whole = kind[which] == PART
            if whole.any():
                part, of = which[whole], text[whole]
                pos = begin_at[part].astype(np.int64)
                sides = piece.sides(pos + piece.first[of], many[part].astype(np.int64))
                out.append(rows_of(**sides, row=keys[of], pos=pos, kind=np.full(len(pos), PART)))
            which, text = which[~whole], text[~whole]
            if not len(which):
                continue
            hot, n, first = salt[which] >= 0, many[which].astype(np.int64), begin_at[which].astype(np.int64)
            ends = np.cumsum(n)
            pos = np.arange(int(ends[-1])) - np.repeat(ends - n, n) + np.repeat(first, n)
            text, hot = np.repeat(text, n), np.repeat(hot, n)
            row = keys[text]
            k, c = piece.window_hashes(pos + piece.first[text])
            out.append(rows_of(k=k, c=c, salt=np.where(hot, row % SALTS, -1), row=row, pos=pos, n=np.ones(len(pos), np.int64)))
    if not shape.beside:
        return pa.concat_tables(out)
    return pa.concat_tables([t if "before" in t.column_names else _without_sides(t) for t in out])


def _without_sides(rows: pa.Table) -> pa.Table:
    zeros = pa.array(np.zeros(rows.num_rows, np.int64))
    return rows.append_column("before", zeros).append_column("after", zeros)


def context_rows(piece: Piece, rows: np.ndarray, chosen: np.ndarray, hot: np.ndarray) -> pa.Table:
    """One CONTEXT row for each chosen run of a piece; ``rows`` are the keys of its texts."""
    k, row = piece.phrases()[chosen], rows[piece.run_text[chosen]] if len(chosen) else np.zeros(0, np.int64)
    first = piece.run_first[chosen]
    packed = np.zeros(len(k), np.int64)
    for part in reversed(piece.part_hashes(chosen) if len(chosen) else []):
        packed = packed * SIDES + part
    packed = packed * SIDES + piece.run_anchor[chosen] - first
    begin = piece.first[:-1][piece.run_text[chosen]] if len(chosen) else first
    return rows_of(
        k=k,
        salt=np.where(np.isin(k, hot), row % SALTS, -1),
        row=row,
        pos=first - begin,
        n=packed * SIDES + piece.run_last[chosen] - first + 1,
        kind=np.full(len(k), CONTEXT),
        c=piece.contexts()[chosen],
    )


def covered(spans: np.ndarray | None, n: int, width: int) -> np.ndarray:
    """Which of n symbols are covered by windows that begin at pos .. pos + n - 1 of the spans."""
    change = np.zeros(n + 1, np.int64)
    if spans is not None and len(spans):
        np.add.at(change, spans[:, 0], 1)
        np.add.at(change, np.minimum(spans[:, 0] + spans[:, 1] - 1 + width, n), -1)
    return np.cumsum(change[:-1]) > 0
