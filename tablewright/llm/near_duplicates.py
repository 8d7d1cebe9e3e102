"""Near duplicates by MinHash signatures and a multi-index Hamming join.

A document's set holds its distinct shingles of ``shingle`` words (a shorter text, but not an empty
one, is one shingle). Documents are linked if the Jaccard similarity of their sets reaches the
threshold; every link is confirmed on the full sets.

**Signatures.** ``VALUES`` b-bit MinHash values (b = 16). Values of a pair with similarity s differ
with probability 1 - s, so a pair at 0.8 differs in 9.6 of 48 places on average, with a standard
deviation of 2.8; :data:`MOST_DIFFERENT` = 23 places lie 4.8 deviations above that.

**Multi-index join.** The signature is cut into ``CHUNKS`` chunks of ``WIDTH`` values. If two
signatures differ in at most 2 * CHUNKS - 1 places, some chunk has at most one difference (pigeonhole).
Each chunk therefore gives WIDTH keys, one for each place where the one allowed error may be; pairs
under the distance meet in at least one key, whatever their similarity. This holds for all of them.

**Groups of copies.** Documents with equal sets are one class from the start, and only classes are
joined. Within a key pairs are not listed. First a star round: a key names up to ``STARS`` centres,
each class is compared with the nearest few of the ``CENTRES`` most common ones among its keys, and
confirmed links become components; keys whose members are all in one component are done. Then, in
keys that still hold several components, the members outside the key's largest component meet the
members of other components, in blocks of ``BLOCK`` by ``BLOCK`` members, so a key of any size is split
over tasks: first each proposes its ``NEAREST`` mates, and when their links have joined components, all
pairs that are left are looked at. A pair is looked at in the first key that it shares only. Cells are
narrowed twice, and no pair leaves a cell but a link: members without a mate under the signature distance
go, and those left are compared by a longer signature, :data:`DETAIL` values of 4 bits: a pair at 0.8
differs in 192 of 1024 places, with a standard deviation of 12.5; :data:`DETAIL_DIFFERENT` lies 7
deviations above that. Texts come to the members left after that, once for each cell, and their full sets
are compared there.

Defined results: texts without words, null or empty, have empty sets and are linked with nothing; a
row without doc_id is linked with nothing, has no component and is kept; rows with equal texts are
linked; rows that share a doc_id share a component; an empty table gives no rows. Columns other than
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.graph import components, small_batches, stored
from tablewright.llm.passages import runs_of
from tablewright.llm.text_arrays import Words, in_pieces, mix, prefix_hash, span_hash, texts_of

CHUNKS, WIDTH = 12, 4
VALUES = CHUNKS * WIDTH
MOST_DIFFERENT = 2 * CHUNKS - 1
# Seven deviations above the mean of a pair at 0.8: such a pair is dropped once in 10^12.
DETAIL, DETAIL_DIFFERENT = 1024, 280
STARS, CENTRES, TRIED, NEAREST, BLOCK = 3, 8, 3, 3, 4096
# A cell of longer signatures and one of texts take about the square of this many pairs, and SPREAD times as
# many members of either side.
PART, TEXTS, SPREAD = 256, 128, 8
# A power of two over the number of keys of a signature.
PLACES = 64

_rng = np.random.default_rng(3)
_FACTORS = _rng.integers(1, 2**32, VALUES + DETAIL, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_SHIFTS = _rng.integers(0, 2**32, VALUES + DETAIL, dtype=np.uint64).astype(np.uint32)


def shingle_sets(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each text, and where each text's begin."""
    words = Words(texts, lower=True)
    n_words = np.diff(words.first)
    length = np.minimum(n_words, shingle)
    places = np.where(n_words > 0, n_words - length + 1, 0)
    ends = np.cumsum(places)
    text = np.repeat(np.arange(len(texts)), places)
    start = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - places, places) + words.first[:-1][text]
    hashes = span_hash(prefix_hash(words.hashes()), start, start + length[text])
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[new], text[new]
    return hashes, np.searchsorted(text, np.arange(len(texts) + 1))


def signatures(hashes: np.ndarray, first: np.ndarray, begin: int = 0, end: int = VALUES) -> np.ndarray:
    """One row of 16-bit values per text, of the hash functions ``begin`` to ``end``; zeros for an empty set."""
    out = np.zeros((len(first) - 1, end - begin), np.uint16)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        short, starts = (hashes >> np.uint64(32)).astype(np.uint32), first[:-1][full]
        for k in range(begin, end):
            least = np.minimum.reduceat((short ^ _SHIFTS[k]) * _FACTORS[k], starts)
            out[full, k - begin] = (mix(least.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)
    return out


def sketch(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit digest of the set), signature; one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_pieces(batches):
            hashes, first = shingle_sets(texts_of(piece.column("text")), shingle)
            found = signatures(hashes, first)
            digests = [
                hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() for a, b in zip(first[:-1], first[1:])
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    pa.array(np.diff(first), pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array([row.tobytes() for row in found], pa.binary()),
                ],
                ["doc_id", "n_shingles", "set_key", "signature"],
            )

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return named.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, signature binary")


def chunk_key(values: np.ndarray, chunk: int, error: int) -> np.ndarray:
    """Hash of the values of a chunk but the one at ``error``; ``values``: (rows, CHUNKS, WIDTH).

    The last bits are the number of the key, so that a key says which chunk and place it stands for.
    """
    key = np.full(len(values), chunk * WIDTH + error + 1, np.uint64)
    for place in range(WIDTH):
        if place != error:
            key = mix(key * np.uint64(0x10001) + values[:, chunk, place].astype(np.uint64))
    return (key // np.uint64(PLACES) * np.uint64(PLACES) + np.uint64(chunk * WIDTH + error)).view(np.int64)


def index_keys(classes: DataFrame) -> DataFrame:
    """key, rep: for each chunk and each place of its one allowed error, the hash of the other values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _values(batch.column("signature")).reshape(-1, CHUNKS, WIDTH)
            keys = [chunk_key(values, chunk, error) for chunk in range(CHUNKS) for error in range(WIDTH)]
            reps = np.tile(batch.column("rep").to_numpy(zero_copy_only=False), len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(reps)], ["key", "rep"])

    return classes.select("rep", "signature").mapInArrow(run, "key long, rep long")


def _values(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, VALUES)


def shared_keys(keys: DataFrame) -> DataFrame:
    """The rows of keys with more than one row.

    Rows are range-partitioned by (key, rep) and sorted, and each partition drops the keys that have
    one row in it. A key may be cut by a border, so the first and the last key of a partition always
    stay. A key with most rows is so cut into several partitions, and no row is collected anywhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row seen, and whether it has been emitted
        before, first = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy(zero_copy_only=False)
            same = key[1:] == key[:-1]
            keep = np.zeros(len(key), bool)
            keep[1:] |= same
            keep[:-1] |= same
            if before is not None and before == key[0]:
                keep[0] = True
                if held is not None:
                    yield held
            keep[0] |= first
            first = False
            last_kept = bool(keep[-1])
            held = None if last_kept else batch.slice(len(key) - 1)
            before = key[-1]
            if keep.any():
                yield batch.filter(pa.array(keep))
        if held is not None:
            yield held

    ranged = keys.repartitionByRange("key", "rep").sortWithinPartitions("key", "rep")
    return ranged.mapInArrow(run, "key long, rep long")


def member_table(docs: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """rep, text, n_shingles, signature and detail (the longer signature) of the classes in shared keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_pieces(batches):
            hashes, first = shingle_sets(texts_of(piece.column("text")), shingle)
            detail = signatures(hashes, first, VALUES, VALUES + DETAIL).astype(np.uint8) & 15
            detail = detail[:, ::2] << 4 | detail[:, 1::2]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("rep"),
                    piece.column("text"),
                    pa.array(np.diff(first), pa.int64()),
                    pa.array([row.tobytes() for row in signatures(hashes, first)], pa.binary()),
                    pa.array([row.tobytes() for row in detail], pa.binary()),
                ],
                ["rep", "text", "n_shingles", "signature", "detail"],
            )

    named = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(members, "rep", "left_semi")
    return named.mapInArrow(run, "rep long, text string, n_shingles long, signature binary, detail binary")


def _near(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with their signature distance, as far as distance and set sizes allow a link."""
    for side in "ab":
        side_of = members.select(
            F.col("rep").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("signature").alias(f"s_{side}")
        )
        pairs = pairs.join(side_of, side)
    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            distance = (_values(batch.column("s_a")) != _values(batch.column("s_b"))).sum(axis=1)
            out = pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(distance, pa.int64())], ["a", "b", "distance"]
            )
            yield out.filter(pa.array(distance <= MOST_DIFFERENT))

    return pairs.where(fits).select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long, distance long")


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity; ``texts``: rep, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                yield _confirm(part, shingle, percent)

    for side in "ab":
        pairs = pairs.join(texts.select(F.col("rep").alias(side), F.col("text").alias(f"text_{side}")), side)
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _confirm(part: pa.RecordBatch, shingle: int, percent: int) -> pa.RecordBatch:
    sides = []
    for side in "ab":
        texts = texts_of(part.column(f"text_{side}"))
        distinct = {t: i for i, t in enumerate(dict.fromkeys(texts))}
        hashes, first = shingle_sets(list(distinct), shingle)
        sides.append([hashes[first[i] : first[i + 1]] for i in (distinct[t] for t in texts)])
    keep = np.zeros(part.num_rows, bool)
    for i, (x, y) in enumerate(zip(*sides)):
        keep[i] = _alike(x, y, percent)
    return pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(keep))


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def _star_pairs(shared: DataFrame) -> DataFrame:
    """Classes with centres of their keys: of those the CENTRES that are drawn first everywhere."""
    draw = F.xxhash64("rep")
    point = F.struct(draw.alias("draw"), "rep")
    centres = [F.min(F.when(F.pmod(draw, F.lit(STARS)) == i, point)).alias(f"c{i}") for i in range(STARS)]
    keys = shared.groupBy("key").agg(F.count("*").alias("n"), *centres).where("n > 1")
    keys = keys.select("key", F.array_compact(F.array(*[f"c{i}" for i in range(STARS)])).alias("centres"))
    met = shared.join(keys, "key").select("rep", F.explode("centres").alias("c")).where(F.col("rep") != F.col("c.rep"))
    place = F.dense_rank().over(Window.partitionBy("rep").orderBy("c.draw"))
    first = met.withColumn("place", place).where(F.col("place") <= CENTRES)
    return first.select(F.greatest("rep", "c.rep").alias("a"), F.least("rep", "c.rep").alias("b")).distinct()


def _best(near: DataFrame) -> DataFrame:
    """For each class the nearest few of its pairs."""
    near = stored(near, "near")
    ends = near.withColumn("of", F.col("a")).unionByName(near.withColumn("of", F.col("b")))
    # The limit on the row number is applied before the shuffle, so a centre of many pairs sends few rows.
    place = F.row_number().over(Window.partitionBy("of").orderBy("distance", "a", "b"))
    return ends.withColumn("place", place).where(F.col("place") <= TRIED).select("a", "b").distinct()


def _open_cells(shared: DataFrame, labels: DataFrame, members: DataFrame) -> DataFrame:
    """Members of keys that hold several components, in cells (key, cell) where each meets the other components."""
    named = labels.select(F.col("node").alias("rep"), "component")
    labelled = shared.join(named, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    sizes = labelled.groupBy("key", "component").agg(F.count("*").alias("n"))
    open_keys = (
        sizes.groupBy("key")
        .agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("rows"), F.count("*").alias("kinds"))
        .where("kinds > 1")
        .select(
            "key",
            F.col("main.component").alias("main"),
            F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"),
            F.ceil((F.col("rows") - F.col("main.n")) / BLOCK).cast("int").alias("turns"),
        )
    )
    rows = labelled.join(open_keys, "key").join(members.select("rep", "n_shingles", "signature"), "rep")
    home = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    turn = F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("turns")).cast("int")

    def cell(probe: bool, block: Column, turn: Column) -> Column:
        return F.struct(F.lit(probe).alias("probe"), (F.shiftleft(turn.cast("long"), 32) + block).alias("cell"))

    # A member is looked at in its own block by all turns; outside the main component it also takes a
    # turn of its own through all blocks.
    seen = F.transform(F.sequence(F.lit(0), F.col("turns") - 1), lambda t: cell(False, home, t))
    looks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: cell(True, b, turn))
    cells = F.when(F.col("component") != F.col("main"), F.concat(seen, looks)).otherwise(seen)
    placed = rows.withColumn("at", F.explode(cells)).withColumn("main", F.col("component") == F.col("main"))
    return placed.select("key", "at.cell", "at.probe", "rep", "component", "main", "n_shingles", "signature")


def _dealt(cells: DataFrame) -> DataFrame:
    return cells.repartition("key", "cell").sortWithinPartitions("key", "cell")


def _each_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict[str, np.ndarray]]]:
    for now in _whole_groups(batches, ["key", "cell"]):
        begin = runs_of(now["key"], now["cell"])
        yield [{n: x[a:b] for n, x in now.items()} for a, b in zip(begin, np.append(begin[1:], len(now["key"])))]


def _narrowed(cells: DataFrame, members: DataFrame, columns: list[str], percent: int, part: int) -> DataFrame:
    """Cells of about ``part`` * ``part`` pairs, of the members alone that have a mate in their cell under the
    distances known there; with these ``columns`` of the members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _each_cell(batches):
            met = [(cell, pairs) for cell in group if len(pairs := _compare(cell, percent))]
            if met:
                left = [_in_parts(cell, pairs, part) for cell, pairs in met]
                yield pa.RecordBatch.from_pydict({n: np.concatenate([x[n] for x in left]) for n in left[0]})

    rows = _dealt(cells).mapInArrow(run, "key long, cell long, probe boolean, rep long, component long, main boolean")
    return rows.join(members.select("rep", *columns), "rep")


def _in_parts(cell: dict[str, np.ndarray], pairs: np.ndarray, part: int) -> dict[str, np.ndarray]:
    """The rows of a cell that stand in ``pairs``, once for each part of the other side that they meet.

    There are as many parts as the pairs ask for: where a member has few mates, a large group gives no more rows
    for each member than a small one.
    """
    sides = [np.unique(cell["rep"][at], return_index=True, return_inverse=True) for at in pairs.T]
    dense = -(-len(pairs) // part**2)
    most = [max(1, min(SPREAD * part, int(len(first) / dense**0.5))) for _, first, _ in sides]
    parts = [rank // m for (_, _, rank), m in zip(sides, most)]
    out = []
    for side, (_, first, rank) in enumerate(sides):
        across = int(parts[1 - side].max()) + 1
        rank, other = np.divmod(np.unique(rank * across + parts[1 - side]), across)
        at, own = pairs[first[rank], side], rank // most[side]
        number = ((own << 32) + other if side == 0 else (other << 32) + own).astype(np.uint64)
        rows = {n: cell[n][at] for n in ("key", "probe", "rep", "component", "main")}
        out.append(rows | {"cell": mix(mix(cell["cell"][at].astype(np.uint64)) + number).view(np.int64)})
    names = ("key", "cell", "probe", "rep", "component", "main")
    return {n: np.concatenate([rows[n] for rows in out]) for n in names}


def _nearest_pairs(cells: DataFrame, percent: int, nearest: int) -> DataFrame:
    """Pairs (a, b) in different components that are under the distances: for each class and cell the nearest few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _each_cell(batches):
            yield _ends([cell["rep"][_compare(cell, percent, nearest)] for cell in group])

    return _dealt(cells).mapInArrow(run, "a long, b long").distinct()


def _cell_links(cells: DataFrame, shingle: int, percent: int) -> DataFrame:
    """All pairs (a, b) of the cells that are under the distances and whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _each_cell(batches):
            yield _ends([cell["rep"][_linked(cell, _compare(cell, percent), shingle, percent)] for cell in group])

    return _dealt(cells).mapInArrow(run, "a long, b long")


def _ends(pairs: list[np.ndarray]) -> pa.RecordBatch:
    found = np.concatenate(pairs)
    return pa.RecordBatch.from_arrays([pa.array(found.max(axis=1)), pa.array(found.min(axis=1))], ["a", "b"])


def _linked(cell: dict[str, np.ndarray], pairs: np.ndarray, shingle: int, percent: int) -> np.ndarray:
    """Those of the pairs (places in the cell) whose full sets reach the similarity; every text is cut up once."""
    used, at = np.unique(pairs, return_inverse=True)
    hashes, first = shingle_sets([cell["text"][i] for i in used], shingle)
    sets = [hashes[a:b] for a, b in zip(first[:-1], first[1:])]
    keep = [_alike(sets[a], sets[b], percent) for a, b in at.reshape(-1, 2).tolist()]
    return pairs[np.array(keep, bool)]


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Sorted batches regrouped so that no group is cut; a group is bounded by two blocks."""
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        begin = int(runs_of(*(now[k] for k in keys))[-1])
        if held and (begin or any(held[-1][k][-1] != now[k][0] for k in keys)):
            first = begin or 0
            head = {n: np.concatenate([*(h[n] for h in held), x[:first]]) for n, x in now.items()}
            yield head
            held = [{n: x[first:] for n, x in now.items()}]
        elif begin:
            yield {n: x[:begin] for n, x in now.items()}
            held = [{n: x[begin:] for n, x in now.items()}]
        else:
            held.append(now)
    if held:
        yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}


def _compare(cell: dict[str, np.ndarray], percent: int, nearest: int | None = None) -> np.ndarray:
    """Places (probe, other) in a cell of the pairs in different components that are under the distances and
    share no key before this one: all of them, or the ``nearest`` few of each probe."""
    key, probe = cell["key"][0], cell["probe"].astype(bool)
    here = int(key) % PLACES
    values = np.frombuffer(b"".join(cell["signature"].tolist()), np.uint16).reshape(-1, VALUES)
    # Rows may share a doc_id; only those that have this key belong here.
    own = chunk_key(values.reshape(-1, CHUNKS, WIDTH), here // WIDTH, here % WIDTH) == key
    probes, at = np.flatnonzero(probe & own), np.flatnonzero(~probe & own)
    out = [np.zeros((0, 2), np.int64)]
    if not len(probes) or not len(at):
        return out[0]
    rep, component, main, n = (cell[c] for c in ("rep", "component", "main", "n_shingles"))
    if "detail" in cell:
        packed = np.frombuffer(b"".join(cell["detail"].tolist()), np.uint8).reshape(-1, DETAIL // 2)
    block, sizes, others, after = values[at], n[at], component[at], main[at].astype(bool)
    for i in probes:
        fits = (others != component[i]) & (sizes * 100 >= n[i] * percent) & (n[i] * 100 >= sizes * percent)
        fits &= after | (rep[at] > rep[i])
        near = np.flatnonzero(fits)
        if not len(near):
            continue
        differ = block[near] != values[i]
        distance = differ.sum(axis=1)
        near_enough = np.flatnonzero(distance <= MOST_DIFFERENT)
        near_enough = near_enough[_first_key(differ[near_enough]) == here]
        chosen, distance = at[near[near_enough]], distance[near_enough]
        if "detail" in cell:
            odd = packed[chosen] ^ packed[i]
            alike = ((odd & 15) != 0).sum(axis=1) + ((odd >> 4) != 0).sum(axis=1) <= DETAIL_DIFFERENT
            chosen, distance = chosen[alike], distance[alike]
        if nearest is not None:
            chosen = chosen[np.argsort(distance, kind="stable")[:nearest]]
        out.append(np.stack([np.full(len(chosen), i), chosen], axis=1))
    return np.concatenate(out)


def _first_key(differ: np.ndarray) -> np.ndarray:
    """The number of the first key that a pair shares, from the places where its signatures differ."""
    errors = differ.reshape(-1, CHUNKS, WIDTH)
    chunk = (errors.sum(axis=2) <= 1).argmax(axis=1)
    # Without an error in the chunk all its keys are shared, and the first is number 0 of it.
    return chunk * WIDTH + errors[np.arange(len(errors)), chunk].argmax(axis=1)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document.

    ``component_id`` is the smallest doc_id that a document reaches over links, its own included;
    ``kept`` marks the document that has this id.
    """
    small_batches(docs.sparkSession)
    sketched = stored(sketch(docs, shingle), "sketch")
    classes = stored(
        sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature")),
        "classes",
    )
    shared = stored(shared_keys(index_keys(classes)), "shared")
    members = stored(member_table(docs, shared.select("rep").distinct(), shingle), "members")
    texts = members.select("rep", "text")
    links = stored(confirm(_best(_near(_star_pairs(shared), members, percent)), texts, shingle, percent), "links")
    labels = components(links)
    detailed = ["n_shingles", "signature", "detail"]
    for last in (False, True):
        cells = _narrowed(_open_cells(shared, labels, members), members, detailed, percent, PART)
        if last:
            whole = members.withColumn("text", F.col("text").cast("binary"))
            found = _cell_links(_narrowed(cells, whole, [*detailed, "text"], percent, TEXTS), shingle, percent)
        else:
            found = confirm(_nearest_pairs(cells, percent, NEAREST), texts, shingle, percent)
        labels = components(stored(found, "links"), labels)
    return _rows(sketched, classes, labels)


def _rows(sketched: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    named = (
        classes.select("set_key", "rep")
        .join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        .select("set_key", F.coalesce("component", "rep").alias("component_id"))
    )
    linked = sketched.join(named, "set_key", "left")
    # A text without words is alone; so is a row without doc_id.
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    rows = linked.select("doc_id", "n_shingles", component.alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of linked ones, the one with the smallest doc_id, with all its columns.

    Rows that repeat a doc_id with the same text count as one document; a row without doc_id stays.
    """
    found = near_duplicates(docs, shingle, percent)
    kept = found.where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("text").alias("tie"))
    doc_id = F.col("row.doc_id")
    stays = rows.join(kept, doc_id == F.col("_id"), "left_semi").withColumn("id", doc_id).dropDuplicates(["id", "tie"])
    return stays.select("row.*").unionByName(docs.where("doc_id IS NULL"))
