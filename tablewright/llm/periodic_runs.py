"""Periodic runs of words, found on a grammar of each text.

A run is a stretch of consecutive words in which words ``period`` apart are equal, of at least ``LEAST``
words and twice its smallest period, that no neighbouring word extends.

A piece of texts is worked on as one array of word numbers; numbers belong to one text, so nothing
crosses texts. Re-Pair replaces recurring pairs of neighbours by nonterminals, the frequent ones first,
all places of a round at once, until no pair recurs. A run lies in the smallest derivation node that holds
it and crosses the border of that node's two halves. So the runs that cross the border are worked out once
per nonterminal, within its expansion, and put down at all places where it is derived; for the symbols
that are left of a text, they are worked out at each border, within the text. Equal periods that overlap
by a period are one run.

Crossing runs come from exact ranks of all 2^k-grams that recur: a run of period p has max(12 - p, p)
places at least where words p apart are equal, and one of them is beside the border; so a gram of half
that length beside the border recurs p words away. Its extent is found by stepping down the ranks.

Nothing is shuffled, and each text is whole in one task with arrays of some 100 bytes a word. Defined
results: a null or empty text has no words and no runs; copies and repeated ids are rows of their own;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.graph import small_batches
from tablewright.llm.text_arrays import in_pieces, texts_of

LEAST = 12  # words of a run
CANDIDATES = 1 << 19  # pairs of a border and a period looked at together
RUN = "struct<start:long,length:long,period:long>"


class Rules(NamedTuple):
    """Nonterminals of ``LEAST`` words or more, and the symbols that are left.

    ``first``/``middle``/``end``: where each nonterminal is derived first, and the border of its halves.
    ``rule``/``place``: all places of all nonterminals, ordered by nonterminal. ``starts``: whether a symbol
    of the last sequence begins at the word.
    """

    first: np.ndarray
    middle: np.ndarray
    end: np.ndarray
    rule: np.ndarray
    place: np.ndarray
    starts: np.ndarray


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stable order of ``keys``, the rank of each key and how many keys have each rank."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(new) - 1
    return order, rank, np.diff(np.append(np.flatnonzero(new), len(keys)))


def without(dead: np.ndarray, symbol: np.ndarray, *others: np.ndarray, fresh: int) -> tuple:
    """The sequence with each stretch of dead symbols as one symbol that recurs nowhere."""
    keep = ~dead
    keep[1:] |= ~dead[:-1]
    keep[:1] = True
    symbol, dead = symbol[keep], dead[keep]
    lone = int(dead.sum())
    symbol[dead] = np.arange(fresh, fresh + lone)
    return (symbol, *[x[keep] for x in others], fresh + lone)


def re_pair(words: np.ndarray) -> Rules:
    """Replace recurring pairs until none is left.

    A pair is replaced where it is more frequent than the pairs that share a symbol with it (ties by
    number); of overlapping places of one pair every second is taken. A symbol neither of whose pairs
    recurs never takes part again and leaves the sequence that is worked on.
    """
    starts = np.ones(len(words), bool)
    first, middle, end, rules, places = [], [], [], [], []
    fresh, made = int(words.max()) + 1 if len(words) else 0, 0
    symbol, at, size = words.astype(np.int64), np.arange(len(words)), np.ones(len(words), np.int64)
    if len(symbol):
        symbol, at, size, fresh = without(np.bincount(symbol)[symbol] < 2, symbol, at, size, fresh=fresh)
    while len(symbol) > 1:
        _, pair, often = grouped(symbol[:-1] * fresh + symbol[1:])
        recurs = often[pair] > 1
        weight = np.where(recurs, often[pair] * len(often) + pair, -1)
        best = recurs.copy()
        best[1:] &= weight[1:] >= weight[:-1]
        best[:-1] &= weight[:-1] >= weight[1:]
        index = np.arange(len(weight))
        new = np.ones(len(weight), bool)
        new[1:] = weight[1:] != weight[:-1]
        best &= (index - np.maximum.accumulate(np.where(new, index, 0))) % 2 == 0
        left = np.flatnonzero(best)
        if not len(left):
            break
        _, number, _ = grouped(pair[left])
        starts[at[left + 1]] = False
        whole = size[left] + size[left + 1]
        _, once = np.unique(number, return_index=True)
        long = whole[once] >= LEAST
        if long.any():
            of = np.cumsum(long) - 1 + made
            first.append(at[left[once[long]]])
            middle.append(at[left[once[long]] + 1])
            end.append(first[-1] + whole[once[long]])
            held = long[number]
            rules.append(of[number[held]])
            places.append(at[left[held]])
            made += int(long.sum())
        symbol[left], size[left] = fresh + number, whole
        fresh += len(once)
        # A symbol may meet again what its merged neighbour stood beside; only pairs between two
        # symbols that did not change, both single, keep a symbol out of all later pairs.
        lone = np.zeros(len(symbol), bool)
        lone[1:-1] = ~recurs[1:] & ~recurs[:-1]
        lone[0], lone[-1] = not recurs[0], not recurs[-1]
        keep = np.ones(len(symbol), bool)
        keep[left + 1] = False
        symbol, at, size, lone = symbol[keep], at[keep], size[keep], lone[keep]
        symbol, at, size, fresh = without(lone, symbol, at, size, fresh=fresh)
        symbol, fresh = compact(symbol)
    joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (first, middle, end, rules, places)]
    order = np.argsort(joined[3], kind="stable")
    return Rules(*joined[:3], joined[3][order], joined[4][order], starts)


def compact(symbol: np.ndarray) -> tuple[np.ndarray, int]:
    """Symbols numbered from 0, so that two of them fit into one long."""
    _, rank, often = grouped(symbol)
    return rank, len(often)


class Level(NamedTuple):
    """Recurring grams of one length: ``rank`` per word (-1: recurs nowhere), and (rank, word) in order."""

    length: int
    rank: np.ndarray
    keys: np.ndarray


def recurring_grams(words: np.ndarray) -> list[Level]:
    """Ranks of all grams of 1, 2, 4, ... words that recur, up to the longest that do."""
    n, levels = len(words), []
    if not n:
        return levels
    alive = np.flatnonzero(np.bincount(words)[words] > 1)
    keys, length = words[alive].astype(np.int64), 1
    while len(alive):
        order, rank, often = grouped(keys)
        twice = often > 1
        number = np.where(twice, np.cumsum(twice) - 1, -1)[rank]
        of = np.full(n, -1, np.int32)
        of[alive] = number
        ordered = alive[order][number[order] >= 0]
        if not len(ordered):
            break
        levels.append(Level(length, of, of[ordered].astype(np.int64) * n + ordered))
        alive = np.flatnonzero(of[: n - length] >= 0)
        alive = alive[of[alive + length] >= 0]
        keys = of[alive].astype(np.int64) * (int(of.max()) + 1) + of[alive + length]
        length *= 2
    return levels


def ahead(levels: list[Level], i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """How many words from ``i`` on equal those from ``j`` on (i < j)."""
    same = np.zeros(len(i), np.int64)
    for level in reversed(levels):
        inside = j + same < n
        a, b = np.where(inside, i + same, 0), np.where(inside, j + same, 0)
        rank = level.rank[a]
        same += np.where(inside & (rank >= 0) & (rank == level.rank[b]), level.length, 0)
    return same


def behind(levels: list[Level], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before ``i`` equal those before ``j`` (i < j)."""
    same = np.zeros(len(i), np.int64)
    for level in reversed(levels):
        a = i - same - level.length
        inside = a >= 0
        a = np.where(inside, a, 0)
        rank = level.rank[a]
        b = np.where(inside, j - same - level.length, 0)
        same += np.where(inside & (rank >= 0) & (rank == level.rank[b]), level.length, 0)
    return same


def periods(level: Level) -> tuple[int, int]:
    """The periods whose runs hold a gram of this length, but not of the next, beside every border."""
    return (1 if level.length == 4 else 2 * level.length - 2), 4 * level.length - 3


def crossing(levels: list[Level], n: int, border: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """border number, start, end and smallest period of the runs that cross borders within low..high."""
    found = [np.zeros((4, 0), np.int64)]
    for level in levels:
        if level.length < 4:
            continue
        least, most = periods(level)
        limit = np.minimum(most, (high - low) // 2)
        for anchor, to_right in ((border - 1, True), (border - level.length, True), (border, False), (border - level.length + 1, False)):
            ok = (anchor >= low) & (anchor + level.length <= high) & (limit >= least)
            number = np.flatnonzero(ok)
            number = number[level.rank[anchor[number]] >= 0]
            at = anchor[number]
            if to_right:
                begin, stop = at + least, np.minimum(at + limit[number], high[number] - level.length)
            else:
                begin, stop = np.maximum(at - limit[number], low[number]), at - least
            group = level.rank[at].astype(np.int64) * n
            one = np.searchsorted(level.keys, group + begin)
            many = np.where(stop >= begin, np.searchsorted(level.keys, group + stop, side="right") - one, 0)
            number, at, one, many = (x[many > 0] for x in (number, at, one, many))
            for piece in portions(many, CANDIDATES):
                times = many[piece]
                of = np.repeat(number[piece], times)
                step = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
                other = level.keys[np.repeat(one[piece], times) + step] % n
                period = np.abs(other - np.repeat(at[piece], times))
                place = border[of] - np.where(to_right, 1, period)
                start = np.maximum(place - behind(levels, place, place + period), low[of])
                end = np.minimum(place + ahead(levels, place, place + period, n) + period, high[of])
                good = (end - start >= np.maximum(LEAST, 2 * period)) & (start < border[of]) & (border[of] < end)
                found.append(smallest(np.stack([of, start, end, period])[:, good]))
    return tuple(smallest(np.concatenate(found, axis=1)))


def smallest(runs: np.ndarray) -> np.ndarray:
    """One column per (border, start, end), with the smallest period."""
    runs = runs[:, np.lexsort(runs[::-1])]
    new = np.ones(runs.shape[1], bool)
    new[1:] = (runs[:3, 1:] != runs[:3, :-1]).any(axis=0)
    return runs[:, new]


def portions(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Slices of about ``limit`` in sum, of one element at least."""
    ends, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        held = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, held + limit, side="right")))
        yield slice(begin, stop)
        begin = stop


def merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals of one period that overlap by a period at least become one; ordered by period, start."""
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    if not len(start):
        return start, end, period
    _, group, _ = grouped(period)
    offset = group * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + offset)
    new = np.ones(len(start), bool)
    new[1:] = (group[1:] != group[:-1]) | (start[1:] + period[1:] + offset[1:] > reach[:-1])
    heads = np.flatnonzero(new)
    return start[heads], np.maximum.reduceat(end, heads), period[heads]


def runs_of(words: np.ndarray, text_first: np.ndarray) -> tuple[np.ndarray, ...]:
    """start, end and period of all runs, ordered by start, then period.

    ``words``: numbers that belong to one text each; ``text_first``: text i has the words
    ``text_first[i]:text_first[i + 1]``.
    """
    n = len(words)
    levels = recurring_grams(words)
    if not levels or levels[-1].length < 4:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    rules = re_pair(words)
    # Runs within nonterminals, once each, then wherever these are derived.
    number, start, end, period = crossing(levels, n, rules.middle, rules.first, rules.end)
    begins = np.searchsorted(rules.rule, np.arange(len(rules.first) + 1))
    times = np.diff(begins)[number]
    of = np.repeat(np.arange(len(number)), times)
    which = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
    shift = rules.place[begins[number[of]] + which] - rules.first[number[of]]
    # Borders of the symbols that are left.
    borders = rules.starts.copy()
    borders[text_first[:-1][np.diff(text_first) > 0]] = False
    border = np.flatnonzero(borders)
    text = np.searchsorted(text_first, border, side="right") - 1
    _, start_b, end_b, period_b = crossing(levels, n, border, text_first[text], text_first[text + 1])
    start, end, period = merged(
        np.concatenate([start[of] + shift, start_b]), np.concatenate([end[of] + shift, end_b]), np.concatenate([period[of], period_b])
    )
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def numbered(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The words of each text, all words as numbers of their text's own, and each text's first word."""
    words, numbers, base = [text.split() for text in texts], [], 0
    for of_text in words:
        number = dict(zip(dict.fromkeys(of_text), count(base)))
        numbers.append(np.fromiter(map(number.__getitem__, of_text), np.int64, len(of_text)))
        base += len(number)
    first = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return words, np.concatenate(numbers) if numbers else np.zeros(0, np.int64), first


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in in_pieces(batches, 1 << 20):
        words, numbers, first = numbered(texts_of(piece.column("text")))
        start, end, period = runs_of(numbers, first)
        # How many runs cover a word after their first period: a word so covered is left out.
        covers = np.zeros(len(numbers) + 1, np.int64)
        np.add.at(covers, start + period, 1)
        np.add.at(covers, end, -1)
        kept = np.cumsum(covers[:-1]) == 0
        text = np.searchsorted(first, start, side="right") - 1
        bounds = np.searchsorted(text, np.arange(len(words) + 1))
        collapsed = [
            b" ".join(w) if a == b else b" ".join([w[i] for i in np.flatnonzero(kept[f : f + len(w)])])
            for w, f, a, b in zip(words, first, bounds, bounds[1:])
        ]
        fields = [start - first[text], end - start, period]
        structs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in fields], ["start", "length", "period"])
        yield pa.RecordBatch.from_arrays(
            [
                piece.column("id"),
                pa.array(np.diff(first), pa.int64()),
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), structs),
                pa.array(collapsed, pa.binary()).cast(pa.string()),
            ],
            ["id", "n_words", "runs", "collapsed"],
        )


def periodic_runs(docs: DataFrame, text: str | Column = "text", key: str = "doc_id") -> DataFrame:
    """Per row: ``key``, n_words, ``runs`` (by start, then period) and ``collapsed``, the text's words
    joined by one blank without those that a run repeats: words in a run after its first period."""
    small_batches(docs.sparkSession)
    column = F.col(text) if isinstance(text, str) else text
    name = "`" + key.replace("`", "``") + "`"
    rows = docs.select(F.col(name).alias("id"), column.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(_find, f"id {kind}, n_words long, runs array<{RUN}>, collapsed string")
    return found.withColumnRenamed("id", key)
