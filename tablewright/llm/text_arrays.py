"""Vectorised views of whole texts: many texts as one byte array, their words as spans with hashes.

Everything here works on one Arrow batch inside a task; nothing talks to Spark.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes that separate words: 0x20 and 0x09-0x0D.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
# Everything in ASCII but 0-9 and a-z; all bytes of other characters belong to words.
NON_ALNUM = np.ones(256, bool)
NON_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

# Parameters of glibc's mallopt.
M_TRIM_THRESHOLD, M_MMAP_THRESHOLD = -1, -3

_rng = np.random.default_rng(20_240_229)
_BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2^64."""
    if not _powers or len(_powers["up"]) < n:
        size = -(-n // (1 << 16)) << 16
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`span_hash` gives the hash of any span of ``codes``."""
    up, _ = powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], dtype=np.uint64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span, the same wherever the span stands."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hash(prefix: np.ndarray, size: int) -> np.ndarray:
    """:func:`span_hash` of every span of ``size`` symbols."""
    _, down = powers(len(prefix))
    spans = prefix[size:] - prefix[: len(prefix) - size]
    spans *= down[: len(spans)]
    spans += np.uint64(size)
    return mix(spans)


class Words:
    """The words of a list of texts.

    ``data`` holds the texts one after the other, each followed by a blank, so that no word crosses
    texts. ``start``/``end`` are the byte spans of all words, ``first`` gives for text i its words as
    ``first[i]:first[i + 1]``.
    """

    def __init__(self, texts: list[bytes], separators: np.ndarray = BLANKS, lower: bool = False):
        joined = b" ".join(texts) + b" "
        self.data = np.frombuffer(joined, np.uint8)
        if lower:
            self.data = LOWER[self.data]
        inside = ~separators[self.data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edges = np.concatenate([[0], edges])
        self.start, self.end = edges[0::2], edges[1::2]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_end = np.cumsum(lengths + 1)
        self.text_start = self.text_end - lengths - 1
        self.first = np.concatenate([[0], np.searchsorted(self.start, self.text_end)]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        return span_hash(prefix_hash(_BYTE_CODES[self.data]), self.start, self.end)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _BYTE_CODES[data]


def byte_prefix(data: np.ndarray) -> np.ndarray:
    return prefix_hash(_BYTE_CODES[data])


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def give_back() -> None:
    """Return freed memory to the system, so that a Python worker that is used again starts small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def keep_freed() -> None:
    """Let arrays of up to 32 MB reuse freed memory instead of asking the system for new pages each time; up to
    64 MB are kept, until :func:`give_back`."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(M_MMAP_THRESHOLD, 32 << 20)
        libc.mallopt(M_TRIM_THRESHOLD, 64 << 20)


def in_pieces(batches, limit: int = 2 << 20, rows: int = 20_000):
    """Arrow record batches cut so that the texts of a piece hold about ``limit`` bytes.

    A piece has one text at least, whatever its length; no text is cut.
    """
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0)
        sizes = lengths.cast(pa.int64()).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i, size in enumerate(sizes):
            if i > begin and (held + size > limit or i - begin >= rows):
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += int(size)
        if batch.num_rows > begin:
            yield batch.slice(begin)
    give_back()
