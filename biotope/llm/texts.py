"""Texts of an Arrow batch as byte arrays: pieces, word spans and 64-bit hashes of spans and n-grams.

All functions work on whole texts. A piece holds the bytes of consecutive texts
end to end with the offsets of their bounds, so that one numpy call serves many
short texts, and a very long text is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from biotope.session import ship_package

#: Bytes after which a piece is closed; arrays of a piece stay within a core's cache or little more.
PIECE_BYTES = 1 << 19
#: Positions hashed at a time.
BLOCK = 1 << 17

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LENGTH = U(0xD6E8FEB86659FD93)

#: The white space that separates words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers: dict[str, np.ndarray] = {}


def settings(spark) -> None:
    """Batches of at most 1,000 rows, so that a Python worker holds a few megabytes of text at a time."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive texts; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    texts = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(texts)
    if n == 0:
        return
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(last, first + 1))
        lo, hi = offsets[first], offsets[last]
        yield first, last, whole[lo:hi], offsets[first : last + 1] - lo
        first = last


def word_spans(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text index of each word; no word reaches over a text's bounds."""
    if buffer.size == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    space = SPACE[buffer]
    filled = offsets[1:] > offsets[:-1]
    before, after = np.empty_like(space), np.empty_like(space)
    before[0] = after[-1] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    before[offsets[:-1][filled]] = True
    after[offsets[1:][filled] - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Spread each value over all 64 bits."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i up to n, modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) <= n:
        size = max(2 * BLOCK, n + 1)
        for name, base in (("up", BASE), ("down", INVERSE)):
            p = np.full(size, base, U)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=U)
    return _powers["up"], _powers["down"]


def prefix_sums(block: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums of bytes, one longer than the block."""
    up, _ = powers(len(block))
    out = np.zeros(len(block) + 1, U)
    np.cumsum((block.astype(U) + U(1)) * up[: len(block)], dtype=U, out=out[1:])
    return out


def _hash_long(span: np.ndarray) -> np.ndarray:
    """Polynomial sum of a span of any length, block by block with a carried power."""
    up, _ = powers(BLOCK)
    total, power = np.zeros(1, U), np.ones(1, U)
    for at in range(0, len(span), BLOCK):
        block = span[at : at + BLOCK]
        total += power * prefix_sums(block)[-1:]
        power *= up[len(block) : len(block) + 1]
    return total


def hash_spans(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span; starts ascend. Equal bytes hash equally wherever they stand."""
    out = np.empty(len(starts), U)
    long = np.flatnonzero(ends - starts > BLOCK)
    for k in long:
        out[k] = mix(_hash_long(buffer[starts[k] : ends[k]]) + (ends[k : k + 1] - starts[k : k + 1]).astype(U) * LENGTH)[0]
    if len(long):
        short = np.flatnonzero(ends - starts <= BLOCK)
        out[short] = hash_spans(buffer, starts[short], ends[short])
        return out
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, lo + BLOCK)))
        hi = int(ends[i:j].max())
        sums = prefix_sums(buffer[lo:hi])
        _, down = powers(hi - lo)
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(U) * LENGTH)
        i = j
    return out


def hash_grams(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of each run of ``n`` words inside one text, in order."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    inside = doc[:count] == doc[n - 1 :]
    up, _ = powers(n + 1)
    total = np.full(count, n, U) * LENGTH
    for k in range(n):
        total += words[k : k + count] * up[k + 1]
    return mix(total[inside]), doc[:count][inside]


def lowered(buffer: np.ndarray) -> np.ndarray:
    """A to Z in lower case; other bytes as they are."""
    return buffer + (((buffer >= 65) & (buffer <= 90)).astype(np.uint8) << 5)
