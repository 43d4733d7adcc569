"""Hashes of spans: the polynomial as written down, for spans of any length, in bounded memory."""

import tracemalloc

import numpy as np

from biotope.llm import texts


def plain(span: bytes) -> int:
    base, total, power = int(texts.BASE), 0, 1
    for c in span:
        total = (total + (c + 1) * power) % (1 << 64)
        power = power * base % (1 << 64)
    h = (total + len(span) * int(texts.LENGTH)) % (1 << 64)
    return int(texts.mix(np.array([h], np.uint64))[0])


def test_hashes_of_short_and_long_spans():
    """Spans below, at and above a block, among short ones, hash as the polynomial says and wherever they stand."""
    rng = np.random.default_rng(0)
    long = bytes(rng.integers(97, 123, int(2.5 * texts.BLOCK)).astype(np.uint8))
    parts = [b"abc", long, b"x", long[: texts.BLOCK], b"abc", long[: texts.BLOCK + 1], long, b"end"]
    buffer = np.frombuffer(b" ".join(parts), np.uint8)
    starts, ends, _ = texts.word_spans(buffer, np.array([0, len(buffer)]))
    assert len(starts) == len(parts)
    found = texts.hash_spans(buffer, starts, ends)
    assert [int(h) for h in found] == [plain(p) for p in parts]
    assert found[0] == found[4] and found[1] == found[6] and len(set(found.tolist())) == 6


def test_a_very_long_word_needs_little_memory():
    """16 MB without a space: hashing takes blocks, and no table grows with the word."""
    buffer = np.full(16 << 20, 97, np.uint8)
    texts.powers(2 * texts.BLOCK)
    before = len(texts.powers(1)[0])
    tracemalloc.start()
    texts.hash_spans(buffer, np.array([0]), np.array([len(buffer)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20 and len(texts.powers(1)[0]) == before
