"""Byte-level BPE with a rank queue of hierarchical bitmaps.

The merges of one pre-token are found without a heap: every merge rank has a bucket of linked-list
positions, a two-level bitmap marks the ranks whose buckets hold something, and find-first-set gives
the next rank. A merge unlinks one position and queues at most two new pairs; entries that a merge
made stale are skipped when they come up. The work is linear in the length of the pre-token times the
cost of a queue step, so pre-tokens of millions of bytes are as cheap per byte as words.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biotope.llm import texts

#: Ranks in one leaf of the bitmap; the top level has a bit for each leaf.
LEAF_BITS = 8
LEAF_MASK = (1 << LEAF_BITS) - 1
#: Most pre-tokens in each of the two generations that a Python worker remembers (some 200 bytes each), and
#: the longest of them in characters. What is remembered changes the speed only.
REMEMBERED, REMEMBERED_CHARS = 500_000, 48

Ranks = dict[bytes, int]


def read_ranks(path: str) -> Ranks:
    """Ranks of a file with one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_ids(piece: bytes, ranks: Ranks) -> list[int]:
    """Ids of one pre-token: the lowest rank merges first, the leftmost of equal ones."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    rank_of = ranks.get
    token = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    current = [rank_of(piece[i : i + 2], -1) for i in range(n - 1)]  # rank of the pair that starts here; -1: none or unlinked
    current.append(-1)
    buckets: dict[int, list[int]] = {}
    leaves: dict[int, int] = {}
    top = 0
    pairs = 0  # that are neither stale nor merged; what is queued beyond the last one is stale
    fresh = [(i, rank) for i, rank in enumerate(current) if rank >= 0]
    while True:
        for at, rank in fresh:
            pairs += 1
            bucket = buckets.get(rank)
            if bucket is not None:
                heappush(bucket, at)
                continue
            buckets[rank] = [at]
            leaf = rank >> LEAF_BITS
            bits = leaves.get(leaf, 0)
            leaves[leaf] = bits | 1 << (rank & LEAF_MASK)
            if not bits:
                top |= 1 << leaf
        if not pairs:
            break
        i = rank = -1
        while rank < 0 or current[i] != rank:
            leaf = (top & -top).bit_length() - 1
            bits = leaves[leaf]
            low = bits & -bits
            rank = (leaf << LEAF_BITS) + low.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
                continue
            i = bucket[0]
            del buckets[rank]
            bits ^= low
            leaves[leaf] = bits
            if not bits:
                top ^= 1 << leaf
        gone = after[i]
        token[i] += token[gone]
        pairs -= 1
        if current[gone] >= 0:
            current[gone] = -1
            pairs -= 1
        after[i] = follow = after[gone]
        fresh = []
        if follow < n:
            before[follow] = i
            current[i] = rank = rank_of(token[i] + token[follow], -1)
            if rank >= 0:
                fresh.append((i, rank))
        else:
            current[i] = -1
        at = before[i]
        if at >= 0:
            rank = rank_of(token[at] + token[i], -1)
            if rank != current[at]:
                if current[at] >= 0:
                    pairs -= 1
                current[at] = rank
                if rank >= 0:
                    fresh.append((at, rank))
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i]])
        i = after[i]
    return out


#: What the Unicode classes of a splitting pattern come to in ASCII.
ASCII_CLASSES = {"\\p{L}": "A-Za-z", "\\p{N}": "0-9", "\\s": "\\t-\\r "}


def ascii_pattern(pattern: str) -> str | None:
    """The pattern for texts of ASCII only, in the standard library's terms, or None if it has other classes."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        if pattern[i] == "\\":
            known = next((c for c in ASCII_CLASSES if pattern.startswith(c, i)), None)
            if known:
                out.append(ASCII_CLASSES[known] if inside else f"[{ASCII_CLASSES[known]}]")
                i += len(known)
                continue
            if pattern.startswith("\\S", i) and not inside:
                out.append("[^\\t-\\r ]")
                i += 2
                continue
            return None
        if pattern[i] in "[]":
            if (pattern[i] == "[") == inside:
                return None
            inside = not inside
        out.append(pattern[i])
        i += 1
    return "".join(out)


class Memory:
    """Ids of pre-tokens seen before, for as long as the worker process lives: a young and an old generation."""

    def __init__(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def put(self, piece: str, ids: bytes) -> None:
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        self.young[piece] = ids


_memories: dict[str, Memory] = {}


def encoder(ranks: Ranks, pattern: str, name: str | None = None) -> Callable[[str], bytes]:
    """Function from a text to its ids as little-endian unsigned 32-bit integers.

    Encoders of one ``name`` (a digest of vocabulary and pattern) share their memory within a process.
    """
    import regex

    split = regex.compile(pattern).findall
    narrow = ascii_pattern(pattern)
    split_ascii = re.compile(narrow).findall if narrow else split  # three times as fast
    memory = _memories.setdefault(name, Memory()) if name else Memory()

    def ids_of(piece: str) -> bytes:
        ids = memory.old.get(piece) or np.array(merge_ids(piece.encode("utf-8", "replace"), ranks), "<u4").tobytes()
        if len(piece) <= REMEMBERED_CHARS:
            memory.put(piece, ids)
        return ids

    def encode(text: str) -> bytes:
        # a put may start a new young generation in mid-text; the old one still answers
        get = memory.young.get
        return b"".join([get(piece) or ids_of(piece) for piece in (split_ascii if text.isascii() else split)(text)])

    return encode


def digest_of(ranks: Ranks, pattern: str) -> str:
    """Name under which encoders share memory."""
    h = hashlib.sha256(pattern.encode())
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        h.update(rank.to_bytes(4, "little") + len(token).to_bytes(4, "little") + token)
    return h.hexdigest()


def decoder(ranks: Ranks) -> Callable[[bytes], bytes]:
    """Function from packed ids to the bytes they stand for."""
    token_of = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        token_of[rank] = token
    return lambda ids: b"".join(map(token_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _ranks(spark, path: str):
    """The rank table in every task; its size is that of one vocabulary file."""
    return spark.sparkContext.broadcast(read_ranks(path))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column of token ids (array<int>) for each whole text; null and empty texts have none.

    Other columns, repeated rows and row order are kept; a column named like ``ids`` is replaced.
    """
    texts.settings(docs.sparkSession)
    table = _ranks(docs.sparkSession, path)
    name = digest_of(table.value, pattern)
    kept = [c for c in docs.columns if c != ids]

    def run(batches):
        encode_text = encoder(table.value, pattern, name)
        for batch in batches:
            packed = [encode_text(t) if t else b"" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(packed), "<i4"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in kept] + [pa.ListArray.from_arrays(pa.array(at), values)], [*kept, ids]
            )

    schema = docs.select(*kept).withColumn(ids, F.array(F.lit(0))).schema
    return docs.select(*kept).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each whole text, encoded and decoded again.

    Null texts count as empty; repeated rows give repeated results; extra columns are ignored.
    """
    texts.settings(docs.sparkSession)
    table = _ranks(docs.sparkSession, path)
    name = digest_of(table.value, pattern)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        encode_text, decode_ids = encoder(table.value, pattern, name), decoder(table.value)
        for batch in batches:
            counts, ids_hash, text_hash = [], [], []
            for t in batch.column(1).to_pylist():
                ids = encode_text(t) if t else b""
                counts.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(decode_ids(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
