"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features of a text are its word n-grams in two views, the words themselves (one and two) and their
shapes (one to three): which kinds of characters a word has and whether it repeats one of the two words
before it. Counts are damped by a square root and scaled to unit length, so a text's length alone says
nothing. A score is the logistic of a sparse dot product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biotope.llm import texts
from biotope.llm.sampling import labelled_sample

U = np.uint64
#: log2 of the number of weights.
BITS = 18
#: Most labelled rows that the model is fitted on.
SAMPLE_ROWS = 4000

#: Kinds of bytes that make a word's shape, one bit each.
_KINDS = [(65, 91), (97, 123), (48, 58), (0xC0, 0x100)]


def _kind_tables() -> list[np.ndarray]:
    tables = []
    for a, b in _KINDS:
        t = np.zeros(256, bool)
        t[a:b] = True
        tables.append(t)
    for signs in (b"#*$%&|<>", b"!", b".,;:?", b"\"'()[]{}=/\\@_-+~^`"):
        t = np.zeros(256, bool)
        t[list(signs)] = True
        tables.append(t)
    return tables


KINDS = _kind_tables()


def features(column: pa.Array):
    """(first row, last row, text index, weight index, value) of the non-zero features of each piece."""
    mask = U((1 << BITS) - 1)
    for first, last, raw, offsets in texts.pieces(column):
        starts, ends, doc = texts.word_spans(raw, offsets)
        words = texts.hash_spans(texts.lowered(raw), starts, ends)
        shape = np.zeros(len(words), U)
        for bit, table in enumerate(KINDS):
            counts = np.concatenate([[0], np.cumsum(table[raw], dtype=np.int64)])
            shape |= (counts[ends] > counts[starts]).astype(U) << U(bit)
        for back in (1, 2):
            same = np.zeros(len(words), bool)
            same[back:] = (words[back:] == words[:-back]) & (doc[back:] == doc[:-back])
            shape |= same.astype(U) << U(len(KINDS) + back)
        shape = texts.mix(shape + texts.LENGTH)
        keys, owners = [], []
        for view, tokens in ((1, words), (2, shape)):
            for n in (1, 2) if view == 1 else (1, 2, 3):
                grams, owner = texts.hash_grams(tokens, doc, n)
                keys.append(texts.mix(grams + U(view * 8 + n)) & mask)
                owners.append(owner)
        flat = np.concatenate(owners).astype(U) << U(BITS) | np.concatenate(keys)
        flat, times = np.unique(flat, return_counts=True)
        owner, index = (flat >> U(BITS)).astype(np.int64), (flat & mask).astype(np.int64)
        value = np.sqrt(times)
        norm = np.sqrt(np.bincount(owner, weights=value * value, minlength=last - first))
        yield first, last, owner, index, value / norm[owner]


@dataclass
class Ftrl:
    """FTRL-proximal for logistic loss: per-weight rates, L1 and L2 terms."""

    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.2
    l2: float = 0.5

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 3) -> tuple[np.ndarray, float]:
        """(weights, bias) after passes over (indices, values, label) rows in the order given."""
        z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
        bias_at = 1 << BITS
        l1, l2 = np.full(len(z), self.l1), np.full(len(z), self.l2)
        l1[bias_at] = l2[bias_at] = 0

        def weights(i):
            zi = z[i]
            shrunk = np.sign(zi) * l1[i] - zi
            return np.where(np.abs(zi) <= l1[i], 0.0, shrunk / ((self.beta + np.sqrt(n[i])) / self.alpha + l2[i]))

        for _ in range(epochs):
            for index, value, label in rows:
                i, x = np.append(index, bias_at), np.append(value, 1.0)
                w = weights(i)
                g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
                root = np.sqrt(n[i])
                n[i] += g * g
                z[i] += g - (np.sqrt(n[i]) - root) / self.alpha * w
        w = weights(np.arange(len(z)))
        return w[:-1], float(w[-1])


@dataclass
class Classifier:
    weights: np.ndarray
    bias: float


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = SAMPLE_ROWS, id_column: str = "doc_id", text: str = "text") -> Classifier:
    """Fit on at most ``limit`` labelled rows; their features are made on the executors.

    Without labelled rows the model scores every text 0.5.
    """
    texts.settings(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, limit, id_column, text)

    def run(batches):
        for batch in batches:
            for first, last, owner, index, value in features(batch.column(1)):
                at = np.searchsorted(owner, np.arange(last - first + 1))
                packed = [pa.array([x[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary()) for x in (index.astype("<i4"), value.astype("<f4"))]
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(first, last - first) for k in (0, 2)] + packed, ["doc_id", "label", "index", "value"])

    kind = docs.schema[id_column].dataType.simpleString()
    made = sample.select("doc_id", "text", F.col("label").cast("double").alias("label")).mapInArrow(run, f"doc_id {kind}, label double, index binary, value binary")
    rows = sorted(made.collect(), key=lambda r: (r.doc_id * 2654435761 % 4294967291 if isinstance(r.doc_id, int) else r.doc_id))
    weights, bias = Ftrl().fit([(np.frombuffer(r["index"], "<i4"), np.frombuffer(r["value"], "<f4"), r.label) for r in rows])
    return Classifier(weights, bias)


def score(docs: DataFrame, model: Classifier, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of each row's whole text; a text without words scores by the bias alone.

    Repeated rows give repeated results; extra columns are ignored; an empty table gives an empty table.
    """
    texts.settings(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        m = shared.value
        for batch in batches:
            for first, last, owner, index, value in features(batch.column(1)):
                margin = np.bincount(owner, weights=m.weights[index] * value, minlength=last - first) + m.bias
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(1 / (1 + np.exp(-np.clip(margin, -35, 35))))], ["doc_id", "score"])

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
