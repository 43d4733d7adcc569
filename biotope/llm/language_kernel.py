"""Language identification by string kernels.

Two texts are as alike as the n-grams of one to four bytes that both have (a blended-spectrum presence
kernel, scaled by the numbers of n-grams). A bounded set of labelled passages are the landmarks of a
Nyström approximation; kernel ridge regression of each language against the rest is solved in the space
they span. A text is scored passage by passage over its whole length: one sparse presence matrix times
the landmarks' gives the kernel values of a batch, one more product the languages' scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biotope.llm import texts
from biotope.llm.sampling import collected, labelled_sample

U = np.uint64
#: Sizes of n-grams, and log2 of the table that they are hashed to.
ORDERS, BITS = (1, 2, 3, 4), 13
#: Most labelled rows in the fit, landmarks among their passages, and bytes of a passage.
SAMPLE_ROWS, LANDMARKS, PASSAGE = 3000, 160, 3000
RIDGE = 1e-3
UNKNOWN = "und"
DIM = 1 << BITS


def _letters() -> np.ndarray:
    """Bytes as they are compared: lower case; everything but letters and bytes beyond ASCII is one space."""
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


LETTERS = _letters()


def presence(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Passages x DIM matrix of the n-grams each passage has, scaled to unit length."""
    folded = LETTERS[raw].astype(U)
    rows = len(bounds) - 1
    owner = np.repeat(np.arange(rows), np.diff(bounds))
    out = np.zeros((rows, DIM), np.float32)
    code = np.zeros(len(folded), U)
    for n in range(1, max(ORDERS) + 1):
        code = code[: len(folded) - n + 1] * U(256) + folded[n - 1 :] if n > 1 else folded
        if not len(code):
            break
        if n in ORDERS:
            inside = owner[: len(code)] == owner[n - 1 :]
            slot = (code + U(n)) * texts.BASE >> U(64 - BITS)
            out[owner[: len(code)][inside], slot[inside].astype(np.int64)] = 1
    count = out.sum(axis=1)
    return out / np.sqrt(np.maximum(count, 1))[:, None]


def passages(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of passages of at most PASSAGE bytes over whole texts, and the text of each."""
    sizes = np.diff(offsets)
    parts = np.maximum(1, -(-sizes // PASSAGE))
    owner = np.repeat(np.arange(len(sizes)), parts)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.append(offsets[owner] + sizes[owner] * k // parts[owner], offsets[-1]), owner


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # DIM x landmarks, columns of unit length
    weights: np.ndarray  # landmarks x languages


def _pieces(bodies: list[str]):
    return texts.pieces(pa.array(bodies, pa.large_string()), 1 << 18)


def fit_texts(bodies: list[str], langs: list[str]) -> Model:
    """Landmarks and weights from labelled texts; the first passages of each language take turns as landmarks."""
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.zeros((DIM, 0), np.float32), np.zeros((0, 0)))
    each = max(1, LANDMARKS // len(languages))
    matrices, labels = [], []
    for first, last, raw, offsets in _pieces(bodies):
        bounds, owner = passages(offsets)
        rows = presence(raw, bounds)
        matrices.append(rows)
        labels += [langs[first + o] for o in owner]
    label = np.array([languages.index(x) for x in labels])
    chosen = np.concatenate([np.flatnonzero(label == k)[:: max(1, (label == k).sum() // each)][:each] for k in range(len(languages))])
    place, stored = 0, []
    for m in matrices:
        mine = chosen[(chosen >= place) & (chosen < place + len(m))] - place
        stored.append(m[np.sort(mine)])
        place += len(m)
    landmarks = np.concatenate(stored).T.copy()
    gram = (landmarks.T @ landmarks).astype(float)
    value, vector = np.linalg.eigh(gram)
    use = value > 1e-6 * value.max()
    root = vector[:, use] / np.sqrt(value[use])
    z = np.concatenate([(m @ landmarks).astype(float) @ root for m in matrices])
    z1 = np.concatenate([z, np.ones((len(z), 1))], axis=1)
    target = np.where(label[:, None] == np.arange(len(languages)), 1.0, -1.0)
    share = np.bincount(label, minlength=len(languages)) / len(label)
    weight = 1 / share[label]
    normal = (z1 * weight[:, None]).T @ z1 + RIDGE * weight.sum() * np.eye(z1.shape[1])
    solved = np.linalg.solve(normal, (z1 * weight[:, None]).T @ target)
    return Model(languages, landmarks, np.concatenate([root @ solved[:-1], solved[-1:]]))


def fit(docs: DataFrame, labels: DataFrame, lang: str = "lang", limit: int = SAMPLE_ROWS, id_column: str = "doc_id", text: str = "text") -> Model:
    """Fit on at most ``limit`` rows of ``docs`` whose id has a language in ``labels``."""
    bodies, langs = collected(labelled_sample(docs, labels, lang, limit, id_column, text))
    return fit_texts(bodies, langs)


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row's whole text.

    The score is the share that the softmax of the mean passage scores gives to the best language.
    Null texts, texts without a letter and every text under a model without languages: ``und``, 0.
    Repeated rows give repeated results; extra columns are ignored; an empty table gives an empty table.
    """
    texts.settings(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        m = shared.value
        names = pa.array([*m.languages, UNKNOWN])
        for batch in batches:
            lettered = np.array(batch.column(2).to_pylist(), bool)
            for first, last, raw, offsets in texts.pieces(batch.column(1), 1 << 18):
                rows = last - first
                best, score = np.full(rows, len(m.languages)), np.zeros(rows)
                if m.languages:
                    bounds, owner = passages(offsets)
                    total = np.zeros((rows, len(m.languages)))
                    for a in range(0, len(owner), 128):
                        part = owner[a : a + 128]
                        edge = bounds[a : a + len(part) + 1]
                        kernel = presence(raw[edge[0] : edge[-1]], edge - edge[0]) @ m.landmarks
                        np.add.at(total, part, kernel @ m.weights[:-1] + m.weights[-1])
                    total /= np.bincount(owner, minlength=rows)[:, None]
                    e = np.exp(4 * (total - total.max(axis=1, keepdims=True)))
                    found = lettered[first:last]
                    best = np.where(found, total.argmax(axis=1), best)
                    score = np.where(found, (e / e.sum(axis=1, keepdims=True)).max(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), names.take(pa.array(best)), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(
        F.col(id_column).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False)).alias("lettered")
    ).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
