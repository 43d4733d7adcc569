"""Toxic spans by a linear-chain conditional random field, and the document scores that follow from them.

Two tags (clean, toxic) over the words of a text. A word's emission is the sum of weights of hashed
features: the word, its beginnings of four to six characters, its last three. Tokens get their training
tags from the labelled documents: inside a toxic document a word is toxic where the word or a beginning
of it is tied to toxic documents well beyond chance. Forward-backward runs over whole texts, all texts of a
batch at once, as products of 2 x 2 matrices in blocks, so a text's length does not matter.

A document's score is a logistic function of the expected number of toxic words and of the most
certain one; words whose marginal passes a limit make up the offending spans.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biotope.llm import texts
from biotope.llm.sampling import class_counts, collected, labelled_sample

U = np.uint64
#: log2 of the number of weights, and documents that a feature of the fit is found in at least.
BITS, LEAST_DOCS = 21, 3
#: Least log-likelihood ratios (doubled) of a feature that is tied to toxic documents: of the documents that hold it,
#: and of its occurrences, of which so many must be in toxic documents. A word that clean documents hold once by chance
#: and toxic ones time and again is tied even where few documents of its language are labelled.
TIED_DOCS, TIED_WORDS, TIED_SHARE = 10.8, 24.0, 0.7
#: Most labelled rows in the fit, a third of them toxic where there are as many; the document score weighs
#: the classes by their true shares.
SAMPLE_ROWS = 4500
#: Marginal from which on a word belongs to an offending span.
SPAN_LIMIT = 0.5
#: Words whose marginals are in memory at a time in the fit.
FIT_WORDS = 150_000
#: Positions that one step of the chain takes side by side.
STRIDE = 32
WIDTHS = (4, 5, 6)


def tokens(raw: np.ndarray, offsets: np.ndarray):
    """(starts, ends, text index, features x words table of hashes) of a piece's words.

    Words lose leading and trailing ASCII signs, so that a comma does not make another word.
    """
    starts, ends, doc = texts.word_spans(raw, offsets)
    low = texts.lowered(raw)
    sign = np.zeros(256, bool)
    sign[33:48] = sign[58:65] = sign[91:97] = sign[123:127] = True
    marks = sign[low]
    inner_s, inner_e = starts.copy(), ends.copy()
    for _ in range(3):
        inner_s += (inner_s < inner_e - 1) & marks[np.minimum(inner_s, len(raw) - 1)] if len(raw) else 0
        inner_e -= (inner_e - 1 > inner_s) & marks[np.maximum(inner_e - 1, 0)] if len(raw) else 0
    views = [texts.hash_spans(low, inner_s, inner_e)]
    for width in WIDTHS:
        views.append(texts.hash_spans(low, inner_s, np.minimum(inner_s + width, inner_e)))
    views.append(texts.hash_spans(low, np.maximum(inner_e - 3, inner_s), inner_e))
    table = np.stack([texts.mix(v + U(k + 1)) >> U(64 - BITS) for k, v in enumerate(views)]).astype(np.int32) if len(starts) else np.zeros((len(WIDTHS) + 2, 0), np.int32)
    return starts, ends, doc, table


def running_states(m: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Both parts of the row vectors v_t = v_(t-1) @ m_t, each scaled to sum 1; v_0 is (1, 1) @ m_0.

    ``m`` has the matrices as four arrays (00, 01, 10, 11). They are multiplied side by side in blocks, the
    blocks' products run through the same function, and the blocks start again from what it gives.
    """
    total = len(m[0])
    if total <= STRIDE:
        out, v0, v1 = np.empty((2, total)), 1.0, 1.0
        for t, (a, b, c, d) in enumerate(zip(*(x.tolist() for x in m), strict=True)):
            v0, v1 = v0 * a + v1 * c, v0 * b + v1 * d
            scale = 1 / (v0 + v1)
            v0, v1 = v0 * scale, v1 * scale
            out[:, t] = v0, v1
        return out[0], out[1]
    blocks = -(-total // STRIDE)
    grid = []
    for x, same in zip(m, (1.0, 0.0, 0.0, 1.0), strict=True):
        padded = np.full(blocks * STRIDE, same)
        padded[:total] = x
        grid.append(np.ascontiguousarray(padded.reshape(blocks, STRIDE).T))
    p, q, r, s = (x[0] for x in grid)
    for a, b, c, d in zip(*(x[1:] for x in grid), strict=True):
        p, q, r, s = p * a + q * c, p * b + q * d, r * a + s * c, r * b + s * d
        scale = 1 / (p + q + r + s)
        p, q, r, s = p * scale, q * scale, r * scale, s * scale
    v0, v1 = (np.append(0.5, x[:-1]) for x in running_states([p, q, r, s]))
    out0, out1 = np.empty((STRIDE, blocks)), np.empty((STRIDE, blocks))
    for j, (a, b, c, d) in enumerate(zip(*grid, strict=True)):
        v0, v1 = v0 * a + v1 * c, v0 * b + v1 * d
        scale = 1 / (v0 + v1)
        out0[j] = v0 = v0 * scale
        out1[j] = v1 = v1 * scale
    return out0.T.ravel()[:total], out1.T.ravel()[:total]


def forward_backward(emission: np.ndarray, doc: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = True):
    """Tag marginals (T, 2) and pair marginals (T, 2, 2) of (tag before, tag); pairs of a text's first word are 0.

    ``emission`` is the toxic tag's log weight against the clean one; ``trans`` and ``start`` are weights.
    """
    total = len(emission)
    if not total:
        return np.zeros((0, 2)), np.zeros((0, 2, 2)) if pairs else None
    e = np.exp(np.clip(emission, -30, 30))
    first = np.ones(total, bool)
    first[1:] = doc[1:] != doc[:-1]
    last = np.append(first[1:], True)
    step = [np.full(total, trans[0, 0]), trans[0, 1] * e, np.full(total, trans[1, 0]), trans[1, 1] * e]
    begin = [start[0] / 2, start[1] * e / 2]
    onward = [np.where(first, begin[k % 2], x) for k, x in enumerate(step)]
    alpha = running_states(onward)
    # backwards the matrices of the next word act transposed; a text's last word starts anew
    follow = [np.where(last, 0.5, np.append(x[1:], 0.5))[::-1] for x in (step[0], step[2], step[1], step[3])]
    beta = [x[::-1] for x in running_states(follow)]
    tag = np.stack([alpha[0] * beta[0], alpha[1] * beta[1]], axis=1)
    tag /= tag.sum(axis=1, keepdims=True)
    if not pairs:
        return tag, None
    before = [np.append(0.5, x[:-1]) for x in alpha]
    pair = np.stack([before[0] * step[0] * beta[0], before[0] * step[1] * beta[1], before[1] * step[2] * beta[0], before[1] * step[3] * beta[1]], axis=1)
    pair[first] = 0
    pair /= np.maximum(pair.sum(axis=1, keepdims=True), 1e-300)
    return tag, pair.reshape(-1, 2, 2)


@dataclass
class Crf:
    weights: np.ndarray  # of hashed features
    bias: float
    trans: np.ndarray
    start: np.ndarray
    calibration: np.ndarray  # of (1, log expected count, log odds of the most certain word)


def _emission(table: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    return weights[table].sum(axis=0) + bias


def _document_features(tag: np.ndarray, doc: np.ndarray, rows: int) -> np.ndarray:
    p = np.clip(tag[:, 1], 1e-9, 1 - 1e-9)
    most = np.full(rows, 1e-9)
    np.maximum.at(most, doc, p)
    return np.stack([np.ones(rows), np.log(np.bincount(doc, weights=p, minlength=rows) + 1e-3), np.log(most / (1 - most))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> np.ndarray:
    """Newton's method on weighted rows, with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + 0.05 * w
        curvature = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        w -= np.linalg.solve(curvature, gradient)
    return w


def _known_features(table: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots that enough documents have, whether each is tied to toxic ones); the last view ties nothing."""
    slots, tied = [], []
    log = lambda x: np.log(np.maximum(x, 1e-12))
    bounded = lambda x: min(max(float(x), 1e-6), 1 - 1e-6)
    shares = bounded(toxic.mean()), bounded(toxic[doc].mean())

    def ratio(bad: np.ndarray, every: np.ndarray, share: float) -> np.ndarray:
        return 2 * (bad * log(bad / every / share) + (every - bad) * log((1 - bad / every) / (1 - share)))

    for view, row in enumerate(table):
        pairs, times = np.unique(doc.astype(U) << U(BITS) | row.astype(U), return_counts=True)
        slot, owner = (pairs & U((1 << BITS) - 1)).astype(np.int32), (pairs >> U(BITS)).astype(np.int64)
        slot, inverse, every = np.unique(slot, return_inverse=True, return_counts=True)
        bad = np.bincount(inverse, weights=toxic[owner], minlength=len(slot))
        words, bad_words = (np.bincount(inverse, weights=w, minlength=len(slot)) for w in (times, times * toxic[owner]))
        enough = every >= LEAST_DOCS
        slots.append(slot[enough])
        sure = (ratio(bad, every, shares[0]) > TIED_DOCS) & (ratio(bad_words, words, shares[1]) > TIED_WORDS)
        more = (bad_words >= TIED_SHARE * words) & (bad >= LEAST_DOCS) & (bad > every * shares[0])
        tied.append((sure & more)[enough] & (view < len(table) - 1))
    slot, first = np.unique(np.concatenate(slots), return_index=True)
    return slot, np.concatenate(tied)[first]


def _stretches(doc: np.ndarray) -> list[slice]:
    """Slices of whole texts with about FIT_WORDS words each."""
    cuts, heads = [0], np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, int)
    while len(heads) and cuts[-1] < len(doc):
        k = np.searchsorted(heads, cuts[-1] + FIT_WORDS)
        cuts.append(int(heads[k]) if k < len(heads) else len(doc))
    return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def fit_texts(bodies: list[str], labels: list[int], share: float | None = None, rounds: int = 30, rate: float = 0.5, l2: float = 2e-4) -> Crf:
    """``share``: of toxic rows where the sample was drawn, that of the sample itself if not given.

    Tag the tokens, fit the field by Adagrad on its log-likelihood, then the document score on all rows."""
    toxic = np.array(labels, float)
    parts = [(first, *tokens(raw, offsets)) for first, _, raw, offsets in texts.pieces(pa.array(bodies, pa.large_string()))]
    doc = np.concatenate([p[3] + p[0] for p in parts]) if parts else np.zeros(0, np.int64)
    table = np.concatenate([p[4] for p in parts], axis=1) if parts else np.zeros((len(WIDTHS) + 2, 0), np.int32)
    del parts
    bias, trans, start = -4.0, np.array([[0.95, 0.05], [0.5, 0.5]]), np.array([0.95, 0.05])
    slots, tied = _known_features(table, doc, toxic) if len(doc) else (np.zeros(0, np.int32), np.zeros(0, bool))
    # features by place among the known ones; those of too few documents share the place past the end, without weight
    known = len(slots)
    for row in table:
        at = np.searchsorted(slots, row)
        row[:] = np.where(np.append(slots, -1)[at] == row, at, known)
    tied = np.append(tied, False)
    weights = np.zeros(known + 1)
    t, d = table, doc
    y = (tied[t[:-1]].any(axis=0) & (toxic[d] > 0)).astype(float) if len(doc) else np.zeros(0)
    log_trans, log_start = np.log(trans), np.log(start)
    g_w, g_b, g_t, g_s = np.full(known + 1, 1e-8), 1e-8, np.full((2, 2), 1e-8), np.full(2, 1e-8)
    first = np.ones(len(d), bool)
    first[1:] = d[1:] != d[:-1]
    seen_pairs = np.zeros((2, 2))
    inner = ~first[1:]
    np.add.at(seen_pairs, (y[:-1][inner].astype(int), y[1:][inner].astype(int)), 1)
    seen_start = np.array([(1 - y[first]).sum(), y[first].sum()])
    stretches = _stretches(d)
    for _ in range(rounds if y.any() else 0):
        gradient, wrong, pairs, starts = np.zeros(known + 1), 0.0, np.zeros((2, 2)), np.zeros(2)
        for part in stretches:
            tag, pair = forward_backward(_emission(t[:, part], weights, bias), d[part], np.exp(log_trans), np.exp(log_start))
            error = tag[:, 1] - y[part]
            for row in t[:, part]:
                gradient += np.bincount(row, weights=error, minlength=known + 1)
            wrong += error.sum()
            pairs += pair.sum(axis=0)
            starts += tag[first[part]].sum(axis=0)
        gradient = gradient / len(d) * 100 + l2 * weights
        gradient[known] = 0
        g_w += gradient**2
        weights = weights - rate * gradient / np.sqrt(g_w)
        g = wrong / len(d) * 100
        g_b += g * g
        bias -= rate * g / np.sqrt(g_b)
        g = (pairs - seen_pairs) / len(d) * 100
        g_t += g * g
        log_trans = log_trans - 0.1 * g / np.sqrt(g_t)
        g = (starts - seen_start) / max(1, first.sum())
        g_s += g * g
        log_start = log_start - 0.1 * g / np.sqrt(g_s)
    spread = np.zeros(1 << BITS, np.float32)
    spread[slots] = weights[:known]
    model = Crf(spread, float(bias), np.exp(log_trans), np.exp(log_start), np.zeros(3))
    if len(bodies):
        likely = np.concatenate([forward_backward(_emission(t[:, p], weights, bias), doc[p], model.trans, model.start, False)[0] for p in _stretches(doc)] or [np.zeros((0, 2))])
        mine = toxic.mean()
        weight = np.where(toxic > 0, share / mine, (1 - share) / (1 - mine)) if share is not None and 0 < mine < 1 else np.ones(len(toxic))
        model.calibration = _logistic(_document_features(likely, doc, len(bodies)), toxic, weight)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = SAMPLE_ROWS, id_column: str = "doc_id", text: str = "text") -> Crf:
    """Fit on at most ``limit`` labelled rows. Without any, every text scores 0.5."""
    counts = class_counts(labels, label)
    bodies, marks = [], []
    for toxic, most in ((1, limit // 3), (0, limit - limit // 3)):
        found, _ = collected(labelled_sample(docs, labels.where(F.col(label) == toxic), label, most, id_column, text))
        bodies += found
        marks += [toxic] * len(found)
    return fit_texts(bodies, marks, counts.get(1, 0) / max(1, sum(counts.values())))


def score(docs: DataFrame, model: Crf, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, n_toxic_words, spans) of each row's whole text; spans are (start, end) byte offsets.

    Null and empty texts have a score of their own, that of no toxic words, and no spans. Neighbouring
    offending words make one span. Repeated rows give repeated results; extra columns are ignored.
    """
    texts.settings(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_column].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        m = shared.value
        for batch in batches:
            for first, last, raw, offsets in texts.pieces(batch.column(1)):
                rows = last - first
                starts, ends, doc, table = tokens(raw, offsets)
                tag, _ = forward_backward(_emission(table, m.weights, m.bias), doc, m.trans, m.start, False)
                margin = _document_features(tag, doc, rows) @ m.calibration
                hit = np.flatnonzero(tag[:, 1] >= SPAN_LIMIT)
                opens = np.ones(len(hit), bool)
                opens[1:] = (np.diff(hit) > 1) | (doc[hit[1:]] != doc[hit[:-1]])
                head = hit[opens]
                tail = hit[np.append(np.flatnonzero(opens)[1:] - 1, len(hit) - 1)] if len(hit) else hit
                at = np.searchsorted(doc[head], np.arange(rows + 1)).astype(np.int32)
                spans = pa.StructArray.from_arrays([pa.array(starts[head] - offsets[doc[head]]), pa.array(ends[tail] - offsets[doc[head]])], fields=list(span))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, rows), pa.array(1 / (1 + np.exp(-np.clip(margin, -35, 35)))),
                        pa.array(np.bincount(doc[hit], minlength=rows)), pa.ListArray.from_arrays(pa.array(at), spans),
                    ],
                    ["doc_id", "score", "n_toxic_words", "spans"],
                )

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, score double, n_toxic_words long, spans array<struct<start: long, end: long>>"
    )
