"""The fitted text models against plain versions of their algorithms."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from biotope.llm import language_kernel, quality_classifier
from biotope.llm.language_kernel import BITS, DIM, LETTERS, RIDGE, fit_texts, passages, presence


def texts_of(n, seed):
    draw = random.Random(seed)
    stems = {"aa": ["lo", "mi", "ra", "ento"], "bb": ["sch", "ung", "keit", "ge"], "cc": ["th", "ing", "er", "ed"]}
    return [(" ".join("".join(draw.choice(stems[lang]) for _ in range(draw.randint(1, 3))) for _ in range(draw.randint(3, 14))), lang) for lang in stems for _ in range(n)]


def spectrum(body: str) -> set:
    """Folded n-grams of one to four bytes."""
    folded = bytes(LETTERS[b] for b in body.encode())
    return {folded[k : k + n] for n in (1, 2, 3, 4) for k in range(len(folded) - n + 1)}


def rows_of(bodies):
    raw = [b.encode() for b in bodies]
    bounds = np.append(0, np.cumsum([len(b) for b in raw]))
    return presence(np.frombuffer(b"".join(raw), np.uint8), bounds)


def test_presence_kernel_is_the_blended_spectrum():
    """Products of rows equal shared n-grams over the root of both numbers, but for n-grams that fall into one slot."""
    bodies = [b for b, _ in texts_of(12, 1)] + ["", "x"]
    found = rows_of(bodies)
    sets = [spectrum(b) for b in bodies]
    exact = np.array([[len(a & b) / math.sqrt(max(1, len(a)) * max(1, len(b))) for b in sets] for a in sets])
    assert np.abs(found @ found.T - exact).max() < 0.06  # a shared slot more or less between short texts
    used = [round(float((r > 0).sum())) for r in found]
    lost = sum(len(s) - u for s, u in zip(sets, used, strict=True)) / sum(map(len, sets))
    assert 0 <= lost < 0.02


def test_collisions_cost_little_on_long_passages():
    """A passage of 3,000 bytes of random letters: under two fifths of its n-grams share a slot; the nearest language of long passages stays."""
    draw = random.Random(3)
    long = {lang: " ".join(b for b, x in texts_of(60, 5) if x == lang)[:3000] for lang in ("aa", "bb", "cc")}
    noise = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(3000))
    row = rows_of([noise])[0]
    assert 1 - (row > 0).sum() / len(spectrum(noise)) < 0.4
    found = rows_of([*long.values(), *[b for b, _ in texts_of(5, 9)]])
    near = (found[3:] @ found[:3].T).argmax(axis=1)
    assert near.tolist() == [k for k in range(3) for _ in range(5)]


def test_ridge_with_all_passages_as_landmarks_is_exact():
    """The scores equal those of the kernel ridge system over all passages, classes weighed alike, one against the rest."""
    data = texts_of(10, 2)
    model = fit_texts([b for b, _ in data], [x for _, x in data])
    bodies, held = [b for b, _ in data], [b for b, _ in texts_of(6, 8)]
    train, other = rows_of(bodies).astype(float), rows_of(held).astype(float)
    target = np.array([[1.0 if x == lang else -1.0 for lang in ("aa", "bb", "cc")] for _, x in data])
    weight = np.full(len(data), 3.0)
    kernel = train @ train.T + 1  # the constant takes part as a feature
    dual = np.linalg.solve(kernel + RIDGE * weight.sum() * np.diag(1 / weight), target)
    want = (other @ train.T + 1) @ dual
    found = (other @ model.landmarks) @ model.weights[:-1] + model.weights[-1]
    assert model.languages == ["aa", "bb", "cc"] and model.landmarks.shape == (DIM, len(data)) and DIM == 1 << BITS
    assert np.abs(found - want).max() < 1e-3


def test_predictions_average_passages(spark):
    """Texts of several passages: the language of the greatest mean score, and the share of its softmax."""
    data = texts_of(10, 2)
    model = fit_texts([b for b, _ in data], [x for _, x in data])
    mixed = ["aaabbb", "bbbbcc", "ccccca", "abcabc"]
    docs = [(k, " ".join(b for c in m for b, x in texts_of(60, k) if x == c + c)) for k, m in enumerate(mixed)]
    found = {r.doc_id: r for r in language_kernel.predict(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    for name, body in docs:
        raw = np.frombuffer(body.encode(), np.uint8)
        bounds, owner = passages(np.array([0, len(raw)]))
        parts = [bytes(raw[a:b]).decode() for a, b in zip(bounds, bounds[1:], strict=False)]
        assert "".join(parts) == body and len(parts) == len(owner) == -(-len(raw) // language_kernel.PASSAGE) > 2
        total = ((rows_of(parts) @ model.landmarks) @ model.weights[:-1] + model.weights[-1]).mean(axis=0)
        share = np.exp(4 * total) / np.exp(4 * total).sum()
        assert found[name].lang_pred == model.languages[int(total.argmax())]
        assert found[name].score == pytest.approx(share.max(), rel=1e-4)


def test_ftrl_equals_a_loop_over_weights():
    """Per-weight z and n in dictionaries, one weight at a time, as the update rule is written down."""
    draw = random.Random(4)
    rows = []
    for k in range(300):
        index = sorted(draw.sample(range(40), 6))
        rows.append((np.array(index), np.array([draw.random() for _ in index]), float((3 in index) or (7 in index and k % 2))))
    rule = quality_classifier.Ftrl()
    weights, bias = rule.fit(rows, epochs=2)
    z, n = {}, {}

    def weight(i):
        l1, l2 = (0.0, 0.0) if i == "bias" else (rule.l1, rule.l2)
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        sign = 1.0 if z[i] > 0 else -1.0
        return -(z[i] - sign * l1) / ((rule.beta + math.sqrt(n[i])) / rule.alpha + l2)

    for _ in range(2):
        for index, value, label in rows:
            x = {**{int(i): float(v) for i, v in zip(index, value, strict=True)}, "bias": 1.0}
            now = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(now[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - label) * v
                before = n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(before)) / rule.alpha * now[i]
    assert bias == pytest.approx(weight("bias"), rel=1e-9)
    assert weights[:40].tolist() == pytest.approx([weight(i) for i in range(40)], rel=1e-9)
    assert not weights[40:].any() and (weights[:40] == 0).any() and weights[3] > 0


def test_quality_scores_are_dense_dot_products(spark):
    """Scores equal the logistic of the full weight vector times each text's dense vector, which has length one."""
    bodies = ["a b c a b", "", "One two THREE, one two!", "x" * 5000, "q w e " * 400, None]
    rng = np.random.default_rng(0)
    model = quality_classifier.Classifier(rng.normal(size=1 << quality_classifier.BITS), 0.25)
    dense = np.zeros((len(bodies), 1 << quality_classifier.BITS))
    for first, _, owner, index, value in quality_classifier.features(pa.array(bodies, pa.string())):
        np.add.at(dense, (owner + first, index), value)
    norms = np.linalg.norm(dense, axis=1)
    assert norms[[0, 2, 3, 4]] == pytest.approx(1.0) and not norms[[1, 5]].any()
    want = 1 / (1 + np.exp(-(dense @ model.weights + model.bias)))
    df = spark.createDataFrame(list(enumerate(bodies)), "doc_id int, text string")
    found = {r.doc_id: r.score for r in quality_classifier.score(df, model).collect()}
    assert [found[k] for k in range(len(bodies))] == pytest.approx(want.tolist())
