"""Each operator against a plain version, and on rows that are null, empty, very long, tied or repeated."""

from __future__ import annotations

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from biotope.llm import bpe, decontaminate, jaccard_join, language_kernel, quality_classifier, toxicity_crf
from biotope.llm.components import components
from biotope.llm.decontaminate import benchmark_matches, myers, normalized, without_matches
from biotope.llm.jaccard_join import jaccard_classes, jaccard_components
from biotope.llm.line_dedup import remove_spread_lines
from biotope.llm.quality_rules import References, Rules, distances, fit_references, judge, keep_good
from biotope.llm.sampling import collected, fold, labelled_sample
from biotope.llm.sharding import jump_shard, shard_documents, with_slots
from biotope.llm.suffix_dedup import dedup_windows, merged

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept int, _key string, slot int, root int, ids int"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("aeioulmnrstdé") for _ in range(rng.randint(1, 8))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Families of near copies, repeated rows and ids, nulls, blanks, a very long text and clashing columns."""
    rng = random.Random(5)
    base = words(rng, 120).split()
    texts: list[tuple[int | None, str | None]] = []
    for k in range(12):
        w = base.copy()
        for _ in range(k):
            w[rng.randrange(len(w))] = "x%d" % rng.randrange(1000)
        texts.append((k, " ".join(w)))
    shared = words(rng, 60)
    texts += [(20 + k, words(rng, 40) + "\n" + shared + "\n" + words(rng, 50)) for k in range(6)]
    texts += [(30, None), (31, ""), (32, " \t\n "), (33, "one two"), (34, "One  two"), (35, "ONE"), (36, "a"), (37, "ab " * 4000), (38, "q" * 30000)]
    texts += [(0, texts[0][1]), (0, texts[0][1]), (3, "other text under a used id"), (None, texts[1][1]), (None, None), (40, words(rng, 20000))]
    texts += [(41, "The Ünïcode 中文字 text — with #signs & $money\r\n" * 12), (42, "!!! ??? 123")]
    return [(i, t, "en" if k % 3 else None, f"s{k % 7}" if k % 5 else None, k, k, "k", k, k, k) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    df.cache().count()
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(found, wanted):
    assert sorted(map(repr, found)) == sorted(map(repr, wanted))


def test_base_figures_of_quality_rules(docs, rows, empty):
    found = judge(docs, References([], np.zeros((0, 8)), np.zeros(0, np.uint64), np.zeros((0, 1)))).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    same([(r.doc_id, *[r[n] for n in names]) for r in found], [(i, *brute.base_figures(t)) for i, t, *_ in rows])
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed) for r in found)
    assert judge(empty, fit_references(empty)).collect() == []


def test_quality_rules_keep_prose_and_clashing_columns(spark, docs):
    rng = random.Random(1)
    prose = [(k, " ".join(rng.choice(["the", "of", "and", "to"] + [words(rng, 1)] * 6) for _ in range(300)) + ".", "en") for k in range(40)]
    junk = [(100, " | ".join(words(rng, 200).split()), "en"), (101, words(rng, 200).upper().replace(" ", "!! "), "en"), (102, None, "en")]
    table = spark.createDataFrame(prose + junk, "doc_id long, text string, kept string")
    kept = keep_good(table, fit_references(table, lang="kept"))
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(40))
    assert keep_good(docs, fit_references(docs)).columns == docs.columns


def test_jensen_shannon_distance():
    counts = np.array([[1.0, 1, 0], [0, 0, 4], [0, 0, 0]])
    assert np.allclose(distances(counts, np.array([[0.5, 0.5, 0.0]])), [0, 1, 0])
    assert np.allclose(distances(counts, np.zeros((0, 3))), 0)
    assert Rules().min_words == 50


def test_jaccard_components(docs, rows, empty):
    found = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()]
    same(found, brute.jaccard_components([(r[0], r[1]) for r in rows]))
    assert jaccard_components(empty).collect() == []
    assert jaccard_classes(empty).collect() == []


def test_jaccard_links_at_the_threshold(spark):
    rng = random.Random(9)
    texts = []
    for family in range(8):
        base = words(rng, 90).split()
        for k in range(9):
            w = base.copy()
            for j in range(k):
                w[(17 * j + family) % 90] = f"f{family}k{k}j{j}"
            texts.append(" ".join(w[: 90 - family * k // 2]))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same([tuple(r) for r in jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect()], brute.jaccard_components(rows))


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(k, k + 1) for k in range(60)] + [(200, k) for k in range(201, 260)] + [(7, 7), (3, 2)]
    found = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).select("node", "root").collect())
    assert found == {**{k: 0 for k in range(61)}, **{k: 200 for k in range(200, 260)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("most_runs", [20000, 1])
def test_repeated_windows_go(docs, rows, empty, most_runs):
    wanted = [(r[0], *w) for r, w in zip(rows, brute.window_dedup([r[1] for r in rows], 400), strict=True)]
    found = dedup_windows(docs, most_runs=most_runs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    same([(*r[:4], bytes(r[4])) for r in found], wanted)
    assert dedup_windows(empty).collect() == []


def test_repeated_windows_of_small_size(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(30)] + ["abab" * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in dedup_windows(df, window=12, anchor=4).collect()}
    assert found == dict(enumerate(brute.window_dedup(texts, 12)))
    assert merged([(5, 9), (0, 3), (3, 4), (8, 12)]) == [(0, 4), (5, 12)]


def test_repeated_windows_beside_long_texts(spark):
    # the hashes of "Dv=2" and "hIul" agree in the first 44 bits and differ in the rest
    rng = random.Random(8)
    fill = "".join(chr(rng.randrange(48, 123)) for _ in range(530_000))
    texts = ["Dv=2hIul", fill + "Dv=2hIul", "fF^[1<50"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2, "doc_id")
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in dedup_windows(df, window=8, anchor=4).collect()}
    assert found == dict(enumerate(brute.window_dedup(texts, 8)))
    assert [found[k][1] for k in range(3)] == [8, 8, 0]


def test_spread_lines(docs, rows, empty):
    for sites in (2, 3):
        wanted = brute.spread_lines([(r[0], r[1], r[3]) for r in rows], sites)
        found = remove_spread_lines(docs, sites)
        assert found.columns[: len(docs.columns)] == docs.columns
        # rows that share an id share the lines that id loses; the rows here have them in common
        same([(r.doc_id, r.n_chars, r.text) for r in found.collect()], [(r[0], r[4], t) for r, t in zip(rows, wanted, strict=True)])
    assert remove_spread_lines(empty).collect() == []


def test_jump_shards(spark, docs, rows, empty):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *[random.Random(4).getrandbits(63) for _ in range(300)]]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 16, 17, 100):
        assert all(s == brute.jump(k, n) for k, s in df.select("k", jump_shard(F.col("k"), n)).collect())
    found = shard_documents(docs, blocks=5).collect()
    assert all(r.shard == brute.jump(r.doc_id or 0, 16) and r.grown_shard == brute.jump(r.doc_id or 0, 17) for r in found)
    assert all(r.grown_shard in (r.shard, 16) for r in found)
    same([(r.doc_id, r.size, r.text_crc32) for r in found], [(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows])
    for s in {r.shard for r in found}:
        slots = sorted(r.slot for r in found if r.shard == s)
        assert slots == list(range(len(slots)))
    assert shard_documents(empty).collect() == []


def test_error_budget_search(spark, docs, empty):
    rng = random.Random(2)
    item = words(rng, 40)
    changed = list(item)
    for k in (10, 60, 110):
        changed[k] = "Z"
    del changed[140]
    far = "".join(c if k % 6 else "Z" for k, c in enumerate(item))
    texts = [words(rng, 50) + " " + item.upper() + "\n" + words(rng, 20), words(rng, 9) + " " + "".join(changed), far + words(rng, 30), None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string")
    items = spark.createDataFrame([(7, item, "x"), (8, "short", "x"), (9, None, "x"), (None, item, "x")], "item_id long, text string, doc_id string")
    found = sorted((r.doc_id, r.item_id, r.distance) for r in benchmark_matches(df, items).collect())
    assert found == [(0, 7, 0), (0, 7, 0), (1, 7, brute.edit_distance_within(normalized(item), normalized(texts[1])))]
    assert sorted(r.doc_id for r in without_matches(df, items).collect()) == [2, 3, 4]
    assert without_matches(docs, items).count() == docs.count()
    assert benchmark_matches(empty, items).count() == 0 and benchmark_matches(df, items.limit(0)).count() == 0


def test_rare_language_words_are_tied_by_occurrences():
    """A beginning that toxic texts use time and again, and half as many clean ones once, marks the toxic ones; one of equal shares does not."""
    rng = np.random.default_rng(0)
    fill = [f"w{k}" for k in range(200)]
    bodies, labels = [], []
    for k in range(240):
        words = rng.choice(fill, 40).tolist()
        if k < 24:
            words[::6] = [f"bomente{j}" for j in rng.integers(0, 9, 7)]
        elif k < 48:
            words[3] = "bomentes"
        bodies.append(" ".join(words))
        labels.append(int(k < 24))
    model = toxicity_crf.fit_texts(bodies, labels)
    raw = " ".join(["w1", "bomente99", "w2", "bomentexy", "bomente3"]).encode()
    *_, doc, table = toxicity_crf.tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    tag, _ = toxicity_crf.forward_backward(toxicity_crf._emission(table, model.weights, model.bias), doc, model.trans, model.start, False)
    assert (tag[[1, 3, 4], 1] > 0.5).all() and (tag[[0, 2], 1] < 0.5).all()


def test_labelled_sample_takes_one_text_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, None), (3, "c"), (4, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, None), (4, 0), (None, 1)], "doc_id long, y int")
    texts_, marks = collected(labelled_sample(docs, labels, "y", 10))
    assert len(texts_) == 2 and marks == [1, 0] and texts_[1] == "d"
    assert collected(labelled_sample(docs.orderBy(F.rand(1)), labels, "y", 10)) == (texts_, marks)


def test_no_pair_is_verified_twice(spark, monkeypatch):
    """Chains of near copies with a frequent beginning: many rounds of pairs, each pair tried once, and small buckets change nothing."""
    rng = np.random.default_rng(1)
    common = [f"c{k}" for k in range(20)]
    rows = []
    for k in range(60):
        words = [*common, *(f"w{k // 6}x{j}" for j in range(40))]
        for at in rng.integers(20, 60, k % 6):
            words[at] = f"n{k}y{at}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    verified = jaccard_join._verified

    def watched(pairs, sets, percent):
        seen.extend((r.a, r.b) for r in pairs.collect())
        return verified(pairs, sets, percent)

    monkeypatch.setattr(jaccard_join, "_verified", watched)
    monkeypatch.setattr(jaccard_join, "BUCKET_GRAMS", 10)
    found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df).collect())
    assert found == sorted(brute.jaccard_components(rows))
    assert len(seen) == len(set(seen)) > 0


def test_shards_of_repeated_rows_and_text_ids(spark):
    """One row repeated 4,000 times is dealt to several blocks and has gapless slots; text ids keep to a shard."""
    same_row = spark.range(4000).select(F.lit(7).alias("doc_id"), F.lit("again").alias("text"))
    found = shard_documents(same_row, blocks=4)
    assert sorted(r.slot for r in found.collect()) == list(range(4000)) and found.select("shard").distinct().count() == 1
    numbered = with_slots(same_row.withColumn("shard", F.lit(1)), "shard", ["doc_id"], 4)
    assert sorted(r.slot for r in numbered.collect()) == list(range(4000))
    assert set(numbered.columns) == {"doc_id", "text", "shard", "slot"}
    named = spark.createDataFrame([(f"id-{k % 50}", "x") for k in range(200)] + [(None, "y")], "doc_id string, text string")
    by_id = {}
    for r in shard_documents(named).collect():
        assert by_id.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard) and r.grown_shard in (r.shard, 16)
    assert len({s for s, _ in by_id.values()}) > 5 and by_id[None][0] == brute.jump(0, 16)


def test_short_items_and_blocks(spark, monkeypatch):
    """Items of 5 to 31 characters are found as whole words and without edits; blocks of items give what one block gives."""
    items = [(1, "Five!"), (2, "a  short item"), (3, "thirty-one characters, no more."), (4, ""), (5, None), (6, "x" * 40), (6, "y" * 40), (7, "short"), (8, "item")]
    docs = [
        (1, "five! is here"), (2, "not five!s"), (3, "A short\titem"), (4, "a short items"), (5, "so: thirty-one characters, no more."), (6, "thirty-one characters, no mare."),
        (7, "x" * 39 + "z"), (8, "y" * 40 + " " + "x" * 40), (9, ""), (10, None), (11, "items item"), (12, "shortshort short"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = {(1, 1, 0, 5), (3, 2, 0, 12), (3, 7, 0, 5), (3, 8, 0, 4), (4, 7, 0, 5), (5, 3, 0, 31), (7, 6, 1, 40), (8, 6, 0, 40), (11, 8, 0, 4), (12, 7, 0, 5)}
    for size in (2_000_000, 30):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", size)
        found = benchmark_matches(df, asked)
        assert {(r.doc_id, r.item_id, r.distance, r.item_chars) for r in found.collect()} == want and found.count() == len(want)
    assert {r.doc_id for r in without_matches(df, asked).collect()} == {2, 6, 9, 10}


def test_bit_parallel_distance():
    rng = random.Random(8)
    for _ in range(150):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        least = brute.edit_distance_within(item, text)
        found = myers(item, text, least)
        assert (found[0] if found else len(item)) == least
        assert least == 0 or myers(item, text, least - 1) is None


def test_byte_pair_merges_and_round_trip(docs, rows, empty):
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = public.path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    rng = random.Random(6)
    for k in range(120):
        piece = "".join(rng.choice("abcdeéß中=-") for _ in range(rng.randint(1, 60))) if k % 2 else rng.choice(["a", "th", "==", "é"]) * rng.randint(1, 90)
        assert bpe.merge_ids(piece.encode(), ranks) == brute.merges(piece.encode(), ranks)
    peer = tiktoken.Encoding("peer", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    narrow = bpe.ascii_pattern(public.PATTERN)
    coder = bpe.encoder(ranks, public.PATTERN)
    for k in range(200):
        text = "".join(rng.choice("abZ '09.,;\t\n\r\x0b\x1c\x1f_-$" + "é中\u00a0\u2028" * (k % 2)) for _ in range(rng.randint(0, 80))) + rng.choice(["'s", "'ll it", "  ", ""])
        assert narrow and list(np.frombuffer(coder(text), "<u4")) == peer.encode_ordinary(text)
    assert bpe.ascii_pattern(r"\w+") is None
    wanted = []
    for r in rows:
        ids = peer.encode_ordinary(r[1] or "")
        wanted.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    same([tuple(r) for r in bpe.digests(docs, path, public.PATTERN).collect()], wanted)
    coded = bpe.encode(docs, path, public.PATTERN)
    assert coded.columns == docs.columns and all(r.ids == peer.encode_ordinary(r.text or "") for r in coded.collect())
    assert bpe.digests(empty, path, public.PATTERN).collect() == []


def test_languages(spark, docs, empty):
    rng = random.Random(3)
    kinds = {"aa": "abcdef", "bb": "ghijkl", "cc": "éèàùçô"}
    texts = [(k, " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(60)), name) for k, (name, letters) in enumerate(list(kinds.items()) * 20)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    model = language_kernel.fit(df, df.where("doc_id < 40"))
    assert all(r.lang == r.lang_pred and 0 <= r.score <= 1 for r in language_kernel.predict(df, model).join(df, "doc_id").collect())
    found = language_kernel.predict(docs, model).collect()
    assert len(found) == docs.count()
    assert {r.lang_pred for r in found if r.doc_id in (30, 31, 32, 42)} == {"und"}
    none = language_kernel.fit(empty, empty)
    assert {r.lang_pred for r in language_kernel.predict(docs, none).collect()} == {"und"}
    assert language_kernel.predict(empty, model).collect() == []


def labelled(rng: random.Random, n: int, insult: bool) -> list[tuple[int, str, int]]:
    out = []
    for k in range(n):
        w = words(rng, rng.randint(5, 80)).split()
        bad = k % 4 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vilewordo", "vilewordas", "grubnak"])) if insult else w.append("!! SHOUT")
        out.append((k, " ".join(w), int(bad)))
    return out


def test_toxic_spans_and_scores(spark, docs, empty):
    data = labelled(random.Random(1), 400, True)
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    model = toxicity_crf.fit(df, df.where("doc_id < 300"))
    for r in toxicity_crf.score(df, model).join(df, "doc_id").where("doc_id >= 300").collect():
        assert (r.score >= 0.3) == bool(r.toxic)
        body = r.text.encode()
        assert all(w.startswith(("vile", "grub")) for s in r.spans for w in body[s.start : s.end].decode().split())
        assert sum(len(body[s.start : s.end].split()) for s in r.spans) == r.n_toxic_words == 3 * r.toxic
    found = toxicity_crf.score(docs, model).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    assert {r.score for r in toxicity_crf.score(docs, toxicity_crf.fit(empty, df)).collect()} == {0.5}
    assert toxicity_crf.score(empty, model).collect() == []


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    emission, doc = rng.normal(0, 2, 9), np.array([0, 0, 0, 0, 0, 0, 1, 2, 2])
    trans, start = np.array([[0.9, 0.2], [0.4, 0.7]]), np.array([0.8, 0.3])
    tag, pair = toxicity_crf.forward_backward(np.tile(emission, 20), np.concatenate([doc + 3 * k for k in range(20)]), trans, start)
    for part in (slice(0, 6), slice(6, 7), slice(7, 9)):
        e = np.exp(np.outer(emission[part], [0, 1]))
        total, by_tag, by_pair = 0.0, np.zeros((len(e), 2)), np.zeros((len(e), 2, 2))
        for path in np.ndindex(*[2] * len(e)):
            weight = start[path[0]] * e[0][path[0]] * np.prod([trans[path[t - 1], path[t]] * e[t][path[t]] for t in range(1, len(e))])
            total += weight
            for t, y in enumerate(path):
                by_tag[t, y] += weight
                if t:
                    by_pair[t, path[t - 1], y] += weight
        for copy in (0, 11):
            at = slice(part.start + 9 * copy, part.stop + 9 * copy)
            assert np.allclose(tag[at], by_tag / total) and np.allclose(pair[at], by_pair / total)


def test_quality_classifier(spark, docs, empty):
    data = [(k, t, 1 - y) for k, t, y in labelled(random.Random(2), 400, False)]
    df = spark.createDataFrame(data, "doc_id long, text string, quality int")
    model = quality_classifier.fit(df, df.where("doc_id < 300"))
    held = quality_classifier.score(df, model).join(df, "doc_id").where("doc_id >= 300").collect()
    assert np.mean([(r.score >= 0.5) == bool(r.quality) for r in held]) >= 0.95
    found = quality_classifier.score(docs, model).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    assert {r.score for r in quality_classifier.score(docs, quality_classifier.fit(empty, df)).collect()} == {0.5}
    assert quality_classifier.score(empty, model).collect() == []


def test_folds(spark):
    got = spark.range(50).select("id", fold("id", 3).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 3 for r in got)
