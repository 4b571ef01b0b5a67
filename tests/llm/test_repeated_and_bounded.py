"""Repeated rows, shared ids and texts of many letters: whole results in bounded memory; fitted
parts against plain forms."""

from __future__ import annotations

import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest
from test_results import groups_by_brute_force, sets_by_rule

from ebbtide.llm import decontamination, jaccard_join, language_profiles, quality_kernel, toxicity_kernel

DOCS = "doc_id bigint, text string, lang string"


def components_of_rows(rows):
    """Per row its set size and the smallest id reachable, rows with one id being one node."""
    sets = [sets_by_rule(t) for _, t in rows]
    by_row = groups_by_brute_force(list(enumerate(t for _, t in rows)))
    root = {i: i for i, _ in rows if i is not None}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    first = {}
    for at, (doc, _) in enumerate(rows):
        if doc is None or not sets[at]:
            continue
        x, y = top(doc), top(first.setdefault(by_row[at][1], doc))
        root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else top(i)) for (i, _), s in zip(rows, sets)), key=repr)


@pytest.mark.parametrize("tile", [None, 1])
def test_jaccard_with_repeated_rows_and_shared_ids(spark, monkeypatch, tile):
    if tile:
        monkeypatch.setattr(jaccard_join, "TILE_SHINGLES", 5_000)
        monkeypatch.setattr(jaccard_join, "TILE_MEMBERS", 7)
        monkeypatch.setattr(jaccard_join, "TILE_CLASSES", 8)
    random.seed(9)
    texts = {k: " ".join(f"{k}{random.randrange(3000)}" for _ in range(120)) for k in "wxyz"}
    near = {k: t.replace(t.split()[7], "changed", 1) for k, t in texts.items()}
    rows = [(3, texts["x"]), (5, texts["x"]), (5, texts["y"]), (6, texts["y"]), (7, near["y"]), (8, near["w"])]
    rows += [(20, texts["w"])] * 30 + [(21, texts["w"])] * 2 + [(30, near["z"]), (30, near["x"]), (31, texts["z"])]
    rows += [(40, ""), (40, None), (40, texts["z"]), (41, None), (None, texts["x"]), (50, "alone and short")] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = jaccard_join.jaccard_components(docs)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == components_of_rows(rows)


def test_many_rows_of_one_document_are_one_set(spark):
    """As many rows as would be a block of pairs; they count once before anything is compared."""
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(1, text)] * 4000 + [(2, text.replace("w7 ", "w ")), (3, "other")]
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {tuple(r) for r in found.distinct().collect()} == {(1, 398, 1), (2, 398, 1), (3, 1, 3)}
    assert found.count() == len(rows)


def test_each_language_is_learnt_whatever_the_ids(spark):
    german = [f"der Hund und die Katze gehen nach Hause {i} und schlafen dort" for i in range(900)]
    rows = [(None, german[i % 900], "de") for i in range(5000)] + [(None, "nur ein Satz auf deutsch", "de")] * 200
    rows += [(i, f"the dog and the cat go home {i} and sleep there", "en") for i in range(300)]
    rows += [(4, "un seul texte, souvent", "fr")] * 700 + [(5, None, "nul"), (6, "123", "digits")]
    docs = spark.createDataFrame(rows, DOCS)
    prototypes = language_profiles.language_prototypes(docs, per_language=100)
    assert set(prototypes) >= {"de", "en", "fr"}
    found = language_profiles.identify_language(docs, prototypes).collect()
    right = {"der": "de", "nur": "de", "the": "en", "un ": "fr"}
    texts = defaultdict(set)
    for r in language_profiles.identify_language(docs.select("text").distinct().selectExpr("1L doc_id", "text"), prototypes).collect():
        texts[r["lang_pred"]].add(r["doc_id"])
    assert len(found) == len(rows) and set(texts) == {*right.values(), "und"}
    assert sum(r["lang_pred"] == "de" for r in found) == 5200 and sum(r["lang_pred"] == "fr" for r in found) == 700


def plain_profile(text):
    total = np.zeros(language_profiles.DIMENSIONS)
    for word in language_profiles.LETTERS.findall((text or "").lower()):
        framed = f" {word} "
        for a, b, c in zip(framed, framed[1:], framed[2:]):
            va, vb, vc = (language_profiles.letter_vector(x).astype(int) for x in (a, b, c))
            total += np.roll(va, 2) * np.roll(vb, 1) * vc
    return total


def test_text_vectors_equal_plain_bundles(monkeypatch):
    monkeypatch.setattr(language_profiles, "TOGETHER", 7)
    texts = ["The cat, the CAT and a dog", None, "", "123 !", "日本語 ǅungla É é", "a", "so so so so"]
    got = language_profiles.Bundler().vectors_of(texts)
    assert np.array_equal(got, np.array([plain_profile(t) for t in texts], np.float32))
    monkeypatch.setattr(language_profiles, "CHARACTERS", 5)
    monkeypatch.setattr(language_profiles, "TRIPLES", 3)
    assert np.array_equal(language_profiles.Bundler().vectors_of(texts), got)


def test_texts_of_many_letters_need_little_memory():
    """256 texts of 1,500 characters out of thousands: some hundred thousand different triples."""
    random.seed(3)
    texts = ["".join(chr(random.randrange(0x4E00, 0x9FA5)) for _ in range(1500)) for _ in range(256)]
    tracemalloc.start()
    vectors = language_profiles.Bundler().vectors_of(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert vectors.any(axis=1).all() and peak < 300e6


def test_best_matches_do_not_depend_on_the_number_of_passes(spark):
    a = " ".join(f"i{k}" for k in range(30))
    b = " ".join(f"j{k}" for k in range(25))
    docs = spark.createDataFrame([(1, f"{b} x {a} y {b}"), (2, a[:80]), (3, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, a), (7, b), (8, b), (9, "z"), (7, "unrelated words here")], "item_id bigint, text string")
    want = None
    for block_words in (2_000_000, 26, 1):
        found = decontamination.benchmark_matches(docs, items, block_words).collect()
        rows = {r["doc_id"]: ([tuple(h) for h in r["hits"]], r["items"], [tuple(m) for m in r["matches"]]) for r in found}
        want = want or rows
        assert rows == want, block_words
    assert want[1][2] == [(7, 26, 0, 30), (8, 0, 0, 25)]


def test_shards_hold_a_bounded_number_of_bytes():
    texts = ["x" * n for n in (3_000_000, 2_000_000, 1, 9_000_000, 5, 6)] + [None] * 1500
    shards = list(decontamination._shards(texts))
    assert [x for lo, hi in shards for x in range(lo, hi)] == list(range(len(texts)))
    for lo, hi in shards:
        assert hi - lo <= decontamination.SHARD_ROWS
        assert hi - lo == 1 or sum(len(t or "") for t in texts[lo:hi]) <= decontamination.SHARD_BYTES


def test_isotonic_levels_equal_least_squares():
    """Against max-min of block means, which is what the least-squares fit is."""
    random_ = np.random.default_rng(2)
    for size in (1, 2, 7, 40):
        scores = random_.integers(0, 12, size).astype(float)
        labels = random_.integers(0, 2, size).astype(float)
        steps, levels = quality_kernel.isotonic(scores, labels)
        at = np.unique(scores)
        n = np.array([(scores == x).sum() for x in at])
        t = np.array([labels[scores == x].sum() for x in at])
        want = [
            max(min(t[i : k + 1].sum() / n[i : k + 1].sum() for k in range(j, len(at))) for i in range(j + 1))
            for j in range(len(at))
        ]
        assert np.allclose(np.interp(at, steps, levels), want)


def test_partition_sums_equal_one_matrix(spark):
    random_ = np.random.default_rng(7)
    stats, label = random_.random((300, quality_kernel.STATS)), random_.integers(0, 2, 300)
    rows = [(i, s.tolist(), int(y)) for i, (s, y) in enumerate(zip(stats, label))]
    labelled = spark.createDataFrame(rows, "doc_id bigint, stats array<double>, label int").repartition(7)

    def normal(x, y):
        return np.hstack([x.T @ x, (x.T @ y)[:, None]])

    got = quality_kernel._partition_sums(labelled, normal, quality_kernel.STATS)
    assert np.allclose(got, normal(stats, label.astype(float)))


def plain_kernel(a, b):
    """Shared letter triples in order, by their gaps, of two words scaled to length one."""

    def profile(word):
        letters, out = [1, *map(toxicity_kernel._code, word), 1], defaultdict(float)
        for j, k in toxicity_kernel.OFFSETS:
            for i in range(len(letters) - k):
                out[letters[i], letters[i + j], letters[i + k], j, k] += toxicity_kernel.DECAY ** (k - 2)
        scale = sum(x * x for x in out.values()) ** 0.5 or 1.0
        by_triple = defaultdict(list)
        for (x, y, z, _, k), v in out.items():
            by_triple[x, y, z].append(v / scale)
        return {t: v for t, v in by_triple.items()}

    one, two = profile(a), profile(b)
    return sum(sum(v) * sum(two[t]) for t, v in one.items() if t in two)


def test_kernel_equals_a_naive_one():
    words = ["idiot", "idxiot", "i", "stupidity", "gruß", "thing", "日本", "xyzzy"]
    marks = ["idiot", "stupid", "thing", "日本語"]
    got = toxicity_kernel.kernel(words, marks)
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            assert abs(got[i, j] - plain_kernel(w, m)) < 1e-9, (w, m)
    assert got[0, 0] > got[1, 0] > got[7, 0]


def test_machine_over_partitions_equals_one_matrix(spark):
    random_ = np.random.default_rng(1)
    words = sorted({"".join(random_.choice(list("abcdefg"), 5)) for _ in range(400)})
    up = [float("bad" in w or "fad" in w) * 3 for w in words]
    down = [float(random_.integers(1, 4)) for _ in words]
    marks = words[::20]
    values, vectors = np.linalg.eigh(toxicity_kernel.kernel(marks, marks))
    whiten = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    frame = spark.createDataFrame(list(zip(words, up, down)), "word string, up double, down double")
    got = toxicity_kernel._words_machine(frame, marks, whiten)
    x = np.hstack([toxicity_kernel.kernel(words, marks) @ whiten, np.ones((len(words), 1))])

    def loss(w):
        f = x @ w
        hinge = np.array(up) * np.maximum(0, 1 - f) ** 2 + np.array(down) * np.maximum(0, 1 + f) ** 2
        return ((w[:-1] ** 2).sum() + 1e-6 * w[-1] ** 2) / 2 + hinge.sum() / 2

    for _ in range(50):  # no step in any direction lowers it
        assert loss(got) <= loss(got + 1e-3 * random_.standard_normal(len(got))) + 1e-9
    assert loss(got) < loss(np.zeros(len(got)))


def test_all_words_are_counted_and_long_ones_in_windows(spark):
    """Rare words beside very common ones, and the end of a word beyond the first 24 letters."""
    long = "a" * 30 + "idiot" + "b" * 20
    sentences = [(f"common word number{i} here", 0) for i in range(3000)] + [("rare", 1), (long, 1), (long + " x", 0)]
    frame = spark.createDataFrame(sentences, "sentence string, label int")
    counted = {r["word"]: (r["positive"], r["negative"]) for r in toxicity_kernel._word_labels(frame).collect()}
    assert counted["rare"] == (1, 0) and counted["common"] == (0, 3000) and counted["number2999"] == (0, 1)
    assert len(counted) == 3000 + 5 + len(set(toxicity_kernel.views(long)))
    assert any("idiot" in w for w in counted) and all(len(w) <= toxicity_kernel.LONGEST for w in counted)


def test_samples_are_bounded_however_often_rows_come(spark):
    rows = [(i % 50, f"text of {i % 50}", "en") for i in range(3000)] + [(7, f"other {i}", "en") for i in range(500)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(50)], "doc_id bigint, quality int, toxic int")
    sample = toxicity_kernel._sample(docs, labels, "toxic", 4000)
    assert sample.count() == 50 and sample.select("doc_id").distinct().count() == 50
    stats = quality_kernel.document_statistics(docs)
    model = quality_kernel.fit_quality(quality_kernel.labelled_statistics(stats, labels))
    once = quality_kernel.document_statistics(docs.filter("text not like 'other%'").distinct())
    assert quality_kernel.score_quality(once, model).count() == 50
