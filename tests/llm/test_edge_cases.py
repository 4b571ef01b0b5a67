"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest

from ebbtide.llm import (
    bpe_chunks,
    decontamination,
    jaccard_join,
    language_profiles,
    line_rules,
    quality_kernel,
    secret_forest,
    token_counts,
    toxicity_kernel,
    web_archives,
)

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
CLASHING = (
    "score double, key bigint, node bigint, salt int, common boolean, _bad string, _doc string, line string, "
    "label int, n bigint, predicted string, component string, tiles int"
)
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHING}"
LONG = " ".join(f"word{i % 977} goes on" for i in range(30_000))
PLAIN = "A plain text of a few words that says nothing in particular to anyone at all."
ROWS = [
    (1, PLAIN, "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, " \t\r\n ", "en", "b"),
    (5, LONG, "en", "b"),
    (6, PLAIN, "en", "a"),
    (6, PLAIN, "en", "a"),
    (None, PLAIN, None, None),
    (7, "!!! ... 123 ###", "de", ""),
    (8, "Größé 日本語 \x00 \U0001f600", "de", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, None, 1.0, 2, 3, 4, True, "x", "y", "z", 5, 6, "p", "c", 7) for r in ROWS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (1, 0, 0), (3, 0, 1), (5, 1, None), (None, 1, 1), (99, 1, 1)],
        "doc_id bigint, quality int, toxic int",
    )


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [(1, PLAIN), (2, None), (3, ""), (None, PLAIN), (4, "nothing"), (1, "goes on word5")],
        "item_id bigint, text string",
    )


def one_row_each(df, rows=ROWS):
    found = df.collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in rows)
    return {r["doc_id"]: r for r in found}


def test_token_counts(odd, none):
    by_id = one_row_each(token_counts.token_counts(odd, PIECES))
    assert [by_id[i]["n_tokens"] for i in (2, 3)] == [0, 0]
    assert by_id[5]["over_limit"] and by_id[5]["n_bytes"] == len(LONG.encode())
    assert token_counts.token_counts(none, PIECES).count() == 0


def test_bpe(odd, none):
    by_id = one_row_each(bpe_chunks.bpe_digests(odd, WORDS))
    nothing = hashlib.sha256(b"").hexdigest()
    for i in (2, 3, 4):
        assert tuple(by_id[i])[1:] == (0, nothing, nothing)
    assert by_id[1]["ids_sha256"] == by_id[6]["ids_sha256"]
    assert bpe_chunks.bpe_digests(none, WORDS).count() == 0


def test_quality(odd, none, labels):
    stats = quality_kernel.document_statistics(odd)
    model = quality_kernel.fit_quality(quality_kernel.labelled_statistics(stats, labels))
    by_id = one_row_each(quality_kernel.score_quality(stats, model))
    assert all(0 <= r["score"] <= 1 for r in by_id.values())
    empty = quality_kernel.document_statistics(none)
    model = quality_kernel.fit_quality(quality_kernel.labelled_statistics(empty, labels))
    assert {r["score"] for r in quality_kernel.score_quality(stats, model).collect()} == {0.5}
    assert quality_kernel.score_quality(empty, model).count() == 0
    assert quality_kernel.kept_by_quality(odd, labels, threshold=0.0).columns == odd.columns
    assert quality_kernel.kept_by_quality(odd, labels, threshold=0.0).count() == len(ROWS)


def test_toxicity(odd, none, labels):
    for given in (labels, labels.filter("doc_id = 5"), labels.filter("toxic = 1")):
        model = toxicity_kernel.fit_toxicity(odd, given)
        by_id = one_row_each(toxicity_kernel.score_toxicity(odd, model))
        assert all(0 <= r["score"] <= 1 for r in by_id.values())
        assert by_id[2]["score"] == by_id[3]["score"]
    assert toxicity_kernel.score_toxicity(none, model).count() == 0


def test_language(odd, none):
    prototypes = language_profiles.language_prototypes(odd)
    by_id = one_row_each(language_profiles.identify_language(odd, prototypes))
    assert {by_id[i]["lang_pred"] for i in (2, 3, 4, 7)} == {"und"}
    assert all(by_id[i]["score"] == 0 for i in (2, 3, 4, 7))
    assert by_id[1]["lang_pred"] == "en"
    assert language_profiles.language_prototypes(none) == {}
    assert {r["lang_pred"] for r in language_profiles.identify_language(odd, {}).collect()} == {"und"}
    assert language_profiles.identify_language(none, prototypes).count() == 0


def test_line_rules(odd, none):
    by_id = one_row_each(line_rules.line_rules(odd))
    assert tuple(by_id[2])[1:] == (0, 0, 0, 0, 0, True, False, 0)
    assert tuple(by_id[4])[1:7] == (0, 0, 0, 0, 0, True)
    assert by_id[5]["n_words"] == 90_000 and not by_id[5]["kept"]
    assert by_id[7]["n_symbols"] == 3
    assert line_rules.line_rules(none).count() == 0
    cleaned = line_rules.without_common_lines(odd, few=1)
    assert cleaned.columns == odd.columns and cleaned.count() == len(ROWS)
    texts = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert texts[1] == texts[6] == "" and texts[2] is None and texts[5] == LONG


def test_secrets(odd, none, spark):
    found = secret_forest.scan_secrets(odd)
    assert secret_forest.scan_secrets(none).count() == 0
    assert secret_forest.redacted(odd, found).columns == odd.columns
    assert secret_forest.redacted(odd, found).count() == len(ROWS)
    key = "password=0bec99813b773c6855"
    rows = [(1, f"it is {key}, and {key} again", "a"), (2, None, "a"), (None, f"so {key} here", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    scanned = secret_forest.scan_secrets(docs)
    assert scanned.filter("predicted = 1").count() == 3
    masked = {r["doc_id"]: r["text"] for r in secret_forest.redacted(docs, scanned).collect()}
    assert masked[1] == "it is password=[SECRET], and password=[SECRET] again"
    assert masked[None] == "so password=[SECRET] here" and masked[2] is None


@pytest.mark.parametrize("block_words", [2_000_000, 1])
def test_decontamination(odd, none, items, spark, block_words):
    found = decontamination.benchmark_matches(odd, items, block_words)
    by_id = one_row_each(decontamination.contamination(found))
    assert by_id[2]["n_words"] == by_id[3]["n_words"] == 0 and not by_id[2]["contaminated"]
    assert by_id[1]["contaminated"] and by_id[1]["n_hit"] == by_id[1]["n_words"]
    assert by_id[5]["n_items"] == 1 and by_id[5]["n_hit"] > 0 and not by_id[5]["contaminated"]
    kept = decontamination.decontaminated(odd, items, block_words=block_words)
    assert kept.columns == odd.columns
    assert {2, 3, 4, 7, 8} <= {r["doc_id"] for r in kept.collect()}
    nothing = items.filter("item_id = 3")
    assert decontamination.contamination(decontamination.benchmark_matches(odd, nothing)).filter("n_hit > 0").count() == 0
    assert decontamination.benchmark_matches(none, items, block_words).count() == 0


def test_jaccard_join(odd, none):
    found = jaccard_join.jaccard_components(odd)
    by_id = one_row_each(found)
    assert [by_id[i]["component_id"] for i in (1, 6, 2, 3, 4, 5)] == [1, 1, 2, 3, 4, 5]
    assert [by_id[i]["n_shingles"] for i in (2, 3, 4)] == [0, 0, 0]
    assert by_id[None]["component_id"] is None
    assert jaccard_join.jaccard_components(none).count() == 0
    kept = jaccard_join.one_of_each_group(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted("1 2 3 4 5 7 8 None".split())


def test_web_archives(spark):
    rows = [
        (1, "http://a.example/x y", "<p>one</p>", 1),
        (2, None, None, 2),
        (3, "http://b.example/", "", 3),
        (4, "http://c.example/", "<p>one</p>", 4),
        (4, "http://c.example/", "<p>one</p>", 4),
        (None, "http://d.example/", "<p>one</p>", 5),
        (-5, "http://e.example/", "long é\r\n\r\nWARC/1.1\r\n" * 50_000, 6),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest int").repartition(3)
    found = sorted((tuple(r) for r in web_archives.pages_through_archives(pages).collect()), key=str)
    digest = {h: web_archives.base32_sha1((h or "").encode()) for _, _, h, _ in rows}
    want = [
        (1, 10, digest["<p>one</p>"], "revisit", 4),
        (2, 0, digest[""], "revisit", 3),
        (3, 0, digest[""], "response", None),
        (4, 10, digest["<p>one</p>"], "response", None),
        (4, 10, digest["<p>one</p>"], "response", None),
        (None, 10, digest["<p>one</p>"], "response", None),
        (-5, len(rows[-1][2].encode()), digest[rows[-1][2]], "response", None),
    ]
    assert found == sorted(want, key=str)
    assert web_archives.pages_through_archives(pages.limit(0)).count() == 0
    longer = web_archives.pages_through_archives(pages, at_least=5)
    assert longer.filter("record_type = 'revisit'").count() == 1
