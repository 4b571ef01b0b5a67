"""Inputs that a smaller job would pass over: common lines, short and long secrets, rows
without an id."""

from __future__ import annotations

import random
import shutil

from compare import differences
from conftest import TESTDATA
from pyspark.sql import functions as F

from ebbtide.llm import decontamination, queries, secret_forest

SMALL = TESTDATA / "sf0.001"


def test_line_rules_mark_lines_and_reject_documents_like_sql(spark, tmp_path):
    for given in SMALL.glob("*.parquet"):
        if given.name != "documents.parquet":
            shutil.copy(given, tmp_path)
    shared = "\n".join(" ".join(f"s{k}w{j}" for j in range(30)) for k in range(3))
    own = [" ".join(f"d{i}w{j}" for j in range(10 if i % 2 else 60)) for i in range(1200)]
    # In 11 of 400 documents (more than 10 and one in 50), in 10 of 400, in 12 of 600, in all 11.
    rows = [(i, f"{shared}\n{own[i]}" if i < 11 else own[i] * 9, "en", "common", 1) for i in range(400)]
    rows += [(1000 + i, f"{shared}\n{own[i]}" if i < 10 else own[i] * 9, "en", "few", 1) for i in range(400)]
    rows += [(2000 + i, f"{shared}\n{own[i]}" if i < 12 else own[i] * 9, "en", "rare", 1) for i in range(600)]
    rows += [(3000 + i, f"{shared}\n{own[i]}", "en", None, 1) for i in range(11)]
    rows += [(3100, "\n".join([shared, *own[:1]] * 2), "en", "common", 1)]  # lines twice in one document
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    op9 = queries.QUERIES["op9_line_rules"]
    found = {r["doc_id"]: r for r in op9(spark, str(tmp_path)).collect()}
    common = {*range(11), *range(3000, 3011)}
    assert all(found[i]["common_words"] == (90 if i in common else 180 if i == 3100 else 0) for i in found)
    # With ten words of their own too little is left, with sixty enough.
    depleted = {i for i, r in found.items() if not r["kept"] and not r["base_failed"]}
    assert depleted == {i for i in common if i % 1000 % 2}
    assert differences(spark, str(tmp_path), op9, queries.ORACLE["op9_line_rules"]) is None


PLAIN = "It says here that nothing of note was found by anyone who looked at the thing."
ASSIGNED = {
    'password="Summer2024!"': "Summer2024!",
    "password=hunter2pw9,": "hunter2pw9",
    "secret=qwertyuiopasdf": "qwertyuiopasdf",
    "token=Xk9!pQ2@vL7#mN4$": "Xk9!pQ2@vL7#mN4$",
    "pwd:Tr0ub4dor&3xyz": "Tr0ub4dor&3xyz",
    "db_password = 'c0rrect h0rse b4ttery'": "c0rrect h0rse b4ttery",
    '{"user":"me","apiKey":"zq9-Vw!7","token":"p@ss/w0rd"}': "zq9-Vw!7",
    'Secret => "Ab\\"9xK(2]f"': 'Ab\\"9xK(2]f',
}
STAND_INS = ["password=${DB_PASSWORD}", "secret: nothing", 'token = "found"', "password=None", "author: Looked1234"]


def secret_docs(spark):
    random.seed(5)
    rows = []
    for i in range(60):
        hexes = "".join(random.choice("0123456789abcdef") for _ in range(40))
        rows.append((i, f'{PLAIN} token = "{hexes}" {PLAIN}', "a"))
    for i in range(60, 160):
        long = "".join(random.choice(["there", "found", "that", "thing", "look"]) for _ in range(5))
        rows.append((i, f"{PLAIN} {long} {PLAIN} {random.randrange(10**15, 10**16)}", "a"))
    rows += [(200 + i, f"{PLAIN} {text} {PLAIN}", "a") for i, text in enumerate(ASSIGNED)]
    rows += [(300 + i, f"{PLAIN} {text} {PLAIN}", "a") for i, text in enumerate(STAND_INS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def test_values_assigned_to_credential_names_are_found_and_masked(spark):
    docs = secret_docs(spark)
    scanned = secret_forest.scan_secrets(docs).cache()
    found = {(r["doc_id"], r["value"], r["place"]) for r in scanned.filter("predicted = 1").collect()}
    for i, (text, value) in enumerate(ASSIGNED.items()):
        place = len(f"{PLAIN} {text[: text.index(value)]}x".split()) - 1
        assert (200 + i, value, place) in found, text
    assert (206, "p@ss/w0rd", 16) in {r[:] for r in scanned.select("doc_id", "value", "place").collect()}
    assert not {r for r in found if r[0] >= 300 or 60 <= r[0] < 160}
    assert scanned.filter("doc_id < 60").count() == 60  # a run that is an assigned value comes once
    masked = {r["doc_id"]: r["text"] for r in secret_forest.redacted(docs, scanned).collect()}
    for i, (text, value) in enumerate(ASSIGNED.items()):
        assert value not in masked[200 + i] and "[SECRET]" in masked[200 + i]
    assert masked[201] == f"{PLAIN} password=[SECRET], {PLAIN}"


def test_short_secrets_are_masked_where_they_stand_alone(spark):
    docs = spark.createDataFrame([(1, "pwd=a$1\\Eb9 but not xa$1\\Eb9 nor a$1\\Eb97", "a")], "doc_id int, text string, source string")
    scanned = secret_forest.scan_secrets(docs).withColumn("predicted", F.lit(1))
    assert secret_forest.redacted(docs, scanned).first()["text"] == "pwd=[SECRET] but not xa$1\\Eb9 nor a$1\\Eb97"


def test_long_values_are_taken_to_their_closing_quote(spark):
    prose = "there that thing " * 5000
    escaped = 'a\\"7' * 5000
    rows = [(1, f'secret: "{prose}"', "a"), (2, f'token="{escaped}" and', "a"), (3, f'token="{escaped} and', "a")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    found = {(r["doc_id"], r["value"]) for r in secret_forest.scan_secrets(docs).collect()}
    assert {(1, prose), (2, escaped)} <= found and any(i == 3 and escaped in v for i, v in found)


def test_features_of_long_values_see_all_of_them(spark):
    random.seed(8)
    word = ["there", "found", "that", "thing", "look"]
    path = "/".join(random.choice(word) for _ in range(90))
    keys = "".join(random.choice("0123456789bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ") for _ in range(260))
    values = {1: path + "/1", 2: path + "/" + keys, 3: keys + "/" + path, 4: path + "/" + keys + "/" + path, 5: path + "/" + keys[:44]}
    plain = " ".join(word) + " "
    rows = [(i, plain * 300 + v, "a") for i, v in values.items()]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    unlikely, usual = secret_forest.letter_statistics(docs)
    featured = secret_forest.labelled(secret_forest.with_features(secret_forest.findings(docs), unlikely, usual))
    found = {r["doc_id"]: r for r in featured.collect()}
    assert {i: r["value"] for i, r in found.items()} == values
    assert found[1]["label"] == 0 and found[1]["coverage"] > 0.3
    for i in (2, 3, 4, 5):
        assert found[i]["coverage"] < 0.1 and found[i]["unlikely"] > found[1]["unlikely"] + 1 and found[i]["label"] is None


def test_decontamination_keeps_the_same_rows_for_any_block_size(spark):
    item = " ".join(f"i{k}" for k in range(20))
    rows = [(None, item, 1), (None, PLAIN, 2), (None, PLAIN, 3), (7, f"{item} x", 4), (7, PLAIN, 5), (8, item, 6), (8, item, 7)]
    rows += [(None, None, 8), (7, "", 9), (9, "i1 i2", 10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row int")
    items = spark.createDataFrame([(1, item), (2, "other words of a benchmark")], "item_id bigint, text string")
    for block_words in (2_000_000, 1):
        kept = decontamination.decontaminated(docs, items, block_words=block_words)
        assert sorted(r["row"] for r in kept.collect()) == [2, 3, 5, 8, 9, 10], block_words


def test_rows_without_an_id_are_masked_by_their_own_findings(spark):
    one, two = "0bec99813b773c6855", "7f1cc2093d5a8e4410"
    rows = [(None, f"password={one}", 1), (None, f"password={two} not {one}x", 2), (None, f"see {one} there", 3)]
    rows += [(5, f"password={one}", 4), (5, f"see {one} there", 5), (5, None, 6)] + [(None, f"password={one}", 7)] * 40
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row int").withColumn("source", F.lit("a"))
    scanned = secret_forest.scan_secrets(docs)
    found = [(r["row"], r["text"]) for r in secret_forest.redacted(docs, scanned).collect()]
    assert len(found) == len(rows)
    assert set(found) == {
        (1, "password=[SECRET]"), (2, f"password=[SECRET] not {one}x"), (3, f"see {one} there"),
        (4, "password=[SECRET]"), (5, f"see {one} there"), (6, None), (7, "password=[SECRET]"),
    }
    assert "text_hash" not in queries.op10_secrets(spark, str(SMALL)).columns
