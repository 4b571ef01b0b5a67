"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are put into one form, and the documents that hold each are counted per host. A line that
more than a share of the host's documents hold, and more than a few, is boilerplate and removed,
and documents with too little left are rejected: less than a fifth of their words, or fewer words
than any document needs.
Counts are taken per document and line before anything is brought together, and the join back
is salted, so a line that a third of the documents share loads no task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import unused
from ebbtide.plans import durable

BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
FEW, ONE_IN = 10, 50  # a line is common in more documents of a host than FEW and one in ONE_IN
LEFT = 5  # a document is depleted if less than one word in LEFT stays
LEAST_WORDS, MOST_REPEATED = 50, 50
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def _lines() -> Column:
    return F.filter(F.split(_text(), "\n"), lambda x: x.rlike(WORD))


def _line_form(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(line, UPPER, LOWER), BLANKS, " "))


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more, each word once.

    Windows become hashes. Where some are equal, they are sorted with their places, equal
    neighbours give the places of repeated windows, and those are counted by the ground they
    cover, so the work is that of a sort, not of comparing all windows.
    """

    def of_windows(w: Column) -> Column:
        numbered = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(_let(numbered, covered))

    def covered(s: Column) -> Column:
        def twin(x, k):
            return F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(
                F.get(s, k + 1)["h"] == x["h"], F.lit(False)
            )

        places = F.array_sort(F.transform(F.filter(s, twin), lambda x: x["i"]))

        def ground(p):
            new = F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3))))
            return F.aggregate(new, F.lit(0), lambda a, b: a + b)

        return _let(places, ground)

    def windows(ws: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(ws) - 3),
            lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)),
        )

    return F.when(F.size(words) < 3, 0).otherwise(_let(windows(words), of_windows))


def base_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed for each
    row. A null text counts as empty."""
    text = _text()
    counted = _let(
        _words(text),
        lambda ws: F.struct(
            F.size(ws).cast("bigint").alias("n_words"), _repeat_words(ws).cast("bigint").alias("n_repeat_words")
        ),
    )
    repeated_lines = _let(_lines(), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return (
        docs.select(
            "doc_id",
            counted.alias("counted"),
            F.char_length(F.translate(text, WHITE, "")).cast("bigint").alias("word_chars"),
            (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, "")))
            .cast("bigint")
            .alias("n_symbols"),
            repeated_lines.cast("bigint").alias("n_dup_lines"),
        )
        .select(
            "doc_id",
            "counted.n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "counted.n_repeat_words",
        )
        .withColumn(
            "base_failed",
            (F.col("n_words") < LEAST_WORDS)
            | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
        )
    )


def _keyed_lines() -> Column:
    """Hash of host and line form, and number of words, of each line of a text."""
    return F.transform(
        _lines(),
        lambda x: _let(
            _line_form(x),
            lambda form: F.struct(
                F.xxhash64("source", form).alias("line"),
                F.size(F.split(form, " ")).cast("bigint").alias("words"),
            ),
        ),
    )


def common_lines(docs: DataFrame, few: int = FEW, one_in: int = ONE_IN) -> DataFrame:
    """doc_id, line, words, common: each document's different lines, the words it has in them,
    and whether the line is common on its host: in more than `few` documents and in more than
    one in `one_in` of those that have a line.

    Rows with one doc_id are one document. Null hosts are a host, null ids one document.
    """
    own = durable(
        docs.select("doc_id", F.xxhash64("source").alias("host"), F.explode(_keyed_lines()).alias("x"))
        .select("doc_id", "host", "x.line", "x.words")
        .groupBy("doc_id", "host", "line")
        .agg(F.sum("words").alias("words"))
    )
    hosts = own.select("host", "doc_id").distinct().groupBy("host").agg(F.count("*").alias("documents"))
    above = (
        own.groupBy("line", "host")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > few)
        .join(hosts, "host")
        .filter(F.col("n") * one_in > F.col("documents"))
        .select("line", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        .withColumn("common", F.lit(True))
    )
    salted = own.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    marked = salted.join(above, ["line", "salt"], "left")
    return marked.select("doc_id", "line", "words", F.coalesce("common", F.lit(False)).alias("common"))


def line_rules(docs: DataFrame, few: int = FEW, one_in: int = ONE_IN, left: int = LEFT) -> DataFrame:
    """`base_rules` plus common_words (words in common lines) and kept: false if the base rules
    fail or, after common lines are removed, less than one word in `left` remains or fewer than
    LEAST_WORDS.

    Empty and null texts fail the base rules; repeated rows give a row each and are judged as
    one document; an empty table gives none; other columns are not read.
    """
    removed = (
        common_lines(docs, few, one_in)
        .groupBy(F.col("doc_id").alias("_doc"))
        .agg(
            F.sum("words").alias("_words"),
            F.sum(F.when(F.col("common"), F.col("words")).otherwise(0)).alias("common_words"),
        )
    )
    joined = base_rules(docs).join(removed, F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    rest = F.col("_words") - F.col("common_words")
    enough = (rest * left >= F.col("_words")) & (rest >= LEAST_WORDS)
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.coalesce(enough, F.lit(True))).alias("kept"),
        F.coalesce("common_words", F.lit(0)).cast("bigint").alias("common_words"),
    )


def without_common_lines(docs: DataFrame, few: int = FEW, one_in: int = ONE_IN) -> DataFrame:
    """`docs`, all columns, with common lines taken out of `text`; documents without such lines
    keep theirs as it is."""
    doc, bad = unused(docs, "_doc"), unused(docs, "_bad")
    found = (
        common_lines(docs, few, one_in)
        .filter("common")
        .groupBy(F.col("doc_id").alias(doc))
        .agg(F.collect_list("line").alias(bad))
    )
    plain = F.array_join(
        F.filter(
            F.split(_text(), "\n"),
            lambda x: ~F.array_contains(bad, F.xxhash64("source", _line_form(x))),
        ),
        "\n",
    )
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col(doc)), "left")
    text = F.when(F.col(bad).isNull(), F.col("text")).otherwise(plain)
    return joined.withColumn("text", text).drop(doc, bad)
