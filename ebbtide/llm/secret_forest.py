"""Secret scans whose false positives a random forest removes, in DataFrame functions only.

A scan takes every run of key-like characters in a text, and every value assigned to a
credential's name, with the words around it. Letter statistics over all documents tell how far
a value looks like the corpus's own words. Values whose nature is plain (a provider's key
format, a credential's name right before a mixed or unlikely value; plain words, a path, a bare
number, a placeholder) are labelled findings and train the forest, which sees only lengths,
character transitions, coverage by usual letter triples, path marks and neighbouring words, and
judges all values.
"""

from __future__ import annotations

import math
import re

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import unused
from ebbtide.plans import durable

BLANKS = r"[\x20\x09-\x0D]+"
LEAST = 12  # characters of a token that is looked into
RUN = r"(?:^|[^A-Za-z0-9+/_\-])((?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{12,}={0,2}|[A-Za-z]{20,})"
NAMED = r"(?i)(pass(word|wd)?|pwd|secret|token|api[_\-]?key|access[_\-]?key|auth|credential|bearer|private[_\-]?key)"
# What comes before the value in an assignment to a credential's name, and the whole of it. There
# is no look-around at either end, and no loop that could backtrack over a long text.
HEAD = (
    "(?i:" + NAMED[4:].replace("(", "(?:") + r"(?:key|value|hash|phrase|code|id|s)?"
    r"(?:[_\-][A-Za-z0-9_\-]{0,40})?[0-9]{0,4}(?:\\?[\"'`])?\]?[\x20\t]{0,8}[=:]{1,3}+>?+[\x20\t]{0,8}+)"
)
QUOTED = "|".join(rf"{q}[^{q}\\\r\n]*+(?:\\.[^{q}\\\r\n]*+)*+{q}" for q in "\"'`")
ASSIGNED = rf"({HEAD})({QUOTED}|[^\x20\x09-\x0D]++)"
LEAST_ASSIGNED = 4  # characters of a value assigned to a credential's name
MARK, UNMARKED = "\ufdd0", "\ufdd1"  # no characters; one that a text has of its own is no mark
# Values that stand for one to be filled in or read from elsewhere.
PLACEHOLDER = (
    r"^(\$\{.*\}|\$[A-Za-z_][A-Za-z_0-9]*|\$\(.*|<.*>|\{.*\}|\[.*\]|%[A-Za-z_]+%|[*.xX?_\-]+"
    r"|(?i:none|null|nil|true|false|undefined)|[A-Za-z_]+(\.[A-Za-z_]+)*[(\[].*)$"
)
PHRASE = r"^\p{L}++(?:[\x20\t',.!?\-]++\p{L}++)*+[.!?]*+$"
# Formats that providers of keys publish.
PROVIDERS = (
    r"^((AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abp]-[A-Za-z0-9\-]{20,}"
    r"|AIza[A-Za-z0-9_\-]{35}|sk_live_[A-Za-z0-9]{16,}|glpat-[A-Za-z0-9_\-]{20})$"
)
MASK = "[SECRET]"
SALTS = 16
WINDOW = 40  # characters over which transitions and coverage are averaged
LETTERS = 27  # a to z, and everything else as 0
PER_CLASS = 20_000  # labelled findings of each class a fit uses at most
TREES, DEPTH, SEED = 20, 6, 10
FEATURES = (
    "length digits upper lower distinct switches unlikely coverage slashes joints hexadecimal "
    "named_before named_near assigned quoted plain_neighbours sample_source"
).split()


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _letter(char: Column) -> Column:
    code = F.ascii(F.lower(char)) - 96
    return F.when((code >= 1) & (code <= 26), code).otherwise(0)


def _assignments(text: Column, ws: Column) -> Column:
    """place, value, before, near, after of each value assigned to a credential's name: to the
    closing quote on its line, or to the next white space without the marks that end a sentence
    or a bracket there that nothing in the value opens."""

    def taken(rest: Column) -> Column:
        """The value without its quotes, and the quote it began with."""
        bare = F.regexp_replace(rest, F.lit(r"^[\"'`]+|[\"'`,;.]+$"), F.lit(""))
        # A bracket at the end stays if its partner is in the value, as in ${NAME}.
        for _ in range(2):
            for opening, closing in (r"(", r")"), (r"\[", r"\]"), (r"{", r"}"):
                alone = rf"^([^{opening}]*?)[{closing}]++[\"'`,;.]*+$"
                bare = F.regexp_replace(bare, F.lit(alone), F.lit("$1"))
        inner = F.substring(rest, F.lit(2), F.char_length(rest) - 2)
        return F.struct(
            F.when(rest.rlike(f"^(?:{QUOTED})$"), inner).otherwise(bare).alias("value"),
            F.regexp_extract(rest, "^[\"'`]*", 0).alias("quote"),
        )

    def starts(marked: Column) -> Column:
        """The marked words' places, once a mark, and what stands before each mark in its word."""
        places = F.filter(
            F.sequence(F.lit(0), F.size(marked) - 1), lambda i: F.contains(F.get(marked, i), F.lit(MARK))
        )

        def of_word(i: Column, parts: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(1), F.size(parts) - 1),
                lambda k: F.struct(i.alias("place"), F.array_join(F.slice(parts, 1, k), "").alias("before")),
            )

        return F.flatten(
            F.transform(places, lambda i: _let(F.split(F.get(marked, i), MARK), lambda parts: of_word(i, parts)))
        )

    def described(pair: Column) -> Column:
        i, v = pair["at"]["place"], pair["own"]["value"]
        return F.struct(
            i.alias("place"),
            v.alias("value"),
            F.concat(pair["at"]["before"], pair["own"]["quote"]).alias("before"),
            F.concat_ws(" ", F.get(ws, i - 2), F.get(ws, i - 1)).alias("near"),
            F.coalesce(F.get(ws, i + F.size(F.split(v, BLANKS))), F.lit("")).alias("after"),
            F.lit(True).alias("whole"),
        )

    own = F.transform(F.regexp_extract_all(text, F.lit(ASSIGNED), F.lit(2)), taken)
    with_marks = F.regexp_replace(F.translate(text, MARK, UNMARKED), F.lit(ASSIGNED), F.lit(f"$1{MARK}$2"))
    marked = F.filter(F.split(with_marks, BLANKS), lambda w: w != "")
    pairs = F.arrays_zip(own.alias("own"), _let(marked, starts).alias("at"))
    return F.filter(F.transform(pairs, described), lambda f: F.char_length(f["value"]) >= LEAST_ASSIGNED)


def findings(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, source, place, value, before, near, after, whole: each run and each value
    assigned to a credential's name (whole), the number of the token it begins in, the rest of the token
    before it, the two words before and the one after. A run that is such a value comes once.

    Null and empty texts have none; repeated rows give theirs each time.
    """

    def runs(ws: Column) -> Column:
        places = F.filter(
            F.sequence(F.lit(0), F.size(ws) - 1),
            lambda i: (F.char_length(F.get(ws, i)) >= LEAST) & F.get(ws, i).rlike(RUN),
        )
        return F.flatten(F.transform(places, lambda i: inside(ws, i)))

    def inside(ws: Column, i: Column) -> Column:
        word = F.get(ws, i)
        return F.transform(
            F.regexp_extract_all(word, F.lit(RUN), F.lit(1)),
            lambda v: F.struct(
                i.alias("place"),
                v.alias("value"),
                F.call_function("substring_index", word, v, F.lit(1)).alias("before"),
                F.concat_ws(" ", F.get(ws, i - 2), F.get(ws, i - 1)).alias("near"),
                F.coalesce(F.get(ws, i + 1), F.lit("")).alias("after"),
                F.lit(False).alias("whole"),
            ),
        )

    def both(ws: Column) -> Column:
        def with_runs(own: Column) -> Column:
            def new(r: Column) -> Column:
                return ~F.exists(own, lambda o: (o["place"] == r["place"]) & (o["value"] == r["value"]))

            return F.concat(own, F.filter(runs(ws), new))

        return F.when(text.rlike(ASSIGNED), _let(_assignments(text, ws), with_runs)).otherwise(runs(ws))

    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    found = _let(words, lambda ws: F.when(F.size(ws) > 0, both(ws)))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", F.explode(found).alias("f"))
    return rows.select("doc_id", "text_hash", "source", "f.*")


def letter_statistics(docs: DataFrame) -> tuple[list[float], list[int]]:
    """From the words of all texts: how unlikely each letter is after each other (negative log
    share), and which three-letter pieces are usual. Both lists have a place per combination,
    so what reaches the driver does not grow with the corpus."""
    words = (
        docs.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+")).alias("w"))
        .groupBy("w")
        .count()
        .filter(F.char_length("w") >= 3)
    )

    def code(size: int):
        def of(i: Column) -> Column:
            total = _letter(F.substring("w", i, F.lit(1)))
            for k in range(1, size):
                total = total * LETTERS + _letter(F.substring("w", i + k, F.lit(1)))
            return F.struct(F.lit(size).alias("size"), total.cast("int").alias("code"))

        return of

    places = F.sequence(F.lit(1), F.char_length("w") - 1)
    triples = F.sequence(F.lit(1), F.char_length("w") - 2)
    pieces = F.concat(F.transform(places, code(2)), F.transform(triples, code(3)))
    counts = (
        words.select(F.explode(pieces).alias("p"), "count").groupBy("p.size", "p.code").agg(F.sum("count").alias("n"))
    ).collect()
    pairs = {r["code"]: r["n"] for r in counts if r["size"] == 2}
    after = [sum(pairs.get(a * LETTERS + b, 0) for b in range(LETTERS)) for a in range(LETTERS)]
    unlikely = [
        -math.log((pairs.get(a * LETTERS + b, 0) + 0.5) / (after[a] + 0.5 * LETTERS))
        for a in range(LETTERS)
        for b in range(LETTERS)
    ]
    three = {r["code"]: r["n"] for r in counts if r["size"] == 3}
    usual = sum(three.values()) / max(1, len(three)) / 10
    return unlikely, [int(three.get(c, 0) > usual) for c in range(LETTERS**3)]


def _table(values: list) -> Column:
    """A constant array; the text folds into a literal before the query runs."""
    return F.split(F.lit(",".join(f"{v:.4g}" for v in values)), ",").cast("array<double>")


def with_features(found: DataFrame, unlikely: list[float], usual: list[int]) -> DataFrame:
    """`findings` plus FEATURES, all double. Coverage is the share of letter triples usual in the
    corpus; it and the unlikeliness of transitions are those of the worst window of a value."""
    value, size = F.col("value"), F.char_length("value").cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count("value", F.lit(pattern)) / size

    def worst_mean(table: list, width: int, worst) -> Column:
        """Of the means over overlapping windows that cover the whole value, the worst."""

        def look(codes: Column) -> Column:
            def at(i: Column) -> Column:
                place = F.get(codes, i)
                for k in range(1, width):
                    place = place * LETTERS + F.get(codes, i + k)
                return F.get(_table(table), place)

            def mean(start: Column) -> Column:
                places = F.sequence(start, F.least(start + WINDOW, F.size(codes)) - width)
                total = F.aggregate(places, F.lit(0.0), lambda s, i: s + at(i))
                return total / F.size(places)

            last = F.greatest(F.size(codes) - WINDOW, F.lit(0))
            starts = F.concat(F.sequence(F.lit(0), last, F.lit(WINDOW // 2)), F.array(last))
            return worst(F.transform(F.array_distinct(starts), mean))

        return _let(F.transform(F.split("value", ""), _letter), look)

    switches = "(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"
    flags = {
        "hexadecimal": value.rlike("^[0-9a-fA-F]+$"),
        "named_before": F.col("before").rlike(NAMED),
        "named_near": F.col("near").rlike(NAMED),
        "assigned": F.col("before").rlike("[=:]") | F.col("near").rlike("[=:]>?$"),
        "quoted": F.col("before").rlike("[\"'`]$"),
        "plain_neighbours": F.col("near").rlike(r"^[\p{L}.,]+ [\p{L}.,]+$") & F.col("after").rlike(r"^[\p{L}.,]+$"),
        "sample_source": F.coalesce("source", F.lit("")).rlike("(?i)test|example|sample|fixture|docs?"),
    }
    shares = {
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / size,
        "switches": share(switches),
        "slashes": share("/"),
        "joints": share(r"[_\-+=]"),
    }
    return found.withColumns(
        {
            "length": F.least(size, F.lit(200.0)),
            "unlikely": worst_mean(unlikely, 2, F.array_max),
            "coverage": worst_mean(usual, 3, F.array_min),
        }
        | shares
        | {k: F.coalesce(v, F.lit(False)).cast("double") for k, v in flags.items()}
    )


def labelled(featured: DataFrame) -> DataFrame:
    """`featured` with label 1 or 0 where a finding's nature is plain, else null."""
    value, length, coverage = F.col("value"), F.col("length"), F.col("coverage")
    mixed = (F.col("digits") > 0) & (F.col("digits") < 1) & (F.col("slashes") == 0)
    named = (F.col("named_before") + F.col("named_near") > 0) & (F.col("assigned") == 1)
    stands_in = F.col("whole") & (
        value.rlike(PLACEHOLDER) | (value.rlike(PHRASE) & (coverage >= F.when(value.rlike(BLANKS), 0.3).otherwise(0.5)))
    )
    unlike_words = (F.col("digits") == 0) & (F.col("slashes") == 0) & (coverage < 0.5)
    assigned = F.col("whole") & (length >= 8) & ~value.rlike(BLANKS) & (mixed | unlike_words)
    secret = value.rlike(PROVIDERS) | (named & mixed & (F.col("digits") >= 0.1) & (length >= 16)) | assigned
    plain = (F.col("digits") == 0) & (coverage >= 0.5) & ~named
    bare_number = (F.col("digits") == 1) & ~named
    path = (F.col("slashes") > 0) & (coverage >= 0.3) & ~named
    label = F.when(stands_in, 0.0).when(secret, 1.0).when(plain | bare_number | path, 0.0)
    return featured.withColumn("label", label)


def fit_forest(findings_with_label: DataFrame, per_class: int = PER_CLASS):
    """A forest over FEATURES from findings with a label, at most about `per_class` of each
    label, drawn by a hash of the finding; None unless both labels occur."""
    known = findings_with_label.filter("label is not null")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    draw = F.pmod(F.xxhash64("value", "doc_id", "place"), F.lit(1 << 20))
    keep = F.lit(False)
    for label, n in counts.items():
        keep = keep | ((F.col("label") == label) & (draw < int(min(1.0, per_class / n) * (1 << 20))))
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featuresCol="_features",
        rawPredictionCol="_raw", probabilityCol="_probability", predictionCol="_prediction",
    )
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="_features")
    return Pipeline(stages=[assembled, forest]).fit(known.filter(keep).select("label", *FEATURES))


def scan_secrets(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, text_hash, place, value, length, score, predicted for every finding of the scan;
    predicted 1 is a secret, 0 a false positive; text_hash is xxhash64 of the row's text.

    Without findings of both labels there is no forest, and the labels themselves decide.
    Null and empty texts and an empty table have no findings; repeated rows repeat theirs;
    columns other than doc_id, text and source are not read.
    """
    unlikely, usual = letter_statistics(docs)
    featured = durable(labelled(with_features(findings(docs), unlikely, usual)))
    model = fit_forest(featured)
    if model is None:
        scored = featured.withColumn("score", F.coalesce("label", F.lit(0.0)))
    else:
        scored = model.transform(featured).withColumn("score", vector_to_array("_probability")[1])
    return scored.select(
        "doc_id",
        "text_hash",
        F.col("place").cast("bigint").alias("place"),
        "value",
        F.char_length("value").cast("bigint").alias("length"),
        F.round("score", 6).alias("score"),
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def redacted(docs: DataFrame, scanned: DataFrame, mask: str = MASK) -> DataFrame:
    """`docs`, all columns, with the secrets that `scan_secrets` found masked in `text`, those of
    less than LEAST characters only where no letter or digit adjoins.

    Findings belong to a doc_id and text, so rows without an id, or with one id and different
    texts, are masked each by its own; rows of one text are spread over SALTS parts of the join.
    """
    doc, bad, key, salt = (unused(docs, name) for name in ("_doc", "_bad", "_key", "_salt"))
    own = (
        scanned.filter("predicted = 1")
        .groupBy(F.col("doc_id").alias(doc), F.col("text_hash").alias(key))
        .agg(F.sort_array(F.collect_set(F.struct(F.length("value").alias("n"), "value")), asc=False).alias(bad))
        .withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )

    def hide(t: Column, value: Column) -> Column:
        alone = F.concat(
            F.lit(r"(?<![A-Za-z0-9])\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![A-Za-z0-9])")
        )
        short = F.regexp_replace(t, alone, F.lit(re.sub(r"([\\$])", r"\\\1", mask)))
        return F.when(F.char_length(value) < LEAST, short).otherwise(F.replace(t, value, F.lit(mask)))

    masked = F.aggregate(bad, F.col("text"), lambda t, b: hide(t, b["value"]))
    row_salt = unused(docs, "_row_salt")
    salted = docs.withColumn(row_salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    same = (
        F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(key)) & (F.col(row_salt) == F.col(salt))
    )
    text = F.when(F.col(bad).isNull(), F.col("text")).otherwise(masked)
    return salted.join(own, same, "left").withColumn("text", text).drop(doc, bad, key, salt, row_salt)
