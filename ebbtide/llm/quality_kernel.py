"""Quality scores: random Fourier features of document statistics, ridge regression from
partition-summed normal equations, isotonic calibration.

Random cosine features approximate a Gaussian kernel, so a ridge fit on them is kernel ridge
regression whose size does not grow with the rows. Each partition adds up its own normal
equations and only those sums, from a fixed number of partitions, reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import give_back, map_rows, small_batches
from ebbtide.plans import durable

FEATURES, SEED, RIDGE = 256, 6, 1e-3
MOST_ROWS = 200_000  # labelled rows a fit uses at most; beyond, a hash of doc_id samples
SUM_PARTS = 16
NAMES = (
    "log_words word_length upper symbols marks digits bars other_scripts distinct repeats "
    "repeated_triples short_words lines repeated_lines"
).split()
STATS = len(NAMES)
UPPER = bytes(range(65, 91))
SYMBOLS = b"#*$%&<>{}[]~^\\_=+@"


def statistics(text: str | None) -> list[float]:
    """Shares and lengths of one text; all zero without words."""
    raw = (text or "").encode()
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * STATS

    def share(characters: bytes) -> float:
        return (size - len(raw.translate(None, characters))) / size

    lines = [x for x in raw.split(b"\n") if x.strip()]
    triples = max(1, n - 2)
    return [
        float(np.log1p(n)),
        sum(map(len, words)) / n,
        share(UPPER),
        share(SYMBOLS),
        share(b"!?"),
        share(b"0123456789"),
        share(b"|"),
        1 - len(raw.decode().encode("ascii", "ignore")) / size,
        len(set(words)) / n**0.8,
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(zip(words, words[1:], words[2:]))) / triples if n > 2 else 0.0,
        sum(len(w) <= 2 for w in words) / n,
        float(np.log1p(len(lines))),
        1 - len(set(lines)) / len(lines),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stats: the statistics of each whole text, a few numbers per row."""

    def run(rows):
        for ids, texts in rows:
            yield ids, [statistics(t) for t in texts]

    return map_rows(docs, ["doc_id", "text"], run, "doc_id bigint, stats array<double>")


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # raw scores, rising
    levels: np.ndarray  # calibrated scores at those, not falling

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return _features(stats, self.mean, self.scale, self.waves, self.shift) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.steps, self.levels)


def _features(stats, mean, scale, waves, shift) -> np.ndarray:
    wave = np.cos(np.clip((stats - mean) / scale, -8, 8) @ waves + shift)
    return np.hstack([wave * np.sqrt(2 / waves.shape[1]), np.ones((len(stats), 1))])


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: rising scores and the least-squares rising levels at them.

    Equal scores form one block from the start, so the order of ties does not matter.
    """
    at, group = np.unique(scores, return_inverse=True)
    weight = np.bincount(group).astype(float)
    total = np.bincount(group, labels)
    blocks: list[list[float]] = []  # total, weight, first, last
    for x, t, w in zip(at.tolist(), total.tolist(), weight.tolist()):
        blocks.append([t, w, x, x])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t, w, _, last = blocks.pop()
            blocks[-1][0] += t
            blocks[-1][1] += w
            blocks[-1][3] = last
    steps = np.array([x for b in blocks for x in (b[2], b[3])])
    levels = np.repeat([b[0] / b[1] for b in blocks], 2)
    return steps, levels


def fit_quality(labelled: DataFrame, most_rows: int = MOST_ROWS) -> QualityModel:
    """A model from rows of doc_id, stats, label (0 or 1).

    At most about `most_rows` documents, chosen by a hash of doc_id, are used, with one row each
    however often they are repeated: four in five for the regression, the rest, which it has not seen, for the calibration. Without rows, or with
    one class only, all texts get that class's share (0.5 without rows).
    """
    total = labelled.select("doc_id").distinct().count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 20))
    rate = min(1.0, most_rows / max(1, total))
    sample = (
        labelled.filter(draw < int(rate * (1 << 20)))
        .groupBy("doc_id")
        .agg(F.min(F.struct("stats", "label")).alias("one"))
        .select("doc_id", "one.stats", "one.label")
        .select(F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(5)).alias("part"), "stats", "label")
        .repartition(SUM_PARTS)
        .persist()
    )
    try:
        return _fit(sample)
    finally:
        sample.unpersist()


def _partition_sums(rows: DataFrame, make, width: int) -> np.ndarray:
    """Sum over partitions of `make(stats, label)`, a `width` x (`width` + 1) matrix."""

    def run(parts):
        total = np.zeros((width, width + 1))
        for stats, labels in parts:
            total += make(np.array(stats), np.array(labels, float))
        yield [total.tobytes()],

    sums = map_rows(rows, ["stats", "label"], run, "sums binary").collect()
    return sum((np.frombuffer(r["sums"]).reshape(width, -1) for r in sums), np.zeros((width, width + 1)))


def _fit(sample: DataFrame) -> QualityModel:
    def moments(stats, label):
        z = np.hstack([stats, np.ones((len(stats), 1))])
        return np.hstack([z.T @ z, (z.T @ label)[:, None]])

    sums = _partition_sums(sample, moments, STATS + 1)
    n, positive = sums[-1, -2], sums[-1, -1]
    mean = sums[-1, :STATS] / max(1, n)
    scale = np.sqrt(np.maximum(0, np.diag(sums)[:STATS] / max(1, n) - mean**2))
    scale[scale < 1e-9] = 1.0
    random = np.random.default_rng(SEED)
    waves = random.normal(size=(STATS, FEATURES)) / np.sqrt(STATS)
    shift = random.uniform(0, 2 * np.pi, FEATURES)
    parts = (mean, scale, waves, shift)
    if not 0 < positive < n:
        share = positive / n if n else 0.5
        return QualityModel(*parts, np.zeros(FEATURES + 1), np.zeros(1), np.array([share]))

    def normal(stats, label):
        z = _features(stats, *parts)
        return np.hstack([z.T @ z, (z.T @ label)[:, None]])

    sums = _partition_sums(sample.filter("part > 0"), normal, FEATURES + 1)
    ridge = RIDGE * max(1.0, sums[-1, -2]) * np.eye(FEATURES + 1) / FEATURES
    ridge[-1, -1] = 1e-9
    weights = np.linalg.solve(sums[:, :-1] + ridge, sums[:, -1])
    model = QualityModel(*parts, weights, np.zeros(1), np.zeros(1))

    def unseen(rows):
        for stats, labels in rows:
            yield model.raw(np.array(stats)).tolist(), labels

    pairs = map_rows(sample.filter("part = 0"), ["stats", "label"], unseen, "raw double, label int").toPandas()
    if len(pairs):
        raw = np.round(pairs["raw"].to_numpy(), 9)
        model.steps, model.levels = isotonic(raw, pairs["label"].to_numpy(float))
    else:
        model.steps, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score_quality(stats: DataFrame, model: QualityModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if the score is at least `threshold`) for each row
    of `document_statistics`.

    Null and empty texts are scored like any text, from statistics that are all zero. Repeated
    rows and null ids give a row each; an empty table gives none.
    """

    def run(rows):
        for ids, values in rows:
            yield ids, np.clip(model.score(np.array(values)), 0, 1).tolist()

    scored = map_rows(stats, ["doc_id", "stats"], run, "doc_id bigint, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def labelled_statistics(stats: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, stats, label for rows with a label; a document labelled more than once takes the
    majority, 1 on a tie. Null labels and null ids are left out."""
    one = (
        labels.filter(F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    )
    return stats.join(one, "doc_id")


def kept_by_quality(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.7, most_rows: int = MOST_ROWS
) -> DataFrame:
    """The rows of `docs`, all columns, that a model fitted to its labelled rows scores at
    `threshold` or more.

    At most about `most_rows` labels, drawn by a hash of doc_id, are sent to the documents; the
    scores are worked out where the rows are, so no text is shuffled.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    rate = min(1.0, most_rows / max(1, known.count()))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 2)), F.lit(1 << 20))
    drawn = known.filter(draw < int(rate * (1 << 20))).select("doc_id", "quality").limit(2 * most_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(drawn.select("doc_id").distinct()), "doc_id")
    stats = durable(document_statistics(found))
    model = fit_quality(labelled_statistics(stats, drawn), most_rows)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        scores = sent.value.score(np.array([statistics(t) for t in texts]).reshape(-1, STATS))
        give_back()
        return pd.Series(scores >= threshold)

    return small_batches(docs).filter(good(F.col("text")))
