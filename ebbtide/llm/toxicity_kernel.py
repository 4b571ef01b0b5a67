"""Toxicity with a subsequence string kernel and a Nyström support vector machine.

Two words are alike as far as they share letter triples in order, gaps allowed: each triple
whose letters span at most SPAN places counts DECAY ** span. So `id-iot`, `idxiot` or a stem
with another ending stay close to the insult they come from. The kernel is reduced to a few
hundred landmark words (Nyström), and a support vector machine is fitted to words that carry
the labels of the sentences they stand in. As its decision is linear in the kernel's triples,
it folds into one weight per triple, and a word costs a few table look-ups however many
landmarks there are. A document's score is a logistic function of its strongest words.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import Recent, map_rows
from ebbtide.plans import durable

SPAN, DECAY = 6, 0.6
ALPHABET = 128
LONGEST = 24  # letters of a word; longer ones are scored in overlapping windows
LANDMARKS = 300
PER_CLASS = 4_000  # labelled rows of each class a fit uses at most
SUM_PARTS = 8  # partitions that sums for the fit come from, whatever the number of words
TOXIC_WORDS_KEPT = 150_000
DOUBT = 2.0  # standard deviations
SEED = 1
OFFSETS = [(j, k) for j, k in combinations(range(1, SPAN), 2)]
PLACES = ALPHABET**3
SENTENCE = re.compile(r"[.!?\n]+")
SPELLED = re.compile(r"(?<!\S)\w(?:[\s.\-_*]\w){2,}(?!\S)")
INSIDE = re.compile(r"[\W_]+")
SUMMARY = 4


def tokens(text: str | None) -> list[str]:
    """Lower-case words as they stand, plus spelled-out ones (`i d i o t`) closed up."""
    low = (text or "").lower()
    return low.split() + [INSIDE.sub("", m) for m in SPELLED.findall(low)]


def bare(token: str) -> str:
    """A token without the marks around and inside it."""
    return token if token.isalnum() else INSIDE.sub("", token)


def views(word: str) -> list[str]:
    """A word, or the overlapping windows of one that is longer than LONGEST letters."""
    if len(word) <= LONGEST:
        return [word]
    return [word[x : x + LONGEST] for x in range(0, len(word), LONGEST // 2)]


def _codes(words: list[str]) -> np.ndarray:
    """Letter codes, one row per word, 0 behind its end; 1 stands for a word's edge."""
    width = max(map(len, words), default=0) + 2
    out = np.zeros((len(words), width + SPAN), np.int64)
    for i, w in enumerate(words):
        out[i, 0] = out[i, len(w) + 1] = 1
        out[i, 1 : len(w) + 1] = [_code(c) for c in w]
    return out


def _code(c: str) -> int:
    return ord(c) - 95 if "a" <= c <= "z" else 28 + ord(c) % (ALPHABET - 28)


def gapped_triples(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Triple numbers per word (PLACES where there is none) and the weight of each column.

    Weights are scaled per word to a length of one, so a word is alike itself by about 1.
    """
    codes = _codes(words)
    width = codes.shape[1] - SPAN
    places, weights = [], []
    for j, k in OFFSETS:
        a, b, c = codes[:, :width], codes[:, j : width + j], codes[:, k : width + k]
        places.append(np.where((a > 0) & (b > 0) & (c > 0), (a * ALPHABET + b) * ALPHABET + c, PLACES))
        weights.append(np.full(width, DECAY ** (k - 2)))
    place = np.hstack(places)
    weight = np.where(place < PLACES, np.concatenate(weights)[None, :], 0.0)
    length = np.sqrt((weight**2).sum(axis=1, keepdims=True))
    return place, weight / np.maximum(length, 1e-9)


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Subsequence kernel of each word with each landmark.

    Only triples that a landmark has are looked at: a table has a row of weights, one per
    landmark, for each of those.
    """
    at, own = gapped_triples(landmarks)
    known, row = np.unique(at, return_inverse=True)
    table = np.zeros((len(known), len(landmarks)))
    np.add.at(table, (row.reshape(at.shape), np.arange(len(landmarks))[:, None]), own)
    table[known == PLACES] = 0
    out = np.zeros((len(words), len(landmarks)))
    for start in range(0, len(words), 512):
        place, weight = gapped_triples(words[start : start + 512])
        found = np.minimum(np.searchsorted(known, place), len(known) - 1)
        word, column = np.nonzero((known[found] == place) & (place < PLACES))
        if len(word):
            shared = table[found[word, column]] * weight[word, column][:, None]
            first = np.flatnonzero(np.append(True, np.diff(word) > 0))
            out[start + word[first]] = np.add.reduceat(shared, first)
    return out


@dataclass
class ToxicityModel:
    table: np.ndarray  # weight per triple
    bias: float
    logit: np.ndarray  # of a document's summary, constant last
    threshold: float = 0.0

    def words(self, words: list[str]) -> np.ndarray:
        """Signed distance of each word from the margin."""
        out = np.empty(len(words))
        for start in range(0, len(words), 4096):
            part = [bare(w) for w in words[start : start + 4096]]
            short = [w[:LONGEST] for w in part]
            place, weight = gapped_triples(short)
            out[start : start + 4096] = (self.table[place] * weight).sum(axis=1) + self.bias
            for i, w in enumerate(part):
                if len(w) > LONGEST:
                    place, weight = gapped_triples(views(w))
                    out[start + i] = ((self.table[place] * weight).sum(axis=1) + self.bias).max()
        return out


class Scorer:
    """A model with the distances of recent words."""

    def __init__(self, model: ToxicityModel):
        self.model, self.known = model, Recent(TOXIC_WORDS_KEPT)

    def summaries(self, texts: list[str | None]) -> np.ndarray:
        """Per text: strongest and second strongest word, words beyond the margin, length."""
        split = [tokens(t) for t in texts]
        found = {w: self.known.find(w) for w in set().union(*split)}
        missing = [w for w, x in found.items() if x is None]
        for w, x in zip(missing, self.model.words(missing).tolist(), strict=True):
            found[w] = x
            self.known.put(w, x)
        out = np.zeros((len(texts), SUMMARY))
        for i, words in enumerate(split):
            far = np.full(len(words) + 2, -1.0)
            far[2:] = np.fromiter(map(found.__getitem__, words), float, len(words))
            second, first = np.sort(np.partition(far, -2)[-2:])
            out[i] = first, second, np.log1p((far > 0).sum()), np.log1p(len(words)) / 10
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.clip(self.summaries(texts), -2, 4) @ self.model.logit[:-1] + self.model.logit[-1]
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


_SCORERS: dict[int, Scorer] = {}


def _scorer(model: ToxicityModel, key: int) -> Scorer:
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(model)
    return _SCORERS[key]


def _newton_sums(x: np.ndarray, positive, negative, w: np.ndarray) -> np.ndarray:
    """What some rows add to gradient (last column) and Hessian of the squared hinge at `w`."""
    f = x @ w
    up, down = positive * (f < 1), negative * (f > -1)
    slope = -(x.T @ (up * (1 - f) - down * (1 + f)))
    return np.hstack([(x.T * (up + down)) @ x, slope[:, None]])


def _svm(sums: Callable[[np.ndarray], np.ndarray], width: int, cost: float = 1.0) -> np.ndarray:
    """Squared-hinge support vector machine, Newton steps. `sums` adds up `_newton_sums` over all
    rows; each counts `positive` times as label 1 and `negative` times as label 0. The last
    coefficient is the constant."""
    w = np.zeros(width)
    penalty = np.ones(width)
    penalty[-1] = 1e-6
    for _ in range(30):
        found = cost * sums(w)
        step = np.linalg.solve(np.diag(penalty) + found[:, :-1], penalty * w + found[:, -1])
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z.T * np.maximum(p * (1 - p), 1e-6)) @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, z.T @ (p - y) + ridge * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """doc_id, text, label, part: at most about `per_class` documents of each class, one text of
    each however many rows it has."""
    one = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    )
    counts = {r["label"]: r["count"] for r in one.groupBy("label").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 20))
    keep = F.lit(False)
    for value, n in counts.items():
        keep = keep | ((F.col("label") == value) & (draw < int(min(1.0, per_class / n) * (1 << 20))))
    chosen = one.filter(keep).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(3)))
    # The bound on rows is what makes the broadcast safe.
    chosen = chosen.limit(4 * per_class)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return durable(found.groupBy("doc_id", "label", "part").agg(F.min("text").alias("text")))


def labelled_sentences(sample: DataFrame) -> DataFrame:
    """sentence, label: the different sentences of the sample. A sentence has the label of its
    document, and 0 if it stands in any document with label 0."""

    def run(rows):
        for texts, labels in rows:
            sentences, own = [], []
            for text, label in zip(texts, labels):
                found = {s.strip() for s in SENTENCE.split(text or "")} - {""}
                sentences.extend(found)
                own.extend([label] * len(found))
            yield sentences, own

    pairs = map_rows(sample, ["text", "label"], run, "sentence string, label int")
    return pairs.groupBy("sentence").agg(F.min("label").alias("label"))


def _word_labels(sentences: DataFrame) -> DataFrame:
    """word, positive, negative: all words and windows of long ones, and the number of sentences
    of each label that they stand in; written."""

    def run(rows):
        for texts, labels in rows:
            words, positive = [], []
            for text, label in zip(texts, labels):
                own = {v for w in tokens(text) for v in views(bare(w))} - {""}
                words.extend(own)
                positive.extend([label] * len(own))
            yield words, positive

    pairs = map_rows(sentences, ["sentence", "label"], run, "word string, label int")
    return durable(
        pairs.groupBy("word").agg(F.sum("label").alias("positive"), F.sum(1 - F.col("label")).alias("negative"))
    )


def _evidence(words: DataFrame) -> DataFrame:
    """word, up, down: weights of each word as label 1 and 0.

    Most words of a toxic sentence are plain words, which stand there as often as anywhere.
    Only what a word exceeds that by, beyond chance, counts as label 1.
    """
    positive, negative = words.agg(F.sum("positive"), F.sum("negative")).first()
    usual = F.col("negative") * (positive / max(1.0, negative))
    chance = DOUBT * F.sqrt(F.greatest("positive", F.lit(1)))
    excess = F.greatest(F.lit(0.0), F.col("positive") - usual - chance)
    weights = words.select(
        "word", F.sqrt(excess).alias("up"), F.sqrt(F.col("negative") + F.col("positive") - excess).alias("down")
    )
    up, down = weights.agg(F.sum("up"), F.sum("down")).first()
    scale = max(1.0, float(np.sqrt(down / max(1e-9, up))))
    return weights.withColumn("up", F.col("up") * scale)


def _landmarks(weights: DataFrame) -> list[str]:
    """Half of them the words that speak most for label 1, half drawn by a hash."""
    lift = F.log((F.col("up") + 0.5) / (F.col("down") + 0.5)) * F.sqrt(F.col("up") + F.col("down"))
    half = LANDMARKS // 2
    strong = weights.orderBy(lift.desc(), "word").limit(half).collect()
    drawn = weights.orderBy(F.xxhash64("word", F.lit(SEED)), "word").limit(half).collect()
    return list(dict.fromkeys(r["word"] for r in strong + drawn))


def _words_machine(weights: DataFrame, landmarks: list[str], whiten: np.ndarray) -> np.ndarray:
    """Coefficients of the machine on the words' Nyström features, the constant last."""
    width = whiten.shape[1] + 1

    def features(rows):
        for words, up, down in rows:
            x = np.hstack([kernel(words, landmarks) @ whiten, np.ones((len(words), 1))]).astype(np.float32)
            yield [r.tobytes() for r in x], up, down

    x = map_rows(weights.repartition(SUM_PARTS), ["word", "up", "down"], features, "x binary, up double, down double")
    x = durable(x)

    def sums(w: np.ndarray) -> np.ndarray:
        def run(rows):
            total = np.zeros((width, width + 1))
            for raw, up, down in rows:
                own = np.frombuffer(b"".join(raw), np.float32).reshape(-1, width).astype(float)
                total += _newton_sums(own, np.array(up), np.array(down), w)
            yield [total.tobytes()],

        parts = map_rows(x, ["x", "up", "down"], run, "sums binary", 2048).collect()
        return sum((np.frombuffer(r["sums"]).reshape(width, -1) for r in parts), np.zeros((width, width + 1)))

    return _svm(sums, width)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS
) -> ToxicityModel:
    """A model from the labelled documents, at most about `per_class` of each class.

    Two thirds of them give the labelled sentences for the words' machine, the rest the
    logistic function from a document's strongest words to its label. Without rows or
    words, or with one class only, all texts get the share of label 1 (0.5 without rows).
    """
    sample = _sample(docs, labels, label, per_class)
    shares = sample.agg(F.count(F.lit(1)), F.sum("label")).first()
    n, toxic = shares[0], shares[1] or 0
    words = _word_labels(labelled_sentences(sample.filter("part < 2"))) if 0 < toxic < n else None
    if words is None or words.isEmpty():
        share = toxic / n if n else 0.5
        odds = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return ToxicityModel(np.zeros(PLACES + 1), -1.0, np.array([0.0] * SUMMARY + [odds]))
    weights = durable(_evidence(words))
    landmarks = _landmarks(weights)
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
    kept = values > 1e-6 * values.max()
    whiten = vectors[:, kept] / np.sqrt(values[kept])
    w = _words_machine(weights, landmarks, whiten)
    alpha = whiten @ w[:-1]
    table = np.zeros(PLACES + 1)
    place, weight = gapped_triples(landmarks)
    np.add.at(table, place, weight * alpha[:, None])
    table[PLACES] = 0
    model = ToxicityModel(table.astype(np.float32), float(w[-1]), np.zeros(SUMMARY + 1))

    def run(rows):
        scorer = Scorer(model)
        for texts, values in rows:
            yield scorer.summaries(texts).tolist(), values

    seen = map_rows(sample.filter("part = 2"), ["text", "label"], run, "x array<double>, label int").toPandas()
    if seen["label"].nunique() == 2:
        summary = np.clip(np.array(seen["x"].tolist()), -2, 4)
        model.logit = _logistic(summary, seen["label"].to_numpy(float))
    else:
        model.logit = np.array([1.0, 1.0, 1.0, 0.0, 0.0])
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if the score is at least `threshold`) for each row.

    Null and empty texts have no words and get the score of that. Repeated rows and null ids
    give a row each, an empty table gives none, other columns are not read.
    """
    key = hash((model.bias, *model.logit.tolist()))

    def run(rows):
        scorer = _scorer(model, key)
        for ids, texts in rows:
            yield ids, scorer.scores(texts).tolist()

    scored = map_rows(docs, ["doc_id", "text"], run, "doc_id bigint, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
