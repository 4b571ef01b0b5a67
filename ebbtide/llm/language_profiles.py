"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. The vector of three letters in a row binds
theirs: the product of the first permuted twice, the second once and the third as it is. A
text's vector bundles (adds) those of all its letter triples, a language's prototype those of
its training texts scaled to length one, and a text goes to the prototype with the greatest
cosine.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import kept, map_rows

DIMENSIONS, SEED = 1024, 8
TRIPLES, WORDS = 200_000, 400_000  # kept per Python worker; and ten times as many triples in words
CHARACTERS = 500_000  # of texts whose words are counted together, or one longer text
TOGETHER = 4_096  # triples that have their vectors at one time
MOST_LANGUAGES = 10_000
SHARPNESS = 20.0
LETTERS = re.compile(r"[^\W\d_]+")


def letter_vector(letter: str) -> np.ndarray:
    bits = np.random.default_rng([SEED, ord(letter)]).integers(0, 2, DIMENSIONS)
    return (2 * bits - 1).astype(np.int8)


class Bundler:
    """Text vectors. Keeps the words met with the triples they have, both up to a bound; vectors
    of triples are bound from those of their letters whenever they are needed."""

    def __init__(self):
        self._reset()

    def _reset(self) -> None:
        self.number: dict[str, int] = {}  # of a word
        self.begin, self.triples = array("q", [0]), array("q")  # where a word's triples are
        self.place: dict[str, int] = {}  # of a triple
        self.spelt = array("q")  # the three letters of each, as numbers
        self.letter: dict[str, int] = {}
        self.vectors = np.empty((64, DIMENSIONS), np.int8)  # of letters

    def _letter(self, letter: str) -> int:
        at = self.letter.get(letter)
        if at is None:
            at = self.letter[letter] = len(self.letter)
            if at >= len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
            self.vectors[at] = letter_vector(letter)
        return at

    def _triple(self, triple: str) -> int:
        at = self.place.get(triple)
        if at is None:
            at = self.place[triple] = len(self.place)
            self.spelt.extend(map(self._letter, triple))
        return at

    def _learn(self, words: Iterable[str]) -> None:
        for word in words:
            framed = f" {word} "
            self.triples.extend([self._triple(framed[i : i + 3]) for i in range(len(framed) - 2)])
            self.number[word] = len(self.begin) - 1
            self.begin.append(len(self.triples))

    def _bound(self, triples: np.ndarray) -> np.ndarray:
        """The vectors of some triples."""
        a, b, c = np.frombuffer(self.spelt, np.int64).reshape(-1, 3)[triples].T
        first, second = np.roll(self.vectors[a], 2, axis=1), np.roll(self.vectors[b], 1, axis=1)
        return (first * second * self.vectors[c]).astype(np.float32)

    def vectors_of(self, texts: list[str | None]) -> np.ndarray:
        """One row per text; all zero for texts without a letter."""
        out, start, size = [], 0, 0
        for i, text in enumerate(texts):
            size += len(text or "")
            if size > CHARACTERS or i == len(texts) - 1:
                out.append(self._vectors(texts[start : i + 1]))
                start, size = i + 1, 0
        return np.concatenate(out) if out else np.zeros((0, DIMENSIONS), np.float32)

    def _vectors(self, texts: list[str | None]) -> np.ndarray:
        if len(self.place) > TRIPLES or len(self.number) > WORDS or len(self.triples) > 10 * WORDS:
            self._reset()
        split = [LETTERS.findall((t or "").lower()) for t in texts]
        words = list(chain.from_iterable(split))
        # In the order of the texts, so that the sums below are added up alike every time.
        self._learn(w for w in dict.fromkeys(words) if w not in self.number)
        ids = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        rows = np.repeat(np.arange(len(texts)), [len(w) for w in split])
        # Different words of each text and how often, then the triples of those.
        pairs, times = np.unique(rows * len(self.number) + ids, return_counts=True)
        rows, ids = np.divmod(pairs, max(1, len(self.number)))
        begin = np.frombuffer(self.begin, np.int64)
        many = begin[ids + 1] - begin[ids]
        first = np.repeat(begin[ids] - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
        triples = np.array(self.triples, np.int64)[first + np.arange(len(first))]
        rows, times = np.repeat(rows, many), np.repeat(times, many).astype(float)
        # Triples a few at a time, whatever their number, and their counts per text beside them.
        order = np.argsort(triples, kind="stable")
        rows, times, triples = rows[order], times[order], triples[order]
        used, start = np.unique(triples, return_index=True)
        column = np.repeat(np.arange(len(used)), np.diff(np.append(start, len(triples))))
        out = np.zeros((len(texts), DIMENSIONS), np.float32)
        for at in range(0, len(used), TOGETHER):
            end = min(at + TOGETHER, len(used))
            own = slice(start[at], start[end] if end < len(used) else None)
            bag = np.bincount(rows[own] * (end - at) + column[own] - at, times[own], len(texts) * (end - at))
            out += bag.reshape(len(texts), -1).astype(np.float32) @ self._bound(used[at:end])
        return out


def _bundler() -> Bundler:
    return kept("bundler", Bundler)


def _unit(vectors: np.ndarray) -> np.ndarray:
    length = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return np.divide(vectors, length, out=np.zeros(vectors.shape), where=length > 0)


def language_prototypes(docs: DataFrame, per_language: int = 500) -> dict[str, np.ndarray]:
    """Unit prototype per non-null `lang` of `docs`, from about `per_language` different texts of
    each; copies of a text count once.

    Of a language with more texts a hash of the text draws some, at a rate its number of
    different texts gives, so the training set is bounded by `per_language` and the number of
    languages, whatever ids the rows have and however often they are repeated, and no language
    goes without. Sums of one language are added up per task and then by dimension, so only
    prototypes reach the driver.
    """
    known = docs.select("text", "lang", F.xxhash64("text", F.lit(SEED)).alias("_draw")).filter(F.col("lang").isNotNull())
    counts = known.select("lang", "_draw").distinct().groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return {}
    rates = docs.sparkSession.createDataFrame(
        [(r["lang"], min(1.0, per_language / r["count"])) for r in counts], "lang string, _rate double"
    )
    scaled = F.pmod("_draw", F.lit(1 << 20)) / (1 << 20)
    drawn = known.join(F.broadcast(rates), "lang").filter(scaled < F.col("_rate"))
    sample = drawn.groupBy("lang", "_draw").agg(F.any_value("text").alias("text"))

    def bundle(rows):
        sums: dict[str, np.ndarray] = {}
        for texts, langs in rows:
            units = _unit(_bundler().vectors_of(texts))
            for lang in set(langs):
                own = units[[i for i, x in enumerate(langs) if x == lang]].sum(axis=0)
                sums[lang] = sums.get(lang, 0) + own
        yield list(sums), [v.tolist() for v in sums.values()]

    parts = map_rows(sample, ["text", "lang"], bundle, "lang string, sums array<double>")
    totals = (
        parts.select("lang", F.posexplode("sums").alias("at", "v"))
        .groupBy("lang", "at")
        .agg(F.sum("v").alias("v"))
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("sums"))
        .collect()
    )
    found = {r["lang"]: np.array([x["v"] for x in r["sums"]]) for r in totals}
    return {lang: _unit(v[None])[0] for lang, v in sorted(found.items())}


def identify_language(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score, cosine for each row.

    The score is the softmax of the sharpened cosines, the cosine that of the language chosen;
    equal cosines go to the first language by name. Null texts, texts without a letter, and
    all texts if there are no prototypes, are `und` with score and cosine 0. Repeated rows and
    null ids give a row each, an empty table gives none, other columns are not read.
    """
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] for n in names]).reshape(len(names), DIMENSIONS)

    def run(rows):
        for ids, texts in rows:
            vectors = _unit(_bundler().vectors_of(texts))
            some = vectors.any(axis=1)
            if names:
                cosines = vectors @ matrix.T
                best = cosines.argmax(axis=1)
                top = cosines[np.arange(len(best)), best]
                odds = np.exp(SHARPNESS * (cosines - top[:, None]))
                score = np.where(some, 1 / odds.sum(axis=1), 0.0)
                pred = [names[b] if s else "und" for b, s in zip(best, some)]
                yield ids, pred, score.tolist(), np.where(some, top, 0.0).tolist()
            else:
                yield ids, ["und"] * len(ids), [0.0] * len(ids), [0.0] * len(ids)

    schema = "doc_id bigint, lang_pred string, score double, cosine double"
    return map_rows(docs, ["doc_id", "text"], run, schema)
