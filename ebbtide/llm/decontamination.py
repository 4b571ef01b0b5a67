"""Benchmark decontamination with suffix arrays of the training texts.

The documents of a batch are one shard: their words, numbered by the benchmark's vocabulary,
form one sequence, and the suffixes that could match (those that start with two words that
follow each other in the benchmark) are sorted by their first words. Each window of a
benchmark item, and so each of its suffixes, is then found by binary search in the shard's
suffix array, which gives all places at once. Neighbouring windows join into longest verbatim
matches. No document leaves its task, so there is no shuffle whatever the number of copies.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import give_back, map_rows, small_batches, unused
from ebbtide.plans import durable

WINDOW = 13
BLOCK_WORDS = 2_000_000  # benchmark words searched for in one pass; bounds what is sent out
SHARD_ROWS, SHARD_BYTES = 512, 4 << 20  # of a shard's texts; or one longer text
MATCH = ("item_id", "start", "item_start", "length")
FOUND = (
    "doc_id bigint, n_words bigint, hits array<struct<start: bigint, stop: bigint>>, "
    "items array<bigint>, matches array<struct<item_id: bigint, start: bigint, item_start: bigint, length: bigint>>"
)
TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z in lower case."""
    return (text or "").encode().translate(TO_WORDS).split()


class BenchmarkIndex:
    """The different windows of some benchmark items, as keys a suffix array can be searched for."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        places: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for item, words in items:
            ids = [self.number[w] for w in words]
            for at in range(max(0, len(ids) - window) + 1 if ids else 0):
                places[tuple(ids[at : at + window])].append((item, at))
        self.places = list(places.values())
        self.length = np.array([len(k) for k in places], np.int64)
        low = np.zeros((len(places), window), ">u4")
        high = np.full((len(places), window), 0xFFFFFFFF, ">u4")
        for i, key in enumerate(places):
            low[i, : len(key)] = high[i, : len(key)] = key
        self.low, self.high = _keys(low), _keys(high)
        follows = {a * (len(self.number) + 1) + b for key in places for a, b in zip(key, key[1:])}
        self.follows = np.array(sorted(follows), np.int64)

    def _suffixes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sparse suffix array of a shard: places in order, and their sorted keys."""
        at = np.flatnonzero(ids)
        if len(self.length) and self.length.min() > 1:
            following = np.append(ids, 0)[at + 1]
            at, following = at[following > 0], following[following > 0]
            pair = ids[at] * (len(self.number) + 1) + following
            found = np.searchsorted(self.follows, pair)
            at = at[self.follows[np.minimum(found, len(self.follows) - 1)] == pair]
        padded = np.concatenate([ids, np.zeros(self.window, ids.dtype)]).astype(">u4")
        keys = _keys(padded[at[:, None] + np.arange(self.window)])
        order = np.argsort(keys, kind="stable")
        return at[order], keys[order]

    def find(self, texts: list[str | None]) -> list[tuple[int, list, list, list]]:
        """Per text: number of words, runs of hit words, item ids, longest verbatim matches."""
        shard = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in shard], np.int64)
        number = self.number
        ids = np.array([number.get(w, 0) for ws in shard for w in [*ws, b""]], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        out: list[tuple[int, list, list, list]] = [(int(n), [], [], []) for n in sizes]
        suffixes, keys = self._suffixes(ids)
        if not len(suffixes) or not len(self.low):
            return out
        first = np.searchsorted(keys, self.low, "left")
        last = np.searchsorted(keys, self.high, "right")
        hit = np.flatnonzero(last > first)
        if not len(hit):
            return out
        runs = last[hit] - first[hit]
        which = np.repeat(hit, runs)
        inside = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        place = suffixes[np.repeat(first[hit], runs) + inside]
        marks = np.zeros(len(ids) + 1, np.int64)
        np.add.at(marks, place, 1)
        np.add.at(marks, place + self.length[which], -1)
        covered = np.concatenate([[0], (np.cumsum(marks[:-1]) > 0).astype(np.int8), [0]])
        edges = np.flatnonzero(np.diff(covered)).reshape(-1, 2)
        doc = np.searchsorted(starts, place, "right") - 1
        for (a, b), d in zip(edges.tolist(), (np.searchsorted(starts, edges[:, 0], "right") - 1).tolist()):
            out[d][1].append((a - int(starts[d]), b - int(starts[d])))
        lines = defaultdict(list)  # (doc, item, shift between them): places in the item
        for d, p, w in zip(doc.tolist(), (place - starts[doc]).tolist(), which.tolist()):
            for item, at in self.places[w]:
                lines[d, item, p - at].append((at, int(self.length[w])))
        longest: dict[tuple[int, int], tuple[int, int, int]] = {}
        for (d, item, shift), found in lines.items():
            found.sort()
            begin, end = found[0][0], found[0][0] + found[0][1]
            for at, size in [*found[1:], (1 << 60, 0)]:
                if at > end - size + 1:  # not the next window along
                    best = longest.get((d, item), (0, 0, 0))
                    longest[d, item] = max(best, (end - begin, -(begin + shift), begin))
                    begin = at
                end = at + size
        for (d, item), (size, place_, at) in sorted(longest.items()):
            out[d][2].append(item)
            out[d][3].append((item, -place_, at, size))
        return out


def _keys(numbers: np.ndarray) -> np.ndarray:
    wide = numbers.shape[1] * 4
    return np.ascontiguousarray(numbers).view(f"S{wide}").reshape(-1)


def benchmark_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[BenchmarkIndex]:
    """Indexes of all items, each of about `block_words` words at most (or one longer item).

    Items come to the driver block by block, one block being held at a time. Null texts, texts
    without a word and null ids are left out; an id that comes with several texts has the
    windows of all of them.
    """
    block: list[tuple[int, list[bytes]]] = []
    size = 0
    known = benchmark.select("item_id", "text").filter("item_id is not null and text is not null")
    for row in known.toLocalIterator():
        words = words_of(row["text"])
        if block and size + len(words) > block_words:
            yield BenchmarkIndex(block)
            block, size = [], 0
        if words:
            block.append((row["item_id"], words))
            size += len(words)
    yield BenchmarkIndex(block)


def _shards(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of texts that make a shard."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if i > start and (size > SHARD_BYTES or i - start == SHARD_ROWS):
            yield start, i
            start, size = i, len(text or "")
    if start < len(texts):
        yield start, len(texts)


def _search(docs: DataFrame, sent: Broadcast) -> DataFrame:
    """FOUND plus `key`, for docs with a `key` and a broadcast index."""

    def run(rows):
        for ids, keys, texts in rows:
            for lo, hi in _shards(texts):
                found = sent.value.find(texts[lo:hi])
                yield (
                    ids[lo:hi],
                    [n for n, _, _, _ in found],
                    [[{"start": a, "stop": b} for a, b in hits] for _, hits, _, _ in found],
                    [items for _, _, items, _ in found],
                    [[dict(zip(MATCH, m)) for m in matches] for _, _, _, matches in found],
                    keys[lo:hi],
                )

    return map_rows(docs, ["doc_id", "key", "text"], run, f"{FOUND}, key bigint", SHARD_ROWS)


def _best_matches(matches: Column, items: Column) -> Column:
    """Of each item the longest match, of equals the first in the document, as `find` has them."""

    def best(item: Column) -> Column:
        own = F.transform(
            F.filter(matches, lambda m: m["item_id"] == item),
            lambda m: F.struct(m["length"], -m["start"], m["item_start"], m.alias("m")),
        )
        return F.array_max(own)["m"]

    return F.transform(items, best)


def _united(hits: Column) -> Column:
    """Sorted runs with overlapping and touching ones joined."""
    start = F.array().cast("array<struct<start: bigint, stop: bigint>>")

    def add(done, run):
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], run["stop"]).alias("stop"))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))
        touches = (F.size(done) > 0) & (run["start"] <= F.try_element_at(done, F.lit(-1))["stop"])
        return F.when(touches, joined).otherwise(F.concat(done, F.array(run)))

    return F.aggregate(F.array_sort(hits), start, add)


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """doc_id, n_words, hits (runs of words inside any occurrence of a window), items (ids with
    an occurring window), matches (per item the longest verbatim match, the first of equals)
    for each row.

    Null and empty texts have no words and no hits; repeated rows and null ids give a row
    each; an empty benchmark hits nothing; other columns are not read. A benchmark larger than
    `block_words` is searched for in several passes, each written before the next begins; their
    rows meet per document and text.
    """
    return _keyed_matches(docs, benchmark, block_words).drop("key")


def _keyed_matches(docs: DataFrame, benchmark: DataFrame, block_words: int) -> DataFrame:
    """`benchmark_matches` plus key, a hash of the row's text."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    context = docs.sparkSession.sparkContext
    blocks = benchmark_blocks(benchmark, block_words)
    index, following = next(blocks), next(blocks, None)
    if following is None:
        return _search(keyed, context.broadcast(index))
    rows, at = None, 0
    while index is not None:  # a pass is written before the next one's index is sent out
        sent = context.broadcast(index)
        found = durable(_search(keyed, sent)).withColumn("pass", F.lit(at))
        sent.destroy()
        rows = found if rows is None else rows.unionByName(found)
        index, following, at = following, next(blocks, None), at + 1
    once = rows.groupBy("doc_id", "key", "pass").agg(
        F.first(F.struct("n_words", "hits", "items", "matches")).alias("r"), F.count("*").alias("copies")
    )
    return (
        once.groupBy("doc_id", "key")
        .agg(F.collect_list("r").alias("r"), F.max("copies").alias("copies"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
        .select(
            "doc_id",
            "key",
            F.col("r")[0]["n_words"].alias("n_words"),
            _united(F.flatten("r.hits")).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten("r.items"))).alias("items"),
            F.flatten("r.matches").alias("matches"),
        )
        .withColumn("matches", _best_matches(F.col("matches"), F.col("items")))
    )


def _n_hit() -> Column:
    return F.aggregate("hits", F.lit(0).cast("bigint"), lambda s, h: s + h["stop"] - h["start"])


def _contaminated(one_in: int) -> Column:
    return (_n_hit() > 0) & (_n_hit() * one_in >= F.col("n_words"))


def contamination(found: DataFrame, one_in: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, from `benchmark_matches`.
    Contaminated: at least one word in `one_in` is hit."""
    names = F.concat_ws(",", F.array_sort(F.transform("items", lambda i: i.cast("string"))))
    return found.select(
        "doc_id",
        "n_words",
        _n_hit().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        _contaminated(one_in).alias("contaminated"),
    )


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, one_in: int = 20, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """The rows of `docs`, all columns, that are not contaminated. Null texts stay."""
    blocks = benchmark_blocks(benchmark, block_words)
    index = next(blocks)
    if next(blocks, None) is not None:  # several passes: decide per document and text
        doc, key = unused(docs, "_doc"), unused(docs, "_key")
        found = _keyed_matches(docs, benchmark, block_words)
        bad = found.filter(_contaminated(one_in)).select(F.col("doc_id").alias(doc), F.col("key").alias(key)).distinct()
        same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(key))
        return docs.join(bad, same, "left_anti")
    sent = docs.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        out = []
        own = texts.tolist()
        for lo, hi in _shards(own):
            for n, hits, _, _ in sent.value.find(own[lo:hi]):
                hit = sum(b - a for a, b in hits)
                out.append(not (hit and hit * one_in >= n))
        give_back()
        return pd.Series(out, dtype=bool)

    return small_batches(docs).filter(clean(F.col("text")))
