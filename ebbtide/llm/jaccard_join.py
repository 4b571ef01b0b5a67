"""Self-join of documents on the Jaccard similarity of their word shingles, by T-occurrence search.

1. Equal shingle sets are one class with one representative.
2. Sets are cut by hash value into segments of some hundred shingles. If two sets are alike
   to a share t, so are their parts in at least one segment (the whole's share of common
   shingles is a mean of the segments'). Segments that alike share one of their first few
   shingles, and differ in at least as many shingles as their parity sketches differ in bits.
   Classes for which both hold are put into one block; all links lie inside blocks.
3. In a block every class is searched for among the others with inverted lists: to have the
   overlap T the threshold asks for, another class must be on T of the query's lists. The
   longest L lists are set aside (DivideSkip), the short ones merged, and only classes on
   T - L of those are looked up in the long ones by binary search.
4. Links become components. Blocks and lists that are too long are cut into tiles and the
   pairs of tiles spread over tasks. What leaves a task are spanning edges, never all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ebbtide.llm.common import map_rows, unused
from ebbtide.llm.components import connected_components
from ebbtide.plans import durable

WORDS = 100_000  # word hashes kept per Python worker
SEGMENT = 150  # shingles of a segment: between this and twice as many
SKETCH = 128  # bits
TILE_CLASSES = 2_048  # of a list
TILE_SHINGLES, TILE_MEMBERS = 4_000_000, 512  # of a block
SAMPLED, HEAVY = 20_000, 500  # classes sampled for long lists; one in HEAVY makes a list long
SEND_AT_MOST = 1_000_000  # ids in a broadcast; more are joined by shuffling
LONG_LISTS = 0.0085  # the share of list work that sets L, as published with DivideSkip
SALTS = 16
K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * K[3]
    x = x ^ (x >> np.uint64(29))
    x = x * K[0]
    return x ^ (x >> np.uint64(32))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_HASH = _WordHash()


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the different `size`-word shingles of a text; of the whole sequence if
    it has fewer words; none without words. A-Z count as a-z."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = _HASH
    ids = np.array([h[w] for w in words], np.uint64)
    width = min(size, len(words))
    count = len(words) - width + 1
    out = np.full(count, width, np.uint64)
    for k in range(width):
        out = (out + ids[k : k + count]) * K[k % 3]
        out ^= out >> np.uint64(31)
    return np.unique(_mix(out))


class Threshold:
    """Jaccard similarity of at least `part` / `whole`, in whole numbers."""

    def __init__(self, part: int, whole: int):
        self.part, self.whole = part, whole

    def overlap(self, both):
        """Least common shingles of two sets with `both` shingles together."""
        return -(-self.part * both // (self.part + self.whole))

    def own(self, n):
        """Least common shingles of a set of `n` with any partner."""
        return -(-self.part * n // self.whole)

    def largest(self, n):
        """Largest partner of a set of `n`."""
        return n * self.whole // self.part


def _parts(n: int) -> int:
    """Bits of hash value that cut a set of `n` into segments."""
    return max(0, (n // SEGMENT).bit_length() - 1)


def _segments(shingles: np.ndarray, bits: int, threshold: Threshold) -> tuple[list, list]:
    edges = np.searchsorted(shingles, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else []
    keys, facts = [], []
    salt = _mix(np.array([bits + 1], np.uint64))
    low = (shingles & np.uint64(SKETCH - 1)).astype(np.int64)
    for a, b in zip([0, *edges], [*edges, len(shingles)]):
        size = int(b - a)
        if size:
            first = size - threshold.own(size) + 1
            keys.append(shingles[a : a + first] ^ salt)
            odd = np.bincount(low[a:b], minlength=SKETCH) & 1
            s1, s2 = np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()
            facts.append((first, size, s1, s2))
    return keys, facts


def _summaries(docs: DataFrame, size: int, threshold: Threshold) -> DataFrame:
    """doc_id, n, f1, f2, keys, facts: size and fingerprint of each document's set, and what
    its segments show of it (their first shingles; count of those, size and sketch)."""

    def run(rows):
        for ids, texts in rows:
            n, f1, f2, keys, facts = [], [], [], [], []
            for text in texts:
                s = shingle_set(text, size)
                mark = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                n.append(len(s))
                f1.append(int(mark[0]))
                f2.append(int(mark[1]))
                own_keys, own_facts = [], []
                for bits in range(_parts(len(s)), _parts(threshold.largest(len(s))) + 1):
                    k, f = _segments(s, bits, threshold)
                    own_keys += k
                    own_facts += f
                keys.append(np.concatenate(own_keys).tobytes() if own_keys else b"")
                facts.append(np.array(own_facts, np.int64).tobytes())
            yield ids, n, f1, f2, keys, facts
        _HASH.clear()  # the worker may go on with other work

    schema = "doc_id bigint, n bigint, f1 bigint, f2 bigint, keys binary, facts binary"
    return map_rows(docs, ["doc_id", "text"], run, schema)


POSTING = "key bigint, node bigint, size bigint, s1 bigint, s2 bigint"


def _postings(classes: DataFrame) -> DataFrame:
    def run(rows):
        for nodes, keys, facts in rows:
            table = np.frombuffer(b"".join(facts), np.int64).reshape(-1, 4)
            per_node = [len(f) // 32 for f in facts]
            node = np.repeat(np.array(nodes, np.int64), per_node)
            times = table[:, 0]
            key = np.frombuffer(b"".join(keys), np.int64)
            yield (key, *(np.repeat(c, times) for c in (node, table[:, 1], table[:, 2], table[:, 3])))

    return map_rows(classes, ["node", "keys", "facts"], run, POSTING)


def _tiled(postings: DataFrame, classes: DataFrame) -> DataFrame:
    """`postings` plus tile and other: which pair of tiles of its list a row is dealt to.

    Lists of at least one class in HEAVY are known from a sample, so there are at most
    HEAVY times the postings of a class of them. It decides about spreading work only.
    """
    total = classes.count()
    rate = min(1.0, SAMPLED / max(1, total))
    draw = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < int(rate * (1 << 20))
    sampled = _postings(classes.filter(draw)).groupBy("key").count()
    least = max(8, min(total, SAMPLED) // HEAVY)
    heavy = sampled.filter(F.col("count") >= least).select(
        "key", F.ceil(F.col("count") / rate / TILE_CLASSES).cast("int").alias("tiles")
    )
    joined = postings.join(F.broadcast(heavy.filter("tiles > 1")), "key", "left")
    return _dealt(joined)


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows with `tiles` (null: one) repeated for each pair of tiles that their own is in."""
    tiles = F.coalesce("tiles", F.lit(1))
    own = F.pmod(F.xxhash64("node", F.lit(3)), tiles).cast("int")
    return (
        rows.withColumn("own", own)
        .withColumn("with", F.explode(F.sequence(F.lit(0), tiles - 1)))
        .withColumn("tile", F.least("own", "with"))
        .withColumn("other", F.greatest("own", "with"))
        .drop("tiles", "with")
    )


class _Forest:
    """Union-find that hands out the edges that joined something."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def _root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self._root(a), self._root(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.edges.append((a, b))

    def taken(self) -> tuple[list[int], list[int]]:
        out, self.edges = self.edges, []
        return [a for a, _ in out], [b for _, b in out]


def _groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list]:
    """Columns of each run of rows that are equal in the first `by` columns, from sorted
    batches. Fixed-width columns come as arrays, others as lists."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        whole = pa.Table.from_batches(kept).combine_chunks()
        heads = [whole.column(i).to_numpy() for i in range(by)]
        change = np.zeros(whole.num_rows - 1, bool)
        for h in heads:
            change |= h[1:] != h[:-1]
        ends = np.flatnonzero(change) + 1
        if not len(ends):
            continue
        yield from _cut(whole, [0, *ends.tolist()])
        kept = whole.slice(int(ends[-1])).combine_chunks().to_batches()
    if kept:
        whole = pa.Table.from_batches(kept).combine_chunks()
        yield from _cut(whole, [0, whole.num_rows])


def _cut(table: pa.Table, bounds: list[int]) -> Iterator[list]:
    columns = [
        c.to_pylist() if pa.types.is_binary(c.type) else c.to_numpy() for c in table.columns
    ]
    for a, b in zip(bounds, bounds[1:]):
        if b - a > 1:
            yield [c[a:b] for c in columns]


def _alike_lists(dealt: DataFrame, threshold: Threshold) -> DataFrame:
    """u, v: spanning edges of classes whose segments on one list pass size and sketch."""
    arrow = to_arrow_schema(StructType.fromDDL("u bigint, v bigint"))

    def run(batches):
        forest = _Forest()
        for _, tile, other, size, node, own, s1, s2 in _groups(batches, 3):
            cross = tile[0] != other[0]
            s1, s2 = s1.view(np.uint64), s2.view(np.uint64)
            for start in range(0, len(node), 256):
                end = min(start + 256, len(node))
                # Rows are in order of size: partners of these are among the next ones.
                stop = int(np.searchsorted(size, threshold.largest(int(size[end - 1])), "right"))
                a, b = slice(start, end), slice(start, stop)
                both = size[a, None] + size[None, b]
                differ = np.bitwise_count(s1[a, None] ^ s1[None, b]).astype(np.int64)
                differ += np.bitwise_count(s2[a, None] ^ s2[None, b])
                good = differ <= both - 2 * threshold.overlap(both)
                good &= size[None, b] <= threshold.largest(size[a, None])
                good &= np.arange(stop - start)[None, :] > np.arange(end - start)[:, None]
                if cross:
                    good &= own[a, None] != own[None, b]
                for i, j in zip(*(x.tolist() for x in np.nonzero(good))):
                    forest.join(int(node[start + i]), int(node[start + j]))
            if len(forest.edges) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in forest.taken()], schema=arrow)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in forest.taken()], schema=arrow)

    columns = ["key", "tile", "other", "size", "node", "own", "s1", "s2"]
    together = dealt.select(*columns).repartition("key", "tile", "other")
    return together.sortWithinPartitions("key", "tile", "other", "size").mapInArrow(run, "u bigint, v bigint")


class DivideSkip:
    """Inverted lists of some sets, searched for sets with enough shingles in common."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets], np.int64)
        shingles = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(shingles, kind="stable")
        self.owner = owner[order]
        self.shingles, self.begin, self.length = np.unique(
            shingles[order], return_index=True, return_counts=True
        )

    def search(self, query: int, allowed: np.ndarray, threshold: Threshold) -> np.ndarray:
        """The sets, among those `allowed`, that are alike enough to set `query`."""
        own = self.sets[query]
        lists = np.searchsorted(self.shingles, own)
        lists = lists[np.argsort(self.length[lists], kind="stable")]
        need = int(threshold.own(len(own)))
        longest = int(self.length[lists[-1]])
        skip = min(need - 1, int(need / (LONG_LISTS * np.log2(longest + 1) + 1)))
        short, long = lists[: len(lists) - skip], lists[len(lists) - skip :]
        # Merge the short lists: how many of them each set is on.
        length = self.length[short]
        start = np.repeat(self.begin[short] - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
        on = np.bincount(self.owner[start + np.arange(length.sum())], minlength=len(self.sets))
        wanted = threshold.overlap(self.sizes + len(own))
        found = np.flatnonzero(allowed & (on >= need - skip) & (on >= wanted - skip))
        # Look the rest up in the long lists, shorter ones first, dropping sets that can no
        # longer reach their overlap.
        left = len(long)
        for at in long:
            if len(found) <= 16:
                break
            list_ = self.owner[self.begin[at] : self.begin[at] + self.length[at]]
            place = np.searchsorted(list_, found)
            on[found] += list_[np.minimum(place, len(list_) - 1)] == found
            left -= 1
            found = found[on[found] + left >= wanted[found]]
        if left:
            rest = self.shingles[long[len(long) - left :]]
            for y in found.tolist():
                place = np.searchsorted(self.sets[y], rest)
                on[y] += int((self.sets[y][np.minimum(place, len(self.sets[y]) - 1)] == rest).sum())
        return found[on[found] >= wanted[found]]


def _block_links(blocks: DataFrame, threshold: Threshold) -> DataFrame:
    """u, v: spanning edges of the classes linked in each pair of tiles of each block."""
    arrow = to_arrow_schema(StructType.fromDDL("u bigint, v bigint"))

    def run(batches):
        for _, tile, other, node, own, raw in _groups(batches, 3):
            index = DivideSkip([np.frombuffer(r, np.uint64) for r in raw])
            label = np.arange(len(node))
            cross = tile[0] != other[0]
            us, vs = [], []
            for q in np.argsort(index.sizes, kind="stable").tolist():
                if cross and own[q] != tile[0]:
                    continue
                allowed = label != label[q]  # what hangs together already needs no search
                allowed &= (own != own[q]) if cross else (index.sizes <= index.sizes[q])
                if not allowed.any():
                    continue
                for y in index.search(q, allowed, threshold).tolist():
                    if label[y] != label[q]:
                        label[label == label[y]] = label[q]
                        us.append(int(node[q]))
                        vs.append(int(node[y]))
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us), pa.array(vs)], schema=arrow)

    columns = ["block", "tile", "other", "node", "own", "shingles"]
    together = blocks.select(*columns).repartition("block", "tile", "other")
    return together.sortWithinPartitions("block", "tile", "other").mapInArrow(run, "u bigint, v bigint")


def _with_sets(docs: DataFrame, members: DataFrame, size: int, repeated: bool) -> DataFrame:
    """`members` (node, ...) plus the shingle set of the document that stands for each, or of each
    of its different texts if ids are `repeated`."""
    if members.count() <= SEND_AT_MOST:
        members = F.broadcast(members)
    extra = [c for c in members.columns if c != "node"]
    chosen = docs.select("doc_id", "text").join(members, F.col("doc_id") == F.col("node"))
    if repeated:  # rows that are alike in id and text are one per task before they shuffle
        alike = ["node", *extra, F.xxhash64("text").alias("_h1"), F.md5("text").alias("_h2")]
        chosen = chosen.groupBy(*alike).agg(F.any_value("text").alias("text"))

    def run(rows):
        for *kept, texts in rows:
            yield (*kept, [shingle_set(t, size).tobytes() for t in texts])
        _HASH.clear()

    kinds = dict(members.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ["node", *extra]) + ", shingles binary"
    return map_rows(chosen, ["node", *extra, "text"], run, schema)


def jaccard_components(docs: DataFrame, size: int = 3, part: int = 9, whole: int = 10) -> DataFrame:
    """doc_id, n_shingles, component_id for each row: the number of different `size`-word
    shingles, and the smallest doc_id reachable by links. Two documents link when the Jaccard
    similarity of their shingle sets is at least `part` / `whole`.

    Null and empty texts have no shingles and link with nothing. Repeated rows are each given and
    compared once; rows that share a doc_id are one node of the graph, linked by each of their
    texts. Rows with a null
    doc_id have no component (null) and make no links. An empty table gives none; other
    columns are not read.
    """
    threshold = Threshold(part, whole)
    every = durable(_summaries(docs, size, threshold))
    prints = ["f1", "f2", "n"]
    known = every.filter("doc_id is not null and n > 0")
    grouped = known.groupBy(*prints).agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    stands = grouped.select("node", *prints)
    shared = durable(known.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id"))
    repeated = not shared.isEmpty()
    if repeated:
        known = known.dropDuplicates(["doc_id", *prints])
    classes = durable(
        known.withColumnRenamed("doc_id", "node").join(stands, ["node", *prints]).select("node", "n", "keys", "facts")
    )
    maybe = connected_components(_alike_lists(_tiled(_postings(classes), classes), threshold))
    sizes = classes.groupBy("node").agg(F.max("n").alias("n"))
    members = maybe.join(sizes, "node").select("node", F.col("component").alias("block"), "n")
    by_size, by_count = F.ceil(F.sum("n") / TILE_SHINGLES), F.ceil(F.count("*") / TILE_MEMBERS)
    tiles = members.groupBy("block").agg(F.greatest(by_size, by_count).cast("int").alias("tiles"))
    placed = durable(members.join(tiles, "block").select("node", "block", "tiles"))
    links = _block_links(_dealt(_with_sets(docs, placed, size, repeated)), threshold)
    if repeated:  # a document with several texts hangs together with the classes of all of them
        own = known.select("doc_id", *prints).join(shared, "doc_id").join(stands, prints)
        links = links.union(own.select(F.col("node").alias("u"), F.col("doc_id").alias("v")))
    joined = durable(connected_components(links))
    # Copies find their class by fingerprint, which is salted as one text may be on a third of
    # the rows; all others stand for themselves.
    same = (
        grouped.filter("copies > 1")
        .join(joined, "node", "left")
        .select(*prints, F.coalesce("component", "node").alias("of_class"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    salted = every.select("doc_id", *prints).withColumn(
        "salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    )
    found = salted.join(same, [*prints, "salt"], "left").join(
        joined.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left"
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of_class", "component", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each_group(docs: DataFrame, size: int = 3, part: int = 9, whole: int = 10) -> DataFrame:
    """The rows of `docs`, all columns, whose document has the smallest doc_id of its component.
    Rows with a null doc_id stay."""
    found = jaccard_components(docs, size, part, whole)
    own = unused(docs, "_gone")
    gone = durable(found.filter("component_id < doc_id").select(F.col("doc_id").alias(own)).distinct())
    if gone.count() <= SEND_AT_MOST:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col("doc_id") == F.col(own), "left_anti")
