"""Largest inner products by multiprobe p-stable hashing.

A vector's projections on random normal directions, shifted and cut into steps of one width,
name its bucket in each of a few tables. A query looks into its own bucket and then into those
that differ by a step in some projections, in order of the sum of squares of its distances to the
borders it crosses, which puts likelier buckets first. What the buckets of all tables hold is
compared with the query exactly.

Vectors are hashed per class of their norm (a factor of two), scaled by the class's greatest norm
and given one more coordinate that makes their length one, so that nearness in space is largeness
of inner product. How many probes a class needs is measured: the true neighbours of a bounded
sample of queries, found among all rows, must be reached in a share of at least `target`.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import map_rows
from ebbtide.plans import durable
from ebbtide.plans.ranked import first_per_group

NEAREST = 20
TABLES, MOST_CUTS, WIDTH, SEED = 4, 48, 3.0, 12
BUCKET = 256  # rows of a bucket that the number of projections aims at
MOST_PROBES = 2_000  # buckets per table; if they do not reach enough, projections are taken away
SAMPLE, TARGET = 100, 0.96
UNSEEN_PROBES = 16  # in classes that hold no neighbour of the sample
MOST_CLASSES = 10_000
TILE = 512  # rows, and queries, of a bucket that one task compares in one go, about
HELD = 400_000  # results a task keeps before it drops what is not among a query's nearest
NO_ID = (1 << 63) - 1  # stands for a null vec_id, which comes last

FOUND = "query bigint, query_id bigint, row bigint, vec_id bigint, score double"
LISTS = "query bigint, query_id bigint, rows array<bigint>, vec_ids array<bigint>, scores array<double>"
BEST = "query bigint, query_id bigint, vec_id bigint, score double, rank int"


@dataclass(frozen=True)
class NormClass:
    """Vectors of one length and norm class, and how they are hashed."""

    dim: int
    norm_class: int
    rows: int
    scale: float
    cuts: int  # projections per table
    probes: int


def _directions(dim: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng([SEED, dim])
    return random.standard_normal((dim + 1, TABLES * MOST_CUTS)), random.uniform(0, 1, TABLES * MOST_CUTS)


_DIRECTIONS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def projections(vectors: np.ndarray, scale: float | None) -> np.ndarray:
    """In steps, shape (vectors, tables, projections). With `scale`, of stored vectors, whose
    extra coordinate makes up for what their norm lacks; else of queries, scaled to length one."""
    dim = vectors.shape[1]
    if dim not in _DIRECTIONS:
        _DIRECTIONS.clear()  # one dimension at a time
        _DIRECTIONS[dim] = _directions(dim)
    directions, shifts = _DIRECTIONS[dim]
    top = np.abs(vectors).max(axis=1, keepdims=True)
    if scale is None:
        unit = vectors / top
        unit /= np.sqrt((unit**2).sum(axis=1, keepdims=True))
        rest = np.zeros((len(vectors), 1))
    else:
        unit = vectors / scale
        rest = np.sqrt(np.maximum(0, 1 - (unit**2).sum(axis=1, keepdims=True)))
    steps = np.hstack([unit, rest]) @ directions / WIDTH + shifts
    return steps.reshape(-1, TABLES, MOST_CUTS)


def bucket(steps: np.ndarray) -> bytes:
    return np.floor(steps).astype(np.int16).tobytes()


def probe_order(steps: np.ndarray, most: int) -> Iterator[bytes]:
    """At most `most` buckets for one table's projections of a query, likelier ones first.

    Sets of border crossings grow from the cheapest one by moving their dearest crossing to the
    next dearer one or adding that to them, which meets every set once, in order of cost.
    """
    own = np.floor(steps)
    yield own.astype(np.int16).tobytes()
    k = len(steps)
    part = steps - own
    cost = np.concatenate([part**2, (1 - part) ** 2])
    order = np.argsort(cost, kind="stable")
    price = cost[order].tolist()
    place, way = (order % max(1, k)).tolist(), np.where(order < k, -1, 1).tolist()
    heap = [(price[0], (0,))] if k else []
    made = 1
    while heap and made < most:
        spent, crossed = heapq.heappop(heap)
        last = crossed[-1]
        if last + 1 < len(price):
            dearer = price[last + 1]
            heapq.heappush(heap, (spent - price[last] + dearer, (*crossed[:-1], last + 1)))
            heapq.heappush(heap, (spent + dearer, (*crossed, last + 1)))
        if len({place[i] for i in crossed}) == len(crossed):  # not both borders of a projection
            moved = own.copy()
            for i in crossed:
                moved[place[i]] += way[i]
            yield moved.astype(np.int16).tobytes()
            made += 1


def prepared(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """row (a number of the row's own), vec_id, vector, dim, norm_class, norm of the rows that
    take part; written, so that the numbers stay."""
    real = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < math.inf))

    def length(top: Column) -> Column:
        return top * F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + (x / top) * (x / top)))

    # The greatest component is worked out once, not again for each component.
    top = F.array_max(F.transform("vector", F.abs))
    return durable(
        vectors.filter(F.col(column).isNotNull() & real)
        .select(
            F.coalesce(F.col("vec_id").cast("bigint"), F.lit(NO_ID)).alias("vec_id"),
            F.col(column).cast("array<double>").alias("vector"),
        )
        .withColumn("norm", F.transform(F.array(F.nullif(top, F.lit(0.0))), length)[0])
        .filter(F.col("norm") < math.inf)
        .select(
            F.monotonically_increasing_id().alias("row"),
            "vec_id",
            "vector",
            F.size("vector").alias("dim"),
            F.round(F.log2("norm")).cast("int").alias("norm_class"),
            "norm",
        )
    )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def _best(query: np.ndarray, row: np.ndarray, vec_id: np.ndarray, score: np.ndarray, nearest: int) -> np.ndarray:
    """Places of the `nearest` best rows of each query, each row once: greater score, then smaller
    id, then smaller row."""
    order = np.lexsort((row, vec_id, -score, query))
    again = (np.diff(query[order]) == 0) & (np.diff(row[order]) == 0)
    order = order[np.flatnonzero(np.append(True, ~again))[: len(order)]]
    own = query[order]
    begin = np.searchsorted(own, own)
    return order[np.arange(len(own)) - begin < nearest]


class Nearest:
    """The best rows so far of the queries a task has met."""

    def __init__(self, nearest: int):
        self.nearest, self.parts, self.many = nearest, [], 0

    def compare(self, queries, query_rows, query_ids, rows, row_numbers, row_ids) -> None:
        """Add the best of `rows` for each of `queries`.

        A matrix product tells which rows can be among the nearest, with some room for its
        rounding; their scores are then added up in an order that depends on the vectors only,
        so equal vectors have equal scores wherever they are compared.
        """
        product = queries @ rows.T
        product[query_rows[:, None] == row_numbers] = -np.inf
        if rows.shape[0] > self.nearest:
            least = np.partition(product, -self.nearest, axis=1)[:, -self.nearest]
            room = np.abs(queries).sum(axis=1) * np.abs(rows).max() * 1e-12
            chosen = (product >= (least - room)[:, None]) & (product > -np.inf)
        else:
            chosen = product > -np.inf
        q, r = np.nonzero(chosen)
        for at in range(0, len(q), 1 << 16):
            a, b = q[at : at + (1 << 16)], r[at : at + (1 << 16)]
            self._add(query_rows[a], query_ids[a], row_numbers[b], row_ids[b], (queries[a] * rows[b]).sum(axis=1))

    def _add(self, *part) -> None:
        keep = _best(part[0], part[2], part[3], part[4], self.nearest)
        self.parts.append([x[keep] for x in part])
        self.many += len(keep)
        if self.many > HELD:
            self._shrink()

    def _shrink(self) -> None:
        whole = [np.concatenate(x) for x in zip(*self.parts)]
        keep = _best(whole[0], whole[2], whole[3], whole[4], self.nearest)
        self.parts, self.many = [[x[keep] for x in whole]], len(keep)

    def take(self, least: int = 0) -> list[list[np.ndarray]]:
        """What is kept, if more than `least` results are, and forget it."""
        if self.parts:
            self._shrink()
        if self.many <= least:
            return []
        out, self.parts, self.many = self.parts, [], 0
        return out


_LONG, _REAL = pa.int64(), pa.float64()
_FOUND = pa.schema([("query", _LONG), ("query_id", _LONG), ("row", _LONG), ("vec_id", _LONG), ("score", _REAL)])
_BEST = pa.schema([("query", _LONG), ("query_id", _LONG), ("vec_id", _LONG), ("score", _REAL), ("rank", pa.int32())])


def _as_batch(columns, arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)


def _begins(query: np.ndarray) -> np.ndarray:
    """Where another query begins."""
    return np.flatnonzero(np.append(True, np.diff(query) != 0)[: len(query)])


def _as_lists(part) -> pa.RecordBatch:
    """A row per query, for results in order of queries."""
    begin = _begins(part[0])
    offsets = pa.array(np.append(begin, len(part[0])), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in part[2:]]
    first = [pa.array(x[begin], _LONG) for x in part[:2]]
    return pa.RecordBatch.from_arrays(first + lists, names=["query", "query_id", "rows", "vec_ids", "scores"])


def _against_sample(base: DataFrame, sample: dict[int, tuple[np.ndarray, ...]], nearest: int) -> DataFrame:
    """The true nearest rows of a few queries (per dimension: rows, ids, vectors) among all rows."""

    def run(batches):
        best = Nearest(nearest)
        for batch in batches:
            rows, ids, dims = (batch.column(i).to_numpy() for i in (0, 1, 3))
            for dim, (query_rows, query_ids, queries) in sample.items():
                own = np.flatnonzero(dims == dim)
                for at in range(0, len(own), TILE):
                    part = own[at : at + TILE]
                    vectors = _matrix(batch.column(2).take(pa.array(part)), dim)
                    best.compare(queries, query_rows, query_ids, vectors, rows[part], ids[part])
        yield from (_as_batch(x, _FOUND) for x in best.take())

    return base.select("row", "vec_id", "vector", "dim").mapInArrow(run, FOUND)


def _reached_at(query: np.ndarray, row: np.ndarray, cuts: int) -> int:
    """The number of probes per table after which a query meets a row; both by projections."""
    at = MOST_PROBES + 1
    for table in range(TABLES):
        wanted = bucket(row[table, :cuts])
        for i, key in enumerate(probe_order(query[table, :cuts], at - 1), 1):
            if key == wanted:
                at = min(at, i)
                break
    return at


def fit_index(base: DataFrame, queries: DataFrame, nearest: int = NEAREST, target: float = TARGET) -> list[NormClass]:
    """How each class is hashed, from its number of rows and from the true neighbours, among all
    rows, of at most `SAMPLE` of `queries` drawn by a hash. At most `MOST_CLASSES` pairs of a
    dimension and a norm class, a few numbers each, reach the driver."""
    sizes = (
        base.groupBy("dim", "norm_class")
        .agg(F.count(F.lit(1)).alias("rows"), F.max("norm").alias("scale"))
        .limit(MOST_CLASSES + 1)
        .collect()
    )
    if len(sizes) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} dimensions and norm classes")
    drawn = queries.orderBy(F.xxhash64("row", F.lit(SEED)), "row").limit(SAMPLE)
    drawn = drawn.select("row", "vec_id", "vector", "dim").collect()
    sample = {
        dim: (
            np.array([r["row"] for r in drawn if r["dim"] == dim], np.int64),
            np.array([r["vec_id"] for r in drawn if r["dim"] == dim], np.int64),
            np.array([r["vector"] for r in drawn if r["dim"] == dim]),
        )
        for dim in {r["dim"] for r in drawn}
    }
    found = first_per_group(
        _against_sample(base, sample, nearest),
        ["query"],
        [F.col("score").desc(), F.col("vec_id"), F.col("row")],
        nearest,
        "row",
        "rank",
    ).select("query", "row")
    true = found.join(base.select("row", "dim", "norm_class", "vector"), "row").collect() if drawn else []
    steps = {
        int(row): own
        for rows, _, vectors in sample.values()
        for row, own in zip(rows, projections(vectors, None))
    }
    out = []
    for r in sorted(sizes, key=lambda r: (r["dim"], r["norm_class"])):
        own = [t for t in true if (t["dim"], t["norm_class"]) == (r["dim"], r["norm_class"])]
        cuts = min(MOST_CUTS, max(0, round(math.log2(r["rows"] / BUCKET)))) if r["rows"] else 0
        probes = UNSEEN_PROBES if cuts else 1
        if own:
            reach = projections(np.array([t["vector"] for t in own]), r["scale"])
            while cuts:
                at = sorted(_reached_at(steps[t["query"]], x, cuts) for t, x in zip(own, reach))
                probes = at[math.ceil(target * len(at)) - 1]
                if probes <= MOST_PROBES:
                    break
                cuts -= 1
            probes = probes if cuts else 1
        out.append(NormClass(r["dim"], r["norm_class"], r["rows"], r["scale"], cuts, probes))
    return out


def _index(base: DataFrame, model: list[NormClass], tables: int) -> DataFrame:
    """row, vec_id, dim, bucket of each row and table; a bucket's name holds class and table."""
    known = {(c.dim, c.norm_class): c for c in model}

    def run(rows):
        for numbers, ids, dims, classes, vectors in rows:
            out = [[], [], [], []]
            for key in sorted(set(zip(dims, classes))):
                own = [i for i, x in enumerate(zip(dims, classes)) if x == key]
                c = known[key]
                steps = projections(np.array([vectors[i] for i in own]), c.scale)
                for i, x in zip(own, steps):
                    for table in range(tables if c.cuts else 1):
                        name = np.array([*key, table], np.int32).tobytes() + bucket(x[table, : c.cuts])
                        for column, value in zip(out, (numbers[i], ids[i], key[0], name)):
                            column.append(value)
            yield out

    columns = ["row", "vec_id", "dim", "norm_class", "vector"]
    return map_rows(base, columns, run, "row bigint, vec_id bigint, dim int, bucket binary")


def _probes(queries: DataFrame, model: list[NormClass]) -> DataFrame:
    """row, vec_id, dim, bucket for each query and each bucket it looks into."""
    classes: dict[int, list[NormClass]] = {}
    for c in model:
        classes.setdefault(c.dim, []).append(c)

    def run(rows):
        for numbers, ids, dims, vectors in rows:
            for number, own_id, dim, vector in zip(numbers, ids, dims, vectors):
                steps = projections(np.array([vector]), None)[0]
                names = [
                    np.array([dim, c.norm_class, table], np.int32).tobytes() + key
                    for c in classes.get(dim, ())
                    for table in range(TABLES if c.cuts else 1)
                    for key in probe_order(steps[table, : c.cuts], c.probes)
                ]
                yield [number] * len(names), [own_id] * len(names), [dim] * len(names), names

    columns = ["row", "vec_id", "dim", "vector"]
    return map_rows(queries, columns, run, "row bigint, vec_id bigint, dim int, bucket binary")


def _compared(placed: DataFrame, nearest: int) -> DataFrame:
    """Compare the rows of each cell with the queries that follow them."""

    def run(batches):
        best, cell, blocks = Nearest(nearest), None, []
        for batch in batches:
            dims, cells, asks, rows, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            change = (np.diff(cells) != 0) | (np.diff(dims) != 0) | (np.diff(asks) != 0)
            ends = np.append(np.flatnonzero(change) + 1, len(cells))
            start = 0
            for end in ends.tolist() if len(cells) else []:
                own = (int(dims[start]), int(cells[start]))
                vectors = _matrix(batch.column(5).slice(start, end - start), own[0])
                if own != cell:
                    cell, blocks = own, []
                if not asks[start]:
                    blocks.append((vectors, rows[start:end], ids[start:end]))
                elif blocks:
                    blocks = [tuple(np.concatenate(x) for x in zip(*blocks))]
                    for at in range(0, end - start, TILE):
                        a, b = start + at, min(end, start + at + TILE)
                        best.compare(vectors[a - start : b - start], rows[a:b], ids[a:b], *blocks[0])
                start = end
            yield from map(_as_lists, best.take(HELD // 2))
        yield from map(_as_lists, best.take())

    columns = ["dim", "cell", "asks", "row", "vec_id", "vector"]
    return placed.select(*columns).mapInArrow(run, LISTS)


def _merged(found: DataFrame, nearest: int) -> DataFrame:
    """The best of what tasks have found for each query, numbered. A task sends one row a query."""

    def ranked(part) -> pa.RecordBatch:
        keep = _best(part[0], part[2], part[3], part[4], nearest)
        query, query_id, vec_id, score = (part[i][keep] for i in (0, 1, 3, 4))
        return _as_batch((query, query_id, vec_id, score, np.arange(len(query)) - np.searchsorted(query, query) + 1), _BEST)

    def run(batches):
        held = None
        for batch in batches:
            many = np.diff(batch.column(2).offsets.to_numpy())
            part = [np.repeat(batch.column(i).to_numpy(), many) for i in (0, 1)]
            part += [batch.column(i).flatten().to_numpy() for i in (2, 3, 4)]
            held = part if held is None else [np.concatenate(x) for x in zip(held, part)]
            # Rows come in order of queries, so only the last query may go on.
            done = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if done:
                yield ranked([x[:done] for x in held])
                held = [x[done:] for x in held]
        if held is not None:
            yield ranked(held)

    return found.repartition("query").sortWithinPartitions("query").mapInArrow(run, BEST)


def _search(base: DataFrame, queries: DataFrame, model: list[NormClass], nearest: int) -> DataFrame:
    """query, query_id, vec_id, score, rank of the best rows of the buckets queries look into.

    Rows and queries of a bucket that has more than about `TILE` of either are dealt to tiles, and
    each tile of rows meets each tile of queries in a cell of its own. Only bucket names are
    counted and joined to find that out; sizes are known for buckets that have both.
    """
    index, probes = durable(_index(base, model, TABLES)), durable(_probes(queries, model))
    many = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = F.sequence(F.lit(0), F.lit(many - 1))
    held = index.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    asked = probes.groupBy("bucket").agg(F.count(F.lit(1)).alias("asks"))
    tiles = held.join(asked, "bucket").select(
        "bucket",
        F.ceil(F.col("rows") / TILE).cast("int").alias("row_tiles"),
        F.ceil(F.col("asks") / TILE).cast("int").alias("ask_tiles"),
    )
    large = (F.col("row_tiles") > 1) | (F.col("ask_tiles") > 1)
    # A hot bucket's tiles are known under every salt, any other's under the first.
    salted = tiles.withColumn("hot", large).withColumn(
        "salt", F.explode(F.when(large, salts).otherwise(F.array(F.lit(0))))
    )
    hot = tiles.filter(large).select("bucket", F.lit(True).alias("spread"), F.explode(salts).alias("own"))

    def placed(df: DataFrame, kind: int, own: str, other: str) -> DataFrame:
        hashed = df.withColumn("own", F.pmod(F.xxhash64("row"), F.lit(many)).cast("int"))
        known = hashed.join(hot, ["bucket", "own"], "left").withColumn(
            "salt", F.when(F.col("spread"), F.col("own")).otherwise(F.lit(0))
        )
        return (
            known.join(salted, ["bucket", "salt"])
            .withColumn("tile", F.pmod(F.xxhash64("row", F.lit(SEED)), own).cast("int"))
            .withColumn("across", F.explode(F.expr(f"sequence(0, {other} - 1)")))
            .select(
                "row",
                "vec_id",
                "dim",
                F.lit(kind).alias("asks"),
                F.xxhash64("bucket", *(("tile", "across") if kind == 0 else ("across", "tile"))).alias("cell"),
            )
        )

    rows = placed(index, 0, "row_tiles", "ask_tiles").join(base.select("row", "vector"), "row")
    asks = placed(probes, 1, "ask_tiles", "row_tiles").join(queries.select("row", "vector"), "row")
    cells = rows.unionByName(asks).repartition("dim", "cell").sortWithinPartitions("dim", "cell", "asks")
    return _merged(_compared(cells, nearest), nearest)


def nearest_rows(
    vectors: DataFrame, step: int, column: str = "embedding", nearest: int = NEAREST, target: float = TARGET
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id `step` divides, the rows with the
    largest inner products, in double precision, greatest first, ties to the smaller vec_id.

    All other rows are candidates, also those that share the query's vec_id; repeated rows are
    each a candidate and each a query with a result of its own. A null vec_id is never a query
    and comes last among ties. Vectors that are null, empty, zero, of no finite length or with a
    null or non-finite component take no part; vectors of another length than the query's are
    no candidates. A query that the index gives fewer than `nearest` rows is compared with all
    rows, so results are short only where there are no more candidates. An empty table gives no
    rows; other columns are not read.

    The index holds every row. True neighbours are found in a share of about `target`, measured
    on a sample of queries (`fit_index`).
    """
    base = prepared(vectors, column)
    queries = base.filter(F.col("vec_id") % step == 0)
    model = fit_index(base, queries, nearest, target)
    found = _search(base, queries, model, nearest)
    if any(c.cuts for c in model):
        found = durable(found)
        rows: dict[int, int] = {}
        for c in model:
            rows[c.dim] = rows.get(c.dim, 0) + c.rows
        due = base.sparkSession.createDataFrame(
            [(dim, min(nearest, many - 1)) for dim, many in rows.items()], "dim int, due int"
        )
        got = found.groupBy(F.col("query").alias("row")).agg(F.count(F.lit(1)).alias("got"))
        short = durable(
            queries.join(due, "dim")
            .join(got, "row", "left")
            .filter(F.coalesce("got", F.lit(0)) < F.col("due"))
            .select(*queries.columns)
        )
        if not short.isEmpty():
            all_in_one = [replace(c, cuts=0, probes=1) for c in model]
            rest = _search(base, short, all_in_one, nearest)
            found = found.join(short.select(F.col("row").alias("query")), "query", "left_anti").unionByName(rest)
    return found.select(
        "query_id",
        F.col("rank").cast("int").alias("rank"),
        F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"),
        "score",
    )
