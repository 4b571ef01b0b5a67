"""What several operators share: tables, folds, texts as Arrow batches, bounded memory."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROWS = 256  # rows of a batch that are Python objects at one time
# What Spark hands to a Python worker at one time. Texts are long, and its own 10,000 rows of them
# are held by the executor, in Arrow's buffers and by the worker.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_fold(key: str, parts: int, part: int) -> Column:
    """Whether crc32 of the key as text leaves `part` modulo `parts`; false for a null key."""
    rest = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts))
    return F.coalesce(rest == part, F.lit(False))


def unused(df: DataFrame, name: str) -> str:
    """`name`, made longer until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, whose session from now on sends texts to Python workers in `BATCHES`."""
    for name, value in BATCHES.items():
        df.sparkSession.conf.set(name, value)
    return df


_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]):
    """What a Python worker keeps under `name` from task to task, made if it has none. Workers
    live on from operator to operator; what others kept there is dropped."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def give_back() -> None:
    """Return freed memory of this Python worker to the system at the end of a task. It stays with
    the allocators otherwise, and the most that any operator needed adds up over operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library, which has its own ways


def map_rows(
    df: DataFrame,
    columns: Sequence[str],
    fn: Callable[[Iterator[tuple[list, ...]]], Iterable[Sequence[Sequence]]],
    schema: str,
    size: int = ROWS,
) -> DataFrame:
    """`fn` over `columns` of `df`, `size` rows at a time.

    `fn` gets an iterator of tuples of lists, one list per column, for one partition, and
    yields one list per column of `schema`. Only `columns` are read, so other columns of the
    input, whatever their names, neither matter nor clash.
    """
    fields = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(fields)

        def rows():
            for batch in batches:
                for at in range(0, batch.num_rows, size):
                    part = batch.slice(at, size)
                    yield tuple(c.to_pylist() for c in part.columns)

        for out in fn(rows()):
            arrays = [pa.array(v, f.type) for v, f in zip(out, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        give_back()

    return small_batches(df).select(*columns).mapInArrow(run, schema)


class Recent(dict):
    """A dict of at most 2 x `size` entries: when the newer half is full, the older is dropped.

    An entry that is asked for with `find` moves to the newer half, so frequent ones stay.
    """

    def __init__(self, size: int):
        super().__init__()
        self.size, self.older = size, {}

    def find(self, key):
        found = self.get(key)
        if found is None:
            found = self.older.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value
