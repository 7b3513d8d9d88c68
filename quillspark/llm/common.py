"""Helpers that the corpus operators share: scratch tables, Arrow mapping, word splitting."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: No digest, source or bucket beyond this share of all rows escapes the broadcast side table,
#: so that table never has more than this many rows, whatever the input's size.
HOT_SHARE = 1000

#: Ids of at most this many rows are broadcast to filter a table where it lies (16 bytes a row); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000

#: Bytes of words that are hashed at a time.
HASH_BYTES = 1 << 18

_left: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; one of our own only where it names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if (master := spark.sparkContext.master) != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        sc = spark.sparkContext
        if sc._jsc is not None:
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the folder's owner cleans it
        pass


def _drop_scratch(since: int = 0) -> None:
    for spark, path in _left[since:]:
        _delete(spark, path)
    del _left[since:]


class Tables:
    """Scratch tables by name, each of which can go as soon as nothing reads it any more."""

    def __init__(self, name: str) -> None:
        self.name = name
        self.paths: dict[str, tuple[SparkSession, str]] = {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """df, written once to the shared folder and read again."""
        spark = df.sparkSession
        path = scratch_path(spark, f"{self.name}-{name}")
        self.paths[name] = spark, path
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for x in names:
            gone = self.paths.pop(x)
            _delete(*gone)
            _left.remove(gone)


atexit.register(_drop_scratch)


@contextlib.contextmanager
def own_scratch() -> Iterator[None]:
    """Scratch tables made inside are dropped at the end, when nothing reads them any more."""
    since = len(_left)
    try:
        yield
    finally:
        _drop_scratch(since)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _left.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read again: lineage ends here and an executor's loss costs nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_settings(spark: SparkSession) -> None:
    """Small Arrow batches, as one text may be very long; the same for all operators, as plans are run later than they are made."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow form of a flat DDL string; executors have no session that could parse one."""
    pairs = [x.split() for x in ddl.split(",")]
    return pa.schema([(name, pa.list_(_ARROW[kind[6:-1]]) if kind.startswith("array<") else _ARROW[kind]) for name, kind in pairs])


def as_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[x.name], x.type) for x in schema], schema=schema)


def give_back() -> None:
    """Returns freed memory to the system: Python workers live on between tasks and stages, and allocators keep what they once had."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc has no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


#: What this process holds for one kind of work only: how to drop it, by the work's name.
caches: dict[str, Callable[[], None]] = {}


def entered(work: str = "") -> None:
    """A Python worker begins a task: what it remembers for other kinds of work goes."""
    for name in [x for x in caches if x != work]:
        caches.pop(name)()


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], dict | None], ddl: str, work: str = "") -> DataFrame:
    """mapInArrow where f gives the columns of each batch; caches of this kind of work stay with the worker."""
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entered(work)
        for b in batches:
            if b.num_rows and (out := f(b)) is not None:
                yield as_batch(out, schema)
        give_back()

    return df.mapInArrow(run, ddl)


def held_out(doc_id: str, mod: int, left: int) -> F.Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(mod)) == left


def joined_small_hot(rows: DataFrame, answers: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined to answers, one of which each key has.

    Keys with over total / HOT_SHARE rows, of which there are fewer than HOT_SHARE, are broadcast, so no task gets all rows of one; the others are joined by a shuffle.
    """
    limit = max(1, total // HOT_SHARE)
    hot = F.broadcast(answers.filter(F.col(size) > limit))
    rest = rows.join(F.broadcast(answers.filter(F.col(size) > limit).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(answers.filter(F.col(size) <= limit), key))


def free_name(df: DataFrame, name: str) -> str:
    """A name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def keyed(docs: DataFrame, doc_id: str = "doc_id") -> tuple[DataFrame, str]:
    """docs with a private column that tells its rows apart, and that column's name: the id, or where ids are null or repeated a number, for which docs is stored once."""
    row = free_name(docs, "_row")
    again = docs.groupBy(doc_id).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(doc_id).isNull())
    if again.isEmpty():
        return docs.withColumn(row, F.col(doc_id)), row
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), "keyed"), row


def picked(df: DataFrame, ids: DataFrame, key: str, anti: bool = False) -> DataFrame:
    """df's rows whose key is among ids, or isn't; ids must be stored, as they are counted to choose the join."""
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, key, "left_anti" if anti else "left_semi").select(*df.columns)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PLACE = mix64(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_view(data: bytes, lower: bool = False) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    return _LOWER[b] if lower else b


def word_spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of UTF-8 bytes."""
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~_SPACE[b]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same in every process."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    last = np.cumsum(sizes)
    if last[-1] > HASH_BYTES and len(starts) > 1:
        cuts = np.unique([0, *np.searchsorted(last, np.arange(HASH_BYTES, last[-1], HASH_BYTES), "right"), len(starts)])
        return np.concatenate([_hashed(b, starts[x:y], ends[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)])
    return _hashed(b, starts, ends)


def _hashed(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    at = place + np.repeat(starts, sizes)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(_BYTE[b[at]] * (_PLACE[place & 4095] + (place >> 12).astype(np.uint64) * np.uint64(2)), first)
        return mix64(h + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of n consecutive elements."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        m = np.uint64(0x5851F42D4C957F2D + 2 * seed)
        out = np.full(len(h) - n + 1, seed + n, np.uint64)
        for i in range(n):
            out = out * m + h[i : len(h) - n + 1 + i]
        return mix64(out)
