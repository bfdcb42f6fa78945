"""Shared helpers: text buffers as NumPy arrays, vectorised words and hashes, shared-folder tables.

Everything here works on Arrow record batches inside ``mapInArrow`` tasks, a few megabytes at a
time, so that a task's memory depends on the chunk size and not on the partition size.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20
CHUNK_DOCS = 4096
ARROW_ROWS = 2000

# ---------------------------------------------------------------- shared folder


def small_batches(spark: SparkSession) -> SparkSession:
    """Arrow batches of `ARROW_ROWS` rows, unless the session has a size of its own: Spark's 10,000 whole texts are tens of
    megabytes, several times over, outside the executor's heap and again in its Python worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(ARROW_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where unset, a session without other machines (tests) gets one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="meridia-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so a lost executor costs no recomputation."""
    path = table_path(small_batches(df.sparkSession), name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove a table that :func:`materialize` wrote and nothing needs any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of steps that are written down and over: it does so when the driver collects garbage.

    Listeners let go of the last step a moment after it, so this waits that long.
    """
    time.sleep(0.3)
    spark._jvm.System.gc()
    trim_driver(spark)


def trim_driver(spark: SparkSession) -> None:
    """Give freed pages of the driver back, Python's and the JVM's: its compiler's native memory stays with the C library otherwise.

    The JVM's command for that is called by reflection, as the bean's class is not open; a JVM without it keeps the pages.
    """
    release()
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        find = jvm.java.lang.Class.forName
        kinds = array(jvm.java.lang.Class, 4)
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = find(name)
        given = array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        find("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, given)
    except Py4JError:
        pass


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def block_count(docs: DataFrame, text: str = "text", target: int = 8 << 20) -> int:
    """How many blocks of about `target` text bytes the documents make (one cheap aggregate)."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, -(-int(total) // target))


def buckets(spark: SparkSession, count: int, each: int) -> int:
    """Buckets for `count` blocks: as many as Spark's shuffles have, and more where a bucket would get more than `each` blocks."""
    return max(partitions(spark), -(-count // each))


def spread(spark: SparkSession, count: int, each: int = 16) -> int:
    """Partitions for `count` blocks that are taken one at a time."""
    return max(1, min(count, max(4 * partitions(spark), count // each)))


def block_of(count: int, key: str = "doc_id", text: str = "text"):
    """Block number of a document, from its id and text (so that rows without an id, or with one id, spread too)."""
    return F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(count)).cast("int")


def result_fields(df: DataFrame, *made: str) -> tuple[DataFrame, str]:
    """`df` without the columns that an operator makes (its result takes the place of a given column of that name), and the others' types."""
    small_batches(df.sparkSession)
    kept = df.drop(*[c for c in df.columns if c.lower() in {m.lower() for m in made}])
    return kept, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != TEXT)


#: Name of a document's text on its way into an operator.
TEXT = "__meridia_text"


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """Consecutive rows of equal key, as one table each; the batches come sorted by key."""
    claim(None)
    held: list[pa.RecordBatch] = []
    value = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [*np.flatnonzero(run_starts(keys)).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if held and keys[a] != value:
                yield value, pa.Table.from_batches(held)
                held = []
            value = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield value, pa.Table.from_batches(held)
        held = []
    release()


# ---------------------------------------------------------------- memory


@functools.cache
def _allocator():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return None


def release() -> None:
    """Give freed pages back: idle Python workers would keep what their last task used."""
    pa.default_memory_pool().release_unused()
    if trim := _allocator():
        trim(0)


_caches: dict[str, Callable[[], None]] = {}


def cache(owner: str, clear: Callable[[], None]) -> None:
    """Register how to drop what an operator keeps in a Python worker from task to task."""
    _caches[owner] = clear


def claim(owner: str | None) -> None:
    """A worker that now serves another operator drops the caches of the one before."""
    for name in [n for n in _caches if n != owner]:
        _caches.pop(name)()
        release()


# ---------------------------------------------------------------- buffers


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and each row's bounds in them.  A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES, docs: int = CHUNK_DOCS, owner: str | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of at most `docs` rows and `limit` text bytes; a longer text is a slice of its own."""
    claim(owner)
    done = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = int(np.searchsorted(ends, base + limit, "right"))
            to = min(max(to, at + 1), at + docs, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
            done += 1
            if done % 8 == 0:
                release()
    release()


def gathered(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES, docs: int = 1 << 16, owner: str | None = None) -> Iterator[pa.Table]:
    """Consecutive rows of about `limit` text bytes, across batches; a longer text is a table of its own."""
    held: list[pa.RecordBatch] = []
    size = rows = 0
    for part in chunks(batches, text, limit // 8, docs, owner):
        n = pc.sum(pc.binary_length(part.column(text))).as_py() or 0
        if held and (size + n > limit or rows + part.num_rows > docs):
            yield pa.Table.from_batches(held)
            held, size, rows = [], 0, 0
        held.append(part)
        size, rows = size + n, rows + part.num_rows
    if held:
        yield pa.Table.from_batches(held)


# ---------------------------------------------------------------- hashes

_B = np.uint64(0x9E3779B97F4A7C15)
_B_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@functools.cache
def _byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**64 - 1, 256, dtype=np.uint64) | np.uint64(1)


_powers_held: list[np.ndarray] = []


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; one pair of arrays a process, grown when needed."""

    def series(b: np.uint64, n: int) -> np.ndarray:
        x = np.full(n, b, np.uint64)
        x[0] = 1
        return np.cumprod(x)

    if not _powers_held or len(_powers_held[0]) < size:
        n = (size >> 16) + 1 << 16
        _powers_held[:] = [series(_B, n), series(_B_INV, n)]
    return _powers_held[0], _powers_held[1]


class RollingHash:
    """Hash of any substring of a buffer in constant time, from one prefix sum modulo 2**64."""

    def __init__(self, data: np.ndarray, seed: int = 7):
        power, self._inverse = _powers(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.multiply(_byte_values(seed)[data], power[: len(data)], out=self._sums[1:])
        np.cumsum(self._sums, out=self._sums)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._inverse[start] + (end - start).astype(np.uint64))

    def windows(self, length: int) -> np.ndarray:
        """Hashes of all substrings of one length."""
        n = len(self._sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self._sums[length:] - self._sums[:n]) * self._inverse[:n])


# ---------------------------------------------------------------- words

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False


def word_bounds(data: np.ndarray, bounds: np.ndarray, table: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of bytes that `table` marks; runs end with their row."""
    inside = table[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = np.unique(bounds[(bounds > 0) & (bounds < len(data))])
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """True where a row of sorted columns differs from the row before."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    if n:
        out[0] = True
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out
