"""What the operators share: tables, reliable storage, word arrays."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blank characters of the word rule ``[^\x20\x09-\x0D]+``.
BLANKS = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder under the warehouse is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/shared")
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path made by ``scratch`` once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    _PINNED.discard(path)
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def pinned(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read from there, and the path."""
    spark = df.sparkSession
    path = removed_at_exit(scratch(spark, name))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed_at_exit(path: str) -> str:
    _PINNED.add(path)
    return path


_PINNED: set[str] = set()


@atexit.register
def _remove_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    with contextlib.suppress(Exception):  # the context may be gone already
        for path in sorted(_PINNED) if spark else ():
            remove(spark, path)


def text_batches(spark: SparkSession, rows: int = 1024, size: int = 8 << 20) -> None:
    """Batches to Python of at most ``rows`` rows and ``size`` bytes from now on, unless they are smaller already.

    A batch is held several times over (by the JVM, on its way, and as arrays), so
    texts call for smaller ones than the default of 10 000 rows and 64 MB.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(re.match(r"-?\d+", spark.conf.get(key))[0])
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def words(text: Column) -> Column:
    """Words of a text as an array; null: none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != F.lit(""))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


# Word arrays over whole batches of texts --------------------------------------

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD1342543DE82EF95)


def utf8_chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """``(first row, bytes, offsets)`` for runs of texts of about ``limit`` bytes; null: empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), len(column))
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray):
    """Byte spans of the words and the number of words per text."""
    inside = np.empty(len(data) + 1, dtype=bool)
    inside[:-1] = ~_BLANK[data]
    inside[-1] = False
    before = np.empty(len(data) + 1, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    bounds = offsets[1:-1]
    is_start = inside & ~before
    is_end = before & ~inside
    cut = bounds[inside[bounds] & before[bounds]]
    is_start[cut] = True
    is_end[cut] = True
    starts, ends = np.flatnonzero(is_start), np.flatnonzero(is_end)
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes; spans are disjoint and in order."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.zeros(len(starts), dtype=np.int64)
    np.cumsum(lengths[:-1], out=first[1:])
    within = np.arange(total) - np.repeat(first, lengths)
    at = within + np.repeat(starts, lengths)
    powers = np.ones(int(lengths.max()) + 1, dtype=np.uint64)
    powers[1:] = np.multiply.accumulate(np.full(len(powers) - 1, _BASE))
    values = _BYTE[data[at]] * powers[within]
    return mix64(np.add.reduceat(values, first) + lengths.astype(np.uint64) * _BYTE[7])


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive values (runs may cross texts)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, factor = np.zeros(n, dtype=np.uint64), 1
    for j in range(k):
        out += hashes[j : j + n] * np.uint64(factor)
        factor = factor * int(_BASE) % 2**64
    return mix64(out)
