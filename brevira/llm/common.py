"""What several corpus operators share: the shared folder, column choice, and fast word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import remove, shared_dir, staged  # noqa: F401

_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C55
_BASE_INV = pow(_BASE, -1, 1 << 64)


def stash(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    return staged(df, tag)


def discard(df: DataFrame) -> None:
    """Delete a stashed table that no later plan reads."""
    remove(df.sparkSession, list({x.rsplit("/", 1)[0] for x in df.inputFiles()}))


def free(name: str, *tables: DataFrame) -> str:
    """``name``, with underscores before it until no column of the tables is called so in any case of letters."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Up to so many rows a table of ids (8 to 24 bytes each) is broadcast; beyond, it is a shuffled join.
BROADCAST_IDS = 500_000


def bounded(df: DataFrame, n_rows: int) -> DataFrame:
    """``df``, of columns of fixed width, with a broadcast hint if its counted rows are within the bound, else as it is."""
    return F.broadcast(df) if n_rows <= BROADCAST_IDS else df


def _powers(base: int) -> np.ndarray:
    return np.array([1, base & _M64], np.uint64)


_pow, _ipow = _powers(_BASE), _powers(_BASE_INV)


def _grow(n: int) -> None:
    global _pow, _ipow
    if len(_pow) < n:
        n = max(n, 1 << 16, 2 * len(_pow))
        out = []
        for base in (_BASE, _BASE_INV):
            x = np.full(n, base & _M64, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _pow, _ipow = out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix's finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of an array of numbers."""
    _grow(len(x) + 1)
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * _pow[: len(x)], out=total[1:])
    return mix((total[ends] - total[starts]) * _ipow[starts])


def word_hashes(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a text, A-Z lower-cased, as (64-bit hashes, byte starts, byte ends, lower-cased bytes).

    A word is a run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``: in UTF-8 the bytes 0-9, a-z and all from 0x80
    up, so whole texts are cut and hashed in a few array operations.
    """
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    low = raw + (((raw - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))
    is_word = ((low - np.uint8(97)) < 26) | ((low - np.uint8(48)) < 10) | (low >= 128)
    edge = np.diff(is_word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return span_hashes(low, starts, ends), starts, ends, low


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k-grams of a word-hash sequence."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    return mix(out)


#: Rows of an Arrow batch that Python works on at a time; bounds what a worker holds beside the batch itself.
SLICE, BATCH = 512, 1024


def release() -> None:
    """Give freed memory back to the system: workers are reused, and what one operator held would count for the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not on every C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Whole texts make large rows: small Arrow batches bound what JVM and worker hold of them. A smaller setting of the
    session stays; the setting is read when a plan runs, so it has to be the session's."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))


def add_columns(df: DataFrame, inputs: list[str], ddl: str, make, drop: list[str] | tuple = ()) -> DataFrame:
    """``df`` with the columns of ``ddl``, made in Python from whole Arrow batches; columns of the same name are replaced.

    ``make()`` runs once per task and returns a function from one list per input column to one list per new column.
    All other columns pass through as Arrow arrays, untouched, but for those in ``drop``, which are not returned.
    """
    new = StructType.fromDDL(ddl)
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c in inputs or c not in new.names])
    over = [c for c in df.columns if c not in new.names and c not in drop]
    types = [f.type for f in to_arrow_schema(new)]

    small_batches(df.sparkSession)

    def run(batches):
        f = make()
        try:
            for b in (x.slice(i, SLICE) for x in batches for i in range(0, x.num_rows, SLICE)):
                made = f(*[b.column(c).to_pylist() for c in inputs])
                arrays = [pa.array(x, t) for x, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in over), *arrays], names=[*over, *new.names])
        finally:
            release()

    return df.mapInArrow(run, StructType([*(df.schema[c] for c in over), *new.fields]))
