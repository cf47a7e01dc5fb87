"""Shared plumbing of the training-data operators: the shared folder, text helpers, tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenospark.storage import discard, materialize, shared_dir

__all__ = ["WordHashes", "crc_mod", "discard", "materialize", "per_batch", "rolling", "shared_dir", "slices", "small_batches", "words", "write_few"]


def write_few(df: DataFrame, name: str) -> DataFrame:
    """materialize() in fewer files, for operators that write many small tables one after the other.

    Each file that is written to a local folder makes the executor start a process; where very many
    are, these weigh more than some width of the stage.
    """
    return materialize(df, name, files_per_core=3)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Tables written within get texts to Python in batches of 1,000 rows, unless the session says otherwise.

    Spark's own 10,000 would hold some tens of MB of text outside the heap for each task. The
    session's setting is put back on leaving.
    """
    before = spark.conf.get(ARROW_ROWS)
    if before == "10000":
        spark.conf.set(ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def crc_mod(column: str, n: int):
    """crc32 of the column as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def words(raw: bytes) -> list[bytes]:
    """Lower-case A-Z, then the maximal runs of bytes other than space and 0x09-0x0D.

    Both bytes.lower() and bytes.split() know ASCII only, which is just what is wanted.
    """
    return raw.lower().split()


def per_batch(fn: Callable) -> Callable:
    """Lift a function from one Arrow batch to another to an iterator of them, for mapInArrow."""

    def run(batches):
        for batch in slices(batches):
            yield fn(batch)

    return run


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` of text, or one row: what a worker unpacks at
    once stays small, however many long texts meet."""
    for b in batches:
        if b.nbytes <= most_bytes:
            if b.num_rows:
                yield b
            continue
        size = None
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
                n = pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype("int64")
                size = n if size is None else size + n
        start, held = 0, 0
        for i, n in enumerate([] if size is None else size.tolist()):
            if held and held + n > most_bytes:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n
        yield b.slice(start)
    _give_back()


def _give_back() -> None:
    """At the end of a task, return freed memory to the system: the worker stays for later tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class WordHashes(dict):
    """64-bit hashes of words, the same in every process; remembers a bounded number of them."""

    most = 100_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, ws: list[bytes]):
        import numpy as np

        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


_ROLL = 0x9E3779B97F4A7C15 | 1


def rolling(h, k: int):
    """Hash of each run of k word hashes: Karp-Rabin's polynomial modulo 2**64, all starts at once."""
    import numpy as np

    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out *= np.uint64(_ROLL)
        out += h[i : i + n]
    return out
