"""Helpers that several corpus operators share: stage tables, Arrow batches, vectorised text hashing."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch handed to Python; keeps a batch of long texts small.
ARROW_ROWS = 1000
#: Bytes of text that are hashed at a time (a longer single text is hashed alone).
CHUNK_BYTES = 1 << 21


def session_of(df: DataFrame) -> SparkSession:
    """The frame's session, with small Arrow batches unless it asks for its own size."""
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:  # Spark's default
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a local one only where driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="strandline-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        folder = "file://" + local
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Paths of the stage tables that this process wrote and did not delete.
_WRITTEN: list[str] = []


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """The frame written to the shared folder and read again (cuts lineage, survives lost executors), and its path."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/strandline-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stage_mark() -> int:
    """A mark of the stage tables written so far; see ``forget_since``."""
    return len(_WRITTEN)


def forget_since(spark: SparkSession, mark: int, keep: str) -> None:
    """Delete the stage tables written since ``mark`` but the one at ``keep``, whose rows no longer need them."""
    for path in [p for p in _WRITTEN[mark:] if p != keep]:
        forget(spark, path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table that ``stored`` wrote, once nothing reads it any more."""
    if path in _WRITTEN:
        _WRITTEN.remove(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


# --- text as bytes ---------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            steps = np.full(size, self.base, np.uint64), np.full(size, self.inverse, np.uint64)
            for s in steps:
                s[0] = 1
            self.up, self.down = (np.cumprod(s, dtype=np.uint64) for s in steps)
        return self.up, self.down


_POW = {0: _Powers(0x9E3779B97F4A7C15), 1: _Powers(0xD1342543DE82EF95), 2: _Powers(0xA0761D6478BD642F)}


def prefix_sums(values: np.ndarray, lane: int) -> np.ndarray:
    """Prefix sums of a polynomial hash over ``values`` (length n + 1); see ``span_hash``."""
    up, _ = _POW[lane].upto(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:], dtype=np.uint64)
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int) -> np.ndarray:
    """Position-independent 64-bit hashes of the spans ``[start, end)``."""
    _, down = _POW[lane].upto(len(prefix))
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of several texts, as hashes.

    ``hashes`` holds all words in order; text i has ``hashes[first[i]:first[i + 1]]``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        if lower:
            data = _LOWER[data]
        word = ~_SPACE[data]
        n = len(data)
        begins, ends = word.copy(), word.copy()
        if n:
            cut = offsets[(offsets > 0) & (offsets < n)]
            begins[1:] &= ~word[:-1]
            begins[cut] = word[cut]
            ends[:-1] &= ~word[1:]
            ends[cut - 1] = word[cut - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.start, self.end = start, end
        self.hashes = span_hash(prefix_sums(_BYTE[data], 0), start, end, 0)
        self.first = np.searchsorted(start, offsets)


def text_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows and the end) for runs of rows of about CHUNK_BYTES; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def int64(values: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as the signed ones of the same bits."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker (code sent by value has no lasting module)."""
    import sys
    import types

    return sys.modules.setdefault("_strandline_worker_cache", types.ModuleType("cache")).__dict__


def bounded_rows(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """About ``rows`` of the ``total`` rows, chosen by a hash of ``key`` (the same ones on every run)."""
    from pyspark.sql import functions as F

    part = min(1.0, rows / max(total, 1))
    return df.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < F.lit(int(np.ceil(part * 1_000_000))))
