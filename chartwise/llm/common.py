"""Helpers shared by the operators: tables, saved intermediates, Arrow text access, code shipping."""

from __future__ import annotations

import ctypes
import hashlib
import os
import tempfile
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartwise.scratch import drop, folder, save  # noqa: F401  shared by the operators
from chartwise.session import configure

BATCH_ROWS = 500
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the folder may be any path Spark can read."""
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Prepare a session for the Python operators.

    Sends this package to the workers once per application (they need not
    have it installed), and bounds the rows of an Arrow batch: a row holds
    a whole text or a set of shingles, and a batch is in memory on both sides.
    """
    if int(spark.conf.get(_BATCH_CONF)) > BATCH_ROWS:
        spark.conf.set(_BATCH_CONF, BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="chartwise-code-"), "chartwise.zip")
    with zipfile.ZipFile(out, "w") as z:
        for place, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(place, n)
                    z.write(p, os.path.join("chartwise", os.path.relpath(p, root)))
    spark.sparkContext.addPyFile(out)
    _shipped.add(app)


def trim() -> None:
    """Give freed memory back to the system; workers stay alive between tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def boxed(docs: DataFrame, **more) -> DataFrame:
    """``docs`` as one struct column ``_row`` beside the named expressions, so that no column of its can clash."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("_row"), *[e.alias(name) for name, e in more.items()])


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and its n+1 offsets, without copying; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type)
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64 if wide else np.int32)[arr.offset: arr.offset + n + 1].astype(np.int64)
    data = arr.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0]: off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int):
    """Consecutive row ranges of about ``limit`` bytes (a longer row is a range of its own)."""
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        b = min(b, n)
        yield a, b
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the 64-bit splitmix generator (public domain constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        p[0] = 1
        have = np.multiply.accumulate(p)
        if n <= 1 << 21:
            _powers[name] = have
    return have[:n]


LONG_SPAN = 64


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray = BYTE) -> np.ndarray:
    """64-bit hash of every span of ``buf``: differences of one running polynomial sum, then mixed.

    Such sums modulo 2^64 collide for self-similar strings of 1,024 bytes
    and more: ``word_hashes`` names spans of any length.
    """
    n = len(buf)
    run = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values[buf] * _power("up", _BASE, n), out=run[1:])
    return mix((run[end] - run[start]) * _power("down", _BACK, n + 1)[start] + (end - start).astype(np.uint64))


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every span; those of over LONG_SPAN bytes by BLAKE2b."""
    out = span_hashes(buf, start, end)
    long = np.flatnonzero(end - start > LONG_SPAN)
    if len(long):
        view = memoryview(np.ascontiguousarray(buf))
        raw = b"".join(hashlib.blake2b(view[a:b], digest_size=8).digest() for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True))
        out[long] = np.frombuffer(raw, "<u8")
    return out


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without ASCII white space, never across rows): starts, ends, and their row numbers."""
    n = len(buf)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = ~_SPACE[buf]
    first = inside[:n].copy()
    first[1:] &= ~inside[: n - 1]
    last = inside[1:].copy()  # True where the next byte still is inside
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] |= inside[cut]
    last[cut - 1] = False
    start = np.flatnonzero(first)
    end = np.flatnonzero(inside[:n] & ~last) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def lower(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def nz(text="text"):
    """The text column with null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
