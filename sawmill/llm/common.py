"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sawmill.session import work_folder

#: Words of every contract: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one Arrow batch. Texts may be long, so batches are kept well below Spark's 10,000 rows.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20
MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Sets the session's Arrow batches: texts may be long, so bytes are bounded too (plans read this as they run)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only on a single machine that names none (tests, local runs)."""
    return work_folder(spark)


#: Spark's setting by which an execution removes its shuffle files when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scratch: list[list[str]] = []


def written(df: DataFrame, what: str) -> DataFrame:
    """Writes df as a table in the shared folder and rereads it: lineage ends there and any executor can be lost.
    The shuffles behind it are of no more use, so Spark may remove their files at once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sawmill/{what}-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    if _scratch:
        _scratch[-1].append(path)
    out = spark.read.schema(schema).parquet(path)
    out._written_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._written_at)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes, at its end, the tables written within it but those given to the function it yields: these are left to the scratch around it, if any."""
    own: list[str] = []
    outer = _scratch[-1] if _scratch else []
    _scratch.append(own)

    def keep(df: DataFrame) -> None:
        own.remove(df._written_at)
        outer.append(df._written_at)

    try:
        yield keep
    finally:
        _scratch.remove(own)
        for path in own:
            _delete(spark, path)


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def words(text: bytes | None) -> list[bytes]:
    """bytes.split() cuts at exactly the six ASCII white-space bytes, and bytes.lower() changes A-Z alone."""
    return text.lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A random value for each byte, the same for A-Z and a-z; none for white space.
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTES[65:91] = _BYTES[97:123]
_BYTES[_SPACE] = 0
#: Bytes of a text that are hashed at once.
_PIECE = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2 ** 64."""
    if len(_powers.known[0]) < n:
        base = 0x9E3779B97F4A7C15
        n = max(1 << 16, 1 << (n - 1).bit_length())
        _powers.known = tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)))) for b in (base, pow(base, -1, 1 << 64)))
    return tuple(x[:n] for x in _powers.known)


_powers.known = (np.empty(0, np.uint64),) * 2


def word_hashes(text: bytes | None) -> np.ndarray:
    """A 64-bit hash of each word of a text (see words), in order: sums of byte values times powers, by prefix sums."""
    if not text:
        return np.empty(0, np.uint64)
    if len(text) > _PIECE:  # cut at white space; a word is never cut
        out, at = [], 0
        while at < len(text):
            piece = text[at : at + _PIECE]
            if at + _PIECE < len(text):
                more = re.compile(rb"[\x20\x09-\x0D]").search(text, at + _PIECE)
                piece = text[at : len(text) if more is None else more.start()]
            out.append(_piece_hashes(piece))
            at += len(piece)
        return np.concatenate(out)
    return _piece_hashes(text)


def _piece_hashes(text: bytes) -> np.ndarray:
    b = np.frombuffer(text, dtype=np.uint8)
    edge = np.flatnonzero(np.diff(~_SPACE[b], prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        power, inverse = _powers(len(b))
        sums = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[b] * power[: len(b)], out=sums[1:])
        return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


#: Odd factors of the words of a shingle.
FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9FB21C651E98DF25]


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash for each run of width words (8 at most), in order; the whole sequence as one if it is shorter."""
    n = len(hashes)
    if n == 0:
        return hashes
    k, width = (1, n) if n < width else (n - width + 1, width)
    with np.errstate(over="ignore"):
        out = hashes[:k] * np.uint64(FACTORS[0])
        for j in range(1, width):
            out += hashes[j : j + k] * np.uint64(FACTORS[j])
        return mix(out + np.uint64(width))


@contextlib.contextmanager
def quiet():
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        yield


def same_text_key(*columns: str) -> list[Column]:
    """Two 64-bit hashes of the columns: rows that agree in all of them share it."""
    own = [F.col(c) for c in columns]
    return [F.xxhash64(*own).alias("k1"), F.xxhash64(F.lit(7), *own).alias("k2")]


def release() -> None:
    """Gives memory that Python has freed back to the system, where the C library can: workers live on between tasks."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(f):
    """A function of batches that gives freed memory back when its task ends."""

    @functools.wraps(f)
    def run(batches):
        yield from f(batches)
        release()

    return run
