"""What the corpus operators share: tables, shared storage, words and batches."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: ASCII bytes that are neither letters nor digits become spaces, A-Z become a-z; bytes of other characters stay.
WORD_BYTES = bytes(c if c >= 128 or chr(c).isalnum() and not chr(c).isupper() else c + 32 if chr(c).isupper() else 32 for c in range(256))

_WORD_TABLE = np.frombuffer(WORD_BYTES, np.uint8)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **types: str) -> DataFrame:
    """The named columns alone, cast; columns that clash with an operator's own go."""
    return df.select(*(F.col(name).cast(kind).alias(name) for name, kind in types.items()))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: str) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of all other characters beyond ASCII, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, nulls as empty, and where each text begins (one more for the end)."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, at - at[0]


_CHUNK = 1 << 20  # bytes of text that are hashed at once
_BASE = 0x9E3779B97F4A7C15


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** k and its inverse, modulo 2 ** 64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        with np.errstate(over="ignore"):
            out.append(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * _CHUNK, base, np.uint64), dtype=np.uint64)]))
    return tuple(out)


def hashed_spans(norm: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes from each ``start`` to its ``stop``: spans in order that do not overlap."""
    up, down = _powers()
    out = np.empty(len(start), np.uint64)
    k = 0
    while k < len(start):
        end = max(k + 1, int(np.searchsorted(stop, start[k] + _CHUNK, side="right")))
        low, high = int(start[k]), int(stop[end - 1])
        if high - low > 2 * _CHUNK:  # a single endless word
            from xxhash import xxh64_intdigest

            out[k] = xxh64_intdigest(norm[low:high].tobytes())
        else:
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum((norm[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=sums[1:])
            out[k:end] = (sums[stop[k:end] - low] - sums[start[k:end] - low]) * down[start[k:end] - low]
        k = end
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (as ``words`` gives them) of a string column, in order, and how many each text has.

    A word's hash is a polynomial of its bytes, taken from running sums over all texts at once, and then mixed.
    """
    flat, at = text_bytes(column)
    norm = _WORD_TABLE[flat]
    inside = norm != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = at[:-1][(at[:-1] < at[1:])]
    begins[first] = inside[first]  # words do not go on from one text to the next
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = at[1:][(at[:-1] < at[1:])] - 1
    ends[last] = inside[last]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    counts = np.diff(np.searchsorted(start, at))
    return hashed_spans(norm, start, stop), counts


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; a local one only where it names none and all runs in one process."""
    for conf in (lambda: spark.conf.get("spark.checkpoint.dir", None), lambda: spark.sparkContext.getConf().get("spark.checkpoint.dir")):
        if found := conf():
            return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='linewright-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def forget(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    try:
        forget(spark, path)
    except Exception:  # the session has ended: nothing is left to ask
        pass


@contextmanager
def _small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Within it, Python workers get at most so many rows at once: 10,000 whole documents are held several times over on their way."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, keep: bool = True, batch: int = 1000) -> DataFrame:
    """``df`` written once to the shared folder and read again: its lineage ends there and lost executors cost no recomputation.

    The table goes when the driver's process ends, or by ``drop_stored``. Python workers get at most ``batch`` rows at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/linewright-{uuid.uuid4().hex}"
    with _small_batches(spark, batch):
        df.write.option("compression", "zstd").parquet(path)
    if keep:
        atexit.register(_at_exit, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def keep_until_exit(df: DataFrame) -> None:
    atexit.register(_at_exit, df.sparkSession, df._stored_at)


_ONE_TASK = 150_000


def join_hot(rows: DataFrame, dims: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """Join (inner or left_semi) of ``rows`` with ``dims``: one row for each key, whose ``n`` (dropped) says how many of about ``total`` rows have it.

    Keys with over a thousandth of the rows are joined by a broadcast: as ``n`` adds up to at most 2 * ``total``, they are
    2,000 at most, whatever the data, so ``dims`` should hold numbers only. All other keys are shuffled.
    """
    if total < _ONE_TASK:  # whatever key they share, so few rows fit into any task
        return rows.join(dims.drop("n"), key, how)
    often = F.col("n") > F.lit(total // 1000)
    heavy = F.broadcast(dims.where(often).drop("n"))
    light = rows.join(heavy.select(key), key, "left_anti").join(dims.where(~often).drop("n"), key, how)
    return light.unionByName(rows.join(heavy, key, how))


def drop_stored(df: DataFrame) -> None:
    if path := getattr(df, "_stored_at", None):
        forget(df.sparkSession, path)


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, the files that a job shuffled go when the job ends, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that a text column has few bytes in each; a single longer text stays whole."""
    for batch in batches:
        col = batch.column(column)
        rows = max(1, int(batch.num_rows * most_bytes / max(1, col.nbytes))) if batch.num_rows else 1
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
