"""SimHash near-duplicates by a grid over segment bit counts.

A 64-bit fingerprint is embedded as the bit counts of its 16 segments. Fingerprints that differ in d bits lie at a
Manhattan distance of at most d there, so the grid finds every pair at distance 2 or less: each fingerprint is posted to
its own cell and to the cells one step away in one coordinate (33 at most), and two within distance 2 share a cell, for
between two points at distance 2 there is one a step away from both. Pairs that share a cell are verified by their
differing bits. Equal fingerprints are one before anything is joined, so copies cost nothing.

Near copies by shingle similarity (``one_of_near_copies``) lie far beyond 2 bits: 0.8 of five-word shingles is about 10
bits of 64, and at such a radius the grid tells nothing apart. There the least values of the shingles' hashes under
``BANDS * ROWS`` multiplications are cut into bands, texts that agree in a band are held against each other, fingerprints
further apart than ``radius`` go, and the shingle sets of the others are compared exactly. A pair at 0.8 shares no band
once in 4,600 cases (0.5904 ** 16); the radius of 28 lies about 5 deviations beyond the bits that such a pair differs in.
As in line dedup, texts meet the ends of their bands first, and then all that is still in other groups.

Null texts count as without words. Texts without words have fingerprint zero and are linked like any other. Null doc_ids
stay as rows, and take no part in the smallest doc_id. Repeated rows are kept. An empty table gives no rows.
Long texts are hashed whole, in blocks; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, pick, slices, stored, table
from .graph import components

SEGMENTS, SEGMENT_BITS = 16, 4
BANDS, ROWS = 16, 4
_TIMES = np.random.default_rng(17).integers(0, 2**63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(found: list[bytes], shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle of some words; fewer words than a shingle are one."""
    from xxhash import xxh64_intdigest

    grams = map(b" ".join, zip(*(found[k:] for k in range(shingle)))) if len(found) >= shingle else iter([b" ".join(found)])
    return np.fromiter(map(xxh64_intdigest, grams, repeat(seed)), np.uint64, max(1, len(found) - shingle + 1))


def byte_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone, and white space of ASCII alone


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes, as a signed 64-bit number."""
    n = len(hashes)
    hashes = hashes.byteswap().view(np.uint8).reshape(-1, 8)
    ones = sum(np.unpackbits(hashes[k : k + 8192], axis=1).sum(axis=0, dtype=np.int32).astype(np.int64) for k in range(0, n, 8192))
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Bits that are set in over half of the shingles' XXH64, as a signed 64-bit number."""
    found = byte_words(text)
    return majority(shingle_hashes(found, shingle, seed)) if found else 0


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, th (hash of the text) and fp (signed 64 bits) of each row."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [fingerprint(t or "", shingle, seed) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(found, pa.int64())], names=["doc_id", "th", "fp"])

    return pick(docs, doc_id="long", text="string").withColumn("th", F.xxhash64("text")).mapInArrow(prints, "doc_id long, th long, fp long")


def grid_cells(fp: Column) -> Column:
    """The cells of a fingerprint: its own, and each one step away that holds any fingerprint."""
    base = SEGMENT_BITS + 1
    counts = [F.bit_count(F.shiftright(fp, SEGMENT_BITS * k).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))).cast("long") for k in range(SEGMENTS)]
    own = sum((c * F.lit(base**k) for k, c in enumerate(counts)), F.lit(0).cast("long"))
    steps = [own]
    for k, c in enumerate(counts):
        steps += [F.when(c > 0, own - F.lit(base**k)), F.when(c < SEGMENT_BITS, own + F.lit(base**k))]
    return F.array_compact(F.array(*steps))


def close_pairs(fps: DataFrame) -> DataFrame:
    """Pairs (a < b) of distinct values of ``fp`` with 1 or 2 differing bits."""
    posts = fps.select("fp", F.explode(grid_cells(F.col("fp"))).alias("cell"))
    a, b = posts.alias("a"), posts.hint("merge").alias("b")  # Spark takes posts to be as small as the table they come from: a broadcast would fill the driver
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= 2
    return a.join(b, (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") < F.col("b.fp")) & near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()


def _labels(distinct: DataFrame, total: int) -> DataFrame:
    """fp, component (the smallest linked fp), component_id (the smallest doc_id of the component) and n of each row (fp, first, n)."""
    linked = components(close_pairs(distinct)).withColumnRenamed("node", "fp").join(distinct, "fp")
    least = linked.groupBy("component").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("n"))
    named = join_hot(linked.select("fp", "component"), least, "component", total).select("fp", "component", "least")
    return distinct.join(named, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), F.when(F.col("component").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"), "n")


def _marked(docs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """doc_id, th, fp, component and component_id of each row."""
    marked = stored(fingerprints(docs, shingle, seed))
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    total = marked.count()
    return join_hot(marked, _labels(distinct, total), "fp", total)  # copies of one text share a fingerprint


def group_near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable by links of 2 differing bits or fewer."""
    return _marked(docs, shingle, seed).select("doc_id", "fp", "component_id")


def _rows_named(docs: DataFrame, first: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``first`` (none, doc_id, th in a struct) names, each once, with whatever columns they have."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    own = docs.select(row.alias("_row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_keep"))
    once = F.row_number().over(Window.partitionBy("_row").orderBy("_row"))  # rows that repeat another stay once
    return own.join(first, "_row").withColumn("_once", once).where("_once = 1").select(*(F.col("_keep").getField(c).alias(c) for c in docs.columns))


def one_of_each_group(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the row with the smallest doc_id (null last), then hash of the text."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    return _rows_named(docs, _marked(docs, shingle, seed).groupBy("component").agg(F.min(order).alias("_row")).select("_row"))


def bands(hashes: np.ndarray, chunk: int = 2048) -> np.ndarray:
    """A key for each band: its number and the least of the hashes under each of its multiplications."""
    least = (hashes[:chunk] * _TIMES).min(axis=1)
    for k in range(chunk, len(hashes), chunk):
        np.minimum(least, (hashes[k : k + chunk] * _TIMES).min(axis=1), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = (key ^ row) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def shingle_similarity(x: str, y: str, shingle: int, seed: int = 42) -> float:
    """Shared shingles of all distinct ones."""
    a, b = (set(shingle_hashes(w, shingle, seed).tolist()) if (w := byte_words(t)) else set() for t in (x, y))
    return len(a & b) / len(a | b) if a or b else 1.0


def _banded(rows: DataFrame, shingle: int, seed: int) -> DataFrame:
    """doc_id, th, id (hash of the words), fp and bands of each row; texts without words have no bands."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in slices(batches, "text"):
            ids, fps, keys = [], [], []
            for t in batch.column("text").to_pylist():
                found = byte_words(t or "")
                hashes = shingle_hashes(found, shingle, seed)
                ids.append(xxh64_intdigest(b" ".join(found)))
                fps.append(majority(hashes) if found else 0)
                keys.append(bands(hashes) if found else np.zeros(0, np.int64))
            ids = np.array(ids, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(ids), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "th", "id", "fp", "bands"])

    return rows.mapInArrow(prints, "doc_id long, th long, id long, fp long, bands array<long>")


def _alike(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float, seed: int) -> DataFrame:
    """Those ``pairs`` (a, b) whose texts (id, text) share enough of their shingles."""

    @F.pandas_udf("boolean")
    def alike(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([shingle_similarity(x or "", y or "", shingle, seed) >= similarity for x, y in zip(xs, ys)], dtype=bool)

    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    return both.where(alike("x", "y")).select(*pairs.columns)


def near_copies(distinct: DataFrame, rows: DataFrame, shingle: int, similarity: float, radius: int, seed: int) -> DataFrame:
    """(node, component) of all texts (id, fp, bands, first) that have near copies."""

    def near(a: str, b: str) -> Column:
        return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius

    def texts(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        places = distinct.join(wanted, "id").select("id", "first.doc_id", "first.th")
        own = rows.select(F.col("doc_id").alias("_doc"), F.col("th").alias("_th"), "text")
        return places.join(own, F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("th").eqNullSafe(F.col("_th"))).groupBy("id").agg(F.min("text").alias("text"))

    posts = distinct.select("id", "fp", F.explode("bands").alias("key"))
    ends = posts.groupBy("key").agg(F.min(F.struct("id", "fp")).alias("low"), F.max(F.struct("id", "fp")).alias("high")).where("low.id != high.id")
    met = posts.join(ends.hint("merge"), "key").select("id", "fp", F.explode(F.array("low", "high")).alias("c")).where(F.col("id") != F.col("c.id")).where(near("fp", "c.fp"))
    stars = stored(met.select(F.least("id", "c.id").alias("a"), F.greatest("id", "c.id").alias("b")).distinct())
    groups = components(_alike(stars, texts(stars), shingle, similarity, seed)).withColumnRenamed("node", "id")
    grouped = distinct.join(groups, "id", "left").withColumn("group", F.coalesce("component", "id"))
    posts = grouped.select("id", "fp", "group", F.explode("bands").alias("key"))
    a, b = posts.alias("a"), posts.hint("merge").alias("b")
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.group") != F.col("b.group")) & near("a.fp", "b.fp")
    rest = a.join(b, on).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.group").alias("ga"), F.col("b.group").alias("gb")).distinct()
    rest = stored(rest.join(stars, ["a", "b"], "left_anti"))
    between = components(_alike(rest, texts(rest), shingle, similarity, seed).select("ga", "gb")).select(F.col("node").alias("group"), F.col("component").alias("joint"))
    joined = grouped.join(between, "group", "left").where("component IS NOT NULL OR joint IS NOT NULL")
    return joined.select(F.col("id").alias("node"), F.coalesce("joint", "group").alias("component"))


def one_of_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 28, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` without near copies: of the texts linked by shingle similarity the row with the smallest doc_id (null last), then hash of the text."""
    rows = pick(docs, doc_id="long", text="string").withColumn("th", F.xxhash64("text"))
    marked = stored(_banded(rows, shingle, seed))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    distinct = stored(marked.groupBy("id", "fp").agg(F.min(order).alias("first"), F.min("bands").alias("bands")))
    linked = near_copies(distinct, rows, shingle, similarity, radius, seed).withColumnRenamed("node", "id")
    first = distinct.join(linked, "id", "left").groupBy(F.coalesce("component", "id")).agg(F.min("first").alias("_row")).select("_row")
    return _rows_named(docs, first)


def op2_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    groups = group_near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
