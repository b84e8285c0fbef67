"""Best-fit packing by minimum bin slack.

Documents become pieces of at most ``capacity`` tokens. Only the histogram of piece lengths reaches the driver: at most
``capacity`` numbers, whatever the corpus. There, bin after bin takes the longest length left and the fullest feasible
company for it (so what one bin holds never fits into what another leaves free), found by subset-sum dynamic programming over the available lengths with big-integer bitsets; that
combination is applied as often as its lengths last, so the number of different combinations is bounded by
sum(1 + capacity / length) over the lengths, not by the corpus. A piece finds its place from its rank among the pieces of
its length, which is counted in salted groups, so that no length has to fit into one task.

Null texts count as empty (one closing token). Repeated rows are packed each. An empty table gives no rows. A null doc_id
stays null. Long texts are tokenised whole; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, slices, stored, table
from .tokens import BatchTokenizer

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(df: DataFrame, capacity: int = 2048, end_id: int = 0, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of each document's ids and closing ``end_id``: the first may be short, all others are full."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = BatchTokenizer(path), np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, "text", 8 << 20):
            rows = []
            flat, at = tokens.ids(batch.column("text"))
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                ids = flat[at[k] : at[k + 1]].astype("<u4").tobytes() + end
                n = len(ids) // 4
                start, piece = 0, 0
                stop = n % capacity or min(n, capacity)
                while start < n:
                    part = ids[4 * start : 4 * stop]
                    rows.append((doc, piece, start, stop - start, zlib.crc32(part), part if with_ids else None))
                    start, stop, piece = stop, stop + capacity, piece + 1
            columns = list(zip(*rows)) or [()] * 6
            arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:5])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(columns[5], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return pick(df, doc_id="long", text="string").mapInArrow(cut, PIECE_SCHEMA + (", ids binary" if with_ids else ""))


@dataclass(frozen=True)
class Pattern:
    """``times`` bins with the same lengths: (length, copies), longest first."""

    times: int
    lengths: tuple[tuple[int, int], ...]


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Copies of each length whose sum is the largest possible up to ``capacity``; of equals, that with the longest lengths."""
    usable = sorted(x for x, n in counts.items() if n and x <= capacity)
    full = (1 << (capacity + 1)) - 1
    reach = [1]
    for x in usable:
        bits = new = reach[-1]
        for _ in range(min(counts[x], capacity // x)):
            new = (new << x) & full
            if new | bits == bits:
                break
            bits |= new
        reach.append(bits)
        if x == usable[-1]:
            break
    rest = reach[-1].bit_length() - 1
    taken: dict[int, int] = {}
    for k in range(len(usable) - 1, -1, -1):
        x = usable[k]
        for copies in range(min(counts[x], rest // x), -1, -1):
            if reach[k] >> (rest - copies * x) & 1:
                if copies:
                    taken[x] = copies
                    rest -= copies * x
                break
    return taken


def minimum_slack(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Bins for all lengths: each takes the longest length left and the fullest combination beside it."""
    left = {x: n for x, n in histogram.items() if n}
    out = []
    while left:
        longest = max(left)
        less = {x: n - (x == longest) for x, n in left.items()}
        taken = fullest(less, capacity - longest)
        taken[longest] = taken.get(longest, 0) + 1
        times = min(left[x] // c for x, c in taken.items())
        out.append(Pattern(times, tuple(sorted(taken.items(), reverse=True))))
        for x, c in taken.items():
            left[x] -= times * c
            if not left[x]:
                del left[x]
    return out


def slots(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Runs of places for each length: rank_from within the length, first bin, copies a bin, offset of the first copy."""
    rows, bins, used = [], 0, {}
    for p in patterns:
        offset = 0
        for x, c in p.lengths:
            rows.append((x, used.get(x, 0), bins, c, offset))
            used[x] = used.get(x, 0) + p.times * c
            offset += x * c
        bins += p.times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "bin", "copies", "offset"), cols))


def pack(pieces: DataFrame, capacity: int = 2048, group_rows: int = 50_000) -> DataFrame:
    """``pieces`` (read several times, so stored before) with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    at = slots(minimum_slack(counts, capacity))
    salts = max(1, -(-max(counts.values(), default=1) // group_rows))
    order = ["doc_id", "piece", "start", "ids_crc32"]
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    group = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)  # salts rows for each length
    before = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(group), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order))
    ranked = salted.withColumn("_own", own).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_own") - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        span = int(at["rank"].max(initial=0)) + 1
        keys = at["length"] * span + at["rank"]
        for length, rank in lengths:
            length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
            k = np.searchsorted(keys, length * span + np.minimum(rank, span - 1), side="right") - 1
            turn, copy = np.divmod(rank - at["rank"][k], at["copies"][k])
            yield pd.DataFrame({"sequence_id": at["bin"][k] + turn, "offset": at["offset"][k] + copy * length})

    placed = ranked.withColumn("_at", place("length", "_rank"))
    return placed.select(*pieces.columns, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(stored(token_pieces(table(spark, sf_dir, "documents"))))
