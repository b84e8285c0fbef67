"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` turns the training documents into blocks of about a million words and stores them, once, in the shared
folder: each block is one row with the postings of all its words, sorted by term: where each stands, ascending. The index is
cut by documents, so that all lists of a document meet without a shuffle, and a block holds whole documents. ``search`` looks
the terms of a test set up in every block. For each window of consecutive item words it starts from the rarest term in the
block, and intersects the offset-adjusted lists of the other terms, rarer ones first: what is left are the exact
occurrences. Proximity matches are places around a rarest term where all terms of a window stand within a span of its length
plus ``slop`` words, in any order.

Test sets are read and broadcast in slices of at most ``slice_chars`` characters of text, one after the other, so that what
the driver holds and sends has a fixed bound (a single longer item is a slice of its own); what several slices find is
stored and merged by the number of the document's row in the index.

Words are lower-cased runs of ASCII letters and digits and of all characters beyond ASCII; terms are 64-bit hashes of them.
Null texts have no words. An item with fewer words than a window is one window; an item without words is none. Rows that
repeat an item_id are one item with the windows of all; a null item_id appears as the string ``null``. Documents that repeat
are answered each; an empty table gives no rows, an empty test set only zeros. Long documents are indexed whole; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, pick, slices, stored, table

INDEX_SCHEMA = "block string, doc_id array<long>, th array<long>, n_words array<long>, terms binary, ends binary, places binary"


def build_index(docs: DataFrame, block_words: int = 1 << 20) -> DataFrame:
    """One row for each block of documents: their ids, hashes of their texts and numbers of words; and the postings.

    ``terms`` are sorted hashes, ``ends`` says where each one's postings end, ``places`` are word positions in the block, with one
    free position after each document.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, count, held_words = TaskContext.get(), 0, 0
        held: list[tuple] = []  # ids, text hashes, numbers of words, words of some documents

        def block() -> pa.RecordBatch:
            nonlocal count
            ids, hashes = (pa.concat_arrays([h[k] for h in held]) for k in (0, 1))
            length, word = (np.concatenate([h[k] for h in held]) for k in (2, 3))
            place = np.arange(len(word), dtype=np.uint32) + np.repeat(np.arange(len(length), dtype=np.uint32), length)
            order = np.argsort(word, kind="stable")
            word = word[order]
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
            ends = np.append(first[1:], len(word)).astype(np.uint32) if len(word) else np.zeros(0, np.uint32)
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            arrays = [pa.array([f"{task.partitionId()}-{count}"]), one(ids), one(hashes), one(pa.array(length.astype(np.int64)))]
            arrays += [pa.array([x.tobytes()], pa.binary()) for x in (word[first], ends, place[order])]
            count += 1
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["block", "doc_id", "th", "n_words", "terms", "ends", "places"])

        for batch in slices(batches, "text", 4 << 20):
            found, length = hashed_words(batch.column("text"))
            held.append((batch.column("doc_id"), batch.column("th"), length, found))
            held_words += len(found) + 8 * len(length)
            if held_words >= block_words:
                yield block()
                held_words = 0
        if held:
            yield block()

    rows = pick(docs, doc_id="long", text="string").select("doc_id", F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(index, INDEX_SCHEMA)


def _among(places: np.ndarray, postings: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(postings, places), len(postings) - 1)
    return postings[at] == places


class TestWindows:
    """The windows of a slice of a test set, as hashes of their words."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        self.width, seen = width, {}
        self.items: list[list[str]] = []
        found, counts = hashed_words(pa.array([text for _, text in items], pa.string()))
        self.terms, number = np.unique(found, return_inverse=True)
        stop = np.cumsum(counts)
        for (item, _), a, b in zip(items, stop - counts, stop):
            for at in range(a, max(a + 1, b - width + 1)):
                key = number[at : min(at + width, b)].tobytes()
                if key:
                    k = seen.setdefault(key, len(self.items))
                    if k == len(self.items):
                        self.items.append([])
                    if item not in self.items[k]:
                        self.items[k].append(item)
        self.windows = [np.frombuffer(k, number.dtype) for k in seen]
        self.padded = np.full((len(self.windows), width), len(self.terms), np.int64)
        for k, w in enumerate(self.windows):
            self.padded[k, : len(w)] = w

    def search(self, terms: np.ndarray, ends: np.ndarray, places: np.ndarray, starts: np.ndarray, slop: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each window with a match in a block: its number, exact starts, and places of proximity matches.

        ``starts`` are the positions where the block's documents begin.
        """
        if not len(self.windows) or not len(terms):
            return
        at = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
        there = terms[at] == self.terms
        begin = np.append(np.where(there, np.where(at > 0, ends[at - 1], 0), 0), 0).astype(np.int64)
        held = np.append(np.where(there, ends[at].astype(np.int64) - begin[:-1], 0), np.iinfo(np.int64).max)  # the last stands for no term
        counts = held[self.padded]
        lists_of: dict[int, np.ndarray] = {}  # terms of the test set stand in many windows

        def postings(t: int) -> np.ndarray:
            if t not in lists_of:
                lists_of[t] = places[begin[t] : begin[t] + held[t]].astype(np.int64)
            return lists_of[t]

        for k in np.flatnonzero(counts.min(axis=1) > 0):
            window = self.windows[k]
            order = np.argsort(counts[k, : len(window)], kind="stable")  # the rarest term leads
            lists = [postings(int(t)) for t in window[order]]
            start = lists[0] - order[0]
            for at, more in zip(order[1:], lists[1:]):
                if not len(start):
                    break
                start = start[_among(start + at, more)]
            near = lists[0][:0]
            if slop is not None:
                near, reach = lists[0], len(window) + slop
                for more in lists[1:]:
                    if not len(near):
                        break
                    at = np.searchsorted(more, near - reach + 1)
                    near = near[(at < len(more)) & (more[np.minimum(at, len(more) - 1)] < near + reach)]
                near = self._within(near, lists, reach, starts)
            if len(start) or len(near):
                yield int(k), start, near

    @staticmethod
    def _within(near: np.ndarray, lists: list[np.ndarray], reach: int, starts: np.ndarray) -> np.ndarray:
        """Those anchors for which some span of ``reach`` words of their document holds every term of the window."""
        kept = []
        for anchor in near:
            row = np.searchsorted(starts, anchor, side="right")
            low = max(anchor - reach + 1, starts[row - 1])
            high = min(anchor + reach, starts[row] - 1 if row < len(starts) else anchor + reach)
            close = [p[np.searchsorted(p, low) : np.searchsorted(p, high)] for p in lists]
            begins = np.unique(np.concatenate(close))
            begins = begins[(begins <= anchor) & (begins > anchor - reach)]
            fits = np.ones(len(begins), bool)
            for p in close:
                at = np.searchsorted(p, begins)
                fits &= (p[np.minimum(at, len(p) - 1)] < begins + reach) & (at < len(p)) if len(p) else False
            if fits.any():
                kept.append(anchor)
        return np.array(kept, np.int64)


HIT_SCHEMA = "block string, row int, doc_id long, th long, n_words long, spans array<long>, items array<string>, near_items array<string>"


def _merged(starts: np.ndarray, stops: np.ndarray) -> list[int]:
    """Sorted disjoint spans, flat: start, stop, start, stop, ..."""
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    new = np.append(True, starts[1:] > stops[:-1])
    lasts = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
    return np.column_stack([starts[new], stops[lasts]]).ravel().tolist()


def search_slice(index: DataFrame, tests: TestWindows, slop: int | None) -> DataFrame:
    """A row for every document of the index: hit spans, items with exact and with proximity matches."""
    sent = index.sparkSession.sparkContext.broadcast(tests)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = sent.value
        for batch in batches:
            for k in range(batch.num_rows):
                raw = lambda c, kind: np.frombuffer(batch.column(c)[k].as_buffer(), kind)  # noqa: B023, E731
                docs, hashes, n_words = (batch.column(c)[k].values for c in ("doc_id", "th", "n_words"))
                n = len(docs)
                starts = np.append(0, np.cumsum(n_words.to_numpy() + 1)[:-1])
                spans: dict[int, list[tuple[np.ndarray, int]]] = {}
                exact: dict[int, set] = {}
                close: dict[int, set] = {}
                for w, start, near in tests.search(raw("terms", np.uint64), raw("ends", np.uint32), raw("places", np.uint32), starts, slop):
                    row, width = np.searchsorted(starts, start, side="right") - 1, len(tests.windows[w])
                    for r in np.unique(row).tolist():
                        spans.setdefault(r, []).append((start[row == r] - starts[r], width))
                        exact.setdefault(r, set()).update(tests.items[w])
                    for r in np.unique(np.searchsorted(starts, near, side="right") - 1).tolist():
                        close.setdefault(r, set()).update(tests.items[w])
                flat = [_merged(np.concatenate([s for s, _ in spans[r]]), np.concatenate([s + w for s, w in spans[r]])) if r in spans else [] for r in range(n)]
                block = batch.column("block")[k].as_py()
                names = [pa.array([sorted(d.get(r, ())) for r in range(n)], pa.list_(pa.string())) for d in (exact, close)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * n, pa.string()), pa.array(range(n), pa.int32()), docs, hashes, n_words, pa.array(flat, pa.list_(pa.int64())), *names],
                    names=["block", "row", "doc_id", "th", "n_words", "spans", "items", "near_items"],
                )

    return index.mapInArrow(look, HIT_SCHEMA)


def _test_slices(items: DataFrame, slice_chars: int) -> Iterator[list[tuple[str, str]]]:
    part, size = [], 0
    for row in pick(items, item_id="string", text="string").toLocalIterator():  # the test set, not the corpus
        part.append((row["item_id"] if row["item_id"] is not None else "null", row["text"] or ""))
        size += len(row["text"] or "")
        if size >= slice_chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def find_contamination(docs: DataFrame, items: DataFrame, width: int = 10, slop: int | None = 4, slice_chars: int = 8 << 20) -> DataFrame:
    """doc_id, th (xxhash64 of the text), n_words, spans of hit words (flat array of starts and stops), items (exact) and near_items (proximity)."""
    index, out, several = stored(build_index(docs)), None, False
    for part in _test_slices(items, slice_chars):
        if out is None:
            out = search_slice(index, TestWindows(part, width), slop)
            continue
        more = stored(search_slice(index, TestWindows(part, width), slop))  # one slice at a time is held and sent
        out, several = out.unionByName(more), True
    if out is None:
        return search_slice(index, TestWindows([], width), slop).select("doc_id", "th", "n_words", "spans", "items", "near_items")

    @F.pandas_udf("array<long>")
    def merge(spans: pd.Series) -> pd.Series:
        def one(flats):
            flat = np.concatenate([np.asarray(x, np.int64) for x in flats] or [np.zeros(0, np.int64)])
            return _merged(flat[::2], flat[1::2]) if len(flat) else []

        return spans.map(one)

    if several:  # a document's rows: one from each slice
        union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
        same = [F.first(c).alias(c) for c in ("doc_id", "th", "n_words")]
        out = out.groupBy("block", "row").agg(*same, F.collect_list("spans").alias("spans"), union("items").alias("items"), union("near_items").alias("near_items"))
        out = out.withColumn("spans", merge("spans"))
    return out.select("doc_id", "th", "n_words", "spans", "items", "near_items")


def contamination_report(hits: DataFrame) -> DataFrame:
    """Counts and digests of ``find_contamination``'s rows."""
    odd = F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    n_hit = F.aggregate(odd, F.lit(0).cast("long"), lambda a, x: a + x)
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near_items"),
    )


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination_report(find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination_report(find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
