"""All crops and line policies of an item at once: which lines each candidate shows, and its statistics.

Lines go in as one array for each item and candidates come out as one; texts are not among them. What crops and policies
multiply are numbers in columns over many items, so that nothing of theirs is exchanged or sorted between tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHOLE, POLICY, MERGED = range(3)
_LINES_AT_ONCE = 20_000  # about 30 MB of numbers


class _Groups:
    """Rows of lines in groups: ``line`` by ``group`` (ascending), in the order in which a group shows its lines."""

    def __init__(self, line: np.ndarray, group: np.ndarray):
        order = np.argsort(group, kind="stable")
        self.line, group = line[order], group[order]
        self.start = np.flatnonzero(np.diff(group, prepend=-1))
        self.id = group[self.start]
        self.size = np.diff(self.start, append=len(group))
        self.row = np.repeat(np.arange(len(self.id)), self.size)

    def sums(self, values: np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        return np.bincount(self.row[at], weights=values, minlength=len(self.id))


def _quantile(values: np.ndarray, start: np.ndarray, size: np.ndarray, share: float) -> np.ndarray:
    """Of sorted values in groups that are not empty, as Spark's percentile gives it."""
    place = share * (size - 1)
    low, high = np.floor(place).astype(np.int64), np.ceil(place).astype(np.int64)
    a, b = values[start + low], values[start + high]
    with np.errstate(invalid="ignore"):
        return np.where((low == high) | (a == b), a, (high - place) * a + (place - low) * b)


def _described(g: _Groups, of: dict[str, np.ndarray], sums: list[str]) -> dict:
    """Places, statistics and sums of each group, by name; places as values and counts."""
    out, n = {}, len(g.id)
    out["num_lines"] = g.sums(of["text"][g.line] >= 0).astype(np.int64)
    score = of["score"][g.line]
    valid = np.flatnonzero(of["scored"][g.line])
    some = np.bincount(g.row[valid], minlength=n)
    total = g.sums(score[valid], valid)
    out["avg_line_score"] = np.divide(total, some, out=np.zeros(n), where=some > 0)
    ranked = score[valid][np.lexsort((score[valid], g.row[valid]))]
    begin, held = np.cumsum(some) - some, some > 0
    out["median_line_score"] = np.zeros(n)
    out["median_line_score"][held] = _quantile(ranked, begin[held], some[held], 0.5)
    area = of["area"][g.line]
    there = np.flatnonzero((area > 0) | np.isnan(area))
    some = np.bincount(g.row[there], minlength=n)
    out["avg_area_ratio"] = np.divide(g.sums(area[there], there), some, out=np.zeros(n), where=some > 0)
    text = of["text"][g.line]
    key = np.where(text >= 0, g.row * (of["text"].max(initial=0) + 1) + text, -1)
    shown = np.sort(np.unique(key, return_index=True)[1])
    shown = shown[text[shown] >= 0]  # the first line of each text
    out["places"] = (of["place"][g.line[shown]], np.bincount(g.row[shown], minlength=n))
    for name in sums:
        out[name] = g.sums(of[name][g.line[shown]], shown).astype(np.int64)
    return out


def _policy_groups(g: _Groups, of: dict[str, np.ndarray], policies: tuple[str, ...]) -> _Groups:
    """The lines of each group that each policy keeps; a group's number is that of the old one times the policies."""
    area, score = of["area0"][g.line], of["score0"][g.line]
    down = np.where(np.isnan(area), -np.inf, -area)
    by_area = np.lexsort((down, g.row))  # stable: reading order among equals
    rank = np.empty(len(by_area), np.int64)
    rank[by_area] = np.arange(len(by_area)) - g.start[g.row]
    ascending = area[by_area][2 * g.start[g.row] + g.size[g.row] - 1 - np.arange(len(by_area))]  # each group the other way round
    largest = area[by_area[g.start]] if len(g.id) else area
    several = (g.size >= 2)[g.row]
    any_area = several & ((largest > 0) | np.isnan(largest))[g.row]
    least = lambda share: ~(area < _quantile(ascending, g.start, g.size, share)[g.row])
    at_least = lambda x: ~(score < x)
    held = {
        "all_clean": np.ones(len(area), bool), "score_ge_07": at_least(0.70), "score_ge_085": at_least(0.85), "with_accent": of["accented"][g.line] > 0, "long_lines": of["long"][g.line] > 0,
        "top5_area": several & (rank < 5), "area_ge_q50": any_area & least(0.5), "area_ge_q65": any_area & least(0.65),
    }
    line, group = [], []
    for k, p in enumerate(policies):
        rows = by_area[held[p][by_area]] if p == "top5_area" else np.flatnonzero(held[p])
        line.append(g.line[rows])
        group.append(g.id[g.row[rows]] * len(policies) + k)
    return _Groups(np.concatenate(line), np.concatenate(group))


def _of_items(of: dict[str, np.ndarray], doc: np.ndarray, n_docs: int, crops: list, policies: tuple[str, ...], merges: list, sums: list[str]) -> tuple[np.ndarray, pa.StructArray]:
    """How many candidates each item has, and all of them, by item."""
    last = np.full(n_docs, -np.inf)
    np.maximum.at(last, doc, np.where(np.isnan(of["line_idx"]), -np.inf, of["line_idx"]))
    at = (of["line_idx"] + 0.5) / (last[doc] + 1)
    seen = [np.flatnonzero((top <= at) & (at <= bottom)) for _, top, bottom, *_ in crops]
    n = len(crops)
    whole = _Groups(np.concatenate(seen), np.concatenate([doc[rows] * n + k for k, rows in enumerate(seen)]))
    parts = []

    def add(kind: int, found: dict, item: np.ndarray, variant: np.ndarray, policy: np.ndarray) -> None:
        values, counts = found.pop("places")
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        columns = {"kind": np.full(len(item), kind, np.int32), "variant": variant.astype(np.int32), "policy": policy.astype(np.int32), "places": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))} | found
        parts.append((item, pa.table({k: pa.array(v) if isinstance(v, np.ndarray) else v for k, v in columns.items()})))

    found, every = _described(whole, of, sums), np.arange(n_docs * n)
    values, counts = found.pop("places")
    filled = {k: np.zeros(len(every), v.dtype) for k, v in found.items()} | {"places": (values, np.zeros(len(every), np.int64))}
    for k, v in found.items():
        filled[k][whole.id] = v
    filled["places"][1][whole.id] = counts
    add(WHOLE, filled, every // n, every % n, np.zeros_like(every))
    if policies:
        kept = _policy_groups(whole, of, policies)
        found = _described(kept, of, sums)
        add(POLICY, found, kept.id // (n * len(policies)), kept.id // len(policies) % n, kept.id % len(policies))
    if merges:
        sure, number = of["score0"] >= 0.85, {c[0]: k for k, c in enumerate(crops)}
        rows = [(m, seen[number[v]][sure[seen[number[v]]]]) for m, pair in enumerate(merges) for v in pair if v in number]
        merged = _Groups(np.concatenate([r for _, r in rows]), np.concatenate([doc[r] * len(merges) + m for m, r in rows]))
        add(MERGED, _described(merged, of, sums), merged.id // len(merges), merged.id % len(merges), np.zeros_like(merged.id))
    item, table = np.concatenate([i for i, _ in parts]), pa.concat_tables([t for _, t in parts])
    if policies:  # a policy that keeps no text gives no candidate
        keep = (table["kind"].to_numpy() != POLICY) | (pc.list_value_length(table["places"]).to_numpy() > 0)
        item, table = item[keep], table.filter(pa.array(keep))
    table = _named(table, [c[0] for c in crops], policies, ["+".join(m) for m in merges])
    table = table.take(pa.array(np.argsort(item, kind="stable"))).combine_chunks()
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns]
    return np.bincount(item, minlength=n_docs), pa.StructArray.from_arrays(columns, table.column_names)


def _named(table: pa.Table, crops: list[str], policies: tuple[str, ...], merges: list[str]) -> pa.Table:
    """With candidate_name and cand_ord, and what the choice without a model looks at if there are sums."""
    kind, variant, policy = (table[k].to_numpy() for k in ("kind", "variant", "policy"))
    names = [*(f"variant::{c}" for c in crops), *(f"line::{c}::{p}" for c in crops for p in policies), *(f"merge::{m}::score_ge_085" for m in merges)]
    at = np.select([kind == WHOLE, kind == POLICY], [variant, len(crops) + variant * len(policies) + policy], len(crops) * (1 + len(policies)) + variant)
    added = {"candidate_name": pa.array(names, pa.string()).take(pa.array(at)), "cand_ord": pa.array(np.select([kind == WHOLE, kind == POLICY], [variant * 100, variant * 100 + policy + 1], 10_000).astype(np.int32))}
    if "of_n" in table.column_names:
        shown = pc.list_value_length(table["places"]).to_numpy()
        n = np.where(shown > 0, table["of_n"].to_numpy() + shown - 1, 0)
        words = table["of_words"].to_numpy()
        junk = np.where(n == 0, 1.0, 1.0 - (n - table["of_bad"].to_numpy()) / np.maximum(n, 1))
        score = 4.0 * table["avg_line_score"].to_numpy() + np.minimum(words, 40) / 10.0 - 3.0 * junk - np.where(kind == MERGED, 2.0, 0.0)
        added |= {"text_len": pa.array(n.astype(np.int32)), "junk": pa.array(junk), "rank_score": pa.array(score)}
    for k, v in added.items():
        table = table.append_column(k, v)
    return table


def candidate_arrays(lists: pa.ListArray, crops: list, policies: tuple[str, ...], merges: list, sums: list[str]) -> Iterator[pa.ListArray]:
    """``lists``: for each item the lines in reading order, as structs with line_idx, low (the text, small), score, area, accented, long and
    ``sums``. Gives for each the candidates: kind, variant and policy by number, places, statistics and sums over the places."""
    counts = pc.list_value_length(lists).fill_null(0).to_numpy().astype(np.int64)
    ends = np.cumsum(counts)
    flat = lists.flatten()
    k = 0
    while k < len(counts):
        base = ends[k - 1] if k else 0
        stop = max(k + 1, int(np.searchsorted(ends, base + _LINES_AT_ONCE, side="right")))
        rows = flat.slice(base, ends[stop - 1] - base)
        field = lambda name: rows.field(rows.type.get_field_index(name))  # noqa: B023, E731
        number = lambda name, default: pc.fill_null(field(name).cast(pa.float64()), default).to_numpy(zero_copy_only=False)
        low = field("low")
        text = low.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        text[pc.equal(low, "").to_numpy(zero_copy_only=False)] = -1
        doc = np.repeat(np.arange(stop - k), counts[k:stop])
        of = {"line_idx": number("line_idx", np.nan), "text": text, "score": number("score", 0.0), "scored": field("score").is_valid().to_numpy(zero_copy_only=False), "area": number("area", 0.0)}
        of |= {"score0": of["score"], "area0": of["area"], "place": np.arange(len(doc)) - np.repeat(ends[k:stop] - counts[k:stop] - base, counts[k:stop])}
        of |= {name: number(name, 0.0) for name in ("accented", "long", *sums)}
        n, made = _of_items(of, doc, stop - k, crops, policies, merges, sums)
        yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), made)
        k = stop
