import hashlib
import random

import pyarrow as pa
import pytest

from linewright.llm import common
from linewright.llm.common import hashed_words, stored, words
from linewright.llm.decontaminate import build_index, contamination_report, find_contamination

DOCS, ITEMS = "doc_id long, text string, block string, items string", "item_id long, text string, term int"


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[object, str | None]], width: int = 10) -> list[tuple]:
    """The same report for a few documents, by comparing every window with every place."""
    tests = [("null" if i is None else str(i), words(t or "")) for i, t in items]
    out = []
    for doc, text in docs:
        found = words(text or "")
        hit, names = set(), set()
        for name, own in tests:
            for at in range(max(1, len(own) - width + 1)):
                window = own[at : at + width]
                for k in range(len(found) - len(window) + 1) if window else ():
                    if found[k : k + len(window)] == window:
                        hit.update(range(k, k + len(window)))
                        names.add(name)
        joined = ",".join(sorted(names))
        out.append((doc, len(found), len(hit), len(names), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)))
    return out


def test_hashed_words_are_the_words(monkeypatch):
    monkeypatch.setattr(common, "_CHUNK", 64)
    common._powers.cache_clear()
    rng, seen = random.Random(4), {}
    for _ in range(60):
        texts = ["".join(rng.choice(["a", "B", "é", "日", " ", "  ", "\n", "-", "7", "long" * 9]) for _ in range(rng.randint(0, 40))) for _ in range(9)] + [None, "", "x" * 500]
        found, counts = hashed_words(pa.array(texts, pa.string()))
        want = [words(t or "") for t in texts]
        assert counts.tolist() == list(map(len, want))
        for word, h in zip((w for ws in want for w in ws), found.tolist()):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen) > 300
    common._powers.cache_clear()


def test_index_holds_every_word(spark):
    docs = [(1, "The cat the", "", ""), (None, None, "", ""), (2, "dog The", "", "")]
    index = stored(build_index(spark.createDataFrame(docs, DOCS).coalesce(1)))
    (row,) = index.collect()
    assert row["doc_id"] == [1, None, 2] and row["n_words"] == [3, 0, 2] and len(row["terms"]) == 3 * 8
    places = [int.from_bytes(row["places"][k : k + 4], "little") for k in range(0, len(row["places"]), 4)]
    assert sorted(places) == [0, 1, 2, 5, 6]


@pytest.mark.parametrize("slice_chars", [8 << 20, 60])
def test_against_brute_force(spark, slice_chars):
    rng = random.Random(7)
    pool = ["The", "of", "é", "x1", "日本", "a", "AN", "b-c", "q!"]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(k, text(rng.randint(0, 14)), 1) for k in range(12)] + [(3, text(11), 1), (None, "solo thing", 1), (50, None, 1), (51, "", 1)]
    docs = [(k, text(rng.randint(0, 200)) + " " + (items[k % 12][1] or "") + " tail", "z", "z") for k in range(40)] + [(None, "a solo thing", "", ""), (5, None, "", ""), (6, "", "", "")]
    docs += docs[:2] + [(99, text(30000), "", "")]
    got = contamination_report(find_contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), width=4, slice_chars=slice_chars)).collect()
    want = brute_force([(d[0], d[1]) for d in docs], [(i[0], i[1]) for i in items], width=4)
    assert sorted(map(repr, (tuple(r)[:6] for r in got))) == sorted(map(repr, want))


def test_proximity(spark):
    docs = [(1, "red fish swims near blue boat", "", ""), (2, "red one two three four five six seven eight nine blue fish swims", "", ""), (3, "blue swims fish red", "", "")]
    got = find_contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, "red fish swims blue", 0)], ITEMS), width=4, slop=2)
    assert {r["doc_id"]: (len(r["items"]), len(r["near_items"])) for r in got.collect()} == {1: (0, 1), 2: (0, 0), 3: (0, 1)}


def test_empty(spark):
    none, one = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b", "", "")], DOCS)
    assert contamination_report(find_contamination(none, spark.createDataFrame([(1, "a", 0)], ITEMS))).count() == 0
    assert [r["n_hit"] for r in contamination_report(find_contamination(one, spark.createDataFrame([], ITEMS))).collect()] == [0]
