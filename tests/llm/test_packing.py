import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from linewright.llm.common import stored
from linewright.llm.packing import fullest, minimum_slack, pack, token_pieces
from linewright.llm.tokens import BatchTokenizer

SCHEMA = "doc_id long, text string, length long, sequence_id string"


def test_batch_ids_equal_single_ids():
    tokens = BatchTokenizer(bits=6, most=200)
    one = tokens.encoding.encode_ordinary
    rng = random.Random(3)
    parts = [" ", "\n", "a", "b", "é", " ", "'s", "1", "日", "!", " a", "\t", " ", "the", "ing" * 15]
    for _ in range(300):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(8)] + [None]
        ids, at = tokens.ids(pa.array(texts, pa.string()))
        assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == [one(t or "") for t in texts]


@pytest.mark.parametrize("seed", range(30))
def test_fullest_is_the_fullest(seed):
    rng = random.Random(seed)
    counts = {x: rng.randint(1, 2) for x in rng.sample(range(1, 30), 5)}
    capacity = rng.randint(5, 60)
    sums = {sum(x * c for x, c in zip(counts, cs)) for cs in itertools.product(*(range(n + 1) for n in counts.values()))}
    taken = fullest(counts, capacity)
    assert all(c <= counts[x] for x, c in taken.items())
    assert sum(x * c for x, c in taken.items()) == max(s for s in sums if s <= capacity)


def test_patterns_use_every_length_once():
    rng = random.Random(1)
    counts = {x: rng.randint(1, 400) for x in rng.sample(range(1, 2049), 300)}
    used = {}
    for p in minimum_slack(counts, 2048):
        assert sum(x * c for x, c in p.lengths) <= 2048
        for x, c in p.lengths:
            used[x] = used.get(x, 0) + p.times * c
    assert used == counts


def fewest(lengths, capacity):
    """The fewest bins, by trying every place for every length."""
    best = len(lengths)

    def place(k, room):
        nonlocal best
        if len(room) >= best:
            return
        if k == len(lengths):
            best = len(room)
            return
        for free in set(room):
            if free >= lengths[k]:
                at = room.index(free)
                place(k + 1, room[:at] + [free - lengths[k]] + room[at + 1 :])
        place(k + 1, room + [capacity - lengths[k]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_bins_against_the_fewest(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
    patterns = minimum_slack({x: lengths.count(x) for x in set(lengths)}, 20)
    bins = [sum(x * c for x, c in p.lengths) for p in patterns for _ in range(p.times)]
    best = fewest(lengths, 20)
    assert best <= len(bins) <= best + 1
    assert all(a + b > 20 for a, b in itertools.combinations(bins, 2))


def test_whole_packing(spark):
    rng = random.Random(2)
    texts = [None, "", "a", "a", "same words here"] + [" ".join(rng.choice(["the", "of", "é", "blue\n"]) for _ in range(rng.randint(0, 300))) for _ in range(150)] + ["word " * 5000]
    rows = [(k % 140 if k % 9 else None, t, 5, "x") for k, t in enumerate(texts)] * 2
    pieces = stored(token_pieces(spark.createDataFrame(rows, SCHEMA), capacity=256))
    got = pack(pieces, capacity=256, group_rows=7).collect()
    one = BatchTokenizer().encoding.encode_ordinary
    want = []
    for doc, text, _, _ in rows:
        ids = [*one(text or ""), 0]
        stop = len(ids) % 256 or min(len(ids), 256)
        cuts = [0, *range(stop, len(ids) + 1, 256)]
        want += [(doc, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) <= 256
    # what minimum bin slack guarantees: all of one bin would not fit into another, so bins are over half full on average
    used = sorted(sum(n for _, n in own) for own in by.values())
    assert used[0] + used[1] > 256 and len(by) < 2 * sum(w[3] for w in want) / 256 + 1


def test_empty(spark):
    assert pack(stored(token_pieces(spark.createDataFrame([], SCHEMA)))).count() == 0
