import random

import numpy as np
import xxhash

from linewright.llm.common import stored
from linewright.llm.graph import components
from linewright.llm.simhash import close_pairs, fingerprint, group_near_duplicates

SCHEMA = "doc_id long, text string, fp string, cell int"


def slow_fingerprint(text):
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(nodes, linked):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if linked(a, b) and least[a] < least[b]:
                    least[b], changed = least[a], True
    return least


def test_fingerprints():
    for text in ["", " \n", "One", "one TWO", "a b c", "É é x\u0085y  b\tc\x0bd", "a b c d e f g h " * 3000]:
        assert fingerprint(text) % (1 << 64) == slow_fingerprint(text)


def test_close_pairs_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63 - 1, 40)
    fps = {int(x) for x in base} | {0, -1, 1, 3, 7}
    for x in base:
        for _ in range(4):
            bits = rng.choice(64, rng.integers(1, 4), replace=False)
            fps.add(int(np.int64(int(x) ^ int(np.bitwise_xor.reduce(np.left_shift(np.int64(1), bits))))))
    got = {tuple(r) for r in close_pairs(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()}
    assert got == {(a, b) for a in fps for b in fps if a < b and bin((a ^ b) % (1 << 64)).count("1") <= 2}


def test_posts_of_the_grid_are_not_broadcast(spark):
    """33 posts a fingerprint, which Spark's estimate leaves out, stay out of the driver however few they seem."""
    few = stored(spark.range(1000).selectExpr("xxhash64(id) AS fp"))
    assert "BroadcastHashJoin" not in close_pairs(few)._jdf.queryExecution().executedPlan().toString()


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(500, k) for k in range(501, 540)] + [(7, 7)]
    nodes = sorted({x for a, b in edges if a != b for x in (a, b)})
    pairs = set(edges) | {(b, a) for a, b in edges}
    want = smallest_reachable(nodes, lambda a, b: (a, b) in pairs)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(nodes) and {r["node"]: r["component"] for r in got} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(30):
        own = rng.choices(words, k=200)
        texts.append(" ".join(own))
        for _ in range(3):
            own = list(own)
            own[rng.randrange(200)] = "changed"
            texts.append(" ".join(own))
    rows = [(1000 - k, t, "x", 1) for k, t in enumerate(texts + texts[:5] + ["", None, "  "])] + [(None, texts[0], "x", 1), (1000, texts[0], "x", 1)]
    got = group_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    prints = {}
    for d, t, _, _ in rows:
        if d is not None:
            prints[d] = slow_fingerprint(t or "")
    want = smallest_reachable(list(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    assert len(got) == len(rows)
    assert all(r["component_id"] == want[r["doc_id"] if r["doc_id"] is not None else 1000] for r in got)
    assert len(set(want.values())) < len(want) - 10


def test_empty(spark):
    assert group_near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
