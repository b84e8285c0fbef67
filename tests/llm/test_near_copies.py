import random

from linewright.llm.simhash import fingerprint, one_of_near_copies, shingle_similarity

from .test_simhash import SCHEMA, smallest_reachable


def slow_similarity(x, y):
    a, b = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for t in (x, y))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(12)
    pool = [f"w{k}" for k in range(400)]
    texts = ["", " ", "one two", "One  two", "one three"]
    for _ in range(25):
        own = rng.choices(pool, k=rng.randint(60, 300))
        texts.append(" ".join(own))
        for n in (1, 2, 3, 6):
            other = list(own)
            for k in rng.sample(range(len(own)), n):
                other[k] = "changed"
            texts.append(" ".join(other))
    rows = [(1000 - k, t, "x", 1) for k, t in enumerate(texts)] + [(2000, None, "x", 1), (None, texts[7], "x", 1), (None, "no other row says this", "x", 1)]
    by = {d: t or "" for d, t, _, _ in rows if d is not None}
    linked = {(a, b) for a in by for b in by if slow_similarity(by[a], by[b]) >= 0.8}
    far = [1 for a, b in linked if a < b and bin((fingerprint(by[a]) ^ fingerprint(by[b])) % (1 << 64)).count("1") > 2]
    assert len(far) > 20  # the radius of op2 holds few of them
    want = set(smallest_reachable(list(by), lambda a, b: (a, b) in linked).values())
    got = [r["doc_id"] for r in one_of_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(d for d in got if d is not None) == sorted(want) and got.count(None) == 1


def test_similarity():
    assert shingle_similarity("a b c d e f", "A B c d e g", 5) == 1 / 3 and shingle_similarity("", " ", 5) == 1.0 and shingle_similarity("a", "b", 5) == 0.0


def test_empty(spark):
    assert one_of_near_copies(spark.createDataFrame([], SCHEMA)).count() == 0
