import math
import random

import numpy as np
from pyspark.sql import functions as F

from linewright.llm.ann import neighbours, permutations

SCHEMA = "vec_id long, embedding array<float>, label int, score string, block int"


def brute(rows, k, dim):
    ok = [(i, np.array(v, float)) for i, v, *_ in rows if i is not None and v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in sorted(ok, key=lambda r: (r[0], r[1].tolist())):
        if i % 10 == 0 and i not in out:
            out[i] = sorted((math.sqrt(((w - v) ** 2).sum()), j) for j, w in ok if j != i)[:k]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_exact_when_all_are_measured(spark):
    rng = random.Random(1)
    vec = lambda: [float(np.float32(rng.gauss(0, 1))) for _ in range(6)]
    rows = [(k, vec(), 0, "", 0) for k in range(300)]
    rows += [(400 + k, rows[0][1], 0, "", 0) for k in range(50)]  # a common vector: ties
    rows += [(10, rows[7][1], 0, "", 0), rows[20], (None, vec(), 0, "", 0), (2000, None, 0, "", 0), (2010, [0.0] * 6, 0, "", 0), (2020, [None, *vec()[1:]], 0, "", 0), (2030, [float("nan"), *vec()[1:]], 0, "", 0), (2040, [float("inf"), *vec()[1:]], 0, "", 0), (2050, [1.0], 0, "", 0), (2060, [], 0, "", 0)]
    got = {}
    for r in neighbours(frame(spark, rows), F.col("vec_id") % 10 == 0, k=5, share=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    want = brute(rows, 5, 6)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert np.allclose([d for d, _ in got[q]], [d for d, _ in want[q]], rtol=1e-14, atol=0)


def test_recall(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 32)) + 2 * rng.normal(size=(8, 32))[rng.integers(0, 8, 3000)]
    rows = [(k, v, 0, "", 0) for k, v in enumerate(x.astype(np.float32).tolist())]
    want = brute([(k, v) if k % 100 == 0 or True else None for k, v, *_ in rows], 10, 32)
    hits = [r for r in neighbours(frame(spark, rows), F.col("vec_id") % 10 == 0).collect()]
    found = {}
    for r in hits:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = np.mean([len(found[q] & {i for _, i in w}) / 10 for q, w in want.items()])
    assert recall >= 0.9


def test_permutations_put_the_nearest_pivot_first():
    rng = np.random.default_rng(2)
    x, pivots = rng.normal(size=(20, 4)), rng.normal(size=(9, 4))
    want = np.argsort(((x[:, None] - pivots[None]) ** 2).sum(-1), axis=1)
    assert (permutations(x, pivots, 9) == want).all()


def test_few_and_none(spark):
    assert neighbours(frame(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    assert neighbours(frame(spark, [(10, [1.0, 2.0], 0, "", 0)]), F.col("vec_id") % 10 == 0).count() == 0
    got = neighbours(frame(spark, [(10, [1.0, 2.0], 0, "", 0), (11, [1.0, 4.0], 0, "", 0)]), F.col("vec_id") % 10 == 0).collect()
    assert [tuple(r) for r in got] == [(10, 1, 11, 2.0)]
