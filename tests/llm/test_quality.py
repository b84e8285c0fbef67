import random

import numpy as np
from pyspark.sql import functions as F

from linewright.llm.quality import Voters, features, fit, learnable, score, unit

DOCS, LABELS = "doc_id long, text string, lang string, score string", "doc_id long, quality int, toxic int, text string"


def make(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(["tha", "ing", "er", "wh", "on"], k=rng.randint(1, 3)))
    docs, labels = [], []
    for k in range(n):
        good = rng.random() < 0.8
        words = [word() for _ in range(rng.randint(20, 120))]
        kind = rng.randrange(3)
        text = ". ".join(" ".join(words[a : a + 9]).capitalize() for a in range(0, len(words), 9)) if good else " ".join(w + rng.choice(["###", "$$$"]) for w in words) if kind == 0 else " | ".join(words) if kind == 1 else " ".join([words[0]] * len(words))
        docs.append((k, text, "x", "y"))
        labels.append((k, int(good), 0, "z"))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = make(800)
    extra = [(None, "a b", "", ""), (9001, None, "", ""), (9002, "", "", ""), (9003, docs[0][1] * 300, "", "")]
    marks = labels + [(None, 1, 0, ""), (5, None, 0, ""), (6, 7, 0, ""), (99999, 1, 0, "")] + labels[:3]
    d, m = spark.createDataFrame(docs + extra + docs[:2], DOCS), spark.createDataFrame(marks, LABELS)
    got = score(d, fit(d, m, learnable(F.col("doc_id")))).collect()
    assert len(got) == len(docs) + 6 and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    held = [(r.doc_id, r.quality) for r in m.where(~learnable(F.col("doc_id"))).where("quality in (0, 1)").collect() if r.doc_id in by and r.doc_id is not None]
    assert len(held) > 100 and np.mean([(by[k] >= 0.7) == bool(q) for k, q in held]) > 0.97


def test_votes_against_brute_force():
    rng = np.random.default_rng(1)
    voters = Voters(np.ones(8, np.float32), np.eye(8, dtype=np.float32), unit(rng.normal(size=(50, 8))), rng.integers(0, 2, 50).astype(float), rng.random(50) + 0.5, 0.6, nearest=7, sharpness=3.0)
    rows = rng.normal(size=(20, 8))
    for row, got in zip(rows, voters.scores(rows)):
        cosine = voters.vectors @ (row / np.linalg.norm(row))
        best = np.argsort(-cosine)[:7]
        vote = np.clip(cosine[best], 0, 1) ** 3 * voters.worth[best]
        doubt = 1e-3 * voters.worth.mean()
        assert np.isclose(got, (vote @ voters.labels[best] + doubt * 0.6) / (vote.sum() + doubt))


def test_no_labels_and_no_rows(spark):
    docs, labels = spark.createDataFrame([(1, "abc", "", "")], DOCS), spark.createDataFrame([], LABELS)
    assert [r["score"] for r in score(docs, fit(docs, labels, F.lit(True))).collect()] == [0.5]
    assert score(spark.createDataFrame([], DOCS), None).count() == 0


def test_features_of_odd_texts():
    for text in ["", " ", "\n", "é", "!" * 100_000, "\U0010ffff"]:
        assert np.isfinite(features(text)).all()


def test_scores_against_brute_force(spark):
    """Every row's score from its own features, all cosines sorted, and the votes of the nearest; equal neighbours included."""
    docs, labels = make(150, seed=3)
    docs += [(1000 + k, docs[0][1], "", "") for k in range(40)] + [(2000, None, "", ""), (2001, "", "", "")]
    labels += [(1000 + k, k % 2, 0, "") for k in range(40)]
    d, m = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    voters = fit(d, m, F.lit(True))
    assert len(voters.labels) == 190
    for row, (doc, text, _, _) in zip(score(d.coalesce(1), voters).collect(), docs):
        own = (features(text or "") * voters.weight) @ voters.project
        own = own / max(1e-12, np.linalg.norm(own))
        near = sorted(((float(v @ own), float(y), float(w)) for v, y, w in zip(voters.vectors, voters.labels, voters.worth)), reverse=True)
        kth = near[24][0]
        above, level = ([x for x in near if (x[0] > kth + 1e-5) == up and x[0] > kth - 1e-5] for up in (True, False))
        doubt = 1e-3 * voters.worth.mean()

        def voted(found):
            votes = [np.clip(c, 0, 1) ** voters.sharpness * w for c, _, w in found]
            return (sum(v * y for v, (_, y, _) in zip(votes, found)) + doubt * voters.prior) / (sum(votes) + doubt)

        assert row["doc_id"] == doc
        spare = 25 - len(above)  # of those at the last similarity any may vote
        by_label = sorted(level, key=lambda x: x[1])
        assert voted(above + by_label[:spare]) - 1e-3 <= row["score"] <= voted(above + by_label[::-1][:spare]) + 1e-3


def test_copies_of_a_labelled_row_crowd_nothing_out(spark):
    docs, labels = make(60, seed=5)
    voters = fit(spark.createDataFrame(docs + [docs[0]] * 500, DOCS), spark.createDataFrame(labels, LABELS), F.lit(True), per_label=60)
    assert len(voters.labels) == 60
