import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linewright.llm.common import stored, table, words
from linewright.llm.quality import learnable, fit, score
from linewright.llm.tokens import BatchTokenizer

from .test_line_dedup import brute
from .test_simhash import smallest_reachable

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, SF, "documents")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF)))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_quality_rejects_what_it_scores_low(spark, stages):
    docs = stages[0]
    low = {r["doc_id"] for r in score(docs, fit(docs, table(spark, SF, "labels"), learnable(F.col("doc_id")))).where("score < 0.7").collect()}
    assert low and rows(stages[1]).keys() == rows(docs).keys() - low


def test_line_dedup_against_brute_force(spark, stages):
    before, after = rows(stages[1]), rows(stages[2])
    short = {d: r["text"] for d, r in before.items()}
    assert {d: r["text"] for d, r in after.items()} == dict(brute(list(short.items()), spark))
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())


def test_near_dedup_against_brute_force(stages):
    before = rows(stages[2])
    sets = {}
    for d, r in before.items():
        found = (r["text"] or "").encode().lower().split()
        sets[d] = {tuple(found[k : k + 5]) for k in range(max(1, len(found) - 4))} if found else set()
    alike = lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    least = smallest_reachable(list(sets), alike)
    assert rows(stages[3]) == {d: before[d] for d in set(least.values())}


def test_decontamination_against_brute_force(spark, stages):
    windows = set()
    for r in table(spark, SF, "benchmark").collect():
        own = words(r["text"])
        windows |= {tuple(own[k : k + 10]) for k in range(max(1, len(own) - 9))} if own else set()
    before = rows(stages[3])

    def leaks(text):
        found = words(text or "")
        return any(tuple(found[k : k + n]) in windows for n in {len(w) for w in windows} for k in range(len(found) - n + 1))

    assert rows(stages[4]) == {d: r for d, r in before.items() if not leaks(r["text"])}
    assert len(rows(stages[4])) < len(before)


def test_packing_holds_every_token(stages):
    tokens = BatchTokenizer().encoding.encode_ordinary
    got = {}
    for r in stages[5].orderBy("doc_id", "piece").collect():
        got.setdefault(r["doc_id"], []).append((r["length"], r["ids_crc32"]))
    for d, r in rows(stages[4]).items():
        ids, at = [*tokens(r["text"] or ""), 0], 0
        for length, crc in got.pop(d):
            assert zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes()) == crc
            at += length
        assert at == len(ids)
    assert not got


def test_run_is_the_stages_in_turn(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect())) == sorted(map(tuple, stages[5].drop("sequence_id", "offset").collect()))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labels and a benchmark of a few rows."""
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(k, int(k % 2 == 0), 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


HIT = "zero one two three four five six seven eight nine ten eleven"
ODD = "doc_id long, text string, score double, n_removed int, _row string, _once int, th long, `a.b` int, n_chars int"


def odd_rows():
    good = lambda k: f"Plain sentence number {k} goes on about weather. " + " ".join(f"word{k * 7 + j}" for j in range(30))
    bad = "### $$$ !!! ### $$$ !!!"
    texts = [good(k) if k % 2 == 0 else f"{bad} {k}" for k in range(40)] + [None, "", good(2), good(2)]
    return [(k if k < 41 else None, t, 0.1, 5, "r", 7, k, k, None if t is None else len(t)) for k, t in enumerate(texts)]


@pytest.mark.parametrize("k", range(5))
def test_stages_take_clashing_columns_nulls_and_empty_tables(spark, folder, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = spark.createDataFrame(odd_rows(), ODD)
    out = stage(spark, docs, folder)
    none = stage(spark, spark.createDataFrame([], ODD), folder)
    assert none.count() == 0 and none.columns == out.columns
    if k < 4:
        assert out.schema.simpleString() == docs.schema.simpleString()
        kept = {r["th"]: r for r in out.collect()}
        assert all(r["_row"] == "r" and r["_once"] == 7 and r["n_removed"] == 5 and r["score"] == 0.1 and r["a.b"] == r["th"] for r in kept.values())
        assert set(range(0, 40, 2)) - {2} <= set(kept)
    else:
        assert out.agg(F.sum("length")).first()[0] > 44


def test_decontamination_judges_rows_not_ids(spark, folder):
    docs = spark.createDataFrame([(None, HIT), (None, "clean"), (7, "clean too"), (7, HIT), (8, None), (7, HIT)], "doc_id long, text string")
    left = corpus_pipeline.without_benchmarks(spark, docs, folder).collect()
    assert sorted(map(tuple, left), key=repr) == sorted([(None, "clean"), (7, "clean too"), (8, None)], key=repr)


def test_line_dedup_stage_links_what_shares_crowded_blocks_alone(spark):
    """Pairs whose own words all differ by a letter, among many unlike lines with the same common words."""
    import random

    import corpus_pipeline

    rng = random.Random(43)
    common = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(36)]
    rows = []
    for k in range(60):
        own = ["".join(rng.choices("ijklmnopqrstuvwxyz", k=20)) for _ in range(4)]
        for j, found in enumerate((own, [w[:9] + "a" + w[10:] for w in own])):
            rows.append((2 * k + j, " ".join(w for c in range(4) for w in [*common[9 * c : 9 * c + 9], found[c]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.without_repeated_lines(spark, docs, "").collect()}
    assert all(got[2 * k] for k in range(60)) and sum(got[2 * k + 1] == "" for k in range(60)) >= 54
