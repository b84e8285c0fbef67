import random

import numpy as np
import pytest

from linewright.llm import line_dedup
from linewright.llm.common import stored, table
from linewright.llm.line_dedup import CENTRES, LEAST, PLACES, _bound, _may_be_near, _trim, block_keys, dedup_lines, first_pairs, hashed_features, line_features, met_in_blocks, normal_lines, pairs_between, simhashes

SCHEMA = "doc_id long, text string, id long, fp long, line string, n_lines int"
SF = "/root/testdata/sf0.001"


def distance(a, b):
    """Edit distance, by bit vectors over ``a``."""
    if not a or not b:
        return max(len(a), len(b))
    at = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    full, top, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0
    for c in b:
        same = at.get(c, 0)
        flat = same | down
        step = (((same & up) + up) ^ up) | same
        more, less = down | (full & ~(step | up)), up & step
        score += 1 if more & top else -1 if less & top else 0
        more, less = (more << 1 | 1) & full, (less << 1) & full
        up, down = less | (full & ~(flat | more)), more & flat
    return score


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similar(forms, similarity=0.8):
    """All pairs of normal forms at that edit similarity or more: nothing else decides."""
    forms = sorted(forms, key=len)
    size = np.array([len(f) for f in forms])
    counts = np.zeros((len(forms), 256), np.int32)  # an edit changes four at most
    for k, f in enumerate(forms):
        points = np.frombuffer(f.encode("utf-32-le"), np.uint32).astype(np.int64)
        np.add.at(counts[k], (points[:-1] * 31 + points[1:]) % 251, 1)
    for i, f in enumerate(forms):
        last = np.searchsorted(size, size[i] / similarity + 1e-9, side="right")
        most = np.floor(size[i + 1 : last] * (1 - similarity) + 1e-9).astype(np.int64)
        gap = np.abs(counts[i + 1 : last] - counts[i]).sum(axis=1)
        for j in np.flatnonzero((gap <= 4 * most) & (most > 0)) + i + 1:
            if distance(*_trim(f, forms[j])) <= most[j - i - 1]:
                yield f, forms[j]


def brute(docs, spark, similarity=0.8):
    """``docs`` with one occurrence of each group of lines linked by edit similarity."""
    from pyspark.sql import functions as F

    hashes = {r["text"]: r["h"] for r in spark.createDataFrame([(t,) for t in {t for _, t in docs}], "text string").withColumn("h", F.xxhash64("text")).collect()}
    ordered = sorted({(d, t) for d, t in docs}, key=lambda x: (x[0] is not None, x[0] or 0, hashes[x[1]]))
    places = {}
    for doc, text in ordered:
        for k, found in enumerate(normal_lines(text or "")):
            if found:
                places.setdefault(b" ".join(found).decode(), []).append((doc, text, k))
    group = {f: f for f in places}

    def root(f):
        while group[f] != f:
            f = group[f]
        return f

    for a, b in similar(places, similarity):
        group[root(a)] = root(b)
    order = {p: k for k, p in enumerate((d, t, k) for d, t in ordered for k in range(len((t or "").split("\n"))))}
    members = {}
    for f in places:
        members.setdefault(root(f), []).extend(places[f])
    gone = set()
    for own in members.values():
        gone.update(sorted(own, key=order.get)[1:])
    return [(d, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, t, k) not in gone)) for d, t in docs]


def texts(spark, docs):
    return {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame([(d, t, 1, 2, "x", 3) for d, t in docs], SCHEMA), keep=("doc_id",)).collect()}


def test_fast_distance():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 12))) for _ in range(2))
        assert distance(a, b) == slow_distance(a, b) == distance(*_trim(a, b))


def test_against_brute_force(spark):
    rng = random.Random(6)
    pool = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 8))) for _ in range(400)]
    bases = [" ".join(rng.choices(pool, k=rng.randint(3, 60))) for _ in range(25)]

    def line():
        words = rng.choice(bases).split()
        if rng.random() < 0.4:
            words[rng.randrange(len(words))] = rng.choice(pool)
        text = " ".join(words)
        return text.upper() + "!" if rng.random() < 0.2 else text

    docs = [(100 - k, "\n".join(line() for _ in range(rng.randint(1, 6)))) for k in range(40)]
    docs += [(None, docs[0][1]), (3, None), (4, ""), (5, "short line\nshort line\n\n"), (6, "one two three four five\nOne, two three four five."), docs[2], (9, "a b c d é\n" * 300)]
    rows = [(d, t, 1, 2, "x", 3) for d, t in docs]
    got = sorted(((r["doc_id"], r["text"]) for r in dedup_lines(spark.createDataFrame(rows, SCHEMA), keep=("doc_id",)).collect()), key=repr)
    assert got == sorted(brute(docs, spark), key=repr)


def test_recall_against_edit_similarity_alone(spark):
    """Of all pairs of lines of a whole table at edit similarity 0.8 or more, 0.9 at least end in one group, and no others."""
    texts = [r["text"] for r in table(spark, SF, "documents").select("text").collect()]
    forms = sorted({b" ".join(found).decode() for t in texts if t for found in normal_lines(t) if found})
    docs = spark.createDataFrame(list(enumerate(forms)), "doc_id long, text string")
    left = {r["doc_id"] for r in dedup_lines(docs, keep=("doc_id",)).where("text != ''").collect()}
    group = {f: f for f in forms}

    def root(f):
        return f if group[f] == f else root(group[f])

    linked = set()
    for a, b in similar(forms):
        linked |= {a, b}
        group[root(a)] = root(b)
    spare = len(linked) - len({root(f) for f in linked})  # lines that go, by edit similarity alone
    gone = len(forms) - len(left)
    assert spare > 30 and 0.9 * spare <= gone <= spare
    assert all(f in linked for k, f in enumerate(forms) if k not in left)


@pytest.mark.parametrize("columns", [("doc_id",), ("doc_id", "text", "line")])
def test_empty(spark, columns):
    out = dedup_lines(spark.createDataFrame([], SCHEMA), keep=columns)
    assert out.count() == 0 and out.columns[-2:] == ["n_lines", "n_removed"]


def test_clashing_columns_ride_along(spark):
    rows = [(1, "same line here\nown", 7, "a", -1, None), (2, "same line here", None, None, -2, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed int, component string, _doc int, n int")
    got = {r["doc_id"]: r for r in dedup_lines(docs, keep=tuple(docs.columns)).collect()}
    assert got[1]["text"] == "same line here\nown" and got[2]["text"] == "" and got[1]["n_removed"] == 7 and got[2]["n"] == 5 and got[2]["_doc"] == -2


@pytest.mark.parametrize("x, y", [("abc", "abc"), ("", "a"), ("abcd", "abXcd"), ("aaa", "aa"), ("abcabc", "abc"), ("kitten", "sitting")])
def test_trimming_keeps_the_distance(x, y):
    assert slow_distance(*_trim(x, y)) == slow_distance(x, y)


def test_few_edits_leave_a_block_for_certain():
    """A changed word touches two blocks at most: with fewer changes than half the blocks, one that was posted stays."""
    rng = random.Random(9)
    for _ in range(200):
        words = [f"{rng.getrandbits(40):x}".encode() for _ in range(rng.randint(24, 47))]  # eight blocks
        other = list(words)
        for at in rng.sample(range(len(words)), 2):
            other[at] = f"{rng.getrandbits(40):x}".encode()
        features, length = hashed_features([line_features(words), line_features(other)])
        owner, keys = block_keys(features, length)
        mine, theirs = (set(keys[owner == k].tolist()) for k in (0, 1))
        assert len(mine) <= 2 * PLACES and len(mine - theirs) <= 4 * 2
        assert mine & theirs or min(len(mine), len(theirs)) < LEAST + 4


def test_simhash_of_long_lines():
    rng = np.random.default_rng(3)
    for sizes in ([1], [255, 256, 3], [600, 1]):
        features = rng.integers(0, 2**63, sum(sizes), np.uint64)
        at, want = 0, []
        for n in sizes:
            own = [int(x) for x in features[at : at + n]]
            at += n
            # bytes of a number in the order of memory, bits of a byte from the highest
            bits = [2 * sum(x >> 8 * (k // 8) + 7 - k % 8 & 1 for x in own) > n for k in range(64)]
            want.append(int("".join("01"[b] for b in bits), 2))
        assert [int(x) % (1 << 64) for x in simhashes(features, np.array(sizes))] == want


def test_crowded_blocks_over_many_batches(spark):
    """A block that lies in several Arrow batches and tasks gives ends, and all of its lines as posts; pairs grow with its lines."""
    rows = [(k, 5, 100, [7, 10000 + k]) for k in range(3000)] + [(k, 5, 100, [8]) for k in range(5000, 5009)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        met = stored(met_in_blocks(spark.createDataFrame(rows, "id long, fp long, more long, keys array<long>"), 0.8))
        posts = met.where("kind = 1 AND key = 7").select("a").distinct().count()
        ends = met.where("kind = 2 AND key = 7").count()
        pairs = first_pairs(met, 0.8)
        rest = pairs_between(met, spark.createDataFrame([], "id long, component long"), 0.8)
        crowded, small = pairs.where("a < 5000").count(), pairs.unionByName(rest.select("a", "b")).where("a >= 5000").distinct().count()
        between = rest.where("a < 5000").count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert posts == 3000 and ends >= 6 and small == 36
    assert 2999 <= crowded <= 3100 and 2999 * CENTRES - 100 <= between <= 2999 * CENTRES


def test_all_groups_of_a_crowded_block_meet(spark, monkeypatch):
    """All pairs of lines of different groups, over tiles, each once; pairs of one group or that are not likely are not made."""
    monkeypatch.setattr(line_dedup, "TILE", 7)
    rng = random.Random(8)
    fps = [rng.getrandbits(62) for _ in range(5)]
    rows = [(k, rng.choice(fps), 100, [7]) for k in range(90)] + [(k, fps[0], 100, [8]) for k in range(100, 130)]
    group = {k: k % 4 for k in range(0, 90, 2)}
    met = stored(met_in_blocks(spark.createDataFrame(rows, "id long, fp long, more long, keys array<long>"), 0.8))
    got = [tuple(r) for r in line_dedup.all_pairs_between(met, spark.createDataFrame(list(group.items()), "id long, component long"), 0.8).collect()]
    near = lambda x, y: bin(x ^ y).count("1") <= line_dedup.RADIUS
    own = lambda k: group.get(k, k)
    want = [(a, b, own(a), own(b)) for a, x, _, p in rows for b, y, _, q in rows if a < b and p == q and own(a) != own(b) and near(x, y)]
    assert sorted(got) == sorted(want)


def test_alike_in_crowded_blocks_alone(spark):
    """Pairs whose own words all differ by a letter share no block but those that hundreds of unlike lines share."""
    rng = random.Random(41)
    common = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(36)]
    docs = []
    for k in range(60):
        own = ["".join(rng.choices("ijklmnopqrstuvwxyz", k=20)) for _ in range(4)]
        for j, words in enumerate((own, [w[:9] + "a" + w[10:] for w in own])):
            docs.append((2 * k + j, " ".join(w for c in range(4) for w in [*common[9 * c : 9 * c + 9], words[c]])))
    got = texts(spark, docs)
    assert all(got[2 * k] for k in range(60))
    assert sum(got[2 * k + 1] == "" for k in range(60)) >= 54


def test_short_lines_and_scripts_without_spaces(spark):
    paragraph = "".join(chr(0x4E00 + 37 * k % 5000) for k in range(120))
    docs = [(1, "Read more\nHome\n\n"), (2, "read MORE!\nNews\n\nHome"), (3, paragraph), (4, paragraph + "\nother"), (5, paragraph[:60] + "二" + paragraph[61:]), (6, None), (7, "abcd"), (8, "abce")]
    assert texts(spark, docs) == {1: "Read more\nHome\n\n", 2: "News\n", 3: paragraph, 4: "other", 5: "", 6: None, 7: "abcd", 8: "abce"}


def test_planted_repeats_near_the_limit(spark):
    rng = random.Random(31)
    docs, planted = [], 0
    for k in range(300):
        own = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(4, 7))) for _ in range(rng.choice((6, 12, 25, 50)))]
        other, at, size = list(own), rng.randrange(len(own)), len(" ".join(own))
        other[at] = "".join(rng.choices("qrstuvwxyz", k=len(own[at])))
        docs += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
        planted += 1 - distance(docs[-1][1], docs[-2][1]) / size >= 0.8
    got = texts(spark, docs)
    found = sum(got[2 * k + 1] == "" for k in range(300))
    assert planted > 200 and 0.97 * planted <= found <= planted
    assert all(got[2 * k] for k in range(300))


def test_large_family_and_what_is_unlike_it(spark):
    rng = random.Random(32)
    base = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(40)]
    docs = []
    for k in range(120):
        own = list(base)
        own[rng.randrange(40)] = f"other{chr(97 + k % 26)}{chr(97 + k // 26)}"
        docs.append((k, " ".join(own)))
    docs.append((500, " ".join(base[:20] + [f"new{chr(97 + k)}" for k in range(20)])))
    got = texts(spark, docs)
    assert got[0] == docs[0][1] and got[500] == docs[-1][1] and sum(t != "" for t in got.values()) == 2


def test_shared_runs_never_rule_out_a_near_pair():
    rng, ruled = random.Random(33), 0
    for _ in range(3000):
        x = "".join(rng.choices("abcd", k=rng.randint(0, 30)))
        y = list(x)
        for _ in range(rng.randint(0, 8)):
            at = rng.randint(0, len(y))
            y[at : at + rng.randint(0, 1)] = rng.choices("abcd", k=rng.randint(0, 1))
        y, most = "".join(y), rng.randint(0, 6)
        may = _may_be_near(x, y, most)
        assert may or distance(x, y) > most
        assert _bound(x, y, most, 3) > most or distance(x, y) <= _bound(x, y, most, 3)
        ruled += not may
    assert ruled > 200


def test_pieces_rule_out_unlike_lines_and_never_a_near_pair():
    """Lines of the same words in another order share most runs of characters; pieces, which stay near their place, tell them apart."""
    rng = random.Random(51)
    for _ in range(600):
        x = "".join(rng.choices("abcdé", k=rng.randint(1, 200)))
        y = list(x)
        for _ in range(rng.randint(0, 40)):
            at = rng.randint(0, len(y))
            y[at : at + rng.randint(0, 3)] = rng.choices("abcd二", k=rng.randint(0, 3))
        y = "".join(y)
        for most in (distance(x, y), distance(x, y) + 3):
            assert line_dedup.least_edits([x], [y], np.array([most]))[0] <= distance(x, y)
    pool = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(30)]
    xs, ys = ([" ".join(rng.sample(pool, 30) * 2) for _ in range(40)] for _ in range(2))
    mosts = np.array([max(len(x), len(y)) // 5 for x, y in zip(xs, ys)])
    assert all(distance(x, y) > k for x, y, k in zip(xs, ys, mosts))
    ruled = line_dedup.least_edits(xs, ys, mosts) > mosts
    runs = [not _may_be_near(x, y, int(k)) for x, y, k in zip(xs, ys, mosts)]
    assert ruled.sum() >= 38 and not any(runs)
    assert not len(line_dedup.least_edits([], [], np.zeros(0, np.int64)))


def test_pairs_by_edit_distance_alone(spark):
    """Of pairs around the limit, in characters of all widths, exactly those stay that an edit distance lets stay."""
    rng, forms, want = random.Random(52), [], []
    for k in range(200):
        x = "".join(rng.choices("abcdef é二𝄞", k=rng.randint(5, 300)))
        y = list(x)
        for _ in range(int(len(x) * rng.uniform(0.15, 0.5))):
            at = rng.randint(0, len(y))
            y[at : at + rng.randint(0, 1)] = rng.choices("abcdef é二𝄞", k=rng.randint(0, 1))
        y = "".join(y)
        forms += [(2 * k, x), (2 * k + 1, y)]
        if distance(x, y) <= int(max(len(x), len(y)) * 0.2 + 1e-9):
            want.append(2 * k)
    pairs = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(200)], "a long, b long")
    got = [r["a"] for r in line_dedup.similar_pairs(pairs, spark.createDataFrame(forms, "id long, form string"), 0.8).collect()]
    assert sorted(got) == want and 30 < len(want) < 170


def test_edit_distances_side_by_side_are_exact():
    """Pairs at, under and over their limits, in bands of one number and of many, few and many at once, in characters of all widths."""
    rng = random.Random(53)
    for size, pairs in ((1, 40), (60, 300), (200, 300), (700, 150), (3000, 5)):
        xs, ys = [], []
        for _ in range(pairs):
            x = "".join(rng.choices("abcdé 二𝄞", k=rng.randint(1, size)))
            y = list(x)
            for _ in range(rng.randint(0, len(x) // 2 + 1)):
                at = rng.randint(0, len(y))
                y[at : at + rng.randint(0, 1)] = rng.choices("abcd xé", k=rng.randint(0, 1))
            xs.append(x)
            ys.append("".join(y) or "q")
        found = np.array([distance(x, y) for x, y in zip(xs, ys)])
        assert [line_dedup.edit_distance(x, y) for x, y in zip(xs, ys)] == found.tolist()
        for more in (-1, 0, 1, 7):
            most = np.maximum(found + more, 0)
            assert (line_dedup.within_edits(xs, ys, most) == (found <= most)).all()
    assert not len(line_dedup.within_edits([], [], np.zeros(0, np.int64)))


def test_pairs_that_many_batches_hold_are_all_decided(spark, monkeypatch):
    """Pairs that wait for their edit distances are decided together, whatever the batch they came in, with what rides along."""
    monkeypatch.setattr(line_dedup, "_HELD", 3000)
    rng, forms, want = random.Random(54), [], []
    for k in range(300):
        x = "".join(rng.choices("abcdef", k=rng.randint(100, 200)))
        y = "".join(rng.choice("ghijk") if rng.random() < rng.choice((0.15, 0.25)) else c for c in x)
        forms += [(2 * k, x), (2 * k + 1, y)]
        if distance(x, y) <= int(len(x) * 0.2 + 1e-9):
            want.append((2 * k, 2 * k + 1, 7 * k, -k))
    pairs = spark.createDataFrame([(2 * k, 2 * k + 1, 7 * k, -k) for k in range(300)], "a long, b long, ga long, gb long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = [tuple(r) for r in line_dedup.similar_pairs(pairs, spark.createDataFrame(forms, "id long, form string"), 0.8).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(got) == want and 60 < len(want) < 240


def test_lines_of_a_buffer_are_those_of_each_text():
    """Places, normal forms, sizes and numbers of features as line by line, and the same features in whatever batch a line comes."""
    rng = random.Random(55)
    texts = [None, "", "\n\n", "a\n\nb  c\n", " x ", "ÀÉ İ\n二 二" * 9, "w" * 50 + " " + "b c " * 20, "z" * 3000 + "\n" + "q 7 " * 13, "!!!\n???"]
    texts += ["\n".join(" ".join("".join(rng.choices("abcÉ9,", k=rng.randint(1, 24))) for _ in range(rng.randint(0, 30))) for _ in range(5)) for _ in range(40)]

    def found(texts):
        flat, count = line_dedup._normal_buffer(texts)
        place, forms, sizes, short, features, length = line_dedup._buffer_lines(flat)
        doc = np.searchsorted(np.cumsum(count), place, side="right")
        want = [(k, n, words) for k, t in enumerate(texts) for n, words in enumerate(normal_lines(t or "")) if words]
        assert list(zip(doc.tolist(), (place - (np.cumsum(count) - count)[doc]).tolist(), forms)) == [(k, n, b" ".join(w)) for k, n, w in want]
        assert short.tolist() == [len(w) < line_dedup.SHORT for *_, w in want] and sizes.tolist() == [len(x.decode()) for x in forms]
        assert length.tolist() == [len(line_features(w)) for *_, w in want]
        return {x: sorted(features[at : at + n].tolist()) for x, at, n in zip(forms, np.cumsum(length) - length, length)}

    whole = found(texts)
    assert all(whole[x] == own for t in texts for x, own in found([t]).items())
    assert not found([])


def test_forms_of_rows_that_repeat_and_of_null_ids(spark):
    rows = [(None, 5, "A b!\n\nC  D\nx"), (1, 6, "E\nf"), (1, 6, "E\nf"), (2, 7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, th long, text string")
    lines = [(10, (None, 5, 0)), (11, (None, 5, 2)), (12, (None, 5, 3)), (13, (1, 6, 1)), (14, (1, 6, 0))]
    lines = spark.createDataFrame(lines, "id long, first struct<doc_id:long,th:long,line:int>")
    ids = spark.createDataFrame([(k,) for k in (10, 11, 13)], "id long")
    assert sorted(tuple(r) for r in line_dedup.line_forms(ids, lines, docs).collect()) == [(10, "a b"), (11, "c d"), (13, "f")]
