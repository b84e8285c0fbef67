"""Fuzzy line deduplication.

Lines are normalised (lower case, digits alike, punctuation gone). Equal normal forms are one from the start, whatever their
length. Fuzzy links join those whose edit similarity (1 - distance / longer length, over normal forms) is ``similarity``
or more, and of each connected group one occurrence stays: the first by doc_id (null first), hash of the text, and line
number.

Pairs to compare come from pigeonhole blocks. A line's features (its counted words; runs of characters for long words and
lines of few words) are dealt to blocks by their hashes, ``PER`` to twice as many a block on average, and a block's key is
the sum of the hashes in it. An edit of one word changes two blocks at most, so lines that differ in fewer words than half
of the blocks agree in one for certain; short lines, which have few blocks, are dealt several times over, and of long ones
``PLACES`` blocks are posted (``SHORT_PLACES`` where characters decide). Lines that share a block, whose lengths allow the
similarity and whose SimHashes lie within ``RADIUS`` of ``BITS`` bits, are compared. The blocks are of the features and not of
the SimHash's own bits, because lines at similarity 0.8 differ in a tenth to a fifth of all bits, and blocks that such a
radius leaves whole are too short to tell lines apart.

In blocks of up to ``SMALL`` lines all likely pairs are compared. In larger ones, and in blocks that lie in several batches, a
line is held against the block's least line, and then, if they are not in one group yet, against ``CENTRES`` more that are drawn
by a hash: pairs that add nothing to the groups are not made, and their number grows with the lines and not with the square
of a block. What is then still in different groups of a crowded block meets whole, in squares of ``TILE`` lines a side, so that no
likely pair of a block is lost: only links inside a group are left out. Blocks are cut by ranges of (key, id), so that lines of a
crowded block lie in as many tasks as they need.

Null texts stay null; empty texts stay. Rows that repeat both doc_id and text are one document and get one answer.
An empty table gives no rows. Long texts are read whole. Columns named in ``keep`` ride along (one of the names ``n_lines`` or
``n_removed`` stays as it is, and the operator's own of that name is left out), others are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_BYTES, drop_stored, hashed_spans, join_hot, slices, stored, table, tidy_shuffles
from .graph import components

PLACES, PER, LEAST = 12, 3, 3  # blocks posted; features a block; features that a posted block holds
BITS, RADIUS = 104, 32  # of a SimHash: 64 bits, and 40 that share a number with the size
_MOST = (1 << 128 - BITS) - 1  # sizes are told apart up to here
SHORT, SHORT_PLACES = 12, 32  # lines of fewer words are compared by characters; their blocks posted
SMALL, CENTRES = 24, 8  # lines of a block that are all held against each other; lines of a larger one that all others meet first
TILE = 2048  # about so many lines of a crowded block meet as many others in one place
_TIMES = np.random.default_rng(17).integers(0, 2**63, SHORT_PLACES, np.uint64) * np.uint64(2) + np.uint64(1)
_NORMAL = bytes(10 if c == 10 else 48 if 48 <= c <= 57 else WORD_BYTES[c] for c in range(256))
#: The bits of each byte value, one in each byte of a 64-bit number.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64)[:, 0]


def normal_lines(text: str) -> list[list[bytes]]:
    """The words of each line's normal form."""
    return [line.split() for line in text.lower().encode("utf-8", "surrogatepass").translate(_NORMAL).split(b"\n")]


def line_features(found: list[bytes]) -> list[bytes]:
    """What lines are compared by: words, and runs of characters of words of over 20 bytes and of lines of under ``SHORT`` words."""
    if len(found) < SHORT:
        whole = b" ".join(found)
        return _runs(whole, 3 if len(whole) >= 20 else 2)
    if max(map(len, found)) <= 20:
        return found
    return [x for w in found for x in ([w] if len(w) <= 20 else _runs(w, 4))]


def _runs(word: bytes, width: int) -> list[bytes]:
    if word.isascii():
        return [word[k : k + width] for k in range(max(1, len(word) - width + 1))]
    text = word.decode("utf-8", "surrogatepass")
    return [text[k : k + width].encode("utf-8", "surrogatepass") for k in range(max(1, len(text) - width + 1))]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def _occurrences(features: np.ndarray, line: np.ndarray) -> np.ndarray:
    """How often each feature stood in its line before."""
    key = features ^ _mixed(line.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)  # equal ones in any order: only how often each stands in its line counts
    ranked = key[order]
    at = np.arange(len(key))
    first = np.maximum.accumulate(np.where(np.concatenate([[True], ranked[1:] != ranked[:-1]]), at, 0))
    out = np.empty(len(key), np.uint64)
    out[order] = at - first
    return out


def hashed_features(lines: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every feature with the number of times that it stood in its line before, and how many each line has.

    By that number a frequent word weighs once for each time, not by the square, and unlike lines stay apart.
    """
    from xxhash import xxh64_intdigest

    length = np.fromiter(map(len, lines), np.int64, len(lines))
    hashes = np.fromiter(map(xxh64_intdigest, chain.from_iterable(lines)), np.uint64, length.sum())
    return _mixed(hashes + _occurrences(hashes, np.repeat(np.arange(len(lines)), length))), length


def simhashes(features: np.ndarray, length: np.ndarray, width: int = 8) -> np.ndarray:
    """Bits set in over half of the hashes of each line's features (none may be without), in the first ``width`` bytes; no others are set."""
    starts = np.cumsum(length) - length
    # up to 255 features are summed in byte lanes, eight bits to a number; such blocks are then summed for each line
    blocks = -(-length // 255)
    first = np.cumsum(blocks) - blocks
    begins = np.repeat(starts - 255 * first, blocks) + 255 * np.arange(blocks.sum())
    lanes = np.add.reduceat(_SPREAD[features.view(np.uint8).reshape(-1, 8)[:, :width]], begins, axis=0)
    ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8 * width), first, axis=0, dtype=np.int64)
    out = np.zeros((len(length), 8), np.uint8)
    out[:, :width] = np.packbits(2 * ones > length[:, None], axis=1)
    return out.view(">i8")[:, 0].astype(np.int64)


def block_keys(features: np.ndarray, length: np.ndarray, places: int = PLACES) -> tuple[np.ndarray, np.ndarray]:
    """Lines and keys of their posted blocks.

    The number of blocks is a power of two that follows the number of features; a line near the next power is dealt to
    that too, so that lines of which one is a fourth longer than the other meet.
    """
    line = np.repeat(np.arange(len(length)), length)
    owners, keys = [], []
    own, more = (np.floor(np.log2(np.maximum(1, length / share / PER))).astype(np.int64) for share in (1, 0.8))
    for levels, counts in ((own, np.ones(len(own), bool)), (more, more != own)):
        for level in np.unique(levels[counts]).tolist():
            taken = np.flatnonzero(counts & (levels == level))
            place = np.full(len(length), -1)
            place[taken] = np.arange(len(taken))
            at = place[line]
            held, at = features[at >= 0], at[at >= 0]
            blocks = 1 << level
            posted = min(blocks, places)
            for deal in range(max(1, places // blocks)):
                x = _mixed(held * _TIMES[deal])
                block = (x >> np.uint64(64 - level)).astype(np.int64) if level else np.zeros(len(x), np.int64)
                some = slice(None) if blocks <= places else block < places
                cell = at[some] * posted + block[some]
                total = np.zeros(len(taken) * posted, np.uint64)
                np.add.at(total, cell, _mixed(x[some]))
                good = np.flatnonzero(np.bincount(cell, minlength=len(total)) >= LEAST)
                mark = (good % posted + (level * places + deal) * places).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                owners.append(taken[good // posted])
                keys.append(_mixed(total[good] ^ mark))
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in ((owners, np.int64), (keys, np.uint64)))


def line_keys(features: np.ndarray, length: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many blocks each line posts, and their keys by line."""
    found = []
    for kind, places in ((short, SHORT_PLACES), (~short, PLACES)):
        line = np.flatnonzero(kind)
        owner, key = block_keys(features[np.repeat(kind, length)], length[kind], places)
        found.append((line[owner], key))
    owner, key = (np.concatenate(x) for x in zip(*found))
    return np.bincount(owner, minlength=len(length)), key[np.argsort(owner, kind="stable")].view(np.int64)


def _normal_buffer(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that ``normal_lines`` splits, of all texts, each with a newline after it; and how many lines each text has."""
    found = [(t or "").lower().encode("utf-8", "surrogatepass").translate(_NORMAL) for t in texts]
    return np.frombuffer(b"\n".join([*found, b""]), np.uint8), np.fromiter((t.count(b"\n") + 1 for t in found), np.int64, len(found))


def _buffer_lines(flat: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line with words: its place, normal form, size in characters, whether it is short, its hashed features (in order of lines) and how many.

    Words are hashed in place; runs of characters, of short lines and long words alone, are cut out.
    """
    inside = (flat != 32) & (flat != 10)
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, stop = edges[::2], edges[1::2]
    number = (np.cumsum(flat == 10) - (flat == 10))[start]  # of each word's line
    first = np.flatnonzero(np.diff(number, prepend=-1))
    place, count = number[first], np.diff(np.append(first, len(number)))
    line = np.repeat(np.arange(len(place)), count)
    kept = inside.copy()
    kept[stop[:-1][line[1:] == line[:-1]]] = True  # one space between words
    ends = np.cumsum(np.add.reduceat(kept, start[first], dtype=np.int64)) if len(first) else np.zeros(0, np.int64)
    begins = np.concatenate([[0], ends])[: len(ends)]
    squeezed = flat[kept]
    sizes = np.add.reduceat((squeezed & 0xC0) != 0x80, begins, dtype=np.int64) if len(first) else begins  # all bytes but those that go on with a character
    whole = squeezed.tobytes()
    forms = [whole[x:y] for x, y in zip(begins.tolist(), ends.tolist())]
    short, long = count < SHORT, stop - start > 20
    words = ~short[line] & ~long
    hashes = hashed_spans(flat, start[words], stop[words])
    of_words = np.bincount(line[words], minlength=len(place))
    hashes = _mixed(hashes + _occurrences(hashes, line[words])) if len(hashes) else hashes
    cut = np.flatnonzero(short | (np.bincount(line[long], minlength=len(place)) > 0))
    runs, of_runs = hashed_features([line_features(w) if len(w) < SHORT else [x for v in w if len(v) > 20 for x in _runs(v, 4)] for w in (forms[k].split() for k in cut.tolist())])
    length = of_words.copy()
    length[cut] += of_runs
    features, begins = np.empty(length.sum(), np.uint64), np.cumsum(length) - length
    for found, owners, own, after in ((hashes, np.arange(len(place)), of_words, 0), (runs, cut, of_runs, of_words[cut])):
        features[np.arange(len(found)) + np.repeat(begins[owners] + after - (np.cumsum(own) - own), own)] = found
    return place, forms, sizes, short, features, length


def fuzzy_lines(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), line, id (hash of the normal form), fp, more (40 bits of its SimHash over its size in characters) and keys of each line that is not empty."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in slices(batches, "text", 2 << 20):
            flat, count = _normal_buffer(batch.column("text").to_pylist())
            place, forms, sizes, short, features, length = _buffer_lines(flat)
            if not len(place):
                continue
            doc = np.searchsorted(np.cumsum(count), place, side="right")
            ids = np.fromiter(map(xxh64_intdigest, forms), np.uint64, len(forms)).view(np.int64)
            posted, keys = line_keys(features, length, short)
            ends = np.concatenate([[0], np.cumsum(posted)]).astype(np.int32)
            columns = {c: batch.column(c).take(pa.array(doc)) for c in ("doc_id", "th")}
            columns |= {"line": pa.array((place - (np.cumsum(count) - count)[doc]).astype(np.int32)), "id": pa.array(ids)}
            more = simhashes(_mixed(features), length, (BITS - 64) // 8) & ~_MOST | np.minimum(sizes, _MOST)
            columns |= {"fp": pa.array(simhashes(features, length)), "more": pa.array(more), "keys": pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(lines, "doc_id long, th long, line int, id long, fp long, more long, keys array<long>")


def _likely(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sizes allow the similarity, and SimHashes lie near; ``x``, ``y`` are what ``more`` holds."""
    bits = np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int64) + np.bitwise_count(((x ^ y) & ~_MOST).view(np.uint64))
    return (bits <= RADIUS) & (np.minimum(x & _MOST, y & _MOST) >= np.maximum(x & _MOST, y & _MOST) * similarity - 1e-9)


def _likely_columns(similarity: float) -> Column:
    x, y = (F.col(f"{t}.more").bitwiseAND(F.lit(_MOST)) for t in "ab")
    rest = F.col("a.more").bitwiseXOR(F.col("b.more")).bitwiseAND(F.lit(~_MOST))
    bits = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) + F.bit_count(rest)
    return (F.least(x, y) >= F.greatest(x, y) * F.lit(similarity) - F.lit(1e-9)) & (bits <= RADIUS)


PAIR, POST, END = 0, 1, 2
MET_SCHEMA = "kind int, a long, b long, fp long, more long, key long"


def met_in_blocks(lines: DataFrame, similarity: float) -> DataFrame:
    """Rows of three kinds, from ``lines`` (id, fp, more, keys).

    PAIR: two likely lines of a small block (a, b), or a larger one's least line and another. POST: a line of a larger block. END:
    the least line of a block that may go on in another batch; all lines of such a block are posts as well.
    """
    size = F.col("more").bitwiseAND(F.lit(_MOST))  # a line too short to lose a character has equals alone
    posts = lines.where(F.floor(size * F.lit(1 - similarity) + F.lit(1e-9)) > 0).select("id", "fp", "more", F.explode("keys").alias("key"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, fps, more, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "fp", "more", "key"))
            order = np.lexsort((ids, keys))
            ids, fps, more, keys = ids[order], fps[order], more[order], keys[order]
            begins = np.append(True, keys[1:] != keys[:-1])
            at = np.flatnonzero(begins)
            number = np.cumsum(begins) - 1
            lines = np.diff(np.append(at, len(keys)))
            edge = np.zeros(len(at), bool)
            edge[[0, -1]] = True
            large = (lines > SMALL) | edge
            # of each line and the one so many places before: in small blocks any, in larger ones the first
            here = np.flatnonzero(~large[number] & ~begins)
            back = np.arange(len(keys)) - at[number]
            firsts, seconds = [], []
            for step in range(1, min(SMALL, int(back[here].max(initial=0)) + 1)):
                here = here[back[here] >= step]
                firsts.append(here - step)
                seconds.append(here)
            rest = np.flatnonzero(large[number] & ~begins)
            first, second = np.concatenate([*firsts, at[number][rest]]), np.concatenate([*seconds, rest])
            near = (ids[first] != ids[second]) & _likely(fps[first], fps[second], more[first], more[second], similarity)
            first, second = first[near], second[near]
            post, end = np.flatnonzero(large[number]), at[edge]
            taken = np.concatenate([first, post, end])
            kind = np.repeat(np.array([PAIR, POST, END], np.int32), [len(first), len(post), len(end)])
            other = np.concatenate([ids[second], np.zeros(len(post) + len(end), np.int64)])
            arrays = [kind, ids[taken], other, fps[taken], more[taken], keys[taken]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["kind", "a", "b", "fp", "more", "key"])

    dealt = posts.repartitionByRange(F.col("key"), F.col("id")).sortWithinPartitions("key")  # by one number, as a radix sort can
    return dealt.mapInArrow(meet, MET_SCHEMA)


def first_pairs(met: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a < b) of ``met_in_blocks``, and those of the least lines of blocks that lie in several batches."""
    ends = met.where(F.col("kind") == END).select(F.col("a").alias("id"), "fp", "more", "key")
    least = ends.groupBy("key").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "low")
    least = least.join(ends.withColumnRenamed("id", "low"), ["key", "low"]).distinct()
    across = ends.alias("b").join(least.withColumnRenamed("low", "id").alias("a"), F.col("a.key") == F.col("b.key")).where((F.col("a.id") < F.col("b.id")) & _likely_columns(similarity))
    return met.where(F.col("kind") == PAIR).select("a", "b").unionByName(across.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))).distinct()


def mixed_posts(met: DataFrame, groups: DataFrame, counted: bool = True) -> DataFrame:
    """The posts of ``met`` (id, fp, more, key, group, and, if ``counted``, lines) in crowded blocks that hold several groups; lines: of the block.

    ``groups`` (id, component) names lines with links; a line without is its own group.
    """
    posts = met.where(F.col("kind") == POST).select(F.col("a").alias("id"), "fp", "more", "key").join(groups, "id", "left")
    posts = posts.select("id", "fp", "more", "key", F.coalesce("component", "id").alias("group"))
    mixed = posts.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count(F.lit(1)).alias("n")).where("low != high").select("key", "n", F.col("n").alias("lines"))
    return stored(join_hot(posts, mixed, "key", met.count(), "inner" if counted else "left_semi"))


def _ordered(met: DataFrame) -> DataFrame:
    """(a, b, ga, gb) of joined posts a and b, the smaller id first, each pair once."""
    low, high = F.struct("a.id", "a.group"), F.struct("b.id", "b.group")
    ordered = met.select(F.when(F.col("a.id") < F.col("b.id"), F.struct(low.alias("x"), high.alias("y"))).otherwise(F.struct(high.alias("x"), low.alias("y"))).alias("p"))
    return ordered.select(F.col("p.x.id").alias("a"), F.col("p.y.id").alias("b"), F.col("p.x.group").alias("ga"), F.col("p.y.group").alias("gb")).distinct()


def pairs_between(met: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """Likely pairs (a, b) of a crowded block's centres and its other lines that are in different groups (ga, gb). Blocks of one group go first."""
    posts = mixed_posts(met, groups, counted=False)
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("key", "id"), "id"))
    centres = posts.withColumn("place", place).where(F.col("place") <= CENTRES).drop("place")
    x, y = centres.alias("a"), posts.alias("b")
    return _ordered(x.join(y, (F.col("a.key") == F.col("b.key")) & (F.col("a.group") != F.col("b.group")) & _likely_columns(similarity)))


def all_pairs_between(met: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """All likely pairs (a, b) of crowded blocks that are in different groups (ga, gb). A block's lines are dealt to parts, and each two parts meet once."""
    parts = F.ceil(F.col("lines") / F.lit(TILE)).cast("int")
    placed = mixed_posts(met, groups).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    own = ["id", "fp", "more", "group", "key"]
    x = placed.select(*own, F.col("part").alias("i"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("j")).alias("a")
    y = placed.select(*own, F.explode(F.sequence(F.lit(0), "part")).alias("i"), F.col("part").alias("j")).hint("merge").alias("b")
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
    once = (F.col("a.i") < F.col("a.j")) | (F.col("a.id") < F.col("b.id"))
    return _ordered(x.join(y, same & once & (F.col("a.group") != F.col("b.group")) & _likely_columns(similarity)))


def _shared(x: str, y: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(x), len(y))
    if x[:high] == y[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if x[low:middle] == y[low:middle]:
            low = middle
        else:
            high = middle
    return low


def _trim(x: str, y: str) -> tuple[str, str]:
    """Both without what they begin and end with alike: the edit distance stays."""
    n = _shared(x, y)
    x, y = x[n:], y[n:]
    n = _shared(x[::-1], y[::-1])
    return x[: len(x) - n], y[: len(y) - n]


def _bound(x: str, y: str, most: int, width: int = 8) -> int:
    """Not less than the edit distance: the edits of one way from x to y, which meets again at runs of ``width`` characters."""
    i = j = edits = 0
    while edits <= most:
        n = _shared(x[i : i + 64], y[j : j + 64])
        while n == 64:
            i, j = i + n, j + n
            n = _shared(x[i : i + 64], y[j : j + 64])
        i, j = i + n, j + n
        if i >= len(x) or j >= len(y):
            return edits + len(x) - i + len(y) - j
        for skip in range(0, most - edits + 1, 3):
            run = y[j + skip : j + skip + width]
            if len(run) < width:
                return edits + max(len(x) - i, len(y) - j)
            at = x.find(run, i + max(0, skip - 16), i + skip + 16 + width)
            if at >= 0:
                edits += max(at - i, skip)
                i, j = at, j + skip
                break
        else:
            return most + 1
    return edits


def _may_be_near(x: str, y: str, most: int, width: int = 3) -> bool:
    """False only if more than ``most`` edits lie between: each touches ``width`` runs at most, the others are shared."""
    need = max(len(x), len(y)) - width + 1 - width * most
    if need <= 0:
        return True
    a, b = (Counter(map("".join, zip(*(t[k:] for k in range(width))))) for t in (x, y))
    return sum((a & b).values()) >= need


PIECE, _AT_ONCE = 64, 4096  # characters of a piece, one bit each; pieces that are searched for at once
_HELD = 1 << 22  # characters of pairs that wait for their edit distances


def least_edits(xs: list[str], ys: list[str], mosts: np.ndarray) -> np.ndarray:
    """For each pair (x not empty) a number of edits that is not above the edit distance, if that is not above ``mosts``.

    Each x is cut into pieces of up to ``PIECE`` characters. A way of ``most`` edits that ends ``d`` places off its start is never more
    than (most - |d|) / 2 places off both, so it takes each piece to a part of y's window around it. The edits to the nearest part of
    the window, by bit vectors over the piece, add up to the bound. Characters are told apart by 64 classes: more agree, never fewer.
    """
    m, n = (np.fromiter(map(len, t), np.int64, len(t)) for t in (xs, ys))
    x, y = (np.frombuffer("".join(t).encode("utf-32-le", "surrogatepass"), np.uint32) for t in (xs, ys))
    x, y = (((c ^ (c >> np.uint32(6))) & np.uint32(63)).astype(np.int64) for c in (x, y))
    count = -(-m // PIECE)
    pair = np.repeat(np.arange(len(m)), count)
    number = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
    begin, end = m[pair] * number // count[pair], m[pair] * (number + 1) // count[pair]
    off = n - m
    spare = np.maximum(mosts - np.abs(off), 0) // 2
    first = np.maximum(0, begin + (np.minimum(off, 0) - spare)[pair])
    last = np.minimum(n[pair], end + (np.maximum(off, 0) + spare)[pair])
    steps = np.maximum(last - first, 0)
    from_x, from_y = (np.cumsum(m) - m)[pair] + begin, (np.cumsum(n) - n)[pair] + first
    size, best = end - begin, np.empty(len(pair), np.int64)
    order = np.argsort(-steps, kind="stable")
    for at in range(0, len(order), _AT_ONCE):
        own = order[at : at + _AT_ONCE]
        best[own] = _nearest(x, from_x[own], size[own], y, from_y[own], steps[own])
    return np.bincount(pair, best, len(m)).astype(np.int64)


def _nearest(x: np.ndarray, from_x: np.ndarray, size: np.ndarray, y: np.ndarray, from_y: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Edits from each piece of x to the nearest part of its window of y; windows in order of falling length."""
    rows = np.arange(len(size)) * 64
    equal = np.zeros(64 * len(size), np.uint64)  # by piece and class: the places of the class in the piece
    for k in range(int(size.max())):
        some = np.flatnonzero(size > k)
        equal[rows[some] + x[from_x[some] + k]] |= np.uint64(1 << k)
    one, top = np.uint64(1), (size - 1).astype(np.uint64)
    up, down = np.full(len(size), ~np.uint64(0)), np.zeros(len(size), np.uint64)
    score = size.copy()
    best = size.copy()
    lasting = np.searchsorted(-steps, -np.arange(int(steps.max(initial=0))), side="left")  # windows that are longer than so many steps
    for t, live in enumerate(lasting.tolist()):
        if live < len(up):
            up, down, score, top = up[:live], down[:live], score[:live], top[:live]
        same = equal[rows[:live] + y[from_y[:live] + t]]
        step = (((same & up) + up) ^ up) | same
        more = down | ~(step | up)
        less = up & step
        score += ((more >> top) & one).view(np.int64)
        score -= ((less >> top) & one).view(np.int64)
        more <<= one
        less <<= one
        flat = same | down
        up = less | ~(flat | more)
        down = more & flat
        np.minimum(best[:live], score, out=best[:live])
    return best


_WORDS = 1 << 20  # numbers of a table of the places of characters


def edit_distance(x: str, y: str) -> int:
    """By bit vectors over x (not empty), in whole numbers of any size."""
    at: dict[str, int] = {}
    for k, c in enumerate(x):
        at[c] = at.get(c, 0) | 1 << k
    full, top, score = (1 << len(x)) - 1, 1 << (len(x) - 1), len(x)
    up, down = full, 0
    for c in y:
        same = at.get(c, 0)
        step = (((same & up) + up) ^ up) | same | down
        more, less = down | (full & ~(step | up)), up & step
        score += 1 if more & top else -1 if less & top else 0
        more, less = (more << 1 | 1) & full, (less << 1) & full
        up, down = less | (full & ~(step | more)), more & step
    return score


def within_edits(xs: list[str], ys: list[str], mosts: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair (neither empty) is at most ``mosts``: exactly.

    Pairs whose bands take equally many 64-bit numbers go side by side; few and wide ones go one by one, without a band.
    """
    both = [(x, y) if len(x) >= len(y) else (y, x) for x, y in zip(xs, ys)]
    m, n = (np.fromiter((len(t[k]) for t in both), np.int64, len(both)) for k in (0, 1))
    out = m - n <= mosts
    side = np.maximum(mosts - (m - n), 0) // 2  # a way of ``most`` edits from corner to corner is never further off both
    width = -(-(m - n + 2 * side + 1) // 64)
    left = np.flatnonzero(out)
    left = left[np.lexsort((-n[left], width[left]))]
    while len(left):
        words, longest = int(width[left[0]]), int(m[left[0]])
        some = left[: max(1, _WORDS // (40 * (longest // 64 + words + 2)))]
        some = some[width[some] == words]
        left = left[len(some) :]
        x, y = ([both[k][i] for k in some.tolist()] for i in (0, 1))
        if len(some) < 24 * words:
            out[some] = np.fromiter(map(edit_distance, x, y), np.int64, len(some)) <= mosts[some]
        else:
            out[some] = _within_band(x, y, side[some], mosts[some], words)
    return out


def _within_band(xs: list[str], ys: list[str], side: np.ndarray, mosts: np.ndarray, words: int) -> np.ndarray:
    """``within_edits`` of pairs in order of falling lengths of y, none longer than its x; the band goes ``side`` diagonals past the last corner's.

    The band is a column of ``words`` numbers that moves one row down with each character of y. Its bits are the differences of
    neighbours in the column, and the score is that of the last corner's diagonal, which never falls.
    """
    m, n = (np.fromiter(map(len, t), np.int64, len(t)) for t in (xs, ys))
    x, y = (np.frombuffer("".join(t).encode("utf-32-le", "surrogatepass"), np.uint32) for t in (xs, ys))
    seen = np.zeros(int(max(x.max(), y.max())) + 1, bool)
    seen[x] = True
    number = np.cumsum(seen) * seen  # 0: in no x
    kinds = int(seen.sum()) + 1
    bit = 64 * words - 1 - side  # of the last corner's diagonal
    above = bit - (m - n)  # bits over the first row when y begins
    place = np.arange(len(x)) + np.repeat(above - (np.cumsum(m) - m), m)
    equal = np.zeros((max(int((above + m).max()), int(n.max())) // 64 + words + 2, len(m) * kinds), np.uint64)
    cell = (place >> 6) * equal.shape[1] + np.repeat(np.arange(len(m)) * kinds, m) + number[x]
    np.add.at(equal.reshape(-1), cell, np.uint64(1) << (place & 63).astype(np.uint64))  # each bit once
    y, start, own = number[y], np.cumsum(n) - n, np.arange(len(m)) * kinds
    one, last = np.uint64(1), np.uint64(63)
    empty = np.clip(above - 64 * np.arange(words)[:, None], 0, 64)
    up = np.where(empty > 63, np.uint64(0), ~np.uint64(0) << np.minimum(empty, 63).astype(np.uint64))
    down = np.zeros_like(up)
    live, score, out = np.arange(len(m)), m - n, np.zeros(len(m), bool)
    for t in range(int(n[0])):
        if t % 32 == 0 or n[live[-1]] <= t:
            ended = n[live] <= t
            out[live[ended]] = score[ended] <= mosts[live[ended]]
            stay = ~ended & (score <= mosts[live])
            live, score, up, down = live[stay], score[stay], up[:, stay], down[:, stay]
            if not len(live):
                break
            at, word, rest = np.arange(len(live)), bit[live] >> 6, (bit[live] & 63).astype(np.uint64)
        row = own[live] + y[start[live] + t]
        number_of, shift = divmod(t, 64)
        held = [equal[number_of + w][row] for w in range(words + (shift > 0))]
        carry = np.zeros(len(live), np.uint64)
        step, more, less = np.empty_like(up), np.empty_like(up), np.empty_like(up)
        for w in range(words):
            same = held[w] >> np.uint64(shift) | held[w + 1] << np.uint64(64 - shift) if shift else held[w]
            part = (same & up[w]) + up[w]
            total = part + carry
            carry = ((part < up[w]) | (total < part)).astype(np.uint64)
            step[w] = (total ^ up[w]) | same | down[w]
            more[w] = down[w] | ~(step[w] | up[w])
            less[w] = up[w] & step[w]
        score += 1 - (step[word, at] >> rest & one).view(np.int64)
        down_one = step >> one
        down_one[:-1] |= step[1:] << last
        up, down = less | ~(down_one | more), down_one & more
    out[live] = score <= mosts[live]
    return out


def similar_pairs(pairs: DataFrame, forms: DataFrame, similarity: float) -> DataFrame:
    """Those pairs whose normal forms (id, form) are alike enough.

    A pair for which one way with few enough edits is found at once, or none can be, needs no edit distance. The others wait
    until some hundreds to thousands are there, which are decided side by side.
    """

    names = pairs.columns

    def decided(held: list[tuple[pa.RecordBatch, list[tuple[str, str]], np.ndarray]]) -> Iterator[pa.RecordBatch]:
        cuts, most = [cut for h in held for cut in h[1]], np.concatenate([h[2] for h in held])
        near = least_edits([x for x, _ in cuts], [y for _, y in cuts], most) <= most
        near &= np.fromiter((max(map(len, cut)) >= PIECE or _may_be_near(*cut, own) for cut, own in zip(cuts, most.tolist())), bool, len(cuts))
        left = np.flatnonzero(near)
        cuts = [cuts[k] for k in left.tolist()]
        near[left] = within_edits([x for x, _ in cuts], [y for _, y in cuts], most[left])
        at = 0
        for rows, *_ in held:
            yield rows.filter(pa.array(near[at : at + rows.num_rows]))
            at += rows.num_rows

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            rows = batch.select(names)
            xs, ys = (batch.column(c).to_pylist() for c in "xy")
            longer = np.fromiter((max(len(x), len(y)) for x, y in zip(xs, ys)), np.int64, len(xs))
            most = np.floor(longer * (1 - similarity) + 1e-9).astype(np.int64)
            near, left, cuts = [], [], []  # alike for certain; neither that nor different in one place alone
            for k, (x, y, own) in enumerate(zip(xs, ys, most.tolist())):
                if abs(len(x) - len(y)) > own:
                    continue
                cut = _trim(x, y)
                if max(map(len, cut)) <= own or _bound(*cut, own) <= own:
                    near.append(k)
                elif min(map(len, cut)):
                    left.append(k)
                    cuts.append(cut)
            yield rows.take(pa.array(near, pa.int64()))
            held.append((rows.take(pa.array(left, pa.int64())), cuts, most[left]))
            size += sum(len(x) + len(y) for x, y in cuts)
            if size > _HELD:
                yield from decided(held)
                held, size = [], 0
        if held:
            yield from decided(held)

    both = pairs.join(forms.select(F.col("id").alias("a"), F.col("form").alias("x")), "a").join(forms.select(F.col("id").alias("b"), F.col("form").alias("y")), "b")
    return both.mapInArrow(alike, both.select(*names).schema)


def line_forms(ids: DataFrame, lines: DataFrame, docs: DataFrame) -> DataFrame:
    """id and normal form of the lines named by ``ids`` (distinct), from their first occurrences. A text is cut into lines once for all of its own."""

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            named, found = batch.column("named").to_pylist(), []
            for own, text in zip(named, batch.column("text").to_pylist()):
                raw = text.split("\n")
                found += [b" ".join(normal_lines(raw[x["line"]])[0]).decode("utf-8", "replace") for x in own]
            yield pa.RecordBatch.from_arrays([pa.array([x["id"] for x in chain.from_iterable(named)], pa.int64()), pa.array(found, pa.string())], names=["id", "form"])

    places = lines.join(ids, "id").select("id", "first.*").groupBy("doc_id", "th").agg(F.collect_list(F.struct("id", "line")).alias("named"))
    texts = docs.select(F.col("doc_id").alias("_doc"), F.col("th").alias("_th"), "text").where("text IS NOT NULL")
    found = places.join(texts, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th"))).select("named", "text")
    return found.mapInArrow(forms, "id long, form string").groupBy("id").agg(F.min("form").alias("form"))  # rows may repeat


def linked_lines(distinct: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """(id, component) of all lines of ``distinct`` (id, fp, more, keys, first) that have links."""
    met = stored(met_in_blocks(distinct, similarity), batch=10_000)
    ends = met.select(F.explode(F.when(F.col("kind") == PAIR, F.array("a", "b")).otherwise(F.array("a"))).alias("id")).distinct()
    forms = stored(line_forms(ends, distinct, docs))
    pairs = stored(first_pairs(met, similarity))
    groups = stored(components(similar_pairs(pairs, forms, similarity)).withColumnRenamed("node", "id"))
    for between in (pairs_between, all_pairs_between):  # centres first: they leave few groups for the rest
        rest = stored(between(met, groups, similarity).join(pairs, ["a", "b"], "left_anti"))
        if rest.limit(1).count():
            # what is left are links between groups: a small graph of its own
            links = components(similar_pairs(rest, forms, similarity).select("ga", "gb")).select(F.col("node").alias("group"), F.col("component").alias("joint"))
            grouped = distinct.select("id").join(groups, "id", "left").withColumn("group", F.coalesce("component", "id"))
            joined = grouped.join(links, "group", "left").where("component IS NOT NULL OR joint IS NOT NULL")
            groups = stored(joined.select("id", F.coalesce("joint", "group").alias("component")))
            pairs = pairs.unionByName(rest.select("a", "b"))
    return groups


def dedup_lines(docs: DataFrame, keep: tuple[str, ...] = (), similarity: float = 0.8) -> DataFrame:
    """The columns ``keep``, then text without repeated lines, n_lines and n_removed of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    first = [F.min(F.struct("doc_id", "th", "line")).alias("first"), F.count(F.lit(1)).alias("n"), F.any_value("more").alias("more"), F.any_value("keys").alias("keys")]
    with tidy_shuffles(docs.sparkSession):  # keys take most of the disk, and go when they have met
        whole = stored(fuzzy_lines(rows), keep=False)
        keyed = stored(whole.groupBy("id", "fp").agg(*first), keep=False)
        lines = stored(whole.select("doc_id", "th", "line", "id"))
        drop_stored(whole)
        linked = linked_lines(keyed, rows, similarity)
        distinct = stored(keyed.select("id", "first", "n").join(linked, "id", "left").where("n > 1 OR component IS NOT NULL"))
        drop_stored(keyed)
    total = lines.count()
    best = distinct.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("best"), F.count(F.lit(1)).alias("n"))
    grouped = join_hot(distinct.where("component IS NOT NULL").withColumnRenamed("n", "_n"), best, "component", total)
    several = grouped.select("id", "best", F.col("_n").alias("n")).unionByName(distinct.where("component IS NULL").select("id", F.col("first").alias("best"), "n"))
    several = several.select("id", F.col("best.doc_id").alias("_d"), F.col("best.th").alias("_t"), F.col("best.line").alias("_l"), "n")
    stays = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")) & (F.col("line") == F.col("_l"))
    gone = join_hot(lines, several, "id", total).where(~stays).select("doc_id", "th", "line").distinct()
    gone = gone.groupBy(F.struct("doc_id", "th").alias("_doc")).agg(F.array_sort(F.collect_list("line")).alias("_gone"))  # lines of one document
    own = docs.select(F.struct(F.lit(0), *(F.col(f"`{c}`") for c in keep)).alias("_keep"), F.col("text").cast("string").alias("text"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th")).alias("_doc"))
    parts = F.split("text", "\n")
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("_gone", i)), "\n"))
    joined = own.join(gone, "_doc", "left")
    n_lines = F.coalesce(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    kept = [F.col("_keep").getField(c).alias(c) if c != "text" else text.alias("text") for c in (keep if "text" in keep else (*keep, "text"))]
    counts = {"n_lines": n_lines.cast("long"), "n_removed": F.coalesce(F.size("_gone"), F.lit(0)).cast("long")}
    return joined.select(*kept, *(x.alias(name) for name, x in counts.items() if name not in keep))


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return found.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), "text")
