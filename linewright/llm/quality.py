"""Quality classification by nearest-neighbour voting in a latent semantic space.

A text becomes counts of hashed features: n-grams over its runs of like characters (its shape, whatever the language),
character trigrams, and bins of how long and how repetitive it is. Weighted by inverse document frequency and projected on
the leading singular directions of a bounded labelled sample, it becomes a short vector. The sample's vectors are broadcast
(at most ``2 * per_label`` rows of ``DIMS`` numbers: a fixed bound), and each block of documents takes exact cosine products
with all of them; the nearest vote with their similarity, corrected for how often each label was drawn.

Null texts count as empty; an empty text has a vector (its length bin) and a score like any other. A labelled doc_id
that several rows have teaches with one of their texts, so copies crowd nothing out. Without labels every
score is 0.5. Labels that are null, or neither 0 nor 1, or without a document, teach nothing; a doc_id labelled more than
once counts once, with its smallest label. Repeated rows are scored each; ties between neighbours change no score, as all
of one similarity vote alike or the first in sample order stand. An empty table gives no rows. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, slices, table

SHAPE, LEXICAL, BINS = 2048, 2048, 32
FEATURES = SHAPE + LEXICAL + BINS
DIMS = 64


@cache
def _kinds() -> np.ndarray:
    """A number for each character: lower-case or uncased letter 1, upper-case letter 2, digit 3, blank 4, line end 5, others their own."""
    kinds = (np.arange(0x110000) % 4093 + 6).astype(np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            kinds[c] = 2 if s.isupper() else 1
        elif s.isdigit():
            kinds[c] = 3
        elif s.isspace():
            kinds[c] = 5 if s == "\n" else 4
    return kinds


def _hashed(symbols: np.ndarray, grams: range, bits: int) -> np.ndarray:
    total = np.zeros(1 << bits, np.int64)
    mixed = np.zeros(len(symbols), np.uint32)
    for n in range(grams.stop - 1):
        if n >= len(symbols):
            break
        mixed = (mixed[: len(symbols) - n] ^ symbols[n:]) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        if n + 1 >= grams.start:
            total += np.bincount((mixed * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits), minlength=1 << bits)
    return total


def features(text: str) -> np.ndarray:
    """Hashed counts, logged, each family of unit length."""
    out = np.zeros(FEATURES, np.float32)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kinds()[points]
    if len(points):
        begins = np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1]))
        runs = np.minimum(np.diff(begins, append=len(kinds)), 255).astype(np.uint32)
        letters = kinds[begins] <= 2
        size = np.where(letters, np.uint32(1) + (runs > 1), np.minimum(runs, np.uint32(4)))
        shape = np.log1p(_hashed(kinds[begins] * np.uint32(8) + size.astype(np.uint32), range(1, 4), 11))
        lexical = np.log1p(_hashed(points, range(3, 4), 11))
        out[:SHAPE] = shape / np.linalg.norm(shape)
        out[SHAPE : SHAPE + LEXICAL] = lexical / max(1e-9, np.linalg.norm(lexical))
    words = text.split()
    again = sum(map(eq, words, words[1:])) / max(1, len(words) - 1)
    fresh = len(set(words)) / max(1, len(words))
    bins = out[SHAPE + LEXICAL :]
    bins[min(11, int(np.log2(len(words) + 1)))] = 0.3
    bins[12 + min(7, int(np.ceil(again * 8)))] = 1.0
    bins[20 + min(11, int(fresh * 12))] = 0.3
    return out


@dataclass
class Voters:
    weight: np.ndarray  # of each feature
    project: np.ndarray  # features x dims
    vectors: np.ndarray  # unit vectors of the sample
    labels: np.ndarray
    worth: np.ndarray  # how many rows of the corpus each stands for
    prior: float
    nearest: int = 25
    sharpness: float = 8.0

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Votes for a block of feature rows."""
        vectors = unit((rows * self.weight) @ self.project)
        cosines = vectors @ self.vectors.T
        k = min(self.nearest, cosines.shape[1])
        best = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        near = np.clip(np.take_along_axis(cosines, best, 1), 0, 1).astype(np.float64)
        vote = near**self.sharpness * self.worth[best]
        doubt = 1e-3 * self.worth.mean()
        return (np.einsum("ij,ij->i", vote, self.labels[best]) + doubt * self.prior) / (vote.sum(axis=1) + doubt)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def leading_directions(x: np.ndarray, dims: int, seed: int = 11, rounds: int = 3) -> np.ndarray:
    """The right singular vectors of the largest singular values, by randomised subspace iteration."""
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(x.T @ rng.normal(size=(x.shape[0], min(dims + 10, *x.shape))).astype(np.float32))[0]
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, right = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ right.T)[:, :dims]


def fit(docs: DataFrame, labels: DataFrame, learn: Column, per_label: int = 1500) -> Voters | None:
    """From at most ``per_label`` documents of each label, drawn by a hash of their ids among rows where ``learn`` holds."""
    marked = pick(labels, doc_id="long", quality="int").where("doc_id IS NOT NULL AND quality IN (0, 1)").where(learn)
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sizes = {r["quality"]: r["n"] for r in marked.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = [r for q in sizes for r in marked.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label).collect()]
    if not drawn:
        return None
    sample = docs.sparkSession.createDataFrame([tuple(r) for r in drawn], "doc_id long, quality int")
    rows = pick(docs, doc_id="long", text="string").join(F.broadcast(sample), "doc_id")  # 2 * per_label ids

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            found = [features(t or "") for t in batch.column("text").to_pylist()]
            held = [np.flatnonzero(x) for x in found]
            ids, values = ([a.astype(np.int16).tobytes() for a in held], [x[a].astype(np.float16).tobytes() for x, a in zip(found, held)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(ids, pa.binary()), pa.array(values, pa.binary())], names=["doc_id", "quality", "ids", "vals"])

    found = rows.mapInArrow(extract, "doc_id long, quality int, ids binary, vals binary")
    found = found.groupBy("doc_id").agg(F.min(F.struct("quality", "ids", "vals")).alias("row")).select("row.*").orderBy("ids", "vals", "quality").collect()  # one row for each drawn id: 2 * per_label at most
    if not found:
        return None
    x = np.zeros((len(found), FEATURES), np.float32)
    for k, r in enumerate(found):
        x[k, np.frombuffer(r["ids"], np.int16)] = np.frombuffer(r["vals"], np.float16)
    y = np.array([r["quality"] for r in found], np.float64)
    seen = (x != 0).sum(axis=0)
    weight = (np.log((1 + len(x)) / (1 + seen)) + 0.1).astype(np.float32)
    weight[:SHAPE] *= 1.5
    weight[SHAPE + LEXICAL :] += 1.0
    x *= weight
    project = leading_directions(x, DIMS)
    got = {q: max(1, int((y == q).sum())) for q in sizes}
    worth = np.array([sizes[int(q)] / got[int(q)] for q in y])
    return Voters(weight, project, unit(x @ project), y, worth / worth.mean(), sizes.get(1, 0) / sum(sizes.values()))


def score(docs: DataFrame, voters: Voters | None, keep: tuple[str, ...] = ("doc_id",), block: int = 512) -> DataFrame:
    """The columns ``keep`` and the score of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(voters)
    kept = docs.select(*keep, F.col("text").cast("string").alias("_text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in slices(batches, "_text"):
            texts, found = batch.column("_text").to_pylist(), []
            for at in range(0, len(texts), block):
                part = texts[at : at + block]
                found.append(m.scores(np.stack([features(t or "") for t in part])) if m else np.full(len(part), 0.5))
            scores = np.clip(np.concatenate(found), 0, 1) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores, pa.float64())], names=[*keep, "score"])

    schema = kept.select(*keep).schema.add("score", "double")
    return kept.mapInArrow(judge, schema)


def learnable(doc_id: Column) -> Column:
    """Ids whose crc32 leaves 0, 1 or 3 by 4; null ids never."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    voters = fit(docs, labels, learnable(F.col("doc_id")))
    scored = score(pick(docs, doc_id="long", text="string"), voters)
    return scored.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
