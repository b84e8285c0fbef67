"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's lower-cased letters, with one space for every run of anything else, give character n-grams; each n-gram is
hashed to a row of an embedding table, the rows are averaged, and a softmax over the mean names the language. Both are
trained by stochastic gradient descent in numpy on a bounded sample: at most ``per_language`` labelled rows of each
language, whole texts. A fifth of the sample is kept back to fit a temperature and a score below which a prediction is
marked as rejected, so that what is accepted is right with probability ``precision``.

Null texts and texts without letters are ``und`` with score 0; so is everything if nothing can be learned. Rows with a
null language are predicted, never learned from; so are rows with a null doc_id. Repeated rows are judged each. An empty
table gives no rows. Ties go to the language that sorts first. Long texts are read whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, slices, table

BUCKETS, GRAMS = 1 << 14, 3


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def bucket_counts(text: str, buckets: int = BUCKETS, grams: int = GRAMS) -> np.ndarray | None:
    """How often each bucket is hit by an n-gram of 1 to ``grams`` characters; None without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return None
    kept = np.where(_letters()[points], points, np.uint32(32))
    blank = kept == 32
    kept = kept[~(blank & np.append(True, blank[:-1]))]  # no blank first, and one for each run
    if not len(kept):
        return None
    kept = np.concatenate([np.array([32], np.uint32), kept, np.full(int(kept[-1] != 32), 32, np.uint32)])
    shift = np.uint32(32 - buckets.bit_length() + 1)
    total = np.zeros(buckets, np.int64)
    mixed = np.zeros(len(kept), np.uint32)
    for n in range(grams):
        mixed = (mixed[: len(kept) - n] ^ kept[n:]) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        total += np.bincount((mixed * np.uint32(0x85EBCA77)) >> shift, minlength=buckets)
    return total


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # buckets x languages: embeddings times output layer
    bias: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        logits = (counts @ self.weights / counts.sum() + self.bias) / self.temperature
        e = np.exp(logits - logits.max())
        return e / e.sum()


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(samples: list[tuple[np.ndarray, np.ndarray]], labels: list[str], buckets: int = BUCKETS, dims: int = 16, epochs: int = 12, rate: float = 40.0, precision: float = 0.995, seed: int = 7) -> LanguageModel | None:
    """``samples``: (bucket numbers, counts) of each text."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    target = np.array([languages.index(x) for x in labels])
    embed = rng.normal(0, 0.1, (buckets, dims)).astype(np.float32)
    out, bias = np.zeros((dims, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    order = rng.permutation(len(samples))
    held = order[: len(order) // 5] if len(order) >= 50 else order[:0]
    learn = order[len(held) :]

    def dense(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), buckets), np.float32)
        for k, r in enumerate(rows):
            ids, counts = samples[r]
            x[k, ids] = counts / counts.sum()
        return x

    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        rng.shuffle(learn)
        for at in range(0, len(learn), 32):
            rows = learn[at : at + 32]
            x = dense(rows)
            mean = x @ embed
            error = _softmax(mean @ out + bias)
            error[np.arange(len(rows)), target[rows]] -= 1
            error /= len(rows)
            back = error @ out.T
            out -= 0.1 * step * (mean.T @ error)
            bias -= 0.01 * step * error.sum(axis=0)
            used = np.flatnonzero(x.any(axis=0))
            embed[used] -= step * (x[:, used].T @ back)
    weights = (embed @ out).astype(np.float64)
    temperature, reject = 1.0, 0.0
    if len(held):
        logits = dense(held).astype(np.float64) @ weights + bias
        loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(held)), target[held]] + 1e-12).mean()
        temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
        p = _softmax(logits / temperature)
        best, right = p.max(axis=1), p.argmax(axis=1) == target[held]
        down = np.argsort(-best, kind="stable")
        share = np.cumsum(right[down]) / np.arange(1, len(down) + 1)
        fine = np.flatnonzero(share >= precision)
        reject = 0.0 if len(fine) and fine[-1] == len(down) - 1 else float(best[down[fine[-1]]]) if len(fine) else 1.0
    return LanguageModel(languages, weights, bias.astype(np.float64), temperature, reject)


def fit(docs: DataFrame, learn: Column, per_language: int = 1000, languages: int = 200) -> LanguageModel | None:
    """A model from rows where ``learn`` holds; the sample is drawn by a hash, evenly over all rows of a language.

    It knows the ``languages`` most frequent ones (of equally frequent ones those that sort first), so that what is collected
    has a fixed bound: 2 * per_language * languages rows, each of a bounded number of counts.
    """
    rows = pick(docs, doc_id="long", text="string", lang="string").where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not sizes:
        return None
    share = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, 1.2 * per_language / n)))))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    chosen = rows.withColumn("_place", place).where(F.col("_place") < share[F.col("lang")] * (1 << 30))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            out: list = []
            for lang, place, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "_place", "text"))):
                counts = bucket_counts(text)
                if counts is not None:
                    ids = np.flatnonzero(counts)
                    out.append((lang, place, ids.astype(np.int16 if BUCKETS <= 1 << 15 else np.int32), counts[ids].astype(np.float32)))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array([x.tobytes() for x in cols[2]], pa.binary()), pa.array([x.tobytes() for x in cols[3]], pa.binary())], names=["lang", "place", "ids", "counts"])

    found = chosen.mapInArrow(features, "lang string, place long, ids binary, counts binary").orderBy("place", "lang", "ids", "counts").limit(2 * per_language * len(sizes)).collect()
    taken: dict[str, int] = {}
    samples, labels = [], []
    for r in found:
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= per_language:
            samples.append((np.frombuffer(r["ids"], np.int16).astype(np.int64), np.frombuffer(r["counts"], np.float32)))
            labels.append(r["lang"])
    return train(samples, labels)


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred, score and rejected for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in slices(batches, "text"):
            names, scores, rejected = [], [], []
            for text in batch.column("text").to_pylist():
                counts = bucket_counts(text) if text and m else None
                if counts is None:
                    name, score = "und", 0.0
                else:
                    p = m.probabilities(counts)
                    name, score = m.languages[int(p.argmax())], float(p.max())
                names.append(name)
                scores.append(score)
                rejected.append(name == "und" or score < m.reject_below)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return pick(docs, doc_id="long", text="string").mapInArrow(judge, "doc_id long, lang_pred string, score double, rejected boolean")


def fold(doc_id: Column, parts: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(True))
    return predict(docs, fit(docs, ~held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
