"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Carried, Words, mix64, only, steps, string_column

#: Feature space; the weights of one model are a broadcast of 4 bytes each.
BITS = 20
#: Labelled documents of each class that a model is fitted on, at most.
MOST_PER_LABEL = 6000
#: The step between sorted buckets that 16 bits don't hold any more.
WIDE = (1 << 16) - 1


def features(hashes: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of words, pairs of neighbours and pairs with one word between, repeats included."""
    row = np.repeat(np.arange(len(start) - 1), np.diff(start))
    rows, buckets = [row], [mix64(hashes)]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(hashes) > gap:
            same = row[gap:] == row[:-gap]
            rows.append(row[gap:][same])
            buckets.append(mix64(hashes[:-gap] * np.uint64(salt) + hashes[gap:])[same])
    return np.concatenate(rows), (np.concatenate(buckets) >> np.uint64(64 - BITS)).astype(np.int32)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int, id_col: str, **columns: str) -> tuple[DataFrame, dict[int, float]]:
    """(rows id, y and the named columns of docs, share of each class taken): at most about `most` rows a class, by a hash of the id.

    usable is a condition on the labels' id column, named as in docs. The sample of label rows is
    bounded by `most`, so it is broadcast and texts stay where they are.
    """
    known = only(labels.where(usable), id=id_col, y=label).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").cast("int").alias("y"))
    there = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    share = {y: min(1.0, most / n) for y, n in there.items()}
    cut = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    wanted = F.lit(False)
    for y, s in share.items():
        wanted = wanted | ((F.col("y") == y) & (cut < int(s * (1 << 20))))
    return only(docs, id=id_col, **columns).join(F.broadcast(known.where(wanted)), "id"), share


def packed(buckets: np.ndarray) -> bytes:
    """Sorted distinct numbers as 16-bit steps; a step of WIDE goes on without a number."""
    step = np.diff(buckets, prepend=0)
    wide, left = np.divmod(step, WIDE)
    out = np.full(len(step) + int(wide.sum()), WIDE, np.uint16)
    out[np.arange(len(step)) + np.cumsum(wide)] = left
    return out.tobytes()


def unpacked(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.int32)[steps < WIDE]


class Ftrl:
    """Per-coordinate FTRL-proximal for a logistic loss."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 12.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.full(len(z), self.l1)
        l1[-1] = 0  # the intercept stands last
        return np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, buckets: np.ndarray, y: int) -> None:
        at = np.append(buckets, 1 << BITS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def fit(self, rows: list[np.ndarray], ys: np.ndarray, use: np.ndarray, epochs: int) -> np.ndarray:
        rng = np.random.default_rng(7)
        for _ in range(epochs):
            for i in rng.permutation(use):
                self.learn(unpacked(rows[i]), ys[i])
        at = np.append(np.flatnonzero(np.abs(self.z[:-1]) > self.l1), 1 << BITS)
        out = np.zeros(len(self.z))
        out[at] = self.weights(at)
        return out


def best_cut(margins: np.ndarray, ys: np.ndarray, weight: np.ndarray, recall_weight: float) -> float:
    """The margin from which on label 1 is told so that the F measure, recall counted recall_weight times, is highest."""
    order = np.argsort(-margins, kind="stable")
    hit, told = np.cumsum((ys * weight)[order]), np.cumsum(weight[order])
    b = recall_weight**2
    at = int(((1 + b) * hit / (b * hit[-1] + told)).argmax())
    return float(margins[order[at : at + 2]].mean())


def train(docs: DataFrame, labels: DataFrame, label: str, usable: Column, epochs: int = 5, most: int = MOST_PER_LABEL, recall_weight: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights by bucket, the intercept last; most of them are 0.

    Fitted on at most about `most` labelled documents a class, taken by a hash of the id; their hashed
    features, not their texts, come to the driver. The intercept is moved back by the log of the classes' shares taken, so
    the prior is that of all labelled rows at every size. With recall_weight the intercept is moved on so that a
    score of 0.5 stands where the F measure of that weight is highest, as found on training rows alone: each third is
    judged by a model of the others. Without labelled rows, or with one class only, the weights are the class's prior alone.
    """
    sample, share = labelled_sample(docs, labels, label, usable, most, id_col, t=text_col)

    def run(batches):
        for batch in batches:
            texts, out = string_column(batch.column(1)), []
            for a, b in steps(texts):
                words = Words(texts.slice(a, b - a), ALNUM)
                row, bucket = features(words.hashes(), words.start)
                order = np.argsort(row, kind="stable")
                ends = np.searchsorted(row[order], np.arange(b - a + 1))
                bucket = bucket[order]
                out += [packed(np.unique(bucket[x:y])) for x, y in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["id", "y", "f"])

    kind = sample.select("id").schema[0].dataType.simpleString()
    rows = sample.select("id", "t", "y").mapInArrow(run, f"id {kind}, y int, f binary").toArrow()
    order = pc.sort_indices(rows, [("id", "ascending"), ("f", "ascending")]).to_numpy()
    ys, fs = rows["y"].to_numpy()[order], [np.frombuffer(f.as_buffer(), np.uint16) for f in rows["f"]]
    fs = [fs[i] for i in order]
    if len(share) < 2 or not 0 < ys.sum() < len(ys):
        w = np.zeros((1 << BITS) + 1)
        w[-1] = {(): 0.0, (0,): -4.0, (1,): 4.0}.get(tuple(share), 0.0)
        return w.astype(np.float32)
    w = Ftrl().fit(fs, ys, np.arange(len(ys)), epochs)
    moved = np.log(share[0] / share[1])  # odds in the sample are share[1] / share[0] times too high
    if recall_weight is not None:
        third, margins = np.arange(len(ys)) % 3, np.zeros(len(ys))
        for t in range(3):
            v = Ftrl().fit(fs, ys, np.flatnonzero(third != t), epochs)
            for i in np.flatnonzero(third == t):
                margins[i] = v[unpacked(fs[i])].sum() + v[-1]
        moved = -best_cut(margins, ys, np.where(ys == 1, 1 / share[1], 1 / share[0]), recall_weight)
    w[-1] += moved
    del rows, fs
    pa.default_memory_pool().release_unused()
    return w.astype(np.float32)


def toxicity(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """The rows of docs with score, the model's probability of label 1 for the whole text.

    A null, empty or wordless text gets the intercept's score. Repeated rows get equal scores; extra columns pass
    through, but for one named score, which is replaced; an empty table gives an empty result.
    """
    at = np.flatnonzero(weights)
    box = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), weights[at]))  # bounded by 2 ** BITS

    def run(batches):
        sparse, values = box.value
        dense = np.zeros((1 << BITS) + 1, np.float32)
        dense[sparse] = values
        for column in batches:
            texts, out = string_column(column), []
            for a, b in steps(texts):
                words = Words(texts.slice(a, b - a), ALNUM)
                row, bucket = features(words.hashes(), words.start)
                some = dense[bucket] != 0
                once = np.unique(row[some].astype(np.int64) << BITS | bucket[some])
                sums = np.bincount(once >> BITS, dense[once & (1 << BITS) - 1], b - a)
                out.append(1 / (1 + np.exp(-(sums + float(dense[-1])))))
            yield pa.array(np.concatenate(out) if out else np.zeros(0))

    score = F.arrow_udf(run, "double", F.ArrowUDFType.SCALAR_ITER)
    held = Carried(docs, "score")
    return held.rows.select(*held.back, score(held.col(text_col)).alias("score"))
