"""Quality by a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Carried, Words, mix64, steps, string_column
from .toxicity import labelled_sample

BITS, RANK = 15, 8
MOST_PER_LABEL = 3000
#: Structure statistics of a text, in this order; one metadata statistic per named column follows.
STATISTICS = ("bytes", "words", "upper", "digits", "signs", "blanks", "lines", "bars", "beyond_ascii", "word_bytes", "distinct", "repeats")


def _byte_kinds() -> np.ndarray:
    kinds = np.zeros(256, np.int64)  # 0: lower-case letters and what is named below nowhere
    for i, chars in enumerate((range(0x41, 0x5B), range(0x30, 0x3A), [*range(0x21, 0x30), *range(0x3A, 0x41)], [0x20, 0x09], [0x0A, 0x0D], [0x7C], range(0x80, 0x100))):
        kinds[list(chars)] = i + 1
    return kinds


_KINDS = _byte_kinds()


def statistics(texts: pa.Array, words: Words) -> np.ndarray:
    """One row of STATISTICS per text, each on a bounded scale."""
    n = len(texts)
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer("".join(texts.to_pylist()).encode(), np.uint8)
    kinds = np.bincount(np.repeat(np.arange(n) * 8, size) + _KINDS[raw], minlength=8 * n).reshape(n, 8)[:, 1:]
    count = words.counts
    row = np.repeat(np.arange(n), count)
    distinct = np.bincount(np.unique(row * max(1, len(words.distinct)) + words.codes) // max(1, len(words.distinct)), minlength=n) if len(row) else np.zeros(n)
    again = np.bincount(row[1:][(words.codes[1:] == words.codes[:-1]) & (row[1:] == row[:-1])], minlength=n) if len(row) > 1 else np.zeros(n)
    letters = np.bincount(row, pc.binary_length(words.distinct).to_numpy(zero_copy_only=False)[words.codes], n) if len(row) else np.zeros(n)
    per, each = np.maximum(size, 1)[:, None], np.maximum(count, 1)
    return np.column_stack([np.log1p(size), np.log1p(count), np.sqrt(kinds / per), np.log1p(letters / each), distinct / each, again / each])


class FactorisationMachine:
    """w0 + w.x + sum over pairs <v_i, v_j> x_i x_j; every word occurrence is a feature of value 1 / words."""

    def __init__(self, extra: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        size = (1 << BITS) + extra
        self.w, self.v = np.zeros(size), rng.normal(0, 0.05, (size, RANK))
        self.w0, self.mean, self.scale = 0.0, np.zeros(extra), np.ones(extra)

    def margin(self, buckets: np.ndarray, start: np.ndarray, stats: np.ndarray) -> np.ndarray:
        """Linear in the features: the pairs are half of (sum v x)^2 - sum (v x)^2."""
        n, base = len(start) - 1, 1 << BITS
        x = np.clip((stats - self.mean) / self.scale, -5, 5)
        words = np.diff(start)
        row, value = np.repeat(np.arange(n), words), np.repeat(1 / np.maximum(words, 1), words)
        linear = self.w0 + x @ self.w[base:] + np.bincount(row, self.w[buckets] * value, n)
        sums, squares = x @ self.v[base:], (x**2) @ (self.v[base:] ** 2)
        for f in range(RANK):
            vx = self.v[:base, f][buckets] * value
            sums[:, f] += np.bincount(row, vx, n)
            squares[:, f] += np.bincount(row, vx * vx, n)
        return linear + 0.5 * (sums**2 - squares).sum(1)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], ys: np.ndarray, weight: dict[int, float], epochs: int, rate: float = 0.05, decay: float = 1e-4) -> None:
        """Adagrad on the logistic loss; rows: (buckets, statistics)."""
        stats = np.stack([s for _, s in rows])
        self.mean, self.scale = stats.mean(0), np.maximum(stats.std(0), 1e-3)
        x_all = np.clip((stats - self.mean) / self.scale, -5, 5)
        base = 1 << BITS
        g_w, g_v, g_0 = np.full(len(self.w), 1e-2), np.full(self.v.shape, 1e-2), 1e-2
        rng = np.random.default_rng(5)
        tail = np.arange(base, len(self.w))
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                bucket, times = np.unique(rows[i][0], return_counts=True)
                total = max(1, times.sum())
                at = np.concatenate([bucket, tail])
                x = np.concatenate([times / total, x_all[i]])
                own = np.concatenate([times / total**2, x_all[i] ** 2])  # sum of x^2 over a feature's occurrences
                v = self.v[at]
                s = x @ v
                z = self.w0 + self.w[at] @ x + 0.5 * (s @ s - (own @ (v * v)).sum())
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - ys[i]) * weight[ys[i]]
                d_w, d_v = g * x + decay * self.w[at], g * (x[:, None] * s - own[:, None] * v) + decay * v
                g_w[at] += d_w**2
                g_v[at] += d_v**2
                g_0 += g * g
                self.w[at] -= rate * d_w / np.sqrt(g_w[at])
                self.v[at] -= rate * d_v / np.sqrt(g_v[at])
                self.w0 -= rate * g / np.sqrt(g_0)


def _columns(texts: pa.Array, metadata: np.ndarray):
    """(buckets, start, statistics) of each run of texts."""
    for a, b in steps(texts):
        part = texts.slice(a, b - a)
        words = Words(part, ALNUM)
        buckets = (mix64(words.hashes()) >> np.uint64(64 - BITS)).astype(np.int64)
        yield buckets, words.start, np.column_stack([statistics(part, words), np.log1p(np.maximum(metadata[a:b], 0))])


def _numbers(columns: list[pa.Array], n: int) -> np.ndarray:
    return np.column_stack([np.nan_to_num(pc.fill_null(c.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)) for c in columns]) if columns else np.zeros((n, 0))


def train(docs: DataFrame, labels: DataFrame, label: str, usable: Column, metadata: tuple[str, ...] = (), epochs: int = 6, most: int = MOST_PER_LABEL, id_col: str = "doc_id", text_col: str = "text") -> FactorisationMachine:
    """Fitted on at most about `most` labelled documents a class, taken by a hash of the id, weighted back to all labelled rows' shares.

    metadata: numeric columns of docs, null as 0. Without labelled rows of both classes the machine gives the prior alone.
    """
    columns = {f"m{i}": m for i, m in enumerate(metadata)}
    sample, share = labelled_sample(docs, labels, label, usable, most, id_col, t=text_col, **columns)
    machine = FactorisationMachine(len(STATISTICS) + len(metadata))
    if len(share) < 2:
        machine.v[:], machine.w0 = 0, {(): 0.0, (0,): -4.0, (1,): 4.0}[tuple(share)]
        return machine

    def run(batches):
        for batch in batches:
            texts, out = string_column(batch.column(1)), []
            for buckets, start, stats in _columns(texts, _numbers(batch.columns[3:], len(texts))):
                out += [(buckets[a:b].astype(np.int32).tobytes(), s.tobytes()) for a, b, s in zip(start, start[1:], stats)]
            f, s = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(f, pa.binary()), pa.array(s, pa.binary())], ["id", "y", "f", "s"])

    kind = sample.select("id").schema[0].dataType.simpleString()
    rows = sample.select("id", "t", "y", *[F.col(m).cast("double").alias(m) for m in columns])
    rows = rows.mapInArrow(run, f"id {kind}, y int, f binary, s binary").toPandas().sort_values(["id", "f"])
    small = min(share.values())
    machine.fit([(np.frombuffer(f, np.int32), np.frombuffer(s)) for f, s in zip(rows.f, rows.s)], rows.y.to_numpy(), {y: small / s for y, s in share.items()}, epochs)
    return machine


def quality(docs: DataFrame, machine: FactorisationMachine, metadata: tuple[str, ...] = (), text_col: str = "text") -> DataFrame:
    """The rows of docs with score, the machine's probability of label 1 for the whole text.

    A null or empty text has statistics of zero and no words; null metadata count as 0. Repeated rows get equal
    scores; extra columns pass through, but for one named score, which is replaced; an empty table gives an empty result.
    """
    box = docs.sparkSession.sparkContext.broadcast(machine)  # 2 ** BITS rows of RANK + 1 numbers

    def run(batches):
        for columns in batches:
            text, *meta = columns if isinstance(columns, tuple) else (columns,)
            texts, out = string_column(pa.array(text, pa.large_string(), from_pandas=True)), []
            for buckets, start, stats in _columns(texts, _numbers([pa.array(m, pa.float64(), from_pandas=True) for m in meta], len(texts))):
                out.append(1 / (1 + np.exp(-np.clip(box.value.margin(buckets, start, stats), -50, 50))))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    score = F.pandas_udf(run, "double", F.PandasUDFType.SCALAR_ITER)
    held = Carried(docs, "score")
    return held.rows.select(*held.back, score(F.coalesce(held.col(text_col), F.lit("")), *[held.col(m).cast("double") for m in metadata]).alias("score"))
