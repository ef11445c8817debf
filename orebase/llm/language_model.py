"""Text scores: a smoothed unigram baseline from all training documents and a log-bilinear neural model.

Every word whose count the tasks hold is a class of its own, all others share one. The two tokens
before a word predict its vector: each place has a weight per dimension. The classes are dealt into about as many
groups as a group has members, words with like neighbours together. The log-odds of a group and of a
class within its group are the products of the prediction with their vectors, plus biases. Both sets of scores are
trained with noise-contrastive estimation: each token against noise drawn from the unigram distribution of groups, and of
its own group's classes. At scoring, two batched matrix products give all groups' and all the group's classes'
scores of a token, so its probability is exactly normalised. The parameters grow with the
vocabulary. Before training, each class has its unigram probability. A word of the rest class gets
the class's probability times its smoothed share of it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACED, Words, materialise, only, steps, string_column, word_hashes

#: Numbers of a prediction, a bias beside them.
DIMS = 7
#: Most frequent words that every task holds with counts and vectors, at most; 80 bytes each. The others meet their counts in a join.
HELD_WORDS = 1 << 15
#: Tokens of one training step, and of one matrix product in scoring.
BATCH, PRODUCT = 1 << 10, 1 << 10
#: Noise groups for the tokens of a step, and noise classes for those of a group.
NOISE_GROUPS, NOISE_CLASSES = 24, 4
#: Adagrad's rate of the first round.
RATE = 0.1
#: Averaged rounds, each over its own share of the texts, and the tokens that one task learns from in a round.
ROUNDS, TASK_TOKENS = 3, 1 << 21
#: Parameter rows that tasks send together.
BLOCK = 256
#: Word hashes are 64 bits; no word hashes to this value's place in practice, it stands for the end of a text.
END = np.uint64(0xE0D0F0E0D0F0E0D1)
#: Text bytes that a task counts, or learns and scores, at a time.
COUNT_STEP, STEP = 12 << 20, 4 << 20


def _occurrences(texts: pa.Array, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, codes, start) of texts a to b with an end token after each text."""
    words = Words(texts.slice(a, b - a), SPACED)
    distinct = np.append(word_hashes(words.distinct), END)
    codes = np.insert(words.codes.astype(np.int64), words.start[1:], len(distinct) - 1)
    return distinct, codes, words.start + np.arange(b - a + 1)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c): the count of every word hash and of the end token over all texts (one column)."""

    def run(batches):
        for batch in batches:
            column = string_column(batch.column(0))
            for a, b in steps(column, COUNT_STEP):
                distinct, codes, _ = _occurrences(column, a, b)
                yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(np.bincount(codes, minlength=len(distinct)), pa.int64())], ["word", "c"])

    return texts.mapInArrow(run, "word bigint, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Counts of the corpus as far as every task needs them; `words` is sorted, `rank` gives each word's class."""

    words: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    total: int
    size: int
    unigram: np.ndarray
    rest_total: int
    rest_size: int
    least: int

    @classmethod
    def of(cls, counts: DataFrame) -> Vocabulary:
        whole = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
        # Words by eighths of a power of two of their count: the lowest count from which on at most HELD_WORDS words lie.
        by_size = counts.groupBy(F.floor(F.log2("c") * 8).alias("e")).agg(F.count("*").alias("words"), F.min("c").alias("least")).toPandas().sort_values("e", ascending=False)
        fits = by_size[by_size.words.cumsum() <= HELD_WORDS]
        least = int(fits.least.min()) if len(fits) else 1 << 62
        top = counts.where(F.col("c") >= least).toPandas().sort_values(["c", "word"], ascending=[False, True])  # bounded above
        words, c = top.word.to_numpy(np.int64).view(np.uint64), top.c.to_numpy(np.int64)
        total, size = int(whole.n or 0), int(whole.v or 0)
        rest = total - int(c.sum())
        order = np.argsort(words)
        return cls(words[order], c[order], np.arange(len(words), dtype=np.int32)[order], total, size, np.append(c, rest + 1) + 0.5, rest, size - len(words), least)

    def find(self, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, count) of word hashes; the count is -1 where the task doesn't hold it."""
        if not len(self.words):
            return np.full(len(distinct), self.rest, np.int32), np.full(len(distinct), -1)
        at = np.minimum(np.searchsorted(self.words, distinct), len(self.words) - 1)
        held = self.words[at] == distinct
        return np.where(held, self.classes[at], self.rest), np.where(held, self.counts[at], -1)

    def renumbered(self, order: np.ndarray) -> Vocabulary:
        """The same with classes in the given order; the rest class stays last."""
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        return replace(self, classes=place[self.classes], unigram=np.append(self.unigram[:-1][order], self.unigram[-1]))

    @property
    def rest(self) -> int:
        """The class of all words that the tasks don't hold."""
        return len(self.words)

    @property
    def end_class(self) -> int:
        return int(self.find(np.array([END]))[0][0])


def _contexts(classes: np.ndarray, start: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes one and two tokens before; before a text stand ends."""
    one, two = np.full(len(classes), end, np.int32), np.full(len(classes), end, np.int32)
    one[1:], two[2:] = classes[:-1], classes[:-2]
    first = start[:-1]
    one[first], two[first] = end, end
    two[np.minimum(first + 1, len(classes) - 1)[np.diff(start) > 1]] = end
    return one, two


def _in_order(keys: np.ndarray) -> np.ndarray:
    """Stable order of numbers from 0; those of 16 bits are sorted by digits."""
    return np.argsort(keys.astype(np.uint16) if len(keys) and keys.max() < 1 << 16 else keys, kind="stable")


def like_neighbours(vectors: np.ndarray) -> np.ndarray:
    """An order of rows in which like ones stand together: halves along the axis of most variance, and so on within halves."""
    out, open_ = [], [np.arange(len(vectors))]
    while open_:
        own = open_.pop()
        if len(own) <= 32:
            out.append(own)
            continue
        x = vectors[own] - vectors[own].mean(0)
        along = x @ np.linalg.eigh(x.T @ x)[1][:, -1]
        half = np.argsort(along, kind="stable")
        open_ += [own[half[len(own) // 2 :]], own[half[: len(own) // 2]]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.maximum(x, -60)))


def _summed(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, sum of their rows); keys are sorted."""
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(rows, first, 0)


class LogBilinear:
    """One matrix of parameters: context vectors of all classes, vectors and biases of all classes, those of groups, the weights of both places."""

    def __init__(self, unigram: np.ndarray, seed: int = 3):
        n = self.n = len(unigram)
        groups = max(1, round(n**0.5))
        self.bounds = np.linspace(0, n, groups + 1).astype(np.int64)
        self.group = np.repeat(np.arange(groups), np.diff(self.bounds))
        mass = np.add.reduceat(unigram, self.bounds[:-1])
        self.log_group, self.log_class = np.log(mass / mass.sum()).astype(np.float32), np.log(unigram / mass[self.group]).astype(np.float32)
        self.up_to = np.concatenate([[0], np.cumsum(unigram)])
        self.w = np.zeros((2 * n + groups + 2, DIMS + 1), np.float32)
        self.contexts, self.classes, self.groups, self.places = (slice(*x) for x in ((0, n), (n, 2 * n), (2 * n, 2 * n + groups), (2 * n + groups, 2 * n + groups + 2)))
        self.w[self.contexts, :DIMS] = np.random.default_rng(seed).normal(0, 0.3, (n, DIMS))
        self.w[self.classes, DIMS], self.w[self.groups, DIMS] = self.log_class, self.log_group
        self.w[self.places, :DIMS] = 1

    def _predicted(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context vectors of both places, prediction); the prediction ends in 1, which meets the biases."""
        r1, r2 = self.w.take(one, 0), self.w.take(two, 0)
        p1, p2 = self.w[self.places]
        h = r1 * p1 + r2 * p2
        h[:, DIMS] = 1
        return r1, r2, h

    def logs(self, word: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The natural log of each class's probability after its context."""
        out, order = np.zeros(len(word)), _in_order(word)
        all_groups, all_classes = np.ascontiguousarray(self.w[self.groups].T), self.w[self.classes]
        ones = np.ones(max(all_groups.shape[1], int(np.diff(self.bounds).max())), np.float32)
        far = np.sqrt(max((self.w[self.groups] ** 2).sum(1).max(), (all_classes**2).sum(1).max()))

        def log_share(scores: np.ndarray, own: np.ndarray, large: bool) -> np.ndarray:
            if large:  # only then can exp leave the range of a float
                scores -= scores.max(1)[:, None]
            picked = scores[np.arange(len(own)), own]
            return picked - np.log(np.exp(scores, out=scores) @ ones[: scores.shape[1]])

        for s in range(0, len(word), PRODUCT):
            at = order[s : s + PRODUCT]
            w, g = word[at], self.group[word[at]]
            h = self._predicted(one[at], two[at])[2]
            large = bool(np.sqrt((h * h).sum(1).max()) * far > 60)
            own = log_share(h @ all_groups, g, large).astype(float)
            edges = np.append(np.flatnonzero(np.diff(g, prepend=-1)), len(g))
            for a, b in zip(edges, edges[1:]):
                low, high = self.bounds[g[a]], self.bounds[g[a] + 1]
                own[a:b] += log_share(h[a:b] @ all_classes[low:high].T, w[a:b] - low, large)
            out[at] = own
        return out

    def train(self, stream, rate: float) -> np.ndarray:
        """One pass of noise-contrastive estimation with Adagrad over (word, one, two) steps; how often each row was met."""
        squares, met, rng = np.ones(len(self.w), np.float32), np.zeros(len(self.w), np.float32), np.random.default_rng(11)
        w, n, groups = self.w, self.n, len(self.bounds) - 1
        mass = np.exp(self.log_group.astype(float))
        mass /= mass.sum()
        off_group, off_class = np.log(np.float32(NOISE_GROUPS)) + self.log_group, np.log(np.float32(NOISE_CLASSES)) + self.log_class
        start, weight = self.up_to[self.bounds[:-1]], np.diff(self.up_to[self.bounds])
        all_groups, places = np.arange(self.groups.start, self.groups.stop), np.arange(self.places.start, self.places.stop)
        drawn_groups = iter(())

        for word, one, two in stream:
            order = _in_order(word)
            word, one, two = word[order], one[order], two[order]
            g = self.group[word]
            r1, r2, h = self._predicted(one, two)
            edges = np.flatnonzero(np.diff(g, prepend=-1))
            there = g[edges]

            u = w[self.groups]
            noise = next(drawn_groups, None)
            if noise is None:
                drawn_groups = iter(rng.choice(groups, (256, NOISE_GROUPS), p=mass))
                noise = next(drawn_groups)
            against = u[noise]
            p = _sigmoid(h @ against.T - off_group[noise])
            own = u[g]
            z = (_sigmoid(np.einsum("ij,ij->i", h, own) - off_group[g]) - 1)[:, None]
            d_h = p @ against + z * own
            d_u = np.zeros_like(u)
            d_u[there] = np.add.reduceat(z * h, edges, 0)
            np.add.at(d_u, noise, p.T @ h)

            own = w.take(n + word, 0)
            z = (_sigmoid(np.einsum("ij,ij->i", h, own) - off_class[word]) - 1)[:, None]
            d_h += z * own
            drawn = np.searchsorted(self.up_to, start[there][:, None] + rng.random((len(there), NOISE_CLASSES)) * weight[there][:, None], side="right") - 1
            drawn = np.clip(drawn, self.bounds[there][:, None], self.bounds[there + 1][:, None] - 1)
            mine = np.repeat(np.arange(len(there)), np.diff(np.append(edges, len(g))))
            against = w[n + drawn][mine]
            p = _sigmoid(np.einsum("ij,ikj->ik", h, against) - off_class[drawn][mine])
            d_h += np.einsum("ik,ikj->ij", p, against)
            d_n = np.add.reduceat(p[:, :, None] * h[:, None, :], edges, 0)

            d_h[:, DIMS] = 0
            p1, p2 = w[self.places].copy()
            d_p = np.stack([(d_h * r1).sum(0), (d_h * r2).sum(0)])
            rows = np.concatenate([one, two, n + word, n + drawn.ravel()])
            order = np.argsort(rows)
            rows, d = _summed(rows[order], np.concatenate([d_h * p1, d_h * p2, z * h, d_n.reshape(-1, DIMS + 1)])[order])
            rows, d = np.concatenate([rows, all_groups, places]), np.concatenate([d, d_u, d_p])
            squares[rows] += (d * d).mean(1)
            w[rows] -= d * (rate / np.sqrt(squares[rows]))[:, None]
            met[rows] += 1
        return met


def _blocks(rows: np.ndarray, met: np.ndarray, moved: np.ndarray):
    """A batch (block, places, met, moved) of rows in order, as bytes."""
    ends = np.flatnonzero(np.diff(rows // BLOCK, append=-1)) + 1
    out = [(int(rows[a] // BLOCK), (rows[a:b] % BLOCK).astype(np.uint8).tobytes(), met[a:b].astype(np.float32).tobytes(), moved[a:b].astype(np.float16).tobytes()) for a, b in zip([0, *ends[:-1]], ends)]
    block, *rest = zip(*out)
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), *[pa.array(x, pa.binary()) for x in rest]], ["block", "places", "met", "moved"])


def _averaged(batches):
    """Each row's mean over the tasks that met it, by how often they did."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, places, met, moved in zip(*[c.to_pylist() for c in batch.columns]):
            one = sums.setdefault(block, np.zeros((BLOCK, DIMS + 2)))
            at, n = np.frombuffer(places, np.uint8), np.frombuffer(met, np.float32)
            one[at, : DIMS + 1] += np.frombuffer(moved, np.float16).reshape(len(at), -1) * n[:, None].astype(float)
            one[at, DIMS + 1] += n
    for block, one in sums.items():
        mean = (one[:, : DIMS + 1] / np.maximum(one[:, DIMS + 1 :], 1e-9)).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([mean.tobytes()], pa.binary())], ["block", "mean"])


def _means(tasks: DataFrame, run, size: int) -> np.ndarray:
    """The rows' means over what run yields in the tasks; combined in tasks, so bounded by the rows for the driver."""
    moved = tasks.mapInArrow(run, "block int, places binary, met binary, moved binary")
    means, out = moved.repartition("block").mapInArrow(_averaged, "block int, mean binary").toArrow(), np.zeros((size, DIMS + 1), np.float32)
    for block, mean in zip(means["block"].to_pylist(), means["mean"]):
        at = slice(block * BLOCK, (block + 1) * BLOCK)
        out[at] = np.frombuffer(mean.as_buffer(), np.float32).reshape(BLOCK, -1)[: len(out[at])]
    return out


def _tokens(batches, v: Vocabulary):
    """(classes, one, two, start) of runs of texts."""
    for batch in batches:
        column = string_column(batch.column(0))
        for a, b in steps(column, STEP):
            distinct, codes, start = _occurrences(column, a, b)
            classes = v.find(distinct)[0][codes]
            yield (classes, *_contexts(classes, start, v.end_class), start)


def neighbour_vectors(classes: np.ndarray, one: np.ndarray, start: np.ndarray, end: int, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct classes, their counts, sums of the sign vectors of both neighbours)."""
    after = np.full(len(classes), end, np.int32)
    after[:-1] = classes[1:]
    after[start[1:] - 1] = end
    order = _in_order(classes)
    half = (DIMS + 1) // 2
    rows = np.concatenate([signs[one[order], :half], signs[after[order], half:]], 1)
    at, sums = _summed(classes[order], rows)
    return at, np.diff(np.append(np.flatnonzero(np.diff(classes[order], prepend=-1)), len(classes))), sums


def grouped(texts: DataFrame, vocabulary: Vocabulary) -> Vocabulary:
    """The vocabulary with its classes in an order by their neighbours: every neighbour adds a random sign vector of its own."""
    words = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        v = words.value
        signs = np.random.default_rng(17).choice(np.array([-1, 1], np.float32), (len(v.words) + 1, DIMS + 1))
        count, sums = np.zeros(len(v.words) + 1), np.zeros((len(v.words) + 1, DIMS + 1), np.float32)
        for classes, one, _, start in _tokens(batches, v):
            at, n, own = neighbour_vectors(classes, one, start, v.end_class, signs)
            count[at] += n
            sums[at] += own
        rows = np.flatnonzero(count)
        if len(rows):
            yield _blocks(rows, count[rows], sums[rows] / count[rows, None])

    vectors = _means(texts.select("text"), run, len(vocabulary.words) + 1)[:-1]
    return vocabulary.renumbered(like_neighbours(vectors))


def train_model(texts: DataFrame, vocabulary: Vocabulary) -> LogBilinear:
    """Trained in rounds on texts (key, text), each text in one round.

    In a round every task trains on about TASK_TOKENS tokens, dealt by key, from the same start; what the
    next round starts from are the rows' means over the tasks that met them. So the model depends on
    neither files nor splits.
    """
    model = LogBilinear(vocabulary.unigram)
    if model.n == 1 or not vocabulary.total:
        return model
    context = texts.sparkSession.sparkContext
    words = context.broadcast(vocabulary)
    parts = -(-vocabulary.total // (ROUNDS * TASK_TOKENS))
    for turn in range(ROUNDS):
        box = context.broadcast(model)

        def run(batches, box=box, rate=RATE / (1 + turn)):
            v, m = words.value, box.value
            before = m.w
            m.w = before.copy()

            def stream():
                for classes, one, two, _ in _tokens(batches, v):
                    order = np.random.default_rng(len(classes)).permutation(len(classes))
                    for s in range(0, len(classes), BATCH):
                        at = order[s : s + BATCH]
                        yield classes[at], one[at], two[at]

            met = m.train(stream(), rate)
            rows = np.flatnonzero(met)
            moved, m.w = m.w[rows] - before[rows], before  # the worker may run further tasks
            if len(rows):
                yield _blocks(rows, met[rows], moved)

        own = texts.where(F.pmod("key", F.lit(ROUNDS)) == turn).repartition(parts, "key").sortWithinPartitions("key").select("text")
        model.w += _means(own, run, len(model.w))
        box.unpersist()
    return model


def score_texts(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", learned: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words between ASCII white space, A-Z lower-cased, and one end per text. Counts and
    model come from the rows where `training` holds. base_score sums log10((c + 1) / (N + V + 1));
    score sums the model's log10 probabilities; with learned=False it is left out and no model is trained, the
    other columns come from the same steps. A null or empty text is its end alone. Rows
    that repeat are each counted and scored; other columns are ignored; an empty table gives an
    empty result, and without training rows N, V and every c are 0.
    """
    base = docs.select(F.xxhash64(docs[id_col], docs[text_col]).alias("key"), docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    learn = base.where("training").select("key", "text")
    counts = materialise(word_counts(learn.select("text")), "word_counts")
    vocabulary = Vocabulary.of(counts)
    if learned and len(vocabulary.words):
        vocabulary = grouped(learn, vocabulary)
    model = train_model(learn, vocabulary) if learned else None
    spark = docs.sparkSession
    box = spark.sparkContext.broadcast((vocabulary, model))
    ln10 = float(np.log(10))

    def run(batches):
        v, m = box.value
        for batch in batches:
            column, parts = string_column(batch.column(2)), []
            for a, b in steps(column, STEP):
                distinct, codes, start = _occurrences(column, a, b)
                kind, count = v.find(distinct)
                classes = kind[codes]
                logs = m.logs(classes, *_contexts(classes, start, v.end_class)) if m else np.zeros(len(codes))
                row = np.repeat(np.arange(b - a), np.diff(start))
                held = count >= 0
                own = np.where(held, np.log10(np.maximum(count, 0) + 1.0), 0.0)  # log10(c + 1)
                inner = np.where(kind == v.rest, own - np.log10(v.rest_total + v.rest_size + 1.0), 0.0)
                free = np.flatnonzero(~held[codes])
                ends = np.searchsorted(row[free], np.arange(b - a + 1))
                rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(distinct[codes[free]].view(np.int64)))
                sums = [np.bincount(row, x, b - a) for x in (own[codes], logs / ln10 + inner[codes])]
                parts.append((np.diff(start), np.bincount(row, held[codes], b - a).astype(np.int64), *sums, rare))
            n, known, one_sum, two_sum, rare = ([p[i] for p in parts] for i in range(5)) if parts else ([], [], [], [], [])
            join = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), join(n, pa.int64()), join(known, pa.int64()), join(one_sum, pa.float64()), join(two_sum, pa.float64()), pa.concat_arrays(rare) if rare else pa.array([], pa.list_(pa.int64()))],
                ["key", "doc_id", "n_tokens", "held", "own", "lm", "rare"],
            )

    kind = base.schema["doc_id"].dataType.simpleString()
    scored = materialise(base.select("key", "doc_id", "text").mapInArrow(run, f"key bigint, doc_id {kind}, n_tokens bigint, held bigint, own double, lm double, rare array<bigint>"), "scored")
    if vocabulary.size > len(vocabulary.words):  # some counts are not held by the tasks
        words = scored.dropDuplicates(["key"]).select("key", F.explode("rare").alias("word")).groupBy("key", "word").agg(F.count("*").alias("tf"))
        met = words.join(counts.where(F.col("c") < vocabulary.least), "word")
        rare = met.groupBy("key").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("add"))
        scored = scored.join(rare, "key", "left")
    else:
        scored = scored.withColumns({"more": F.lit(0), "add": F.lit(0.0)})
    add = F.coalesce("add", F.lit(0.0))
    whole = float(np.log10(vocabulary.total + vocabulary.size + 1))
    score = [(F.col("lm") + add).alias("score")] if learned else []
    return scored.select(
        "doc_id",
        "n_tokens",
        (F.col("held") + F.coalesce("more", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(vocabulary.total).cast("bigint").alias("train_tokens"),
        (F.col("own") + add - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        *score,
    )
