"""Benchmark decontamination by winnowing.

Of every `gap` consecutive k-gram hashes the smallest is a fingerprint. Two texts that share
k + gap - 1 words share a window of hashes and hence its minimum, so every span of at least
`window` words is met when k + gap - 1 = window. Documents that share a fingerprint with an
item are then extended to all occurrences of the item's windows on the words themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Carried, Words, materialise, narrow_side, only, rolling, steps, string_column, with_partners

#: Benchmark fingerprints that a task may hold: 8 MB. With more, all document fingerprints go to the join.
HELD_FINGERPRINTS = 1_000_000
BROADCAST_IDS = 2_000_000


def winnow(hashes: np.ndarray, k: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(minima of each `gap` k-gram hashes, index of their first word), equal neighbours left out."""
    grams = rolling(hashes, k)
    n = len(grams) - gap + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    least = grams[:n].copy()
    for j in range(1, gap):
        np.minimum(least, grams[j : j + n], out=least)
    return least, np.arange(n)


def fingerprints(rows: DataFrame, window: int, k: int, short: list[int], whole_short: bool, held: np.ndarray | None = None) -> DataFrame:
    """(key, n_words, prints) for rows (key, text).

    short: lengths under `window` whose every gram is a fingerprint as well; whole_short: only a
    text of just that length gives it (items). held: keep only these, sorted; None keeps all.
    """
    gap = window - k + 1
    box = rows.sparkSession.sparkContext.broadcast(held) if held is not None else None

    def run(batches):
        for batch in batches:
            texts, counts, prints = string_column(batch.column(1)), [], []
            for a, b in steps(texts):
                words = Words(texts.slice(a, b - a), ALNUM)
                hashes, start = words.hashes(), words.start
                counts.append(words.counts)
                found = [(*winnow(hashes, k, gap), window)]
                found += [(g := rolling(hashes, m), np.arange(len(g)), m) for m in short]
                at, value = [], []
                for v, i, length in found:
                    row = np.searchsorted(start, i, side="right") - 1
                    ok = i + length <= start[row + 1] if len(i) else np.zeros(0, bool)
                    if whole_short and length < window and len(i):
                        ok &= words.counts[row] == length
                    if box is not None and len(v):
                        h = box.value
                        ok &= h[np.minimum(np.searchsorted(h, v), len(h) - 1)] == v if len(h) else False
                    elif len(v):
                        ok &= np.concatenate([[True], (v[1:] != v[:-1]) | (row[1:] != row[:-1])])
                    at.append(row[ok])
                    value.append(v[ok])
                at, value = np.concatenate(at), np.concatenate(value)
                order = np.argsort(at, kind="stable")
                ends = np.searchsorted(at[order], np.arange(b - a + 1))
                sorted_values = value[order].view(np.int64)
                prints.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sorted_values)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.concat_arrays(prints) if prints else pa.array([], pa.list_(pa.int64()))], ["key", "n_words", "prints"]
            )

    return rows.mapInArrow(run, "key bigint, n_words bigint, prints array<bigint>")


def _hit_spans(pairs: DataFrame, texts: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """(key, item_key, spans) of pairs with a hit; spans of word indices, end exclusive. texts: (key, text), items: (item_key, text)."""

    def run(batches):
        doc, grams = None, {}
        for batch in batches:
            texts, heads, spans = string_column(batch.column(2)), batch.column(1).is_null().to_pylist(), []
            for a, b in steps(texts):
                words = Words(texts.slice(a, b - a), ALNUM)
                hashes, start = words.hashes(), words.start
                for i in range(b - a):
                    own = hashes[start[i] : start[i + 1]]
                    spans.append(None)
                    if heads[a + i]:
                        doc, grams = own.copy(), {}
                        continue
                    w = min(window, len(own))
                    if w and w not in grams:
                        grams[w] = rolling(doc, w)
                    at = np.flatnonzero(np.isin(grams[w], rolling(own, w))) if w else np.zeros(0, np.int64)
                    if len(at):
                        new = np.flatnonzero(np.diff(at) > w)
                        spans[-1] = [{"s": int(s), "e": int(e) + w} for s, e in zip(at[np.r_[0, new + 1]], at[np.r_[new, len(at) - 1]])]
            kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind)], ["key", "item_key", "spans"])
            yield out.filter(pc.is_valid(out.column(2)))

    rows = with_partners(pairs.select(F.col("key").alias("a"), F.col("item_key").alias("b")), texts.withColumnRenamed("key", "a"), items.withColumnRenamed("item_key", "b"))
    return rows.mapInArrow(run, "key bigint, item_key bigint, spans array<struct<s:bigint,e:bigint>>")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 6, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs with n_words, n_hit, items (sorted item ids as strings), spans and contaminated.

    Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased.
    A window is `window` consecutive words of an item, or the whole item if it has fewer; a
    document word is hit when any occurrence of a window covers it. Null and empty texts have
    no words and no hits; items without words or with a null id match nothing; items that
    repeat an id count as one. Repeated rows of docs each get their result. Extra columns pass through, but
    for those named like a result, which are replaced; empty tables give empty results, an empty benchmark leaves every row clean.
    """
    key = F.xxhash64(docs[id_col], docs[text_col])
    rows = docs.select(key.alias("key"), docs[text_col].alias("text"))
    items = only(benchmark, item_id=item_col, text=item_text_col).where("item_id is not null and text is not null").withColumn("item_id", F.col("item_id").cast("string")).withColumn("key", F.xxhash64("item_id", "text"))
    own = materialise(fingerprints(items.select("key", "text"), window, k, list(range(1, window)), True), "item_prints")
    short = sorted(r.n_words for r in own.where(f"n_words between 1 and {window - 1}").select("n_words").distinct().collect())  # window - 1 values at most
    prints = own.select(F.col("key").alias("item_key"), F.explode("prints").alias("print")).distinct()
    some = prints.select("print").distinct().limit(HELD_FINGERPRINTS + 1)
    held = np.sort(np.asarray(some.toPandas()["print"], np.int64).view(np.uint64))  # limited above
    few = len(held) <= HELD_FINGERPRINTS
    met = materialise(fingerprints(rows, window, k, short, False, held if few else None), "document_prints")
    pairs = met.select("key", F.explode("prints").alias("print")).distinct().join(narrow_side(prints, HELD_FINGERPRINTS), "print").select("key", "item_key").distinct()
    pairs = materialise(pairs, "pairs")
    texts = rows.join(narrow_side(pairs.select("key").distinct(), BROADCAST_IDS), "key", "left_semi").dropDuplicates(["key"])
    item_texts = items.select(F.col("key").alias("item_key"), "item_id", "text").dropDuplicates(["item_key"])
    hits = _hit_spans(pairs, texts, item_texts.select("item_key", "text"), window).join(item_texts.select("item_key", "item_id"), "item_key")
    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    by_doc = hits.groupBy("key").agg(spans.alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))

    def covered(state, span):
        return F.struct(F.greatest(state["end"], span["e"]).alias("end"), (state["n"] + F.greatest(F.lit(0).cast("bigint"), span["e"] - F.greatest(state["end"], span["s"]))).alias("n"))

    by_doc = by_doc.withColumn("n_hit", F.aggregate("spans", start, covered, lambda s: s["n"]))
    counts = met.select("key", "n_words").dropDuplicates(["key"]).join(by_doc, "key", "left")
    held = Carried(docs, "n_words", "n_hit", "items", "spans", "contaminated")
    found = held.rows.withColumn("key", F.xxhash64(held.col(id_col), held.col(text_col))).join(counts, "key")
    return found.select(
        *held.back,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<s:bigint,e:bigint>>")).alias("spans"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
