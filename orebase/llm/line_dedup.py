"""Repeated lines across documents, found with levelled sorted runs of line hashes. DataFrame functions only."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Carried, ascii_lower, discard, materialise, only, shared_dir

BLANKS = " \t\n\x0b\x0c\r"
#: Parts that a very common line's holders are dealt into.
SALTS = 8


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def key_hash(key: Column) -> Column:
    """128 bits of a line's key."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


class LineRuns:
    """Sorted runs of line hashes, in levels of up to `fanout` runs each. A hash is in one run only.

    Batches (doc_id, h1, h2) come in falling order of ids. A batch is merged against the runs: hashes that
    no run holds are its own new run, with the number of its documents and the largest id (`last`), which no
    later batch can exceed. Its other hashes were met before and only add documents; they are kept apart as
    repeats. A level with more than `fanout` runs is compacted into one run of the next.

    Runs and batches are tables in `buckets` buckets by hash, each sorted, so merging them needs no exchange.
    """

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = 2):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.repeats: list[DataFrame] = []

    def _table(self, rows: DataFrame, name: str) -> DataFrame:
        name = f"{name}_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{name}"
        rows.repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        out = self.spark.table(name)
        out.written_at, out.table_name = path, name
        return out

    def _drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self.spark.sql(f"DROP TABLE {t.table_name}")
        discard(*tables)

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The rows (h1, h2, ...) of a batch whose hash no run holds."""
        runs = [run for level in self.levels for run in level]
        return reduce(lambda rows, run: rows.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti"), runs, batch)

    def add(self, batch: DataFrame) -> None:
        own = self._table(batch.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last")), "batch")
        fresh = self._table(self.unseen(own), "run")
        repeats = own.join(fresh.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti").select("h1", "h2", "docs")
        self.repeats.append(materialise(repeats, "repeats"))
        self._drop(own)
        self.levels[0].append(fresh)
        for i, level in enumerate(self.levels):
            if len(level) > self.fanout:
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(self._table(reduce(DataFrame.union, level), "run"))
                self._drop(*level)
                level.clear()

    def common(self, min_docs: int) -> DataFrame:
        """(h1, h2, last) of every hash in at least min_docs documents; the runs go."""
        more = reduce(DataFrame.union, self.repeats).groupBy("h1", "h2").agg(F.sum("docs").alias("more"))
        runs = [run for level in self.levels for run in level]
        enough = F.col("docs") + F.coalesce("more", F.lit(0)) >= min_docs
        out = materialise(reduce(DataFrame.union, runs).join(more, ["h1", "h2"], "left").where(enough).select("h1", "h2", "last"), "common_lines")
        self._drop(*runs)
        discard(*self.repeats)
        return out


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int | None = None, fanout: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with every column, and n_lines, n_dropped and kept_text per row.

    A text is split at line feeds; a line's key is the line without ASCII white space at both
    ends, A-Z lower-cased. Lines whose key has at least min_chars code points and occurs in at
    least min_docs documents are dropped, except in the row (or rows) with the largest id that holds
    them. A null or empty text is one empty line and stays an empty text. Ids are integers. Rows that repeat an id
    count as one document. Rows with a null id neither count nor lose lines. Extra columns pass through
    unchanged, but for those named like a result, which are replaced; an empty table gives an empty result.

    batches: how many the documents are dealt into by id; by default their number grows with the
    logarithm of the documents, so that all merging together is n log n.
    """
    spark = docs.sparkSession
    base = only(docs, doc_id=id_col, text=text_col).where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    number = base.count()
    batches = batches or 4 + (number >> 16).bit_length()
    cuts = base.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("q")).first().q or [] if batches > 1 else []
    batch = reduce(lambda n, cut: n + (F.col("doc_id") <= cut).cast("int"), sorted(set(cuts)), F.lit(0))  # 0 holds the largest ids
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    long_keys = F.filter(F.transform(lines, line_key), lambda k: F.length(k) >= min_chars)
    posts = base.select("doc_id", F.explode(F.array_distinct(F.transform(long_keys, key_hash))).alias("h"))
    posts = materialise(posts.select("doc_id", "h.h1", "h.h2", batch.alias("batch")).distinct(), "line_posts", by=("batch",))
    runs = LineRuns(spark, max(int(spark.conf.get("spark.sql.shuffle.partitions")), number >> 20), fanout)
    for i in range(len(set(cuts)) + 1):
        runs.add(posts.where(F.col("batch") == i))
    # A very common line is one row here and may be a large part of the posts: both sides are salted.
    common = runs.common(min_docs).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    drops = posts.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(common, ["h1", "h2", "salt"]).where("doc_id <> last")
    drops = drops.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("drops"))
    held = Carried(docs, "n_lines", "n_dropped", "kept_text")
    out = held.rows.withColumn("doc_id", held.col(id_col).cast("bigint")).join(drops, "doc_id", "left")
    lines = F.split(F.coalesce(held.col(text_col), F.lit("")), "\n", -1)
    stays = F.filter(lines, lambda x: (F.length(F.trim(x, F.lit(BLANKS))) < min_chars) | ~F.array_contains(F.col("drops"), key_hash(line_key(x))))
    kept = F.when(F.col("drops").isNull(), lines).otherwise(stays)
    out = out.withColumns({"lines": lines, "kept": kept})
    return out.select(*held.back, F.size("lines").cast("bigint").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("bigint").alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text"))
