"""What several operators share: shared-folder tables, input clean-up and word hashing on Arrow buffers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Text bytes that one numpy step of a worker holds at a time.
STEP_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where none is named, a temporary one with a
    local master, which has only one machine; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.gettempdir() + "/orebase-intermediate"
    return base.rstrip("/")


def materialise(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write df to the shared folder, in folders by some columns, and read it again: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what materialise wrote for these tables, which nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns under our own names, so that extra columns of the input cannot clash."""
    return df.select(*[df[old].alias(new) for new, old in columns.items()])


class Carried:
    """A table under names of our own, so that no column of it can clash with ours; `back` gives its columns their names again.

    results: the names that the operator adds. An input column of such a name is replaced by the result.
    """

    def __init__(self, df: DataFrame, *results: str):
        taken = {r.lower() for r in results}
        self.names = {name: f"in{i}" for i, name in enumerate(df.columns)}
        self.rows = df.toDF(*self.names.values())
        self.back = [F.col(own).alias(name) for name, own in self.names.items() if name.lower() not in taken]

    def col(self, name: str) -> Column:
        return F.col(self.names[name])


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text falls in the given fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == fold


def narrow_side(df: DataFrame, max_rows: int) -> DataFrame:
    """df marked for broadcast if it has at most max_rows rows, else df unmarked: Spark then shuffles the join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def with_partners(pairs: DataFrame, heads: DataFrame, tails: DataFrame, per: int = 256) -> DataFrame:
    """Rows (a, b, text) of pairs (a, b): a head (b null) with the text of a, then up to `per` rows with the texts of its partners b.

    heads: (a, text), tails: (b, text), one row each; both ends of a pair are bigint. So a text with many
    partners is sent once for every `per` of them, and no task gets more than such a share of them at once.
    """
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / per).alias("shares"))
    pairs = pairs.join(shares, "a").select("a", F.pmod(F.xxhash64("b"), "shares").alias("share"), "b")
    first = pairs.select("a", "share").distinct().join(heads, "a").select("a", "share", F.lit(None).cast("bigint").alias("b"), "text")
    rows = first.union(pairs.join(tails, "b").select("a", "share", "b", "text"))
    return rows.repartition("a", "share").sortWithinPartitions("a", "share", F.asc_nulls_first("b")).select("a", "b", "text")


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, vectorised; uint64 in, uint64 out."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(word_bytes: np.ndarray, lower: bool = True) -> np.ndarray:
    """Maps each byte: those outside word_bytes become a space, A-Z become a-z."""
    table = np.full(256, 0x20, np.uint8)
    table[word_bytes] = np.arange(256, dtype=np.uint8)[word_bytes]
    if lower:
        upper = np.frombuffer(UPPER.encode(), np.uint8)
        table[upper] = np.where(word_bytes[upper] | word_bytes[upper + 32], upper + 32, 0x20)
    return table


def _bytes_where(accept) -> np.ndarray:
    return np.array([bool(accept(b)) for b in range(256)])


#: Words between ASCII white space.
SPACED = byte_table(_bytes_where(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D))
#: Words of ASCII letters, digits and anything beyond ASCII.
ALNUM = byte_table(_bytes_where(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80))


def string_column(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous large_string array, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def steps(texts: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `most` bytes each, one row at least."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(texts):
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield a, b
        a = b


class Words:
    """The words of a run of texts: codes into `distinct`, `start[i]:start[i + 1]` are those of text i."""

    def __init__(self, texts: pa.Array, table: np.ndarray):
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        clean = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(table[raw]))
        parts = pc.ascii_split_whitespace(clean)
        flat, ends = parts.values, np.asarray(parts.offsets)
        full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
        kept = np.concatenate([[0], np.cumsum(full)])
        self.start = kept[ends]
        coded = flat.filter(pa.array(full)).dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.distinct = coded.dictionary

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word occurrence."""
        return word_hashes(self.distinct)[self.codes]


def word_hashes(words: pa.Array) -> np.ndarray:
    if not len(words):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k items from each position on; positions less than k from the end are left out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(k))
    for j in range(k):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n])
    return out
