"""Near-duplicate documents: a signature-coordinate inverted join over MinHash values.

Every distinct shingle set is a class with one signature of `coordinates` minima; everything up to
the components works on classes, whatever doc_ids hold them. A class is posted under its
(coordinate, value) pairs, the rarest first. Two sets whose signatures agree in at least
`matches` places share one of their `coordinates - matches + 1` rarest postings (prefix), so the
frequent rest is never merged (skip). Pairs that meet in a posting are counted on the whole
signature, kept from `matches` agreements on, and confirmed on the full shingle sets.

A posting list never becomes all of its pairs: first every member is compared only with the list's
central member, whose values are the most frequent. Then members that still lie in different
components are compared, block against block in long lists, but for the members of a list's
largest component among each other; only links that join components come out. A true link is lost
only where two sets of at least the wanted similarity agree in fewer than `matches` coordinates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, Words, discard, materialise, mix64, narrow_side, only, rolling, steps, string_column, with_partners
from .components import components

#: Rows of three numbers that a join may broadcast: 12 MB.
BROADCAST_ROWS = 500_000
#: Members of a posting list that one task compares at once.
BLOCK = 1024
#: Members of a posting list that are paired in a join.
SHORT = 16


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct k-word shingles as 64-bit hashes; fewer words count as one shingle."""
    for a, b in steps(texts):
        words = Words(texts.slice(a, b - a), SPACED)
        hashes, start = words.hashes(), words.start
        rolled = rolling(hashes, k)
        for i in range(b - a):
            n = start[i + 1] - start[i]
            if n >= k:
                yield np.unique(rolled[start[i] : start[i + 1] - k + 1])
            else:
                yield rolling(hashes[start[i] : start[i + 1]], n) if n else np.zeros(0, np.uint64)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return bool(common) and 100 * common >= percent * (len(x) + len(y) - common)


def signature(shingles: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    out = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 8192):
        y = x[a : a + 8192, None] * factors + terms
        y ^= y >> np.uint32(15)
        np.minimum(out, (y * np.uint32(0x2C1B3C6D)).min(0), out=out)
    return out.view(np.int32)


def signatures(docs: DataFrame, k: int, coordinates: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, print, n, h1, h2, sig) per document; print: hash of the text, n: distinct shingles, h1 and h2 identify the set."""
    rng = np.random.default_rng(20240501)
    factors = rng.integers(1, 1 << 31, coordinates, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    terms = rng.integers(0, 1 << 32, coordinates, dtype=np.uint64).astype(np.uint32)

    def run(batches):
        for batch in batches:
            rows = []
            for s in shingle_sets(string_column(batch.column(2)), k):
                rows.append((len(s), s.sum(dtype=np.uint64).view(np.int64), np.bitwise_xor.reduce(mix64(s ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64), signature(s, factors, terms) if len(s) else None))
            n, h1, h2, sig = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.list_(pa.int32()))], ["id", "print", "n", "h1", "h2", "sig"])

    rows = only(docs, id=id_col, text=text_col).select("id", F.xxhash64("text").alias("print"), "text")
    return rows.mapInArrow(run, "id bigint, print bigint, n bigint, h1 bigint, h2 bigint, sig array<int>")


def _confirmed(pairs: DataFrame, sets: DataFrame, texts: DataFrame, k: int, percent: int, matches: int) -> DataFrame:
    """The pairs (a, b) that agree in enough coordinates and whose full sets are similar enough.

    Only texts of pairs with enough agreements are joined.
    """
    one = sets.select(F.col("c").alias("a"), F.col("sig").alias("sig_a"))
    two = sets.select(F.col("c").alias("b"), F.col("sig").alias("sig_b"))
    agreed = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    near = materialise(pairs.join(one, "a").join(two, "b").where(agreed >= matches).select("a", "b"), "near")
    def run(batches):
        own = None
        for batch in batches:
            a, b, good = batch.column(0), batch.column(1), []
            heads = b.is_null().to_pylist()
            for head, x in zip(heads, shingle_sets(string_column(batch.column(2)), k), strict=True):
                if head:
                    own = x
                good.append(not head and similar(own, x, percent))
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    rows = with_partners(near, texts.withColumnRenamed("c", "a"), texts.withColumnRenamed("c", "b"))
    return rows.mapInArrow(run, "a bigint, b bigint")


def _mixed(posts: DataFrame, joined: DataFrame) -> DataFrame:
    """The posts (coord, val, c, n, g, size) of lists whose members lie in different components g."""
    placed = posts.join(joined, "c", "left").select("coord", "val", "c", "n", F.coalesce("found", "c").alias("g"))
    lists = placed.groupBy("coord", "val").agg(F.count("*").alias("size"), F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 <> g1").select("coord", "val", "size")
    return materialise(placed.join(lists, ["coord", "val"]), "mixed")


def _short_pairs(mixed: DataFrame, percent: int) -> DataFrame:
    """All pairs of a short list's members that lie in different components and may be similar by size."""
    sizes_near = F.expr(f"100 * least(n, n2) >= {percent} * greatest(n, n2)")
    few = mixed.where(f"size <= {SHORT}")
    other = few.select("coord", "val", F.col("c").alias("c2"), F.col("n").alias("n2"), F.col("g").alias("g2"))
    return few.join(other, ["coord", "val"]).where((F.col("c") < F.col("c2")) & (F.col("g") != F.col("g2")) & sizes_near).select(F.col("c").alias("a"), F.col("c2").alias("b")).distinct()


def _blocked(mixed: DataFrame) -> DataFrame:
    """Members of long lists once per pair of blocks (lo, hi) that they are compared in.

    A list's largest component is one side, all others the other. Blocks of others meet each other and
    those of the largest component, which never meet among themselves: they are joined already. A block of others is compared
    with itself where it meets the first block of the largest component. So a list with few strangers sends each member once.
    """
    long = mixed.where(f"size > {SHORT}")
    sizes = long.groupBy("coord", "val", "g").agg(F.count("*").alias("own"))
    largest = sizes.groupBy("coord", "val").agg(F.max(F.struct("own", "g")).alias("top")).select("coord", "val", F.col("top.g").alias("main"), F.col("top.own").alias("most"))
    rest = F.col("size") - F.col("most")
    # The fewer the others, the larger a block of the largest component can be.
    mains = F.ceil(F.greatest(F.col("most") * F.least(rest, F.lit(BLOCK)) / F.lit(BLOCK * BLOCK), F.col("most") / F.lit(2 * BLOCK))).cast("int")
    long = long.join(largest, ["coord", "val"]).withColumns({"mains": mains, "others": F.ceil(rest / F.lit(BLOCK)).cast("int")})
    in_main = F.col("g") == F.col("main")
    # Blocks of others count from 0, those of the largest component from -1 downwards.
    block = F.when(in_main, -1 - F.pmod(F.xxhash64("c"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("c"), F.col("others"))).cast("int")
    partners = F.when(in_main, F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.filter(F.sequence(-F.col("mains"), F.col("others") - 1), lambda p: p != F.col("block")))
    long = long.withColumn("block", block).withColumn("partner", F.explode(partners))
    return long.select("coord", "val", "c", "n", "g", "block", F.least("block", "partner").alias("lo"), F.greatest("block", "partner").alias("hi"))


def _long_links(mixed: DataFrame, own: DataFrame, sets: DataFrame, texts: DataFrame, k: int, percent: int, matches: int, coordinates: int) -> DataFrame:
    """Links (a, b) that join what the members of long lists can be joined to, found block against block.

    A block holds about BLOCK members, of the largest component up to twice as many. Pairs are counted on whole signatures and confirmed on
    whole texts inside the task; a pair whose ends are joined already is passed over.
    """
    long = _blocked(mixed)
    counts = F.map_from_entries(F.transform("t", lambda x: F.struct(x["coord"], x["f"])))
    counts = F.transform(F.sequence(F.lit(0), F.lit(coordinates - 1)), lambda c: F.coalesce(F.try_element_at(counts, c), F.lit(1)))
    wanted = long.select("c").distinct()
    facts = sets.select("c", "sig").join(own.select("c", counts.alias("counts")), "c").join(wanted, "c", "left_semi").join(texts, "c")
    long = long.join(facts, "c")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        hi = pdf[pdf.block == pdf.hi]
        lo = pdf if pdf.lo.iat[0] == -1 else pdf[pdf.block == pdf.lo]
        if not len(lo) or not len(hi):
            return pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="int64")})
        x, y, counts = np.stack(lo.sig.to_numpy()), np.stack(hi.sig.to_numpy()), np.stack(lo["counts"].to_numpy()).astype(np.int64)
        agreed = np.zeros((len(lo), len(hi)), np.int16)
        first = np.full(agreed.shape, np.iinfo(np.int64).max)
        for j in range(coordinates):
            same = x[:, j, None] == y[None, :, j]
            agreed += same
            np.minimum(first, (counts[:, j] * coordinates + j)[:, None], out=first, where=same)
        here = int(pdf.coord.iat[0])
        n, m = lo.n.to_numpy()[:, None], hi.n.to_numpy()[None, :]
        # A pair is told once, by the rarest posting that it shares.
        ok = (agreed >= matches) & (first == (counts[:, here] * coordinates + here)[:, None])
        ok &= (lo.g.to_numpy()[:, None] != hi.g.to_numpy()[None, :]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
        i, j = np.nonzero(ok)
        order = np.argsort(-agreed[i, j], kind="stable")
        full: dict[int, np.ndarray] = {}  # sets of those classes that a pair asks for
        ids, comps, text, up, links = (lo.c.tolist(), hi.c.tolist()), (lo.g.tolist(), hi.g.tolist()), (lo.text.tolist(), hi.text.tolist()), {}, []

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                x = y
            return x

        def shingles(side: int, at: int) -> np.ndarray:
            c = ids[side][at]
            if c not in full:
                full[c] = next(shingle_sets(pa.array([text[side][at]], pa.large_string()), k))
            return full[c]

        for x, y in zip(i[order].tolist(), j[order].tolist()):
            p, q = top(comps[0][x]), top(comps[1][y])
            if p != q and similar(shingles(0, x), shingles(1, y), percent):
                up[max(p, q)] = min(p, q)
                links.append((ids[0][x], ids[1][y]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    rows = long.select("coord", "val", "lo", "hi", "block", "c", "n", "g", "sig", "counts", F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("coord", "val", "lo", "hi").applyInPandas(compare, "a bigint, b bigint")


def default_matches(coordinates: int, percent: int) -> int:
    """Over six standard deviations below the agreements that the wanted similarity gives: at most 1 link in 10^7 is lost."""
    p = percent / 100
    return max(1, int(coordinates * p - 6 * (coordinates * p * (1 - p)) ** 0.5))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, coordinates: int = 64, matches: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their sets of k-word
    shingles (words between ASCII white space, A-Z lower-cased). component_id is the smallest id
    reachable by links, kept says that it is the document's own. A text of fewer than k words
    is one shingle; null, empty and blank texts have an empty set and are linked with nothing.
    Rows that repeat a doc_id count as one document with several texts: each row is returned, and
    what any of them links to is in one component; rows with a null id are returned unlinked. Other columns
    of docs are ignored. An empty table gives an empty result.

    matches: agreements of signatures from which on a pair is confirmed, by default default_matches. With
    matches=1 no posting is skipped and every pair that agrees anywhere is confirmed on its full sets: the exact way,
    which misses a pair of similarity s with a chance of (1 - s) ** coordinates.
    """
    if matches is None:
        matches = default_matches(coordinates, percent)
    prefix = coordinates - matches + 1
    found = signatures(docs, k, coordinates, id_col, text_col)
    rows = materialise(found.select(F.monotonically_increasing_id().alias("row"), *found.columns), "signatures")
    real = rows.where("n > 0 and id is not null")
    # A class is one distinct set; its number c is the row whose signature and text stand for it.
    classes = real.groupBy("h1", "h2", "n").agg(F.min("row").alias("c"))
    members = materialise(real.select("row", "id", "h1", "h2", "n").join(classes, ["h1", "h2", "n"]).select("row", "id", "c"), "members")
    reps = members.where("row = c").select("row")
    sets = materialise(real.join(reps, "row", "left_semi").select(F.col("row").alias("c"), "id", "print", "n", "sig"), "sets")

    tokens = sets.select("c", "n", F.posexplode("sig").alias("coord", "val"))
    shared = tokens.groupBy("coord", "val").agg(F.count("*").alias("f")).where("f > 1")
    own = tokens.join(shared, ["coord", "val"]).groupBy("c", "n").agg(F.array_sort(F.collect_list(F.struct("f", "coord", "val"))).alias("t"))
    own = own.where(F.size("t") > coordinates - prefix)
    own = materialise(own, "shared_postings")
    slots = F.lit(prefix - coordinates) + F.size("t")  # what the postings without partners leave of the prefix
    fame = F.aggregate("t", F.lit(0).cast("bigint"), lambda s, x: s + x["f"])
    posts = own.select("c", "n", fame.alias("fame"), F.explode(F.slice("t", F.lit(1), slots)).alias("t")).select("c", "n", "fame", "t.coord", "t.val")

    hubs = posts.groupBy("coord", "val").agg(F.max(F.struct("fame", "c", "n")).alias("h"))
    stars = posts.join(hubs, ["coord", "val"]).where(f"c <> h.c and 100 * least(n, h.n) >= {percent} * greatest(n, h.n)").select(F.col("h.c").alias("a"), F.col("c").alias("b")).distinct()
    stars = materialise(stars, "stars")
    wanted = narrow_side(sets.join(posts.select("c").distinct(), "c", "left_semi").select("c", "id", "print"), BROADCAST_ROWS)
    texts = only(docs, id=id_col, text=text_col).withColumn("print", F.xxhash64("text"))
    texts = materialise(texts.join(wanted, ["id", "print"]).select("c", "text").dropDuplicates(["c"]), "texts")
    first = materialise(_confirmed(stars, sets, texts, k, percent, matches), "links")

    mixed = _mixed(posts, components(first).select(F.col("id").alias("c"), F.col("component_id").alias("found")))
    either = stars.union(stars.select("b", "a"))
    rest = materialise(_short_pairs(mixed, percent).join(either, ["a", "b"], "left_anti"), "rest")
    links = first.union(_confirmed(rest, sets, texts, k, percent, matches)).union(_long_links(mixed, own, sets, texts, k, percent, matches, coordinates))
    # Rows of one id tie all their classes to the smallest of them.
    least = members.groupBy("id").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("id", "a")
    ties = members.join(least, "id").where("a <> c").select("a", F.col("c").alias("b"))
    joined = components(links.union(ties)).select(F.col("id").alias("c"), F.col("component_id").alias("g"))
    discard(sets, own, stars, texts, first, mixed, rest)
    by_class = members.groupBy("c").agg(F.min("id").alias("least"))
    by_group = joined.join(by_class, "c").groupBy("g").agg(F.min("least").alias("component_id"))
    in_groups = joined.join(by_group, "g").select("c", "component_id")
    placed = by_class.join(in_groups, "c", "left").select("c", F.coalesce("component_id", "least").alias("component_id"))
    placed = members.join(placed, "c").groupBy("id").agg(F.min("component_id").alias("component_id"))
    out = rows.select("id", "n").join(placed, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
