"""Every pipeline stage against plain Python on its own input, and the whole run."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

WORDS = [f"w{i}" for i in range(500)]
LINE = "this very same notice stands below the text of many documents"


def low(s):
    return "".join(c.lower() if c.isascii() else c for c in s or "")


def spaced(s):
    return re.findall(r"[^\x20\x09-\x0D]+", low(s))


def alnum(s):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(s))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(21)
    bench = [" ".join(rng.choice(WORDS, 25)) for _ in range(3)]
    text = {i: " ".join(rng.choice(WORDS, 60)) for i in range(160)}
    toxic = set(range(0, 100, 4))
    for i in toxic:
        text[i] += " vile wretch" + " vile" * (i % 3)
    for i in range(101, 109):
        text[i] += f"\n {LINE.upper() if i % 2 else LINE}\t\nend {i}"
    for i in range(110, 116):  # near copies, some too far to be linked
        w = text[109].split()
        w[:: 70 - 10 * (i - 110)] = [f"new{i}"] * len(w[:: 70 - 10 * (i - 110)])
        text[i] = " ".join(w)
    text[116] = text[109]
    text[117] += " " + bench[0].upper()
    text[118] += " " + " ".join(bench[1].split()[3:13]) + "."
    text[119] += " " + " ".join(bench[2].split()[:9])
    text |= {120: None, 121: "", 122: " \n\n ", 123: " ".join(rng.choice(WORDS, 2500))}
    out = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en", "web", None if t is None else len(t)) for i, t in text.items()]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(100)], "doc_id bigint, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id bigint, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), toxic


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def without_lines(docs):
    holders = defaultdict(set)
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    for i, t in docs.items():
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    common = {k: max(v) for k, v in holders.items() if len(k) >= 40 and len(v) >= 5}
    return {i: None if t is None else "\n".join(x for x in t.split("\n") if common.get(key(x), i) == i) for i, t in docs.items()}


def one_of_each_group(docs):
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := spaced(t)) else set() for i, t in docs.items()}
    top = {i: i for i in docs}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in docs:
        for b in docs:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {i: t for i, t in docs.items() if root(i) == i}


def clean_of(docs, items):
    windows = {tuple(w[j : j + 10]) for w in map(alnum, items) for j in range(len(w) - 9)}
    return {i: t for i, t in docs.items() if not any(tuple(w[j : j + 10]) in windows for w in [alnum(t)] for j in range(len(w) - 9))}


def test_stages_equal_brute_force(spark, folder):
    path, toxic = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages, everything = dict(P.STAGES), texts_of(docs)
    docs = stages["toxicity"](spark, docs, path)
    kept = texts_of(docs)
    assert set(everything) - set(kept) == toxic and all(kept[i] == everything[i] for i in kept)
    for name, plain in (("line_dedup", without_lines), ("minhash", one_of_each_group), ("decontaminate", lambda d: clean_of(d, texts_of(spark.read.parquet(f"{path}/benchmark.parquet").withColumnRenamed("item_id", "doc_id")).values()))):
        want = plain(texts_of(docs))
        docs = P.materialise(stages[name](spark, docs, path), f"test-{name}")
        assert docs.columns == list(P.COLUMNS)
        assert texts_of(docs) == want, name
        assert docs.where("n_chars <> length(text)").count() == 0
    assert not {116, 117, 118} & set(texts_of(docs)) and {109, 119, 120, 121, 122, 123} <= set(texts_of(docs))
    assert sum("notice stands" in low(t) for t in texts_of(docs).values()) == 1

    pytest.importorskip("public_tokenizers")
    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    ids = {i: encode(t or "", add_special_tokens=False).ids + [2] for i, t in texts_of(docs).items()}
    rows = P.run(spark, path).toPandas()
    assert set(rows.doc_id) == set(ids)
    for i, p in rows.sort_values("piece").groupby("doc_id"):
        assert p.start.tolist() == [0, *p.length.cumsum()[:-1]] and p.length.sum() == len(ids[i])
        assert all(zlib.crc32(np.array(ids[i][a : a + n], "<u4").tobytes()) == c for a, n, c in zip(p.start, p.length, p.ids_crc32))
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 1024 and s.offset.tolist() == [0, *s.length.cumsum()[:-1]]


def test_stages_on_empty_tables(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").where(F.lit(False))
    for name, stage in P.STAGES:
        assert stage(spark, docs, path).count() == 0, name
