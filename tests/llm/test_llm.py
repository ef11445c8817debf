"""The numbered operators against plain Python on small tables with nulls, ties, repeats, clashing columns."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orebase.llm import quality, toxicity
from orebase.llm.decontaminate import contamination
from orebase.llm.embeddings import near_vectors
from orebase.llm.language_model import Vocabulary, score_texts, train_model, word_counts
from orebase.llm.line_dedup import dedup_lines
from orebase.llm.minhash import near_duplicates
from orebase.llm.packing import ChunkEncoder, packed_documents
from orebase.llm.secrets import secret_spans, span_text
from orebase.llm.token_fst import compiled, count_texts, token_counts

WORDS = [f"w{i}" for i in range(400)]


def texts(rng, n, size=60):
    return [" ".join(rng.choice(WORDS, size)) for _ in range(n)]


def table(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.withColumns({"n": F.lit(1), "key": F.lit("k"), "id": F.lit(0), "score": F.lit(0.5)}) if extra else df


def low(s):
    return "".join(c.lower() if c.isascii() else c for c in s or "")


def groups(ids, pairs):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {i: top(i) for i in ids}


def test_minhash_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = list(enumerate(texts(rng, 20)))
    for _ in range(60):  # a dense group of near copies, linked and not
        w = rows[3][1].split()
        for j in rng.integers(0, len(w), rng.integers(0, 6)):
            w[j] = "x" + str(rng.integers(0, 50))
        rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", " \t", "One", "one", "a b", rows[0][1], rows[0][1].upper()])]

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()

    s = {i: shingles(t) for i, t in rows}
    pairs = [(a, b) for a in s for b in s if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b])]
    want = groups(s, pairs)
    got = {r.doc_id: r for r in near_duplicates(table(spark, rows), 3, 85).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(s[i]) and r.kept == (want[i] == i) for i, r in got.items())
    assert near_duplicates(table(spark, []), 3, 85).count() == 0


def brute_components(rows, k, percent):
    """Components of ids; an id's rows tie their texts together."""

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()

    s = [(i, shingles(t)) for i, t in rows]
    return groups({i for i, _ in rows}, [(i, j) for i, x in s for j, y in s if i != j and x and y and 100 * len(x & y) >= percent * len(x | y)])


def test_minhash_keeps_links_of_rows_that_share_an_id(spark):
    rng = np.random.default_rng(12)
    a, b, c = texts(rng, 3)
    near = lambda t: " ".join([*t.split()[:-1], "other"])
    rows = [(1, a), (1, b), (1, c), (2, near(b)), (3, near(a)), (4, near(c)), (5, None), (5, a), (6, b)]
    want = brute_components(rows, 3, 85)
    for parts in range(1, 4):
        got = near_duplicates(table(spark, rows).repartition(parts), 3, 85).collect()
        assert {(r.doc_id, r.component_id) for r in got} == set(want.items()) == {(i, 1) for i in range(1, 7)}


def test_minhash_long_lists_with_strangers(spark, monkeypatch):
    rng = np.random.default_rng(13)
    monkeypatch.setattr("orebase.llm.minhash.BLOCK", 16)
    base = texts(rng, 1, 80)[0].split()
    rows = []
    for i in range(300):  # all near one text, few near each other
        w = list(base)
        for j in rng.integers(0, 80, rng.integers(1, 5)):
            w[j] = f"z{i}"
        rows.append((i, " ".join(w)))
    want = brute_components(rows, 3, 85)
    got = {r.doc_id: r.component_id for r in near_duplicates(table(spark, rows), 3, 85).collect()}
    assert got == want
    exact = {r.doc_id: r.component_id for r in near_duplicates(table(spark, rows[:60]), 3, 85, matches=1).collect()}
    assert exact == brute_components(rows[:60], 3, 85)


def test_columns_named_like_results_and_inner_ones(spark):
    rows = [(i, t) for i, t in enumerate(texts(np.random.default_rng(14), 12, 30))] + [(50, None), (51, "")]
    names = ("score", "y", "id", "key", "n", "t", "n_lines", "n_dropped", "kept_text", "n_words", "n_hit", "items", "spans", "contaminated", "n_bytes", "n_tokens", "drops", "lines", "kept", "in0", "label", "f", "row", "sig")
    df = table(spark, rows, False).withColumns({c: F.lit("mine") for c in names})
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(12)], "doc_id bigint, toxic int").withColumn("y", F.lit(3))
    bench = spark.createDataFrame([(1, rows[0][1])], "item_id bigint, text string")
    found = {
        "toxicity": (toxicity.toxicity(df, toxicity.train(df, labels, "toxic", F.lit(True))), {"score"}),
        "quality": (quality.quality(df, quality.train(df, labels, "toxic", F.lit(True))), {"score"}),
        "lines": (dedup_lines(df), {"n_lines", "n_dropped", "kept_text"}),
        "contamination": (contamination(df, bench), {"n_words", "n_hit", "items", "spans", "contaminated"}),
    }
    try:
        import public_tokenizers as P

        found["tokens"] = (token_counts(df, P.path("byte_bpe_50k.json")), {"n_bytes", "n_tokens"})
    except ImportError:
        pass
    for name, (out, results) in found.items():
        assert sorted(out.columns) == sorted({"doc_id", "text", *names} | results), name
        got = out.collect()
        assert len(got) == len(rows) and all(r[c] == "mine" for r in got for c in set(names) - results), name
    for out in (near_duplicates(df), score_texts(df, F.lit(True)), secret_spans(df)):
        assert out.count() == len(rows)


def test_line_dedup(spark):
    line = "a line that is certainly longer than forty characters"
    rows = [(i, f"own {i}\n {line.upper() if i % 2 else line}\t\nshort") for i in range(6)] + [(10, None), (11, ""), (12, line * 2)]
    got = {r.doc_id: r for r in dedup_lines(table(spark, rows), batches=3).collect()}
    assert [got[i].n_dropped for i in range(6)] == [1] * 5 + [0]
    assert got[0].kept_text == "own 0\nshort" and got[5].kept_text == rows[5][1]
    assert (got[10].n_lines, got[10].kept_text, got[12].n_dropped) == (1, "", 0)
    assert dedup_lines(table(spark, [])).count() == 0


def test_line_dedup_counts_documents_not_rows(spark):
    line = "a line that is certainly longer than forty characters"
    got = dedup_lines(table(spark, [(9, line)] * 4 + [(3, line)])).collect()
    assert [r.n_dropped for r in got] == [0] * 5
    got = dedup_lines(table(spark, [(9, line)] * 4 + [(i, line) for i in range(4)])).collect()
    assert {(r.doc_id, r.n_dropped) for r in got} == {(0, 1), (1, 1), (2, 1), (3, 1), (9, 0)}


def test_decontamination(spark):
    rng = np.random.default_rng(2)
    item = " ".join(rng.choice(WORDS, 15))
    w = item.split()
    rows = [(1, "x y " + " ".join(w[2:13]).upper() + ". z"), (2, " ".join(w[:9])), (3, None), (4, "Short-Item here"), (4, "Short-Item here"), (5, "")]
    bench = spark.createDataFrame([(7, item), (8, "short item"), (9, None), (10, "...")], "item_id bigint, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in contamination(table(spark, rows), bench).orderBy("doc_id").collect()]
    assert got == [(1, 14, 11, ["7"]), (2, 9, 0, []), (3, 0, 0, []), (4, 3, 2, ["8"]), (4, 3, 2, ["8"]), (5, 0, 0, [])]
    assert contamination(table(spark, rows), bench.limit(0)).where("contaminated").count() == 0


def test_packing_and_token_counts(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(3)
    rows = list(enumerate([*texts(rng, 30, 90), " ".join(texts(rng, 1, 3000)), None, "", "it's  \n x <|endoftext|> y", "é中 '' 'll"]))
    ids = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in rows}
    got = token_counts(table(spark, rows), P.path("byte_bpe_50k.json")).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(x) for i, x in ids.items()}
    assert all(r.n_bytes == len((dict(rows)[r.doc_id] or "").encode()) for r in got)
    pieces = packed_documents(table(spark, rows), P.path("byte_bpe_50k.json")).toPandas()
    for i, p in pieces.sort_values("piece").groupby("doc_id"):
        full = np.array(ids[i] + [2], "<u4")
        assert p.length.sum() == len(full)
        assert all(zlib.crc32(full[a : a + n].tobytes()) == c for a, n, c in zip(p.start, p.length, p.ids_crc32))
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 1024 and s.offset.tolist() == [0, *s.length.cumsum()[:-1]]


def test_chunks_are_read_many_at_a_time():
    P = pytest.importorskip("public_tokenizers")
    import pyarrow as pa
    from tokenizers import Tokenizer

    class Counting:
        def __init__(self, inner):
            self.inner, self.asked = inner, 0

        def encode_batch_fast(self, some, **how):
            self.asked += len(some)
            return self.inner.encode_batch_fast(some, **how)

    t, e = Tokenizer.from_file(P.path("byte_bpe_50k.json")), ChunkEncoder(P.path("byte_bpe_50k.json"))
    e.tokenizer = Counting(e.tokenizer)
    rng = np.random.default_rng(6)
    bits = ["a", "'s", "'re", "'", " ", "\n", "\t", "é", "中", "😀", "1", "!", "(", "-", "\x00", "\x85", " ", "​", "\u3000", "the", "'ll", " x", "<|endoftext|>", "<|end"]
    some = ["".join(rng.choice(bits, rng.integers(0, 30))) for _ in range(3000)] + ["", "a", " ", "-", "ab" * 3000, " " * 700, "<|endoftext|>"]
    for part in (some[:5], ["", ""], [], some, some[::-1]):
        assert [x.tolist() for x in e.ids(pa.array(part, pa.large_string()))] == [t.encode(x, add_special_tokens=False).ids for x in part]
    e.tokenizer.asked = 0
    plain = [f"word{i} of{i}-that (by{i}), it{i}" for i in range(5000)]
    assert [x.tolist() for x in e.ids(pa.array(plain, pa.large_string()))] == [x.ids for x in t.encode_batch(plain, add_special_tokens=False)]
    assert e.tokenizer.asked < 1.1 * len(plain)  # the texts' first chunks, and few runs of the 20,000 others


def test_token_machine_on_odd_texts():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t, m = Tokenizer.from_file(P.path("byte_bpe_50k.json")), compiled(P.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(4)
    bits = ["a", "'s", "'re", "'", " ", "\n", "é", "中", "😀", "1", "!", "\x00", " ", "​", "the", "'ll"]
    some = ["".join(rng.choice(bits, rng.integers(0, 30))) for _ in range(2000)] + ["ab" * 3000, " " * 700]
    assert count_texts(some, m).tolist() == [len(e.ids) for e in t.encode_batch(some, add_special_tokens=False)]


def test_models_learn_and_ignore_held_out(spark):
    rng = np.random.default_rng(5)
    rows = [(i, t + (" vile" if i % 3 == 0 else "")) for i, t in enumerate(texts(rng, 300, 20))] + [(300, None), (301, "")]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id bigint, toxic int")
    w = toxicity.train(table(spark, rows, False), labels, "toxic", F.col("doc_id") < 240)
    got = {r.doc_id: r.score for r in toxicity.toxicity(table(spark, rows, False), w).collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 3 == 0) for i in range(240, 300)]) > 0.95
    assert got[300] == got[301] and all(0 <= s <= 1 for s in got.values())
    assert toxicity.train(table(spark, [], False), labels.limit(0), "toxic", F.lit(True)).any() == False  # noqa: E712
    rows = [(i, ("| " * 20 + "x") if i % 4 == 0 else t) for i, t in rows]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(300)], "doc_id bigint, quality int")
    m = quality.train(table(spark, rows, False), labels, "quality", F.col("doc_id") < 240)
    got = {r.doc_id: r.score for r in quality.quality(table(spark, rows, False), m).collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 4 != 0) for i in range(240, 300)]) > 0.95


def test_toxicity_keeps_the_prior_of_all_labels(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "'' as text")
    labels = spark.range(2000).selectExpr("id as doc_id", "int(id % 10 = 0) as toxic")
    for most in (10_000, 200):  # all labels; about 200 of each class
        w = toxicity.train(docs, labels, "toxic", F.lit(True), most=most)
        assert toxicity.toxicity(docs.limit(1), w).first().score == pytest.approx(0.1, abs=0.05)


def test_toxicity_sends_features_as_short_steps():
    rng = np.random.default_rng(8)
    for buckets in ([], [0], [65534], [65535], [65536], [0, 1, 65536, 131071, 131072, 1048575], np.unique(rng.integers(0, 1 << toxicity.BITS, 2000))):
        buckets = np.array(buckets, np.int32)
        sent = toxicity.packed(buckets)
        assert (toxicity.unpacked(np.frombuffer(sent, np.uint16)) == buckets).all() and len(sent) <= 2 * (len(buckets) + 16)


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(30, 40))
    v = np.concatenate([base, base[:10] + rng.normal(scale=0.2, size=(10, 40)), base[:3] * 7])
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(100, None), (101, [0.0] * 40), (102, [float("nan")] * 40), (103, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("id", F.lit(1))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    g = u @ u.T >= 0.95
    pairs = [(i, j) for i in range(len(v)) for j in range(i) if g[i, j]]
    want = groups([r[0] for r in rows], pairs)
    for tile in (6144, 8):  # one tile, and tiles that links cross
        got = {r.vec_id: r for r in near_vectors(df, 0.95, tile=tile).collect()}
        assert {i: r.component_id for i, r in got.items()} == want
        assert all(got[i].n_links == g[i].sum() - 1 for i in range(len(v))) and got[100].n_links == 0


def test_secrets(spark):
    text = "😀 token: 'abcd1234efgh' password=token:zzzzzzzzzz AKIA0123456789AB " + "0f" * 20
    rows = [(1, text), (2, "login=someone " + "- " * 200 + " secret=abcdefgh1"), (3, "login = someone, secret=abcdefgh1 https://h.example/x"), (4, None), (5, "https://h.example login=someone")]
    got = {r.doc_id: (r.b, r.w) for r in secret_spans(table(spark, rows)).select("doc_id", span_text(F.col("base")).alias("b"), span_text(F.col("weak")).alias("w")).collect()}
    want = [(m.start(), "assign", m.end()) for m in re.finditer(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[1]) >= 8]
    want += [(m.start(), k, m.end()) for k, p in (("access", "AKIA[A-Z0-9]{12,}"), ("hex", "[0-9a-f]{32,}")) for m in re.finditer(p, text)]
    assert got[1][0] == ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(want))
    assert got[2][1] == "" and got[4] == ("", "") and got[5] == ("", "")  # out of reach, null, no secret
    assert got[3][1] == "identifier:0:15,endpoint:34:53"


def test_secrets_equal_brute_force(spark):
    rng = np.random.default_rng(15)
    bits = ["login=someone", "client_id=abcd", "AKIA0123456789AB", "secret=abcdefgh1", "token: short", "0f" * 16, "aB3+" * 11, "https://h.example/x", "mysql://u:" + "0a" * 16 + "@h", "😀", "plain words here"]
    rows = [(i, "".join(str(rng.choice(bits)) + " " * int(rng.choice([1, 5, 120])) for _ in range(rng.integers(0, 14)))) for i in range(80)] + [(90, None), (3, ""), (3, "")]
    key = r"[\"']?\x20*[:=]\x20*[\"']?"
    patterns = [
        ("assign", "secret", rf"(?i:password|passwd|secret|token|api_?key){key}([A-Za-z0-9+/_.=-]+)"), ("access", "identifier", "AKIA[A-Z0-9]{12,}"), ("hex", "secret", "[0-9a-f]{32,}"),
        ("identifier", "identifier", rf"(?i:client_?id|access_?key_?id|key_?id|user_?name|login){key}[A-Za-z0-9_.@-]{{4,}}"), ("long_key", "secret", "[A-Za-z0-9+/]{40,}={0,2}"),
        ("endpoint", "endpoint", r"(?i:https?|wss?|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\s\"'<>|]+"),
    ]

    def linked(t):
        every = [(m.start(), m.end(), k, role) for k, role, p in patterns for m in re.finditer(p, t or "") if k != "assign" or len(m[1]) >= 8]
        out = set()
        for a, b, k, role in every:
            if role == "secret":
                continue
            near = [x for x in every if x[3] != "identifier" and x[0] < b + 300 and x[1] > max(0, a - 300) and (role == "identifier" or x[3] == "secret" and (x[0] >= b or x[1] <= a))]
            if any(x[3] == "secret" for x in near):
                out |= {(a, b, k), *[x[:3] for x in near]}
        return sorted(f"{k}:{a}:{b}" for a, b, k in out if k in ("identifier", "long_key", "endpoint"))

    got = secret_spans(table(spark, rows)).select("doc_id", span_text(F.col("weak")).alias("w")).collect()
    want = sorted((i, linked(t)) for i, t in rows)
    assert sorted((r.doc_id, sorted(filter(None, r.w.split(",")))) for r in got) == want


def test_secrets_of_hex_and_endpoints(spark):
    hex32, far = "0123456789abcdef" * 2, "- " * 200
    rows = [(1, f"client_id=abcd https://host/x {hex32}"), (2, f"https://host/x {hex32}"), (3, f"https://host/{hex32}"), (4, f"https://host/x {far}{hex32}")]
    rows += [(5, "secret=abcdefgh1 https://host/x"), (6, f"https://host/{'aB3' * 15}"), (7, f"login=someone {far[:200]}https://host/x {far[:250]}{hex32}")]
    got = {r.doc_id: r.w for r in secret_spans(table(spark, rows)).select("doc_id", span_text(F.col("weak")).alias("w")).collect()}
    assert got[1] == "identifier:0:14,endpoint:15:29"
    assert got[2] == "endpoint:0:14" and got[5] == "endpoint:17:31"  # no identifier
    assert got[3] == got[4] == got[6] == ""  # part of the address, out of reach
    assert got[7] == "endpoint:214:228"  # the identifier is out of the secret's reach


def test_language_model(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(["a b", "c d"], 30))) for i in range(60)] + [(60, None), (61, "New words A")]
    got = {r.doc_id: r for r in score_texts(table(spark, rows), F.col("doc_id") < 50).collect()}
    counts, total = {}, 0
    for i, t in rows[:50]:
        for w in [*low(t).split(), "\n"]:
            counts[w] = counts.get(w, 0) + 1
            total += 1
    for i, t in rows:
        w = [*low(t).split(), "\n"]
        base = sum(np.log10((counts.get(x, 0) + 1) / (total + len(counts) + 1)) for x in w)
        assert got[i].base_score == pytest.approx(base) and (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(x in counts for x in w), total)
    assert all(np.isfinite(r.score) for r in got.values())


def test_language_model_has_a_class_for_every_word(spark):
    rng = np.random.default_rng(9)
    pairs = [f"a{i} b{i}" for i in range(1500)]  # all words equally rare
    docs = [" ".join(rng.permutation(pairs)) for _ in range(12)]
    keyed = table(spark, list(enumerate(docs)), False).select(F.col("doc_id").alias("key"), "text")
    v = Vocabulary.of(word_counts(keyed.select("text")))
    assert len(v.words) == 3001 and len(set(v.classes)) == 3001
    models = [train_model(keyed.repartition(n), v) for n in (1, 5)]
    assert (models[0].w == models[1].w).all()  # whatever the splits are
    whole = np.arange(3002)
    for context in (0, 1700, 3001):
        at = np.full(3002, context)
        assert np.exp(models[0].logs(whole, at, at[::-1])).sum() == pytest.approx(1, abs=1e-4)
    assert len(np.unique(models[0].w[:3001], axis=0)) == 3001


def test_language_model_beats_unigrams_on_held_out_texts(spark):
    rng = np.random.default_rng(10)
    follows = {w: rng.choice(WORDS, 4) for w in WORDS}

    def walk():
        out = [rng.choice(WORDS)]
        while len(out) < 120:
            out.append(rng.choice(follows[out[-1]]))
        return " ".join(out)

    rows = [(i, walk()) for i in range(700)] + [(700, None), (701, "")]
    got = score_texts(table(spark, rows), F.col("doc_id") < 600).where("doc_id >= 600 and doc_id < 700").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert got.s / got.n > got.b / got.n + 0.2


def test_word_likelihood_trains_no_model(spark, monkeypatch):
    from orebase.llm import language_model
    from orebase.llm.queries import QUERIES

    data, cols = "/root/testdata/sf0.001", ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]
    whole = QUERIES["op10_language_model"](spark, data)
    assert whole.columns == [*cols, "score"]
    want = sorted(map(tuple, whole.select(*cols).withColumn("base_score", F.round("base_score", 4)).collect()))
    for name in ("grouped", "train_model"):
        monkeypatch.setattr(language_model, name, lambda *a: pytest.fail("a model is trained"))
    got = QUERIES["word_likelihood"](spark, data)
    assert got.columns == cols and sorted(map(tuple, got.collect())) == want


def test_language_model_without_training_rows_or_texts(spark):
    rows = [(1, "a b"), (2, None), (1, "a b")]
    got = score_texts(table(spark, rows), F.lit(False)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(3, 0, 0), (3, 0, 0), (1, 0, 0)]
    assert all(r.base_score == 0 and np.isfinite(r.score) for r in got)
    assert score_texts(table(spark, []), F.lit(True)).count() == 0


@pytest.mark.parametrize("name", ["op1_minhash", "op3_line_dedup", "op4_decontaminate", "op7_embeddings", "secrets_base", "word_likelihood"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from orebase.llm.queries import ORACLE_SQL, QUERIES

    data = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got, want = QUERIES[name](spark, data).toPandas(), c.sql(ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and sorted(map(tuple, got[cols].values.tolist())) == sorted(map(tuple, want[cols].values.tolist()))
