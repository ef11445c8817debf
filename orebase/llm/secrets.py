"""Secrets in texts, with parts of one credential linked by an interval join. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

# The base patterns, found leftmost and non-overlapping.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
ACCESS = "AKIA[A-Z0-9]{12,}"  # a run is taken whole, so the least length can stand in the pattern
HEX = "[0-9a-f]{32,}"
# Weak candidates: nothing by themselves, a credential's part where the other parts stand near.
IDENTIFIER = r"""(?i)(?:client_?id|access_?key_?id|key_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}"""
KEY = r"[A-Za-z0-9+/]{40,}={0,2}"
ENDPOINT = r"""(?i)(?:https?|wss?|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\s"'<>|]+"""
KINDS = ("assign", "access", "hex", "identifier", "long_key", "endpoint")

SPANS = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, pattern: str, kind: int, least: int = 0) -> Column:
    """Array of (start, kind, end) of the pattern's matches, in code points.

    The pieces between matches and the matches themselves follow one another, so their lengths
    give the places. least: code points that group 2 must have.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if least else whole
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    sizes = F.transform(F.arrays_zip(gaps.alias("g"), whole.alias("m"), value.alias("v")), lambda x: F.struct(F.length(x["g"]).alias("g"), F.length(x["m"]).alias("m"), F.length(x["v"]).alias("v")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(state, x):
        a = state["at"] + x["g"]
        b = a + x["m"]
        span = F.array(F.struct(a.alias("start"), F.lit(kind).alias("kind"), b.alias("end")))
        return F.struct(b.alias("at"), F.when(x["v"] >= least, F.concat(state["out"], span)).otherwise(state["out"]).alias("out"))

    found = F.aggregate(sizes, start, step, lambda s: s["out"])
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(F.array().cast(SPANS))


def _linked(parts: DataFrame, reach: int) -> DataFrame:
    """(key, weak): weak spans of rows (key, role, start, kind, end) that stand with their complements.

    A scope is the interval of an identifier or endpoint widened by `reach` on both sides. It counts
    if a secret overlaps it; then its anchor and secrets are reported, and an identifier's endpoints.
    A secret that shares code points with an endpoint is part of the address and does not stand next to it.
    Intervals meet through equal (key, cell) of `reach` code points, so no task compares more than what lies in a few cells.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / reach), F.floor(b / reach)))
    low, high = F.greatest(F.col("start") - reach, F.lit(0)), F.col("end") + reach
    scopes = parts.where("role <> 'secret'").select("key", F.col("role").alias("of"), F.struct("start", "kind", "end").alias("anchor"), low.alias("low"), high.alias("high"))
    scopes = scopes.withColumn("cell", cells(F.col("low"), F.col("high")))
    others = parts.where("role <> 'identifier'").select("key", "role", F.struct("start", "kind", "end").alias("part"), "start", "end", cells(F.col("start"), F.col("end")).alias("cell"))
    met = scopes.join(others, ["key", "cell"]).where("start < high and end > low")
    beside = (F.col("role") == "secret") & ((F.col("start") >= F.col("anchor.end")) | (F.col("end") <= F.col("anchor.start")))
    met = met.where((F.col("of") == "identifier") | beside).select("key", "anchor", "role", "part").distinct()
    whole = met.where("role = 'secret'").select("key", "anchor").distinct()
    told = met.join(whole, ["key", "anchor"], "left_semi").select("key", F.col("part").alias("s")).union(whole.select("key", F.col("anchor").alias("s")))
    return told.where("s.kind >= 3").groupBy("key").agg(F.collect_set("s").alias("weak"))


def secret_spans(docs: DataFrame, reach: int = 300, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, weak) per row: arrays of (start, kind, end), code points, end exclusive, by start and kind.

    kind counts in KINDS. base: assignments of at least 8 characters, access ids and long hex
    runs, wherever they stand. weak: identifiers, 40-character keys and endpoints, only where an
    identifier (or access id) or an endpoint and a secret (an assignment, key or long hex run) lie within `reach`
    code points, the secret not inside that endpoint; spans of different kinds may overlap. A null or empty text has none. Repeated rows each get their
    result, rows with a null id too; other columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    found = docs.select(
        F.xxhash64(docs[id_col], docs[text_col]).alias("key"),
        docs[id_col].alias("doc_id"),
        *[_spans(text, p, i, ASSIGN_LEAST if p is ASSIGN else 0).alias(KINDS[i]) for i, p in enumerate((ASSIGN, ACCESS, HEX, IDENTIFIER, KEY, ENDPOINT))],
    )
    found = materialise(found, "spans")
    roles = {"access": "identifier", "identifier": "identifier", "assign": "secret", "long_key": "secret", "hex": "secret", "endpoint": "endpoint"}

    def with_role(spans: str, role: str) -> Column:
        return F.transform(spans, lambda s: F.struct(F.lit(role).alias("role"), s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    parts = F.flatten(F.array(*[with_role(k, r) for k, r in roles.items()]))
    some = found.where((F.size("access") + F.size("identifier") + F.size("endpoint") > 0) & (F.size("assign") + F.size("long_key") + F.size("hex") > 0))
    weak = _linked(some.select("key", F.explode(F.array_distinct(parts)).alias("p")).select("key", "p.*").distinct(), reach)
    out = found.join(weak, "key", "left")
    empty = F.array().cast(SPANS)
    return out.select("doc_id", F.array_sort(F.concat("assign", "access", "hex")).alias("base"), F.array_sort(F.coalesce("weak", empty)).alias("weak"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
