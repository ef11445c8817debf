"""Queries over the fixture tables, one or more for every access path and operator, with DuckDB SQL for each."""

from __future__ import annotations

from datetime import datetime
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import arrays, vectors
from .operators import integrity, lookup, navigate, shapes
from .plans import keys
from .plans.evolution import migrate
from .plans.model import CASCADE, MANY, ONE, OPTIONAL, PREVENT, SET_NULL, ClassDef, Index, Model, Property, Reference
from .sources.store import Log, Transaction, changes, conflicts, visible

PARTY = ("name", "nation", "acctbal")

MODEL = Model.of(
    ClassDef("Region", (Property("name", "string"),)),
    ClassDef("Nation", (Property("name", "string"), Reference("region", "Region", ONE, PREVENT))),
    ClassDef("Party", (Property("name", "string"), Reference("nation", "Nation", ONE, PREVENT), Property("acctbal", "double")), abstract=True),
    ClassDef("Customer", (Property("mktsegment", "string"),), base="Party"),
    ClassDef("Supplier", base="Party"),
    ClassDef("Part", (Property("name", "string"), Property("brand", "string"), Property("size", "int"), Property("retailprice", "double"))),
    ClassDef("Order", (Reference("customer", "Customer", ONE, CASCADE), Property("orderdate", "datetime"), Property("totalprice", "double"), Property("orderstatus", "string"))),
    ClassDef("Line", (Reference("order", "Order", ONE, CASCADE), Reference("part", "Part", ONE, PREVENT), Reference("supplier", "Supplier", OPTIONAL, SET_NULL))),
    ClassDef("OrderParts", (Reference("parts", "Part", MANY, SET_NULL),)),
)

BY_DATE = Index("by_date", (("o_orderdate", True), ("o_totalprice", True)), sorted=True)
BY_STATUS = Index("by_status", (("o_orderstatus", True), ("o_orderdate", True)), sorted=True)
BY_DATE_DOWN = Index("by_date_down", (("o_orderdate", False),), sorted=True)
BY_SHIPDATE = Index("by_shipdate", (("l_shipdate", True),), sorted=True)
BY_SIZE = Index("by_size", (("p_size", True), ("p_retailprice", False)), sorted=True)
LINE_KEYS = (("l_returnflag", True), ("l_linestatus", True), ("l_suppkey", True), ("l_linenumber", True))
LINE_VALUES = ("R", "F", 7, 3)

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("SELECT * FROM part")
def class_scan_part(spark, d):
    return table(spark, d, "part")


def parties(spark, d) -> dict[str, DataFrame]:
    names = lambda p: [F.col(f"{p}_{a}").alias(b) for a, b in (("name", "name"), ("nationkey", "nation"), ("acctbal", "acctbal"))]
    return {
        "Customer": table(spark, d, "customer").select(F.col("c_custkey").alias("id"), *names("c"), F.col("c_mktsegment").alias("mktsegment")),
        "Supplier": table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), *names("s")),
    }


_PARTY_SQL = "SELECT 'Customer' AS kind, c_custkey AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS acctbal FROM customer UNION ALL SELECT 'Supplier', s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"


@query(_PARTY_SQL)
def poly_scan_party(spark, d):
    parts = parties(spark, d)
    return lookup.polymorphic_scan({c: parts[c] for c in MODEL.concrete("Party")}, ("id", *PARTY))


@query(f"SELECT * FROM ({_PARTY_SQL}) WHERE kind = 'Supplier'")
def type_test(spark, d):
    return lookup.of_kind(poly_scan_party(spark, d), MODEL.concrete("Supplier"))


@query("SELECT * FROM orders WHERE o_orderkey = 7")
def get_by_id(spark, d):
    return lookup.get(table(spark, d, "orders"), 7, "o_orderkey")


@query("SELECT * FROM orders WHERE o_orderkey = -5")
def get_missing(spark, d):
    return lookup.get(table(spark, d, "orders"), -5, "o_orderkey")


IDS = (5, 0, 12, 5, -1, 40)


@query("SELECT pos::INT AS pos, orders.* FROM (VALUES (0, 5), (1, 0), (2, 12), (3, 5), (4, -1), (5, 40)) v(pos, k) JOIN orders ON o_orderkey = k")
def batch_get_ordered(spark, d):
    return lookup.get_many(table(spark, d, "orders"), IDS, "o_orderkey")


@query("SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def exists_set(spark, d):
    ids = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return lookup.exists(table(spark, d, "customer").where("c_acctbal > 0"), ids, "c_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 0")
def predicate_mod(spark, d):
    return table(spark, d, "orders").where("o_orderkey % 3 = 0").select("o_orderkey", "o_totalprice")


@query("SELECT count(*) AS n FROM part WHERE contains(p_name, 'a')")
def predicate_contains(spark, d):
    return table(spark, d, "part").where(F.contains("p_name", F.lit("a"))).agg(F.count("*").alias("n"))


def _hash(n: int, spark, d):
    return lookup.find(table(spark, d, "lineitem"), Index(f"line{n}", LINE_KEYS[:n]), LINE_VALUES[:n])


for _n in range(1, 5):
    query("SELECT * FROM lineitem WHERE " + " AND ".join(f"{k} = {v!r}" for (k, _), v in zip(LINE_KEYS[:_n], LINE_VALUES)), f"hash_lookup_{_n}")(partial(_hash, _n))


@query("SELECT * FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 1")
def hash_first(spark, d):
    return lookup.find_first(table(spark, d, "orders"), Index("status", (("o_orderstatus", True),)), ("P",), "o_orderkey")


@query("SELECT * FROM orders WHERE (o_orderstatus, o_orderpriority) IN (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey < 3)")
def hash_batch(spark, d):
    orders = table(spark, d, "orders")
    wanted = table(spark, d, "orders").where("o_orderkey < 3").select("o_orderstatus", "o_orderpriority").distinct()
    return lookup.find_batch(orders, Index("status_priority", (("o_orderstatus", True), ("o_orderpriority", True))), wanted)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def hash_dup_check(spark, d):
    return lookup.duplicates(table(spark, d, "lineitem"), Index("line", (("l_orderkey", True), ("l_linenumber", True)), unique=True))


DAY = datetime(1998, 3, 1)
PRICE = 100000.0
_DAY = "TIMESTAMP '1998-03-01'"


def _range(how: str, index: Index, values: tuple, or_equal: bool, spark, d):
    return getattr(lookup, how)(table(spark, d, "orders"), index, values, or_equal, id_col="o_orderkey")


for _how, _op in (("before", "<"), ("after", ">")):
    for _eq in (False, True):
        _tail = "_or_equal" if _eq else ""
        query(f"SELECT * FROM orders WHERE o_orderdate {_op}{'=' if _eq else ''} {_DAY}", f"range_{_how}{_tail}_1")(partial(_range, _how, BY_DATE, (DAY,), _eq))
        query(f"SELECT * FROM orders WHERE (o_orderdate, o_totalprice) {_op}{'=' if _eq else ''} ({_DAY}, {PRICE}::DOUBLE)", f"range_{_how}{_tail}_2")(partial(_range, _how, BY_DATE, (DAY, PRICE), _eq))
        query(f"SELECT * FROM orders WHERE o_orderstatus = 'O' AND o_orderdate {_op}{'=' if _eq else ''} {_DAY}", f"range_partial_{_how}{_tail}")(partial(_range, f"partial_{_how}", BY_STATUS, ("O", DAY), _eq))


def _window(lo_open: bool, hi_open: bool, spark, d):
    return lookup.index_range(table(spark, d, "lineitem"), BY_SHIPDATE, (datetime(1996, 1, 1),), lo_open, (datetime(1996, 3, 1),), hi_open, id_col="l_orderkey")


for _lo in (False, True):
    for _hi in (False, True):
        query(
            f"SELECT * FROM lineitem WHERE l_shipdate {'>' if _lo else '>='} TIMESTAMP '1996-01-01' AND l_shipdate {'<' if _hi else '<='} TIMESTAMP '1996-03-01'", f"range_{'open' if _lo else 'closed'}_{'open' if _hi else 'closed'}"
        )(partial(_window, _lo, _hi))


@query("SELECT * FROM orders WHERE o_orderstatus = 'P'")
def range_equal_prefix(spark, d):
    return lookup.equal_prefix(table(spark, d, "orders"), BY_STATUS, ("P",), id_col="o_orderkey")


@query("SELECT row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC)::INT AS rn, o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' QUALIFY rn <= 10")
def range_prefix_backward_top10(spark, d):
    return _ranked(lookup.equal_prefix(table(spark, d, "orders"), BY_STATUS, ("P",), backward=True, id_col="o_orderkey"), F.desc("o_orderdate"), F.desc("o_orderkey"))


@query("SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderdate = (SELECT min(o_orderdate) FROM orders WHERE o_orderstatus = 'F')")
def index_by_name(spark, d):
    model = Model.of(ClassDef("Order", (Property("o_orderstatus", "string"), Property("o_orderdate", "datetime")), indexes=(BY_STATUS,)))
    orders = table(spark, d, "orders")
    first = orders.where("o_orderstatus = 'F'").agg(F.min("o_orderdate")).first()[0]
    return lookup.find(orders, keys.index_by_name(model, "Order", "by_status", ("string", "datetime")), ("F", first))


@query("SELECT nation, count(*) AS n FROM (SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY nation HAVING count(*) > 1")
def hierarchy_dup_check(spark, d):
    parts = parties(spark, d)
    rows = lookup.polymorphic_scan({c: parts[c] for c in MODEL.concrete("Party")}, ("id", *PARTY))
    return lookup.duplicates(rows, Index("by_nation", (("nation", True),), unique=True))


@query(f"SELECT * FROM orders WHERE o_orderdate > {_DAY}")
def range_desc_key(spark, d):
    return lookup.before(table(spark, d, "orders"), BY_DATE_DOWN, (DAY,), id_col="o_orderkey")


@query("SELECT * FROM part WHERE p_size < 20 OR (p_size = 20 AND p_retailprice >= 1000)")
def range_mixed_directions(spark, d):
    return lookup.before(table(spark, d, "part"), BY_SIZE, (20, 1000.0), True, id_col="p_partkey")


_TOP = "SELECT row_number() OVER (ORDER BY {o})::INT AS rn, o_orderkey, o_orderdate FROM orders QUALIFY rn <= 10"


def _ranked(df: DataFrame, *order) -> DataFrame:
    return df.limit(10).select(F.row_number().over(Window.orderBy(*order)).alias("rn"), "o_orderkey", "o_orderdate")  # ten rows


@query(_TOP.format(o="o_orderdate DESC, o_totalprice DESC, o_orderkey DESC"))
def range_backward_top10(spark, d):
    df = lookup.index_range(table(spark, d, "orders"), BY_DATE, backward=True, id_col="o_orderkey")
    return _ranked(df, F.desc("o_orderdate"), F.desc("o_totalprice"), F.desc("o_orderkey"))


@query(_TOP.format(o="o_orderdate, o_totalprice, o_orderkey"))
def range_forward_top10(spark, d):
    df = lookup.index_range(table(spark, d, "orders"), BY_DATE, id_col="o_orderkey")
    return _ranked(df, "o_orderdate", "o_totalprice", "o_orderkey")


@query("SELECT o_orderkey, o_orderdate, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
def range_follow(spark, d):
    orders = lookup.index_range(table(spark, d, "orders"), BY_DATE, (datetime(1996, 1, 1),), False, (datetime(1997, 1, 1),), True, id_col="o_orderkey")
    return navigate.follow(orders, "o_custkey", table(spark, d, "customer"), "c_custkey", required=True).select("o_orderkey", "o_orderdate", "c_name")


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def follow_ref(spark, d):
    return navigate.follow(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer").where("c_acctbal > 0"), "c_custkey").select("o_orderkey", "c_name")


@query("SELECT r_name, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def follow_ref_chain(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_quantity")
    for ref, name, key in (("l_orderkey", "orders", "o_orderkey"), ("o_custkey", "customer", "c_custkey"), ("c_nationkey", "nation", "n_nationkey"), ("n_regionkey", "region", "r_regionkey")):
        rows = navigate.follow(rows, ref, table(spark, d, name), key, required=True)
    return rows.groupBy("r_name").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def inverse_refs(spark, d):
    return navigate.inverse(table(spark, d, "customer").where("c_mktsegment = 'BUILDING'"), "c_custkey", table(spark, d, "orders"), "o_custkey").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def inverse_count(spark, d):
    return navigate.inverse_count(table(spark, d, "customer"), "c_custkey", table(spark, d, "orders"), "o_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1996-06-01')")
def inverse_empty(spark, d):
    some = table(spark, d, "orders").where("o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1996-06-01'")
    return navigate.inverse_count(table(spark, d, "customer"), "c_custkey", some, "o_custkey").where("n = 0").select("c_custkey")


@query("SELECT c_custkey, o_orderkey FROM (SELECT o_custkey AS c_custkey, o_orderkey + o_orderkey % 2 AS o_orderkey FROM orders) JOIN orders USING (o_orderkey) WHERE o_custkey = c_custkey GROUP BY ALL")
def inverse_contains(spark, d):
    orders = table(spark, d, "orders")
    pairs = orders.select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") + F.col("o_orderkey") % 2).alias("o_orderkey")).distinct()
    return navigate.inverse_contains(table(spark, d, "customer"), "c_custkey", orders, "o_custkey", "o_orderkey", pairs)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE o_custkey END AS o_custkey FROM orders")
def inverse_add(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return navigate.add_to_inverse(orders, "o_orderkey", "o_custkey", orders.where("o_orderkey % 4 = 0").select("o_orderkey", F.lit(1).cast("bigint").alias("target")))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 3 <> 1 OR o_orderkey % 2 = 1 THEN o_custkey END AS o_custkey FROM orders")
def inverse_remove(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    pairs = orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_custkey") % 3 == 1, F.col("o_custkey")).otherwise(-1).alias("target"))
    return navigate.remove_from_inverse(orders, "o_orderkey", "o_custkey", pairs)


@query("SELECT o_orderkey, CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN o_custkey END AS o_custkey FROM orders")
def inverse_clear(spark, d):
    return navigate.clear_inverse(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", table(spark, d, "customer").where("c_acctbal < 0"), "c_custkey")


@query(
    "WITH o AS (SELECT * FROM orders WHERE o_orderstatus = 'P'), c AS (SELECT DISTINCT c_custkey, c_nationkey FROM o JOIN customer ON c_custkey = o_custkey), n AS (SELECT DISTINCT n_nationkey, n_regionkey FROM c JOIN nation ON n_nationkey = c_nationkey) "
    "SELECT 'Order' AS kind, o_orderkey AS id, 0 AS hops FROM o UNION ALL SELECT 'Customer', c_custkey, 1 FROM c UNION ALL SELECT 'Nation', n_nationkey, 2 FROM n UNION ALL SELECT DISTINCT 'Region', n_regionkey, 3 FROM n"
)
def object_graph(spark, d):
    orders, customers, nations = (table(spark, d, n) for n in ("orders", "customer", "nation"))
    refs = [
        ("Order", "customer", "Customer", orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"))),
        ("Customer", "nation", "Nation", customers.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))),
        ("Nation", "region", "Region", nations.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("region"))),
    ]
    return _by_kind(navigate.object_graph({"Order": orders.where("o_orderstatus = 'P'").select("o_orderkey")}, refs, 3), "hops")


def _by_kind(parts: dict[str, DataFrame], *columns: str) -> DataFrame:
    return reduce(DataFrame.union, [df.select(F.lit(kind).alias("kind"), F.col("id").cast("bigint").alias("id"), *columns) for kind, df in parts.items()])


def order_parts(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    return lines.select(F.col("l_orderkey").alias("id"), F.transform("x", lambda s: s["l_partkey"]).alias("parts"))


@query("SELECT p_partkey, count(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey")
def inverse_multiset(spark, d):
    return navigate.inverse(table(spark, d, "part"), "p_partkey", order_parts(spark, d), "parts").groupBy("p_partkey").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)::INT - 1 AS pos, p_name FROM lineitem JOIN part ON l_partkey = p_partkey")
def follow_many(spark, d):
    return navigate.follow_many(order_parts(spark, d), "parts", table(spark, d, "part"), "p_partkey").select("id", "pos", "p_name")


@query("SELECT pos::INT AS pos, c_custkey, o_orderkey FROM (VALUES (0, 7), (1, 3), (2, 7)) v(pos, k) JOIN customer ON c_custkey = k JOIN orders ON o_custkey = c_custkey")
def nested_fetch_flat(spark, d):
    asked = lookup.get_many(table(spark, d, "customer"), (7, 3, 7), "c_custkey").select("pos", "c_custkey")
    sets = navigate.inverse_sets(asked.select("c_custkey").distinct(), "c_custkey", table(spark, d, "orders"), "o_custkey", ["o_orderkey"], "orders")
    return asked.join(sets, "c_custkey").select("pos", "c_custkey", F.explode("orders").alias("o")).select("pos", "c_custkey", "o.o_orderkey")


@query(
    "WITH RECURSIVE b AS MATERIALIZED (SELECT DISTINCT o_custkey AS id, l_partkey AS via FROM orders JOIN lineitem ON o_orderkey = l_orderkey), s AS (SELECT min(id) AS id FROM b), "
    "r AS (SELECT id, 0 AS hops FROM s UNION SELECT y.id, hops + 1 FROM r JOIN b x ON x.id = r.id JOIN b y ON y.via = x.via WHERE hops < 2) SELECT id, min(hops)::INT AS hops FROM r GROUP BY id HAVING min(hops) > 0"
)
def graph_depth_k(spark, d):
    """Customers within two hops of the first one, a hop leading to all who ever ordered a part in common."""
    buys = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    buys = navigate.reliable(buys.select(F.col("o_custkey").alias("id"), F.col("l_partkey").alias("via")).distinct())
    return navigate.reach_through(buys, buys.agg(F.min("id").alias("id")), 2)


def trails(spark, d) -> DataFrame:
    """Each user's event types in order."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("x"))
    return e.select("user_id", F.transform("x", lambda s: s["event_type"]).alias("types"))


_TRAILS = "WITH t AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS types FROM events GROUP BY user_id) "
_JOINED = "array_to_string({}, ',')"
for _name, _expr, _sql in (
    ("count", lambda x: arrays.count(x).cast("bigint"), "len(types)::BIGINT"),
    ("item", lambda x: arrays.item(x, 0), "types[1]"),
    ("last", lambda x: arrays.last(x), "types[-1]"),
    ("add_range", lambda x: F.array_join(arrays.add_range(x, F.array(F.lit("a"), F.lit("b"))), ","), _JOINED.format("list_concat(types, ['a', 'b'])")),
    ("add", lambda x: F.array_join(arrays.add(x, F.lit("end")), ","), _JOINED.format("list_append(types, 'end')")),
    ("contains", lambda x: arrays.contains(x, F.lit("error")), "list_contains(types, 'error')"),
    ("index_of", lambda x: arrays.index_of(x, F.lit("click")), "coalesce(list_position(types, 'click'), 0)::INT - 1"),
    ("set_item", lambda x: F.array_join(arrays.set_item(x, 0, F.lit("x")), ","), _JOINED.format("list_concat(['x'], types[2:])")),
    ("insert", lambda x: F.array_join(arrays.insert(x, 1, F.lit("x")), ","), _JOINED.format("list_concat(list_append(types[1:1], 'x'), types[2:])")),
    ("remove_first", lambda x: F.array_join(arrays.remove(x, F.lit("click")), ","), _JOINED.format("CASE WHEN coalesce(list_position(types, 'click'), 0) = 0 THEN types ELSE list_concat(types[1:list_position(types, 'click') - 1], types[list_position(types, 'click') + 1:]) END")),
    ("remove_at", lambda x: F.array_join(arrays.remove_at(x, 1), ","), _JOINED.format("list_concat(types[1:1], types[3:])")),
    ("clear", lambda x: F.size(arrays.clear(x)), "0::INT"),
):
    query(_TRAILS + f"SELECT user_id, {_sql} AS value FROM t", f"array_{_name}")(lambda spark, d, e=_expr: trails(spark, d).select("user_id", e(F.col("types")).alias("value")))

_VALUES = {"l1": "list_sum(list_transform(range(1, 65), lambda i: abs(a.e[i] - b.e[i])))", "l2": "list_distance(a.e, b.e)", "inner_product": "list_negative_inner_product(a.e, b.e)", "cosine": "1 - list_cosine_similarity(a.e, b.e)"}
_VECTORS = "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) "


def _distance(name: str, spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    q = F.broadcast(v.where("vec_id = 3").select(F.col("embedding").alias("q")))  # one row
    return v.join(q).select("vec_id", F.round(vectors.DISTANCES[name](F.col("embedding"), F.col("q")), 6).alias("distance"))


for _name, _sql in _VALUES.items():
    query(_VECTORS + f"SELECT a.vec_id, round({_sql}, 6) AS distance FROM v a, v b WHERE b.vec_id = 3", f"dist_{_name}")(partial(_distance, _name))


def _knn(k: int, distance: str, spark, d):
    v = table(spark, d, "embeddings")
    queries = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return vectors.nearest_batch(v, "embedding", queries, k, distance, "vec_id").withColumn("distance", F.round("distance", 6) + 0)


for _name, _k, _sql in (("knn_l2", 10, "list_distance(a.e, b.e)"), ("knn_batch_cos", 5, "1 - list_cosine_similarity(a.e, b.e)")):
    query(_VECTORS + f"SELECT b.vec_id AS qid, row_number() OVER (PARTITION BY b.vec_id ORDER BY round({_sql}, 12), a.vec_id)::INT AS rank, a.vec_id AS id, round({_sql}, 6) + 0 AS distance FROM v a, v b WHERE b.vec_id % 20 = 0 QUALIFY rank <= {_k}", _name)(partial(_knn, _k, "l2" if _name == "knn_l2" else "cosine"))


@query("SELECT label, pos::INT AS pos, round(avg(x::DOUBLE), 6) AS value FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY label, pos")
def centroid(spark, d):
    return vectors.centroid(table(spark, d, "embeddings"), "embedding", "label").withColumn("value", F.round("value", 6))


@query("SELECT o_orderkey AS orderkey, coalesce(nullif(o_custkey, 3), 0) AS customerId FROM orders")
def dto_ids(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey"), F.nullif("o_custkey", F.lit(3)).alias("customer"))
    return shapes.reference_ids(orders, {"customer": "customerId"})


@query("SELECT 'Customer' AS kind, c_custkey AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS acctbal, c_mktsegment AS mktsegment FROM customer UNION ALL SELECT 'Supplier', s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier")
def dto_polymorphic(spark, d):
    return shapes.polymorphic(parties(spark, d))


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey")
def dto_selected_object(spark, d):
    selected = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return shapes.nested(table(spark, d, "orders"), "o_custkey", selected, "c_custkey", ["c_name"], "customer").select("o_orderkey", F.col("customer.c_name").alias("c_name"))


@query("SELECT l_orderkey AS id, count(p_partkey)::INT AS n FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 10) ON l_partkey = p_partkey GROUP BY l_orderkey")
def dto_selected_array(spark, d):
    parts = table(spark, d, "part").where("p_size < 10")
    return shapes.nested_many(order_parts(spark, d), "id", "parts", parts, "p_partkey", ["p_name"], "objects").select("id", F.size("objects").alias("n"))


def user_log(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    version = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("id"), version.cast("bigint").alias("version"), (F.col("event_type") == "error").alias("deleted"), "event_id", "value")


_LOG = "WITH l AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, event_type = 'error' AS deleted, event_id, value FROM events), "
_AT = "(SELECT * FROM (SELECT * FROM l WHERE version <= {v} QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1) WHERE NOT deleted)"


@query(_LOG + f"x AS {_AT.format(v=20)} SELECT id, version, event_id, value FROM x")
def snapshot_at_v(spark, d):
    return visible(user_log(spark, d), 20)


@query(_LOG + f"x AS {_AT.format(v=1 << 60)} SELECT id, version, event_id, value FROM x")
def latest_state(spark, d):
    return visible(user_log(spark, d))


@query(_LOG + f"a AS {_AT.format(v=10)}, b AS {_AT.format(v=60)} SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'insert' WHEN b.id IS NULL THEN 'delete' ELSE 'update' END AS change FROM a FULL JOIN b ON a.id = b.id WHERE a.version IS DISTINCT FROM b.version")
def log_diff(spark, d):
    return changes(user_log(spark, d), 10, 60)


_LATER = "(SELECT DISTINCT id FROM l WHERE version > 40)"


@query(_LOG + f"x AS {_AT.format(v=40)} SELECT id FROM {_LATER} WHERE id % 3 = 0 UNION SELECT id FROM x WHERE value > 60 AND id IN {_LATER} UNION SELECT id FROM l WHERE version > 40 AND NOT deleted AND value > 60")
def conflict_rows(spark, d):
    """What gets in the way of a transaction that read version 40, wrote a third of the ids and read a range of values."""
    log = user_log(spark, d)
    return conflicts(log, 40, log.where("id % 3 = 0").select("id"), F.col("value") > 60)


@query(_LOG + f"x AS {_AT.format(v=45)} SELECT id, version, event_id, value FROM x")
def snapshot_then_later_version(spark, d):
    """A version after the one that the log was compacted to."""
    return Log(user_log(spark, d)).compacted(30).at(45)


@query("WITH a AS (SELECT user_id AS id, count(*) AS n FROM events GROUP BY user_id) SELECT id, CASE WHEN id % 2 = 0 THEN n * 2 ELSE n END AS n FROM a WHERE id % 5 <> 0")
def transaction_result(spark, d):
    """Two writes of one transaction, seen together once it has committed."""
    rows = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n")).withColumns({"version": F.lit(1).cast("bigint"), "deleted": F.lit(False)})
    log = Log(rows)
    t = Transaction(log)
    t.write(t.where(F.col("id") % 2 == 0).select("id", F.lit(False).alias("deleted"), (F.col("n") * 2).alias("n")))
    t.write(t.scan().where("id % 5 = 0").select("id", F.lit(True).alias("deleted"), "n"))
    return t.commit(log).at().select("id", "n")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def ref_orphans(spark, d):
    return integrity.orphans(table(spark, d, "lineitem"), "l_orderkey", table(spark, d, "orders").where("o_orderstatus <> 'P'"), "o_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_orderkey FROM orders WHERE nullif(o_custkey, 3) IS NULL")
def missing_required(spark, d):
    return integrity.missing_required(table(spark, d, "orders").withColumn("o_custkey", F.nullif("o_custkey", F.lit(3))), "o_custkey").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def prevent_delete_violations(spark, d):
    return integrity.prevented(table(spark, d, "nation").where("n_regionkey = 1"), "n_nationkey", table(spark, d, "customer"), "c_nationkey").select("c_custkey")


_LINE_ID = "row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey)"


@query("SELECT 'Customer' AS kind, count(*) AS n FROM customer WHERE c_custkey IN (3, 5) UNION ALL SELECT 'Order', count(*) FROM orders WHERE o_custkey IN (3, 5) UNION ALL SELECT 'Line', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey IN (3, 5)")
def cascade_closure(spark, d):
    start = {"Customer": table(spark, d, "customer").where("c_custkey in (3, 5)").select("c_custkey")}
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"))
    lines = table(spark, d, "lineitem").select(F.xxhash64(F.struct("*")).alias("id"), F.col("l_orderkey").alias("order"))  # no two lines are equal
    gone = integrity.cascade(start, [("Customer", "Order", "customer", orders), ("Order", "Line", "order", lines)])
    out = None
    for kind, ids in gone.items():
        one = ids.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
        out = one if out is None else out.union(one)
    return out


_OBJECTS = Model.of(
    ClassDef("Customer", (Property("name", "string"),)),
    ClassDef("Order", (Reference("customer", "Customer", ONE, CASCADE),)),
    ClassDef("Supplier", (Property("name", "string"),)),
    ClassDef("Line", (Reference("order", "Order", ONE, CASCADE), Reference("supplier", "Supplier", OPTIONAL, SET_NULL))),
)


def _objects(spark, d) -> dict[str, DataFrame]:
    return {
        "Customer": table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
        "Order": table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer")),
        "Supplier": table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
        "Line": table(spark, d, "lineitem").select(F.xxhash64(F.struct("*")).alias("id"), F.col("l_orderkey").alias("order"), F.col("l_suppkey").alias("supplier")),  # no two lines are equal
    }


@query(
    "WITH o AS (SELECT * FROM orders WHERE o_custkey NOT IN (3, 5)), l AS (SELECT * FROM lineitem JOIN o ON l_orderkey = o_orderkey) SELECT 'Customer' AS kind, count(*) AS n, NULL::BIGINT AS linked FROM customer WHERE c_custkey NOT IN (3, 5) UNION ALL SELECT 'Order', count(*), NULL FROM o "
    "UNION ALL SELECT 'Supplier', count(*), NULL FROM supplier WHERE s_suppkey % 7 <> 0 UNION ALL SELECT 'Line', count(*), count(*) FILTER (l_suppkey % 7 <> 0) FROM l"
)
def delete_objects(spark, d):
    """Customers and suppliers deleted at once: orders and lines go with customers, lines lose their suppliers."""
    tables = _objects(spark, d)
    start = {"Customer": tables["Customer"].where("id in (3, 5)").select("id"), "Supplier": tables["Supplier"].where("id % 7 = 0").select("id")}
    left = integrity.delete_objects(_OBJECTS, tables, start)
    linked = lambda df: F.count("supplier") if "supplier" in df.columns else F.lit(None).cast("bigint")
    return reduce(DataFrame.union, [df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), linked(df).alias("linked")) for kind, df in left.items()])


@query("SELECT 'unknown_reference' AS rule, 'Order' AS class, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT 'unknown_reference', 'Line', count(*) FROM lineitem WHERE l_suppkey % 7 = 0 HAVING count(*) > 0")
def model_violations(spark, d):
    tables = _objects(spark, d)
    tables["Customer"] = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    tables["Supplier"] = tables["Supplier"].where("id % 7 <> 0")
    found = integrity.violations(_OBJECTS, tables)
    return reduce(DataFrame.union, [df.agg(F.lit(rule).alias("rule"), F.lit(name).alias("class"), F.count("*").alias("n")) for (rule, name, _), df in found.items()])


@query("SELECT p_name AS name, p_size AS size, 5 AS capacity, NULL::VARCHAR AS brand FROM part")
def create_with_defaults(spark, d):
    model = Model.of(ClassDef("Part", (Property("name", "string"), Property("size", "int"), Property("capacity", "int", default=5), Property("brand", "string"))))
    rows = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return integrity.create(model, "Part", rows, 100).drop("id")


@query("SELECT p_size, count(*) AS n FROM (SELECT p_size FROM part UNION ALL SELECT p_size FROM part WHERE p_partkey % 10 = 0) GROUP BY p_size")
def bulk_copy(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    new = integrity.copies(part, part.where("id % 10 = 0").select("id"), 1 << 40)
    return part.union(new).groupBy("p_size").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS id, nullif(nullif(o_custkey, 3), 0) AS customer FROM orders")
def dto_back(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") == 3, 0).otherwise(F.col("o_custkey")).alias("customerId"))
    return shapes.references_from_ids(orders, {"customerId": "customer"}, {"customer": (table(spark, d, "customer"), "c_custkey")})


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 7 <> 0 THEN l_suppkey END AS l_suppkey FROM lineitem")
def set_null_result(spark, d):
    dead = table(spark, d, "supplier").where("s_suppkey % 7 = 0")
    return integrity.set_null(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_suppkey", dead, "s_suppkey")


@query("SELECT l_orderkey AS id, coalesce(array_to_string(list(l_partkey ORDER BY l_linenumber, l_partkey) FILTER (l_partkey % 5 <> 0), ','), '') AS parts FROM lineitem GROUP BY l_orderkey")
def set_null_array(spark, d):
    dead = table(spark, d, "part").where("p_partkey % 5 = 0")
    return integrity.set_null(order_parts(spark, d), "parts", dead, "p_partkey", "id").select("id", F.array_join(F.col("parts").cast("array<string>"), ",").alias("parts"))


@query("SELECT p_size, p_retailprice, count(*) AS n FROM (SELECT p_size, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice * 2 ELSE p_retailprice END AS p_retailprice FROM part UNION ALL SELECT p_size, p_retailprice FROM part WHERE p_partkey % 2 = 1) GROUP BY ALL")
def upsert_result(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size", "p_retailprice")
    even = part.where("id % 2 = 0").withColumn("p_retailprice", F.col("p_retailprice") * 2)
    odd = part.where("id % 2 = 1").withColumn("id", F.lit(None).cast("bigint"))
    return integrity.upsert(part, even.union(odd)).groupBy("p_size", "p_retailprice").agg(F.count("*").alias("n"))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (1, 2)")
def delete_by_ids(spark, d):
    part = table(spark, d, "part").select("p_partkey")
    return integrity.delete(part, spark.createDataFrame([(1,), (2,)], "p_partkey bigint"), "p_partkey")


@query("SELECT p_partkey AS id, p_name AS name, p_size AS size, 5 AS capacity FROM part")
def add_property_default(spark, d):
    before = Model.of(ClassDef("Part", (Property("name", "string"), Property("size", "int"), Property("brand", "string"))))
    after = Model.of(ClassDef("Part", (Property("name", "string"), Property("size", "int"), Property("capacity", "int", default=5))))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))
    return migrate(rows, before, after, "Part")
