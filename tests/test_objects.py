import pytest
from pyspark.sql import functions as F

from orebase.functions import arrays, vectors
from orebase.operators import integrity, lookup, navigate, shapes
from orebase.plans import ids, keys
from orebase.plans.evolution import diff, migrate
from orebase.plans.model import CASCADE, MANY, ONE, OPTIONAL, PREVENT, SET_NULL, ClassDef, Index, Model, ModelError, Property, Reference
from orebase.sources.store import Closed, Conflict, Log, Transaction, conflicts, read_log, write_version
from orebase.streaming.tail import tail


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_ids_round_trip(spark):
    df = spark.createDataFrame([(-512, 1), (3, 77)], "c int, n bigint").withColumn("id", ids.compose(F.col("c"), F.col("n")))
    assert rows(df.select(ids.class_number(F.col("id")), ids.counter(F.col("id")))) == [(-512, 1), (3, 77)]


def test_nulls_in_ranges_and_unique_keys(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "a", 2), (3, "b", 3), (4, None, 4)], "id bigint, k string, v int")
    up, down = Index("k", (("k", True),), sorted=True), Index("k", (("k", False),), sorted=True)
    assert [r.id for r in lookup.before(df, up, ("b",)).collect()] == [1, 4, 2]
    assert [r.id for r in lookup.after(df, up, (None,)).collect()] == [2, 3]
    assert [r.id for r in lookup.before(df, down, ("a",)).collect()] == [3]
    assert [r.id for r in lookup.index_range(df, up, backward=True).collect()] == [3, 2, 4, 1]
    assert rows(lookup.duplicates(df, up)) == [(None, 2)]
    with pytest.raises(ModelError):
        lookup.find(df, Index("h", (("k", True), ("v", True))), ("a",))
    with pytest.raises(lookup.NotFound):
        lookup.get_strict(df, 9)


def test_collated_key(spark):
    df = spark.createDataFrame([(1, "B"), (2, "a"), (3, "b")], "id bigint, k string")
    assert [r.id for r in lookup.index_range(df, Index("k", (("k", True),), sorted=True, collation="UNICODE")).collect()] == [2, 3, 1]
    assert rows(lookup.find(df, Index("k", (("k", True),), collation="UNICODE_CI"), ("b",)).select("id")) == [(1,), (3,)]


def test_range_filter_reaches_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "id as k").write.parquet(f"{tmp_path}/t")
    df = lookup.after(spark.read.parquet(f"{tmp_path}/t"), Index("k", (("k", True), ("id", True)), sorted=True), (3, 4))
    assert "GreaterThanOrEqual(k,3)" in df._jdf.queryExecution().executedPlan().toString()


def test_arrays(spark):
    df = spark.createDataFrame([(["a", None, "a"],), (None,)], "x array<string>")
    x = F.col("x")
    got = df.select(arrays.contains(x, F.lit(None)), arrays.index_of(x, F.lit("z")), arrays.remove(x, F.lit("a")), arrays.count(x), arrays.clear(x)).collect()
    assert [tuple(r) for r in got] == [(True, -1, [None, "a"], 3, []), (None, None, None, None, None)]
    with pytest.raises(Exception, match="index out of range"):
        df.select(arrays.insert(x, 3, F.lit("b"))).collect()


def test_distances(spark):
    v = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 5.0, 6.0]), ([1.0, 0.0, 0.0], [0.0, 1.0, 0.0]), ([0.0], [2.0])], "a array<double>, b array<double>")
    got = v.select(vectors.l2(F.col("a"), F.col("b")), vectors.cosine(F.col("a"), F.col("b"))).collect()
    assert got[0][0] == pytest.approx(27**0.5) and got[1][1] == 1 and got[2][1] == 1
    pts = spark.createDataFrame([(1, [2.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 3.0])], "id bigint, v array<double>")
    assert [r.id for r in vectors.nearest(pts, "v", [0, 0, 0], 3).collect()] == [2, 1, 3]
    with pytest.raises(Exception, match="differ in length"):
        v.select(vectors.l1(F.col("a"), F.array(F.lit(1.0)))).collect()


def test_walk_and_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "a bigint, b bigint")
    assert rows(navigate.reach(e, spark.createDataFrame([(1,)], "id bigint"), 2)) == [(2, 1), (3, 2)]
    links = e.select(F.col("b").alias("id"), F.col("a").alias("ref"))
    gone = integrity.cascade({"N": spark.createDataFrame([(1,)], "id bigint")}, [("N", "N", "ref", links)])
    assert rows(gone["N"]) == [(1,), (2,), (3,), (4,)]
    with pytest.raises(navigate.NotTracked):
        navigate.inverse(e, "a", e, "b", tracked=False)


def test_upsert_rules(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id bigint, s string, n int")
    got = integrity.upsert(old, spark.createDataFrame([(1, "x"), (None, "new")], "id bigint, s string"))
    assert rows(got.select("s", "n")) == [("b", 2), ("new", None), ("x", 1)]
    for bad, kind in (([(9, "x")], "unknown_id"), ([(1, "x"), (1, "y")], "id_not_unique")):
        with pytest.raises(integrity.DataError) as e:
            integrity.upsert(old, spark.createDataFrame(bad, "id bigint, s string"))
        assert e.value.kind == kind


def test_model_rules(spark):
    with pytest.raises(ModelError, match="set_null_on_one"):
        Model.of(ClassDef("A", (Reference("r", "A", ONE, SET_NULL),)))
    one, two = Model.of(ClassDef("A", (Property("x", "int"),))), Model.of(ClassDef("A", (Property("x", "string"),)))
    with pytest.raises(ModelError, match="change_type"):
        diff(one, two)
    with pytest.raises(ModelError, match="add_required_reference"):
        diff(one, Model.of(ClassDef("A", (Property("x", "int"), Reference("r", "A", ONE)))))
    three = Model.of(ClassDef("A", (Property("y", "int", default=4),)))
    assert diff(one, three) == [("add_property", "A", "y"), ("drop_property", "A", "x")]
    assert rows(migrate(spark.createDataFrame([(1, 2)], "id bigint, x int"), one, three, "A")) == [(1, 4)]


KIND = "id bigint, deleted boolean, v int"


def log_of(spark, *values):
    return Log(spark.createDataFrame([(i, 1, False, v) for i, v in values], "id bigint, version bigint, deleted boolean, v int"))


def put(t, spark, *values):
    t.write(spark.createDataFrame([(i, v is None, v) for i, v in values], KIND))


def one(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id bigint")


def state(rows):
    return {r.id: r.v for r in rows.collect()}


def test_versions_and_compaction(spark, tmp_path):
    path = str(tmp_path / "log")
    assert read_log(spark, path) is None
    write_version(spark.createDataFrame([(1, False, 10), (2, False, 20)], KIND), path, 1)
    write_version(spark.createDataFrame([(1, False, 11), (2, True, None)], KIND), path, 2)
    write_version(spark.createDataFrame([(3, False, 30)], KIND), path, 3)
    with pytest.raises(Exception, match="exists"):
        write_version(spark.createDataFrame([(1, False, 12)], KIND), path, 2)
    spark.createDataFrame([(9, False, 9)], KIND).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/version=4")
    log = Log(read_log(spark, path))
    assert log.version() == 3 and state(log.at(1)) == {1: 10, 2: 20} and state(log.at()) == {1: 11, 3: 30}
    short = log.compacted(2)
    assert state(short.at(2)) == {1: 11} and state(short.at()) == {1: 11, 3: 30}
    with pytest.raises(ValueError):
        short.at(1)
    assert rows(conflicts(log.rows, 1, one(spark, 2))) == [(2,)]  # a deletion counts
    got = []
    tail(spark, path, KIND, lambda df, _: got.extend((r.id, r.version) for r in df.collect()), str(tmp_path / "seen")).awaitTermination()
    assert {(1, 1), (2, 1), (1, 2), (2, 2), (3, 3)} <= set(got)


def test_dirty_writes_and_reads(spark):
    log = log_of(spark, (1, 10), (2, 20))
    t1, t2 = Transaction(log), Transaction(log)
    put(t1, spark, (1, 11))
    put(t2, spark, (1, 12), (2, 22))
    assert state(t2.get(one(spark, 1))) == {1: 12} and state(t1.get(one(spark, 2))) == {2: 20}
    now = t2.commit(log)
    with pytest.raises(Conflict):
        t1.commit(now)
    assert state(now.at()) == {1: 12, 2: 22}


def test_rolled_back_and_intermediate_values_are_never_read(spark):
    log = log_of(spark, (1, 10), (2, 20))
    t1, t2 = Transaction(log), Transaction(log)
    put(t1, spark, (1, 101))
    put(t1, spark, (1, 11))
    assert state(t2.get(one(spark, 1))) == {1: 10} and state(t1.get(one(spark, 1))) == {1: 11}
    t1.rollback()
    assert t2.commit(log) is log
    for use in (lambda: t1.commit(log), lambda: t1.scan(), lambda: put(t2, spark, (1, 5))):
        with pytest.raises(Closed):
            use()


def test_lost_update_and_read_skew(spark):
    log = log_of(spark, (1, 10), (2, 20))
    t1, t2 = Transaction(log), Transaction(log)
    t1.get(one(spark, 1))
    put(t2, spark, (1, 12), (2, 18))
    now = t2.commit(log)
    assert state(t1.get(one(spark, 2))) == {2: 20}  # still the version it reads
    put(t1, spark, (2, 0))
    with pytest.raises(Conflict):
        t1.commit(now)


def test_write_skew(spark):
    log = log_of(spark, (1, 10), (2, 20))
    t1, t2 = Transaction(log), Transaction(log)
    for t, i in ((t1, 1), (t2, 2)):
        t.get(one(spark, 1, 2))
        put(t, spark, (i, 11))
    now = t1.commit(log)
    with pytest.raises(Conflict):
        t2.commit(now)


def test_predicates_meet_rows_that_come_change_or_go(spark):
    log = log_of(spark, (1, 10), (2, 20))
    high = F.col("v") >= 15
    for change, meets in ([(3, 30)], True), ([(2, 5)], True), ([(2, None)], True), ([(1, 11)], False):
        t1, t2 = Transaction(log), Transaction(log)
        t1.where(high)
        put(t1, spark, (7, 1))
        put(t2, spark, *change)
        now = t2.commit(log)
        if meets:
            with pytest.raises(Conflict):
                t1.commit(now)
        else:
            assert state(t1.commit(now).at()) == {1: 11, 2: 20, 7: 1}


def test_reading_transactions(spark):
    log = log_of(spark, (1, 10))
    t = Transaction(log, writes=False)
    with pytest.raises(Closed):
        put(t, spark, (1, 2))
    assert state(t.scan()) == {1: 10}


def test_delete_actions_in_order(spark):
    tree = Model.of(ClassDef("A"), ClassDef("B", (Reference("a", "A", ONE, CASCADE),)), ClassDef("C", (Reference("b", "B", OPTIONAL, PREVENT), Reference("all", "A", MANY, SET_NULL))))
    a = one(spark, 1, 2)
    b = spark.createDataFrame([(10, 1), (11, 2)], "id bigint, a bigint")
    c = spark.createDataFrame([(20, None, [1, 2, 1]), (21, 11, [2])], "id bigint, b bigint, all array<bigint>")
    left = integrity.delete_objects(tree, {"A": a, "B": b, "C": c}, {"A": one(spark, 1)})
    assert {k: rows(v) for k, v in left.items()} == {"A": [(2,)], "B": [(11, 2)], "C": [(20, None, [2]), (21, 11, [2])]}
    for start, kind in (({"A": one(spark, 2)}, "delete_prevented"), ({"A": one(spark, 9)}, "unknown_id")):
        with pytest.raises(integrity.DataError) as e:
            integrity.delete_objects(tree, {"A": a, "B": b, "C": c}, start)
        assert e.value.kind == kind
    # Deleted in an earlier round, the holder no longer holds.
    both = Model.of(ClassDef("A"), ClassDef("B", (Reference("a", "A", ONE, CASCADE),)), ClassDef("C", (Reference("b", "B", OPTIONAL, PREVENT),)))
    left = integrity.delete_objects(both, {"A": a, "B": b, "C": c.drop("all")}, {"A": one(spark, 2), "C": one(spark, 21)})
    assert rows(left["B"]) == [(10, 1)] and rows(left["C"]) == [(20, None)]


def test_create_and_rules(spark):
    m = Model.of(ClassDef("X", (Property("n", "int", default=4), Property("s", "string")), abstract=True, indexes=(Index("n", (("n", True),), unique=True),)), ClassDef("Y", (Reference("r", "Y", ONE),), base="X"), ClassDef("Z", base="X"))
    with pytest.raises(ModelError, match="abstract_class"):
        integrity.create(m, "X", spark.createDataFrame([("a",)], "s string"), 0)
    made = integrity.create(m, "Z", spark.createDataFrame([("a",)], "s string"), 7)
    assert rows(made.select("n", "s")) == [(4, "a")] and made.first().id > 7
    with pytest.raises(integrity.DataError):
        integrity.create(m, "Y", spark.createDataFrame([("a",)], "s string"), 0)
    y = spark.createDataFrame([(1, 4, "b", 5)], "id bigint, n int, s string, r bigint")
    assert set(integrity.violations(m, {"Y": y, "Z": made})) == {("unknown_reference", "Y", "r"), ("not_unique", "X", "n")}
    with pytest.raises(integrity.DataError):
        integrity.ensure_unique({"Y": y, "Z": made}, m.indexes("Y")["n"])
    assert keys.index_by_name(m, "Z", "n", ("int",)).name == "n"
    for name, kinds, code in (("q", ("int",), "unknown_index"), ("n", ("string",), "key_types"), ("n", ("int", "int"), "key_types")):
        with pytest.raises(ModelError, match=code):
            keys.index_by_name(m, "Z", name, kinds)
    assert ids.reserve(7, 3) == range(8, 11)


def test_orphans_of_arrays_keep_equal_rows(spark):
    df = spark.createDataFrame([([1, 9, 9],), ([1, 9, 9],), ([1],), ([None, 1],)], "refs array<bigint>")
    assert rows(integrity.orphans(df, "refs", one(spark, 1), "id")) == [([1, 9, 9],), ([1, 9, 9],)]


def test_transfer_ids_and_shapes(spark):
    df = spark.createDataFrame([(5, 1), (6, 0)], "id bigint, aId bigint")
    assert rows(shapes.references_from_ids(df, {"aId": "a"}, {"a": (one(spark, 1), "id")})) == [(5, 1), (6, None)]
    with pytest.raises(integrity.DataError):
        shapes.references_from_ids(df, {"aId": "a"}, {"a": (one(spark, 2), "id")})
    new = shapes.inserted(df, 9)
    assert rows(new.select("aId")) == [(0,), (1,)] and new.where("id > 9").select("id").distinct().count() == 2
    assert shapes.scalars(df, ["id", "aId"], ("aId",)).columns == ["id"]


def test_places_outside_arrays(spark):
    df = spark.createDataFrame([([1, 2],)], "x array<bigint>")
    none = spark.createDataFrame([(None,)], "x array<bigint>")
    x, v = F.col("x"), F.lit(5).cast("bigint")
    for f in (lambda i: arrays.item(x, i), lambda i: arrays.set_item(x, i, v), lambda i: arrays.insert(x, i, v), lambda i: arrays.remove_at(x, i), lambda i: arrays.insert_reference(x, i, v)):
        assert none.select(f(0)).first()[0] is None
        for i in (-1, 9):
            with pytest.raises(Exception, match="index out of range"):
                df.select(f(i)).collect()
    assert df.select(arrays.insert_reference(x, 2, v)).first()[0] == [1, 2, 5] and df.select(arrays.insert_reference(x, 0, v)).first()[0] == [5, 1, 2]
    with pytest.raises(Exception, match="null reference"):
        df.select(arrays.insert_reference(x, 0, F.lit(None).cast("bigint"))).collect()


def test_unknown_distance(spark):
    with pytest.raises(ValueError, match="unknown distance"):
        vectors.by_name("l7")


def test_graph_of_objects_with_a_cycle(spark):
    links = spark.createDataFrame([(1, [2, 3]), (2, [1]), (3, None), (4, [1])], "id bigint, next array<bigint>")
    got = navigate.object_graph({"N": one(spark, 1)}, [("N", "next", "N", links)], 5)
    assert rows(got["N"]) == [(1, 0), (2, 1), (3, 1)]
