import pytest

from tessera.operators.store import ConstraintError, ForeignKey, Store, Table
from tessera.sources.dump import insert_statements
from tessera.streaming.changes import change_stream


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    s.create("dept", Table("id INT, name STRING", keys=[["id"]], not_null=["id"]))
    s.create(
        "emp",
        Table("id INT, dept INT, pay INT", keys=[["id"]], checks=["pay > 0"], defaults={"pay": "10"}, foreign=[ForeignKey(["dept"], "dept", ["id"], "cascade")]),
    )
    s.insert("dept", spark.createDataFrame([(1, "a"), (2, "b")], "id INT, name STRING"))
    s.insert("emp", spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id INT, dept INT"))
    return s


def ids(store, name):
    return sorted(r[0] for r in store.read(name).collect())


def test_defaults_and_constraints(spark, store):
    assert {r.pay for r in store.read("emp").collect()} == {10}
    with pytest.raises(ConstraintError):
        store.insert("emp", spark.createDataFrame([(9, 7)], "id INT, dept INT"))
    with pytest.raises(ConstraintError):
        store.insert("dept", spark.createDataFrame([(1, "z")], "id INT, name STRING"))
    with pytest.raises(ConstraintError):
        store.update("emp", {"pay": "-1"}, "id = 1")
    assert ids(store, "emp") == [1, 2, 3]


def test_update_delete_cascade(store):
    store.update("emp", {"pay": "pay * 2"}, "id = 2")
    assert {r.id: r.pay for r in store.read("emp").collect()} == {1: 10, 2: 20, 3: 10}
    store.delete("dept", "name LIKE 'A'")
    assert ids(store, "dept") == [2] and ids(store, "emp") == [2, 3]


def test_upsert(spark, store):
    rows = spark.createDataFrame([(1, "q"), (5, "n")], "id INT, name STRING")
    store.insert("dept", rows, "nothing")
    assert {r.id: r.name for r in store.read("dept").collect()} == {1: "a", 2: "b", 5: "n"}
    store.insert("dept", rows, "update", {"name": "'new'"})
    assert {r.id: r.name for r in store.read("dept").collect()} == {1: "new", 2: "b", 5: "new"}


def test_transactions(store):
    store.begin()
    store.delete("emp", "id = 1")
    store.savepoint("s")
    store.delete("emp", "id = 2")
    assert ids(store, "emp") == [3]
    store.rollback("s")
    assert ids(store, "emp") == [2, 3]
    store.commit()
    assert ids(store, "emp") == [2, 3]
    with pytest.raises(ConstraintError), store.transaction():
        store.delete("emp")
        store.update("dept", {"id": "1"})
    assert ids(store, "emp") == [2, 3]


def feed(spark, store, name):
    query = change_stream(spark, store.root).writeStream.format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return [tuple(r) for r in spark.table(name).select("table", "event", "row", "old").collect()]


def test_trigger_truncate_feed(spark, store):
    seen = []
    store.on("emp", "AFTER", "DELETE", lambda s: seen.append(len(ids(s, "emp"))))
    store.delete("emp", "id = 3")
    assert seen == [2]
    with pytest.raises(ConstraintError):
        store.truncate("dept")
    store.truncate("emp")
    store.truncate("dept")
    assert ids(store, "dept") == []
    events = [(t, e) for t, e, *_ in feed(spark, store, "feed")]
    assert events.count(("emp", "DELETE")) == 1 and ("emp", "TRUNCATE") in events and ("dept", "CREATE") in events


def test_feed_has_committed_work_alone(spark, store):
    store.begin()
    store.delete("emp", "id = 1")
    store.savepoint("s")
    store.delete("emp", "id = 2")
    store.rollback("s")
    store.commit()
    store.begin()
    store.update("emp", {"pay": "99"})
    store.rollback()
    with pytest.raises(ConstraintError):
        store.update("emp", {"pay": "0"})
    store.update("emp", {"pay": "pay + 1"}, "id = 2")
    rows = [r for r in sorted(feed(spark, store, "committed"), key=str) if r[:2] in (("emp", "DELETE"), ("emp", "UPDATE"))]
    assert rows == [("emp", "DELETE", '{"id":1,"dept":1,"pay":10}', None), ("emp", "UPDATE", '{"id":2,"dept":2,"pay":11}', '{"id":2,"dept":2,"pay":10}')]


def test_key_updates_act_on_children(spark, store):
    with pytest.raises(ConstraintError):
        store.update("dept", {"id": "3"}, "id = 1")  # the default is no action
    assert ids(store, "dept") == [1, 2] and ids(store, "emp") == [1, 2, 3]
    store.tables["emp"].foreign[0].on_update = "cascade"
    store.update("dept", {"id": "id + 1"})
    assert {r.id: r.dept for r in store.read("emp").collect()} == {1: 2, 2: 3, 3: None}
    assert ids(store, "dept") == [2, 3]


def test_rows_that_refer_to_their_own_table(spark, store):
    store.create("tree", Table("id INT, up INT", keys=[["id"]], foreign=[ForeignKey(["up"], "tree", ["id"], "cascade")]))
    store.insert("tree", spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None)], "id INT, up INT"))
    with pytest.raises(ConstraintError):
        store.insert("tree", spark.createDataFrame([(5, 9)], "id INT, up INT"))
    store.delete("tree", "id = 1")
    assert ids(store, "tree") == [4]


def test_store_opens_again(spark, store):
    store.begin()
    store.delete("emp")
    other = Store(spark, store.root)
    assert ids(other, "emp") == [1, 2, 3] and other.tables == Store(spark, store.root).tables
    store.rollback()
    other.insert("dept", spark.createDataFrame([(7, "z")], "id INT, name STRING"))
    with pytest.raises(ConstraintError):
        other.insert("emp", spark.createDataFrame([(1, 1)], "id INT, dept INT"))
    assert ids(Store(spark, store.root), "dept") == [1, 2, 7]
    with pytest.raises(ValueError):
        store.delete("emp", "id = 1")  # the other one has written since
    assert ids(store, "dept") == [1, 2, 7] and ids(store, "emp") == [1, 2, 3]


def test_definitions_are_part_of_transactions(spark, store):
    store.begin()
    store.create("t", Table("x INT"))
    store.drop("emp")
    assert "t" in store.tables and "emp" not in store.tables
    store.rollback()
    assert "t" not in store.tables and ids(store, "emp") == [1, 2, 3]
    with pytest.raises(ValueError):
        store.rollback()


def test_inserts_append(spark, store):
    before = list(store.tables["dept"].files)
    store.insert("dept", spark.createDataFrame([(i, "x") for i in range(10, 13)], "id INT, name STRING"))
    assert store.tables["dept"].files[: len(before)] == before and len(store.tables["dept"].files) == len(before) + 1


def test_no_cascade_comes_back(spark, store):
    store.create("a", Table("id INT, b INT", keys=[["id"]]))
    store.create("b", Table("id INT, a INT", keys=[["id"]], foreign=[ForeignKey(["a"], "a", ["id"], "cascade")]))
    table = Table("id INT, b INT", keys=[["id"]], foreign=[ForeignKey(["b"], "b", ["id"], "cascade")])
    with pytest.raises(ConstraintError):
        store.alter("a", table)
    assert store.tables["a"].foreign == []


def test_dump(spark):
    rows = insert_statements(spark.createDataFrame([(1, "it's"), (2, None)], "id INT, name STRING"), "t").collect()
    assert [r[0] for r in rows] == ["INSERT INTO t (id, name) VALUES (1, 'it''s');", "INSERT INTO t (id, name) VALUES (2, NULL);"]
