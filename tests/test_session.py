from collections import OrderedDict

import pytest

from tessera.dialect.engine import SqlSession
from tessera.dialect.rewrite import DialectError
from tessera.operators.access import matches
from tessera.operators.store import Store
from tessera.streaming.changes import windowed_counts

SF = "/root/testdata/sf0.001"


@pytest.fixture
def session(spark, tmp_path):
    return SqlSession(spark, SF, store=Store(spark, f"file://{tmp_path}/store"))


def test_nothing_gets_below_row_filters(spark):
    filtered = SqlSession(spark, SF, row_filters={"customer": "c_custkey < 0"})
    assert filtered.sql("SELECT * FROM customer").count() == 0
    spark.sql("SELECT 1 AS c_custkey").createOrReplaceTempView("beside")
    for text in (
        f"SELECT * FROM parquet.`{SF}/customer.parquet`", "SELECT * FROM beside", "SELECT * FROM (TABLE beside)", "SELECT * FROM nation WHERE EXISTS (SELECT 1 FROM beside)",
        "WITH a AS (SELECT * FROM beside) SELECT * FROM a", "SELECT * FROM nation, beside", "SELECT * FROM nation JOIN beside ON true", "SELECT * FROM global_temp.x", "SELECT * FROM 'x'",
        f"SELECT * FROM read_files('{SF}')",
    ):
        with pytest.raises(DialectError):
            filtered.sql(text)


def test_names_in_strings_and_functions_stay(spark):
    s = SqlSession(spark, SF)
    row = s.sql("SELECT 'from nation' AS a, '{0} , region' AS b, EXTRACT(YEAR FROM o_orderdate) > 0 AS c, TRIM(LEADING 'x' FROM 'xy') AS d FROM orders AS o LIMIT 1").first()
    assert tuple(row) == ("from nation", "{0} , region", True, "y")
    assert s.sql("SELECT COUNT(*) FROM region r, nation n, (SELECT 1 AS one) t WHERE r.r_regionkey = n.n_regionkey").first()[0] == 25
    assert s.sql("SELECT COUNT(*) FROM nation WHERE n_nationkey IS DISTINCT FROM n_regionkey").first()[0] > 0
    with pytest.raises(DialectError):
        s.sql("SELECT * FROM nowhere")


def test_cache_follows_commits(session):
    session.cache = OrderedDict()
    session.script("CREATE TABLE t (x INT); INSERT INTO t VALUES (1)")
    first = session.sql("SELECT * FROM t")
    assert session.sql("SELECT * FROM t") is first
    session.sql("INSERT INTO t VALUES (2)")
    assert session.sql("SELECT * FROM t").count() == 2


def test_users_and_passwords(session, spark):
    session.script("CREATE USER ann IDENTIFIED BY 'one'; ALTER USER ann IDENTIFIED BY 'two'")
    known = session.store.state["users"]["ann"]["secret"]
    assert matches("two", known) and not matches("one", known) and "two" not in known
    assert not any("one" in r.statement or "two" in r.statement for r in session.sql("INSPECT AUDIT").collect())
    with pytest.raises(PermissionError):
        SqlSession(spark, store=session.store, user="nobody")
    with pytest.raises(PermissionError):
        SqlSession(spark, store=session.store, user="ann").sql("CREATE USER eve IDENTIFIED BY 'x'")


def test_audit_export(session, spark, tmp_path):
    session.sql("CREATE TABLE t (x INT)")
    for form in ("json", "csv", "sql"):
        session.sql(f"EXPORT AUDIT TO 'file://{tmp_path}/{form}' FORMAT {form}")
    assert spark.read.json(f"file://{tmp_path}/json").where("statement = 'CREATE TABLE t (x INT)'").count() == 1
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").count() == 2
    assert spark.read.text(f"file://{tmp_path}/sql").first()[0].startswith("INSERT INTO audit (at, user, statement, outcome) VALUES ('")


def test_statements_that_do_not_hold(session):
    session.script("CREATE TABLE t (x INT DEFAULT (1 + 1), y TEXT)")
    for text in ("INSERT INTO t VALUES (1)", "INSERT INTO u VALUES (1)", "UPDATE t SET x", "CREATE TABLE t2 (x NOTYPE)", "DROP TABLE u", "CALL p()", "FLY AWAY", "", "CREATE VIEW v AS SELECT * FROM nowhere", "USE nowhere"):
        with pytest.raises((DialectError, ValueError)):
            session.sql(text)
    with pytest.raises(ValueError):
        session.sql("CREATE TABLE t (x INT)")
    session.sql("INSERT INTO t (y) VALUES ($1)", "a'b; DROP TABLE t")
    assert [tuple(r) for r in session.sql("SELECT * FROM t WHERE y = $1", "a'b; DROP TABLE t").collect()] == [(2, "a'b; DROP TABLE t")]


def test_scripts_survive_in_the_store(session, spark):
    session.script("CREATE TABLE t (x INT); CREATE PROCEDURE add_one(n INT) BEGIN INSERT INTO t VALUES ($1); END; CREATE VIEW v AS SELECT x * 10 AS y FROM t")
    again = SqlSession(spark, store=Store(spark, session.store.root))
    again.sql("CALL add_one(4)")
    assert again.sql("SELECT y FROM v").first()[0] == 40
    again.script("DROP PROCEDURE add_one; DROP VIEW v; DROP VIEW IF EXISTS v")
    with pytest.raises(DialectError):
        again.sql("SELECT * FROM v")


def test_windowed_counts(spark):
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:00:00", "a", 4.0)], "ts string, event_type string, value double")
    got = sorted((str(r.start), r.n, r.v) for r in windowed_counts(events.selectExpr("cast(ts as timestamp) ts", "event_type", "value")).collect())
    assert got == [("2024-01-01 00:00:00", 2, 3.0), ("2024-01-01 01:00:00", 1, 4.0)]
