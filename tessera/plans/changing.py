"""Registered queries over changing tables: scripts of the dialect in a new store, each with the SQL of what must be left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.dialect.engine import SqlSession
from tessera.operators.store import ConstraintError, Store
from tessera.session import shared_folder
from tessera.sources import dump

REGISTRY: dict[str, tuple] = {}

TABLES = """
CREATE TABLE area (id INT PRIMARY KEY, name TEXT NOT NULL);
CREATE TABLE land (id INT PRIMARY KEY, name TEXT, area INT DEFAULT 0, CHECK (id >= 0));
INSERT INTO area SELECT r_regionkey, r_name FROM region;
INSERT INTO land SELECT n_nationkey, n_name, n_regionkey FROM nation;
"""
LINKED = "ALTER TABLE land ADD CONSTRAINT to_area FOREIGN KEY (area) REFERENCES area (id) "


def opened(spark: SparkSession, sf_dir: str, user: str = "admin") -> SqlSession:
    return SqlSession(spark, sf_dir, store=Store(spark, shared_folder(spark, "store")), user=user)


def script(name: str, text: str, answer: str, oracle: str, refused: str | None = None, tables: bool = True) -> None:
    """Register a script, then a statement that must be refused, then the query of what is left."""

    def left(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = opened(spark, sf_dir)
        session.script(TABLES * tables + text)
        if refused:
            try:
                session.sql(refused)
            except ConstraintError:
                pass
            else:
                raise AssertionError(f"{refused} was not refused")
        return session.sql(answer)

    REGISTRY[name] = (left, oracle)


LAND = "SELECT id, name, area FROM land"
NATION = "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS area FROM nation"

script("dml_insert", "INSERT INTO land (id, name) VALUES (100, 'New'), (101, 'It''s'); INSERT INTO land VALUES (102, NULL, 3);", LAND, f"{NATION} UNION ALL VALUES (100, 'New', 0), (101, 'It''s', 0), (102, NULL, 3)")
script("dml_insert_select", "INSERT INTO land SELECT id + 1000, UPPER(name), area FROM land WHERE area = 2;", LAND, f"{NATION} UNION ALL SELECT n_nationkey + 1000, upper(n_name), n_regionkey FROM nation WHERE n_regionkey = 2")
script("dml_upsert", "INSERT INTO land VALUES (1, 'One', 9), (200, 'Two', 9) ON CONFLICT (id) DO UPDATE SET name = EXCLUDED.name, area = area + 10;", LAND, "SELECT n_nationkey AS id, CASE WHEN n_nationkey = 1 THEN 'One' ELSE n_name END AS name, CASE WHEN n_nationkey = 1 THEN n_regionkey + 10 ELSE n_regionkey END AS area FROM nation UNION ALL SELECT 200, 'Two', 9")
script("dml_upsert_nothing", "INSERT INTO land VALUES (1, 'One', 9), (200, 'Two', 9) ON CONFLICT DO NOTHING;", LAND, f"{NATION} UNION ALL SELECT 200, 'Two', 9")
script("dml_update", "UPDATE land SET name = LOWER(name), area = area * 2 WHERE area IN (1, 2) AND name LIKE '%a';", LAND, "SELECT n_nationkey AS id, CASE WHEN h THEN lower(n_name) ELSE n_name END AS name, CASE WHEN h THEN n_regionkey * 2 ELSE n_regionkey END AS area FROM (SELECT *, n_regionkey IN (1, 2) AND n_name ILIKE '%a' AS h FROM nation)")
script("dml_update_null", "UPDATE land SET area = NULL WHERE id < 5;", LAND, "SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey >= 5 THEN n_regionkey END AS area FROM nation")
script("dml_delete", "DELETE FROM land WHERE area = 1 OR id > 20;", LAND, f"SELECT * FROM ({NATION}) WHERE NOT (area = 1 OR id > 20)")
script("dml_truncate", "TRUNCATE TABLE land;", "SELECT COUNT(*) AS n FROM land", "SELECT 0 AS n")
script("dml_serial", "CREATE TABLE note (id SERIAL PRIMARY KEY, t TEXT DEFAULT UPPER('x')); INSERT INTO note (t) VALUES ('a'), ('b'); INSERT INTO note (t) VALUES ('c');", "SELECT id, t FROM note", "SELECT CAST(id AS BIGINT) AS id, t FROM (VALUES (1, 'a'), (2, 'b'), (3, 'c')) v(id, t)", tables=False)
script("fk_cascade", LINKED + "ON DELETE CASCADE; DELETE FROM area WHERE id = 1;", LAND, f"SELECT * FROM ({NATION}) WHERE area <> 1")
script("fk_set_null", LINKED + "ON DELETE SET NULL; DELETE FROM area WHERE id = 1;", LAND, "SELECT n_nationkey AS id, n_name AS name, nullif(n_regionkey, 1) AS area FROM nation")
script("fk_set_default", LINKED + "ON DELETE SET DEFAULT; DELETE FROM area WHERE id = 1;", LAND, "SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_regionkey = 1 THEN 0 ELSE n_regionkey END AS area FROM nation")
script("fk_update_cascade", LINKED + "ON UPDATE CASCADE; UPDATE area SET id = id + 50 WHERE id > 2;", LAND, "SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_regionkey > 2 THEN n_regionkey + 50 ELSE n_regionkey END AS area FROM nation")
script("fk_update_set_null", LINKED + "ON UPDATE SET NULL ON DELETE CASCADE; UPDATE area SET id = 77 WHERE id = 3;", LAND, "SELECT n_nationkey AS id, n_name AS name, nullif(n_regionkey, 3) AS area FROM nation")
script("fk_restrict", LINKED + "ON DELETE RESTRICT;", "SELECT COUNT(*) AS n FROM area", "SELECT COUNT(*) AS n FROM region", "DELETE FROM area WHERE id = 0")
script("fk_no_action_update", LINKED + ";", "SELECT id FROM area", "SELECT r_regionkey AS id FROM region", "UPDATE area SET id = 99 WHERE id = 0")
script("fk_check", LINKED + ";", "SELECT COUNT(*) AS n FROM land", "SELECT COUNT(*) AS n FROM nation", "INSERT INTO land VALUES (500, 'x', 44)")
script("fk_cycle", "CREATE TABLE a (id INT PRIMARY KEY, b INT); CREATE TABLE b (id INT PRIMARY KEY, a INT REFERENCES a (id) ON DELETE CASCADE);", "SELECT COUNT(*) AS n FROM a", "SELECT 0 AS n", "ALTER TABLE a ADD CONSTRAINT back FOREIGN KEY (b) REFERENCES b (id) ON DELETE CASCADE", tables=False)
script("check_constraint", "", LAND, NATION, "INSERT INTO land VALUES (30, 'ok', 1), (-1, 'bad', 1)")
script("unique_constraint", "ALTER TABLE land ADD CONSTRAINT once UNIQUE (name);", LAND, NATION, "INSERT INTO land SELECT id + 100, name, area FROM land")
script("primary_key", "", LAND, NATION, "INSERT INTO land VALUES (1, 'twice', 1)")
script("composite_key", "CREATE TABLE pair (a INT, b INT, PRIMARY KEY (a, b)); INSERT INTO pair VALUES (1, 1), (1, 2);", "SELECT a, b FROM pair", "SELECT 1 AS a, 1 AS b UNION ALL SELECT 1, 2", "INSERT INTO pair VALUES (2, 1), (1, 2)", tables=False)
script("not_null", "", "SELECT COUNT(*) AS n FROM area", "SELECT COUNT(*) AS n FROM region", "UPDATE area SET name = NULL WHERE id = 2")
script("tx_commit", "BEGIN; DELETE FROM land WHERE id < 10; UPDATE land SET area = 7; COMMIT;", LAND, "SELECT n_nationkey AS id, n_name AS name, 7 AS area FROM nation WHERE n_nationkey >= 10")
script("tx_rollback", "BEGIN; DELETE FROM land; CREATE TABLE gone (id INT); DROP TABLE area; ROLLBACK;", f"{LAND} WHERE area IN (SELECT id FROM area)", NATION)
script("tx_savepoint", "BEGIN; DELETE FROM land WHERE id = 1; SAVEPOINT s; DELETE FROM land; ROLLBACK TO s; SAVEPOINT t; DELETE FROM land WHERE id = 2; RELEASE SAVEPOINT t; COMMIT;", LAND, f"SELECT * FROM ({NATION}) WHERE id NOT IN (1, 2)")
script("alter_add_column", "ALTER TABLE land ADD COLUMN kind TEXT DEFAULT 'state';", "SELECT id, kind FROM land", "SELECT n_nationkey AS id, 'state' AS kind FROM nation")
script("alter_drop_column", "ALTER TABLE land DROP COLUMN area;", "SELECT * FROM land", "SELECT n_nationkey AS id, n_name AS name FROM nation")
script("alter_rename_column", "ALTER TABLE land RENAME COLUMN id TO number; DELETE FROM land WHERE number = 3;", "SELECT number, name FROM land", "SELECT n_nationkey AS number, n_name AS name FROM nation WHERE n_nationkey <> 3", "INSERT INTO land (number, name) VALUES (-5, 'checked still')")
script("alter_modify_column", "ALTER TABLE land MODIFY COLUMN area BIGINT; UPDATE land SET area = area + 3000000000;", "SELECT id, area FROM land", "SELECT n_nationkey AS id, n_regionkey + 3000000000 AS area FROM nation")
script("alter_drop_constraint", "ALTER TABLE land ADD CONSTRAINT low CHECK (id < 50); ALTER TABLE land DROP CONSTRAINT low; INSERT INTO land VALUES (60, 'x', 1);", "SELECT COUNT(*) AS n FROM land", "SELECT COUNT(*) + 1 AS n FROM nation", "INSERT INTO land VALUES (-60, 'x', 1)")
script("drop_table", "CREATE TABLE IF NOT EXISTS t (id INT); DROP TABLE t; DROP TABLE IF EXISTS t; CREATE TABLE t (x TEXT); INSERT INTO t VALUES ('new');", "SELECT x FROM t", "SELECT 'new' AS x", tables=False)
script("create_index", "CREATE INDEX by_area ON land (area); CREATE INDEX IF NOT EXISTS by_area ON land (area); CREATE INDEX by_name ON land (name); DROP INDEX by_name;", "INSPECT INDEXES", "SELECT 'by_area' AS name, 'land' AS \"table\", 'area' AS columns")
script("inspect_table", LINKED + ";", "INSPECT TABLE land", "SELECT * FROM (VALUES (0, 'id', 'int', false, 'primary', NULL, NULL), (1, 'name', 'string', true, '', NULL, NULL), (2, 'area', 'int', true, '', '0', 'area(id)')) v(position, name, type, nullable, key, default_text, refers_to)")
script("inspect_tables", "", "INSPECT TABLES", "SELECT * FROM (VALUES ('default', 'area', 2, 1), ('default', 'land', 3, 1)) v(database, name, n_columns, n_directories)")
script("database_join", "CREATE DATABASE other WITH ENCODING 'UTF8' OWNER 'me'; USE other; CREATE TABLE t (id INT, x TEXT); INSERT INTO t VALUES (1, 'a'), (2, 'b'); USE default;", "SELECT l.name, o.x FROM land l JOIN other.t o ON l.id = o.id", "SELECT n_name AS name, CASE n_nationkey WHEN 1 THEN 'a' ELSE 'b' END AS x FROM nation WHERE n_nationkey IN (1, 2)")
script("view_or_replace", "CREATE VIEW v AS SELECT id FROM land WHERE area = 1; CREATE OR REPLACE VIEW v AS SELECT id, name FROM land WHERE area = 2; CREATE VIEW IF NOT EXISTS v AS SELECT 1 AS x;", "SELECT name FROM v WHERE id > 9", "SELECT n_name AS name FROM nation WHERE n_regionkey = 2 AND n_nationkey > 9")
script("procedure_call", "CREATE PROCEDURE shift(by INT, of INT) BEGIN UPDATE land SET area = area + $1 WHERE area = $2; DELETE FROM land WHERE id = by; END; CALL shift(10, 2);", LAND, "SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_regionkey = 2 THEN 12 ELSE n_regionkey END AS area FROM nation WHERE n_nationkey <> 10")
script("trigger_insert", "CREATE TABLE log (what TEXT, at INT); CREATE TRIGGER t1 AFTER INSERT ON land FOR EACH ROW EXECUTE INSERT INTO log VALUES ('it''s in', 1); CREATE TRIGGER t2 BEFORE DELETE ON land EXECUTE INSERT INTO log VALUES ('out', 2); INSERT INTO land VALUES (90, 'n', 1); DELETE FROM land WHERE id = 90; DROP TRIGGER t1 ON land; INSERT INTO land VALUES (91, 'n', 1);", "SELECT what, at FROM log", "SELECT 'it''s in' AS what, 1 AS at UNION ALL SELECT 'out', 2")
script("prepare_text", "PREPARE p AS SELECT name FROM land WHERE area = $1 AND name <> $2;", "EXECUTE p (1, 'it''s')", "SELECT n_name AS name FROM nation WHERE n_regionkey = 1")
script("inspect_users", "CREATE USER ann IDENTIFIED BY 'x'; CREATE ROLE clerk; GRANT ROLE clerk TO ann; GRANT reader TO ann; CREATE USER bob IDENTIFIED BY 'y'; REVOKE ROLE clerk FROM ann; DROP USER bob;", "INSPECT USERS", "SELECT 'admin' AS name, 'admin' AS roles UNION ALL SELECT 'ann', 'reader'", tables=False)
script("audit_stats", "CREATE TABLE t (id INT); INSERT INTO t VALUES (1);", "SELECT * FROM t", "SELECT 1 AS id", tables=False)


def as_user(name: str, text: str, oracle: str, answer: str, denied: str | None = None) -> None:
    """Register what the user ann sees after a script of the administrator."""

    def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = opened(spark, sf_dir)
        session.script(TABLES + "CREATE USER ann IDENTIFIED BY 'secret';" + text)
        own = SqlSession(spark, sf_dir, store=session.store, user="ann")
        if denied:
            try:
                own.sql(denied)
            except PermissionError:
                pass
            else:
                raise AssertionError(f"{denied} was not denied")
        return own.sql(answer)

    REGISTRY[name] = (seen, oracle)


as_user("grant_where", "GRANT SELECT ON land WHERE area = 3 TO ann; CREATE VIEW v AS SELECT * FROM land;", f"SELECT * FROM ({NATION}) WHERE area = 3 AND id > 6", f"{LAND} WHERE id > 6", "DELETE FROM land WHERE id = 1")
as_user("grant_by_role", "CREATE ROLE clerk; GRANT SELECT, UPDATE ON land WHERE area = 1 TO clerk; GRANT SELECT ON land WHERE area = 2 TO ann; GRANT ROLE clerk TO ann;", f"SELECT * FROM ({NATION}) WHERE area IN (1, 2)", LAND, "SELECT * FROM area")
as_user("role_reader", "GRANT reader TO ann;", NATION, LAND, "INSERT INTO land VALUES (80, 'x', 1)")
as_user("revoke", "GRANT ON land TO ann; REVOKE ON land FROM ann; GRANT SELECT ON area TO ann;", "SELECT r_regionkey AS id, r_name AS name FROM region", "SELECT id, name FROM area", "SELECT * FROM land")


@(lambda f: REGISTRY.__setitem__("row_filter_update", (f, "SELECT n_nationkey AS id, CASE WHEN n_regionkey = 1 THEN 'mine' ELSE n_name END AS name FROM nation")))
def row_filter_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An UPDATE without WHERE by a user who may change some rows changes those."""
    session = opened(spark, sf_dir)
    session.script(TABLES + "CREATE USER ann IDENTIFIED BY 'secret'; GRANT UPDATE ON land WHERE area = 1 TO ann")
    SqlSession(spark, sf_dir, store=session.store, user="ann").sql("UPDATE land SET name = 'mine'")
    return session.sql("SELECT id, name FROM land")


@(lambda f: REGISTRY.__setitem__("audit_trail", (f, "SELECT 'admin' AS \"user\", 'done' AS outcome, CAST(5 AS BIGINT) AS count UNION ALL SELECT 'ann', 'denied', 1")))
def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = opened(spark, sf_dir)
    session.script(TABLES + "CREATE USER ann IDENTIFIED BY 'secret'")
    try:
        SqlSession(spark, sf_dir, store=session.store, user="ann").sql("DROP TABLE land")
    except PermissionError:
        pass
    return session.sql("INSPECT AUDIT STATS")


@(lambda f: REGISTRY.__setitem__("dump_and_import", (f, NATION)))
def dump_and_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store written as compressed SQL text and read into another."""
    session, other = opened(spark, sf_dir), opened(spark, sf_dir)
    session.script(TABLES + LINKED + "ON DELETE CASCADE")
    path = shared_folder(spark, "dump")
    dump.export_store(session.store, path, compress=True)
    ran, failed = dump.import_sql(other, path)
    if failed or ran != 32:
        raise AssertionError(f"{ran} statements, {failed}")
    return other.sql(LAND)


@(lambda f: REGISTRY.__setitem__("copy_csv", (f, NATION)))
def copy_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = opened(spark, sf_dir)
    session.script(TABLES + "CREATE TABLE again (id INT PRIMARY KEY, name TEXT, area INT)")
    path = shared_folder(spark, "csv")
    dump.export_csv(session.sql(LAND), path)
    dump.copy_into(session, "again", path)
    return session.sql("SELECT id, name, area FROM again")


@(lambda f: REGISTRY.__setitem__("copy_json", (f, NATION)))
def copy_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = opened(spark, sf_dir)
    session.script(TABLES + "CREATE TABLE again (id INT PRIMARY KEY, name TEXT, area INT)")
    path = shared_folder(spark, "json")
    dump.export_json(session.sql(LAND), path)
    dump.copy_into(session, "again", path, "json")
    return session.sql("SELECT id, name, area FROM again")


@(lambda f: REGISTRY.__setitem__("change_feed", (f, "SELECT 'area' AS \"table\", 'CREATE' AS event, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'area', 'INSERT', 5 UNION ALL SELECT 'land', 'CREATE', 1 UNION ALL SELECT 'land', 'INSERT', 25 UNION ALL SELECT 'land', 'UPDATE', 5 UNION ALL SELECT 'land', 'ALTER', 1 UNION ALL SELECT 'land', 'DELETE', 5 UNION ALL SELECT 'area', 'DELETE', 1")))
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Committed changes by table and kind, those of cascades too, and none that was rolled back."""
    session = opened(spark, sf_dir)
    session.script(TABLES + "UPDATE land SET area = 2 WHERE area = 2; BEGIN; DELETE FROM land; ROLLBACK;" + LINKED + "ON DELETE CASCADE; DELETE FROM area WHERE id = 4")
    return spark.read.parquet(f"{session.store.root}/_changes").groupBy("table", "event").count().withColumnRenamed("count", "n")
