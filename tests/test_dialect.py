import pytest

from tessera.dialect.rewrite import DialectError, rewrite, statements
from tessera.functions.json_fns import contains, path_steps, put, take_out


def test_statements_keep_bodies_and_strings():
    assert statements("SELECT ';' ; CREATE PROCEDURE p BEGIN a; b; END; SELECT 2") == ["SELECT ';'", "CREATE PROCEDURE p BEGIN a; b; END", "SELECT 2"]


def test_rewrites():
    assert rewrite("SELECT a FROM t WHERE b LIKE 'x%' AND c = $10") == "SELECT a FROM t WHERE b ILIKE 'x%' AND c = :p10"
    assert rewrite("SELECT CAST(a, INT), ISNULL(b, 'it''s')") == r"SELECT try_cast(a AS INT) , ifnull(b, 'it\'s')"
    with pytest.raises(DialectError):
        rewrite("SELECT MOD(a")


@pytest.mark.parametrize(
    "whole, part, want",
    [({"name": "John", "age": 30}, {"name": "John"}, True), ([1, 2, 3], [4], False), ({"a": 1}, {}, True), ({"a": [1, {"b": 2}]}, {"a": [{"b": 2}]}, True)],
)
def test_contains(whole, part, want):
    assert contains(whole, part) is want


def test_paths():
    assert path_steps("users[0].name") == path_steps("$.users[0].name") == ["users", 0, "name"]
    assert put({}, ["a", 1], 5) == {"a": [None, 5]}
    assert take_out({"a": [1, 2]}, ["a", 0]) == {"a": [2]}
