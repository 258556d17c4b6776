"""Statements of the dialect that are no queries: changes of rows, definitions, transactions, programs, users, inspection."""

from __future__ import annotations

import copy
import datetime
import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.dialect.resolve import plain
from tessera.dialect.rewrite import DialectError, Token, joined, rewrite, statements, tokens
from tessera.functions.scalar import TYPES
from tessera.operators import access as rights
from tessera.operators.store import ConstraintError, ForeignKey, Table

AUDIT = "at TIMESTAMP, user STRING, statement STRING, outcome STRING"


class Reader:
    """Tokens of one statement, read from left to right."""

    def __init__(self, toks: list[Token]):
        self.toks, self.at = toks, 0

    @property
    def done(self) -> bool:
        return self.at >= len(self.toks)

    def word(self, ahead: int = 0) -> str:
        at = self.at + ahead
        return self.toks[at].text.upper() if at < len(self.toks) and self.toks[at].kind != "string" else ""

    def skip(self, *words: str) -> bool:
        """Whether the words come next; if so they are read."""
        if [self.word(i) for i in range(len(words))] != list(words):
            return False
        self.at += len(words)
        return True

    def need(self, *words: str) -> None:
        if not self.skip(*words):
            raise DialectError(f"{' '.join(words)} is missing before {self.word() or 'the end'}")

    def one(self) -> Token:
        if self.done:
            raise DialectError("the statement ends too early")
        self.at += 1
        return self.toks[self.at - 1]

    def name(self) -> str:
        """A name, with a database before it if there is one."""
        parts = [plain(self._name())]
        while self.skip("."):
            parts.append(plain(self._name()))
        return ".".join(parts)

    def _name(self) -> str:
        t = self.one()
        if t.kind != "name":
            raise DialectError(f"{t.text} is no name")
        return t.text

    def text(self) -> str:
        t = self.one()
        return t.text[1:-1].replace("''", "'") if t.kind == "string" else t.text

    def parens(self) -> list[Token]:
        """What stands in the parentheses that come next."""
        self.need("(")
        depth, start = 1, self.at
        while depth:
            t = self.one()
            depth += (t.text == "(") - (t.text == ")") if t.kind != "string" else 0
        return self.toks[start : self.at - 1]

    def names(self) -> list[str]:
        return [plain(t.text) for t in self.parens() if t.text != ","]

    def until(self, *words: str) -> list[Token]:
        """Tokens up to one of the words outside parentheses, or the end."""
        start, depth = self.at, 0
        while not self.done and (depth or self.word() not in words):
            depth += (self.word() == "(") - (self.word() == ")")
            self.at += 1
        return self.toks[start : self.at]

    def rest(self) -> list[Token]:
        return self.until()

    def operand(self) -> list[Token]:
        """One value: a signed literal, a name, a call, or what stands in parentheses."""
        start = self.at
        if self.word() in ("-", "+"):
            self.at += 1
        if self.word() == "(":
            self.parens()
        else:
            self.one()
            if self.word() == "(":
                self.parens()
        return self.toks[start : self.at]


def source(toks: list[Token]) -> str:
    """Text of tokens; strings keep their quotes."""
    return " ".join(t.text for t in toks)


def literal(value) -> str:
    """A value as dialect text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def bound(toks: list[Token], values: dict[str, object]) -> list[Token]:
    """Tokens with parameters ($1 or names) replaced by literals: one token for each, never text inside another."""
    out = []
    for t in toks:
        key = t.text.lower() if t.kind in ("param", "name") else None
        out.extend(tokens(literal(values[key])) if key in values else [t])
    return out


def parted(toks: list[Token]) -> list[list[Token]]:
    """Tokens cut at commas outside parentheses."""
    out: list[list[Token]] = [[]]
    depth = 0
    for t in toks:
        if t.kind != "string":
            depth += (t.text == "(") - (t.text == ")")
        if t.text == "," and not depth and t.kind != "string":
            out.append([])
        else:
            out[-1].append(t)
    return [p for p in out if p]


def told(session, what: str, rows: int = 0) -> DataFrame:
    return session.spark.createDataFrame([(what, rows)], "status string, n long")


def run(session, first: str, toks: list[Token], text: str, params: tuple) -> DataFrame:
    r = Reader(bound(toks, {f"${i + 1}": p for i, p in enumerate(params)}))
    r.at = 1
    if first == "PREPARE":
        name = r.name()
        r.need("AS")
        session.prepared[name] = source(toks[r.at :])
        return told(session, "PREPARE")
    if first == "EXECUTE":
        name = r.name()
        values = [_value(session, v) for v in parted(r.parens() if r.word() == "(" else r.rest() if r.skip("USING") else [])]
        return session.execute(name, *values)
    if first == "DEALLOCATE":
        r.skip("PREPARE")
        session.deallocate(r.name())
        return told(session, "DEALLOCATE")
    if first in ("CREATE", "DROP") and session.store is None:
        replace = r.skip("OR", "REPLACE")
        if r.word() == "VIEW":
            return _view(session, first, r, replace)
    if session.store is None:
        raise DialectError(f"{first} needs a store")
    known = {
        "INSERT": _insert, "UPDATE": _update, "DELETE": _delete, "TRUNCATE": _truncate, "CREATE": _create, "DROP": _drop, "ALTER": _alter, "BEGIN": _begin, "START": _begin,
        "COMMIT": _commit, "ROLLBACK": _rollback, "SAVEPOINT": _savepoint, "RELEASE": _release, "CALL": _call, "GRANT": _grant, "REVOKE": _revoke, "USE": _use, "INSPECT": _inspect, "EXPORT": _export,
    }
    if first not in known:
        raise DialectError(f"{first} is no statement")
    return known[first](session, r)


def _value(session, toks: list[Token]):
    return session.spark.sql(f"SELECT {joined(toks)}").first()[0]


# ---- rows


def _table(session, r: Reader, privilege: str | None = None) -> tuple[str, list[str]]:
    """A table of the store by the name that comes next, and the conditions on its rows for the user."""
    name = session.qualified(r.name())
    if name not in session.store.tables:
        raise DialectError(f"there is no table {name}")
    conditions = session.access.filters(name, privilege) if privilege else []
    return name, [*conditions, *([session.row_filters[name]] if name in session.row_filters else [])]


def _assignments(toks: list[Token]) -> dict[str, str]:
    out = {}
    for part in parted(toks):
        if len(part) < 3 or part[1].text != "=":
            raise DialectError(f"{source(part)} sets nothing")
        out[plain(part[0].text)] = source(part[2:])
    return out


def _insert(session, r: Reader) -> DataFrame:
    r.need("INTO")
    name, _ = _table(session, r, "INSERT")
    columns = r.names() if r.word() == "(" and r.word(1) not in ("SELECT", "WITH", "VALUES") else [c for c in _schema(session, name).names]
    toks = r.until("ON") if r.word() == "VALUES" else _query_part(r)
    rows = session.query(toks)
    if len(rows.columns) != len(columns):
        raise DialectError(f"{len(rows.columns)} values for {len(columns)} columns")
    rows = rows.toDF(*columns)
    if toks[0].text.upper() == "VALUES":
        rows = rows.coalesce(1)
    conflict, sets, key = "error", None, None
    if r.skip("ON", "CONFLICT"):
        key = r.names() if r.word() == "(" else None
        r.need("DO")
        if r.skip("NOTHING"):
            conflict = "nothing"
        else:
            r.need("UPDATE", "SET")
            conflict, sets = "update", _assignments(r.rest())
            if session.access and not session.access.free:
                session.access.filters(name, "UPDATE")
    return told(session, "INSERT", session.store.insert(name, rows, conflict, sets, key))


def _query_part(r: Reader) -> list[Token]:
    """A query up to ON CONFLICT."""
    start = r.at
    while not r.done and not (r.word() == "ON" and r.word(1) == "CONFLICT"):
        r.at += 1
    return r.toks[start : r.at]


def _schema(session, name: str):
    return session.store.read(name).schema


def _where(conditions: list[str], own: list[Token]) -> str | None:
    every = [*(f"({c})" for c in conditions), *([f"({source(own)})"] if own else [])]
    return " AND ".join(every) or None


def _update(session, r: Reader) -> DataFrame:
    name, conditions = _table(session, r, "UPDATE")
    r.need("SET")
    sets = _assignments(r.until("WHERE"))
    own = r.rest() if r.skip("WHERE") else []
    return told(session, "UPDATE", session.store.update(name, sets, _where(conditions, own)))


def _delete(session, r: Reader) -> DataFrame:
    r.need("FROM")
    name, conditions = _table(session, r, "DELETE")
    own = r.rest() if r.skip("WHERE") else []
    return told(session, "DELETE", session.store.delete(name, _where(conditions, own)))


def _truncate(session, r: Reader) -> DataFrame:
    r.skip("TABLE")
    name, conditions = _table(session, r, "DELETE")
    if conditions:
        raise rights.Denied(f"{session.user} may not remove all rows of {name}")
    session.store.truncate(name)
    return told(session, "TRUNCATE")


# ---- definitions


def _database(name: str) -> str:
    return name.partition(".")[0] if "." in name else "default"


def _type(r: Reader) -> tuple[str, bool]:
    """A column's Spark type, and whether it numbers itself."""
    word = r._name().upper()
    spark = TYPES.get(word)
    if spark is None:
        raise DialectError(f"there is no type {word}")
    if r.word() == "(":
        inside = source(r.parens())
        if spark.startswith("DECIMAL"):
            spark = f"DECIMAL({inside})"
    return spark, word == "SERIAL"


def _action(r: Reader) -> str:
    for words in (("NO", "ACTION"), ("SET", "NULL"), ("SET", "DEFAULT"), ("RESTRICT",), ("CASCADE",)):
        if r.skip(*words):
            return " ".join(words).lower()
    raise DialectError(f"{r.word()} is no action")


def _reference(session, r: Reader, columns: list[str], name: str | None = None) -> ForeignKey:
    parent = session.qualified(r.name())
    key = ForeignKey(columns, parent, r.names() if r.word() == "(" else columns, name=name)
    while r.skip("ON"):
        if r.skip("DELETE"):
            key.on_delete = _action(r)
        else:
            r.need("UPDATE")
            key.on_update = _action(r)
    return key


def _constraint(session, r: Reader, table: Table) -> bool:
    """Read one table constraint into the definition, if one comes next."""
    name = r.name() if r.skip("CONSTRAINT") else None
    if r.skip("PRIMARY", "KEY"):
        kind, what = "key", r.names()
        table.keys.insert(0, what)
        table.not_null += [c for c in what if c not in table.not_null]
    elif r.word() == "UNIQUE" and r.word(1) == "(":
        r.one()
        kind, what = "key", r.names()
        table.keys.append(what)
    elif r.skip("FOREIGN", "KEY"):
        columns = r.names()
        r.need("REFERENCES")
        kind, what = "foreign", name
        table.foreign.append(_reference(session, r, columns, name))
    elif r.word() == "CHECK":
        r.one()
        kind, what = "check", source(r.parens())
        table.checks.append(what)
    elif name:
        raise DialectError(f"{r.word()} is no constraint")
    else:
        return False
    if name:
        table.names[name] = [kind, what]
    return True


def _column(session, r: Reader, table: Table) -> tuple[str, str]:
    """Read one column definition into the table's; its name and Spark type."""
    name = plain(r._name())
    kind, serial = _type(r)
    if serial:
        table.serial[name] = 1
    while not r.done:
        if r.skip("PRIMARY", "KEY"):
            table.keys.insert(0, [name])
            table.not_null.append(name)
        elif r.skip("NOT", "NULL"):
            table.not_null.append(name)
        elif r.skip("NULL"):
            pass
        elif r.skip("UNIQUE"):
            table.keys.append([name])
        elif r.skip("AUTO_INCREMENT"):
            table.serial[name] = 1
        elif r.skip("DEFAULT"):
            table.defaults[name] = source(r.operand())
        elif r.skip("REFERENCES"):
            table.foreign.append(_reference(session, r, [name]))
        elif r.skip("CHECK"):
            table.checks.append(source(r.parens()))
        else:
            raise DialectError(f"{r.word()} does not belong to a column")
    return name, kind


def _absent(r: Reader) -> bool:
    return r.skip("IF", "NOT", "EXISTS")


def _create(session, r: Reader) -> DataFrame:
    replace = r.skip("OR", "REPLACE")
    state = session.store.state
    if r.word() == "VIEW":
        return _view(session, "CREATE", r, replace)
    if r.skip("TABLE"):
        lenient = _absent(r)
        name = session.qualified(r.name())
        session.access.need("CREATE", _database(name))
        if _database(name) != "default" and _database(name) not in state["databases"]:
            raise DialectError(f"there is no database {_database(name)}")
        if name in session.store.tables and lenient:
            return told(session, "CREATE TABLE")
        table, columns = Table(""), []
        for part in parted(r.parens()):
            one = Reader(part)
            if not _constraint(session, one, table):
                columns.append(_column(session, one, table))
        table.schema = ", ".join(f"`{n}` {t}" for n, t in columns)
        session.store.create(name, table)
        return told(session, "CREATE TABLE")
    if r.skip("UNIQUE", "INDEX") or r.skip("INDEX"):
        lenient, name = _absent(r), r.name()
        r.need("ON")
        table, _ = _table(session, r)
        session.access.need("CREATE", _database(table))
        columns = r.names()
        if missing := [c for c in columns if c not in _schema(session, table).names]:
            raise DialectError(f"{table} has no {missing}")
        if name in state["indexes"]:
            if lenient:
                return told(session, "CREATE INDEX")
            raise DialectError(f"index {name} exists")
        return _put(session, "indexes", name, {"table": table, "columns": columns}, "CREATE INDEX")
    if r.skip("PROCEDURE"):
        lenient, name = _absent(r), r.name()
        session.access.need_admin()
        if name in state["procedures"] and not replace:
            if lenient:
                return told(session, "CREATE PROCEDURE")
            raise DialectError(f"procedure {name} exists")
        parameters = [plain(p[0].text) for p in parted(r.parens())] if r.word() == "(" else []
        r.skip("AS")
        r.need("BEGIN")
        body = r.rest()
        if not body or body[-1].text.upper() != "END":
            raise DialectError("END is missing")
        return _put(session, "procedures", name, {"parameters": parameters, "body": source(body[:-1])}, "CREATE PROCEDURE")
    if r.skip("TRIGGER"):
        return _trigger(session, r, replace)
    session.access.need_admin()
    if r.skip("DATABASE"):
        lenient, name = _absent(r), r.name()
        if name in state["databases"] or name == "default":
            if lenient:
                return told(session, "CREATE DATABASE")
            raise DialectError(f"database {name} exists")
        options = {"encoding": "UTF8", "collation": "default", "locale": "", "owner": session.user}
        r.skip("WITH")
        while not r.done:
            key = r._name().lower()
            if key not in options:
                raise DialectError(f"{key} is no option of a database")
            r.skip("=")
            options[key] = r.text()
        return _put(session, "databases", name, options, "CREATE DATABASE")
    if r.skip("USER"):
        name = r.name()
        r.need("IDENTIFIED", "BY")
        if name in state["users"] or name == "admin":
            raise DialectError(f"user {name} exists")
        return _put(session, "users", name, {"secret": rights.secret(r.text()), "roles": []}, "CREATE USER")
    if r.skip("ROLE"):
        name = r.name()
        if name in state["roles"] or name in rights.BUILT_IN:
            raise DialectError(f"role {name} exists")
        return _put(session, "roles", name, {}, "CREATE ROLE")
    raise DialectError(f"CREATE {r.word()} is no statement")


def _put(session, part: str, name: str, what, said: str) -> DataFrame:
    with session.store.change():
        session.store.state[part][name] = what
    return told(session, said)


def _view(session, verb: str, r: Reader, replace: bool) -> DataFrame:
    r.need("VIEW")
    lenient = _absent(r) if verb == "CREATE" else r.skip("IF", "EXISTS")
    name = r.name()
    there = session.qualified(name) in session.views
    if session.access:
        session.access.need(verb, _database(session.qualified(name)))
    if verb == "CREATE":
        r.need("AS")
        if there and lenient and not replace:
            return told(session, "CREATE VIEW")
        body = r.rest()
        session.query(body)  # refused now rather than at the first use
        session.create_view(name, source(body), replace)
    elif there:
        session.drop_view(name)
    elif not lenient:
        raise DialectError(f"there is no view {name}")
    return told(session, f"{verb} VIEW")


def _trigger(session, r: Reader, replace: bool) -> DataFrame:
    lenient, name = _absent(r), r.name()
    timing, event = r.one().text.upper(), r.one().text.upper()
    if timing not in ("BEFORE", "AFTER") or event not in ("INSERT", "UPDATE", "DELETE"):
        raise DialectError(f"{timing} {event} is no time of a trigger")
    r.need("ON")
    table, _ = _table(session, r)
    session.access.need("CREATE", _database(table))
    r.skip("FOR", "EACH", "ROW") or r.skip("FOR", "EACH", "STATEMENT")
    r.need("EXECUTE")
    triggers = session.store.state["triggers"]
    same = [t for t in triggers if (t["name"], t["table"]) == (name, table)]
    if same and not replace:
        if lenient:
            return told(session, "CREATE TRIGGER")
        raise DialectError(f"trigger {name} exists")
    with session.store.change():
        kept = [t for t in session.store.state["triggers"] if t not in same]
        session.store.state["triggers"] = [*kept, {"name": name, "table": table, "timing": timing, "event": event, "action": source(r.rest())}]
    return told(session, "CREATE TRIGGER")


def _drop(session, r: Reader) -> DataFrame:
    kind = r.word()
    if kind == "VIEW":
        return _view(session, "DROP", r, False)
    r.one()
    lenient = r.skip("IF", "EXISTS")
    state = session.store.state
    if kind == "TABLE":
        name = session.qualified(r.name())
        session.access.need("DROP", _database(name))
        if name in session.store.tables:
            session.store.drop(name)
        elif not lenient:
            raise DialectError(f"there is no table {name}")
        return told(session, "DROP TABLE")
    if kind == "TRIGGER":
        name = r.name()
        r.need("ON")
        table, _ = _table(session, r)
        session.access.need("DROP", _database(table))
        left = [t for t in state["triggers"] if (t["name"], t["table"]) != (name, table)]
        if len(left) == len(state["triggers"]) and not lenient:
            raise DialectError(f"there is no trigger {name}")
        with session.store.change():
            session.store.state["triggers"] = left
        return told(session, "DROP TRIGGER")
    part = {"INDEX": "indexes", "PROCEDURE": "procedures", "DATABASE": "databases", "USER": "users", "ROLE": "roles"}.get(kind)
    if part is None:
        raise DialectError(f"DROP {kind} is no statement")
    session.access.need_admin()
    name = r.name()
    if name not in state[part]:
        if lenient:
            return told(session, f"DROP {kind}")
        raise DialectError(f"there is no {kind.lower()} {name}")
    if kind == "DATABASE" and any(t.startswith(f"{name}.") for t in session.store.tables):
        raise ConstraintError(f"database {name} has tables")
    with session.store.change():
        del session.store.state[part][name]
        if kind in ("USER", "ROLE"):
            session.store.state["grants"] = [g for g in state["grants"] if g["to"] != name]
            for user in session.store.state["users"].values():
                user["roles"] = [x for x in user["roles"] if x["role"] != name]
    return told(session, f"DROP {kind}")


def _renamed(table: Table, old: str, new: str) -> None:
    def swap(names: list[str]) -> list[str]:
        return [new if c == old else c for c in names]

    table.keys, table.not_null = [swap(k) for k in table.keys], swap(table.not_null)
    table.checks = [source([Token(t.kind, new) if t.kind == "name" and plain(t.text) == old else t for t in tokens(c)]) for c in table.checks]
    table.defaults = {new if c == old else c: v for c, v in table.defaults.items()}
    table.serial = {new if c == old else c: v for c, v in table.serial.items()}
    for key in table.foreign:
        key.columns = swap(key.columns)


def _alter(session, r: Reader) -> DataFrame:
    if r.skip("USER"):
        session.access.need_admin()
        name = r.name()
        r.need("IDENTIFIED", "BY")
        if name not in session.store.state["users"]:
            raise DialectError(f"there is no user {name}")
        return _put(session, "users", name, session.store.state["users"][name] | {"secret": rights.secret(r.text())}, "ALTER USER")
    r.need("TABLE")
    name, _ = _table(session, r)
    session.access.need("ALTER", _database(name))
    table, rows = copy.deepcopy(session.store.tables[name]), session.store.read(name)
    if r.skip("ADD"):
        if r.word() in ("CONSTRAINT", "PRIMARY", "FOREIGN", "CHECK") or r.word() == "UNIQUE" and r.word(1) == "(":
            _constraint(session, r, table)
            session.store.alter(name, table)
            return told(session, "ALTER TABLE")
        r.skip("COLUMN")
        column, kind = _column(session, r, table)
        if column in rows.columns:
            raise DialectError(f"{name} has {column}")
        rows = rows.withColumn(column, F.expr(rewrite(table.defaults.get(column, "NULL"))).cast(kind))
    elif r.skip("DROP", "CONSTRAINT"):
        kind, what = table.names.pop(r.name(), (None, None))
        if kind is None:
            raise DialectError("there is no such constraint")
        if kind == "key":
            table.keys.remove(what)
        elif kind == "check":
            table.checks.remove(what)
        else:
            table.foreign = [f for f in table.foreign if f.name != what]
        session.store.alter(name, table)
        return told(session, "ALTER TABLE")
    elif r.skip("DROP"):
        r.skip("COLUMN")
        column = _own(r, rows)
        used = [c for k in table.keys for c in k] + [c for f in table.foreign for c in f.columns]
        used += [c for n, f in session.store._children(name) for c in f.parent_columns] + [plain(t.text) for c in table.checks for t in tokens(c)]
        if column in used:
            raise ConstraintError(f"{column} is part of a constraint")
        rows = rows.drop(column)
        table.not_null = [c for c in table.not_null if c != column]
        table.defaults.pop(column, None)
        table.serial.pop(column, None)
    elif r.skip("RENAME"):
        r.skip("COLUMN")
        old = _own(r, rows)
        r.need("TO")
        new = plain(r._name())
        rows = rows.withColumnRenamed(old, new)
        _renamed(table, old, new)
        for child, key in session.store._children(name):
            for mine in (session.store.tables[child].foreign if child != name else table.foreign):
                if mine == key:
                    mine.parent_columns = [new if c == old else c for c in mine.parent_columns]
    elif r.skip("MODIFY"):
        r.skip("COLUMN")
        column = _own(r, rows)
        kind, _ = _type(r)
        rows = rows.withColumn(column, F.col(column).cast(kind))
    else:
        raise DialectError(f"ALTER TABLE {r.word()} is no statement")
    table.schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    session.store.alter(name, table, rows)
    return told(session, "ALTER TABLE")


def _own(r: Reader, rows: DataFrame) -> str:
    column = plain(r._name())
    if column not in rows.columns:
        raise DialectError(f"there is no column {column}")
    return column


def _use(session, r: Reader) -> DataFrame:
    name = r.name()
    if name != "default" and name not in session.store.state["databases"]:
        raise DialectError(f"there is no database {name}")
    session.database = name
    return told(session, "USE")


# ---- transactions and programs


def _begin(session, r: Reader) -> DataFrame:
    session.store.begin()
    return told(session, "BEGIN")


def _commit(session, r: Reader) -> DataFrame:
    session.store.commit()
    return told(session, "COMMIT")


def _rollback(session, r: Reader) -> DataFrame:
    r.skip("TRANSACTION")
    if r.skip("TO"):
        r.skip("SAVEPOINT")
        session.store.rollback(r.name())
    else:
        session.store.rollback()
    return told(session, "ROLLBACK")


def _savepoint(session, r: Reader) -> DataFrame:
    session.store.savepoint(r.name())
    return told(session, "SAVEPOINT")


def _release(session, r: Reader) -> DataFrame:
    r.skip("SAVEPOINT")
    session.store.release(r.name())
    return told(session, "RELEASE")


def _call(session, r: Reader) -> DataFrame:
    """The last result of the procedure's statements, which run in order; arguments are values of $1 ... and of the names."""
    name = r.name()
    known = session.store.state["procedures"].get(name)
    if known is None:
        raise DialectError(f"there is no procedure {name}")
    given = [_value(session, v) for v in parted(r.parens())] if r.word() == "(" else []
    if len(given) < len(known["parameters"]):
        raise DialectError(f"{name} takes {len(known['parameters'])} arguments")
    values = {f"${i + 1}": v for i, v in enumerate(given)} | dict(zip(known["parameters"], given, strict=False))
    out = told(session, "CALL")
    for statement in statements(known["body"]):
        out = session.sql(source(bound(tokens(statement), values)))
    return out


# ---- users


def _grant(session, r: Reader) -> DataFrame:
    session.access.need_admin()
    if _role_next(r):
        r.skip("ROLE")
        role = r.name()
        r.need("TO")
        user = _user(session, r)
        database = r.name() if r.skip("ON", "DATABASE") else None
        if role not in rights.BUILT_IN and role not in session.store.state["roles"]:
            raise DialectError(f"there is no role {role}")
        with session.store.change():
            held = session.store.state["users"][user]["roles"]
            if {"role": role, "database": database} not in held:
                held.append({"role": role, "database": database})
        return told(session, "GRANT")
    privileges = _privileges(r)
    table = _grantable(session, r)
    where = source(r.until("TO")) if r.skip("WHERE") else None
    r.need("TO")
    r.skip("ROLE")
    to = r.name()
    if to not in session.store.state["users"] and to not in session.store.state["roles"]:
        raise DialectError(f"there is no user or role {to}")
    where = where or (source(r.rest()) if r.skip("WHERE") else None)
    with session.store.change():
        session.store.state["grants"].append({"to": to, "table": table, "privileges": privileges, "where": where})
    return told(session, "GRANT")


def _revoke(session, r: Reader) -> DataFrame:
    session.access.need_admin()
    if _role_next(r):
        r.skip("ROLE")
        role = r.name()
        r.need("FROM")
        user = _user(session, r)
        database = r.name() if r.skip("ON", "DATABASE") else None
        with session.store.change():
            held = session.store.state["users"][user]
            held["roles"] = [x for x in held["roles"] if x != {"role": role, "database": database}]
        return told(session, "REVOKE")
    privileges = _privileges(r)
    table = _grantable(session, r)
    r.need("FROM")
    to = r.name()
    with session.store.change():
        left = []
        for g in session.store.state["grants"]:
            if (g["to"], g["table"]) == (to, table):
                g = g | {"privileges": [p for p in g["privileges"] if p not in privileges]}
            if g["privileges"]:
                left.append(g)
        session.store.state["grants"] = left
    return told(session, "REVOKE")


def _role_next(r: Reader) -> bool:
    return r.word() == "ROLE" or r.word(1) in ("TO", "FROM") and r.word() != "ON"


def _user(session, r: Reader) -> str:
    r.skip("USER")
    name = r.name()
    if name not in session.store.state["users"]:
        raise DialectError(f"there is no user {name}")
    return name


def _privileges(r: Reader) -> list[str]:
    found = [t.text.upper() for t in r.until("ON") if t.text not in (",",) and t.text.upper() != "PRIVILEGES"]
    r.need("ON")
    r.skip("TABLE")
    if not found or found == ["ALL"]:
        return list(rights.PRIVILEGES)
    if wrong := set(found) - set(rights.PRIVILEGES):
        raise DialectError(f"{sorted(wrong)} are no privileges")
    return found


def _grantable(session, r: Reader) -> str:
    return session.qualified(r.name())


# ---- inspection and audit


def audit(session, text: str, outcome: str) -> None:
    """Append one event; what follows IDENTIFIED is not kept. Transactions do not undo it."""
    if session.store is None:
        return
    shown = text.partition("IDENTIFIED")[0].strip() if "IDENTIFIED" in text else text
    event = {"at": datetime.datetime.now(datetime.UTC).isoformat(), "user": session.user, "statement": shown, "outcome": outcome}
    out = session.store._fs.create(session.store._path("_audit", f"{uuid.uuid4().hex}.json"), True)
    out.write(bytearray(json.dumps(event) + "\n", "utf-8"))
    out.close()


def audit_trail(session) -> DataFrame:
    path = f"{session.store.root}/_audit"
    if not session.store._fs.exists(session.store._path("_audit")):
        return session.spark.createDataFrame([], AUDIT)
    return session.spark.read.schema(AUDIT).json(path)


def _export(session, r: Reader) -> DataFrame:
    session.access.need_admin()
    r.need("AUDIT", "TO")
    path = r.text()
    form = r.text().lower() if r.skip("FORMAT") else "json"
    from tessera.sources import dump

    writers = {"json": dump.export_json, "csv": dump.export_csv, "sql": lambda df, p: dump.export_sql(df, "audit", p)}
    if form not in writers:
        raise DialectError(f"{form} is no format")
    writers[form](audit_trail(session).orderBy("at"), path)
    return told(session, "EXPORT AUDIT")


def _inspect(session, r: Reader) -> DataFrame:
    session.access.need_admin()
    what, state, store = r.one().text.upper(), session.store.state, session.store
    frame = session.spark.createDataFrame
    if what == "TABLES":
        rows = [(_database(n), n.rpartition(".")[2], len(_schema(session, n)), len(t.files)) for n, t in sorted(store.tables.items())]
        return frame(rows, "database string, name string, n_columns int, n_directories int")
    if what == "TABLE":
        name, _ = _table(session, r)
        t = store.tables[name]
        rows = []
        for i, (c, kind) in enumerate(store.read(name).dtypes):
            key = "primary" if t.keys and c in t.keys[0] and c in t.not_null else "unique" if any(c in k for k in t.keys) else ""
            to = next((f"{f.parent}({', '.join(f.parent_columns)})" for f in t.foreign if c in f.columns), None)
            rows.append((i, c, kind, c not in t.not_null, key, t.defaults.get(c), to))
        return frame(rows, "position int, name string, type string, nullable boolean, key string, default_text string, refers_to string")
    if what == "INDEXES":
        return frame([(n, i["table"], ",".join(i["columns"])) for n, i in sorted(state["indexes"].items())], "name string, table string, columns string")
    if what in ("DATABASES", "DATABASE"):
        known = {"default": {"encoding": "UTF8", "collation": "default", "locale": "", "owner": "admin"}} | state["databases"]
        chosen = known if what == "DATABASES" else {n: o for n, o in known.items() if n == r.name()}
        rows = [(n, *(o[k] for k in ("encoding", "collation", "locale", "owner")), sum(_database(t) == n for t in store.tables)) for n, o in sorted(chosen.items())]
        return frame(rows, "name string, encoding string, collation string, locale string, owner string, n_tables int")
    if what in ("USERS", "USER"):
        wanted = r.name() if what == "USER" else None
        if r.skip("PRIVILEGES"):
            rows = [(t, p, w) for t in sorted(store.tables) for p, w in rights.Access(store, wanted).privileges(t)]
            return frame(rows, "table string, privilege string, condition string")
        rows = [(n, ",".join(x["role"] for x in u["roles"])) for n, u in sorted(({"admin": {"roles": [{"role": "admin"}]}} | state["users"]).items()) if wanted in (None, n)]
        return frame(rows, "name string, roles string")
    if what in ("ROLES", "ROLE"):
        wanted = r.name() if what == "ROLE" else None
        rows = [(n, n in rights.BUILT_IN, ",".join(rights.BUILT_IN.get(n, ()))) for n in sorted({*rights.BUILT_IN, *state["roles"]}) if wanted in (None, n)]
        return frame(rows, "name string, built_in boolean, privileges string")
    if what == "PRIVILEGES":
        return frame([(g["to"], g["table"], ",".join(g["privileges"]), g["where"]) for g in state["grants"]], "grantee string, table string, privileges string, condition string")
    if what == "AUDIT":
        trail = audit_trail(session)
        return trail.groupBy("user", "outcome").count() if r.skip("STATS") else trail
    if what in ("SERVER", "STATUS"):
        facts = {"spark": session.spark.version, "version": store.version, "tables": len(store.tables), "users": len(state["users"]) + 1, "database": session.database}
        return frame([(k, str(v)) for k, v in facts.items()], "name string, value string")
    raise DialectError(f"INSPECT {what} is no statement")
