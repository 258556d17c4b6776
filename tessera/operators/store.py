"""Tables that change: Parquet snapshots, versioned manifests, constraints, transactions, triggers, a change feed.

A table is a list of immutable Parquet directories. The manifest holds all that is known: definitions, directories, views,
procedures, triggers, users. Each commit writes the manifest of the next version and moves it into place by one rename; the
highest version is the current one, so readers see all of a statement (or of a transaction) or nothing, and a store is
opened again from its folder. INSERT adds a directory and checks the new rows against the old; UPDATE and DELETE rewrite
the table. There is one writer for a store.
"""

from __future__ import annotations

import copy
import json
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.dialect.rewrite import rewrite

#: Columns of the change feed; changes of definitions have the definition as their row.
FEED = "`table` STRING, event STRING, row STRING, old STRING, at TIMESTAMP"
#: A table of more directories than this is written as one by the next INSERT.
MOST_DIRECTORIES = 64


class ConstraintError(ValueError):
    """A statement would leave rows that break a constraint; nothing of it is kept."""


@dataclass
class ForeignKey:
    """columns of this table refer to columns of parent; actions: no action, restrict, cascade, set null, set default."""

    columns: list[str]
    parent: str
    parent_columns: list[str]
    on_delete: str = "no action"
    on_update: str = "no action"
    name: str | None = None


@dataclass
class Table:
    """What the store knows of a table besides its rows. serial: the next value of columns that number themselves."""

    schema: str
    keys: list[list[str]] = field(default_factory=list)
    not_null: list[str] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)
    defaults: dict[str, str] = field(default_factory=dict)
    foreign: list[ForeignKey] = field(default_factory=list)
    serial: dict[str, int] = field(default_factory=dict)
    names: dict[str, list] = field(default_factory=dict)  # of constraints: [kind, columns or text]
    files: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, known: dict) -> Table:
        return cls(**(known | {"foreign": [ForeignKey(**f) for f in known["foreign"]]}))


def _or(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


class Store:
    """Changing tables below a directory that driver and executors share."""

    #: Parts of the manifest besides tables, each a dictionary or a list.
    PARTS = {"views": dict, "procedures": dict, "triggers": list, "indexes": dict, "databases": dict, "users": dict, "roles": dict, "grants": list}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.hooks: list[tuple[str, str, str, Callable[[Store], None]]] = []
        self.run: Callable[[str], object] | None = None  # runs the text of triggers; set by the session
        self._stack: list[tuple[str | None, dict, int]] = []  # savepoint name, state before, feed length before
        self._feeds: list[str] = []
        self._depth = 0  # of statements: triggers run some inside others
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.version = -1
        self._load()

    # ---- manifests

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *names)))

    def _load(self) -> None:
        state = {"tables": {}} | {part: kind() for part, kind in self.PARTS.items()}
        if self._fs.exists(self._path("_manifests")):
            found = [f.getPath().getName() for f in self._fs.listStatus(self._path("_manifests"))]
            versions = sorted(int(n[:-5]) for n in found if n.endswith(".json") and n[:-5].isdigit())
            if versions:
                self.version = versions[-1]
                reader = self._fs.open(self._path("_manifests", f"{self.version:020d}.json"))
                try:
                    state |= json.loads(bytes(reader.readAllBytes()).decode("utf-8"))
                finally:
                    reader.close()
        self.state = state
        self.tables: dict[str, Table] = {n: Table.of(t) for n, t in state.pop("tables").items()}

    def _publish(self) -> None:
        whole = self.state | {"tables": {n: asdict(t) for n, t in self.tables.items()}}
        new, path = self._path("_manifests", f"new-{uuid.uuid4().hex}"), self._path("_manifests", f"{self.version + 1:020d}.json")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(whole, sort_keys=True), "utf-8"))
        out.close()
        if self._fs.exists(path) or not self._fs.rename(new, path):
            self._fs.delete(new, False)
            self._load()
            raise ValueError("another writer has changed the store")
        self.version += 1
        for feed in self._feeds:
            self._fs.mkdirs(self._path("_changes"))
            for f in self._fs.listStatus(self._path("_pending", feed)):
                if f.getPath().getName().endswith(".parquet"):
                    self._fs.rename(f.getPath(), self._path("_changes", f"{self.version:020d}-{f.getPath().getName()}"))
            self._fs.delete(self._path("_pending", feed), True)
        self._feeds = []

    # ---- transactions

    def _snapshot(self) -> dict:
        return {"state": copy.deepcopy(self.state), "tables": copy.deepcopy(self.tables)}

    def _restore(self, snapshot: dict, feeds: int) -> None:
        self.state, self.tables = copy.deepcopy(snapshot["state"]), copy.deepcopy(snapshot["tables"])
        for feed in self._feeds[feeds:]:
            self._fs.delete(self._path("_pending", feed), True)
        del self._feeds[feeds:]

    def _place(self, name: str) -> int:
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] == name:
                return i
        raise ValueError(f"no savepoint {name}")

    def begin(self) -> None:
        if self._stack:
            raise ValueError("a transaction is open")
        self._stack = [(None, self._snapshot(), 0)]

    def _open(self) -> None:
        if not self._stack:
            raise ValueError("no transaction is open")

    def savepoint(self, name: str) -> None:
        self._open()
        self._stack.append((name, self._snapshot(), len(self._feeds)))

    def release(self, name: str) -> None:
        """Forget a savepoint and those after it; what was done since stays."""
        del self._stack[self._place(name) :]

    def rollback(self, name: str | None = None) -> None:
        """All of the transaction, or what came after a savepoint, which stays."""
        self._open()
        at = self._place(name) if name else 0
        self._restore(*self._stack[at][1:])
        del self._stack[at + 1 if name else 0 :]

    def commit(self) -> None:
        self._open()
        self._stack = []
        self._publish()

    @contextmanager
    def transaction(self):
        self.begin()
        try:
            yield self
        except BaseException:
            self.rollback()
            raise
        self.commit()

    @contextmanager
    def change(self):
        """One statement: all of it or nothing, published at once unless a transaction is open."""
        snapshot, feeds = self._snapshot(), len(self._feeds)
        self._depth += 1
        try:
            yield self
        except BaseException:
            self._restore(snapshot, feeds)
            raise
        finally:
            self._depth -= 1
        if not self._stack and not self._depth:
            self._publish()

    # ---- definitions and reads

    def create(self, name: str, table: Table) -> None:
        if name in self.tables:
            raise ValueError(f"table {name} exists")
        with self.change():
            self.tables[name] = table
            for key in table.foreign:
                if key.parent not in self.tables:
                    raise ConstraintError(f"{name} refers to {key.parent}, which is not there")
            self._no_cycles(name)
            self._defined(name, "CREATE")

    def _no_cycles(self, start: str) -> None:
        """Cascades must end: no chain of acting foreign keys leads from a table through others back to it."""
        acting = {n: {f.parent for f in t.foreign if "cascade" in (f.on_delete, f.on_update)} - {n} for n, t in self.tables.items()}
        seen, open_ = set(), list(acting[start])
        while open_:
            at = open_.pop()
            if at == start:
                raise ConstraintError(f"cascades of {start} come back to it")
            if at not in seen:
                seen.add(at)
                open_.extend(acting.get(at, ()))

    def drop(self, name: str) -> None:
        for child, _ in self._children(name):
            if child != name:
                raise ConstraintError(f"{child} refers to {name}")
        with self.change():
            self._defined(name, "DROP")
            del self.tables[name]
            self.state["triggers"] = [t for t in self.state["triggers"] if t["table"] != name]
            self.state["indexes"] = {n: i for n, i in self.state["indexes"].items() if i["table"] != name}

    def alter(self, name: str, table: Table, rows: DataFrame | None = None) -> None:
        """Replace a definition, and with rows the snapshot; the rows are checked against it."""
        with self.change():
            old = self.tables[name]
            self.tables[name] = table
            if rows is not None:
                table.files = [self._write(name, rows)]
            if (table.keys, table.checks, table.foreign, table.not_null, rows is None) != (old.keys, old.checks, old.foreign, old.not_null, True):
                self._check(name, self.read(name), None)
            self._no_cycles(name)
            self._defined(name, "ALTER")

    def read(self, name: str) -> DataFrame:
        return self._rows(self.tables[name])

    def _rows(self, table: Table) -> DataFrame:
        if not table.files:
            return self.spark.createDataFrame([], table.schema)
        return self.spark.read.schema(table.schema).parquet(*table.files)

    def _write(self, name: str, rows: DataFrame) -> str:
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    def _children(self, parent: str) -> list[tuple[str, ForeignKey]]:
        return [(n, f) for n, t in self.tables.items() for f in t.foreign if f.parent == parent]

    # ---- statements

    def insert(self, name: str, rows: DataFrame, on_conflict: str = "error", update: dict[str, str] | None = None, key: list[str] | None = None) -> int:
        """Append rows; absent columns take their default or number. on_conflict: error, nothing, or update (SET expressions).

        Conflicts are those of key, or of all keys of the table: a row conflicts if any of its keys is there already.
        """
        table = self.tables[name]
        with self.change():
            self._fire(name, "BEFORE", "INSERT")
            old = self.read(name)
            given = rows
            for column in old.schema.fields:
                if column.name not in given.columns and column.name not in table.serial:
                    given = given.withColumn(column.name, F.expr(rewrite(table.defaults.get(column.name, "NULL"))))
            given = self._numbered(table, given)
            given = given.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in old.schema.fields))
            fresh = self._staged(given)
            for column, following in table.serial.items():
                top = fresh.agg(F.max(column)).first()[0]
                table.serial[column] = max(following, (top or 0) + 1)
            hit = None
            if on_conflict != "error":
                keys = [key] if key else table.keys
                for k in keys:
                    fresh = fresh.dropDuplicates(k)
                    fresh = fresh.join(old.select(k).dropna().distinct(), k, "left_anti").select(old.columns)
                if on_conflict == "update":
                    hit = given, keys[0]
            if hit:
                self._merge(name, old, *hit, update or {})
            added = self._write(name, fresh)
            fresh = self.spark.read.schema(table.schema).parquet(added)
            self._check(name, fresh, self.read(name))
            table.files = [*table.files, added]
            if len(table.files) > MOST_DIRECTORIES:
                table.files = [self._write(name, self.read(name))]
            self._feed(name, "INSERT", fresh, None)
            self._fire(name, "AFTER", "INSERT")
            return fresh.count()

    def _staged(self, rows: DataFrame) -> DataFrame:
        """Rows with defaults such as uuid() made once."""
        path = f"{self.root}/_given/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _numbered(self, table: Table, rows: DataFrame) -> DataFrame:
        for column, following in table.serial.items():
            number = F.monotonically_increasing_id() + following  # gapless for the rows of one VALUES list, which are one partition
            rows = rows.withColumn(column, F.coalesce(F.col(column).cast("long"), number) if column in rows.columns else number)
        return rows

    def _merge(self, name: str, old: DataFrame, given: DataFrame, key: list[str], sets: dict[str, str]) -> None:
        """Rows of old whose key is given take sets, where EXCLUDED.c is the given row's column."""
        new = given.dropDuplicates(key).select(*(F.col(c).alias(c if c in key else f"excluded_{c}") for c in given.columns), F.lit(True).alias("_hit"))
        texts = {c: rewrite(e).replace("EXCLUDED.", "excluded_").replace("excluded.", "excluded_") for c, e in sets.items()}
        both = old.join(new, key, "left")
        merged = both.select(*(F.when(F.col("_hit"), F.expr(texts[c]).cast(t)).otherwise(F.col(c)).alias(c) if c in texts else F.col(c) for c, t in old.dtypes))
        before = old.join(new.select(key), key, "left_semi").select(old.columns)
        self._replace(name, "UPDATE", merged, before, None)

    def update(self, name: str, sets: dict[str, str], where: str | None = None) -> int:
        with self.change():
            self._fire(name, "BEFORE", "UPDATE")
            old = self.read(name)
            hit = F.coalesce(F.expr(rewrite(where)), F.lit(False)) if where else F.lit(True)
            value = {c: F.expr(rewrite(sets[c])).cast(t) for c, t in old.dtypes if c in sets}
            new = old.select(*(F.when(hit, value[c]).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in old.columns))
            moved = old.where(hit).select(*(F.col(c).alias(f"_was_{c}") for c in old.columns), *(value.get(c, F.col(c)).alias(c) for c in old.columns))
            count = self._replace(name, "UPDATE", new, old.where(hit), moved)
            self._fire(name, "AFTER", "UPDATE")
            return count

    def delete(self, name: str, where: str | None = None) -> int:
        with self.change():
            self._fire(name, "BEFORE", "DELETE")
            old = self.read(name)
            hit = F.coalesce(F.expr(rewrite(where)), F.lit(False)) if where else F.lit(True)
            count = self._replace(name, "DELETE", old.where(~hit), old.where(hit), None)
            self._fire(name, "AFTER", "DELETE")
            return count

    def truncate(self, name: str) -> None:
        for child, _ in self._children(name):
            if child != name and not self.read(child).isEmpty():
                raise ConstraintError(f"{child} has rows that refer to {name}")
        with self.change():
            table = self.tables[name]
            table.files, table.serial = [], dict.fromkeys(table.serial, 1)
            self._defined(name, "TRUNCATE")

    def _replace(self, name: str, event: str, new: DataFrame, before: DataFrame, moved: DataFrame | None) -> int:
        """Write new as the table's snapshot, act on tables that refer to it, and check all of them. before: the rows hit."""
        table = self.tables[name]
        old = self.read(name)
        table.files = [self._write(name, new)]
        if event == "DELETE":
            self._feed(name, event, before, None)
        else:
            self._feed(name, event, moved if moved is not None else self.read(name).exceptAll(old), "_was_" if moved is not None else None)
        self._act(name, event, moved)
        if event != "DELETE":
            self._check(name, self.read(name), None)
        return before.count()

    # ---- foreign keys

    def _act(self, parent: str, event: str, moved: DataFrame | None) -> None:
        """What the foreign keys of other tables say about rows whose key is gone from parent, or has moved."""
        for child, key in self._children(parent):
            action = key.on_delete if event == "DELETE" else key.on_update
            table = self.tables[child]
            rows = self.read(child)
            held = rows.dropna(subset=key.columns)
            pairs = list(zip(key.parent_columns, key.columns, strict=True))
            quiet = action in ("no action", "restrict")
            if event == "UPDATE" and moved is not None and not quiet:
                # by the keys that have moved, for another row may have one of them now
                to = moved.where(_or([~F.col(f"_was_{p}").eqNullSafe(F.col(p)) for p in key.parent_columns]))
                to = to.select(*(x for p, c in pairs for x in (F.col(f"_was_{p}").alias(c), F.col(p).alias(f"_new_{c}")))).distinct()
                touched = held.join(to, key.columns, "left_semi").select(rows.columns)
                kept = held.join(to, key.columns, "left_anti").select(rows.columns)
            else:
                there = self.read(parent).select(*(F.col(p).alias(c) for p, c in pairs)).dropna().distinct()
                touched = held.join(there, key.columns, "left_anti").select(rows.columns)
                kept = held.join(there, key.columns, "left_semi").select(rows.columns)
            if touched.isEmpty():
                continue
            if quiet or event == "UPDATE" and moved is None:
                raise ConstraintError(f"{child} refers to rows that {parent} lacks")
            kept = kept.unionByName(rows.where(_or([F.col(c).isNull() for c in key.columns])))
            changed = None
            if action == "cascade" and event == "UPDATE":
                joined = touched.join(to, key.columns)
                changed = joined.select(*(F.col(c).alias(f"_was_{c}") for c in rows.columns), *(F.col(f"_new_{c}" if c in key.columns else c).alias(c) for c in rows.columns))
            elif action != "cascade":
                defaults = table.defaults if action == "set default" else {}
                value = {c: F.expr(rewrite(defaults.get(c, "NULL"))).cast(t) for c, t in rows.dtypes if c in key.columns}
                changed = touched.select(*(F.col(c).alias(f"_was_{c}") for c in rows.columns), *(value.get(c, F.col(c)).alias(c) for c in rows.columns))
            new = kept.unionByName(changed.select(rows.columns)) if changed is not None else kept
            self._replace(child, "UPDATE" if changed is not None else "DELETE", new, touched, changed)

    def _refers(self, name: str, key: ForeignKey, rows: DataFrame) -> None:
        names = self.read(key.parent).select(*(F.col(p).alias(c) for p, c in zip(key.parent_columns, key.columns, strict=True)))
        if key.parent == name:
            names = names.union(rows.select(*(F.col(p).alias(c) for p, c in zip(key.parent_columns, key.columns, strict=True))))
        if not rows.dropna(subset=key.columns).join(names, key.columns, "left_anti").isEmpty():
            raise ConstraintError(f"{name} refers to rows that {key.parent} lacks")

    def _check(self, name: str, rows: DataFrame, old: DataFrame | None) -> None:
        """Rows against the table's constraints; their keys also against those of old."""
        table = self.tables[name]
        broken = [F.col(c).isNull() for c in table.not_null]
        broken += [~F.coalesce(F.expr(rewrite(c)), F.lit(True)) for c in table.checks]
        if broken:
            wrong = rows.where(_or(broken)).take(1)
            if wrong:
                raise ConstraintError(f"{name}: {wrong[0].asDict()} breaks not null {table.not_null} or check {table.checks}")
        for key in table.keys:
            if not rows.dropna(subset=key).groupBy(*key).count().where("count > 1").isEmpty():
                raise ConstraintError(f"{name}: equal keys {key}")
            if old is not None and not old.dropna(subset=key).join(rows.select(key), key, "left_semi").isEmpty():
                raise ConstraintError(f"{name}: equal keys {key}")
        for key in table.foreign:
            self._refers(name, key, rows)

    # ---- triggers and change feed

    def on(self, table: str, timing: str, event: str, action: Callable[[Store], None]) -> None:
        """Call action around statements; triggers as text are part of the manifest."""
        self.hooks.append((table, timing, event, action))

    def _fire(self, name: str, timing: str, event: str) -> None:
        for table, when, what, action in self.hooks:
            if (table, when, what) == (name, timing, event):
                action(self)
        for trigger in list(self.state["triggers"]):
            if (trigger["table"], trigger["timing"], trigger["event"]) == (name, timing, event) and self.run:
                self.run(trigger["action"])

    def _feed(self, name: str, event: str, rows: DataFrame, old: str | None) -> None:
        """Rows of the change feed, put aside until the commit."""
        columns = [c for c in rows.columns if not old or not c.startswith(old)]
        body = F.to_json(F.struct(*columns))
        before = F.to_json(F.struct(*(F.col(old + c).alias(c) for c in columns))) if old else F.lit(None).cast("string")
        said = rows.select(F.lit(name).alias("table"), F.lit(event).alias("event"), body.alias("row"), before.alias("old"), F.current_timestamp().alias("at"))
        self._pend(said)

    def _defined(self, name: str, event: str) -> None:
        said = self.spark.createDataFrame([(name, event, json.dumps(asdict(self.tables[name])))], "`table` string, event string, row string")
        self._pend(said.select("table", "event", "row", F.lit(None).cast("string").alias("old"), F.current_timestamp().alias("at")))

    def _pend(self, said: DataFrame) -> None:
        feed = uuid.uuid4().hex
        said.write.parquet(f"{self.root}/_pending/{feed}")
        self._feeds.append(feed)
