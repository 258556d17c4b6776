"""Sessions: queries over named tables, and every other statement of the dialect over a store."""

from __future__ import annotations

import time
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession

from tessera.dialect import commands
from tessera.dialect.resolve import plain, relations
from tessera.dialect.rewrite import DialectError, Token, joined, statements, tokens
from tessera.functions import json_fns
from tessera.operators.access import Access, Denied
from tessera.operators.store import Store
from tessera.sources.tables import exists, table


class SqlSession:
    """Dialect SQL over the Parquet tables of a directory and the changing tables of a store, as one user.

    Names are looked up as views, tables of the store (in the current database, or db.table), and tables of the directory.
    Row filters, the session's own and those of grants, apply where a table is resolved, below views and subqueries;
    names that are none of these, and paths, are refused.
    """

    def __init__(
        self,
        spark: SparkSession,
        sf_dir: str | None = None,
        row_filters: dict[str, str] | None = None,
        store: Store | None = None,
        user: str = "admin",
        cached: bool = False,
    ):
        self.spark, self.sf_dir, self.store, self.user = spark, sf_dir, store, user
        self.row_filters = row_filters or {}
        self.database = "default"
        self.own_views: dict[str, str] = {}
        self.prepared: dict[str, str] = {}
        self.cache: OrderedDict[tuple, tuple[float, DataFrame]] | None = OrderedDict() if cached else None
        self.access = Access(store, user) if store else None
        if store:
            store.run = self.as_owner
        json_fns.register(spark)

    # ---- names

    @property
    def views(self) -> dict[str, str]:
        return self.store.state["views"] if self.store else self.own_views

    def qualified(self, name: str) -> str:
        """A name as the store has it: tables of the default database have none before them."""
        if "." in name:
            database, _, rest = name.partition(".")
            return rest if database == "default" else name
        return name if self.database == "default" else f"{self.database}.{name}"

    def resolve(self, name: str) -> DataFrame:
        """A view's or table's rows, with the filters on it applied here, so that no query can get below them."""
        known = self.qualified(name)
        filters = [self.row_filters[n] for n in {name, known} & set(self.row_filters)]
        if self.access:
            filters += self.access.filters(known, "SELECT")
        if known in self.views:
            df = self.as_owner(self.views[known])
        elif self.store and known in self.store.tables:
            df = self.store.read(known)
        elif self.sf_dir and "." not in name and exists(self.spark, self.sf_dir, name):
            df = table(self.spark, self.sf_dir, name)
        else:
            raise DialectError(f"there is no table {name}")
        for f in filters:
            df = df.where(joined(tokens(f)))
        return df

    def as_owner(self, text: str):
        """Run text with the rights of the one who defined it: of a view, trigger or procedure. Session filters still apply."""
        user, access = self.user, self.access
        self.user, self.access = "admin", Access(self.store, "admin") if self.store else None
        try:
            return self.sql(text)
        finally:
            self.user, self.access = user, access

    # ---- statements

    def sql(self, text: str, *params) -> DataFrame:
        """One statement. Parameters are real parameters: $1 is never text, and $10 is not $1 with a zero."""
        toks = tokens(text)
        if toks and toks[-1].text == ";":
            toks = toks[:-1]
        if not toks:
            raise DialectError("there is no statement")
        first = toks[0].text.upper()
        if first in ("SELECT", "WITH", "VALUES", "("):
            return self._cached(text, toks, params)
        try:
            done = commands.run(self, first, toks, text, params)
        except Denied:
            commands.audit(self, text, "denied")
            raise
        commands.audit(self, text, "done")
        return done

    def script(self, text: str) -> list[DataFrame]:
        """Statements of a script in order."""
        return [self.sql(s) for s in statements(text)]

    def query(self, toks: list[Token], params: tuple = ()) -> DataFrame:
        """Rows of query tokens."""
        frames: dict[str, DataFrame] = {}

        def found(name: str) -> str:
            frames[f"f{len(frames)}"] = self.resolve(name)
            return "{" + f"f{len(frames) - 1}" + "}"

        changed = relations([Token(t.kind, t.text.replace("{", "{{").replace("}", "}}")) for t in toks], found)
        args = {f"p{i + 1}": p for i, p in enumerate(params)}
        return self.spark.sql(joined(changed), args=args or None, **frames)

    def _cached(self, text: str, toks: list[Token], params: tuple, most: int = 1000, seconds: float = 300.0) -> DataFrame:
        """Rows of a query; with a cache those of before, if nothing was committed since and they are not too old.

        The key holds all that decides the answer: text, parameters, user, database, and the version of the store.
        """
        if self.cache is None or any(t.text.upper() in ("NOW", "RAND", "RANDOM", "UUID") for t in toks) or self.store and self.store._stack:
            return self.query(toks, params)
        key = (text, params, self.user, self.database, self.store.version if self.store else 0)
        kept = self.cache.pop(key, None)
        if kept and time.time() - kept[0] < seconds:
            self.cache[key] = kept
            return kept[1]
        if kept:
            kept[1].unpersist()
        self.cache[key] = time.time(), self.query(toks, params).cache()
        while len(self.cache) > most:
            self.cache.popitem(last=False)[1][1].unpersist()
        return self.cache[key][1]

    # ---- views and prepared statements, as calls

    def create_view(self, name: str, text: str, replace: bool = False) -> None:
        name = self.qualified(plain(name))
        if name in self.views and not replace:
            raise ValueError(f"view {name} exists")
        if self.store:
            with self.store.change():
                self.store.state["views"][name] = text
        else:
            self.own_views[name] = text

    def drop_view(self, name: str) -> None:
        name = self.qualified(plain(name))
        if self.store:
            with self.store.change():
                del self.store.state["views"][name]
        else:
            del self.own_views[name]

    def prepare(self, name: str, text: str) -> None:
        self.prepared[name] = text

    def execute(self, name: str, *params) -> DataFrame:
        return self.sql(self.prepared[name], *params)

    def deallocate(self, name: str) -> None:
        del self.prepared[name]
