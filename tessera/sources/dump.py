"""Exports and imports: CSV, JSON, SQL text of a table or of a whole store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PLAIN = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


def export_csv(df: DataFrame, path: str) -> None:
    """A directory of CSV files with a header; nulls are empty, empty text is quoted."""
    df.write.option("header", True).option("emptyValue", '""').csv(path)


def import_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def import_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def copy_into(session, table: str, path: str, form: str = "csv") -> int:
    """Append a CSV or JSON folder, read by the table's schema, to a table of the session's store: one checked statement."""
    reader = {"csv": import_csv, "json": import_json}[form]
    schema = session.store.read(session.qualified(table)).schema
    return session.store.insert(session.qualified(table), reader(session.spark, path, schema))


def _shown(column: str, kind: str):
    """A column's values as dialect text: binary and structured values as text that a cast reads back."""
    value = F.col(f"`{column}`")
    if kind in _PLAIN or kind.startswith("decimal"):
        text = value.cast("string")
    else:
        plain = F.base64(value) if kind == "binary" else F.to_json(value) if kind.startswith(("array", "struct", "map")) else value.cast("string")
        text = F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("''")), F.lit("'"))
    text = F.concat(F.lit("unbase64("), text, F.lit(")")) if kind == "binary" else text
    if kind.startswith(("array", "struct", "map")):
        text = F.concat(F.lit("from_json("), text, F.lit(f", '{kind}')"))
    return F.coalesce(text, F.lit("NULL"))


def insert_statements(df: DataFrame, table: str) -> DataFrame:
    """One INSERT statement for each row, quotes doubled, made by Spark expressions so that a dump is written in parallel.

    Line ends inside text are kept, so readers cut statements at semicolons outside strings, not at lines."""
    shown = [_shown(c, t) for c, t in df.dtypes]
    return df.select(F.concat(F.lit(f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES ("), F.concat_ws(", ", *shown), F.lit(");")).alias("value"))


def export_sql(df: DataFrame, table: str, path: str) -> None:
    insert_statements(df, table).write.text(path)


#: Spark types as dialect types, in which definitions are written (fixed values).
DIALECT = {
    "tinyint": "SMALLINT", "smallint": "SMALLINT", "int": "INT", "bigint": "BIGINT", "float": "DOUBLE", "double": "DOUBLE", "boolean": "BOOLEAN", "string": "TEXT",
    "binary": "BLOB", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "DATETIME", "array<string>": "SET", "array<struct<score:double,member:string>>": "ZSET",
}


def create_statement(name: str, table, dtypes: list[tuple[str, str]]) -> str:
    """CREATE TABLE text of a store's table, constraints included."""
    parts = []
    for column, kind in dtypes:
        words = [column, DIALECT.get(kind) or kind.upper().replace("DECIMAL", "DECIMAL")]
        words += ["NOT NULL"] if column in table.not_null else []
        words += ["AUTO_INCREMENT"] if column in table.serial else []
        words += ["DEFAULT", table.defaults[column]] if column in table.defaults else []
        parts.append(" ".join(words))
    parts += [f"{'PRIMARY KEY' if i == 0 and set(k) <= set(table.not_null) else 'UNIQUE'} ({', '.join(k)})" for i, k in enumerate(table.keys)]
    parts += [f"CHECK ({c})" for c in table.checks]
    for f in table.foreign:
        acts = f"ON DELETE {f.on_delete.upper()} ON UPDATE {f.on_update.upper()}"
        parts.append(f"FOREIGN KEY ({', '.join(f.columns)}) REFERENCES {f.parent} ({', '.join(f.parent_columns)}) {acts}")
    return f"CREATE TABLE {name} ({', '.join(parts)});"


def parents_first(tables: dict) -> list[str]:
    out: list[str] = []

    def visit(name: str, above: tuple = ()) -> None:
        if name not in out and name not in above:
            for f in tables[name].foreign:
                visit(f.parent, (*above, name))
            out.append(name)

    for name in sorted(tables):
        visit(name)
    return out


def export_store(store, path: str, compress: bool = False) -> None:
    """A folder of SQL text for each table, in an order in which they can be read back, and one of definitions before them."""
    order = parents_first(store.tables)
    made = [create_statement(n, store.tables[n], store.read(n).dtypes) for n in order]
    options = {"compression": "gzip"} if compress else {}
    store.spark.createDataFrame([(m,) for m in made], "value string").coalesce(1).write.text(f"{path}/0000-definitions", **options)
    for i, name in enumerate(order, 1):
        insert_statements(store.read(name), name).write.text(f"{path}/{i:04d}-{name}", **options)


def import_sql(session, path: str, most: int = 1000) -> tuple[int, list[str]]:
    """Run the SQL text below a folder or file (.gz too) on a session: statements run, and what failed with its error.

    Files come in order of their names, one at a time; INSERTs into one table with the same columns run most at a time.
    """
    from tessera.dialect.rewrite import statements

    files = session.spark.read.option("recursiveFileLookup", True).option("wholetext", True).text(path)
    files = files.select("value", F.input_file_name().alias("file")).orderBy("file")
    ran, failed, head, values = 0, [], None, []

    def do(text: str, n: int = 1) -> None:
        nonlocal ran
        try:
            session.sql(text)
            ran += n
        except Exception as wrong:  # noqa: BLE001  each failure is reported
            failed.append(f"{text[:200]}: {str(wrong)[:200]}")

    def flush() -> None:
        nonlocal head
        if values:
            do(f"{head} VALUES {', '.join(values)}", len(values))
        values.clear()
        head = None

    for row in files.toLocalIterator():
        for text in statements(row["value"]):
            start, found, rest = text.partition(" VALUES ")
            if found and start.upper().startswith("INSERT INTO") and "CONFLICT" not in rest.upper():
                if start != head or len(values) >= most:
                    flush()
                head = start
                values.append(rest)
            else:
                flush()
                do(text)
    flush()
    return ran, failed
