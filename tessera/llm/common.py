"""Helpers that several operators share: words, shared staging, spans, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import inspect
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than these (fixed values).
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a local session gets a fresh local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def trimmed(fn):
    """A function of Arrow batches, or of one table, that gives the memory it freed back to the machine when it ends.

    Python workers live on between tasks; without this each would keep its largest task's memory beside the executor's.
    """

    def release() -> None:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
            ctypes.CDLL(None).malloc_trim(0)

    if inspect.isgeneratorfunction(fn):

        @functools.wraps(fn)
        def batches(given):
            try:
                yield from fn(given)
            finally:
                release()

        return batches

    @functools.wraps(fn)
    def one(given):
        try:
            return fn(given)
        finally:
            release()

    return one


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write rows to the shared folder and read them back: cuts lineage, survives lost executors, computes once."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    rows = df.sparkSession.read.schema(df.schema).parquet(path)
    rows.staged_at = path
    return rows


def unstage(*rows: DataFrame) -> None:
    """Remove staged rows that nothing reads any more; rows that were not staged are left alone."""
    for df in rows:
        path = getattr(df, "staged_at", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def one_by_one(rows: DataFrame, times: str, number: str, chunk: int = 4096) -> DataFrame:
    """Each row as often as its column times says, with a number from 0; rows of more than chunk copies are dealt out in chunks."""
    few = rows.where(F.col(times) <= chunk).withColumn(number, F.explode(F.expr(f"sequence(0L, {times} - 1)")))
    many = rows.where(F.col(times) > chunk).withColumn("_chunk", F.explode(F.expr(f"sequence(0L, ({times} - 1) div {chunk})")))
    many = many.repartition(*many.columns)
    each = F.explode(F.expr(f"sequence(_chunk * {chunk}, least({times}, (_chunk + 1) * {chunk}) - 1)"))
    return few.unionByName(many.withColumn(number, each).drop("_chunk"))


def join_by_key(rows: DataFrame, keys: DataFrame, key: str, total: int, count: str = "n", hot: int = 1000) -> DataFrame:
    """rows joined with keys, one row for each key with the number of rows it has, by key; the count goes.

    Keys of over hot rows and a thousandth of total, the number of rows or more, are less than a thousand: those are
    broadcast, so that no task gets all rows of one. The others meet their rows in one shuffle, with no more than that for each.
    """
    limit = max(hot, total // 1000)
    few = F.broadcast(keys.where(F.col(count) > limit).drop(count))
    often = rows.join(few, key)
    rest = rows.join(few.select(key), key, "left_anti").join(keys.where(F.col(count) <= limit).drop(count), key)
    return often.unionByName(rest)


def word_count(text: Column) -> Column:
    """Number of words of a text without building them: each word becomes one letter, and the letters are counted."""
    marks = F.regexp_replace(text, WORD, "a")
    return F.coalesce(F.octet_length(marks) - F.octet_length(F.replace(marks, F.lit("a"), F.lit(""))), F.lit(0)).cast("long")


SPAN = "array<struct<start:int,end:int,value:string>>"


def _places(found: Column, gaps: Column) -> Column:
    """array<struct<start, end, value>> from matches and the texts around them; see with_matches."""
    pairs = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, v: F.struct(F.length(g).alias("gap"), v.alias("value"))
    )
    none = F.array().cast(SPAN)

    def place(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))
        return F.struct(end.alias("at"), F.concat(acc["out"], one).alias("out"))

    blocks = F.transform(
        F.sequence(F.lit(0), ((F.size(found) - 1) / 128).cast("int")),
        lambda b: F.aggregate(F.slice(pairs, b * 128 + 1, F.lit(128)), F.struct(F.lit(0).alias("at"), none.alias("out")), place),
    )

    def shift(acc, b):
        moved = F.transform(
            b["out"],
            lambda x: F.struct(
                (x["start"] + acc["at"]).alias("start"), (x["end"] + acc["at"]).alias("end"), x["value"].alias("value")
            ),
        )
        return F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    return F.when(F.size(found) > 0, F.aggregate(blocks, first, shift, lambda acc: F.flatten(acc["out"]))).otherwise(none)


def with_matches(df: DataFrame, text: str, patterns: dict[str, str], context: dict[str, int] | None = None) -> DataFrame:
    """Add a column for each pattern: its leftmost non-overlapping matches in code points, end exclusive.

    array<struct<start, end, value>>, empty for null text. For the patterns in context, columns around_<name> are added too:
    array<struct<before, after>>, so many code points on both sides of each match, up to the next match of the pattern. Spark gives matches without places; splitting by the same
    pattern gives what lies between, so places are running sums of both lengths, in blocks of 128 and then over blocks.
    Each step is a projection of its own, so that no regular expression runs twice; texts without a match are not split.
    """
    keep = df.columns
    found = {k: F.coalesce(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)), F.array().cast("array<string>")) for k, p in patterns.items()}
    df = df.select(*keep, *(c.alias(f"_found_{k}") for k, c in found.items()))
    gaps = {k: F.when(F.size(f"_found_{k}") > 0, F.split(F.col(text), p, -1)) for k, p in patterns.items()}
    df = df.select(*df.columns, *(c.alias(f"_gaps_{k}") for k, c in gaps.items()))

    def around(gaps: Column, n: int) -> Column:
        ends = F.transform(gaps, lambda g: F.struct(F.right(g, F.lit(n)).alias("before"), F.left(g, F.lit(n)).alias("after")))
        sides = F.zip_with(ends, F.slice(ends, 2, F.greatest(F.size(ends) - 1, F.lit(0))), lambda a, b: F.struct(a["before"].alias("before"), b["after"].alias("after")))
        return F.when(F.size(ends) > 1, F.slice(sides, 1, F.size(ends) - 1)).otherwise(F.array().cast("array<struct<before:string,after:string>>"))

    return df.select(
        *keep,
        *(_places(F.col(f"_found_{k}"), F.col(f"_gaps_{k}")).alias(k) for k in patterns),
        *(around(F.col(f"_gaps_{k}"), n).alias(f"around_{k}") for k, n in (context or {}).items()),
    )


def tagged(spans: Column, rank: int, kind: str) -> Column:
    """Spans as array<struct<start, rank, kind, end>>, which sort by start and then by rank."""

    def one(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"))

    return F.transform(spans, one)


def spans_text(spans: Column) -> Column:
    """array<struct<start, rank, kind, end>> in order of start, then rank, as kind:start:end joined by commas."""
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")),
        ),
        ",",
    )


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, component), component the smallest node.

    Alternating large-star and small-star steps on distributed rows; each round is staged, and only a count of
    edges and a checksum reach the driver. Hubs, the nodes of a thousandth of all edges, are joined by broadcast.
    """
    cur = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name
    )
    def checked() -> tuple:
        return tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = checked()
    while True:
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_by_key(both.where("v > u"), least, "u", now[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.where("u <> v").distinct(), name)
        lows = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_by_key(large, lows, "u", now[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(lows.select("u", F.col("m").alias("v"))).where("u <> v")
        last, cur = cur, stage(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
        unstage(last, large)
        seen, now = now, checked()
        if now == seen:
            break
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    found.staged_at = cur.staged_at
    return found
