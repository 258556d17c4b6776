"""Sharding by Hilbert-curve ordering: metadata is quantised, rows are sorted by curve index, and the order is cut into runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import one_by_one, stage, unstage

BITS = 4
DIMS = 3


def _rotate_right(x: Column, by: Column) -> Column:
    by = by % DIMS
    low = F.call_function("shiftright", x, by)
    high = F.call_function("shiftleft", x, F.lit(DIMS) - by)
    return low.bitwiseOR(high).bitwiseAND((1 << DIMS) - 1)


def _rotate_left(x: Column, by: Column) -> Column:
    return _rotate_right(x, F.lit(DIMS) - by % DIMS)


def curve_tables() -> tuple[list[int], list[int], list[int]]:
    """Inverse Gray code, entry point and direction of each sub-cube of a level, from their defining rules."""
    n = 1 << DIMS
    gray = [w ^ (w >> 1) for w in range(n)]
    inverse = [gray.index(g) for g in range(n)]
    entry = [0 if w == 0 else gray[2 * ((w - 1) // 2)] for w in range(n)]

    def ones(x: int) -> int:
        count = 0
        while x & 1:
            x, count = x >> 1, count + 1
        return count

    turn = [0 if w == 0 else ones(w - 1) % DIMS if w % 2 == 0 else ones(w) % DIMS for w in range(n)]
    return inverse, entry, turn


def hilbert_index(coordinates: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of DIMS coordinates with the given bits each, by walking the levels from the top.

    State per level: the entry corner e and direction d of the current sub-cube. One higher-order aggregate, no UDF.
    """
    if len(coordinates) != DIMS:
        raise ValueError(f"{DIMS} coordinates are needed")
    inverse, entry, turn = (F.array(*map(F.lit, t)) for t in curve_tables())
    start = F.struct(F.lit(0).alias("e"), F.lit(0).alias("d"), F.lit(0).cast("long").alias("h"))
    corners = [
        sum((F.shiftright(c, level).bitwiseAND(1) * (1 << i) for i, c in enumerate(coordinates)), F.lit(0)).cast("int")
        for level in range(bits - 1, -1, -1)
    ]

    def step(acc, corner):
        w = F.element_at(inverse, _rotate_right(corner.bitwiseXOR(acc["e"]), acc["d"] + 1) + 1)
        return F.struct(
            acc["e"].bitwiseXOR(_rotate_left(F.element_at(entry, w + 1), acc["d"] + 1)).alias("e"),
            ((acc["d"] + F.element_at(turn, w + 1) + 1) % DIMS).alias("d"),
            (acc["h"] * (1 << DIMS) + w).alias("h"),
        )

    return F.aggregate(F.array(*corners), start, step, lambda acc: acc["h"])


def hilbert_shards(docs: DataFrame, shards: int = 24, rows_per_bucket: int = 500) -> DataFrame:
    """Deal documents into shards of near-equal row counts along a Hilbert curve over (source, size, doc_id).

    Coordinates of 4 bits: a hash of the source, log2 of the size, and doc_id between its least and largest. The
    global rank of each row comes without a global sort: rows are counted by curve cell (at most 4096) and by hash
    bucket inside the cell, offsets are running sums of those counts, and only the rows of one bucket are numbered
    together. Buckets hold about rows_per_bucket rows at any input size, so a hot source splits like any other; rows that
    agree in all that is returned are one row with a count until the end, so that repeated rows fill no bucket. Texts are
    read once; the narrow rows made of them are staged.

    Law: rows. Shards are equal in rows up to one; slots run from 0 without gaps. Null text counts as empty, null
    source or doc_id has a coordinate of its own or 0 and sorts first; repeated rows are dealt one by one. An empty
    table gives no rows. Extra columns are kept out of the result.
    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), curve.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = stage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.conv(F.substring(F.md5(F.coalesce(F.col("source").cast("string"), F.lit("\x00"))), 1, 1), 16, 10).cast("int").alias("_source"),
        ),
        "narrow",
    )
    ends = base.agg(
        F.count("*").alias("_n"),
        F.coalesce(F.min("doc_id"), F.lit(0)).alias("_lo"),
        F.coalesce(F.max("doc_id"), F.lit(0)).alias("_hi"),
    )
    side = 1 << BITS
    spread = (F.col("doc_id").cast("double") - F.col("_lo")) * side / (F.col("_hi").cast("double") - F.col("_lo") + 1)
    located = base.join(F.broadcast(ends)).select(
        "doc_id",
        "size",
        "text_crc32",
        "_n",
        hilbert_index(
            [
                F.col("_source"),
                F.least(F.floor(F.log2("size")).cast("int"), F.lit(side - 1 + 3)) - 3,
                F.coalesce(F.least(F.floor(spread).cast("int"), F.lit(side - 1)), F.lit(0)),
            ]
        ).alias("curve"),
    )
    located = stage(located.groupBy("doc_id", "size", "text_crc32", "_n", "curve").agg(F.count("*").alias("_times")), "located")
    unstage(base)
    # Cells get as many buckets as their share of rows needs, so the bucket of a row follows from its cell's count.
    cells = located.groupBy("curve").agg(F.sum("_times").alias("_rows"))
    order = Window.orderBy("curve")  # at most 4096 rows, one for each cell
    cells = cells.select(
        "curve",
        (F.sum("_rows").over(order) - F.col("_rows")).alias("_before"),
        F.ceil(F.col("_rows") / rows_per_bucket).cast("long").alias("_buckets"),
    )
    dealt = located.join(F.broadcast(cells), "curve").withColumn(
        "_bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.col("_buckets"))
    )
    counts = dealt.groupBy("curve", "_bucket").agg(F.sum("_times").alias("_rows"))
    within = Window.partitionBy("curve").orderBy("_bucket")
    starts = counts.select("curve", "_bucket", (F.sum("_rows").over(within) - F.col("_rows")).alias("_offset"))
    one = Window.partitionBy("curve", "_bucket").orderBy("doc_id", "text_crc32", "size")
    ranked = dealt.withColumn("_at", F.sum("_times").over(one) - F.col("_times")).join(starts, ["curve", "_bucket"])
    ranked = one_by_one(ranked, "_times", "_copy").withColumn("_at", F.col("_at") + F.col("_copy"))
    rank = F.col("_before") + F.col("_offset") + F.col("_at")
    # shard s covers the ranks r with floor(r * shards / n) = s; its first is ceil(s * n / shards)
    exact = F.expr(f"(_before + _offset + _at) * {shards} div _n")
    first = F.expr(f"(_shard * _n + {shards - 1}) div {shards}")
    return (
        ranked.withColumn("_shard", exact)
        .withColumn("_first", first)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            F.col("_shard").cast("int").alias("shard"),
            (rank - F.col("_first")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "curve",
        )
    )
