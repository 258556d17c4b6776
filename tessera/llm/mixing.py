"""Mixing sources to target weights: fixed-length blocks, multinomial draws, index permutations, a join by block index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import one_by_one, stage, word_count

#: Weights by place of the source in order of code points, repeating (fixed values of the contract).
WEIGHTS = (5, 2, 1)
#: No source, and no document, is taken more often than this.
REPEATS = 3
#: The largest primes below 2**31, the steps of index permutations (fixed values).
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Targets of sources: (source, source_size) rows gain weight and target.

    Weighted shares of the whole, each stopped at repeats times its source's size, the excess reshared by weight.
    Closed form: in order of cap / weight the stopped sources are a prefix, so running sums find the final level.
    The windows order one row for each source, never documents.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    order = Window.orderBy("_ratio", "_place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("_place", place).withColumn("weight", weight)
    ranked = ranked.withColumn("_cap", F.col("source_size") * repeats)
    ranked = ranked.withColumn("_ratio", F.col("_cap") / F.col("weight"))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    ranked = ranked.withColumn("_level", level)
    # the first source that is not stopped, were all before it stopped, has the final level; later ones have it too
    free = F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "_place", "_level"))
    ranked = ranked.withColumn("_free", F.min(free).over(everything))
    below = F.struct("_ratio", "_place") < F.struct("_free._ratio", "_free._place")
    shared = F.col("weight") * F.col("_free._level")
    target = F.when(F.coalesce(below, F.lit(True)), F.col("_cap").cast("double")).otherwise(shared)
    return ranked.withColumn("target", target).drop("_place", "_cap", "_ratio", "_level", "_free")


def _packed(docs: DataFrame, rows_per_bucket: int) -> DataFrame:
    """Documents with the place _start of their first word in their source's sequence of words.

    Texts are read once; the narrow rows made of them are staged, rows that agree in source, doc_id and size as one with a
    count, so that repeated rows fill no bucket: they stand one after the other.
    """
    name = F.col("source").cast("string")
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        name.alias("source"),
        F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("_source"),
        word_count(F.col("text")).alias("size"),
    )
    sized = stage(sized.groupBy("doc_id", "source", "_source", "size").agg(F.count("*").alias("_times")), "sized")
    n = sized.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / rows_per_bucket)).cast("long").alias("_buckets"))
    sized = sized.join(F.broadcast(n)).withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "size"), F.col("_buckets")))
    packs = sized.groupBy("_source", "_bucket").agg(F.sum(F.col("size") * F.col("_times")).alias("_words"))
    running = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    packs = packs.select("_source", "_bucket", F.coalesce(F.sum("_words").over(running), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_source", "_bucket").orderBy("doc_id", "size")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_row", F.coalesce(F.sum("_times").over(earlier), F.lit(0)))
    placed = placed.withColumn("_sum", F.coalesce(F.sum(F.col("size") * F.col("_times")).over(earlier), F.lit(0)))
    placed = placed.join(packs, ["_source", "_bucket"]).withColumn("_start", F.col("_sum") + F.col("_offset"))
    placed = one_by_one(placed.drop("_buckets", "_sum", "_offset"), "_times", "_copy")
    placed = placed.withColumn("_row", F.col("_row") + F.col("_copy")).withColumn("_start", F.col("_start") + F.col("_copy") * F.col("size"))
    return placed.drop("_times", "_copy")


def _sources(packed: DataFrame, block_words: int, seed: int) -> DataFrame:
    """Sources with targets and with the slots they get: whole passes, then blocks of one more for the rest."""
    sizes = packed.groupBy("source", "_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_documents"))
    sources = source_targets(sizes).withColumn("_blocks", F.expr(f"(source_size + {block_words - 1}) div {block_words}"))
    sources = sources.withColumn("_passes", F.coalesce(F.floor(F.expr("try_divide(target, source_size)")), F.lit(0)))
    rest = F.round(F.expr("try_divide((target - _passes * source_size) * _blocks, source_size)"))
    return sources.withColumn("_slots", F.col("_passes") * F.col("_blocks") + F.coalesce(rest, F.lit(0)).cast("long")).withColumn(
        "_key", F.xxhash64("_source", F.lit(seed))
    )


def _permuted(j: str, turn: str) -> Column:
    """Index j under the permutation of 0 .. _blocks - 1 that source and turn choose: a step prime to _blocks, and a shift."""
    primes = ", ".join(f"{p}L" for p in PRIMES)
    fits = f"filter(array({primes}), p -> _blocks % p <> 0)"
    step = f"element_at({fits}, cast(pmod(xxhash64(_key, {turn}), size({fits})) + 1 as int))"
    shift = f"pmod(xxhash64(_key, {turn}, 1), _blocks)"
    return F.expr(f"cast((cast({step} as decimal(20,0)) * cast({j} as decimal(18,0)) + {shift}) % _blocks as long)")


def _slots(sources: DataFrame, out_shards: int, chunk: int = 4096) -> DataFrame:
    """One row for each drawn block: _source, _block, _slot, out_shard. Chunks spread a large source's slots over tasks."""
    groups = sources.where("_slots > 0").select(
        "_source", "_blocks", "_slots", "_key", F.explode(F.expr(f"sequence(0L, (_slots - 1) div {chunk * chunk})")).alias("_group")
    )
    upto = f"least((_slots - 1) div {chunk}, (_group + 1) * {chunk} - 1)"  # no array is longer than chunk, whatever the source
    chunks = groups.repartition("_source", "_group").select(
        "_source", "_blocks", "_slots", "_key", F.explode(F.expr(f"sequence(_group * {chunk}, {upto})")).alias("_chunk")
    )
    each = F.expr(f"sequence(_chunk * {chunk}, least(_slots, (_chunk + 1) * {chunk}) - 1)")
    slots = chunks.repartition("_source", "_chunk").select("_source", "_blocks", "_key", F.explode(each).alias("_slot"))
    return slots.select(
        "_source",
        "_slot",
        _permuted("(_slot % _blocks)", "(_slot div _blocks)").alias("_block"),
        F.pmod(F.xxhash64("_key", "_slot", F.lit(2)), F.lit(out_shards)).cast("int").alias("out_shard"),
    )


def _parts(packed: DataFrame, block_words: int) -> DataFrame:
    """Parts of documents by block: the words of a document that lie in one block; one part without a block if none do."""
    blocks = F.expr(f"case when size > 0 then sequence(_start div {block_words}, (_start + size - 1) div {block_words}) end")
    parts = packed.select("*", F.explode_outer(blocks).alias("_block"))
    first = F.greatest(F.col("_start"), F.col("_block") * block_words)
    last = F.least(F.col("_start") + F.col("size"), (F.col("_block") + 1) * block_words)
    return parts.withColumn("_first", first - F.col("_start")).withColumn("_words", last - first)


def _taken(
    docs: DataFrame, block_words: int, out_shards: int, seed: int, rows_per_bucket: int
) -> tuple[DataFrame, DataFrame]:
    """Each packed row (_source, _bucket, _row, doc_id, size, taken, n_out_shards), and the sources; see mix_sources."""
    packed = _packed(docs, rows_per_bucket)
    sources = _sources(packed, block_words, seed)
    if not 0 < out_shards <= 64:
        raise ValueError("out_shards must be 1 to 64, the bits of a long")
    here = F.expr("shiftleft(1L, out_shard)")
    drawn = _slots(sources, out_shards).groupBy("_source", "_block").agg(F.count("*").alias("_times"), F.bit_or(here).alias("_shards"))
    taken = _parts(packed, block_words).join(drawn, ["_source", "_block"], "left")
    taken = taken.groupBy("_source", "_bucket", "_row", "doc_id", "size").agg(
        F.coalesce(F.sum(F.col("_words") * F.col("_times")), F.lit(0)).cast("long").alias("taken"),
        F.coalesce(F.bit_count(F.bit_or("_shards")), F.lit(0)).cast("int").alias("n_out_shards"),
    )
    return taken, sources


def mix_sources(
    docs: DataFrame, block_words: int = 128, out_shards: int = 64, seed: int = 17, rows_per_bucket: int = 500
) -> DataFrame:
    """Mix documents so that each source's words come near its target, every draw being a block of fixed length.

    1. Pack: inside a source the words of its documents, in order of a hash bucket and doc_id, are one sequence, cut
       into blocks of block_words. Starts are offsets of buckets (running sums of bucket totals) plus running sums
       inside one bucket; buckets hold at most about rows_per_bucket rows at any size, so a hot source has many.
    2. Draw: a source has as many slots as blocks make its target, and each slot goes to a pseudorandom output shard:
       the counts of sources in a shard are a multinomial draw, given totals that meet the targets.
    3. Permute: slot j takes the block at index a * j + c modulo the source's blocks; a is prime to that number, and
       a and c change with source and pass. A pass takes no block twice and there are at most REPEATS passes, so no
       document exceeds REPEATS times its words.
    4. Join: slots, counted by block, meet the parts of documents by source and block index.

    Null text has no words; null source is a source of its own, last in order; repeated rows are packed one by one;
    documents without words have taken 0; an empty table gives no rows. Other columns of the input are left out.
    Returns doc_id, size, source_size, target, taken, n_out_shards (output shards that take words of it).
    """
    taken, sources = _taken(docs, block_words, out_shards, seed, rows_per_bucket)
    return taken.join(sources.select("_source", "source_size", "target"), "_source").select(
        "doc_id", "size", "source_size", "target", "taken", "n_out_shards"
    )


def mix_slots(
    docs: DataFrame, block_words: int = 128, out_shards: int = 64, seed: int = 17, rows_per_bucket: int = 500
) -> DataFrame:
    """The mix itself, as mix_sources counts it: one row for each part of a document in each slot.

    Returns out_shard, source, slot, block, doc_id, first_word (place in the document), words.
    """
    packed = _packed(docs, rows_per_bucket)
    slots = _slots(_sources(packed, block_words, seed), out_shards)
    return (
        _parts(packed, block_words)
        .join(slots, ["_source", "_block"])
        .selectExpr(
            "out_shard", "source", "_slot as slot", "_block as block", "doc_id", "_first as first_word", "_words as words"
        )
    )


def whole_copies(taken: DataFrame, sources: DataFrame, seed: int, rows_per_group: int = 4096) -> DataFrame:
    """Rows (_source, _bucket, _row, size, taken) with words gain _copies: whole copies whose words come to those taken.

    A row has taken div size copies, and one more where the running sum of what is left over passes a whole number. Sums
    run by size, from a pseudorandom start, in fixed point: each row has its share as the expected number of copies, and
    since the sums are off by less than one copy, a group's words are off by less than its largest document. Groups hold
    about rows_per_group rows of one source, so a hot source has many and the others one each.
    """
    one = 1 << 32
    counts = sources.select("_source", F.ceil(F.col("_documents") / rows_per_group).cast("long").alias("_groups"))
    grouped = taken.where("size > 0").join(counts, "_source")
    grouped = grouped.withColumn("_group", F.pmod(F.xxhash64("_bucket", "_row", F.lit(seed)), F.col("_groups")))
    grouped = grouped.withColumn("_left", F.expr(f"(taken % size) * {one}L div size"))
    begin = F.pmod(F.xxhash64("_source", "_group", F.lit(seed)), F.lit(one))
    upto = Window.partitionBy("_source", "_group").orderBy("size", "_bucket", "_row").rowsBetween(Window.unboundedPreceding, 0)
    grouped = grouped.withColumn("_reached", begin + F.sum("_left").over(upto))
    more = F.expr(f"_reached div {one}L - (_reached - _left) div {one}L")
    return grouped.withColumn("_copies", F.expr("taken div size") + more).drop("_groups", "_group", "_left", "_reached")


def mixed_documents(
    docs: DataFrame, block_words: int = 128, out_shards: int = 64, seed: int = 17, rows_per_bucket: int = 500, hot: int = 4096
) -> DataFrame:
    """Rows of docs, with all their columns, in whole copies (0 to REPEATS) whose words by source are those the mix takes.

    Copies are drawn by row (see whole_copies). Rows that agree in source, doc_id and size (repeated rows, null doc_ids)
    share theirs evenly: texts meet copies by that key, in one shuffle. Keys of over hot rows and a thousandth of all (so
    a thousand at most, which are broadcast) are dealt out over salts first. Null or empty texts have no words; of those,
    and of documents without words, the mix takes nothing, so they go. A null source is a source of its own; an empty
    table gives no rows; columns may have any names.
    """
    key = ["_source", "_known", "_id", "size"]
    copies = whole_copies(*_taken(docs, block_words, out_shards, seed, rows_per_bucket), seed)

    def known(rows: DataFrame) -> DataFrame:
        doc_id = F.col("doc_id").cast("long")
        return rows.withColumn("_known", doc_id.isNotNull()).withColumn("_id", F.coalesce(doc_id, F.lit(0)))

    copies = known(copies).groupBy(key).agg(F.sum("_copies").alias("_copies"), F.count("*").alias("_rows")).where("_copies > 0")
    copies = stage(copies, "copies")
    total = copies.agg(F.sum("_rows")).first()[0] or 0
    limit = max(hot, total // 1000)
    copies = copies.withColumn("_salts", F.expr(f"(_rows + {limit - 1}) div {limit}"))
    salts = F.broadcast(copies.where("_salts > 1").select(*key, F.col("_salts").alias("_split")))
    name = F.col("source").cast("string")
    texts = docs.select(
        F.struct(*docs.columns).alias("_doc"),
        F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("_source"),
        F.col("doc_id"),
        word_count(F.col("text")).alias("size"),
    )
    texts = known(texts).join(salts, key, "left").withColumn("_salt", F.floor(F.rand(seed) * F.coalesce("_split", F.lit(1))).cast("long"))
    copies = copies.select(*key, "_copies", "_rows", F.explode(F.expr("sequence(0L, _salts - 1)")).alias("_salt"))
    place = Window.partitionBy(*key, "_salt").orderBy(F.xxhash64("_doc.text"))
    drawn = texts.withColumn("_place", F.row_number().over(place)).join(copies.hint("merge"), [*key, "_salt"])
    # the copies over whole ones fall evenly on a key's rows, whichever of its salts they are in
    more = "(_place * (_copies % _rows)) div _rows - ((_place - 1) * (_copies % _rows)) div _rows"
    drawn = drawn.withColumn("_times", F.expr(f"cast(_copies div _rows + {more} as int)")).where("_times > 0")
    return drawn.select("_doc", F.explode(F.expr("sequence(1, _times)"))).select("_doc.*")
