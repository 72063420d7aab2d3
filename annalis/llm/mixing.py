"""Mixing sources to target weights with a low-discrepancy schedule.

Slot i of the mix takes the point frac(i * golden ratio). The points are mapped through the
cumulative targets of the sources, so that every stretch of the schedule has the sources
in their shares. The slots of a source are ranked; its documents, in a fixed random order
and repeated once, are cut into blocks of BLOCK words, and the block of each rank fills
the slot of that rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalis.llm.common import WORD, global_rank, join_counted, row_key, text_of
from annalis.session import staged, staged_alone

BLOCK = 128
WEIGHTS = (5, 2, 1)
PASSES = 2
#: Stretches of the unit interval and of each source's random order; chunks of slots ranked at once.
CELLS = 4096
CHUNK = 1 << 16
_GOLDEN = (5**0.5 - 1) / 2
_LOW = 1 << 20  # slots are multiplied in two parts, so that doubles keep the fraction


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = PASSES) -> DataFrame:
    """(source_key, source, rows, source_size, target) from ``sources`` (source, rows, source_size).

    Sources are ranked by code point, null last, and weigh ``weights`` in turn. They share
    ``share`` times all words by weight; what exceeds ``most`` times a source's own
    words is shared among the others again until no source is above.
    """
    ranked = global_rank(sources, [F.col("source").isNull(), F.col("source")], "_rank", "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = staged(ranked.select("source", "rows", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap")), "ranked-sources")
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = None, -1
    while True:  # a round shares out what the full sources leave; they only become more
        if level is None:
            state = ranked.agg(F.lit(0.0), F.sum("weight"), F.lit(0))
        else:
            above = F.col("weight") * level >= F.col("cap")
            state = ranked.agg(F.sum(F.when(above, F.col("cap")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))), F.sum(above.cast("int")))
        taken, free, n = state.first()
        if n == full or not free:
            break
        level, full = (total - taken) / free, n
    return ranked.select(F.xxhash64(F.lit(3), F.col("source")).alias("source_key"), "source", "rows", "source_size", F.least(F.col("weight") * F.lit(level or 0.0), F.col("cap")).alias("target"))


def schedule(target: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, source_key, rank): the slots of the mix with their rank inside the source."""
    spark = target.sparkSession
    words = target.select("source_key", F.round("target").cast("long").alias("words")).filter("words > 0")
    total = words.agg(F.sum("words")).first()[0] or 0
    slots = round(total / block)
    ends = staged(_running(words, "words", F.col("source_key")), "cumulative-targets")
    low, high = F.col("_before") / F.lit(total), (F.col("_before") + F.col("words")) / F.lit(total)
    spans = ends.select("source_key", low.alias("low"), high.alias("high")).withColumn("cell", F.explode(F.sequence(F.least(F.floor(F.col("low") * CELLS), F.lit(CELLS - 1)), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))))
    point = F.pmod((F.col("slot") % _LOW) * F.lit(_GOLDEN) + F.pmod(F.floor(F.col("slot") / _LOW) * F.lit(_LOW * _GOLDEN % 1.0), F.lit(1.0)), F.lit(1.0))
    drawn = spark.range(slots).select(F.col("id").alias("slot")).withColumn("point", point).withColumn("cell", F.floor(F.col("point") * CELLS))
    placed = drawn.join(spans, "cell").filter("low <= point AND point < high").select("slot", "source_key", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    placed = staged(placed, "slots")
    ahead = placed.groupBy("source_key", "chunk").count().withColumn("_before", F.sum("count").over(Window.partitionBy("source_key").orderBy("chunk")) - F.col("count"))
    inside = F.row_number().over(Window.partitionBy("source_key", "chunk").orderBy("slot")) - 1
    return placed.withColumn("_in", inside).join(ahead, ["source_key", "chunk"]).select("slot", "source_key", (F.col("_in") + F.col("_before")).alias("rank"))


def _running(df: DataFrame, value: str, order: Column) -> DataFrame:
    """Adds _before: the sum of ``value`` over the rows before, in ``order``, by ranges."""
    parts = staged(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = parts.groupBy("_part").agg(F.sum(value).alias("_s"))
    starts = sums.select("_part", (F.sum("_s").over(Window.orderBy("_part")) - F.col("_s")).alias("_start"))  # one row per task
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return parts.withColumn("_in", inside).join(F.broadcast(starts), "_part").withColumn("_before", F.col("_in") + F.col("_start")).drop("_part", "_in", "_start")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", row_key().alias("_key"), F.xxhash64(F.lit(3), F.col("source")).alias("source_key"), F.coalesce(F.regexp_count(text_of(), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def blocks(rows: DataFrame, target: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, doc_id, _key, pass, source_key, rank, start, length): the pieces of all blocks of every source.

    ``rows`` has row, doc_id, _key, source_key, size. A source's order is by a hash of the row key;
    it is summed in CELLS stretches, so that no task sums a whole source.
    """
    some = rows.filter("size > 0").withColumn("_at", F.xxhash64(F.lit(11), F.col("_key"))).withColumn("cell", F.shiftrightunsigned("_at", 52))
    cells = some.groupBy("source_key", "cell").agg(F.sum("size").alias("_n"), F.count("*").alias("_rows"))
    cells = cells.withColumn("_start", F.sum("_n").over(Window.partitionBy("source_key").orderBy("cell")) - F.col("_n")).select("source_key", "cell", "_start")  # CELLS rows per source at most
    inside = F.sum("size").over(Window.partitionBy("source_key", "cell").orderBy("_at", "row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = some.withColumn("_in", inside).join(cells, ["source_key", "cell"]).withColumn("_first", F.col("_in") + F.col("_start"))
    placed = join_counted(placed, staged(target.select("source_key", "rows", "source_size"), "source-sizes"), "source_key", "rows", "inner")
    placed = placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(PASSES - 1)))).withColumn("_from", F.col("_first") + F.col("pass") * F.col("source_size"))
    ranks = F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_from") + F.col("size") - 1) / block))
    cut = placed.withColumn("rank", F.explode(ranks))
    begin = F.greatest(F.col("_from"), F.col("rank") * block)
    end = F.least(F.col("_from") + F.col("size"), (F.col("rank") + 1) * block)
    return cut.select("row", "doc_id", "_key", "pass", "source_key", "rank", (begin - F.col("_from")).alias("start"), (end - begin).alias("length"))


def mix_sources(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, targets, pieces) of the mix of ``docs``.

    ``pieces`` has slot, row, doc_id, _key, pass, start, length: the words of a document that a
    slot takes; sorted by slot, then rank order they are the mix. Sizes are word counts; null
    and empty texts have none and are never taken. A null source is a source of its own, the
    last. Rows that repeat are separate documents. An empty table gives empty results.
    """
    rows = staged(sized(docs).withColumn("row", F.monotonically_increasing_id()), "sized")
    target = staged(targets(rows.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))), "targets")
    pieces = blocks(rows, target, block).join(schedule(target, block), ["source_key", "rank"])
    return rows, target, pieces.select("slot", "row", "doc_id", "_key", "pass", "start", "length")


def taken_words(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken."""
    rows, target, pieces = mix_sources(docs)
    taken = pieces.groupBy("row").agg(F.sum("length").alias("taken"))
    out = join_counted(rows.join(taken, "row", "left"), target.drop("source"), "source_key", "rows", "inner")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them, with the same columns.

    A document comes once for every pass that takes words of it, in the order of the first slot
    that does. A part of a document keeps its text up to the last word taken, joined by
    spaces; n_chars then tells its length.
    """

    def passes() -> DataFrame:
        _, _, pieces = mix_sources(docs)
        return pieces.groupBy("row", "_key", "pass").agg(F.max(F.col("start") + F.col("length")).alias("_upto"), F.min("slot").alias("_slot")).select("_key", "row", "_upto", "_slot")

    repeated = staged_alone(passes, "passes").groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_upto", "_slot")), False).alias("_uptos"), F.countDistinct("row").alias("_same"))
    # rows that repeat share their passes: each takes its own slice of the list
    nth = F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(1))) - 1
    both = docs.withColumn("_key", row_key()).join(repeated, "_key").withColumn("_nth", nth)
    each = F.filter(F.transform("_uptos", lambda x, i: F.when(F.pmod(i, F.col("_same")) == F.col("_nth"), x)), lambda x: x.isNotNull())
    out = both.withColumn("_pass", F.explode(each)).withColumn("_upto", F.col("_pass._upto")).withColumn("_slot", F.col("_pass._slot")).withColumn("_size", F.regexp_count(F.col("text"), F.lit(WORD)))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.col("_upto") < F.col("_size")
    out = out.withColumn("text", F.when(cut, F.array_join(F.slice(words, 1, F.col("_upto").cast("int")), " ")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.repartitionByRange("_slot").sortWithinPartitions("_slot").select(*docs.columns)
