"""Exact dedup: sorted digest runs, merged in binomial rounds.

Every task sorts the digests of its rows into a run and keeps one entry per digest. In
each round the tasks swap parts of their runs: with FAN_IN = 2**b, round r sends an entry
to the task whose number has the next b bits of the digest in place of its own. After the
last round each task holds the merged run of its own range of digests, and no task has
ever held more than the merged entries of its range. Rows of a hot text vanish in the first
run, as each task sends a digest on once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalis.llm.common import join_counted, keep_rows, row_key, text_of
from annalis.session import staged

#: Runs merged at once in a round is 2**FAN_BITS.
FAN_BITS = 3

_RUN = "digest binary, tag long, part long, best long, has_id boolean, row long, n long"


def _merge_runs(batches):
    """One entry per digest and tag of a sorted run, with the best identifier of its entries."""
    held = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        digest = table["digest"].combine_chunks()
        tag = table["tag"].to_numpy()
        raw = np.frombuffer(b"".join(digest.to_pylist()), dtype="V32")
        new = np.ones(len(raw), bool)
        new[1:] = (raw[1:] != raw[:-1]) | (tag[1:] != tag[:-1])
        starts = np.flatnonzero(new)
        at = table.schema.get_field_index("n")
        merged = table.take(starts).set_column(at, table.schema.field(at), pa.array(np.add.reduceat(table["n"].to_numpy(), starts)))
        held = merged.slice(len(merged) - 1)
        yield from merged.slice(0, len(merged) - 1).to_batches()
    if held is not None:
        yield from held.to_batches()


def digest_groups(rows: DataFrame, width: int) -> DataFrame:
    """(digest, tag, best, has_id, row, n) per group of ``rows`` (digest, tag, order, row).

    ``width`` is the number of tasks of a round, a power of two. The best entry of a group
    is the one with the smallest ``order``, then the smallest ``row``; null orders come last.
    Two entries are merged only if digest and tag both agree.
    """
    bits = width.bit_length() - 1
    own = F.pmod(F.spark_partition_id(), F.lit(width)).cast("long")
    runs = rows.select("digest", "tag", own.alias("part"), F.col("order").alias("best"), F.col("order").isNotNull().alias("has_id"), "row", F.lit(1).cast("long").alias("n"))
    by = ["digest", "tag", F.col("has_id").desc(), "best", "row"]
    runs = runs.sortWithinPartitions(*by).mapInArrow(_merge_runs, _RUN)
    address = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    done = 0
    while done < bits:
        step = min(FAN_BITS, bits - done)
        mask = ((1 << step) - 1) << done
        runs = runs.withColumn("part", F.col("part").bitwiseAND(F.lit(~mask)).bitwiseOR(address.bitwiseAND(F.lit(mask))))
        runs = runs.repartitionById(width, F.col("part").cast("int")).sortWithinPartitions(*by).mapInArrow(_merge_runs, _RUN)
        done += step
    return runs.drop("part")


def exact_dedup(docs: DataFrame, keep: str = "smallest", width: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 and _key.

    ``keep`` says which doc_id of equal texts stays, "smallest" or "largest". Null texts
    equal empty ones. Null ids lose against all others; of rows with equal text and equal
    id one stays. An empty table gives an empty result; further columns are ignored.
    """
    base = docs.select("doc_id", text_of().alias("text"), row_key().alias("_key"))
    rows = staged(base.select("doc_id", "_key", F.unhex(F.sha2("text", 256)).alias("digest"),
                              F.xxhash64("text", F.length("text")).alias("tag"), F.monotonically_increasing_id().alias("row")), "digests")
    order = F.col("doc_id").cast("long") if keep == "smallest" else -F.col("doc_id").cast("long")
    groups = staged(digest_groups(rows.withColumn("order", order), width), "digest-groups")
    groups = groups.select("digest", F.col("tag").alias("_tag"), (F.col("best") if keep == "smallest" else -F.col("best")).alias("keep_id"), F.col("row").alias("_row"), F.col("n").alias("group_size"))
    joined = join_counted(rows, groups, "digest", "group_size", "inner").filter("tag = _tag")
    return joined.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "_key")


def drop_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """``docs`` with one row of each group of equal texts."""
    found = exact_dedup(docs, keep)
    return keep_rows(docs, staged(found.groupBy("_key").agg(F.max("kept").alias("_kept"), F.count("*").alias("_copies")), "keys"))
