"""What the operators of this package share: row keys, joins with hot keys, words and hashes.

Tables of documents hold doc_id, text, lang, source, n_chars; other columns pass through.
A null text counts as empty everywhere.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalis.session import staged

WORD = r"[^\x20\x09-\x0D]+"
#: A key with at least this share of the rows is joined by broadcast; there are at most HOT_KEYS such keys.
HOT_KEYS = 128
#: Buckets of the semi-join filter in front of a join that would shuffle whole texts.
FILTER_BUCKETS = 1 << 20

U64 = np.uint64
_MIX = U64(0x9E3779B97F4A7C15)
_MIX2 = U64(0xBF58476D1CE4E5B9)


def text_of(text: str | Column = "text") -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(col, F.lit(""))


def row_key(id_col: str = "doc_id", text: str = "text") -> Column:
    """64 bits of id and text. Rows equal in both are the same document."""
    return F.xxhash64(F.col(id_col), text_of(text))


def with_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def join_counted(left: DataFrame, right: DataFrame, on: str, rows: str, how: str = "left") -> DataFrame:
    """Equi-join of ``left`` with one ``right`` row per key, where ``right[rows]`` is the key's row count in ``left``.

    Keys with a share of 1/HOT_KEYS or more of all rows are at most HOT_KEYS many, so that
    they can be broadcast; their rows are not shuffled. No key of the rest is hot.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    hot = F.col(rows) * HOT_KEYS >= F.lit(total)
    few = right.filter(hot).limit(HOT_KEYS)
    many = right.filter(~hot)
    known = F.broadcast(few.select(on))
    return left.join(F.broadcast(few), on).unionByName(left.join(known, on, "left_anti").join(many, on, how))


def likely_in(docs: DataFrame, keys: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """``docs`` without most rows whose ``key`` is not in ``keys``; a filter in front of the exact join.

    At most FILTER_BUCKETS hash buckets are broadcast. With more keys than that it lets more
    rows pass and the join behind it still gives the same rows. ``left_anti`` gives the rows left out.
    """
    bucket = lambda c: F.pmod(F.xxhash64(F.lit(17), c), F.lit(FILTER_BUCKETS))
    buckets = keys.select(bucket(F.col(key)).cast("int").alias("_bucket")).distinct()
    return docs.withColumn("_bucket", bucket(F.col(key)).cast("int")).join(F.broadcast(buckets), "_bucket", how).drop("_bucket")


def keep_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose row key is kept, equal rows once; ``keys`` has _key, _copies, _kept for every key of ``docs``.

    Only rows in a bucket with a key that goes or has copies are looked up by a join. At most
    FILTER_BUCKETS buckets are broadcast; with more such keys than that more rows take the join.
    """
    cols = docs.columns
    open_ = keys.filter("NOT _kept OR _copies > 1")
    kept = keys.filter("_kept").select("_key", "_copies")
    keyed = docs.withColumn("_key", row_key())
    own = likely_in(keyed, open_, "_key").join(kept, "_key")
    sure = likely_in(keyed, open_, "_key", "left_anti").select(*cols)
    one = own.filter("_copies = 1").select(*cols)
    return sure.unionByName(one).unionByName(own.filter("_copies > 1").dropDuplicates(["_key"]).select(*cols))


def global_rank(df: DataFrame, order: list[Column], name: str, label: str) -> DataFrame:
    """Adds the 0-based rank in ``order`` without a single-task sort: ranges, then offsets of the ranges."""
    parts = staged(df.repartitionByRange(*order).sortWithinPartitions(*order)
                   .withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), label)
    counts = parts.groupBy("_part").count()
    starts = counts.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_start"))
    first = parts.groupBy("_part").agg(F.min("_at").alias("_first"))
    return (parts.join(F.broadcast(starts), "_part").join(F.broadcast(first), "_part")
            .withColumn(name, F.col("_start") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_start", "_first"))


class WordHashes(dict):
    """64-bit hash of each word; keeps a bounded number of them."""

    LIMIT = 1 << 16

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * _MIX2
    return x ^ (x >> U64(29))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive entries."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    acc = np.full(n, U64(width))
    for k in range(width):
        acc = (acc ^ hashes[k : k + n]) * _MIX
        acc ^= acc >> U64(32)
    return acc


def texts(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty. ``bytes.split()`` gives the words of WORD."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]
