"""Collocations: frequent phrases per language, found by fingerprints and verified by their texts.

1. Texts are cut into blocks of one language: distinct words, and the text as word numbers
   with -1 between pieces. Words are counted by their text.
2. Prefix polynomials over the words' hashes give a fingerprint to every pair, then to every
   triple of words. A block sends each of its distinct n-grams once, with its count and a
   pointer (block and position), to the fingerprint's bucket, as packed arrays; the word
   numbers have proven that they are equal. Pairs are sent only if both words are frequent,
   triples only if both pairs are, as far as bitmaps of fixed size know: they never miss one.
3. A bucket adds up equal fingerprints and keeps the pointers of those that are frequent.
4. Pointers go back to their blocks, where the phrases are read as text. The counts of equal
   texts are added, so that a collision of fingerprints can't change a count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalis.llm.align import blocks_of, text_sizes
from annalis.llm.common import U64, mix, text_of, texts
from annalis.session import staged

MIN_COUNT = 10
TOP = 2000
LONGEST = 3
#: A candidate goes if a longer one that holds it has at least this percentage of its count.
COVERED_PERCENT = 50
BLOCK_BYTES = 1 << 22
#: Bits of the filters in front of the shuffles; 8 MB each at any size of the data.
FILTER_BITS = 1 << 26
#: Words of the corpus for each bucket of fingerprints.
BUCKET_WORDS = 1 << 21
#: Parts of a language whose best rows are found apart from each other.
SALTS = 256

_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: 0 in a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?\n\v\f\r")] = 2


def numbered(found: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of some texts, their counts, and the texts as word numbers with -1 between pieces."""
    data = np.frombuffer(b"\n".join(found).translate(_LOWER), np.uint8)
    kind = _KIND[data]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = kind == 0
    edges = np.flatnonzero(np.diff(inside))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[kind == 0])]).dictionary_encode()
    numbers = words.indices.to_numpy()
    piece = np.cumsum(kind == 2)[starts]
    ids = np.insert(numbers, np.flatnonzero(piece[1:] != piece[:-1]) + 1, -1)
    return words.dictionary, np.bincount(numbers, minlength=len(words.dictionary)), ids


def word_prints(words: list[bytes], lang: str) -> np.ndarray:
    """The same 64 bits as ``xxhash64(lang, word)`` in SQL."""
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), U64, len(words))


def gram_prints(ids: np.ndarray, prints: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of the ``n`` words from each position on, and whether they are in one piece."""
    size = len(ids) - n + 1
    if size <= 0:
        return np.zeros(0, U64), np.zeros(0, bool)
    known = ids >= 0
    each = np.where(known, prints[np.maximum(ids, 0)], U64(0)) if len(prints) else np.zeros(len(ids), U64)
    prefix = np.append(U64(0), np.cumsum(each * np.cumprod(np.full(len(ids), _BASE))))
    found = (prefix[n:] - prefix[:-n]) * np.cumprod(np.full(size, _INVERSE))
    whole = np.logical_and.reduce([known[k : k + size] for k in range(n)])
    return mix(found + U64(n)), whole


def distinct_grams(ids: np.ndarray, prints: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, first position and count of the different n-grams at ``at``; equal means equal word numbers."""
    order = np.argsort(prints[at], kind="stable")
    for again in (False, True):
        pos = at[order]
        p = prints[pos]
        equal = np.logical_and.reduce([ids[pos[1:] + k] == ids[pos[:-1] + k] for k in range(n)])
        if again or not ((p[1:] == p[:-1]) & ~equal).any():
            break
        order = np.lexsort((at, *(ids[at + k] for k in range(n)), prints[at]))  # a collision: by words as well
    first = np.append(True, (p[1:] != p[:-1]) | ~equal)[: len(pos)]
    starts = np.flatnonzero(first)
    return p[starts], pos[starts], np.diff(np.append(starts, len(pos)))


#: Word numbers and fingerprints are packed, and few blocks share a row group: Spark's reader holds a group at once.
_BLOCK = "block long, lang string, words array<string>, counts array<long>, prints binary, ids binary"
GROUP_ROWS = 4


def _number(limit: int):
    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi in blocks_of(text_sizes(batch["text"]), limit):
                part, by_lang = batch.slice(lo, hi - lo), {}
                for lang, text in zip(part["lang"].to_pylist(), texts(part["text"]), strict=True):
                    by_lang.setdefault(lang, []).append(text)
                for lang in sorted(by_lang):
                    words, counts, ids = numbered(by_lang[lang])
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (words.cast(pa.string()), pa.array(counts, pa.int64()))]
                    packed = [pa.array([v.tobytes()], pa.binary()) for v in (word_prints(words.to_pylist(), lang).astype("<u8"), ids.astype("<i4"))]
                    yield pa.record_batch([pa.array([block], pa.int64()), pa.array([lang]), *lists, *packed], ["block", "lang", "words", "counts", "prints", "ids"])
                    block += 1

    return run


def _packed(batch, k: int, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(batch[name][k].as_buffer(), kind)


def _in(bitmap: np.ndarray, prints: np.ndarray) -> np.ndarray:
    bit = prints % U64(FILTER_BITS)
    return (bitmap[(bit >> U64(6)).astype(np.int64)] >> (bit & U64(63))) & U64(1) == 1


_SENT = "bucket int, block long, prints binary, at binary, counts binary"


def _send(n: int, sent, buckets: int):
    """The n-grams of each block whose parts of n - 1 words are in the bitmap, packed by bucket."""

    def run(batches):
        bitmap = sent.value
        for batch in batches:
            for k in range(batch.num_rows):
                prints, ids = _packed(batch, k, "prints", "<u8"), _packed(batch, k, "ids", "<i4")
                shorter, _ = gram_prints(ids, prints, n - 1) if n > 2 else (np.where(ids >= 0, prints[np.maximum(ids, 0)], U64(0)) if len(prints) else np.zeros(len(ids), U64), None)
                known = _in(bitmap, shorter)
                found, whole = gram_prints(ids, prints, n)
                at = np.flatnonzero(whole & known[: len(found)] & known[1 : len(found) + 1]) if len(found) else np.zeros(0, np.int64)
                p, pos, count = distinct_grams(ids, found, at, n)
                bucket = ((p >> U64(32)) % U64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                packed = [(p[order] & U64(0xFFFFFFFF)).astype("<u4"), pos[order].astype("<u4"), count[order].astype("<u4")]
                rows = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
                cols = [pa.array([v[cuts[b] : cuts[b + 1]].tobytes() for b in rows], pa.binary()) for v in packed]
                yield pa.record_batch([pa.array(rows, pa.int32()), pa.array([batch["block"][k].as_py()] * len(rows), pa.int64()), *cols], ["bucket", "block", "prints", "at", "counts"])

    return run


_LIVE = "block long, n int, at binary, counts binary, bits array<int>"


def _frequent(n: int, least: int):
    """Pointers of a bucket's frequent fingerprints, block by block, and one row with their bits."""

    def run(table: pa.Table) -> pa.Table:
        blocks = table["block"].to_numpy()
        parts = [[np.frombuffer(x, "<u4") for x in table[c].to_pylist()] for c in ("prints", "at", "counts")]
        prints, at, counts = (np.concatenate(x) for x in parts)
        order = np.argsort(prints, kind="stable")
        first = np.flatnonzero(np.append(True, prints[order][1:] != prints[order][:-1]))
        total = np.add.reduceat(counts[order].astype(np.int64), first)
        enough = total >= least
        live = np.zeros(len(prints), bool)
        live[order] = np.repeat(enough, np.diff(np.append(first, len(prints))))
        ends = np.cumsum([len(x) for x in parts[0]])
        out = [[], [], []]
        for block, lo, hi in zip(blocks, np.append(0, ends)[:-1], ends, strict=True):
            if live[lo:hi].any():
                some = live[lo:hi]
                for col, v in zip(out, (block, at[lo:hi][some].tobytes(), counts[lo:hi][some].tobytes()), strict=True):
                    col.append(v)
        bits = np.unique(prints[order][first[enough]] % np.uint32(FILTER_BITS))
        m = len(out[0])
        return pa.table([pa.array([*out[0], None], pa.int64()), pa.array([n] * (m + 1), pa.int32()), pa.array([*out[1], None], pa.binary()), pa.array([*out[2], None], pa.binary()),
                         pa.array([None] * m + [bits], pa.list_(pa.int32()))], ["block", "n", "at", "counts", "bits"])

    return run


def _read(batches):
    """The phrases that a block's live pointers point at, with their counts in the block."""
    for batch in batches:
        for k in range(batch.num_rows):
            words, ids = batch["words"][k].values, _packed(batch, k, "ids", "<i4")
            by_n: dict[int, list] = {}
            for x in batch["live"][k].as_py():
                by_n.setdefault(x["n"], []).append((np.frombuffer(x["at"], "<u4"), np.frombuffer(x["counts"], "<u4")))
            for n, some in by_n.items():
                at, counts = (np.concatenate(v).astype(np.int64) for v in zip(*some, strict=True))
                phrases = pc.binary_join_element_wise(*(words.take(pa.array(ids[at + j])) for j in range(n)), " ")
                lang = pa.array([batch["lang"][k].as_py()] * len(at), pa.string())
                yield pa.record_batch([lang, phrases.cast(pa.string()), pa.array([n] * len(at), pa.int32()), pa.array(counts)], ["lang", "phrase", "words", "count"])


def _bitmap(bits: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS bits from rows ``bit``; the driver gets at most FILTER_BITS / 64 rows."""
    packed = bits.groupBy((F.col("bit").bitwiseAND(F.lit(FILTER_BITS - 1)) / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 AS int)))").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, U64)
    out[packed["word"].to_numpy()] = packed["bits"].to_numpy().view(U64)
    return out


def frequent_phrases(docs: DataFrame, least: int = MIN_COUNT, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Phrases of 2 to LONGEST words with ``least`` occurrences or more (lang, phrase, words, count), and all words (lang, phrase, count)."""
    context = docs.sparkSession.sparkContext
    own = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_of().alias("text"))
    blocks = staged(own.mapInArrow(_number(block_bytes), _BLOCK), "word-blocks", **{"parquet.block.row.count.limit": GROUP_ROWS})
    each = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("lang", F.col("x.words").alias("phrase"), F.col("x.counts").alias("count"))
    words = staged(each.groupBy("lang", "phrase").agg(F.sum("count").alias("count")), "word-counts")
    total = words.agg(F.sum("count")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_WORDS))
    bits = words.filter(F.col("count") >= least).select(F.pmod(F.xxhash64("lang", "phrase"), F.lit(FILTER_BITS)).alias("bit"))
    live = None
    for n in range(2, LONGEST + 1):
        sent = blocks.select("block", "prints", "ids").mapInArrow(_send(n, context.broadcast(_bitmap(bits)), buckets), _SENT)
        found = staged(sent.groupBy("bucket").applyInArrow(_frequent(n, least), _LIVE), f"frequent-{n}")
        bits = found.select(F.explode("bits").alias("bit")).select(F.col("bit").cast("long"))
        found = found.filter("block IS NOT NULL").select("block", "n", "at", "counts")
        live = found if live is None else live.unionByName(found)
    pointers = live.groupBy("block").agg(F.collect_list(F.struct("n", "at", "counts")).alias("live"))
    texts_ = blocks.select("block", "lang", "words", "ids").join(pointers, "block").mapInArrow(_read, "lang string, phrase string, words int, count long")
    phrases = texts_.groupBy("lang", "phrase", "words").agg(F.sum("count").alias("count")).filter(F.col("count") >= least)
    return staged(phrases, "phrases"), words


def collocations(docs: DataFrame, least: int = MIN_COUNT, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``top`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    a, l, r are the counts of the phrase and of the two parts of its lowest-scoring cut, n all
    words of the language, score floor(1000000 a a / (l r)) in decimals of 38 digits. Null
    texts are empty, a null language is `und`. Every row counts, repeated ones as often as they
    occur. Ties in score go to the larger a, then to the phrase in byte order. An empty
    table gives an empty result; further columns are ignored.
    """
    phrases, words = frequent_phrases(docs, least, block_bytes)
    number = words.groupBy("lang").agg(F.sum("count").alias("n"))
    parts = words.filter(F.col("count") >= least).unionByName(phrases.filter(F.col("words") < LONGEST).drop("words"))
    split = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", F.col("count").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.array_join(F.slice(split, F.lit(1), F.col("k")), " ")).withColumn("rest", F.array_join(F.slice(split, F.col("k") + 1, F.col("words") - F.col("k")), " "))
    side = lambda name, count: parts.select("lang", F.col("phrase").alias(name), F.col("count").alias(count))
    cuts = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    exact = "cast((cast(1000000 AS decimal(8,0)) * (cast(a AS decimal(15,0)) * cast(a AS decimal(15,0)))) div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0))) AS bigint)"
    scored = cuts.withColumn("score", F.expr(exact)).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    within = phrases.filter(F.col("words") > 2).select("lang", F.col("count").alias("longer"), "words", split.alias("list"))
    within = within.select("lang", "longer", F.explode(F.array(F.expr("slice(list, 1, words - 1)"), F.expr("slice(list, 2, words - 1)"))).alias("list"))
    within = within.groupBy("lang", F.array_join("list", " ").alias("phrase")).agg(F.max("longer").alias("longer"))
    kept = scored.join(within, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < COVERED_PERCENT * F.col("a"), F.lit(True)))
    order = [F.desc("cut.score"), F.desc("a"), F.asc("phrase")]
    few = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.join(number, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
