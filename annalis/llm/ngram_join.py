"""N-gram Jaccard join with token-combination prefixes.

The tokens of a document are its distinct word 5-grams, in one global order: frequency
class, then hash. Two sets of sizes a >= b with Jaccard similarity t or more share a token
in their prefixes of length n - ceil(t * n) + 1.

* Rare tokens (class 0) of the prefix are indexed one by one.
* If a prefix reaches frequent tokens, all its rare tokens lie inside the prefix. It is
  extended by g tokens, so that two similar documents share at least g + 1 tokens of the
  extended prefixes: a rare one, or else g + 1 frequent ones. Frequent tokens are dealt into
  g groups by hash; two of the shared ones are in the same group. So pairs of frequent
  tokens of one group are indexed, about as many as there are tokens. g is a power of two
  near the prefix length; the smaller document uses the g of every larger partner that it
  can have (two values at most).

Frequency classes come from counters of hashed tokens over the whole corpus: SKETCH_BITS
fix their number, and a token counts as frequent if its counter stands out of the mean load
by more than chance allows. Any classes give the same links; they only save work.

Documents with equal sets are one node, and keys with the same nodes are one. Each index key links its nodes to the smallest and
the largest of them, and nodes left over to a few random ones; links are verified on whole
sets. Nodes that are then in one component need no further comparison. What is left is
exact: all pairs of different components that share a key are verified, too, unless sizes,
prefixes and parity bitmaps rule them out, so that no component is missed. Keys of up to
LARGE nodes are joined with themselves. The larger ones of a family have most nodes in
common: their nodes meet once for each smallest node of a key, in tiles of bitmaps, where
only the pairs that pass become rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalis.llm.common import U64, WordHashes, join_counted, keep_rows, likely_in, mix, rolling, row_key, text_of, texts
from annalis.llm.graph import components
from annalis.session import small_batches, staged, staged_alone

WORDS = 5
PERCENT = 80
SKETCH_BITS = 20
#: Further rounds in which nodes outside the main component of their keys try random nodes of these keys.
PIVOT_ROUNDS, PIVOTS = 1, 6
#: Keys of more nodes are compared by tiles of at most about twice TILE nodes.
LARGE, TILE = 16, 1 << 13
_CHUNK = 1 << 12
#: Tokens that a task holds before it counts them.
_COUNTED = 1 << 18


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct 5-gram hashes; a shorter sequence is one shingle, none is empty."""
    return np.unique(mix(rolling(hashes, min(WORDS, len(hashes))))) if len(hashes) else hashes


def _sets(column, hashes: WordHashes):
    for text in texts(column):
        yield shingle_set(hashes.of(text.lower().split()))


def _digest(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _survey(batches):
    """Rows of documents (sizes and digests), and the counters of this task in chunks."""
    hashes, counters = WordHashes(), np.zeros(1 << SKETCH_BITS, np.int64)
    names, found, n = ["doc_id", "key", "n", "digest", "chunk", "counters"], [np.zeros(0, U64)], 0
    for batch in batches:
        sizes, digests = [], []
        for tokens in _sets(batch["text"], hashes):
            sizes.append(len(tokens))
            digests.append(_digest(tokens) if len(tokens) else None)
            found.append(tokens)
            n += len(tokens)
            if n > _COUNTED:
                counters += np.bincount((np.concatenate(found) >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counters))
                found, n = [np.zeros(0, U64)], 0
        none = pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())
        yield pa.record_batch([batch["doc_id"], batch["_key"], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), *none], names)
    counters += np.bincount((np.concatenate(found) >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counters))
    counters = counters.astype(np.uint32)
    chunks = [(k, counters[k * _CHUNK : (k + 1) * _CHUNK]) for k in range(len(counters) // _CHUNK)]
    chunks = [(k, c.tobytes()) for k, c in chunks if c.any()]
    n = len(chunks)
    yield pa.record_batch([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array([k for k, _ in chunks], pa.int32()), pa.array([c for _, c in chunks], pa.binary())], names)


def _add_counters(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch["chunk"].to_pylist(), batch["counters"].to_pylist(), strict=True):
            total[k] = total.get(k, 0) + np.frombuffer(raw, np.uint32).astype(np.int64)
    yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], ["chunk", "counters"])


def frequency_classes(counters: np.ndarray) -> np.ndarray:
    """0 for buckets that do not stand out of the mean load, then one class per doubling."""
    load = counters.mean()
    floor = load + 6 * np.sqrt(load) + 16
    excess = np.maximum(counters - load, 1.0)
    return np.where(counters > floor, 1 + np.floor(np.log2(excess)), 0).astype(np.uint8)


def _prefix(n: int) -> int:
    return n - (PERCENT * n + 99) // 100 + 1


def _groups(n: int) -> set[int]:
    """The g of every partner of size n to n * 100 / PERCENT."""
    return {1 << (_prefix(size).bit_length() - 1) for size in (n, n * 100 // PERCENT)}


def parity_bits(tokens: np.ndarray) -> np.ndarray:
    """Parity bitmap of a set in 64-bit words, a power of two of them, with 2 to 4 bits a token.

    The halves of a bitmap, combined by exclusive or, are the bitmap of half the length.
    """
    words = 1 << max(0, -(-len(tokens) // 32) - 1).bit_length()
    odd = np.bincount((mix(tokens) & U64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(U64)


def index_keys(tokens: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Index keys of a set: rare prefix tokens (even) and pairs of frequent ones (odd)."""
    n = len(tokens)
    if n == 0:
        return tokens
    own = classes[(tokens >> U64(64 - SKETCH_BITS)).astype(np.int64)]
    order = np.argsort(own, kind="stable")
    ranked, frequent = tokens[order], own[order] > 0
    p = _prefix(n)
    keys = [ranked[:p][~frequent[:p]] & ~U64(1)]
    if frequent[p - 1]:
        for g in _groups(n):
            some = ranked[: p + g][frequent[: p + g]]
            group = mix(some ^ U64(g)) & U64(g - 1)
            at = np.argsort(group, kind="stable")
            some, group = some[at], group[at]
            for d in range(1, len(some)):
                same = group[d:] == group[:-d]
                if not same.any():
                    break
                a, b = some[:-d][same], some[d:][same]
                keys.append(mix(mix(np.minimum(a, b)) ^ np.maximum(a, b) ^ U64(g)) | U64(1))
    return np.unique(np.concatenate(keys))


def _index_rows(classes: np.ndarray):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            digests, sizes, keys, bits = [], [], [], []
            for tokens in _sets(batch["text"], hashes):
                digests.append(_digest(tokens) if len(tokens) else None)
                sizes.append(len(tokens))
                keys.append(index_keys(tokens, classes).astype(np.int64))
                bits.append(parity_bits(tokens).view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.record_batch([batch["_key"], pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, longs), pa.array(bits, longs)], ["key", "digest", "n", "keys", "bits"])

    return run


def _set_rows(batches):
    """Sets of the texts that stand for a node; the digest makes sure of it."""
    hashes = WordHashes()
    for batch in batches:
        nodes, sets = [], []
        for tokens, node, digest in zip(_sets(batch["text"], hashes), batch["node"].to_pylist(), batch["digest"].to_pylist(), strict=True):
            if len(tokens) and _digest(tokens) == digest:
                nodes.append(node)
                sets.append(tokens.astype(np.int64))
        yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "tokens"])


def _nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def _with_both(pairs: DataFrame, facts: DataFrame, names: list[str]) -> DataFrame:
    for end in ("a", "b"):
        pairs = pairs.join(facts.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in names]), end)
    return pairs


def _needed(n: Column) -> Column:
    return F.floor((n * PERCENT + 99) / 100)


def _may_link(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """If two nodes (size, sharable) can be similar; sharable is the size without rare prefix tokens that no other set has in its prefix.

    Such a token may still be in the other set, behind its prefix. Of an overlap o, at most needed - 1
    tokens of the larger set lie behind one of the prefixes, so that o - needed + 1 or more are in both;
    with sharable >= n - prefix + those in both, sharable >= o for the larger set, and for the smaller
    one sharable + its lack of needed tokens against the larger >= o.
    """
    (n, upper), (m, other) = a, b
    size = (n * 100 >= m * PERCENT) & (m * 100 >= n * PERCENT)
    overlap = F.least(upper - _needed(n), other - _needed(m)) + _needed(F.greatest(n, m))
    return size & (overlap * (100 + PERCENT) >= (n + m) * PERCENT)


def _differing(a: Column, b: Column) -> Column:
    """Bits in which two parity bitmaps differ; the longer one is folded to the length of the other."""
    half = lambda x, y: F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, 1, F.size(y)), F.slice(x, F.size(y) + 1, F.size(y)), lambda u, v: u.bitwiseXOR(v))).otherwise(x)
    return F.aggregate(F.zip_with(half(a, b), half(b, a), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, v: s + v)


def _possible(pairs: DataFrame, nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) that sizes, sharable tokens and parity bitmaps do not rule out.

    Sizes come first: those that pass differ by a quarter at most, so that one folding is enough.
    """
    pairs = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sized = _with_both(pairs, facts, ["n", "upper"]).filter(_may_link((F.col("n_a"), F.col("upper_a")), (F.col("n_b"), F.col("upper_b"))))
    sized = staged(sized.select("a", "b"), "pairs")
    own = _nodes_of(sized)
    bitmaps = staged(likely_in(nodes.select("node", "n", "bits"), own, "node").join(own, "node", "left_semi"), "bitmaps")
    both, size = _with_both(sized, bitmaps, ["n", "bits"]), F.col("n_a") + F.col("n_b")
    near = (size - _differing(F.col("bits_a"), F.col("bits_b"))) * (100 + PERCENT) >= 2 * PERCENT * size
    return staged(both.filter(near).select("a", "b"), "possible-pairs")


def _near_in_tile(table: pa.Table) -> pa.Table:
    """Pairs of a tile, a stray and a node of another component, that sizes, sharable tokens and bitmaps do not rule out.

    The same conditions as in ``_may_link`` and ``_possible``; a tile of two cells has only pairs across them.
    """
    table = table.sort_by("n").combine_chunks()
    node, c, n, upper, cell = (table[x].to_numpy() for x in ("node", "c", "n", "upper", "cell"))
    stray, across = c != table["c0"].to_numpy(), table["i"][0] != table["j"][0]
    bits = table["bits"].chunk(0)
    starts, values = bits.offsets.to_numpy(), bits.values.to_numpy().view(U64)
    needed = (n * PERCENT + 99) // 100
    groups = {}
    for width in np.unique(np.diff(starts)):
        rows = np.flatnonzero(np.diff(starts) == width)
        whole = values[starts[rows][:, None] + np.arange(width)]
        groups[int(width)] = rows, whole, whole[:, : width // 2] ^ whole[:, width // 2 :]
    out = [np.zeros((0, 2), np.int64)]
    for width, (rows, whole, folded) in groups.items():
        for k in np.flatnonzero(stray[rows]):
            i = rows[k]
            for other, own in ((width // 2, folded[k]), (width, whole[k]), (2 * width, whole[k])):
                if other not in groups:
                    continue
                others = groups[other][0]
                lo, hi = np.searchsorted(n[others], [(n[i] * PERCENT + 99) // 100, n[i] * 100 // PERCENT + 1])
                some, size = others[lo:hi], n[i] + n[others[lo:hi]]
                differing = np.bitwise_count(groups[other][2 if other > width else 1][lo:hi] ^ own).sum(axis=1, dtype=np.int64)
                overlap = np.minimum(upper[i] - needed[i], upper[some] - needed[some]) + np.maximum(needed[i], needed[some])
                ok = ((size - differing) * (100 + PERCENT) >= 2 * PERCENT * size) & (overlap * (100 + PERCENT) >= size * PERCENT)
                ok &= (c[some] != c[i]) & (~stray[some] | (node[some] > node[i]))
                if across:
                    ok &= cell[some] != cell[i]
                b = node[some[ok]]
                out.append(np.stack([np.minimum(b, node[i]), np.maximum(b, node[i])], axis=1))
    pairs = np.concatenate(out)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _near_in_large(label: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct pairs (a < b), one a stray, among the nodes of keys with the same smallest node; their number is not bounded, a tile is."""
    own = staged(label.select("lo", "node", "c", "c0", "n", "upper").distinct(), "large-keys")
    parts = own.groupBy("lo").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    cells = own.join(parts, "lo").withColumn("cell", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    bits = likely_in(nodes.select("node", "bits"), own, "node")
    met = cells.join(bits, "node").withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("lo", F.least("cell", "_other").alias("i"), F.greatest("cell", "_other").alias("j"), "cell", "node", "c", "c0", "n", "upper", "bits")
    return met.groupBy("lo", "i", "j").applyInArrow(_near_in_tile, "a long, b long").distinct()


def _live_keys(index: DataFrame) -> DataFrame:
    """(k, node, lo, hi, m, rare) of the keys of ``index`` with m > 1 nodes, by one shuffle.

    Keys with the same nodes get one new name ``k``, as a passage has many keys and each would
    pair the same nodes again. Should two lists of nodes get the same name, they are one key
    of both, which only adds pairs to compare.
    """
    own = Window.partitionBy("k")
    all_ = F.bit_xor(F.xxhash64("node")).over(own)
    listed = index.select("k", "node", F.min("node").over(own).alias("lo"), F.max("node").over(own).alias("hi"), F.count("*").over(own).alias("m"), all_.alias("_all"))
    return listed.filter("lo < hi").select(F.xxhash64("lo", "hi", "m", "_all").alias("k"), "node", "lo", "hi", "m", (F.col("k") % 2 == 0).alias("rare"))


def _strays(postings: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings of the keys whose nodes are in several components, and those of them outside the component of ``lo``."""
    label = postings.join(known, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    label = label.join(known.select(F.col("node").alias("lo"), F.col("component").alias("_l")), "lo", "left").withColumn("c0", F.coalesce("_l", "lo")).drop("_l")
    label = staged(label, "labelled-postings")
    mixed = label.groupBy("k").agg(F.min("c").alias("_a"), F.max("c").alias("_b")).filter("_a <> _b").select("k")
    label = staged(label.join(mixed, "k", "left_semi"), "mixed-postings")
    return label, label.filter("c <> c0")


def _verified(pairs: DataFrame, nodes: DataFrame, base: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    own = staged(nodes.select("node", F.col("key").alias("_key"), "digest").join(_nodes_of(pairs), "node", "left_semi"), "live-nodes")
    with small_batches(base.sparkSession):
        sets = staged(likely_in(base, own, "_key").join(own, "_key").mapInArrow(_set_rows, "node long, tokens array<long>"), "live-sets")
    joined = _with_both(pairs, sets, ["tokens"]).withColumn("_both", F.size(F.array_intersect("tokens_a", "tokens_b")))
    near = F.col("_both") * 100 >= (F.size("tokens_a") + F.size("tokens_b") - F.col("_both")) * PERCENT
    return staged(joined.filter(near).select("a", "b").distinct(), "links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, class_id, n_links and _key.

    ``class_id`` names the documents with the same set, ``n_links`` counts the verified
    links of that class to others that were needed to find the component. Null and
    empty texts have no shingles, are linked with nothing and are their own component. Null
    ids take part, but are never the smallest unless all ids of a component are null. Rows
    that repeat an id and text are linked with each other. An empty table gives an empty
    result; further columns are ignored.
    """
    base = docs.select("doc_id", text_of().alias("text"), row_key().alias("_key"))
    with small_batches(base.sparkSession):
        survey = staged(base.mapInArrow(_survey, "doc_id long, key long, n long, digest binary, chunk int, counters binary"), "shingle-survey")
    rows = survey.filter("n IS NOT NULL").select("doc_id", "key", "n", "digest")
    counters = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in survey.filter("chunk IS NOT NULL").select("chunk", "counters").repartition("chunk").mapInArrow(_add_counters, "chunk int, counters binary").collect():  # fixed size
        counters[r["chunk"] * _CHUNK : (r["chunk"] + 1) * _CHUNK] = np.frombuffer(r["counters"], np.int64)
    classes = frequency_classes(counters)

    keyed = base.mapInArrow(_index_rows(classes), "key long, digest binary, n long, keys array<long>, bits array<long>").filter("digest IS NOT NULL")
    nodes = keyed.groupBy("digest").agg(F.min("key").alias("key"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("bits").alias("bits"))
    with small_batches(base.sparkSession):
        nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "shingle-nodes")
    live = staged(_live_keys(nodes.select(F.explode("keys").alias("k"), "node")), "live-keys")
    counts = live.groupBy("node").agg(F.sum(F.col("rare").cast("long")).alias("_live"))
    rare = F.size(F.filter("keys", lambda k: k % 2 == 0))
    facts = staged(nodes.select("node", "n", rare.alias("_rare")).join(counts, "node").select("node", "n", (F.col("n") - F.col("_rare") + F.col("_live")).alias("upper")), "live-facts")
    postings = staged(live.filter("m > 2").join(facts, "node").select("k", "node", "n", "upper", "lo", "hi", "m").distinct(), "postings")

    first = live.filter("node = lo").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    for end in ("lo", "hi"):
        first = first.unionByName(postings.select(F.col("node").alias("a"), F.col(end).alias("b")))
    first = _possible(first, nodes, facts)
    links = _verified(first, nodes, base)
    known = components(links)
    for turn in range(PIVOT_ROUNDS):  # members of large groups that neither end is similar to
        label, stray = _strays(postings, known)
        pivot = label.groupBy("k").agg(F.min_by("node", F.xxhash64(F.lit(turn), "k", "node")).alias("_p"))
        tries = stray.select("k", "node").join(pivot, "k")
        drawn = tries.groupBy("node").agg(*[F.min_by("_p", F.xxhash64(F.lit(turn * PIVOTS + i), "k")).alias(f"_p{i}") for i in range(PIVOTS)])
        drawn = drawn.select(F.col("node").alias("a"), F.explode(F.array_distinct(F.array(*[f"_p{i}" for i in range(PIVOTS)]))).alias("b"))
        drawn = staged(_possible(drawn, nodes, facts).join(first, ["a", "b"], "left_anti"), "drawn-pairs")
        first = first.unionByName(drawn)
        linked = _verified(drawn, nodes, base)
        links = staged(links.unionByName(linked), "links-so-far")
        known = components(linked, known=known)
    label, stray = _strays(postings, known)
    small = F.col("m") <= LARGE
    one = stray.filter(small).select("k", F.col("node").alias("a"), F.col("c").alias("ca"), F.col("n").alias("_na"), F.col("upper").alias("_la"))
    rest = label.filter(small).select("k", F.col("node").alias("b"), F.col("c").alias("cb"), "c0", F.col("n").alias("_nb"), F.col("upper").alias("_lb"))
    cross = one.join(rest, "k").filter("ca <> cb AND (cb = c0 OR a < b)").filter(_may_link((F.col("_na"), F.col("_la")), (F.col("_nb"), F.col("_lb")))).select("a", "b")
    cross = _possible(cross, nodes, facts).unionByName(_near_in_large(label.filter(~small), nodes)).distinct()
    cross = staged(cross.join(first, ["a", "b"], "left_anti"), "cross-pairs")
    crossed = _verified(cross, nodes, base)
    more = staged(links.unionByName(crossed), "all-links")
    found = components(crossed, known=known)

    degree = more.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    named = nodes.select("node", "digest", "rows").join(found, "node", "left").join(degree, "node", "left")
    classed = staged(named.select("digest", "rows", F.col("node").alias("class_id"), F.coalesce("component", "node").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    linked = staged(join_counted(rows.filter("digest IS NOT NULL"), classed, "digest", "rows", "inner"), "linked-rows")
    smallest = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("_rows"))
    out = join_counted(linked, staged(smallest, "components"), "component", "_rows", "inner")
    cols = ["doc_id", F.col("n").alias("n_shingles"), "component_id", "component", "class_id", "n_links", F.col("key").alias("_key")]
    lone = rows.filter("digest IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("_key"))
    return out.select(*cols).unionByName(lone)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest doc_id, then row key."""

    def keys() -> DataFrame:
        found = staged_alone(lambda: near_duplicates(docs), "near-duplicates")
        best = found.filter("component IS NOT NULL").groupBy("component").agg(F.min_by("_key", F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("_key"))
        kept = best.select("_key").unionByName(found.filter("component IS NULL").select("_key").distinct())
        copies = found.groupBy("_key").agg(F.count("*").alias("_copies"))
        return copies.join(kept.withColumn("_kept", F.lit(True)), "_key", "left").fillna(False, "_kept")

    return keep_rows(docs, staged_alone(keys, "keys"))
