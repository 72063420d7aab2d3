"""Removal of repeated 50-word passages by recompression.

Every text is a sequence of word symbols. A round names runs or pairs of symbols:

* run round: two equal symbols that stand alone as a pair become one symbol; longer runs stay;
* pair round: symbols are left or right by one bit of their name; a left symbol and the
  right one behind it become one symbol.

Names are fingerprints of what they stand for, so that all tasks name equal runs and pairs
alike. A round decides from neighbours only, so that inside equal passages all symbols are
equal, except for some at either end: a run round looks at one symbol on both sides of a
border of two (2 words), the pair rounds at the two (2 and 4 words more). After the rounds
of ROUNDS a symbol covers at most WIDEST words, and the symbols of a passage agree from
MARGIN words after its start to MARGIN words before its end.

Of the symbols that start in the REACH words behind the margin of a window, the one with
the smallest name owns the window; equal windows have equal owners. An owner's key is the
hash of the CONTEXT words around its start that all of its windows hold. Keys that are in one
document only rule out all windows of that owner. The windows of shared keys are then hashed whole and compared; every
one that also starts in a document with a smaller id is removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalis.llm.common import HOT_KEYS, U64, WordHashes, likely_in, mix, rolling, row_key, text_of, texts
from annalis.session import staged

WINDOW = 50
ROUNDS = ("run", "pair", "pair")
MARGIN, WIDEST = 8, 8
REACH = (WINDOW - 2 * MARGIN) // 2
#: Words from MARGIN before the start of an owner on that are in every window it can own.
CONTEXT = WINDOW - REACH + 1
#: Holders of one key whose windows share a task in the comparison.
HOLDERS = 1024
LAST = (1 << 63) - 1

_RUN, _PAIR = U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)


def symbols(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the symbols of a sequence after all rounds, and the words at which they start."""
    names, starts = words, np.arange(len(words))
    for kind in ROUNDS:
        if len(names) < 2:
            break
        if kind == "run":
            same = names[1:] == names[:-1]
            head = np.zeros(len(names), bool)
            head[:-1] = same & ~np.append(False, same[:-1]) & ~np.append(same[1:], False)
            joined = mix(names * _RUN + U64(1))
        else:
            right = (mix(names ^ _PAIR) >> U64(63)).astype(bool)
            head = np.zeros(len(names), bool)
            head[:-1] = ~right[:-1] & right[1:]
            joined = mix(mix(names ^ _PAIR) + np.append(names[1:], U64(0)) * _RUN)
        keep = np.ones(len(names), bool)
        keep[1:] = ~head[:-1]
        names, starts = np.where(head, joined, names)[keep], starts[keep]
    return names, starts


def owners(words: np.ndarray) -> np.ndarray:
    """For each window, the word at which its owner starts."""
    names, starts = symbols(words)
    n = len(words) - WINDOW + 1
    top = np.iinfo(np.uint64).max
    score = np.full(len(words), top, U64)
    score[starts] = np.minimum(mix(names ^ _RUN), U64(top - 1))
    best, offset = score[MARGIN : MARGIN + n].copy(), np.zeros(n, np.int64)
    for d in range(1, REACH):
        other = score[MARGIN + d : MARGIN + d + n]
        less = other < best
        best[less], offset[less] = other[less], d
    return np.arange(MARGIN, MARGIN + n) + offset


def anchor_keys(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix(rolling(words, CONTEXT))[at - MARGIN]


_POWER = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def window_hashes(words: np.ndarray) -> np.ndarray:
    """A hash of the words of each window, from running sums."""
    n = len(words)
    up = np.cumprod(np.full(n, _POWER))
    down = np.cumprod(np.full(n, _INVERSE))
    total = np.append(U64(0), np.cumsum(mix(words) * up))
    return mix((total[WINDOW:] - total[:-WINDOW]) * down[: n - WINDOW + 1])


def _survey(batches):
    hashes = WordHashes()
    for batch in batches:
        out = [[], [], [], []]
        for text in texts(batch["text"]):
            split = text.split()
            words = hashes.of(split)
            keys = np.unique(anchor_keys(words, np.unique(owners(words)))) if len(words) >= WINDOW else np.zeros(0, U64)
            for col, value in zip(out, (len(split), xxhash.xxh3_128_digest(words.tobytes()), hashlib.sha256(b" ".join(split)).hexdigest(), keys.astype(np.int64)), strict=True):
                col.append(value)
        n, digest, sha, keys = out
        yield pa.record_batch([batch["doc_id"], batch["_key"], pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sha), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "key", "n", "digest", "sha", "keys"])


def _shared(batches):
    """Holders of keys that are in two ids or more, from rows sorted by key and id, with their place in the key's run."""
    key_now, low, held, n = None, None, [], 0  # the run that may go on: its rows so far are held until a second id comes
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ks, ids, keys = (batch[c].to_numpy() for c in ("k", "id", "key"))
        starts = np.flatnonzero(np.append(True, ks[1:] != ks[:-1]))
        ends = np.append(starts[1:], len(ks))
        several = ids[ends - 1] != ids[starts]
        take, rank = np.repeat(several, ends - starts), np.arange(len(ks)) - np.repeat(starts, ends - starts)
        before = []
        rows = lambda a, b: list(zip(ks[a:b].tolist(), ids[a:b].tolist(), keys[a:b].tolist(), rank[a:b].tolist(), strict=True))  # noqa: B023, E731
        goes_on = ks[0] == key_now
        if goes_on:
            e = ends[0]
            rank[:e] += n
            n += e
            if held is None or ids[e - 1] != low:
                before, held, take[:e] = held or [], None, True
            else:
                held += rows(0, e)
                take[:e] = False
        if not goes_on or len(starts) > 1:
            a = starts[-1]
            key_now, low, n = ks[a], ids[a], len(ks) - a
            held = None if several[-1] else rows(a, len(ks))
        cols = [np.concatenate([np.array([x[j] for x in before], np.int64), v[take]]) for j, v in enumerate((ks, ids, keys, rank))]
        yield pa.record_batch([pa.array(c) for c in cols], ["k", "id", "key", "rank"])


def _windows(batches):
    """The windows that the live keys of each text own: one row per owner with the hashes of its windows."""
    hashes = WordHashes()
    for batch in batches:
        cols, sizes, values = [[], [], [], [], []], [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]
        for text, key, ident, live, ranks in zip(texts(batch["text"]), batch["_key"].to_numpy(), batch["id"].to_numpy(), batch["live"].to_pylist(), batch["ranks"].to_pylist(), strict=True):
            words = hashes.of(text.split())
            at = owners(words)
            starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            lengths = np.diff(np.append(starts, len(at)))
            own = anchor_keys(words, at[starts]).astype(np.int64)
            order = np.argsort(np.array(live, np.int64))
            known, salts = np.array(live, np.int64)[order], np.array(ranks, np.int64)[order] // HOLDERS
            pos = np.minimum(np.searchsorted(known, own), len(known) - 1)
            found = known[pos] == own
            some = np.flatnonzero(found)
            for col, value in zip(cols, (own[some], salts[pos[some]], np.full(len(some), ident), np.full(len(some), key), starts[some]), strict=True):
                col.append(value)
            sizes.append(lengths[some])
            values.append(window_hashes(words)[np.repeat(found, lengths)].astype(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)), pa.int32()), pa.array(np.concatenate(values)))
        yield pa.record_batch([*(pa.array(np.concatenate(c).astype(np.int64)) if c else pa.array([], pa.int64()) for c in cols), lists], ["k", "salt", "id", "key", "s", "h"])


def _later(batches):
    """From rows sorted by (k, salt, id): bit j of ``late`` says that a smaller id of this run has window s + j.

    A run has HOLDERS texts at most. Hashes go on only while a window is the first of its run.
    """
    run, low = None, {}
    for batch in batches:
        if batch.num_rows == 0:
            continue
        late, hashes = [], []
        for k, salt, ident, own in zip(*(batch[c].to_pylist() for c in ("k", "salt", "id", "h")), strict=True):
            if run != (k, salt):
                run, low = (k, salt), {}
            bits = 0
            for j, h in enumerate(own):
                if low.setdefault(h, ident) < ident:
                    bits |= 1 << j
            late.append(bits)
            hashes.append(None if bits == (1 << len(own)) - 1 else own)
        yield pa.record_batch([batch["k"], batch["id"], batch["key"], batch["s"], pa.array(late, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], ["k", "id", "key", "s", "late", "h"])


def _spans(batches):
    """Removed word ranges of each text from its removed windows: bit j of ``late`` stands for the window at s + j."""
    for batch in batches:
        starts, ends = [], []
        for found in batch["at"].to_pylist():
            first, late = np.array([x["s"] for x in found], np.int64), np.array([x["late"] for x in found], np.int64)
            s = np.unique(np.concatenate([first[(late >> j) & 1 == 1] + j for j in range(REACH)]))
            cut = np.append(True, s[1:] > s[:-1] + WINDOW)
            starts.append(s[cut])
            ends.append(s[np.append(cut[1:], True)] + WINDOW)
        yield pa.record_batch([batch["key"], *(pa.array(x, pa.list_(pa.int64())) for x in (starts, ends))], ["key", "starts", "ends"])


def _kept(batches):
    for batch in batches:
        n, removed, kept = [], [], []
        for text, starts, ends in zip(texts(batch["text"]), batch["starts"].to_pylist(), batch["ends"].to_pylist(), strict=True):
            words = text.split()
            out, done = [], 0
            for a, b in zip(starts, ends, strict=True):
                out += words[done:a]
                done = b
            out += words[done:]
            n.append(len(words))
            removed.append(len(words) - len(out))
            kept.append(b" ".join(out).decode())
        yield pa.record_batch([batch["doc_id"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), batch["_key"]], ["doc_id", "n_words", "n_removed", "kept_text", "_key"])


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key, n, sha, whole) of all texts, and the removed word ranges (key, starts, ends).

    ``whole`` marks texts of which an equal one has a smaller id and that are removed as a
    whole; they have no ranges. Null ids count as the largest; rows with equal ids
    never remove words from each other. Texts under 50 words lose nothing.
    """
    base = docs.select("doc_id", text_of().alias("text"), row_key().alias("_key"), F.coalesce("doc_id", F.lit(LAST)).alias("id"))
    survey = staged(base.drop("id").mapInArrow(_survey, "doc_id long, key long, n long, digest binary, sha string, keys array<long>").withColumn("id", F.coalesce("doc_id", F.lit(LAST))), "passage-survey")
    equal = staged(survey.groupBy("digest").agg(F.min("id").alias("low"), F.count("*").alias("rows")).filter("rows > 1"), "equal-texts")
    copies = staged(survey.filter(f"n >= {WINDOW}").select("key", "digest", "id").join(F.broadcast(_hot(equal)), "digest", "left").select("key", "digest", "id", "low"), "hot-copies")
    cold = copies.filter("low IS NULL").drop("low").join(equal.select("digest", "low"), "digest")
    whole = staged(copies.filter("low IS NOT NULL").unionByName(cold).filter("id > low").select("key").distinct(), "whole-copies")

    index = survey.select(F.explode("keys").alias("k"), "id", "key").repartition("k").sortWithinPartitions("k", "id")
    shared = index.mapInArrow(_shared, "k long, id long, key long, rank long")
    live = shared.groupBy("key").agg(F.min("id").alias("id"), F.collect_list("k").alias("live"), F.collect_list("rank").alias("ranks"))
    live = staged(live.join(whole, "key", "left_anti"), "live-passages")
    narrowed = likely_in(base.select("_key", "text"), live.select(F.col("key").alias("_key")), "_key")
    windows = narrowed.join(live.withColumnRenamed("key", "_key"), "_key").mapInArrow(_windows, "k long, salt long, id long, key long, s long, h array<long>")
    judged = windows.repartition("k", "salt").sortWithinPartitions("k", "salt", "id").mapInArrow(_later, "k long, id long, key long, s long, late long, h array<long>")
    judged = staged(judged, "windows")
    sure = judged.filter("late <> 0").select("key", "s", "late")
    split = live.filter(F.exists("ranks", lambda r: r >= HOLDERS)).select(F.explode(F.arrays_zip("live", "ranks")).alias("x"))
    split = split.filter(F.col("x.ranks") >= HOLDERS).select(F.col("x.live").alias("k")).distinct()  # keys whose holders are in several runs
    some = likely_in(judged.filter("h IS NOT NULL"), split, "k").select("k", "id", "key", "s", "late", F.posexplode("h").alias("j", "h"))
    some = staged(some.filter("(late >> j) & 1 = 0").select("k", "h", "id", "key", (F.col("s") + F.col("j")).alias("s")), "split-windows")
    lows = some.groupBy("h", "k").agg(F.min("id").alias("low"))
    late = some.join(lows, ["h", "k"]).filter("id > low").select("key", "s", F.lit(1).cast("long").alias("late"))
    found = sure.unionByName(late).groupBy("key").agg(F.collect_list(F.struct("s", "late")).alias("at"))
    spans = found.mapInArrow(_spans, "key long, starts array<long>, ends array<long>")
    return survey.join(whole.withColumn("whole", F.lit(True)), "key", "left").select("doc_id", "key", "n", "sha", F.coalesce("whole", F.lit(False)).alias("whole")), staged(spans, "passage-spans")


def _hot(equal: DataFrame) -> DataFrame:
    total = equal.agg(F.sum("rows")).first()[0] or 0
    return equal.filter(F.col("rows") * HOT_KEYS >= total).select("digest", "low").limit(HOT_KEYS)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` that loses some but not all words: doc_id, n_words, n_removed, kept_text, _key."""
    _, spans = repeated_spans(docs)
    return _cut(docs, spans)


def _cut(docs: DataFrame, spans: DataFrame) -> DataFrame:
    own = docs.select("doc_id", text_of().alias("text"), row_key().alias("_key"))
    spans = spans.withColumnRenamed("key", "_key")
    joined = likely_in(own, spans, "_key").join(spans, "_key")
    return joined.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_text string, _key long")


def digests(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256. Null texts count as empty."""
    rows, spans = repeated_spans(docs)
    cut = _cut(docs, spans).select("_key", "n_removed", F.sha2("kept_text", 256).alias("cut_sha")).dropDuplicates(["_key"])
    out = rows.join(staged(cut, "cut-texts").withColumnRenamed("_key", "key"), "key", "left")
    removed = F.when(F.col("whole"), F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0)))
    sha = F.when(F.col("whole"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha", "sha"))
    return out.select("doc_id", F.col("n").alias("n_words"), removed.cast("long").alias("n_removed"), sha.alias("kept_sha256"))
