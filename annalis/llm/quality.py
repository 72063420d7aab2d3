"""Quality rules by distribution divergence.

Two histograms of a text are compared with references of its language by Jensen-Shannon
distance (base 2, 0 to 1): classes of characters, and common words with one bin for all
other words. References are the mean histograms of all documents of the language;
languages with under one row in RARE_LANGUAGE use the mean over all documents. Short texts have noisy
histograms: below MIN_CHARS or MIN_WORDS the comparison is skipped and the text passes it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalis.llm.common import WordHashes, rolling, text_of, texts
from annalis.session import staged

#: Common words of the languages: fixed values.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he i this are or his from at which but have an had they you were".split(),
    "fr": "de la le et les des en un une du est que dans qui pour par au sur pas avec ne se ce il plus son sa aux ou ont".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si".split(),
}
WORDS = sorted({w for words in COMMON.values() for w in words})
CLASSES = ("lower", "upper", "digit", "space", "punctuation", "symbol", "accented")
SYMBOLS = b"#*$%&|<>"
MIN_CHARS, MIN_WORDS = 200, 120
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.30, 0.30
RARE_LANGUAGE = 100
BASE_WORDS, BASE_REPEATED = 50, 50


def _byte_classes() -> np.ndarray:
    """Class of each byte; bytes inside a character are class 7 and not counted."""
    out = np.full(256, 5, np.uint8)
    out[ord("a") : ord("z") + 1], out[ord("A") : ord("Z") + 1], out[ord("0") : ord("9") + 1] = 0, 1, 2
    out[list(b" \t\n\r\x0b\x0c")] = 3
    out[list(b".,;:!?'\"()-")] = 4
    out[0xC0:], out[0x80:0xC0] = 6, 7
    return out


def _features(batches):
    hashes, classes = WordHashes(), _byte_classes()
    known = hashes.of([w.encode() for w in WORDS])
    order = np.argsort(known)
    known = known[order]
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for batch in batches:
        numbers, chars, common = [[] for _ in names], [], []
        for text in texts(batch["text"]):
            raw = np.frombuffer(text, np.uint8)
            counts = np.bincount(classes[raw], minlength=8)
            words = hashes.of(text.split())
            lines = [x for x in text.split(b"\n") if x.strip()]
            triples = rolling(words, 3)
            repeated = 0
            if len(triples):
                _, at, times = np.unique(triples, return_inverse=True, return_counts=True)
                again = times[at] > 1
                covered = np.zeros(len(words), bool)
                for k in range(3):
                    covered[k : k + len(again)] |= again
                repeated = int(covered.sum())
            for col, value in zip(numbers, (len(words), int(counts[:7].sum() - counts[3]), int(symbol[raw].sum()), len(lines) - len(set(lines)), repeated), strict=True):
                col.append(value)
            pos = np.minimum(np.searchsorted(known, words), len(known) - 1)
            hit = known[pos] == words
            found = np.bincount(order[pos[hit]], minlength=len(known))
            chars.append(counts[:7])
            common.append(np.append(found, len(words) - hit.sum()))
        kind = pa.list_(pa.int64())
        yield pa.record_batch([batch["doc_id"], batch["lang"], *(pa.array(c, pa.int64()) for c in numbers), pa.array(chars, kind), pa.array(common, kind)], ["doc_id", "lang", *names, "chars", "common"])


def _shares(column) -> np.ndarray:
    """Histograms of a batch as shares; empty ones are all zero."""
    counts = np.array(column.flatten().to_numpy(), np.float64).reshape(len(column), -1)
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of the rows of two tables of shares."""
    m = (p + q) / 2
    part = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0.0)
    return np.sqrt(np.maximum((part(p) + part(q)).sum(axis=1) / 2, 0.0))


def _partial_means(batches):
    """Sums of the shares of the documents with words, per language and task."""
    sums: dict[str | None, np.ndarray] = {}
    for batch in batches:
        if batch.num_rows == 0:
            continue
        shares = np.hstack([_shares(batch["chars"]), _shares(batch["common"])])
        some, langs = batch["n_words"].to_numpy() > 0, np.array(batch["lang"].to_pylist(), object)
        for lang in set(langs[some].tolist()):
            own = shares[some & (langs == lang)] if lang is not None else shares[some & np.array([x is None for x in langs])]
            sums[lang] = sums.get(lang, 0) + np.append(own.sum(axis=0), len(own))
    width = len(CLASSES) + len(WORDS) + 2
    flat = np.concatenate(list(sums.values())) if sums else np.zeros(0)
    yield pa.record_batch([pa.array(np.repeat(list(sums), width).tolist() if sums else [], pa.string()), pa.array(np.tile(np.arange(width), len(sums))), pa.array(flat)], ["lang", "bin", "value"])


def references(rows: DataFrame) -> dict[str, np.ndarray]:
    """Mean shares of each frequent language, and of all documents under "*": RARE_LANGUAGE + 1 at most."""
    last = len(CLASSES) + len(WORDS) + 1
    sums = staged(rows.select("lang", "n_words", "chars", "common").mapInArrow(_partial_means, "lang string, bin long, value double").groupBy("lang", "bin").agg(F.round(F.sum("value"), 6).alias("value")), "quality-sums")
    total = sums.groupBy("bin").agg(F.round(F.sum("value"), 6).alias("value")).withColumn("lang", F.lit("*"))
    n = total.filter(F.col("bin") == last).select("value").first()
    often = sums.filter((F.col("bin") == last) & F.col("lang").isNotNull() & (F.col("value") * RARE_LANGUAGE >= (n["value"] if n else 0))).select("lang")
    found: dict[str, np.ndarray] = {}
    for r in sums.join(F.broadcast(often), "lang", "left_semi").unionByName(total.select("lang", "bin", "value")).collect():
        found.setdefault(r["lang"], np.zeros(last + 1))[r["bin"]] = r["value"]
    return {lang: np.round(v[:last] / max(v[last], 1), 9) for lang, v in found.items()}


def _distances(refs: dict[str, np.ndarray]):
    # without a word in the table all shares count as equal; no distance is judged then
    others = refs.get("*", np.concatenate([np.full(k, 1 / k) for k in (len(CLASSES), len(WORDS) + 1)]))

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            expected = np.array([refs.get(lang, others) for lang in batch["lang"].to_pylist()])
            chars, common = _shares(batch["chars"]), _shares(batch["common"])
            enough = [np.array(batch["chars"].flatten().to_numpy()).reshape(batch.num_rows, -1).sum(axis=1) >= MIN_CHARS, batch["n_words"].to_numpy() >= MIN_WORDS]
            found = [np.round(distance(chars, expected[:, : len(CLASSES)]), 6), np.round(distance(common, expected[:, len(CLASSES) :]), 6)]
            names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            yield pa.record_batch([*(batch[c] for c in names), *(pa.array(d, mask=~e) for d, e in zip(found, enough, strict=True))], [*names, "char_distance", "word_distance"])

    return run


def judge(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): the counts of the base rules, both distances, base_failed and kept.

    Null texts count as empty and fail the base rules. Documents with a null or rare
    language are compared with all documents. A distance is null where its guard skips it.
    Repeated rows get equal results; an empty table an empty result; further columns are ignored.
    """
    schema = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars array<long>, common array<long>"
    rows = staged(docs.select("doc_id", "lang", text_of().alias("text")).mapInArrow(_features, schema), "quality-features")
    counts = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    out = rows.mapInArrow(_distances(references(rows)), counts + ", char_distance double, word_distance double")
    failed = (F.col("n_words") < BASE_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * BASE_REPEATED)
    near = (F.coalesce("char_distance", F.lit(0.0)) <= MAX_CHAR_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE)
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & near)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")
