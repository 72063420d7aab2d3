"""Collocations against plain counting."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalis.llm import phrases


def plain(rows, least, top):
    count, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                for k in range(len(words) - size + 1):
                    count[lang][tuple(words[k : k + size])] += 1
    out = []
    for lang, f in count.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in found.items():
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if not any(100 * b >= 50 * a for q, b in found.items() if len(q) > len(p) and any(q[j : j + len(p)] == p for j in range(2))):
                rows_.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank + 1, p.decode(), -a, lo, r, n[lang], -s) for rank, (s, a, p, lo, r) in enumerate(sorted(rows_)[:top])]
    return sorted(out)


def rows_of(seed=1, texts=60):
    rng = np.random.default_rng(seed)
    words = ["The", "the", "river", "Éa", "über", "a|b", "x", "日本", "of", "o'f", "ÀB", "\x00", "\x85"]
    marks = [" ", " ", " ", " ", "\t", ". ", ",", "\n", "!? ", "  ", "\x0b", "\x1c"]
    draw = lambda n: "".join(words[min(int(rng.exponential(3)), 12)] + marks[rng.integers(12)] for _ in range(n))
    return [(draw(int(rng.integers(0, 200))), ["en", "fr", None][k % 3]) for k in range(texts)] + [(None, "en"), ("", None), ("  ..", "fr")]


@pytest.mark.parametrize("block", [1 << 23, 500])
def test_collocations(make, block):
    rows = rows_of()
    docs = make([(k, t, lang) for k, (t, lang) in enumerate(rows)])
    for least, top in ((10, 2000), (3, 7)):
        found = sorted(tuple(r) for r in phrases.collocations(docs, least, top, block).collect())
        assert found == plain(rows, least, top) and len(found) > 10


def test_collisions_change_nothing():
    """With fingerprints that all collide, the different n-grams of a block stay apart."""
    ids = np.array([0, 1, 2, 0, 1, -1, 1, 2, 0, 0, 1])
    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    p, pos, counts = phrases.distinct_grams(ids, np.zeros(10, np.uint64), at, 2)
    assert {(int(ids[k]), int(ids[k + 1])): int(c) for k, c in zip(pos, counts)} == {(0, 1): 3, (1, 2): 2, (2, 0): 2, (0, 0): 1}


def test_buckets_with_collisions():
    """Fingerprints with the same 32 bits are added up in a bucket; the texts behind their pointers tell them apart."""
    import pyarrow as pa

    pack = lambda *x: np.array(x, "<u4").tobytes()
    table = pa.table({"bucket": [0, 0], "block": [5, 6], "prints": [pack(7, 9), pack(7)], "at": [pack(0, 3), pack(1)], "counts": [pack(4, 4), pack(6)]})
    out = phrases._frequent(2, 10)(table).to_pylist()
    assert [(r["block"], r["at"], r["counts"]) for r in out[:2]] == [(5, pack(0), pack(4)), (6, pack(1), pack(6))]
    assert out[2]["block"] is None and out[2]["bits"] == [7]


def test_fingerprints_are_those_of_sql(spark):
    df = spark.createDataFrame([("en", "word"), ("", "été"), ("und", "a" * 100)], "lang string, word string")
    for r in df.select("lang", "word", F.xxhash64("lang", "word").alias("h")).collect():
        assert phrases.word_prints([r.word.encode()], r.lang).view(np.int64)[0] == r.h


def test_repeats_long_texts_and_empty_tables(make):
    rows = [("one two three. " * 30_000, "en"), ("one two", "en"), ("one two", "en"), ("w" * 100_000, None)]
    found = sorted(tuple(r) for r in phrases.collocations(make([(None, *r) for r in rows])).collect())
    assert found and found == plain(rows, 10, 2000)
    assert phrases.collocations(make([(1, "a b", "en")]).limit(0)).collect() == []


def test_blocks_are_read_a_few_at_a_time(make, monkeypatch):
    """Numbers of a block are one packed value, and a row group, which Spark reads at once, has few blocks."""
    import pyarrow.parquet as pq

    kept, plainly = {}, phrases.staged
    monkeypatch.setattr(phrases, "staged", lambda df, label, **options: kept.setdefault(label, plainly(df, label, **options)))
    rows = [("a b. c", "en")] * 90 + [("", "fr"), (None, "de")]
    assert phrases.frequent_phrases(make([(k, *r) for k, r in enumerate(rows)]).coalesce(1), block_bytes=40)[0].count() == 1
    blocks = kept["word-blocks"]
    assert dict(blocks.dtypes)["ids"] == dict(blocks.dtypes)["prints"] == "binary"
    groups = [pq.ParquetFile(f.removeprefix("file:").replace("///", "/")).metadata for f in blocks.inputFiles()]
    assert sum(g.num_rows for g in groups) > 10 and max(g.row_group(k).num_rows for g in groups for k in range(g.num_row_groups)) <= 4
    monkeypatch.undo()
    assert phrases.collocations(make([(1, "", "en"), (2, None, None)])).collect() == []
