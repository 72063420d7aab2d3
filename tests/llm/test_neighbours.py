"""Nearest-neighbour votes: descriptions and votes against plain loops, held-out accuracy on the given tables."""

import zlib
from collections import Counter

import numpy as np
import pytest

from annalis.llm import neighbours

SF = "/root/testdata/sf0.01"


def test_counts_against_plain_loops(monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK_BYTES", 7)
    found = [b"Ab 1.\n|\xc3\xa9", b"", b"ab", b"aaaaaaaaaaaaaaaaaaaa", b"abc"]
    shapes, grams = neighbours.counts(found)
    for text, row, gram_row in zip(found, shapes, grams):
        classes = neighbours._CLASS[list(text)].tolist()
        want = Counter(64 * a + 8 * b + c for a, b, c in zip(classes, classes[1:], classes[2:]))
        assert {k: v for k, v in enumerate(row) if v} == want
        want = Counter(((a << 16) + (b << 8) + c) * 2654435761 % (1 << 32) >> (32 - neighbours.GRAM_BITS) for a, b, c in zip(text, text[1:], text[2:]))
        assert {k: v for k, v in enumerate(gram_row) if v} == want


def test_votes_against_plain_loops():
    rng = np.random.default_rng(3)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    voters = neighbours.Voters(None, None, unit(rng.normal(size=(60, 5))), rng.integers(0, 2, 60).astype(float))
    queries = np.vstack([unit(rng.normal(size=(40, 5))), np.zeros((1, 5))])
    for q, got in zip(queries, neighbours.vote(queries, voters)):
        best = sorted(((float(q @ v), y) for v, y in zip(voters.vectors, voters.labels)), reverse=True)[: neighbours.NEIGHBOURS]
        total = sum(max(c, 0) for c, _ in best)
        assert got == pytest.approx(sum(max(c, 0) * y for c, y in best) / total if total else voters.prior)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = {r.doc_id: r for r in neighbours.score(docs, neighbours.fit(docs, labels)).collect()}
    assert len(found) == docs.count()
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(found[r.doc_id].held_out for r in held)
    right = [found[r.doc_id].predicted == r.quality for r in held]
    ones = [found[r.doc_id].predicted for r in held if r.quality == 1]
    zeros = [found[r.doc_id].predicted for r in held if r.quality == 0]
    assert np.mean(right) >= 0.95 and np.mean(ones) >= 0.98 and np.mean(zeros) <= 0.3


def test_only_training_rows_and_texts_count(spark, make):
    good, bad = "A calm line of words, and more of them.", "BUY!! NOW!! $$$ BUY!! NOW!! $$$"
    rows = [(k, (good if k % 2 else bad) + f" {k}") for k in range(80)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(80)], "doc_id long, quality int, toxic int")
    turned = spark.createDataFrame([(k, 1 - k % 2 if zlib.crc32(str(k).encode()) % 5 == 0 else k % 2, 0) for k in range(80)], "doc_id long, quality int, toxic int")
    docs = make(rows)
    first = neighbours.score(docs, neighbours.fit(docs, labels)).sort("doc_id").collect()
    assert first == neighbours.score(docs, neighbours.fit(docs, turned)).sort("doc_id").collect()
    assert [r.predicted for r in first] == [k % 2 for k in range(80)]


def test_edge_cases(spark, make):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    docs = make([(1, "plain words here"), (2, "### $$$ ### $$$"), (3, None), (4, ""), (None, "plain words here"), (None, "plain words here"), (5, "ab"), (6, "x " * 700_000)])
    rows = neighbours.score(docs, neighbours.fit(docs, labels)).collect()
    assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows)
    assert sorted(r.doc_id or 0 for r in rows if r.held_out)[:2] == [0, 0]
    none = neighbours.fit(docs, labels.limit(0))
    assert {r.score for r in neighbours.score(docs, none).collect()} == {0.5}
    assert neighbours.score(docs.limit(0), neighbours.fit(docs.limit(0), labels)).collect() == []
