"""Trigrams in slices of any size are those of the whole texts."""

import numpy as np
import pyarrow as pa
import pytest

from annalis.llm import langid


def whole(text):
    raw = text.encode()
    return [((a << 16 | b << 8 | c) * 2654435761 % (1 << 32)) >> 17 for a, b, c in zip(raw, raw[1:], raw[2:])]


@pytest.mark.parametrize("limit", [1, 2, 3, 7, 1 << 20])
def test_slices(limit):
    rows = ["", "a", "ab", "abc", "été là", "", "x" * 40, "the river " * 3, "zz"]
    for column in (pa.array(rows), pa.array(["other", *rows, "more"]).slice(1, len(rows)), pa.array([], pa.string())):
        found = [[] for _ in column]
        for first, last, buckets, starts, ends in langid._grams(column, limit):
            assert len(buckets) <= limit
            for row, a, b in zip(range(first, last), starts, ends, strict=True):
                found[row] += buckets[a:b].tolist()
        assert found == [whole(t) for t in column.to_pylist()]


def test_scores_do_not_depend_on_slices(spark):
    rng = np.random.default_rng(2)
    model = langid.GramModel(("en", "fr"), rng.normal(size=(langid.BUCKETS, 2)).astype(np.float32))
    texts = ["one two three", "", "deux trois quatre " * 70_000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for r in langid.text_scores(df, model, ["k"], df["t"]).collect():
        raw = whole(df.where(df["k"] == r.k).select(langid.letters(df["t"])).first()[0])
        want = [sum(float(model.logs[b, k]) for b in raw) for k in range(2)] + [len(raw) * langid.FLAT_LOG]
        assert r.n_grams == len(raw)
        assert r.scores == pytest.approx([w / (1 + len(raw) / langid.SATURATE) for w in want], rel=1e-9, abs=1e-9)
