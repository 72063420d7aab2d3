"""Exact dedup, n-gram join and passage removal against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest

from annalis.llm import exact_dedup, ngram_join, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus():
    rng = random.Random(7)
    base, passage = [sentence(rng, rng.randrange(60, 160)) for _ in range(25)], sentence(rng, 70)
    rows = [(k, " ".join(w)) for k, w in enumerate(base)]
    for k in range(25, 60):  # near copies with few edits, chains of them, and a passage that many share
        words = list(rows[rng.randrange(len(rows))][1].split())
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        if k % 5 == 0:
            words[10:10] = passage
        rows.append((k, " ".join(words)))
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "one two"), (104, "One  two"), (105, "one two"), (106, "same " * 130), (107, "same " * 90), (108, "long " + " ".join(sentence(rng, 6000))), (30, rows[30][1])]
    return rows


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i, len(sets[k]), low[find(k)]) for k, (i, _) in enumerate(rows))


def cut(rows):
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    low = {}
    for i, w in split:
        for s in range(len(w) - 49):
            key = tuple(w[s : s + 50])
            low[key] = min(low.get(key, i), i)
    out = []
    for i, w in split:
        gone = {x for s in range(len(w) - 49) if low[tuple(w[s : s + 50])] < i for x in range(s, s + 50)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_exact_dedup(make):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (None, "a"), (5, "b"), (5, "b"), (6, "x" * 100_000)]
    for keep, stays in (("largest", {"a": 2, "": 4, "b": 5, "x" * 100_000: 6}), ("smallest", {"a": 1, "": 3, "b": 5, "x" * 100_000: 6})):
        found = exact_dedup.exact_dedup(make(rows), keep, width=8).collect()
        digest = {hashlib.sha256(t.encode()).hexdigest(): (k, t) for t, k in stays.items()}
        assert len(found) == len(rows) and sum(r.kept for r in found) == len(stays)
        for r in found:
            keep_id, text = digest[r.text_sha256]
            assert r.keep_id == keep_id and r.group_size == sum((t or "") == text for _, t in rows)
            assert not r.kept or r.doc_id == r.keep_id
    kept = exact_dedup.drop_copies(make(rows))
    assert kept.columns == make(rows).columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6]
    assert exact_dedup.exact_dedup(make(rows).limit(0)).count() == 0


def test_merged_runs_cross_batches(spark, make):
    rows = [(k, f"t{k % 7}") for k in range(500)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        found = exact_dedup.exact_dedup(make(rows), "largest", width=16).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.keep_id, r.group_size) for r in found} == {(max(range(k, 500, 7)), len(range(k, 500, 7))) for k in range(7)}


def test_near_duplicates(make):
    rows = corpus()
    found = ngram_join.near_duplicates(make(rows))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == components(rows)
    kept = [r.doc_id for r in ngram_join.drop_near_copies(make(rows)).collect()]
    assert sorted(kept) == sorted({c for _, n, c in components(rows) if n} | {100, 101, 102})


def test_near_duplicates_with_frequent_tokens(make, monkeypatch):
    """Everything frequent: only pairs of tokens are indexed, and the links are the same."""
    monkeypatch.setattr(ngram_join, "frequency_classes", lambda counters: (counters > 1).astype(np.uint8))
    rows = corpus()
    found = ngram_join.near_duplicates(make(rows))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == components(rows)


def family(size=120):
    """Variants of one text at similarities around 0.80, with a group of close ones, and other texts."""
    rng = random.Random(3)
    text, rows = sentence(rng, 150), []
    for k in range(size):
        words = list(text)
        for _ in range(rng.randrange(0, 3) if k % 3 == 0 else rng.randrange(3, 12)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        rows.append((k, " ".join(words[rng.randrange(8):])))
    return rows + [(1000 + k, " ".join(sentence(rng, 100))) for k in range(40)]


def test_large_groups_make_no_row_per_pair(make, monkeypatch):
    """Strays of a key with many nodes are compared in tiles; only the pairs that pass become rows, and no component is lost."""
    counts, plainly = {}, ngram_join.staged

    def counted(df, label):
        out = plainly(df, label)
        counts.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "staged", counted)
    monkeypatch.setattr(ngram_join, "frequency_classes", lambda counters: (counters > 20).astype(np.uint8))
    monkeypatch.setattr(ngram_join, "PIVOT_ROUNDS", 0)
    rows = family()
    found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(make(rows)).collect())
    assert found == components(rows) and 40 < len({c for _, _, c in found}) < 150
    assert counts["large-keys"][0] > 100 and counts["pairs"][1] < 1500
    monkeypatch.setattr(ngram_join, "LARGE", 2)
    monkeypatch.setattr(ngram_join, "TILE", 16)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(make(rows)).collect()) == found


def test_keys_with_the_same_nodes_are_one(make, monkeypatch):
    """A passage of many tokens pairs the documents that have it once, not once for each token."""
    counts, plainly = {}, ngram_join.staged

    def counted(df, label):
        out = plainly(df, label)
        counts.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "staged", counted)
    rng = random.Random(5)
    text = sentence(rng, 300, 10**6)
    rows = [(k, " ".join([*text, f"e{k}"])) for k in range(6)] + [(10 + k, " ".join(sentence(rng, 100, 10**6))) for k in range(5)]
    found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(make(rows)).collect())
    assert found == components(rows) and len({c for _, _, c in found}) == 6
    assert counts["live-keys"][0] > 200 and counts["postings"] == [6]


def test_whole_texts_reach_python_in_small_batches(spark, make, monkeypatch):
    from annalis import session

    import pyarrow as pa

    setting, seen, plainly = "spark.sql.execution.arrow.maxBytesPerBatch", {}, ngram_join.staged
    before = spark.conf.get(setting)
    monkeypatch.setattr(ngram_join, "staged", lambda df, label: seen.setdefault(label, spark.conf.get(setting)) and plainly(df, label))
    ngram_join.near_duplicates(make(corpus())).collect()
    assert {seen[x] for x in ("shingle-survey", "shingle-nodes", "live-sets")} == {str(session.BATCH_BYTES)}
    assert {seen[x] for x in ("live-keys", "links")} == {before} and spark.conf.get(setting) == before

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], ["n"])

    monkeypatch.setattr(session, "BATCH_BYTES", 100_000)
    with session.small_batches(spark):
        found = [r.n for r in make([(k, "x" * 10_000) for k in range(200)]).mapInArrow(sizes, "n long").collect()]
    assert max(found) < 150_000 and sum(found) > 2_000_000


def test_tiles_lose_no_similar_pair():
    import pyarrow as pa

    rng = np.random.default_rng(9)
    base, sets = rng.integers(0, 1 << 63, 140, dtype=np.uint64), []
    for k in range(150):
        kept = base[: rng.integers(24, 140)] if k % 2 else base[rng.random(140) > rng.random() * 0.3]
        sets.append(np.unique(np.append(kept, rng.integers(0, 1 << 63, rng.integers(0, 12), dtype=np.uint64))))
    c, cell = rng.integers(0, 60, 150), rng.integers(0, 2, 150)
    n = np.array([len(x) for x in sets])
    for i, j in ((0, 0), (0, 1)):
        some = [k for k in range(150) if cell[k] in (i, j)]
        table = pa.table({"i": [i] * len(some), "j": [j] * len(some), "cell": cell[some], "node": np.array(some), "c": c[some], "c0": [7] * len(some), "n": n[some], "upper": n[some],
                          "bits": pa.array([ngram_join.parity_bits(sets[k]).view(np.int64) for k in some], pa.list_(pa.int64()))})
        found = [tuple(r.values()) for r in ngram_join._near_in_tile(table).to_pylist()]
        may = [(a, b) for a in some for b in some if a < b and c[a] != c[b] and (c[a] != 7 or c[b] != 7) and (i == j or cell[a] != cell[b])]
        near = {(a, b) for a, b in may if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
        assert near <= set(found) <= set(may) and len(found) == len(set(found)) and len(near) > 20
        assert len(found) < len(may) / 2


def test_rows_that_surely_stay_are_not_joined(spark, make, monkeypatch):
    """Only rows in a bucket with a key that goes or has copies are joined, and the rows are the same with a single bucket."""
    from annalis.llm import common

    rows = [(k, f"text {k}") for k in range(300)] + [(400, "text 7"), (9, "text 9"), (None, "text 11"), (None, None), (500, "")]
    for buckets in (common.FILTER_BUCKETS, 1):
        monkeypatch.setattr(common, "FILTER_BUCKETS", buckets)
        got = sorted((r.doc_id is None, r.doc_id, r.text or "") for r in exact_dedup.drop_copies(make(rows)).collect())
        assert got == sorted([(False, k, f"text {k}") for k in range(300)] + [(False, 500, "")])
    monkeypatch.undo()
    docs, seen = make(rows), []
    plainly = common.likely_in
    monkeypatch.setattr(common, "likely_in", lambda *x: seen.append(out := plainly(*x)) or out)
    exact_dedup.drop_copies(docs).collect()
    assert [df.count() for df in seen] == [5, 300]


def truncated():
    """Texts and copies of them without their last or first words, at similarities from just below 0.80 to 0.86."""
    rng = random.Random(11)
    rows = []
    for k in range(60):
        words = sentence(rng, rng.randrange(80, 400), 10**6)
        n = len(words) - 4
        kept = -(-n * (79 + k % 8) // 100) + 4
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:kept] if k % 2 else words[-kept:]))]
    return rows


def test_truncated_copies_leave_the_near_copies_stage(spark, make):
    import corpus_pipeline

    rows = truncated()
    kept = corpus_pipeline.near_copies(spark, make(rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in components(rows)})


def test_truncated_copies_are_linked(make):
    rows = truncated()
    want = components(rows)
    assert 40 < len(rows) - len({c for _, _, c in want}) < 60
    found = ngram_join.near_duplicates(make(rows))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == want


@pytest.mark.parametrize("size", [5, 6, 9, 30, 200])
def test_similar_sets_share_a_key(size):
    """The prefix guarantee, with mixed, all rare and all frequent tokens."""
    rng = np.random.default_rng(size)
    for trial in range(60):
        classes = (rng.random(1 << ngram_join.SKETCH_BITS) < (0.0, 0.5, 1.0)[trial % 3]).astype(np.uint8)
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        b = a[rng.random(len(a)) < 0.95]
        b = np.unique(np.append(b, rng.integers(0, 1 << 63, max(1, size // 12)).astype(np.uint64)))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            assert len(np.intersect1d(ngram_join.index_keys(a, classes), ngram_join.index_keys(b, classes)))


def test_no_rows(make):
    empty = make([(1, "a")]).limit(0)
    assert ngram_join.near_duplicates(empty).count() == 0 and substring.digests(empty).count() == 0
    assert ngram_join.near_duplicates(make([(None, "a b c d e f"), (None, None)])).count() == 2


def test_substring(make):
    rows = corpus()
    found = substring.digests(make(rows)).collect()
    assert sorted(tuple(r) for r in found) == cut(rows)


def test_equal_windows_have_equal_owners():
    rng = np.random.default_rng(3)
    for vocabulary in (1, 2, 5, 1000):
        words = rng.integers(0, vocabulary, 90).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for _ in range(20):
            left, right = (rng.integers(0, vocabulary, rng.integers(0, 40)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in "ab")
            other = np.concatenate([left, words, right])
            own, there = substring.owners(words), substring.owners(other)[len(left) : len(left) + 41] - len(left)
            assert (own == there).all()


def test_many_holders_are_split(make, monkeypatch):
    monkeypatch.setattr(substring, "HOLDERS", 2)
    rng = random.Random(1)
    passage = sentence(rng, 60)
    rows = [(k, " ".join(sentence(rng, 15) + passage + sentence(rng, 15))) for k in range(40)]
    assert sorted(tuple(r) for r in substring.digests(make(rows)).collect()) == cut(rows)


def test_parity_bitmaps_bound_the_difference_of_sets(spark):
    rng = np.random.default_rng(5)
    rows, sizes = [], [1, 2, 31, 32, 33, 40, 64, 80, 127, 128, 129, 160, 500, 620, 6000]
    for n in sizes:
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for kept in (0, n // 2, n - n // 10, n):
            for m in (n, min(n + n // 4, kept + n)):
                b = np.unique(np.append(a[:kept], rng.integers(0, 1 << 63, m - kept, dtype=np.uint64)))
                if 100 * min(len(a), len(b)) >= 80 * max(len(a), len(b)):
                    rows.append((len(np.setxor1d(a, b)), *(ngram_join.parity_bits(x).view(np.int64).tolist() for x in (a, b))))
    df = spark.createDataFrame(rows, "real long, a array<long>, b array<long>")
    for x, y in (("a", "b"), ("b", "a")):
        found = df.select("real", ngram_join._differing(df[x], df[y]).alias("bits")).collect()
        assert all(r.bits <= r.real and (r.real - r.bits) % 2 == 0 for r in found)
        assert sum(r.bits for r in found) > 0.6 * sum(r.real for r in found)


def test_components_go_on_from_known_ones_and_write_no_round_too_many(spark, monkeypatch):
    from annalis.llm import graph

    labels = []
    monkeypatch.setattr(graph, "staged", lambda df, label, f=graph.staged: labels.append(label) or f(df, label))
    of = lambda df: sorted(map(tuple, df.collect()))
    links = lambda rows: spark.createDataFrame(rows, "a long, b long")
    stars = graph.components(links([(1, 5), (7, 1), (2, 9)]))
    assert of(stars) == [(1, 1), (2, 2), (5, 1), (7, 1), (9, 2)] and len(labels) == 1
    assert of(graph.components(links([]), known=stars)) == of(stars) and len(labels) == 2
    assert of(graph.components(links([(9, 5), (20, 21)]), known=stars)) == [(k, 1) for k in (1, 2, 5, 7, 9)] + [(20, 20), (21, 20)]
    assert of(graph.components(links([(k, k + 1) for k in range(40)]))) == [(k, 0) for k in range(41)]
    assert of(graph.components(links([]))) == []
