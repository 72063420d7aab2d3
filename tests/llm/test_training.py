"""Packing, mixing and the pipeline."""

import subprocess
import sys
import zlib

import numpy as np
import pytest

from annalis.llm import mixing, packing

WEIGHTS = (5, 2, 1)


def check_packing(found, want):
    by_doc, by_seq = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes())
    for doc, ids in want.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids)
    padding = 0
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= packing.LENGTH
        padding += 0 if at & (at - 1) == 0 else packing.LENGTH - at
    return padding


ENDED_TASK = """
import gc, sys
from types import SimpleNamespace
import pyarrow as pa
from pyspark import TaskContext, cloudpickle

TaskContext.get = lambda: SimpleNamespace(partitionId=lambda: 0)
batch = pa.record_batch([pa.array([1, 2]), pa.array(["some words", None])], ["doc_id", "text"])
task = cloudpickle.loads(sys.stdin.buffer.read())
gc.disable()
rows = sum(b.num_rows for b in task(iter([batch])))
del task
print(rows, sum(type(x).__name__ == "WordTokens" for x in gc.get_objects()))
"""


def test_tokens_go_with_their_task():
    """A worker must not have the tokens of tasks that ended beside those of its next one."""
    import public_tokenizers
    from pyspark import cloudpickle

    task = cloudpickle.dumps(packing._pack(str(public_tokenizers.path("word_bpe_49k.json"))))
    ended = subprocess.run([sys.executable, "-c", ENDED_TASK], input=task, capture_output=True, check=True)
    assert ended.stdout.split() == [b"2", b"0"], ended.stderr


def test_known_words_stay_when_there_are_too_many(monkeypatch):
    import public_tokenizers

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    texts = [f"always the same and word{chr(97 + k) * 9} é{k}.".encode() for k in range(20)]
    want = [packing.WordTokens(path).ids([t])[0].tolist() for t in texts]
    monkeypatch.setattr(packing.WordTokens, "LIMIT", 16)
    tokens, asked = packing.WordTokens(path), []
    encode = tokens._encode
    tokens._encode = lambda parts: (asked.extend(parts), encode(parts))
    assert [tokens.ids([t])[0].tolist() for t in texts] == want
    assert asked.count(b"always") == 1 and len(tokens) <= 16


def test_packing(make):
    import public_tokenizers
    from tokenizers import Tokenizer

    words = ["The river, it's <|endoftext|> <|ENDOFTEXT|>", "ÉCOLE été ﬁ ½ don'T 'S", "foo...bar!! 12.5 ###", "日本語。"]
    rows = [(k, " ".join(words[(k + j) % 4] for j in range(k * 7 % 400))) for k in range(60)] + [(100, None), (101, ""), (102, "long words " * 9000)]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {k: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for k, t in rows}
    assert check_packing(packing.pack(make(rows)).collect(), want) == 0
    assert packing.pack(make(rows).limit(0)).count() == 0
    repeated = packing.pack(make([(None, "a b"), (None, "a b"), (1, None)])).collect()
    assert sum(r.length for r in repeated) == 3 + 3 + 1


def test_packer_keeps_few_windows(monkeypatch):
    monkeypatch.setattr(packing, "OPEN", 3)
    packer, rng, total = packing.Packer(), np.random.default_rng(1), 0
    for k in range(300):
        n = int(rng.integers(1, 5000))
        total += n
        for window in packer.add(packing.Piece(k, 0, np.zeros(n, np.uint16), n)):
            assert sum(len(p.ids) for p in window) == packing.LENGTH
            total -= packing.LENGTH
        assert len(packer.windows) <= 3
    whole, tail = packer.close()
    assert total == len(whole) * packing.LENGTH + sum(len(p.ids) for p in tail)


def levels(sizes, share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[k % 3] for k, s in enumerate(names)}
    target, free, rest = {}, set(names), share * sum(sizes.values())
    while free:
        unit = rest / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * unit >= most * sizes[s]}
        if not above:
            return target | {s: weight[s] * unit for s in free}
        for s in above:
            target[s] = most * sizes[s]
            rest -= target[s]
        free -= above
    return target


def test_mixing(make):
    rng = np.random.default_rng(8)
    sources = ["a", "a", "a", "b", "c", "é", None, "Z"]
    rows = [(k, "w " * int(rng.integers(0, 300)), "en", sources[k % 8]) for k in range(800)] + [(900, None, "en", "b"), (901, "", "en", "empty"), (902, "v " * 30_000, "en", "c"), (8, "x y", "en", "a"), (8, "x y", "en", "a")]
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = levels(sizes)
    found = mixing.taken_words(make(rows)).collect()
    assert len(found) == len(rows)
    source_of = {r[0]: r[3] for r in rows}
    taken = {}
    for r in found:
        source = source_of[r.doc_id]
        assert r.source_size == sizes[source] and r.target == pytest.approx(want[source]) and r.taken <= 2 * r.size
        taken[source] = taken.get(source, 0) + r.taken
    for source, target in want.items():
        assert abs(taken[source] - target) <= 6 * mixing.BLOCK
    again = mixing.taken_words(make(rows)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    assert mixing.taken_words(make(rows).limit(0)).count() == 0
    mixed = mixing.mixed_documents(make(rows))
    assert mixed.columns == make(rows).columns
    assert sum(len(r.text.split()) for r in mixed.collect()) == pytest.approx(sum(taken.values()), abs=2 * mixing.BLOCK * len(want))


def test_mixed_documents_are_in_the_order_of_their_slots(make):
    rows = [(k, f"w{k} " * (20 + k % 90), "en", "abc"[k % 3]) for k in range(300)]
    slots = {}
    for r in mixing.mix_sources(make(rows))[2].groupBy("doc_id", "pass").agg({"slot": "min"}).collect():
        slots.setdefault(r.doc_id, []).append(r[2])
    slots = {k: sorted(v) for k, v in slots.items()}
    order = [slots[r.doc_id].pop(0) for r in mixing.mixed_documents(make(rows)).collect()]
    assert len(order) > 100 and order == sorted(order) and not any(slots.values())


def test_stages_leave_one_small_table_behind(make, tmp_path, monkeypatch):
    from annalis import session
    from annalis.llm import ngram_join

    names = (f"{k}-" for k in range(10_000))
    monkeypatch.setattr(session, "shared_folder", lambda spark, label: f"{tmp_path}/{next(names)}{label}")
    rows = [(k, " ".join(f"w{(k % 30) * 50 + i}" for i in range(40)) + f" x{k // 30}", "en", "abc"[k % 3]) for k in range(60)] + [(60, "one two", "en", None), (60, "one two", "en", None)]
    kept = ngram_join.drop_near_copies(make(rows))
    assert [p.name.split("-", 1)[1] for p in tmp_path.iterdir()] == ["keys"]
    assert kept.count() == 31
    docs = make(rows)
    taken = {}
    for r in mixing.mix_sources(docs)[2].groupBy("doc_id", "row", "pass").agg({"length": "sum"}).collect():
        taken.setdefault(r.doc_id, []).append(r[3])
    before = set(tmp_path.iterdir())
    mixed = mixing.mixed_documents(docs)
    assert [p.name.split("-", 1)[1] for p in set(tmp_path.iterdir()) - before] == ["passes"]
    found = {}
    for r in mixed.collect():
        found.setdefault(r.doc_id, []).append(len(r.text.split()))
    assert {k: len(v) for k, v in found.items()} == {k: len(v) for k, v in taken.items()}


def test_slots_keep_the_shares_in_every_stretch(make):
    rows = [(k, "w " * 100, "en", "abc"[k % 3]) for k in range(900)]
    _, target, pieces = mixing.mix_sources(make(rows))
    total = sum(r.target for r in target.collect())
    share = {r.source_key: r.target / total for r in target.collect()}
    slots = sorted((r.slot, r.source_key) for r in mixing.schedule(target).collect())
    for begin in range(0, len(slots) - 100, 100):
        own = [s for _, s in slots[begin : begin + 100]]
        assert all(abs(own.count(s) - 100 * p) <= 3 for s, p in share.items())
    assert pieces.groupBy("slot").sum("length").filter(f"`sum(length)` > {mixing.BLOCK}").count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps, now = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.staged(stage(spark, now, sf), name)
        assert now.columns == docs.columns
        steps[name] = now.toPandas()
    from test_dedup import components

    texts = steps["copies"]
    assert len(texts) == texts.text.nunique() == steps["language"].text.nunique()
    rows = list(zip(texts.doc_id, texts.text, strict=True))
    assert sorted(steps["near_copies"].doc_id) == sorted({c for _, _, c in components(rows)})
    sizes = steps["near_copies"].assign(n=steps["near_copies"].text.str.split().str.len()).groupby("source").n.sum()
    mixed = steps["mix"].assign(n=steps["mix"].text.str.split().str.len()).groupby("source").n.sum()
    for source, target in levels(sizes.to_dict()).items():
        assert abs(mixed[source] - target) <= 8 * mixing.BLOCK
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    assert packed.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0
    assert corpus_pipeline.run(spark, sf).count() == packed.count()
