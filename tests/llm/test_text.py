"""Language ID, secrets, chats, WARC and quality."""

import base64
import glob
import gzip
import hashlib
import json
import random
import re

import numpy as np
import pandas as pd
import pytest

from annalis.llm import chat, langid, quality, secrets, warc

SF = "/root/testdata/sf0.001"


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.filter("doc_id % 2 = 0"))
    held = docs.filter("doc_id % 2 = 1")
    found = langid.identify(langid.documents_evidence(held, model)).toPandas().merge(held.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (found.lang_id == found.lang).mean() > 0.95 and found.kept.mean() > 0.95


def test_copies_do_not_count_in_the_language_sample(make, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 4)
    rows = [(k, f"{w} river {w}", "en") for k, w in enumerate("stone window garden bread light water".split())]
    once, often = langid.fit(make(rows)), langid.fit(make(rows + [(100 + k, rows[k % 6][1], "en") for k in range(90)]))
    assert np.array_equal(once.logs, often.logs)


def test_language_evidence(make):
    rng = random.Random(5)
    words = {"en": "the of and with that from this have".split(), "fr": "les des une dans pour avec sur être".split()}
    rows = [(k, " ".join(rng.choices(words[lang], k=40)), lang, f"host.{lang[:2]}") for k, lang in enumerate(["en", "fr"] * 40)]
    rows += [(900, "", None, "host.fr"), (901, None, None, None), (902, "12345 !!! 9", "en", "host.en"), (903, "zz qq", None, "host.fr"), (904, '<html lang="fr">', None, "host.fr"), (0, rows[0][1], "en", "host.en")]
    found = {r.doc_id: r for r in langid.identify_documents(make(rows)).collect()}
    assert all(found[k].lang_id == ["en", "fr"][k % 2] and found[k].kept for k in range(80))
    assert not any(found[k].kept for k in (900, 901, 902)) and found[900].text_lang is None
    assert found[903].lang_id != "en" and found[904].declared == "fr"
    assert sorted(r.doc_id for r in langid.keep_identified(make(rows)).collect() if r.doc_id >= 900) == [k for k in (903, 904) if found[k].kept]
    assert langid.identify_documents(make(rows).limit(0)).count() == 0


def test_secrets(make):
    rng = random.Random(2)
    b64 = [base64.b64encode(rng.randbytes(36)).decode() for _ in range(8)]
    texts = ["café password = 'abcdefghijkl' and TOKEN:short token=secret:abcdefghijklmnop", "AKIA" + "A1" * 8 + " AKIAA1 " + "0123456789abcdef" * 2, None, "", "x" * 50_000 + " api_key=" + "k" * 12,
             "Donaudampfschifffahrtsgesellschaft abcdefghijklmnopqrstuvwxyz0123456789 AAAAAAAAAAAAAAAAAAAA1111 this-is-a-long-dashed-phrase-of-words"] + [f"see {t} there" for t in b64]
    rows = list(enumerate(texts))
    found = {r.doc_id: r for r in secrets.scan(make(rows + [rows[0]])).collect()}
    pattern = re.compile(secrets.ASSIGN)
    for k, text in rows:
        text = text or ""
        want = [(m.start(), 0, m.end()) for m in pattern.finditer(text) if len(m[2]) >= 12]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        assert [tuple(s) for s in found[k].base] == sorted(want), k
        assert set(found[k].base) <= set(found[k].spans)
    caught = [r for k, r in found.items() if k >= 6 and r.n_random == 1]
    assert len(caught) >= 7 and all(texts[r.doc_id][r.spans[-1].start : r.spans[-1].end] in b64 for r in caught)
    assert found[5].n_random == 0
    assert secrets.scan(make(rows).limit(0)).count() == 0


def test_random_keys_of_every_encoding_pass_the_battery(spark):
    """Of true random keys the battery rejects few at every length."""
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = {"hex": digits + "abcdef", "HEX": digits + "ABCDEF", "base32": upper + "234567", "base36": lower + digits, "BASE36": upper + digits,
                 "base62": upper + lower + digits, "base64": upper + lower + digits + "+/", "base64url": upper + lower + digits + "-_"}
    rng = random.Random(9)
    keys = [("".join(rng.choices(a, k=n)), name, n) for name, a in alphabets.items() for n in (20, 32, 64, 128) for _ in range(25)]
    rows = secrets.battery(spark.createDataFrame(keys, "token string, name string, n long").repartition(4)).select("name", "n", "random_p").collect()
    passed = {(name, n): sum(r.random_p >= secrets.BATTERY_P for r in rows if (r.name, r.n) == (name, n)) for _, name, n in keys}
    assert min(passed.values()) >= 20, passed


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "be # <nice>"), (1, 1, "user", "\\### Assistant: </turn> ok"), (1, 2, "assistant", "\\h\\\\l </turn>\n### user: "), (2, 0, "assistant", "no"), (2, 0, "assistant", "no"), (3, 0, "user", None), (3, 1, None, "x"), (None, 0, "us:er\n", "é" * 20_000), (4, None, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS segments")
    out = chat.format_chats(df).withColumn("turns", chat.read_turns(chat.F.col("formatted"))).withColumn("loss", chat.learned_text(chat.F.col("segments")))
    found = {r.conv_id: r for r in out.collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert [(t.role, t.text) for t in found[conv].turns] == [(r, t) for _, _, r, t in own]
        assert found[conv].loss == "".join(t for _, _, r, t in own if r == "assistant")
    assert (found[1].first_violation, found[2].first_violation, found[3].first_violation) == (None, 0, 1)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    page = '<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- ad --><p>one  <b>two</b><br>three &lt;x&gt;</p><a href="/l?a=1&amp;b=2">l</a></body></html>'
    pages = spark.createDataFrame([(1, "http://a/", page), (2, None, None), (1, "http://a/", page), (3, "http://b/", "é" * 50_000)], "page_id long, url string, html string").selectExpr("*", "'x' AS block")
    responses = warc.responses(pages)
    made = warc.derivatives(responses)
    rows = [r for r in made.collect() if r.page_id == 1]
    text = next(r for r in rows if r.warc_type == "conversion")
    facts = json.loads(next(r for r in rows if r.warc_type == "metadata").block)
    assert text.block == "A & B\none two\nthree <x>\nl" and facts["title"] == "A & B" and facts["links"] == ["/l?a=1&b=2"] and facts["payload_verified"]
    assert text.headers["WARC-Source-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(page.encode()).digest()).decode()
    ids = {r.record_id for r in responses.collect()}
    assert all(r.refers_to in ids for r in made.collect()) and made.count() == 8
    warc.write_warc(responses.unionByName(made), str(tmp_path / "out"))
    read = [x for f in glob.glob(str(tmp_path / "out" / "*.gz")) for x in warc.read_warc(gzip.open(f).read())]
    assert len(read) == 12
    for fields, block in read:
        assert fields["WARC-Block-Digest"] == warc.sha1_base32(block)
    assert warc.derivatives(responses.limit(0)).count() == 0 and warc.derivatives(made).count() == 0


def base_rules(text):
    words, seen = re.findall(r"[^\x20\x09-\x0D]+", text), {}
    for k in range(len(words) - 2):
        seen.setdefault(tuple(words[k : k + 3]), []).append(k)
    covered = {k + d for at in seen.values() if len(at) > 1 for k in at for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality(make):
    rng = random.Random(4)
    common = quality.COMMON["en"]
    clean = [" ".join(rng.choices(common + ["stone", "river", "window", "garden"], k=150)) + "." for _ in range(40)]
    odd = [" é # a|b\n# a|b\n\nx\x0b y", None, "", "up " * 400, " ".join(f"{w}###$$$%%%" for w in clean[0].split()), clean[1].upper() + "!!" * 80, "plain " * 30 + "\n" + "plain " * 30]
    rows = [(k, t, "en") for k, t in enumerate(clean)] + [(100 + k, t, None if k % 2 else "xx") for k, t in enumerate(odd)]
    found = {r.doc_id: r for r in quality.judge(make(rows + [rows[0]])).collect()}
    for k, text, _ in rows:
        r = found[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_rules(text or ""), k
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert all(found[k].kept or found[k].base_failed for k in range(40)) and sum(found[k].kept for k in range(40)) > 30
    assert not found[104].kept and not found[105].kept
    assert quality.judge(make(rows).limit(0)).count() == 0


def test_distance():
    p, q = np.array([[1.0, 0.0], [0.5, 0.5]]), np.array([[0.0, 1.0], [0.5, 0.5]])
    assert quality.distance(p, q) == pytest.approx([1.0, 0.0])


def test_labels_agree(spark):
    found = quality.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas().merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    good, bad = found[(found.quality == 1) & ~found.base_failed], found[found.quality == 0]
    assert good.kept.mean() > 0.99 and bad.kept.mean() < 0.2


def test_quality_of_a_table_without_words(make):
    from annalis.llm import quality

    rows = quality.judge(make([(1, None), (2, ""), (3, " \n "), (None, None)])).collect()
    assert len(rows) == 4 and not any(r.kept for r in rows) and all(r.base_failed and r.n_words == 0 for r in rows)
