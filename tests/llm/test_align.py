"""Alignment of two tokenizers against plain loops over all pairs of tokens."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from annalis.llm import align

TEXTS = ["The river, it's <|endoftext|> </s> <s>", "", None, "ÉCOLE été ﬁ ½ don'T 'S", "日本語 und  \n\n zwei\t drei ", "a▁b", "naïve 😀😀 Ω≈ç √∫", " ", "\x00\r\n", "x" * 3000 + " " * 3000 + "!" * 900]


def plain(rows):
    import public_tokenizers as public
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    shown = align._shown_bytes()
    out, count, links = {}, Counter(), {}
    for key, text in rows:
        want = (" " + text).encode() if text else b""
        ia, ib = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        pieces = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k, p in zip(ib, map(b.id_to_piece, ib))]
        tokens = [bytes(shown[c] for c in a.id_to_token(k)) for k in ia]
        if not text or b"".join(pieces) != want or b"".join(tokens) != want:
            out[key], links[key] = [0, 0, 0, 0, ""], []
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in tokens]), np.cumsum([len(x) for x in pieces])
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = []
        for lo, hi in zip([0, *cuts], cuts):
            groups.append(",".join(str(k) for k, e in zip(ia, ends_a) if lo < e <= hi) + "|" + ",".join(str(k) for k, e in zip(ib, ends_b) if lo < e <= hi))
        pairs = []
        for k, x, e in zip(ia, tokens, ends_a):
            for m, y, f in zip(ib, pieces, ends_b):
                if max(e - len(x), f - len(y)) < min(e, f):
                    pairs.append((k, m))
        links[key] = pairs
        count.update(pairs)
        out[key] = [len(ia), len(ib), len(groups), len(pairs), hashlib.sha256(";".join(groups).encode()).hexdigest()]
    best = {}
    for (_, m), n in count.items():
        best[m] = max(best.get(m, 0), n)
    return {k: (*v[:4], sum(count[p] == best[p[1]] for p in links[k]), sum(count[p] for p in links[k]), v[4]) for k, v in out.items()}


@pytest.mark.parametrize("block", [1 << 21, 40])
def test_align(make, block):
    rows = list(enumerate(TEXTS)) + [(100 + k, " ".join(TEXTS[j % 6] or "?" for j in range(k))) for k in range(8)] + [(200, TEXTS[0])]
    found = align.align(make(rows), block_bytes=block).collect()
    assert {r[0]: tuple(r[1:]) for r in found} == plain(rows) and len(found) == len(rows)


def test_repeated_rows_nulls_and_empty_tables(make):
    rows = [(None, "one two"), (None, "one two"), (3, None)]
    found = sorted(tuple(r) for r in align.align(make(rows)).select("n_a", "n_links", "count_sum").collect())
    assert found[0] == (0, 0, 0) and found[1] == found[2] == (2, 2, 4)
    assert align.align(make(rows).limit(0)).collect() == []
    assert align.aligned_groups(make(rows).limit(0)).collect() == []


def test_groups_give_the_text_back(make):
    rows = [(k, t) for k, t in enumerate(TEXTS[:6])]
    found = {r.doc_id: r.groups for r in align.aligned_groups(make(rows)).collect()}
    for k, text in rows:
        at = 0
        for g in found[k]:
            assert g.start == at and g.a and g.b
            at = g.end
        assert at == (len((" " + text).encode()) if found[k] else 0)


def test_coalesce_with_gaps():
    order, group, a, b = align.coalesce(np.array([0, 12]), np.array([10, 14]), np.array([0, 5, 14]), np.array([3, 8, 15]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(0, 0), (0, 1)]
    assert group.tolist() == [0, 0, 0, 1, 2]


def test_long_texts(make):
    """Runs of one character and a text with very many tokens take linear time."""
    rows = [(1, "a" * 200_000), (2, " " * 200_000), (3, "ab, " * 100_000), (4, "^" * 100_000)]
    found = {r.doc_id: r for r in align.align(make(rows)).collect()}
    assert found[3].n_a > 100_000 and all(r.n_links >= r.n_groups > 0 for r in found.values())
