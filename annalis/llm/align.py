"""Alignment of two tokenizations of one text by coalescing byte intervals.

Every token is an interval of bytes. The intervals of both tokenizers are sorted together by
start (A before B at the same start), and the running maximum of their ends is taken: where a
start reaches the maximum of all before, a new group begins. Within a group every token
overlaps the newest token of the other side that started before it, which gives each
overlapping pair once.

Texts are worked on in blocks of BLOCK_BYTES, one row per block, whose links are counted in
the block. Only distinct pairs of a block are shuffled: they are summed over the corpus, the
sums go back to the blocks by one join, and each block then sums over its documents.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalis.llm.common import text_of
from annalis.session import staged

#: Text that one block holds, apart from a longer single text.
BLOCK_BYTES = 1 << 21
#: A pair is A's id times PAIR plus B's id; ids are below 2**31.
PAIR = 1 << 32
#: Characters for which the fast encoder's letter classes are sure to be those of the tokenizer file.
_COMMON = re.compile("[^\x00-ȿ]")
#: Runs of one kind of character beyond this length go to the tokenizer file as well.
_LONG_RUN = re.compile(r"[^\W\d]{500}|\d{500}|\s{500}|[^\s\w]{500}")


class ByteLevel:
    """Tokenizer A: a byte-level vocabulary file, with the same vocabulary as ranks for ordinary text."""

    def __init__(self, file: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        self.whole = Tokenizer.from_file(file)
        self.whole.encode_special_tokens = True
        shown = _shown_bytes()
        self.bytes = np.array([b""] * self.whole.get_vocab_size(), object)
        for token, k in self.whole.get_vocab().items():
            self.bytes[k] = bytes(shown[c] for c in token) if all(c in shown for c in token) else token.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = []
        for text in texts:
            text = " " + text
            plain = _COMMON.search(text) is None and _LONG_RUN.search(text) is None
            out.append(self.fast.encode_ordinary(text) if plain else self.whole.encode(text, add_special_tokens=False).ids)
        return out


class Pieces:
    """Tokenizer B: a piece model that writes the space as U+2581 and unknown characters byte by byte."""

    def __init__(self, file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=file)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes = np.array([b""] * len(names), object)
        for k, name in enumerate(names):
            self.bytes[k] = bytes([int(name[3:5], 16)]) if self.model.is_byte(k) else name.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def _shown_bytes() -> dict[str, int]:
    """The printable character that a byte-level vocabulary shows for each byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(hidden)}


_LOADED: dict[tuple, object] = {}


def _loaded(kind, *args):
    if args not in _LOADED:
        _LOADED[args] = kind(*args)
    return _LOADED[args]


def coalesce(a_starts: np.ndarray, a_ends: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Groups and links of two lists of intervals; the intervals of one list don't overlap each other.

    Returns the order of all tokens (A's first, B's behind them), the group of each token in
    that order, and the A and B positions of all overlapping pairs.
    """
    n = len(a_starts)
    starts, ends = np.concatenate([a_starts, b_starts]), np.concatenate([a_ends, b_ends])
    side = np.arange(len(starts)) >= n
    order = np.lexsort((side, starts))
    starts, ends, side = starts[order], ends[order], side[order]
    reach = np.maximum.accumulate(ends)
    first = np.append(True, starts[1:] >= reach[:-1])[: len(starts)]
    group = np.cumsum(first) - 1
    # within a group: the newest token of either side so far
    at_a, at_b = np.cumsum(~side) - 1, np.cumsum(side) - 1
    linked = (at_a >= 0) & (at_b >= 0) & ~first
    linked[linked] = np.minimum(a_ends[at_a[linked]], b_ends[at_b[linked]]) > starts[linked]
    return order, group, at_a[linked], at_b[linked]


def blocks_of(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold ``limit`` bytes at most, or one row."""
    at, n = 0, len(sizes)
    ends = np.cumsum(sizes)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(int(np.searchsorted(ends, base + limit, side="right")), at + 1)
        yield at, to
        at = to


def text_sizes(column) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


class Aligned:
    """Tokens, groups and links of the texts of one block."""

    def __init__(self, texts: list[str], a: ByteLevel, b: Pieces):
        known = [k for k, t in enumerate(texts) if t]
        some = [texts[k] for k in known]
        want = [b" " + t.encode() for t in some]
        a_ids, b_ids = a.encode(some), b.encode(some)
        same = [j for j, w in enumerate(want) if b"".join(a.bytes[a_ids[j]]) == w and b"".join(b.bytes[b_ids[j]]) == w]
        self.n_a, self.n_b = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for j in same:
            self.n_a[known[j]], self.n_b[known[j]] = len(a_ids[j]), len(b_ids[j])
        self.a = np.concatenate([np.zeros(0, np.int64), *(a_ids[j] for j in same)]).astype(np.int64)
        self.b = np.concatenate([np.zeros(0, np.int64), *(b_ids[j] for j in same)]).astype(np.int64)
        # equal bytes on both sides: the texts can stand one behind the other
        a_ends, b_ends = (np.cumsum(_lengths(t)[ids]) for t, ids in ((a, self.a), (b, self.b)))
        ahead = lambda e: np.append(0, e)[:-1]
        self.order, self.group, self.link_a, self.link_b = coalesce(ahead(a_ends), a_ends, ahead(b_ends), b_ends)
        doc_a = np.repeat(np.arange(len(texts)), self.n_a)
        self.link_doc = doc_a[self.link_a]
        n_groups = self.group[-1] + 1 if len(self.group) else 0
        side = self.order >= len(self.a)
        leads = self.order[~side][np.unique(self.group[~side], return_index=True)[1]] if n_groups else np.zeros(0, np.int64)
        self.n_groups = np.bincount(doc_a[leads], minlength=len(texts))
        self.n_links = np.bincount(self.link_doc, minlength=len(texts))

    def digests(self) -> list[str]:
        """Hash of the groups of each text as `a1,a2|b1;a3|b2,b3`; without tokens the empty string."""
        n = len(self.a)
        by_group = np.lexsort((self.order, self.group))  # positions of A come before those of B
        token, group = self.order[by_group], self.group[by_group]
        last = np.append((group[1:] != group[:-1]) | ((token[1:] >= n) != (token[:-1] >= n)), True)[: len(token)]
        ids = np.concatenate([self.a, self.b])[token]
        mark = np.where(last, np.where(token >= n, 2, 1), 0)
        written = _numbers(int(ids.max()) + 1 if len(ids) else 0)[mark, ids]
        ends = np.cumsum(self.n_a + self.n_b)
        return [hashlib.sha256(b"".join(written[e - m : e])[:-1]).hexdigest() if m else "" for e, m in zip(ends, self.n_a + self.n_b, strict=True)]


_LENGTHS: dict[int, np.ndarray] = {}
_NUMBERS: list[np.ndarray] = []


def _lengths(tokenizer) -> np.ndarray:
    if id(tokenizer) not in _LENGTHS:
        _LENGTHS[id(tokenizer)] = np.array([len(x) for x in tokenizer.bytes], np.int64)
    return _LENGTHS[id(tokenizer)]


def _numbers(n: int) -> np.ndarray:
    """Decimal ids with each of the three marks that can follow them."""
    if not _NUMBERS or _NUMBERS[0].shape[1] < n:
        _NUMBERS[:] = [np.array([[b"%d%c" % (k, mark) for k in range(max(n, 1))] for mark in b",|;"], object)]
    return _NUMBERS[0]


_BLOCK = ("block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, shas array<string>, "
          "pairs array<long>, counts array<long>, sizes array<int>, at array<int>, times array<int>")


def _measure(a_args: tuple, b_args: tuple, limit: int):
    def run(batches):
        a, b = _loaded(ByteLevel, *a_args), _loaded(Pieces, *b_args)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi in blocks_of(text_sizes(batch["text"]), limit):
                part = batch.slice(lo, hi - lo)
                found = Aligned(part["text"].to_pylist(), a, b)
                code = found.a[found.link_a] * PAIR + found.b[found.link_b]
                pairs, at, counts = np.unique(code, return_inverse=True, return_counts=True)
                own, times = np.unique(found.link_doc * max(len(pairs), 1) + at, return_counts=True)
                doc, at = own // max(len(pairs), 1), own % max(len(pairs), 1)
                row = [number, part["doc_id"].to_pylist(), found.n_a, found.n_b, found.n_groups, found.n_links, found.digests(), pairs, counts,
                       np.bincount(doc, minlength=hi - lo), at, times]
                kinds = [pa.int64(), *(pa.list_(t) for t in [pa.int64()] * 5 + [pa.string()] + [pa.int64()] * 2 + [pa.int32()] * 3)]
                names = [f.split()[0] for f in _BLOCK.split(", ")]
                yield pa.record_batch([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names)
                number += 1

    return run


def _per_document(batches):
    """Counts of the links of each document from its block's pairs and what the corpus knows of them."""
    for batch in batches:
        for k in range(batch.num_rows):
            flat = lambda name: batch[name][k].values  # noqa: B023, E731
            n, sizes = len(flat("doc_ids")), flat("sizes").to_numpy()
            counts = np.zeros(len(flat("pairs")), np.int64)
            best = np.zeros(len(counts), bool)
            if batch["known"][k].is_valid:
                known = flat("known")
                at = known.field("pos").to_numpy()
                counts[at], best[at] = known.field("count").to_numpy(), known.field("best").to_numpy(zero_copy_only=False)
            doc, at, times = np.repeat(np.arange(n), sizes), flat("at").to_numpy(), flat("times").to_numpy().astype(np.int64)
            n_best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(n_best, doc, times * best[at])
            np.add.at(total, doc, times * counts[at])
            cols = [flat(c) for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.record_batch([*cols, pa.array(n_best), pa.array(total), flat("shas")],
                                  ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def _paths(a: str | None, a_ranks: str | None, pattern: str | None, b: str | None) -> tuple[tuple, tuple]:
    import public_tokenizers as public

    return ((str(a or public.path("byte_bpe_50k.json")), str(a_ranks or public.path("byte_bpe_50k.tiktoken")), pattern or public.PATTERN),
            (str(b or public.path("piece_bpe_32k.model")),))


def align(docs: DataFrame, a: str | None = None, a_ranks: str | None = None, pattern: str | None = None, b: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a`` and ``a_ranks`` are a byte-level tokenizer file and the same vocabulary as ranks,
    ``b`` a piece model. Null and empty texts, and texts that a tokenizer doesn't give back
    byte by byte, have no tokens: zeros and an empty string. Repeated rows count each; null ids
    stay null; an empty table gives an empty result; further columns are ignored.
    """
    a_args, b_args = _paths(a, a_ranks, pattern, b)
    blocks = staged(docs.select("doc_id", "text").mapInArrow(_measure(a_args, b_args, block_bytes), _BLOCK), "token-blocks")
    own = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("pos", "x")).select("block", "pos", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    totals = own.groupBy("pair").agg(F.sum("n").alias("count"))
    # at most one row per id of A for each id of B
    best = F.col("count") == F.max("count").over(Window.partitionBy(F.col("pair") % PAIR))
    totals = staged(totals.withColumn("best", best), "pair-counts")
    known = own.drop("n").join(totals, "pair").groupBy("block").agg(F.collect_list(F.struct("pos", "count", "best")).alias("known"))
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return blocks.drop("counts").join(known, "block", "left").mapInArrow(_per_document, out)


def aligned_groups(docs: DataFrame, a: str | None = None, a_ranks: str | None = None, pattern: str | None = None, b: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id and ``groups``, the A and B ids of each group and its byte range in space+text.

    Rows without tokens, as in ``align``, have an empty list.
    """
    a_args, b_args = _paths(a, a_ranks, pattern, b)

    def run(batches):
        one, two = _loaded(ByteLevel, *a_args), _loaded(Pieces, *b_args)
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for lo, hi in blocks_of(text_sizes(batch["text"]), BLOCK_BYTES):
                part, lists = batch.slice(lo, hi - lo), []
                for text in part["text"].to_pylist():
                    found = Aligned([text], one, two)
                    groups = [{"a": [], "b": []} for _ in range(int(found.n_groups[0]))]
                    for token, group in zip(found.order.tolist(), found.group.tolist(), strict=True):
                        is_b = token >= len(found.a)
                        groups[group]["b" if is_b else "a"].append(int(found.b[token - len(found.a)] if is_b else found.a[token]))
                    at = 0
                    for g in groups:
                        g["start"], at = at, at + sum(len(one.bytes[k]) for k in g["a"])
                        g["end"] = at
                    lists.append(groups)
                yield pa.record_batch([part["doc_id"], pa.array(lists, kind)], ["doc_id", "groups"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, "doc_id long, groups array<struct<a: array<int>, b: array<int>, start: long, end: long>>")
