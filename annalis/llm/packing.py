"""Bounded-space online packing of token sequences.

Every task keeps OPEN windows. A text's tokens are cut into whole windows and a rest. The
rest goes to the open window that it fills best. If it fits none and all windows are open,
the fullest one is topped up with the head of the rest and emitted. At the end of a task
its open windows are joined to whole windows and one tail; tails of MERGED tasks at a time
are joined in the same way. A last tail is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import os
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalis.llm.common import text_of, texts
from annalis.session import small_batches, staged

LENGTH = 2048
OPEN = 64
MERGED = 256
END = 1
#: Texts that are tokenized at once.
AT_ONCE = 256

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, ids binary"
MARKS = b".,!?;:*#$%&"
_LETTER, _MARK, _IN_WORD = np.zeros(256, bool), np.zeros(256, bool), np.ones(256, bool)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_MARK[list(MARKS)] = True
_IN_WORD[list(b" \t\n\v\f\r")] = False


class WordTokens(dict):
    """Token ids of the parts of texts as 16-bit bytes; keeps a bounded number of them.

    When there are too many, those of the texts at hand stay, as most of the others never come again.
    The tokenizer lower-cases, drops white space and never joins text across it, nor a letter
    with the marks of MARKS behind it, so that a text's ids are those of its parts in order.
    """

    LIMIT = 1 << 18
    #: Words that the tokenizer holds at once.
    ENCODED = 1 << 13

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        self.whole = Tokenizer.from_file(path)
        self.letters = Tokenizer(self.whole.model)
        self.letters.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def _encode(self, parts: list[bytes]) -> None:
        plain, rest = [], []
        for part in parts:
            word = part.decode()
            simple = word.isalpha() and word == word.lower() and unicodedata.is_normalized("NFC", word)
            (plain if simple else rest).append((part, word))
        for some in (plain[k : k + self.ENCODED] for k in range(0, len(plain), self.ENCODED)):  # one pre-token each, as it stands
            found = self.letters.encode([w for _, w in some], is_pretokenized=True, add_special_tokens=False)
            ids, cuts = np.array(found.ids, np.uint16).tobytes(), 2 * np.searchsorted(np.array(found.word_ids), np.arange(len(some) + 1))
            self.update((part, ids[x:y]) for (part, _), x, y in zip(some, cuts.tolist(), cuts[1:].tolist()))
        for some in (rest[k : k + self.ENCODED] for k in range(0, len(rest), self.ENCODED)):
            for (part, _), found in zip(some, self.whole.encode_batch([w for _, w in some], add_special_tokens=False), strict=True):
                self[part] = np.array(found.ids, np.uint16).tobytes()

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """Token ids of each text, END behind them. Distinct words are looked up once and expanded by their numbers."""
        if not texts:
            return []
        lower = [t if b"<|" in t else t.lower() for t in texts]  # special tokens are looked for before lower-casing
        data = np.frombuffer(b"\n".join(lower), np.uint8)
        word = np.append(_IN_WORD[data], False)
        opens = word.copy()  # a part begins behind white space, and at a mark behind a letter
        opens[1:-1] &= ~word[:-2] | (_LETTER[data[:-1]] & _MARK[data[1:]])
        starts = np.flatnonzero(opens)
        stops = np.flatnonzero(word[:-1] & (~word[1:] | opens[1:])) + 1
        lengths = stops - starts
        offsets = np.append(0, np.cumsum(lengths)).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[word[:-1]])]).dictionary_encode()
        names = words.dictionary.to_pylist()
        new = {w for w in names if w not in self}
        if len(self) + len(new) > self.LIMIT:
            known = {w: self[w] for w in names if w in self}
            self.clear()
            self.update(known)
        if new:
            self._encode(list(new))
        known = [self[w] for w in names] + [END.to_bytes(2, "little")]
        flat, sizes = np.frombuffer(b"".join(known), np.uint16), np.array([len(x) // 2 for x in known])
        begins = np.cumsum(sizes) - sizes
        behind = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in lower]))  # words up to the end of each text
        sequence = np.insert(words.indices.to_numpy().astype(np.int64), behind, len(names))
        reach = np.cumsum(sizes[sequence])
        at = np.repeat(begins[sequence] - (reach - sizes[sequence]), sizes[sequence]) + np.arange(reach[-1])
        return np.split(flat[at], reach[behind + np.arange(len(texts))][:-1])


class Piece:
    __slots__ = ("doc_id", "start", "ids", "total")

    def __init__(self, doc_id, start, ids, total):
        self.doc_id, self.start, self.ids, self.total = doc_id, start, ids, total

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[:n], self.total), Piece(self.doc_id, self.start + n, self.ids[n:], self.total)


def join_pieces(pieces: list[Piece]) -> tuple[list[list[Piece]], list[Piece]]:
    """Whole windows from ``pieces`` in order, and the pieces of the tail."""
    whole, tail, used = [], [], 0
    for piece in pieces:
        while used + len(piece.ids) >= LENGTH:
            head, piece = piece.cut(LENGTH - used)
            whole.append([*tail, head])
            tail, used = [], 0
        if len(piece.ids):
            tail.append(piece)
            used += len(piece.ids)
    return whole, tail


class Packer:
    """Best fit with at most OPEN windows; ``add`` returns the windows that are full."""

    def __init__(self):
        self.windows: list[list[Piece]] = []
        self.used: list[int] = []

    def add(self, piece: Piece) -> list[list[Piece]]:
        out = []
        while len(piece.ids) >= LENGTH:
            head, piece = piece.cut(LENGTH)
            out.append([head])
        while len(piece.ids):
            n = len(piece.ids)
            fits = [u for u in self.used if u + n <= LENGTH]
            if fits:
                at = self.used.index(max(fits))
            elif len(self.windows) < OPEN:
                self.windows.append([])
                self.used.append(0)
                at = len(self.windows) - 1
            else:
                at = self.used.index(max(self.used))
            head, piece = piece.cut(min(n, LENGTH - self.used[at]))
            self.windows[at].append(head)
            self.used[at] += len(head.ids)
            if self.used[at] == LENGTH:
                out.append(self.windows.pop(at))
                self.used.pop(at)
        return out

    def close(self) -> tuple[list[list[Piece]], list[Piece]]:
        order = sorted(range(len(self.used)), key=lambda k: -self.used[k])
        return join_pieces([p for k in order for p in self.windows[k]])


def _rows(windows: list[list[Piece]], first: int, part: int, keep: bool = False) -> pa.RecordBatch:
    cols = [[] for _ in range(9)]
    for k, window in enumerate(windows):
        offset = 0
        for p in window:
            wide = p.ids.astype("<u4").tobytes()
            for col, value in zip(cols, (p.doc_id, p.start, len(p.ids), zlib.crc32(wide), p.total, first + k, offset, part, p.ids.tobytes() if keep else None), strict=True):
                col.append(value)
            offset += len(p.ids)
    kinds = [pa.int64()] * 8 + [pa.binary()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "ids"])


def _pack(path: str):
    def run(batches):
        # the task's own, so that they go with it: what a function's module holds waits for Python's garbage collector
        tokens, packer, part, n = WordTokens(path), Packer(), TaskContext.get().partitionId(), 0
        base = part << 36
        for batch in batches:
            out = []
            doc_ids, found = batch["doc_id"].to_pylist(), texts(batch["text"])
            for k, doc_id in enumerate(doc_ids):
                if k % AT_ONCE == 0:
                    some = tokens.ids(found[k : k + AT_ONCE])
                ids = some[k % AT_ONCE]
                out += packer.add(Piece(doc_id, 0, ids, len(ids)))
                if len(out) >= 1024:
                    yield _rows(out, base + n, part)
                    n, out = n + len(out), []
            yield _rows(out, base + n, part)
            n += len(out)
        whole, tail = packer.close()
        yield _rows(whole, base + n, part)
        yield _rows([tail], -1, part, True)

    return run


def _merge_tails(frame: pa.Table) -> pa.Table:
    frame = frame.sort_by([("part", "ascending"), ("offset", "ascending")])
    rows = frame.select(["doc_id", "start", "doc_tokens", "ids"]).to_pylist()
    group = frame["part"][0].as_py() // MERGED
    whole, tail = join_pieces([Piece(r["doc_id"], r["start"], np.frombuffer(r["ids"], np.uint16), r["doc_tokens"]) for r in rows])
    left = sum(len(p.ids) for p in tail)
    for power in (1 << k for k in range(left.bit_length() - 1, -1, -1)):
        if left & power:
            window, used = [], 0
            while used < power:
                head, rest = tail[0].cut(min(power - used, len(tail[0].ids)))
                window.append(head)
                used += len(head.ids)
                tail = [rest, *tail[1:]] if len(rest.ids) else tail[1:]
            whole.append(window)
    return pa.Table.from_batches([_rows(whole, (1 << 62) + (group << 36), group)])


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Pieces of the token sequences of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a tokenizer file whose ids are below 65536. Each text is
    followed by END. Null and empty texts are one piece with END only. Rows are packed one by
    one, so that repeated rows and null ids need no care. An empty table gives an empty
    result; further columns are ignored.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    with small_batches(docs.sparkSession):
        pieces = staged(docs.select("doc_id", text_of().alias("text")).mapInArrow(_pack(str(tokenizer)), _PIECE), "pieces")
    tails = pieces.filter("ids IS NOT NULL").withColumn("group", F.floor(F.col("part") / MERGED)).groupBy("group").applyInArrow(lambda t: _merge_tails(t), _PIECE)
    return pieces.filter("ids IS NULL").unionByName(tails).drop("part", "ids")
