"""Quality scores by votes of the nearest labelled texts in a latent space.

A text is described by its counts of character-class trigrams, of hashed byte trigrams and
by how much of it falls to a few trigrams. Counts enter as logarithms, each part with unit
length. The principal directions of a labelled sample span the latent space; the sample's
vectors in it are broadcast. Every text is projected, its cosines with all of them are
computed block by block, and the NEIGHBOURS closest vote with their similarity as weight.

The sample is bounded: SAMPLE_ROWS different texts per label, those with the smallest hash.
All rows that may be learnt from take part in the choice.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalis.llm.common import text_of, texts
from annalis.session import staged

SAMPLE_ROWS = 2000
NEIGHBOURS = 15
DIRECTIONS = 48
GRAM_BITS = 10
#: Shares of a text beyond which a single trigram counts as repeated.
SHARES = (1 / 256, 1 / 128, 1 / 64, 1 / 32, 1 / 16, 1 / 8)
#: Weights of the three parts of a description.
WEIGHTS = (1.0, 0.3, 1.0)
THRESHOLD = 0.3
FOLDS = 5
#: Texts described at once, and bytes looked at at once.
BLOCK_ROWS = 256
CHUNK_BYTES = 1 << 20

_GRAMS = 1 << GRAM_BITS
_SHAPES = 8**3
#: Lower-case, upper-case, digit, space, line break, sentence mark, other ASCII sign, the rest.
_CLASS = np.full(256, 7, np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\t\n\v\f\r", b".,;:!?", b"\"#$%&'()*+-/<=>@[\\]^_`{|}~")):
    _CLASS[list(_chars)] = _k


@dataclass
class Voters:
    centre: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray  # unit length
    labels: np.ndarray

    @property
    def prior(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5


def counts(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of class trigrams and of hashed byte trigrams; a trigram never spans two texts."""
    n = len(found)
    shapes, grams = np.zeros(n * _SHAPES), np.zeros(n * _GRAMS)
    data = np.frombuffer(b"".join(found), np.uint8)
    ends = np.cumsum([len(t) for t in found])
    for lo in range(0, max(len(data) - 2, 0), CHUNK_BYTES):
        some = data[lo : lo + CHUNK_BYTES + 2]
        at = np.arange(lo, lo + len(some) - 2)
        doc = np.searchsorted(ends, at, side="right")
        whole = at + 2 < ends[doc]
        doc, c, x = doc[whole], _CLASS[some].astype(np.int32), some.astype(np.uint32)
        shape = (c[:-2] * 64 + c[1:-1] * 8 + c[2:])[whole]
        gram = (((x[:-2] << np.uint32(16)) + (x[1:-1] << np.uint32(8)) + x[2:]) * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)
        first, last = (doc[0], doc[-1] + 1) if len(doc) else (0, 0)
        for total, width, kind in ((shapes, _SHAPES, shape), (grams, _GRAMS, gram[whole])):
            total[first * width : last * width] += np.bincount((doc - first) * width + kind, minlength=(last - first) * width)
    return shapes.reshape(n, _SHAPES), grams.reshape(n, _GRAMS)


def describe(found: list[bytes]) -> np.ndarray:
    shapes, grams = counts(found)
    length = grams.sum(1, keepdims=True)
    repeated = np.stack([(grams * (grams > length * s)).sum(1) for s in SHARES], 1) / np.maximum(length, 1)
    logs = [np.log1p(m) for m in (shapes, grams)]
    parts = [m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9) for m in logs]
    return np.concatenate([w * m for w, m in zip(WEIGHTS, [*parts, repeated], strict=True)], 1).astype(np.float32)


def project(described: np.ndarray, centre: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Unit vectors in the latent space; zero for a text without a trigram."""
    vectors = (described - centre) @ directions
    vectors[~described.any(1)] = 0
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def learn(described: np.ndarray, labels: np.ndarray) -> Voters:
    """Latent space and voters from the descriptions of labelled texts."""
    width = described.shape[1]
    if not len(described):
        return Voters(np.zeros(width, np.float32), np.zeros((width, 1), np.float32), np.zeros((0, 1), np.float32), labels)
    centre = described.mean(0)
    centred = (described - centre).astype(np.float64)
    directions = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :DIRECTIONS].astype(np.float32)
    return Voters(centre, directions, project(described, centre, directions), labels)


def vote(vectors: np.ndarray, voters: Voters) -> np.ndarray:
    """Labels of the nearest voters, weighted by their cosine where it is above zero; the prior without any such voter."""
    if not len(voters.labels):
        return np.full(len(vectors), voters.prior)
    cosines = vectors @ voters.vectors.T
    k = min(NEIGHBOURS, cosines.shape[1])
    near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64)
    total = weight.sum(1)
    return np.where(total > 0, (weight * voters.labels[near]).sum(1) / np.where(total > 0, total, 1), voters.prior)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """A null id counts as the empty text, whose remainder is 0: it is never learnt from."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def sample(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """At most SAMPLE_ROWS different texts per label: text, label. Only ids and hashes are shuffled."""
    ids = docs.select("doc_id", F.xxhash64(text_of()).alias("hash"))
    given = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("label IN (0, 1)").distinct()
    known = ids.join(given, "doc_id").filter(~held_out()).groupBy("label", "hash").agg(F.min("doc_id").alias("doc_id"))
    order = Window.partitionBy("label", "salt").orderBy("hash")
    # the smallest hashes of each of 64 parts first, so that no task orders all texts of a label
    few = known.withColumn("salt", F.pmod(F.xxhash64("hash"), F.lit(64))).withColumn("row", F.row_number().over(order)).filter(F.col("row") <= SAMPLE_ROWS)
    few = few.withColumn("row", F.row_number().over(Window.partitionBy("label").orderBy("hash"))).filter(F.col("row") <= SAMPLE_ROWS)
    chosen = staged(few.select("label", "hash", "doc_id"), "voters")
    own = docs.select("doc_id", text_of().alias("text")).withColumn("hash", F.xxhash64("text"))
    return own.join(F.broadcast(chosen), ["doc_id", "hash"]).dropDuplicates(["label", "hash"]).select("text", "label")


def _described(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            rows = describe(texts(part["text"]))
            yield pa.record_batch([part["label"], pa.array([r.tobytes() for r in rows], pa.binary())], ["label", "described"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Voters:
    """The driver gets the descriptions of the bounded sample, 2 * SAMPLE_ROWS rows of some 6 KB at most."""
    rows = sample(docs, labels, label).mapInArrow(_described, "label int, described binary").collect()
    rows.sort(key=lambda r: (r.label, bytes(r.described)))
    width = _SHAPES + _GRAMS + len(SHARES)
    described = np.array([np.frombuffer(r.described, np.float32) for r in rows], np.float32).reshape(len(rows), width)
    return learn(described, np.array([r.label for r in rows], np.float64))


def score(docs: DataFrame, voters: Voters) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Null and empty texts, and those under three bytes, have no neighbours: their score is the
    share of label 1 among the voters (0.5 without voters). Repeated rows and null ids are
    scored each; an empty table gives an empty result; further columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches):
        known = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                scores = np.round(vote(project(describe(texts(part["text"])), known.centre, known.directions), known), 6)
                yield pa.record_batch([part["doc_id"], part["held_out"], pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), text_of().alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
