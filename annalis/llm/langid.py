"""Language identification by Bayesian fusion of four kinds of evidence.

posterior(l) ~ prior(l | host) * P(declared | l) * P(text | l) ** (n_eff / n)

* Text: byte trigrams under a naive Bayes model per language, and a flat model "und" for
  text that is in none. Trigrams of one text depend on each other, so that n of them count
  as n / (1 + n / SATURATE).
* Declared markup language: a confusion table of declared against text-only posteriors,
  summed over all rows.
* Address suffix and host: prior counts of text-only posteriors, summed over all rows by
  host, by suffix and in total. Each level is smoothed towards the one above with SMOOTHING
  pseudo-rows.

Only the trigram model is fitted on a sample: at most SAMPLE_ROWS different texts per language,
those with the smallest key hash, each once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalis.llm.common import join_counted, row_key, text_of
from annalis.session import small_batches, staged

LANGUAGES = ("en", "fr", "de", "es")
UNKNOWN = "und"
SAMPLE_ROWS = 1000
BUCKETS = 1 << 15
#: Trigrams that a task holds at once.
SLICE_BYTES = 1 << 20
SATURATE = 100.0
SMOOTHING = 20.0
#: A text is "und" if its trigrams have a lower mean log-probability than this in every language.
FLAT_LOG = -9.8
MIN_CONFIDENCE = 0.5


@dataclass
class GramModel:
    languages: tuple[str, ...]
    logs: np.ndarray  # BUCKETS x languages


def _grams(column, limit: int = SLICE_BYTES):
    """Buckets of the byte trigrams of a column of strings, at most ``limit`` at once, also within one long text.

    Yields the first row and the row behind the last one of a slice, the slice's buckets, and where each of
    these rows begins and ends in them. The trigrams of a row can be in several slices.
    """
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    ends = np.maximum(offsets[:-1], offsets[1:] - 2)
    for lo in range(int(offsets[0]), int(offsets[-1]), limit):
        hi = min(lo + limit, int(offsets[-1]))
        first, last = np.searchsorted(offsets, lo, side="right") - 1, np.searchsorted(offsets, hi, side="left")
        some = data[lo : min(hi + 2, int(offsets[-1]))].astype(np.uint32)
        code = (some[:-2] << 16 | some[1:-1] << 8 | some[2:]) if len(some) > 2 else np.zeros(0, np.uint32)
        yield first, last, (code * np.uint32(2654435761)) >> np.uint32(17), np.clip(offsets[first:last], lo, hi) - lo, np.clip(ends[first:last], lo, hi) - lo


def letters(text: Column) -> Column:
    """Lower-case letters with one space between runs; the form that trigrams are taken from."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")


def fit(labelled: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> GramModel:
    """A trigram model from ``labelled`` (text, lang). Languages without rows get a flat model."""
    keyed = labelled.filter(F.col("lang").isin(*languages)).select("lang", text_of().alias("text")).withColumn("_key", F.xxhash64("lang", "text"))
    order = Window.partitionBy("lang").orderBy("_key")
    sample = keyed.select("lang", "_key").distinct().withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= SAMPLE_ROWS)
    picked = keyed.join(F.broadcast(sample.select("lang", "_key")), ["lang", "_key"], "left_semi")  # SAMPLE_ROWS keys per language at most
    picked = picked.groupBy("lang", "_key").agg(F.min("text").alias("text"))  # a task hands on one copy of each text

    def count(batches):
        total = {lang: np.zeros(BUCKETS, np.int64) for lang in languages}
        for batch in batches:
            langs = batch["lang"].to_pylist()
            for first, last, buckets, starts, ends in _grams(batch["text"]):
                for lang, a, b in zip(langs[first:last], starts, ends, strict=True):
                    total[lang] += np.bincount(buckets[a:b], minlength=BUCKETS)
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], ["lang", "bucket", "n"])

    rows = picked.select("lang", letters(F.col("text")).alias("text")).mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages x BUCKETS rows at most
    counts = np.zeros((BUCKETS, len(languages)))
    for k, lang in enumerate(languages):
        own = rows[rows["lang"] == lang]
        counts[own["bucket"].to_numpy(), k] = own["n"].to_numpy()
    smooth = counts + 0.05
    return GramModel(languages, np.log(smooth / smooth.sum(axis=0)).astype(np.float32))


def text_scores(rows: DataFrame, model: GramModel, id_cols: list[str], text: Column) -> DataFrame:
    """``id_cols``, n_grams and scores: the tempered log-likelihood per language, then of "und"."""
    logs = model.logs
    source = rows.select(*id_cols, letters(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]) + ", n_grams long, scores array<double>"

    def score(batches):
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            sums = np.zeros((len(n), logs.shape[1] + 1))
            for first, last, buckets, starts, ends in _grams(batch["_text"]):
                n[first:last] += ends - starts
                some = np.flatnonzero(ends > starts)
                if len(some):
                    cuts = np.column_stack([starts[some], ends[some]]).ravel()
                    for k in range(logs.shape[1]):
                        sums[first + some, k] += np.add.reduceat(np.append(logs[:, k][buckets].astype(np.float64), 0.0), cuts)[::2]
            sums[:, -1] = n * FLAT_LOG
            scores = sums / (1 + n / SATURATE)[:, None]
            out = [batch.column(k) for k in range(batch.num_columns - 1)] + [pa.array(n), pa.array(list(scores), pa.list_(pa.float64()))]
            yield pa.record_batch(out, [*batch.schema.names[:-1], "n_grams", "scores"])

    return source.mapInArrow(score, schema)


def _soft(scores: Column) -> Column:
    """Posterior of log scores."""
    shifted = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, y: a + y))


def _smoothed(counts: Column, n: Column, above: Column) -> Column:
    return F.zip_with(counts, above, lambda c, p: (c + p * SMOOTHING) / (n + SMOOTHING))


def identify(evidence: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """Adds lang_id, confidence, text_lang and kept to ``evidence`` (host, suffix, declared, n_grams, scores, ...).

    ``suffix`` must have at most two letters, so that there are few. Rows without a letter
    have text_lang null and kept false; so have rows whose best answer is "und" or has a
    posterior below MIN_CONFIDENCE. Null host, suffix or declared count as empty.
    """
    labels = [*languages, UNKNOWN]
    width = len(labels)
    lang_at = F.array(*[F.lit(x) for x in labels])
    ev = (evidence.withColumn("host", F.coalesce("host", F.lit(""))).withColumn("suffix", F.coalesce("suffix", F.lit("")))
          .withColumn("declared", F.when(F.col("declared").isin(*languages), F.col("declared")).when(F.coalesce("declared", F.lit("")) == "", F.lit("none")).otherwise(F.lit("other")))
          .withColumn("_soft", _soft(F.col("scores"))))
    sums = [F.sum(F.when(F.col("n_grams") > 0, F.round(F.col("_soft")[k], 9)).otherwise(0.0)).alias(f"_c{k}") for k in range(width)]
    counts = F.array(*[f"_c{k}" for k in range(width)])
    hosts = staged(ev.groupBy("host", "suffix").agg(F.count("*").alias("_rows"), *sums).select("host", "suffix", "_rows", F.transform(counts, lambda x: F.round(x, 6)).alias("_counts")), "host-counts")
    level = lambda keys: hosts.groupBy(*keys).agg(F.sum("_rows").alias("_n"), *[F.sum(F.col("_counts")[k]).alias(f"_c{k}") for k in range(width)])
    total = level([]).first()
    flat = F.array(*[F.lit(((total[f"_c{k}"] or 0.0) + 1.0) / ((total["_n"] or 0) + width)) for k in range(width)])
    by_suffix = level(["suffix"]).select("suffix", _smoothed(counts, F.col("_n"), flat).alias("_above"))
    priors = (hosts.join(F.broadcast(by_suffix), "suffix")  # suffixes of two letters at most: under 800
              .select(F.struct("host", "suffix").alias("_at"), "_rows", _smoothed(F.col("_counts"), F.col("_rows"), F.col("_above")).alias("_prior")))
    table = {r["declared"]: r for r in ev.groupBy("declared").agg(*sums).collect()}  # languages + 2 rows
    kinds = [*languages, "other", "none"]
    seen = np.array([[table[d][f"_c{k}"] if d in table else 0.0 for k in range(width)] for d in kinds]) + 1.0
    confusion = np.round(np.log(seen / seen.sum(axis=0)), 9)
    declared_log = F.create_map(*[x for d, row in zip(kinds, confusion, strict=True) for x in (F.lit(d), F.array(*[F.lit(float(v)) for v in row]))])

    fused = F.zip_with(F.zip_with(F.col("scores"), F.col("_prior"), lambda s, p: s + F.log(p)), declared_log[F.col("declared")], lambda a, b: a + b)
    out = join_counted(ev.withColumn("_at", F.struct("host", "suffix")), priors, "_at", "_rows", "inner").withColumn("_post", _soft(fused))
    best = F.array_position("_post", F.array_max("_post"))
    out = out.withColumn("lang_id", F.element_at(lang_at, best.cast("int"))).withColumn("confidence", F.round(F.array_max("_post"), 6))
    out = out.withColumn("text_lang", F.when(F.col("n_grams") > 0, F.element_at(lang_at, F.array_position("_soft", F.array_max("_soft")).cast("int"))))
    out = out.withColumn("kept", (F.col("n_grams") > 0) & (F.col("lang_id") != UNKNOWN) & (F.col("confidence") >= MIN_CONFIDENCE))
    return out.drop("_at", "_rows", "_prior", "_post", "_soft", "scores")


def declared_in(markup: Column) -> Column:
    """Language of the first html tag of a text, lower case, without region."""
    return F.lower(F.regexp_extract(markup, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))


def documents_evidence(docs: DataFrame, model: GramModel) -> DataFrame:
    """Evidence of documents: source stands for the host; a suffix is its last label, if of two letters."""
    rows = docs.select("doc_id", row_key().alias("_key"), F.col("source").alias("host"),
                       F.regexp_extract(F.coalesce("source", F.lit("")), r"\.([A-Za-z]{2})$", 1).alias("suffix"), declared_in(text_of()).alias("declared"), "text")
    return text_scores(rows, model, ["doc_id", "_key", "host", "suffix", "declared"], text_of())


def pages_evidence(pages: DataFrame, model: GramModel) -> DataFrame:
    """Evidence of raw pages (page_id, url, html)."""
    html = F.coalesce("html", F.lit(""))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>|&[#A-Za-z0-9]+;", " ")
    rows = pages.select("page_id", host.alias("host"), F.regexp_extract(host, r"\.([a-z]{2})$", 1).alias("suffix"), declared_in(html).alias("declared"), bare.alias("_bare"))
    return text_scores(rows, model, ["page_id", "host", "suffix", "declared"], F.col("_bare"))


def identify_documents(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """Per row of ``docs``: doc_id, _key, host, declared, n_grams, lang_id, confidence, text_lang, kept.

    Null texts count as empty and are not kept. Repeated rows get the same answer. An empty
    table gives an empty result; further columns are ignored.
    """
    model = fit(docs, languages)
    with small_batches(docs.sparkSession):
        scores = staged(documents_evidence(docs, model), "language-scores")
    return identify(scores, languages)


def keep_identified(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """The rows of ``docs`` with an accepted language, with the columns of ``docs``."""
    rejected = staged(identify_documents(docs, languages).filter(~F.col("kept")).select("_key").distinct(), "rejected")
    return docs.withColumn("_key", row_key()).join(rejected, "_key", "left_anti").select(*docs.columns)
