"""Queries of the operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalis.llm import align, chat, exact_dedup, langid, mixing, neighbours, ngram_join, packing, phrases, quality, secrets, substring, warc
from annalis.session import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle.strip()
        return fn

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(documents(spark, sf_dir)).drop("_key")


@query()
def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over raw pages, which have markup, hosts and suffixes."""
    model = langid.fit(documents(spark, sf_dir))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return langid.identify(staged(langid.pages_evidence(pages, model), "page-scores"))


@query()
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(documents(spark, sf_dir))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.digest_text(F.col("base")), 256).alias("base_sha256"), secrets.digest_text(F.col("spans")).alias("spans"), "n_random")


@query("""
WITH RECURSIVE lists AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM lists WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM both_ JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * c >= 80 * (s.n + t.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM reach r JOIN edges e ON e.x = r.b)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = d.doc_id
""")
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


@query(r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(role) + length(text) + (length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', '')))
    + (length(role) - length(replace(replace(replace(replace(role, '\', ''), '#', ''), '<', ''), ':', ''))) + 14 AS n,
    row_number() OVER w - 1 AS pos, coalesce(lag(role) OVER w, '') AS prev FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
judged AS (SELECT *, CASE WHEN pos = 0 THEN role IN ('system', 'user') WHEN prev IN ('system', 'assistant') THEN role = 'user' WHEN prev = 'user' THEN role = 'assistant' ELSE false END AS allowed FROM sized)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars, min(pos) FILTER (WHERE NOT allowed) AS first_violation
FROM judged GROUP BY conv_id
""")
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    out = chat.format_chats(rows.unionByName(probe)).withColumn("_turns", chat.read_turns(F.col("formatted"))).withColumn("_loss", chat.learned_text(F.col("segments")))
    lines = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("_loss").cast("long").alias("loss_chars"),
                      F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), F.col("first_violation").cast("long").alias("first_violation"))


@query("""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""")
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir), keep="largest").drop("_key")


@query()
def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.serialised(warc.derivatives(warc.responses(spark.read.parquet(f"{sf_dir}/pages.parquet"))))
    return made.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "content_type", F.col("headers")["WARC-Source-Payload-Digest"].alias("source_digest"),
                       F.col("headers")["WARC-Block-Digest"].alias("block_digest"), F.octet_length("block").cast("long").alias("block_bytes"), F.sha2("record", 256).alias("record_sha256"))


@query()
def op7_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


@query()
def op8_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


@query("""
WITH lists AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM lists WHERE len(w) >= 50)),
late AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS low FROM starts) WHERE low < doc_id),
cut AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM late),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM lists WHERE len(w) > 0),
kept AS (SELECT words.doc_id, string_agg(x, ' ' ORDER BY words.i) FILTER (WHERE cut.i IS NULL) AS t, count(cut.i) AS n FROM words LEFT JOIN cut ON cut.doc_id = words.doc_id AND cut.i = words.i GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM lists LEFT JOIN kept USING (doc_id)
""")
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(documents(spark, sf_dir))


@query()
def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(documents(spark, sf_dir))


@query()
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(documents(spark, sf_dir))


@query(r"""
WITH lists AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, p, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, doc_id, unnest(pieces) AS piece, unnest(range(len(pieces))) AS p
        FROM (SELECT lang, doc_id, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents))),
words AS (SELECT lang, doc_id, p, unnest(w) AS x, unnest(range(len(w))) AS i FROM lists WHERE len(w) > 0),
next_ AS (SELECT lang, x, lead(x, 1) OVER g AS y, lead(x, 2) OVER g AS z FROM words WINDOW g AS (PARTITION BY doc_id, p ORDER BY i)),
grams AS (
  SELECT lang, 1 AS size, x AS phrase, count(*) AS f FROM next_ GROUP BY ALL
  UNION ALL SELECT lang, 2, x || ' ' || y, count(*) FROM next_ WHERE y IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z, count(*) FROM next_ WHERE z IS NOT NULL GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE size = 1 GROUP BY lang),
found AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE size > 1 AND f >= 10),
cuts AS (SELECT lang, phrase, size, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM found, (VALUES (1), (2)) v(k) WHERE k < size),
scored AS (
  SELECT c.lang, c.phrase, c.size, c.a, c.k, g.f AS l, h.f AS r, CAST((1000000::HUGEINT * c.a * c.a) // (g.f::HUGEINT * h.f) AS BIGINT) AS score
  FROM cuts c JOIN grams g ON g.lang = c.lang AND g.phrase = c.x JOIN grams h ON h.lang = c.lang AND h.phrase = c.y),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, array_to_string(w[j:j + 1], ' ') AS phrase, max(a) AS f FROM found, (VALUES (1), (2)) v(j) WHERE size = 3 GROUP BY ALL),
kept AS (SELECT s.* FROM lowest s LEFT JOIN longer q ON q.lang = s.lang AND q.phrase = s.phrase WHERE s.size = 3 OR q.f IS NULL OR 100 * q.f < 50 * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""")
def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


@query()
def op13_neighbour_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return neighbours.score(docs, neighbours.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
