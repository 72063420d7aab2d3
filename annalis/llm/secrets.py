"""Secret scan with DataFrame functions only.

Fixed patterns find assignments, access keys and long hex runs. On top, a battery of
randomness tests judges every long token whose characters fit an encoding:

* chi-squared: are all letters of the inferred alphabet equally frequent?
* runs: does the class (lower, upper, digit, other) change as often as in random text?
* serial correlation: is the next character unrelated to the one before?

A token stays only if none of the three rejects randomness (Bonferroni, p >= BATTERY_P).
Then false discoveries are controlled: how far a token lies from ordinary text in
uniformity and runs gives a p-value, bounded by exp(-z*z/2), and in each length class the
Benjamini-Hochberg rule over all tokens of the table picks the discoveries. p-values are
rounded up to steps of P_STEP in log10, so that the rule needs counts per step only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalis.llm.common import text_of
from annalis.session import staged

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a shorter run holds no longer match, so that the length can be asked for at once
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")

#: Alphabets in the order of inference, with the share of adjacent class changes in random text.
ENCODINGS = {
    "hex": ("0123456789abcdef", r"^[0-9a-f]+$"),
    "HEX": ("0123456789ABCDEF", r"^[0-9A-F]+$"),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", r"^[A-Z2-7]+=*$"),
    "base36": ("abcdefghijklmnopqrstuvwxyz0123456789", r"^[a-z0-9]+$"),
    "BASE36": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", r"^[A-Z0-9]+$"),
    "base62": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", r"^[A-Za-z0-9]+=*$"),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", r"^[A-Za-z0-9+/]+=*$"),
    "base64url": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", r"^[A-Za-z0-9_-]+=*$"),
}
#: Words: letters of one case, a capital first, or digits only. They have no encoding.
WORDLIKE = r"^(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[=+/_-]+)$"
BATTERY_P = 0.001
FDR = 0.01
P_STEP = 0.1
#: Sum of squared and cubed letter shares, and share of class changes, of ordinary text.
TEXT_SQUARES, TEXT_CUBES, TEXT_CHANGES = 0.066, 0.0053, 0.15
LENGTH_CLASSES = (32, 48, 64, 128)


def _spans(found: Column, gaps: Column) -> Column:
    """(start, end) of matches from the matches and the text between them, in code points."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    pairs = F.zip_with(found, gaps, lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("size")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        return F.struct((start + x["size"]).alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), (start + x["size"]).alias("end"))).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(F.slice(pairs, 1, F.size(found)), zero, step)["out"]).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def _changes(alphabet: str) -> float:
    sizes = [sum(map(test, alphabet)) / len(alphabet) for test in (str.islower, str.isupper, str.isdigit)]
    return 1 - sum(x * x for x in [*sizes, max(0.0, 1 - sum(sizes))])


def battery(tokens: DataFrame) -> DataFrame:
    """Adds encoding, z_text and random_p to ``tokens`` (token); encoding is null for words."""
    token = F.col("token")
    enc = F.when(token.rlike(WORDLIKE), None)
    for name, (_, pattern) in ENCODINGS.items():
        enc = enc.when(token.rlike(pattern), F.lit(name))
    per = lambda fn: F.create_map(*[x for k, (a, _) in ENCODINGS.items() for x in (F.lit(k), F.lit(fn(a)))])[F.col("encoding")]
    t = tokens.withColumn("encoding", enc).filter("encoding IS NOT NULL").withColumn("_body", F.rtrim(token, F.lit("=")))
    chars = F.filter(F.split("_body", ""), lambda c: c != "")
    kind = lambda c: F.when(c.rlike("[a-z]"), 1).when(c.rlike("[A-Z]"), 2).when(c.rlike("[0-9]"), 3).otherwise(4)
    t = t.withColumn("_alphabet", per(str)).withColumn("_chars", chars).withColumn("_m", F.size(chars).cast("double"))
    t = t.withColumn("_ix", F.transform("_chars", lambda c: F.instr(F.col("_alphabet"), c).cast("double"))).withColumn("_kind", F.transform("_chars", kind))
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    squares = total(F.transform(F.array_distinct("_chars"), lambda c: F.pow(F.size(F.filter("_chars", lambda x: x == c)).cast("double"), 2.0)))
    ahead = lambda c: F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))
    behind = lambda c: F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))
    mean = total(F.col("_ix")) / F.col("_m")
    t = (t.withColumn("_k", per(lambda a: float(len(a)))).withColumn("_r", per(_changes)).withColumn("_mean", mean)
         .withColumn("_chi", F.col("_k") / F.col("_m") * squares - F.col("_m"))
         .withColumn("_moves", total(F.zip_with(behind(F.col("_kind")), ahead(F.col("_kind")), lambda a, b: (a != b).cast("double"))))
         .withColumn("_var", total(F.transform("_ix", lambda x: F.pow(x - F.col("_mean"), 2.0))))
         .withColumn("_cov", total(F.zip_with(behind(F.col("_ix")), ahead(F.col("_ix")), lambda a, b: (a - F.col("_mean")) * (b - F.col("_mean"))))))
    m, k, r = F.col("_m"), F.col("_k"), F.col("_r")
    tail = lambda z: F.least(F.lit(1.0), 2 * F.exp(-z * z / 2))
    chi_z = (F.col("_chi") - (k - 1)) / F.sqrt(2 * (k - 1) * (m - 1) / m)
    runs_z = (F.col("_moves") - (m - 1) * r) / F.sqrt((m - 1) * r * (1 - r))
    serial_z = F.when(F.col("_var") > 0, F.col("_cov") / F.col("_var") * F.sqrt(m) + 1 / F.sqrt(m)).otherwise(F.lit(99.0))
    text_mean = k * (1 + (m - 1) * TEXT_SQUARES) - m
    text_sd = F.sqrt(2 * (k - 1) + 4 * m * k * k * (TEXT_CUBES - TEXT_SQUARES**2))
    away = ((text_mean - F.col("_chi")) / text_sd + (F.col("_moves") - (m - 1) * TEXT_CHANGES) / F.sqrt((m - 1) * TEXT_CHANGES * (1 - TEXT_CHANGES))) / math.sqrt(2)
    t = t.withColumn("random_p", F.least(F.lit(1.0), 3 * F.least(tail(chi_z), tail(runs_z), tail(serial_z)))).withColumn("z_text", F.round(away, 6))
    return t.select(*tokens.columns, "encoding", "random_p", "z_text")


def _length_class(length: Column) -> Column:
    out = F.lit(len(LENGTH_CLASSES))
    for k, most in reversed(list(enumerate(LENGTH_CLASSES))):
        out = F.when(length < most, F.lit(k)).otherwise(out)
    return out


def _p_bin(z: Column) -> Column:
    """Steps of P_STEP in -log10 of the p-value, rounded down: the p-value is rounded up."""
    return F.when(z > 0, F.floor(F.least(z * z / (2 * math.log(10)), F.lit(300.0)) / P_STEP)).otherwise(F.lit(0)).cast("int")


def discoveries(tokens: DataFrame) -> DataFrame:
    """(length_class, least_bin): the Benjamini-Hochberg cut of each length class of ``tokens`` (length_class, p_bin, weight)."""
    steps = tokens.groupBy("length_class", "p_bin").agg(F.sum("weight").alias("n"))  # length classes x 3000 steps at most
    down = Window.partitionBy("length_class").orderBy(F.col("p_bin").desc())
    whole = Window.partitionBy("length_class")
    ranked = steps.withColumn("_i", F.sum("n").over(down)).withColumn("_m", F.sum("n").over(whole))
    good = F.pow(F.lit(10.0), -F.col("p_bin") * P_STEP) <= F.col("_i") / F.col("_m") * FDR
    return ranked.filter(good).groupBy("length_class").agg(F.min("p_bin").alias("least_bin"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, n_random, base, spans.

    ``base`` and ``spans`` are arrays of (start, rank, end), in code points with an exclusive
    end, sorted by start, then kind; rank is the place in KINDS. ``base`` has the spans of the
    fixed patterns, ``spans`` also the random tokens that no base span covers. Null texts
    count as empty; repeated rows give repeated results; an empty table an empty result.
    """
    t = docs.select("doc_id", text_of().alias("_text"))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "random": TOKEN}
    for name, pattern in patterns.items():
        t = t.withColumn(f"_{name}", F.regexp_extract_all("_text", F.lit(pattern), 0))
    t = t.withColumn("_assigned", F.when(F.size("_assign") > 0, F.regexp_extract_all("_text", F.lit(ASSIGN), 2)).otherwise(F.array().cast("array<string>")))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    for name, pattern in patterns.items():
        gaps = F.split("_text", pattern, -1)
        t = t.withColumn(f"_{name}_at", F.when(F.size(f"_{name}") > 0, _spans(F.col(f"_{name}"), gaps)).otherwise(empty))
    ranked = lambda col, rank: F.transform(col, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))
    long_enough = F.transform(F.filter(F.arrays_zip(F.col("_assign_at").alias("at"), F.col("_assigned").alias("value")), lambda x: F.length(x["value"]) >= 12), lambda x: x["at"])
    t = t.select("doc_id", ranked(long_enough, 0).alias("_b0"), ranked(F.col("_access_at"), 1).alias("_b1"), ranked(F.col("_hex_at"), 2).alias("_b2"),
                 F.filter(F.zip_with("_random", "_random_at", lambda s, at: F.struct(s.alias("token"), at["start"].alias("start"), at["end"].alias("end"))), lambda x: ~x["token"].rlike(WORDLIKE)).alias("_cand"))
    t = t.withColumn("base", F.array_sort(F.concat("_b0", "_b1", "_b2"))).withColumn("_row", F.monotonically_increasing_id())
    t = staged(t.select("_row", "doc_id", F.size("_b0").cast("long").alias("n_assign"), F.size("_b1").cast("long").alias("n_access"), F.size("_b2").cast("long").alias("n_hex"), "base", "_cand"), "secret-spans")
    cand = t.filter(F.size("_cand") > 0).select("_row", F.explode("_cand").alias("_c")).select("_row", "_c.*")
    judged = staged(battery(cand).withColumn("length_class", _length_class(F.length("token"))).withColumn("p_bin", _p_bin(F.col("z_text"))).withColumn("weight", F.lit(1).cast("long")), "secret-tokens")
    cuts = discoveries(judged)
    random = (judged.filter(F.col("random_p") >= BATTERY_P).join(F.broadcast(cuts), "length_class").filter("p_bin >= least_bin")  # one row per length class
              .groupBy("_row").agg(F.collect_list(F.struct("start", F.lit(3).alias("rank"), "end")).alias("_extra")))
    out = t.join(random, "_row", "left")
    covered = lambda x: F.exists("base", lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"]))
    extra = F.filter(F.coalesce("_extra", F.array().cast("array<struct<start:int,rank:int,end:int>>")), lambda x: ~covered(x))
    out = out.withColumn("_new", extra)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.size("_new").cast("long").alias("n_random"), "base", F.array_sort(F.concat("base", "_new")).alias("spans"))


def digest_text(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
