"""Priority lists: top-K sets, capture, recall, quotas and error concentration.

Lists are limited to K rows inside every task before the shuffle (see ``order.top_k``).
The totals they are compared with come from plain grouped aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from annalis import fixed_values as fv
from annalis.functions.scalar import ratio
from annalis.operators import order


def recall_at_k(
    scored: DataFrame, by: list[str], score: str, label: str, ties: list[str], ks: list[int] | None = None
) -> DataFrame:
    """Hits, precision, recall, random recall and lift of the first K rows, for every K up to the group size."""
    ks = ks or fv.LIST_SIZES
    totals = scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("positives"))
    best = order.top_k(scored.select(*by, score, label, *ties), by, score, max(ks), ties)
    sizes = F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("position"))
    hits = best.select(*by, label, F.explode(sizes).alias("k")).groupBy(*by, "k").agg(F.sum(label).alias("hits"))
    return (
        hits.join(totals, by)
        .where(F.col("k") <= F.col("n"))
        .select(
            *by,
            "k",
            ratio(F.col("k"), F.col("n")).alias("list_share"),
            "hits",
            ratio(F.col("hits"), F.col("k")).alias("precision_at_k"),
            ratio(F.col("hits"), F.col("positives")).alias("recall_at_k"),
            ratio(F.col("k"), F.col("n")).alias("random_recall"),
            ratio(F.col("hits") * F.col("n"), F.col("k") * F.col("positives")).alias("lift"),
        )
    )


def list_summary(chosen: DataFrame, everyone: DataFrame, by: list[str], group: list[str], count: str, size: str, special: str) -> DataFrame:
    """Captured share of the counts, median size and number of special rows of each list.

    ``chosen`` is a set of lists keyed by ``by`` with at most K rows each, ``group`` are
    the keys of the population that a list was drawn from.
    """
    totals = everyone.groupBy(*group).agg(F.sum(count).alias("_total"))
    picked = chosen.groupBy(*by).agg(
        F.sum(count).alias("captured"),
        F.median(F.col(size).cast("double")).alias("median_size"),
        F.sum((F.coalesce(F.col(special), F.lit(0)) == 1).cast("bigint")).alias("special"),
    )
    return picked.join(totals, group).withColumn("capture", ratio(F.col("captured"), F.col("_total"))).drop("_total")


def topk_overlap(a: DataFrame, b: DataFrame, keys: list[str], entity: str, k: int) -> DataFrame:
    """Shared entities of two sets of lists over K; lists without a shared entity give 0."""
    both = a.select(*keys, entity).join(b.select(*keys, entity), [*keys, entity]).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    lists = a.select(*keys).distinct()
    return lists.join(both, keys, "left").select(*keys, ratio(F.coalesce(F.col("_n"), F.lit(0)), F.lit(k)).alias("overlap"))


def oracle_and_random(df: DataFrame, by: list[str], rate: str, count: str, size: str, special: str, ties: list[str], k: int) -> DataFrame:
    """Best possible lists by true rate and by true count, and the expectation of a random list."""
    parts = []
    for name, c in (("oracle by rate", rate), ("oracle by count", count)):
        best = order.top_k(df, by, c, k, ties)
        parts.append(list_summary(best, df, by, by, count, size, special).select(*by, F.lit(name).alias("rule"), "capture", "median_size", "special"))
    random = df.groupBy(*by).agg(ratio(F.lit(k), F.count(F.lit(1))).alias("capture"))
    random = random.select(
        *by, F.lit("random").alias("rule"), "capture", F.lit(None).cast("double").alias("median_size"), F.lit(None).cast("bigint").alias("special")
    )
    return parts[0].unionByName(parts[1]).unionByName(random)


def special_capture(chosen: DataFrame, everyone: DataFrame, by: list[str], group: list[str], count: str, special: str) -> DataFrame:
    """Share of the special rows' counts that a list captures."""
    flagged = F.coalesce(F.col(special), F.lit(0)) == 1
    total = everyone.groupBy(*group).agg(F.sum(F.when(flagged, F.col(count))).alias("_t"))
    hit = chosen.groupBy(*by).agg(F.coalesce(F.sum(F.when(flagged, F.col(count))), F.lit(0)).alias("_h"))
    return hit.join(total, group).select(*by, ratio(F.col("_h"), F.col("_t")).alias("special_capture"))


def frontier_summary(chosen: DataFrame, everyone: DataFrame, by: list[str], group: list[str], count: str, size: str, special: str, stratum: str, capital: str) -> DataFrame:
    base = list_summary(chosen, everyone, by, group, count, size, special)
    capitals = chosen.groupBy(*by).agg(F.sum((F.col(stratum) == capital).cast("bigint")).alias("capital"))
    extra = special_capture(chosen, everyone, by, group, count, special)
    return base.join(extra, by).join(capitals, by).select(*by, "capture", "special_capture", "special", "capital", "median_size")


def rate_count_lists(df: DataFrame, by: list[str], score: str, size: str, powers: list[float], k: int, ties: list[str]) -> DataFrame:
    """Lists ranked by score x size^power, one list per power."""
    per_power = df.withColumn("power", F.explode(F.array(*[F.lit(float(p)) for p in powers])))
    ranked = per_power.withColumn("_score", F.round(F.col(score) * F.pow(F.col(size), F.col("power")), 9))
    return order.top_k(ranked, [*by, "power"], "_score", k, ties)


def quota_seats(df: DataFrame, by: list[str], stratum: str, expected: str, k: int) -> DataFrame:
    """Seats per stratum by largest remainder, for three weightings of the strata.

    The windows run over the strata of one group, not over the rows.
    """
    sizes = df.groupBy(*by, stratum).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.sum(expected).alias("_e"))
    weightings = F.array(
        F.struct(F.lit("entities").alias("weighting"), F.col("_n").alias("w")),
        F.struct(F.lit("expected").alias("weighting"), F.col("_e").alias("w")),
        F.struct(F.lit("root").alias("weighting"), F.sqrt(F.col("_n") * F.col("_e")).alias("w")),
    )
    long = sizes.select(*by, stratum, F.explode(weightings).alias("x")).select(*by, stratum, "x.*")
    group = Window.partitionBy(*by, "weighting")
    shares = long.withColumn("_q", F.round(ratio(F.col("w"), F.sum("w").over(group)) * k, 9)).withColumn("_floor", F.floor("_q"))
    rest = F.row_number().over(group.orderBy((F.col("_q") - F.col("_floor")).desc(), F.col(stratum)))
    left = F.lit(k) - F.sum("_floor").over(group)
    return shares.withColumn("_rest", rest).select(
        *by, "weighting", stratum, (F.col("_floor") + F.when(F.col("_rest") <= left, 1).otherwise(0)).cast("int").alias("seats")
    )


def stratum_quota(df: DataFrame, by: list[str], stratum: str, expected: str, k: int, ties: list[str]) -> DataFrame:
    """First rows of every stratum by expected count, as many as the stratum has seats."""
    seats = quota_seats(df, by, stratum, expected, k)
    best = order.top_k(df, [*by, stratum], expected, k, ties)  # no stratum can have more than k seats
    return best.join(seats, [*by, stratum]).where(F.col("position") <= F.col("seats"))


def error_concentration(df: DataFrame, by: list[str], error: Column, fractions: list[float]) -> DataFrame:
    """Share of the squared error in the worst fraction of the rows (at least one row)."""
    squared = df.withColumn("_sq", F.round(error * error, 9))
    counted = order.tally(squared, by, "_sq").withColumn("w", F.col("n") * F.col("_sq"))
    runs = order.running_totals(counted, by, "_sq", ["n", "w"], descending=True)
    cells = []
    for f in fractions:
        worst = F.greatest(F.lit(1), F.floor(F.col("all_n") * F.lit(f)))
        taken = F.greatest(F.lit(0), F.least(F.col("n"), worst - F.col("before_n")))
        cells.append(ratio(F.sum(taken * F.col("_sq")), F.max("all_w")).alias(f"worst_{int(round(f * 100))}"))
    return runs.groupBy(*by).agg(*cells)


def regression_to_mean(df: DataFrame, by: list[str], rate: str, next_rate: str, k: int, ties: list[str]) -> DataFrame:
    """Mean of the top-K list this year and next year against everyone, and how many fell."""
    top = order.top_k(df, by, rate, k, ties).groupBy(*by).agg(
        F.avg(rate).alias("top_now"),
        F.avg(next_rate).alias("top_next"),
        F.sum((F.col(next_rate) < F.col(rate)).cast("bigint")).alias("fell"),
    )
    everyone = df.groupBy(*by).agg(F.avg(rate).alias("all_now"), F.avg(next_rate).alias("all_next"))
    return top.join(everyone, by)


def rate_vs_count_lists(df: DataFrame, by: list[str], rate: str, count: str, size: str, special: str, ties: list[str], k: int) -> DataFrame:
    parts = []
    for name, c in (("rate", rate), ("count", count)):
        best = order.top_k(df, by, c, k, ties)
        parts.append(list_summary(best, df, by, by, count, size, special).select(*by, F.lit(name).alias("list"), "captured", "capture", "median_size", "special"))
    return parts[0].unionByName(parts[1])
