"""Counts, strata, weighted series, empirical-Bayes prior and variance decomposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalis import fixed_values as fv
from annalis.functions.scalar import half_even, ratio, reconstruct_denominator
from annalis.operators import order
from annalis.spec import PanelSpec


def counts(df: DataFrame, approval: str, failure: str, dropout: str, size: str) -> DataFrame:
    """Denominator that fits the published rates, and the counts it implies.

    Stage the result before filtering on a computed column: Spark pushes such a filter
    below the projection and would search each denominator twice.
    """
    known = df.where(F.col(dropout).isNotNull())
    with_n = known.withColumn("n_rate", reconstruct_denominator(approval, failure, dropout, size))
    with_use = with_n.withColumn("n_use", F.coalesce(F.col("n_rate").cast("double"), F.col(size).cast("double")))
    return with_use.withColumns(
        {
            "dropouts": half_even(F.col(dropout) * F.col("n_use") / 100),
            "failures": half_even(F.col(failure) * F.col("n_use") / 100),
        }
    )


def stratify(
    df: DataFrame, flag: Column, capital: Column, urban: Column, spec: PanelSpec, out: str = "ESTRATO", ever: str = "INDIG_E"
) -> DataFrame:
    """Four strata; an entity flagged in any year belongs to the first one in all years."""
    flagged = df.withColumn("_flag", flag.cast("double"))
    marked = flagged.withColumn(ever, F.max("_flag").over(Window.partitionBy(spec.entity))).drop("_flag")
    return marked.withColumn(
        out,
        F.when(F.col(ever) == 1, fv.STRATUM_INDIGENOUS)
        .when(capital & urban, fv.STRATUM_CAPITAL)
        .when(urban, fv.STRATUM_URBAN)
        .otherwise(fv.STRATUM_RURAL),
    )


def size_distribution(df: DataFrame, size: str, limits: tuple[int, ...] = (30, 50, 100)) -> DataFrame:
    """Quantiles of the size and share of rows up to each limit, one row."""
    marked = df.withColumn("scope", F.lit("all"))
    shares = marked.groupBy("scope").agg(
        *[F.avg(F.coalesce(F.col(size) <= k, F.lit(False)).cast("double")).alias(f"up_to_{k}") for k in limits]
    )
    probs = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    return shares.join(order.quantiles(marked, ["scope"], size, probs), "scope")


def stratum_shares(df: DataFrame, stratum: str, size: str, by: list[str]) -> DataFrame:
    """Entities, enrolment, median size, drop-outs, shares within ``by`` and weighted rate per stratum."""
    totals = df.groupBy(*by, stratum).agg(
        F.count(F.lit(1)).alias("entities"), F.sum("n_use").alias("enrolment"), F.sum("dropouts").alias("dropouts")
    )
    medians = order.quantiles(df, [*by, stratum], size, {"median_size": 0.5})
    everything = Window.partitionBy(*by)  # over the strata, not over the rows
    return totals.join(medians, [*by, stratum], "left").withColumns(
        {
            "share_entities": ratio(F.col("entities"), F.sum("entities").over(everything)),
            "share_enrolment": ratio(F.col("enrolment"), F.sum("enrolment").over(everything)),
            "share_dropouts": ratio(F.col("dropouts"), F.sum("dropouts").over(everything)),
            "rate": ratio(100 * F.col("dropouts"), F.col("enrolment")),
        }
    )


def weighted_series(df: DataFrame, rate: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("entities"),
        F.sum("n_use").alias("enrolment"),
        F.sum("dropouts").alias("dropouts"),
        ratio(100 * F.sum("dropouts"), F.sum("n_use")).alias("weighted_rate"),
        F.avg(rate).alias("simple_mean"),
    )


def stratum_year_matrix(df: DataFrame, stratum: str, year: str, years: list[int]) -> DataFrame:
    """Weighted rate, one row per stratum and one column per year."""
    cells = df.groupBy(stratum, year).agg(ratio(100 * F.sum("dropouts"), F.sum("n_use")).alias("rate"))
    wide = cells.groupBy(stratum).pivot(year, years).agg(F.first("rate", ignorenulls=True))
    return wide.select(stratum, *[F.col(str(y)).alias(f"y{y}") for y in years])


def denominator_ratio(df: DataFrame, size: str) -> DataFrame:
    """Share of rows with a reconstructed denominator and quantiles of its ratio to the size."""
    marked = df.withColumn("scope", F.lit("all")).withColumn("_ratio", ratio(F.col("n_rate"), F.col(size)))
    share = marked.groupBy("scope").agg(F.avg(F.col("n_rate").isNotNull().cast("double")).alias("reconstructed"))
    probs = {"p05": 0.05, "median": 0.5, "p95": 0.95}
    return share.join(order.quantiles(marked, ["scope"], "_ratio", probs), "scope", "left")


def eb_prior(df: DataFrame, folds: list[int], spec: PanelSpec, out: str = "fold") -> DataFrame:
    """Beta prior by moments for every fold, from the years before it.

    Entity totals for all folds come from one shuffle on the entity; the weighted
    variance is expanded so that no second pass is needed.
    """
    past = df.where(F.col(spec.year) < max(folds))
    totals = past.groupBy(spec.entity).agg(
        *[F.sum(F.when(F.col(spec.year) < f, F.col("dropouts"))).alias(f"_b{f}") for f in folds],
        *[F.sum(F.when(F.col(spec.year) < f, F.col("n_use"))).alias(f"_n{f}") for f in folds],
    )
    per_fold = F.explode(
        F.array(*[F.struct(F.lit(f).alias(out), F.col(f"_b{f}").alias("b"), F.col(f"_n{f}").alias("n")) for f in folds])
    )
    rows = totals.select(per_fold.alias("t")).select("t.*").where(F.col("n") > 0)
    sums = rows.groupBy(out).agg(
        F.sum("b").alias("b"),
        F.sum("n").alias("n"),
        F.sum(F.col("b") * F.col("b") / F.col("n")).alias("b2"),
        F.avg(1 / F.col("n")).alias("mean_inverse"),
    )
    p0 = F.col("b") / F.col("n")
    spread = F.col("b2") / F.col("n") - p0 * p0
    with_tau = sums.withColumn("p0", p0).withColumn(
        "tau2", F.greatest(spread - F.col("p0") * (1 - F.col("p0")) * F.col("mean_inverse"), F.lit(1e-6))
    )
    return with_tau.select(out, "p0", "tau2", (F.col("p0") * (1 - F.col("p0")) / F.col("tau2")).alias("m"))


def eb_score(cum_count: str = "cum_count", cum_size: str = "cum_size") -> Column:
    """Pooled rate shrunk to the prior, in per cent. Needs columns p0 and m of the fold."""
    return ratio(100 * (F.col(cum_count) + F.col("m") * F.col("p0")), F.col(cum_size) + F.col("m"))


def icc_anova(df: DataFrame, c: str, by: list[str], entity: str) -> DataFrame:
    """Intraclass correlation by one-way ANOVA with unequal group sizes."""
    groups = (
        df.where(F.col(c).isNotNull())
        .groupBy(*by, entity)
        .agg(F.count(F.lit(1)).alias("k"), F.sum(c).alias("s"), F.sum(F.col(c) * F.col(c)).alias("q"))
    )
    sums = groups.groupBy(*by).agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("k").alias("rows"),
        F.sum(F.col("k") * F.col("k")).alias("k2"),
        F.sum(F.col("s") * F.col("s") / F.col("k")).alias("between"),
        F.sum("q").alias("total"),
    )
    msb = ratio(F.col("between"), F.col("groups") - 1)
    msw = ratio(F.col("total") - F.col("between"), F.col("rows") - F.col("groups"))
    k0 = ratio(F.col("rows") - F.col("k2") / F.col("rows"), F.col("groups") - 1)
    return sums.select(*by, "groups", "rows", ratio(msb - msw, msb + (k0 - 1) * msw).alias("icc"))


def variance_budget(df: DataFrame, rate: str, spec: PanelSpec) -> DataFrame:
    """Within-year variance split into persistent, binomial and transient parts, one row.

    Half of each entity's own rate and half of the pooled rate set the binomial noise.
    """
    by = ["scope"]
    base = df.where(F.col(rate).isNotNull()).withColumn("scope", F.lit("all"))
    yearly = base.groupBy(*by, spec.year).agg(F.avg(rate).alias("_year_mean"))
    pooled = base.groupBy(*by).agg(ratio(F.sum("dropouts"), F.sum("n_use")).alias("_pool"))
    entity = Window.partitionBy(spec.entity)
    own = ratio(F.sum("dropouts").over(entity), F.sum("n_use").over(entity))
    rows = (
        base.join(F.broadcast(yearly), [*by, spec.year])  # one row per year
        .join(F.broadcast(pooled), by)  # one row
        .withColumns({"centred": F.col(rate) - F.col("_year_mean"), "p": 0.5 * own + 0.5 * F.col("_pool")})
        .withColumn("noise", F.col("p") * (1 - F.col("p")) / F.col("n_use") * 1e4)
    )
    sums = rows.groupBy(*by).agg(
        F.var_samp("centred").alias("variance"),
        F.avg("noise").alias("_noise"),
        F.avg((F.col(rate) == 0).cast("double")).alias("zeros_observed"),
        F.avg(F.pow(1 - F.col("p"), F.col("n_use"))).alias("zeros_expected"),
    )
    medians = order.column_quantiles(rows, by, ["noise", "n_use"], {"median": 0.5}).groupBy(*by).agg(
        F.max(F.when(F.col("column") == "noise", F.col("median"))).alias("_noise_median"),
        F.max(F.when(F.col("column") == "n_use", F.col("median"))).alias("_size_median"),
    )
    icc = icc_anova(rows, "centred", by, spec.entity).select(*by, "icc")
    binomial = ratio(F.col("_noise"), F.col("variance"))
    return (
        sums.join(icc, by)
        .join(medians, by)
        .select(
            "variance",
            "icc",
            binomial.alias("binomial"),
            (1 - F.col("icc") - binomial).alias("transient"),
            F.sqrt("_noise_median").alias("noise_sd_median"),
            ratio(F.lit(100), F.col("_size_median")).alias("one_person_points"),
            "zeros_observed",
            "zeros_expected",
        )
    )


def persistent_zeros(df: DataFrame, rate: str, years: int, spec: PanelSpec) -> DataFrame:
    """Entities with all years, those with zero in all of them, and the number expected by chance."""
    known = df.where(F.col(rate).isNotNull())
    zero = (F.col(rate) == 0).cast("int")
    entities = known.groupBy(spec.entity).agg(F.count(F.lit(1)).alias("rows"), F.sum(zero).alias("zeros"))
    full = F.col("rows") == years
    return entities.agg(
        F.sum(full.cast("bigint")).alias("entities"),
        F.sum((full & (F.col("zeros") == years)).cast("bigint")).alias("always_zero"),
        (F.sum(full.cast("bigint")) * F.pow(ratio(F.sum("zeros"), F.sum("rows")), F.lit(years))).alias("expected"),
    )


def year_pairs(df: DataFrame, rate: str, spec: PanelSpec) -> DataFrame:
    """Both values of every two years of an entity. An entity has one row per year,
    so it gives at most years x (years - 1) / 2 rows."""
    known = df.where(F.col(rate).isNotNull())
    history = known.groupBy(spec.entity).agg(
        F.sort_array(F.collect_list(F.struct(F.col(spec.year).alias("y"), F.col(rate).alias("v")))).alias("h")
    )
    first = history.select(spec.entity, "h", F.posexplode("h").alias("i", "a"))
    both = first.select(spec.entity, "a", F.explode(F.slice("h", F.col("i") + 2, F.size("h"))).alias("b"))
    return both.select(
        spec.entity, F.col("a.y").alias("year_1"), F.col("b.y").alias("year_2"), F.col("a.v").alias("v1"), F.col("b.v").alias("v2")
    )


def spearman_year_matrix(df: DataFrame, rate: str, spec: PanelSpec, min_rows: int = 30) -> DataFrame:
    """Rank correlation between every two years over the entities known in both."""
    return order.spearman(year_pairs(df, rate, spec), ["year_1", "year_2"], "v1", "v2", min_rows=min_rows)


def spearman_by_lag(matrix: DataFrame, lags: list[int], first_year: int) -> DataFrame:
    lag = F.col("year_2") - F.col("year_1")
    return (
        matrix.where(F.col("year_1") >= first_year)
        .groupBy(lag.alias("lag"))
        .agg(F.avg("spearman").alias("mean_spearman"))
        .where(F.col("lag").isin(lags))
    )


def pareto_cut(df: DataFrame, by: list[str], count: str, shares: list[float]) -> DataFrame:
    """How many entities, largest first, reach each share of the total.

    Equal counts are handled together by arithmetic, so no entity list is sorted.
    """
    counted = order.tally(df, by, count).withColumn("w", F.col("n") * F.col(count))
    runs = order.running_totals(counted, by, count, ["n", "w"], descending=True)
    out = []
    for share in shares:
        room = F.lit(share) * F.col("all_w") - F.col("before_w")
        below = F.when(F.col(count) > 0, F.ceil(room / F.nullif(F.col(count), F.lit(0))) - 1)
        below = F.when(room <= 0, 0).otherwise(F.coalesce(below, F.col("n")))
        within = F.greatest(F.lit(0), F.least(F.col("n"), below))
        out.append((F.sum(within) + 1).cast("bigint").alias(f"reach_{int(round(share * 100))}"))
    return runs.groupBy(*by).agg(F.sum("w").alias("total"), F.sum("n").cast("bigint").alias("entities"), *out)
