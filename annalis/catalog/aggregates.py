"""Queries of the aggregate operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalis.catalog import adapters as ad
from annalis.catalog.adapters import FOLDS, GRADES, SPEC, YEARS
from annalis.catalog.registry import CTES, query
from annalis.operators import order, profile, structure
from annalis.session import staged
from annalis.spec import PanelSpec

NUMERIC = ["ap", "rp", "ab", "ap_f", "rp_f", "ab_f", "ab_o", "tdi", "atu", "enrolment"]
TARGETS = ["ab_T1", "ab_f_T1", "ab_o_T1"]
ITEM = PanelSpec(entity="l_orderkey", year="year")


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def union_sql(cols, template, sep="\nUNION ALL\n"):
    return sep.join(template.format(c=c) for c in cols)


def items(spark, sf):
    return ad.read(spark, sf, "lineitem").withColumn("year", F.year("l_shipdate"))


@query("a1_rows_per_year", """SELECT CAST(year(l_shipdate) AS INT) AS year, count(*) AS rows, count(DISTINCT l_orderkey) AS entities,
    count(*) - count(DISTINCT l_orderkey) AS repeated FROM lineitem GROUP BY 1""")
def rows_per_year(spark, sf):
    return profile.rows_per_year(items(spark, sf).select("year", "l_orderkey"), ITEM)


@query("a2_duplicate_sample", """SELECT year, l_orderkey, rows, varying, position FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY year ORDER BY rows DESC, l_orderkey) AS INT) AS position FROM (
      SELECT CAST(year(l_shipdate) AS INT) AS year, l_orderkey, count(*) AS rows,
        concat_ws(',', CASE WHEN min(l_returnflag) < max(l_returnflag) THEN 'l_returnflag' END, CASE WHEN min(l_linestatus) < max(l_linestatus) THEN 'l_linestatus' END,
          CASE WHEN min(l_suppkey) < max(l_suppkey) THEN 'l_suppkey' END) AS varying
      FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)) WHERE position <= 3""")
def duplicate_sample(spark, sf):
    return profile.duplicate_sample(items(spark, sf), ["l_returnflag", "l_linestatus", "l_suppkey"], ITEM)


@query("a3_coverage_by_year", f"""SELECT year, count(*) AS rows, round(100.0 * sum({" + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in ad.RATES)}) / (count(*) * 9), 1) AS coverage
    FROM sp GROUP BY 1""")
def coverage_by_year(spark, sf):
    return profile.coverage_by_year(ad.supplier_panel(spark, sf), ad.RATES, SPEC)


TRIPLES = [["ap", "rp", "ab"], ["ap_f", "rp_f", "ab_f"], ["ap_o", "rp_o", "ab_o"]]
TOTALS = {"ap": ["ap_f", "ap_o"], "rp": ["rp_f", "rp_o"], "ab": ["ab_f", "ab_o"]}
SQL_OFF = " + ".join(f"CASE WHEN abs({a} + {b} + {c} - 100) > 0.05 THEN 1 ELSE 0 END" for a, b, c in TRIPLES)
SQL_OFF_02 = " + ".join(f"CASE WHEN abs({a} + {b} + {c} - 100.0) > 0.2 THEN 1 ELSE 0 END" for a, b, c in TRIPLES)
SQL_OUT = " + ".join(f"CASE WHEN {t} < least({a}, {b}) - 0.15 OR {t} > greatest({a}, {b}) + 0.15 THEN 1 ELSE 0 END" for t, (a, b) in TOTALS.items())


@query("a4_sum_to_100", f"SELECT year, CAST(sum({SQL_OFF_02}) AS BIGINT) AS off_total, CAST(sum({SQL_OFF}) AS BIGINT) AS off_total_tight FROM sp GROUP BY 1")
def sum_to_100(spark, sf):
    tight = [profile.off_total(t, tol=0.05) for t in TRIPLES]
    p = ad.supplier_panel(spark, sf)
    strict = p.groupBy("year").agg(F.sum(tight[0] + tight[1] + tight[2]).alias("off_total_tight"))
    return profile.sum_to_100(p, TRIPLES, SPEC).join(strict, "year")


@query("a5_total_within_components", f"SELECT year, CAST(sum({SQL_OUT}) AS BIGINT) AS outside FROM sp GROUP BY 1")
def total_within_components(spark, sf):
    return profile.total_within_components(ad.supplier_panel(spark, sf), TOTALS, SPEC)


@query("a6_year_summary", f"""SELECT year, count(*) AS rows, count(ab_f) AS known_ab_f, count(ab_o) AS known_ab_o, round(avg(ab_f), 6) AS mean_ab_f, round(avg(ab_o), 6) AS mean_ab_o,
    count(ab_f_T1) AS targets, CAST(sum({SQL_OFF_02}) AS BIGINT) AS off_total, CAST(sum({SQL_OUT}) AS BIGINT) AS outside FROM lp GROUP BY 1""")
def year_summary(spark, sf):
    out = profile.year_summary(ad.longitudinal_panel(spark, sf), ["ab_f", "ab_o"], "ab_f_T1", TRIPLES, TOTALS, SPEC)
    return rounded(out, "mean_ab_f", "mean_ab_o")


@query("a7_category_counts", "SELECT dependency, count(*) AS rows FROM sp WHERE dependency IS NOT NULL GROUP BY 1")
def category_counts(spark, sf):
    return profile.category_counts(ad.supplier_panel(spark, sf), "dependency")


@query("a7_category_counts_top", "SELECT ab, count(*) AS rows FROM sp GROUP BY 1 ORDER BY rows DESC, ab NULLS FIRST LIMIT 10")
def category_counts_top(spark, sf):
    return profile.category_counts(ad.supplier_panel(spark, sf), "ab", keep_null=True, top=10)


DIST = """SELECT target_year, '{c}' AS "column", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, max({c}) AS max,
    round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS p75, round(quantile_cont({c}, 0.1), 6) AS p10, round(quantile_cont({c}, 0.9), 6) AS p90
    FROM lp WHERE target_year IS NOT NULL GROUP BY 1"""


@query("a8_target_distribution", union_sql(TARGETS, DIST))
def target_distribution(spark, sf):
    probs = {"median": 0.5, "p75": 0.75, "p10": 0.1, "p90": 0.9}
    out = profile.target_distribution(ad.staged_longitudinal(spark, sf), ["target_year"], TARGETS, probs)
    return rounded(out, "mean", "sd", *probs)


DESC = """SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
    count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS p25,
    round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS p75 FROM sp"""


@query("a9_describe", union_sql(NUMERIC, DESC))
def describe(spark, sf):
    return rounded(profile.describe(ad.staged_supplier(spark, sf), NUMERIC), "mean", "sd", "p25", "p50", "p75")


NULLS_COLS = {"entity": "bigint", "year": "int", "ab": "double", "ab_f": "double", "ab_o": "double", "ab_LAG1": "double", "ab_f_T1": "double", "target_year": "int"}


@query("a10_null_profile", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) - count({c}) AS nulls, round(100.0 * (count(*) - count({c})) / count(*), 1) AS null_pct FROM lp""" for c, t in NULLS_COLS.items()))
def null_profile(spark, sf):
    return profile.null_profile(ad.longitudinal_panel(spark, sf).select(*NULLS_COLS))


@query("a11_constant_columns", """WITH v AS (SELECT 'public' AS "column", CAST(public AS VARCHAR) AS value FROM st UNION ALL SELECT 'special', CAST(special AS VARCHAR) FROM st
    UNION ALL SELECT 'one', '1' FROM st),
    c AS (SELECT "column", value, count(*) AS n FROM v GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS p FROM c)
    SELECT "column", count(value) AS distinct_values, CASE WHEN count(value) <= 1 THEN 'constant' ELSE 'near-constant' END AS kind,
    string_agg(CASE WHEN p <= 3 THEN coalesce(value, 'NULL') || '=' || CAST(n AS VARCHAR) END, ';' ORDER BY p) AS top_values FROM r GROUP BY 1""")
def constant_columns(spark, sf):
    p = staged(ad.strata_panel(spark, sf), "strata").withColumn("one", F.lit(1))
    return profile.constant_columns(p.select("entity", "year", "town", "dependency", "ab", "public", "special", "one", "enrolment"))


@query("a12_group_target_table", "\nUNION ALL\n".join(
    f"""SELECT CAST({b} AS VARCHAR) AS level, '{b}' AS grouping_column, '{c}' AS "column", count({c}) AS n, round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.5), 6) AS median, max({c}) AS max
    FROM lp GROUP BY 1""" for b in ("public", "location", "dependency") for c in TARGETS))
def group_target_table(spark, sf):
    p = ad.staged_longitudinal(spark, sf)
    groups = F.array(*[F.struct(F.lit(b).alias("grouping_column"), F.col(b).cast("string").alias("level")) for b in ("public", "location", "dependency")])
    long = p.select(F.explode(groups).alias("g"), *TARGETS).select("g.*", *TARGETS)
    out = profile.target_distribution(long, ["grouping_column", "level"], TARGETS, {"median": 0.5})
    return rounded(out.drop("sd"), "mean", "median")


@query("a13_iqr_outliers", """WITH v AS (""" + union_sql(NUMERIC, """SELECT '{c}' AS "column", CAST({c} AS DOUBLE) AS value FROM sp WHERE {c} IS NOT NULL""") + """),
    q AS (SELECT "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM v GROUP BY 1),
    f AS (SELECT "column", q1 - 0.5 * (q3 - q1) AS low, q3 + 0.5 * (q3 - q1) AS high FROM q)
    SELECT "column", CAST(sum(CASE WHEN value < low OR value > high THEN 1 ELSE 0 END) AS BIGINT) AS outliers, round(100.0 * sum(CASE WHEN value < low OR value > high THEN 1 ELSE 0 END) / count(*), 2) AS outlier_pct,
    round(any_value(low), 6) AS low, round(any_value(high), 6) AS high FROM v JOIN f USING ("column") GROUP BY 1 HAVING sum(CASE WHEN value < low OR value > high THEN 1 ELSE 0 END) > 0""")
def iqr_outliers(spark, sf):
    return rounded(profile.iqr_outliers(ad.staged_supplier(spark, sf), NUMERIC, k=0.5), "low", "high")


@query("a14_pearson_with_targets", union_sql(NUMERIC, """SELECT '{c}' AS "column", round(corr({c}, ab_T1), 6) AS ab_T1, round(corr({c}, ab_f_T1), 6) AS ab_f_T1, round(corr({c}, ab_o_T1), 6) AS ab_o_T1 FROM lp"""))
def pearson(spark, sf):
    return rounded(profile.pearson_with_targets(ad.longitudinal_panel(spark, sf), NUMERIC, TARGETS), *TARGETS)


LEAK_COLS = ["ap", "ab", "ab_f", "ab_o", "copy_T1", "ab_f_T1"]


@query("a15_leak_candidates", "SELECT * FROM (\n" + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", '{t}' AS target, '{c}' <> '{t}' AND list_has_all(string_split('{t}', '_'), string_split('{c}', '_')) AS by_name,
    coalesce(abs(corr({"ab_T1 * 2" if c == "copy_T1" else c}, {t})) > 0.95, false) AS by_corr FROM lp""" for c in LEAK_COLS for t in TARGETS) + "\n) WHERE by_name OR by_corr")
def leak_candidates(spark, sf):
    p = ad.longitudinal_panel(spark, sf).withColumn("copy_T1", F.col("ab_T1") * 2)
    return profile.leak_candidates(p, LEAK_COLS, TARGETS)


@query("a16_duplicate_rows", """SELECT (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS repeated_rows,
    (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS repeated_keys""")
def duplicate_rows(spark, sf):
    return profile.duplicate_rows(ad.read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


CRITICAL = ["ap", "rp", "ab", "ap_f", "rp_f", "ab_f", "ap_o", "rp_o", "ab_o", "tdi", "atu", "ab_LAG1"]


@query("a17_critical_coverage", f"""SELECT target_year, {", ".join(f"round(avg(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END), 3) AS {c}" for c in CRITICAL)} FROM lp WHERE target_year IS NOT NULL GROUP BY 1""")
def critical_coverage(spark, sf):
    return profile.coverage_by_group(ad.longitudinal_panel(spark, sf), "target_year", CRITICAL)


@query("a18_panel_balance", "SELECT years, count(*) AS entities FROM (SELECT entity, count(DISTINCT year) AS years FROM cp GROUP BY 1) GROUP BY 1")
def panel_balance(spark, sf):
    return profile.panel_balance(ad.customer_panel(spark, sf), SPEC)


CTES["cl"] = """SELECT p.*, CASE WHEN nx.entity IS NOT NULL THEN CAST(p.year + 1 AS INT) END AS target_year
FROM cp p LEFT JOIN cp nx ON nx.entity = p.entity AND nx.year = p.year + 1"""


def customer_targets(spark, sf):
    from annalis.operators import shifts

    return ad.customer_panel(spark, sf).withColumn("target_year", shifts.target_year(SPEC))


@query("a19_year_target_pairs", """SELECT p.year, p.target_year, p.rows, e.target_entities FROM (SELECT year, target_year, count(*) AS rows FROM cl GROUP BY 1, 2) p
    LEFT JOIN (SELECT target_year, count(DISTINCT entity) AS target_entities FROM cl WHERE target_year IS NOT NULL GROUP BY 1) e USING (target_year)""")
def year_target_pairs(spark, sf):
    return profile.year_target_pairs(customer_targets(spark, sf), "target_year", SPEC)


@query("a20_mean_median_by_year", union_sql(["ab_f", "ab_o"], """SELECT year, '{c}' AS "column", round(avg({c}), 8) AS mean, round(quantile_cont({c}, 0.5), 8) AS median FROM sp WHERE public = 1 GROUP BY 1"""))
def mean_median(spark, sf):
    p = ad.staged_supplier(spark, sf).where(F.col("public") == 1)
    return rounded(profile.mean_median_by(p, ["year"], ["ab_f", "ab_o"]), "mean", "median", digits=8)


@query("a21_size_distribution", """SELECT 'all' AS scope, round(avg(CASE WHEN enrolment <= 30 THEN 1 ELSE 0 END), 6) AS up_to_30, round(avg(CASE WHEN enrolment <= 50 THEN 1 ELSE 0 END), 6) AS up_to_50,
    round(avg(CASE WHEN enrolment <= 100 THEN 1 ELSE 0 END), 6) AS up_to_100, """ + ", ".join(f"round(quantile_cont(CAST(enrolment AS DOUBLE), {q}), 6) AS {n}" for n, q in
    (("p10", .1), ("p25", .25), ("p50", .5), ("p75", .75), ("p90", .9))) + " FROM ct")
def size_distribution(spark, sf):
    out = structure.size_distribution(ad.staged_counts(spark, sf), "enrolment")
    return rounded(out, "up_to_30", "up_to_50", "up_to_100", "p10", "p25", "p50", "p75", "p90")


@query("a22_stratum_shares", """SELECT year, stratum, count(*) AS entities, sum(n_use) AS enrolment, sum(dropouts) AS dropouts, round(quantile_cont(CAST(enrolment AS DOUBLE), 0.5), 6) AS median_size,
    round(count(*) / sum(count(*)) OVER (PARTITION BY year), 6) AS share_entities, round(sum(n_use) / sum(sum(n_use)) OVER (PARTITION BY year), 6) AS share_enrolment,
    round(sum(dropouts) / sum(sum(dropouts)) OVER (PARTITION BY year), 6) AS share_dropouts, round(100 * sum(dropouts) / sum(n_use), 6) AS rate
    FROM ct GROUP BY 1, 2""")
def stratum_shares(spark, sf):
    out = structure.stratum_shares(ad.staged_counts(spark, sf), "stratum", "enrolment", ["year"])
    return rounded(out, "median_size", "share_entities", "share_enrolment", "share_dropouts", "rate")


@query("a23_weighted_series", """SELECT year, count(*) AS entities, sum(n_use) AS enrolment, sum(dropouts) AS dropouts, round(100 * sum(dropouts) / sum(n_use), 6) AS weighted_rate, round(avg(ab), 6) AS simple_mean
    FROM ct GROUP BY 1""")
def weighted_series(spark, sf):
    return rounded(structure.weighted_series(ad.counts_panel(spark, sf), "ab", ["year"]), "weighted_rate", "simple_mean")


@query("a24_stratum_year_matrix", "SELECT stratum, " + ", ".join(f"round(100 * sum(dropouts) FILTER (WHERE year = {y}) / sum(n_use) FILTER (WHERE year = {y}), 6) AS y{y}" for y in YEARS) + " FROM ct GROUP BY 1")
def stratum_year_matrix(spark, sf):
    out = structure.stratum_year_matrix(ad.counts_panel(spark, sf), "stratum", "year", YEARS)
    return rounded(out, *[f"y{y}" for y in YEARS])


@query("a25_denominator_ratio", """SELECT 'all' AS scope, round(avg(CASE WHEN n_rate IS NULL THEN 0 ELSE 1 END), 6) AS reconstructed, round(quantile_cont(CAST(n_rate AS DOUBLE) / enrolment, 0.05), 6) AS p05,
    round(quantile_cont(CAST(n_rate AS DOUBLE) / enrolment, 0.5), 6) AS median, round(quantile_cont(CAST(n_rate AS DOUBLE) / enrolment, 0.95), 6) AS p95 FROM ct""")
def denominator_ratio(spark, sf):
    return rounded(structure.denominator_ratio(ad.staged_counts(spark, sf), "enrolment"), "reconstructed", "p05", "median", "p95")


CTES["prior"] = "\nUNION ALL\n".join(f"""SELECT {f} AS fold, p0, tau2, p0 * (1 - p0) / tau2 AS m FROM (
  SELECT p0, greatest(spread - p0 * (1 - p0) * mi, 1e-6) AS tau2 FROM (
    SELECT sum(b) / sum(n) AS p0, sum(b * b / n) / sum(n) - (sum(b) / sum(n)) * (sum(b) / sum(n)) AS spread, avg(1 / n) AS mi
    FROM (SELECT entity, sum(dropouts) AS b, sum(n_use) AS n FROM ct WHERE year < {f} GROUP BY 1)))""" for f in range(min(FOLDS) - 1, max(FOLDS) + 1))


@query("a26_eb_prior", f"SELECT CAST(fold AS INT) AS fold, round(p0, 6) AS p0, round(tau2, 8) AS tau2, round(m, 4) AS m FROM prior WHERE fold IN ({', '.join(map(str, FOLDS))})")
def eb_prior(spark, sf):
    out = structure.eb_prior(ad.counts_panel(spark, sf), FOLDS, SPEC)
    return out.select("fold", F.round("p0", 6).alias("p0"), F.round("tau2", 8).alias("tau2"), F.round("m", 4).alias("m"))


CTES["icc_rows"] = "SELECT entity, year, ab, ab - avg(ab) OVER (PARTITION BY year) AS c, dropouts, n_use FROM ct WHERE year >= 1998"
CTES["icc_value"] = """SELECT g AS groups, n AS rows, (msb - msw) / (msb + ((n - k2 / n) / (g - 1) - 1) * msw) AS icc FROM (
  SELECT count(*) AS g, sum(k) AS n, CAST(sum(k * k) AS DOUBLE) AS k2, sum(s * s / k) / (count(*) - 1) AS msb, (sum(q) - sum(s * s / k)) / (sum(k) - count(*)) AS msw
  FROM (SELECT entity, count(*) AS k, sum(c) AS s, sum(c * c) AS q FROM icc_rows GROUP BY 1))"""


@query("a27_icc_anova", "SELECT groups, CAST(rows AS BIGINT) AS rows, round(icc, 6) AS icc FROM icc_value")
def icc(spark, sf):
    from annalis.operators import shifts

    rows = ad.staged_counts(spark, sf).where(F.col("year") >= 1998)
    rows = shifts.demean_within(rows, "ab", ["year"], "centred", calendar=True).withColumn("scope", F.lit("all"))
    return structure.icc_anova(rows, "centred", ["scope"], "entity").select("groups", "rows", F.round("icc", 6).alias("icc"))


@query("a28_variance_budget", """WITH r AS (SELECT *, 0.5 * sum(dropouts) OVER (PARTITION BY entity) / sum(n_use) OVER (PARTITION BY entity) + 0.5 * (SELECT sum(dropouts) / sum(n_use) FROM icc_rows) AS p FROM icc_rows),
    x AS (SELECT *, p * (1 - p) / n_use * 1e4 AS noise FROM r),
    a AS (SELECT var_samp(c) AS vt, avg(noise) AS nb, quantile_cont(noise, 0.5) AS nm, quantile_cont(n_use, 0.5) AS sm, avg(CASE WHEN ab = 0 THEN 1 ELSE 0 END) AS zo, avg(pow(1 - p, n_use)) AS ze FROM x)
    SELECT round(vt, 6) AS variance, round(icc, 6) AS icc, round(nb / vt, 6) AS binomial, round(1 - icc - nb / vt, 6) AS transient, round(sqrt(nm), 6) AS noise_sd_median,
    round(100 / sm, 6) AS one_person_points, round(zo, 6) AS zeros_observed, round(ze, 6) AS zeros_expected FROM a, icc_value""")
def variance_budget(spark, sf):
    out = structure.variance_budget(ad.staged_counts(spark, sf).where(F.col("year") >= 1998), "ab", SPEC)
    return rounded(out, *out.columns)


CTES["zeros"] = "SELECT entity, year, ab FROM cp WHERE ab IS NOT NULL AND year >= 1998"


@query("a29_persistent_zeros", """WITH e AS (SELECT entity, count(*) AS r, sum(CASE WHEN ab = 0 THEN 1 ELSE 0 END) AS z FROM zeros GROUP BY 1)
    SELECT count(*) FILTER (WHERE r = 3) AS entities, count(*) FILTER (WHERE r = 3 AND z = 3) AS always_zero, round(count(*) FILTER (WHERE r = 3) * pow(sum(z) / sum(r), 3), 6) AS expected FROM e""")
def persistent_zeros(spark, sf):
    p = ad.customer_panel(spark, sf).where(F.col("year") >= 1998)
    return rounded(structure.persistent_zeros(p, "ab", 3, SPEC), "expected")


CTES["ymx"] = """SELECT year_1, year_2, count(*) AS rows, CASE WHEN count(*) >= 30 THEN corr(r1, r2) END AS spearman FROM (
  SELECT a.year AS year_1, b.year AS year_2,
    rank() OVER (PARTITION BY a.year, b.year ORDER BY a.ab) + (count(*) OVER (PARTITION BY a.year, b.year, a.ab) - 1) / 2.0 AS r1,
    rank() OVER (PARTITION BY a.year, b.year ORDER BY b.ab) + (count(*) OVER (PARTITION BY a.year, b.year, b.ab) - 1) / 2.0 AS r2
  FROM cp a JOIN cp b ON a.entity = b.entity AND a.year < b.year WHERE a.ab IS NOT NULL AND b.ab IS NOT NULL) GROUP BY 1, 2"""


@query("a30_spearman_year_matrix", "SELECT year_1, year_2, rows, round(spearman, 6) AS spearman FROM ymx")
def spearman_year_matrix(spark, sf):
    return rounded(structure.spearman_year_matrix(ad.customer_panel(spark, sf), "ab", SPEC), "spearman")


@query("a31_spearman_by_lag", "SELECT CAST(year_2 - year_1 AS INT) AS lag, round(avg(spearman), 6) AS mean_spearman FROM ymx WHERE year_1 >= 1997 AND year_2 - year_1 IN (1, 2, 3) GROUP BY 1")
def spearman_by_lag(spark, sf):
    m = structure.spearman_year_matrix(ad.customer_panel(spark, sf), "ab", SPEC)
    return rounded(structure.spearman_by_lag(m, [1, 2, 3], 1997), "mean_spearman")


@query("a32_grade_series", "\nUNION ALL\n".join(f"SELECT year, 'g{k}' AS grade, round(sum(ab_g{k} * n_g{k}) / sum(CASE WHEN ab_g{k} IS NOT NULL THEN n_g{k} END), 6) AS rate, CAST(sum(n_g{k}) AS BIGINT) AS enrolment FROM gp WHERE public = 1 GROUP BY 1" for k in GRADES))
def grade_series(spark, sf):
    p = ad.grade_panel(spark, sf).where(F.col("public") == 1)
    return rounded(profile.grade_series(p, {f"g{k}": (f"ab_g{k}", f"n_g{k}") for k in GRADES}, ["year"]), "rate")


@query("a33_cohort_progression", "WITH t AS (SELECT year, " + ", ".join(f"sum(n_g{k}) AS n{k}" for k in GRADES) + " FROM gp GROUP BY 1) SELECT a.year, " +
       ", ".join(f"round(b.n{k + 1} / a.n{k}, 6) AS n_g{k}_to_n_g{k + 1}" for k in GRADES[:-1]) + " FROM t a JOIN t b ON b.year = a.year + 1")
def cohort_progression(spark, sf):
    out = profile.cohort_progression(ad.grade_panel(spark, sf), [f"n_g{k}" for k in GRADES], SPEC)
    return rounded(out, *[c for c in out.columns if c != "year"])


def _rank(x, part):
    return f"rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0"


def _diagonal_sql():
    parts = []
    for g, p in ((5, 4), (6, 5), (7, 6)):
        rows = f"""SELECT year, ab_g{g} AS h, ab_g{p} AS d, ab AS s, CASE WHEN lead(year) OVER w = year + 1 THEN lead(ab_g{g}) OVER w END AS nx FROM gp WINDOW w AS (PARTITION BY entity ORDER BY year)"""
        ranked = f"SELECT year, {_rank('nx', 'year')} AS rn, {_rank('h', 'year')} AS rh, {_rank('d', 'year')} AS rd, {_rank('s', 'year')} AS rs FROM ({rows}) WHERE year IN (1997, 1998, 1999, 2000) AND nx IS NOT NULL AND h IS NOT NULL AND d IS NOT NULL"
        fold = f"SELECT year, corr(rh, rn) AS h, corr(rd, rn) AS d, corr(rs, rn) AS s FROM ({ranked}) GROUP BY 1 HAVING count(*) >= 30"
        parts.append(f"SELECT 'ab_g{g}' AS grade, round(avg(h), 6) AS horizontal, round(avg(d), 6) AS diagonal, round(avg(s), 6) AS stage FROM ({fold})")
    return "\nUNION ALL\n".join(parts)


@query("a34_diagonal_vs_horizontal", _diagonal_sql())
def diagonal(spark, sf):
    triples = [("ab_g5", "ab_g4", "ab"), ("ab_g6", "ab_g5", "ab"), ("ab_g7", "ab_g6", "ab")]
    return rounded(profile.diagonal_vs_horizontal(ad.grade_panel(spark, sf), triples, FOLDS, SPEC), "horizontal", "diagonal", "stage")


@query("a35_cross_stage_spearman", f"""SELECT s.year, s.share_with_both, r.rows, r.spearman FROM (SELECT year, round(count(CASE WHEN ab_f IS NOT NULL AND ab_o IS NOT NULL THEN 1 END) / count(ab_o), 6) AS share_with_both FROM sp GROUP BY 1) s
    LEFT JOIN (SELECT year, count(*) AS rows, round(corr(r1, r2), 6) AS spearman FROM (SELECT year, {_rank('ab_f', 'year')} AS r1, {_rank('ab_o', 'year')} AS r2 FROM sp WHERE ab_f IS NOT NULL AND ab_o IS NOT NULL) GROUP BY 1) r USING (year)""")
def cross_stage(spark, sf):
    return rounded(profile.cross_stage_spearman(ad.staged_supplier(spark, sf), "ab_f", "ab_o", SPEC), "share_with_both", "spearman")


INVENTORY = {"rate": ["AB"], "size": ["ENROLMENT"], "quality": ["TDI", "ATU"]}
CTES["inv"] = "\nUNION ALL\n".join(
    f"""SELECT year, '{label}' AS label, '{c}' AS "column", {i} AS ordinal, count(*) AS rows, count({c}) AS filled, round(100.0 * count({c}) / count(*), 1) AS filled_pct,
    round(coalesce(sum({c}), 0) / nullif(count({c}), 0), 3) AS mean FROM sp GROUP BY 1"""
    for i, (label, c) in enumerate([("size", "enrolment"), ("rate", "ab"), ("quality", "tdi"), ("quality", "atu")]))


@query("a39_column_inventory", "SELECT * FROM inv")
def column_inventory(spark, sf):
    p = ad.supplier_panel(spark, sf).select("year", "enrolment", "ab", "tdi", "atu", "location")
    return profile.column_inventory(p, INVENTORY, SPEC)


@query("a40_label_year_cover", """SELECT label, count(DISTINCT year) AS years, arg_min("column", (year, ordinal)) AS first_column FROM inv WHERE mean IS NOT NULL GROUP BY 1""")
def label_cover(spark, sf):
    p = ad.supplier_panel(spark, sf).select("year", "enrolment", "ab", "tdi", "atu", "location")
    return profile.label_year_cover(profile.column_inventory(p, INVENTORY, SPEC), "year")


@query("a42_grade_size", union_sql([f"n_g{k}" for k in GRADES], """SELECT year, '{c}' AS "column", round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS p25 FROM gp WHERE {c} > 0 GROUP BY 1"""))
def grade_size(spark, sf):
    return profile.grade_size(ad.grade_panel(spark, sf), [f"n_g{k}" for k in GRADES], ["year"])


@query("a43_grade_simple_means", "SELECT year, " + ", ".join(f"round(avg(ab_g{k}), 6) AS ab_g{k}" for k in GRADES) + " FROM gp WHERE public = 1 GROUP BY 1")
def grade_means(spark, sf):
    p = ad.grade_panel(spark, sf).where(F.col("public") == 1)
    return p.groupBy("year").agg(*[F.round(F.avg(f"ab_g{k}"), 6).alias(f"ab_g{k}") for k in GRADES])


@query("a44_entity_churn", """SELECT x.year, CAST(x.year + 1 AS INT) AS next_year, n.entries, x.exits FROM
    (SELECT p.year, count(*) FILTER (WHERE q.entity IS NULL) AS exits FROM cp p LEFT JOIN cp q ON q.entity = p.entity AND q.year = p.year + 1 GROUP BY 1) x
    JOIN (SELECT p.year, count(*) FILTER (WHERE q.entity IS NULL) AS entries FROM cp p LEFT JOIN cp q ON q.entity = p.entity AND q.year = p.year - 1 GROUP BY 1) n ON n.year = x.year + 1""")
def entity_churn(spark, sf):
    return profile.entity_churn(ad.customer_panel(spark, sf), SPEC)


@query("a45_missing_target_by_year", "SELECT year, count(*) FILTER (WHERE target_year IS NULL) AS without_target FROM cl GROUP BY 1")
def missing_target(spark, sf):
    return profile.missing_target_by_year(customer_targets(spark, sf), "target_year", SPEC)


@query("a46_zero_share", """SELECT year, count(*) AS rows, count(*) FILTER (WHERE ab = 0) AS zeros, round(count(*) FILTER (WHERE ab = 0) / count(*), 6) AS zero_share, count(DISTINCT entity) AS entities
    FROM cp WHERE ab IS NOT NULL GROUP BY 1""")
def zero_share(spark, sf):
    return rounded(profile.zero_share(ad.customer_panel(spark, sf), ["year"], "ab", SPEC), "zero_share")


@query("w8_pareto_cut", """WITH r AS (SELECT year, dropouts, sum(dropouts) OVER (PARTITION BY year ORDER BY dropouts DESC, entity ROWS UNBOUNDED PRECEDING) AS cum, sum(dropouts) OVER (PARTITION BY year) AS tot FROM ct)
    SELECT year, any_value(tot) AS total, count(*) AS entities, count(*) FILTER (WHERE cum / tot < 0.5) + 1 AS reach_50, count(*) FILTER (WHERE cum / tot < 0.8) + 1 AS reach_80 FROM r GROUP BY 1""")
def pareto(spark, sf):
    return structure.pareto_cut(ad.staged_counts(spark, sf), ["year"], "dropouts", [0.5, 0.8])


@query("w9_average_rank", f"SELECT entity, year, ab, {_rank('ab', 'year')} AS ab_rank FROM cp WHERE ab IS NOT NULL")
def average_rank(spark, sf):
    p = ad.customer_panel(spark, sf).where(F.col("ab").isNotNull()).select("entity", "year", "ab")
    return order.with_average_ranks(p, ["year"], {"ab": "ab_rank"}).drop("ab_rank_of")


@query("w10_year_over_year_check", """SELECT year, round(m, 6) AS mean, CASE WHEN m < lag(m) OVER (ORDER BY year) THEN 'fell' WHEN m > lag(m) OVER (ORDER BY year) THEN 'rose' END AS direction
    FROM (SELECT year, avg(ab_f) AS m FROM sp GROUP BY 1)""")
def year_over_year(spark, sf):
    from annalis.operators import quality

    return quality.yearly_direction(ad.supplier_panel(spark, sf), "ab_f", SPEC)
