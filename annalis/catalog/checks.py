"""Queries of the projections and of the validation suite."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalis.catalog import adapters as ad
from annalis.catalog.adapters import SPEC, YEARS
from annalis.catalog.joins import features
from annalis.catalog.registry import query
from annalis.catalog.scans import sheet_rows
from annalis.functions import scalar as sc
from annalis.operators import profile, quality, select
from annalis.session import shared_folder, staged
from annalis.sources import stages

NAMES = {
    0: ("3_CAT_FUN_AF", "TAB_FUN_AF"), 1: ("tab_F04", "TAB_F04"), 2: ("Taxa de aprovação - Anos Finais", "TAP_FUN_AF"), 3: ("Abandono - Ensino Médio", "TAB_MED"),
    4: ("Reprovação na 1ª série", None), 5: ("reprovacao_medio_02", "TRE_MED_02"), 6: ("aprovacao_ai", "TAP_FUN_AI"), 7: ("NO_ENTIDADE", None),
}


def case(column, mapping):
    return reduce(lambda acc, kv: F.when(column == kv[0], F.lit(kv[1])).otherwise(acc), mapping.items(), F.lit(None).cast("string"))


def sql_case(column, mapping):
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in mapping.items() if v is not None) + " END"


@query("p1_clean_rate_strict", "SELECT entity, year, ab FROM sp")
def clean_rate(spark, sf):
    text = F.coalesce(F.col("ab").cast("string"), F.lit("--"))
    return ad.supplier_panel(spark, sf).select("entity", "year", sc.clean_rate_strict(text).alias("ab"))


@query("p2_to_number_lenient", "SELECT entity, year, CASE WHEN entity % 4 <> 0 THEN ab END AS ab FROM sp")
def lenient(spark, sf):
    text = F.when(F.col("entity") % 4 == 0, F.lit("n/d")).otherwise(F.coalesce(F.concat(F.lit(" "), F.col("ab").cast("string")), F.lit("·")))
    return ad.supplier_panel(spark, sf).select("entity", "year", sc.to_number_lenient(text).alias("ab"))


@query("p3_normalise_id", "SELECT CAST(entity AS VARCHAR) AS id, year FROM sp")
def normalise_id(spark, sf):
    e = F.col("entity").cast("string")
    text = F.when(F.col("year") % 3 == 0, F.concat(F.lit(" 00"), e)).when(F.col("year") % 3 == 1, F.concat(e, F.lit(".0"))).otherwise(F.concat(e, F.lit("  ")))
    return ad.supplier_panel(spark, sf).select(sc.normalise_id(text).alias("id"), "year")


@query("p4_canonical_category", "SELECT entity, year, dependency FROM sp")
def canonical(spark, sf):
    raw = F.when((F.col("dependency") == "Privada") & (F.col("year") < 1998), " Particular ").otherwise(F.concat(F.col("dependency"), F.lit(" ")))
    return ad.supplier_panel(spark, sf).select("entity", "year", sc.canonical_category(raw).alias("dependency"))


@query("p8_normalise_header_ws", "SELECT entity, year, 'Nome da Escola ' || name AS label FROM sp")
def header_ws(spark, sf):
    messy = F.concat(F.lit("  Nome \n da\t\tEscola "), F.col("name"), F.lit(" \n"))
    return ad.supplier_panel(spark, sf).select("entity", "year", sc.normalise_spaces(messy).alias("label"))


@query("p9_semantic_key", f"SELECT {sql_case('entity % 8', {k: v[0] for k, v in NAMES.items()})} AS name, {sql_case('entity % 8', {k: v[1] for k, v in NAMES.items()})} AS key, count(*) AS rows FROM sp GROUP BY 1, 2")
def semantic_key(spark, sf):
    named = ad.supplier_panel(spark, sf).select(case(F.col("entity") % 8, {k: v[0] for k, v in NAMES.items()}).alias("name"))
    return named.select("name", sc.semantic_key("name").alias("key")).groupBy("name", "key").agg(F.count(F.lit(1)).alias("rows"))


@query("p10_select_rate_columns", """SELECT 'tap_FUN' AS "column", count(ap) AS known FROM sp UNION ALL SELECT '3_CAT_MED', count(ab_o) FROM sp UNION ALL SELECT 'Aprovação - Anos Iniciais', count(ap_f) FROM sp UNION ALL SELECT 'Taxa de Abandono', count(ab) FROM sp""")
def rate_columns(spark, sf):
    p = ad.supplier_panel(spark, sf)
    wide = p.select("entity", "name", F.col("ap").alias("tap_FUN"), F.col("ab_o").alias("3_CAT_MED"), F.col("ap_f").alias("Aprovação - Anos Iniciais"),
                    F.col("ab").alias("Taxa de Abandono"), F.col("rp").alias("reprovação"), "town")
    cols = select.select_rate_columns(wide.columns)
    one = wide.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in cols])
    return profile.as_rows(one, [], [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("known")) for c in cols])


@query("p13_flag_public", "SELECT entity, year, CASE WHEN entity % 17 = 4 THEN NULL WHEN dependency <> 'Privada' THEN 1 ELSE 0 END AS public FROM sp")
def flag_public(spark, sf):
    dependency = F.when(F.col("entity") % 17 != 4, F.col("dependency"))
    return ad.supplier_panel(spark, sf).select("entity", "year", sc.flag_public(dependency).alias("public"))


@query("p14_flag_any_present", "SELECT entity, year, CASE WHEN ab IS NOT NULL OR ab_f IS NOT NULL THEN 1 ELSE 0 END AS has_rates FROM sp")
def flag_any(spark, sf):
    return ad.supplier_panel(spark, sf).select("entity", "year", sc.flag_any_present(["ab", "ab_f"]).alias("has_rates"))


@query("p15_flag_period", "SELECT entity, year, CASE WHEN year IN (1998, 1999) THEN 1 ELSE 0 END AS unusual FROM sp")
def flag_period(spark, sf):
    return ad.supplier_panel(spark, sf).select("entity", "year", sc.flag_period("year", [1998, 1999]).alias("unusual"))


@query("p16_universe", "SELECT entity, year, target_year, ab FROM lp WHERE public = 1 AND year > 1995 AND target_year IN (1998, 2000, 2001)")
def universe(spark, sf):
    rows = select.universe(ad.longitudinal_panel(spark, sf), "public", "year", "target_year", 1995, [1998, 2000, 2001])
    return rows.select("entity", "year", "target_year", "ab")


@query("p17_split_inference", "SELECT entity, year, CASE WHEN target_year IS NULL THEN 'score' ELSE 'model' END AS part FROM lp WHERE public = 1")
def split_inference(spark, sf):
    p = ad.longitudinal_panel(spark, sf).where(F.col("public") == 1).select("entity", "year", "target_year")
    model, score = select.split_inference(p, "target_year")
    return model.withColumn("part", F.lit("model")).unionByName(score.withColumn("part", F.lit("score"))).drop("target_year")


@query("p18_stage_dataset", "SELECT entity, year, ap_f, rp_f, ab_f, ab_f_LAG1, ab_f_DELTA1, ab_f_T1 FROM lp WHERE ab_f_T1 IS NOT NULL")
def stage_dataset(spark, sf):
    p = ad.longitudinal_panel(spark, sf).drop("n_f", "n_o")
    return select.stage_dataset(p, "ab_f_T1", ["entity", "year"], ["_f", "_o"], ["_o", "_none"])


@query("p19_columns_by_dtype", """SELECT * FROM (SELECT unnest(['entity', 'year', 'ab', 'enrolment', 'location', 'dependency', 'town']) AS "column", unnest(['number', 'number', 'number', 'number', 'text', 'text', 'text']) AS kind), (SELECT count(*) AS rows FROM sp)""")
def by_dtype(spark, sf):
    p = ad.supplier_panel(spark, sf).select("entity", "year", "ab", "enrolment", "location", "dependency", "town")
    numeric, text = profile.columns_by_dtype(p)
    cells = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind")) for k, cs in (("number", numeric), ("text", text)) for c in cs]
    return profile.as_rows(p.agg(F.count(F.lit(1)).alias("rows")), ["rows"], cells)


@query("p20_drop_sparse_columns", "SELECT entity, year, ab, ab_f FROM lp")
def drop_sparse(spark, sf):
    p = ad.staged_longitudinal(spark, sf).select("entity", "year", "ab", "ab_f", F.when(F.col("entity") % 5 == 0, F.col("ab")).alias("rare"))
    return p.drop(*profile.drop_sparse_columns(p, ["ab", "ab_f", "rare"], 0.30))


@query("p21_assert_no_leakage", "SELECT count(*) AS rows, 'ab_f_T1' AS caught FROM lp WHERE ab_f_T1 IS NOT NULL")
def no_leakage(spark, sf):
    p = ad.longitudinal_panel(spark, sf)
    targets = [c for c in p.columns if c.endswith("_T1")]
    select.assert_no_leakage(["ab", "ab_f", "tdi"], targets)
    caught = ""
    try:
        select.assert_no_leakage(["ab", "ab_f_T1"], targets)
    except ValueError:
        caught = "ab_f_T1"
    return p.where(F.col("ab_f_T1").isNotNull()).agg(F.count(F.lit(1)).alias("rows")).withColumn("caught", F.lit(caught))


@query("p22_stratify", "SELECT entity, year, special, ever_special, stratum FROM st")
def stratify(spark, sf):
    return ad.strata_panel(spark, sf).select("entity", "year", "special", "ever_special", "stratum")


@query("p23_segment_filters", "SELECT entity, year, ab_f FROM sp WHERE public = 1 AND ab_f IS NOT NULL AND year >= 1998")
def segment_filters(spark, sf):
    p = ad.supplier_panel(spark, sf)
    return p.where((F.col("public") == 1) & F.col("ab_f").isNotNull() & (F.col("year") >= 1998)).select("entity", "year", "ab_f")


@query("p24_grade_enrolment", """SELECT entity, year, CASE WHEN year = 2001 THEN CAST(n_g5 AS DOUBLE) WHEN coalesce(n_g5_f, n_g5_o) IS NOT NULL THEN CAST(coalesce(n_g5_f, 0) + coalesce(n_g5_o, 0) AS DOUBLE) END AS enrolment FROM gp""")
def grade_enrolment(spark, sf):
    p = ad.grade_panel(spark, sf)
    return p.select("entity", "year", sc.grade_enrolment("year", 2001, "n_g5", ["n_g5_f", "n_g5_o"]).alias("enrolment"))


@query("m29_median_impute_whole", """SELECT entity, year, coalesce(ab, (SELECT quantile_cont(ab, 0.5) FROM lp WHERE ab_f_T1 IS NOT NULL)) AS ab, coalesce(ab_f, (SELECT quantile_cont(ab_f, 0.5) FROM lp WHERE ab_f_T1 IS NOT NULL)) AS ab_f FROM lp WHERE ab_f_T1 IS NOT NULL""")
def impute_whole(spark, sf):
    from annalis.operators import models

    p = ad.staged_longitudinal(spark, sf).where(F.col("ab_f_T1").isNotNull()).select("entity", "year", "ab", "ab_f", F.when(F.col("entity") % 5 == 0, F.col("ab")).alias("rare"))
    p = p.drop(*profile.drop_sparse_columns(p, ["ab", "ab_f", "rare"], 0.5))
    return models.impute(p, ["ab", "ab_f"], models.medians(p, ["ab", "ab_f"]))


COUNT = "CAST(count(CASE WHEN {0} THEN 1 END) AS BIGINT)"


def sql_check(section, name, subject, bad, source, otherwise="fail"):
    return f"SELECT '{section}' AS section, '{name}' AS check_name, '{subject}' AS subject, CASE WHEN n_bad = 0 THEN 'ok' ELSE '{otherwise}' END AS status, n_bad FROM (SELECT CAST({bad} AS BIGINT) AS n_bad FROM {source})"


def union(*parts):
    return "\nUNION ALL\n".join(parts)


@query("q1_type_contract", union(*[sql_check("types", "type", c, b, "(SELECT count(*) FROM sp)") for c, b in (("entity", 1), ("year", 0), ("ab", 0), ("location", 0))]))
def type_contract(spark, sf):
    return quality.type_contract(ad.supplier_panel(spark, sf), {"entity": T.StringType, "year": T.IntegralType, "ab": T.DoubleType, "location": T.StringType})


@query("q2_unique_key", union(sql_check("key", "unique key", "panel", "count(*)", "(SELECT 1 FROM sp GROUP BY entity, year HAVING count(*) > 1)"),
                              sql_check("key", "unique key", "items", "count(*)", "(SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")))
def unique_key(spark, sf):
    a = quality.unique_key(ad.supplier_panel(spark, sf), SPEC.keys, "panel")
    return a.unionByName(quality.unique_key(ad.read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "items"))


@query("q3_no_residual_marker", union(*[sql_check("marker", "no residual marker", c, COUNT.format(cond), "sp") for c, cond in (("location", "false"), ("cell", "ab IS NULL"))]))
def no_marker(spark, sf):
    p = ad.supplier_panel(spark, sf).select("entity", "location", F.coalesce(F.col("ab").cast("string"), F.lit(" -- ")).alias("cell"))
    return quality.no_marker(p)


@query("q4_year_cover", union(sql_check("cover", "rows equal entities", "every year", "count(*)", "(SELECT 1 FROM sp GROUP BY year HAVING count(*) <> count(DISTINCT entity))"),
                              sql_check("cover", "years present", "7", "abs(count(DISTINCT year) - 7)", "sp")))
def year_cover(spark, sf):
    return quality.year_cover(ad.supplier_panel(spark, sf), len(YEARS), SPEC)


@query("q5_rates_in_range", union(*[sql_check("range", "in range or NULL", c, COUNT.format(f"{c} < 0 OR {c} > 100"), "sp") for c in ad.RATES + ["enrolment"]]))
def in_range(spark, sf):
    return quality.in_range(ad.supplier_panel(spark, sf), ad.RATES + ["enrolment"])


@query("q6_temporal_curve", union(
    sql_check("curve", "lower than", "1998<1999", "CASE WHEN avg(CASE WHEN year = 1998 THEN ab_f END) < avg(CASE WHEN year = 1999 THEN ab_f END) THEN 0 ELSE 1 END", "sp"),
    sql_check("curve", "higher than", "2001>2000", "CASE WHEN avg(CASE WHEN year = 2001 THEN ab_f END) > avg(CASE WHEN year = 2000 THEN ab_f END) THEN 0 ELSE 1 END", "sp", "warn")))
def temporal_curve(spark, sf):
    return quality.temporal_curve(ad.supplier_panel(spark, sf), "ab_f", (1998, 1999), (2001, 2000), SPEC)


COHERENT = "(SELECT *, lag(ab) OVER w AS before, lead(ab) OVER w AS after FROM (SELECT p.*, pv.ab AS ab_LAG1, nx.ab AS ab_T1, p.ab - pv.ab AS ab_DELTA1 FROM cp p LEFT JOIN cp pv ON pv.entity = p.entity AND pv.year = p.year - 1 LEFT JOIN cp nx ON nx.entity = p.entity AND nx.year = p.year + 1) WINDOW w AS (PARTITION BY entity ORDER BY year))"


def gappy(spark, sf):
    from annalis.operators import shifts

    return shifts.longitudinal(ad.customer_panel(spark, sf), ["ab"], ["ab"], ["ab"], SPEC, target="target_year")


@query("q7_lag_coherent", sql_check("lag", "lag is the previous row", "ab_LAG1", COUNT.format("abs(before - ab_LAG1) > 0.01"), COHERENT))
def lag_coherent(spark, sf):
    return quality.lag_coherent(gappy(spark, sf), "ab", "ab_LAG1", SPEC)


@query("q8_delta_coherent", sql_check("delta", "delta is value minus lag", "ab_DELTA1", COUNT.format("abs(ab - ab_LAG1 - ab_DELTA1) > 0.01"), COHERENT))
def delta_coherent(spark, sf):
    return quality.delta_coherent(gappy(spark, sf), "ab", "ab_LAG1", "ab_DELTA1")


@query("q9_next_coherent", sql_check("next", "next year''s value is the next row", "ab_T1", COUNT.format("abs(after - ab_T1) > 0.01"), COHERENT))
def next_coherent(spark, sf):
    return quality.next_coherent(gappy(spark, sf), "ab", "ab_T1", SPEC)


@query("q10_target_year_rules", union(sql_check("target year", "no target in the last year", "2001", COUNT.format("year = 2001 AND target_year IS NOT NULL"), "cl"),
                                      sql_check("target year", "missing target means absent", "other years", "count(*)", "(SELECT 1 FROM cl a JOIN cl b ON b.entity = a.entity AND b.year = a.year + 1 WHERE a.target_year IS NULL)")))
def target_year_rules(spark, sf):
    return quality.target_year_rules(staged(gappy(spark, sf), "gappy"), "target_year", 2001, SPEC)


@query("q11_binary_features", union(*[sql_check("domain", "values in domain", c, COUNT.format(f"{c} NOT IN (0, 1)"), "feat") for c in ("IIB_a", "IDA_b", "IDP_c")]))
def binary(spark, sf):
    return quality.domain(features(spark, sf), ["IIB_a", "IDA_b", "IDP_c"], [0.0, 1.0])


COVER = "(SELECT year, 100.0 * sum(CASE WHEN IIB_a IS NULL THEN 0 ELSE 1 END + CASE WHEN IDA_b IS NULL THEN 0 ELSE 1 END) / (2 * count(*)) AS cover FROM feat GROUP BY 1)"


@query("q12_feature_cover", union(sql_check("cover", "years with full cover", "at least 7", "greatest(0, 7 - count(CASE WHEN cover > 99 THEN 1 END))", COVER, "info"),
                                  sql_check("cover", "poorly covered years", "only 1999", COUNT.format("cover < 60 AND year <> 1999"), COVER, "warn")))
def feature_cover(spark, sf):
    return quality.feature_cover(features(spark, sf), ["IIB_a", "IDA_b"], 1999, 7, SPEC, poor=60.0)


@query("q13_published_equals", union(sql_check("published", "identical to the last stage", "published", "0", "(SELECT count(*) FROM sp)")))
def published(spark, sf):
    stage, public = shared_folder(spark, "stage"), shared_folder(spark, "published")
    stages.write_stage(ad.supplier_panel(spark, sf).select("entity", "year", "ab", "location"), stage)
    return quality.published_equals(stages.read_stage(spark, stage), stages.publish(spark, stage, public))


@query("q14_same_rows_per_year", union(sql_check("upstream", "rows per year", "all years", "count(DISTINCT year)", "(SELECT year FROM sp WHERE entity % 50 = 7)"), sql_check("upstream", "same keys", "all years", "count(*)", "(SELECT 1 FROM sp WHERE entity % 50 = 7)")))
def same_rows(spark, sf):
    p = ad.supplier_panel(spark, sf)
    return quality.same_rows_per_year(p.where(F.col("entity") % 50 != 7), ad.supplier_years(spark, sf), SPEC.keys, SPEC.year)


@query("q15_input_shape", union(sql_check("input", "column count", "63", "0", "(SELECT count(*) FROM sp)"), sql_check("input", "constant year", "every file", "0", "(SELECT count(*) FROM sp)")))
def input_shape(spark, sf):
    return quality.input_shape(sheet_rows(spark, sf)[0], 63, "cells", "year", "file")


@query("q16_exact_columns", union(sql_check("columns", "missing columns", "panel", "1", "(SELECT count(*) FROM sp)"), sql_check("columns", "extra columns", "panel", "0", "(SELECT count(*) FROM sp)")))
def exact_columns(spark, sf):
    p = ad.supplier_panel(spark, sf).select("entity", "year", "ab")
    return quality.exact_columns(p, ["entity", "year", "ab", "target_year"], "panel")


@query("q17_id_format", sql_check("id", "format", "code", COUNT.format("entity % 9 = 2"), "sp"))
def id_format(spark, sf):
    code = F.when(F.col("entity") % 9 == 2, F.col("entity").cast("string")).otherwise(F.lpad(F.col("entity").cast("string"), 8, "14000000"))
    p = ad.supplier_panel(spark, sf).select(code.alias("code"))
    return quality.id_format(p, "code")


@query("q18_no_nulls", union(*[sql_check("nulls", "no NULL", c, COUNT.format(f"{c} IS NULL"), "sp") for c in ("year", "entity", "town", "location", "dependency", "ab")]))
def no_nulls(spark, sf):
    return quality.no_nulls(ad.supplier_panel(spark, sf), ["year", "entity", "town", "location", "dependency", "ab"])


@query("q19_categories_every_year", union(*[f"SELECT 'categories' AS section, 'present every year' AS check_name, '{c}' AS subject, CASE WHEN n_bad = 0 THEN 'ok' ELSE 'fail' END AS status, n_bad FROM (SELECT count(*) FILTER (WHERE y < 7) AS n_bad FROM (SELECT count(DISTINCT year) AS y FROM {src} WHERE {c} IS NOT NULL GROUP BY {c}))"
                                            for c, src in (("location", "sp"), ("dependency", "sp"), ("label", "(SELECT year, CASE WHEN year > 1996 THEN dependency ELSE location END AS label FROM sp)"))]))
def categories(spark, sf):
    p = ad.staged_supplier(spark, sf).withColumn("label", F.when(F.col("year") > 1996, F.col("dependency")).otherwise(F.col("location")))
    return quality.categories_every_year(p, ["location", "dependency", "label"], SPEC)


@query("q20_target_cover", union(*[f"SELECT '{t}' AS target, count({t}) AS filled, round(100.0 * count({t}) / count(*), 1) AS filled_pct, CASE WHEN count(ab_o_T1) >= count({t}) THEN 'ok' ELSE 'fail' END AS status FROM lp" for t in ("ab_o_T1", "ab_T1", "ab_f_T1")]))
def target_cover(spark, sf):
    return quality.target_cover(ad.longitudinal_panel(spark, sf), ["ab_o_T1", "ab_T1", "ab_f_T1"])


@query("q21_flag_domain", sql_check("flag", "values in domain", "public", COUNT.format("public NOT IN (0, 1)"), "sp"))
def flag_domain(spark, sf):
    return quality.domain(ad.supplier_panel(spark, sf), ["public"], [0, 1], section="flag")
