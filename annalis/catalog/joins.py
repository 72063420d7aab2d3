"""Queries of the joins, reconciliations and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalis.catalog import adapters as ad
from annalis.catalog.adapters import SPEC
from annalis.catalog.aggregates import customer_targets, rounded
from annalis.catalog.registry import CTES, query
from annalis.operators import reconcile, sets, shifts, structure
from annalis.functions.scalar import semantic_key
from annalis.session import staged

KEYS = ["year", "entity"]


def features(spark, sf):
    """A binary feature table: one source column up to 1998, another one later; missing in 1995."""
    p = ad.supplier_panel(spark, sf)
    e, y = F.col("entity"), F.col("year")
    return p.where((e + y) % 5 != 0).select(
        "year", "entity",
        F.when(y > 1995, (F.col("region") % 2).cast("double")).alias("IIB_a"),
        ((e % 3) == 0).cast("double").alias("IDA_b"),
        F.when(y <= 1998, (F.col("tdi") > 5).cast("double")).otherwise((F.col("atu") > 25).cast("double")).alias("IDP_c"),
    )


CTES["feat"] = """SELECT year, entity, CASE WHEN year > 1995 THEN CAST(region % 2 AS DOUBLE) END AS IIB_a, CASE WHEN entity % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS IDA_b,
    CASE WHEN year <= 1998 THEN CASE WHEN tdi > 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE CASE WHEN atu > 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS IDP_c FROM sp WHERE (entity + year) % 5 <> 0"""


@query("j3_enrich_left_1to1", "SELECT l.entity, l.year, l.ab, l.ab_f_T1, feat.IIB_a, feat.IDA_b, feat.IDP_c FROM lp l LEFT JOIN feat ON feat.entity = l.entity AND feat.year = l.year")
def enrich(spark, sf):
    base = ad.longitudinal_panel(spark, sf).select("year", "entity", "ab", "ab_f_T1")
    return reconcile.join_1to1(base, features(spark, sf), KEYS)


def other_panel(spark, sf):
    """The panel of a second source: some rows missing, some values changed, some lost."""
    e, y = F.col("entity"), F.col("year")
    return ad.longitudinal_panel(spark, sf).where(e % 11 != 5).withColumns(
        {
            "ab": F.when(e % 13 == 1, F.col("ab") + 0.5).otherwise(F.col("ab")),
            "ab_f": F.when((e + y) % 17 != 2, F.col("ab_f")),
            "dependency": F.when(e % 19 == 3, F.lit("Outra")).otherwise(F.col("dependency")),
            "ab_LAG1": F.when(y > 1995, F.col("ab_LAG1")),
        }
    )


CTES["op"] = """SELECT entity, year, CASE WHEN entity % 13 = 1 THEN ab + 0.5 ELSE ab END AS ab, CASE WHEN (entity + year) % 17 <> 2 THEN ab_f END AS ab_f, ab_o,
    CASE WHEN entity % 19 = 3 THEN 'Outra' ELSE dependency END AS dependency, CASE WHEN year > 1995 THEN ab_LAG1 END AS ab_LAG1 FROM lp WHERE entity % 11 <> 5"""
RECONCILED = ["ab", "ab_f", "ab_o", "dependency", "ab_LAG1"]


def _reconcile_sql():
    parts = []
    for c in RECONCILED:
        cond = "a.year >= 1996 AND " if c == "ab_LAG1" else ""
        differs = f"a.{c} <> b.{c}" if c == "dependency" else f"abs(a.{c} - b.{c}) > 1e-9"
        parts.append(f"""SELECT '{c}' AS "column", count(*) AS common_rows, count(CASE WHEN {cond}((a.{c} IS NULL) <> (b.{c} IS NULL)) THEN 1 END) AS null_mismatch,
        count(CASE WHEN {cond}{differs} THEN 1 END) AS value_mismatch FROM lp a JOIN op b ON b.entity = a.entity AND b.year = a.year""")
    return "\nUNION ALL\n".join(parts)


@query("j4_reconcile", _reconcile_sql())
def reconcile_panels(spark, sf):
    mine = ad.longitudinal_panel(spark, sf)
    return reconcile.reconcile(mine, other_panel(spark, sf), RECONCILED, KEYS, only={"ab_LAG1": F.col("year") >= 1996})


@query("j5_reconcile_mapped", "\nUNION ALL\n".join(f"""SELECT a.year, '{o}' AS "column", count(*) AS compared, count(CASE WHEN abs(a.{m} - b.{m}) > 0.01 THEN 1 END) AS different, round(max(abs(a.{m} - b.{m})), 6) AS largest
    FROM lp a JOIN op b ON b.entity = a.entity AND b.year = a.year WHERE a.{m} IS NOT NULL AND b.{m} IS NOT NULL GROUP BY 1""" for o, m in (("3_CAT_FUN", "ab"), ("3_CAT_FUN_AF", "ab_f"), ("3_CAT_MED", "ab_o"))))
def reconcile_mapped(spark, sf):
    """Ids are text with blanks on one side and decimals on the other; missing cells carry a marker."""
    mine = ad.longitudinal_panel(spark, sf).select(
        "year", F.concat(F.lit(" "), F.col("entity").cast("string"), F.lit(" ")).alias("id"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("--")).alias(n) for n, c in (("tab_FUN", "ab"), ("tab_F04", "ab_f"), ("tab_MED", "ab_o"))],
    )
    official = other_panel(spark, sf).select(
        "year", F.concat(F.col("entity").cast("string"), F.lit(".0")).alias("code"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("·")).alias(n) for n, c in (("3_CAT_FUN", "ab"), ("3_CAT_FUN_AF", "ab_f"), ("3_CAT_MED", "ab_o"))],
    )
    mapping = {"3_CAT_FUN": "tab_FUN", "3_CAT_FUN_AF": "tab_F04", "3_CAT_MED": "tab_MED"}
    return rounded(reconcile.reconcile_mapped(mine, official, mapping, "year", "id", "code"), "largest")


CTES["ka"] = "SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year, o_custkey AS k FROM orders WHERE o_orderstatus = 'F'"
CTES["kb"] = "SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year, o_custkey AS k FROM orders WHERE o_orderstatus = 'P'"


def order_keys(spark, sf, status):
    o = ad.read(spark, sf, "orders").where(F.col("o_orderstatus") == status)
    return o.select(F.year("o_orderdate").alias("year"), "o_custkey")


@query("j6_key_set_diff", """WITH f AS (SELECT coalesce(ka.year, kb.year) AS year, coalesce(ka.k, kb.k) AS k, CASE WHEN kb.k IS NULL THEN 'a' WHEN ka.k IS NULL THEN 'b' ELSE 'both' END AS side FROM ka FULL JOIN kb ON ka.year = kb.year AND ka.k = kb.k),
    r AS (SELECT *, row_number() OVER (PARTITION BY year, side ORDER BY k) AS p FROM f)
    SELECT year, count(*) FILTER (WHERE side = 'a') AS only_a, count(*) FILTER (WHERE side = 'b') AS only_b, count(*) FILTER (WHERE side = 'both') AS common,
    coalesce(string_agg(CASE WHEN side = 'a' AND p <= 5 THEN CAST(k AS VARCHAR) END, ',' ORDER BY k), '') AS examples_a, coalesce(string_agg(CASE WHEN side = 'b' AND p <= 5 THEN CAST(k AS VARCHAR) END, ',' ORDER BY k), '') AS examples_b FROM r GROUP BY 1""")
def key_set_diff(spark, sf):
    return reconcile.key_set_diff(order_keys(spark, sf, "F"), order_keys(spark, sf, "P"), "year", "o_custkey")


@query("j7_join_blocks", """SELECT p.entity, p.year, p.ab, feat.IIB_a, c.ab AS ab_customer, g.ab_g5, g.n_g5 FROM sp p LEFT JOIN feat ON feat.entity = p.entity AND feat.year = p.year
    LEFT JOIN cp c ON c.entity = p.entity AND c.year = p.year LEFT JOIN gp g ON g.entity = p.entity AND g.year = p.year""")
def join_blocks(spark, sf):
    base = ad.supplier_panel(spark, sf).select("year", "entity", "ab")
    blocks = [
        features(spark, sf).select("year", "entity", "IIB_a"),
        ad.customer_panel(spark, sf).select("year", "entity", F.col("ab").alias("ab_customer")),
        ad.grade_panel(spark, sf).select("year", "entity", "ab_g5", "n_g5"),
    ]
    return reconcile.join_blocks(base, blocks, KEYS, check=False)


@query("j8_assert_equal_columns", """SELECT 'ab' AS "column", 'ab_again' AS mapped, 0.0::DOUBLE AS largest_gap, 0::BIGINT AS null_mismatch
    UNION ALL SELECT 'ab_f', 'ab_f_other', round(max(abs(a.ab_f - b.ab_f)), 6), count(CASE WHEN (a.ab_f IS NULL) <> (b.ab_f IS NULL) THEN 1 END) FROM lp a LEFT JOIN op b ON b.entity = a.entity AND b.year = a.year""")
def equal_columns(spark, sf):
    mine = ad.longitudinal_panel(spark, sf).withColumn("ab_again", F.col("ab")).select("year", "entity", "ab", "ab_again", "ab_f")
    theirs = other_panel(spark, sf).select("year", "entity", F.col("ab_f").alias("ab_f_other"))
    joined = mine.join(theirs, KEYS, "left")
    return rounded(reconcile.equal_columns(joined, [("ab", "ab_again"), ("ab_f", "ab_f_other")]), "largest_gap")


@query("j9_confirm_absent", "SELECT count(*) FILTER (WHERE target_year IS NULL) AS without_target, 0::BIGINT AS present_next_year FROM cl")
def confirm_absent(spark, sf):
    p = staged(customer_targets(spark, sf), "targets")
    wrong = reconcile.present_despite_missing_target(p, "target_year", SPEC).agg(F.count(F.lit(1)).alias("present_next_year"))
    missing = p.agg(F.count(F.when(F.col("target_year").isNull(), 1)).alias("without_target"))
    return missing.select("without_target", wrong.scalar().alias("present_next_year"))


@query("j10_entity_lookup", "SELECT entity, year, ab, round(100.0 * sum(k_ab) OVER (PARTITION BY entity) / sum(n) OVER (PARTITION BY entity), 6) AS own_rate, CAST(max(special) OVER (PARTITION BY entity) AS INT) AS ever FROM sp")
def entity_lookup(spark, sf):
    p = ad.staged_supplier(spark, sf)
    own = p.groupBy("entity").agg(F.round(100.0 * F.sum("k_ab") / F.sum("n"), 6).alias("own_rate"))
    rows = p.select("entity", "year", "ab", shifts.ever_flagged("special", SPEC).alias("ever"))
    return reconcile.entity_lookup(rows, own, "entity")


@query("j12_compare_with_official", """SELECT a.year, round(a.rate, 6) AS weighted_rate, o.official_rate, round(a.rate - o.official_rate, 6) AS difference FROM (SELECT year, 100 * sum(dropouts) / sum(n_use) AS rate FROM ct GROUP BY 1) a
    JOIN (SELECT year, round(100.0 * sum(k_ab) / sum(n), 1) AS official_rate FROM sp WHERE public = 1 GROUP BY 1) o USING (year)""")
def compare_with_official(spark, sf):
    own = structure.weighted_series(ad.counts_panel(spark, sf), "ab", ["year"]).select("year", "weighted_rate")
    public = ad.supplier_panel(spark, sf).where(F.col("public") == 1)
    official = public.groupBy("year").agg(F.round(100.0 * F.sum("k_ab") / F.sum("n"), 1).alias("official_rate"))
    return rounded(reconcile.compare_with_official(own, official, ["year"], "weighted_rate", "official_rate"), "weighted_rate", "difference")


@query("p11_map_columns", """WITH m AS (SELECT unnest(['tap_FUN', '3_CAT_MED', 'tab_FUN', 'tab_MED', 'tab_FUN_AF']) AS c, unnest([1, 2, 3, 4, 5]) AS o, unnest(['TAP_FUN', 'TAB_MED', 'TAB_FUN', 'TAB_MED', 'TAB_FUN_AF']) AS k),
    pair AS (SELECT '3_CAT_FUN' AS "column", 'tab_FUN' AS mine, 2 AS priority UNION ALL SELECT '3_CAT_MED', '3_CAT_MED', 1 UNION ALL SELECT '1_CAT_FUN', 'tap_FUN', 2 UNION ALL SELECT '3_CAT_FUN_AF', 'tab_FUN_AF', 2)
    SELECT p.*, (SELECT count(*) FROM sp WHERE ab IS NOT NULL) AS known_rows FROM pair p""")
def map_columns(spark, sf):
    """Header names come from the columns of two wide renderings of the panel."""
    p = ad.supplier_panel(spark, sf)
    mine = p.select(F.col("ap").alias("tap_FUN"), F.col("ab_o").alias("3_CAT_MED"), F.col("ab").alias("tab_FUN"), F.col("ab_o").alias("tab_MED"), F.col("ab_f").alias("tab_FUN_AF"))
    official = p.select(F.col("ab").alias("3_CAT_FUN"), F.col("ab_o").alias("3_CAT_MED"), F.col("ap").alias("1_CAT_FUN"), F.col("ab_f").alias("3_CAT_FUN_AF"), F.col("name").alias("NO_ENTIDADE"))

    def names(df):
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("ordinal")) for i, c in enumerate(df.columns)])
        one = df.agg(F.count(F.lit(1)).alias("rows"))
        return one.select(F.explode(cells).alias("r")).select("r.*", semantic_key(F.col("r.column")).alias("key"))

    known = p.agg(F.count("ab").alias("known_rows"))
    return reconcile.map_columns(names(mine), names(official)).select("*", known.scalar().alias("known_rows"))


@query("u1_union_years", "SELECT entity, year, ab FROM sp")
def union_years(spark, sf):
    p = ad.staged_supplier(spark, sf)
    return sets.union_years([p.where(F.col("year") == y).select("entity", "year", "ab") for y in ad.YEARS])


@query("u2_union_drifting", "SELECT entity, year, CASE WHEN year < 1998 THEN ab END AS tab_FUN, CASE WHEN year < 1998 THEN ap END AS tap_FUN, CASE WHEN year >= 1998 THEN ab END AS \"3_CAT_FUN\", CASE WHEN year > 1999 THEN rp END AS \"2_CAT_FUN\" FROM sp")
def union_drifting(spark, sf):
    p = ad.staged_supplier(spark, sf)
    y = F.col("year")
    old = p.where(y < 1998).select("entity", "year", F.col("ab").alias("tab_FUN"), F.col("ap").alias("tap_FUN"))
    mid = p.where(y.between(1998, 1999)).select("entity", "year", F.col("ab").alias("3_CAT_FUN"))
    new = p.where(y > 1999).select("entity", "year", F.col("ab").alias("3_CAT_FUN"), F.col("rp").alias("2_CAT_FUN"))
    return sets.union_drifting([old, mid, new])


@query("u3_intersect_except_keys", "SELECT 'common' AS side, k FROM (SELECT k FROM ka INTERSECT SELECT k FROM kb) UNION ALL SELECT 'only_first', k FROM (SELECT k FROM ka EXCEPT SELECT k FROM kb)")
def intersect_except(spark, sf):
    a, b = (order_keys(spark, sf, s).select(F.col("o_custkey").alias("k")) for s in "FP")
    return sets.common_keys(a, b).withColumn("side", F.lit("common")).unionByName(sets.only_in_first(a, b).withColumn("side", F.lit("only_first")))


@query("u4_domain_subset", """SELECT 'special' AS "column", count(*) FILTER (WHERE special NOT IN (0, 1)) AS outside FROM sp UNION ALL SELECT 'public', count(*) FILTER (WHERE public NOT IN (0, 1)) FROM sp UNION ALL SELECT 'region', count(*) FILTER (WHERE region NOT IN (0, 1)) FROM sp""")
def domain_subset(spark, sf):
    return sets.domain_violations(ad.supplier_panel(spark, sf), ["special", "public", "region"], [0, 1])


@query("u5_tables_equal", "SELECT a.entity, a.year, a.ab, CAST(1 AS BIGINT) AS surplus FROM sp a WHERE entity % 13 = 1 AND ab IS NOT NULL UNION ALL SELECT entity, year, ab + 0.5, CAST(-1 AS BIGINT) FROM sp WHERE entity % 13 = 1 AND ab IS NOT NULL")
def tables_equal(spark, sf):
    p = ad.supplier_panel(spark, sf).select("entity", "year", "ab")
    changed = p.withColumn("ab", F.when(F.col("entity") % 13 == 1, F.col("ab") + 0.5).otherwise(F.col("ab")))
    return sets.table_differences(p, changed)
