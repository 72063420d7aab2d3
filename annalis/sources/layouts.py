"""From sheets of any layout generation to the typed panel: columns by position, checked by label."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalis import fixed_values as fv
from annalis.functions.scalar import canonical_category, clean_rate_strict, normalise_id, normalise_spaces
from annalis.operators.profile import outside_components


class LabelError(ValueError):
    """A column does not carry the label that its position must have."""


def by_layout(year: Column, a: Column, b: Column) -> Column:
    return F.when(year <= fv.LAST_YEAR_OF_LAYOUT_A, a).otherwise(b)


def rate_cell(year: Column, measure: fv.Measure, stage: str) -> Column:
    """The cell of a rate: its position depends on the layout of the year."""
    a, b = (fv.POSITIONS[x][stage] + measure.shift - 1 for x in "AB")
    return by_layout(year, F.get("cells", F.lit(a)), F.get("cells", F.lit(b)))


def component_cells(measure: fv.Measure, stage: str, layout: str) -> Column:
    first, last = fv.COMPONENT_POSITIONS[layout][stage]
    return F.slice("cells", first + measure.shift, last - first + 1)


def rate_names() -> list[str]:
    return [f"{m.name}_{s}" for m in fv.MEASURE_CODES for s in fv.STAGES]


def expected_labels(year: Column) -> Column:
    """Array of (rate, position, label pattern) that a sheet of the year must have."""
    out = F.lit(None)
    for first, last, patterns in reversed(fv.LABEL_PATTERNS):
        layout = "A" if last <= fv.LAST_YEAR_OF_LAYOUT_A else "B"
        rows = F.array(
            *[
                F.struct(
                    F.lit(f"{m.name}_{s}").alias("rate"),
                    F.lit(fv.POSITIONS[layout][s] + m.shift).alias("position"),
                    F.lit(patterns[s].format(title=m.title, old=m.old_prefix, digit=m.digit)).alias("pattern"),
                )
                for m in fv.MEASURE_CODES
                for s in fv.STAGES
            ]
        )
        out = F.when(year.between(first, last), rows).otherwise(out)
    return out


def label_violations(headers: DataFrame, year: str = "ANO") -> DataFrame:
    """Header labels that do not match the pattern of their position. ``headers`` has names per sheet."""
    rows = headers.select("file", "sheet", year, "names", F.explode(expected_labels(F.col(year))).alias("x"))
    label = normalise_spaces(F.coalesce(F.get("names", F.col("x.position") - 1), F.lit("")))
    return rows.select("file", "sheet", year, "x.*", label.alias("label")).where(~F.rlike(F.col("label"), F.col("pattern")))


def assert_label(headers: DataFrame, year: str = "ANO") -> None:
    bad = label_violations(headers, year).limit(5).collect()
    if bad:
        raise LabelError("; ".join(f"{r[year]}: position {r.position} must be {r.rate} but is labelled {r.label!r}" for r in bad))


IDENTITY = ["CO_ENTIDADE", "NO_ENTIDADE", "CO_MUNICIPIO", "NO_MUNICIPIO", "LOCALIZACAO", "DEPENDENCIA"]


def identity_positions(headers: DataFrame, year: str = "ANO") -> DataFrame:
    """Per sheet the positions of the identity columns, found by the names they have in the year."""
    y = F.col(year)

    def place(field: str) -> Column:
        wanted = reduce(
            lambda acc, p: F.when(y.between(p[0], p[1]), p[2][field]).otherwise(acc), reversed(fv.IDENTITY_NAMES), F.lit(None).cast("string")
        )
        return F.array_position("_names", wanted).cast("int")

    clean = headers.withColumn("_names", F.transform("names", lambda x: normalise_spaces(x)))
    return clean.select("file", "sheet", *[place(f).alias(f"_at_{f}") for f in IDENTITY])


def identity_cell(field: str) -> Column:
    return F.when(F.col(f"_at_{field}") > 0, F.get("cells", F.col(f"_at_{field}") - 1))


def harmonise(rows: DataFrame, headers: DataFrame, year: str = "ANO") -> DataFrame:
    """The selected panel: identity, location, dependency and twelve rates.

    A projection of the rows; only the small table of positions per sheet is joined.
    """
    y = F.col(year)
    return rows.join(identity_positions(headers, year), ["file", "sheet"]).select(
        y.cast("int").alias("ANO"),
        normalise_id(identity_cell("CO_ENTIDADE")).alias("CO_ENTIDADE"),
        F.trim(identity_cell("NO_ENTIDADE")).alias("NO_ENTIDADE"),
        normalise_id(identity_cell("CO_MUNICIPIO")).alias("CO_MUNICIPIO"),
        F.trim(identity_cell("NO_MUNICIPIO")).alias("NO_MUNICIPIO"),
        F.trim(identity_cell("LOCALIZACAO")).alias("LOCALIZACAO"),
        canonical_category(identity_cell("DEPENDENCIA")).alias("DEPENDENCIA"),
        *[clean_rate_strict(rate_cell(y, m, s)).alias(f"{m.name}_{s}") for m in fv.MEASURE_CODES for s in fv.STAGES],
    )


def totals_outside_components(rows: DataFrame, year: str = "ANO") -> DataFrame:
    """Per year the totals outside the range of their grades: a mix-up of positions shows here."""
    y = F.col(year)
    flags = []
    for m in fv.MEASURE_CODES:
        for s in fv.STAGES:
            cells = by_layout(y, component_cells(m, s, "A"), component_cells(m, s, "B"))
            parts = F.transform(cells, lambda x: clean_rate_strict(x))
            flags.append(outside_components(clean_rate_strict(rate_cell(y, m, s)), [F.array_min(parts), F.array_max(parts)]))
    return rows.groupBy(year).agg(F.sum(reduce(lambda a, b: a + b, flags)).alias("outside"))
