"""Column expressions: cleaning, flags, rounding and count reconstruction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from annalis.fixed_values import CATEGORY_SYNONYMS, MEASURE_CODES, MISSING_MARKER, PRIVATE_CATEGORY, STAGE_PATTERNS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_even(c: Column | str) -> Column:
    """Round to a whole number, ties to even."""
    return F.rint(col(c))


def ratio(num: Column, den: Column) -> Column:
    """Quotient as a double, NULL on a zero denominator."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def to_number_lenient(c: Column | str) -> Column:
    """Text to double; anything that is not a number becomes NULL."""
    return nan_to_null(F.trim(col(c).cast("string")).try_cast("double"))


def clean_rate_strict(c: Column | str, marker: str = MISSING_MARKER) -> Column:
    """Text to double; the marker is missing, any other text stops the job."""
    text = col(c).cast("string")
    number = text.try_cast("double")
    bad = text.isNotNull() & (text != marker) & number.isNull()
    message = F.concat(F.lit("not a rate: "), text)
    return F.when(bad, F.raise_error(message).cast("double")).otherwise(nan_to_null(number))


def normalise_id(c: Column | str) -> Column:
    """Identifier through a whole number to text: ' 014 ' and '14.0' both give '14'."""
    text = F.trim(col(c).cast("string"))
    whole = F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))
    return whole.cast("string")


def canonical_category(c: Column | str, synonyms: dict[str, str] = CATEGORY_SYNONYMS) -> Column:
    text = F.trim(col(c))
    return reduce(lambda acc, kv: F.when(text == kv[0], kv[1]).otherwise(acc), synonyms.items(), text)


def normalise_spaces(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def flag_public(c: Column | str, private: str = PRIVATE_CATEGORY) -> Column:
    return (col(c) != private).cast("int")


def flag_any_present(cols: list[str]) -> Column:
    return F.coalesce(*[F.col(c) for c in cols]).isNotNull().cast("int")


def flag_period(year: Column | str, years: list[int]) -> Column:
    return col(year).isin(years).cast("int")


def coalesce_candidates(candidates: list[str], available: list[str]) -> Column:
    """First numeric value among the candidate columns that exist."""
    by_upper = {c.upper().strip(): c for c in available}
    present = [by_upper[c.upper()] for c in candidates if c.upper() in by_upper]
    if not present:
        return F.lit(None).cast("double")
    return F.coalesce(*[to_number_lenient(F.col(f"`{c}`")) for c in present])


def semantic_rules() -> list[tuple[str, str]]:
    """(pattern, key) pairs for rate column names; the first that matches counts."""
    coded = [(rf"^(?:{m.digit}_CAT|(?i:{m.key}))_(.+)$", f"{m.key}_$1") for m in MEASURE_CODES]
    spelled = [
        (rf"(?iu)^(?:taxa de )?{m.stem}{pattern}.*$", f"{m.key}_{stage}")
        for m in MEASURE_CODES
        for pattern, stage in STAGE_PATTERNS
    ]
    return coded + spelled


def semantic_key(name: Column | str) -> Column:
    """Reduce a rate column name of any layout generation to one key such as TAP_FUN_AF."""
    name = col(name)
    return F.coalesce(*[F.when(name.rlike(pattern), F.regexp_replace(name, pattern, key)) for pattern, key in semantic_rules()])


def null_skipping_sum(cols: list[str]) -> Column:
    """Row sum that is NULL only when every part is NULL."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])
    return F.when(F.coalesce(*[F.col(c).cast("double") for c in cols]).isNotNull(), total)


def row_mean(cols: list[Column]) -> Column:
    """Mean of the non-NULL columns of the row."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols])
    known = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return ratio(total, known)


def reconstruct_denominator(
    approval: str, failure: str, dropout: str, size: str, window: float = 0.35, tol: float = 0.051, near: int = 64, block: int = 4096
) -> Column:
    """Whole denominator, nearest to ``size``, that reproduces three one-decimal rates.

    Candidates lie in intervals of growing distance from the size, so the first interval
    with a hit holds the nearest one, and no array is longer than an interval.

    A count is off its rate by at most half a unit. With s = 100 - approval - failure -
    dropout, the third rate is missed by |s| up to 100 / n, so that no n beyond
    100 / (|s| - tol) can match when |s| > tol. When |s| < tol, every n beyond
    100 / (tol - |s|) matches (but for ties that make the third count -1, never twice in a
    row), and the first interval has a hit. One-decimal rates thus search at most about
    2,800 candidates whatever the size is.
    """
    ap, rp, ab, n0 = (F.col(c).cast("double") for c in (approval, failure, dropout, size))
    first = F.greatest(F.lit(1), F.floor(n0 * (1 - window)) - 2)
    rest = 100 - ab - rp
    slack = F.abs(rest - ap) - tol

    def ceiling(excess: Column) -> Column:
        return F.when(excess > 1e-9, F.ceil(100 / excess) + 1)

    last = F.least(F.ceil(n0 * (1 + window)) + 2, ceiling(slack), ceiling(-rest))

    def compatible(n: Column) -> Column:
        b, r = F.rint(ab * n / 100), F.rint(rp * n / 100)
        a = n - b - r
        return (
            (a >= 0)
            & (F.abs(100 * b / n - ab) <= tol)
            & (F.abs(100 * r / n - rp) <= tol)
            & (F.abs(100 * a / n - ap) <= tol)
        )

    def nearest_hit(inner: Column, outer: Column) -> Column:
        """Among candidates whose distance from the size is in [inner, outer)."""

        def hits(low: Column, high: Column) -> Column:
            low, high = F.greatest(low, first), F.least(high, last)
            return F.filter(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>")), compatible)

        below = hits(F.floor(n0 - outer) + 1, F.floor(n0 - inner))
        above = hits(F.ceil(n0 + inner), F.ceil(n0 + outer) - 1)
        return F.array_min(F.transform(F.concat(below, above), lambda n: F.struct(F.abs(n - n0).alias("gap"), n.alias("n"))))["n"]

    # distances up to the farthest candidate; a window above the last possible one starts beyond it
    reach = F.greatest(n0 - first, last - n0)
    blocks = F.when(reach >= near, F.sequence(F.lit(0).cast("bigint"), F.floor((reach - near) / block)))
    wider = F.aggregate(
        blocks,
        F.lit(None).cast("bigint"),
        lambda best, i: F.coalesce(best, nearest_hit(near + i * block, near + (i + 1) * block)),
    )
    usable = ap.isNotNull() & rp.isNotNull() & ab.isNotNull() & (n0 > 0)
    return F.when(usable, F.coalesce(nearest_hit(F.lit(0), F.lit(near)), F.when(first <= last, wider))).cast("int")


def grade_enrolment(year: Column | str, last_year: int, single: str, parts: list[str]) -> Column:
    """One column in the last year, otherwise the sum of the parts (NULL when all are NULL)."""
    return F.when(col(year) == last_year, F.col(single).cast("double")).otherwise(null_skipping_sum(parts))
