import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang[, source]]), with a further column whose name clashes with a helper's."""

    def build(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOC).repartition(3)
        return df.selectExpr("*", "'x' AS _key", "1 AS row", "2 AS n", "'y' AS key") if extra else df

    return build
