import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture()
def make_docs(spark):
    """A table like ``documents`` from (doc_id, text) or (doc_id, text, lang, source)."""

    def make(rows, *more):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        for name in more:  # columns whose names the operators use inside
            df = df.selectExpr("*", f"1 as {name}")
        return df.repartition(3)

    return make


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
