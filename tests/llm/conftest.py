import pytest


@pytest.fixture()
def documents(spark):
    """A maker of documents tables with extra columns whose names clash with inner ones."""
    def make(rows):
        from pyspark.sql import functions as F

        schema = "doc_id long, text string, lang string, source string, n_chars long"
        df = spark.createDataFrame([(*r, *(None,) * (5 - len(r))) for r in rows], schema)
        return df.withColumns({c: F.lit(1) for c in ("_row", "_block", "fp", "_id", "score_", "size")})

    return make
