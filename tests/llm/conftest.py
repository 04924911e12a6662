import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Build a documents table of (doc_id, text) rows with columns whose names clash with internal ones."""

    def build(rows):
        return spark.createDataFrame(
            [(i, t, "en", "src", 1, "x", "y", "z", "m", "h", 3, 4) for i, t in rows],
            "doc_id long, text string, lang string, source string, n_chars long, digest string, keep_id string, "
            "kept_id string, mark string, hit_mark string, words int, rank int",
        )

    return build
