import pytest

#: Names that clash with columns that operators make for themselves.
CLASHES = ", id string, digest string, bucket string, size string, n string, label string, start string, tokens string, rank string, prefix string"


@pytest.fixture(scope="session")
def records(spark):
    """A table of ``rec_id, text, source, lang`` rows with further columns of clashing names."""

    def make(rows):
        width = CLASHES.count(",")
        return spark.createDataFrame([(*r, *["x"] * width) for r in rows], f"rec_id bigint, text string, source string, lang string{CLASHES}")

    return make
