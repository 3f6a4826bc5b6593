import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use for columns of their own.
CLASHING = (
    "copy", "score", "lang_pred", "spans", "size", "rate", "target", "draw", "bucket", "part",
    "kept", "key", "rep", "label", "version", "hash", "place", "row", "changed", "members",
)


@pytest.fixture(scope="session")
def corpus(spark):
    """Rows of documents as a DataFrame, with columns of clashing names on request."""
    from pyspark.sql import functions as F

    def make(rows, clashing=False):
        full = [tuple(r) + (None, None, None, None, None)[len(r) :] for r in rows]
        df = spark.createDataFrame(full, COLUMNS)
        if clashing:
            df = df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})
        return df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank, very long and repeated texts."""
    prose = "the quick brown fox jumps over the lazy dog and runs away from here "
    return [
        (1, prose * 3, "en", "a", 9),
        (2, None, "en", "a", None),
        (3, "", None, "b", 0),
        (4, " \t\n ", "en", None, 4),
        (5, prose * 6000, "en", "a", 0),
        (6, "der schnelle braune fuchs springt und läuft über die straße " * 4, "de", "b", 1),
        (7, "x" * 300_000, None, None, None),
        (1, prose * 3, "en", "a", 9),
        (None, prose * 3, "en", "a", 9),
        (None, None, None, None, None),
        (8, "one two three", "en", "c", 3),
        (9, "call +1 (456) 555-2186 or a.b@c.example now", "en", "c", 3),
    ]
