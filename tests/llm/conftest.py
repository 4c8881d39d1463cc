import pytest

#: Names that operators use for columns of their own.
CLASHES = ["n_words", "kept", "id", "score", "node", "runs", "hit_spans", "host_rate", "mix_slot", "n_tokens", "__cw_id", "__cw_s", "__cw_row"]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank, short, long and repeated texts; a null id and source; columns with clashing names."""
    body = " ".join(f"word{i % 97}x{i % 13}" for i in range(3000))
    rows = [
        (1, None, "a"),
        (2, "", "a"),
        (3, " \n\t ", None),
        (4, "one two", "a"),
        (5, body, "b"),
        (5, body, "b"),
        (6, body + " tail", "b"),
        (None, body, "b"),
        (7, "é" * 10, None),
        (8, body.replace("word3x", "ward3x"), "c"),
    ]
    df = spark.createDataFrame([(i, t, s, *range(len(CLASHES))) for i, t, s in rows], "doc_id long, text string, source string, " + ", ".join(f"`{c}` long" for c in CLASHES))
    return df


@pytest.fixture(scope="session")
def none(spark, odd):
    return odd.limit(0)
