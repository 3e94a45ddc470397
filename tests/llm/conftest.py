import pytest
from pyspark.sql import functions as F

# Names that operators use for results or inside, as columns that come with the input.
CLASHING = [
    "size", "shard", "slot", "kept", "n_words", "clean_text", "n_tokens", "copies", "shards",
    "taken", "target", "row", "item", "digest", "block", "key", "keys", "label", "score",
    "lang_pred", "held_out", "first", "_src", "_key", "wanted", "spans", "removed",
]
LONG = " ".join(f"word{i % 997}x{i % 89}" for i in range(60_000))


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source)."""

    def make(rows, clashing=False):
        full = [(*r, *(["en", "s"][len(r) - 2 :] if len(r) < 4 else [])) for r in rows]
        full = [(i, t, l, s, None if t is None else len(t)) for i, t, l, s in full]
        df = spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long"
        )
        if clashing:
            df = df.select("*", *(F.lit("x").alias(c) for c in CLASHING))
        return df

    return make


@pytest.fixture
def odd():
    """Rows with everything that may be odd: nulls, blanks, a long text, repeated rows."""
    line = "The quick brown fox jumps over the lazy dog, and then it sleeps a while."
    return [
        (1, line),
        (1, line),
        (2, None),
        (None, line + " Really."),
        (None, None),
        (3, ""),
        (4, " \n\t "),
        (5, LONG),
        (6, "one"),
        (7, line),
    ]
