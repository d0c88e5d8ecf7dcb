import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def plain(spark):
    """(doc_id, text) rows as a table like `documents`."""

    def make(rows, source="s"):
        full = [(i, t, "en", s[0] if s else source, None if t is None else len(t)) for i, t, *s in rows]
        return spark.createDataFrame(full, COLUMNS)

    return make


@pytest.fixture(scope="session")
def odd(spark, plain):
    """Nulls in all columns, empty and blank texts, a very long one, ties, repeated rows and control strings."""
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000))
    rows = [(1, "plain words of a small text in one line"), (2, None), (3, ""), (4, " \t\n "), (5, long), (6, "x" * 70_000), (7, "plain words of a small text in one line"), (7, "plain words of a small text in one line"), (None, "no id here"), (None, None), (8, "<|im_end|>\\<|endoftext|> \x00 漢字 😀 ▁▁ é\xa0z"), (9, "a\nb\nb\n\nb")]
    return plain([(i, t, [None, "s", "ü", ""][n % 4]) for n, (i, t) in enumerate(rows)])


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd table with further columns that are named like the operators' own."""
    from pyspark.sql import functions as F

    names = "size shard slot key bytes node label fp component_id z a b id start n_tokens _size _tie _copies _source position n_words kept score label_id toxic gone item coverage weight expected".split()
    return odd.select("*", *(F.lit(f"own {n}").alias(n) for n in names))


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, None, None), (None, 0, 1), (7, 0, 1), (7, 1, 0), (99, 0, 0)], "doc_id bigint, quality int, toxic int")
