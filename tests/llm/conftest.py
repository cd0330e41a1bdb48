from __future__ import annotations

import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, k string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty, blank and long texts, repeated rows, and columns of clashing names."""
    texts = [
        None, "", "   ", "one", "one two", "The cat sat on the mat.", "The cat sat on the mat.", "é" * 3_000, "word " * 5_000,
        "a  b   c\n\nd", "Zeile\u0085mit <|endoftext|> darin", "日本語 テキスト", 'token = "0123456789abcdef0123456789abcdef01234567" end',
    ]
    rows = [(i, t, None if i == 3 else "en", None if i == 4 else "src", None if i == 5 else 3, 0.5, "x") for i, t in enumerate(texts)]
    rows += [rows[5], (None, "no id", "en", "src", 5, None, None)]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)
