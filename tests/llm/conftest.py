import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

ODD = [
    None, "", " ", "\n\n", "a", "It's 12 o'clock,  isn't it?\r\n\tYes.", "naïve Straße Ünïcode 東京 42² ½  x y",
    "<|endoftext|>", "one<|endoftext|>two <|endoftext|> <|startoftext|>", "x\x1c\x1dy \x85 z w", "🙂🙃 é 가",
    "word " * 3000, "y" * 20000, "...!!!<|", "  lead and trail  ",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Texts of all odd kinds, repeated rows and ids, and columns with the names operators use."""
    rows = [(i, t, i % 3, f"s{i}") for i, t in enumerate(ODD)] + [(4, "a", 0, "twice"), (4, "b a", 0, "twice"), (None, "no id", 1, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, `row` string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
