import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, schema=DOCS):
        """rows: (doc_id, text[, lang])"""
        return spark.createDataFrame([(i, t, (r or ["en"])[0], "s", None if t is None else len(t)) for i, t, *r in rows], schema)

    return make


# Null, empty, white space only, ties, repeated rows, long texts: every operator takes them.
ODD = [(1, None), (2, ""), (3, " \t\n\x0b\f\r "), (4, "one"), (5, "one two"), (6, "ÄÖ ß \U0001f600 x\x00y"), (7, "a\n\nb\n"),
       (7, "a\n\nb\n"), (8, "word " * 30_000), (9, "x" * 70_000), (None, "no id"), (10, "<|endoftext|> <s> ▁▁ <0x0A>")]


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(ODD)
