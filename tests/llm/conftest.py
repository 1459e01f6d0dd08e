from __future__ import annotations

import pytest
import public_tokenizers
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.01"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score double, n long, class long, token long"
LONG = "Word one two three four. Plain text, again and again " * 4000


def doubled(times: int) -> tuple[str, str]:
    """A word and its complement, of ``2 ** times`` letters, that polynomial hashes confuse."""
    a, b = "a", "b"
    for _ in range(times):
        a, b = a + b, b + a
    return a, b


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 1, 0.0, 1, 1, 1),
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 1, 0.0, 1, 1, 1),
        (2, "The Quick brown fox jumps over the lazy dog", "en", None, None, None, None, None, None),
        (3, None, None, None, None, None, None, None, None),
        (4, "", "en", "b", 0, 0.0, 0, 0, 0),
        (5, " \n\t ", "en", "b", 4, 0.0, 0, 0, 0),
        (6, LONG, "en", "b", 4, 0.0, 0, 0, 0),
        (7, "é x\n\né x\né x", "fr", "\U0001f600", 4, 0.0, 0, 0, 0),
        (None, "no id at all", "en", "a", 4, 0.0, 0, 0, 0),
        (8, "one", "en", "a", 4, 0.0, 0, 0, 0),
        (9, "ONE", "en", "a", 4, 0.0, 0, 0, 0),
    ]
    words = [*doubled(10), *doubled(12)]
    rows += [(20 + i, w, "en", "a", 4, 0.0, 0, 0, 0) for i, w in enumerate(words)]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def vocabulary():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def tokenizer(vocabulary):
    out = Tokenizer.from_file(vocabulary)
    out.encode_special_tokens = True
    return out
