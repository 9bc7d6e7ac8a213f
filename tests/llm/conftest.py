import os

import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return FOLDER


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with null ids and texts, empty and long texts, copies, repeated rows, and columns named like the operators' own."""
    a = " ".join(f"word{k % 37} and{k % 11}" for k in range(60))
    rows = [
        (1, a, "en", "s0", 0, 7),
        (2, a, "en", "s0", 0, 7),
        (2, a, "en", "s0", 0, 7),
        (3, None, "en", "s1", None, 7),
        (4, "", None, None, 0, None),
        (5, "  \n\t ", "de", "s1", 0, 7),
        (None, "null id here", "de", "s1", 0, 7),
        (None, None, None, None, None, None),
        (6, "x", "de", "s2", 0, 7),
        (7, "Grüße an alle, die Öfen bauen " * 3000, "de", "s2", 0, 7),
        (8, a.upper(), "en", "s0", 0, 7),
        (9, "prefix " + a + " suffix", "en", "s0", 0, 7),
        (10, "a" * 5000, "fr", "s3", 0, 7),
        (11, "12 34 !!", "fr", "s3", 0, 7),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, block int")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("doc_id < 0")
