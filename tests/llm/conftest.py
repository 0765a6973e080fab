"""Small documents with every awkward case, and the rows of the smallest driver table."""

import pytest
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(400)]
PASSAGE = " ".join(WORDS[:60])
#: doc_id, text, extra columns whose names meet the operators' own
ODD = [
    (1, None, "a", 0.5, 7),
    (2, "", "b", 0.5, 7),
    (3, f"start {PASSAGE} end", "c", 0.1, 7),
    (4, f"other words {PASSAGE} here", "d", 0.1, 8),
    (5, f"other words {PASSAGE} here", "e", 0.1, 8),
    (5, f"other words {PASSAGE} here", "e", 0.1, 8),
    (None, f"nameless {PASSAGE}", None, None, None),
    (None, None, None, None, None),
    (6, "  spaced\tout \n\n lines é 漢字   😀 ", "f", 0.2, 9),
    (7, "long " * 5000 + "x" * 20000, "g", 0.2, 9),
    (8, "Mail a.b@mail1.example.com or +49 (30) 1234-5678, card 4111 1111 1111 1111, host 10.0.0.255", "h", 0.3, 9),
    (9, "one", "i", 0.3, 9),
]
ODD_SCHEMA = "doc_id long, text string, spans string, score double, th int"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, ODD_SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], T._parse_datatype_string(ODD_SCHEMA))


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def texts(small):
    return {r.doc_id: r.text or "" for r in small.collect()}
