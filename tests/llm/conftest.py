import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from skylag.llm.tables import reach_workers  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    reach_workers(spark)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    base = " ".join(f"word{k}" for k in range(60))
    long = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))
    rows = [(1, base, "en", "a", 1), (2, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base + " more", None, "b", 2),
            (4, None, "en", None, None), (5, "", None, "b", 0), (6, " \n\t ", "en", "b", 4), (None, base, "en", "c", 3),
            (7, long, "fr", "c", 4), (8, long + " end", "fr", "c", 4), (9, "123 456", "en", "c", 7), (10, "a b a b " * 200, "en", "c", 9)]
    extra = [(*r, "x", 1, "y", [1], 0.5, "z") for r in rows]
    return spark.createDataFrame(extra, DOCUMENTS + ", component_id string, n int, keep_id string, ids array<int>, score double, marks string")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)
