import pytest
from odd_rows import CLASHES, TEXTS


@pytest.fixture(scope="session")
def clashing(spark):
    """The odd rows with a column of every name that might clash, each holding its own name."""
    rows = [(i, t, s, *CLASHES) for i, t, s in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES))
