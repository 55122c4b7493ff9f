import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dunlake.session import CHECKPOINT_KEY, local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", partitions=4)
    if not session.conf.get(CHECKPOINT_KEY, None):
        session.conf.set(CHECKPOINT_KEY, tempfile.mkdtemp(prefix="dunlake-tests-"))
    return session


@pytest.fixture
def evaluate(spark):
    """Results of a column expression over a list of text tuples."""

    def run(expression, rows, names=("c0", "c1", "c2")):
        width = len(rows[0])
        schema = ", ".join(f"{name} string" for name in names[:width]) + ", at int"
        df = spark.createDataFrame([(*row, i) for i, row in enumerate(rows)], schema)
        return [r[0] for r in df.select(expression.alias("x"), "at").orderBy("at").collect()]

    return run
