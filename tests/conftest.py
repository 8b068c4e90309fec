import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from inkblot.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {"spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("scratch"))}
    session = get_spark("tests", 8, **conf)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture()
def texts(spark):
    """Rows (doc_id, text) from a list of texts."""

    def make(values, **extra):
        rows = [(i, v, *extra.values()) for i, v in enumerate(values)]
        schema = "doc_id bigint, text string" + "".join(f", {c} string" for c in extra)
        return spark.createDataFrame(rows, schema)

    return make
