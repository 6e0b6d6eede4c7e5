import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from leafsift import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session("leafsift-tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_blocks(spark):
    def make(reports):
        """Blocks from {filename: {page: [text, ...]}}."""
        rows = [(f, p, i, t) for f, pages in reports.items() for p, texts in pages.items() for i, t in enumerate(texts, 1)]
        return spark.createDataFrame(rows, "filename string, page int, paragraph int, text string")
    return make
