import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from emberfield.session import build_session

    session = build_session("tests", "local[*]", **{
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("work")),
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        # Tests read the plans of their own executions, which the whole suite would push out of the default thousand.
        "spark.sql.ui.retainedExecutions": "20000", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a DataFrame as plain tuples, sorted."""
    def collect(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=repr)
    return collect
