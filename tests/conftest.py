import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from codeloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, memory="8g", app="codeloom-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def files(spark):
    """Turns ``{path: text}`` or ``[(project, path, text)]`` into a file table."""

    def build(texts):
        rows = [("p", p, t) for p, t in texts.items()] if isinstance(texts, dict) else texts
        return spark.createDataFrame(rows, "project string, path string, content string")

    return build


@pytest.fixture(scope="session")
def nodes_of(files):
    from codeloom.operators import extract, scan
    from codeloom.session import stage

    return lambda texts: stage(extract.file_nodes(scan.source_files(files(texts))), "test-nodes")


@pytest.fixture(scope="session")
def node(nodes_of):
    """The extracted symbols of one file, as plain values."""

    def build(path, text):
        return nodes_of({path: text}).first().asDict(recursive=True)

    return build
