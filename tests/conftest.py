import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import local_session  # noqa: E402

MANIFEST_DDL = (
    "full_path string, relative_path string, filename string, file_extension string, "
    "file_size bigint, prefix_hash string, full_hash string, position bigint"
)


@pytest.fixture(scope="session")
def spark():
    s = local_session(shuffle_partitions=8, app="tidemark-tests")
    yield s
    s.stop()


def rows(spark, data, root="/lake"):
    """Manifest rows from (name, size, prefix, full) tuples."""
    out = []
    for i, (name, size, p, f) in enumerate(data):
        out.append((f"{root}/{name}", name, name.rsplit("/", 1)[-1], "." + name.rsplit(".", 1)[-1], size, p, f, i))
    return spark.createDataFrame(out, MANIFEST_DDL)


@pytest.fixture
def mk(spark):
    return lambda data, root="/lake": rows(spark, data, root)
