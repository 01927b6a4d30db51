import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from skimdex.session import local_session

    s = local_session("*", shuffle_partitions=8, app="skimdex-tests")
    yield s
    s.stop()


def make_files(spark, rows, target="/t"):
    """rows: list of (path, content) -> files DataFrame."""
    import datetime as dt

    data = [
        (target, p, c, len(c.encode("utf-8")), dt.datetime(2024, 1, 1, 0, 0, i))
        for i, (p, c) in enumerate(rows)
    ]
    return spark.createDataFrame(
        data, "target_dir string, path string, content string, size_bytes bigint, mtime timestamp"
    )
