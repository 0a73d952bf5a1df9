import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from foliolake.session import local_session

    session = local_session(8, 8, "12g")
    session.sparkContext.setLogLevel("OFF")
    import __spark_entry__  # noqa: F401  functions travel to Python workers by value

    yield session
    session.stop()


@pytest.fixture
def scan_of(spark):
    """Scanlines from ``{page_id: rows of values}``."""

    def build(pages):
        rows = [(p, y, [int(v) for v in line]) for p, lines in pages.items() for y, line in enumerate(lines)]
        return spark.createDataFrame(rows, "page_id bigint, y int, values array<int>")

    return build


@pytest.fixture
def plane_of():
    """Pages back as ``{page_id: list of rows}``."""

    def collect(df, values="values"):
        pages = {}
        for r in sorted(df.select("page_id", "y", values).collect(), key=lambda r: (r[0], r[1])):
            pages.setdefault(r[0], []).append(list(r[2]))
        return pages

    return collect
