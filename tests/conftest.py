from __future__ import annotations

import pytest

from newsloom import session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    found = session.build("local[4]", 4, "4g", **{"spark.checkpoint.dir": f"file://{folder}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    yield found
    found.stop()
