import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pagesift.session import get_spark

    s = get_spark(app="tests", cores="4", partitions=4)
    yield s
    s.stop()
