import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loomlog.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", "tests", 4, **{"spark.driver.memory": "4g"})
    yield s
    s.stop()
