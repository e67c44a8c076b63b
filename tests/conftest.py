import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from loomspan.session import session

    made = session("local[4]", "tests", shuffle=4)
    made.sparkContext.setLogLevel("ERROR")
    return made
