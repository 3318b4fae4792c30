import os
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)
sys.path.insert(0, os.path.join(HERE, "tests"))
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (HERE, os.environ.get("PYTHONPATH")) if x)


@pytest.fixture(scope="session")
def spark():
    from corpusloom.session import local_session

    return local_session(cores=4, shuffle_partitions=4, memory="4g")
