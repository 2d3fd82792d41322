import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[1], os.environ.get("PYTHONPATH", "")])  # for the workers


@pytest.fixture(scope="session")
def spark():
    from codequarry.session import local_session

    return local_session(4, 4)
