import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from brevira.session import local_session

    session = local_session(4, 4, "4g", "tests")
    yield session
    session.stop()
