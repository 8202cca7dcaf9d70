import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from quillstone.session import local_session

    session = local_session(4, "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    yield session
    session.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    if not Path(SMALL).exists():
        pytest.skip("driver tables are not here")
    return SMALL
