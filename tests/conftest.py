import pytest

from barline.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, 4)
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))
    return session
