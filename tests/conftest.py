import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from fieldgauge.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "fieldgauge-tests", 4)


@pytest.fixture
def drop(tmp_path):
    """Write files below a fresh inbox: drop(name, text or bytes)."""
    inbox = tmp_path / "inbox"
    inbox.mkdir()

    def write(name, content):
        path = inbox / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        return path

    write.inbox = str(inbox)
    return write
