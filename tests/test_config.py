import pytest

from loghelm.__main__ import main
from loghelm.config import decode, duration_ns
from loghelm.schema import RefusedError

GOOD = """# comment
storage:
  path: "store"
source:
  id: live
  path: mail.log
  poll_interval: 1.5s
"""


def test_good():
    c = decode(GOOD, "/etc/x")
    assert (c.storage["path"], c.source.path, c.source.poll_interval) == ("/etc/x/store", "/etc/x/mail.log", 1_500_000_000)
    assert decode("", "/x").source is None and duration_ns("d", "1m30s") == 90 * 10**9


@pytest.mark.parametrize("text", ["a", "- a", "storage:", "storage:\n  path:", "storage: x", "other:\n  a: b", "storage:\n  path: a\n  path: b", "source:\n  id: a", "source:\n  id: a\n  path: b\n  start_at: middle", "source:\n  id: a\n  path: b\n  resume_origins: 0", "source:\n  id: &x a\n  path: b", "storage:\n  path: null", "source:\n  id: a\n  path: b\n  poll_interval: 5", "source:\n  id: a\n   path: b"])
def test_bad(text):
    with pytest.raises(RefusedError):
        decode(text, "/x")


def test_commands(tmp_path, capsys):
    p = tmp_path / "c.yaml"
    p.write_text(GOOD)
    assert main(["check-config", str(p)]) == 0 and main(["check-config", str(tmp_path / "none")]) == 1 and main(["what"]) == 2
    p.write_text("nope")
    assert main(["check-config", str(p)]) == 2
    assert "valid" in capsys.readouterr().out
