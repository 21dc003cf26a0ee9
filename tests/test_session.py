from types import SimpleNamespace

import pytest

from cashweave.session import ensure_checkpoint_dir


def _session(master, configured=None):
    made = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=made.append)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: configured), sparkContext=context), made


def test_a_cluster_must_name_the_shared_folder(tmp_path, monkeypatch):
    monkeypatch.setenv("TMPDIR", str(tmp_path))
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(_session("spark://host:7077")[0])
    session, made = _session("spark://host:7077", "hdfs:///shared")
    assert ensure_checkpoint_dir(session) == "hdfs:///shared" and made == ["hdfs:///shared"]
    session, made = _session("local[2]")
    assert ensure_checkpoint_dir(session).startswith(str(tmp_path)) and len(made) == 1
