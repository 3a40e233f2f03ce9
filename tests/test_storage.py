from types import SimpleNamespace

import pytest

from pathloom import storage


def test_tables_come_back_and_go(spark, monkeypatch):
    monkeypatch.setattr(storage, "_written", {})  # other tests' tables stay
    a, b = (storage.stored(spark.range(n), "some") for n in (3, 5))
    assert (a.count(), b.count()) == (3, 5) and a.stored_at != b.stored_at
    storage.discard(a, None, spark.range(1))
    with pytest.raises(Exception, match="(?i)exist"):
        a.collect()
    assert b.count() == 5 and storage.clear(spark) >= 1 and storage.clear(spark) == 0


@pytest.mark.parametrize(("master", "fine"), [("local[4]", True), ("local", True), ("yarn", False), ("spark://host:7077", False), ("local-cluster[3,2,1000]", False)])
def test_a_cluster_needs_a_shared_folder(master, fine):
    class Conf(dict):
        def get(self, k, d=None):
            return d

    session = SimpleNamespace(conf=Conf(), sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))
    if fine:
        assert storage.shared_dir(session).startswith("file:///")
    else:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            storage.shared_dir(session)
