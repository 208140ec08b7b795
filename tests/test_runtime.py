import os

import pytest

from twintable import runtime


class Stub:
    """A session on a cluster without a shared folder."""

    def __init__(self, master):
        self.master, self.conf, self.sparkContext, self._jsc = master, self, self, self

    def sc(self):
        return self

    def getCheckpointDir(self):
        return self

    def isDefined(self):
        return False

    def getConf(self):
        return self

    def get(self, *_):
        return None


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,3000]", "k8s://host"])
def test_a_cluster_without_a_shared_folder_is_an_error(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.checkpoint_dir(Stub(master))


def test_scratch_tables_go_and_kept_ones_stay(spark):
    df = spark.range(10)
    with runtime.scratch(spark):
        inner = runtime.cut(df)
        a, b = runtime.cut_all(df, inner.where("id > 4"))
        kept = runtime.cut(b, keep=True)
        held = inner.inputFiles() + a.inputFiles()
    assert sorted(r.id for r in kept.collect()) == [5, 6, 7, 8, 9]
    assert held and not any(os.path.exists(p.removeprefix("file://").removeprefix("file:")) for p in held)
    with pytest.raises(ZeroDivisionError), runtime.scratch(spark):
        1 / 0
    assert runtime.cut(df).count() == 10


def test_release_gives_native_memory_back(spark, monkeypatch):
    trimmed, real = [], runtime.trim
    monkeypatch.setattr(runtime, "trim", lambda s: trimmed.append(real(s)))
    runtime.release(spark)
    assert trimmed == [True]
