"""The shared folder comes from the session; a local one only when unset."""

from __future__ import annotations

import os

import pytest

from paylens.session import shared_dir, unique_shared_path


class _Conf:
    def __init__(self, values):
        self.values = dict(values)

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


class _Ctx:
    def __init__(self, ckpt=None, master="local[2]"):
        self.ckpt = ckpt
        self.master = master
        self.set_calls = []

    def getCheckpointDir(self):
        return self.ckpt

    def setCheckpointDir(self, d):
        self.set_calls.append(d)
        self.ckpt = d


class _Session:
    def __init__(self, conf, ckpt=None, master="local[2]"):
        self.conf = _Conf(conf)
        self.sparkContext = _Ctx(ckpt, master)


def test_configured_folder_is_used_and_never_replaced():
    s = _Session({"spark.checkpoint.dir": "hdfs://cluster/shared/ckpt"})
    assert shared_dir(s) == "hdfs://cluster/shared/ckpt"
    assert s.sparkContext.set_calls == []
    p = unique_shared_path(s, "gold")
    assert p.startswith("hdfs://cluster/shared/ckpt/gold-")


def test_context_folder_is_used_when_conf_is_absent():
    s = _Session({}, ckpt="s3a://bucket/ckpt/uuid")
    assert shared_dir(s) == "s3a://bucket/ckpt/uuid"
    assert s.sparkContext.set_calls == []


def test_local_folder_only_when_nothing_is_set():
    s = _Session({})
    d = shared_dir(s)
    assert os.path.isdir(d) and s.sparkContext.set_calls == [d]
    assert shared_dir(s) == d  # stable afterwards


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_a_cluster_without_a_shared_folder_is_refused(master):
    with pytest.raises(RuntimeError):
        shared_dir(_Session({}, master=master))
