"""Checkpoint-folder rules: read from the session; a private folder only in local mode."""

import pytest

from tablewise import session as S


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _SC:
    def __init__(self, master, conf=None, current=None):
        self.master = master
        self._conf = _Conf(conf or {})
        self.current = current
        self.set_to = None

    def getCheckpointDir(self):
        return self.current

    def getConf(self):
        return self._conf

    def setCheckpointDir(self, path):
        self.set_to = path
        self.current = path


class _Spark:
    def __init__(self, sc, conf=None):
        self.sparkContext = sc
        self.conf = _Conf(conf or {})


def test_cluster_without_checkpoint_dir_is_an_error():
    with pytest.raises(RuntimeError):
        S.ensure_checkpoint_dir(_Spark(_SC("yarn")))


def test_cluster_uses_the_configured_shared_folder():
    sc = _SC("yarn")
    spark = _Spark(sc, {"spark.checkpoint.dir": "hdfs:///shared/ckpt"})
    assert S.ensure_checkpoint_dir(spark) == "hdfs:///shared/ckpt"
    assert sc.set_to == "hdfs:///shared/ckpt"


def test_existing_setting_wins_and_local_gets_a_private_folder():
    assert S.ensure_checkpoint_dir(_Spark(_SC("yarn", current="s3a://b/ck"))) == "s3a://b/ck"
    sc = _SC("local[4]")
    path = S.ensure_checkpoint_dir(_Spark(sc))
    assert sc.set_to == path and "tablewise-ckpt-" in path
