from __future__ import annotations

import os

import pytest

from framewright import storage


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class Session:
    def __init__(self, **conf):
        self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError):
        storage.shared_dir(Session(spark_master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        storage.shared_dir(Session(spark_master="yarn"))
    assert storage.shared_dir(Session(spark_master="yarn", spark_checkpoint_dir="hdfs://x/y/")) == "hdfs://x/y"
    assert storage.shared_dir(Session(spark_master="local[4]")).startswith("file://")


def test_tables_of_a_step_are_deleted(spark):
    with storage.scratch() as keep:
        a = storage.materialize(spark.range(5))
        gone = storage._written[-1][1]
        b = keep(storage.materialize(a.filter("id > 1")))
        kept = storage._written[-1][1]
    exists = lambda p: os.path.exists(p.removeprefix("file://"))
    assert b.count() == 3 and exists(kept) and not exists(gone)


def test_shuffle_files_of_a_written_step_are_deleted(spark):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv
    held = lambda: env.get().mapOutputTracker().shuffleStatuses().size()
    before, was = held(), spark.conf.get(storage.CLEANUP)
    d = storage.materialize(spark.range(1000).repartition(3, "id"))
    assert held() <= before and d.count() == 1000 and spark.conf.get(storage.CLEANUP) == was
