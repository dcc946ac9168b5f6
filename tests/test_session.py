"""Intermediate tables: where they lie, and that they go."""

import os
from types import SimpleNamespace

import pytest

from tessera import session


def test_a_cluster_needs_a_shared_folder():
    def fake(master, named):
        folder = []
        sc = SimpleNamespace(master=master, getCheckpointDir=lambda: folder[0] if folder else None, setCheckpointDir=folder.append)
        return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda key, default: named))

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://host"):
        with pytest.raises(RuntimeError):
            session.shared_folder(fake(master, None))
        assert session.shared_folder(fake(master, "hdfs://host/folder")) == "hdfs://host/folder"
    assert os.path.isabs(session.shared_folder(fake("local[2]", None)))


def test_steps_remove_what_they_made(spark):
    first = len(session._MADE)
    seen = []

    def step(df):
        side = session.store(df.selectExpr("id + 100 AS id"))
        seen.append(list(session._MADE[first:]))
        return session.checkpoint(df.unionByName(side))

    out = session.in_steps(spark.range(3), [step, step])
    assert out.count() == 12 and len(session._MADE) == first + 1
    paths = {p.removeprefix("file:") for made in seen for p in made}
    assert len(paths) == 3 and not any(os.path.exists(p) for p in paths)
    last = session._MADE[-1].removeprefix("file:")
    assert os.path.exists(last)
    session.release(spark, first)
    assert not os.path.exists(last)


def test_small_sides_only_are_broadcast(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    df = spark.range(10)
    assert "broadcast" in plan(df.join(session.small(df), "id")) and "broadcast" not in plan(df.join(session.small(df, 9), "id"))
