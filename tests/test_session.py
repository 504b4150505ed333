"""Staged tables and their clean-up."""

import os

import pytest

from codeloom import session


def test_release_deletes_own_folder_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "stage_root", lambda _: str(tmp_path))
    other = tmp_path / "codeloom/app-of-another/table"
    other.mkdir(parents=True)
    staged = session.stage(spark.range(5), "numbers")
    assert staged.count() == 5 and os.path.isdir(session.run_folder(spark))
    session.release(spark)
    assert not os.path.exists(session.run_folder(spark)) and other.is_dir()
    session.release(spark)  # nothing left to delete


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Cluster:
        conf = Conf
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.stage_root(Cluster)


def test_staged_tables_are_written_small(spark, tmp_path):
    session.stage_at(spark.range(10), str(tmp_path / "t"))
    assert [f.name for f in (tmp_path / "t").glob("part-*")] and all(
        f.name.endswith(".zstd.parquet") for f in (tmp_path / "t").glob("part-*")
    )
