"""Intermediates: the shared folder, and tables derived once per application."""

import os

import kbspark.session as session
from kbspark.session import clear_intermediates, derived_once, ensure_checkpoint_dir, intermediate_folder, intermediate_path


def test_the_session_names_its_checkpoint_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert named and ensure_checkpoint_dir(spark) == named == ensure_checkpoint_dir(spark)
    assert intermediate_folder(spark).startswith(named)


def test_derived_tables_follow_their_source(spark, tmp_path):
    made = []

    def build():
        made.append(len(made))
        path = intermediate_path(spark, "t-derived")
        spark.range(3).write.parquet(path)
        return path

    (tmp_path / "t.parquet").write_text("one")
    first = derived_once(spark, str(tmp_path), "x", build)
    assert derived_once(spark, str(tmp_path), "x", build) == first and made == [0]
    (tmp_path / "t.parquet").write_text("changed")
    assert derived_once(spark, str(tmp_path), "x", build) != first and made == [0, 1]


def test_clearing_forgets_what_it_deletes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "intermediate_folder", lambda s: f"{tmp_path}/own")
    monkeypatch.setattr(session, "_DERIVED", {})
    (tmp_path / "in").mkdir()
    path = derived_once(spark, f"{tmp_path}/in", "y", lambda: intermediate_path(spark, "t"))
    spark.range(3).write.parquet(path)
    clear_intermediates(spark)
    assert not session._DERIVED and not os.path.isdir(path)
    assert derived_once(spark, f"{tmp_path}/in", "y", lambda: 2) == 2
