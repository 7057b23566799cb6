from tablewright.session import clear_scratch, materialise, scratch_path, shared_dir
from tablewright.sources.paths import path_exists


def test_scratch_is_qualified_and_cleared(spark, monkeypatch):
    from tablewright import session

    monkeypatch.setattr(session, "_made", [])  # what other tests hold stays
    assert shared_dir(spark).startswith("file:/")
    kept = materialise(spark.range(3), "kept")
    assert kept.count() == 3
    path = session._made[-1]
    unused = scratch_path(spark, "unused")
    assert path_exists(spark, path) and not path_exists(spark, unused)
    assert clear_scratch(spark) == 1 and not path_exists(spark, path) and not session._made
