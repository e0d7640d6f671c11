"""Tables in the shared folder live as long as they are needed."""

from pathlib import Path

import pytest

from textguard.scratch import shared_dir, stage, temporary_tables


def test_staged_tables_go_with_their_block(spark, tmp_path):
    root = Path(shared_dir(spark, "probe")).parent
    kept = stage(spark.range(3), "kept")
    before = set(root.iterdir())
    with temporary_tables(spark):
        outer = stage(kept.filter("id > 0"), "outer")
        with temporary_tables(spark):
            assert stage(outer, "inner").count() == 2
            assert len(set(root.iterdir()) - before) == 2
        assert len(set(root.iterdir()) - before) == 1
        outer.write.parquet(str(tmp_path / "result"))
    assert set(root.iterdir()) == before
    assert spark.read.parquet(str(tmp_path / "result")).count() == 2 and kept.count() == 3


def test_staged_tables_go_after_an_error(spark):
    root = Path(shared_dir(spark, "probe")).parent
    stage(spark.range(1), "kept")
    before = set(root.iterdir())
    with pytest.raises(RuntimeError, match="stop"), temporary_tables(spark):
        stage(spark.range(3), "lost")
        raise RuntimeError("stop")
    assert set(root.iterdir()) == before
