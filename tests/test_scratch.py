import os

import pytest

from tidemark.sources import scratch


def local(path):
    return path.removeprefix("file://")


def test_what_a_block_writes_goes_with_it(spark):
    outer = scratch.shared_path(spark, "outer")
    spark.range(3).write.parquet(outer)
    with scratch.temporary(spark) as keep:
        kept, gone = scratch.shared_path(spark, "kept"), scratch.shared_path(spark, "gone")
        spark.range(3).write.parquet(kept)
        spark.range(3).write.parquet(gone)
        with scratch.temporary(spark):
            inner = scratch.shared_path(spark, "inner")
            spark.range(3).write.parquet(inner)
        assert not os.path.exists(local(inner)) and os.path.exists(local(gone))
        keep(kept)
    assert os.path.exists(local(outer)) and os.path.exists(local(kept)) and not os.path.exists(local(gone))
    with pytest.raises(ValueError, match="lost"), scratch.temporary(spark):
        late = scratch.shared_path(spark, "late")
        spark.range(3).write.parquet(late)
        raise ValueError("lost")
    assert not os.path.exists(local(late)) and spark.read.parquet(kept).count() == 3
    scratch.remove(spark, kept)
    assert not os.path.exists(local(kept))
