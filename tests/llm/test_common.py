import os

import pytest

from shelfcast.llm.common import Shared, intermediates, shared_dir
from shelfcast.llm.mixing import mix_digest
from shelfcast.llm.near_dup import near_duplicates


def runs(spark):
    where = f"{shared_dir(spark).removeprefix('file://')}/shelfcast-llm"
    return set(os.listdir(where)) if os.path.isdir(where) else set()


def test_intermediates_are_deleted_with_their_block(spark, make_docs, tmp_path):
    docs, before = make_docs([(i, f"some words of text {i % 7} " * 3) for i in range(50)]), runs(spark)
    with intermediates():
        near_duplicates(docs).write.parquet(str(tmp_path / "a"))
        with intermediates():
            mix_digest(docs).write.parquet(str(tmp_path / "b"))
        assert len(runs(spark) - before) == 1
    assert runs(spark) == before
    assert spark.read.parquet(str(tmp_path / "a")).count() == spark.read.parquet(str(tmp_path / "b")).count() == 50
    with pytest.raises(KeyError), intermediates():
        Shared(spark, "fails").write(docs, "x")
        raise KeyError
    assert runs(spark) == before


def test_a_run_knows_its_tables(spark):
    store = Shared(spark, "tables")
    store.write(spark.range(3), "a")
    store.write(spark.range(4), "b")
    store.drop("a")
    assert store.tables() == ["b"] and os.listdir(store.path.removeprefix("file://")) == ["b"]
